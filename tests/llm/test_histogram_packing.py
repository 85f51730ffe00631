"""Packing over the length histogram: every id once, no gaps, no padding."""

import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from landsieve.llm import histogram_packing as P
from landsieve.llm.common import word_tokenizer
from landsieve.llm.word_encode import PLAIN, WordEncoder
from tests.llm.fixtures import DOCS, frame, odd_texts, sentence


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_tokenizer())


def padding(pieces, capacity):
    """Padded ids of (sequence, offset, length) rows; they must fill their sequences from the start."""
    sequences, total = defaultdict(list), 0
    for sequence, offset, length in pieces:
        sequences[sequence].append((offset, length))
    for items in sequences.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
        total += capacity - at if at & (at - 1) else 0
    return total


def test_word_encoder_equals_the_library(library):
    encode, rng = WordEncoder(word_tokenizer()), random.Random(2)
    bits = [*"abcABC'123 .,!?\n\t", "'s", "'LL", "don't", "é", "ß", "Σ", "İ", "²", "½", "一", "😀", "\x1c", "\x85", " ", "​", "́",
            "<|endoftext|>", "<|startoftext|>", "  ", "$$", *rng.sample(PLAIN, 60)]
    scraps = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(3000)]
    assert all(unicodedata.is_normalized("NFC", c) for c in PLAIN)
    for text in [*scraps, *filter(None, odd_texts()), " " * 9000 + "x"]:
        assert np.frombuffer(encode(text), "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_shortest_pack_first(seed):
    """Patterns hold exactly the histogram, and equal placing documents one by one into the emptiest pack."""
    rng, capacity = random.Random(seed), 32
    histogram = Counter(rng.randrange(1, rng.choice([5, 33])) for _ in range(300))
    patterns, held = P.shortest_pack_first(histogram, capacity), Counter()
    for p in patterns:
        assert p.used == sum(n * k for n, k in p.slots) <= capacity
        for n, k in p.slots:
            held[n] += k * p.packs
    assert held == histogram
    fills = []
    for n in sorted(histogram.elements(), reverse=True):
        low = min(range(len(fills)), key=fills.__getitem__, default=None)
        if low is None or fills[low] + n > capacity:
            fills.append(n)
        else:
            fills[low] += n
    assert Counter(fills) == Counter({u: sum(p.packs for p in patterns if p.used == u) for u in {p.used for p in patterns}})


def test_patterns_don_t_grow_with_the_counts():
    few, many = ({n: k * (n % 7 + 1) for n in range(1, 2049)} for k in (1, 10**9))
    assert len(P.shortest_pack_first(many, 2048)) <= len(P.shortest_pack_first(few, 2048)) + 2048
    assert P.shortest_pack_first({1024: 10**12}, 2048) == [P.Pattern(5 * 10**11, ((1024, 2),), 2048)]


def test_plan_places_every_token():
    rng = random.Random(0)
    for _ in range(300):
        capacity = rng.choice([1, 2, 8, 16, 64])
        sizes = [rng.randrange(1, rng.choice([2, capacity + 1, capacity * 4 + 2])) for _ in range(rng.randrange(120))]
        plan = P.Plan(Counter(n for n in sizes if n <= capacity), sum(n for n in sizes if n > capacity), capacity)
        ranks, line, pieces = Counter(), 0, []
        for n in sizes:
            at = line
            if n <= capacity:
                sequence, offset, at = plan.of_rank(n, ranks[n])
                ranks[n] += 1
                if at < 0:
                    pieces.append((sequence, offset, n))
                    continue
            else:
                line += n
            own = [(sequence, offset, k) for k, sequence, offset in plan.of_line(at, n)]
            assert sum(k for *_, k in own) == n
            pieces += own
        assert padding(pieces, capacity) == 0


def check(spark, library, docs, rows, capacity):
    got = [tuple(r) for r in P.pack_histogram(docs, word_tokenizer(), capacity).collect()]
    want = Counter()
    for doc, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[doc, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert padding([(s, o, n) for _, _, n, _, _, s, o in got], capacity) == 0
    return got, want


@pytest.mark.parametrize("capacity", [64, 2048])
def test_pieces_cover_every_document(spark, library, capacity):
    rng = random.Random(4)
    rows = list(enumerate([*odd_texts(), *[sentence(rng, rng.randrange(1, 60)) for _ in range(150)]]))
    got, _ = check(spark, library, frame(spark, rows, ["size", "task", "place"]), rows, capacity)
    pieces = defaultdict(list)
    for doc, start, n, crc, total, _, _ in got:
        pieces[doc].append((start, n, crc, total))
    assert set(pieces) == {i for i, _ in rows}
    for doc, text in rows:
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for start, n, crc, total in sorted(pieces[doc]):
            assert (start, total, crc) == (at, len(ids), zlib.crc32(ids[start:start + n].tobytes()))
            at += n
        assert at == len(ids)


def test_repeats_null_ids_and_empty_table(spark, library):
    rows = [(1, "one two three four five")] * 5 + [(None, "six"), (None, None), (1, "")]
    got, want = check(spark, library, frame(spark, rows), rows, 2048)
    assert sum(r[2] for r in got) == sum(n * c for (_, n, _), c in want.items())
    assert P.pack_histogram(spark.createDataFrame([], DOCS), word_tokenizer()).collect() == []


def test_documents_that_fit_stay_whole(spark, library):
    """With long documents beside them to fill the rooms, short ones are not cut."""
    rng = random.Random(7)
    rows = list(enumerate([sentence(rng, rng.randrange(2, 14)) for _ in range(200)] + [sentence(rng, 4000) for _ in range(2)]))
    got, _ = check(spark, library, frame(spark, rows), rows, 64)
    assert all(n == total for _, _, n, _, total, _, _ in got if total <= 64)
