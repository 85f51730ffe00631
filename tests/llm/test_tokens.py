import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from landsieve.llm import automaton, encode, packing, separator_scan
from landsieve.llm.common import default_tokenizer
from tests.llm.fixtures import DOCS, frame, odd_texts

PATH = default_tokenizer()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def scraps(seed, n):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "\x85", " ", "​", "\x1c", "'s", "'LL", "a", "aa", "aaa", "é", "é", "1", "²", "½", "一",
            "😀", "<|endoftext|>", "don't", "$$", "...", "A", "the", "ing", "tion", "er", "\r\n", "ß", "ﬁ"]
    return ["".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(n)]


def test_encoder_equals_the_library(library):
    encoder = encode.Encoder(PATH)
    for text in [*scraps(1, 1500), *filter(None, odd_texts()), " " * 20_000 + "x", "x" + "\n" * 9_000]:
        assert encoder(text) == ids_of(library, text)
    assert encoder("a<|endoftext|>b", special=False) == encoder("a", special=False) + encoder("<|endoftext|>", False) + encoder("b")
    assert 50256 not in encoder("a<|endoftext|>b", special=False)


def test_automaton_equals_the_library(library):
    code = automaton.Coder(automaton.Automaton(*encode.vocabulary(PATH)))
    rng = random.Random(4)
    noise = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(97, 101), rng.randrange(160, 0x2100)]))
                     for _ in range(25)) for _ in range(1500)]
    for text in [*scraps(2, 1500), *noise, *filter(None, odd_texts()), "ab" * 20_000]:
        groups, want = code.encode(text), ids_of(library, text)
        assert [int(i) for g in groups for i in g.split(",")] == want
        assert code.decode(groups) == library.decode(want, skip_special_tokens=False)
    assert code.decode(["230"]) == library.decode([230], skip_special_tokens=False)  # half a character


def test_small_automaton_by_all_paths():
    """Every word has one path, and it is what merging by hand gives."""
    tokens = {b: i for i, b in enumerate([b"a", b"b", b"aa", b"ab", b"aab", b"ba", b"baab"])}
    merges = [(0, 0, 2), (0, 1, 3), (0, 3, 4), (1, 0, 5), (5, 3, 6)]
    auto = automaton.Automaton(tokens, merges, {})
    label = {i: t for t, i in tokens.items()}

    def by_hand(word):
        parts = [tokens[bytes([c])] for c in word]
        while True:
            pairs = [(k, m) for m, (u, v, _) in enumerate(merges) for k in range(len(parts) - 1) if (parts[k], parts[k + 1]) == (u, v)]
            if not pairs:
                return parts
            best = min(m for _, m in pairs)
            k = min(k for k, m in pairs if m == best)
            parts[k:k + 2] = [merges[best][2]]

    def paths(word, last=None):
        if not word:
            yield []
        for t, i in tokens.items():
            if i in auto.made and word.startswith(t) and (last is None or auto.has_arc(last, i)):
                for rest in paths(word[len(t):], i):
                    yield [i, *rest]

    for n in range(1, 11):
        for bits in range(2 ** n):
            word = bytes(97 + (bits >> k & 1) for k in range(n))
            all_ = list(paths(word))
            assert all_ == [by_hand(word)] == [auto.path(word)], word
            assert b"".join(label[i] for i in all_[0]) == word


def test_encode_decode_digests(spark, library):
    rows = [*enumerate([*odd_texts(), *scraps(3, 60)]), (None, "no id"), (1, "id again")]
    docs = frame(spark, rows, ["ids", "n_tokens"])
    got = automaton.encode_decode(docs, PATH).collect()
    want = []
    for i, text in rows:
        ids = ids_of(library, text)
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(str(type(got[0])(*w)) for w in want) or {tuple(r) for r in got} == set(want)
    assert automaton.encode_decode(spark.createDataFrame([], DOCS), PATH).count() == 0


# --- packing -----------------------------------------------------------------

def test_pieces_and_places(spark, library):
    rows = [*enumerate(odd_texts()), (None, "no id"), (3, "id again")]
    docs = frame(spark, rows, ["uid", "piece", "grp", "length"])
    got = packing.pack_documents(docs, PATH, capacity=64).collect()
    have = sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got)
    want, total = [], 0
    for i, text in rows:
        ids = np.array([*ids_of(library, text), 2], "<u4")
        total += len(ids)
        first = len(ids) % 64 or 64
        for k, start in enumerate([0, *range(first, len(ids), 64)]):
            part = ids[start:start + (64 if k else first)]
            want.append((str(i), k, start, len(part), zlib.crc32(part.tobytes())))
    assert have == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= -(-total // 64) * 1.02 + 1
    assert packing.pack_documents(spark.createDataFrame([], DOCS), PATH).count() == 0


def exact_bins(sizes, capacity):
    """Least number of bins by search."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= sizes[k]:
                left = list(rooms)
                left.remove(room)
                place(k + 1, [*left, room - sizes[k]])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_lower_bound_never_passes_the_optimum():
    rng = random.Random(6)
    tight = 0
    for _ in range(250):
        capacity = rng.choice([10, 13, 24])
        sizes = np.array([rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 9))])
        best = exact_bins(sizes.tolist(), capacity)
        bins, offsets, filled = packing.best_fit_decreasing(sizes, capacity)
        assert packing.lower_bound(sizes, capacity) <= best <= len(filled)
        tight += packing.lower_bound(sizes, capacity) == best
        for b in range(len(filled)):
            spans = sorted((int(o), int(o + s)) for o, s, x in zip(offsets, sizes, bins, strict=True) if x == b)
            assert [a for a, _ in spans] == [0, *[e for _, e in spans[:-1]]] and spans[-1][1] == filled[b] <= capacity
    assert tight > 230
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3  # by thresholds: the sum alone gives 2


def test_groups_with_gaps_exchange(spark):
    rng = np.random.default_rng(8)
    sizes = rng.integers(200, 700, 3000)
    pieces = spark.createDataFrame([(i, i, 0, 0, int(s), 0) for i, s in enumerate(sizes)], packing.PIECE_DDL).repartition(4)
    one = packing.pack(pieces, 1024, group_items=100, rounds=1)
    more = packing.pack(pieces, 1024, group_items=100, rounds=4)
    count = lambda d: d.select("sequence_id").distinct().count()
    assert more.count() == 3000 and more.select("doc_id").distinct().count() == 3000
    assert packing.lower_bound(sizes, 1024) <= count(more) <= count(one)
    over = more.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert over.filter("n > 1024 or n <> end").count() == 0


# --- separator scan ----------------------------------------------------------

@pytest.mark.parametrize("per_block, stretch", [(3, 4), (1, 1024), (7, 2)])
def test_scan_of_flat_files(spark, monkeypatch, per_block, stretch):
    monkeypatch.setattr(separator_scan, "STRETCH", stretch)
    rng = random.Random(5)
    rows, want = [], []
    for f, n in enumerate([40, 0, 1, 97, 60]):
        ids = [rng.choice([7, 7, 1, 2, 3, 4]) if f != 4 else 1 for _ in range(n)]
        at = order = 0
        for i, x in enumerate(ids):
            if x == 7:
                want.append((f, order, at, i - at, True))
                at, order = i + 1, order + 1
        if at < n:
            want.append((f, order, at, n - at, False))
        for b in range(0, n, per_block):
            rows.append((f, b // per_block, bytearray(np.array(ids[b:b + per_block], "<u2").tobytes())))
    rng.shuffle(rows)
    blocks = spark.createDataFrame(rows, "file long, block long, ids binary").repartition(5)
    got = separator_scan.token_counts(blocks, 7).collect()
    assert sorted((r.file, r.ordinal, r.start, r.n_tokens, r.ended) for r in got) == sorted(want)


def test_counts_of_documents(spark, library):
    rows = [*enumerate(odd_texts()), (None, "no id"), (3, "id again")]
    docs = frame(spark, rows, ["file", "block", "ends"])
    library.encode_special_tokens = True
    want = sorted((str(i), len(ids_of(library, t))) for i, t in rows)
    library.encode_special_tokens = False
    got = separator_scan.document_token_counts(docs, PATH)
    assert sorted((str(r.doc_id), r.n_tokens) for r in got.collect()) == want
    assert separator_scan.document_token_counts(docs.limit(0), PATH).count() == 0
