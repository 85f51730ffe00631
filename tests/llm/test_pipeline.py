"""The pipeline as a whole against brute force, and its contract."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from landsieve.llm import quality
from landsieve.llm.common import default_tokenizer
from tests.llm.fixtures import DOCS, frame, odd_texts, sentence
from tests.llm.test_cleaning import base_spans, groups, measures, without_windows, words


def rule_fails(line):
    n = len(words(line))
    count = lambda pattern: len(re.findall(pattern, line))
    return ((count("[|»›•·]") >= 3 and count("[|»›•·]") * 100 >= n * 20) or (n >= 3 and not re.search(quality.FINAL.replace(r"\z", r"\Z"), line))
            or count(r"[#*$%&|<>]") * 100 > n * 30 or count("!!") * 100 > n * 30 or re.search("|".join(quality.BOILERPLATE), line.lower()))


def by_hand(rows):
    """(doc_id, text) after all stages but the last."""
    kept = []
    for i, text in rows:
        n, chars, _, _, repeats = measures(text)
        lines = [x for x in (text or "").split("\n") if words(x)]
        good = [x for x in lines if not rule_fails(x)]
        lost = chars - sum(len(w) for x in good for w in words(x))
        if n >= 10 and 100 * repeats <= 20 * n and 100 * lost <= 50 * chars:
            kept.append((i, "\n".join(good)))
    left = without_windows(kept)
    kept = [(i, left[i, t]) for i, t in kept]
    kept = [(i, t) for i, t in kept if words(t)]
    root, _ = groups(kept, 5, 80)
    best = {}
    for k, (i, _) in enumerate(kept):
        if root[k] not in best or i < kept[best[root[k]]][0]:
            best[root[k]] = k
    out = []
    for k in sorted(best.values()):
        i, text = kept[k]
        for _, start, end in sorted(base_spans(text), key=lambda s: -s[1]):
            text = text[:start] + "[SECRET]" + text[end:]
        out.append((i, text))
    return out


def table(seed=13):
    rng = random.Random(seed)
    body = lambda n: "\n".join(sentence(rng, 9) for _ in range(n))
    texts = [body(rng.randrange(2, 12)) for _ in range(60)]
    shared = body(4)
    texts += [f"{body(2)}\n{shared}\n{body(3)}" for _ in range(6)]
    near = body(2).split(" ")
    for _ in range(5):
        copy = list(near)
        copy[rng.randrange(1, 8)] = f"w{rng.randrange(99)}"
        texts.append(" ".join(copy))
    texts += [f"{body(3)}\nThe password: {sentence(rng, 1)[:-1]}longvalue ends here.", "Home | News | Sport | Shop | Mail\n" + body(3)]
    return list(enumerate([*texts, *odd_texts()]))


def test_run_matches_brute_force(spark, tmp_path):
    rows = table()
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    library, want = Tokenizer.from_file(default_tokenizer()), Counter()
    for i, text in by_hand(rows):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or 1024
        for k, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start:start + (1024 if k else first)]
            want[i, k, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert got == want


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "near_dedup", "secret_scan", "best_fit_packing"]
    docs = spark.createDataFrame([], DOCS + ", uid int, row int, lines int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "unused").count() == 0
