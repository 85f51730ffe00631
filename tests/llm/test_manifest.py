"""The manifest against a tree built by hand."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from landsieve.llm import manifest as M
from tests.llm.fixtures import odd_texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def beside(levels, i):
    out = []
    for level in levels[:-1]:
        start = i // 16 * 16
        out.append(("".join(level[start:i]), "".join(level[i + 1:start + 16])))
        i //= 16
    return out


def by_hand(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sources = defaultdict(list)
    for doc, text, lang, source, n in rows:
        leaf = digest("".join(map(part, (doc, source, lang, n, text))))
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0
        other = digest("".join(map(part, (doc, source, lang, n, lower(text))))) if hit else leaf
        sources[source].append((doc is not None, doc or 0, leaf, other, doc))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(sources[s])]) for s in order}
    top, out = tree([trees[s][-1][0] for s in order]), []
    for k, s in enumerate(order):
        for i, (_, _, leaf, other, doc) in enumerate(sorted(sources[s])):
            sides = beside(trees[s], i) + beside(top, k)
            folded = other
            for before, after in sides:
                folded = digest(before + folded + after)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], digest("".join(a + b for a, b in sides)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, extra=""):
    full = [(*r, *([9] * (extra.count(",")))) for r in rows]
    docs = spark.createDataFrame(full, DOCS + extra).repartition(3)
    return sorted((tuple(r) for r in M.manifest(docs, M.tampered_fifth(F.col("doc_id"))).collect()), key=str)


def table(n_sources, n, seed, ids=None):
    rng = random.Random(seed)
    ids = ids or rng.sample(range(-10**6, 10**12), n)
    return [(i, f"Text {i % 11} Ä {'x' * rng.randrange(5)}", rng.choice(["en", None]), rng.choice([*"ABCé"[:n_sources], None]), rng.choice([3, None]))
            for i in ids]


@pytest.mark.parametrize("rows", [
    table(4, 700, 1),  # ids from all over the range, several levels, a null source
    [(i, "T", "en", "one", 1) for i in range(257)],  # one more than a full tree of two levels
    [(i, "T", "en", f"s{i}", 1) for i in range(40)],  # sources of one leaf
    [(-2**63, "A", "x", "s", 0), (2**63 - 1, "B", "x", "s", 0), (-1, "C", "x", "s", 0), (0, "D", "x", "s", 0)],
    [(5, None, None, None, None)],
], ids=["spread", "levels", "lone", "ends", "single"])
def test_equals_a_tree_by_hand(spark, rows):
    assert run(spark, rows) == by_hand(rows)


def test_ties_nulls_and_clashing_columns(spark):
    """Repeated ids, repeated rows and rows without id are leaves of their own."""
    rows = [(i % 7 if i % 3 else None, t, "en", "s" if i % 2 else None, i % 4) for i, t in enumerate([*odd_texts(), *odd_texts(2)])]
    assert run(spark, rows, ", tree string, pos long, h long, n long".replace("string", "long")) == by_hand(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_bitmap_directory(spark):
    """Words, popcounts and the counts before them equal those of the sorted ids, across all steps of the directory."""
    rng = random.Random(3)
    ids = {rng.choice([rng.randrange(300), rng.randrange(10**6), rng.randrange(-2**62, 2**62)]) for _ in range(3000)}
    got = M.id_bitmap(spark.createDataFrame([("t", i) for i in ids], "tree string, doc_id long")).collect()
    order = sorted(ids)
    assert sum(r["ids"] for r in got) == len(order) and {r["total"] for r in got} == {len(order)}
    for r in got:
        mine = [i for i in order if i >> 6 == r["word"]]
        assert r["first"] == order.index(mine[0]) and r["ids"] == r["rows"] == len(mine)
        assert r["bits"] & (2**64 - 1) == sum(1 << (i & 63) for i in mine)


def test_leaves_are_not_sorted(spark):
    """Coordinates come from the directory: no sort of the leaves but for their join to it."""
    docs = spark.createDataFrame(table(2, 50, 5), DOCS)
    placed = M.leaves(docs, F.lit(False))
    plan = M.ranked(placed, M.id_bitmap(placed))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort [" not in plan
