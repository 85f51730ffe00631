"""Packed products and mined negatives against plain sums."""

import random

import numpy as np
import pytest

from landsieve.llm import hard_negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, every=50, positives=5, negatives=3):
    good = [r for r in rows if None not in r and all(x is not None and np.isfinite(x) for x in r[1])]
    seen = sorted({(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v, lab in good})
    out = []
    for i, label, v in seen:
        if i % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), j, lab) for j, lab, w in seen if j != i)
        for p, j, _ in [s for s in scores if s[2] == label][:positives]:
            fits = [s for s in scores if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(i, j, k, c, -p, -s) for k, (s, c, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(n, dim, seed, labels=4, step=5):
    """Small grids of values, so that scores tie often."""
    rng = random.Random(seed)
    return [(i * step, [rng.randrange(-3, 4) / 8 for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


def run(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in N.mine(spark.createDataFrame(rows, schema).repartition(3)).collect())


@pytest.mark.parametrize("scale", [1, 100, 2**20, 2**40])
def test_packed_products_are_exact(scale):
    """Fields of one integer give back each score, in machine words and past them."""
    rng = np.random.default_rng(scale)
    x, a = rng.integers(-scale, scale, (37, 9), endpoint=True), rng.integers(-scale, scale, (5, 9), endpoint=True)
    want = np.array([[sum(int(p) * int(q) for p, q in zip(u, v, strict=True)) for v in x] for u in a], dtype=object)
    got = N.PackedBlock(x, N._reach(a)).scores(a)
    assert (got == np.clip(want, -N.LONG, N.LONG)).all()
    block = N.PackedBlock(x, N._reach(a))
    assert block.fields > 1 or block.width > 32


def test_edges_of_a_field():
    """All components at one end, on both sides."""
    for u in (-7, 7):
        for v in (-5, 5):
            x, a = np.full((10, 16), v), np.full((3, 16), u)
            assert (N.PackedBlock(x, N._reach(a)).scores(a) == 16 * u * v).all()


@pytest.mark.parametrize("block", [8192, 40])
def test_equals_plain_sums(spark, monkeypatch, block):
    """One block and many, one group of anchors and several."""
    monkeypatch.setattr(N, "CANDIDATES", block)
    monkeypatch.setattr(N, "ANCHORS", 20 if block == 40 else 131_072)
    rows = vectors(400, 6, 1)
    got = run(spark, rows)
    assert got == by_hand(rows) and len(got) > 100


def test_odd_rows(spark, monkeypatch):
    """Nulls, non-finite numbers, repeats, lone labels, lengths, a very common vector and label."""
    monkeypatch.setattr(N, "CANDIDATES", 64)
    rows = vectors(200, 4, 2)
    rows += [(i, [0.5, 0.5, 0.25, 0.0], 1) for i in range(2000, 2150)] + [(i, [0.5, 0.4, 0.25, 0.0], 2) for i in range(3000, 3150)]
    rows += [rows[0], rows[0], (5000, None, 1), (5050, [0.1, None, 0.2, 0.3], 1), (5100, [float("nan"), 0.0, 0.0, 0.0], 1), (5150, [float("inf")] * 4, 1),
             (5200, [0.5] * 4, None), (None, [0.5] * 4, 1), (5250, [0.5] * 4, 9), (5300, [], 1), (5400, [0.5, 0.5], 1), (5450, [-0.5] * 6, 3)]
    assert run(spark, rows) == by_hand(rows)
    extra = run(spark, [(*r, 1, 2) for r in rows], SCHEMA + ", uid int, id int")
    assert extra == by_hand(rows)


def test_empty_table(spark):
    assert run(spark, []) == [] and run(spark, [(None, None, None)]) == []
