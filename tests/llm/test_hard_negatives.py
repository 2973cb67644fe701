"""Hard negatives beside plain Python, and exact products by residues."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sentinela.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row string, score long, width int"


def plain(rows):
    units = []
    for key, values, label in rows:
        if key is None or label is None or values is None or any(
                v is None or not math.isfinite(v) for v in values):
            continue
        units.append((key, (label + 1) % 10 if key % 7 == 0 else label,
                      [math.floor(256 * float(np.float32(v))) for v in values]))
    out = []
    for a, (key, label, own) in enumerate(units):
        if key % 100:
            continue
        others = [(-sum(x * y for x, y in zip(own, v)), k, s == label)
                  for b, (k, s, v) in enumerate(units) if b != a and len(v) == len(own)]
        for score, positive, _ in sorted(o for o in others if o[2])[:5]:
            near = sorted(o for o in others if not o[2] and 80 * -score <= 100 * -o[0] <= 100 * -score)[:5]
            out += [(key, positive, rank, k, -score, -s) for rank, (s, k, _) in enumerate(near, 1)]
    return sorted(out)


def found(spark, rows):
    table = spark.createDataFrame([(*r, "r", 1, 2) for r in rows], SCHEMA).repartition(4)
    got = hard_negatives.mine_negatives(table)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


def awkward():
    pick = random.Random(8)
    rows = [(k, [pick.gauss(0.3, 0.5) for _ in range(6)], pick.randrange(10)) for k in range(0, 1200, 3)]
    same = [0.5, 0.5, 0.5, 0.5, 0.0, 0.0]
    rows += [(k, same, k % 4) for k in range(2000, 2120)]           # ties
    rows += [(300, same, 2), (300, same, 2), (400, [0.1] * 6, 5), (401, same, 1), (401, same, 1)]
    rows += [(None, same, 1), (500, None, 1), (600, same, None), (700, [0.5, None, 0.0, 0.0, 0.0, 0.0], 1),
             (800, [float("nan")] * 6, 1), (900, [float("inf")] * 6, 1), (1000, [], 1), (1001, [], 2),
             (1003, [], 1), (1100, [0.0] * 6, 3), (3000, [1.0, 2.0], 1), (3001, [1.0, 2.0], 1),
             (3002, [0.9, 2.0], 2), (-100, [-0.4] * 6, -1), (-99, [-0.4] * 6, -1)]
    return rows


@pytest.mark.parametrize("block", [None, 90])
def test_negatives_of_awkward_rows(spark, block, monkeypatch):
    if block:
        monkeypatch.setattr(hard_negatives, "ROW_BLOCK", block)
        monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 3)
        monkeypatch.setattr(hard_negatives, "SLICE", 2)
    rows = awkward()
    assert found(spark, rows) == plain(rows)


def test_negatives_of_no_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0], 1)]) == []
    assert found(spark, [(None, None, None)]) == []


@pytest.mark.parametrize("bits,width", [(1, 1), (8, 64), (9, 3000), (27, 300), (30, 5)])
def test_residue_products_are_exact(bits, width):
    pick = np.random.default_rng(bits)
    a, b = (pick.integers(-(1 << bits), (1 << bits) + 1, (n, width)) for n in (5, 11))
    a[0], b[0] = 1 << bits, -(1 << bits)        # the largest score there is
    bound = width << 2 * bits
    primes = hard_negatives.primes_for(bound)
    assert math.prod(primes) > 2 * bound and math.prod(primes[:-1]) <= 2 * bound
    assert (hard_negatives.scores(a, b, primes) == a @ b.T).all()


def test_scores_beyond_64_bits_are_an_error():
    with pytest.raises(OverflowError):
        hard_negatives.primes_for(1 << 63)
