"""Strassen products and hard negatives against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatewright.llm import negatives

SCHEMA = "vec_id long, vector array<long>, label int, uid string, block string, score string, rank string"


def rows_of(spark, rows):
    """Vectors with extra columns whose names the operator uses itself."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (17, 64, 33), (65, 40, 129), (0, 4, 5), (4, 0, 5)])
@pytest.mark.parametrize("least", [1, 2, 8])
def test_products_are_exact(shape, least):
    draw = np.random.default_rng(1)
    m, k, n = shape
    for most in (300, 1 << 29):
        a, b = draw.integers(-most, most, (m, k)), draw.integers(-most, most, (k, n))
        assert np.array_equal(negatives.strassen(a, b, least).astype(object), a.astype(object) @ b.astype(object) if k else np.zeros((m, n), int))


def test_best_are_the_largest_then_the_first():
    draw = np.random.default_rng(2)
    for most in (1, 3, 5):
        scores, allowed = draw.integers(-4, 4, (30, 12)), draw.random((30, 12)) < 0.6
        row, column = negatives.best(scores, allowed, most)
        want = [(i, j) for i in range(30) for j in sorted(np.flatnonzero(allowed[i]), key=lambda j: (-scores[i, j], j))[:most]]
        assert list(zip(row.tolist(), column.tolist())) == want


def test_bounds_of_a_window():
    p = np.array([*range(-250, 250), (1 << 62) + 3, -(1 << 62) - 7])
    for percent in (80, 100, 33):
        assert negatives.lowest(p, percent).tolist() == [-(-percent * int(x) // 100) for x in p]
        assert negatives.highest(p, percent).tolist() == [percent * int(x) // 100 for x in p]


def brute(rows, positives=5, most=5, low=80, high=100):
    kept = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and None not in r[1]]
    out = []
    for i, (anchor, a, label) in enumerate(kept):
        if anchor % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a, b)), n, k, own) for k, (n, b, own) in enumerate(kept) if k != i)
        for p, pid, _, _ in [s for s in scored if s[3] == label][:positives]:
            window = [s for s in scored if s[3] != label and low * -p <= 100 * -s[0] <= high * -p]
            out += [(anchor, pid, r, n, -p, -s) for r, (s, n, _, _) in enumerate(window[:most], 1)]
    return out


def vectors(seed, n, width):
    draw = random.Random(seed)
    out = [(i, [draw.randint(-9, 30) for _ in range(draw.choice([width, width, width - 1]))], draw.choice([0, 0, 0, 1, 2, -5])) for i in range(n)]
    draw.shuffle(out)
    out += [(i, [1, 2, 3], 7) for i in range(5000, 5020)]  # ties
    return out + [(100, out[0][1], 1), (300, None, 1), (400, [1, None], 1), (500, [3], None), (None, [1], 1), (600, [], 0), out[5], out[5], (700, [-1] * width, 0)]


@pytest.mark.parametrize(("n", "width", "block"), [(350, 9, 4096), (350, 9, 50), (420, 33, 128)])
def test_negatives_equal_brute_force(spark, n, width, block):
    rows = vectors(n + block, n, width)
    found = negatives.mine(rows_of(spark, rows), F.col("vec_id") % 100 == 0, block_rows=block)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows)
    assert len(want) > 50
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_other_numbers_of_positives_and_bounds(spark):
    rows = vectors(3, 210, 6)
    found = negatives.mine(rows_of(spark, rows), F.col("vec_id") % 100 == 0, positives=2, negatives=3, low=50, high=95, block_rows=64)
    assert sorted(map(tuple, found.collect())) == sorted(brute(rows, 2, 3, 50, 95))


@pytest.mark.parametrize("rows", [[], [(1, [1, 2], 0), (2, [1, 2], 1)], [(100, [1, 2], 0)], [(100, [1, 2], 0), (101, [1, 2], 0)], [(100, [1, 2], 0), (101, [1, 2], 1)]])
def test_nothing_to_find(spark, rows):
    assert negatives.mine(rows_of(spark, rows), F.col("vec_id") % 100 == 0).count() == 0


def test_scaled_components_and_labels(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(7, [0.5, -0.001], 9), (8, [1.0, nan], 1), (9, [inf], 1), (10, [None], 1), (11, None, 1), (12, [], 1), (14, [1e30], 2), (21, [-1.5], None), (None, [0.1], 3)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.label, r.vector) for r in negatives.scaled(table).collect()}
    assert got == {7: (0, [128, -1]), 8: (1, None), 9: (1, None), 10: (1, None), 11: (1, None), 12: (1, []), 14: (3, None), 21: (None, [-384]), None: (3, [25])}
