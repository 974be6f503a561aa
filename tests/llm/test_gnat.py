"""Hard negatives against brute force, and the trees that find them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codetally.llm import gnat

SCHEMA = "vec_id long, embedding array<double>, label int, cell int, rank int, anchor int, v int, id int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA).repartition(parts)


def brute_force(rows, positives=5, negatives=3):
    usable = {
        (i, label, tuple(math.floor(256 * x) for x in v))
        for i, v, label in rows
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)
    }
    result = []
    for i, label, v in usable:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, u)), j, m) for j, m, u in usable)
        for s, j, _ in [r for r in scored if r[2] == label and r[1] != i][:positives]:
            fits = [r for r in scored if r[2] != label and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            result += [(i, j, rank + 1, r[1], -s, -r[0]) for rank, r in enumerate(fits)]
    return sorted(result)


def mined(df, **options):
    return sorted(map(tuple, gnat.mine_hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect()))


def random_rows(n, dim, seed, ids=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [
        (int(i * ids), (centres[rng.integers(6)] + 0.4 * rng.normal(size=dim)).round(2).tolist(), int(rng.integers(4)))
        for i in range(n)
    ]


@pytest.mark.parametrize("options", [{}, {"top_cells": 5, "tree_bytes": 1, "anchors_per_lot": 7}])
def test_random_vectors(spark, options):
    rows = random_rows(1500, 5, 1)
    rows += [(2000 + i, [0.5, 0.25, 0.0, 1.0, 0.5], i % 3) for i in range(700)]
    rows += [rows[50], rows[50], rows[7], (50, rows[3][1], 2), (100, rows[100][1], 3), (-50, [0.1] * 5, 1)]
    rows += [(4000, None, 1), (4050, [1.0, None, 0.0, 0.0, 0.0], 1), (4100, [math.nan] * 5, 2), (None, [0.0] * 5, 1)]
    rows += [(4150, [math.inf] * 5, 2), (4200, [0.5] * 5, None), (4250, [], 1), (4300, [1.0, 0.5], 0), (4350, [0.0] * 5, 0)]
    assert mined(frame(spark, rows, 5), **options) == brute_force(rows)


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i * 10, (rng.normal(size=3) * 1e6).tolist(), i % 2) for i in range(120)]
    expected = brute_force(rows)
    assert max(r[4] for r in expected) > 1 << 53
    assert mined(frame(spark, rows)) == expected


def test_nothing(spark):
    assert mined(frame(spark, []).limit(0)) == []
    assert mined(frame(spark, [(1, [1.0], 0), (2, [1.0], 1)])) == []
    assert mined(frame(spark, [(50, [1.0], 0)])) == []
    assert mined(frame(spark, [(50, None, 0), (100, [1.0], None)])) == []


def test_windows_leave_subtrees_out():
    rng = np.random.default_rng(5)
    centres = 100 * rng.normal(size=(40, 8))
    x = np.floor(centres[rng.integers(40, size=20_000)] + rng.normal(size=(20_000, 8)))
    ids, labels = np.arange(20_000), rng.integers(3, size=20_000)
    space = gnat.Space(float((x * x).sum(axis=1).max()))
    tree = gnat.Tree(space, ids, labels, x)
    q = x[:50]
    scores = (q @ x.T).astype(np.int64)
    best = np.sort(scores, axis=1)[:, -400][:, None]
    seen = 0

    class Counting(gnat.Search):
        def see(self, space, active, ids, labels, x):
            nonlocal seen
            seen += len(active) * len(ids)
            super().see(space, active, ids, labels, x)

    search = Counting(ids[:50], labels[:50], q, best // 2, best, 3, False)
    tree.search(space, search, np.arange(50))
    assert 0 < seen < 0.3 * scores.size, "ranges of split points leave most rows out"
    for i in range(50):
        fits = (labels != labels[i]) & (scores[i] >= best[i, 0] // 2) & (scores[i] <= best[i, 0])
        order = np.lexsort((ids, -scores[i]))
        assert search.found[i, 0].tolist() == [j for j in order if fits[j]][:3]


def test_few_anchors_share_a_lot():
    assert gnat._shared_lots([3, 0, 2, 25, 1, 9, 10], 10) == [(0, 1), (0, 1), (0, 1), (1, 3), (4, 1), (4, 1), (5, 1)]
