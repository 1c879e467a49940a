"""Hard negatives against every pair."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<double>"


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    usable = set()
    for i, label, x in rows:
        if i is None or label is None or not x or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(math.floor(256 * c) for c in x)
        if sum(c * c for c in v) < 2**62:
            usable.add((i, label, v))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, label, v in usable:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, other) for j, other, w in usable if j != i)
        for s, j, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s][:negatives]
            out += [(i, j, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, is_anchor, **options):
    df = spark.createDataFrame(rows, SCHEMA).select("*", F.lit(1).alias("anchor"), F.lit("x").alias("windows"), F.lit(2).alias("v"), F.lit(3).alias("block"))
    return sorted(map(tuple, hard_negatives.mine(df, is_anchor(F.col("vec_id")), **options).collect()))


def cloud(n, width, seed, labels=3, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, width))
    return [(k, int(rng.integers(labels)), (centres[rng.integers(12)] + spread * rng.normal(size=width)).tolist()) for k in range(n)]


def test_several_blocks_rounds_and_parts(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "TASK_QUERIES", 40)
    monkeypatch.setattr(hard_negatives, "WIDEN", 3)
    rows = cloud(1200, 6, 1)
    tenth = lambda i: i % 10 == 0
    want = plain(rows, tenth)
    assert len(want) > 500
    assert mined(spark, rows, tenth) == want


def test_ties_repeats_and_one_common_vector(spark):
    """Nine rows of ten hold one vector; small whole components tie often."""
    rng = random.Random(4)
    rows = [(k, rng.randrange(3), [rng.randrange(-2, 3) / 256 for _ in range(3)]) for k in range(60)]
    rows += [(1000 + k, k % 4, [1 / 256, 1 / 256, 2 / 256]) for k in range(500)]
    rows += rows[:30] + [(7, 1, [9.0, 1.0, 1.0]), (7, 2, [8.0, 1.0, 1.0]), (0, 0, [1.0, 2.0, 3.0])]
    few = lambda i: i % 100 == 0
    assert mined(spark, rows, few) == plain(rows, few)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = cloud(40, 4, 2) + [
        (100, 1, None), (101, None, [1.0] * 4), (None, 1, [1.0] * 4), (102, 1, [1.0, None, 1.0, 1.0]), (103, 1, [inf, 0.0, 0.0, 0.0]), (104, 1, [nan, 0.0, 0.0, 0.0]),
        (105, 1, []), (106, 1, [0.0] * 4), (107, 2, [0.0] * 4), (108, 0, [2.0]), (109, 1, [1.0, 1.0]), (110, 0, [0.5] * 9), (111, 1, [1e300] * 4), (112, 1, [-1.0, -1.0, 0.0, 0.0]),
    ]
    every = lambda i: i >= 0
    want = plain(rows, every)
    assert want and mined(spark, rows, every) == want


@pytest.mark.parametrize("size", [2.0e4, 3.0e6])
def test_long_vectors_are_exact(spark, size):
    """Scores beyond 2**53 are still whole numbers without rounding."""
    rng = random.Random(8)
    rows = [(k, k % 2, [size * (1 + rng.random() / 1e6) for _ in range(5)]) for k in range(50)] + [(90 + k, 1, [0.7 * size * (1 + rng.random() / 1e9) for _ in range(5)]) for k in range(20)]
    all_ = lambda i: i < 50
    assert mined(spark, rows, all_) == plain(rows, all_)


def test_no_rows_no_anchors_one_label(spark):
    some = lambda i: i % 2 == 0
    assert mined(spark, [(1, 0, None)], some) == []
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).collect() == []
    rows = [(k, 0, [1.0, k / 10]) for k in range(9)]
    assert mined(spark, rows, some) == []
    assert mined(spark, cloud(30, 3, 3), lambda i: i < 0) == []


def test_other_counts_and_percents(spark):
    rows = cloud(300, 3, 9, labels=2)
    some = lambda i: i % 9 == 0
    options = {"positives": 2, "negatives": 7, "low": 20, "high": 110}
    assert mined(spark, rows, some, **options) == plain(rows, some, **options)


def test_blocks_far_away_are_not_scanned():
    """The bounds of a directory hold for every vector and rule out far blocks."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(0, 50, (200, 4)) + 1000 * k for k in range(5)])
    space = hard_negatives.Space(int((x**2).sum(axis=1).max()), 4, x[::200])
    keys = space.keys(x, True)
    pivot = keys.argmin(axis=1)
    directory = object.__new__(hard_negatives.Directory)
    directory.block = directory.pivot = np.arange(5)
    directory.lo = np.array([keys[pivot == p, p].min() for p in range(5)])
    directory.hi = np.array([keys[pivot == p, p].max() for p in range(5)])
    directory.names, directory.first = np.unique(directory.block, return_index=True)
    q = x[::37]
    near, far = directory.bounds(space.keys(q, False))
    true = space.distance((q**2).sum(axis=1), q @ x.T)
    for p in range(5):
        assert (true[:, pivot == p] >= near[:, [p]] - space.slack).all() and (true[:, pivot == p] <= far[:, [p]] + space.slack).all()
    assert (near > 0).sum() > len(q)
