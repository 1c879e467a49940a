"""Interactions, resampling, checks of cells and ways to predict, on small tables."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import boosting, profile, ranking, regression, sampling, trees

FEATURES = ["a", "b", "c"]
#: Splits on ``a`` twice on one path, so a path's features are fewer than its tests.
DEEP = trees.Tree(
    [
        trees.Node("a", 0.5, left=1, right=2, count=10),
        trees.Node("b", 0.5, left=3, right=4, count=6),
        trees.Node(value=3.0, count=4),
        trees.Node("a", -0.5, left=5, right=6, count=4, default_left=False),
        trees.Node("c", 0.0, left=7, right=8, count=2),
        trees.Node(value=-1.0, count=1),
        trees.Node(value=2.0, count=3),
        trees.Node(value=5.0, count=1),
        trees.Node(value=0.25, count=1),
    ],
    0.5,
)


def worth(tree, row, known, at=0):
    """The output when only the known features are known, from the definition."""
    n = tree.nodes[at]
    if n.is_leaf:
        return tree.rate * n.value
    if n.feature in known:
        v = row[n.feature]
        left = n.default_left if v is None else v <= n.threshold
        return worth(tree, row, known, n.left if left else n.right)
    share = tree.nodes[n.left].count / n.count
    return share * worth(tree, row, known, n.left) + (1 - share) * worth(tree, row, known, n.right)


def definition(tree, row, a, b):
    rest = [f for f in FEATURES if f not in (a, b)]
    m = len(FEATURES)
    if a == b:
        own = sum(
            math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) * (worth(tree, row, {*s, a}) - worth(tree, row, set(s)))
            for k in range(m)
            for s in itertools.combinations(rest, k)
        )
        return own - sum(definition(tree, row, a, o) for o in FEATURES if o != a)
    return sum(
        math.factorial(k) * math.factorial(m - 2 - k) / (2 * math.factorial(m - 1)) * (worth(tree, row, {*s, a, b}) - worth(tree, row, {*s, a}) - worth(tree, row, {*s, b}) + worth(tree, row, set(s)))
        for k in range(m - 1)
        for s in itertools.combinations(rest, k)
    )


def test_interactions_follow_the_definition(spark):
    rows = [(-1.0, 0.0, 1.0), (0.0, 1.0, -1.0), (0.25, 1.0, 2.0), (1.0, 0.0, 0.0), (None, 0.0, None), (None, None, None), (0.0, 1.0, -1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = trees.shap_values(trees.shap_interactions(df, [DEEP], FEATURES), [DEEP], FEATURES).collect()
    assert len(got) == len(rows)
    for r in got:
        matrix, row = np.array(r["interactions"]).reshape(3, 3), r.asDict()
        assert matrix == pytest.approx(np.array([[definition(DEEP, row, a, b) for b in FEATURES] for a in FEATURES]), abs=1e-12)
        assert matrix.sum(axis=1) == pytest.approx(r["shap"][:3])
        assert sum(r["shap"]) == pytest.approx(worth(DEEP, row, set(FEATURES)))
    empty = trees.shap_interactions(df.limit(0), [DEEP], FEATURES)
    assert empty.count() == 0
    assert trees.shap_summary(trees.shap_values(df.limit(0), [DEEP], FEATURES)).first()["mean"] is None


def test_resamples_weigh_rows_evenly_and_draws_differ(spark):
    rows = sampling.resamples(spark.range(5000), F.col("id"), 20, 1)
    per_draw = {r["draw"]: r for r in rows.groupBy("draw").agg(F.avg("weight").alias("m"), F.var_pop("weight").alias("v")).collect()}
    assert len(per_draw) == 20
    assert all(abs(r["m"] - 1) < 0.07 and abs(r["v"] - 1) < 0.12 for r in per_draw.values())
    wide = rows.groupBy("id").pivot("draw", [0, 1, 2]).agg(F.first("weight"))
    for a, b in ((0, 1), (1, 2), (0, 2)):
        assert abs(wide.agg(F.corr(f"`{a}`", f"`{b}`")).first()[0]) < 0.06


def test_bootstrap_bounds_hold_the_mean(spark):
    df = spark.range(4000).withColumn("x", F.pmod(F.col("id") * 37, F.lit(101)).cast("double"))
    r = regression.bootstrap(df, F.col("id"), {"mean": lambda w: regression.mean(F.col("x"), w)}, 200).first()
    error = 29.15 / math.sqrt(4000)
    assert r["low"] < 50 < r["high"]
    assert 2.5 * error < r["high"] - r["low"] < 5.5 * error
    assert regression.bootstrap(df.limit(0), F.col("id"), {"mean": lambda w: regression.mean(F.col("x"), w)}, 20).first()["low"] is None


def test_bootstrap_of_queries_leaves_out_those_without_gain(spark):
    queries = spark.createDataFrame([(i, None if i % 2 else 1.0, 0.5) for i in range(40)], "query long, ndcg double, ap double")
    got = {r["metric"]: (r["low"], r["high"]) for r in ranking.bootstrap_means(queries, F.col("query"), 50).collect()}
    assert got == {"ndcg": (1.0, 1.0), "map": (0.5, 0.5)}


def test_cell_checks_count_each_fault(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0), (nan, inf), (None, -inf), (9.0, None)], "x double, y double")
    got = {(r["check"], r["subject"]): r["n"] for r in profile.cell_checks(df, ["x", "y"], {"x": (0.0, 5.0)}, {"small": F.col("y") < 10}).collect()}
    assert got == {("missing", "x"): 2, ("missing", "y"): 1, ("infinite", "x"): 0, ("infinite", "y"): 2, ("out_of_range", "x"): 1, ("rule", "small"): 1, ("repeated_rows", None): 1}
    assert {r["n"] for r in profile.cell_checks(df.limit(0), ["x", "y"]).collect()} == {0}


def test_predict_options(spark):
    df = spark.createDataFrame([(0.0, 1.0, -1.0), (None, None, None), (1.0, 0.0, 0.0)], "a double, b double, c double")
    model = boosting.Ensemble([DEEP, DEEP, DEEP], 0.5)
    one = [worth(DEEP, r.asDict(), set(FEATURES)) for r in df.collect()]
    whole = boosting.predict_with(df, model, boosting.PredictOptions(leaves=True, contributions=True), FEATURES).collect()
    assert [r["prediction"] for r in whole] == pytest.approx([0.5 + 3 * v for v in one])
    assert [sum(r["shap"]) for r in whole] == pytest.approx([3 * v for v in one])
    assert all(len(r["leaves"]) == 3 for r in whole)
    none = boosting.predict_with(df, model, boosting.PredictOptions(trees=0, stop_every=1)).collect()
    assert [(r["prediction"], r["used"]) for r in none] == [(0.5, 0)] * 3
    binary = boosting.Ensemble([DEEP, DEEP, DEEP], 0.0, "binary")
    stopped = boosting.predict_with(df, binary, boosting.PredictOptions(raw=True, stop_every=1, stop_margin=2.0)).collect()
    assert [r["prediction"] for r in stopped] == pytest.approx([r["used"] * v for r, v in zip(stopped, one, strict=True)])
    assert {r["used"] for r in stopped} == {1 if 2 * abs(v) > 2 else 2 if 4 * abs(v) > 2 else 3 for v in one}
