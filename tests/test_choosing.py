"""Selection, importance by exchange, scaling by quantiles and monotone growth."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import boosting, scale, trees
from timberline.operators.binning import Mapper


def test_quantile_scale_against_interpolation(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=300), np.full(200, 0.5)])
    rows = [(k, float(v), None if k % 4 == 0 else float(k % 3), None) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    scales = scale.fit_quantile_scale(df, ["a", "b", "c"], 20)
    sorted_a = np.sort(x)
    knots = sorted_a[[int((len(x) - 1) * k / 20 + 0.5) for k in range(21)]]
    assert scales[0].knots == tuple(knots) and scales[2].knots == ()
    more = df.unionByName(spark.createDataFrame([(900, 99.0, -5.0, 1.0), (901, float("nan"), 7.0, None)], df.schema))
    got = {r["id"]: r for r in scale.quantile_scale(more, scales).collect()}
    share = np.linspace(0, 1, 21)
    for k, v in enumerate(x):
        a, b = np.interp(v, knots, share), 1 - np.interp(-v, -knots[::-1], share)
        assert got[k]["a"] == pytest.approx((a + b) / 2)
    assert got[0]["b"] is None and got[1]["c"] is None and got[1]["b"] == got[4 + 3]["b"]
    assert (got[900]["a"], got[900]["b"], got[900]["c"]) == (1.0, 0.0, None) or np.isnan(got[900]["c"])
    assert got[901]["a"] is None and got[901]["b"] == 1.0


def test_lasso_and_elimination_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 5))
    x[:, 3] = x[:, 0] + 0.3 * x[:, 3]
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.2 * rng.normal(size=400)
    names = list("abcde")
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], ", ".join(f"{n} double" for n in [*names, "y"]))
    df = df.unionByName(spark.createDataFrame([(None, 1.0, 1.0, 1.0, 1.0, 99.0)], df.schema))
    z, t = (x - x.mean(axis=0)) / np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=0)), (y - y.mean()) / np.sqrt(((y - y.mean()) ** 2).sum())
    chosen = scale.select_l1(df, names, "y", 0.05)
    w = np.array([chosen.get(n, 0.0) for n in names])
    slope = z.T @ (t - z @ w)
    for k in range(5):  # the conditions of the least penalised square
        assert slope[k] == pytest.approx(0.05 * np.sign(w[k]), abs=1e-9) if w[k] else abs(slope[k]) <= 0.05 + 1e-9
    assert {"a", "b"} <= set(chosen) and scale.select_l1(df, names, "y", 2.0) == {}
    assert scale.eliminate(df, names, "y", 2) == ["a", "b"]
    seen = []
    assert scale.eliminate(df, names, "y", 3, lambda left: seen.append(list(left)) or {n: float(ord(n)) for n in left}) == ["e", "d", "c"] and len(seen) == 3


def test_selection_by_trees(spark):
    df = spark.range(300).select("id", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10)).cast("double").alias(f) for k, f in enumerate("abc")])
    df = df.withColumn("y", F.col("c") * 2 + F.when(F.col("a") > 4, 3.0).otherwise(0.0))
    assert scale.select_by_trees(df, ["a", "b", "c"], "y", ["id"], 2, rounds=1, num_leaves=6, min_data=5) == ["c", "a"]


def test_exchange_importance_is_one_shift_of_rows(spark):
    rows = [(float(k % 7), float(k % 5), k) for k in range(60)]
    df = spark.createDataFrame([(a, b, a * 2 + 1, k) for a, b, k in rows], "a double, b double, y double, at long")
    score = lambda names: F.col(names.get("a", "a")) * 2 + 1 + 0 * F.col(names.get("b", "b"))
    got = trees.permutation_importance(df, ["a", "b"], score, "y", F.col("at"), seed=3)
    shift = 1 + 3 * 2654435761 % 59
    assert got == {"a": pytest.approx(np.mean([(2 * (rows[k][0] - rows[(k + shift) % 60][0])) ** 2 for k in range(60)])), "b": pytest.approx(0)}
    assert trees.permutation_importance(df.limit(1), ["a"], score, "y", F.col("at")) == {"a": 0.0}
    named = trees.over([trees.Tree([trees.Node("a", 2.0, 0, left=1, right=2), trees.Node(value=1.0, linear={"": 1.0, "a": 2.0}), trees.Node()])], {"a": "z"})[0]
    assert named.nodes[0].feature == "z" and named.nodes[1].linear == {"": 1.0, "z": 2.0}


def test_monotone_leaves_by_their_neighbours(spark):
    """Outputs follow the signs everywhere, and the loss is no worse than with the middle rule."""
    df = spark.range(2000).select(*[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)).cast("int").alias(f"bin_{f}") for k, f in enumerate("xz")], F.pmod(F.xxhash64("id", F.lit(5)), F.lit(100)).alias("noise"))
    y = F.col("bin_x") * 1.0 + F.when(F.col("bin_z") > 3, 4.0).otherwise(0.0) - F.when((F.col("bin_x") == 5) & (F.col("bin_z") > 2), 6.0).otherwise(0.0) + F.col("noise") / 50
    df = df.select("bin_x", "bin_z", y.alias("y"), (-y).alias("g"), F.lit(1.0).alias("h")).withColumn("x", F.col("bin_x").cast("double")).withColumn("z", F.col("bin_z").cast("double")).cache()
    mappers = [Mapper(f, bounds=tuple(float(k) for k in range(8)), lowest=0.0, highest=7.0) for f in "xz"]
    losses = {}
    for rule in ("middle", "neighbours"):
        tree = trees.grow(df, mappers, num_leaves=9, min_data=5, monotone={"x": 1, "z": 1}, monotone_rule=rule)
        grid = spark.range(64).select(F.floor(F.col("id") / 8).cast("double").alias("x"), (F.col("id") % 8).cast("double").alias("z")).select("x", "z", trees.score_expression(tree).alias("s"))
        s = np.zeros((8, 8))
        for r in grid.collect():
            s[int(r["x"]), int(r["z"])] = r["s"]
        assert (np.diff(s, axis=0) >= -1e-12).all() and (np.diff(s, axis=1) >= -1e-12).all(), rule
        losses[rule] = df.agg(F.avg((trees.score_expression(tree) - F.col("y")) ** 2)).first()[0]
    assert losses["neighbours"] <= losses["middle"] + 1e-9
    free = trees.grow(df, mappers, num_leaves=9, min_data=5)
    assert df.agg(F.avg((trees.score_expression(free) - F.col("y")) ** 2)).first()[0] <= losses["neighbours"]


def test_boosting_with_signs_by_neighbours(spark):
    df = spark.range(400).select("id", F.pmod(F.col("id") * 37, F.lit(20)).cast("double").alias("x")).withColumn("y", F.col("x") + 5 * F.pmod(F.col("id"), F.lit(3)) - F.when(F.col("x") == 12, 30).otherwise(0))
    model = boosting.train(df, ["x"], "y", ["id"], rounds=2, rate=0.5, num_leaves=6, min_data=5, monotone={"x": 1}, monotone_rule="neighbours")
    out = [r[0] for r in df.select("x", model.raw().alias("s")).distinct().orderBy("x").select("s").collect()]
    assert all(b >= a - 1e-12 for a, b in zip(out, out[1:], strict=False))
