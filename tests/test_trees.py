"""Histograms, splits, trees and boosting."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import boosting, histogram, split, trees
from timberline.operators.binning import Mapper


def test_histogram_of_three_rows(spark):
    """Published three-row case: bins (1,0,1), (0,1,0), (1,1,1) at offsets 0, 2, 4."""
    rows = [(1.0, 0.5, 1, 0, 1), (2.0, 1.0, 0, 1, 0), (3.0, 1.5, 1, 1, 1)]
    df = spark.createDataFrame(rows, "g double, h double, bin_a int, bin_b int, bin_c int")
    got = {(r["feature"], r["bin"]): (r["sum_g"], r["sum_h"], r["n"]) for r in histogram.histograms(df, ["a", "b", "c"]).collect()}
    assert got == {("a", 0): (2, 1, 1), ("a", 1): (4, 2, 2), ("b", 0): (1, 0.5, 1), ("b", 1): (5, 2.5, 2), ("c", 0): (2, 1, 1), ("c", 1): (4, 2, 2)}


def test_sparse_histogram_recovers_the_default_bin(spark):
    rows = spark.createDataFrame([(0, 1.0, 0.5), (1, 2.0, 1.0), (2, 3.0, 1.5)], "row_id long, g double, h double")
    cells = spark.createDataFrame([(0, "a", 1), (2, "a", 1), (1, "b", 1), (2, "b", 1)], "row_id long, feature string, bin int")
    got = {(r["feature"], r["bin"]): (r["sum_g"], r["sum_h"], r["n"]) for r in histogram.sparse_histograms(cells, rows, {"a": 0, "b": 0}).collect()}
    assert got == {("a", 1): (4, 2, 2), ("a", 0): (2, 1, 1), ("b", 1): (5, 2.5, 2), ("b", 0): (1, 0.5, 1)}


def test_subtraction_gives_the_sibling(spark):
    df = spark.range(50).select((F.col("id") % 5).cast("int").alias("bin_a"), F.col("id").cast("double").alias("g"), F.lit(1.0).alias("h"))
    parent, child, other = (histogram.histograms(d, ["a"]).drop("leaf") for d in (df, df.where("g < 20"), df.where("g >= 20")))
    got = {r["bin"]: (r["sum_g"], r["n"]) for r in histogram.subtract(parent, child).collect()}
    assert got == {r["bin"]: (r["sum_g"], r["n"]) for r in other.collect()}


def test_quantised_sums_are_close(spark):
    df = spark.range(2000).select("id", (F.col("id") % 7 - 3.0).alias("g"), F.lit(0.5).alias("h"))
    q = histogram.quantised(df, "g", "h", 64, 1, ["id"]).agg(F.sum("qg") * F.first("scale_g"), F.sum("g")).first()
    assert abs(q[0] - q[1]) < 0.05 * 2000


def test_best_split_against_brute_force(spark):
    rng = np.random.default_rng(0)
    b, g = rng.integers(0, 6, 200), rng.normal(size=200)
    df = spark.createDataFrame([(int(x), float(y), 1.0) for x, y in zip(b, g, strict=True)], "bin_a int, g double, h double")
    got = split.best_splits(histogram.histograms(df, ["a"]), l2=1.0, min_data=5).first()
    gain = lambda s: 0.5 * s.sum() ** 2 / (len(s) + 1)
    want = max((gain(g[b <= k]) + gain(g[b > k]) - gain(g), -k) for k in range(5) if min((b <= k).sum(), (b > k).sum()) >= 5)
    assert got["gain"] == pytest.approx(want[0]) and got["bin"] == -want[1]


def test_monotone_constraint_drops_cuts(spark):
    df = spark.createDataFrame([(0, -1.0, 1.0)] * 10 + [(1, 1.0, 1.0)] * 10, "bin_a int, g double, h double")
    hist = histogram.histograms(df, ["a"])
    assert split.best_splits(hist, min_data=1, monotone={"a": -1}).count() == 1
    assert split.best_splits(hist, min_data=1, monotone={"a": 1}).count() == 0


def _toy(spark):
    df = spark.range(400).select("id", F.pmod(F.col("id") * 37, F.lit(100)).cast("double").alias("x"), F.pmod(F.col("id") * 11, F.lit(9)).cast("double").alias("z"))
    return df.withColumn("y", F.when(F.col("x") > 60, 5.0).otherwise(F.when(F.col("z") > 4, 1.0).otherwise(-2.0)))


def test_a_grown_ensemble_fits_and_round_trips(spark):
    df = _toy(spark)
    model = boosting.train(df, ["x", "z"], "y", ["id"], rounds=4, rate=0.7, num_leaves=4, min_data=5)
    assert df.agg(F.avg((model.raw() - F.col("y")) ** 2)).first()[0] < 0.1
    again = boosting.Ensemble.from_json(model.to_json())
    assert df.agg(F.max(F.abs(again.raw() - model.raw()))).first()[0] == 0
    assert set(trees.importance(model.trees)) == {"x", "z"}
    tree = model.trees[0]
    assert trees.to_dict(trees.from_text(trees.to_text(tree))) == trees.to_dict(tree)
    assert df.agg(F.max(F.abs(F.expr(trees.to_sql(tree)) - trees.score_expression(tree)))).first()[0] == 0


@pytest.mark.parametrize("options", [{"mode": "rf", "bagging": 0.7}, {"mode": "dart", "drop_rate": 0.5}, {"objective_name": "binary"}, {"feature_fraction": 0.5}])
def test_other_modes_lower_the_loss(spark, options):
    df = _toy(spark).withColumn("b", (F.col("y") > 0).cast("double"))
    label = "b" if "objective_name" in options else "y"
    model = boosting.train(df, ["x", "z"], label, ["id"], rounds=3, rate=0.5, num_leaves=4, min_data=5, **options)
    out = model.predict(df)
    row = out.agg(F.avg((F.col("prediction") - F.col(label)) ** 2).alias("mse"), F.var_pop(label).alias("v")).first()
    assert row["mse"] < 0.8 * row["v"]


def test_contributions_add_up(spark):
    df = _toy(spark).withColumn("x", F.when(F.col("id") % 9 != 0, F.col("x")))
    model = boosting.train(df, ["x", "z"], "y", ["id"], rounds=2, rate=0.5, num_leaves=5, min_data=5)
    out = trees.shap_values(df, model.trees, ["x", "z"])
    total = F.aggregate("shap", F.lit(0.0), lambda a, v: a + v)
    assert out.agg(F.max(F.abs(total - (model.raw() - model.start)))).first()[0] < 1e-9


def test_early_stop_and_combinations():
    stop = boosting.EarlyStop(patience=2, min_delta=0.1)
    assert [stop.update(v) for v in (1.0, 0.5, 0.49, 0.48)] == [False, False, False, True]
    assert stop.best_round == 1 and stop.statistics()["rounds"] == 4
    assert boosting.combine_stops([True, False, True], "majority") and not boosting.combine_stops([True, False], "all")


def test_linear_leaves_follow_a_line(spark):
    df = spark.range(100).select((F.col("id") / 10).alias("x")).withColumn("g", -(F.col("x") * 3 + 1)).withColumn("h", F.lit(1.0))
    tree = trees.refit_linear(df, trees.Tree([trees.Node(value=9.0)]), ["x"], l2=1e-9)
    assert df.agg(F.max(F.abs(trees.score_expression(tree) - (F.col("x") * 3 + 1)))).first()[0] < 1e-6
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS x").select(trees.score_expression(tree)).first()[0] == 9.0


def test_objectives_match_numeric_slopes(spark):
    losses = {"binary": lambda y, s: math.log1p(math.exp(s)) - y * s, "poisson": lambda y, s: math.exp(s) - y * s, "gamma": lambda y, s: y * math.exp(-s) + s, "regression": lambda y, s: 0.5 * (s - y) ** 2}
    for name, loss in losses.items():
        y, s, d = 1.0, 0.3, 1e-4
        g, h = spark.range(1).select(*boosting.objective(name, F.lit(y), F.lit(s))).first()
        assert g == pytest.approx((loss(y, s + d) - loss(y, s - d)) / (2 * d), rel=1e-5)
        assert h == pytest.approx((loss(y, s + d) - 2 * loss(y, s) + loss(y, s - d)) / d**2, rel=1e-3)


def test_offsets_conflicts_and_bundles(spark):
    df = spark.createDataFrame([(0, 1, 1), (1, 0, 1), (0, 0, 0)], "bin_a int, bin_b int, bin_c int")
    pairs = histogram.conflicts(df, {"a": 0, "b": 0, "c": 0})
    assert {(r["a"], r["b"]): r["n"] for r in pairs.collect()} == {("a", "b"): 0, ("a", "c"): 1, ("b", "c"): 1}
    assert histogram.bundles(pairs, ["a", "b", "c"], 0) == [["a", "b"], ["c"]]
    assert Mapper("a", bounds=(1.0, 2.0)).n_bins == 2


def _grown_by_hand(rows, leaves, smooth=0.0, max_delta=0.0):
    """Best leaf first, a leaf at a time, on plain lists of (bins, g); hessians are 1."""
    value = lambda part: -sum(g for _, g in part) / (len(part) + 1)
    gain = lambda part: 0.5 * sum(g for _, g in part) ** 2 / (len(part) + 1)

    def best(part):
        cuts = []
        for f in (0, 1):
            for cut in range(8):
                low, high = [r for r in part if r[0][f] <= cut], [r for r in part if r[0][f] > cut]
                if min(len(low), len(high)) >= 5:
                    cuts.append((gain(low) + gain(high) - gain(part), -f, -cut, low, high))
        top = max(cuts, key=lambda c: c[:3], default=None)
        return top if top and top[0] > 0 else None

    def output(part, parent):
        v = value(part)
        if max_delta:
            v = max(-max_delta, min(max_delta, v))
        w = smooth / (smooth + len(part)) if smooth else 0.0
        return (1 - w) * v + w * parent

    out = {0: (rows, output(rows, value(rows)))}
    made = 1
    while len(out) < leaves:
        open_ = {k: best(part) for k, (part, _) in out.items()}
        open_ = {k: c for k, c in open_.items() if c}
        if not open_:
            break
        k = min(open_, key=lambda k: (-open_[k][0], k))
        parent = out.pop(k)[1]
        for part in open_[k][3:]:
            out[made] = (part, output(part, parent))
            made += 1
    return {k: (len(part), v) for k, (part, v) in out.items()}


@pytest.mark.parametrize("options", [{}, {"smooth": 4.0}, {"max_delta": 0.2}])
def test_looking_ahead_gives_the_tree_of_one_split_a_time(spark, options):
    rng = np.random.default_rng(3)
    bins, g = rng.integers(0, 9, (500, 2)), rng.normal(size=500)
    g += np.where(bins[:, 0] > 4, 1.0, -0.3) * (bins[:, 1] - 3)
    df = spark.createDataFrame([(int(a), int(b), float(x), 1.0) for (a, b), x in zip(bins, g, strict=True)], "bin_a int, bin_b int, g double, h double")
    cuts = tuple(float(k) for k in range(9))
    tree = trees.grow(df, [Mapper("a", bounds=cuts, highest=8.0), Mapper("b", bounds=cuts, highest=8.0)], num_leaves=9, l2=1.0, min_data=5, **options)
    want = _grown_by_hand([(tuple(b), x) for b, x in zip(bins.tolist(), g.tolist(), strict=True)], 9, **options)
    assert {i: tree.nodes[i].count for i in tree.leaves()} == {i: n for i, (n, _) in want.items()}
    for i in tree.leaves():
        assert tree.nodes[i].value == pytest.approx(want[i][1])


def test_monotone_outputs_hold_over_the_whole_tree(spark):
    df = _toy(spark).withColumn("y", F.col("x") / 10 + F.sin("x") * 3 + F.col("z"))
    model = boosting.train(df, ["x", "z"], "y", ["id"], rounds=3, rate=0.5, num_leaves=8, min_data=5, monotone={"x": 1})
    grid = spark.range(0, 101).crossJoin(spark.range(0, 9).withColumnRenamed("id", "k")).select(F.col("id").cast("double").alias("x"), F.col("k").cast("double").alias("z"))
    scores = {(r["x"], r["z"]): r["s"] for r in grid.withColumn("s", model.raw()).collect()}
    assert all(scores[x + 1, z] >= scores[x, z] - 1e-9 for x, z in scores if x < 100)


def test_sets_of_categories_split_and_round_trip(spark):
    df = spark.range(600).select("id", F.pmod(F.col("id") * 7, F.lit(12)).cast("int").alias("c"), F.pmod(F.col("id"), F.lit(5)).cast("double").alias("x"))
    df = df.withColumn("y", F.when(F.col("c").isin(1, 5, 8, 11), 4.0).otherwise(-1.0)).withColumn("c", F.when(F.col("id") % 50 != 0, F.col("c")))
    model = boosting.train(df, ["c", "x"], "y", ["id"], rounds=2, rate=1.0, num_leaves=3, min_data=5, categorical=["c"])
    root = model.trees[0].nodes[0]
    assert root.feature == "c" and set(root.categories) in ({1, 5, 8, 11}, set(range(12)) - {1, 5, 8, 11})
    assert df.where("c is not null").agg(F.max(F.abs(model.raw() - F.col("y")))).first()[0] < 0.5
    tree = model.trees[0]
    assert df.agg(F.max(F.abs(F.expr(trees.to_sql(tree)) - trees.score_expression(tree)))).first()[0] == 0


def test_ranking_gradients_and_training(spark):
    rows = [(i, i // 40, float((i * 7) % 3), float((i * 5) % 11)) for i in range(240)] + [(900, None, 1.0, 1.0), (901, 77, 0.0, 2.0), (902, 78, None, 2.0)]
    df = spark.createDataFrame(rows, "id long, q long, y double, x double").withColumn("x", F.col("x") + F.col("y") * 4)
    got = {r["id"]: (r["g"], r["h"]) for r in boosting.ranking_gradients(df, "q", "y", F.col("x") / 9, ["id"]).collect()}
    assert got.keys() == {*range(240), 901} and got[901] == (0.0, 0.0)
    data = df.where("id < 240").toPandas()
    for _, part in data.groupby("q"):
        p, t = np.exp(part.x / 9) / np.exp(part.x / 9).sum(), (2**part.y - 1) / (2**part.y - 1).sum()
        for i, a, b in zip(part.id, p, t, strict=True):
            assert got[i] == pytest.approx((a - b, a * (1 - a)))
    model = boosting.train(df, ["x"], "y", ["id"], objective_name="ranking", rounds=3, rate=0.5, num_leaves=4, min_data=5, query="q", min_hessian=1e-6)
    means = {r["y"]: r["s"] for r in df.where("id < 240").groupBy("y").agg(F.avg(model.raw()).alias("s")).collect()}
    assert means[0.0] < means[1.0] < means[2.0]
    with pytest.raises(ValueError):
        boosting.train(df, ["x"], "y", ["id"], objective_name="ranking")


@pytest.mark.parametrize("options", [{"extra": 5}, {"levels": 64}, {"penalty": {"z": 1e9}}])
def test_other_options_of_growing(spark, options):
    df = _toy(spark)
    model = boosting.train(df, ["x", "z"], "y", ["id"], rounds=4, rate=0.7, num_leaves=4, min_data=5, **options)
    row = df.agg(F.avg((model.raw() - F.col("y")) ** 2).alias("mse"), F.var_pop("y").alias("v")).first()
    assert row["mse"] < 0.7 * row["v"]
    if "penalty" in options:
        assert set(trees.importance(model.trees)) == {"x"}


def test_forced_splits_are_a_tree(spark):
    """Three splits in order: the root, its left child, and the right one's leaf; then growth goes on."""
    df = spark.range(400).select(F.pmod(F.col("id") * 37, F.lit(10)).cast("int").alias("bin_x"), F.pmod(F.col("id") * 11, F.lit(7)).cast("int").alias("bin_z"))
    df = df.withColumn("g", F.col("bin_x") - F.col("bin_z") * 1.5).withColumn("h", F.lit(1.0))
    mappers = [Mapper("x", bounds=tuple(k + 0.5 for k in range(10)), highest=9.0), Mapper("z", bounds=tuple(k + 0.5 for k in range(7)), highest=6.0)]
    tree = trees.grow(df, mappers, num_leaves=6, min_data=5, forced=[("x", 3), (1, "z", 2), (2, "x", 6)])
    first, left, right = tree.nodes[0], tree.nodes[1], tree.nodes[2]
    assert (first.feature, first.bin, left.feature, left.bin, right.feature, right.bin) == ("x", 3, "z", 2, "x", 6)
    assert (first.left, first.right, left.left, left.right, right.left, right.right) == (1, 2, 3, 4, 5, 6) and len(tree.leaves()) == 6
    for node, where in ((3, "bin_x <= 3 AND bin_z <= 2"), (6, "bin_x > 6")):
        assert tree.nodes[node].count == df.where(where).count()
    with pytest.raises(ValueError):
        trees.grow(df, mappers, forced=[("x", 3), (7, "z", 2)])
    with pytest.raises(ValueError):
        trees.grow(df, mappers, min_data=300, forced=[("x", 3)])


def test_only_the_lighter_child_is_summed_from_rows(spark, monkeypatch):
    """Histograms of all children equal those summed from rows, and half of them come by subtraction."""
    df = spark.range(600).select("id", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(8)).cast("int").alias(f"bin_{f}") for k, f in enumerate("xyz")])
    df = df.withColumn("g", F.pmod(F.xxhash64("id", F.lit(9)), F.lit(100)) / 10.0 - F.col("bin_x")).withColumn("h", F.lit(1.0)).cache()
    mappers = [Mapper(f, bounds=tuple(k + 0.5 for k in range(8)), highest=7.0) for f in "xyz"]
    summed, taken = [], []
    rows, less = histogram.leaf_histograms, histogram.siblings
    monkeypatch.setattr(histogram, "leaf_histograms", lambda b, w, at, leaves: summed.extend(leaves) or rows(b, w, at, leaves))
    monkeypatch.setattr(histogram, "siblings", lambda p, c, links: taken.extend(links) or less(p, c, links))
    tree = trees.grow(df, mappers, num_leaves=8, min_data=5)
    monkeypatch.undo()
    assert len(tree.leaves()) == 8 and len(summed) == len(taken) + 1
    want = {(r["feature"], r["bin"], r["n"]): r["sum_g"] for r in histogram.histograms(df, ["x", "y", "z"]).collect()}
    got = {(r["feature"], r["bin"], r["n"]): r["sum_g"] for r in histogram.leaf_histograms(df, {"x": 8, "y": 8, "z": 8}, F.lit(0), [0]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    parent, child = (histogram.leaf_histograms(d, {"x": 8, "y": 8}, F.lit(n), [n]) for d, n in ((df, 0), (df.where("bin_z < 3"), 1)))
    other = {(r["leaf"], r["feature"], r["bin"]): (r["n"], round(r["sum_g"], 9)) for r in histogram.leaf_histograms(df.where("bin_z >= 3"), {"x": 8, "y": 8}, F.lit(2), [2]).collect()}
    assert {(r["leaf"], r["feature"], r["bin"]): (r["n"], round(r["sum_g"], 9)) for r in histogram.siblings(parent, child, [(0, 1, 2)]).collect()} == other


def test_rows_of_equal_bins_are_summed_before_growing(spark, monkeypatch):
    """The same trees as from single rows, of which a tree then makes no second pass."""
    df = spark.range(4000).select("id", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(6)).cast("double").alias(f) for k, f in enumerate("ab")], F.pmod(F.col("id") * 7919, F.lit(13)).alias("noise"))
    df = df.withColumn("y", F.col("a") * F.col("b") + F.col("noise") / 4).withColumn("c", F.pmod(F.col("noise"), F.lit(3)))
    plain, seen = histogram.leaf_histograms, []

    def watched(binned, *args, **options):
        seen.append(binned.count())
        return plain(binned, *args, **options)

    monkeypatch.setattr(histogram, "leaf_histograms", watched)
    found = {}
    for least in (8, 10**9):
        monkeypatch.setattr(histogram, "CONDENSE", least)
        seen.clear()
        model = boosting.train(df, ["a", "b"], "y", ["id"], rounds=2, num_leaves=5, each={"a": 0.01})
        classes = boosting.train_multiclass(df, ["a", "b"], "c", ["id"], 3, rounds=1, num_leaves=3)
        found[least] = [(n.feature, n.threshold, n.count, round(n.value, 9), round(n.weight, 6)) for t in [*model.trees, *(m.trees[0] for m in classes)] for n in t.nodes]
        assert max(seen) <= 36 * 2 if least == 8 else min(seen) == 4000
    assert found[8] == found[10**9]
