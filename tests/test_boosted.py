"""Losses that need more than sums: renewed leaves, pairwise ranking, bundled columns."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import boosting, histogram, ordering, trees


@pytest.mark.parametrize("range_rows", [1_000_000, 40])
@pytest.mark.parametrize("weighted", [False, True])
def test_quantiles_of_all_groups(spark, monkeypatch, range_rows, weighted):
    """Few rows a range force cuts and cuts again; group 2 is nearly one value, group 3 one row."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(7)
    groups = {0: rng.normal(size=400), 1: np.round(rng.exponential(size=300), 1), 2: np.concatenate([np.full(500, 1.5), [0.0, 9.0]]), 3: np.array([4.0])}
    weights = {g: rng.integers(1, 5, len(v)).astype(float) for g, v in groups.items()}
    rows = [(g, float(x), float(w)) for g, v in groups.items() for x, w in zip(v, weights[g], strict=True)] + [(None, 1.0, 1.0), (0, None, 1.0), (1, 5.0, 0.0), (5, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "group int, value double, weight double").repartition(3)
    if not weighted:
        df = df.where("weight > 0")
    for q in (0.0, 0.3, 0.5, 0.97, 1.0):
        got = ordering.grouped_quantiles(df, q, weighted)
        assert set(got) == set(groups)
        for g, v in groups.items():
            if weighted:
                order = np.argsort(v, kind="stable")
                upto = np.cumsum(weights[g][order])
                want = v[order][np.searchsorted(upto, q * upto[-1] * (1 - 1e-12))]
            else:
                want = np.quantile(v, q)
            assert got[g] == pytest.approx(want), (q, g)
    assert ordering.grouped_quantiles(df.limit(0), 0.5, weighted) == {}


def test_quantiles_of_skewed_groups_without_lists(spark, monkeypatch):
    """Values over many magnitudes, infinite ones and halves far apart; no pass ranks more rows than a range may hold."""
    monkeypatch.setattr(ordering, "RANGE_ROWS", 20)
    rng = np.random.default_rng(9)
    groups = {0: 10.0 ** rng.uniform(-250, 250, 601), 1: np.concatenate([np.full(100, -5e307), np.full(100, 5e307)]), 2: np.concatenate([rng.normal(size=301), [np.inf] * 20])}
    df = spark.createDataFrame([(g, float(x)) for g, v in groups.items() for x in v], "group int, value double")
    got = ordering.grouped_quantiles(df, 0.5)
    assert got == {0: pytest.approx(np.median(groups[0])), 1: pytest.approx(0.0, abs=1e294), 2: pytest.approx(np.median(groups[2]))}
    calls = []
    monkeypatch.setattr(F, "percentile_approx", lambda *a: calls.append(a))
    even = spark.range(5000).select(F.lit(0).alias("group"), F.col("id").cast("double").alias("value"))
    assert ordering.grouped_quantiles(even, 0.25) == {0: pytest.approx(4999 * 0.25)} and not calls


def test_renewed_leaves_are_what_the_loss_asks_for(spark):
    """After a full step no leaf's quantile of the residuals is off zero, whatever the outliers."""
    df = spark.range(600).select("id", F.pmod(F.col("id") * 7, F.lit(10)).cast("double").alias("x"))
    df = df.withColumn("y", F.when(F.col("id") % 21 == 0, 1e6).otherwise(F.col("x") * 10 + F.pmod(F.col("id"), F.lit(3)) - 1))
    typical = lambda m: df.agg(F.percentile_approx(F.abs(m.raw() - F.col("y")), 0.5)).first()[0]
    squares = typical(boosting.train(df, ["x"], "y", ["id"], rounds=2, rate=1.0, num_leaves=10, min_data=5))
    for kind, share in (("l1", 0.5), ("quantile", 0.8), ("huber", None), ("mape", None)):
        model = boosting.train(df, ["x"], "y", ["id"], kind, rounds=2, rate=1.0, num_leaves=10, min_data=5, shape=0.8 if kind == "quantile" else None)
        assert typical(model) < squares / 100, kind
        if share is not None:
            off = df.groupBy(trees.leaf_expression(model.trees[-1])).agg(F.percentile(F.col("y") - model.raw(), share).alias("off"))
            assert off.agg(F.max(F.abs("off"))).first()[0] < 1e-6


def test_robust_losses_have_their_slopes(spark):
    losses = {
        "quantile": lambda y, s: (0.9 if y >= s else -0.1) * (y - s),
        "huber": lambda y, s: 0.5 * (s - y) ** 2 if abs(s - y) <= 0.9 else 0.9 * (abs(s - y) - 0.45),
        "fair": lambda y, s: abs(s - y) - math.log1p(abs(s - y)),
        "mape": lambda y, s: abs(s - y) / max(1, abs(y)),
    }
    for name, loss in losses.items():
        for y, s in ((3.0, 0.3), (-2.0, 1.4), (0.2, 0.9)):
            g, total = spark.range(1).select(boosting.objective(name, F.lit(y), F.lit(s))[0].alias("g")).first()[0], spark.range(1).select(boosting.loss(name, F.lit(y), F.lit(s))).first()[0]
            assert g == pytest.approx((loss(y, s + 1e-5) - loss(y, s - 1e-5)) / 2e-5, rel=1e-4) and total == pytest.approx(loss(y, s))


def plain_lambdarank(rows, truncation, sigma=1.0):
    """``id -> (g, h)`` of ``(id, query, label, score)`` from all pairs."""
    out = {r[0]: [0.0, 0.0] for r in rows}
    for query in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == query), key=lambda r: (-r[3], r[0]))
        gain = [2.0 ** r[2] - 1 for r in own]
        cut = [1 / math.log2(k + 2) for k in range(len(own))]
        best = sum(g * c for g, c in zip(sorted(gain, reverse=True)[:truncation], cut, strict=False))
        for i in range(len(own)):
            for j in range(len(own)):
                if gain[i] > gain[j] and min(i, j) < truncation:
                    change = abs(gain[i] - gain[j]) * abs(cut[i] - cut[j]) / best
                    rho = 1 / (1 + math.exp(sigma * (own[i][3] - own[j][3])))
                    out[own[i][0]][0] -= sigma * rho * change
                    out[own[j][0]][0] += sigma * rho * change
                    for k in (i, j):
                        out[own[k][0]][1] += sigma * sigma * rho * (1 - rho) * change
    return out


@pytest.mark.parametrize("long_query", [100_000, 50])
def test_pairwise_gradients_with_a_hot_query(spark, monkeypatch, long_query):
    monkeypatch.setattr(boosting, "LONG_QUERY", long_query)
    rng = np.random.default_rng(2)
    rows = [(k, 0 if k < 300 else int(rng.integers(1, 30)), int(rng.integers(0, 4)), float(np.round(rng.normal(), 1))) for k in range(420)]
    rows += [(500 + k, 99, 0, 0.5 * k) for k in range(5)] + [(600, 98, 3, 1.0)]
    df = spark.createDataFrame([*rows, (700, None, 1, 1.0), (701, 0, None, 1.0), (702, 0, 1, None)], "id long, q int, y int, s double").withColumn("g", F.lit("clash"))
    got = {r["id"]: (r["g"], r["h"]) for r in boosting.lambdarank_gradients(df.drop("g"), "q", "y", F.col("s"), ["id"], truncation=5, sigma=1.3).collect()}
    want = plain_lambdarank(rows, 5, 1.3)
    assert set(got) == set(want)
    for k, (g, h) in want.items():
        assert got[k] == (pytest.approx(g, abs=1e-9), pytest.approx(h, abs=1e-9)), k


def test_pairwise_gradients_of_short_queries_take_one_shuffle(spark, capsys):
    """No row is multiplied and no part of a query is joined; queries run over batches of any size."""
    df = spark.range(3000).select("id", F.floor(F.col("id") / 7).alias("q"), F.pmod(F.xxhash64("id"), F.lit(4)).cast("double").alias("y"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50)) / 10).alias("s"))
    out = boosting.lambdarank_gradients(df, "q", "y", F.col("s"), ["id"], truncation=3)
    out.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan and "Join" not in plan
    want = {r["id"]: (r["g"], r["h"]) for r in boosting._long_lambdas(df.withColumn("__score", F.col("s")).withColumn("__gain", F.pow(F.lit(2.0), F.col("y")) - 1), df.columns, "q", ["id"], 3, 1.0).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    got = {r["id"]: (r["g"], r["h"]) for r in out.collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 3000 and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_training_on_pairs_puts_better_rows_first(spark):
    df = spark.range(800).select("id", (F.col("id") % 40).alias("q"), F.pmod(F.col("id") * 13, F.lit(11)).cast("double").alias("x"), F.pmod(F.col("id") * 7, F.lit(5)).cast("double").alias("noise"))
    df = df.withColumn("y", F.when(F.col("x") > 7, 3).when(F.col("x") > 4, 1).otherwise(0))
    model = boosting.train(df, ["noise", "x"], "y", ["id"], "lambdarank", rounds=3, rate=0.5, num_leaves=4, min_data=5, query="q")
    low, high = (df.where(c).agg(F.max(model.raw()) if c == "x <= 4" else F.min(model.raw())).first()[0] for c in ("x <= 4", "x > 7"))
    assert high > low


def test_bundles_with_and_without_conflicts(spark):
    rows = [(k, 1 + k % 3 if k % 3 == 0 else 0, 1 + k % 4 if k % 3 == 1 else 0, 1 if k % 3 == 2 or k == 30 else 0, k % 5) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, bin_a int, bin_b int, bin_c int, bin_d int").withColumn("g", F.col("id") / 7 - 20).withColumn("h", F.lit(1.0))
    widths = {"a": 4, "b": 6, "c": 2, "d": 5}
    plan = histogram.find_bundles(df, widths, 0)
    assert [[f for f, _ in held] for held in plan.columns.values()] == [["a", "b"], ["c"], ["d"]]
    leaf = F.pmod(F.col("id"), F.lit(2)).cast("int")

    def taken_apart(plan):
        hist = histogram.leaf_histograms(histogram.with_bundles(df, plan), {c: plan.width(c) for c in plan.columns}, leaf, [0, 1])
        return {(r["leaf"], r["feature"], r["bin"]): (r["n"], round(r["sum_g"], 6)) for r in histogram.unbundled(hist, plan).collect()}

    want = {(r["leaf"], r["feature"], r["bin"]): (r["n"], round(r["sum_g"], 6)) for r in histogram.histograms(df, list(widths), leaf=leaf).collect()}
    assert taken_apart(plan) == want
    borne = histogram.find_bundles(df, widths, 1)  # row 30 has both a and c: c counts as at its default there
    assert [[f for f, _ in held] for held in borne.columns.values()] == [["a", "b", "c"], ["d"]]
    got = taken_apart(borne)
    assert {k: v for k, v in got.items() if k[1] != "c"} == {k: v for k, v in want.items() if k[1] != "c"}
    assert got[0, "c", 1][0] == want[0, "c", 1][0] - 1 and got[0, "c", 0][0] == want[0, "c", 0][0] + 1


def test_training_on_bundles_gives_the_same_trees(spark):
    df = spark.range(500).select("id", *[F.when(F.col("id") % 3 == k, F.pmod(F.col("id") * 7 + k, F.lit(9)).cast("double") + 1).otherwise(0.0).alias(f) for k, f in enumerate("abc")])
    df = df.withColumn("y", F.col("a") * 2 - F.col("b") + F.sqrt("c") * F.pmod(F.col("id"), F.lit(4)))
    plain, shared = (boosting.train(df, ["a", "b", "c"], "y", ["id"], rounds=2, rate=0.5, num_leaves=5, min_data=5, bundle=b) for b in (None, 0))
    for one, two in zip(plain.trees, shared.trees, strict=True):
        assert [(n.feature, n.threshold, n.count) for n in one.nodes] == [(n.feature, n.threshold, n.count) for n in two.nodes]
        assert [n.value for n in one.nodes] == pytest.approx([n.value for n in two.nodes])
    assert trees.importance(plain.trees) == trees.importance(shared.trees)


def test_linear_leaves_follow_their_path(spark):
    """Lines in the leaves beat constants on a line with a step; each leaf has the features of its own path; gaps fall back."""
    df = spark.range(600).select("id", (F.pmod(F.col("id") * 37, F.lit(100)) / 10).alias("x"), F.pmod(F.col("id") * 11, F.lit(9)).cast("double").alias("z"))
    df = df.withColumn("y", 2 * F.col("x") + F.when(F.col("z") > 4, 5.0).otherwise(0.0))
    error = lambda m, d: d.agg(F.avg((m.raw() - F.col("y")) ** 2)).first()[0]
    plain, lines = (boosting.train(df, ["x", "z"], "y", ["id"], rounds=2, rate=1.0, num_leaves=4, min_data=5, linear=v) for v in (None, 1e-6))
    assert error(lines, df) < 0.1 * error(plain, df)
    tree = lines.trees[0]
    for leaf in tree.leaves():
        assert set(tree.nodes[leaf].linear) == {"", *tree.branch(leaf)}
    again = boosting.Ensemble.from_json(lines.to_json())
    assert error(again, df) == error(lines, df)
    holes = df.withColumn("x", F.when(F.col("id") % 2 == 0, F.col("x")))
    assert holes.where("x is null").agg(F.count_if(lines.raw().isNull())).first()[0] == 0


def test_prices_are_paid_once_a_model_and_once_a_row(spark):
    from timberline.operators.binning import Mapper

    df = spark.range(400).select("id", *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(6)).cast("int").alias(f"bin_{f}") for k, f in enumerate("xz")])
    df = df.withColumn("g", -(F.col("bin_x") + 0.9 * F.col("bin_z"))).withColumn("h", F.lit(1.0)).withColumn("__paid", F.when(F.col("id") % 2 == 0, 1).otherwise(0).cast("long")).cache()
    mappers = [Mapper(f, bounds=tuple(k + 0.5 for k in range(6)), highest=5.0) for f in "xz"]
    names = lambda t: [n.feature for n in t.nodes if not n.is_leaf]
    free = trees.grow(df, mappers, num_leaves=4, min_data=5)
    assert set(names(free)) == {"x", "z"}
    # so dear that only one feature is ever worth it; one that an earlier tree paid for costs nothing
    assert set(names(trees.grow(df, mappers, num_leaves=4, min_data=5, once={"x": 1e9}))) == {"z"}
    assert names(trees.grow(df, mappers, num_leaves=4, min_data=5, once={"x": 1e9}, used={"x"})) == names(free)
    # a price below the root's gain is taken off once: the next cut of the feature gains as without it
    some = trees.grow(df, mappers, num_leaves=4, min_data=5, once={"x": 10.0, "z": 10.0})
    root = [n for n in free.nodes if not n.is_leaf][0]
    assert some.nodes[0].feature == root.feature and some.nodes[0].gain == pytest.approx(root.gain - 10)
    again = [n for n in some.nodes[1:] if n.feature == root.feature]
    plain = {(n.feature, n.bin, n.count): n.gain for n in free.nodes if not n.is_leaf}
    assert all(n.gain == pytest.approx(plain.get((n.feature, n.bin, n.count), n.gain)) for n in again)
    # half of the rows have asked for x before and do not pay
    rows = trees.grow(df, mappers, num_leaves=2, min_data=5, each={"x": 0.01})
    cost = 0.01 * df.where("id % 2 = 1").count()
    assert rows.nodes[0].gain == pytest.approx((root.gain - cost) if root.feature == "x" and rows.nodes[0].feature == "x" else rows.nodes[0].gain)
    toy = df.select("id", F.col("bin_x").cast("double").alias("x"), F.col("bin_z").cast("double").alias("z"), (-F.col("g")).alias("y"))
    model = boosting.train(toy, ["x", "z"], "y", ["id"], rounds=3, rate=0.5, num_leaves=3, min_data=5, once={"x": 100.0}, each={"z": 1e6})
    assert {n for t in model.trees for n in names(t)} <= {"x"}
