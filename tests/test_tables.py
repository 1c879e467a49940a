"""Readers, imputation, sampling and order statistics on small tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from timberline.operators import impute, ordering, profile, ranking, sampling, scale
from timberline.sources import readers, sinks
from timberline.streaming import windows


def test_csv_parquet_and_ipc_round_trips(spark, tmp_path):
    df, spec = readers.from_arrays(spark, np.arange(12).reshape(4, 3), np.array([0, 1, 0, 1]))
    sinks.export(df, str(tmp_path / "t.csv"), "csv")
    sinks.export(df, str(tmp_path / "t.parquet"), "parquet")
    table = pa.table({c: [r[c] for r in df.collect()] for c in df.columns})
    (tmp_path / "t.arrow").mkdir()
    for name, opened in (("a", pa.ipc.new_file), ("b", pa.ipc.new_stream)):
        with opened(str(tmp_path / "t.arrow" / name), table.schema) as f:
            f.write_table(table)
    for path, times in (("t.csv", 1), ("t.parquet", 1), ("t.arrow", 2)):
        got = readers.read(spark, str(tmp_path / path))
        assert got.agg(F.sum("feature_2"), F.count("*")).first() == (times * (2 + 5 + 8 + 11), times * 4)
    assert spec.features == ("feature_0", "feature_1", "feature_2")
    with pytest.raises(ValueError):
        readers.read(spark, "x.unknown")


def test_roles_are_checked(spark):
    df = spark.createDataFrame([(1, True, "a", 2.0)], "n int, b boolean, s string, target double")
    with pytest.raises(ValueError, match="requires encoding"):
        readers.load_frame(df)
    out, spec = readers.load_frame(df, features=["n", "b"])
    assert out.first().asDict() == {"n": 1.0, "b": 1.0, "target": 2.0}
    with pytest.raises(ValueError):
        readers.load_frame(df, label="missing")
    with pytest.raises(ValueError):
        readers.require_rows(df.limit(0))


def test_image_and_settings(spark, tmp_path):
    df, spec = readers.synthetic(spark, 20, 2)
    sinks.save_image(df, spec, str(tmp_path / "image"))
    again, spec2 = sinks.load_image(spark, str(tmp_path / "image"))
    assert again.count() == 20 and spec2 == spec
    s = sinks.settings({"eta": "0.2", "num_leaf": 7})
    sinks.save_settings(s, str(tmp_path / "s.toml"))
    assert sinks.load_settings(str(tmp_path / "s.toml")) == s
    assert sinks.settings_from_environment(environment={"TIMBERLINE_NUM_LEAVES": "5"}).num_leaves == 5
    with pytest.raises(ValueError):
        sinks.settings({"learning_rate": -1})


def test_fills_across_stretches(spark):
    rows = [(1, i, float(i) if i in (3, 7) else None) for i in range(10)]
    df = spark.createDataFrame(rows, "g int, t int, v double")
    near = impute.neighbours_in_order(df, "v", ["g"], ["t"], F.floor(F.col("t") / 2))
    got = near.select("t", impute.forward_fill(near).alias("f"), impute.backward_fill(near).alias("b"), impute.linear_fill(near).alias("l")).orderBy("t").collect()
    assert [r["f"] for r in got] == [0, 0, 0, 3, 3, 3, 3, 7, 7, 7]
    assert [r["b"] for r in got] == [3, 3, 3, 3, 7, 7, 7, 7, 0, 0]
    assert [r["l"] for r in got] == [3, 3, 3, 3, 4, 5, 6, 7, 7, 7]


def test_knn_fill_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    rows = [(i, *map(float, r[:2]), None if i % 4 == 0 else float(r[2])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    got = {r["id"]: r["c"] for r in impute.knn_fill(df, ["a", "b", "c"], "c", ["id"], 3).collect()}
    full = np.array([i for i in range(40) if i % 4])
    for i in range(0, 40, 4):
        d = np.sqrt(((x[full, :2] - x[i, :2]) ** 2).sum(axis=1))
        near = np.argsort(d)[:3]
        assert got[i] == pytest.approx((x[full[near], 2] / d[near]).sum() / (1 / d[near]).sum())


def test_knn_fill_with_repeated_keys(spark):
    """Two rows of key 1 and one of key 2 meet the same neighbours and get the same value."""
    rows = [(1, 0.0, None), (1, 0.0, None), (2, 0.0, None), (1, 5.0, None), (3, 1.0, 10.0), (4, 1.0, 10.0), (5, 2.0, 40.0), (6, 4.0, 70.0)]
    df = spark.createDataFrame(rows, "id int, x double, c double")
    got = sorted((r["id"], r["x"], round(r["c"], 9)) for r in impute.knn_fill(df, ["x", "c"], "c", ["id"], 2).collect())
    assert got == [(1, 0.0, 10.0), (1, 0.0, 10.0), (1, 5.0, 62.5), (2, 0.0, 10.0), (3, 1.0, 10.0), (4, 1.0, 10.0), (5, 2.0, 40.0), (6, 4.0, 70.0)]


def test_knn_fill_over_many_blocks_meets_few_points(spark):
    """Blocks and cells leave the neighbours as they are, ties included, and the search holds few pairs of rows."""
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(size=(3000, 2)) * 40)
    x[:, 1] *= 25
    v = np.where(np.arange(3000) % 3 == 0, np.nan, rng.integers(0, 50, 3000))
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, v, strict=True))], "id int, a double, b double, c double")
    got = {r["id"]: r["c"] for r in impute.knn_fill(df, ["a", "b", "c"], "c", ["id"], 3, block_rows=100).collect()}
    full = ~np.isnan(v)
    for i in np.flatnonzero(~full):
        d = np.sqrt(((x[full] - x[i]) ** 2).sum(axis=1))
        near = np.lexsort((v[full], d))[:3]
        w = np.where(d[near] > 0, 1 / np.maximum(d[near], 1e-300), 1e6)
        assert got[i] == pytest.approx((w * v[full][near]).sum() / w.sum())
    assert len(got) == 3000
    points, asks = rng.uniform(size=(20_000, 3)), rng.uniform(size=(500, 3))
    cells, pairs = impute.Cells(points, 128), 0
    far = np.sqrt(((asks[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)).min(axis=1)
    for cell, rows in cells.visits(asks, far):
        pairs += len(rows) * len(cells.held[cell])
    assert pairs < 500 * 20_000 / 20


def test_vectors_become_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [3.0, None])], "y int, v array<double>")
    wide, spec = readers.from_vectors(df, "v", label="y")
    assert spec.features == ("feature_0", "feature_1") and spec.label == "y"
    assert sorted(map(tuple, wide.collect())) == [(1, 1.0, 2.0), (2, None, None), (3, 3.0, None)]
    with pytest.raises(ValueError):
        readers.from_vectors(df, "v", names=["a", "b", "c"])


def test_random_fill_draws_observed_values(spark):
    df = spark.createDataFrame([(i, float(i % 3) if i % 2 else None) for i in range(100)], "id int, v double")
    got = impute.random_fill(df, "v", F.col("id"))
    assert got.count() == 100 and {r["v"] for r in got.collect()} == {0.0, 1.0, 2.0}


def test_running_sums_and_numbers_match_plain_windows(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = {r["o"]: r["s"] for r in ordering.running_sums(df, ["g"], "o", {"s": F.col("v")}, 8).collect()}
    assert got == {o: sum(k % 7 for k in range(o) if k % 3 == o % 3) for o in range(500)}
    numbers = sampling.numbered(df.select("o"), -F.col("o")).collect()
    assert {r["o"]: r["row_number"] for r in numbers} == {o: 499 - o for o in range(500)}


def test_sampling_helpers(spark):
    assert sampling.lcg_sample(5, 9, 1) == [0, 1, 2, 3, 4]
    assert len(sampling.lcg_sample(100, 10, 3)) == 10
    assert sampling.sample_features(list("abcd"), 0.5, 1) == sorted(sampling.sample_features(list("abcd"), 0.5, 1))
    assert sampling.allowed_features(["a", "b", "c"], {"a"}, [{"a", "b"}, {"c"}]) == ["a", "b"]
    df = spark.range(10_000)
    assert 2700 < sampling.bagging(df, F.col("id"), 0.3).count() < 3300
    kept = sampling.bagging_by_label(df.withColumn("y", F.col("id") % 2), F.col("id"), "y", 1.0, 0.0)
    assert kept.count() == 5000


def test_missing_reports_and_selection(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, None, 5.0), (nan, None, 5.0), (3.0, 1.0, 5.0)], "a double, b double, c double")
    assert {r["pattern"]: r["n"] for r in profile.missing_patterns(df, ["a", "b", "c"]).collect()} == {"b": 1, "a,b": 1, "": 1}
    assert impute.drop_sparse_features(df, ["a", "b", "c"], 0.5) == ["a", "c"]
    assert profile.drop_low_variance(df, ["a", "b", "c"]) == ["a"]
    wide = spark.range(50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"), F.pmod(F.col("id") * 7, F.lit(11)).cast("double").alias("z"))
    assert profile.drop_correlated(wide, ["x", "y", "z"]) == ["x", "z"]
    assert profile.validate(df, []).first()["check"] == "no_features"
    assert {r["check"] for r in profile.validate(df, ["c"]).collect()} == {"too_few_rows", "constant"}
    assert scale.first_features(["a", "b"], 1) == ["a"]


def test_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], "a double, b double")
    assert profile.feature_statistics(empty, ["a", "b"]).count() in (0, 2)
    assert profile.order_statistics(empty, ["a"]).count() == 0
    nulls = spark.createDataFrame([(None,), (None,)], "a double")
    row = profile.feature_statistics(nulls, ["a"]).first()
    assert (row["n"], row["missing"], row["mean"]) == (0, 2, 0.0)
    assert impute.fit_constants(nulls, {"a": "median"}) == {"a": 0.0}


def test_a_stream_of_files_gives_the_batch_result(spark, tmp_path):
    events = spark.range(200).select((F.lit(1_600_000_000) + F.col("id") * 3600).cast("timestamp").alias("ts"), F.col("id").cast("double").alias("v"), (F.col("id") % 2).alias("k"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = windows.windowed_profile(stream, "ts", "v", ["k"]).writeStream.outputMode("complete").format("memory").queryName("profiled").start()
    query.processAllAvailable()
    query.stop()
    want = sorted(map(tuple, windows.windowed_profile(events, "ts", "v", ["k"]).collect()))
    assert sorted(map(tuple, spark.table("profiled").collect())) == want


def test_query_boundaries(spark):
    df = spark.createDataFrame([(i, g) for i, g in enumerate([4, 4, 7, 4])], "o int, g int")
    got = [(r["group"], r["start"], r["stop"]) for r in readers.query_boundaries(df, "g", "o").orderBy("run").collect()]
    assert got == [(4, 0, 2), (7, 2, 3), (4, 3, 4)]


def test_runs_over_all_rows_by_ranges(spark):
    rng = np.random.default_rng(5)
    groups = np.repeat(rng.integers(0, 4, 1500), rng.integers(1, 5, 1500)).tolist()
    df = spark.createDataFrame(list(enumerate(groups)), "o int, g int").repartition(3)
    begins = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]]
    want = [(k + 1, groups[b], b, e) for k, (b, e) in enumerate(zip(begins, [*begins[1:], len(groups)], strict=True))]
    assert sorted(map(tuple, readers.query_boundaries(df, "g", "o").collect())) == want
    number = {r["o"]: r["run"] for r in ranking.runs(df, "g", "o").collect()}
    assert all(number[i] == k for k, g, b, e in want for i in range(b, e))
    for out in (readers.query_boundaries(df, "g", "o"), ranking.runs(df, "g", "o")):
        whole = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x and "__range" not in x]
        assert not whole


def test_rank_agreement_of_a_hot_query(spark):
    rng = np.random.default_rng(6)
    rel = {1: rng.integers(0, 5, 400).tolist(), 2: [3], 3: [6, 0, 5, 4, 1], 4: [2, 2]}
    rows = spark.createDataFrame([(q, i, float(r)) for q, l in rel.items() for i, r in enumerate(l, 1)], "query int, pos int, rel double")
    tau, err = ranking.kendall(rows), ranking.expected_reciprocal_rank(rows)
    for out in (tau, err):
        assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()
    tau, err = ({r[0]: r[1] for r in out.collect()} for out in (tau, err))
    for q, l in rel.items():
        n, go, want = len(l), 1.0, 0.0
        score = sum(np.sign(l[i] - l[j]) for i in range(n) for j in range(i + 1, n))
        assert tau[q] == pytest.approx(score / (n * (n - 1) / 2) if n > 1 else 0)
        for i, r in enumerate(l, 1):
            use = (2.0**r - 1) / 16
            want, go = want + go * use / i, go * (1 - use)
        assert err[q] == pytest.approx(want)


def test_d2_and_medians_without_lists_of_values(spark, monkeypatch):
    """The same as numpy's, and no aggregate that holds every value."""
    from timberline.operators import regression

    monkeypatch.setattr(F, "median", lambda *a: pytest.fail("a list of all values"))
    rng = np.random.default_rng(3)
    y, p = np.round(rng.exponential(size=400), 2) + 0.5, rng.uniform(1, 2, 400)
    df = spark.createDataFrame([(float(a), float(b), "xyz"[k % 3] if k % 7 else None) for k, (a, b) in enumerate(zip(y, p, strict=True))] + [(None, 1.0, "x")], "y double, p double, g string")
    row = regression.d2_scores(df, F.col("p"), F.col("y"), 0.3).first()
    assert row["d2_absolute_error"] == pytest.approx(1 - np.abs(p - y).mean() / np.abs(np.median(y) - y).mean())
    loss = lambda q: np.where(y >= q, 0.3 * (y - q), 0.7 * (q - y)).mean()
    assert row["d2_pinball"] == pytest.approx(1 - loss(p) / loss(np.sort(y)[int(399 * 0.3)]))
    assert regression.d2_absolute_error(df, F.col("p"), F.col("y")).first()[0] == pytest.approx(row["d2_absolute_error"])
    got = {r["g"]: r["median_absolute_error"] for r in regression.median_absolute_errors(df, F.col("p"), F.col("y"), "g").collect()}
    for g in "xyz":
        own = [k for k in range(400) if k % 7 and "xyz"[k % 3] == g]
        assert got[g] == pytest.approx(np.median(np.abs(p - y)[own]))
    assert got[None] == pytest.approx(np.median(np.abs(p - y)[::7]))


def test_moments_of_pairs_in_one_pass(spark):
    """Far from zero, with gaps, over several parts: as numpy's over the rows that hold both; four numbers a pair are not four aggregates."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 3)) + [1e8, 0.0, -5.0]
    x[:, 2] += x[:, 1]
    x[::5, 0], x[1::7, 1], x[2::11, 2] = np.nan, np.inf, np.nan
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").withColumn("gone", F.lit(None).cast("double")).repartition(5)
    got = {(r["a"], r["b"]): r for r in profile.pair_moments(df, ["a", "b", "c", "gone"]).collect()}
    assert len(got) == 6 and got["a", "gone"]["n"] == 0
    for i, j in ((0, 1), (0, 2), (1, 2)):
        both = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
        c = np.cov(x[both][:, [i, j]].T, ddof=0)
        r = got["abc"[i], "abc"[j]]
        assert r["n"] == both.sum() and (r["cov"], r["vx"], r["vy"]) == (pytest.approx(c[0, 1], abs=1e-7), pytest.approx(c[0, 0], abs=1e-7), pytest.approx(c[1, 1], abs=1e-7))
    rows = {(r["a"], r["b"]): r["r"] for r in profile.correlations(df, ["a", "c", "gone"]).collect()}
    assert rows["a", "gone"] == 0 and rows["a", "c"] == pytest.approx(got["a", "c"]["cov"] / np.sqrt(got["a", "c"]["vx"] * got["a", "c"]["vy"]))
    assert profile.correlations(df.limit(0), ["a", "b"]).first()["r"] == 0


def test_rank_agreement_of_few_grades_multiplies_no_row(spark, capsys, monkeypatch):
    """Grades side by side and grades as rows agree; unknown grades too."""
    df = spark.range(400).select(F.floor(F.col("id") / 9).alias("query"), (F.col("id") % 9 + 1).alias("pos"), F.when(F.col("id") % 50 != 3, F.pmod(F.xxhash64("id"), F.lit(4))).alias("rel"))
    few = ranking.kendall(df)
    few.explain()
    assert "Generate" not in capsys.readouterr().out
    monkeypatch.setattr(ranking, "FEW_GRADES", 0)
    assert sorted(few.collect()) == sorted(ranking.kendall(df).collect())


def test_ranges_by_halving_count_bounds_below(spark, capsys):
    """As many ranges as bounds below a value, without a search through them all in each row."""
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 1, 2, 8, 8, 9, 3]] + [(None,), (float("nan"),)], "v double")
    out = ordering.with_ranges(df, [], "v", 4)
    out.explain()
    assert "filter(" not in capsys.readouterr().out
    bounds = df.agg(F.array_distinct(F.percentile_approx("v", [0.25, 0.5, 0.75], 40))).first()[0]
    for r in out.collect():
        above = r["v"] is not None and r["v"] != r["v"]
        assert r["__range"] == (0 if r["v"] is None else sum(above or b < r["v"] for b in bounds if b == b))
