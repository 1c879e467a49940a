"""Bin mappers: known literals, invariants and brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from timberline.operators import binning


def test_quantile_bounds_of_few_values_are_the_values(spark):
    df = spark.createDataFrame([(float(v),) for v in [3, 1, 2, 2, 1, 3, 3]], "x double")
    (m,) = binning.fit_quantile(df, ["x"], 10)
    assert m.bounds == (1.0, 2.0, 3.0)


def test_quantile_cuts_pick_elements(spark):
    df = spark.range(101).select(F.col("id").cast("double").alias("x"))
    (m,) = binning.fit_quantile(df, ["x"], 4, 3)
    assert m.bounds == (25.0, 50.0, 75.0, 100.0)


def test_missing_values_go_to_the_default_bin(spark):
    m = binning.Mapper("x", bounds=(1.0, 2.0, 3.0), lowest=0.0, highest=3.0).with_missing("separate")
    df = spark.createDataFrame([(None,), (float("nan"),), (-5.0,), (1.5,), (9.0,)], "x double")
    got = [r[0] for r in df.select(binning.to_bin(F.col("x"), m)).collect()]
    assert got == [3, 3, 0, 1, 2]


def test_categories_by_count_then_value(spark):
    df = spark.createDataFrame([(v,) for v in [5, 5, 5, 2, 2, 9, 9, 1]], "c int")
    m = binning.fit_categorical(df, "c", 3)
    assert m.categories == {5: 0, 2: 1, 9: 2}
    assert [r[0] for r in df.where("c = 1").select(binning.to_bin(F.col("c"), m)).collect()] == [2]


def test_kept_bounds_leave_enough_rows():
    assert binning.keep_filled([(1.0, 0), (2.0, 5), (3.0, 7), (4.0, 12)], 5, 4.0) == [2.0, 4.0]
    assert binning.keep_filled([(1.0, 0)], 5, 9.0) == [9.0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-50, 50), st.integers(1, 30)), min_size=1, max_size=60, unique_by=lambda t: t[0]), st.integers(2, 16), st.integers(1, 10))
def test_training_bounds_grow_and_end_at_infinity(pairs, max_bin, min_data):
    pairs = sorted(pairs)
    values, counts = [float(v) for v, _ in pairs], [c for _, c in pairs]
    for bounds in (binning.equal_count_bounds(values, counts, max_bin, min_data), binning.zero_bin_bounds(values, counts, max_bin, min_data)):
        assert bounds == sorted(set(bounds)) and bounds[-1] == math.inf
        assert len(bounds) <= max_bin + 1


def one_by_one(values, counts, max_bin, min_data):
    """The rule of equal counts, read literally: walk the rows' values and ask at each whether its bin is full."""
    total, few = sum(counts), len(values) <= max_bin
    bins = len(values) if few else max(1, min(max_bin, total // max(min_data, 1)))
    is_heavy = lambda i: not few and counts[i] >= total / bins
    light_bins = bins - sum(map(is_heavy, range(len(values))))
    light_after = lambda i: sum(c for j, c in enumerate(counts) if j > i and not is_heavy(j))
    share = lambda i: light_after(i) / light_bins if light_bins > 0 else math.inf
    goal, held, out = (min_data if few else share(-1)), 0, []
    for i in range(len(values) - 1):
        if len(out) == bins - 1:
            break
        held += counts[i]
        if is_heavy(i) or held >= goal or (is_heavy(i + 1) and held >= max(1.0, goal / 2)):
            out.append(i)
            held = 0
            if not few and not is_heavy(i):
                light_bins -= 1
                goal = share(i)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=80), st.integers(1, 20), st.integers(1, 12))
def test_equal_counts_against_the_literal_rule(counts, max_bin, min_data):
    values = [float(i) for i in range(len(counts))]
    got = binning.equal_count_bounds(values, counts, max_bin, min_data)
    assert [math.floor(b) for b in got[:-1]] == one_by_one(values, counts, max_bin, min_data)
    assert all(values[int(b)] < b <= values[int(b) + 1] for b in got[:-1])


def test_information_gain_of_cuts(spark):
    assert binning.information_gain([4, 0], [0, 4]) == 1.0 and binning.information_gain([2, 2], [3, 3]) == pytest.approx(0.0)
    df = spark.createDataFrame([(float(i), int(i > 3), "x") for i in range(8)] + [(None, 1, "x"), (1.0, None, "x")], "v double, y int, n string")
    m = binning.Mapper("v", bounds=(1.0, 3.0, 7.0), lowest=-1.0, highest=9.0)
    got = {r["bin"]: r["gain"] for r in binning.cut_gains(df, m, "y").collect()}
    assert got[1] == pytest.approx(1.0) and got[0] == pytest.approx(binning.information_gain([2, 0], [2, 4])) and got[2] == pytest.approx(0.0)


def test_zero_has_a_bin_of_its_own():
    bounds = binning.zero_bin_bounds([-2.0, -1.0, 0.0, 1.0, 2.0], [10, 10, 10, 10, 10], 10, 1)
    assert -binning.ZERO in bounds and binning.ZERO in bounds


def test_forced_bounds_are_kept():
    values = [float(i) for i in range(100)]
    assert {10.0, 50.0} <= set(binning.forced_bounds(values, [1] * 100, 20, 1, [10.0, 50.0]))


def test_merge_and_check():
    a, b = binning.Mapper("x", bounds=(1.0, 3.0)), binning.Mapper("x", bounds=(2.0, 3.0))
    assert binning.merge(a, b).bounds == (1.0, 2.0, 3.0)
    with pytest.raises(ValueError):
        binning.check(binning.Mapper("x", bounds=(2.0, 1.0)))
    with pytest.raises(ValueError):
        binning.merge(a, binning.Mapper("x", "categorical"))


def test_adaptive_bins_find_a_step(spark):
    df = spark.range(200).select(F.when(F.col("id") < 100, F.col("id") * 0.001).otherwise(10 + F.col("id") * 0.001).alias("x"))
    m = binning.fit_adaptive(df, "x", 2, 3)
    assert len(m.bounds) == 2 and m.bounds[0] < 1


def test_adaptive_bins_against_every_cut(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=250), 1)
    y = np.where(x > 0.5, 3.0, 0.0) + np.where(x < -1, -2.0, 0.0) + 0.3 * rng.normal(size=250)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)] + [(None, 1.0), (1.0, None)], "x double, y double")
    for target in (None, "y"):
        t = y if target else x
        parts, least = [np.arange(250)], 10
        while len(parts) < 5:
            cuts = []
            for k, p in enumerate(parts):
                for v in np.unique(x[p])[:-1]:
                    left, right = p[x[p] <= v], p[x[p] > v]
                    if min(len(left), len(right)) >= least:
                        spread = lambda q: ((t[q] - t[q].mean()) ** 2).sum()
                        cuts.append((spread(p) - spread(left) - spread(right), -v, k))
            gain, v, k = max(cuts)
            p = parts.pop(k)
            parts += [p[x[p] <= -v], p[x[p] > -v]]
        own = df if target else df.where("y is not null or x is null")
        m = binning.fit_adaptive(own, "x", 5, least, target=target)
        assert list(m.bounds) == pytest.approx(sorted(float(x[p].max()) for p in parts))
    assert binning.fit_adaptive(df.limit(0), "x").bounds == (0.0,)


def test_mappers_are_saved_and_loaded(spark, tmp_path):
    made = [binning.Mapper("a", bounds=(1.0, 2.0)), binning.Mapper("b", "categorical", categories={3: 0})]
    binning.save(made, spark.range(1), str(tmp_path / "m"))
    assert binning.load(spark.read.json(str(tmp_path / "m"))) == made


def test_training_fit_and_usable_features(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 10 != 0, F.col("id").cast("double")).alias("x"), F.lit(1.0).alias("flat"))
    x, flat = binning.fit_training(df, ["x", "flat"], 8, 3)
    assert x.missing == "separate" and x.bounds[-1] == math.inf
    assert [m.feature for m in binning.usable_features(df, [x, flat], 20)] == ["x"]
    assert binning.most_frequent_bin(df, flat)[1] == 1.0


@pytest.mark.parametrize("fences,range_rows", [(1024, 1_000_000), (4, 50)])
def test_values_at_exact_positions(spark, monkeypatch, fences, range_rows):
    """Few fences, large ranges that are cut again, one hot value, missing cells."""
    from timberline.operators import ordering

    monkeypatch.setattr(ordering, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(size=900), np.full(700, 0.25), [np.inf, -np.inf]])
    b = np.round(rng.exponential(size=len(a)), 1)
    rows = [(float(x), None if k % 5 == 0 else float(y), None) for k, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    lines = ordering.outlines(df, ["a", "b", "c"], fences)
    places = {f: [0, 1, 17, lines[f].total // 2, lines[f].total - 1, lines[f].total] for f in "abc"}
    got = ordering.values_at(df, places, lines)
    for f, k in (("a", 0), ("b", 1)):
        v = np.sort([r[k] for r in rows if r[k] is not None])
        assert got[f] == {p: (v[p], int((v < v[p]).sum()), int((v == v[p]).sum())) for p in set(places[f]) if p < len(v)}
    assert got["c"] == {}


@pytest.mark.parametrize("counted,near", [(100_000, 64), (20, 64), (20, 0)])
def test_training_bounds_of_all_rows_are_those_of_the_rule(spark, monkeypatch, counted, near):
    """Long columns, whose values are looked up, get the bounds of the rule on all value counts."""
    monkeypatch.setattr(binning, "COUNTED_VALUES", counted)
    monkeypatch.setattr(binning, "NEAR", near)
    rng = np.random.default_rng(11)
    n = 1500
    a = np.round(rng.normal(size=n), 2)  # repeats, both signs
    b = np.concatenate([rng.exponential(size=n - 500), np.full(300, 0.7), np.full(120, 2.0), np.zeros(80)])  # heavy values
    c = np.where(np.arange(n) % 3 == 0, np.nan, np.arange(n) % 4.0)  # few values, gaps
    d = -rng.exponential(size=n)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, d, strict=True)], "a double, b double, c double, d double").repartition(3)
    forced = {"d": [-1.0, -0.25]}
    for bins, least in ((12, 3), (60, 20)):
        got = {m.feature: m for m in binning.fit_training(df, list("abcd"), bins, least, forced)}
        for f, x in zip("abcd", (a, b, c, d), strict=True):
            values, counts = np.unique(x[~np.isnan(x)], return_counts=True)
            room = bins - int(np.isnan(x).any())
            rule = binning.forced_bounds(values.tolist(), counts.tolist(), room, least, forced[f]) if f in forced else binning.zero_bin_bounds(values.tolist(), counts.tolist(), room, least)
            assert list(got[f].bounds) == rule, (f, bins)
            assert (got[f].missing == "separate") == bool(np.isnan(x).any())
