"""Profiles, missing-value analysis, validation and correlation of feature tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.operators.ordering import outlines, values_at
from timberline.operators.spec import finite, long_form, ratio, valid

MAX_CATEGORIES = 20


def feature_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """Per feature over its valid cells: count, missing, min, max, mean, population deviation; an empty feature has zeros."""
    cells = long_form(df, features)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return cells.groupBy("feature").agg(
        F.count("value").alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        zero(F.min("value")).alias("min_value"),
        zero(F.max("value")).alias("max_value"),
        zero(F.avg("value")).alias("mean"),
        zero(F.stddev_pop("value")).alias("std"),
    )


def kinds(df: DataFrame, features: list[str], max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """``feature, distinct_ints, kind``: categorical if all valid cells are whole and few differ."""
    cells = long_form(df, features)
    stats = cells.groupBy("feature").agg(
        F.max(F.abs(F.col("value") - F.round("value"))).alias("fraction"),
        F.count_distinct(F.when(F.abs("value") < 1e18, F.floor("value"))).alias("distinct_ints"),
    )
    categorical = (F.coalesce("fraction", F.lit(1.0)) == 0) & (F.col("distinct_ints") <= max_categories)
    return stats.select("feature", "distinct_ints", F.when(categorical, "categorical").otherwise("numerical").alias("kind"))


def table_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: rows, features and the share of missing cells; one pass over the table."""
    missing = sum((valid(f).isNull().cast("long") for f in features), F.lit(0))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.lit(len(features)).cast("long").alias("n_features"),
        ratio(F.sum(missing), F.count("*") * len(features)).alias("sparsity"),
    )


def missing_by_feature(df: DataFrame, features: list[str], threshold: float = 0.8) -> DataFrame:
    """``feature, missing, share, is_high``."""
    cells = long_form(df, features).groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("missing"), F.count("*").alias("n"))
    share = ratio(F.col("missing"), F.col("n"))
    return cells.select("feature", "missing", share.alias("share"), (share > threshold).alias("is_high"))


def missing_by_row(df: DataFrame, features: list[str]) -> Column:
    """Missing cells of a row."""
    return sum((valid(f).isNull().cast("int") for f in features), F.lit(0))


def missing_patterns(df: DataFrame, features: list[str]) -> DataFrame:
    """``pattern, n, share``: rows by the set of features that they miss; the empty pattern too."""
    pattern = F.array_join(F.array_compact(F.array(*[F.when(valid(f).isNull(), F.lit(f)) for f in features])), ",")
    counted = df.groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("pattern", "n", ratio(F.col("n"), F.col("total")).alias("share"))


def order_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, median, q25, q75, mode`` of valid cells.

    The median is the mean of the middle pair; quartiles are the element at
    ``floor(n * q)``; the mode is of values truncated to whole numbers, ties to
    the smallest.
    """
    lines = outlines(df, features)
    spots = {f: {"lo": (n - 1) // 2, "hi": n // 2, "q25": min(int(n * 0.25), n - 1), "q75": min(int(n * 0.75), n - 1)} for f in features if (n := lines[f].total)}
    at = values_at(df, {f: list(p.values()) for f, p in spots.items()}, lines)
    rows = [(f, (at[f][p["lo"]][0] + at[f][p["hi"]][0]) / 2, at[f][p["q25"]][0], at[f][p["q75"]][0]) for f, p in spots.items()]
    found = df.sparkSession.createDataFrame(rows, "feature string, median double, q25 double, q75 double")
    truncated = F.when(F.col("value") < 0, F.ceil("value")).otherwise(F.floor("value"))
    modes = long_form(df, features).where("value is not null").groupBy("feature", truncated.alias("whole")).agg(F.count("*").alias("n"))
    mode = modes.groupBy("feature").agg(F.min(F.struct((-F.col("n")).alias("n"), "whole"))["whole"].cast("double").alias("mode"))
    return found.join(mode, "feature").select("feature", "median", "q25", "q75", "mode")


def equal_width_histogram(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """``feature, bin, n``: equal-width bins over each feature's range, the last one closed; empty bins are left out."""
    cells = long_form(df, features).where(F.col("value").isNotNull())
    spans = cells.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col("value") - F.col("lo"), width)), F.lit(bins - 1)))
    return cells.join(F.broadcast(spans), "feature").groupBy("feature", at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def category_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row: categories, missing, the most and the least frequent one (ties to the smallest)."""
    counted = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    known = F.col("category").isNotNull()
    return counted.agg(
        F.count("category").alias("n_categories"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
        F.min(F.when(known, F.struct((-F.col("n")).alias("n"), "category")))["category"].alias("most_frequent"),
        F.min(F.when(known, F.struct("n", "category")))["category"].alias("least_frequent"),
    )


def pair_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """``a, b, n, cov, vx, vy``: rows in which both features of a pair are finite, and their population moments over these.

    A task sums products of a batch around the batch's own means, all pairs by
    one product of matrices; what leaves it is a row a pair.
    """
    names, m = list(features), len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1)
            there = np.isfinite(x)
            middle = np.where(there, x, 0.0).sum(axis=0) / np.maximum(there.sum(axis=0), 1)
            x, there = np.where(there, x - middle, 0.0), there.astype(float)
            n = there.T @ there
            least = np.maximum(n, 1)
            sx = x.T @ there  # of the row's feature, where the column's is there too
            sq = (x * x).T @ there
            new = (n, middle[:, None] + sx / least, x.T @ x - sx * sx.T / least, sq - sx * sx / least)
            held = new if held is None else merged(held, new)
        if held is not None:
            i, j = np.triu_indices(m, 1)
            n, mean, cov, var = held
            columns = [i.astype(np.int32), j.astype(np.int32), n[i, j], mean[i, j], mean[j, i], cov[i, j], var[i, j], var[j, i]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "n", "mx", "my", "cov", "vx", "vy"])

    def merged(one: tuple, two: tuple) -> tuple:
        n = one[0] + two[0]
        part = one[0] * two[0] / np.maximum(n, 1)
        step = np.where((one[0] > 0) & (two[0] > 0), two[1] - one[1], 0.0)
        mean = (one[0] * one[1] + two[0] * two[1]) / np.maximum(n, 1)
        return n, mean, one[2] + two[2] + part * step * step.T, one[3] + two[3] + part * step * step

    parts = df.select(*[finite(f).alias(f"f{k}") for k, f in enumerate(names)]).mapInArrow(run, "i int, j int, n double, mx double, my double, cov double, vx double, vy double")
    pair, n = Window.partitionBy("i", "j"), F.col("n")  # a row a task and pair
    off = {c: F.col(c) - F.try_divide(F.sum(n * F.col(c)).over(pair), F.sum(n).over(pair)) for c in ("mx", "my")}
    parts = parts.where(n > 0).select("i", "j", "n", "cov", "vx", "vy", off["mx"].alias("dx"), off["my"].alias("dy"))
    whole = lambda c, p, q: (F.sum(F.col(c) + n * F.col(p) * F.col(q)) / F.sum(n)).alias(c)
    sums = parts.groupBy("i", "j").agg(F.sum("n").cast("long").alias("n"), whole("cov", "dx", "dy"), whole("vx", "dx", "dx"), whole("vy", "dy", "dy"))
    pairs = df.sparkSession.createDataFrame([(i, j, names[i], names[j]) for i in range(m) for j in range(i + 1, m)], "i int, j int, a string, b string")
    out = pairs.join(sums, ["i", "j"], "left")
    return out.select("a", "b", F.coalesce("n", F.lit(0)).alias("n"), "cov", "vx", "vy")


def correlations(df: DataFrame, features: list[str]) -> DataFrame:
    """``a, b, r`` for each pair of features, from moments in one pass; 0 without two finite pairs or variance."""
    usable = (F.col("n") >= 2) & (F.col("vx") > 0) & (F.col("vy") > 0)
    return pair_moments(df, features).select("a", "b", F.when(usable, F.try_divide("cov", F.sqrt(F.col("vx") * F.col("vy")))).otherwise(0.0).alias("r"))


def drop_correlated(df: DataFrame, features: list[str], limit: float = 0.95) -> list[str]:
    """Features left when, in order, each later feature too close to a kept one goes."""
    close = {(r["a"], r["b"]) for r in correlations(df, features).where(F.abs("r") > limit).collect()}  # pairs of columns
    gone: set[str] = set()
    for i, a in enumerate(features):
        gone |= {b for b in features[i + 1 :] if a not in gone and (a, b) in close}
    return [f for f in features if f not in gone]


def drop_low_variance(df: DataFrame, features: list[str], least: float = 0.01) -> list[str]:
    """Features whose population variance is above ``least``; one pass, without a row a cell."""
    row = df.agg(*[F.var_pop(valid(f)).alias(f"v{k}") for k, f in enumerate(features)]).first()
    return [f for k, f in enumerate(features) if row[f"v{k}"] is not None and row[f"v{k}"] > least]


def iqr_outliers(df: DataFrame, features: list[str], k: float = 1.5) -> DataFrame:
    """``feature, lower, upper, n_outliers``: cells outside the quartiles by more than ``k`` ranges."""
    quartiles = order_statistics(df, features)
    spread = F.col("q75") - F.col("q25")
    fences = quartiles.select("feature", (F.col("q25") - k * spread).alias("lower"), (F.col("q75") + k * spread).alias("upper"))
    cells = long_form(df, features).join(F.broadcast(fences), "feature")
    outside = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return cells.groupBy("feature", "lower", "upper").agg(F.count_if(outside).alias("n_outliers"))


def validate(df: DataFrame, features: list[str], least_rows: int = 10) -> DataFrame:
    """``check, feature, level``: what is wrong with a table as a training set.

    Errors: too few rows, no features.  Warnings: a sparse table, a constant feature.
    """
    spark = df.sparkSession
    if not features:
        return spark.sql("SELECT 'no_features' AS check, CAST(NULL AS STRING) AS feature, 'error' AS level")
    table = table_statistics(df, features)
    few = table.where(F.col("n_rows") < least_rows).select(F.lit("too_few_rows").alias("check"), F.lit(None).cast("string").alias("feature"), F.lit("error").alias("level"))
    sparse = table.where(F.col("sparsity") > 0.8).select(F.lit("sparse").alias("check"), F.lit(None).cast("string").alias("feature"), F.lit("warning").alias("level"))
    flat = feature_statistics(df, features).where(F.col("std") < 1e-10).select(F.lit("constant").alias("check"), "feature", F.lit("warning").alias("level"))
    return few.unionByName(sparse).unionByName(flat)


def cell_checks(df: DataFrame, features: list[str], ranges: dict[str, tuple[float, float]] | None = None, rules: dict[str, Column] | None = None) -> DataFrame:
    """``check, subject, n``: missing and infinite cells and those outside ``ranges`` by feature, repeated rows, rows that break a rule.

    A repeated row is one whose features all equal those of another, the first
    not counted; nulls equal nulls.  A rule that gives null is not broken.
    Every check has its row, with 0 where nothing is wrong.
    """
    checks = {("missing", f): valid(f).isNull() for f in features}
    checks |= {("infinite", f): F.abs(valid(f)) == float("inf") for f in features}
    checks |= {("out_of_range", f): ~valid(f).between(lo, hi) for f, (lo, hi) in (ranges or {}).items()}
    checks |= {("rule", name): ~rule for name, rule in (rules or {}).items()}
    one = df.agg(*[F.count_if(broken).alias(f"c{i}") for i, broken in enumerate(checks.values())])
    listed = F.explode(F.array(*[F.struct(F.lit(check).alias("check"), F.lit(subject).alias("subject"), F.col(f"c{i}").alias("n")) for i, (check, subject) in enumerate(checks)]))
    repeated = df.groupBy(*features).agg(F.count("*").alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n"))
    return one.select(listed.alias("r")).select("r.*").unionByName(repeated.select(F.lit("repeated_rows").alias("check"), F.lit(None).cast("string").alias("subject"), "n"))
