"""Profiling queries over ``lineitem`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import profile
from timberline.plans.common import FEATURES, HOLED_SQL, cells_sql, holed, lineitem, rounded
from timberline.session import read_table


def profile_lineitem(spark, sf_dir):
    return rounded(profile.feature_statistics(holed(spark, sf_dir), FEATURES), 4, "min_value", "max_value", "mean", "std")


def feature_kinds(spark, sf_dir):
    return profile.kinds(lineitem(spark, sf_dir), [*FEATURES, "l_linenumber", "l_suppkey"])


def table_profile(spark, sf_dir):
    return rounded(profile.table_statistics(holed(spark, sf_dir), FEATURES), 6, "sparsity")


def missing_features(spark, sf_dir):
    return rounded(profile.missing_by_feature(holed(spark, sf_dir), FEATURES, 0.25), 6, "share")


def missing_rows(spark, sf_dir):
    rows = holed(spark, sf_dir).groupBy(profile.missing_by_row(holed(spark, sf_dir), FEATURES).alias("n_missing"))
    return rows.agg(F.count("*").alias("n_rows"))


def missing_patterns(spark, sf_dir):
    return rounded(profile.missing_patterns(holed(spark, sf_dir), FEATURES), 6, "share")


def order_statistics(spark, sf_dir):
    return rounded(profile.order_statistics(holed(spark, sf_dir), FEATURES), 4, "median", "q25", "q75", "mode")


def equal_width_histogram(spark, sf_dir):
    return profile.equal_width_histogram(holed(spark, sf_dir), ["l_quantity", "l_tax"], 7)


def category_statistics(spark, sf_dir):
    return profile.category_statistics(read_table(spark, sf_dir, "orders"), "o_orderpriority")


def feature_correlations(spark, sf_dir):
    return rounded(profile.correlations(holed(spark, sf_dir), FEATURES), 6, "r")


def iqr_outliers(spark, sf_dir):
    return rounded(profile.iqr_outliers(lineitem(spark, sf_dir), ["l_extendedprice", "l_quantity"], 0.5), 4, "lower", "upper")


def validation_report(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("one", F.lit(1.0))
    return profile.validate(df, [*FEATURES, "one"])


_CELLS = cells_sql(HOLED_SQL)
QUERIES = {f.__name__: f for f in (profile_lineitem, feature_kinds, table_profile, missing_features, missing_rows, missing_patterns, order_statistics, equal_width_histogram, category_statistics, feature_correlations, iqr_outliers, validation_report)}
_HOLE = "(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END)"
_PAIRS = [(a, b) for i, a in enumerate(FEATURES) for b in FEATURES[i + 1 :]]

ORACLE = {
    "profile_lineitem": f"""
        SELECT feature, count(value) AS n, count(*) - count(value) AS missing, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value,
               round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM ({_CELLS}) GROUP BY feature""",
    "feature_kinds": f"""
        SELECT feature, count(DISTINCT floor(value)) AS distinct_ints,
               CASE WHEN max(abs(value - round(value))) = 0 AND count(DISTINCT floor(value)) <= 20 THEN 'categorical' ELSE 'numerical' END AS kind
        FROM ({cells_sql("lineitem", [*FEATURES, "l_linenumber", "l_suppkey"])}) GROUP BY feature""",
    "table_profile": f"""
        SELECT count(*) AS n_rows, CAST(4 AS BIGINT) AS n_features, round(CAST(sum({_HOLE}) AS DOUBLE) / (count(*) * 4), 6) AS sparsity FROM lineitem""",
    "missing_features": f"""
        SELECT feature, count(*) - count(value) AS missing, round(CAST(count(*) - count(value) AS DOUBLE) / count(*), 6) AS share,
               (count(*) - count(value)) / CAST(count(*) AS DOUBLE) > CAST(0.25 AS DOUBLE) AS is_high FROM ({_CELLS}) GROUP BY feature""",
    "missing_rows": f"SELECT CAST({_HOLE} AS INTEGER) AS n_missing, count(*) AS n_rows FROM lineitem GROUP BY 1",
    "missing_patterns": f"""
        SELECT pattern, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE), 6) AS share FROM (
          SELECT concat_ws(',', CASE WHEN l_discount IS NULL THEN 'l_discount' END, CASE WHEN l_tax IS NULL THEN 'l_tax' END) AS pattern FROM {HOLED_SQL}) GROUP BY pattern""",
    "order_statistics": f"""
        WITH c AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY feature) AS n
                   FROM ({_CELLS}) WHERE value IS NOT NULL),
        m AS (SELECT feature, arg_min(w, (-n, w)) AS mode FROM (SELECT feature, trunc(value) AS w, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY feature)
        SELECT feature, round(median(value), 4) AS median, round(max(CASE WHEN p = least(CAST(floor(n * CAST(0.25 AS DOUBLE)) AS BIGINT), n - 1) THEN value END), 4) AS q25,
               round(max(CASE WHEN p = least(CAST(floor(n * CAST(0.75 AS DOUBLE)) AS BIGINT), n - 1) THEN value END), 4) AS q75, round(any_value(mode), 4) AS mode
        FROM c JOIN m USING (feature) GROUP BY feature""",
    "equal_width_histogram": f"""
        WITH c AS (SELECT * FROM ({cells_sql(HOLED_SQL, ["l_quantity", "l_tax"])}) WHERE value IS NOT NULL),
        s AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM c GROUP BY feature)
        SELECT feature, CAST(least(floor((value - lo) / ((hi - lo) / 7)), 6) AS INTEGER) AS bin, count(*) AS n FROM c JOIN s USING (feature) GROUP BY 1, 2""",
    "category_statistics": """
        WITH c AS (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1)
        SELECT count(k) AS n_categories, CAST(coalesce(sum(CASE WHEN k IS NULL THEN n END), 0) AS BIGINT) AS missing,
               arg_min(k, (-n, k)) AS most_frequent, arg_min(k, (n, k)) AS least_frequent FROM c""",
    "feature_correlations": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})), 6) AS r FROM {HOLED_SQL} WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS
    ),
    "iqr_outliers": f"""
        WITH c AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY feature) AS n
                   FROM ({cells_sql("lineitem", ["l_extendedprice", "l_quantity"])})),
        q AS (SELECT feature, max(CASE WHEN p = CAST(floor(n * CAST(0.25 AS DOUBLE)) AS BIGINT) THEN value END) AS a, max(CASE WHEN p = CAST(floor(n * CAST(0.75 AS DOUBLE)) AS BIGINT) THEN value END) AS b FROM c GROUP BY feature),
        f AS (SELECT feature, a - CAST(0.5 AS DOUBLE) * (b - a) AS lower, b + CAST(0.5 AS DOUBLE) * (b - a) AS upper FROM q)
        SELECT feature, round(lower, 4) AS lower, round(upper, 4) AS upper, count(*) FILTER (WHERE value < lower OR value > upper) AS n_outliers
        FROM c JOIN f USING (feature) GROUP BY feature, lower, upper""",
    "validation_report": "SELECT 'too_few_rows' AS \"check\", CAST(NULL AS VARCHAR) AS feature, 'error' AS level FROM lineitem HAVING count(*) < 10"
    + "".join(f" UNION ALL SELECT 'constant', '{f}', 'warning' FROM (SELECT *, 1.0 AS one FROM lineitem) HAVING stddev_pop({f}) < 1e-10" for f in [*FEATURES, "one"]),
}
