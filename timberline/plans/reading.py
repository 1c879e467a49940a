"""Queries that read tables into roles, and windowed profiles of events."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.plans.common import KEY, lineitem
from timberline.session import read_table
from timberline.sources import readers
from timberline.streaming import windows


def training_table(spark, sf_dir):
    """A digest of the table as loaded: labels, weights and single-precision features."""
    df = lineitem(spark, sf_dir).withColumn("target", F.col("l_returnflag") == "R").withColumn("flag", F.col("l_linenumber") > 3)
    df = df.withColumn("target", F.col("target").cast("int"))
    out, spec = readers.load_frame(df, "target", "l_tax", "l_suppkey", ["l_quantity", "l_discount", "flag"], f32_inputs=True)
    return out.groupBy("target").agg(F.count("*").alias("n"), *[F.round(F.sum(f), 3).alias(f) for f in spec.features], F.round(F.sum("l_tax"), 3).alias("weight"), F.count_distinct("l_suppkey").alias("groups"))


def query_runs(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders")
    return readers.query_boundaries(orders.withColumn("g", F.floor(F.col("o_custkey") / 400)), "g", "o_orderkey")


def keep_columns(spark, sf_dir):
    df = lineitem(spark, sf_dir).select(*KEY, "l_quantity")
    return df.select(*KEY, F.round("l_quantity", 2).alias("l_quantity"))


def event_windows(spark, sf_dir):
    out = windows.windowed_profile(read_table(spark, sf_dir, "events"), "ts", "value", ["event_type"], "7 days")
    return out.select("window_start", "event_type", "n", "missing", F.round("total", 3).alias("total"), F.round("least", 4).alias("least"), F.round("greatest", 4).alias("greatest")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


def event_sliding_windows(spark, sf_dir):
    out = windows.windowed_profile(read_table(spark, sf_dir, "events"), "ts", "value", [], "2 days", "1 day")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n", F.round("total", 3).alias("total"))


def event_sessions(spark, sf_dir):
    out = windows.sessions(read_table(spark, sf_dir, "events"), "ts", ["user_id"], "6 hours")
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"), F.sum("n").alias("events"))


def metric_rollup(spark, sf_dir):
    """Errors of a constant prediction, with subtotals."""
    df = lineitem(spark, sf_dir)
    err = F.abs(F.col("l_quantity") - 25.0)
    return df.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.avg(err), 5).alias("mae"), F.grouping_id().cast("int").alias("level"))


QUERIES = {f.__name__: f for f in (training_table, query_runs, keep_columns, event_windows, event_sliding_windows, event_sessions, metric_rollup)}

ORACLE = {
    "training_table": """
        SELECT CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS target, count(*) AS n, round(sum(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE)), 3) AS l_quantity,
          round(sum(CAST(CAST(l_discount AS FLOAT) AS DOUBLE)), 3) AS l_discount, CAST(count(*) FILTER (WHERE l_linenumber > 3) AS DOUBLE) AS flag, round(sum(l_tax), 3) AS weight, count(DISTINCT l_suppkey) AS groups FROM lineitem GROUP BY 1""",
    "query_runs": """
        WITH o AS (SELECT o_custkey // 400 AS g, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, lag(o_custkey // 400) OVER (ORDER BY o_orderkey) AS p FROM orders),
        s AS (SELECT * FROM o WHERE p IS NULL OR p <> g)
        SELECT CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS run, g AS "group", pos AS start, coalesce(lead(pos) OVER (ORDER BY pos), (SELECT count(*) FROM o)) AS stop FROM s""",
    "keep_columns": f"SELECT {', '.join(KEY)}, round(l_quantity, 2) AS l_quantity FROM lineitem",
    "event_windows": """
        SELECT strftime(to_timestamp(floor(epoch(ts) / 604800) * 604800) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, CAST(0 AS BIGINT) AS missing,
          round(sum(value), 3) AS total, round(min(value), 4) AS least, round(max(value), 4) AS greatest FROM events GROUP BY 1, 2""",
    "event_sliding_windows": """
        SELECT strftime(to_timestamp((floor(epoch(ts) / 86400) - k) * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n, round(sum(value), 3) AS total FROM events, range(2) r(k) GROUP BY 1""",
    "event_sessions": """
        WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e), n AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2)
        SELECT user_id, count(*) AS sessions, max(n) AS longest, CAST(sum(n) AS BIGINT) AS events FROM n GROUP BY 1""",
    "metric_rollup": """
        SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(abs(l_quantity - 25.0)), 5) AS mae, CAST(grouping(l_returnflag, l_linestatus) AS INTEGER) AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
}
