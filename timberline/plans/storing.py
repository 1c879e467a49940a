"""Queries over tables that were written and read again, and over readers' other inputs."""

from __future__ import annotations

import uuid
from dataclasses import asdict

import numpy as np
from pyspark.sql import functions as F

from timberline.operators import binning
from timberline.plans.common import lineitem
from timberline.session import read_table, scratch_dir
from timberline.sources import readers, sinks

_PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def _path(spark, ending):
    return f"{scratch_dir(spark)}/stored-{uuid.uuid4().hex}.{ending}"


def csv_round_trip(spark, sf_dir):
    path = _path(spark, "csv")
    sinks.export(read_table(spark, sf_dir, "part"), path, "csv")
    return readers.read_csv(spark, path, _PART)


def csv_inferred(spark, sf_dir):
    """The same by the path's ending, tab-separated, with types that are read off the file."""
    path = _path(spark, "tsv")
    read_table(spark, sf_dir, "supplier").write.option("header", True).option("sep", "\t").csv(path)
    return readers.read(spark, path).select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


def json_round_trip(spark, sf_dir):
    path = _path(spark, "json")
    sinks.export(read_table(spark, sf_dir, "nation"), path, "json")
    return readers.read(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("int").alias("n_regionkey"))


def orc_round_trip(spark, sf_dir):
    path = _path(spark, "orc")
    sinks.export(read_table(spark, sf_dir, "customer"), path, "orc")
    return readers.read(spark, path).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


def parquet_columns(spark, sf_dir):
    df = readers.read_parquet(spark, f"{sf_dir}/lineitem.parquet", ["l_shipdate", "l_quantity"])
    return df.groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.sum("l_quantity"), 2).alias("quantity"))


def read_by_ending(spark, sf_dir):
    return readers.require_rows(readers.read(spark, f"{sf_dir}/orders.parquet")).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def image_round_trip(spark, sf_dir):
    df, spec = readers.load_frame(read_table(spark, sf_dir, "customer"), label="c_acctbal", features=["c_nationkey"], key=["c_custkey"])
    path = _path(spark, "image")
    sinks.save_image(df, spec, path)
    back, again = sinks.load_image(spark, path)
    return back.groupBy(again.features[0]).agg(F.round(F.sum(again.label), 2).alias("total"), F.count("*").alias("n"))


def partitioned_write(spark, sf_dir):
    path = _path(spark, "parts")
    sinks.write_partitioned(read_table(spark, sf_dir, "orders"), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 1).alias("total"))


def group_ids(spark, sf_dir):
    """Groups as whole numbers, a null one as 0; features narrowed to single precision."""
    df = read_table(spark, sf_dir, "orders").withColumn("g", F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey") % 7))
    out, _ = readers.load_frame(df, label="o_totalprice", group="g", features=["o_orderkey"], f32_inputs=True)
    return out.groupBy("g").agg(F.count("*").alias("n"), F.round(F.sum("o_orderkey"), 0).alias("keys"))


def table_of_arrays(spark, sf_dir):
    df, _ = readers.from_arrays(spark, np.array([[1.0, 2.0], [3.0, 4.0], [5.0, float("nan")]]), np.array([0, 1, 1]), np.array([0.5, 1.0, 2.0]), ["a", "b"])
    return df.select("row_id", "a", F.nanvl("b", F.lit(None).cast("double")).alias("b"), "target", "weight")


def table_of_numbers(spark, sf_dir):
    return readers.from_flat(spark, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], 3, 2)[0]


def nested_vectors(spark, sf_dir):
    """Arrays of a column as features of their own, as many as the vectors are long."""
    wide, spec = readers.from_vectors(read_table(spark, sf_dir, "embeddings"), "embedding", label="label")
    return wide.groupBy(F.col("label").cast("int").alias("label")).agg(F.count("*").alias("n"), *[F.round(F.sum(f), 3).alias(f) for f in spec.features])


def synthetic_table(spark, sf_dir):
    """Rows of a made-up table, and how many break its rule."""
    df, spec = readers.synthetic(spark, 5000, 4, 3)
    total = sum((F.col(f) for f in spec.features), F.lit(0.0))
    inside = F.forall(F.array(*spec.features), lambda x: (x >= -5) & (x < 5))
    return df.agg(F.count("*").alias("n"), F.count_if(~inside).alias("outside"), F.count_if((total > 0).cast("double") != F.col("target")).alias("wrong"))


def memory_sizes(spark, sf_dir):
    sizes = [(t, readers.memory_estimate(read_table(spark, sf_dir, t))) for t in ("lineitem", "orders", "part")]
    return spark.createDataFrame(sizes, "table_name string, bytes long")


def attached_weights(spark, sf_dir):
    """A role column joined by key: each order's line count as its weight."""
    weights = lineitem(spark, sf_dir).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("double").alias("w"))
    orders = read_table(spark, sf_dir, "orders").join(weights.select("o_orderkey"), "o_orderkey", "left_semi")
    out = readers.attach(orders, weights, ["o_orderkey"], "w")
    return out.groupBy("o_orderstatus").agg(F.sum("w").alias("weight"), F.count("*").alias("n"))


def settings_by_other_names(spark, sf_dir):
    s = sinks.settings({"eta": "0.2", "num_leaf": "15", "app": "binary", "subsample": "0.5"})
    e = sinks.settings_from_environment("X_", {"X_ETA": "0.3", "OTHER": "1"})
    rows = [(k, str(v), str(asdict(e)[k])) for k, v in asdict(s).items()]
    return spark.createDataFrame(rows, "name string, given string, environment string")


def stored_mappers(spark, sf_dir):
    """Bounds of mappers that were merged, written and read again."""
    df = read_table(spark, sf_dir, "lineitem")
    halves, thirds = (binning.fit_uniform(df, ["l_quantity"], n)[0] for n in (2, 3))
    made = [*binning.fit_quantile(df, ["l_discount"], 64), binning.merge(halves, thirds)]
    path = _path(spark, "mappers")
    binning.save(made, spark.range(1), path)
    out = binning.bounds_table(spark.range(1), binning.load(spark.read.json(path)))
    return out.select("feature", "bin", F.round("upper", 6).alias("upper"))


QUERIES = {
    f.__name__: f
    for f in (csv_round_trip, csv_inferred, json_round_trip, orc_round_trip, parquet_columns, read_by_ending, image_round_trip, partitioned_write, group_ids, table_of_arrays, table_of_numbers, nested_vectors, synthetic_table, memory_sizes, attached_weights, settings_by_other_names, stored_mappers)
}


def _settings_sql() -> str:
    given = asdict(sinks.Settings()) | {"learning_rate": 0.2, "num_leaves": 15, "objective": "binary", "bagging_fraction": 0.5}
    other = asdict(sinks.Settings()) | {"learning_rate": 0.3}
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{given[k]}', '{other[k]}')" for k in given) + ") t(name, given, environment)"


def _bytes(table: str, each: int) -> str:
    return f"SELECT '{table}' AS table_name, CAST(count(*) * {each} AS BIGINT) AS bytes FROM {table}"


ORACLE = {
    "csv_round_trip": "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part",
    "csv_inferred": "SELECT s_suppkey, s_name, s_acctbal FROM supplier",
    "json_round_trip": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "orc_round_trip": "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1",
    "parquet_columns": "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1",
    "read_by_ending": "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1",
    "image_round_trip": "SELECT CAST(c_nationkey AS DOUBLE) AS c_nationkey, round(sum(c_acctbal), 2) AS total, count(*) AS n FROM customer GROUP BY 1",
    "partitioned_write": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 1) AS total FROM orders GROUP BY 1",
    "group_ids": "SELECT CAST(CASE WHEN o_custkey % 3 > 0 THEN o_custkey % 7 ELSE 0 END AS BIGINT) AS g, count(*) AS n, round(sum(CAST(CAST(o_orderkey AS FLOAT) AS DOUBLE)), 0) AS keys FROM orders GROUP BY 1",
    "table_of_arrays": "SELECT CAST(r AS BIGINT) AS row_id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(t AS DOUBLE) AS target, CAST(w AS DOUBLE) AS weight FROM (VALUES (0, 1, 2, 0, 0.5), (1, 3, 4, 1, 1.0), (2, 5, NULL, 1, 2.0)) v(r, a, b, t, w)",
    "table_of_numbers": "SELECT CAST(r AS BIGINT) AS row_id, CAST(2 * r + 1 AS DOUBLE) AS feature_0, CAST(2 * r + 2 AS DOUBLE) AS feature_1 FROM range(3) q(r)",
    "nested_vectors": "SELECT label, count(*) AS n, " + ", ".join(f"round(sum(CAST(embedding[{i + 1}] AS DOUBLE)), 3) AS feature_{i}" for i in range(64)) + " FROM embeddings GROUP BY 1",
    "synthetic_table": "SELECT CAST(5000 AS BIGINT) AS n, CAST(0 AS BIGINT) AS outside, CAST(0 AS BIGINT) AS wrong",
    # bytes of each type and four for the mask: longs 12, ints 8, doubles 12, others 20
    "memory_sizes": " UNION ALL ".join([_bytes("lineitem", 3 * 12 + 8 + 4 * 12 + 2 * 20 + 20), _bytes("orders", 2 * 12 + 12 + 3 * 20), _bytes("part", 12 + 3 * 20 + 8 + 12)]),
    "attached_weights": "SELECT o_orderstatus, CAST(sum(w) AS DOUBLE) AS weight, count(*) AS n FROM orders JOIN (SELECT l_orderkey, count(*) AS w FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1",
    "settings_by_other_names": _settings_sql(),
    "stored_mappers": """
        WITH u AS (SELECT DISTINCT 'l_discount' AS f, l_discount AS u FROM lineitem UNION SELECT 'l_quantity', lo + (hi - lo) * k / n FROM (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), (VALUES (1, 2), (1, 3), (2, 3), (1, 1)) v(k, n))
        SELECT f AS feature, CAST(row_number() OVER (PARTITION BY f ORDER BY u) - 1 AS INTEGER) AS bin, round(u, 6) AS upper FROM u""",
}
