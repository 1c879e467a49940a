"""Scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.functions import scalars as S
from timberline.plans.common import lineitem
from timberline.session import read_table


def math_functions(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    q, d = F.col("l_quantity"), F.col("l_discount")
    return df.groupBy("l_linenumber").agg(
        F.round(F.sum(S.sigmoid(q / 10)), 4).alias("sigmoid"),
        F.sum(S.round_int(q * d)).alias("round_int"),
        F.sum(S.pow2_round_up(q)).alias("pow2"),
        F.round(F.sum(F.when(d > 0, S.safe_log(d))), 4).alias("safe_log"),
        F.sum(S.sign(q - 25)).cast("long").alias("signs"),
    )


def vector_functions(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.round(S.dot(e, e), 5).alias("dot"),
        F.round(S.vector_sum(S.vector_scale(S.vector_add(e, e), 0.5)), 5).alias("total"),
        S.arg_max(e).alias("arg_max"),
        S.arg_min(e).alias("arg_min"),
        F.round(S.kth_largest(e, 3), 6).alias("third"),
        F.round(F.array_max(S.softmax(e)), 6).alias("softmax"),
    )


def bitset_functions(spark, sf_dir):
    words = S.bitset(F.array(*[F.lit(x) for x in (1, 3, 5, 31, 32, 40, 49)]))
    return read_table(spark, sf_dir, "part").groupBy(S.in_bitset(words, F.col("p_size")).alias("inside")).agg(F.count("*").alias("n"))


def string_functions(spark, sf_dir):
    name = F.col("p_type")
    return read_table(spark, sf_dir, "part").select(
        "p_partkey",
        F.size(S.split_any(name, " -")).alias("parts"),
        F.lower(F.trim(name)).alias("lowered"),
        S.parse_int(F.regexp_extract("p_brand", "([0-9]+)", 1)).alias("brand"),
        S.strip_quotes(F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))).alias("bare"),
        S.config_value(F.concat(F.lit("size = "), F.col("p_size").cast("string"), F.lit(" # note\nname="), name), "size").alias("size"),
    )


def json_functions(spark, sf_dir):
    props = F.col("props")
    return read_table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(S.json_field(props, "k", "long")).alias("k"), F.count_if(S.json_has_shape(props, {"k": "BIGINT"})).alias("shaped"))


QUERIES = {f.__name__: f for f in (math_functions, vector_functions, bitset_functions, string_functions, json_functions)}

ORACLE = {
    "math_functions": """
        SELECT l_linenumber, round(sum(1 / (1 + exp(-l_quantity / 10))), 4) AS sigmoid, CAST(sum(CAST(trunc(l_quantity * l_discount + 0.5) AS INTEGER)) AS BIGINT) AS round_int,
          CAST(sum(CAST(power(2, ceil(log2(greatest(l_quantity, 1)))) AS BIGINT)) AS BIGINT) AS pow2, round(sum(CASE WHEN l_discount > 0 THEN ln(l_discount) END), 4) AS safe_log,
          CAST(sum(sign(l_quantity - 25)) AS BIGINT) AS signs FROM lineitem GROUP BY 1""",
    "vector_functions": """
        WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
        SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 5) AS dot, round(list_sum(e), 5) AS total, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS arg_max,
          CAST(list_position(e, list_min(e)) - 1 AS INTEGER) AS arg_min, round(list_reverse_sort(e)[3], 6) AS third,
          round(1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))), 6) AS softmax FROM e""",
    "bitset_functions": "SELECT p_size IN (1, 3, 5, 31, 32, 40, 49) AS inside, count(*) AS n FROM part GROUP BY 1",
    "string_functions": r"""
        SELECT p_partkey, CAST(len(list_filter(regexp_split_to_array(p_type, '[ -]'), lambda x: x <> '')) AS INTEGER) AS parts, lower(trim(p_type)) AS lowered,
          TRY_CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS brand, p_brand AS bare, CAST(p_size AS VARCHAR) AS size FROM part""",
    "json_functions": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) FILTER (WHERE json_type(props, '$.k') IN ('UBIGINT', 'BIGINT')) AS shaped FROM events GROUP BY 1",
}
