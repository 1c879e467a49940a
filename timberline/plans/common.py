"""Tables and SQL fragments that the query families share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.session import read_table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]

#: Missing cells of the feature table, by rules on a row's values.
HOLES = {"l_discount": ("l_linenumber", 3), "l_tax": ("l_partkey", 5)}


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "lineitem")


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` with some discounts missing and some taxes NaN."""
    df = lineitem(spark, sf_dir)
    df = df.withColumn("l_discount", F.when(F.col("l_linenumber") % 3 != 0, F.col("l_discount")))
    return df.withColumn("l_tax", F.when(F.col("l_partkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("l_tax")))


HOLED_SQL = """(SELECT * REPLACE (
    CASE WHEN l_linenumber % 3 != 0 THEN l_discount END AS l_discount,
    CASE WHEN l_partkey % 5 != 0 THEN l_tax END AS l_tax) FROM lineitem)"""


def cells_sql(source: str = "lineitem", features: list[str] = FEATURES) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {source}" for f in features)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.select(*[F.round(F.col(c), digits).alias(c) if c in columns else F.col(c) for c in df.columns])
