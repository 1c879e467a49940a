"""Input tables and the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from timberline.session import materialize, read_table

__all__ = ["materialize", "table"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = read_table(spark, sf_dir, name)
    return df.select(*columns) if columns else df
