"""Reading feature tables from files and arrays, with roles checked and columns cast."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from timberline.operators.spec import TableSpec, valid
from timberline.session import share_package

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def feature_columns(df: DataFrame, label: str | None = "target", weight: str | None = None, group: str | None = None, features: list[str] | None = None) -> list[str]:
    """The named features, or every column without a role."""
    if features is not None:
        missing = [f for f in features if f not in df.columns]
        if missing:
            raise ValueError(f"no such columns: {missing}")
        return list(features)
    return [c for c in df.columns if c not in (label, weight, group)]


def feature_cell(df: DataFrame, name: str) -> Column:
    """A feature as a double: missing as null, booleans as 1 and 0 with null as 0; text is refused."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.col(f"`{name}`").cast("double"), F.lit(0.0))
    if isinstance(kind, NUMERIC):
        return valid(f"`{name}`")
    if isinstance(kind, T.StringType):
        raise ValueError(f"{name}: text requires encoding")
    raise ValueError(f"{name}: unsupported type {kind.simpleString()}")


def load_frame(df: DataFrame, label: str | None = "target", weight: str | None = None, group: str | None = None, features: list[str] | None = None, key: list[str] | None = None, f32_inputs: bool = False, max_rows: int | None = None) -> tuple[DataFrame, TableSpec]:
    """Choose and cast the columns of a training table: one projection, pushed into the scan.

    A null group is group 0.  ``f32_inputs`` narrows features to single
    precision first.
    """
    for role in (label, weight, group, *(key or [])):
        if role is not None and role not in df.columns:
            raise ValueError(f"no such column: {role}")
    names = feature_columns(df, label, weight, group, features)
    if not names:
        raise ValueError("no features")
    cells = [(feature_cell(df, f).cast("float").cast("double") if f32_inputs else feature_cell(df, f)).alias(f) for f in names]
    roles = [F.col(f"`{c}`").cast("double").alias(c) for c in (label, weight) if c is not None]
    groups = [F.coalesce(F.col(f"`{group}`").cast("long"), F.lit(0)).alias(group)] if group else []
    keys = [F.col(f"`{k}`") for k in key or [] if k not in names and k not in (label, weight, group)]
    out = df.select(*keys, *cells, *roles, *groups)
    spec = TableSpec(tuple(names), label, weight, group, tuple(key or ()), f32_inputs=f32_inputs)
    return (out if max_rows is None else out.limit(max_rows)), spec


def require_rows(df: DataFrame) -> DataFrame:
    if not df.limit(1).count():
        raise ValueError("empty table")
    return df


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, delimiter: str = ",", quote: str = '"', escape: str = "\\", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Delimited text; without a schema Spark reads the file once more to infer one."""
    reader = spark.read.option("header", header).option("sep", delimiter).option("quote", quote).option("escape", escape).option("encoding", encoding)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, max_rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.select(*columns) if columns else df
    return df if max_rows is None else df.limit(max_rows)


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (file or stream form), one task a file, from any path that Spark reads.

    The schema is that of the first file by name.
    """
    share_package(spark)
    files = spark.read.format("binaryFile").load(path)
    first = files.orderBy("path").select("content").first()
    if first is None:
        raise ValueError("no files")
    schema = _open_ipc(first["content"]).schema
    from pyspark.sql.pandas.types import from_arrow_schema

    spark_schema = from_arrow_schema(schema)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from _open_ipc(content.as_buffer()).read_all().cast(schema).to_batches()

    return files.select("content").mapInArrow(decode, spark_schema)


def _open_ipc(content) -> pa.ipc.RecordBatchReader:
    try:
        return pa.ipc.open_stream(content)
    except pa.ArrowInvalid:
        table = pa.ipc.open_file(pa.py_buffer(content)).read_all()
        return pa.RecordBatchReader.from_batches(table.schema, table.to_batches())


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """By the path's ending: csv, tsv, parquet, ipc or arrow, json, orc."""
    ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if ending in ("csv", "tsv"):
        return read_csv(spark, path, delimiter=options.pop("delimiter", "\t" if ending == "tsv" else ","), **options)
    if ending == "parquet":
        return read_parquet(spark, path, **options)
    if ending in ("ipc", "arrow"):
        return read_ipc(spark, path)
    if ending in ("json", "orc"):
        return spark.read.format(ending).load(path)
    raise ValueError(f"unknown kind of file: {path}")


def from_arrays(spark: SparkSession, features: np.ndarray, labels: np.ndarray | None = None, weights: np.ndarray | None = None, names: list[str] | None = None) -> tuple[DataFrame, TableSpec]:
    """A table from arrays on the driver, rows numbered in ``row_id``."""
    features = np.asarray(features, dtype=float)
    if features.ndim != 2 or not features.size:
        raise ValueError("features must be a matrix with rows")
    for extra in (labels, weights):
        if extra is not None and len(extra) != len(features):
            raise ValueError("lengths differ")
    names = names or [f"feature_{i}" for i in range(features.shape[1])]
    if len(names) != features.shape[1]:
        raise ValueError("a name for each feature is needed")
    data = pd.DataFrame(features, columns=names)
    data.insert(0, "row_id", np.arange(len(data)))
    if labels is not None:
        data["target"] = np.asarray(labels, dtype=float)
    if weights is not None:
        data["weight"] = np.asarray(weights, dtype=float)
    spec = TableSpec(tuple(names), "target" if labels is not None else None, "weight" if weights is not None else None, key=("row_id",))
    return spark.createDataFrame(data), spec


def from_vectors(df: DataFrame, column: str, label: str | None = None, names: list[str] | None = None) -> tuple[DataFrame, TableSpec]:
    """The components of an array column as feature columns; the other columns stay.

    All arrays must have as many components as the first names ask for, or as
    the longest has; a null array gives missing features.
    """
    width = len(names) if names else df.agg(F.max(F.size(column))).first()[0] or 0
    if width < 1:
        raise ValueError("vectors need components")
    if df.where(F.col(column).isNotNull() & (F.size(column) != width)).limit(1).count():
        raise ValueError("vectors differ in length")
    names = names or [f"feature_{i}" for i in range(width)]
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (column, *names)]
    wide = df.select(*kept, *[F.get(column, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    return wide, TableSpec(tuple(names), label)


def from_flat(spark: SparkSession, flat: list[float], rows: int, columns: int, **roles) -> tuple[DataFrame, TableSpec]:
    """Row-major numbers."""
    if len(flat) != rows * columns:
        raise ValueError("rows x columns differs from the count of numbers")
    return from_arrays(spark, np.array(flat, dtype=float).reshape(rows, columns), **roles)


def synthetic(spark: SparkSession, rows: int, features: int, seed: int = 0) -> tuple[DataFrame, TableSpec]:
    """Uniform features in [-5, 5); the label is whether their sum is positive.  Made on the cluster."""
    names = [f"feature_{i}" for i in range(features)]
    cell = lambda i: F.pmod(F.xxhash64("id", F.lit(seed * 1_000_003 + i)), F.lit(1 << 40)) / float(1 << 40) * 10 - 5
    df = spark.range(rows).select(F.col("id").alias("row_id"), *[cell(i).alias(n) for i, n in enumerate(names)])
    total = sum((F.col(n) for n in names), F.lit(0.0))
    return df.withColumn("target", (total > 0).cast("double")), TableSpec(tuple(names), "target", key=("row_id",))


def memory_estimate(df: DataFrame) -> int:
    """Bytes of the rows by their types, and a missing mask."""
    sizes = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "boolean": 1}
    return df.count() * sum(sizes.get(kind, 16) + 4 for _, kind in df.dtypes)


def attach(df: DataFrame, values: DataFrame, key: list[str], name: str) -> DataFrame:
    """Join a role column ``name`` by key; every row must have one."""
    joined = df.drop(name).join(values.select(*key, name), key, "left")
    if joined.where(F.col(name).isNull()).limit(1).count():
        raise ValueError(f"{name}: rows without a value")
    return joined


def query_boundaries(df: DataFrame, group: str, order: str) -> DataFrame:
    """``run, group, start, stop``: runs of equal group ids in row order, as offsets.

    Rows and runs are numbered by ranges of the order, a number, date or time;
    windows without a partition are over ranges.
    """
    from timberline.operators.ordering import run_starts

    counted = df.select(F.col(group).alias("group"), F.col(order).alias("o"))
    starts = run_starts(counted, "group", "o").where("__new")
    by_range = Window.orderBy("__range")
    sizes = starts.groupBy("__range").agg(F.count("*").alias("n"), F.min("__pos").alias("first"))
    base = F.coalesce(F.sum("n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("__range", base.alias("base"), F.lead("first").over(by_range).alias("next"))
    total = counted.agg(F.count("*").alias("total"))
    w = Window.partitionBy("__range").orderBy("__pos")
    runs = starts.select("*", F.row_number().over(w).alias("k"), F.lead("__pos").over(w).alias("lead"))
    runs = runs.join(F.broadcast(sizes), "__range").crossJoin(F.broadcast(total))
    stop = F.coalesce("lead", "next", "total").cast("long")
    return runs.select((F.col("base") + F.col("k")).cast("int").alias("run"), "group", F.col("__pos").cast("long").alias("start"), stop.alias("stop"))


def with_kinds(spec: TableSpec, kinds: DataFrame) -> TableSpec:
    """The spec with the kinds that ``profile.kinds`` found."""
    return replace(spec, kinds={r["feature"]: r["kind"] for r in kinds.collect()})
