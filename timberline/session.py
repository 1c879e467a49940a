"""Session helpers."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def share_package(spark: SparkSession) -> None:
    """Let Python workers import the package from where the driver did.

    Only a source checkout needs this; an installed or shipped package
    (``--py-files``) is found anyway.
    """
    root = str(Path(__file__).resolve().parent.parent)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([p for p in paths if p] + [root])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Used only where the session names no shared checkpoint folder and everything runs in one JVM (tests).
LOCAL_SCRATCH = "/tmp/checkpoints/timberline"


_FOLDERS: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``; only a local master can do without."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = LOCAL_SCRATCH
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/timberline-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_drop_at_exit, spark)
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of files that all
    executors share, not a second run of what made them.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores: a table in fewer partitions than cores, so a small one, is dealt anew; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def drop_scratch(spark: SparkSession) -> None:
    """Remove what ``materialize`` wrote; results that still read it end here."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _drop_at_exit(spark: SparkSession) -> None:
    """The folder goes with the driver, unless its JVM is gone already."""
    with contextlib.suppress(Exception):
        drop_scratch(spark)
