"""Writing tables, images of a dataset, and settings."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.operators.spec import TableSpec


def export(df: DataFrame, path: str, kind: str, mode: str = "errorifexists") -> None:
    """csv, json, parquet or orc."""
    writer = df.write.mode(mode)
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "parquet", "orc"):
        getattr(writer, kind)(path)
    else:
        raise ValueError(f"unknown kind of file: {kind}")


def save_image(df: DataFrame, spec: TableSpec, path: str) -> None:
    """A dataset with its roles: Parquet rows and a small JSON header; never over an old one."""
    df.write.mode("errorifexists").parquet(f"{path}/rows")
    header = df.sparkSession.createDataFrame([(1, json.dumps(asdict(spec)))], "version int, spec string")
    header.coalesce(1).write.mode("errorifexists").json(f"{path}/header")


def load_image(spark: SparkSession, path: str) -> tuple[DataFrame, TableSpec]:
    header = spark.read.schema("version int, spec string").json(f"{path}/header").first()
    if header is None or header["version"] != 1:
        raise ValueError("unknown image")
    spec = json.loads(header["spec"])
    return spark.read.parquet(f"{path}/rows"), TableSpec(**spec | {"features": tuple(spec["features"]), "key": tuple(spec["key"])})


@dataclass(frozen=True)
class Settings:
    """What training and binning are asked for."""

    objective: str = "regression"
    num_iterations: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = -1
    min_data_in_leaf: int = 20
    min_sum_hessian_in_leaf: float = 1e-3
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    max_bin: int = 255
    min_data_in_bin: int = 3
    feature_fraction: float = 1.0
    bagging_fraction: float = 1.0
    early_stopping_rounds: int = 0
    num_class: int = 1
    seed: int = 0

    def check(self) -> Settings:
        """Refuse values out of range."""
        wrong = [
            name
            for name, ok in (
                ("num_iterations", self.num_iterations >= 0),
                ("learning_rate", self.learning_rate > 0),
                ("num_leaves", self.num_leaves > 1),
                ("min_data_in_leaf", self.min_data_in_leaf >= 0),
                ("lambda_l1", self.lambda_l1 >= 0),
                ("lambda_l2", self.lambda_l2 >= 0),
                ("max_bin", self.max_bin > 1),
                ("feature_fraction", 0 < self.feature_fraction <= 1),
                ("bagging_fraction", 0 < self.bagging_fraction <= 1),
                ("num_class", self.num_class >= 1 and (self.num_class > 1) == (self.objective == "multiclass")),
            )
            if not ok
        ]
        if wrong:
            raise ValueError(f"out of range: {', '.join(wrong)}")
        return self


#: Other names of settings.
ALIASES = {"num_trees": "num_iterations", "n_estimators": "num_iterations", "num_round": "num_iterations", "eta": "learning_rate", "shrinkage_rate": "learning_rate", "num_leaf": "num_leaves", "min_child_samples": "min_data_in_leaf", "min_child_weight": "min_sum_hessian_in_leaf", "reg_alpha": "lambda_l1", "reg_lambda": "lambda_l2", "colsample_bytree": "feature_fraction", "subsample": "bagging_fraction", "early_stopping_round": "early_stopping_rounds", "random_state": "seed", "app": "objective", "application": "objective"}


def settings(values: dict) -> Settings:
    """Settings from a mapping with any of the known names; unknown ones are refused."""
    kinds = {f.name: type(getattr(Settings(), f.name)) for f in fields(Settings)}
    named = {ALIASES.get(k, k): v for k, v in values.items()}
    unknown = [k for k in named if k not in kinds]
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return replace(Settings(), **{k: kinds[k](v) for k, v in named.items()}).check()


def load_settings(path: str) -> Settings:
    """From a JSON or TOML file on the driver."""
    with open(path, "rb") as f:
        return settings(tomllib.load(f) if path.endswith(".toml") else json.load(f))


def save_settings(s: Settings, path: str) -> None:
    """As JSON or TOML by the path's ending."""
    values = asdict(s)
    text = "".join(f"{k} = {json.dumps(v)}\n" for k, v in values.items()) if path.endswith(".toml") else json.dumps(values, indent=1)
    with open(path, "w") as f:
        f.write(text)


def settings_from_environment(prefix: str = "TIMBERLINE_", environment: dict[str, str] | None = None) -> Settings:
    """Settings from variables such as ``TIMBERLINE_NUM_LEAVES``."""
    source = os.environ if environment is None else environment
    return settings({k[len(prefix) :].lower(): v for k, v in source.items() if k.startswith(prefix)})


def write_partitioned(df: DataFrame, path: str, by: str, files: int = 8) -> None:
    """Partitioned Parquet whose partitions are dealt to several files each, so no value is one task's work."""
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files))
    df.repartition(F.col(by), part).write.partitionBy(by).parquet(path)
