"""Roles of columns, and the long form that feeds per-feature aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TableSpec:
    """Which columns of a table are features, label, weight, group and row key."""

    features: tuple[str, ...]
    label: str | None = None
    weight: str | None = None
    group: str | None = None
    key: tuple[str, ...] = ()
    kinds: dict[str, str] = field(default_factory=dict)  # feature -> numerical | categorical
    f32_inputs: bool = False


def valid(column: Column | str) -> Column:
    """The value as a double, null where it is null or NaN."""
    c = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(~F.isnan(c), c)


def finite(column: Column | str) -> Column:
    """The value as a double, null where it is null, NaN or infinite."""
    c = valid(column)
    return F.when(F.abs(c) < float("inf"), c)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    """``a / b``, or ``empty`` where ``b`` is zero or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def long_form(df: DataFrame, features: list[str] | tuple[str, ...], ids: list[str] | None = None) -> DataFrame:
    """``ids..., feature, value``: one row per cell, missing cells as null; no shuffle."""
    ids = ids or []
    cells = df.select(*ids, *[valid(f).alias(f) for f in features])
    return cells.unpivot(ids, list(features), "feature", "value")
