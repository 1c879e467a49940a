"""Scaling, encoding, outlier handling and feature selection."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.ordering import outlines, value_counts, values_at
from timberline.operators.profile import correlations, feature_statistics, order_statistics
from timberline.operators.spec import long_form, ratio, valid


def min_max(x: Column, lo: float, hi: float) -> Column:
    return F.lit(0.0) if hi == lo else (x - lo) / (hi - lo)


def standard(x: Column, mean: float, std: float) -> Column:
    return F.lit(0.0) if std == 0 else (x - mean) / std


def robust(x: Column, mean: float, q25: float, q75: float) -> Column:
    """Centred on the mean, divided by the quartile range."""
    return F.lit(0.0) if q75 == q25 else (x - mean) / (q75 - q25)


def fit_scaler(df: DataFrame, features: list[str], method: str) -> dict[str, dict[str, float]]:
    """Per feature the numbers its scaling needs; one row a feature reaches the driver."""
    stats = {r["feature"]: r.asDict() for r in feature_statistics(df, features).collect()}
    if method == "robust":
        for r in order_statistics(df, features).collect():
            stats[r["feature"]] |= {"q25": r["q25"], "q75": r["q75"]}
    return stats


def scale(df: DataFrame, fitted: dict[str, dict[str, float]], method: str) -> DataFrame:
    """Replace features by their scaled values; one projection, missing stays missing."""
    forms = {
        "minmax": lambda x, s: min_max(x, s["min_value"], s["max_value"]),
        "standard": lambda x, s: standard(x, s["mean"], s["std"]),
        "robust": lambda x, s: robust(x, s["mean"], s.get("q25", 0.0), s.get("q75", 0.0)),
    }
    scaled = {f: F.when(valid(f).isNotNull(), forms[method](valid(f), s)) for f, s in fitted.items()}
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(f"`{c}`") for c in df.columns])


def percent_ranks(df: DataFrame, features: list[str]) -> DataFrame:
    """``feature, value, percent_rank`` of each distinct value: the share of other rows that lie below."""
    ranked = value_counts(long_form(df, features))
    return ranked.select("feature", "value", ratio(F.col("before"), F.col("total") - 1).alias("percent_rank"))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """``category, code``: codes from 0 in the order of the categories."""
    from timberline.operators.sampling import numbered

    categories = df.select(F.col(column).alias("category")).where("category is not null").distinct()
    spots = categories.withColumn("__n", F.conv(F.hex(F.substring(F.rpad(F.col("category").cast("string"), 6, "\0"), 1, 6)), 16, 10).cast("double"))
    return numbered(spots, F.col("__n"), "code").select("category", "code")


def one_hot(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Append ``<column>_<category>``, 1 or 0, for the given categories."""
    return df.select("*", *[F.coalesce((F.col(column) == c).cast("int"), F.lit(0)).alias(f"{column}_{c}") for c in categories])


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    """``category, frequency``: the category's share of all rows."""
    counted = df.groupBy(F.col(column).alias("category")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    return counted.crossJoin(F.broadcast(total)).select("category", ratio(F.col("n"), F.col("total")).alias("frequency"))


def target_encode(df: DataFrame, column: str, label: Column) -> DataFrame:
    """``category, target``: the mean label of the category."""
    return df.groupBy(F.col(column).alias("category")).agg(F.avg(label.cast("double")).alias("target"))


def binary_encode(codes: DataFrame, bits: int) -> DataFrame:
    """Append ``bit_0 ..``: the bits of ``code``."""
    return codes.select("*", *[F.shiftright("code", k).bitwiseAND(F.lit(1)).cast("int").alias(f"bit_{k}") for k in range(bits)])


def cap_outliers(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    capped = {f: F.greatest(F.least(valid(f), F.lit(hi)), F.lit(lo)) for f, (lo, hi) in fences.items()}
    return df.select(*[capped[c].alias(c) if c in capped else F.col(f"`{c}`") for c in df.columns])


def remove_outliers(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    keep = F.lit(True)
    for f, (lo, hi) in fences.items():
        keep = keep & (valid(f).isNull() | valid(f).between(lo, hi))
    return df.where(keep)


def log_transform(x: Column) -> Column:
    """``sign(x) * ln(1 + abs(x))``."""
    return F.signum(x) * F.log1p(F.abs(x))


def rank_by_label(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """``feature, score``: absolute correlation with the label, for choosing the best ``k``."""
    return correlations(df, [label, *features]).where(F.col("a") == label).select(F.col("b").alias("feature"), F.abs("r").alias("score"))


@dataclass(frozen=True)
class QuantileScale:
    """Values at even steps of a feature's order, first to last."""

    feature: str
    knots: tuple[float, ...]


def fit_quantile_scale(df: DataFrame, features: list[str], steps: int = 1000) -> list[QuantileScale]:
    """Exact values at positions ``round((n - 1) * k / steps)``; the driver gets ``steps + 1`` numbers a feature."""
    lines = outlines(df, features)
    places = {f: [math.floor((lines[f].total - 1) * k / steps + 0.5) for k in range(steps + 1)] for f in features if lines[f].total}
    at = values_at(df, places, lines)
    return [QuantileScale(f, tuple(at[f][p][0] for p in places[f]) if f in places else ()) for f in features]


def quantile_scale(df: DataFrame, scales: list[QuantileScale]) -> DataFrame:
    """Each feature's share of the rows below it, from 0 to 1, on straight lines between the knots.

    A value that several knots have lies in the middle of them; values beyond
    the ends are 0 and 1, missing cells stay missing.  Rows meet the knots by
    bisection in Arrow batches; nothing is joined.
    """
    names = [s.feature for s in scales]
    knots = [np.array(s.knots, dtype=float) for s in scales]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {}
            for k, x in enumerate(knots):
                v = batch[f"c{k}"].to_numpy(dtype=float)
                if not len(x):
                    out[f"c{k}"] = np.full(len(v), np.nan)
                    continue
                share = np.linspace(0.0, 1.0, len(x))
                out[f"c{k}"] = 0.5 * (np.interp(v, x, share) - np.interp(-v, -x[::-1], -share[::-1]))
            yield pd.DataFrame(out, index=batch.index)

    schema = ", ".join(f"c{k} double" for k in range(len(names)))
    scaled = F.pandas_udf(run, schema)
    cells = F.struct(*[valid(f).alias(f"c{k}") for k, f in enumerate(names)])
    rows = df.withColumn("__scaled", scaled(cells))
    value = {f: F.when(valid(f).isNotNull(), F.col("__scaled")[f"c{k}"]) for k, f in enumerate(names)}
    return rows.select(*[value[c].alias(c) if c in value else F.col(f"`{c}`") for c in df.columns])


def products(df: DataFrame, features: list[str], label: str) -> tuple[np.ndarray, np.ndarray, int]:
    """``(correlations of the features, correlations with the label, rows)`` of complete rows, from one aggregation."""
    x = [valid(f) for f in [*features, label]]
    complete = F.lit(True)
    for c in x:
        complete = complete & c.isNotNull()
    rows = df.where(complete)
    centre = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)]).first()
    x = [c - F.lit(centre[f"m{i}"] or 0.0) for i, c in enumerate(x)]
    sums = rows.agg(F.count("*").alias("n"), *[F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]).first()
    a = np.array([[sums[f"s{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(x))] for i in range(len(x))])
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    a = a / scale[:, None] / scale
    return a[:-1, :-1], a[:-1, -1], sums["n"]


def lasso(gram: np.ndarray, target: np.ndarray, penalty: float, rounds: int = 10_000, close: float = 1e-12) -> np.ndarray:
    """Coefficients of standardised features with the sum of their sizes penalised: coordinate descent on products."""
    w = np.zeros(len(target))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            if gram[j, j] > 0:
                rest = target[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - penalty, 0.0) / gram[j, j]
        if np.abs(w - before).max(initial=0.0) < close:
            break
    return w


def select_l1(df: DataFrame, features: list[str], label: str, penalty: float) -> dict[str, float]:
    """Features that a penalised regression on standardised columns keeps, with their coefficients; two passes whatever the penalty."""
    gram, target, _ = products(df, features, label)
    return {f: float(w) for f, w in zip(features, lasso(gram, target, penalty), strict=True) if w != 0}


def eliminate(df: DataFrame, features: list[str], label: str, keep: int, importance: Callable[[list[str]], dict[str, float]] | None = None) -> list[str]:
    """Drop the least important feature again and again until ``keep`` are left; the rest, most important first.

    Without ``importance``, a function of the features that are left, they are
    judged by the size of their coefficients in a regression on standardised
    columns, which all come from the same products: no pass a step.  Equal ones
    go from the end.
    """
    left = list(features)
    if importance is None:
        gram, target, _ = products(df, features, label)
        place = {f: i for i, f in enumerate(features)}

        def importance(names: list[str]) -> dict[str, float]:
            at = [place[f] for f in names]
            return dict(zip(names, np.abs(np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]).tolist(), strict=True))

    while True:
        worth = importance(left)
        order = sorted(left, key=lambda f: (-round(worth.get(f, 0.0), 12), features.index(f)))
        if len(left) <= keep:
            return order
        left = [f for f in left if f != order[-1]]


def select_by_trees(df: DataFrame, features: list[str], label: str, key: list[str], keep: int, rounds: int = 10, **options) -> list[str]:
    """The ``keep`` features whose cuts gain most in a boosted model."""
    from timberline.operators import boosting, trees

    model = boosting.train(df, features, label, key, rounds=rounds, **options)
    gains = trees.importance(model.trees, "gain")
    return sorted(features, key=lambda f: (-gains.get(f, 0.0), features.index(f)))[:keep]


def first_features(features: list[str], k: int) -> list[str]:
    return features[:k]
