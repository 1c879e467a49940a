"""Regression metrics: each a column aggregate, so that any set of them is one pass."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.spec import ratio

EPS = 1e-12
#: Stands for the median among shares of an order.
MIDDLE = None


def mean(x: Column, w: Column | None = None) -> Column:
    """Weighted mean of the rows where ``x`` is not null; null without any."""
    if w is None:
        return F.avg(x)
    return F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))


def mse(p, y, w=None):
    return mean((p - y) * (p - y), w)


def rmse(p, y, w=None):
    return F.sqrt(mse(p, y, w))


def mae(p, y, w=None):
    return mean(F.abs(p - y), w)


def mape(p, y, w=None, zero_rows_count: bool = False):
    """In percent; zero targets are left out, or count as rows without error."""
    term = F.when(F.abs(y) > EPS, F.abs(F.try_divide(p - y, y)))
    return 100 * F.coalesce(mean(F.coalesce(term, F.lit(0.0)) if zero_rows_count else term, w), F.lit(0.0))


def smape(p, y, w=None):
    scale = (F.abs(p) + F.abs(y)) / 2
    return 100 * mean(F.when(scale > EPS, F.abs(p - y) / scale).otherwise(0.0), w)


def msle(p, y, w=None):
    both = (p > 0) & (y > 0)
    d = F.ln(F.when(both, p)) - F.ln(F.when(both, y))
    return mean(d * d, w)


def rmsle(p, y, w=None):
    return F.sqrt(msle(p, y, w))


def r2(p, y, w=None):
    """1 less the residual share of the variance; 0 for a constant target."""
    total = F.var_pop(y) if w is None else mean(y * y, w) - mean(y, w) * mean(y, w)
    return F.when(total > EPS, 1 - F.try_divide(mse(p, y, w), total)).otherwise(0.0)


def explained_variance(p, y, w=None):
    return r2(p, y, w)


def mean_bias_error(p, y, w=None):
    return mean(p - y, w)


def mean_percentage_error(p, y, w=None):
    return 100 * mean(F.when(F.abs(y) > EPS, F.try_divide(p - y, y)), w)


def normalised_rmse(p, y, w=None):
    return F.try_divide(rmse(p, y, w), F.max(y) - F.min(y))


def median_absolute_error(p, y, w=None):
    return F.median(F.abs(p - y))


def gamma_deviance(p, y, w=None):
    ok = (p > 0) & (y > 0)
    a, b = F.when(ok, p), F.when(ok, y)
    return mean(2 * (b / a - F.ln(b) + F.ln(a) - 1), w)


def poisson_deviance(p, y, w=None):
    ok = (p > 0) & (y >= 0)
    a, b = F.when(ok, p), F.when(ok, y)
    log = F.when(b > 0, b * F.ln(F.try_divide(F.when(b > 0, b), a))).otherwise(F.when(ok, 0.0))
    return mean(2 * (log - b + a), w)


def tweedie_deviance(p, y, w=None, power: float = 1.5):
    """The published unit deviance; powers 1 and 2 are Poisson and gamma."""
    if not 1 <= power <= 2:
        raise ValueError("power must lie between 1 and 2")
    if power == 1:
        return poisson_deviance(p, y, w)
    if power == 2:
        return gamma_deviance(p, y, w)
    ok = (p > 0) & (y >= 0)
    a, b = F.when(ok, p), F.when(ok, y)
    unit = F.pow(b, F.lit(2 - power)) / ((1 - power) * (2 - power)) - b * F.pow(a, F.lit(1 - power)) / (1 - power) + F.pow(a, F.lit(2 - power)) / (2 - power)
    return mean(2 * unit, w)


def pinball(p, y, w=None, alpha: float = 0.5):
    return mean(F.when(y >= p, alpha * (y - p)).otherwise((1 - alpha) * (p - y)), w)


#: Metrics by name, for reports and custom registries.
METRICS: dict[str, Callable[..., Column]] = {
    f.__name__: f
    for f in (mse, rmse, mae, mape, smape, msle, rmsle, r2, explained_variance, mean_bias_error, mean_percentage_error, normalised_rmse, gamma_deviance, poisson_deviance, tweedie_deviance, pinball)
}


def register(name: str, metric: Callable[..., Column]) -> None:
    METRICS[name] = metric


def custom(name: str, p: Column, y: Column) -> Column:
    """A registered metric, or 0 for an unknown name."""
    return METRICS[name](p, y) if name in METRICS else F.lit(0.0)


def report(df: DataFrame, p: Column, y: Column, w: Column | None = None, names: list[str] | None = None) -> DataFrame:
    """One row with the named metrics; one pass."""
    return df.agg(*[METRICS[n](p, y, w).alias(n) for n in (names or list(METRICS))])


def _at(df: DataFrame, y: Column, shares: list[float | None]) -> list[float | None]:
    """The valid values of ``y`` at positions ``floor((n - 1) * share)`` of their order, for 0.5 the mean of the middle pair."""
    from timberline.operators.ordering import outlines, values_at

    rows = df.select(y.cast("double").alias("y"))
    lines = outlines(rows, ["y"])
    n = lines["y"].total
    if not n:
        return [None] * len(shares)
    spots = [((n - 1) // 2, n // 2) if q is MIDDLE else (math.floor((n - 1) * q),) * 2 for q in shares]
    at = values_at(rows, {"y": [p for pair in spots for p in pair]}, lines)["y"]
    return [(at[a][0] + at[b][0]) / 2 if a != b else at[a][0] for a, b in spots]


def _constant(value: float | None) -> Column:
    return F.lit(value).cast("double")


def _d2_absolute_error(p: Column, y: Column, middle: Column) -> Column:
    return (1 - ratio(F.avg(F.abs(p - y)), F.avg(F.abs(middle - y)), 1.0)).alias("d2_absolute_error")


def _d2_pinball(p: Column, y: Column, base: Column, alpha: float) -> Column:
    return (1 - ratio(pinball(p, y, None, alpha), pinball(base, y, None, alpha), 1.0)).alias("d2_pinball")


def _d2_tweedie(p: Column, y: Column, mean_y: Column, power: float) -> Column:
    return (1 - ratio(tweedie_deviance(p, y, None, power), tweedie_deviance(mean_y, y, None, power), 1.0)).alias("d2_tweedie")


def d2_absolute_error(df: DataFrame, p: Column, y: Column) -> DataFrame:
    """1 less the mean absolute error over that of the median."""
    return df.agg(_d2_absolute_error(p, y, _constant(_at(df, y, [MIDDLE])[0])))


def d2_pinball(df: DataFrame, p: Column, y: Column, alpha: float = 0.5) -> DataFrame:
    """Against the constant at position ``floor((n - 1) * alpha)`` of the sorted targets."""
    return df.agg(_d2_pinball(p, y, _constant(_at(df, y, [alpha])[0]), alpha))


def d2_tweedie(df: DataFrame, p: Column, y: Column, power: float = 1.5) -> DataFrame:
    return df.agg(_d2_tweedie(p, y, _constant(df.agg(F.avg(y)).first()[0]), power))


def d2_scores(df: DataFrame, p: Column, y: Column, alpha: float = 0.5, power: float = 1.5) -> DataFrame:
    """All three in one row, from one search for both positions and one pass of sums."""
    middle, base = _at(df, y, [MIDDLE, alpha])
    mean_y = _constant(df.agg(F.avg(y)).first()[0])
    return df.agg(_d2_absolute_error(p, y, _constant(middle)), _d2_pinball(p, y, _constant(base), alpha), _d2_tweedie(p, y, mean_y, power))


def median_absolute_errors(df: DataFrame, p: Column, y: Column, group: str) -> DataFrame:
    """``group, median_absolute_error``: the median of each group's errors without a list of them; groups must be few."""
    from timberline.operators.ordering import grouped_quantiles

    groups = [r[0] for r in df.select(group).distinct().collect()]  # a row a group
    table = df.sparkSession.createDataFrame(list(enumerate(groups)), f"__group int, {group} {df.schema[group].dataType.simpleString()}")
    rows = df.select(F.col(group), F.abs(p - y).alias("value")).join(F.broadcast(table.withColumnRenamed(group, "__name")), F.col(group).eqNullSafe(F.col("__name")))
    found = grouped_quantiles(rows.select(F.col("__group").alias("group"), "value"), 0.5)
    return df.sparkSession.createDataFrame([(g, found.get(k)) for k, g in enumerate(groups)], f"{group} {df.schema[group].dataType.simpleString()}, median_absolute_error double")


def lag_metrics(df: DataFrame, p: Column, y: Column, group: list[str], order: list[str], stretch: Column) -> DataFrame:
    """Metrics against the last target before: ``mase, msse, theil_u, directional_accuracy`` of each group.

    The order is cut into stretches, so a long group is not one task's work.
    """
    from pyspark.sql.window import Window

    rows = df.withColumn("__p", p.cast("double")).withColumn("__y", y.cast("double")).withColumn("__stretch", stretch)
    ends = rows.groupBy(*group, "__stretch").agg(F.max(F.struct(*order, "__p", "__y")).alias("__last"))
    carried = ends.select(*group, "__stretch", F.lag("__last").over(Window.partitionBy(*group).orderBy("__stretch")).alias("__carry"))
    w = Window.partitionBy(*group, "__stretch").orderBy(*order)
    rows = rows.join(carried, [*group, "__stretch"])
    before = lambda c: F.coalesce(F.lag(c).over(w), F.col(f"__carry.{c}"))
    rows = rows.withColumn("__y0", before("__y")).withColumn("__p0", before("__p"))
    known = F.col("__y0").isNotNull()
    naive = F.when(known, F.col("__y") - F.col("__y0"))
    hit = F.when(known, (naive * (F.col("__p") - F.col("__p0")) > 0).cast("double"))
    err = F.col("__p") - F.col("__y")
    return rows.groupBy(*group).agg(
        F.try_divide(F.avg(F.abs(err)), F.avg(F.abs(naive))).alias("mase"),
        F.try_divide(F.avg(err * err), F.avg(naive * naive)).alias("msse"),
        F.try_divide(F.sqrt(F.avg(F.when(known, err * err))), F.sqrt(F.avg(naive * naive))).alias("theil_u"),
        F.avg(hit).alias("directional_accuracy"),
    )


def bootstrap(df: DataFrame, row_id: Column, metrics: dict[str, Callable[[Column], Column]], draws: int = 100, level: float = 0.95, seed: int = 0) -> DataFrame:
    """``metric, low, high``: bounds of weighted metrics over resamples of the rows with replacement.

    A metric takes a column of row weights and gives an aggregate; rows are
    weighed anew for each draw by a hash of ``row_id``.  What is shuffled are
    sums by draw.  The bounds are the draws at the outer shares of their order;
    null over an empty table.
    """
    from timberline.operators.sampling import resamples

    w = F.col("weight")
    values = resamples(df, row_id, draws, seed).groupBy("draw").agg(*[f(w).cast("double").alias(name) for name, f in metrics.items()])
    ordered = values.agg(*[F.array_sort(F.collect_list(name)).alias(name) for name in metrics])  # `draws` numbers a metric
    n = F.size("values")
    at = lambda q: F.get("values", F.least(n - 1, F.floor(n * q).cast("int")))
    rows = ordered.unpivot([], list(metrics), "metric", "values")
    return rows.select("metric", at((1 - level) / 2).alias("low"), at((1 + level) / 2).alias("high"))
