"""Ranks and running sums of large groups, without sorting a group in one task.

A plain window puts each group into one task.  Here a group's order is cut into
ranges at approximate quantiles; sums of whole ranges run over a small table,
and a window is needed only within a range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.operators.spec import valid

RANGES = 64
#: Values that cut a feature's order into ranges, and a large range again.
FENCES, MORE_FENCES = 1024, 64
#: Equal parts that a group's span is cut into in the search for its quantile.
WIDE_CUTS = 4096
#: Rows of a range that are ranked in one task, about.
RANGE_ROWS = 1_000_000


def with_ranges(df: DataFrame, group: list[str], order: str, ranges: int = RANGES) -> DataFrame:
    """Add ``__range``, growing with ``order`` within a group; the number of groups must be small.

    Equal values have one range.  Nulls have range 0.
    """
    cuts = [k / ranges for k in range(1, ranges)]
    bounds = df.groupBy(*group).agg(F.array_distinct(F.percentile_approx(order, cuts, 10 * ranges)).alias("__bounds"))
    if not group:
        found = (bounds.first() or [[]])[0] or []  # one row of at most ``ranges`` values
        if all(isinstance(b, (int, float)) for b in found):
            return df.withColumn("__range", _count_below(F.col(order), sorted(found)))
    joined = df.join(F.broadcast(bounds), group) if group else df.crossJoin(F.broadcast(bounds))  # one small row a group
    return joined.withColumn("__range", F.size(F.filter("__bounds", lambda b: b < F.col(order)))).drop("__bounds")


def _count_below(value: Column, bounds: list[float], first: int = 0) -> Column:
    """How many of the sorted ``bounds`` are below ``value``, by halving; as many as ``first`` for null."""
    if not bounds:
        return F.lit(first)
    at = len(bounds) // 2
    return F.when(value > F.lit(bounds[at]), _count_below(value, bounds[at + 1 :], first + at + 1)).otherwise(_count_below(value, bounds[:at], first))


def running_sums(df: DataFrame, group: list[str], order: str, sums: dict[str, Column], ranges: int = RANGES) -> DataFrame:
    """Add, per name in ``sums``, the sum of its column over the rows before in ``order`` (exclusive).

    ``order`` must be unique within a group; aggregate by it first.
    """
    dealt = with_ranges(df, group, order, ranges)
    for name, column in sums.items():
        dealt = dealt.withColumn(f"__v_{name}", column)
    totals = dealt.groupBy(*group, "__range").agg(*[F.sum(f"__v_{n}").alias(n) for n in sums])
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*group, "__range", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__b_{n}") for n in sums])
    within = Window.partitionBy(*group, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(f"__v_{n}").over(within), F.lit(0)).alias(f"__w_{n}") for n in sums])
    out = out.join(F.broadcast(base), [*group, "__range"])  # `ranges` rows a group
    kept = [c for c in df.columns]
    return out.select(*kept, *[(F.col(f"__b_{n}") + F.col(f"__w_{n}")).alias(n) for n in sums])


def run_starts(df: DataFrame, group: str, order: str, ranges: int = RANGES) -> DataFrame:
    """Add ``__range``, ``__pos`` from 0, and ``__new``: whether the row before in ``order`` has another group.

    ``order`` is a number, date or time.  The last row of each range is carried
    over to the next, so no task sorts all rows.
    """
    dealt = with_ranges(df, [], order, ranges)
    ends = dealt.groupBy("__range").agg(F.count("*").alias("__n"), F.max(F.struct(F.col(order).alias("o"), F.col(group).alias("g"))).alias("__last"))
    by_range = Window.orderBy("__range")  # at most `ranges` rows
    base = F.coalesce(F.sum("__n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = ends.select("__range", base.alias("__base"), F.lag("__last.g").over(by_range).alias("__carry"))
    within = Window.partitionBy("__range").orderBy(order, group)
    rows = dealt.withColumn("__row", F.row_number().over(within)).withColumn("__lag", F.lag(group).over(within))
    rows = rows.join(F.broadcast(carried), "__range")
    before = F.when(F.col("__row") == 1, F.col("__carry")).otherwise(F.col("__lag"))
    new = F.coalesce(F.col(group) != before, F.lit(True))
    return rows.select(*df.columns, "__range", (F.col("__base") + F.col("__row") - 1).alias("__pos"), new.alias("__new"))


def value_counts(cells: DataFrame) -> DataFrame:
    """``feature, value, n, before, total`` of valid cells: counts, and those below, of each distinct value."""
    counts = cells.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))
    ranked = running_sums(counts, ["feature"], "value", {"before": F.col("n")})
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    return ranked.join(F.broadcast(totals), "feature")  # one row a feature


def pick(ranked: DataFrame, positions: DataFrame) -> DataFrame:
    """Values at zero-based ``position`` (columns ``feature, name, position``) of ``value_counts``."""
    hit = (F.col("before") <= F.col("position")) & (F.col("position") < F.col("before") + F.col("n"))
    return ranked.join(F.broadcast(positions), "feature").where(hit).select("feature", "name", "value")


# --- values at exact positions -----------------------------------------------------------------


@dataclass
class Outline:
    """What one pass tells of a feature: its valid rows, its span, about how many values it has, and fences among them."""

    total: int
    lo: float | None
    hi: float | None
    distinct: int
    fences: np.ndarray


def outlines(df: DataFrame, features: list[str], fences: int = FENCES) -> dict[str, Outline]:
    """An outline of each feature, from one aggregation of one row."""
    cuts = F.lit([k / fences for k in range(1, fences)])
    parts = []
    for k, f in enumerate(features):
        v = valid(f)
        parts += [F.count(v).alias(f"n{k}"), F.min(v).alias(f"lo{k}"), F.max(v).alias(f"hi{k}"), F.approx_count_distinct(v).alias(f"d{k}"), F.percentile_approx(v, cuts, F.lit(10 * fences)).alias(f"c{k}")]
    row = df.agg(*parts).first()
    return {f: Outline(row[f"n{k}"], row[f"lo{k}"], row[f"hi{k}"], row[f"d{k}"], np.unique(np.array(row[f"c{k}"] or [], dtype=float))) for k, f in enumerate(features)}


def _range_counts(df: DataFrame, fences: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows between the fences of each feature; a value that is a fence counts below it."""
    names = list(fences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(len(fences[f]) + 1, dtype=np.int64) for f in names]
        for batch in batches:
            for k, f in enumerate(names):
                v = np.asarray(batch.column(k).drop_null())
                held[k] += np.bincount(np.searchsorted(fences[f], v), minlength=len(held[k]))
        for k, n in enumerate(held):
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at), pa.array(n[at])], names=["f", "r", "n"])

    parts = df.select(*[valid(f).alias(f"v{k}") for k, f in enumerate(names)]).mapInArrow(run, "f int, r long, n long")
    out = {f: np.zeros(len(x) + 1, dtype=np.int64) for f, x in fences.items()}
    for r in parts.groupBy("f", "r").agg(F.sum("n").alias("n")).collect():  # a row a range
        out[names[r["f"]]][r["r"]] = r["n"]
    return out


def values_at(df: DataFrame, wanted: dict[str, list[int]], lines: dict[str, Outline]) -> dict[str, dict[int, tuple[float, int, int]]]:
    """``feature -> position -> (value, rows below it, rows of it)`` at zero-based positions among valid cells.

    Rows are only counted, range by range; those of the few ranges that hold a
    wanted position are ranked.  Ranges of more than RANGE_ROWS rows are cut
    again first, unless they are one value.
    """
    wanted = {f: sorted({p for p in ps if 0 <= p < lines[f].total}) for f, ps in wanted.items()}
    fences = {f: lines[f].fences for f, ps in wanted.items() if ps}
    if not fences:
        return {f: {} for f in wanted}
    while True:
        counts = _range_counts(df, fences)
        base = {f: np.concatenate(([0], np.cumsum(n))) for f, n in counts.items()}
        held = {f: np.unique(np.searchsorted(base[f], wanted[f], side="right") - 1) for f in fences}
        large = [(f, int(r)) for f in fences for r in held[f] if counts[f][r] > RANGE_ROWS]
        more = _more_fences(df, fences, large)
        if not more:
            break
        fences = {f: np.union1d(x, more.get(f, [])) for f, x in fences.items()}
    names = list(fences)
    chosen = {f: np.isin(np.arange(len(fences[f]) + 1), held[f]) for f in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, f in enumerate(names):
                v = np.asarray(batch.column(k).drop_null())
                at = np.searchsorted(fences[f], v)
                own = chosen[f][at]
                value, n = np.unique(v[own], return_counts=True)
                r = np.searchsorted(fences[f], value)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), k, dtype=np.int32)), pa.array(r), pa.array(value), pa.array(n)], names=["f", "r", "value", "n"])

    rows = df.select(*[valid(f).alias(f"v{k}") for k, f in enumerate(names)]).mapInArrow(run, "f int, r long, value double, n long")
    rows = rows.groupBy("f", "r", "value").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("f", "r").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0)))
    asked = [(k, int(np.searchsorted(base[f], p, side="right") - 1), p, int(p - base[f][np.searchsorted(base[f], p, side="right") - 1])) for k, f in enumerate(names) for p in wanted[f]]
    spots = df.sparkSession.createDataFrame(asked, "f int, r long, position long, inside long")
    hit = (F.col("below") <= F.col("inside")) & (F.col("inside") < F.col("below") + F.col("n"))
    out: dict[str, dict[int, tuple[float, int, int]]] = {f: {} for f in wanted}
    for x in rows.join(F.broadcast(spots), ["f", "r"]).where(hit).collect():  # a row a wanted position
        f = names[x["f"]]
        out[f][x["position"]] = (x["value"], int(base[f][x["r"]]) + x["below"], x["n"])
    return out


def grouped_quantiles(rows: DataFrame, q: float, weighted: bool = False) -> dict[int, float]:
    """The ``q``-quantile of ``value`` in each ``group`` of ``rows(group, value[, weight])``; groups must be few.

    Without weights the quantile lies at position ``(n - 1) * q``, between two
    neighbours by their distance from it.  With weights it is the least value
    at which the weights reach ``q`` of their sum.  All groups are searched at
    once: a group's span is cut into WIDE_CUTS equal parts, weights are summed
    part by part, and only the part that holds the quantile is cut again, until
    few rows are left to be ranked.  Where equal parts leave most rows in one,
    the next cuts are approximate quantiles.  Rows without group, value or
    weight, or of weight 0, do not count.
    """
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    rows = rows.select("group", valid("value").alias("value"), weight.alias("weight")).where("group is not null and value is not null and weight > 0")
    spark = rows.sparkSession
    first = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("weight").alias("w"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()  # a row a group
    whole = {r["group"]: r["n"] for r in first}
    # each group's wanted share of weight, first and last, and the open range with its rows and the weight below it
    goals = {r["group"]: (q * r["w"],) * 2 if weighted else (math.floor((r["n"] - 1) * q) + 0.5, math.floor((r["n"] - 1) * q) + 1.5) for r in first}
    spans = {r["group"]: (r["lo"], r["hi"], 0.0, r["n"]) for r in first}
    pairs: dict[int, tuple[float, float]] = {}  # the values on both sides of the quantile, once they are known
    uneven: set[int] = set()  # groups that equal parts did not cut well

    def inside(groups: list[int]) -> DataFrame:
        table = spark.createDataFrame([(g, *spans[g][:2]) for g in groups], "group int, __lo double, __hi double")
        return rows.join(F.broadcast(table), "group").where((F.col("value") >= F.col("__lo")) & (F.col("value") <= F.col("__hi")))  # a row a group

    cuts = F.lit([k / MORE_FENCES for k in range(1, MORE_FENCES)])
    while wide := [g for g, (lo, hi, _, n) in spans.items() if g not in pairs and n > RANGE_ROWS and lo < hi]:
        held = inside(wide)
        fenced = [g for g in wide if g in uneven or not math.isfinite(spans[g][1] - spans[g][0])]
        at = F.least(F.floor((F.col("value") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * WIDE_CUTS), F.lit(WIDE_CUTS - 1)).cast("int")
        if fenced:
            fences = held.where(F.col("group").isin(fenced)).groupBy("group").agg(F.array_distinct(F.percentile_approx("value", cuts, F.lit(100 * MORE_FENCES))).alias("__f")).collect()
            table = spark.createDataFrame([(r["group"], r["__f"]) for r in fences], "group int, __f array<double>")
            held = held.join(F.broadcast(table), "group", "left")
            at = F.when(F.col("__f").isNotNull(), F.size(F.filter("__f", lambda c: c < F.col("value")))).otherwise(at)
        sums = held.groupBy("group", at.alias("at")).agg(F.sum("weight").alias("w"), F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).collect()  # a row a part
        for g in wide:
            parts = sorted((s["at"], s["w"], s["n"], s["lo"], s["hi"]) for s in sums if s["group"] == g)
            upto = np.cumsum([spans[g][2], *(p[1] for p in parts)])
            a, b = (min(int(np.searchsorted(upto[1:], goal * (1 - 1e-12))), len(parts) - 1) for goal in goals[g])  # sums may round
            if a != b:  # the last of one part and the first of the next
                pairs[g] = (parts[a][4], parts[b][3])
            if 2 * parts[a][2] > spans[g][3]:
                uneven ^= {g}
            spans[g] = (parts[a][3], parts[a][4], float(upto[a]), parts[a][2])
    for g, (lo, hi, _, _) in spans.items():
        if lo == hi:
            pairs.setdefault(g, (lo, hi))
    left = [g for g in spans if g not in pairs]
    if left:
        order = Window.partitionBy("group").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        values = inside(left).groupBy("group", "value").agg(F.sum("weight").alias("w")).withColumn("upto", F.sum("w").over(order))
        table = spark.createDataFrame([(g, goals[g][0] - spans[g][2], goals[g][1] - spans[g][2]) for g in left], "group int, __a double, __b double")
        # sums of weights may round in the last place
        reach = lambda goal: F.min(F.when(F.col("upto") >= F.col(goal) * (1 - 1e-12), F.col("value")))
        found = values.join(F.broadcast(table), "group").groupBy("group").agg(reach("__a").alias("a"), reach("__b").alias("b"), F.max("value").alias("most"))
        for r in found.collect():  # a row a group
            a = r["most"] if r["a"] is None else r["a"]
            pairs[r["group"]] = (a, a if weighted or r["b"] is None else r["b"])
    out = {}
    for g, (a, b) in pairs.items():
        place = (whole[g] - 1) * q
        out[g] = a if a == b or weighted else a + (b - a) * (place - math.floor(place))
    return out


def _more_fences(df: DataFrame, fences: dict[str, np.ndarray], large: list[tuple[str, int]]) -> dict[str, list[float]]:
    """New fences within ``(feature, range)``; none where a range is one value."""
    if not large:
        return {}
    cuts, parts = F.lit([k / MORE_FENCES for k in range(1, MORE_FENCES)]), []
    for k, (f, r) in enumerate(large):
        inside = F.lit(True)
        if r > 0:
            inside = inside & (valid(f) > float(fences[f][r - 1]))
        if r < len(fences[f]):
            inside = inside & (valid(f) <= float(fences[f][r]))
        parts.append(F.percentile_approx(F.when(inside, valid(f)), cuts, F.lit(100 * MORE_FENCES)).alias(f"c{k}"))
    row = df.agg(*parts).first()
    found: dict[str, list[float]] = {}
    for k, (f, _) in enumerate(large):
        new = np.setdiff1d(np.array(row[f"c{k}"] or [], dtype=float), fences[f])
        if len(new):
            found.setdefault(f, []).extend(new.tolist())
    return found
