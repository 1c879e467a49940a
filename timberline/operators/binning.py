"""Discretisation: fitting bin mappers and applying them as expressions."""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.operators.ordering import Outline, outlines, running_sums, values_at
from timberline.operators.spec import long_form, valid
from timberline.session import materialize

#: Values closer to zero than this are zero.
ZERO = 1e-35
#: Columns of about as many values have all of them counted for training-grade bounds; of longer ones those near the
#: ends of bins are looked up, so many rows on both sides of a guess.
COUNTED_VALUES = 100_000
NEAR = 64


@dataclass(frozen=True)
class Mapper:
    """How one feature is cut: a numerical one by upper bounds, a categorical one by a map."""

    feature: str
    kind: str = "numerical"
    bounds: tuple[float, ...] = ()
    categories: dict[int, int] = field(default_factory=dict)
    missing: str = "none"  # none, zero, nan, separate
    default_bin: int = 0
    lowest: float = 0.0
    highest: float = 0.0

    @property
    def n_bins(self) -> int:
        return len(self.bounds) if self.kind == "numerical" else max(self.categories.values(), default=-1) + 1

    def with_missing(self, missing: str) -> Mapper:
        """A separate missing bin stands after all others; other kinds use bin 0."""
        return replace(self, missing=missing, default_bin=self.n_bins if missing == "separate" else 0)


def to_bin(x: Column, m: Mapper) -> Column:
    """The bin of a value: the first bound at or above it, one array expression."""
    if m.kind == "categorical":
        if not m.categories:
            return F.lit(m.default_bin)
        names = F.create_map(*[F.lit(v) for pair in m.categories.items() for v in pair])
        return F.coalesce(F.try_element_at(names, F.when(valid(x).between(-2e9, 2e9), valid(x)).cast("int")), F.lit(m.default_bin))
    v = valid(x)
    bounds = F.array(*[F.lit(float(b)) for b in m.bounds])
    found = F.least(F.size(F.filter(bounds, lambda b: b < v)), F.lit(len(m.bounds) - 1))
    inner = F.when(v <= m.lowest, 0).when(v >= m.highest, len(m.bounds) - 1).otherwise(found)
    return F.when(v.isNull(), m.default_bin).otherwise(inner).cast("int")


def from_bin(b: Column, m: Mapper) -> Column:
    """A value that stands for a bin: the middle of its bounds."""
    if m.kind == "categorical":
        back: dict[int, int] = {}
        for value, k in m.categories.items():
            back.setdefault(k, value)
        return F.element_at(F.create_map(*[F.lit(v) for pair in back.items() for v in pair]), b).cast("double")
    bounds = list(m.bounds)
    middles = [(m.lowest + bounds[0]) / 2] + [((m.lowest if i == 1 else bounds[i - 1]) + bounds[i]) / 2 for i in range(1, len(bounds))]
    return F.array(*[F.lit(x) for x in middles])[b]


def transform(df: DataFrame, mappers: list[Mapper], prefix: str = "bin_") -> DataFrame:
    """Append ``bin_<feature>``; one projection for all features."""
    return df.select("*", *[to_bin(F.col(m.feature), m).alias(prefix + m.feature) for m in mappers])


def keep_filled(cuts: list[tuple[float, int]], least: int, highest: float) -> list[float]:
    """Of ``(bound, rows below it)`` in order, the bounds that leave ``least`` rows since the one kept before."""
    kept, last = [], 0
    for bound, below in cuts:
        if below - last >= max(1, least):
            kept.append(bound)
            last = below
    return kept or [highest]


def fit_quantile(df: DataFrame, features: list[str], max_bins: int = 255, min_data: int = 3) -> list[Mapper]:
    """Distinct values as bounds where they are few, else quantile cuts thinned to ``min_data`` rows a bin.

    Cut ``i`` is the value at position ``round((n - 1) * i / max_bins)``.  The
    driver gets at most ``max_bins`` bounds a feature, and the value counts of
    features that have few values: those with about ``2 * max_bins`` or less
    are counted exactly.
    """
    lines = outlines(df, features)
    few = [f for f in features if 0 < lines[f].distinct <= 2 * max_bins]
    counted: dict[str, list] = {f: [] for f in few}
    if few:
        for r in long_form(df, few).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n")).orderBy("feature", "value").collect():
            counted[r["feature"]].append((r["value"], r["n"]))
    cuts = {f: sorted({math.floor((lines[f].total - 1) * (i / max_bins) + 0.5) for i in range(1, max_bins + 1)}) for f in features if lines[f].total}
    found = values_at(df, {f: cuts[f] for f in cuts if f not in few}, lines)
    out = []
    for f in features:
        line = lines[f]
        if not line.total:
            out.append(Mapper(f, bounds=(0.0,)))
            continue
        if f in few:
            values, n = np.array(counted[f]).T
            before = np.cumsum(n) - n
            if len(values) <= max_bins:
                out.append(Mapper(f, bounds=tuple(values.tolist()), lowest=line.lo, highest=line.hi))
                continue
            at = np.unique(np.searchsorted(before, cuts[f], side="right") - 1)
            rows = [(float(values[k]), int(before[k])) for k in at]
        else:
            rows = sorted({(v, below) for v, below, _ in found[f].values()})
        out.append(Mapper(f, bounds=tuple(keep_filled(rows, min_data, line.hi)), lowest=line.lo, highest=line.hi))
    return out


def fit_uniform(df: DataFrame, features: list[str], max_bins: int = 255) -> list[Mapper]:
    """Bounds of equal width; the last is the largest value."""
    spans = long_form(df, features).groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    out = {}
    for r in spans.collect():
        lo, hi = (r["lo"] or 0.0), (r["hi"] or 0.0)
        bounds = [lo + (hi - lo) * i / max_bins for i in range(1, max_bins)] + [hi]
        out[r["feature"]] = Mapper(r["feature"], bounds=tuple(dict.fromkeys(bounds)) if hi > lo else (hi,), lowest=lo, highest=hi)
    return [out[f] for f in features]


def fit_categorical(df: DataFrame, feature: str, max_bins: int = 255, min_count: int = 1) -> Mapper:
    """The most frequent whole values get bins of their own, ties to the smallest; others share the last."""
    whole = F.when(valid(feature).between(-2e9, 2e9), valid(feature)).cast("int")
    counts = df.select(whole.alias("c")).where("c is not null").groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    top = counts.orderBy(F.desc("n"), "c").limit(max_bins).collect()
    return Mapper(feature, "categorical", categories={r["c"]: k for k, r in enumerate(top)}, default_bin=max(len(top) - 1, 0))


def fit_adaptive(df: DataFrame, feature: str, max_bins: int = 16, min_data: int = 3, target: str | None = None) -> Mapper:
    """Repeatedly cut the part whose best cut lowers the variance most, of the feature or of ``target``.

    Every distinct value is a possible cut.  Sums up to each value are worked
    out once, range by range, and written; a cut then costs one aggregation of
    that table that gives the best cut of the two new parts.  The driver sees
    one row a part.  Rows without value or target do not count; equal gains go
    to the lower value, then to the lower part.
    """
    y = valid(target) if target else valid(feature)
    rows = df.select(valid(feature).alias("value"), y.alias("y")).where("value is not null and y is not null")
    middle = rows.agg(F.avg("y")).first()[0]
    if middle is None:
        return Mapper(feature, bounds=(0.0,))
    off = F.col("y") - F.lit(middle)  # centred, so that squares do not drown the differences
    values = rows.groupBy("value").agg(F.count("*").alias("n"), F.sum(off).alias("s"), F.sum(off * off).alias("q"))
    sums = running_sums(values, [], "value", {"n0": F.col("n").cast("double"), "s0": F.col("s"), "q0": F.col("q")})
    sums = materialize(sums.select("value", *[(F.col(f"{c}0") + F.col(c)).alias(c) for c in "nsq"]), "running")
    whole = sums.agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.max(F.struct("n", "s", "q")).alias("t")).first()

    def best(parts: list[tuple]) -> list[tuple]:
        """``(gain, part, cut, sums up to it)`` of each part ``(low, high, sums below, sums up to its end)`` that can be cut."""
        found = []
        for k, (low, high, below, upto) in enumerate(parts):
            inside = (F.col("value") > low) & (F.col("value") < high) if low is not None else F.col("value") < high
            left = {c: F.col(c) - F.lit(b) for c, b in zip("nsq", below, strict=True)}
            right = {c: F.lit(u) - F.col(c) for c, u in zip("nsq", upto, strict=True)}
            spread = lambda p: p["q"] - p["s"] * p["s"] / p["n"]
            n, s, q = (u - b for u, b in zip(upto, below, strict=True))
            fits = inside & (left["n"] >= min_data) & (right["n"] >= min_data)
            gain = F.lit(q - s * s / n) - spread(left) - spread(right)
            found.append(F.max(F.when(fits, F.struct(gain.alias("gain"), (-F.col("value")).alias("back"), "n", "s", "q"))).alias(f"p{k}"))
        row = sums.agg(*found).first()
        return [(r["gain"], part, -r["back"], (r["n"], r["s"], r["q"])) for k, part in enumerate(parts) if (r := row[f"p{k}"]) is not None]

    zero, end = (0.0, 0.0, 0.0), tuple(whole["t"])
    first = (None, whole["hi"], zero, end)
    done, open_ = [whole["hi"]], best([first])
    while open_ and len(done) < max_bins:
        gain, part, cut, upto = min(open_, key=lambda t: (-t[0], -math.inf if t[1][0] is None else t[1][0]))
        if gain <= 1e-12 * max(end[2], 1e-300):
            break
        open_ = [t for t in open_ if t[1] is not part]
        done.append(cut)
        if len(done) < max_bins:
            open_ += best([(part[0], cut, part[2], upto), (cut, part[1], upto, part[3])])
    return Mapper(feature, bounds=tuple(sorted(done)), lowest=whole["lo"], highest=whole["hi"])


def information_gain(classes_left: list[int], classes_right: list[int]) -> float:
    """Bits of the class that a cut tells, from the class counts on both sides."""
    left, right = np.asarray(classes_left, dtype=float), np.asarray(classes_right, dtype=float)

    def entropy(c: np.ndarray) -> float:
        p = c[c > 0] / max(c.sum(), 1.0)
        return float(-(p * np.log2(p)).sum())

    n = left.sum() + right.sum()
    return entropy(left + right) - (left.sum() * entropy(left) + right.sum() * entropy(right)) / n if n else 0.0


def cut_gains(df: DataFrame, mapper: Mapper, label: str) -> DataFrame:
    """``bin, gain``: the information gain about ``label`` of a cut after each bin; windows over bins and classes.

    Rows with a null label or a missing value take no part.
    """
    rows = df.where(F.col(label).isNotNull() & valid(mapper.feature).isNotNull())
    cells = rows.groupBy(to_bin(F.col(mapper.feature), mapper).alias("bin"), F.col(label).alias("__class")).agg(F.count("*").alias("n"))
    grid = cells.select("bin").distinct().crossJoin(cells.select("__class").distinct())  # bins x classes
    full = grid.join(cells, ["bin", "__class"], "left").na.fill(0, ["n"])
    own = Window.partitionBy("__class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    full = full.select("bin", F.sum("n").over(own).cast("double").alias("l"), F.sum("n").over(Window.partitionBy("__class")).cast("double").alias("a"))
    full = full.withColumn("r", F.col("a") - F.col("l"))
    term = lambda c: F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(c)).otherwise(0.0))
    total = lambda c: F.when(F.sum(c) > 0, F.sum(c) * F.log2(F.sum(c))).otherwise(0.0)
    bits = lambda c: total(c) - term(c)
    return full.groupBy("bin").agg(((bits("a") - bits("l") - bits("r")) / F.sum("a")).alias("gain"))


def choose_strategy(df: DataFrame, features: list[str], max_bins: int = 255) -> DataFrame:
    """``feature, strategy``: ``distinct`` for few values, ``uniform`` where the tails are short, else ``quantile``.

    Tails are short if no value lies more than three deviations from the mean.
    """
    cells = long_form(df, features).groupBy("feature")
    stats = cells.agg(F.count_distinct("value").alias("d"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    short = F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo")) <= 3 * F.col("s")
    return stats.select("feature", F.when(F.col("d") <= max_bins, "distinct").when(short, "uniform").otherwise("quantile").alias("strategy"))


def fit_custom(feature: str, bounds: list[float], lowest: float, highest: float) -> Mapper:
    return Mapper(feature, bounds=tuple(sorted(set(bounds))), lowest=lowest, highest=highest)


def merge(a: Mapper, b: Mapper) -> Mapper:
    """The union of two mappers of one kind."""
    if a.kind != b.kind:
        raise ValueError("mappers differ in kind")
    if a.kind == "categorical":
        both = dict(a.categories)
        for c in b.categories:
            both.setdefault(c, len(both))
        return replace(a, categories=both)
    return replace(a, bounds=tuple(sorted({*a.bounds, *b.bounds})), lowest=min(a.lowest, b.lowest), highest=max(a.highest, b.highest))


def check(m: Mapper) -> None:
    if m.kind == "numerical" and (not m.bounds or any(x >= y for x, y in zip(m.bounds, m.bounds[1:], strict=False))):
        raise ValueError(f"{m.feature}: bounds are not growing")
    if m.kind == "categorical" and any(k < 0 for k in m.categories.values()):
        raise ValueError(f"{m.feature}: negative bin")


def auto_settings(n: int) -> tuple[int, int]:
    """``max_bins, min_data`` for a table of ``n`` rows."""
    bins = 32 if n < 1000 else 64 if n < 10_000 else 128 if n < 100_000 else 255
    return bins, max(3, n // (bins * 100))


def save(mappers: list[Mapper], df: DataFrame, path: str) -> None:
    """Write mappers as a small table."""
    rows = [(m.feature, json.dumps(asdict(m))) for m in mappers]
    df.sparkSession.createDataFrame(rows, "feature string, mapper string").coalesce(1).write.json(path)


def load(df: DataFrame) -> list[Mapper]:
    """Mappers from the rows that ``save`` wrote."""
    out = []
    for r in df.select("mapper").collect():
        m = json.loads(r["mapper"])
        out.append(Mapper(**m | {"bounds": tuple(m["bounds"]), "categories": {int(k): v for k, v in m["categories"].items()}}))
    return sorted(out, key=lambda m: m.feature)


# --- training-grade bounds -------------------------------------------------------------------


def _between(a: float, b: float) -> float:
    """A bound between two neighbouring values, the next double at least."""
    return max(math.nextafter((a + b) / 2, math.inf), math.nextafter(a, math.inf)) if b > a else a


def equal_count_bounds(values: list[float], counts: list[int], max_bin: int, min_data: int) -> list[float]:
    """Bounds of bins with about equally many rows.

    No more values than bins: a bin ends at the first value that gives it
    ``min_data`` rows.  Else ``b`` bins are aimed at, ``max_bin`` or as many as
    ``min_data`` allows.  A value with a ``b``-th of the rows or more is heavy
    and ends its bin; the other bins aim at an equal share of the light rows,
    worked out anew after each of them, and one also ends before a heavy value
    if it holds half of its share.
    """
    if not values:
        return [math.inf]
    n = np.asarray(counts, dtype=np.int64)
    rows = np.concatenate(([0], np.cumsum(n)))
    last = len(values) - 1
    few = len(values) <= max_bin
    bins = len(values) if few else max(1, min(max_bin, int(rows[-1]) // max(min_data, 1)))
    heavy = np.flatnonzero(n >= rows[-1] / bins) if not few else np.zeros(0, dtype=np.int64)
    light = rows - np.concatenate(([0], np.cumsum(np.where(np.isin(np.arange(len(n)), heavy), n, 0))))
    light_bins = bins - len(heavy)

    def share(start: int) -> float:
        return (light[-1] - light[start]) / light_bins if light_bins > 0 else math.inf

    goal = max(min_data, 1) if few else share(0)
    ends, start = [], 0
    while start < last and len(ends) < bins - 1:
        held = rows[start + 1 :] - rows[start]  # rows of a bin that ends at each place
        end = start + int(np.searchsorted(held, goal))
        wall = heavy[np.searchsorted(heavy, start)] if len(heavy) and heavy[-1] >= start else last + 1
        if end >= wall:
            before = wall - 1
            end = before if before >= start and held[before - start] >= max(1.0, goal / 2) else wall
        if end >= last:
            break
        ends.append(int(end))
        start = int(end) + 1
        if end != wall and not few:
            light_bins -= 1
            goal = share(start)
    return [*dict.fromkeys(_between(values[e], values[e + 1]) for e in ends), math.inf]


def _inside(values: np.ndarray, counts: np.ndarray, lo: float, hi: float) -> tuple[list[float], list[int]]:
    """Values above ``lo`` and up to ``hi``, and their counts."""
    own = (values > lo) & (values <= hi)
    return values[own].tolist(), counts[own].tolist()


def zero_bin_bounds(values: list[float], counts: list[int], max_bin: int, min_data: int) -> list[float]:
    """Zero, all within ``ZERO`` of it, has a bin of its own; the negatives get bins by their share of the other rows, the positives the rest."""
    v, n = np.asarray(values, dtype=float), np.asarray(counts, dtype=np.int64)
    below, above = int(n[v < -ZERO].sum()), int(n[v > ZERO].sum())
    negative: list[float] = []
    if below:
        bins = max(1, int(below / (below + above) * (max_bin - 1)))
        negative = [*equal_count_bounds(*_inside(v, n, -math.inf, math.nextafter(-ZERO, -math.inf)), bins, min_data)[:-1], -ZERO]
    room = max_bin - 1 - len(negative)
    if above and room > 0:
        return [*negative, ZERO, *equal_count_bounds(*_inside(v, n, ZERO, math.inf), room, min_data)]
    return [*negative, math.inf]


def _fences(forced: list[float], max_bin: int) -> list[float]:
    return sorted({-ZERO, ZERO}.union(b for b in forced if abs(b) > ZERO))[: max(max_bin - 1, 0)]


def forced_bounds(values: list[float], counts: list[int], max_bin: int, min_data: int, forced: list[float]) -> list[float]:
    """The given bounds and zero's stand; the bins that are left go to the stretches between them by their rows."""
    v, n = np.asarray(values, dtype=float), np.asarray(counts, dtype=np.int64)
    fences = _fences(forced, max_bin)
    free = max_bin - 1 - len(fences)
    chosen = set(fences)
    for lo, hi in zip([-math.inf, *fences], [*fences, math.inf], strict=True):
        own, own_counts = _inside(v, n, lo, hi)
        bins = 1 + round(sum(own_counts) * free / max(int(n.sum()), 1))
        if bins > 1:
            chosen.update(b for b in equal_count_bounds(own, own_counts, bins, min_data) if lo < b < hi)
    return [*sorted(chosen)[: max(max_bin - 1, 0)], math.inf]


def _ends_of_bins(total: int, max_bin: int, min_data: int, heavy: list[tuple[float, int, int]], look: Callable[[int], tuple[float, int, int]]) -> list[tuple[float, int]]:
    """The rule of ``equal_count_bounds`` for many values, by rows: ``(last value, rows up to its end)`` of each bin but the last.

    ``look`` gives ``(value, rows below it, rows of it)`` at a row; ``heavy``
    lists the values that end their bins, in order.
    """
    bins = max(1, min(max_bin, total // max(min_data, 1)))
    starts = [below for _, below, _ in heavy]
    upto = np.concatenate(([0], np.cumsum([n for _, _, n in heavy]))).tolist()
    light_bins = bins - len(heavy)

    def share(row: int) -> float:
        k = bisect.bisect_left(starts, row)
        return ((total - upto[-1]) - (row - upto[k])) / light_bins if light_bins > 0 else math.inf

    goal, row, out = share(0), 0, []
    while row < total and len(out) < bins - 1:
        k = bisect.bisect_left(starts, row)
        wall = heavy[k] if k < len(heavy) else None
        spot = row + max(math.ceil(goal) - 1, 0) if math.isfinite(goal) else total
        if wall is not None and spot >= wall[1]:
            held = wall[1] - row
            if held >= max(1.0, goal / 2):
                end, by_wall = (look(wall[1] - 1)[0], wall[1]), False
            else:
                end, by_wall = (wall[0], wall[1] + wall[2]), True
        elif spot >= total:
            break
        else:
            value, below, n = look(spot)
            end, by_wall = (value, below + n), False
        if end[1] >= total:
            break
        out.append(end)
        row = end[1]
        if not by_wall:
            light_bins -= 1
            goal = share(row)
    return out


class _Lookup:
    """Values known so far of a column that is too long to be held; what is asked for and not known is noted."""

    def __init__(self):
        self.below: list[int] = []
        self.cells: list[tuple[float, int, int]] = []
        self.asked: set[int] = set()

    def add(self, cells: Iterable[tuple[float, int, int]]) -> None:
        self.cells = sorted({*self.cells, *cells}, key=lambda c: c[1])
        self.below = [c[1] for c in self.cells]

    def __call__(self, row: int) -> tuple[float, int, int]:
        k = bisect.bisect_right(self.below, row) - 1
        if k >= 0 and row < self.cells[k][1] + self.cells[k][2]:
            return self.cells[k]
        self.asked.add(row)
        return math.nan, row, 1


def _equal_counts(df: DataFrame, lines: dict[str, Outline], bins: dict[str, int], min_data: int) -> dict[str, list[float]]:
    """``equal_count_bounds`` of each column of ``df`` that ``bins`` names, over all of its rows.

    Columns of about COUNTED_VALUES values or fewer have them counted, and each
    is folded in a task of its own.  Of longer ones only the values where bins
    may end are looked up, again until none is missing: the rows of a bin say
    where the next ends, so a guess is off by a few rows at most, and NEAR
    values on both sides of it are looked up with it.
    """
    out: dict[str, list[float]] = {f: [math.inf] for f in bins}
    short = [f for f in bins if 0 < lines[f].distinct <= COUNTED_VALUES]
    if short:
        counts = long_form(df, short).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("n"))

        def fold(one: pd.DataFrame) -> pd.DataFrame:
            name, own = one["feature"].iloc[0], one.sort_values("value")
            return pd.DataFrame({"feature": [name], "bounds": [equal_count_bounds(own["value"].tolist(), own["n"].tolist(), bins[name], min_data)]})

        out |= {r["feature"]: list(r["bounds"]) for r in counts.groupBy("feature").applyInPandas(fold, "feature string, bounds array<double>").collect()}
    known = {f: _Lookup() for f in bins if lines[f].distinct > COUNTED_VALUES}
    # a heavy value holds one of the rows at every ``total // aimed``
    aimed = {f: max(1, min(bins[f], lines[f].total // max(min_data, 1))) for f in known}
    first = values_at(df, {f: list(range(0, lines[f].total, max(lines[f].total // aimed[f], 1))) for f in known}, lines)
    heavy = {}
    for f in known:
        known[f].add(first[f].values())
        heavy[f] = [c for c in known[f].cells if c[2] >= lines[f].total / aimed[f]]
    open_ = dict(known)
    while open_:
        missing = {}
        for f, look in list(open_.items()):
            look.asked = set()
            ends = _ends_of_bins(lines[f].total, bins[f], min_data, heavy[f], look)
            nexts = [look(row)[0] for _, row in ends]
            if look.asked:
                missing[f] = sorted({p for row in look.asked for p in range(row - NEAR, row + NEAR + 1)})
            else:
                out[f] = [*dict.fromkeys(_between(v, w) for (v, _), w in zip(ends, nexts, strict=True)), math.inf]
                del open_[f]
        for f, cells in values_at(df, missing, lines).items():
            known[f].add(cells.values())
    return out


def fit_training(df: DataFrame, features: list[str], max_bin: int = 255, min_data: int = 3, forced: dict[str, list[float]] | None = None, use_missing: bool = True) -> list[Mapper]:
    """Training-grade mappers over all rows; the driver sees the values at which bins may end.

    Zero has a bin of its own, or the forced bounds and zero's stand; the rest
    of a feature is cut into stretches between those, which get bins by their
    rows, each stretch being a column of its own here.  A feature with missing
    cells keeps one bin for them.
    """
    forced = forced or {}
    cells = long_form(df, features).groupBy("feature")
    whole = {r["feature"]: r for r in cells.agg(F.count("*").alias("n"), F.count("value").alias("valid"), F.max("value").alias("hi")).collect()}
    gaps = {f: use_missing and f in whole and whole[f]["valid"] < whole[f]["n"] for f in features}
    room = {f: max_bin - int(gaps[f]) for f in features}
    stretches: dict[str, list[tuple[float, float]]] = {}
    for f in features:
        fences = _fences(forced[f], room[f]) if f in forced else []
        stretches[f] = list(zip([-math.inf, *fences], [*fences, math.inf], strict=True)) if f in forced else [(-math.inf, math.nextafter(-ZERO, -math.inf)), (ZERO, math.inf)]
    names = {f"{i}_{k}": (f, k) for i, f in enumerate(features) for k in range(len(stretches[f]))}
    parts = []
    for name, (f, k) in names.items():
        v, (lo, hi) = valid(f), stretches[f][k]
        parts.append(F.when((v > lo if lo > -math.inf else F.lit(True)) & (v <= hi if hi < math.inf else F.lit(True)), v).alias(name))
    rows = df.select(*parts)
    lines = outlines(rows, list(names))
    size = {place: lines[name].total for name, place in names.items()}
    name_of = {place: name for name, place in names.items()}

    def ask(bins: dict[tuple[str, int], int]) -> dict[tuple[str, int], list[float]]:
        found = _equal_counts(rows, lines, {name_of[place]: n for place, n in bins.items() if size[place]}, min_data)
        return {names[name]: bounds for name, bounds in found.items()}

    first: dict[tuple[str, int], int] = {}
    for f in features:
        if f in forced:
            free = room[f] - 1 - (len(stretches[f]) - 1)
            each = {(f, k): 1 + round(size[f, k] * free / max(whole[f]["valid"], 1)) for k in range(len(stretches[f]))}
            first |= {place: n for place, n in each.items() if n > 1}
        elif size[f, 0]:
            first[f, 0] = max(1, int(size[f, 0] / (size[f, 0] + size[f, 1]) * (room[f] - 1)))
    found = ask(first)
    # what the bins of the negatives leave is for the positives
    negative = {f: [*found[f, 0][:-1], -ZERO] if (f, 0) in found else [] for f in features if f not in forced}
    second = {(f, 1): room[f] - 1 - len(negative[f]) for f in negative if size[f, 1]}
    positive = ask({place: n for place, n in second.items() if n > 0})
    out = []
    for f in features:
        if f in forced:
            fences = [hi for _, hi in stretches[f][:-1]]
            inner = {b for k, (lo, hi) in enumerate(stretches[f]) for b in found.get((f, k), []) if lo < b < hi}
            bounds = [*sorted({*fences, *inner})[: max(room[f] - 1, 0)], math.inf]
        else:
            bounds = [*negative[f], ZERO, *positive[f, 1]] if (f, 1) in positive else [*negative[f], math.inf]
        hi = whole[f]["hi"] if f in whole and whole[f]["hi"] is not None else 0.0
        top = bounds[-2] if len(bounds) > 1 else hi
        m = Mapper(f, bounds=tuple(bounds), lowest=-math.inf, highest=math.nextafter(max(top, hi), math.inf))
        out.append(m.with_missing("separate") if gaps[f] else m)
    return out


def fit_training_categorical(df: DataFrame, feature: str, max_bin: int = 255, min_data: int = 3) -> Mapper:
    """Bin 0 for missing and negative values; then by falling count until 99 % of the rows are covered."""
    whole = F.when(valid(feature).between(-2e9, 2e9), valid(feature)).cast("int")
    counts = df.select(whole.alias("c")).where("c >= 0").groupBy("c").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    categories, covered = {}, 0
    for r in counts.orderBy(F.desc("n"), "c").limit(max_bin - 1).collect():
        if covered >= 0.99 * total or (r["n"] < min_data and len(categories) >= 2):
            break
        categories[r["c"]] = len(categories) + 1
        covered += r["n"]
    return Mapper(feature, "categorical", categories=categories, default_bin=0, missing="nan")


def usable_features(df: DataFrame, mappers: list[Mapper], least: int) -> list[Mapper]:
    """Mappers with a cut that leaves ``least`` rows on both sides."""
    binned = transform(df, mappers)
    long = binned.select(*[F.col("bin_" + m.feature).cast("double").alias(m.feature) for m in mappers])
    counts = long_form(long, [m.feature for m in mappers]).groupBy("feature", "value").agg(F.count("*").alias("n"))
    rows = counts.orderBy("feature", "value").collect()  # at most max_bin rows a feature
    keep = []
    for m in mappers:
        n = [r["n"] for r in rows if r["feature"] == m.feature]
        below = np.cumsum(n)
        if any(b >= least and below[-1] - b >= least for b in below[:-1]):
            keep.append(m)
    return keep


def most_frequent_bin(df: DataFrame, mapper: Mapper, share: float = 0.8) -> tuple[int, float]:
    """``(bin, rate)``: the commonest bin, or zero's bin where none is common enough, and its share."""
    binned = df.groupBy(to_bin(F.col(mapper.feature), mapper).alias("b")).agg(F.count("*").alias("n"))
    rows = {r["b"]: r["n"] for r in binned.collect()}
    total = max(sum(rows.values()), 1)
    best = min(rows, key=lambda b: (-rows[b], b), default=0)
    if rows.get(best, 0) / total < share and mapper.kind == "numerical":
        best = int(min(np.searchsorted(np.array(mapper.bounds), 0.0), len(mapper.bounds) - 1))
    return best, rows.get(best, 0) / total


def iterate_bounds(mappers: list[Mapper]) -> Iterator[tuple[str, int, float]]:
    for m in mappers:
        for k, b in enumerate(m.bounds):
            yield m.feature, k, b


def bounds_table(df: DataFrame, mappers: list[Mapper]) -> DataFrame:
    """``feature, bin, upper`` of numerical mappers."""
    return df.sparkSession.createDataFrame(list(iterate_bounds(mappers)), "feature string, bin int, upper double")


