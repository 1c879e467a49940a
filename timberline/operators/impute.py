"""Imputation: fitted constants, ordered fills, interpolation, neighbours, random draws."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from timberline.operators.profile import feature_statistics, missing_by_feature, order_statistics
from timberline.operators.spec import valid
from timberline.session import materialize


def fit_constants(df: DataFrame, strategies: dict[str, str | float]) -> dict[str, float]:
    """Fill values per feature: ``mean``, ``median``, ``mode``, ``zero`` or a number; 0 for an empty feature."""
    features = list(strategies)
    fitted: dict[str, float] = {}
    means = [f for f in features if strategies[f] == "mean"]
    orders = [f for f in features if strategies[f] in ("median", "mode")]
    if means:
        fitted |= {r["feature"]: r["mean"] for r in feature_statistics(df, means).collect()}  # a row a feature
    if orders:
        rows = {r["feature"]: r for r in order_statistics(df, orders).collect()}
        fitted |= {f: rows[f][strategies[f]] if f in rows else 0.0 for f in orders}
    for f in features:
        if strategies[f] == "zero":
            fitted[f] = 0.0
        elif not isinstance(strategies[f], str):
            fitted[f] = float(strategies[f])
    return {f: float(fitted.get(f) or 0.0) for f in features}


def fill_constants(df: DataFrame, values: dict[str, float]) -> DataFrame:
    """Replace missing cells by fitted values; a projection."""
    filled = {f: F.coalesce(valid(f), F.lit(v)) for f, v in values.items()}
    return df.select(*[filled[c].alias(c) if c in filled else F.col(f"`{c}`") for c in df.columns])


def missing_indicators(df: DataFrame, features: list[str]) -> DataFrame:
    """Append ``<feature>_missing``, 1.0 or 0.0."""
    return df.select("*", *[valid(f).isNull().cast("double").alias(f"{f}_missing") for f in features])


def drop_sparse_features(df: DataFrame, features: list[str], threshold: float = 0.8) -> list[str]:
    """Features whose share of missing cells is at most ``threshold``."""
    sparse = {r["feature"] for r in missing_by_feature(df, features, threshold).where("is_high").collect()}
    return [f for f in features if f not in sparse]


def drop_missing_rows(df: DataFrame, feature: str) -> DataFrame:
    return df.where(valid(feature).isNotNull())


def _stretches(df: DataFrame, value: str, group: list[str], order: list[str], stretch: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with ``__stretch`` (a coarse, growing part of the order), and each stretch's ends.

    A window then needs only a stretch, and what a stretch takes over from its
    neighbours is found on one row per stretch: a group that holds most rows is
    not one task's work.
    """
    rows = df.withColumn("__value", valid(value)).withColumn("__stretch", stretch)
    within = Window.partitionBy(*group, "__stretch").orderBy(*order)
    rows = rows.withColumn("__pos", F.row_number().over(within))
    known = F.col("__value").isNotNull()
    ends = rows.groupBy(*group, "__stretch").agg(
        F.count("*").alias("__rows"),
        F.max(F.when(known, F.struct("__pos", "__value"))).alias("__last"),
        F.min(F.when(known, F.struct("__pos", "__value"))).alias("__first"),
    )
    over = Window.partitionBy(*group).orderBy("__stretch")
    past, future = over.rowsBetween(Window.unboundedPreceding, -1), over.rowsBetween(1, Window.unboundedFollowing)
    ends = ends.withColumn("__offset", F.coalesce(F.sum("__rows").over(past), F.lit(0)))
    at = lambda end: F.when(F.col(end).isNotNull(), F.struct((F.col("__offset") + F.col(f"{end}.__pos")).alias("p"), F.col(f"{end}.__value").alias("v")))
    ends = ends.withColumn("__a", at("__last")).withColumn("__z", at("__first"))
    ends = ends.select(*group, "__stretch", "__offset", F.last("__a", True).over(past).alias("__before"), F.first("__z", True).over(future).alias("__after"))
    return rows, ends


def neighbours_in_order(df: DataFrame, value: str, group: list[str], order: list[str], stretch: Column) -> DataFrame:
    """Add ``prev_pos, prev, next_pos, next, pos``: the nearest valid values at or before and at or after each row."""
    rows, ends = _stretches(df, value, group, order, stretch)
    rows = rows.join(ends, [*group, "__stretch"])
    w = Window.partitionBy(*group, "__stretch").orderBy("__pos")
    pos = F.col("__offset") + F.col("__pos")
    own = F.when(F.col("__value").isNotNull(), F.struct(pos.alias("p"), F.col("__value").alias("v")))
    rows = rows.withColumn("__own", own)
    prev = F.coalesce(F.last("__own", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("__before"))
    after = F.coalesce(F.first("__own", True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.col("__after"))
    rows = rows.select(*[F.col(f"`{c}`") for c in df.columns], pos.alias("pos"), prev.alias("__p"), after.alias("__n"))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], "pos", F.col("__p.p").alias("prev_pos"), F.col("__p.v").alias("prev"), F.col("__n.p").alias("next_pos"), F.col("__n.v").alias("next"))


def forward_fill(near: DataFrame) -> Column:
    """Over ``neighbours_in_order``: the last valid value, 0 before the first."""
    return F.coalesce(F.col("prev"), F.lit(0.0))


def backward_fill(near: DataFrame) -> Column:
    return F.coalesce(F.col("next"), F.lit(0.0))


def linear_fill(near: DataFrame) -> Column:
    """By row position between the neighbours; the ends hold; 0 where nothing is valid."""
    span = F.col("next_pos") - F.col("prev_pos")
    between = F.col("prev") + (F.col("next") - F.col("prev")) * F.try_divide(F.col("pos") - F.col("prev_pos"), span)
    return F.coalesce(F.when(span > 0, between), F.col("prev"), F.col("next"), F.lit(0.0))


#: Points of a block of the neighbour search, and rows that ask in a task of it, about.
BLOCK_ROWS = 50_000
#: Points of a cell within a block, and rows that are held against a cell at a time.
CELL_ROWS, QUERY_ROWS = 128, 2048
#: Points that the cuts between blocks are placed by, a block; they change the speed, never the result.
CUT_POINTS = 64


class Cells:
    """Points in cells of neighbouring ones: halves by the widest feature, until few are left; each cell has its box."""

    def __init__(self, x: np.ndarray, rows: int):
        self.cut: list[tuple[int, float, int, int] | None] = []  # feature, bound, cell at or below it, cell above
        self.held: list[np.ndarray] = []
        todo = [(np.arange(len(x)), -1, 0)]
        while todo:
            own, above, side = todo.pop()
            at = len(self.cut)
            if above >= 0:
                f, bound, *pair = self.cut[above]
                pair[side] = at
                self.cut[above] = (f, bound, *pair)
            self.cut.append(None)
            self.held.append(own)
            part = x[own]
            spread = part.max(axis=0) - part.min(axis=0) if len(own) > rows else np.zeros(1)
            if not spread.max() > 0:
                continue
            f = int(spread.argmax())
            v = part[:, f]
            bound = np.partition(v, len(v) // 2 - 1)[len(v) // 2 - 1]
            if bound == v.max():
                bound = v[v < bound].max()
            self.cut[at] = (f, float(bound), -1, -1)
            todo += [(own[v > bound], at, 1), (own[v <= bound], at, 0)]
        self.low, self.high = np.full((len(self.cut), x.shape[1]), np.inf), np.full((len(self.cut), x.shape[1]), -np.inf)
        for at, own in enumerate(self.held):
            if len(own):
                self.set_box(at, x[own].min(axis=0), x[own].max(axis=0))

    def set_box(self, at: int, low: np.ndarray, high: np.ndarray) -> None:
        self.low[at], self.high[at] = low, high

    def leaves(self) -> list[int]:
        return [at for at, cut in enumerate(self.cut) if cut is None]

    def cover(self) -> None:
        """Boxes of cut cells from those of their halves."""
        for at in range(len(self.cut) - 1, -1, -1):  # halves come after what they are halves of
            if self.cut[at] is not None:
                pair = list(self.cut[at][2:])
                self.set_box(at, self.low[pair].min(axis=0), self.high[pair].max(axis=0))

    def homes(self, x: np.ndarray) -> np.ndarray:
        """The cell that each row falls in."""
        out, todo = np.zeros(len(x), dtype=np.int64), [(0, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            if self.cut[at] is None:
                out[own] = at
            elif len(own):
                f, bound, below, above = self.cut[at]
                left = x[own, f] <= bound
                todo += [(below, own[left]), (above, own[~left])]
        return out

    def visits(self, x: np.ndarray, far: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """``(cell, rows)`` whose box is no further than the rows' ``far``, which may shrink between two of them."""
        todo = [(0, np.arange(len(x)))]
        while todo:
            at, own = todo.pop()
            off = np.maximum(np.maximum(self.low[at] - x[own], x[own] - self.high[at]), 0.0)
            own = own[(off * off).sum(axis=1) <= far[own] * far[own] * (1 + 1e-9)]  # sums may round
            if not len(own):
                continue
            if self.cut[at] is None:
                yield at, own
            else:
                todo += [(child, own) for child in self.cut[at][2:]]


def _nearest(cells: Cells, points: np.ndarray, values: np.ndarray, x: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances and values of the ``k`` nearest points within ``far`` of each row, equal distances by the smaller value; infinite where there are fewer."""
    d, v = np.full((len(x), k), np.inf), np.full((len(x), k), np.inf)
    far = far.copy()

    def meet(cell: int, rows: np.ndarray) -> None:
        own = cells.held[cell]
        for at in range(0, len(rows), QUERY_ROWS):
            some = rows[at : at + QUERY_ROWS]
            new = np.zeros((len(some), len(own)))
            for c in range(x.shape[1]):
                new += (x[some, c][:, None] - points[own, c][None, :]) ** 2
            new = np.sqrt(new)
            new[~(new <= far[some][:, None])] = np.inf
            hit = np.isfinite(new).any(axis=1)
            some, new = some[hit], new[hit]
            every = np.concatenate([d[some], new], axis=1)
            worth = np.concatenate([v[some], np.broadcast_to(values[own], new.shape)], axis=1)
            line = np.arange(len(some))
            for j in range(k):
                least = every.min(axis=1)
                tied = np.where(every == least[:, None], worth, np.inf)
                best = tied.argmin(axis=1)
                d[some, j], v[some, j] = least, tied[line, best]
                every[line, best] = np.inf
            far[some] = np.minimum(far[some], d[some, k - 1])

    homes = cells.homes(x)
    order = np.argsort(homes, kind="stable")
    ends = np.flatnonzero(np.diff(homes[order])) + 1
    for rows in np.split(order, ends):  # a good bound first
        if len(rows):
            meet(int(homes[rows[0]]), rows)
    for cell, rows in cells.visits(x, far):
        meet(cell, rows[homes[rows] != cell])
    return d, v


def _lists(d: np.ndarray, v: np.ndarray) -> pa.Array:
    """``array<struct<d, v>>`` of what was found."""
    found = np.isfinite(d)
    offsets = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(d[found]), pa.array(v[found])], ["d", "v"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def knn_fill(df: DataFrame, features: list[str], target: str, key: list[str], k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill ``target`` by the inverse-distance mean of its ``k`` nearest complete rows, of all of them.

    Rows of equal features ask once, whatever their ``key``, and of complete
    rows with equal features only the ``k`` of smallest value can be near, so
    no point is held more than ``k`` times.  Points are dealt to blocks of
    neighbouring ones.  A row to fill asks its own block first; the distance of
    its ``k``-th point there bounds the search, and it visits just those other
    blocks whose box is no further.  Within a block the same holds of cells.
    So the work grows with the rows, not with pairs of them, unless features
    are so many that every box is near; a task then still holds one block.
    Equal distances go to the smaller value, distance 0 weighs 1e6, and rows
    that miss another feature, or find no complete row, stay as they are.
    """
    others = [f for f in features if f != target]
    names = [f"__x{i}" for i in range(max(len(others), 1))]
    cells = [valid(f) + 0.0 for f in others] or [F.lit(0.0)]  # -0.0 is 0.0
    whole = sum((valid(f).isNull().cast("int") for f in others), F.lit(0)) == 0
    asks = whole & valid(target).isNull()
    placed = df.select(*[c.alias(n) for c, n in zip(cells, names, strict=True)], valid(target).alias("__v"), whole.alias("__whole")).where("__whole").drop("__whole")
    counts = placed.where("__v is not null").groupBy(*names, "__v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("__n"))
    first = F.row_number().over(Window.partitionBy(*names).orderBy("__v"))
    points = materialize(counts.withColumn("__r", first).where(F.col("__r") <= k).drop("__r"), "points")
    ask = materialize(placed.where("__v is null").select(*names).distinct().withColumn("__id", F.monotonically_increasing_id()), "asked")
    blocks, n = _blocks(points, names, block_rows)
    kept = [valid(target).alias(c) if c == target else F.col(f"`{c}`") for c in df.columns]
    if not n:
        return df.select(*kept)

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(c)) for c in names], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blocks.homes(x).astype(np.int32))], [*batch.schema.names, "__block"])

    located = lambda rows: rows.mapInArrow(homes, T.StructType([*rows.schema.fields, T.StructField("__block", T.IntegerType())]))
    points = materialize(located(points), "points")
    boxes = points.groupBy("__block").agg(*[F.min(c).alias(f"lo{c}") for c in names], *[F.max(c).alias(f"hi{c}") for c in names]).collect()  # a row a block
    blocks.low[:], blocks.high[:], blocks.held = np.inf, -np.inf, []
    for r in boxes:
        blocks.set_box(r["__block"], np.array([r[f"lo{c}"] for c in names]), np.array([r[f"hi{c}"] for c in names]))
    blocks.cover()

    def others_near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.asarray(batch.column(c)) for c in names], axis=1)
            near, home = batch.column("__near"), np.asarray(batch.column("__block"))
            n, flat = np.diff(np.asarray(near.offsets)), np.asarray(near.flatten().field("d"))
            far = np.full(len(x), np.inf)
            full = n == k
            far[full] = flat[np.cumsum(n)[full] - 1]
            for block, rows in blocks.visits(x, far):
                rows = rows[home[rows] != block]
                yield pa.RecordBatch.from_arrays([*[pa.array(x[rows, c]) for c in range(len(names))], batch.column("__id").take(pa.array(rows)), pa.array(np.full(len(rows), block, dtype=np.int32)), pa.array(far[rows])], [*names, "__id", "__block", "__far"])

    typed = ", ".join(f"{c} double" for c in names)
    own = materialize(_visit(points, located(ask).withColumn("__far", F.lit(float("inf"))), names, k), "near")
    more = materialize(own.mapInArrow(others_near, f"{typed}, __id long, __block int, __far double"), "visits")
    found = _visit(points, more, names, k).groupBy("__id").agg(F.flatten(F.collect_list("__near")).alias("__more"))  # at most k a block
    pair = F.slice(F.array_sort(F.concat("__near", F.coalesce("__more", F.expr("array()")))), 1, k)
    weight = lambda p: F.when(p["d"] > 0, 1.0 / F.greatest(p["d"], F.lit(1e-300))).otherwise(1e6)
    total = lambda of: F.aggregate("__near", F.lit(0.0), lambda a, p: a + of(p))
    filled = own.join(found, "__id", "left").withColumn("__near", pair)
    filled = filled.select(*names, F.try_divide(total(lambda p: weight(p) * p["v"]), total(weight)).alias("__filled"))
    gaps = df.where(asks).select("*", *[c.alias(n) for c, n in zip(cells, names, strict=True)]).join(filled, names, "left")
    gaps = gaps.select(*[F.col("__filled").alias(c) if c == target else F.col(f"`{c}`") for c in df.columns])
    return df.where(~asks).select(*kept).unionByName(gaps)


def _blocks(points: DataFrame, names: list[str], block_rows: int) -> tuple[Cells, int]:
    """Cuts of the points into blocks of about ``block_rows``, placed by a few points of each, and how many points there are."""
    n = points.count()
    blocks = max(1, -(-n // block_rows), min(points.sparkSession.sparkContext.defaultParallelism, n // 2000))
    some = points.select(*names).sample(min(1.0, CUT_POINTS * blocks / max(n, 1)), seed=1).collect() if blocks > 1 else []  # CUT_POINTS a block
    return Cells(np.array(some, dtype=float).reshape(-1, len(names)), CUT_POINTS), n


def _visit(points: DataFrame, asks: DataFrame, names: list[str], k: int) -> DataFrame:
    """``asks`` with ``__near``: the ``k`` nearest ``points`` of their ``__block`` within ``__far``.

    A block's rows that ask are dealt to tasks of about BLOCK_ROWS, each with
    the block's points.
    """
    spark = points.sparkSession
    counts = {r["__block"]: r["n"] for r in asks.groupBy("__block").agg(F.count("*").alias("n")).collect()}  # a row a block
    if not counts:
        return asks.select(*names, "__id", "__block").withColumn("__near", F.expr("cast(array() as array<struct<d:double,v:double>>)"))
    plan, tasks = [], 0
    for block, n in sorted(counts.items()):
        shares = -(-n // BLOCK_ROWS)
        plan.append((block, tasks, shares))
        tasks += shares
    table = F.broadcast(spark.createDataFrame(plan, "__block int, __first int, __shares int"))
    held = points.join(table, "__block").withColumn("__task", F.explode(F.sequence(F.col("__first"), F.col("__first") + F.col("__shares") - 1)))
    asked = asks.join(table, "__block").withColumn("__task", (F.col("__first") + F.pmod(F.xxhash64("__id"), F.col("__shares"))).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = held.select("__task", F.lit(0).alias("__kind"), none("long").alias("__id"), "__block", none("double").alias("__far"), "__v", "__n", *names)
    rows = rows.unionByName(asked.select("__task", F.lit(1).alias("__kind"), "__id", "__block", "__far", none("double").alias("__v"), none("int").alias("__n"), *names))
    rows = rows.repartitionById(tasks, F.col("__task")).sortWithinPartitions("__task", "__kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        at = None
        for batch in batches:
            task = np.asarray(batch.column(0))
            ends = [0, *(np.flatnonzero(np.diff(task)) + 1).tolist(), len(task)]
            for a, b in zip(ends, ends[1:], strict=False):
                if b > a and task[a] != at:
                    if held:
                        yield from answer(held)
                    at, held = task[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield from answer(held)

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        point = np.asarray(rows["__kind"]) == 0
        x = np.stack([np.asarray(rows[c]) for c in names], axis=1)
        times = rows["__n"].to_numpy()[point].astype(np.int64)
        places, values = np.repeat(x[point], times, axis=0), np.repeat(rows["__v"].to_numpy()[point], times)
        asked = np.flatnonzero(~point)
        d, v = _nearest(Cells(places, CELL_ROWS), places, values, x[asked], rows["__far"].to_numpy()[asked], k)
        own = rows.select([*names, "__id", "__block"]).take(pa.array(asked)).combine_chunks()
        for at in range(0, len(asked), 10_000):
            part = own.slice(at, 10_000)
            yield pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in part.columns], _lists(d[at : at + 10_000], v[at : at + 10_000])], [*part.column_names, "__near"])

    typed = ", ".join(f"{c} double" for c in names)
    return rows.mapInArrow(run, f"{typed}, __id long, __block int, __near array<struct<d:double,v:double>>")


def random_fill(df: DataFrame, target: str, row_id: Column, seed: int = 0) -> DataFrame:
    """Fill with values drawn from the observed ones; the draw is a hash of the row's id, a whole number, the same on every run.

    Observed values are reduced to their distinct values with counts, and the
    draw picks by cumulative count.  Rows of one id get one value; without any
    observed value cells stay null.
    """
    from timberline.operators.ordering import running_sums
    from timberline.operators.sampling import drawn as hashed

    counts = df.select(valid(target).alias("__v")).where("__v is not null").groupBy("__v").agg(F.count("*").alias("__n"))
    counts = materialize(counts, "observed")
    total = counts.agg(F.sum("__n")).first()[0] or 0
    own = lambda fill: [fill.alias(c) if c == target else F.col(f"`{c}`") for c in df.columns]
    if not total:
        return df.select(*own(valid(target)))
    # only rows without a value are joined; the others, usually most, stay where they are
    full = df.where(valid(target).isNotNull()).select(*own(valid(target)))
    gaps = hashed(hashed(df.where(valid(target).isNull()), row_id, seed, "__high"), row_id, seed + 1, "__low")
    drawn = gaps.withColumn("__draw", (F.col("__high") * (1 << 30) + F.shiftright("__low", 2)) % F.lit(total))
    # draws meet values in a coarse cell of the cumulative count that holds both
    ranked, width = running_sums(counts, [], "__v", {"__below": F.col("__n")}), max(-(-total // 1024), 1)
    last = F.floor((F.col("__below") + F.col("__n") - 1) / width)
    cells = ranked.select("__below", "__n", "__v", F.explode(F.sequence(F.floor(F.col("__below") / width), last)).alias("__cell"))
    drawn = drawn.withColumn("__at", F.floor(F.col("__draw") / width))
    inside = (F.col("__at") == F.col("__cell")) & (F.col("__draw") >= F.col("__below")) & (F.col("__draw") < F.col("__below") + F.col("__n"))
    return full.unionByName(drawn.join(cells, inside).select(*own(F.col("__v"))))
