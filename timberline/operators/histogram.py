"""Gradient/hessian histograms: one aggregation for all leaves and features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def histograms(binned: DataFrame, features: list[str], gradient: str = "g", hessian: str | None = "h", leaf: Column | None = None, prefix: str = "bin_") -> DataFrame:
    """``leaf, feature, bin, sum_g, sum_h, n`` over ``binned`` rows.

    A constant hessian is given as None and counts rows.  Cells are summed in
    the map tasks, so what is shuffled is bounded by leaves x features x bins.
    """
    leaf = F.lit(0) if leaf is None else leaf
    h = F.lit(1.0) if hessian is None else F.col(hessian).cast("double")
    rows = binned.select(leaf.cast("int").alias("leaf"), F.col(gradient).cast("double").alias("g"), h.alias("h"), *[F.col(prefix + f).cast("int").alias(f) for f in features])
    long = rows.unpivot(["leaf", "g", "h"], features, "feature", "bin").where("leaf is not null and bin is not null and bin >= 0")
    return long.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("sum_g"), F.sum("h").alias("sum_h"), F.count("*").alias("n"))


#: Rows are summed by their bins before a tree is grown where these leave fewer than a row in so many.
CONDENSE = 8
#: Summed rows of a task, about.
CONDENSED_ROWS = 100_000


def condenses(binned: DataFrame, prefix: str = "bin_") -> int:
    """In how many parts to hold the sums of rows of equal bins; 0 where these rows are too few to be summed first."""
    bins = [c for c in binned.columns if c.startswith(prefix)]
    row = binned.agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64(*bins)).alias("d")).first()
    return 1 + row["d"] // CONDENSED_ROWS if row["d"] * CONDENSE <= row["n"] else 0


def condensed(binned: DataFrame, sums: list[str], parts: int, prefix: str = "bin_", by: list[str] | None = None) -> DataFrame:
    """One row for all rows of equal bins (and equal ``by``), with the sums of ``sums`` and ``__rows``, their number.

    A tree's histograms are sums over bins, so they are the same of these rows.
    """
    bins = [c for c in binned.columns if c.startswith(prefix)]
    return binned.groupBy(*bins, *(by or [])).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("__rows")).coalesce(parts)


def leaf_histograms(binned: DataFrame, widths: dict[str, int], leaf: Column, leaves: list[int], gradient: str = "g", hessian: str = "h", prefix: str = "bin_", count: Column | None = None) -> DataFrame:
    """The histograms of ``leaves``, summed in the tasks as arrays, without a long form of the rows.

    ``widths`` holds each feature's number of bins.  A task holds three numbers
    a leaf, feature and bin, and these, not rows, are shuffled.  ``count`` says
    how many rows a row stands for (one, if not given).  Rows of other and bins that are null, negative or not below the width, count nowhere.
    """
    names = list(widths)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__{c}")
    stands = (F.lit(1) if count is None else count).cast("double").alias("__count")
    rows = binned.select(leaf.cast("int").alias("leaf"), number(gradient), number(hessian), stands, *[F.coalesce(F.col(prefix + f).cast("int"), F.lit(-1)).alias(f"__b{k}") for k, f in enumerate(names)])
    rows = rows.where(F.col("leaf").isin(leaves))
    order = np.array(sorted(leaves), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {f: np.zeros((3, len(order) * w)) for f, w in widths.items()}
        for batch in batches:
            at, g, h, times = np.searchsorted(order, np.asarray(batch.column(0))), *(np.asarray(batch.column(c)) for c in (1, 2, 3))
            for k, (f, w) in enumerate(widths.items()):
                b = np.asarray(batch.column(4 + k))
                own = (b >= 0) & (b < w)
                cell, some = (at * w + b, slice(None)) if own.all() else ((at * w + b)[own], own)
                for sums, weights in zip(held[f], (g[some], h[some], times[some]), strict=True):
                    sums += np.bincount(cell, weights, len(sums))
        for f, w in widths.items():
            cell = np.flatnonzero(held[f][2])
            g, h, n = held[f][:, cell]
            columns = [pa.array(order[cell // w], pa.int32()), pa.array([f] * len(cell), pa.string()), pa.array(cell % w, pa.int32()), pa.array(g), pa.array(h), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["leaf", "feature", "bin", "sum_g", "sum_h", "n"])

    parts = rows.mapInArrow(run, "leaf int, feature string, bin int, sum_g double, sum_h double, n long")
    return parts.groupBy("leaf", "feature", "bin").agg(F.sum("sum_g").alias("sum_g"), F.sum("sum_h").alias("sum_h"), F.sum("n").alias("n"))


def siblings(parents: DataFrame, lighter: DataFrame, links: list[tuple[int, int, int]]) -> DataFrame:
    """Histograms of the heavier children: those of ``parents`` less those of the ``lighter`` ones.

    ``links`` holds ``(parent, lighter child, heavier child)``.
    """
    named = lambda pairs: F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), F.col("leaf"))
    child = lighter.withColumn("leaf", named([(b, a) for a, b, _ in links])).where(F.col("leaf").isNotNull())
    child = child.select("leaf", "feature", "bin", F.col("sum_g").alias("__g"), F.col("sum_h").alias("__h"), F.col("n").alias("__n"))
    less = lambda c, k: (F.col(c) - F.coalesce(F.col(k), F.lit(0))).alias(c)
    out = parents.join(child, ["leaf", "feature", "bin"], "left")
    out = out.select(named([(a, c) for a, _, c in links]).alias("leaf"), "feature", "bin", less("sum_g", "__g"), less("sum_h", "__h"), less("n", "__n"))
    return out.where((F.col("n") > 0) & F.col("leaf").isNotNull())


def sparse_histograms(cells: DataFrame, rows: DataFrame, defaults: dict[str, int]) -> DataFrame:
    """Histograms of a sparse table ``cells(row_id, feature, bin)`` of all but default bins.

    The default bin is what the listed ones leave of the totals of
    ``rows(row_id, g, h)``.
    """
    listed = cells.join(rows, "row_id").groupBy("feature", "bin").agg(F.sum("g").alias("sum_g"), F.sum("h").alias("sum_h"), F.count("*").alias("n"))
    total = rows.agg(F.sum("g").alias("tg"), F.sum("h").alias("th"), F.count("*").alias("tn"))
    names = cells.sparkSession.createDataFrame(list(defaults.items()), "feature string, bin int")
    held = listed.groupBy("feature").agg(F.sum("sum_g").alias("sg"), F.sum("sum_h").alias("sh"), F.sum("n").alias("sn"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    rest = names.join(held, "feature", "left").crossJoin(F.broadcast(total))
    rest = rest.select("feature", "bin", (F.col("tg") - zero("sg")).alias("sum_g"), (F.col("th") - zero("sh")).alias("sum_h"), (F.col("tn") - zero("sn")).alias("n"))
    return listed.unionByName(rest)


def subtract(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The sibling's histogram: the parent's less the smaller child's."""
    c = child.select("feature", "bin", F.col("sum_g").alias("cg"), F.col("sum_h").alias("ch"), F.col("n").alias("cn"))
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    out = parent.join(c, ["feature", "bin"], "left")
    return out.select("feature", "bin", (F.col("sum_g") - zero("cg")).alias("sum_g"), (F.col("sum_h") - zero("ch")).alias("sum_h"), (F.col("n") - zero("cn")).alias("n"))


def quantised(df: DataFrame, gradient: str, hessian: str, levels: int, seed: int, key: list[str]) -> DataFrame:
    """Gradients and hessians as whole numbers of a scale, rounded up or down by a hash of the key.

    Sums of whole numbers do not depend on their order.  Adds ``qg, qh long``
    and ``scale_g, scale_h``; real sums are ``sum(qg) * scale_g``.
    """
    top = df.agg((F.max(F.abs(gradient)) / (levels / 2)).alias("scale_g"), (F.max(F.abs(hessian)) / levels).alias("scale_h"))
    draw = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    rows = df.crossJoin(F.broadcast(top))
    whole = lambda v, s: F.floor(F.coalesce(F.try_divide(F.col(v), F.col(s)), F.lit(0.0)) + draw).cast("long")
    return rows.withColumn("qg", whole(gradient, "scale_g")).withColumn("qh", whole(hessian, "scale_h"))


def bin_offsets(n_bins: DataFrame) -> DataFrame:
    """``feature, n_bins, offset``: where each feature's bins start in one global numbering."""
    before = Window.orderBy("feature").rowsBetween(Window.unboundedPreceding, -1)
    return n_bins.select("feature", "n_bins", F.coalesce(F.sum("n_bins").over(before), F.lit(0)).cast("long").alias("offset"))


def conflicts(binned: DataFrame, defaults: dict[str, int], prefix: str = "bin_") -> DataFrame:
    """``a, b, n``: rows in which both features of a pair are off their default bin, in one pass."""
    names = list(defaults)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    off = {f: F.col(prefix + f) != k for f, k in defaults.items()}
    one = binned.agg(*[F.count_if(off[a] & off[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("n")) for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*")


@dataclass(frozen=True)
class BundlePlan:
    """Columns that hold several features: ``bundle -> ((feature, first code), ...)``.

    Code 0 stands for the default bin of all of them; bin ``b`` of a feature
    has code ``first + b``.
    """

    columns: dict[str, tuple[tuple[str, int], ...]]
    widths: dict[str, int]
    defaults: dict[str, int]

    def width(self, bundle: str) -> int:
        return 1 + sum(self.widths[f] for f, _ in self.columns[bundle])


def plan_bundles(groups: list[list[str]], widths: dict[str, int], defaults: dict[str, int]) -> BundlePlan:
    """A plan for groups of features, as ``bundles`` finds them; ``widths`` are their numbers of bins."""
    columns = {}
    for k, group in enumerate(groups):
        first, held = 1, []
        for f in group:
            held.append((f, first))
            first += widths[f]
        columns[f"bundle_{k}"] = tuple(held)
    return BundlePlan(columns, widths, defaults)


def find_bundles(binned: DataFrame, widths: dict[str, int], most: int, prefix: str = "bin_") -> BundlePlan:
    """Features that seldom leave their commonest bin together share a column.

    One pass counts bins, one the rows in which both of a pair are off their
    commonest bin; up to ``most`` such rows a bundle are borne, and their
    further features count as being at their default.
    """
    rows = leaf_histograms(binned.withColumn("g", F.lit(0.0)).withColumn("h", F.lit(0.0)), widths, F.lit(0), [0], prefix=prefix)
    common = rows.groupBy("feature").agg(F.max(F.struct("n", (-F.col("bin")).alias("back"))).alias("m")).collect()  # a row a feature
    defaults = {f: 0 for f in widths} | {r["feature"]: -r["m"]["back"] for r in common}
    if len(widths) < 2:
        return plan_bundles([[f] for f in widths], widths, defaults)
    return plan_bundles(bundles(conflicts(binned, defaults, prefix), list(widths), most), widths, defaults)


def with_bundles(binned: DataFrame, plan: BundlePlan, prefix: str = "bin_") -> DataFrame:
    """Append a column of codes for each bundle; the first feature off its default bin gives the code."""
    off = lambda f, first: F.when(F.col(prefix + f) != plan.defaults[f], F.col(prefix + f) + first)
    codes = [F.coalesce(*[off(f, first) for f, first in held], F.lit(0)).cast("int").alias(prefix + name) for name, held in plan.columns.items()]
    return binned.select("*", *codes)


def unbundled(hist: DataFrame, plan: BundlePlan) -> DataFrame:
    """Histograms of features from those of bundles; a default bin is what the other bins leave of the leaf's total."""
    spark = hist.sparkSession
    codes = [(name, first + b, f, b) for name, held in plan.columns.items() for f, first in held for b in range(plan.widths[f]) if b != plan.defaults[f]]
    table = spark.createDataFrame(codes, "bundle string, code int, __f string, __b int")
    at = (F.col("feature") == F.col("bundle")) & (F.col("bin") == F.col("code"))
    listed = hist.join(F.broadcast(table), at).select("leaf", F.col("__f").alias("feature"), F.col("__b").alias("bin"), "sum_g", "sum_h", "n")  # a row a bin
    names = ("sum_g", "sum_h", "n")
    totals = hist.groupBy("leaf", F.col("feature").alias("bundle")).agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    owners = spark.createDataFrame([(name, f, plan.defaults[f]) for name, held in plan.columns.items() for f, _ in held], "bundle string, feature string, bin int")
    held = listed.groupBy("leaf", "feature").agg(*[F.sum(c).alias(f"h_{c}") for c in names])
    rest = totals.join(F.broadcast(owners), "bundle").join(held, ["leaf", "feature"], "left")
    rest = rest.select("leaf", "feature", "bin", *[(F.col(f"t_{c}") - F.coalesce(f"h_{c}", F.lit(0))).alias(c) for c in names])
    return listed.unionByName(rest.where("n > 0"))


def bundles(pair_conflicts: DataFrame, features: list[str], most: int) -> list[list[str]]:
    """Features that may share a column: greedily, each joins the first bundle it fits in."""
    n = {frozenset((r["a"], r["b"])): r["n"] for r in pair_conflicts.collect()}  # pairs of columns
    out: list[list[str]] = []
    for f in features:
        for bundle in out:
            if sum(n.get(frozenset((f, g)), 0) for g in bundle) <= most:
                bundle.append(f)
                break
        else:
            out.append([f])
    return out
