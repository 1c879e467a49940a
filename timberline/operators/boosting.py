"""Gradient boosting: objectives, the loop, ensembles and early stopping."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from timberline.operators import binning, histogram, ordering, trees
from timberline.operators.sampling import sample_features
from timberline.session import materialize, spread

#: Other names of objectives.
OBJECTIVE_NAMES = {"l2": "regression", "mse": "regression", "mean_squared_error": "regression", "rmse": "regression", "regression_l2": "regression", "mean_absolute_error": "l1", "mae": "l1", "regression_l1": "l1", "softmax": "multiclass", "logistic": "binary", "binary_logloss": "binary", "rank": "ranking", "listwise": "ranking", "pinball": "quantile", "mean_absolute_percentage_error": "mape", "rank_ndcg": "lambdarank"}

#: Trees whose scores are one expression; longer ensembles are summed in parts.
TREES_AT_ONCE = 50
#: Parts that the rows of one query are dealt to.
QUERY_PARTS = 16


#: The share of ``quantile``, the width of ``huber`` and the scale of ``fair`` if none is given.
SHAPES = {"quantile": 0.9, "huber": 0.9, "fair": 1.0}


def label_weight(y: Column) -> Column:
    """What an error at ``y`` weighs in the loss ``mape``."""
    return 1 / F.greatest(F.abs(y), F.lit(1.0))


def objective(name: str, y: Column, s: Column, shape: float | None = None) -> tuple[Column, Column]:
    """Gradient and hessian of the loss at raw score ``s``; ``shape`` is the share, width or scale of SHAPES."""
    name = OBJECTIVE_NAMES.get(name, name)
    shape = SHAPES.get(name) if shape is None else shape
    if name == "quantile":
        return F.when(s >= y, 1.0 - shape).otherwise(-shape), F.lit(1.0)
    if name == "huber":
        return F.greatest(F.least(s - y, F.lit(float(shape))), F.lit(-float(shape))), F.lit(1.0)
    if name == "fair":
        far = F.abs(s - y) + shape
        return shape * (s - y) / far, shape * shape / (far * far)
    if name == "mape":
        return F.signum(s - y) * label_weight(y), F.lit(1.0)
    if name == "regression":
        return s - y, F.lit(1.0)
    if name == "l1":
        return F.signum(s - y), F.lit(1.0)
    if name == "binary":
        p = 1 / (1 + F.exp(-s))
        return p - y, F.greatest(p * (1 - p), F.lit(1e-16))
    if name == "poisson":
        return F.exp(s) - y, F.exp(s)
    if name == "gamma":
        return 1 - y * F.exp(-s), y * F.exp(-s)
    if name == "tweedie":
        rho = 1.5
        a, b = F.exp((1 - rho) * s), F.exp((2 - rho) * s)
        return -y * a + b, -y * (1 - rho) * a + (2 - rho) * b
    raise ValueError(f"unknown objective {name}")


def softmax_objective(y: Column, scores: Column, k: int) -> tuple[Column, Column]:
    """Gradient and hessian of class ``k``."""
    from timberline.functions.scalars import softmax

    p = F.element_at(softmax(scores), k + 1)
    return p - (y == k).cast("double"), p * (1 - p)


def ranking_gradients(df: DataFrame, query: str, label: str, score: Column, key: list[str]) -> DataFrame:
    """Append ``g`` and ``h`` of the listwise softmax loss of each query.

    The wanted share of a row is its ``2 ** label - 1`` out of its query's sum,
    its present share the softmax of scores; the gradient is their difference.
    Queries whose rows are all of label 0 have nothing to order and get zeros;
    rows without query, label or score take no part.  A query's rows are dealt
    to ``QUERY_PARTS`` parts by a hash of ``key``, so a hot query is never one
    task; what joins them are two sums a query.
    """
    gain = F.pow(F.lit(2.0), F.col(label)) - 1
    rows = df.withColumn("__score", score.cast("double")).withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(QUERY_PARTS)))
    rows = rows.where(F.col(query).isNotNull() & F.col(label).isNotNull() & F.col("__score").isNotNull())
    parts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(QUERY_PARTS)])).alias("__part")
    top = rows.groupBy(query).agg(F.max("__score").alias("__top"), F.sum(gain).alias("__gain")).select("*", parts)
    placed = rows.join(top, [query, "__part"])
    power = F.exp(F.col("__score") - F.col("__top"))
    total = placed.groupBy(query, "__part").agg(F.sum(power).alias("__t")).groupBy(query).agg(F.sum("__t").alias("__total")).select("*", parts)
    share = power / F.col("__total")
    some = F.col("__gain") > 0
    out = placed.join(total, [query, "__part"])
    out = out.withColumn("g", F.when(some, share - gain / F.col("__gain")).otherwise(0.0)).withColumn("h", F.when(some, share * (1 - share)).otherwise(0.0))
    return out.drop("__score", "__part", "__top", "__gain", "__total")


def renew_leaves(rows: DataFrame, tree: trees.Tree, kind: str, y: Column, s: Column, shape: float | None = None) -> trees.Tree:
    """Give each leaf the output that the loss asks for: the median of its residuals, or what stands for it.

    ``l1``: the median; ``quantile``: the quantile of its share; ``mape``: the
    median weighted by ``label_weight``; ``huber``: the median and the mean
    deviation from it, deviations cut at the width.  Other losses, and leaves
    without rows, keep their outputs.  All leaves are renewed together.
    """
    if kind not in ("l1", "quantile", "mape", "huber"):
        return tree
    shape = SHAPES.get(kind) if shape is None else shape
    held = rows.select(trees.leaf_expression(tree).cast("int").alias("group"), (y - s).alias("value"), (label_weight(y) if kind == "mape" else F.lit(1.0)).alias("weight"))
    new = ordering.grouped_quantiles(held, shape if kind == "quantile" else 0.5, weighted=kind == "mape")
    if kind == "huber" and new:
        middle = F.element_at(F.create_map(*[F.lit(x) for pair in new.items() for x in pair]), F.col("group"))
        off = F.col("value") - middle
        means = held.where("value is not null").groupBy("group").agg(F.avg(F.greatest(F.least(off, F.lit(float(shape))), F.lit(-float(shape)))).alias("m"))
        new = {r["group"]: new[r["group"]] + r["m"] for r in means.collect()}  # a row a leaf
    for leaf, value in new.items():
        tree.nodes[leaf].value = value
    return tree


def start_score(rows: DataFrame, kind: str, y: Column, shape: float | None = None) -> float:
    """The constant that the loss asks for, as a raw score."""
    if kind == "ranking" or kind == "lambdarank":
        return 0.0
    if kind in ("l1", "quantile", "mape"):
        share = (SHAPES["quantile"] if shape is None else shape) if kind == "quantile" else 0.5
        one = rows.select(F.lit(0).alias("group"), y.alias("value"), label_weight(y).alias("weight"))
        return ordering.grouped_quantiles(one, share, weighted=kind == "mape").get(0, 0.0)
    mean = rows.agg(F.avg(y)).first()[0] or 0.0
    if kind == "binary":
        mean = min(max(mean, 1e-12), 1 - 1e-12)
        return math.log(mean / (1 - mean))
    return math.log(max(mean, 1e-12)) if kind in ("poisson", "gamma", "tweedie") else mean


#: Queries of more rows are put in order range by range.
LONG_QUERY = 100_000


def _positions(rows: DataFrame, query: str, key: list[str]) -> DataFrame:
    """Add ``__pos`` from 0 by falling ``__score`` within each query, ties by ``key``; long queries are cut into ranges."""
    order = [F.desc("__score"), *key]
    plain = F.row_number().over(Window.partitionBy(query).orderBy(*order)) - 1
    sizes = rows.groupBy(query).agg(F.count("*").alias("__n")).where(F.col("__n") > LONG_QUERY).select(query)
    long = [r[0] for r in sizes.collect()]  # at most one a LONG_QUERY rows
    if not long:
        return rows.withColumn("__pos", plain)
    short = rows.where(~F.col(query).isin(long)).withColumn("__pos", plain)
    dealt = ordering.with_ranges(rows.where(F.col(query).isin(long)), [query], "__score")
    ends = Window.partitionBy(query).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(query, "__range").agg(F.count("*").alias("__n")).select(query, "__range", F.coalesce(F.sum("__n").over(ends), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(query, "__range").orderBy(*order)) - 1
    far = dealt.withColumn("__own", own).join(F.broadcast(base), [query, "__range"])  # RANGES rows a long query
    return short.unionByName(far.withColumn("__pos", F.col("__base") + F.col("__own")).select(*rows.columns, "__pos"))


def lambdarank_gradients(df: DataFrame, query: str, label: str, score: Column, key: list[str], truncation: int = 30, sigma: float = 1.0) -> DataFrame:
    """Append ``g`` and ``h`` of the pairwise loss weighted by what a swap changes in NDCG.

    A pair of rows of one query with different labels, one of them among the
    first ``truncation`` places by score, draws the better row up and pushes
    the other down by ``sigma / (1 + exp(sigma * (better - worse)))`` times the
    change of NDCG at ``truncation`` if they swapped places.  Every row meets
    only the first places of its query, ``truncation`` of them.  Queries of up to
    LONG_QUERY rows are worked on batch by batch after one shuffle; longer ones
    are dealt to QUERY_PARTS parts, and what rows further down add to the first
    places is summed by place.  So no long query is one task or one array, and the work
    grows with rows times ``truncation``.  Queries without anything to order
    get zeros; rows without query, label or score take no part; equal scores
    are put in order by ``key``.
    """
    rows = df.withColumn("__score", score.cast("double")).withColumn("__gain", F.pow(F.lit(2.0), F.col(label)) - 1)
    rows = rows.where(F.col(query).isNotNull() & F.col(label).isNotNull() & F.col("__score").isNotNull())
    short, long = _by_length(rows, query)
    near = _short_lambdas(short, df.columns, query, key, truncation, sigma)
    return near if long is None else near.unionByName(_long_lambdas(long, df.columns, query, key, truncation, sigma))


def _by_length(rows: DataFrame, query: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows of queries of up to LONG_QUERY rows, and the others if there are any."""
    sizes = rows.groupBy(query).agg(F.count("*").alias("__n")).where(F.col("__n") > LONG_QUERY).select(query)
    long = [r[0] for r in sizes.collect()]  # at most one a LONG_QUERY rows
    return (rows.where(~F.col(query).isin(long)), rows.where(F.col(query).isin(long))) if long else (rows, None)


def _short_lambdas(rows: DataFrame, columns: list[str], query: str, key: list[str], truncation: int, sigma: float) -> DataFrame:
    """The gradients of queries that fit a task each, from one shuffle by query; place by place, for all queries of a batch."""
    kept = [*columns, "g", "h"]
    dealt = rows.repartition(query).sortWithinPartitions(query, F.desc("__score"), *key)
    at = {c: i for i, c in enumerate(dealt.columns)}

    def pulls(batch: pa.Table) -> pa.Table:
        names = batch.column(query).combine_chunks()
        n = batch.num_rows
        first = np.ones(n, dtype=bool)
        first[1:] = pc.not_equal(names.slice(1), names.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(first)
        own = np.cumsum(first) - 1
        sizes = np.diff(np.append(starts, n))
        pos = np.arange(n) - starts[own]
        score, gain = (batch.column(c).to_numpy() for c in ("__score", "__gain"))
        cut = 1 / np.log2(pos + 2.0)
        order = np.lexsort((-gain, own))
        best = np.bincount(own, np.where(pos < truncation, gain[order] * cut, 0.0), len(starts))[own]
        g, h = np.zeros(n), np.zeros(n)
        for t in range(min(truncation, int(sizes.max()))):
            some = np.flatnonzero((sizes[own] > t) & (pos > t) & (best > 0))  # a pair once, at its lower place
            top = starts[own[some]] + t
            worth = gain[some] - gain[top]
            change = np.abs(worth) * np.abs(cut[some] - cut[top]) / best[some]
            with np.errstate(over="ignore"):
                rho = 1 / (1 + np.exp(sigma * np.sign(worth) * (score[some] - score[top])))
            pull, bend = -np.sign(worth) * sigma * rho * change, sigma * sigma * rho * (1 - rho) * change
            g[some] += pull
            h[some] += bend
            g -= np.bincount(top, pull, n)
            h += np.bincount(top, bend, n)
        out = batch.select(columns)
        return out.append_column("g", pa.array(g)).append_column("h", pa.array(h))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(at[query])
            other = np.flatnonzero(pc.not_equal(names.slice(1), names.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)) if batch.num_rows > 1 else np.array([], dtype=int)
            goes_on = bool(left) and left[-1].column(at[query])[-1].as_py() == names[0].as_py()
            if not goes_on and left:
                yield from pulls(pa.Table.from_batches(left)).to_batches()
                left = []
            cut = int(other[-1]) + 1 if len(other) else 0  # the last query may go on in the next batch
            if cut:
                yield from pulls(pa.Table.from_batches([*left, batch.slice(0, cut)])).to_batches()
                left = []
            left.append(batch.slice(cut))
        if left:
            yield from pulls(pa.Table.from_batches(left)).to_batches()

    fields = [rows.schema[c] for c in columns]
    return dealt.mapInArrow(run, T.StructType([*fields, *[T.StructField(c, T.DoubleType()) for c in ("g", "h")]])).select(*kept)


def _long_lambdas(rows: DataFrame, columns: list[str], query: str, key: list[str], truncation: int, sigma: float) -> DataFrame:
    """The gradients of queries that are dealt to parts; see ``lambdarank_gradients``."""
    tops_of, parts = ["__pos", "__score", "__gain", "__cut"], F.explode(F.array(*[F.lit(i).cast("long") for i in range(QUERY_PARTS)])).alias("__part")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64(*key), F.lit(QUERY_PARTS)))
    placed = _positions(rows, query, key).withColumn("__cut", 1 / F.log2(F.col("__pos") + 2.0))
    # the best DCG there is, from how often each gain occurs
    upto = F.lit([float(sum(1 / math.log2(k + 2) for k in range(n))) for n in range(truncation + 1)])
    by_gain = Window.partitionBy(query).orderBy(F.desc("__gain")).rowsBetween(Window.unboundedPreceding, 0)
    grades = rows.groupBy(query, "__gain").agg(F.count("*").alias("__n")).withColumn("__b", F.sum("__n").over(by_gain))
    at = lambda n: F.element_at(upto, (F.least(n, F.lit(truncation)) + 1).cast("int"))
    best = grades.groupBy(query).agg(F.sum(F.col("__gain") * (at(F.col("__b")) - at(F.col("__b") - F.col("__n")))).alias("__best"))
    tops = placed.where(F.col("__pos") < truncation).groupBy(query).agg(F.collect_list(F.struct(*tops_of)).alias("__tops"))  # at most ``truncation`` a query
    tops = tops.join(best, query).select("*", parts)

    def pull(t: Column) -> Column:
        """The row's own gradient and hessian from its pair with place ``t``."""
        change = F.abs(F.col("__gain") - t["__gain"]) * F.abs(F.col("__cut") - t["__cut"]) / F.col("__best")
        better = F.col("__gain") > t["__gain"]
        ahead = F.when(better, F.col("__score") - t["__score"]).otherwise(t["__score"] - F.col("__score"))
        rho = 1 / (1 + F.exp(sigma * ahead))
        pulled = (F.col("__gain") != t["__gain"]) & (F.col("__pos") != t["__pos"]) & (F.col("__best") > 0)
        g = F.when(pulled, F.when(better, -1.0).otherwise(1.0) * sigma * rho * change).otherwise(0.0)
        return F.struct(t["__pos"].alias("pos"), g.alias("g"), F.when(pulled, sigma * sigma * rho * (1 - rho) * change).otherwise(0.0).alias("h"))

    met = placed.join(tops, [query, "__part"]).withColumn("__pulls", F.transform("__tops", pull)).drop("__tops")
    total = lambda k: F.aggregate("__pulls", F.lit(0.0), lambda a, p: a + p[k])
    met = met.withColumn("g", total("g")).withColumn("h", total("h"))
    below = met.where(F.col("__pos") >= truncation).select(query, F.explode("__pulls").alias("p")).where("p.g != 0")
    below = below.groupBy(query, F.col("p.pos").alias("__pos")).agg(F.sum("p.g").alias("__g"), F.sum("p.h").alias("__h"))
    first = met.where(F.col("__pos") < truncation).join(below, [query, "__pos"], "left")
    first = first.withColumn("g", F.col("g") - F.coalesce("__g", F.lit(0.0))).withColumn("h", F.col("h") + F.coalesce("__h", F.lit(0.0)))
    kept = [*columns, "g", "h"]
    return met.where(F.col("__pos") >= truncation).select(*kept).unionByName(first.select(*kept))


@dataclass
class EarlyStop:
    """Training stops after ``patience`` rounds without a gain of ``min_delta``."""

    patience: int = 10
    min_delta: float = 1e-4
    relative: bool = False
    larger_is_better: bool = False
    smooth: int = 1
    history: list[float] = field(default_factory=list)
    best: float | None = None
    best_round: int = -1
    gains: list[float] = field(default_factory=list)  # of each round after the first, over the best before; 0 where there is none

    def update(self, value: float) -> bool:
        """Whether to stop after this round's value."""
        self.history.append(value)
        recent = self.history[-self.smooth :]
        now = sum(recent) / len(recent)
        if self.best is None:
            better = True
        else:
            rise = (now - self.best) * (1 if self.larger_is_better else -1)
            self.gains.append(max(rise, 0.0))
            better = rise > self.min_delta * (abs(self.best) if self.relative else 1.0)
        if better:
            self.best, self.best_round = now, len(self.history) - 1
        return len(self.history) - 1 - self.best_round >= self.patience

    def waited(self) -> int:
        """Rounds since the best one."""
        return len(self.history) - 1 - self.best_round

    def remaining(self) -> int | None:
        """A guess at the rounds to come: what is left of the patience, twice that while the last five rounds gained; null before them."""
        if len(self.gains) < 5:
            return None
        left = max(self.patience - self.waited(), 0)
        return left if sum(self.gains[-5:]) / 5 < self.min_delta / 10 else 2 * left

    def statistics(self) -> dict[str, float]:
        n = len(self.history)
        mean = sum(self.history) / max(n, 1)
        spread = sum((v - mean) ** 2 for v in self.history) / max(n, 1)
        risen = [g for g in self.gains if g > 0]
        return {
            "rounds": n,
            "best": self.best or 0.0,
            "best_round": self.best_round,
            "improvements": len(risen),
            "mean_improvement": sum(risen) / max(len(risen), 1),
            "waited": self.waited(),
            "stability": 1 / (1 + spread) if n > 1 else 0.0,
        }


def combine_stops(stops: list[bool], rule: str = "any", primary: int = 0) -> bool:
    """Several monitors: any, all, more than half, or the primary one."""
    return {"any": any(stops), "all": all(stops), "majority": 2 * sum(stops) > len(stops), "primary": stops[primary]}[rule]


def stop_round(log: DataFrame, metric: str, order: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """``order, best, gap, stop`` of a metric log, smaller is better; windows over the log."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = log.withColumn("best", F.min(metric).over(w))
    prior = F.lag("best").over(Window.orderBy(order))
    improved = best.withColumn("__at", F.when(prior.isNull() | (F.col("best") < prior - min_delta), F.col(order)))
    gap = F.col(order) - F.last("__at", True).over(w)
    return improved.select(order, "best", gap.alias("gap"), (gap >= patience).alias("stop"))


@dataclass
class Ensemble:
    """Trees in order, a start score, and how raw scores become predictions."""

    trees: list[trees.Tree] = field(default_factory=list)
    start: float = 0.0
    objective: str = "regression"
    average: bool = False
    history: list[dict[str, float]] = field(default_factory=list)

    def raw(self, upto: int | None = None) -> Column:
        """The raw score as one expression, of the first ``upto`` trees."""
        used = self.trees[: len(self.trees) if upto is None else upto]
        total = sum((trees.score_expression(t) for t in used), F.lit(self.start))
        return total / max(len(used), 1) if self.average else total

    def predict(self, df: DataFrame, upto: int | None = None, name: str = "prediction") -> DataFrame:
        """Append the prediction; long ensembles go through a written table every TREES_AT_ONCE trees."""
        used = self.trees[: len(self.trees) if upto is None else upto]
        out = df.withColumn("__raw", F.lit(float(self.start)))
        for at in range(0, len(used), TREES_AT_ONCE):
            if at:
                out = materialize(out, "scores")
            out = out.withColumn("__raw", sum((trees.score_expression(t) for t in used[at : at + TREES_AT_ONCE]), F.col("__raw")))
        raw = F.col("__raw") / max(len(used), 1) if self.average else F.col("__raw")
        return out.withColumn(name, self.link(raw)).drop("__raw")

    def link(self, raw: Column) -> Column:
        kind = OBJECTIVE_NAMES.get(self.objective, self.objective)
        if kind == "binary":
            return 1 / (1 + F.exp(-raw))
        return F.exp(raw) if kind in ("poisson", "gamma", "tweedie") else raw

    def leaves(self) -> Column:
        """``array<int>``: the leaf of each tree."""
        return F.array(*[trees.leaf_expression(t) for t in self.trees])

    def prune(self, keep: int) -> Ensemble:
        return Ensemble(self.trees[:keep], self.start, self.objective, self.average, self.history[:keep])

    def to_json(self) -> str:
        return json.dumps({"start": self.start, "objective": self.objective, "average": self.average, "trees": [trees.to_dict(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Ensemble:
        d = json.loads(text)
        return Ensemble([trees.from_dict(t) for t in d["trees"]], d["start"], d["objective"], d["average"])

    def statistics(self) -> dict[str, float]:
        n = max(len(self.trees), 1)
        return {"trees": len(self.trees), "mean_depth": sum(t.depth() for t in self.trees) / n, "mean_leaves": sum(len(t.leaves()) for t in self.trees) / n}


def train(
    df: DataFrame,
    features: list[str],
    label: str,
    key: list[str],
    objective_name: str = "regression",
    rounds: int = 10,
    rate: float = 0.1,
    max_bin: int = 63,
    feature_fraction: float = 1.0,
    bagging: float = 1.0,
    mode: str = "gbdt",
    drop_rate: float = 0.1,
    valid_rows: Column | None = None,
    early_stop: EarlyStop | None = None,
    seed: int = 0,
    categorical: list[str] | None = None,
    query: str | None = None,
    levels: int = 0,
    shape: float | None = None,
    bundle: int | None = None,
    linear: float | None = None,
    **tree_options,
) -> Ensemble:
    """Boost trees over ``df``.

    Rows are binned once and written; each round updates the score column,
    written again every few rounds so that plans stay short.  Where few
    different rows of bins stand for many rows, gradients are summed by them
    first, in one pass a round, and the tree is grown on these sums.  ``valid_rows``
    marks rows that only measure.  ``mode`` may be ``gbdt``, ``rf`` (trees on
    bagged rows, averaged) or ``dart`` (a hash of the round drops earlier trees,
    and new and dropped ones are scaled down).  ``categorical`` names those of
    the features that are split by sets of values, ``query`` the column of lists
    for the objectives ``ranking`` and ``lambdarank``; ``levels`` rounds
    gradients to that many steps (0: not at all); ``shape`` is the share, width
    or scale of ``quantile``, ``huber`` and ``fair``.  Losses whose gradients
    are signs have their leaves renewed from the residuals, see ``renew_leaves``.
    ``bundle`` lets features share a histogram column if at most so many rows
    have both off their commonest bin.  With ``linear`` each leaf is a ridge
    regression, of that penalty, on the features of its path.
    """
    kind = OBJECTIVE_NAMES.get(objective_name, objective_name)
    if kind in ("ranking", "lambdarank") and (query is None or early_stop is not None):
        raise ValueError("ranking needs a query column and has no mean loss to stop by")
    train_row = F.lit(True) if valid_rows is None else ~valid_rows
    named = set(categorical or [])
    mappers = binning.fit_quantile(df.where(train_row), [f for f in features if f not in named], max_bin) if named < set(features) else []
    mappers = [m.with_missing("separate") for m in [*mappers, *(binning.fit_categorical(df.where(train_row), f, max_bin) for f in features if f in named)]]
    ranks = kind in ("ranking", "lambdarank")
    named_rows = key if ranks or bagging < 1.0 or levels else []  # nothing else asks which row it is
    base = df.select(*dict.fromkeys([*named_rows, *features]), F.col(label).cast("double").alias("__y"), train_row.alias("__train"), *([F.col(query).alias("__query")] if query else []))
    rows = materialize(binning.transform(spread(base), mappers), "binned")
    if bundle is not None:
        plan = histogram.find_bundles(rows, {m.feature: m.n_bins + 2 for m in mappers}, bundle)
        if any(len(held) > 1 for held in plan.columns.values()):
            rows, tree_options = histogram.with_bundles(rows, plan), {**tree_options, "bundle": plan}
    dense = histogram.condenses(rows)
    start = start_score(rows.where("__train"), kind, F.col("__y"), shape)
    model = Ensemble(start=0.0 if mode == "rf" else start, objective=kind, average=mode == "rf")
    scored = rows.withColumn("__s", F.lit(float(start)))
    each = sorted(tree_options.get("each") or {})
    if tree_options.get("once"):
        tree_options = {**tree_options, "used": set()}
    if each:
        scored = scored.withColumn("__paid", F.lit(0).cast("long"))
    for k in range(rounds):
        dropped = [i for i in range(len(model.trees)) if mode == "dart" and (hash((seed, k, i)) % 10_000) < drop_rate * 10_000]
        s = F.col("__s") - sum((trees.score_expression(model.trees[i]) for i in dropped), F.lit(0.0))
        own = scored.where("__train")
        if kind == "lambdarank":
            own = lambdarank_gradients(own, "__query", "__y", s, key)
        elif kind == "ranking":
            own = ranking_gradients(own, "__query", "__y", s, key)
        else:
            g, h = objective(kind, F.col("__y"), s, shape)
            own = own.withColumn("g", g).withColumn("h", h)
        if bagging < 1.0:
            own = own.where(F.pmod(F.xxhash64(*key, F.lit(seed * 1000 + k)), F.lit(1_000_000)) < round(bagging * 1_000_000))
        if levels:
            own = histogram.quantised(own, "g", "h", levels, seed + k, key)
            own = own.withColumn("g", F.col("qg") * F.col("scale_g")).withColumn("h", F.col("qh") * F.col("scale_h"))
        chosen = sample_features(features, feature_fraction, seed + k)
        step = 1.0 if mode == "rf" else rate
        if ranks or linear is not None or not dense:
            own = own.cache()
        if dense:  # one pass over the rows, whatever the depth of the tree
            summed = histogram.condensed(own, ["g", "h"], dense, by=["__paid"] if each else []).cache()
            tree = trees.grow(summed, mappers, rate=step, features=chosen, count="__rows", **tree_options)
            summed.unpersist()
        else:
            tree = trees.grow(own, mappers, rate=step, features=chosen, **tree_options)
        if linear is not None:
            tree = trees.fit_linear(own, tree, linear, skip=named)
        tree = renew_leaves(own, tree, kind, F.col("__y"), s, shape)
        own.unpersist()
        if mode == "rf":  # each tree stands for a whole model
            for n in tree.nodes:
                n.value += start
        if dropped:
            share = 1 / (len(dropped) + 1)
            before = sum((trees.score_expression(model.trees[i]) for i in dropped), F.lit(0.0))
            for i in dropped:
                model.trees[i].rate *= len(dropped) * share
            tree.rate *= share
            after = sum((trees.score_expression(model.trees[i]) for i in dropped), F.lit(0.0))
            scored = scored.withColumn("__s", F.col("__s") - before + after)
        model.trees.append(tree)
        if each:  # rows that have asked for a feature do not pay for it again
            bits = {leaf: sum(1 << each.index(f) for f in set(tree.branch(leaf)) & set(each)) for leaf in tree.leaves()}
            asked = F.element_at(F.create_map(*[F.lit(x) for leaf, b in bits.items() for x in (leaf, b)]), trees.leaf_expression(tree))
            scored = scored.withColumn("__paid", F.col("__paid").bitwiseOR(asked.cast("long")))
        if mode != "rf":
            scored = scored.withColumn("__s", F.col("__s") + trees.score_expression(tree))
        if (k + 1) % 4 == 0:
            scored = materialize(scored, "scores")
        if early_stop is not None and valid_rows is not None:
            value = scored.where("not __train").agg(loss(kind, F.col("__y"), F.col("__s"), shape)).first()[0]
            model.history.append({"round": k, "valid": value})
            if early_stop.update(value):
                return model.prune(early_stop.best_round + 1)
    return model


def loss(kind: str, y: Column, s: Column, shape: float | None = None) -> Column:
    """The mean loss that a model is watched by."""
    shape, far = SHAPES.get(kind) if shape is None else shape, F.abs(s - y)
    if kind in ("l1", "mape"):
        return F.avg(far * label_weight(y) if kind == "mape" else far)
    if kind == "quantile":
        return F.avg(F.when(y >= s, shape * far).otherwise((1 - shape) * far))
    if kind == "huber":
        return F.avg(F.when(far <= shape, 0.5 * far * far).otherwise(shape * (far - 0.5 * shape)))
    if kind == "fair":
        return F.avg(shape * far - shape * shape * F.log1p(far / shape))
    if kind == "binary":
        return F.avg(F.log1p(F.exp(-F.abs(s))) + F.greatest(s, F.lit(0.0)) - y * s)
    if kind in ("poisson", "gamma", "tweedie"):
        return F.avg(F.exp(s) - y * s)
    return F.avg((s - y) * (s - y))


def staged_stop(stages: Column, kind: str, threshold: float, period: int) -> Column:
    """Trees used before a row's running score is sure enough.

    ``stages`` is ``array<double>`` of tree outputs, for ``multiclass`` an array
    of such arrays, one number a class.  Every ``period`` trees the margin is
    held against the threshold: ``2 * abs(score)`` (binary) or the largest
    score less the second (multiclass).  Other kinds never stop.
    """
    if kind not in ("binary", "multiclass"):
        return F.size(stages)
    many = kind == "multiclass"
    nothing = F.transform(stages[0], lambda _: F.lit(0.0)) if many else F.lit(0.0)
    start = F.struct(nothing.alias("s"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def margin(s: Column) -> Column:
        if not many:
            return 2 * F.abs(s)
        order = F.sort_array(s, asc=False)
        return F.coalesce(F.get(order, F.lit(0)) - F.get(order, F.lit(1)), F.lit(float("inf")))

    def step(a: Column, x: Column) -> Column:
        s, n = F.zip_with(a["s"], x, lambda p, q: p + q) if many else a["s"] + x, a["n"] + 1
        sure = (n % period == 0) & (margin(s) > threshold)
        return F.when(a["done"], a).otherwise(F.struct(s.alias("s"), n.alias("n"), sure.alias("done")))

    return F.aggregate(stages, start, step, lambda a: a["n"])


@dataclass
class PredictOptions:
    """What ``predict_with`` appends, and of how many trees."""

    trees: int | None = None  # the first so many; None: all
    raw: bool = False
    leaves: bool = False
    contributions: bool = False
    stop_every: int | None = None  # trees between looks at the margin; None: use all
    stop_margin: float = 0.0


def predict_with(df: DataFrame, model: Ensemble, options: PredictOptions, features: list[str] | None = None) -> DataFrame:
    """Append ``prediction`` (``raw``: before the link), and, as asked, ``used`` trees, ``leaves`` and ``shap`` of ``features``.

    Rows whose margin is sure stop early and are scored by the trees seen so
    far.  Missing values follow the trees' default sides.
    """
    chosen = model.prune(len(model.trees) if options.trees is None else options.trees)
    if options.stop_every is None:
        out = chosen.predict(df)
        if options.raw:
            out = out.withColumn("prediction", chosen.raw())
    else:
        stages = F.array(F.lit(0.0), *[trees.score_expression(t) for t in chosen.trees])
        out = df.withColumn("__stages", F.slice(stages, 2, len(chosen.trees)))  # never an empty literal
        out = out.withColumn("used", staged_stop(F.col("__stages"), OBJECTIVE_NAMES.get(chosen.objective, chosen.objective), options.stop_margin, options.stop_every))
        total = F.aggregate(F.slice("__stages", F.lit(1), F.col("used")), F.lit(float(chosen.start)), lambda a, x: a + x)
        score = total / F.greatest("used", F.lit(1)) if chosen.average else total
        out = out.withColumn("prediction", score if options.raw else chosen.link(score)).drop("__stages")
    if options.leaves:
        out = out.withColumn("leaves", chosen.leaves())
    return trees.shap_values(out, chosen.trees, features or []) if options.contributions else out


def confidence_stop(log: Column, threshold: float = 0.9, patience: int = 5, least: int = 10) -> Column:
    """Whether predictions are sure and steady, from ``array<double>`` of confidences by iteration.

    The last ``patience`` of them must average ``threshold``, differ by less
    than one percent from the average of as many before, and vary by less than
    0.001; never before ``least`` iterations or twice the patience.
    """
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / patience
    now, before = F.slice(log, -patience, patience), F.slice(log, -2 * patience, patience)
    spread = F.aggregate(now, F.lit(0.0), lambda a, x: a + (x - mean(now)) * (x - mean(now))) / patience
    steady = F.abs(mean(now) - mean(before)) < 0.01 * F.when(F.abs(mean(before)) > 1e-8, F.abs(mean(before))).otherwise(1.0)
    sure = (mean(now) >= threshold) & steady & (spread < 0.001)
    return F.when(F.size(log) >= max(least, 2 * patience), sure).otherwise(False)


def train_multiclass(df: DataFrame, features: list[str], label: str, key: list[str], classes: int, rounds: int = 10, rate: float = 0.1, max_bin: int = 63, **tree_options) -> list[Ensemble]:
    """One ensemble a class, boosted together on the softmax loss.

    Labels are whole numbers from 0 to ``classes - 1``; other rows take no
    part.  Scores of all classes stand in one array column, written again
    after each round, so plans stay short.
    """
    from timberline.operators.spec import valid

    y = valid(label)
    rows = df.where(y.isNotNull() & (y >= 0) & (y < classes))
    mappers = [m.with_missing("separate") for m in binning.fit_quantile(rows, features, max_bin)]
    base = rows.select(*dict.fromkeys(features), y.cast("int").alias("__y"))
    counts = {r["__y"]: r["n"] for r in base.groupBy("__y").agg(F.count("*").alias("n")).collect()}  # a row a class
    total = max(sum(counts.values()), 1)
    models = [Ensemble(start=math.log(max(counts.get(k, 0), 1e-9) / total), objective="multiclass") for k in range(classes)]
    scored = materialize(binning.transform(spread(base), mappers).withColumn("__s", F.array(*[F.lit(m.start) for m in models])), "binned")
    dense = histogram.condenses(scored)
    slopes = [c for k in range(classes) for c in (f"__g{k}", f"__h{k}")]
    for _ in range(rounds):
        sloped = scored.select("*", *[c.alias(n) for n, c in zip(slopes, (x for k in range(classes) for x in softmax_objective(F.col("__y"), F.col("__s"), k)), strict=True)])
        if dense:  # one pass over the rows for all classes
            sloped = histogram.condensed(sloped, slopes, dense).cache()
        for k, model in enumerate(models):
            own = sloped.withColumn("g", F.col(f"__g{k}")).withColumn("h", F.col(f"__h{k}"))
            model.trees.append(trees.grow(own, mappers, rate=rate, count="__rows" if dense else None, **tree_options))
        if dense:
            sloped.unpersist()
        after = F.array(*[F.col("__s")[k] + trees.score_expression(m.trees[-1]) for k, m in enumerate(models)])
        scored = materialize(scored.withColumn("__s", after), "scores")
    return models


def class_chances(models: list[Ensemble]) -> Column:
    """``array<double>``: the chance of each class."""
    from timberline.functions.scalars import softmax

    return softmax(F.array(*[m.raw() for m in models]))


def rank_importance(values: dict[str, float]) -> list[tuple[str, float, float]]:
    """``(feature, value, share)``, largest first."""
    total = sum(values.values()) or 1.0
    return [(f, v, v / total) for f, v in sorted(values.items(), key=lambda kv: (-kv[1], kv[0]))]


def approximate_contributions(importances: dict[str, float], output: Column, bias: float) -> Column:
    """``array<double>``: the output dealt out by importance shares, the bias last."""
    total = sum(importances.values()) or 1.0
    return F.array(*[(output - bias) * (v / total) for v in importances.values()], F.lit(bias))


def compare(df: DataFrame, models: dict[str, Ensemble], label: str) -> DataFrame:
    """One row of mean squared errors by model name; one pass."""
    return df.agg(*[F.avg((m.link(m.raw()) - F.col(label)) ** 2).alias(n) for n, m in models.items()])


Custom = Callable[[Column, Column], tuple[Column, Column]]

