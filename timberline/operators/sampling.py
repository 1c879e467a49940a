"""Row and column sampling, splitting and subsets."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The generator of the 32-bit linear congruential sequence.
LCG_A, LCG_C = 214013, 2531011

#: Factors of the hash that resampling takes its numbers from.
MIXER, DRAW_STEP = 73244475, 2654435761

BUCKETS = 256


def numbered(df: DataFrame, order: Column, name: str = "row_number") -> DataFrame:
    """Add the row's number from 0 in ``order``, hashed ties aside, without one task sorting all.

    ``order`` must be a number; rows are dealt to buckets by its approximate
    quantiles, and numbered within a bucket.
    """
    from timberline.operators.ordering import with_ranges

    keyed = df.withColumn("__order", order.cast("double"))
    dealt = with_ranges(keyed, [], "__order", BUCKETS)
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))  # BUCKETS rows
    within = Window.partitionBy("__range").orderBy("__order", *[F.col(f"`{c}`") for c in df.columns])
    out = dealt.withColumn("__row", F.row_number().over(within)).join(F.broadcast(base), "__range")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__base") + F.col("__row") - 1).cast("long").alias(name))


def train_valid_split(df: DataFrame, order: Column, ratio: float) -> DataFrame:
    """Add ``is_train``: exactly the first ``floor(n * ratio)`` rows in ``order``."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    rows = numbered(df, order, "__number")
    total = df.agg(F.floor(F.count("*") * ratio).alias("__limit"))
    return rows.crossJoin(F.broadcast(total)).withColumn("is_train", F.col("__number") < F.col("__limit")).drop("__number", "__limit")


def take_rows(df: DataFrame, row_id: str, positions: DataFrame) -> DataFrame:
    """Rows named by ``positions(pos, row_id)``, repeats allowed, with their ``pos``."""
    return positions.join(df, row_id)


def lcg_state(state: Column) -> Column:
    """The next state, modulo 2**32."""
    return F.pmod(state.cast("long") * LCG_A + LCG_C, F.lit(1 << 32))


def lcg_uniform(row_id: Column, seed: int) -> Column:
    """A uniform number in [0, 1) from a row's id: one step from ``seed + id``, bits 16 to 30."""
    state = lcg_state(F.pmod(row_id.cast("long") + seed, F.lit(1 << 32)))
    return (F.shiftright(state, 16).bitwiseAND(F.lit(0x7FFF))) / F.lit(32768.0)


def lcg_sample(n: int, k: int, seed: int) -> list[int]:
    """An ordered sample of ``k`` positions below ``n``, for driver-side choices of columns."""
    if k >= n:
        return list(range(n))
    state, out = seed & 0xFFFFFFFF, []
    for i in range(n):
        state = (state * LCG_A + LCG_C) & 0xFFFFFFFF
        if ((state >> 16) & 0x7FFF) / 32768.0 * (n - i) < k - len(out):
            out.append(i)
    return out


def sample_features(features: list[str], fraction: float, seed: int = 0) -> list[str]:
    """Columns for one tree: ``max(round(n * fraction), min(1, n))`` of them, in their order."""
    k = max(round(len(features) * fraction), min(1, len(features)))
    return [features[i] for i in sorted(random.Random(seed).sample(range(len(features)), k))]


def allowed_features(features: list[str], branch: set[str], constraints: list[set[str]]) -> list[str]:
    """Features a node may split on: the branch's own, and constraint sets that hold the whole branch."""
    if not constraints:
        return list(features)
    allowed = set(branch)
    for group in constraints:
        if branch <= group:
            allowed |= group
    return [f for f in features if f in allowed]


def mixed(df: DataFrame, name: str) -> DataFrame:
    """Replace a column of whole numbers by well-mixed ones below 2**32, in plain arithmetic that any engine can repeat."""
    x = F.col(name)
    for _ in range(2):
        df = df.withColumn(name, ((x.bitwiseXOR(F.shiftright(x, 16))) * MIXER).bitwiseAND(F.lit(0xFFFFFFFF)))
    return df.withColumn(name, x.bitwiseXOR(F.shiftright(x, 16)))


def resamples(df: DataFrame, row_id: Column, draws: int, seed: int = 0) -> DataFrame:
    """Each row once per draw, with ``draw`` and ``weight``: how often a resample with replacement holds it.

    Weights are Poisson(1) numbers from a hash of ``row_id``, a whole number
    (null counts as 0), and the draw.  Rows are multiplied within their task,
    to be summed by draw before any shuffle.
    """
    rows = df.withColumn("__mix", F.coalesce(row_id.cast("long"), F.lit(0)).bitwiseAND(F.lit(0xFFFFFFFF)))
    rows = mixed(rows, "__mix").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    rows = mixed(rows.withColumn("__mix", (F.col("__mix") + (F.col("draw") + seed * 65_537).cast("long") * DRAW_STEP).bitwiseAND(F.lit(0xFFFFFFFF))), "__mix")
    below = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]
    weight = sum(((F.col("__mix") >= math.ceil(p * (1 << 32))).cast("int") for p in below), F.lit(0))
    return rows.withColumn("weight", weight.cast("double")).drop("__mix")


def drawn(df: DataFrame, row_id: Column, seed: int, name: str = "__mix") -> DataFrame:
    """Add a number below 2**32 from a hash of a row's id and the seed; a null id counts as 0."""
    return mixed(df.withColumn(name, (F.coalesce(row_id.cast("long"), F.lit(0)) + seed * 65_537).bitwiseAND(F.lit(0xFFFFFFFF))), name)


def bagging(df: DataFrame, row_id: Column, fraction: float, seed: int = 0) -> DataFrame:
    """Rows kept with chance ``fraction``, decided by a hash of their id, a whole number: the same on every run.

    Rows of one id stay or go together; a null id counts as 0.
    """
    return drawn(df, row_id, seed).where(F.col("__mix") < round(fraction * (1 << 32))).drop("__mix")


def bagging_by_label(df: DataFrame, row_id: Column, label: str, positive: float, negative: float, seed: int = 0) -> DataFrame:
    """Separate rates for positive and other rows."""
    rate = F.when(F.col(label) > 0, F.lit(round(positive * (1 << 32)))).otherwise(F.lit(round(negative * (1 << 32))))
    return drawn(df, row_id, seed).where(F.col("__mix") < rate).drop("__mix")


def goss(df: DataFrame, row_id: Column, gradient: str, hessian: str, top: float = 0.2, other: float = 0.1, seed: int = 0) -> DataFrame:
    """Gradient-based one-side sampling.

    Keeps the ``floor(top * n)`` rows of largest ``abs(gradient * hessian)`` as
    they are and a share ``other / (1 - top)`` of the rest by hash, whose
    gradients and hessians grow by ``(1 - top) / other``.
    """
    score = -F.abs(F.col(gradient) * F.col(hessian))
    rows = numbered(df.withColumn("__id", row_id.cast("string")), score, "__number")
    limit = df.agg(F.floor(F.count("*") * top).alias("__limit"))
    rows = rows.crossJoin(F.broadcast(limit)).withColumn("is_top", F.col("__number") < F.col("__limit"))
    drawn = F.pmod(F.xxhash64("__id", F.lit(seed)), F.lit(1_000_000)) < math.floor(other / (1 - top) * 1_000_000)
    grow = F.when(F.col("is_top"), 1.0).otherwise((1 - top) / other)
    kept = rows.where(F.col("is_top") | drawn)
    return kept.withColumn(gradient, F.col(gradient) * grow).withColumn(hessian, F.col(hessian) * grow).drop("__number", "__limit", "__id")


def class_values(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels."""
    return df.select(label).where(F.col(label).isNotNull()).distinct()


def class_count(df: DataFrame, label: str, most: int = 1000) -> DataFrame:
    """One row, ``classes``: the number of different labels, null where they are more than ``most`` and so no classes."""
    n = F.count_distinct(F.col(label))
    return df.agg(F.when(n <= most, n).cast("int").alias("classes"))
