"""Split search over histograms and routing of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def soft(g: Column, l1: float) -> Column:
    """The gradient sum drawn towards zero by ``l1``."""
    return F.signum(g) * F.greatest(F.abs(g) - l1, F.lit(0.0))


def leaf_gain(g: Column, h: Column, l1: float = 0.0, l2: float = 0.0) -> Column:
    return F.when((h <= 0) | (F.abs(g) <= l1), 0.0).otherwise(0.5 * F.try_divide(soft(g, l1) * soft(g, l1), h + l2))


def leaf_value(g: Column, h: Column, l1: float = 0.0, l2: float = 0.0) -> Column:
    return F.when(h <= 0, 0.0).otherwise(F.coalesce(F.try_divide(-soft(g, l1), h + l2), F.lit(0.0)))


def smoothed(value: Column, parent: Column, h: Column, smooth: float) -> Column:
    """A leaf's value drawn towards its parent's, less so the heavier the leaf."""
    w = F.try_divide(F.lit(smooth), smooth + h)
    return (1 - w) * value + w * parent


def candidates(hist: DataFrame, l1: float = 0.0, l2: float = 0.0, min_data: int = 20, min_hessian: float = 1e-3, unordered: dict[str, int] | None = None, category_smooth: float = 10.0) -> DataFrame:
    """Every cut of every histogram that leaves enough on both sides, with its gain.

    A cut at ``bin`` sends bins up to it left.  Windows run over the bins of a
    leaf and feature, never over rows.  Columns: ``leaf, feature, bin, left_g,
    left_h, left_n, right_g, right_h, right_n, gain``.

    ``unordered`` names categorical features and the bin of their missing and
    rare values.  Their bins are put in the order of ``sum_g / (sum_h +
    category_smooth)``, that bin last, and the cut sends the bins listed in the
    further column ``bins`` left.
    """
    order = [F.col("bin")]
    if unordered:
        rest = F.create_map(*[F.lit(x) for pair in unordered.items() for x in pair])
        ratio = F.coalesce(F.try_divide(F.col("sum_g"), F.col("sum_h") + category_smooth), F.lit(0.0))
        place = F.when(F.try_element_at(rest, F.col("feature")) == F.col("bin"), F.lit(float("inf"))).otherwise(ratio)
        order = [F.when(F.col("feature").isin(list(unordered)), place).otherwise(F.col("bin").cast("double")), F.col("bin")]
    w = Window.partitionBy("leaf", "feature").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("leaf", "feature")
    sums = hist.select("leaf", "feature", "bin", *[F.sum(c).over(w).alias(f"left_{k}") for k, c in (("g", "sum_g"), ("h", "sum_h"), ("n", "n"))], *[F.sum(c).over(whole).alias(f"all_{k}") for k, c in (("g", "sum_g"), ("h", "sum_h"), ("n", "n"))], *([F.collect_list(F.when(F.col("feature").isin(list(unordered)), F.col("bin"))).over(w).alias("bins")] if unordered else []))
    sides = sums.select("*", *[(F.col(f"all_{k}") - F.col(f"left_{k}")).alias(f"right_{k}") for k in "ghn"])
    enough = (F.least("left_n", "right_n") >= max(min_data, 1)) & (F.least("left_h", "right_h") >= min_hessian)
    gain = leaf_gain(F.col("left_g"), F.col("left_h"), l1, l2) + leaf_gain(F.col("right_g"), F.col("right_h"), l1, l2) - leaf_gain(F.col("all_g"), F.col("all_h"), l1, l2)
    return sides.where(enough).withColumn("gain", gain).drop("all_g", "all_h", "all_n")


def loss_fall(g: Column, h: Column, value: Column, l1: float, l2: float) -> Column:
    """How much the loss falls if rows with these sums get ``value``."""
    return -(g * value + 0.5 * (h + l2) * value * value) - l1 * F.abs(value)


def best_splits(hist: DataFrame, digits: int | None = None, monotone: dict[str, int] | None = None, penalty: dict | None = None, extra: int | None = None, bounds: dict[int, tuple[float, float]] | None = None, **limits) -> DataFrame:
    """The best cut of each leaf; equal gains go to the smaller feature, then the lower bin.

    ``monotone`` drops cuts whose outputs move against a feature's sign and
    ``penalty`` takes the cost of a feature, or of a ``(leaf, feature)``, off its
    gains; ``digits`` rounds gains
    before they are compared.  ``bounds`` holds each leaf's lowest and highest
    output: gains are then what outputs within them gain.  With ``extra`` each feature of a leaf offers
    only one of its cuts, drawn by a hash with that seed.
    """
    l1, l2 = limits.get("l1", 0.0), limits.get("l2", 0.0)
    cuts = candidates(hist, **limits)
    if extra is not None:
        draw = Window.partitionBy("leaf", "feature").orderBy(F.xxhash64("leaf", "feature", "bin", F.lit(extra)), "bin")
        cuts = cuts.withColumn("__draw", F.row_number().over(draw)).where("__draw = 1").drop("__draw")
    within = lambda v: v
    if bounds:
        low, high = (F.element_at(F.create_map(*[F.lit(x) for leaf, b in bounds.items() for x in (leaf, float(b[k]))]), F.col("leaf")) for k in (0, 1))
        within = lambda v: F.greatest(F.least(v, high), low)
        fall = [loss_fall(F.col(f"{side}_g"), F.col(f"{side}_h"), within(leaf_value(F.col(f"{side}_g"), F.col(f"{side}_h"), l1, l2)), l1, l2) for side in ("left", "right")]
        cuts = cuts.withColumn("gain", fall[0] + fall[1] - leaf_gain(F.col("left_g") + F.col("right_g"), F.col("left_h") + F.col("right_h"), l1, l2))
    if penalty:
        own = any(isinstance(k, tuple) for k in penalty)  # prices of a leaf's own
        cost = F.create_map(*[F.lit(x) for k, v in penalty.items() for x in (f"{k[0]}|{k[1]}" if own else k, float(v))])
        name = F.concat_ws("|", F.col("leaf").cast("string"), "feature") if own else F.col("feature")
        cuts = cuts.withColumn("gain", F.col("gain") - F.coalesce(F.try_element_at(cost, name), F.lit(0.0)))
    if monotone:
        sign = F.create_map(*[F.lit(x) for pair in monotone.items() for x in pair])
        step = within(leaf_value(F.col("right_g"), F.col("right_h"), l1, l2)) - within(leaf_value(F.col("left_g"), F.col("left_h"), l1, l2))
        cuts = cuts.where(F.coalesce(F.try_element_at(sign, F.col("feature")), F.lit(0)) * step >= 0)
    if digits is not None:
        cuts = cuts.withColumn("gain", F.round("gain", digits))
    rank = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("gain"), "feature", "bin"))
    return cuts.where("gain > 0").withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def with_values(splits: DataFrame, l1: float = 0.0, l2: float = 0.0) -> DataFrame:
    """Add the values of both children and which side missing rows follow."""
    left, right = leaf_value(F.col("left_g"), F.col("left_h"), l1, l2), leaf_value(F.col("right_g"), F.col("right_h"), l1, l2)
    return splits.select("*", left.alias("left_value"), right.alias("right_value"), (F.col("left_h") >= F.col("right_h")).alias("default_left"))


def goes_left(bin_column: Column, cut: int, missing_bin: int | None = None, default_left: bool = True) -> Column:
    """Routing in bin space; the missing bin follows the default side."""
    left = bin_column <= cut
    return left if missing_bin is None else F.when(bin_column == missing_bin, F.lit(default_left)).otherwise(left)


def in_set(bin_column: Column, bins: list[int]) -> Column:
    """Categorical routing: listed bins go left."""
    return F.coalesce(bin_column.isin(bins), F.lit(False))


def route(df: DataFrame, leaf: str, split: int, predicate: Column, left: int, right: int) -> DataFrame:
    """Rows of leaf ``split`` move to ``left`` or ``right``; a narrow projection."""
    moved = F.when(F.col(leaf) == split, F.when(predicate, left).otherwise(right)).otherwise(F.col(leaf))
    return df.withColumn(leaf, moved)
