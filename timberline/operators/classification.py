"""Classification metrics from confusion counts, score counts and probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.ordering import running_sums
from timberline.operators.spec import ratio

EPS = 1e-15


def confusion(df: DataFrame, score: Column, label: Column, threshold: float = 0.5, w: Column | None = None) -> DataFrame:
    """One row ``tp, fp, tn, fn``; labels other than 0 and 1 are ignored."""
    weight = F.lit(1.0) if w is None else w
    said, y = score >= threshold, label.cast("int")
    cell = lambda a, b: F.coalesce(F.sum(F.when(a & (y == b), weight)), F.lit(0.0))
    return df.agg(cell(said, 1).alias("tp"), cell(said, 0).alias("fp"), cell(~said, 0).alias("tn"), cell(~said, 1).alias("fn"))


def from_confusion(c: DataFrame, beta: float = 1.0) -> DataFrame:
    """Every ratio of a binary confusion row; 0 where a denominator is 0."""
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    chance = ratio((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn), n * n)
    accuracy = ratio(tp + tn, n)
    margin = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        accuracy.alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        specificity.alias("specificity"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        ratio((1 + beta * beta) * precision * recall, beta * beta * precision + recall).alias("f_beta"),
        ((recall + specificity) / 2).alias("balanced_accuracy"),
        ratio(tp, tp + fp + fn).alias("jaccard"),
        ratio(tp * tn - fp * fn, margin).alias("matthews"),
        ratio(accuracy - chance, 1 - chance).alias("kappa"),
        ratio(fp + fn, n).alias("zero_one"),
    )


def accurate(score: Column, label: Column, threshold: float = 0.5) -> Column:
    """1 where the score says the label, else 0; null for labels other than 0 and 1."""
    return F.when(label.isin(0, 1), ((score >= threshold) == (label == 1)).cast("double"))


def log_loss(p: Column, y: Column, w: Column | None = None) -> Column:
    """Binary, clamped away from 0 and 1."""
    q = F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))
    known = p.isNotNull() & y.isNotNull()
    each = F.when(known, -F.when(y == 1, F.ln(q)).otherwise(F.ln(1 - q)))
    return F.avg(each) if w is None else F.try_divide(F.sum(w * each), F.sum(F.when(known, w)))


def brier(p: Column, y: Column) -> Column:
    return F.avg((p - y) * (p - y))


def hinge(p: Column, y: Column) -> Column:
    """Labels are -1 and 1."""
    return F.avg(F.greatest(F.lit(0.0), 1 - y * p))


def score_counts(df: DataFrame, score: Column, label: Column, group: list[str] | None = None) -> DataFrame:
    """``score, pos, neg, pos_below, neg_below`` by distinct score: what curves and AUC need."""
    group = group or []
    counts = df.where(score.isNotNull()).groupBy(*group, score.cast("double").alias("score")).agg(F.count_if(label == 1).alias("pos"), F.count_if(label == 0).alias("neg"))
    return running_sums(counts, group, "score", {"pos_below": F.col("pos"), "neg_below": F.col("neg")})


def auc(counts: DataFrame) -> DataFrame:
    """Area under the ROC curve, ties counted half; 0.5 if a class is absent."""
    pairs = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    return counts.agg(ratio(pairs, F.sum("pos") * F.sum("neg"), 0.5).alias("auc"))


def roc_curve(counts: DataFrame) -> DataFrame:
    """``threshold, fpr, tpr`` at each distinct score."""
    total = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    rows = counts.crossJoin(F.broadcast(total))
    return rows.select(F.col("score").alias("threshold"), ratio(F.col("N") - F.col("neg_below"), F.col("N")).alias("fpr"), ratio(F.col("P") - F.col("pos_below"), F.col("P")).alias("tpr"))


def pr_curve(counts: DataFrame) -> DataFrame:
    """``threshold, precision, recall`` at each distinct score."""
    total = counts.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    rows = counts.crossJoin(F.broadcast(total))
    tp, fp = F.col("P") - F.col("pos_below"), F.col("N") - F.col("neg_below")
    return rows.select(F.col("score").alias("threshold"), ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("P")).alias("recall"))


def class_confusion(df: DataFrame, truth: Column, predicted: Column, n_classes: int) -> DataFrame:
    """``truth, predicted, n``; labels out of range are left out."""
    rows = df.select(truth.cast("int").alias("truth"), predicted.cast("int").alias("predicted"))
    return rows.where(F.col("truth").between(0, n_classes - 1) & F.col("predicted").between(0, n_classes - 1)).groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def per_class(matrix: DataFrame) -> DataFrame:
    """``class, support, precision, recall, f1`` from a confusion table."""
    support = matrix.groupBy(F.col("truth").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    said = matrix.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("said"))
    both = support.join(said, "class", "full").na.fill(0)
    precision, recall = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("support"))
    return both.select("class", "support", precision.alias("precision"), recall.alias("recall"), ratio(2 * precision * recall, precision + recall).alias("f1"))


def averages(classes: DataFrame) -> DataFrame:
    """Macro means over all classes (macro F1 is that of macro precision and recall) and support-weighted means."""
    p, r = F.avg("precision"), F.avg("recall")
    weighted = lambda c: ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))
    return classes.agg(p.alias("macro_precision"), r.alias("macro_recall"), ratio(2 * p * r, p + r).alias("macro_f1"), *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def multiclass_kappa(matrix: DataFrame) -> DataFrame:
    n = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    rows = matrix.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("a"))
    columns = matrix.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("b"))
    chance = rows.join(columns, "c").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("ab"))
    pe = ratio(F.col("ab"), F.col("n") * F.col("n"))
    return n.crossJoin(chance).select(ratio(ratio(F.col("hit"), F.col("n")) - pe, 1 - pe).alias("kappa"))


def multiclass_log_loss(probs: Column, y: Column, w: Column | None = None) -> Column:
    """Labels out of range are skipped."""
    p = F.try_element_at(probs, F.when((y >= 0) & (y < F.size(probs)), y.cast("int") + 1))
    each = F.when(p.isNotNull(), -F.ln(F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))))
    return F.avg(each) if w is None else F.try_divide(F.sum(w * each), F.sum(F.when(p.isNotNull(), w)))


def arg_max(probs: Column) -> Column:
    """The first largest entry."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def top_k_hit(probs: Column, y: Column, k: int) -> Column:
    """Whether the label is among the ``k`` largest entries, earlier ones first among equals."""
    p = F.try_element_at(probs, y.cast("int") + 1)
    ahead = F.size(F.filter(probs, lambda x: x > p)) + F.size(F.filter(F.slice(probs, 1, y.cast("int")), lambda x: x == p))
    return p.isNotNull() & (ahead < k)
