"""Ranking metrics per query.

A query's rows meet in one task, as ranks need; queries are small next to the
table.  Ties in the score go by the row id that the caller names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.operators.ordering import run_starts
from timberline.operators.regression import bootstrap, mean
from timberline.operators.spec import ratio

MAX_RELEVANCE = 4
#: Grades that are counted side by side.
FEW_GRADES = 16


def exponential_gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def linear_gain(rel: Column) -> Column:
    return rel.cast("double")


def log_discount(pos: Column) -> Column:
    return 1 / F.log2(pos + 1)


def reciprocal_discount(pos: Column) -> Column:
    return 1 / pos


def runs(df: DataFrame, query: str, order: str) -> DataFrame:
    """Add ``run``: a repeated query id after another one starts a new query, as in row order.

    For exact row-order semantics only; group by the id itself otherwise.
    """
    starts = run_starts(df, query, order)
    by_range = Window.orderBy("__range")  # a row a range
    sizes = starts.groupBy("__range").agg(F.count_if("__new").alias("n"))
    base = sizes.select("__range", F.coalesce(F.sum("n").over(by_range.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    w = Window.partitionBy("__range").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    within = starts.withColumn("__run", F.sum(F.col("__new").cast("long")).over(w)).join(F.broadcast(base), "__range")
    return within.select(*df.columns, (F.col("__base") + F.col("__run")).alias("run"))


def ranked(df: DataFrame, query: str, score: Column, relevance: Column, ties: list[str]) -> DataFrame:
    """``query, pos, ideal_pos, rel, hits, n, relevant``: positions from 1, relevant rows up to each."""
    by_score = Window.partitionBy("query").orderBy(F.desc("__s"), *ties)
    by_rel = Window.partitionBy("query").orderBy(F.desc("rel"), *ties)
    whole = Window.partitionBy("query")
    rows = df.select(F.col(query).alias("query"), score.cast("double").alias("__s"), relevance.cast("double").alias("rel"), *ties)
    rows = rows.withColumn("pos", F.row_number().over(by_score)).withColumn("ideal_pos", F.row_number().over(by_rel))
    good = (F.col("rel") > 0).cast("int")
    rows = rows.withColumn("hits", F.sum(good).over(by_score.rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.count("*").over(whole)).withColumn("relevant", F.sum(good).over(whole))
    return rows.select("query", "pos", "ideal_pos", "rel", "hits", "n", "relevant")


def per_query(rows: DataFrame, k: int, gain: Callable[[Column], Column] = exponential_gain, discount: Callable[[Column], Column] = log_discount) -> DataFrame:
    """``query, dcg, idcg, ndcg, ap, rr, precision, recall`` at ``k`` of every query; one aggregation."""
    g, good, top = gain(F.col("rel")), F.col("rel") > 0, F.col("pos") <= k
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = rows.groupBy("query").agg(
        zero(F.sum(F.when(top, g * discount(F.col("pos"))))).alias("dcg"),
        zero(F.sum(F.when(F.col("ideal_pos") <= k, g * discount(F.col("ideal_pos"))))).alias("idcg"),
        zero(F.sum(F.when(top & good, F.col("hits") / F.col("pos")))).alias("precision_sum"),
        F.min(F.when(good, F.col("pos"))).alias("first_hit"),
        F.count_if(top & good).alias("top_hits"),
        F.max("n").alias("n"),
        F.max("relevant").alias("relevant"),
    )
    return sums.select(
        "query",
        "dcg",
        "idcg",
        F.when(F.col("idcg") > 1e-12, F.try_divide("dcg", "idcg")).alias("ndcg"),
        ratio(F.col("precision_sum"), F.col("relevant")).alias("ap"),
        F.coalesce(1 / F.col("first_hit"), F.lit(0.0)).alias("rr"),
        ratio(F.col("top_hits"), F.least(F.col("n"), F.lit(k))).alias("precision"),
        ratio(F.col("top_hits"), F.col("relevant")).alias("recall"),
    )


def means(queries: DataFrame) -> DataFrame:
    """One row of means over queries; NDCG over those with any gain to be had."""
    return queries.agg(F.avg("ndcg").alias("ndcg"), F.avg("ap").alias("map"), F.avg("rr").alias("mrr"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def bootstrap_means(queries: DataFrame, row_id: Column, draws: int = 1000, level: float = 0.95, seed: int = 0) -> DataFrame:
    """``metric, low, high`` of mean NDCG and MAP over resamples of the queries of ``per_query``."""
    metrics = {name: lambda w, c=column: mean(F.col(c), w) for name, column in (("ndcg", "ndcg"), ("map", "ap"))}
    return bootstrap(queries, row_id, metrics, draws, level, seed)


def spearman(rows: DataFrame) -> DataFrame:
    """``query, rho`` from ordinal ranks by score and by relevance; 0 for single rows."""
    d = F.col("pos") - F.col("ideal_pos")
    n = F.count("*")
    return rows.groupBy("query").agg(F.when(n > 1, 1 - 6 * F.sum(d * d) / (n * (n * n - 1))).otherwise(0.0).alias("rho"))


def kendall(rows: DataFrame) -> DataFrame:
    """``query, tau``: agreeing less disagreeing pairs over all pairs; equal relevances count for neither.

    Each row counts the rows of each grade before it; no query is one array.
    Up to FEW_GRADES grades of the table are counted side by side, in the order
    that gave the places; with more, each row is paired with the grades of its query.
    """
    unknown = F.count_if(F.col("rel").isNull()).alias("unknown")
    grades = [r[0] for r in rows.select("rel").where("rel is not null").distinct().limit(FEW_GRADES + 1).collect()]
    if len(grades) <= FEW_GRADES:
        before = Window.partitionBy("query").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        signs = [F.signum(F.lit(g) - F.col("rel")).cast("long") * F.count_if(F.col("rel") == F.lit(g)).over(before) for g in grades]
        scored = rows.select("query", "rel", sum(signs, F.lit(0).cast("long")).alias("s"))
        return _tau(scored.groupBy("query").agg(F.sum("s").alias("s"), F.count("*").alias("n"), unknown))
    whole = Window.partitionBy("query")
    grades = rows.select("query", "pos", "rel", F.collect_set("rel").over(whole).alias("grades"))
    graded = grades.select("query", "pos", "rel", F.posexplode_outer("grades").alias("k", "grade"))
    before = Window.partitionBy("query", "grade").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum((F.col("rel") == F.col("grade")).cast("long")).over(before), F.lit(0))
    scored = graded.withColumn("s", F.signum(F.col("grade") - F.col("rel")).cast("long") * above)
    sums = scored.groupBy("query").agg(F.sum("s").alias("s"), F.count_if(F.coalesce("k", F.lit(0)) == 0).alias("n"), unknown)
    return _tau(sums)


def _tau(sums: DataFrame) -> DataFrame:
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sums.select("query", F.when(F.col("n") > 1, ratio(F.when(F.col("unknown") == 0, F.col("s")), pairs)).otherwise(0.0).alias("tau"))


def expected_reciprocal_rank(rows: DataFrame, highest: int = MAX_RELEVANCE) -> DataFrame:
    """``query, err``: the cascade model, from running sums of log(1 - use) in score order.

    Factors of 0, and below 0 for relevances over ``highest``, are counted
    apart from the logarithms.
    """
    before = Window.partitionBy("query").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    used = rows.select("query", "pos", ((F.pow(F.lit(2.0), F.col("rel")) - 1) / float(2**highest)).alias("u"))
    rest = 1 - F.col("u")
    logs = F.coalesce(F.sum(F.when(rest != 0, F.log(F.abs(rest)))).over(before), F.lit(0.0))
    sign = F.when(F.count_if(rest < 0).over(before) % 2 == 1, -1.0).otherwise(1.0)
    go = F.when(F.count_if(rest == 0).over(before) > 0, 0.0).otherwise(sign * F.exp(logs))
    gains = used.withColumn("gain", go * F.col("u") / F.col("pos"))
    return gains.groupBy("query").agg(F.when(F.count_if(F.col("u").isNull()) == 0, F.sum("gain")).alias("err"))
