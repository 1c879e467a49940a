"""Metric queries over ``lineitem``, ``events``, ``labels`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import classification, ranking, regression
from timberline.plans.common import KEY, lineitem, rounded
from timberline.session import read_table


def _p():
    return F.col("p")


def _y():
    return F.col("y")



def _predictions(spark, sf_dir):
    """A price per unit predicted by a constant, against the true one."""
    df = lineitem(spark, sf_dir)
    return df.select(*KEY, (F.col("l_extendedprice") / F.col("l_quantity")).alias("y"), (F.lit(1000.0) + F.col("l_quantity") * 12.0).alias("p"), F.col("l_quantity").alias("w"), "l_returnflag", "l_discount", "l_suppkey")


_ROUND = 4


def regression_report(spark, sf_dir):
    out = regression.report(_predictions(spark, sf_dir), _p(), _y())
    return rounded(out, _ROUND, *out.columns)


def regression_weighted(spark, sf_dir):
    out = regression.report(_predictions(spark, sf_dir), _p(), _y(), F.col("w"), ["mse", "mae", "smape", "msle", "mean_bias_error", "r2"])
    return rounded(out, _ROUND, *out.columns)


def regression_by_group(spark, sf_dir):
    df = _predictions(spark, sf_dir)
    middles = regression.median_absolute_errors(df, _p(), _y(), "l_returnflag").withColumnRenamed("l_returnflag", "flag")
    out = df.groupBy("l_returnflag").agg(F.round(regression.rmse(_p(), _y()), 4).alias("rmse"))
    return out.join(F.broadcast(middles), F.col("l_returnflag").eqNullSafe(F.col("flag"))).select("l_returnflag", "rmse", F.round("median_absolute_error", 4).alias("median_absolute_error"))


def d2_scores(spark, sf_dir):
    df = _predictions(spark, sf_dir)
    out = regression.d2_scores(df, _p(), _y(), 0.3, 1.5)
    return rounded(out, 5, *out.columns)


def lag_metrics(spark, sf_dir):
    events = read_table(spark, sf_dir, "events").withColumn("p", F.col("value") * 0.9 + 1.0)
    out = regression.lag_metrics(events, _p(), F.col("value"), ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"))
    return rounded(out, 5, "mase", "msse", "theil_u", "directional_accuracy")


def _scores(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return df.select(*KEY, (F.col("l_quantity") / 51.0).alias("s"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_tax") * 100 + 1).alias("w"))


def binary_report(spark, sf_dir):
    out = classification.from_confusion(classification.confusion(_scores(spark, sf_dir), F.col("s"), F.col("y")), 2.0)
    return rounded(out, 6, *out.columns)


def binary_weighted(spark, sf_dir):
    out = classification.confusion(_scores(spark, sf_dir), F.col("s"), F.col("y"), 0.3, F.col("w"))
    return rounded(out, 3, *out.columns)


def binary_losses(spark, sf_dir):
    df = _scores(spark, sf_dir)
    s, y = F.col("s"), F.col("y")
    return df.agg(
        F.round(classification.log_loss(s, y), 5).alias("log_loss"),
        F.round(classification.log_loss(s, y, F.col("w")), 5).alias("weighted_log_loss"),
        F.round(classification.brier(s, y), 5).alias("brier"),
        F.round(classification.hinge(s * 2 - 1, y * 2 - 1), 5).alias("hinge"),
    )


def auc(spark, sf_dir):
    return rounded(classification.auc(classification.score_counts(_scores(spark, sf_dir), F.col("s"), F.col("y"))), 8, "auc")


def roc_curve(spark, sf_dir):
    return rounded(classification.roc_curve(classification.score_counts(_scores(spark, sf_dir), F.col("s"), F.col("y"))), 6, "threshold", "fpr", "tpr")


def pr_curve(spark, sf_dir):
    return rounded(classification.pr_curve(classification.score_counts(_scores(spark, sf_dir), F.col("s"), F.col("y"))), 6, "threshold", "precision", "recall")


def quality_auc(spark, sf_dir):
    """Document length as a quality score."""
    df = read_table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(read_table(spark, sf_dir, "labels"), "doc_id")
    return rounded(classification.auc(classification.score_counts(df, F.col("n_chars"), F.col("quality"))), 8, "auc")


def _classes(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return df.select((F.col("l_linenumber") - 1).alias("t"), ((F.col("l_partkey") + F.col("l_linenumber")) % 7).cast("int").alias("q"))


def _matrix(spark, sf_dir):
    return classification.class_confusion(_classes(spark, sf_dir), F.col("t"), F.col("q"), 6)


def class_confusion(spark, sf_dir):
    return _matrix(spark, sf_dir)


def class_report(spark, sf_dir):
    return rounded(classification.per_class(_matrix(spark, sf_dir)), 6, "precision", "recall", "f1")


def class_averages(spark, sf_dir):
    out = classification.averages(classification.per_class(_matrix(spark, sf_dir))).crossJoin(classification.multiclass_kappa(_matrix(spark, sf_dir)))
    return rounded(out, 6, *out.columns)


def class_probabilities(spark, sf_dir):
    """Log loss, arg-max and top-k accuracy of softmax scores."""
    from timberline.functions.scalars import softmax

    df = lineitem(spark, sf_dir).select(F.col("l_linenumber").alias("y"), softmax(F.array(F.col("l_discount") * 30, F.col("l_tax") * 30, F.col("l_quantity") / 25, F.lit(1.0))).alias("probs"))
    probs, y = F.col("probs"), F.col("y") - 1
    return df.agg(
        F.round(classification.multiclass_log_loss(probs, y), 5).alias("log_loss"),
        F.round(F.avg((classification.arg_max(probs) == y).cast("double")), 6).alias("accuracy"),
        F.round(F.avg(classification.top_k_hit(probs, y, 2).cast("double")), 3).alias("top_2"),
    )


def _ranked(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("rel", F.floor(F.col("l_quantity") / 10.5))
    return ranking.ranked(df, "l_suppkey", F.col("l_extendedprice"), F.col("rel"), ["l_orderkey", "l_linenumber", "l_partkey"])


def ranking_per_query(spark, sf_dir):
    out = ranking.per_query(_ranked(spark, sf_dir), 10)
    return rounded(out, 5, *out.columns[1:])


def ranking_means(spark, sf_dir):
    out = ranking.means(ranking.per_query(_ranked(spark, sf_dir), 5))
    return rounded(out, 5, *out.columns)


def ranking_linear(spark, sf_dir):
    out = ranking.per_query(_ranked(spark, sf_dir), 20, ranking.linear_gain, ranking.reciprocal_discount).select("query", "dcg", "ndcg")
    return rounded(out, 5, "dcg", "ndcg")


def rank_correlation(spark, sf_dir):
    return rounded(ranking.spearman(_ranked(spark, sf_dir)), 6, "rho")


def rank_agreement(spark, sf_dir):
    rows = lineitem(spark, sf_dir).withColumn("rel", F.floor(F.col("l_quantity") / 10.5))
    rows = ranking.ranked(rows, "l_orderkey", F.col("l_extendedprice"), F.col("rel"), ["l_linenumber", "l_partkey", "l_suppkey"])
    return rounded(ranking.kendall(rows), 6, "tau")


def expected_reciprocal_rank(spark, sf_dir):
    return rounded(ranking.expected_reciprocal_rank(_ranked(spark, sf_dir)), 6, "err")


QUERIES = {
    f.__name__: f
    for f in (regression_report, regression_weighted, regression_by_group, d2_scores, lag_metrics, binary_report, binary_weighted, binary_losses, auc, roc_curve, pr_curve, quality_auc, class_confusion, class_report, class_averages, class_probabilities, ranking_per_query, ranking_means, ranking_linear, rank_correlation, rank_agreement, expected_reciprocal_rank)
}

_PRED = "(SELECT l_extendedprice / l_quantity AS y, 1000.0 + l_quantity * 12.0 AS p, l_quantity AS w, l_returnflag FROM lineitem)"
_D = lambda x: f"CAST({x} AS DOUBLE)"
_TWEEDIE = lambda p: f"avg(2 * (power(y, 0.5) / -0.25 - y * power({p}, -0.5) / -0.5 + power({p}, 0.5) / 0.5))"
_PIN = lambda p, a: f"avg(CASE WHEN y >= {p} THEN {a} * (y - {p}) ELSE (1 - {a}) * ({p} - y) END)"
_SC = "(SELECT l_quantity / 51.0 AS s, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_tax * 100 + 1 AS w FROM lineitem)"
_CONF = f"(SELECT {_D('count(*) FILTER (WHERE s >= 0.5 AND y = 1)')} AS tp, {_D('count(*) FILTER (WHERE s >= 0.5 AND y = 0)')} AS fp, {_D('count(*) FILTER (WHERE s < 0.5 AND y = 0)')} AS tn, {_D('count(*) FILTER (WHERE s < 0.5 AND y = 1)')} AS fn FROM {_SC})"
_AUC = lambda source: f"""
    SELECT round((sum(CASE WHEN y = 1 THEN r END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 8) AS auc
    FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM {source})"""  # noqa: E731
_CURVE = f"(SELECT s, CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE y = 0) AS DOUBLE) AS b FROM {_SC} GROUP BY s)"
_ABOVE = f"(SELECT s, sum(a) OVER (ORDER BY s DESC) AS tp, sum(b) OVER (ORDER BY s DESC) AS fp, sum(a) OVER () AS P, sum(b) OVER () AS N FROM {_CURVE})"
_M = "(SELECT l_linenumber - 1 AS t, CAST((l_partkey + l_linenumber) % 7 AS INTEGER) AS q FROM lineitem WHERE l_linenumber - 1 BETWEEN 0 AND 5 AND (l_partkey + l_linenumber) % 7 BETWEEN 0 AND 5)"
_PC = f"""(SELECT class, support, coalesce(hit / nullif(said, 0), 0) AS precision, coalesce(hit / nullif(support, 0), 0) AS recall FROM (
    SELECT c AS class, (SELECT count(*) FROM {_M} WHERE t = c) AS support, CAST((SELECT count(*) FROM {_M} WHERE q = c) AS DOUBLE) AS said, CAST((SELECT count(*) FROM {_M} WHERE q = c AND t = c) AS DOUBLE) AS hit FROM range(6) r(c)))"""
_RK = """(SELECT query, rel, row_number() OVER (PARTITION BY query ORDER BY s DESC, l_orderkey, l_linenumber, l_partkey) AS pos, row_number() OVER (PARTITION BY query ORDER BY rel DESC, l_orderkey, l_linenumber, l_partkey) AS ipos,
    count(*) OVER (PARTITION BY query) AS n, count(*) FILTER (WHERE rel > 0) OVER (PARTITION BY query) AS relevant,
    count(*) FILTER (WHERE rel > 0) OVER (PARTITION BY query ORDER BY s DESC, l_orderkey, l_linenumber, l_partkey ROWS UNBOUNDED PRECEDING) AS hits
    FROM (SELECT l_suppkey AS query, l_extendedprice AS s, floor(l_quantity / 10.5) AS rel, l_orderkey, l_linenumber, l_partkey FROM lineitem))"""
_PQ = lambda k: f"""(SELECT query, coalesce(sum((power(2, rel) - 1) / log2(pos + 1)) FILTER (WHERE pos <= {k}), 0) AS dcg, coalesce(sum((power(2, rel) - 1) / log2(ipos + 1)) FILTER (WHERE ipos <= {k}), 0) AS idcg,
    coalesce(sum(CAST(hits AS DOUBLE) / pos) FILTER (WHERE pos <= {k} AND rel > 0) / nullif(max(relevant), 0), 0) AS ap, coalesce(1.0 / min(pos) FILTER (WHERE rel > 0), 0) AS rr,
    CAST(count(*) FILTER (WHERE pos <= {k} AND rel > 0) AS DOUBLE) / least(max(n), {k}) AS precision, coalesce(CAST(count(*) FILTER (WHERE pos <= {k} AND rel > 0) AS DOUBLE) / nullif(max(relevant), 0), 0) AS recall FROM {_RK} GROUP BY query)"""  # noqa: E731

ORACLE = {
    "regression_report": f"""
        SELECT round(avg((p - y) ** 2), 4) AS mse, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(100 * avg(abs((p - y) / y)), 4) AS mape,
          round(100 * avg(abs(p - y) / ((abs(p) + abs(y)) / 2)), 4) AS smape, round(avg((ln(p) - ln(y)) ** 2), 4) AS msle, round(sqrt(avg((ln(p) - ln(y)) ** 2)), 4) AS rmsle,
          round(1 - avg((p - y) ** 2) / var_pop(y), 4) AS r2, round(1 - avg((p - y) ** 2) / var_pop(y), 4) AS explained_variance, round(avg(p - y), 4) AS mean_bias_error,
          round(100 * avg((p - y) / y), 4) AS mean_percentage_error, round(sqrt(avg((p - y) ** 2)) / (max(y) - min(y)), 4) AS normalised_rmse,
          round(avg(2 * (y / p - ln(y) + ln(p) - 1)), 4) AS gamma_deviance, round(avg(2 * (y * ln(y / p) - y + p)), 4) AS poisson_deviance, round({_TWEEDIE("p")}, 4) AS tweedie_deviance,
          round({_PIN("p", _D("0.5"))}, 4) AS pinball FROM {_PRED}""",
    "regression_weighted": f"""
        SELECT round(sum(w * (p - y) ** 2) / sum(w), 4) AS mse, round(sum(w * abs(p - y)) / sum(w), 4) AS mae, round(100 * sum(w * (abs(p - y) / ((abs(p) + abs(y)) / 2))) / sum(w), 4) AS smape,
          round(sum(w * (ln(p) - ln(y)) ** 2) / sum(w), 4) AS msle, round(sum(w * (p - y)) / sum(w), 4) AS mean_bias_error,
          round(1 - sum(w * (p - y) ** 2) / sum(w) / (sum(w * y * y) / sum(w) - (sum(w * y) / sum(w)) ** 2), 4) AS r2 FROM {_PRED}""",
    "regression_by_group": f"SELECT l_returnflag, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(median(abs(p - y)), 4) AS median_absolute_error FROM {_PRED} GROUP BY 1",
    "d2_scores": f"""
        WITH q AS (SELECT median(y) AS m, avg(y) AS a FROM {_PRED}), z AS (SELECT y AS z FROM (SELECT y, row_number() OVER (ORDER BY y) - 1 AS r, count(*) OVER () AS n FROM {_PRED}) WHERE r = CAST(floor((n - 1) * {_D("0.3")}) AS BIGINT))
        SELECT round(1 - avg(abs(p - y)) / avg(abs(m - y)), 5) AS d2_absolute_error, round(1 - {_PIN("p", _D("0.3"))} / {_PIN("z", _D("0.3"))}, 5) AS d2_pinball, round(1 - {_TWEEDIE("p")} / {_TWEEDIE("a")}, 5) AS d2_tweedie FROM {_PRED}, q, z""",
    "lag_metrics": """
        WITH e AS (SELECT user_id, value AS y, value * CAST(0.9 AS DOUBLE) + 1.0 AS p, lag(value) OVER w AS y0, lag(value * CAST(0.9 AS DOUBLE) + 1.0) OVER w AS p0 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, round(avg(abs(p - y)) / avg(abs(y - y0)), 5) AS mase, round(avg((p - y) ** 2) / avg((y - y0) ** 2), 5) AS msse,
          round(sqrt(avg((p - y) ** 2) FILTER (WHERE y0 IS NOT NULL)) / sqrt(avg((y - y0) ** 2)), 5) AS theil_u,
          round(avg(CASE WHEN y0 IS NULL THEN NULL WHEN (y - y0) * (p - p0) > 0 THEN 1.0 ELSE 0.0 END), 5) AS directional_accuracy FROM e GROUP BY user_id""",
    "binary_report": f"""
        SELECT round((tp + tn) / n, 6) AS accuracy, round(pr, 6) AS precision, round(rc, 6) AS recall, round(sp, 6) AS specificity, round(2 * pr * rc / (pr + rc), 6) AS f1, round(5 * pr * rc / (4 * pr + rc), 6) AS f_beta,
          round((rc + sp) / 2, 6) AS balanced_accuracy, round(tp / (tp + fp + fn), 6) AS jaccard, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS matthews,
          round(((tp + tn) / n - pe) / (1 - pe), 6) AS kappa, round((fp + fn) / n, 6) AS zero_one FROM (
            SELECT *, tp + fp + tn + fn AS n, tp / (tp + fp) AS pr, tp / (tp + fn) AS rc, tn / (tn + fp) AS sp, ((tp + fp) * (tp + fn) + (tn + fp) * (tn + fn)) / ((tp + fp + tn + fn) ** 2) AS pe FROM {_CONF})""",
    "binary_weighted": f"""
        SELECT {", ".join(f"round(sum(w) FILTER (WHERE s {o} {_D('0.3')} AND y = {y}), 3) AS {n}" for n, o, y in (("tp", ">=", 1), ("fp", ">=", 0), ("tn", "<", 0), ("fn", "<", 1)))} FROM {_SC}""",
    "binary_losses": f"""
        SELECT round(avg(l), 5) AS log_loss, round(sum(w * l) / sum(w), 5) AS weighted_log_loss, round(avg((s - y) ** 2), 5) AS brier, round(avg(greatest(0, 1 - (y * 2 - 1) * (s * 2 - 1))), 5) AS hinge
        FROM (SELECT *, CASE WHEN y = 1 THEN -ln(s) ELSE -ln(1 - s) END AS l FROM {_SC})""",
    "auc": _AUC(_SC),
    "roc_curve": f"SELECT round(s, 6) AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM {_ABOVE}",
    "pr_curve": f"SELECT round(s, 6) AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / P, 6) AS recall FROM {_ABOVE}",
    "quality_auc": _AUC("(SELECT n_chars AS s, quality AS y FROM documents JOIN labels USING (doc_id))"),
    "class_confusion": f"SELECT t AS truth, q AS predicted, count(*) AS n FROM {_M} GROUP BY 1, 2",
    "class_report": f"SELECT CAST(class AS INTEGER) AS class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1 FROM {_PC}",
    "class_averages": f"""
        SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(coalesce(2 * avg(precision) * avg(recall) / nullif(avg(precision) + avg(recall), 0), 0), 6) AS macro_f1,
          round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
          round(sum(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) * support) / sum(support), 6) AS weighted_f1,
          (SELECT round((po - pe) / (1 - pe), 6) FROM (SELECT (SELECT avg(CASE WHEN t = q THEN 1.0 ELSE 0.0 END) FROM {_M}) AS po,
            (SELECT sum((SELECT count(*) FROM {_M} WHERE t = c) * (SELECT count(*) FROM {_M} WHERE q = c)) FROM range(6) r(c)) / CAST((SELECT count(*) FROM {_M}) AS DOUBLE) ** 2 AS pe)) AS kappa FROM {_PC}""",
    "class_probabilities": """
        WITH e AS (SELECT l_linenumber - 1 AS y, [exp(l_discount * 30), exp(l_tax * 30), exp(l_quantity / 25), exp(1.0)] AS z FROM lineitem),
        p AS (SELECT y, z, z[y + 1] AS own FROM e)
        SELECT round(avg(CASE WHEN own IS NOT NULL THEN -ln(greatest(own / list_sum(z), CAST(1e-15 AS DOUBLE))) END), 5) AS log_loss, round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
          round(avg(CASE WHEN y < 4 AND len(list_filter(z, lambda x: x > own)) + len(list_filter(z[1:y], lambda x: x = own)) < 2 THEN 1.0 ELSE 0.0 END), 3) AS top_2 FROM p""",
    "ranking_per_query": f"SELECT query, {', '.join(f'round({c}, 5) AS {c}' for c in ('dcg', 'idcg'))}, round(CASE WHEN idcg > 0 THEN dcg / idcg END, 5) AS ndcg, {', '.join(f'round({c}, 5) AS {c}' for c in ('ap', 'rr', 'precision', 'recall'))} FROM {_PQ(10)}",
    "ranking_means": f"SELECT round(avg(CASE WHEN idcg > 0 THEN dcg / idcg END), 5) AS ndcg, round(avg(ap), 5) AS map, round(avg(rr), 5) AS mrr, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall FROM {_PQ(5)}",
    "ranking_linear": f"""SELECT query, round(d, 5) AS dcg, round(d / i, 5) AS ndcg FROM (SELECT query, coalesce(sum(rel / pos) FILTER (WHERE pos <= 20), 0) AS d, nullif(coalesce(sum(rel / ipos) FILTER (WHERE ipos <= 20), 0), 0) AS i FROM {_RK} GROUP BY query)""",
    "rank_correlation": f"SELECT query, round(CASE WHEN count(*) > 1 THEN 1 - 6 * CAST(sum((pos - ipos) * (pos - ipos)) AS DOUBLE) / (count(*) * (CAST(count(*) AS DOUBLE) ** 2 - 1)) ELSE 0 END, 6) AS rho FROM {_RK} GROUP BY query",
    "rank_agreement": """
        WITH r AS (SELECT l_orderkey AS query, floor(l_quantity / 10.5) AS rel, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
        SELECT a.query, round(coalesce(sum(CASE WHEN b.pos < a.pos THEN sign(b.rel - a.rel) ELSE 0 END) / nullif(any_value(a.n) * (any_value(a.n) - 1) / 2.0, 0), 0), 6) AS tau FROM r a JOIN r b USING (query) GROUP BY a.query""",
    "expected_reciprocal_rank": f"""
        WITH u AS (SELECT query, pos, (power(2, rel) - 1) / 16 AS u FROM {_RK}),
        g AS (SELECT query, pos, u, coalesce(exp(sum(ln(1 - u)) OVER (PARTITION BY query ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS go FROM u)
        SELECT query, round(sum(go * u / pos), 6) AS err FROM g GROUP BY query""",
}
