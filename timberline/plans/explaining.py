"""Queries over contributions, interactions, resampled intervals, checks of cells and ways to predict."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import boosting, classification, impute, profile, ranking, regression, sampling, trees
from timberline.plans.common import FEATURES, HOLED_SQL, holed, lineitem, rounded
from timberline.plans.metrics import _PQ, _ranked
from timberline.plans.models import _LEAF, _ONE, _TWO, SECOND, TREE

NAMES = [*FEATURES, "l_linenumber"]
DRAWS = 40


def _explained(spark, sf_dir):
    return trees.shap_values(holed(spark, sf_dir).select("l_linenumber", *FEATURES), [TREE, SECOND], NAMES)


def tree_explanation(spark, sf_dir):
    """Mean contributions, and the largest gap between their sum and the score."""
    total = F.aggregate("shap", F.lit(0.0), lambda a, x: a + x)
    gap = F.abs(total - trees.score_expression(TREE) - trees.score_expression(SECOND))
    return _explained(spark, sf_dir).agg(F.round(F.max(gap), 9).alias("gap"), *[F.round(F.avg(F.abs(F.col("shap")[i])), 5).alias(f) for i, f in enumerate(NAMES)])


def shap_importance(spark, sf_dir):
    return rounded(trees.shap_importance(_explained(spark, sf_dir), NAMES), 5, "importance")


def shap_summary(spark, sf_dir):
    out = trees.shap_summary(_explained(spark, sf_dir))
    return rounded(rounded(out, 5, "lowest", "highest", "mean", "median", "std"), 2, "total_absolute")


def shap_interactions(spark, sf_dir):
    """Mean absolute interaction of each pair of features that the first tree splits on."""
    names = ["l_quantity", "l_discount", "l_tax"]
    out = trees.shap_interactions(holed(spark, sf_dir).select("l_linenumber", *FEATURES), [TREE], names)
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.abs(F.col("interactions")[3 * i + j]).alias("v")) for i, a in enumerate(names) for j, b in enumerate(names)]))
    return out.select(cells.alias("c")).groupBy("c.a", "c.b").agg(F.round(F.avg("c.v"), 5).alias("strength"))


def _id():
    return F.col("l_orderkey") * 1000 + F.col("l_partkey") * 10 + F.col("l_linenumber")


def bootstrap_mae(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("p", 1000.0 + F.col("l_quantity") * 12.0)
    return rounded(regression.bootstrap(df, _id(), {"mae": lambda w: regression.mae(F.col("p"), F.col("y"), w)}, 50, 0.9, seed=2), 4, "low", "high")


def bootstrap_metrics(spark, sf_dir):
    """Intervals of a regression's error and of a classifier's accuracy."""
    df = lineitem(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / F.col("l_quantity")).withColumn("p", 1000.0 + F.col("l_quantity") * 12.0)
    right = classification.accurate(F.col("l_quantity") / 51.0, (F.col("l_returnflag") == "R").cast("int"))
    metrics = {"mae": lambda w: regression.mae(F.col("p"), F.col("y"), w), "accuracy": lambda w: regression.mean(right, w)}
    return rounded(regression.bootstrap(df, _id(), metrics, DRAWS), 4, "low", "high")


def bootstrap_ranking(spark, sf_dir):
    """Intervals of NDCG@5 and MAP@5 over resamples of the suppliers."""
    return rounded(ranking.bootstrap_means(ranking.per_query(_ranked(spark, sf_dir), 5), F.col("query"), DRAWS), 4, "low", "high")


def bagged_rows(spark, sf_dir):
    """Rows that bags of two kinds keep."""
    df = lineitem(spark, sf_dir).withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    kept = sampling.bagging(df, _id(), 0.3, 3).groupBy("y").agg(F.count("*").alias("bagged"))
    return kept.join(sampling.bagging_by_label(df, _id(), "y", 0.9, 0.2, 3).groupBy("y").agg(F.count("*").alias("by_label")), "y")


def fill_random(spark, sf_dir):
    """Taxes drawn from the known ones, by line number."""
    df = impute.random_fill(holed(spark, sf_dir), "l_tax", _id(), 5)
    return df.groupBy("l_linenumber").agg(F.count("l_tax").alias("n"), F.round(F.sum("l_tax"), 3).alias("l_tax"))


def cell_checks(spark, sf_dir):
    df = holed(spark, sf_dir).withColumn("l_quantity", F.when(F.col("l_linenumber") == 2, float("inf")).otherwise(F.col("l_quantity")))
    rules = {"dear": F.col("l_extendedprice") < 50_000, "taxed": F.col("l_tax") > 0.01}
    return profile.cell_checks(df, ["l_quantity", "l_discount", "l_tax"], {"l_quantity": (5.0, 45.0), "l_tax": (0.0, 0.06)}, rules)


def prediction_kinds(spark, sf_dir):
    """Predictions of one tree, raw ones, those of an early stop, leaves and contributions."""
    df = holed(spark, sf_dir).select("l_linenumber", *FEATURES)
    model = boosting.Ensemble([TREE, SECOND, TREE], 0.1, "binary")
    one = boosting.predict_with(df, model, boosting.PredictOptions(trees=1)).withColumnRenamed("prediction", "one")
    raw = boosting.predict_with(one, model, boosting.PredictOptions(raw=True, leaves=True)).withColumnRenamed("prediction", "raw")
    stop = boosting.predict_with(raw, model, boosting.PredictOptions(stop_every=1, stop_margin=1.6, contributions=True), NAMES)
    total = F.aggregate("shap", F.lit(0.0), lambda a, x: a + x)
    sums = {"one": F.sum("one"), "raw": F.sum("raw"), "stopped": F.sum("prediction"), "contributions": F.sum(total)}
    return stop.groupBy(F.col("leaves")[0].alias("leaf")).agg(F.sum("used").alias("used"), *[F.round(v, 3).alias(k) for k, v in sums.items()])


def stop_statistics(spark, sf_dir):
    """What an early stop knows after each of nine rounds; -1 rounds remain while it has no guess."""
    stop, rows = boosting.EarlyStop(patience=4, min_delta=0.01), []
    for k, value in enumerate((1.0, 0.5, 0.25, 0.25, 0.125, 0.125, 0.125, 0.125, 0.125)):
        stopped = stop.update(value)
        known = stop.statistics()
        rows.append((k, stopped, known["best_round"], known["improvements"], round(known["mean_improvement"], 6), known["waited"], -1 if stop.remaining() is None else stop.remaining()))
    return spark.createDataFrame(rows, "round int, stopped boolean, best_round int, improvements int, mean_improvement double, waited int, remaining int")


QUERIES = {
    f.__name__: f
    for f in (tree_explanation, shap_importance, shap_summary, shap_interactions, bootstrap_mae, bootstrap_metrics, bootstrap_ranking, bagged_rows, fill_random, cell_checks, prediction_kinds, stop_statistics)
}

# The value of each coalition of the first tree's features, from the definition: v0 knows none, v1 the quantity, v2 the discount, v4 the tax.
_SIDES = """(SELECT l_linenumber, CASE WHEN l_quantity <= 24.5 THEN 1 ELSE 0 END AS q, CASE WHEN coalesce(l_discount <= CAST(0.045 AS DOUBLE), false) THEN 1 ELSE 0 END AS d,
    CASE WHEN coalesce(l_tax <= CAST(0.035 AS DOUBLE), true) THEN 1 ELSE 0 END AS t, CASE WHEN l_linenumber IN (1, 4, 6) THEN 1.0 ELSE -0.5 END AS two FROM """ + HOLED_SQL + ")"
_D = lambda x: f"CAST({x} AS DOUBLE)"


def _coalition(mask: int) -> str:
    q, d, t = ("q" if mask & 1 else _D("0.5")), ("d" if mask & 2 else f"({_D(1)} / 3)"), ("t" if mask & 4 else _D("0.4"))
    return f"0.5 * ({q} * ({d} * -1.5 + (1 - {d}) * 0.25) + (1 - {q}) * ({t} * 0.75 + (1 - {t}) * 2)) AS v{mask}"


_VALUES = f"(SELECT {', '.join(_coalition(m) for m in range(8))}, {_D('two')} AS two, l_linenumber FROM {_SIDES})"


def _shapley(bit: int) -> str:
    """A feature's contribution: the mean over orders of what it adds."""
    a, b = (x for x in (1, 2, 4) if x != bit)
    return f"((v{bit} - v0) / 3 + (v{bit | a} - v{a}) / 6 + (v{bit | b} - v{b}) / 6 + (v7 - v{a | b}) / 3)"


def _pair(a: int, b: int) -> str:
    c = 7 - a - b
    return f"((v{a | b} - v{a} - v{b} + v0) / 4 + (v7 - v{a | c} - v{b | c} + v{c}) / 4)"


_BITS = {"l_quantity": 1, "l_discount": 2, "l_tax": 4}
_PHI = {"l_quantity": _shapley(1), "l_extendedprice": _D(0), "l_discount": _shapley(2), "l_tax": _shapley(4), "l_linenumber": f"(two - {_D('0.1')})"}
_ALL_SHAP = " UNION ALL ".join(f"SELECT {x} AS x FROM {_VALUES}" for x in (*_PHI.values(), f"(v0 + {_D('0.1')})"))


def _own(a: str) -> str:
    return f"({_PHI[a]} - " + " - ".join(_pair(_BITS[a], _BITS[b]) for b in _BITS if b != a) + ")"


def _mix(x: str, steps: int = 2) -> str:
    """The hash of resampling, one subquery a step over column h of a source."""
    for _ in range(steps):
        x = f"(SELECT * REPLACE ((xor(h, h >> 16) * 73244475) & 4294967295 AS h) FROM {x})"
    return f"(SELECT * REPLACE (xor(h, h >> 16) AS h) FROM {x})"


def _resampled(source: str, row_id: str, draws: int = DRAWS, seed: int = 0) -> str:
    first = _mix(f"(SELECT *, CAST({row_id} AS BIGINT) & 4294967295 AS h FROM {source})")
    second = _mix(f"(SELECT * REPLACE ((h + (draw + {seed * 65_537}) * 2654435761) & 4294967295 AS h) FROM {first} CROSS JOIN range({draws}) r(draw))")
    below, term, total = [], 1.0, 0.0
    for k in range(8):
        term = term / k if k else 1.0
        total += term
        below.append(f"CASE WHEN h >= ceil({total!r}::DOUBLE * exp(-1) * 4294967296) THEN 1 ELSE 0 END")
    return f"(SELECT *, {' + '.join(below)} AS w FROM {second})"


def _interval(name: str, per_draw: str) -> str:
    return f"SELECT '{name}' AS metric, round(list_sort(list(v))[2], 4) AS low, round(list_sort(list(v))[{int(DRAWS * 0.975) + 1}], 4) AS high FROM ({per_draw})"


_ID = "l_orderkey * 1000 + l_partkey * 10 + l_linenumber"
_ROWS = f"(SELECT {_ID} AS id, abs(1000.0 + l_quantity * 12.0 - l_extendedprice / l_quantity) AS e, CASE WHEN (l_quantity / 51.0 >= 0.5) = (l_returnflag = 'R') THEN 1.0 ELSE 0.0 END AS hit FROM lineitem)"
_QUERIES_5 = f"(SELECT query, CASE WHEN idcg > 0 THEN dcg / idcg END AS ndcg, ap FROM {_PQ(5)})"
_BAG = _mix(f"(SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, ({_ID} + 196611) & 4294967295 AS h FROM lineitem)")
_DRAWN = lambda seed: _mix(f"(SELECT *, ({_ID} + {seed * 65_537}) & 4294967295 AS h FROM {HOLED_SQL})")
_BOTH = _mix(f"(SELECT * EXCLUDE h, h AS high, ({_ID} + {6 * 65_537}) & 4294967295 AS h FROM {_DRAWN(5)})")
_CHECKED = f"(SELECT * REPLACE (CASE WHEN l_linenumber = 2 THEN CAST('Infinity' AS DOUBLE) ELSE l_quantity END AS l_quantity) FROM {HOLED_SQL})"
_SCORED = f"(SELECT {_LEAF} AS leaf, {_ONE} AS a, {_TWO} AS b FROM {HOLED_SQL})"
_LINK = lambda x: f"1 / (1 + exp(-({x})))"

ORACLE = {
    "tree_explanation": f"SELECT CAST(0 AS DOUBLE) AS gap, {', '.join(f'round(avg(abs({x})), 5) AS {f}' for f, x in _PHI.items())} FROM {_VALUES}",
    "shap_importance": " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg(abs({x})), 5) AS importance FROM {_VALUES}" for f, x in _PHI.items()),
    "shap_summary": f"""SELECT round(min(x), 5) AS lowest, round(max(x), 5) AS highest, round(avg(x), 5) AS mean, round(median(x), 5) AS median,
        round(stddev_pop(x), 5) AS std, round(sum(abs(x)), 2) AS total_absolute FROM ({_ALL_SHAP})""",
    "shap_interactions": " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(avg(abs({_own(a) if a == b else _pair(_BITS[a], _BITS[b])})), 5) AS strength FROM {_VALUES}" for a in _BITS for b in _BITS
    ),
    "bootstrap_mae": f"SELECT 'mae' AS metric, round(list_sort(list(v))[3], 4) AS low, round(list_sort(list(v))[48], 4) AS high FROM (SELECT sum(w * e) / sum(w) AS v FROM {_resampled(_ROWS, 'id', 50, 2)} GROUP BY draw)",
    "bootstrap_metrics": " UNION ALL ".join(
        _interval(name, f"SELECT sum(w * {x}) / sum(w) AS v FROM {_resampled(_ROWS, 'id')} GROUP BY draw") for name, x in (("mae", "e"), ("accuracy", "hit"))
    ),
    "bootstrap_ranking": " UNION ALL ".join(
        _interval(name, f"SELECT sum(w * {x}) / sum(CASE WHEN {x} IS NOT NULL THEN w END) AS v FROM {_resampled(_QUERIES_5, 'query')} GROUP BY draw") for name, x in (("ndcg", "ndcg"), ("map", "ap"))
    ),
    "bagged_rows": f"""SELECT CAST(y AS INTEGER) AS y, count(*) FILTER (WHERE h < 1288490189) AS bagged,
        count(*) FILTER (WHERE h < CASE WHEN y = 1 THEN 3865470566 ELSE 858993459 END) AS by_label FROM {_BAG} GROUP BY y""",
    "fill_random": f"""WITH k AS (SELECT l_tax AS v, row_number() OVER (ORDER BY l_tax) - 1 AS pos FROM {HOLED_SQL} WHERE l_tax IS NOT NULL),
        d AS (SELECT l_linenumber, l_tax, (high * 1073741824 + (h >> 2)) % (SELECT count(*) FROM k) AS pos FROM {_BOTH})
        SELECT l_linenumber, count(coalesce(l_tax, v)) AS n, round(sum(coalesce(l_tax, v)), 3) AS l_tax FROM d JOIN k USING (pos) GROUP BY 1""",
    "cell_checks": " UNION ALL ".join(
        [
            *(f"SELECT 'missing' AS \"check\", '{f}' AS subject, count(*) FILTER (WHERE {f} IS NULL) AS n FROM {_CHECKED}" for f in ("l_quantity", "l_discount", "l_tax")),
            *(f"SELECT 'infinite', '{f}', count(*) FILTER (WHERE isinf({f})) FROM {_CHECKED}" for f in ("l_quantity", "l_discount", "l_tax")),
            *(f"SELECT 'out_of_range', '{f}', count(*) FILTER (WHERE {f} < {lo} OR {f} > {_D(hi)}) FROM {_CHECKED}" for f, lo, hi in (("l_quantity", 5, 45), ("l_tax", 0, 0.06))),
            f"SELECT 'rule', 'dear', count(*) FILTER (WHERE NOT l_extendedprice < 50000) FROM {_CHECKED}",
            f"SELECT 'rule', 'taxed', count(*) FILTER (WHERE l_partkey % 5 = 0 OR l_tax <= {_D('0.01')}) - count(*) FILTER (WHERE l_partkey % 5 = 0) FROM {_CHECKED}",
            f"SELECT 'repeated_rows', NULL, CAST(sum(k - 1) AS BIGINT) FROM (SELECT count(*) AS k FROM {_CHECKED} GROUP BY l_quantity, l_discount, l_tax)",
        ]
    ),
    "prediction_kinds": f"""WITH s AS (SELECT *, CASE WHEN 2 * abs(a) > {_D('1.6')} THEN 1 WHEN 2 * abs(a + b) > {_D('1.6')} THEN 2 ELSE 3 END AS used FROM {_SCORED})
        SELECT CAST(leaf AS INTEGER) AS leaf, CAST(sum(used) AS BIGINT) AS used, round(sum({_LINK(f"{_D('0.1')} + a")}), 3) AS one, round(sum({_D('0.1')} + a + b + a), 3) AS raw,
          round(sum({_LINK(f"{_D('0.1')} + a + CASE WHEN used > 1 THEN b ELSE 0 END + CASE WHEN used > 2 THEN a ELSE 0 END")}), 3) AS stopped, round(sum(a + b + a), 3) AS contributions FROM s GROUP BY leaf""",
    "stop_statistics": """SELECT CAST(r AS INTEGER) AS round, s AS stopped, CAST(b AS INTEGER) AS best_round, CAST(i AS INTEGER) AS improvements, CAST(m AS DOUBLE) AS mean_improvement, CAST(w AS INTEGER) AS waited, CAST(l AS INTEGER) AS remaining
        FROM (VALUES (0, false, 0, 0, 0, 0, -1), (1, false, 1, 1, 0.5, 0, -1), (2, false, 2, 2, 0.375, 0, -1), (3, false, 2, 2, 0.375, 1, -1), (4, false, 4, 3, 0.291667, 0, -1), (5, false, 4, 3, 0.291667, 1, 6),
          (6, false, 4, 3, 0.291667, 2, 4), (7, false, 4, 3, 0.291667, 3, 2), (8, true, 4, 3, 0.291667, 4, 0)) v(r, s, b, i, m, w, l)""",
}
