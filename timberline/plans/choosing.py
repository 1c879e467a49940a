"""Queries over feature selection, importance by exchange, monotone trees and scaling by quantiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import boosting, scale, trees
from timberline.plans.boosted import _FEATURES, _HOLED_NULL, _labelled, _leaf_report
from timberline.plans.common import KEY, lineitem, rounded
from timberline.plans.models import _ONE, TREE

_SIGNS = {"l_quantity": 1, "l_discount": -1, "l_tax": 1}
_STEPS = 100


def permutation_importance(spark, sf_dir):
    """Rise of a tree's error when one feature's values come from other rows."""
    df = lineitem(spark, sf_dir).withColumn("y", F.col("l_quantity") / 25 - F.col("l_tax") * 10)
    order = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729, F.lit(1000003))
    score = lambda names: trees.score_expression(trees.over([TREE], names)[0])
    rises = trees.permutation_importance(df, _FEATURES, score, "y", order, seed=7)
    return rounded(spark.createDataFrame(list(rises.items()), "feature string, rise double"), 6, "rise")


def monotone_tree(spark, sf_dir):
    """Leaves of a tree of three leaves whose outputs follow the sign of each feature."""
    df = _labelled(spark, sf_dir)
    model = boosting.train(df, _FEATURES, "y", KEY, rounds=1, rate=1.0, num_leaves=3, monotone=_SIGNS, monotone_rule="neighbours")
    return _leaf_report(df, model)


def scale_quantile(spark, sf_dir):
    """Sums of two columns scaled to their share of the rows below."""
    df, names = lineitem(spark, sf_dir), ["l_quantity", "l_extendedprice"]
    out = scale.quantile_scale(df, scale.fit_quantile_scale(df, names, _STEPS))
    return out.groupBy("l_linenumber").agg(*[F.round(F.sum(f), 3).alias(f) for f in names])


def _three(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return df.withColumn("y", F.col("l_quantity") + F.col("l_extendedprice") / 2000 + F.col("l_tax") * 50)


def selected_l1(spark, sf_dir):
    """Features that a penalised regression keeps, with standardised coefficients."""
    chosen = scale.select_l1(_three(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_tax"], "y", 0.2)
    return rounded(spark.createDataFrame(list(chosen.items()), "feature string, weight double"), 6, "weight")


def eliminated_features(spark, sf_dir):
    """Two of three features, the least important one being dropped, most important first."""
    left = scale.eliminate(_three(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_tax"], "y", 2)
    return spark.createDataFrame([(k, f) for k, f in enumerate(left)], "place int, feature string")


QUERIES = {f.__name__: f for f in (permutation_importance, monotone_tree, scale_quantile, selected_l1, eliminated_features)}

_D = "CAST({} AS DOUBLE)".format


def _exchange_sql(seed: int) -> str:
    errors = [f"avg(({_ONE} - y) * ({_ONE} - y)) AS base"]
    for f in _FEATURES:
        one = _ONE.replace(f, f"p_{f}")
        errors.append(f"avg(({one} - y) * ({one} - y)) AS e_{f}")
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, round(e_{f} - base, 6) AS rise FROM e" for f in _FEATURES)
    return f"""
        WITH v AS (SELECT {", ".join(_FEATURES)}, l_quantity / 25 - l_tax * 10 AS y, (l_orderkey * 7919 + l_partkey * 104729) % 1000003 AS o FROM lineitem),
        r AS (SELECT *, row_number() OVER (ORDER BY o, {", ".join(_FEATURES)}, y) - 1 AS i, count(*) OVER () AS n FROM v),
        j AS (SELECT r.*, {", ".join(f"p.{f} AS p_{f}" for f in _FEATURES)} FROM r JOIN r p ON p.i = (r.i + 1 + ({seed} * 2654435761) % (r.n - 1)) % r.n),
        e AS (SELECT {", ".join(errors)} FROM j) {rows}"""


def _monotone_sql() -> str:
    """Two cuts on squared error; the second one's outputs stay within what the first one's other side leaves."""
    sign = "CASE f " + " ".join(f"WHEN '{f}' THEN {s}" for f, s in _SIGNS.items()) + " END"
    ctes = [f"seen AS (SELECT r.*, 0 AS leaf, avg(y) OVER () - y AS g, {_D(1)} AS h, avg(y) OVER () AS s FROM {_HOLED_NULL} r)"]
    source = "seen"
    for k in range(2):
        if k == 0:
            low, high = _D("'-infinity'"), _D("'infinity'")
        else:
            low = "(SELECT CASE WHEN c.leaf = 2 AND z.sign > 0 THEN z.lv WHEN c.leaf = 1 AND z.sign < 0 THEN z.rv ELSE CAST('-infinity' AS DOUBLE) END FROM cut_0 z)"
            high = "(SELECT CASE WHEN c.leaf = 1 AND z.sign > 0 THEN z.rv WHEN c.leaf = 2 AND z.sign < 0 THEN z.lv ELSE CAST('infinity' AS DOUBLE) END FROM cut_0 z)"
        cells = " UNION ALL ".join(f"SELECT leaf, '{f}' AS f, {f} AS v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {source} GROUP BY ALL" for f in _FEATURES)
        ctes.append(f"cells_{k} AS ({cells})")
        ctes.append(f"""sums_{k} AS (SELECT leaf, f, v, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln, sum(g) OVER a AS ag, sum(h) OVER a AS ah, sum(n) OVER a AS an
          FROM cells_{k} WINDOW w AS (PARTITION BY leaf, f ORDER BY v NULLS LAST ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY leaf, f))""")
        ctes.append(f"""open_{k} AS (SELECT c.*, {low} AS low, {high} AS high, {sign} AS sign FROM sums_{k} c WHERE v IS NOT NULL AND ln >= 20 AND an - ln >= 20)""")
        ctes.append(f"valued_{k} AS (SELECT *, greatest(least(-lg / lh, high), low) AS lv, greatest(least(-(ag - lg) / (ah - lh), high), low) AS rv FROM open_{k})")
        ctes.append(f"""cut_{k} AS (SELECT *, -(lg * lv + lh * lv * lv / 2) - ((ag - lg) * rv + (ah - lh) * rv * rv / 2) - ag * ag / ah / 2 AS gain FROM valued_{k}
          WHERE sign * (rv - lv) >= 0 QUALIFY row_number() OVER (ORDER BY gain DESC, leaf, f, v) = 1)""")
        value = " ".join(f"WHEN '{f}' THEN r.{f}" for f in _FEATURES)
        ctes.append(f"rows_{k} AS (SELECT r.* REPLACE (CASE WHEN r.leaf <> c.leaf THEN r.leaf WHEN CASE c.f {value} END <= c.v THEN {2 * k + 1} ELSE {2 * k + 2} END AS leaf) FROM {source} r, cut_{k} c)")
        source = f"rows_{k}"
    return f"""WITH {", ".join(ctes)}
        SELECT CAST(r.leaf AS INTEGER) AS leaf, count(*) AS n, round(avg(y), 4) AS mean,
          round(any_value(s + CASE r.leaf WHEN 1 THEN a.lv WHEN 2 THEN a.rv WHEN 3 THEN b.lv ELSE b.rv END), 4) AS score
        FROM rows_1 r, cut_0 a, cut_1 b GROUP BY r.leaf"""


def _scaled_sql(feature: str) -> str:
    return f"""(
        WITH o AS (SELECT {feature} AS x, row_number() OVER (ORDER BY {feature}) - 1 AS i, count(*) OVER () AS n FROM lineitem),
        q AS (SELECT k, x AS q FROM range({_STEPS + 1}) r(k) JOIN o ON i = CAST(floor((n - 1) * k / {_STEPS} + 0.5) AS BIGINT)),
        d AS (SELECT DISTINCT x FROM o),
        s AS (SELECT x, max(k) FILTER (WHERE q <= x) AS a, max(q) FILTER (WHERE q <= x) AS qa, min(k) FILTER (WHERE q >= x) AS b, min(q) FILTER (WHERE q >= x) AS qb FROM d, q GROUP BY x)
        SELECT x, CASE WHEN qa = qb THEN (a + b) / 2.0 ELSE a + (x - qa) / (qb - qa) END / {_STEPS} AS v FROM s)"""


_THREE = """(SELECT corr(l_quantity, l_extendedprice) AS g12, corr(l_quantity, l_tax) AS g13, corr(l_extendedprice, l_tax) AS g23, corr(l_quantity, y) AS c1, corr(l_extendedprice, y) AS c2, corr(l_tax, y) AS c3
    FROM (SELECT *, l_quantity + l_extendedprice / 2000 + l_tax * 50 AS y FROM lineitem))"""
_L = _D(0.2)

ORACLE = {
    "permutation_importance": _exchange_sql(7),
    "monotone_tree": _monotone_sql(),
    "scale_quantile": f"""
        SELECT l_linenumber, round(sum(a.v), 3) AS l_quantity, round(sum(b.v), 3) AS l_extendedprice
        FROM lineitem JOIN {_scaled_sql("l_quantity")} a ON l_quantity = a.x JOIN {_scaled_sql("l_extendedprice")} b ON l_extendedprice = b.x GROUP BY 1""",
    # two features stay, both positive; the third one's slope stays below the penalty
    "selected_l1": f"""
        WITH w AS (SELECT *, ((c1 - {_L}) - g12 * (c2 - {_L})) / (1 - g12 * g12) AS w1, ((c2 - {_L}) - g12 * (c1 - {_L})) / (1 - g12 * g12) AS w2 FROM {_THREE})
        SELECT 'l_quantity' AS feature, round(w1, 6) AS weight FROM w WHERE w1 > 0 UNION ALL SELECT 'l_extendedprice', round(w2, 6) FROM w WHERE w2 > 0
        UNION ALL SELECT 'l_tax', c3 FROM w WHERE abs(c3 - g13 * w1 - g23 * w2) > {_L}""",
    "eliminated_features": f"""
        WITH t AS (SELECT *, c1 * (1 - g23 * g23) - g12 * (c2 - g23 * c3) + g13 * (c2 * g23 - c3) AS d1, (c2 - c3 * g23) - c1 * (g12 - g13 * g23) + g13 * (g12 * c3 - g13 * c2) AS d2,
            (c3 - g23 * c2) - g12 * (g12 * c3 - g13 * c2) + c1 * (g12 * g23 - g13) AS d3 FROM {_THREE}),
        l AS (SELECT unnest([{{'f': 'l_quantity', 'w': abs(d1)}}, {{'f': 'l_extendedprice', 'w': abs(d2)}}, {{'f': 'l_tax', 'w': abs(d3)}}]) AS x FROM t),
        k AS (SELECT x.f AS f FROM l QUALIFY row_number() OVER (ORDER BY x.w DESC) <= 2),
        p AS (SELECT list(f ORDER BY f) AS fs FROM k),
        e AS (SELECT fs, CASE WHEN fs = ['l_extendedprice', 'l_quantity'] THEN [abs(c2 - g12 * c1), abs(c1 - g12 * c2)] WHEN fs = ['l_extendedprice', 'l_tax'] THEN [abs(c2 - g23 * c3), abs(c3 - g23 * c2)] ELSE [abs(c1 - g13 * c3), abs(c3 - g13 * c1)] END AS ws FROM t, p)
        SELECT CAST(row_number() OVER (ORDER BY w DESC) - 1 AS INTEGER) AS place, f AS feature FROM (SELECT unnest(fs) AS f, unnest(ws) AS w FROM e)""",
}
