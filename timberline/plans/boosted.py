"""Queries over trained models and their losses, each with SQL that trains the same way."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import boosting, histogram, sampling, trees
from timberline.plans.common import HOLED_SQL, KEY, holed, lineitem, rounded
from timberline.plans.models import TREE

_FEATURES = ["l_quantity", "l_discount", "l_tax"]
_ONCE, _EACH = {"l_quantity": 500.0, "l_tax": 100.0}, {"l_discount": 0.02, "l_tax": 0.005}
_TOGETHER = [{"l_quantity", "l_discount"}, {"l_tax", "l_discount"}]
_ROBUST = ("quantile", "huber", "fair", "mape")


def _labelled(spark, sf_dir):
    return holed(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / 1000)


def objective_robust(spark, sf_dir):
    """Sums of gradients and hessians of the losses that bear outliers, by line status."""
    df = lineitem(spark, sf_dir).withColumn("y", F.col("l_quantity") / 10).withColumn("s", F.col("l_linenumber") * 0.7)
    sums = []
    for kind in _ROBUST:
        g, h = boosting.objective(kind, F.col("y"), F.col("s"))
        sums += [F.round(F.sum(g), 4).alias(f"{kind}_g"), F.round(F.sum(h), 4).alias(f"{kind}_h")]
    return df.groupBy("l_linestatus").agg(*sums)


def objective_lambdarank(spark, sf_dir):
    """Sums of the pairwise gradients, an order being a query of which the first three places count."""
    df = lineitem(spark, sf_dir).withColumn("y", F.pmod(F.col("l_partkey"), F.lit(4)).cast("double"))
    out = boosting.lambdarank_gradients(df, "l_orderkey", "y", F.col("l_quantity") / 25, KEY, truncation=3)
    return out.groupBy("l_linestatus").agg(F.round(F.sum("g"), 4).alias("g"), F.round(F.sum(F.col("g") * F.col("g")), 4).alias("g2"), F.round(F.sum("h"), 4).alias("h"))


def renewed_leaves(spark, sf_dir):
    """Outputs that the losses ask for in the leaves of a given tree, from the residuals of a constant."""
    df, out = _labelled(spark, sf_dir), None
    for kind in ("l1", "quantile", "mape", "huber"):
        tree = trees.Tree([trees.Node(**vars(n)) for n in TREE.nodes], 1.0)
        boosting.renew_leaves(df, tree, kind, F.col("y"), F.lit(30.0), {"quantile": 0.75, "huber": 5.0}.get(kind))
        rows = spark.createDataFrame([(kind, i, tree.nodes[i].value) for i in tree.leaves()], "loss string, leaf int, value double")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, 4, "value")


def _leaf_report(df, model):
    tree = model.trees[-1]
    return df.groupBy(trees.leaf_expression(tree).alias("leaf")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 4).alias("mean"), F.round(F.max(model.raw()), 4).alias("score"))


def boosted_one_round(spark, sf_dir):
    """Leaves of one tree of three leaves on squared error."""
    df = _labelled(spark, sf_dir)
    return _leaf_report(df, boosting.train(df, _FEATURES, "y", KEY, rounds=1, rate=0.3, num_leaves=3))


def tree_importance(spark, sf_dir):
    """Importance of the features of a trained tree, by its cuts, their gains and the rows they part."""
    model = boosting.train(_labelled(spark, sf_dir), _FEATURES, "y", KEY, rounds=1, rate=0.3, num_leaves=3)
    rows = [(kind, f, float(v), share) for kind in ("split", "gain", "cover") for f, v, share in boosting.rank_importance(trees.importance(model.trees, kind))]
    return rounded(spark.createDataFrame(rows, "kind string, feature string, value double, share double"), 4, "value", "share")


def tree_shape(spark, sf_dir):
    """Leaves, depth, mean output and its bounds of a trained tree, and the features above its first leaf."""
    tree = boosting.train(_labelled(spark, sf_dir), _FEATURES, "y", KEY, rounds=1, rate=0.3, num_leaves=3).trees[0]
    row = (len(tree.leaves()), tree.depth(), float(tree.expected_value()), *map(float, tree.bounds()), ",".join(tree.branch(tree.leaves()[0])))
    return rounded(spark.createDataFrame([row], "leaves int, depth int, expected double, lowest double, highest double, branch string"), 5, "expected", "lowest", "highest")


def boosted_linear(spark, sf_dir):
    """Rows, intercept and slope of the two leaves of a tree whose leaves are lines along its cut feature."""
    df = _labelled(spark, sf_dir).withColumn("y", F.col("l_quantity") * F.col("l_quantity") / 100 + F.col("l_extendedprice") / 10000)
    tree = boosting.train(df, _FEATURES, "y", KEY, rounds=1, rate=0.5, num_leaves=2, linear=1.0).trees[0]
    rows = [(i, tree.nodes[i].count, tree.nodes[0].feature, tree.nodes[i].linear[""], tree.nodes[i].linear[tree.nodes[0].feature]) for i in tree.leaves()]
    return rounded(spark.createDataFrame(rows, "leaf int, n long, feature string, intercept double, slope double"), 4, "intercept", "slope")


def node_features(spark, sf_dir):
    """Features that the leaves of a trained tree may be cut by, under sets of features that may stand on one path."""
    tree = boosting.train(_labelled(spark, sf_dir), _FEATURES, "y", KEY, rounds=1, rate=0.3, num_leaves=3).trees[0]
    rows = [(leaf, f) for leaf in tree.leaves() for f in sampling.allowed_features(_FEATURES, set(tree.branch(leaf)), _TOGETHER)]
    return spark.createDataFrame(rows, "leaf int, feature string")


def constrained_tree(spark, sf_dir):
    """Leaves of a tree grown under those sets."""
    df = _labelled(spark, sf_dir)
    return _leaf_report(df, boosting.train(df, _FEATURES, "y", KEY, rounds=1, rate=0.3, num_leaves=3, constraints=[{"l_quantity", "l_tax"}, {"l_discount"}]))


def priced_features(spark, sf_dir):
    """Cuts of a tree whose features cost something when they are first used, in the model and for a row."""
    df = _labelled(spark, sf_dir)
    tree = boosting.train(df, _FEATURES, "y", KEY, rounds=1, rate=0.3, num_leaves=3, once=_ONCE, each=_EACH).trees[0]
    rows = [(i, n.feature, n.threshold, n.gain) for i, n in enumerate(tree.nodes) if not n.is_leaf]
    return rounded(spark.createDataFrame(rows, "leaf int, feature string, threshold double, gain double"), 3, "threshold", "gain")


def boosted_two_rounds(spark, sf_dir):
    """Leaves of the second tree, with the largest score of both."""
    df = _labelled(spark, sf_dir)
    return _leaf_report(df, boosting.train(df, _FEATURES, "y", KEY, rounds=2, rate=0.3, num_leaves=3))


def boosted_quantile(spark, sf_dir):
    """Leaves of one tree for the upper decile, renewed from the residuals."""
    df = _labelled(spark, sf_dir)
    return _leaf_report(df, boosting.train(df, _FEATURES, "y", KEY, "quantile", rounds=1, rate=0.5, num_leaves=3, shape=0.9))


def watched_losses(spark, sf_dir):
    """Losses of held-out rows after each of two rounds, by which training may stop."""
    df = _labelled(spark, sf_dir)
    stop = boosting.EarlyStop(patience=3, min_delta=0.0)
    boosting.train(df, _FEATURES, "y", KEY, rounds=2, rate=0.3, num_leaves=3, valid_rows=F.col("l_partkey") % 5 == 0, early_stop=stop)
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(stop.history)], "round int, loss double")
    return rounded(rows, 6, "loss")


def boosted_classes(spark, sf_dir):
    """The first cut of each class's tree, boosted together, and both outputs."""
    df = holed(spark, sf_dir).withColumn("y", F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2))
    models = boosting.train_multiclass(df, _FEATURES, "y", KEY, 3, rounds=1, rate=0.5, num_leaves=2)
    rows = []
    for k, m in enumerate(models):
        root, left, right = m.trees[0].nodes
        rows.append((k, root.feature, root.threshold, left.count, right.count, left.value, right.value))
    out = spark.createDataFrame(rows, "class int, feature string, threshold double, left_n long, right_n long, left_value double, right_value double")
    return rounded(out, 5, "threshold", "left_value", "right_value")


def _exclusive(spark, sf_dir):
    """Three features of which only one, by the return flag, is off bin 0 in a row."""
    df = lineitem(spark, sf_dir)
    bins = {"a": ("A", F.col("l_linenumber")), "n": ("N", F.ceil(F.col("l_quantity") / 10)), "r": ("R", F.col("l_discount") * 100)}
    cells = [F.when(F.col("l_returnflag") == flag, F.round(b).cast("int")).otherwise(0).alias(f"bin_{f}") for f, (flag, b) in bins.items()]
    return df.select((F.col("l_extendedprice") / 1000 - 30).alias("g"), (F.col("l_tax") + 0.5).alias("h"), "l_linestatus", *cells)


def bundled_histogram(spark, sf_dir):
    """Histograms of features that share one column, taken apart again."""
    rows, widths = _exclusive(spark, sf_dir), {"a": 8, "n": 6, "r": 11}
    plan = histogram.find_bundles(rows, widths, 0)
    hist = histogram.leaf_histograms(histogram.with_bundles(rows, plan), {c: plan.width(c) for c in plan.columns}, F.when(F.col("l_linestatus") == "O", 1).otherwise(2), [1, 2])
    out = histogram.unbundled(hist, plan).withColumn("bundles", F.lit(len(plan.columns)))
    return rounded(out, 3, "sum_g", "sum_h")


QUERIES = {f.__name__: f for f in (objective_robust, objective_lambdarank, renewed_leaves, boosted_one_round, tree_importance, tree_shape, node_features, constrained_tree, priced_features, boosted_linear, boosted_two_rounds, boosted_quantile, watched_losses, boosted_classes, bundled_histogram)}

_D = "CAST({} AS DOUBLE)".format


def _robust_sql() -> str:
    d = "(s - y)"
    forms = {
        "quantile": (f"CASE WHEN s >= y THEN {_D(0.1)} ELSE {_D(-0.9)} END", _D(1)),
        "huber": (f"greatest(least({d}, {_D(0.9)}), {_D(-0.9)})", _D(1)),
        "fair": (f"{d} / (abs({d}) + 1)", f"1 / ((abs({d}) + 1) * (abs({d}) + 1))"),
        "mape": (f"sign({d}) / greatest(abs(y), 1)", _D(1)),
    }
    sums = ", ".join(f"round(sum({g}), 4) AS {k}_g, round(sum({h}), 4) AS {k}_h" for k, (g, h) in forms.items())
    return f"SELECT l_linestatus, {sums} FROM (SELECT l_linestatus, l_quantity / 10 AS y, l_linenumber * {_D(0.7)} AS s FROM lineitem) GROUP BY 1"


def _grown(ctes: list[str], source: str, tag: str, leaves: int, features: list[str] = _FEATURES, only: str = "") -> str:
    """Append the CTEs that grow a tree, best cut first, on ``source`` with ``leaf, g, h``; the name of the last.

    ``only`` says which features may follow the one that was cut ``first``.
    """
    for k in range(leaves - 1):
        cells = " UNION ALL ".join(f"SELECT leaf, '{f}' AS f, {f} AS v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM {source} GROUP BY ALL" for f in features)
        ctes.append(f"cells_{tag}_{k} AS ({cells})")
        ctes.append(f"""cuts_{tag}_{k} AS (
          SELECT leaf, f, v, sum(g) OVER w AS lg, sum(h) OVER w AS lh, sum(n) OVER w AS ln, sum(g) OVER a AS ag, sum(h) OVER a AS ah, sum(n) OVER a AS an FROM cells_{tag}_{k}
          WINDOW w AS (PARTITION BY leaf, f ORDER BY v NULLS LAST ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY leaf, f))""")
        ctes.append(f"""cut_{tag}_{k} AS (
          SELECT leaf, f, v, lg, lh, ln, ag, ah, an, (lg * lg / lh + (ag - lg) * (ag - lg) / (ah - lh) - ag * ag / ah) / 2 AS gain FROM cuts_{tag}_{k}
          {f", (SELECT f AS first FROM cut_{tag}_0)" if only and k else ""}
          WHERE v IS NOT NULL AND ln >= 20 AND an - ln >= 20 AND lh >= 0.001 AND ah - lh >= 0.001 {f"AND {only}" if only and k else ""}
          QUALIFY row_number() OVER (ORDER BY (lg * lg / lh + (ag - lg) * (ag - lg) / (ah - lh) - ag * ag / ah) DESC, leaf, f, v) = 1)""")
        value = " ".join(f"WHEN '{f}' THEN r.{f}" for f in features)
        ctes.append(f"""rows_{tag}_{k} AS (
          SELECT r.* REPLACE (CASE WHEN r.leaf <> c.leaf THEN r.leaf WHEN CASE c.f {value} END <= c.v THEN {2 * k + 1} ELSE {2 * k + 2} END AS leaf) FROM {source} r, cut_{tag}_{k} c)""")
        source = f"rows_{tag}_{k}"
    return source


_HOLED_NULL = f"(SELECT * REPLACE (CASE WHEN isnan(l_tax) THEN NULL ELSE l_tax END AS l_tax), l_extendedprice / 1000 AS y FROM {HOLED_SQL})"


def _boosted(rounds: int, rate: float, train: str = "true", watch: bool = False, report: str = "", leaves: int = 3, only: str = "") -> str:
    """``rounds`` trees of ``leaves`` leaves on squared error; ``report`` selects from their cuts and outputs."""
    ctes = [f"start AS (SELECT avg(y) FILTER (WHERE {train}) AS s FROM {_HOLED_NULL})", f"at_0 AS (SELECT r.*, s, {train} AS own FROM {_HOLED_NULL} r, start)"]
    losses = []
    for t in range(rounds):
        ctes.append(f"seen_{t} AS (SELECT *, 0 AS leaf, s - y AS g, {_D(1)} AS h FROM at_{t} WHERE own)")
        last = _grown(ctes, f"seen_{t}", f"t{t}", leaves, only=only)
        # rows that only measure go the same way
        steps = [f"cut_t{t}_{k}" for k in range(leaves - 1)]
        value = " ".join(f"WHEN '{f}' THEN r.{f}" for f in _FEATURES)
        ctes.append(f"walk_{t}_0 AS (SELECT *, 0 AS leaf FROM at_{t})")
        for k, c in enumerate(steps):
            ctes.append(f"walk_{t}_{k + 1} AS (SELECT r.* REPLACE (CASE WHEN r.leaf <> c.leaf THEN r.leaf WHEN CASE c.f {value} END <= c.v THEN {2 * k + 1} ELSE {2 * k + 2} END AS leaf) FROM walk_{t}_{k} r, {c} c)")
        ctes.append(f"outputs_{t} AS (SELECT leaf, -sum(g) / sum(h) AS value FROM {last} GROUP BY 1)")
        ctes.append(f"routed_{t} AS (SELECT * FROM walk_{t}_{leaves - 1})")
        ctes.append(f"at_{t + 1} AS (SELECT r.* EXCLUDE (leaf) REPLACE (s + {_D(rate)} * value AS s) FROM routed_{t} r JOIN outputs_{t} USING (leaf))")
        losses.append(f"SELECT CAST({t} AS INTEGER) AS round, round(avg((s - y) * (s - y)), 6) AS loss FROM at_{t + 1} WHERE NOT own")
    if watch:
        return f"WITH {', '.join(ctes)} {' UNION ALL '.join(losses)}"
    if report:
        return f"WITH RECURSIVE {', '.join(ctes)} {report}"
    t = rounds - 1
    return f"WITH {', '.join(ctes)} SELECT CAST(leaf AS INTEGER) AS leaf, count(*) AS n, round(avg(y), 4) AS mean, round(max(s + {_D(rate)} * value), 4) AS score FROM routed_{t} JOIN outputs_{t} USING (leaf) GROUP BY 1"


def _quantile_sql(share: float, rate: float) -> str:
    ctes = [f"start AS (SELECT quantile_cont(y, {share}) AS s FROM {_HOLED_NULL})", f"seen AS (SELECT r.*, s, 0 AS leaf, CASE WHEN s >= y THEN {_D(1 - share)} ELSE {_D(-share)} END AS g, {_D(1)} AS h FROM {_HOLED_NULL} r, start)"]
    last = _grown(ctes, "seen", "q", 3)
    return f"WITH {', '.join(ctes)} SELECT CAST(leaf AS INTEGER) AS leaf, count(*) AS n, round(avg(y), 4) AS mean, round(max(s) + {_D(rate)} * quantile_cont(y - s, {share}), 4) AS score FROM {last} GROUP BY 1"


def _classes_sql(rate: float = 0.5) -> str:
    source = f"(SELECT *, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS class FROM {_HOLED_NULL})"
    ctes, parts = [f"shares AS (SELECT class, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS p FROM {source} GROUP BY 1)"], []
    for k in range(3):
        ctes.append(f"seen_{k} AS (SELECT r.*, 0 AS leaf, p - CASE WHEN r.class = {k} THEN 1 ELSE 0 END AS g, p * (1 - p) AS h FROM {source} r, (SELECT p FROM shares WHERE class = {k}))")
        _grown(ctes, f"seen_{k}", f"c{k}", 2)
        parts.append(f"""SELECT CAST({k} AS INTEGER) AS class, f AS feature, round(v, 5) AS threshold, CAST(ln AS BIGINT) AS left_n, CAST(an - ln AS BIGINT) AS right_n,
          round(-lg / lh, 5) AS left_value, round(-(ag - lg) / (ah - lh), 5) AS right_value FROM cut_c{k}_0""")
    return f"WITH {', '.join(ctes)} {' UNION ALL '.join(parts)}"


def _priced_sql() -> str:
    """Two cuts on squared error; the second one does not pay for the first one's feature again."""
    once = "CASE f " + " ".join(f"WHEN '{f}' THEN {_D(v)}" for f, v in _ONCE.items()) + " ELSE 0 END"
    each = "CASE f " + " ".join(f"WHEN '{f}' THEN {_D(v)}" for f, v in _EACH.items()) + " ELSE 0 END"
    ctes, source = [f"seen AS (SELECT r.*, 0 AS leaf, avg(y) OVER () - y AS g, {_D(1)} AS h FROM {_HOLED_NULL} r)"], "seen"
    for k in range(2):
        _grown(ctes, source, f"p{k}", 2)
        ctes.pop()  # rows and best cut without prices
        ctes.pop()
        price = f"({once} + {each} * (SELECT count(*) FROM {source} z WHERE z.leaf = c.leaf))"
        paid = price if k == 0 else f"CASE WHEN f = (SELECT f FROM cut_0) THEN 0 ELSE {price} END"
        ctes.append(f"""gains_{k} AS (SELECT *, (lg * lg / lh + (ag - lg) * (ag - lg) / (ah - lh) - ag * ag / ah) / 2 - {paid} AS gain FROM cuts_p{k}_0 c WHERE v IS NOT NULL AND ln >= 20 AND an - ln >= 20)""")
        ctes.append(f"cut_{k} AS (SELECT * FROM gains_{k} WHERE gain > 0 QUALIFY row_number() OVER (ORDER BY gain DESC, leaf, f, v) = 1)")
        value = " ".join(f"WHEN '{f}' THEN r.{f}" for f in _FEATURES)
        ctes.append(f"parted_{k} AS (SELECT r.* REPLACE (CASE WHEN r.leaf <> c.leaf THEN r.leaf WHEN CASE c.f {value} END <= c.v THEN {2 * k + 1} ELSE {2 * k + 2} END AS leaf) FROM {source} r, cut_{k} c)")
        source = f"parted_{k}"
    cuts = " UNION ALL ".join(f"SELECT CAST(leaf AS INTEGER) AS leaf, f AS feature, round(v, 3) AS threshold, round(gain, 3) AS gain FROM cut_{k}" for k in range(2))
    return f"WITH {', '.join(ctes)} {cuts}"


def _linear_sql() -> str:
    """One cut, then a ridge regression of each leaf's residuals on the cut feature."""
    source = f"(SELECT * REPLACE (l_quantity * l_quantity / 100 + l_extendedprice / 10000 AS y) FROM {_HOLED_NULL})"
    ctes = [f"seen AS (SELECT r.*, 0 AS leaf, avg(y) OVER () - y AS g, {_D(1)} AS h FROM {source} r)"]
    last = _grown(ctes, "seen", "l", 2)
    value = " ".join(f"WHEN '{f}' THEN {f}" for f in _FEATURES)
    ctes.append(f"x AS (SELECT r.leaf, g, CASE f {value} END AS x, f FROM (SELECT * FROM {last}) r, (SELECT f FROM cut_l_0))")
    ctes.append("m AS (SELECT leaf, f, count(*) AS every, count(x) AS n, sum(x) AS sx, sum(x * x) AS sxx, sum(g) FILTER (WHERE x IS NOT NULL) AS sg, sum(g * x) AS sgx FROM x GROUP BY 1, 2)")
    return f"""WITH {", ".join(ctes)} SELECT CAST(leaf AS INTEGER) AS leaf, every AS n, f AS feature,
        round(-((sxx + 1) * sg - sx * sgx) / (n * (sxx + 1) - sx * sx), 4) AS intercept, round(-(n * sgx - sx * sg) / (n * (sxx + 1) - sx * sx), 4) AS slope FROM m"""


def _stopped_sql(rounds: int, patience: int, delta: float) -> str:
    """How many trees are left once the held-out loss has not fallen by ``delta`` for ``patience`` rounds."""
    losses = " UNION ALL ".join(f"SELECT {t} AS k, avg((s - y) * (s - y)) AS m FROM at_{t + 1} WHERE NOT own" for t in range(rounds))
    report = f"""
        , losses AS ({losses}),
        watch(k, best, best_round) AS (
          SELECT 0, m, 0 FROM losses WHERE k = 0
          UNION ALL
          SELECT w.k + 1, CASE WHEN best - m > {delta} THEN m ELSE best END, CASE WHEN best - m > {delta} THEN w.k + 1 ELSE best_round END
          FROM watch w JOIN losses l ON l.k = w.k + 1 WHERE w.k - best_round < {patience})
        SELECT CAST(CASE WHEN k - best_round >= {patience} THEN best_round + 1 ELSE {rounds} END AS INTEGER) AS trees, round(best, 4) AS best FROM watch WHERE k = (SELECT max(k) FROM watch)"""
    return _boosted(rounds, 0.5, "l_orderkey % 4 <> 0", report=report, leaves=5)


_LEAF = f"CASE WHEN l_quantity <= {_D(24.5)} THEN CASE WHEN coalesce(l_discount <= {_D(0.045)}, false) THEN 3 ELSE 4 END WHEN coalesce(l_tax <= {_D(0.035)}, true) THEN 5 ELSE 6 END"

ORACLE = {
    "objective_robust": _robust_sql(),
    "objective_lambdarank": f"""
        WITH r AS (SELECT *, l_quantity / {_D(25)} AS s, power({_D(2)}, l_partkey % 4) - 1 AS gain, row_number() OVER (ORDER BY {", ".join(KEY)}) AS id FROM lineitem),
        p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY s DESC, {", ".join(KEY)}) - 1 AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY gain DESC, id) - 1 AS ideal FROM r),
        b AS (SELECT *, 1 / log2(pos + 2) AS cut, sum(CASE WHEN ideal < 3 THEN gain / log2(ideal + 2) ELSE 0 END) OVER (PARTITION BY l_orderkey) AS best FROM p),
        pairs AS (
          SELECT x.id AS better, y.id AS worse, abs(x.gain - y.gain) * abs(x.cut - y.cut) / x.best AS change, 1 / (1 + exp(x.s - y.s)) AS rho
          FROM b x JOIN b y ON x.l_orderkey = y.l_orderkey AND x.gain > y.gain AND least(x.pos, y.pos) < 3),
        each AS (SELECT better AS id, -rho * change AS g, rho * (1 - rho) * change AS h FROM pairs UNION ALL SELECT worse, rho * change, rho * (1 - rho) * change FROM pairs),
        sums AS (SELECT l_linestatus, coalesce(sum(g), 0) AS g, coalesce(sum(h), 0) AS h FROM r LEFT JOIN each USING (id) GROUP BY id, l_linestatus)
        SELECT l_linestatus, round(sum(g), 4) AS g, round(sum(g * g), 4) AS g2, round(sum(h), 4) AS h FROM sums GROUP BY 1""",
    "boosted_regression": _boosted(5, 0.3, leaves=5, report="SELECT round(avg((s - y) * (s - y)), 4) AS mse, round(var_pop(y), 4) AS variance FROM at_5"),
    "boosted_early_stop": _stopped_sql(6, 2, 1.0),
    "renewed_leaves": f"""
        WITH r AS (SELECT CAST({_LEAF} AS INTEGER) AS leaf, y - 30 AS d, 1 / greatest(abs(y), 1) AS w FROM {_HOLED_NULL}),
        m AS (SELECT leaf, median(d) AS med, quantile_cont(d, 0.75) AS upper FROM r GROUP BY 1),
        v AS (SELECT leaf, d, sum(w) AS w FROM r GROUP BY 1, 2),
        c AS (SELECT leaf, d, sum(w) OVER (PARTITION BY leaf ORDER BY d) AS upto, sum(w) OVER (PARTITION BY leaf) AS total FROM v)
        SELECT 'l1' AS loss, leaf, round(med, 4) AS value FROM m
        UNION ALL SELECT 'quantile', leaf, round(upper, 4) FROM m
        UNION ALL SELECT 'mape', leaf, round(min(d), 4) FROM c WHERE upto >= total / 2 GROUP BY leaf
        UNION ALL SELECT 'huber', leaf, round(any_value(med) + avg(greatest(least(d - med, 5), -5)), 4) FROM r JOIN m USING (leaf) GROUP BY leaf""",
    "boosted_one_round": _boosted(1, 0.3),
    "tree_importance": _boosted(1, 0.3, report="""
        , cuts AS (SELECT f, gain, an FROM cut_t0_0 UNION ALL SELECT f, gain, an FROM cut_t0_1),
        kinds AS (SELECT 'split' AS kind, f, 1.0 AS v FROM cuts UNION ALL SELECT 'gain', f, gain FROM cuts UNION ALL SELECT 'cover', f, CAST(an AS DOUBLE) FROM cuts),
        sums AS (SELECT kind, f, CAST(sum(v) AS DOUBLE) AS v FROM kinds GROUP BY 1, 2)
        SELECT kind, f AS feature, round(v, 4) AS value, round(v / sum(v) OVER (PARTITION BY kind), 4) AS share FROM sums"""),
    "tree_shape": _boosted(1, 0.3, report="""
        SELECT CAST(3 AS INTEGER) AS leaves, CAST(2 AS INTEGER) AS depth, round(0.3 * sum(value * n) / sum(n), 5) AS expected, round(min(0.3 * value), 5) AS lowest, round(max(0.3 * value), 5) AS highest, (SELECT f FROM cut_t0_0) AS branch
        FROM outputs_0 JOIN (SELECT leaf, count(*) AS n FROM routed_0 GROUP BY 1) USING (leaf)"""),
    "node_features": _boosted(1, 0.3, report=f"""
        , paths AS (SELECT 3 - b.leaf AS leaf, [a.f] AS path FROM cut_t0_0 a, cut_t0_1 b UNION ALL SELECT unnest([3, 4]), [a.f, b.f] FROM cut_t0_0 a, cut_t0_1 b)
        SELECT CAST(leaf AS INTEGER) AS leaf, f AS feature FROM paths, (SELECT unnest({_FEATURES}) AS f)
        WHERE list_contains(path, f) OR {" OR ".join(f"(list_has_all({sorted(group)}, path) AND list_contains({sorted(group)}, f))" for group in _TOGETHER)}"""),
    "constrained_tree": _boosted(1, 0.3, only="(f = 'l_discount') = (first = 'l_discount')"),
    "priced_features": _priced_sql(),
    "boosted_linear": _linear_sql(),
    "boosted_two_rounds": _boosted(2, 0.3),
    "boosted_quantile": _quantile_sql(0.9, 0.5),
    "watched_losses": _boosted(2, 0.3, "l_partkey % 5 <> 0", watch=True),
    "boosted_classes": _classes_sql(),
    "bundled_histogram": """
        WITH r AS (SELECT CASE WHEN l_linestatus = 'O' THEN 1 ELSE 2 END AS leaf, l_extendedprice / 1000 - 30 AS g, l_tax + CAST(0.5 AS DOUBLE) AS h,
          CASE WHEN l_returnflag = 'A' THEN l_linenumber ELSE 0 END AS a, CASE WHEN l_returnflag = 'N' THEN CAST(ceil(l_quantity / 10) AS INTEGER) ELSE 0 END AS n,
          CASE WHEN l_returnflag = 'R' THEN CAST(round(l_discount * 100) AS INTEGER) ELSE 0 END AS r FROM lineitem)
        SELECT CAST(leaf AS INTEGER) AS leaf, f AS feature, CAST(b AS INTEGER) AS bin, round(sum(g), 3) AS sum_g, round(sum(h), 3) AS sum_h, count(*) AS n, CAST(1 AS INTEGER) AS bundles FROM (
          SELECT leaf, g, h, 'a' AS f, a AS b FROM r UNION ALL SELECT leaf, g, h, 'n', n FROM r UNION ALL SELECT leaf, g, h, 'r', r FROM r) GROUP BY 2, 1, 3""",
}
