"""Queries over objectives, trees, their importance and leaves, and histograms of other forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import binning, boosting, histogram, impute, profile, sampling, scale, split, trees
from timberline.plans.common import FEATURES, HOLED_SQL, KEY, holed, lineitem, rounded
from timberline.plans.models import _ONE, _TWO, SECOND, TREE
from timberline.plans.splitting import _BINNED, CUTS, _binned, _cuts, _hist
from timberline.session import read_table

_KINDS = ("regression", "l1", "binary", "poisson", "gamma", "tweedie")


def objectives(spark, sf_dir):
    """Sums of gradients and hessians of every loss, by line status."""
    df = lineitem(spark, sf_dir).withColumn("y", F.col("l_tax") + 0.5).withColumn("s", F.col("l_quantity") / 25 - 1)
    sums = []
    for kind in _KINDS:
        g, h = boosting.objective(kind, F.col("y"), F.col("s"))
        sums += [F.round(F.sum(g), 4).alias(f"{kind}_g"), F.round(F.sum(h), 4).alias(f"{kind}_h")]
    return df.groupBy("l_linestatus").agg(*sums)


def objective_multiclass(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    y = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    scores = F.array(F.col("l_quantity") / 25, F.col("l_discount") * 10, F.col("l_tax") * 10)
    sums = []
    for k in range(3):
        g, h = boosting.softmax_objective(y, scores, k)
        sums += [F.round(F.sum(g), 3).alias(f"g{k}"), F.round(F.sum(h), 3).alias(f"h{k}")]
    return df.agg(*sums)


def objective_ranking(spark, sf_dir):
    """Sums of the listwise gradients and hessians, an order being a query."""
    df = lineitem(spark, sf_dir).withColumn("y", F.pmod(F.col("l_linenumber"), F.lit(3)).cast("double"))
    out = boosting.ranking_gradients(df, "l_orderkey", "y", F.col("l_quantity") / 25, KEY)
    return out.groupBy("l_linestatus").agg(F.round(F.sum("g"), 4).alias("g"), F.round(F.sum(F.col("g") * F.col("g")), 4).alias("g2"), F.round(F.sum("h"), 4).alias("h"))


def category_cuts(spark, sf_dir):
    """The best set of return flags and modes to send left, their bins in the order of gradient to hessian."""
    df = lineitem(spark, sf_dir)
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    binned = df.select((F.col("l_extendedprice") / 1000 - 30).alias("g"), F.lit(1.0).alias("h"), flag.alias("bin_flag"), (F.col("l_linenumber") - 1).cast("int").alias("bin_line"))
    cuts = split.best_splits(histogram.histograms(binned, ["flag", "line"]).withColumn("leaf", F.when(F.col("feature") == "flag", 0).otherwise(1)), min_data=1, unordered={"flag": 99, "line": 99}, category_smooth=10.0)
    return cuts.select("feature", F.array_join(F.array_sort("bins"), ",").alias("bins"), F.round("left_g", 3).alias("left_g"), "left_n", F.round("gain", 2).alias("gain"))


def refitted_leaves(spark, sf_dir):
    """Outputs of a tree's leaves drawn halfway towards those of all rows."""
    df = holed(spark, sf_dir).withColumn("g", F.col("l_extendedprice") / 1000 - 30).withColumn("h", F.lit(1.0))
    new = trees.refit(df, TREE, l2=1.0, decay=0.5)
    rows = [(i, round(new.nodes[i].value, 4), new.nodes[i].count) for i in new.leaves()]
    return spark.createDataFrame(rows, "leaf int, value double, n long")


def tree_round_trip(spark, sf_dir):
    """Scores of a tree that went through text, of one that went through JSON, and of the SQL that it exports."""
    text, again = trees.from_text(trees.to_text(TREE)), trees.from_json(trees.to_json(SECOND))
    df = holed(spark, sf_dir).withColumn("l_tax", F.nanvl("l_tax", F.lit(None).cast("double")))
    return df.groupBy("l_linenumber").agg(F.round(F.sum(trees.score_expression(text)), 4).alias("first"), F.round(F.sum(trees.score_expression(again)), 4).alias("second"), F.round(F.sum(F.expr(trees.to_sql(TREE)).cast("double")), 4).alias("exported"))


def leaf_numbers(spark, sf_dir):
    model = boosting.Ensemble([TREE, SECOND])
    return holed(spark, sf_dir).groupBy(F.array_join(model.leaves(), ",").alias("leaves")).agg(F.count("*").alias("n"))


def score_first_trees(spark, sf_dir):
    model = boosting.Ensemble([TREE, SECOND], 0.25)
    one = model.predict(holed(spark, sf_dir), upto=1, name="one")
    return model.prune(2).predict(one, name="two").groupBy("l_linestatus").agg(F.round(F.sum("one"), 3).alias("one"), F.round(F.sum("two"), 3).alias("two"))


_LINEAR = trees.Tree([trees.Node("l_quantity", 24.5, 0, left=1, right=2, count=2), trees.Node(value=1.0, linear={"": 0.5, "l_discount": 2.0}, count=1), trees.Node(value=-1.0, linear={"": 0.25, "l_tax": -3.0}, count=1)], 0.5)


def score_linear_leaves(spark, sf_dir):
    return holed(spark, sf_dir).groupBy("l_linestatus").agg(F.round(F.sum(trees.score_expression(_LINEAR)), 4).alias("total"))


def fit_linear_leaves(spark, sf_dir):
    """Intercept and slope of each leaf's ridge regression."""
    df = holed(spark, sf_dir).withColumn("g", 1.0 - F.col("l_extendedprice") / 1000).withColumn("h", F.lit(1.0))
    tree = trees.Tree([trees.Node("l_quantity", 24.5, 0, left=1, right=2, count=2), trees.Node(), trees.Node()])
    fitted = trees.refit_linear(df, tree, ["l_discount"], l2=1.0)
    rows = [(i, round(fitted.nodes[i].linear[""], 3), round(fitted.nodes[i].linear["l_discount"], 3)) for i in fitted.leaves()]
    return spark.createDataFrame(rows, "leaf int, intercept double, slope double")


def contributions(spark, sf_dir):
    model = boosting.Ensemble([TREE, SECOND])
    dealt = boosting.approximate_contributions(trees.importance(model.trees, "gain"), model.raw(), 0.125)
    return holed(spark, sf_dir).select(dealt.alias("c")).agg(*[F.round(F.sum(F.col("c")[i]), 3).alias(f"c{i}") for i in range(5)])


def compared_models(spark, sf_dir):
    df = holed(spark, sf_dir).withColumn("y", F.col("l_discount") * 10)
    out = boosting.compare(df, {"one": boosting.Ensemble([TREE]), "both": boosting.Ensemble([TREE, SECOND])}, "y")
    return rounded(out, 6, "one", "both")


def stop_rules(spark, sf_dir):
    flags = [True, False, False]
    rows = [(rule, boosting.combine_stops(flags, rule, 1)) for rule in ("any", "all", "majority", "primary")]
    return spark.createDataFrame(rows, "rule string, stops boolean")


def sparse_histogram(spark, sf_dir):
    """The root histogram again, from the cells off their default bins only."""
    binned = _binned(spark, sf_dir)
    defaults = {"l_quantity": 0, "l_discount": 5, "l_tax": 0}
    rows = binned.select(F.concat_ws("|", *KEY).alias("row_id"), "g", "h")
    long = binned.select(F.concat_ws("|", *KEY).alias("row_id"), *[F.col("bin_" + f).alias(f) for f in defaults]).unpivot(["row_id"], list(defaults), "feature", "bin")
    off = F.lit(False)
    for f, k in defaults.items():
        off = off | ((F.col("feature") == f) & (F.col("bin") != k))
    return rounded(histogram.sparse_histograms(long.where(off), rows, defaults), 4, "sum_g", "sum_h")


def quantised_histogram(spark, sf_dir):
    """Histogram of whole-number gradients: rows, and whether its sums are within one step a row."""
    rows = histogram.quantised(_binned(spark, sf_dir), "g", "h", 64, 1, KEY)
    sums = rows.groupBy(F.col("bin_l_quantity").alias("bin")).agg(F.count("*").alias("n"), F.sum("g").alias("g"), (F.sum("qg") * F.first("scale_g")).alias("q"), F.first("scale_g").alias("step"))
    return sums.select("bin", "n", (F.abs(F.col("g") - F.col("q")) <= F.col("n") * F.col("step")).alias("close"))


def constant_hessian_histogram(spark, sf_dir):
    return rounded(histogram.histograms(_binned(spark, sf_dir), list(CUTS), hessian=None).drop("leaf"), 4, "sum_g", "sum_h")


def bundled_features(spark, sf_dir):
    pairs = histogram.conflicts(_binned(spark, sf_dir), {"l_quantity": 0, "l_discount": 5, "l_tax": 4})
    return spark.createDataFrame([(i, f) for i, b in enumerate(histogram.bundles(pairs, list(CUTS), 0)) for f in b], "bundle int, feature string")


def best_split_with_costs(spark, sf_dir):
    """The best cut where one feature's cuts cost something and another's outputs must not fall."""
    hist = histogram.histograms(_binned(spark, sf_dir), list(CUTS), leaf=F.col("l_linenumber"))
    best = split.best_splits(hist, digits=6, l1=0.0, l2=1.0, min_data=20, penalty={"l_quantity": 0.5}, monotone={"l_discount": 1})
    return rounded(best.select("leaf", "feature", "bin", "gain"), 4, "gain")


def smoothed_values(spark, sf_dir):
    """Leaf values drawn towards the root's."""
    hist = histogram.histograms(_binned(spark, sf_dir), ["l_tax"])
    root = split.leaf_value(F.sum("sum_g").over(_all()), F.sum("sum_h").over(_all()), 0.0, 1.0)
    own = split.leaf_value(F.col("sum_g"), F.col("sum_h"), 0.0, 1.0)
    return hist.select("bin", F.round(split.smoothed(own, root, F.col("sum_h"), 10.0), 6).alias("value"))


def _all():
    from pyspark.sql.window import Window

    return Window.partitionBy("leaf", "feature")  # bins of one feature


def cut_information(spark, sf_dir):
    m = binning.Mapper("l_quantity", bounds=tuple(CUTS["l_quantity"]), lowest=-1.0, highest=1e9)
    return rounded(binning.cut_gains(lineitem(spark, sf_dir), m, "l_returnflag"), 8, "gain")


def binning_strategies(spark, sf_dir):
    return binning.choose_strategy(lineitem(spark, sf_dir), FEATURES, 32)


def bin_training_categorical(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    m = binning.fit_training_categorical(part, "p_size", 20, 1)
    return part.groupBy(binning.to_bin(F.col("p_size"), m).alias("bin")).agg(F.count("*").alias("n"))


def common_bin(spark, sf_dir):
    m = binning.Mapper("l_discount", bounds=tuple(CUTS["l_discount"]), lowest=-1.0, highest=1e9)
    b, rate = binning.most_frequent_bin(lineitem(spark, sf_dir), m, 0.2)
    return spark.createDataFrame([(b, round(rate, 6))], "bin int, rate double")


def usable_features(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("flat", F.lit(1.0)).withColumn("rare", (F.col("l_linenumber") > 100).cast("double"))
    mappers = [binning.Mapper(f, bounds=(0.5, 2.0), lowest=-1.0, highest=1e9) for f in ("flat", "rare")] + [binning.Mapper("l_quantity", bounds=(25.0, 60.0), lowest=-1.0, highest=1e9)]
    return spark.createDataFrame([(m.feature,) for m in binning.usable_features(df, mappers, 20)], "feature string")


def automatic_bins(spark, sf_dir):
    """Settings for the sizes of some tables."""
    sizes = {t: read_table(spark, sf_dir, t).count() for t in ("nation", "customer", "orders", "lineitem", "events")}
    return spark.createDataFrame([(t, n, *binning.auto_settings(n)) for t, n in sizes.items()], "table string, n long, max_bins int, min_data int")


def complete_rows(spark, sf_dir):
    """Rows left, and features kept, when what is missing goes."""
    df = holed(spark, sf_dir)
    kept = impute.drop_sparse_features(df, FEATURES, 0.25)
    return impute.drop_missing_rows(impute.drop_missing_rows(df, "l_discount"), "l_tax").agg(F.count("*").alias("n"), F.lit(",".join(kept)).alias("features"))


def chosen_features(spark, sf_dir):
    """Features that the variance, correlation and count rules leave."""
    df = lineitem(spark, sf_dir).withColumn("twice", F.col("l_quantity") * 2).withColumn("flat", F.lit(3.0))
    names = [*FEATURES, "twice", "flat"]
    rows = [("variance", ",".join(profile.drop_low_variance(df, names))), ("correlation", ",".join(profile.drop_correlated(df, names, 0.99))), ("first", ",".join(scale.first_features(names, 2)))]
    return spark.createDataFrame(rows, "rule string, features string")


def log_scaled(spark, sf_dir):
    return lineitem(spark, sf_dir).agg(F.round(F.sum(scale.log_transform(F.col("l_extendedprice") - 30000)), 2).alias("total"))


def class_count(spark, sf_dir):
    return sampling.class_count(read_table(spark, sf_dir, "embeddings"), "label")


def score_early_stop_multiclass(spark, sf_dir):
    one, two = trees.score_expression(TREE), trees.score_expression(SECOND)
    stages = F.array(F.array(one, two, F.lit(0.0)), F.array(two, two, F.lit(0.5)), F.array(one, F.lit(0.0), two))
    return holed(spark, sf_dir).groupBy(boosting.staged_stop(stages, "multiclass", 0.9, 1).alias("used")).agg(F.count("*").alias("n"))


def confidence_stops(spark, sf_dir):
    """The confidence rule on logs of growing length."""
    log = spark.range(1, 41).select("id", F.transform(F.sequence(F.lit(1), F.col("id").cast("int")), lambda i: 1 - 0.5 / (i * i)).alias("log"))
    return log.select("id", boosting.confidence_stop(F.col("log"), 0.9, 4, 6).alias("stops"))


QUERIES = {
    f.__name__: f
    for f in (
        objectives, objective_multiclass, objective_ranking, category_cuts, refitted_leaves, tree_round_trip, leaf_numbers, score_first_trees, score_linear_leaves, fit_linear_leaves, contributions, compared_models, stop_rules,
        sparse_histogram, quantised_histogram, constant_hessian_histogram, bundled_features, best_split_with_costs, smoothed_values, cut_information, binning_strategies, bin_training_categorical, common_bin,
        usable_features, automatic_bins, complete_rows, chosen_features, log_scaled, class_count, score_early_stop_multiclass, confidence_stops,
    )
}

_D = "CAST({} AS DOUBLE)".format
_LEAF_ONE = f"CASE WHEN l_quantity <= {_D(24.5)} THEN CASE WHEN coalesce(l_discount <= {_D(0.045)}, false) THEN 3 ELSE 4 END WHEN coalesce(l_tax <= {_D(0.035)}, true) THEN 5 ELSE 6 END"
_P = "exp(s{k} - m) / (exp(s0 - m) + exp(s1 - m) + exp(s2 - m))"


def _objectives_sql() -> str:
    p = "(1 / (1 + exp(-s)))"
    forms = {
        "regression": ("s - y", _D(1)),
        "l1": ("CASE WHEN s > y THEN 1.0 WHEN s < y THEN -1.0 ELSE 0.0 END", _D(1)),
        "binary": (f"{p} - y", f"{p} * (1 - {p})"),
        "poisson": ("exp(s) - y", "exp(s)"),
        "gamma": ("1 - y * exp(-s)", "y * exp(-s)"),
        "tweedie": (f"-y * exp({_D(-0.5)} * s) + exp({_D(0.5)} * s)", f"y * {_D(0.5)} * exp({_D(-0.5)} * s) + {_D(0.5)} * exp({_D(0.5)} * s)"),
    }
    sums = ", ".join(f"round(CAST(sum({g}) AS DOUBLE), 4) AS {k}_g, round(sum({h}), 4) AS {k}_h" for k, (g, h) in forms.items())
    return f"SELECT l_linestatus, {sums} FROM (SELECT l_linestatus, l_tax + {_D(0.5)} AS y, l_quantity / 25 - 1 AS s FROM lineitem) GROUP BY 1"


def _classes_sql() -> str:
    sums = ", ".join(f"round(sum({_P.format(k=k)} - CASE WHEN y = {k} THEN 1 ELSE 0 END), 3) AS g{k}, round(sum({_P.format(k=k)} * (1 - {_P.format(k=k)})), 3) AS h{k}" for k in range(3))
    return f"""SELECT {sums} FROM (SELECT *, greatest(s0, s1, s2) AS m FROM (
        SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS y, l_quantity / 25 AS s0, l_discount * 10 AS s1, l_tax * 10 AS s2 FROM lineitem))"""


def _sparse_sql() -> str:
    source = _BINNED
    missing_first = {"l_quantity": "b_l_quantity", "l_discount": "b_l_discount", "l_tax": "b_l_tax"}
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, CAST({b} AS INTEGER) AS bin, round(CAST(sum(g) AS DOUBLE), 4) AS sum_g, round(sum(h), 4) AS sum_h, count(*) AS n FROM {source} GROUP BY 2" for f, b in missing_first.items())


_RIDGE = """
    SELECT CAST(leaf AS INTEGER) AS leaf, round(-((sxx + 1) * sg - sx * sgx) / (n * (sxx + 1) - sx * sx), 3) AS intercept, round(-(n * sgx - sx * sg) / (n * (sxx + 1) - sx * sx), 3) AS slope FROM (
      SELECT CASE WHEN l_quantity <= 24.5 THEN 1 ELSE 2 END AS leaf, count(*) AS n, sum(l_discount) AS sx, sum(l_discount * l_discount) AS sxx, sum(1 - l_extendedprice / 1000) AS sg, sum((1 - l_extendedprice / 1000) * l_discount) AS sgx
      FROM {source} WHERE l_discount IS NOT NULL GROUP BY 1)"""
_BITS = "CASE WHEN {0} > 0 THEN {0} * log2({0}) ELSE 0 END"

def _chosen_sql() -> str:
    names = [*FEATURES, "twice", "flat"]
    source = "(SELECT *, l_quantity * 2 AS twice, CAST(3 AS DOUBLE) AS flat FROM lineitem)"
    varied = " UNION ALL ".join(f"SELECT {k} AS k, '{f}' AS f FROM {source} HAVING var_pop({f}) > 0.01" for k, f in enumerate(names))
    # a feature goes if one before it is too close; none that goes is close to another here
    close = " UNION ALL ".join(f"SELECT {j} AS k FROM {source} HAVING count(*) > 1 AND stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 AND abs(corr({a}, {b})) > 0.99" for i, a in enumerate(names) for j, b in enumerate(names) if i < j and b != "flat")
    every = ", ".join(f"({k}, '{f}')" for k, f in enumerate(names))
    return f"""SELECT 'variance' AS rule, string_agg(f, ',' ORDER BY k) AS features FROM ({varied})
        UNION ALL SELECT 'correlation', string_agg(f, ',' ORDER BY k) FROM (VALUES {every}) v(k, f) WHERE k NOT IN (SELECT k FROM ({close}))
        UNION ALL SELECT 'first', string_agg(f, ',' ORDER BY k) FROM (VALUES {every}) v(k, f) WHERE k < 2"""


ORACLE = {
    "objectives": _objectives_sql(),
    "objective_multiclass": _classes_sql(),
    "objective_ranking": f"""
        WITH r AS (SELECT *, l_quantity / {_D(25)} AS s, CAST((1 << CAST(l_linenumber % 3 AS INTEGER)) - 1 AS DOUBLE) AS gain FROM lineitem),
        t AS (SELECT *, max(s) OVER (PARTITION BY l_orderkey) AS top, sum(gain) OVER (PARTITION BY l_orderkey) AS gains FROM r),
        p AS (SELECT *, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY l_orderkey) AS p FROM t),
        g AS (SELECT l_linestatus, CASE WHEN gains > 0 THEN p - gain / gains ELSE 0 END AS g, CASE WHEN gains > 0 THEN p * (1 - p) ELSE 0 END AS h FROM p)
        SELECT l_linestatus, round(sum(g), 4) AS g, round(sum(g * g), 4) AS g2, round(sum(h), 4) AS h FROM g GROUP BY 1""",
    "category_cuts": f"""
        WITH r AS (SELECT l_extendedprice / 1000 - 30 AS g, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag, l_linenumber - 1 AS line FROM lineitem),
        b AS (SELECT 'flag' AS feature, flag AS bin, sum(g) AS g, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'line', line, sum(g), count(*) FROM r GROUP BY 2),
        c AS (SELECT feature, list_sort(list(bin) OVER w) AS bins, sum(g) OVER w AS lg, sum(n) OVER w AS ln, sum(g) OVER (PARTITION BY feature) AS ag, sum(n) OVER (PARTITION BY feature) AS an FROM b WINDOW w AS (PARTITION BY feature ORDER BY g / (n + 10), bin ROWS UNBOUNDED PRECEDING)),
        k AS (SELECT *, (lg * lg / ln + (ag - lg) * (ag - lg) / (an - ln) - ag * ag / an) / 2 AS gain FROM c WHERE ln < an)
        SELECT feature, array_to_string(bins, ',') AS bins, round(lg, 3) AS left_g, CAST(ln AS BIGINT) AS left_n, round(gain, 2) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC) AS i FROM k) WHERE i = 1""",
    "refitted_leaves": f"""
        SELECT CAST(leaf AS INTEGER) AS leaf, round({_D(0.5)} * old + {_D(0.5)} * -sum(l_extendedprice / 1000 - 30) / (count(*) + 1), 4) AS value, count(*) AS n FROM
          (SELECT {_LEAF_ONE} AS leaf, l_extendedprice FROM {HOLED_SQL}) JOIN (VALUES OLDVALUES) v(leaf2, old) ON leaf = leaf2 GROUP BY leaf, old""".replace("OLDVALUES", ", ".join(f"({i}, CAST({TREE.nodes[i].value} AS DOUBLE))" for i in TREE.leaves())),
    "tree_round_trip": f"SELECT l_linenumber, round(sum({_ONE}), 4) AS first, round(CAST(sum({_TWO}) AS DOUBLE), 4) AS second, round(sum({_ONE}), 4) AS exported FROM {HOLED_SQL} GROUP BY 1",
    "leaf_numbers": f"SELECT CAST({_LEAF_ONE} AS VARCHAR) || ',' || CASE WHEN l_linenumber IN (1, 4, 6) THEN '1' ELSE '2' END AS leaves, count(*) AS n FROM {HOLED_SQL} GROUP BY 1",
    "score_first_trees": f"SELECT l_linestatus, round(sum({_D(0.25)} + {_ONE}), 3) AS one, round(sum({_D(0.25)} + {_ONE} + {_TWO}), 3) AS two FROM {HOLED_SQL} GROUP BY 1",
    "score_linear_leaves": f"SELECT l_linestatus, round(sum({_D(0.5)} * CASE WHEN l_quantity <= {_D(24.5)} THEN coalesce({_D(0.5)} + 2 * l_discount, 1) ELSE coalesce({_D(0.25)} - 3 * l_tax, -1) END), 4) AS total FROM {HOLED_SQL} GROUP BY 1",
    "fit_linear_leaves": _RIDGE.format(source=HOLED_SQL),
    "contributions": f"SELECT round(sum(({_ONE} + {_TWO} - {_D(0.125)}) * {_D(0.75)}), 3) AS c0, round(sum(({_ONE} + {_TWO} - {_D(0.125)}) * {_D(0.25)}), 3) AS c1, CAST(0 AS DOUBLE) AS c2, CAST(0 AS DOUBLE) AS c3, round(count(*) * {_D(0.125)}, 3) AS c4 FROM {HOLED_SQL}",
    "compared_models": f"SELECT round(avg(({_ONE} - l_discount * 10) * ({_ONE} - l_discount * 10)), 6) AS one, round(avg(({_ONE} + {_TWO} - l_discount * 10) * ({_ONE} + {_TWO} - l_discount * 10)), 6) AS both FROM {HOLED_SQL}",
    "stop_rules": "SELECT * FROM (VALUES ('any', true), ('all', false), ('majority', false), ('primary', false)) t(rule, stops)",
    "sparse_histogram": _sparse_sql(),
    "quantised_histogram": f"SELECT CAST(b_l_quantity AS INTEGER) AS bin, count(*) AS n, true AS close FROM {_BINNED} GROUP BY 1",
    "constant_hessian_histogram": f"SELECT feature, bin, round(sum_g, 4) AS sum_g, CAST(n AS DOUBLE) AS sum_h, n FROM ({_hist(_BINNED)})",
    # in order, each joins the first bundle in which no row has two features off their defaults
    "bundled_features": f"""
        WITH n AS (SELECT count(*) FILTER (WHERE b_l_quantity <> 0 AND b_l_discount <> 5) AS qd, count(*) FILTER (WHERE b_l_quantity <> 0 AND b_l_tax <> 4) AS qt,
          count(*) FILTER (WHERE b_l_discount <> 5 AND b_l_tax <> 4) AS dt FROM {_BINNED}),
        d AS (SELECT *, CASE WHEN qd = 0 THEN 0 ELSE 1 END AS d FROM n),
        t AS (SELECT *, CASE WHEN qt + CASE WHEN d = 0 THEN dt ELSE 0 END = 0 THEN 0 WHEN d = 1 AND dt = 0 THEN 1 ELSE d + 1 END AS t FROM d)
        SELECT CAST(0 AS INTEGER) AS bundle, 'l_quantity' AS feature UNION ALL SELECT CAST(d AS INTEGER), 'l_discount' FROM d UNION ALL SELECT CAST(t AS INTEGER), 'l_tax' FROM t""",
    "best_split_with_costs": f"""
        SELECT leaf, feature, bin, round(cost, 4) AS gain FROM (
          SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY cost DESC, feature, bin) AS k FROM (
            SELECT *, round(gain - CASE WHEN feature = 'l_quantity' THEN {_D(0.5)} ELSE 0 END, 6) AS cost FROM ({_cuts("l_linenumber", "0", "1")}) WHERE feature <> 'l_discount' OR -rg / (rh + 1) >= -lg / (lh + 1)) WHERE cost > 0) WHERE k = 1""",
    "smoothed_values": f"""
        SELECT bin, round((1 - w) * (-sum_g / (sum_h + 1)) + w * (-ag / (ah + 1)), 6) AS value FROM (
          SELECT *, 10 / (10 + sum_h) AS w, sum(sum_g) OVER () AS ag, sum(sum_h) OVER () AS ah FROM ({_hist(_BINNED)}) WHERE feature = 'l_tax')""",
    "cut_information": f"""
        WITH c AS (SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 WHEN l_quantity <= 30 THEN 2 WHEN l_quantity <= 40 THEN 3 ELSE 4 END AS bin, l_returnflag AS y, count(*) AS n FROM lineitem GROUP BY 1, 2),
        g AS (SELECT b.bin, q.y, CAST(coalesce((SELECT sum(n) FROM c WHERE c.y = q.y AND c.bin <= b.bin), 0) AS DOUBLE) AS l, CAST((SELECT sum(n) FROM c WHERE c.y = q.y) AS DOUBLE) AS a FROM (SELECT DISTINCT bin FROM c) b, (SELECT DISTINCT y FROM c) q)
        SELECT CAST(bin AS INTEGER) AS bin, round(({_BITS.format("sum(a)")} - sum({_BITS.format("a")}) - ({_BITS.format("sum(l)")} - sum({_BITS.format("l")})) - ({_BITS.format("sum(a - l)")} - sum({_BITS.format("(a - l)")}))) / sum(a), 8) AS gain FROM g GROUP BY bin""",
    "binning_strategies": " UNION ALL ".join(f"SELECT '{f}' AS feature, CASE WHEN count(DISTINCT {f}) <= 32 THEN 'distinct' WHEN greatest(max({f}) - avg({f}), avg({f}) - min({f})) <= 3 * stddev_pop({f}) THEN 'uniform' ELSE 'quantile' END AS strategy FROM lineitem" for f in FEATURES),
    "bin_training_categorical": """
        WITH c AS (SELECT p_size, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_size) AS k, sum(count(*)) OVER (ORDER BY count(*) DESC, p_size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM part GROUP BY p_size)
        SELECT CAST(CASE WHEN k <= 19 AND coalesce(before, 0) < 0.99 * (SELECT count(*) FROM part) THEN k ELSE 0 END AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""",
    "common_bin": """
        WITH c AS (SELECT CASE WHEN l_discount <= 0.015 THEN 0 WHEN l_discount <= 0.035 THEN 1 WHEN l_discount <= 0.055 THEN 2 WHEN l_discount <= 0.075 THEN 3 ELSE 4 END AS b, count(*) AS n FROM lineitem GROUP BY 1),
        t AS (SELECT b, n / CAST(sum(n) OVER () AS DOUBLE) AS r, row_number() OVER (ORDER BY n DESC, b) AS k FROM c)
        SELECT CAST(CASE WHEN r < 0.2 THEN 0 ELSE b END AS INTEGER) AS bin, round(CASE WHEN r < 0.2 THEN (SELECT r FROM t WHERE b = 0) ELSE r END, 6) AS rate FROM t WHERE k = 1""",
    "usable_features": " UNION ALL ".join(
        f"SELECT '{f}' AS feature FROM lineitem HAVING " + " OR ".join(f"(count(*) FILTER (WHERE {v} <= {b}) >= 20 AND count(*) FILTER (WHERE {v} > {b}) >= 20)" for b in bounds)
        for f, v, bounds in (("flat", "1.0", (0.5,)), ("rare", "CAST(l_linenumber > 100 AS INTEGER)", (0.5,)), ("l_quantity", "l_quantity", (25.0,)))
    ),
    "automatic_bins": """
        SELECT t AS "table", n, b AS max_bins, CAST(greatest(3, n // (b * 100)) AS INTEGER) AS min_data FROM (
          SELECT *, CASE WHEN n < 1000 THEN 32 WHEN n < 10000 THEN 64 WHEN n < 100000 THEN 128 ELSE 255 END AS b FROM (""" + " UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in ("nation", "customer", "orders", "lineitem", "events")) + "))",
    "complete_rows": f"SELECT count(*) AS n, 'l_quantity,l_extendedprice,l_tax' AS features FROM {HOLED_SQL} WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL",
    "chosen_features": _chosen_sql(),
    "log_scaled": "SELECT round(sum(sign(l_extendedprice - 30000) * ln(1 + abs(l_extendedprice - 30000))), 2) AS total FROM lineitem",
    "class_count": "SELECT CAST(count(DISTINCT label) AS INTEGER) AS classes FROM embeddings",
    "confidence_stops": """
        WITH l AS (SELECT n AS id, i, CAST(1 AS DOUBLE) - CAST(0.5 AS DOUBLE) / (i * i) AS v FROM range(1, 41) a(n), range(1, 41) b(i) WHERE i <= n),
        s AS (SELECT id, avg(v) FILTER (WHERE i > id - 4) AS r, avg(v) FILTER (WHERE i > id - 8 AND i <= id - 4) AS p, var_pop(v) FILTER (WHERE i > id - 4) AS s FROM l GROUP BY id)
        SELECT id, id >= 8 AND r >= 0.9 AND abs(r - p) < 0.01 * abs(p) AND s < 0.001 AS stops FROM s""",
    "score_early_stop_multiclass": f"""
        SELECT CAST(CASE WHEN m1 > {_D(0.9)} THEN 1 WHEN m2 > {_D(0.9)} THEN 2 ELSE 3 END AS INTEGER) AS used, count(*) AS n FROM (
          SELECT x[1] - x[2] AS m1, z[1] - z[2] AS m2 FROM (
            SELECT list_reverse_sort([a, b, CAST(0 AS DOUBLE)]) AS x, list_reverse_sort([a + b, b + b, {_D(0.5)}]) AS z FROM (SELECT {_ONE} AS a, CAST({_TWO} AS DOUBLE) AS b FROM {HOLED_SQL}))) GROUP BY 1""",
}
