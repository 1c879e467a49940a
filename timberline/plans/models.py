"""Tree and boosting queries over ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import boosting, trees
from timberline.plans.common import HOLED_SQL, KEY, holed, rounded
from timberline.session import read_table

#: A tree written by hand, so that scoring has an equal in SQL.
TREE = trees.Tree(
    [
        trees.Node("l_quantity", 24.5, 0, left=1, right=2, count=60),
        trees.Node("l_discount", 0.045, 0, default_left=False, left=3, right=4, count=30, gain=3.0),
        trees.Node("l_tax", 0.035, 0, default_left=True, left=5, right=6, count=30, gain=1.0),
        trees.Node(value=-1.5, count=10),
        trees.Node(value=0.25, count=20),
        trees.Node(value=0.75, count=12),
        trees.Node(value=2.0, count=18),
    ],
    0.5,
)
SECOND = trees.Tree([trees.Node("l_linenumber", categories=[1, 4, 6], left=1, right=2, count=60), trees.Node(value=1.0, count=24), trees.Node(value=-0.5, count=36)], 1.0)


def score_tree(spark, sf_dir):
    df = holed(spark, sf_dir)
    return df.groupBy(trees.leaf_expression(TREE).alias("leaf")).agg(F.count("*").alias("n"), F.round(F.sum(trees.score_expression(TREE)), 4).alias("total"))


def score_ensemble(spark, sf_dir):
    model = boosting.Ensemble([TREE, SECOND], 0.1, "binary")
    out = model.predict(holed(spark, sf_dir))
    return out.groupBy("l_returnflag").agg(F.round(F.sum("prediction"), 3).alias("total"))


def score_early_stop(spark, sf_dir):
    df = holed(spark, sf_dir)
    stages = F.array(trees.score_expression(TREE), trees.score_expression(SECOND), trees.score_expression(TREE))
    return df.groupBy(boosting.staged_stop(stages, "binary", 1.6, 1).alias("used")).agg(F.count("*").alias("n"))


def leaf_distribution(spark, sf_dir):
    return rounded(trees.leaf_statistics(holed(spark, sf_dir), TREE), 6, "share")


def leaf_entropy(spark, sf_dir):
    return rounded(trees.leaf_entropy(trees.leaf_statistics(holed(spark, sf_dir), TREE)), 6, "entropy")


def _train(spark, sf_dir, **options):
    df = holed(spark, sf_dir).withColumn("y", F.col("l_extendedprice") / 1000)
    return df, boosting.train(df, ["l_quantity", "l_discount", "l_tax"], "y", KEY, num_leaves=5, min_data=20, **options)


def boosted_regression(spark, sf_dir):
    """Squared error of a trained ensemble and of the mean."""
    df, model = _train(spark, sf_dir, rounds=5, rate=0.3)
    return df.agg(F.round(F.avg((model.raw() - F.col("y")) ** 2), 4).alias("mse"), F.round(F.var_pop("y"), 4).alias("variance"))


def boosted_early_stop(spark, sf_dir):
    stop = boosting.EarlyStop(patience=2, min_delta=1.0)
    df, model = _train(spark, sf_dir, rounds=6, rate=0.5, valid_rows=F.pmod(F.col("l_orderkey"), F.lit(4)) == 0, early_stop=stop)
    return spark.createDataFrame([(len(model.trees), round(float(stop.best), 4))], "trees int, best double")


def stop_rounds(spark, sf_dir):
    """The early-stop rule over a metric log, the mean value of each day's events."""
    days = read_table(spark, sf_dir, "events").groupBy(F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("id"))
    log = days.agg(F.round(F.avg("value"), 6).alias("metric"))
    return boosting.stop_round(log, "metric", "id", 8)


QUERIES = {f.__name__: f for f in (score_tree, score_ensemble, score_early_stop, leaf_distribution, leaf_entropy, boosted_regression, boosted_early_stop, stop_rounds)}

_ONE, _TWO = trees.to_sql(TREE), trees.to_sql(SECOND)
_LEAF = "CASE WHEN l_quantity <= 24.5 THEN CASE WHEN coalesce(l_discount <= CAST(0.045 AS DOUBLE), false) THEN 3 ELSE 4 END WHEN coalesce(l_tax <= CAST(0.035 AS DOUBLE), true) THEN 5 ELSE 6 END"

ORACLE = {
    "score_tree": f"SELECT CAST({_LEAF} AS INTEGER) AS leaf, count(*) AS n, round(sum({_ONE}), 4) AS total FROM {HOLED_SQL} GROUP BY 1",
    "score_ensemble": f"SELECT l_returnflag, round(sum(1 / (1 + exp(-(CAST(0.1 AS DOUBLE) + {_ONE} + {_TWO})))), 3) AS total FROM {HOLED_SQL} GROUP BY 1",
    "score_early_stop": f"""SELECT CAST(CASE WHEN 2 * abs(a) > CAST(1.6 AS DOUBLE) THEN 1 WHEN 2 * abs(a + b) > CAST(1.6 AS DOUBLE) THEN 2 ELSE 3 END AS INTEGER) AS used, count(*) AS n
        FROM (SELECT {_ONE} AS a, {_TWO} AS b FROM {HOLED_SQL}) GROUP BY 1""",
    "leaf_distribution": f"SELECT CAST({_LEAF} AS INTEGER) AS leaf, count(*) AS n, round(count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE), 6) AS share FROM {HOLED_SQL} GROUP BY 1",
    "leaf_entropy": f"SELECT round(-sum(s * log2(s)), 6) AS entropy FROM (SELECT count(*) / CAST((SELECT count(*) FROM lineitem) AS DOUBLE) AS s FROM {HOLED_SQL} GROUP BY {_LEAF})",
    "stop_rounds": """
        WITH l AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS id, round(avg(value), 6) AS m FROM events GROUP BY 1), b AS (SELECT id, min(m) OVER (ORDER BY id) AS best FROM l),
        i AS (SELECT id, best, CASE WHEN lag(best) OVER (ORDER BY id) IS NULL OR best < lag(best) OVER (ORDER BY id) THEN id END AS hit FROM b)
        SELECT id, best, id - last_value(hit IGNORE NULLS) OVER (ORDER BY id) AS gap, id - last_value(hit IGNORE NULLS) OVER (ORDER BY id) >= 8 AS stop FROM i""",
}
