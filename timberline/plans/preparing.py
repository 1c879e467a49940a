"""Imputation, scaling, encoding and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import impute, sampling, scale
from timberline.plans.common import FEATURES, HOLED_SQL, KEY, cells_sql, holed, lineitem, rounded
from timberline.session import read_table


def _sums(df, features, digits=2):
    """Count and rounded sum of each feature: the digest of a transformed table."""
    return df.agg(F.count("*").alias("n"), *[F.round(F.sum(f), digits).alias(f) for f in features])


def fill_constants(spark, sf_dir):
    df = holed(spark, sf_dir)
    values = impute.fit_constants(df, {"l_discount": "mean", "l_tax": "median", "l_quantity": "zero"})
    return _sums(impute.fill_constants(df, values), ["l_discount", "l_tax", "l_quantity"])


def fill_mode(spark, sf_dir):
    df = holed(spark, sf_dir).withColumn("q", F.when(F.col("l_linenumber") != 2, F.col("l_quantity")))
    return _sums(impute.fill_constants(df, impute.fit_constants(df, {"q": "mode", "l_tax": 0.5})), ["q", "l_tax"])


def missing_indicators(spark, sf_dir):
    df = impute.missing_indicators(holed(spark, sf_dir), ["l_discount", "l_tax"])
    return _sums(df, ["l_discount_missing", "l_tax_missing"])


def _events(spark, sf_dir):
    return read_table(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_id") % 4 != 1, F.col("value")))


def _near(spark, sf_dir):
    return impute.neighbours_in_order(_events(spark, sf_dir), "v", ["user_id"], ["ts", "event_id"], F.date_trunc("day", "ts"))


def fill_forward(spark, sf_dir):
    near = _near(spark, sf_dir)
    return near.select("event_id", F.round(impute.forward_fill(near), 6).alias("filled"))


def fill_backward(spark, sf_dir):
    near = _near(spark, sf_dir)
    return near.select("event_id", F.round(impute.backward_fill(near), 6).alias("filled"))


def fill_linear(spark, sf_dir):
    near = _near(spark, sf_dir)
    return near.select("event_id", F.round(impute.linear_fill(near), 4).alias("filled"))


def fill_knn(spark, sf_dir):
    df = holed(spark, sf_dir)
    return _sums(impute.knn_fill(df, FEATURES, "l_tax", KEY, 3).where(F.col("l_discount").isNotNull()), ["l_tax"], 3)


def scale_minmax(spark, sf_dir):
    df = holed(spark, sf_dir)
    return _sums(scale.scale(df, scale.fit_scaler(df, FEATURES, "minmax"), "minmax"), FEATURES)


def scale_standard(spark, sf_dir):
    df = holed(spark, sf_dir)
    scaled = scale.scale(df, scale.fit_scaler(df, FEATURES, "standard"), "standard")
    return scaled.groupBy("l_linestatus").agg(*[F.round(F.sum(f), 2).alias(f) for f in FEATURES])


def scale_robust(spark, sf_dir):
    df = holed(spark, sf_dir)
    scaled = scale.scale(df, scale.fit_scaler(df, FEATURES, "robust"), "robust")
    return scaled.groupBy("l_linestatus").agg(*[F.round(F.sum(f), 2).alias(f) for f in FEATURES])


def percent_rank(spark, sf_dir):
    return rounded(scale.percent_ranks(holed(spark, sf_dir), ["l_quantity", "l_discount"]), 6, "percent_rank")


def encode_label(spark, sf_dir):
    return scale.binary_encode(scale.label_encode(read_table(spark, sf_dir, "orders"), "o_orderpriority"), 3)


def encode_one_hot(spark, sf_dir):
    hot = scale.one_hot(lineitem(spark, sf_dir), "l_returnflag", ["A", "N", "R"])
    return _sums(hot, ["l_returnflag_A", "l_returnflag_N", "l_returnflag_R"])


def encode_frequency(spark, sf_dir):
    return rounded(scale.frequency_encode(read_table(spark, sf_dir, "orders"), "o_orderpriority"), 6, "frequency")


def encode_target(spark, sf_dir):
    return rounded(scale.target_encode(lineitem(spark, sf_dir), "l_linenumber", F.col("l_returnflag") == "R"), 6, "target")


def cap_outliers(spark, sf_dir):
    return _sums(scale.cap_outliers(lineitem(spark, sf_dir), {"l_quantity": (5.0, 45.0), "l_tax": (0.01, 0.06)}), ["l_quantity", "l_tax"])


def remove_outliers(spark, sf_dir):
    return _sums(scale.remove_outliers(holed(spark, sf_dir), {"l_quantity": (5.0, 45.0), "l_tax": (0.01, 0.06)}), ["l_quantity"])


def label_correlation(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("y", (F.col("l_returnflag") == "R").cast("double"))
    return rounded(scale.rank_by_label(df, FEATURES, "y"), 6, "score")


def train_valid_split(spark, sf_dir):
    split = sampling.train_valid_split(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.col("o_orderkey"), 0.7)
    return split.groupBy("is_train").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def take_rows(spark, sf_dir):
    positions = spark.range(300).select(F.col("id").alias("pos"), (F.col("id") * 7 % 211).alias("event_id"))
    taken = sampling.take_rows(read_table(spark, sf_dir, "events").select("event_id", "value"), "event_id", positions)
    return taken.select("pos", "event_id", F.round("value", 6).alias("value"))


def lcg_sample(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    return events.withColumn("u", sampling.lcg_uniform(F.col("event_id"), 17)).where("u < 0.25").select("event_id", "u")


def goss_sample(spark, sf_dir):
    df = lineitem(spark, sf_dir).select(*KEY, (F.col("l_quantity") - 25.0).alias("g"), F.lit(1.0).alias("h"))
    # everything is kept at 0.8 of the rest, so only the order of the top decides
    kept = sampling.goss(df, F.concat_ws("-", *KEY), "g", "h", 0.2, 0.8)
    return kept.groupBy("is_top").agg(F.count("*").alias("n"), F.round(F.min(F.abs("g")), 4).alias("least"))


def unique_classes(spark, sf_dir):
    return sampling.class_values(lineitem(spark, sf_dir), "l_returnflag")


QUERIES = {
    f.__name__: f
    for f in (fill_constants, fill_mode, missing_indicators, fill_forward, fill_backward, fill_linear, fill_knn, scale_minmax, scale_standard, scale_robust, percent_rank, encode_label, encode_one_hot, encode_frequency, encode_target, cap_outliers, remove_outliers, label_correlation, train_valid_split, take_rows, lcg_sample, goss_sample, unique_classes)
}


def _fill(x: str) -> str:
    return f"""
        WITH e AS (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 1 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
        w AS (SELECT event_id, p,
            last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a,
            last_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ap,
            first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b,
            first_value(CASE WHEN v IS NOT NULL THEN p END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bp FROM e)
        SELECT event_id, {x} AS filled FROM w"""


def _scaled(form: str) -> str:
    sums = ", ".join(f"round(sum(CASE WHEN feature = '{f}' THEN {form} END), 2) AS {f}" for f in FEATURES)
    cells = " UNION ALL ".join(f"SELECT l_linestatus, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {HOLED_SQL} WHERE {f} IS NOT NULL" for f in FEATURES)
    return f"""
        WITH c AS ({cells}),
        r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY feature) AS n FROM c),
        s AS (SELECT feature, avg(value) AS m, stddev_pop(value) AS sd, max(CASE WHEN p = CAST(floor(n * CAST(0.25 AS DOUBLE)) AS BIGINT) THEN value END) AS a,
              max(CASE WHEN p = CAST(floor(n * CAST(0.75 AS DOUBLE)) AS BIGINT) THEN value END) AS b FROM r GROUP BY feature)
        SELECT l_linestatus, {sums} FROM c JOIN s USING (feature) GROUP BY l_linestatus"""


ORACLE = {
    "fill_knn": f"""
        WITH h AS (SELECT row_number() OVER () AS id, * FROM {HOLED_SQL} WHERE l_discount IS NOT NULL),
        n AS (SELECT q.id, min(struct_pack(d := sqrt((q.l_quantity - r.l_quantity) ** 2 + (q.l_extendedprice - r.l_extendedprice) ** 2 + (q.l_discount - r.l_discount) ** 2), v := r.l_tax), 3) AS near
              FROM h q, h r WHERE q.l_tax IS NULL AND r.l_tax IS NOT NULL GROUP BY q.id),
        w AS (SELECT id, sum(x.v * CASE WHEN x.d > 0 THEN 1 / x.d ELSE 1e6 END) / sum(CASE WHEN x.d > 0 THEN 1 / x.d ELSE 1e6 END) AS v FROM (SELECT id, unnest(near) AS x FROM n) GROUP BY id)
        SELECT count(*) AS n, round(sum(coalesce(l_tax, w.v)), 3) AS l_tax FROM h LEFT JOIN w USING (id)""",
    "fill_constants": f"""SELECT count(*) AS n, round(sum(coalesce(l_discount, (SELECT avg(l_discount) FROM {HOLED_SQL}))), 2) AS l_discount,
        round(sum(coalesce(l_tax, (SELECT median(l_tax) FROM {HOLED_SQL}))), 2) AS l_tax, round(sum(l_quantity), 2) AS l_quantity FROM {HOLED_SQL}""",
    "fill_mode": f"""WITH m AS (SELECT trunc(l_quantity) AS w, count(*) AS n FROM lineitem WHERE l_linenumber <> 2 GROUP BY 1)
        SELECT count(*) AS n, round(sum(CASE WHEN l_linenumber <> 2 THEN l_quantity ELSE (SELECT arg_min(w, (-n, w)) FROM m) END), 2) AS q,
        round(sum(coalesce(l_tax, CAST(0.5 AS DOUBLE))), 2) AS l_tax FROM {HOLED_SQL}""",
    "missing_indicators": """SELECT count(*) AS n, CAST(count(*) FILTER (WHERE l_linenumber % 3 = 0) AS DOUBLE) AS l_discount_missing,
        CAST(count(*) FILTER (WHERE l_partkey % 5 = 0) AS DOUBLE) AS l_tax_missing FROM lineitem""",
    "fill_forward": _fill("round(coalesce(a, 0), 6)"),
    "fill_backward": _fill("round(coalesce(b, 0), 6)"),
    "fill_linear": _fill("round(coalesce(CASE WHEN bp > ap THEN a + (b - a) * (CAST(p - ap AS DOUBLE) / (bp - ap)) END, a, b, 0), 4)"),
    "scale_minmax": f"""WITH s AS (SELECT {", ".join(f"min({f}) AS a{i}, max({f}) AS b{i}" for i, f in enumerate(FEATURES))} FROM {HOLED_SQL})
        SELECT count(*) AS n, {", ".join(f"round(sum(({f} - a{i}) / (b{i} - a{i})), 2) AS {f}" for i, f in enumerate(FEATURES))} FROM {HOLED_SQL}, s""",
    "scale_standard": _scaled("(value - m) / sd"),
    "scale_robust": _scaled("(value - m) / (b - a)"),
    "percent_rank": f"""SELECT DISTINCT feature, value, round(percent_rank() OVER (PARTITION BY feature ORDER BY value), 6) AS percent_rank
        FROM ({cells_sql(HOLED_SQL, ["l_quantity", "l_discount"])}) WHERE value IS NOT NULL""",
    "encode_label": """SELECT category, code, CAST(code & 1 AS INTEGER) AS bit_0, CAST((code >> 1) & 1 AS INTEGER) AS bit_1, CAST((code >> 2) & 1 AS INTEGER) AS bit_2 FROM (
        SELECT category, row_number() OVER (ORDER BY category) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS category FROM orders WHERE o_orderpriority IS NOT NULL))""",
    "encode_one_hot": "SELECT count(*) AS n, "
    + ", ".join(f"count(*) FILTER (WHERE l_returnflag = '{c}') AS \"l_returnflag_{c}\"" for c in "ANR")
    + " FROM lineitem",
    "encode_frequency": "SELECT o_orderpriority AS category, round(count(*) / CAST((SELECT count(*) FROM orders) AS DOUBLE), 6) AS frequency FROM orders GROUP BY 1",
    "encode_target": "SELECT l_linenumber AS category, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END), 6) AS target FROM lineitem GROUP BY 1",
    "cap_outliers": "SELECT count(*) AS n, round(sum(greatest(least(l_quantity, 45.0), 5.0)), 2) AS l_quantity, round(sum(greatest(least(l_tax, CAST(0.06 AS DOUBLE)), CAST(0.01 AS DOUBLE))), 2) AS l_tax FROM lineitem",
    "remove_outliers": f"""SELECT count(*) AS n, round(sum(l_quantity), 2) AS l_quantity FROM {HOLED_SQL}
        WHERE l_quantity BETWEEN 5 AND 45 AND (l_tax IS NULL OR l_tax BETWEEN CAST(0.01 AS DOUBLE) AND CAST(0.06 AS DOUBLE))""",
    "label_correlation": " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(abs(covar_pop({f}, y) / sqrt(var_pop({f}) * var_pop(y))), 6) AS score FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem)" for f in FEATURES
    ),
    "train_valid_split": """SELECT is_train, count(*) AS n, max(o_orderkey) AS last, round(sum(o_totalprice), 2) AS total FROM (
        SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 < CAST(floor((SELECT count(*) FROM orders) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS is_train FROM orders) GROUP BY 1""",
    "take_rows": "SELECT p AS pos, event_id, round(value, 6) AS value FROM range(300) r(p) JOIN events ON event_id = p * 7 % 211",
    "lcg_sample": """SELECT event_id, ((((event_id + 17) % 4294967296) * 214013 + 2531011) % 4294967296 // 65536 & 32767) / CAST(32768 AS DOUBLE) AS u FROM events
        WHERE ((((event_id + 17) % 4294967296) * 214013 + 2531011) % 4294967296 // 65536 & 32767) / CAST(32768 AS DOUBLE) < CAST(0.25 AS DOUBLE)""",
    "goss_sample": """SELECT is_top, count(*) AS n, round(min(a), 4) AS least FROM (
        SELECT abs(l_quantity - 25.0) AS a, row_number() OVER (ORDER BY abs(l_quantity - 25.0) DESC) - 1 < CAST(floor((SELECT count(*) FROM lineitem) * CAST(0.2 AS DOUBLE)) AS BIGINT) AS is_top FROM lineitem) GROUP BY 1""",
    "unique_classes": "SELECT DISTINCT l_returnflag FROM lineitem",
}
