"""Binning, histogram and split queries over ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from timberline.operators import binning, histogram, split
from timberline.plans.common import FEATURES, HOLED_SQL, KEY, cells_sql, holed, lineitem, rounded
from timberline.session import read_table

#: Fixed cuts of the histogram queries, so that they need no fit.
CUTS = {"l_quantity": [10.0, 20.0, 30.0, 40.0, 50.0], "l_discount": [0.015, 0.035, 0.055, 0.075, 0.105], "l_tax": [0.015, 0.035, 0.055, 0.085]}


def _fixed(features=tuple(CUTS)):
    return [binning.Mapper(f, bounds=tuple(CUTS[f]), lowest=-1.0, highest=1e9) for f in features]


def bin_bounds_quantile(spark, sf_dir):
    mappers = binning.fit_quantile(holed(spark, sf_dir), FEATURES, 16, 3)
    return rounded(binning.bounds_table(lineitem(spark, sf_dir), mappers), 6, "upper")


def bin_bounds_uniform(spark, sf_dir):
    mappers = binning.fit_uniform(holed(spark, sf_dir), ["l_quantity", "l_extendedprice"], 8)
    return rounded(binning.bounds_table(lineitem(spark, sf_dir), mappers), 4, "upper")


def bin_counts(spark, sf_dir):
    df = holed(spark, sf_dir)
    m = binning.fit_quantile(df, ["l_extendedprice"], 16, 3)[0].with_missing("separate")
    return df.groupBy(binning.to_bin(F.col("l_extendedprice"), m).alias("bin")).agg(F.count("*").alias("n"))


def bin_categorical(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    m = binning.fit_categorical(part, "p_size", 10)
    return part.groupBy(binning.to_bin(F.col("p_size"), m).alias("bin")).agg(F.count("*").alias("n"))


def bin_middles(spark, sf_dir):
    m = binning.Mapper("l_quantity", bounds=(10.0, 20.0, 50.0), lowest=1.0, highest=50.0)
    df = lineitem(spark, sf_dir).select(binning.to_bin(F.col("l_quantity"), m).alias("bin"))
    return df.groupBy("bin").agg(F.count("*").alias("n")).withColumn("middle", binning.from_bin(F.col("bin"), m))


def bin_training(spark, sf_dir):
    df = holed(spark, sf_dir)
    mappers = binning.fit_training(df, FEATURES, 32, 3)
    return rounded(binning.bounds_table(df, mappers), 6, "upper")


def bin_adaptive(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    return rounded(binning.bounds_table(df, [binning.fit_adaptive(df, "l_extendedprice", 8, 20)]), 4, "upper")


def bin_on_target(spark, sf_dir):
    """Bins of the price that tell most of the quantity."""
    df = lineitem(spark, sf_dir)
    return rounded(binning.bounds_table(df, [binning.fit_adaptive(df, "l_extendedprice", 5, 50, target="l_quantity")]), 4, "upper")


def _binned(spark, sf_dir):
    df = holed(spark, sf_dir)
    mappers = [m.with_missing("separate") for m in _fixed()]
    y = (F.col("l_returnflag") == "R").cast("double")
    return binning.transform(df, mappers).withColumn("g", F.lit(0.5) - y).withColumn("h", F.lit(0.25))


def root_histogram(spark, sf_dir):
    hist = histogram.histograms(_binned(spark, sf_dir), list(CUTS))
    return rounded(hist, 4, "sum_g", "sum_h")


def leaf_histograms(spark, sf_dir):
    hist = histogram.histograms(_binned(spark, sf_dir), list(CUTS), leaf=F.when(F.col("bin_l_quantity") <= 2, 1).otherwise(2))
    return rounded(hist, 4, "sum_g", "sum_h")


def histogram_subtraction(spark, sf_dir):
    binned = _binned(spark, sf_dir)
    parent = histogram.histograms(binned, list(CUTS)).drop("leaf")
    child = histogram.histograms(binned.where("bin_l_quantity <= 1"), list(CUTS)).drop("leaf")
    return rounded(histogram.subtract(parent, child), 4, "sum_g", "sum_h")


def split_candidates(spark, sf_dir):
    cuts = split.candidates(histogram.histograms(_binned(spark, sf_dir), list(CUTS)), 0.1, 1.0, 20, 1e-3)
    return rounded(cuts.select("feature", "bin", "left_n", "right_n", "gain"), 4, "gain")


def best_split(spark, sf_dir):
    hist = histogram.histograms(_binned(spark, sf_dir), list(CUTS), leaf=F.col("l_linenumber"))
    best = split.with_values(split.best_splits(hist, digits=6, l1=0.0, l2=1.0, min_data=20), 0.0, 1.0)
    return rounded(best.select("leaf", "feature", "bin", "left_n", "right_n", "gain", "left_value", "right_value"), 4, "gain", "left_value", "right_value")


def bin_offsets(spark, sf_dir):
    mappers = binning.fit_quantile(lineitem(spark, sf_dir), list(CUTS), 64)
    sizes = spark.createDataFrame([(m.feature, m.n_bins) for m in mappers], "feature string, n_bins int")
    return histogram.bin_offsets(sizes)


def feature_conflicts(spark, sf_dir):
    return histogram.conflicts(_binned(spark, sf_dir), {"l_quantity": 0, "l_discount": 5, "l_tax": 4})


def route_rows(spark, sf_dir):
    df = _binned(spark, sf_dir).withColumn("leaf", F.lit(0))
    df = split.route(df, "leaf", 0, split.goes_left(F.col("bin_l_discount"), 2, 5, False), 1, 2)
    df = split.route(df, "leaf", 2, split.in_set(F.col("bin_l_tax"), [0, 3]), 3, 4)
    return df.groupBy("leaf").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (bin_bounds_quantile, bin_bounds_uniform, bin_counts, bin_categorical, bin_middles, bin_training, bin_adaptive, bin_on_target, root_histogram, leaf_histograms, histogram_subtraction, split_candidates, best_split, bin_offsets, feature_conflicts, route_rows)
}


def _bin_sql(f: str) -> str:
    cases = " ".join(f"WHEN {f} <= CAST({b} AS DOUBLE) THEN {k}" for k, b in enumerate(CUTS[f][:-1]))
    return f"CASE WHEN {f} IS NULL THEN {len(CUTS[f])} {cases} ELSE {len(CUTS[f]) - 1} END"


_BINNED = f"(SELECT *, {', '.join(f'{_bin_sql(f)} AS b_{f}' for f in CUTS)}, 0.5 - CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS g, CAST(0.25 AS DOUBLE) AS h FROM {HOLED_SQL})"


def _hist(source: str, leaf: str = "0") -> str:
    return " UNION ALL ".join(
        f"SELECT CAST({leaf} AS INTEGER) AS leaf, '{f}' AS feature, CAST(b_{f} AS INTEGER) AS bin, CAST(sum(g) AS DOUBLE) AS sum_g, sum(h) AS sum_h, count(*) AS n FROM {source} GROUP BY 1, 3" for f in CUTS
    )


def _gain(g: str, h: str, l1: str, l2: str) -> str:
    return f"CASE WHEN {h} <= 0 OR abs({g}) <= {l1} THEN 0 ELSE 0.5 * (abs({g}) - {l1}) * (abs({g}) - {l1}) / ({h} + {l2}) END"


def _cuts(leaf: str, l1: str, l2: str) -> str:
    w = "OVER (PARTITION BY leaf, feature ORDER BY bin ROWS UNBOUNDED PRECEDING)"
    a = "OVER (PARTITION BY leaf, feature)"
    return f"""
        SELECT *, {_gain("lg", "lh", l1, l2)} + {_gain("rg", "rh", l1, l2)} - ({_gain("ag", "ah", l1, l2)}) AS gain FROM (
          SELECT *, ag - lg AS rg, ah - lh AS rh, an - ln AS rn FROM (
            SELECT leaf, feature, bin, sum(sum_g) {w} AS lg, sum(sum_h) {w} AS lh, CAST(sum(n) {w} AS BIGINT) AS ln, sum(sum_g) {a} AS ag, sum(sum_h) {a} AS ah, CAST(sum(n) {a} AS BIGINT) AS an
            FROM ({_hist(_BINNED, leaf)})))
        WHERE least(ln, rn) >= 20 AND least(lh, rh) >= CAST(0.001 AS DOUBLE)"""


_RANKED = f"""
    SELECT feature, value, p, n, min(p) OVER (PARTITION BY feature, value) AS below, count(DISTINCT value) OVER (PARTITION BY feature) AS d, max(value) OVER (PARTITION BY feature) AS hi FROM (
      SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY feature) AS n FROM ({cells_sql(HOLED_SQL)}) WHERE value IS NOT NULL)"""
_QUANTILE = f"""
    WITH RECURSIVE r AS ({_RANKED}),
    cuts AS (SELECT feature, value, below, row_number() OVER (PARTITION BY feature ORDER BY value) AS k FROM (
        SELECT DISTINCT feature, value, below FROM r WHERE d <= 16 OR p IN (SELECT CAST(floor((r2.n - 1) * (i / CAST(16 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) AS BIGINT) FROM range(1, 17) q(i), (SELECT DISTINCT feature, n FROM r) r2 WHERE r2.feature = r.feature))),
    flags AS (SELECT feature, any_value(d) AS d FROM r GROUP BY feature),
    kept AS (
      SELECT feature, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS last, CAST(NULL AS DOUBLE) AS value, false AS keep FROM flags
      UNION ALL
      SELECT c.feature, c.k, CASE WHEN d <= 16 OR c.below - last >= 3 THEN c.below ELSE last END, c.value, d <= 16 OR c.below - last >= 3
      FROM kept JOIN cuts c ON c.feature = kept.feature AND c.k = kept.k + 1 JOIN flags f ON f.feature = c.feature)"""

def _training_sql(bins_total: int = 32, least: int = 3) -> str:
    """The rule bin by bin: each step finds the value at which the next bin ends, or the heavy value before it."""
    D = "CAST({} AS DOUBLE)".format
    cells = " UNION ALL ".join(f"SELECT '{f}' AS f, {f} AS v, count(*) AS n FROM h WHERE {f} > 1e-35 GROUP BY 2" for f in FEATURES)
    gaps = " UNION ALL ".join(f"SELECT '{f}' AS f, count(*) > count({f}) AS gap FROM h" for f in FEATURES)
    return f"""
      WITH RECURSIVE h AS (SELECT * REPLACE (CASE WHEN isnan(l_tax) THEN NULL ELSE l_tax END AS l_tax) FROM {HOLED_SQL}),
      gaps AS ({gaps}),
      cells AS (SELECT *, CAST(sum(n) OVER w - n AS BIGINT) AS below, lead(v) OVER w AS nxt FROM ({cells}) WINDOW w AS (PARTITION BY f ORDER BY v)),
      sizes AS (SELECT f, CAST(sum(n) AS BIGINT) AS total, count(*) AS vals, any_value({bins_total} - CAST(gap AS INTEGER) - 1) AS room FROM cells JOIN gaps USING (f) GROUP BY f),
      aims AS (SELECT *, vals <= room AS few, CASE WHEN vals <= room THEN vals ELSE greatest(1, least(room, total // {least})) END AS bins FROM sizes),
      heavy AS (SELECT f, list({{'b': below, 'n': n}} ORDER BY below) AS hs FROM cells JOIN aims USING (f) WHERE NOT few AND n >= total / bins GROUP BY f),
      plan AS (SELECT a.*, coalesce(hs, []) AS hs, len(coalesce(hs, [])) AS n_heavy, coalesce(list_sum(list_transform(hs, lambda x: x.n)), 0) AS n_in FROM aims a LEFT JOIN heavy USING (f)),
      steps AS (
        SELECT f, CAST(0 AS BIGINT) AS pos, CAST(bins - n_heavy AS BIGINT) AS free, CAST(0 AS BIGINT) AS k,
          CASE WHEN few THEN {D(least)} WHEN bins - n_heavy > 0 THEN (total - n_in) / CAST(bins - n_heavy AS DOUBLE) ELSE {D("'infinity'")} END AS goal, CAST(NULL AS DOUBLE) AS v, CAST(NULL AS DOUBLE) AS nxt FROM plan
        UNION ALL
        SELECT f, pos, free, k, CASE WHEN few OR by_wall THEN goal WHEN free > 0 THEN ((total - n_in) - (pos - gone)) / CAST(free AS DOUBLE) ELSE {D("'infinity'")} END, v, nxt FROM (
          SELECT x.f, few, total, n_in, by_wall, goal, c.below + c.n AS pos, CASE WHEN few OR by_wall THEN free ELSE free - 1 END AS free, k + 1 AS k, c.v, c.nxt,
            coalesce(list_sum(list_transform(list_filter(hs, lambda x: x.b < c.below + c.n), lambda x: x.n)), 0) AS gone, bins FROM (
            SELECT *, CASE WHEN wall IS NULL OR spot < wall THEN spot WHEN wall - pos >= greatest(1, goal / 2) THEN wall - 1 ELSE wall END AS pick, wall IS NOT NULL AND spot >= wall AND NOT wall - pos >= greatest(1, goal / 2) AS by_wall FROM (
              SELECT s.*, few, total, n_in, hs, bins, CASE WHEN isinf(goal) THEN total ELSE pos + greatest(CAST(ceil(goal) AS BIGINT) - 1, 0) END AS spot, list_min(list_transform(list_filter(hs, lambda x: x.b >= pos), lambda x: x.b)) AS wall
              FROM steps s JOIN plan USING (f) WHERE k < bins - 1 AND pos < total)) x
          JOIN cells c ON c.f = x.f AND pick >= c.below AND pick < c.below + c.n WHERE c.below + c.n < total)),
      bounds AS (
        SELECT f, CASE WHEN nxt > v THEN greatest((v + nxt) / 2, v) ELSE v END AS b FROM steps WHERE v IS NOT NULL
        UNION ALL SELECT f, {D('1e-35')} FROM sizes UNION ALL SELECT f, {D("'infinity'")} FROM gaps)
      SELECT f AS feature, CAST(row_number() OVER (PARTITION BY f ORDER BY b) - 1 AS INTEGER) AS bin, round(b, 6) AS upper FROM (SELECT DISTINCT f, b FROM bounds)"""


def _adaptive_sql(value: str, y: str, bins: int, least: int) -> str:
    """Cuts one at a time: the best of all parts by the fall of the squared deviations of ``y``."""
    ctes = [f"r_0 AS (SELECT {value} AS v, {y} - avg({y}) OVER () AS y, 0 AS part FROM lineitem)"]
    for k in range(bins - 1):
        ctes.append(f"""c_{k} AS (SELECT part, v, CAST(sum(n) OVER w AS DOUBLE) AS n, sum(s) OVER w AS s, sum(q) OVER w AS q, CAST(sum(n) OVER a AS DOUBLE) AS an, sum(s) OVER a AS xs, sum(q) OVER a AS xq
          FROM (SELECT part, v, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM r_{k} GROUP BY 1, 2) WINDOW w AS (PARTITION BY part ORDER BY v ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY part))""")
        ctes.append(f"""b_{k} AS (SELECT part, v, xq - xs * xs / an - (q - s * s / n) - (xq - q - (xs - s) * (xs - s) / (an - n)) AS gain FROM c_{k} WHERE n >= {least} AND an - n >= {least}
          QUALIFY row_number() OVER (ORDER BY gain DESC, v) = 1)""")
        ctes.append(f"r_{k + 1} AS (SELECT r.v, r.y, CASE WHEN r.part = b.part AND r.v > b.v THEN {k + 1} ELSE r.part END AS part FROM r_{k} r, b_{k} b)")
    cuts = " UNION ALL ".join(f"SELECT v FROM b_{k}" for k in range(bins - 1))
    return f"WITH {', '.join(ctes)}, u AS ({cuts} UNION ALL SELECT max({value}) FROM lineitem) SELECT '{value}' AS feature, CAST(row_number() OVER (ORDER BY v) - 1 AS INTEGER) AS bin, round(v, 4) AS upper FROM u"


ORACLE = {
    "bin_training": _training_sql(),
    "bin_adaptive": _adaptive_sql("l_extendedprice", "l_extendedprice", 8, 20),
    "bin_on_target": _adaptive_sql("l_extendedprice", "l_quantity", 5, 50),
    "bin_bounds_quantile": _QUANTILE + " SELECT feature, CAST(row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS INTEGER) AS bin, round(value, 6) AS upper FROM kept WHERE keep",
    "bin_bounds_uniform": f"""
        SELECT feature, CAST(i - 1 AS INTEGER) AS bin, round(lo + (hi - lo) * i / 8, 4) AS upper FROM (
          SELECT feature, min(value) AS lo, max(value) AS hi FROM ({cells_sql(HOLED_SQL, ["l_quantity", "l_extendedprice"])}) GROUP BY feature), range(1, 9) r(i)""",
    "bin_counts": _QUANTILE
    + """, b AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS bin FROM kept WHERE keep AND feature = 'l_extendedprice')
        SELECT CAST(coalesce((SELECT min(bin) FROM b WHERE b.value >= l_extendedprice), (SELECT max(bin) FROM b)) AS INTEGER) AS bin, count(*) AS n FROM lineitem GROUP BY 1""",
    "bin_categorical": """
        WITH c AS (SELECT p_size, row_number() OVER (ORDER BY count(*) DESC, p_size) - 1 AS k FROM part GROUP BY p_size)
        SELECT CAST(least(k, 9) AS INTEGER) AS bin, count(*) AS n FROM part JOIN c USING (p_size) GROUP BY 1""",
    "bin_middles": """
        SELECT CAST(b AS INTEGER) AS bin, count(*) AS n, CAST(CASE b WHEN 0 THEN 5.5 WHEN 1 THEN 10.5 ELSE 35.0 END AS DOUBLE) AS middle FROM (
          SELECT CASE WHEN l_quantity <= 10 THEN 0 WHEN l_quantity <= 20 THEN 1 ELSE 2 END AS b FROM lineitem) GROUP BY b""",
    "root_histogram": f"SELECT leaf, feature, bin, round(sum_g, 4) AS sum_g, round(sum_h, 4) AS sum_h, n FROM ({_hist(_BINNED)})",
    "leaf_histograms": f"SELECT leaf, feature, bin, round(sum_g, 4) AS sum_g, round(sum_h, 4) AS sum_h, n FROM ({_hist(_BINNED, 'CASE WHEN b_l_quantity <= 2 THEN 1 ELSE 2 END')})",
    "histogram_subtraction": f"""
        SELECT feature, bin, round(sum_g, 4) AS sum_g, round(sum_h, 4) AS sum_h, n FROM ({" UNION ALL ".join(
            f"SELECT '{f}' AS feature, CAST(b_{f} AS INTEGER) AS bin, CAST(coalesce(sum(g) FILTER (WHERE b_l_quantity > 1), 0) AS DOUBLE) AS sum_g, coalesce(sum(h) FILTER (WHERE b_l_quantity > 1), 0) AS sum_h, count(*) FILTER (WHERE b_l_quantity > 1) AS n FROM {_BINNED} GROUP BY 2" for f in CUTS)})""",
    "split_candidates": f"SELECT feature, bin, ln AS left_n, rn AS right_n, round(gain, 4) AS gain FROM ({_cuts('0', 'CAST(0.1 AS DOUBLE)', '1')})",
    "best_split": f"""
        SELECT leaf, feature, bin, ln AS left_n, rn AS right_n, round(round(gain, 6), 4) AS gain, round(-lg / (lh + 1), 4) AS left_value, round(-rg / (rh + 1), 4) AS right_value FROM (
          SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY round(gain, 6) DESC, feature, bin) AS k FROM ({_cuts('l_linenumber', '0', '1')}) WHERE round(gain, 6) > 0) WHERE k = 1""",
    "bin_offsets": """WITH n AS (SELECT 'l_discount' AS feature, count(DISTINCT l_discount) AS n FROM lineitem UNION ALL SELECT 'l_quantity', count(DISTINCT l_quantity) FROM lineitem UNION ALL SELECT 'l_tax', count(DISTINCT l_tax) FROM lineitem)
        SELECT feature, CAST(n AS INTEGER) AS n_bins, CAST(sum(n) OVER (ORDER BY feature) - n AS BIGINT) AS "offset" FROM n""",
    "feature_conflicts": f"""
        SELECT 'l_quantity' AS a, 'l_discount' AS b, count(*) AS n FROM {_BINNED} WHERE b_l_quantity <> 0 AND b_l_discount <> 5
        UNION ALL SELECT 'l_quantity', 'l_tax', count(*) FROM {_BINNED} WHERE b_l_quantity <> 0 AND b_l_tax <> 4
        UNION ALL SELECT 'l_discount', 'l_tax', count(*) FROM {_BINNED} WHERE b_l_discount <> 5 AND b_l_tax <> 4""",
    "route_rows": f"SELECT CAST(CASE WHEN b_l_discount <= 2 THEN 1 WHEN b_l_tax IN (0, 3) THEN 3 ELSE 4 END AS INTEGER) AS leaf, count(*) AS n FROM {_BINNED} GROUP BY 1",
}
