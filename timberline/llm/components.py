"""Connected components of a link table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm.tables import materialize


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node.

    Every round hangs each node's larger neighbours on its smallest one, then
    each node's smaller neighbours on the smallest of them.  Each step is an
    aggregation and a join; the number of rounds grows as the logarithm of the
    longest chain.  Links with a null end or equal ends are ignored.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if seen == now:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    found = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return found.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
