"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

A source's documents are laid end to end in a seeded order and cut into blocks
of the same number of words.  Sources share the mix by weight; a source whose
share passes ``most`` times its size stops there, and the rest is shared anew.
The blocks of the mix go to sources by highest quotients (1, 3, 5, ...), and a
source's blocks to its shards in the same way, as whole quotas.  Within a
shard, blocks are taken at even steps from a seeded start: a quota of ``q`` of
``n`` blocks takes each ``floor(q / n)`` times or once more.  Sums over blocks
have a closed form, so a document finds what is taken of it from its place and
its shard's quota, and no table of blocks is ever made.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.sharding import digest
from timberline.llm.tables import materialize

WEIGHTS = (5, 2, 1)
MOST = 3
#: Words of a block; fewer where the table would have fewer than ``LEAST_BLOCKS`` blocks.
BLOCK = 64
LEAST_BLOCKS = 1 << 16
#: Documents of a shard, about, and the least number of shards.
SHARD_ROWS = 20_000
LEAST_SHARDS = 16
#: Rows that are numbered in one task, about.
RANGE_ROWS = 100_000
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add exclusive running sums in ``order``, which is cut into ranges so that no task sorts all rows."""
    ranges = math.ceil(df.count() / RANGE_ROWS) or 1
    dealt = df.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id())
    dealt = materialize(dealt, "ranges")
    totals = dealt.groupBy("__range").agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    base = totals.select("__range", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__t_{n}") for n in sums])
    within = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *[F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"__w_{n}") for n, c in sums.items()]).join(base, "__range")
    return out.select(*df.columns, *[(F.col(f"__t_{n}") + F.col(f"__w_{n}")).alias(n) for n in sums])


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of numbers that are not negative."""
    return F.call_function("div", a, b)


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """Add ``idx`` (place by code point, null last), ``weight`` and ``target`` to ``source, source_size``.

    Targets are the level of a filling: ``weight`` times one level, or ``most``
    times the source's size where that is less.  Sources are looked at from the
    one that is full first; those before it are full, and it is full if the
    level of the rest would pass its brim.
    """
    idx = running(sources, [F.col("source").asc_nulls_last()], {"idx": F.lit(1)})
    at = F.pmod("idx", F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (at + 1).cast("int")).cast("long")
    caps = idx.select("*", weight.alias("weight"), (F.col("source_size") * most).alias("__cap"))
    caps = materialize(caps.withColumn("__brim", F.col("__cap").cast("double") / F.col("weight")), "sources")
    total, all_weight = caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    filling = running(caps, [F.col("__brim"), F.col("idx")], {"__caps": F.col("__cap"), "__weights": F.col("weight")})
    rest = (F.lit(float(total)) - F.col("__caps").cast("double")) * F.col("weight").cast("double")
    full = rest > F.col("__cap").cast("double") * (F.lit(float(all_weight)) - F.col("__weights").cast("double"))
    filling = materialize(filling.withColumn("__full", full), "filling")
    held, open_weight = filling.agg(F.sum(F.when(F.col("__full"), F.col("__cap")).otherwise(0)), F.sum(F.when(~F.col("__full"), F.col("weight")).otherwise(0))).first()
    level = (total - held) / open_weight if open_weight else 0.0
    target = F.when(F.col("__full"), F.col("__cap").cast("double")).otherwise(F.least(F.col("__cap").cast("double"), F.lit(level) * F.col("weight")))
    return filling.select("source", "source_size", "idx", "weight", target.alias("target"))


def _window_of_seats(share: Column, seats: Column, parties: Column, cap: Column) -> tuple[Column, Column]:
    """Seats that highest quotients surely give, and a bound of what they may give.

    With rounding to the nearest, seats differ from the exact share of
    ``seats`` by at most ``share * parties / 2 + 1 / 2``; twice that is looked at.
    """
    exact, slack = share * seats, share * parties + F.lit(2.0)
    least = F.least(F.greatest(F.lit(0).cast("long"), F.floor(exact - slack)), cap)
    return least, F.least(F.ceil(exact + slack), cap)


def _candidates(parties: DataFrame, columns: list[str], size: str) -> DataFrame:
    """A row for each seat between ``__least`` and ``__upper`` with its quotient."""
    seats = F.explode(F.expr("filter(sequence(__least, greatest(__upper, __least)), s -> s < __upper)")).alias("__seat")
    rows = parties.where(F.col("__upper") > F.col("__least")).select(*columns, size, seats)
    return rows.select(*columns, (F.col(size).cast("double") / (2 * F.col("__seat") + 1).cast("double")).alias("__quotient"))


def seats_of_sources(sources: DataFrame, block: int, most: int) -> DataFrame:
    """Add ``blocks`` (of the source) and ``seats`` (blocks that the mix takes of it)."""
    total, wanted, parties = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("target"), F.count(F.when(F.col("target") > 0, 1))).first()
    seats = total // block
    blocks = F.ceil(F.col("source_size") / F.lit(block))
    rows = sources.withColumn("blocks", blocks)
    share = F.col("target") / F.lit(wanted or 1.0)
    least, upper = _window_of_seats(share, F.lit(float(seats)), F.lit(float(parties)), F.col("blocks") * most)
    rows = materialize(rows.select("*", least.alias("__least"), upper.alias("__upper")), "seats")
    left = seats - (rows.agg(F.sum("__least")).first()[0] or 0)
    ranked = running(_candidates(rows, ["idx"], "target"), [F.col("__quotient").desc(), F.col("idx")], {"__rank": F.lit(1)})
    more = ranked.where(F.col("__rank") < left).groupBy("idx").agg(F.count("*").alias("__more"))
    out = rows.join(more, "idx", "left")
    return out.select(*sources.columns, "blocks", (F.col("__least") + F.coalesce("__more", F.lit(0))).alias("seats"))


def quotas_of_shards(cells: DataFrame, block: int, most: int, seed: str) -> DataFrame:
    """Quotas of ``cells``: ``idx, seats, blocks, shard, size`` of each shard of each source, of which there are boundedly many.

    Result: also ``base`` (words of the source before the shard), ``first``
    and ``n`` (blocks that start in it), ``quota``, ``offset``, and
    ``__last`` (how often the block is taken that runs into the shard).
    """
    by_shard = Window.partitionBy("idx").orderBy("shard")
    rows = cells.withColumn("base", F.sum("size").over(by_shard) - F.col("size"))
    upto = lambda words: F.ceil(words / F.lit(block))
    rows = rows.select("*", upto(F.col("base")).alias("first"), (upto(F.col("base") + F.col("size")) - upto(F.col("base"))).alias("n"))
    own = Window.partitionBy("idx")
    parties = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).over(own).cast("double")
    share = F.when(F.col("blocks") > 0, F.col("n").cast("double") / F.col("blocks").cast("double")).otherwise(0.0)
    least, upper = _window_of_seats(share, F.col("seats").cast("double"), F.col("__parties"), F.col("n") * most)
    rows = rows.withColumn("__parties", parties).select("*", least.alias("__least"), upper.alias("__upper"))
    rows = materialize(rows.withColumn("__left", F.col("seats") - F.sum("__least").over(own)), "cells")
    rank = F.row_number().over(Window.partitionBy("idx").orderBy(F.desc("__quotient"), "shard"))
    more = _candidates(rows, ["idx", "shard", "__left"], "n").withColumn("__rank", rank).where(F.col("__rank") <= F.col("__left"))
    more = more.groupBy("idx", "shard").agg(F.count("*").alias("__more"))
    rows = rows.join(more, ["idx", "shard"], "left").withColumn("quota", F.col("__least") + F.coalesce("__more", F.lit(0)))
    start = digest(F.concat_ws("/", F.lit(seed), F.col("idx").cast("string"), F.col("shard").cast("string")))
    rows = rows.withColumn("offset", F.when(F.col("n") > 0, F.pmod(start, F.greatest("n", F.lit(1)))).otherwise(F.lit(0)))
    last = F.when(F.col("n") > 0, _steps(F.col("n"), F.col("quota"), F.col("n"), F.col("offset")) - _steps(F.col("n") - 1, F.col("quota"), F.col("n"), F.col("offset")))
    before = by_shard.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__taken_last", last).withColumn("__last", F.coalesce(F.last("__taken_last", ignorenulls=True).over(before), F.lit(0)))
    return rows.select(*cells.columns, "base", "first", "n", "quota", "offset", "__last")


def _steps(j: Column, quota: Column, n: Column, offset: Column) -> Column:
    """How often the first ``j`` of ``n`` blocks are taken, all together."""
    return _div(j * quota + offset, F.greatest(n, F.lit(1)))


def mix_sources(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: str = SEED
) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of each row of ``docs`` (``doc_id, source, text``).

    ``size`` counts a text's words.  ``weights`` go to the sources by code
    point, in turns, null last as a source of its own.  ``taken`` is the number
    of a document's words in the mix with repeats, at most ``most`` times its
    size.  A source's ``taken`` differs from its target by a few blocks, whose
    size is ``block`` words or a 65,536th of the table, if that is less.  Null
    and empty texts have size 0 and are never taken; null ids are kept;
    repeated rows are rows each and may be taken differently often.  The same
    rows give the same result, in whatever order they come.
    """
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", "source", size.alias("size"), ids.alias("__id"))
    rows = rows.withColumn("__place", digest(F.concat_ws("/", F.lit(seed), F.col("__id"), F.col("size").cast("string"))))
    sized = materialize(rows.drop("__id"), "sizes")
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = max(1, min(block, total // LEAST_BLOCKS))
    shards = max(LEAST_SHARDS, math.ceil(n / SHARD_ROWS))
    shard = F.pmod(F.col("__place"), F.lit(shards)).alias("shard")
    # no join on a null, and none on the source alone, which may hold a third of all rows
    source = [F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__null")]
    sized = sized.select("doc_id", *source, shard, "size", "__place")
    key = ["__s", "__null", "shard"]
    cells = materialize(sized.groupBy(*key).agg(F.sum("size").alias("size")), "shards")
    sources = cells.select(F.when(~F.col("__null"), F.col("__s")).alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = seats_of_sources(materialize(targets(sources, weights, most), "targets"), block, most)
    shares = shares.select(*source, "idx", "source_size", "target", "blocks", "seats")
    quotas = quotas_of_shards(cells.join(shares, ["__s", "__null"]), block, most, seed).withColumnRenamed("size", "__cell")
    # a document's words lie from here on among its source's
    before = Window.partitionBy(*key).orderBy("__place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("__before", F.coalesce(F.sum("size").over(before), F.lit(0))).join(quotas, key)
    placed = placed.withColumn("__begin", F.col("base") + F.col("__before")).withColumn("__end", F.col("__begin") + F.col("size"))
    own = F.col("first") * block

    def upto(word: Column) -> Column:
        """Words taken of the shard's own blocks before ``word``."""
        inside = F.greatest(word - own, F.lit(0))
        j = _div(inside, F.lit(block))
        whole, again = (_steps(x, F.col("quota"), F.col("n"), F.col("offset")) for x in (j, j + 1))
        return whole * block + (inside - j * block) * (again - whole)

    carried = (F.least("__end", own) - F.least("__begin", own)) * F.col("__last")
    taken = F.when(F.col("size") > 0, upto(F.col("__end")) - upto(F.col("__begin")) + carried).otherwise(0)
    return placed.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
