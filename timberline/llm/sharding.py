"""Shard placement by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized
table (a start and a stride from its name).  Shards take turns, and on its turn
a shard claims the first slot of its order that is still free.  A key's digest
picks a slot, the slot names the shard: placement is one lookup in a broadcast
table whose size is a parameter, never a function of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_SIZE = 2053
SHARDS = 16


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def digest(text: Column, start: int = 1) -> Column:
    """60 bits of the MD5 digest as a long; ``start`` picks the hex digits."""
    return F.conv(F.substring(F.md5(text), start, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, n_shards: int = SHARDS, size: int = TABLE_SIZE, prefix: str = "shard-") -> DataFrame:
    """``slot int, shard int``: every slot of the table, claimed in turns.

    The fold has ``size`` steps over arrays of ``size`` slots, so its cost is
    the square of a parameter; sizes of a few thousand suit up to a hundred
    shards (the share of a shard is off by at most about ``n_shards / size``).
    """
    if not _is_prime(size) or not 0 < n_shards <= size:
        raise ValueError("the table's size must be a prime of at least n_shards")
    order = spark.range(n_shards).select(
        F.col("id").cast("int").alias("shard"),
        F.pmod(digest(F.concat(F.lit(prefix), F.col("id").cast("string"))), F.lit(size)).cast("int").alias("start"),
        (F.pmod(digest(F.concat(F.lit(prefix), F.col("id").cast("string")), 17), F.lit(size - 1)) + 1).cast("int").alias("stride"),
    )
    shards = order.agg(F.sort_array(F.collect_list(F.struct("shard", "start", "stride"))).alias("shards"))
    turns = f"""
        aggregate(
          sequence(0, {size - 1}),
          named_struct('slots', array_repeat(-1, {size}), 'next', array_repeat(0, {n_shards})),
          (acc, turn) -> transform(
            array(named_struct('acc', acc, 'who', shards[turn % {n_shards}], 'from', acc.next[turn % {n_shards}])),
            s -> transform(
              array(filter(sequence(s.from, {size - 1}),
                j -> s.acc.slots[cast((s.who.start + cast(j as bigint) * s.who.stride) % {size} as int)] = -1)[0]),
              j -> named_struct(
                'slots', transform(s.acc.slots, (x, k) ->
                  if(k = cast((s.who.start + cast(j as bigint) * s.who.stride) % {size} as int), s.who.shard, x)),
                'next', transform(s.acc.next, (x, k) -> if(k = s.who.shard, j + 1, x)))
            )[0]
          )[0],
          acc -> acc.slots)
    """
    filled = shards.select(F.expr(turns).alias("slots"))
    return filled.select(F.posexplode("slots").alias("slot", "shard"))


def assign_shards(df: DataFrame, key: str, n_shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """All rows and columns of ``df`` with ``slot`` and ``shard`` added.

    A null key is placed as the empty string; repeated keys share a shard; an
    empty table gives an empty result.  Columns of ``df`` that are named
    ``slot`` or ``shard`` are replaced.  No row of ``df`` is shuffled.
    """
    table = lookup_table(df.sparkSession, n_shards, size)
    kept = [c for c in df.columns if c not in ("slot", "shard")]
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))
    placed = df.select(*[F.col(f"`{c}`") for c in df.columns if c in kept or c == key], F.pmod(digest(text), F.lit(size)).cast("int").alias("__slot"))
    table = table.select(F.col("slot").alias("__at"), F.col("shard").alias("__shard"))
    joined = placed.join(F.broadcast(table), F.col("__slot") == F.col("__at"))  # `size` rows, a parameter
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def write_shards(df: DataFrame, key: str, path: str, n_shards: int = SHARDS, size: int = TABLE_SIZE, files_per_shard: int = 8) -> None:
    """Write ``df`` in one folder per shard; a shard's rows are dealt to several tasks."""
    placed = assign_shards(df, key, n_shards, size)
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in placed.columns]), F.lit(files_per_shard))
    placed.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)
