"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

A document is looked at through windows of as many word shingles as a benchmark
item has.  The SimHash fingerprint of a window is compared with those of the
items of its size: fingerprints are cut into one block more than the radius, so
two of them within the radius agree in a block, and an equality join on blocks
finds every such pair.  A weighted comparison of the shingles themselves then
decides.

Only windows that can pass are fingerprinted.  A window as similar to an item
as asked for holds three quarters of the item's shingles at least, so one of
the item's shingles stands within its first quarter and one within its last
(with one more each); other windows have no chance whatever their fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.tables import materialize

WORDS = 5
SIMILARITY = 0.75
#: Two windows of similarity 0.75 differ in 11 of 64 bits on average, and in
#: more than 20 with probability 0.001.
RADIUS = 20
#: Bytes sent to all tasks at most, by count and size of the rows; larger sides are shuffled.
BROADCAST_BYTES = 1 << 25

_BLOCKS = RADIUS + 1
_STARTS = [64 * k // _BLOCKS for k in range(_BLOCKS)]
_SIZES = [64 * (k + 1) // _BLOCKS - 64 * k // _BLOCKS for k in range(_BLOCKS)]


def shingles(text: Column) -> Column:
    """``array<long>``: hashes of the word shingles of a text in order; fewer words than five are one shingle."""
    clean = F.trim(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    words = F.split(clean, r"[\x20\x09-\x0D]+")
    five = lambda w, i: F.xxhash64(*[w[i + k] for k in range(WORDS)])
    return F.transform(
        F.array(words),
        lambda w: F.when(F.size(w) >= WORDS, F.transform(F.sequence(F.lit(0), F.size(w) - WORDS), lambda i: five(w, i)))
        .when(w[0] != "", F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.array().cast("array<bigint>")),
    )[0]


def numbered(hashes: str) -> Column:
    """The hashes with repeats told apart by their number, so that sets of them count as bags.

    In the sorted array a hash is its value's ``j``-th if ``j`` places before it
    stand equal ones; ``j`` is found by halving steps.
    """
    before = "aggregate(transform(sequence(30, 0, -1), e -> shiftleft(1, e)), 0, (j, b) -> if(i - j - b >= 0, if(get(o, i - j - b) = h, j + b, j), j))"
    again = F.expr(f"transform(array(array_sort({hashes})), o -> transform(o, (h, i) -> xxhash64(h, {before})))[0]")
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.transform(hashes, lambda h: F.xxhash64(h, F.lit(0)))).otherwise(again)


def simhash(hashes: str, size: str) -> str:
    """SQL of the 64-bit SimHash of an array of hashes: each bit is set where most of ``size`` hashes have it.

    Sixteen longs hold four 16-bit counters each; from 65536 hashes on, 32
    longs hold two 32-bit counters each.
    """

    def counted(lanes: int) -> str:
        # one bit at the bottom of each counter of a long
        ones = sum(1 << (lanes * j) for j in range(64 // lanes))
        zero = ", ".join(f"0L as l{k}" for k in range(lanes))
        add = ", ".join(f"acc.l{k} + (shiftrightunsigned(h, {k}) & {ones}L) as l{k}" for k in range(lanes))
        bits = " | ".join(f"if(2 * (shiftrightunsigned(acc.l{k}, {lanes * j}) & {(1 << lanes) - 1}L) > {size}, shiftleft(1L, {k + lanes * j}), 0L)" for k in range(lanes) for j in range(64 // lanes))
        return f"aggregate({hashes}, struct({zero}), (acc, h) -> struct({add}), acc -> {bits})"

    return f"if({size} < 65536, {counted(16)}, {counted(32)})"


def _blocks(fingerprint: str) -> Column:
    parts = ", ".join(f"shiftrightunsigned({fingerprint}, {at}) & {(1 << size) - 1}L" for at, size in zip(_STARTS, _SIZES, strict=True))
    return F.expr(f"array({parts})")


def _small(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcasting if its rows of ``row_bytes``, as counted, are few enough."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    """``item_id, size, item_shingles, item_key, item_print`` of every item with a word; the key is a hash of the shingles."""
    items = benchmark.select("item_id", shingles(F.col("text")).alias("item_shingles"))
    items = items.withColumn("size", F.size("item_shingles")).where("size > 0").distinct()
    return items.withColumn("item_key", F.xxhash64("item_shingles")).withColumn("item_print", F.expr(simhash("item_shingles", "size")))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Documents that hold a benchmark item, whole or nearly.

    Takes ``docs(doc_id, text)`` and ``benchmark(item_id, text)``; other columns
    are ignored.  Returns one row per document id and item with the best
    window: ``doc_id, item_id, similarity, start_word, n_shingles, hamming``.
    Similarity is the sum of the lesser counts of each shingle over the sum of
    the greater ones.  Null and empty texts and items match nothing; repeated
    rows count once; of equally similar windows the first is named.  An item of
    fewer than five words is one shingle, so only a document that consists of
    the same words holds it.  The work for a document that holds an item grows
    with the square of the item's length, up to a quarter of its windows.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    # a row is known by two hashes of its id and text
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text").alias("k1"), F.hash("text").alias("k2"))
    items = materialize(item_fingerprints(benchmark.select("item_id", "text")), "items")

    # item shingles in the documents, and the windows that have one near each end
    wanted = items.select("size", F.explode("item_shingles").alias("h")).distinct()
    quarter = F.floor(F.col("size") * (1 - similarity)).cast("int") + 1
    places = keyed.select("k1", "k2", shingles(F.col("text")).alias("s")).select("k1", "k2", F.size("s").alias("n"), F.posexplode("s").alias("p", "h"))
    hits = places.join(_small(wanted, 32), "h").where(F.col("n") >= F.col("size") * similarity)
    hits = hits.select("k1", "k2", "n", "size", "p", quarter.alias("q"))
    sides = hits.select("k1", "k2", "n", "size", F.explode(F.expr("""concat(
        transform(sequence(p - q + 1, p), s -> struct(s, 1 as side)),
        transform(sequence(p - size + 1, p - size + q), s -> struct(s, 2 as side)))""")).alias("w"))
    last = F.greatest(F.col("n") - F.col("size"), F.lit(0))
    sides = sides.select("k1", "k2", "size", F.least(F.greatest(F.col("w.s"), F.lit(0)), last).alias("start"), (F.col("w.side") == 1).cast("int").alias("head"), (F.col("w.side") == 2).cast("int").alias("tail"))
    starts = sides.groupBy("k1", "k2", "size", "start").agg(F.max("head").alias("head"), F.max("tail").alias("tail")).where("head = 1 and tail = 1")
    per_doc = materialize(starts.groupBy("k1", "k2").agg(F.collect_list(F.struct("size", "start")).alias("windows")), "windows")

    # their fingerprints; a window itself is never written
    texts = keyed.join(_small(per_doc.select("k1", "k2"), 32), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    window = "slice(s, w.start + 1, w.size)"
    held = "least(w.size, size(s) - w.start)"
    printed = F.expr(f"transform(windows, w -> named_struct('size', w.size, 'start', w.start, 'held', {held}, 'print', {simhash(window, held)}))")
    seen = texts.join(per_doc, ["k1", "k2"]).select("k1", "k2", shingles(F.col("text")).alias("s"), "windows")
    seen = materialize(seen.select("k1", "k2", F.explode(printed).alias("w")).select("k1", "k2", "w.*"), "prints")

    # every pair within the radius, once, by its first equal block
    index = items.select("item_id", "item_key", "size", "item_print", F.posexplode(_blocks("item_print")).alias("block", "bits"))
    cut = seen.select("*", F.posexplode(_blocks("print")).alias("block", "bits"))
    pairs = cut.join(_small(index, 64), ["size", "block", "bits"])
    first = F.array_position(F.transform(_blocks("(print ^ item_print)"), lambda b: (b == 0).cast("int")), 1) - 1
    hamming = F.expr("bit_count(print ^ item_print)")
    pairs = pairs.where((hamming <= RADIUS) & (first == F.col("block")))
    pairs = materialize(pairs.select("k1", "k2", "item_id", "item_key", "size", "start", "held", hamming.cast("int").alias("hamming")), "pairs")

    # weighted shingle similarity
    per_doc = pairs.groupBy("k1", "k2").agg(F.collect_list(F.struct("item_id", "item_key", "size", "start", "held", "hamming")).alias("windows"))
    texts = keyed.join(_small(pairs.select("k1", "k2").distinct(), 32), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    near = texts.join(per_doc, ["k1", "k2"]).select("doc_id", shingles(F.col("text")).alias("s"), "windows")
    near = near.select("doc_id", F.explode(F.expr(f"transform(windows, w -> struct(w as at, {window} as window_shingles))")).alias("w"))
    near = near.select("doc_id", "w.at.*", "w.window_shingles")
    bags = items.select("item_key", "size", "item_shingles").distinct()
    whole = bags.agg(F.sum(F.col("size") * 8 + 96)).first()[0] or 0  # bytes
    near = near.join(F.broadcast(bags) if whole <= BROADCAST_BYTES else bags, ["item_key", "size"])
    common = F.size(F.array_intersect(numbered("item_shingles"), numbered("window_shingles")))
    scored = near.select("doc_id", "item_id", "start", "size", "held", "hamming", common.alias("common"))
    value = F.col("common") / (F.col("size") + F.col("held") - F.col("common"))
    scored = scored.withColumn("similarity", value).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size", (-F.col("hamming")).alias("near"))).alias("b"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("b.similarity").alias("similarity"),
        (-F.col("b.back")).cast("int").alias("start_word"),
        F.col("b.size").cast("int").alias("n_shingles"),
        (-F.col("b.near")).cast("int").alias("hamming"),
    )
