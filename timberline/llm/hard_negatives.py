"""Hard negatives by one-dimensional distance keys.

One more coordinate gives all vectors the same length, so a larger inner
product is a smaller distance.  Each vector's key is its nearest pivot and its
distance from it; vectors are stored in blocks sorted by key.  By the triangle
inequality a vector at distance ``r`` from a query has a key within ``r`` of
the query's own distance from that pivot, so a block's interval of keys bounds
how near its vectors can be.  A query scans blocks in the order of that bound,
more of them each round, and is done when the bound of the next block passes
the distance of its ``k``-th answer.  An answer may be asked to lie in a window
of scores: those are annuli around the query, with several of them scanned at once.

Queries travel to blocks in packs, and a block's rows stream past them, so a
task holds a bounded number of queries and their answers so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.tables import materialize

#: Pivots, picked from the rows of least hash; any pivots give the same result.
PIVOTS = 32
PIVOT_SAMPLE = 1024
#: Rows of a block, about, and the most blocks there may be: the list of their key intervals goes to every task.
BLOCK_ROWS = 8192
MOST_BLOCKS = 1 << 16
#: Rows stored together.
CHUNK = 512
#: Queries that travel together, and that meet in one task at most, about.
PACK = 256
TASK_QUERIES = 50_000
#: Each round scans so many times more blocks.
WIDEN = 16
#: Integer vectors are at most this long, squared, so that no inner product leaves 64 bits.
REACH = 2.0**62
LEAST = -(1 << 62)


def _integers(rows: DataFrame, scale: float) -> DataFrame:
    """``vec_id, label, v array<int>`` of usable rows, each once."""
    x = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    x = x.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("x") > 0)).where(F.forall("x", fine))
    whole = x.select("vec_id", "label", F.transform("x", lambda c: F.floor(F.lit(scale) * c).cast("double")).alias("v"))
    near = whole.where(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c) < REACH)
    return near.select("vec_id", "label", F.col("v").cast("array<int>").alias("v")).distinct()


class Space:
    """Lifted vectors and their distances from pivots."""

    def __init__(self, longest: int, width: int, pivots: np.ndarray):
        self.longest, self.width = longest, width
        #: Inner products of whole numbers below 2**53 are exact in any order of summing.
        self.kind = np.float64 if longest < 1 << 53 else np.int64
        self.pivots = pivots.astype(np.float64)
        self.lifts = self._lift(self.pivots)
        self.slack = 1e-6 * (2 * math.sqrt(longest) + 1)

    def padded(self, values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Rows of vectors; those that are shorter than the longest end in zeros."""
        out = np.zeros((len(sizes), self.width), dtype=self.kind)
        out[np.arange(self.width) < sizes[:, None]] = values
        return out

    def _lift(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - (x.astype(np.float64) ** 2).sum(axis=1), 0.0))

    def keys(self, x: np.ndarray, lifted: bool) -> np.ndarray:
        """Distances from every pivot; queries have no lift."""
        x = x.astype(np.float64)
        lift = self._lift(x) if lifted else np.zeros(len(x))
        square = (x**2).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(square + (lift[:, None] - self.lifts) ** 2, 0.0))

    def distance(self, length: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Distance at which the queries of squared ``length`` have ``score``."""
        return np.sqrt(np.maximum(self.longest + length[:, None] - 2.0 * score, 0.0))


def _vectors(column: pa.Array, space: Space) -> np.ndarray:
    return space.padded(np.asarray(column.flatten()), np.asarray(column.value_lengths()))


def build_index(rows: DataFrame, space: Space, n: int) -> DataFrame:
    """``rows`` in chunks of one pivot, sorted by distance, dealt to blocks by key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4 * CHUNK):
                part = batch.slice(at, 4 * CHUNK)
                keys = space.keys(_vectors(part.column(2), space), True)
                pivot = keys.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int32()), pa.array(keys[np.arange(len(part)), pivot]), *part.columns], names=["pivot", "key", "vec_id", "label", "v"])

    blocks = min(max(1, math.ceil(n / BLOCK_ROWS)), MOST_BLOCKS)
    dealt = rows.select("vec_id", "label", "v").mapInArrow(keyed, "pivot int, key double, vec_id long, label long, v array<int>")
    dealt = dealt.repartitionByRange(blocks, "pivot", "key", "vec_id").withColumn("block", F.spark_partition_id()).sortWithinPartitions("pivot", "key", "vec_id")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.concatenate(([0], np.flatnonzero(pivot[1:] != pivot[:-1]) + 1, [len(pivot)]))
            starts = [s for lo, hi in zip(cuts[:-1], cuts[1:], strict=True) for s in range(lo, hi, CHUNK)]
            for lo, hi in zip(starts, [*starts[1:], len(pivot)], strict=True):
                part = batch.slice(lo, hi - lo)
                ids, labels = np.asarray(part.column(2)), np.asarray(part.column(3))
                x = _vectors(part.column(4), space).astype(np.int32)
                row = (int(part.column(5)[0].as_py()), int(pivot[lo]), key[lo:hi].min(), key[lo:hi].max(), ids.tobytes(), labels.tobytes(), x.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _CHUNK_TYPES, strict=True)], names=_CHUNK_NAMES)

    return materialize(dealt.mapInArrow(packed, "block int, pivot int, lo double, hi double, ids binary, labels binary, vectors binary"), "index")


_CHUNK_NAMES = ["block", "pivot", "lo", "hi", "ids", "labels", "vectors"]
_CHUNK_TYPES = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]


class Directory:
    """Key intervals of blocks, by pivot."""

    def __init__(self, index: DataFrame):
        entries = index.groupBy("block", "pivot").agg(F.min("lo"), F.max("hi")).orderBy("block", "pivot").collect()  # blocks and pivots, both bounded
        self.block = np.array([e[0] for e in entries], dtype=np.int64)
        self.pivot = np.array([e[1] for e in entries], dtype=np.int64)
        self.lo, self.hi = (np.array([e[k] for e in entries], dtype=np.float64) for k in (2, 3))
        self.names, self.first = np.unique(self.block, return_index=True)

    def bounds(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, blocks): least and most distance that a block's vectors may have."""
        own = keys[:, self.pivot]
        near = np.maximum(np.maximum(self.lo - own, own - self.hi), 0.0)
        return np.minimum.reduceat(near, self.first, axis=1), np.maximum.reduceat(own + self.hi, self.first, axis=1)


_SENT = "block int, part int, kind int, pivot int, lo double, hi double, ids binary, labels binary, vectors binary, anchors binary, windows binary"
_SENT_NAMES = ["block", "part", "kind", "pivot", "lo", "hi", "ids", "labels", "vectors", "anchors", "windows"]


def _sent(queries: DataFrame, space: Space, directory: Directory, begin: int, end: int, parts: int) -> DataFrame:
    """Packs of queries for blocks ``begin`` to ``end`` of their order, if they may hold an answer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = 0
        for batch in batches:
            for at in range(0, len(batch), PACK):
                part = batch.slice(at, PACK)
                anchors, ids, labels = (np.asarray(part.column(c)) for c in (0, 1, 2))
                x = _vectors(part.column(3), space)
                windows = np.asarray(part.column(4).flatten().flatten()).reshape(len(part), -1, 2)  # lowest and highest score
                length = (x.astype(np.float64) ** 2).sum(axis=1)
                reach = space.distance(length, windows[:, :, 0]).max(axis=1) + space.slack
                inner = space.distance(length, windows[:, :, 1]).min(axis=1) - space.slack
                near, far = directory.bounds(space.keys(x, False))
                order = np.argsort(near, axis=1, kind="stable")[:, begin:end]
                wanted = np.zeros(near.shape, dtype=bool)
                np.put_along_axis(wanted, order, np.take_along_axis(near, order, axis=1) <= reach[:, None], axis=1)
                wanted &= far >= inner[:, None]
                for b in np.flatnonzero(wanted.any(axis=0)):
                    who = np.flatnonzero(wanted[:, b])
                    row = (int(directory.names[b]), count % parts, 0, -1, 0.0, 0.0, *[v[who].tobytes() for v in (ids, labels, x.astype(np.int32), anchors, windows)])
                    types = [pa.int32()] * 4 + [pa.float64()] * 2 + [pa.binary()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=_SENT_NAMES)
                count += 1

    return queries.select("anchor", "vec_id", "label", "v", "windows").mapInArrow(run, _SENT)


class Answers:
    """The ``k`` best rows so far of each window of some queries."""

    def __init__(self, space: Space, k: int, same: bool, packs: list[tuple[bytes, ...]]):
        self.space, self.k, self.same = space, k, same
        self.own, self.label, x, self.anchor, windows = (b"".join(c) for c in zip(*packs, strict=True))
        self.own, self.label, self.anchor = (np.frombuffer(c, dtype=np.int64) for c in (self.own, self.label, self.anchor))
        self.x = np.frombuffer(x, dtype=np.int32).reshape(-1, space.width).astype(space.kind)
        windows = np.frombuffer(windows, dtype=np.int64).reshape(len(self.own), -1, 2)
        self.least, self.most = windows[:, :, 0].copy(), windows[:, :, 1]
        self.length = (self.x.astype(np.float64) ** 2).sum(axis=1)
        self.keys = space.keys(self.x, False)
        self.inner = space.distance(self.length, self.most).min(axis=1) - space.slack
        self.who = self.score = self.id = np.zeros(0, dtype=np.int64)  # who: query * windows + window

    def scan(self, pivot: int, lo: float, hi: float, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        key = self.keys[:, pivot]
        reach = self.space.distance(self.length, self.least).max(axis=1) + self.space.slack
        live = np.flatnonzero((np.maximum(lo - key, key - hi) <= reach) & (key + hi >= self.inner))
        if not len(live):
            return
        score = (self.x[live] @ x.astype(self.space.kind).T).astype(np.int64)
        open_ = ((self.label[live][:, None] == labels) == self.same) & (self.own[live][:, None] != ids)
        who, scores, found = [self.who], [self.score], [self.id]
        n = self.least.shape[1]
        for w in range(n):
            q, r = np.nonzero(open_ & (score >= self.least[live, w][:, None]) & (score <= self.most[live, w][:, None]))
            who.append(live[q] * n + w)
            scores.append(score[q, r])
            found.append(ids[r])
        who, scores, found = (np.concatenate(c) for c in (who, scores, found))
        order = np.lexsort((found, -scores, who))
        who, scores, found = who[order], scores[order], found[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < self.k
        self.who, self.score, self.id = who[keep], scores[keep], found[keep]
        last = place[keep] == self.k - 1
        self.least.reshape(-1)[self.who[last]] = self.score[last]

    def rows(self) -> pa.RecordBatch:
        n = self.least.shape[1]
        columns = [self.anchor[self.who // n], (self.who % n).astype(np.int32), self.id, self.score]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["anchor", "window", "vec_id", "score"])


def search(index: DataFrame, directory: Directory, space: Space, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor, window, rank, vec_id, score``: the ``k`` best rows in each window of each query.

    ``queries`` holds ``anchor`` (unique), ``vec_id, label, v`` and ``windows``,
    an array of ``[lowest score, highest score]``, as many for each query.
    Answers have the query's label, or another if not ``same``, and another id.
    """
    spark = queries.sparkSession
    parts = max(1, math.ceil(queries.count() / TASK_QUERIES))
    n_blocks = len(directory.names)
    found = spark.createDataFrame([], "anchor long, window int, rank int, vec_id long, score long")
    if not n_blocks:
        return found
    best = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id")
    asked, begin, width = queries, 0, 1
    top = int(directory.names.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come block by block, the packs of queries before the chunks."""
        here, packs, answers = None, [], None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["block"], r["part"]) != here:
                    if answers is not None:
                        yield answers.rows()
                    here, packs, answers = (r["block"], r["part"]), [], None
                if r["kind"] == 0:
                    packs.append(tuple(r[c] for c in ("ids", "labels", "vectors", "anchors", "windows")))
                    continue
                if not packs:
                    continue
                if answers is None:
                    answers = Answers(space, k, same, packs)
                ids, labels = (np.frombuffer(r[c], dtype=np.int64) for c in ("ids", "labels"))
                answers.scan(r["pivot"], r["lo"], r["hi"], ids, labels, np.frombuffer(r["vectors"], dtype=np.int32).reshape(-1, space.width))
        if answers is not None:
            yield answers.rows()

    while begin < n_blocks:
        end = min(n_blocks, begin + width)
        sent = materialize(_sent(asked, space, directory, begin, end, parts), "sent")
        if sent.isEmpty():
            break  # every query is certified
        needed = sent.select("block", "part").distinct()
        chunks = index.join(F.broadcast(needed), "block")  # one row a block and part, at most MOST_BLOCKS * parts
        none = F.lit(None).cast("binary")
        chunks = chunks.select("block", "part", F.lit(1).alias("kind"), "pivot", "lo", "hi", "ids", "labels", "vectors", none.alias("anchors"), none.alias("windows"))
        rows = sent.unionByName(chunks).repartitionById(top * parts, F.col("block") * parts + F.col("part"))
        new = rows.sortWithinPartitions("block", "part", "kind", "pivot", "lo").mapInArrow(run, "anchor long, window int, vec_id long, score long")
        both = found.drop("rank").unionByName(new).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        found = materialize(both.select("anchor", "window", "rank", "vec_id", "score"), "found")
        # a window that has its k answers is open to none below the last of them
        kth = found.where(F.col("rank") == k).groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("__kth"))
        raised = F.transform("windows", lambda w, i: F.array(F.coalesce(F.element_at("__kth", i.cast("int")), w[0]), w[1]))
        asked = queries.join(kth, "anchor", "left").withColumn("windows", raised)
        begin, width = end, width * WIDEN
    return found


def _share(score: Column, percent: int, up: bool) -> Column:
    """``percent`` hundredths of a whole number, to the next whole number."""
    exact = score.cast("decimal(20,0)") * F.lit(percent).cast("decimal(4,0)") / F.lit(100).cast("decimal(3,0)")
    return (F.ceil(exact) if up else F.floor(exact)).cast("long")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` holds ``vec_id, label, embedding``; ``anchors`` is a condition on
    them.  Components become ``floor(scale * x)``, and scores are inner products
    of those, exact.  An anchor's positives are its ``positives`` best other
    rows of its label; for each, the ``negatives`` best rows of other labels
    between ``low`` and ``high`` percent of its score are given, best first.
    Ties go to the smaller id.  Rows with a null id, label, vector or component,
    a component that is not finite, no component, or a squared length of 2**62
    and more take no part.  Repeated rows count once; rows that share an id are
    each a candidate, except for an anchor of that id.  A shorter vector counts
    as if zeros followed it.  An anchor without a row that fits has no row.
    """
    chosen = rows.select("vec_id", "label", "embedding").where(anchors)
    usable = materialize(_integers(rows, scale), "integers")
    asked = materialize(_integers(chosen, scale).select(F.monotonically_increasing_id().alias("anchor"), "vec_id", "label", "v"), "anchors")
    # of equal vectors of one label, the first few can be answers
    first = F.row_number().over(Window.partitionBy("v", "label").orderBy("vec_id"))
    kept = usable.withColumn("__n", first).where(F.col("__n") <= max(positives, negatives) + 1).drop("__n")
    square = F.aggregate("v", F.lit(0).cast("long"), lambda s, c: s + c.cast("long") * c.cast("long"))
    n, longest, width = usable.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    sample = usable.orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label").limit(PIVOT_SAMPLE).select("v").collect()
    space = Space(longest or 0, width or 1, _pivots([r.v for r in sample], width or 1))
    index = build_index(kept, space, n)
    directory = Directory(index)
    whole = F.array(F.array(F.lit(LEAST), F.lit(-LEAST)))
    best = search(index, directory, space, asked.withColumn("windows", whole), positives, True)
    best = best.select("anchor", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    window = F.array(_share(F.col("positive_score"), low, True), _share(F.col("positive_score"), high, False))
    # as many windows for each anchor: where positives lack, or nothing lies between, a window is empty
    closed = F.array(F.lit(1).cast("long"), F.lit(0).cast("long"))
    listed = best.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("place", window.alias("w")))).alias("__w"))
    places = F.sequence(F.lit(1), F.lit(positives))
    windows = F.transform(places, lambda p: F.coalesce(F.element_at("__w", p), closed))
    wanted = asked.join(listed, "anchor").withColumn("windows", F.transform(windows, lambda w: F.when(w[0] <= w[1], w).otherwise(closed))).drop("__w")
    wanted = materialize(wanted.where(F.exists("windows", lambda w: w[0] <= w[1])), "wanted")
    found = search(index, directory, space, wanted, negatives, False).select("anchor", (F.col("window") + 1).alias("place"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(best, ["anchor", "place"]).join(asked.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _pivots(sample: list[list[int]], width: int) -> np.ndarray:
    """Each pivot is the row of the sample that is farthest from those before."""
    x = np.zeros((max(len(sample), 1), width))
    for k, v in enumerate(sample):
        x[k, : len(v)] = v
    picked = [0]
    far = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < min(PIVOTS, len(x)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = reduce(np.minimum, [far, ((x - x[picked[-1]]) ** 2).sum(axis=1)])
    return x[picked]
