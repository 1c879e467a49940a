"""Approximate nearest neighbours by robust-pruned directed graphs.

Vectors are dealt to shards by a hash.  In each shard a graph is grown in
batches: a greedy search from the shard's middle proposes neighbours for every
new vector, and relaxed distance pruning keeps those that no kept neighbour is
clearly closer to, so edges stay few and diverse.  A beam search walks the
graph of every shard for every query, and the shards' answers are merged.
Largest inner product becomes least distance by one more coordinate.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a shard at most, about, and bytes of them; a shard's vectors and graph fit in one task.
SHARD_SIZE = 10_000
SHARD_BYTES = 1 << 26
#: Shards of a small table, so that several tasks share the work.
LEAST_SHARDS = 8
DEGREE = 32
BUILD_BEAM = 64
SEARCH_BEAM = 96
#: Kept edges may be so many times longer than the way round.
RELAXED = 1.2
#: Queries that a beam search takes at a time.
BLOCK = 512


class Graph:
    """The graph of one shard's vectors; distances are squared Euclidean."""

    def __init__(self, vectors: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relaxed: float = RELAXED):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        self.degree, self.relaxed = degree, relaxed
        n = len(self.x)
        self.square = (self.x**2).sum(axis=1)
        self.edges = np.full((n, degree), -1, dtype=np.int32)
        middle = self.x.mean(axis=0)
        self.start = int(((self.x - middle) ** 2).sum(axis=1).argmin())
        order = np.random.default_rng(5).permutation(n).astype(np.int32)
        order = np.concatenate(([self.start], order[order != self.start])).astype(np.int32)
        at = 1
        while at < n:  # batches double, so a search always has a fair part of the graph to walk
            stop = min(n, at + min(max(at, 8), 1024))
            self._insert(order[at:stop], beam)
            at = stop
        if n > 1:
            for lo in range(0, n, 1024):  # once more, on the whole graph
                self._insert(order[lo : lo + 1024], beam)

    def _distances(self, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """(queries, ids per query) squared distances up to a constant of the query; -1 is infinitely far."""
        safe = np.maximum(ids, 0)
        d = self.square[safe] - 2 * np.einsum("qkd,qd->qk", self.x[safe], queries)
        d[ids < 0] = np.inf
        return d

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: ``(ids, distances)`` of the beam, nearest first, -1 where it has no more."""
        q = len(queries)
        rows = np.arange(q)
        ids = np.full((q, beam), -1, dtype=np.int32)
        far = np.full((q, beam), np.inf, dtype=np.float32)
        done = np.zeros((q, beam), dtype=bool)
        seen = np.zeros((q, len(self.x)), dtype=bool)
        ids[:, 0] = self.start
        far[:, 0] = self._distances(queries, ids[:, :1])[:, 0]
        seen[:, self.start] = True
        active = rows
        while len(active):
            todo = np.where(done[active] | (ids[active] < 0), np.inf, far[active])
            best = todo.argmin(axis=1)
            going = np.isfinite(todo[np.arange(len(active)), best])
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            near = self.edges[ids[active, best]]
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            near = np.where(fresh, near, -1)
            a, k = np.nonzero(fresh)
            seen[active[a], near[a, k]] = True
            d = self._distances(queries[active], near)
            all_ids = np.concatenate((ids[active], near), axis=1)
            all_far = np.concatenate((far[active], d), axis=1)
            all_done = np.concatenate((done[active], np.zeros(near.shape, dtype=bool)), axis=1)
            keep = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            ids[active], far[active], done[active] = (np.take_along_axis(v, keep, axis=1) for v in (all_ids, all_far, all_done))
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(far, order, axis=1)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning of each node's candidates (rows of ids, -1 for none) to ``degree`` edges."""
        c = np.sort(np.where(candidates == nodes[:, None], -1, candidates), axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        d = self._distances(self.x[nodes], c) + self.square[nodes][:, None]
        order = np.argsort(d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, axis=1), np.take_along_axis(d, order, axis=1)
        out = np.full((len(nodes), self.degree), -1, dtype=np.int32)
        count = np.zeros(len(nodes), dtype=int)
        alive = np.isfinite(d)
        rows = np.arange(len(nodes))
        while True:
            first = alive.argmax(axis=1)
            going = alive[rows, first] & (count < self.degree)
            if not going.any():
                return out
            r, f = rows[going], first[going]
            pick = c[r, f]
            out[r, count[r]] = pick
            count[r] += 1
            between = self.square[pick][:, None] + self._distances(self.x[pick], c[r])
            alive[r] &= self.relaxed**2 * between > d[r]
            alive[r, f] = False

    def _insert(self, nodes: np.ndarray, beam: int) -> None:
        """Give ``nodes`` the edges that a search proposes, and edges back to them."""
        for lo in range(0, len(nodes), 256):
            part = nodes[lo : lo + 256]
            found, _ = self.search(self.x[part], beam)
            self.edges[part] = self._prune(part, np.concatenate((found, self.edges[part]), axis=1))
        source = np.repeat(nodes, self.degree)
        target = self.edges[nodes].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        who, begin, count = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(who), int(count.max()) if len(who) else 0), -1, dtype=np.int32)
        for k in range(back.shape[1]):
            has = count > k
            back[has, k] = source[begin[has] + k]
        for lo in range(0, len(who), 256):
            part = who[lo : lo + 256]
            width = int(count[lo : lo + 256].max())
            both = np.concatenate((self.edges[part], back[lo : lo + 256, :width]), axis=1)
            room = (both >= 0).sum(axis=1) <= self.degree
            self.edges[part[~room]] = self._prune(part[~room], both[~room])
            if room.any():
                own = both[room]
                own = np.sort(np.where(own < 0, np.iinfo(np.int32).max, own), axis=1)
                own[:, 1:][own[:, 1:] == own[:, :-1]] = np.iinfo(np.int32).max
                own = np.sort(own, axis=1)[:, : self.degree]
                self.edges[part[room]] = np.where(own == np.iinfo(np.int32).max, -1, own)


def _usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding array<double>`` of rows with an id and finite components, not all zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0))
    return v.where(F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` vectors of largest inner product found for each query.

    ``vectors`` and ``queries`` hold ``vec_id`` and ``embedding``; a query is no
    candidate of its own.  Scores are inner products of the given vectors in
    double precision; ties go to the smaller id.  Rows with a null id or vector,
    a null or non-finite component or only zeros take no part; rows of another
    length than most are other vectors' neighbours only within their length.
    Of equal vectors, as many as can be among the ``k`` answers are searched:
    those of the ``k + 1`` smallest ids, ``k`` rows of each.  Repeated ids are
    repeated candidates; every row with the query's id is its own.
    """
    base, asked = _usable(vectors), _usable(queries)
    # equal vectors stand once in a graph; the least ids of each can be answers
    # (one window with a bound on its rank, so each task ranks its own rows before any are shuffled)
    base = base.groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("__n"))
    base = base.withColumn("__r", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("__r") <= k + 1)
    base = base.select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("__copy"))
    # lengths of the vectors, taken so that no square overflows
    most = F.array_max(F.transform("embedding", F.abs))
    length = most * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    about = _usable(vectors).agg(F.count("*"), F.max(length), F.max(F.size("embedding"))).first()
    n, largest, width = about[0], min(about[1] or 1.0, sys.float_info.max), about[2] or 1
    shards = max(math.ceil(n / min(SHARD_SIZE, max(SHARD_BYTES // (8 * width), 1))), min(LEAST_SHARDS, math.ceil(n / 500)), 1)

    placed = base.select(F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int").alias("shard"), F.size("embedding").alias("dim"), F.lit(0).alias("kind"), "vec_id", "embedding")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.size("embedding").alias("dim"), F.lit(1).alias("kind"), "vec_id", "embedding")
    rows = placed.unionByName(sent).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "dim", "kind", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come shard by shard, the shard's vectors before the queries, so one graph is held at a time."""
        key, held, graph = None, [], None

        def answers(ids: np.ndarray, asked: np.ndarray) -> pa.RecordBatch:
            own_ids, distinct, members = graph[1:]
            if len(distinct) <= SEARCH_BEAM:  # the beam holds all there is
                found = np.tile(np.arange(len(distinct)), (len(asked), 1))
            else:
                unit = asked / np.abs(asked).max(axis=1, keepdims=True)  # a query's length does not change the order
                found, _ = graph[0].search(np.concatenate((unit, np.zeros((len(asked), 1))), axis=1).astype(np.float32), SEARCH_BEAM)
            out_q, out_v, out_s = [], [], []
            for i, row in enumerate(found):
                row = row[row >= 0]
                hit = np.concatenate([members[j] for j in row]) if len(row) else np.zeros(0, dtype=int)
                # a vector is scored once, summed row by row, so that equal vectors tie
                value = np.repeat((distinct[row] * asked[i]).sum(axis=1), [len(members[j]) for j in row])
                value, hit = value[own_ids[hit] != ids[i]], hit[own_ids[hit] != ids[i]]
                best = np.lexsort((own_ids[hit], -value))[:k]
                out_q.append(np.full(len(best), ids[i]))
                out_v.append(own_ids[hit[best]])
                out_s.append(value[best])
            cat = lambda parts, t: pa.array(np.concatenate(parts) if parts else [], t)
            return pa.RecordBatch.from_arrays([cat(out_q, pa.int64()), cat(out_v, pa.int64()), cat(out_s, pa.float64())], ["query_id", "vec_id", "score"])

        def build():
            ids = np.concatenate([a for a, _ in held])
            own = np.concatenate([b for _, b in held])
            distinct, inverse = np.unique(own, axis=0, return_inverse=True)
            order = np.argsort(inverse.reshape(-1), kind="stable")
            members = np.split(order, np.cumsum(np.bincount(inverse.reshape(-1)))[:-1])
            unit = distinct / largest
            lift = np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))
            return Graph(np.concatenate((unit, lift[:, None]), axis=1)), ids, distinct, members

        for batch in batches:
            if not batch.num_rows:
                continue
            shard, dim, kind = (np.asarray(batch.column(c)) for c in (0, 1, 2))
            ids = np.asarray(batch.column(3))
            group = np.stack((shard, dim, kind), axis=1)
            cuts = np.concatenate(([0], np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, [len(group)]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                here = (shard[lo], dim[lo])
                if here != key:
                    key, held, graph = here, [], None
                part = batch.column(4).slice(lo, hi - lo)
                values = np.asarray(part.flatten(), dtype=np.float64).reshape(hi - lo, -1)
                if kind[lo] == 0:
                    held.append((ids[lo:hi], values))
                    continue
                if graph is None and held:
                    graph = build()
                if graph is None:  # no vector of this length in the shard
                    continue
                for at in range(0, hi - lo, BLOCK):
                    yield answers(ids[lo + at : min(lo + at + BLOCK, hi)], values[at : at + BLOCK])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
