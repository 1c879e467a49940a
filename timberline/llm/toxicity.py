"""Toxicity: a character n-gram classifier scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams is counted per class over a bounded sample
of labelled texts; the log-count ratio of a feature scales it, and a logistic
regression on the scaled features gives the weights.  Scoring passes over every
whole text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm import grams
from timberline.llm.tables import materialize

ORDERS = (4, 5)
BITS = 22
#: Labelled texts of each class that a model is fitted on, at most.
PER_CLASS = 8000
#: N-grams with the clearest difference between the classes that the model keeps.
FEATURES = 4096
THRESHOLD = 0.7
#: Tasks that the sample is counted in.
SAMPLE_TASKS = 12
#: Sampled texts whose features a step of the training widens at a time.
BLOCK = 1024


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float


def _present(batch: pa.Array, keep: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, buckets)``, each pair once per chunk; ``keep`` limits the buckets."""
    for rows, starts, stops, data in grams.chunks(batch, max(ORDERS) - 1):
        text = grams.lower(data, grams.LETTERS)
        found = []
        for n in ORDERS:
            bucket = grams.hashed(text, n, BITS)
            owner = grams.owners(starts, stops, n, len(bucket))
            ok = owner >= 0
            if keep is not None:
                ok &= keep[bucket]
            found.append(rows[owner[ok]] << BITS | bucket[ok])
        pairs = np.unique(np.concatenate(found))
        yield pairs >> BITS, pairs & ((1 << BITS) - 1)


def _merged(column: pa.Array, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All distinct ``(row, bucket)`` pairs of a batch."""
    found = [r << BITS | b for r, b in _present(column, keep)]
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """``text, label`` of the sampled labelled documents; a hash of the id picks them."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = [one.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    # at most 2 * per_class ids
    ids = F.broadcast(picked[0].unionByName(picked[1]))
    # dealt by id, so that the copies of a text do not meet
    return docs.select("doc_id", "text").join(ids, "doc_id").repartition(SAMPLE_TASKS, F.xxhash64("doc_id")).select("text", "label")


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, label 0/1)``.

    Rows without a label take no part; of repeated labels the largest counts.
    Without texts of both classes the model has no features and gives the share
    of the one class it saw, smoothed.
    """
    sample = materialize(_sample(docs, labels, per_class), "toxicity-sample")
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    base = float(np.log((n_pos + 1) / (n_neg + 1)))
    if not n_pos or not n_neg:
        return Model(np.zeros(0, dtype=np.int64), np.zeros(0), base)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, 1 << BITS), dtype=np.int32)
        for part in (x for batch in batches for x in grams.slices(batch, 0)):
            label = np.asarray(part.column(1)).astype(np.int64)
            rows, buckets = _merged(part.column(0))
            for k in (0, 1):
                bucket, n = np.unique(buckets[label[rows] == k], return_counts=True)
                seen[k, bucket] += n.astype(np.int32)
        used = np.flatnonzero(seen.any(axis=0))
        for at in range(0, len(used), 1 << 16):
            part = used[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(seen[1, part].astype(np.int64)), pa.array(seen[0, part].astype(np.int64))], ["bucket", "pos", "neg"])

    counts = sample.mapInArrow(count, "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    share = (F.col("pos") + F.col("neg")) / (n_pos + n_neg)
    z = F.abs(F.col("pos") / n_pos - F.col("neg") / n_neg) / F.sqrt(share * (1 - share) * (1 / n_pos + 1 / n_neg) + 1e-12)
    best = counts.withColumn("z", z).orderBy(F.desc("z"), "bucket").limit(FEATURES).collect()  # at most FEATURES rows
    chosen = sorted((r["bucket"], r["pos"], r["neg"]) for r in best)
    buckets = np.array([c[0] for c in chosen], dtype=np.int64)
    ratio = np.log((np.array([c[1] for c in chosen]) + 1) / (n_pos + 2)) - np.log((np.array([c[2] for c in chosen]) + 1) / (n_neg + 2))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _flags(buckets)
        for part in (x for batch in batches for x in grams.slices(batch, 0)):
            rows, found = _merged(part.column(0), keep)
            feature = np.searchsorted(buckets, found).astype(np.uint16)
            cuts = np.searchsorted(rows, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part.column(1).cast(pa.int32()), pa.array([feature[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["label", "features"])

    # at most 2 * PER_CLASS rows of at most FEATURES numbers of two bytes; sorted, so that sums do not depend on the tasks' order
    rows = sample.mapInArrow(project, "label int, features binary").toArrow().sort_by([("label", "ascending"), ("features", "ascending")])
    features = rows.column("features").cast(pa.large_binary()).combine_chunks()
    cuts = np.concatenate(([0], np.cumsum(pc.binary_length(features).to_numpy()))) // 2
    feature = np.frombuffer(b"".join(memoryview(x.as_buffer()) for x in features), dtype=np.uint16)
    weights, bias = _logistic(feature, cuts, rows.column("label").to_numpy().astype(np.float64), ratio)
    return Model(buckets, weights * ratio, bias)


def _flags(buckets: np.ndarray) -> np.ndarray:
    keep = np.zeros(1 << BITS, dtype=bool)
    keep[buckets] = True
    return keep


def _logistic(feature: np.ndarray, cuts: np.ndarray, y: np.ndarray, scale: np.ndarray, steps: int = 400, l2: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights of the scaled presence features, by accelerated gradient descent.

    Text ``i`` has the features ``feature[cuts[i]:cuts[i + 1]]``; a block of
    texts is widened at a time.
    """
    n, k = len(y), len(scale)
    blocks = [(lo, min(lo + BLOCK, n)) for lo in range(0, n, BLOCK)]

    def each_block():
        for lo, hi in blocks:
            index = feature[cuts[lo] : cuts[hi]].astype(np.int64)
            yield slice(lo, hi), index, np.repeat(np.arange(hi - lo), np.diff(cuts[lo : hi + 1]))

    # a bound on the curvature: the largest sum of squares of a row
    largest = max(np.bincount(row, scale[index] ** 2, minlength=1).max() for _, index, row in each_block())
    lipschitz = 0.25 * (largest + 1) / 4 + l2
    w, b = np.zeros(k), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    w_old, b_old = np.zeros(k), b
    for t in range(steps):
        m = t / (t + 3)
        v, c = w + m * (w - w_old), b + m * (b - b_old)
        slope, rest, scaled = np.zeros(k), 0.0, scale * v
        for own, index, row in each_block():
            z = np.bincount(row, scaled[index], minlength=own.stop - own.start) + c
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / n
            slope += np.bincount(index, g[row], minlength=k)
            rest += g.sum()
        w_old, b_old = w, b
        w = v - (scale * slope + l2 * v) / lipschitz
        b = c - rest / lipschitz
    return w, b


def score(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``score double`` (0 to 1) added to ``columns`` (all, by default).

    A null or empty text has the score of no features; a column named ``score``
    is replaced.
    """
    names = [c for c in (columns or docs.columns) if c != "score"]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = _flags(model.buckets)
        for part in (x for batch in batches for x in grams.slices(batch, len(names))):
            rows, found = _merged(part.column(len(names)), keep)
            z = np.bincount(rows, model.weights[np.searchsorted(model.buckets, found)], minlength=part.num_rows) + model.bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(p)], [*names, "score"])

    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add("score", "double")
    return source.mapInArrow(run, schema)


def remainder(doc_id: Column, n: int) -> Column:
    """``crc32`` of an id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))
