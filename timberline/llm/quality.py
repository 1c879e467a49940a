"""Quality: a weak-label model over heuristic labellers and a hashed linear scorer.

Each labeller looks at one aspect of a text and votes good, bad or nothing.
Expectation maximisation over the counts of vote patterns estimates how often
each labeller is right for each class, without any label; the posteriors of a
bounded sample of texts then train a linear scorer on hashed byte trigrams,
which scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.llm import grams
from timberline.llm.shingles import hash_words
from timberline.llm.tables import materialize

GOOD, BAD, NOTHING = 1, 0, 2

#: Frequent short words of English, German, French and Spanish.
FUNCTION_WORDS = "the of and to in is that it for on was as with be by this are from or an der die das und ist ein eine nicht mit von den zu auf für im des dem sich als le la les des et est un une que qui en dans pour pas sur au par il elle du de el los las y es por con del se una su para al como no".split()

LABELLERS = ("signs", "capitals", "sentences", "separators", "shouting", "function_words", "repetition")

#: Trigram buckets of the scorer.
BITS = 14
#: Documents of each posterior class that the scorer is fitted on, at most.
PER_CLASS = 2500
THRESHOLD = 0.5

_SIGNS = np.zeros(256, dtype=bool)
_SIGNS[list(b"#$%&*+<=>@[\\]^_`{|}~")] = True


def _function_word_hashes() -> np.ndarray:
    text = grams.lower(np.frombuffer(" ".join(FUNCTION_WORDS).encode(), dtype=np.uint8))
    return np.unique(hash_words(text, text == 32)[1])


def aspects(column: pa.Array) -> dict[str, np.ndarray]:
    """Counts per text: bytes of several kinds, words, function words, repeated words."""
    n = len(column)
    out = {k: np.zeros(n) for k in ("letters", "capitals", "signs", "ends", "bars", "shouts", "words", "function", "repeats")}
    known = _function_word_hashes()
    for rows, starts, stops, data in grams.chunks(column, 0):
        text = grams.lower(data)
        kinds = {
            "letters": ((text >= 97) & (text <= 122)) | (text >= 0xC0),
            "capitals": (data >= 65) & (data <= 90) | (text != data) & (data >= 0x80),
            "signs": _SIGNS[data],
            "ends": (data == 46) | (data == 44) | (data == 63),
            "bars": data == 124,
            "shouts": data == 33,
        }
        for name, flag in kinds.items():
            total = np.concatenate(([0], np.cumsum(flag, dtype=np.int32)))
            out[name] += np.bincount(rows, total[stops] - total[starts], minlength=n)
        begin, word = hash_words(text, text == 32)
        owner = np.searchsorted(stops, begin, side="right")
        row = rows[owner]
        out["words"] += np.bincount(row, minlength=n)
        out["function"] += np.bincount(row, np.isin(word, known), minlength=n)
        # places whose four words stood earlier in the same part of the text
        if len(word) > 3:
            four = word[:-3] + word[1:-2] * np.uint64(3) + word[2:-1] * np.uint64(5) + word[3:] * np.uint64(7)
            same = owner[:-3] == owner[3:]
            four, who = four[same] ^ (owner[:-3][same].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), owner[:-3][same]
            _, first = np.unique(four, return_index=True)
            again = np.bincount(who, minlength=len(rows)) - np.bincount(who[first], minlength=len(rows))
            out["repeats"] += np.bincount(rows, again, minlength=n)
    return out


def votes(column: pa.Array) -> np.ndarray:
    """``(texts, labellers)`` votes: 1 good, 0 bad, 2 nothing."""
    a = aspects(column)
    words, letters = np.maximum(a["words"], 1), np.maximum(a["letters"], 1)

    def vote(x: np.ndarray, good_to: float, bad_from: float, enough: np.ndarray) -> np.ndarray:
        return np.where(~enough, NOTHING, np.where(x >= bad_from, BAD, np.where(x <= good_to, GOOD, NOTHING)))

    some, many = a["words"] >= 5, a["words"] >= 30
    return np.stack(
        [
            vote(a["signs"] / words, 0.1, 0.5, some),
            vote(a["capitals"] / letters, 0.1, 0.3, some),
            vote(-a["ends"] / words, -0.06, -0.01, many),
            vote(a["bars"] / words, 0.02, 0.2, some),
            vote(a["shouts"] / words, 0.02, 0.2, some),
            vote(-a["function"] / words, -0.15, -0.05, many),
            vote(a["repeats"] / words, 0.2, 0.6, many),
        ],
        axis=1,
    ).astype(np.int64)


@dataclass(frozen=True)
class WeakLabels:
    prior: float  # share of good texts
    tables: np.ndarray  # (labellers, class, vote): chances of each vote where it is given; an abstention says nothing

    def accuracy(self) -> np.ndarray:
        """Of each labeller: the chance that a vote it gives is right."""
        share = np.array([1 - self.prior, self.prior])
        return sum(share[k] * self.tables[:, k, k] for k in (BAD, GOOD))

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Chance that texts with these votes are good."""
        each = np.arange(pattern.shape[1])
        log = [np.log(share) + np.log(self.tables[each, k, pattern]).sum(axis=1) for k, share in ((BAD, 1 - self.prior), (GOOD, self.prior))]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> WeakLabels:
    """Expectation maximisation from the majority vote; one pattern per row."""
    m = patterns.shape[1]
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    q = np.clip((good + 1) / (good + 3 * bad + 2), 0.02, 0.98)  # labellers overlap: a bad sign outweighs a clean aspect
    model = WeakLabels(0.5, np.ones((m, 2, 3)))
    total = counts.sum()
    for _ in range(rounds):
        tables = np.zeros((m, 2, 3))
        for k, weight in ((BAD, (1 - q) * counts), (GOOD, q * counts)):
            for v in (BAD, GOOD):
                tables[:, k, v] = (weight[:, None] * (patterns == v)).sum(axis=0) + 0.1
        tables[:, :, :2] /= tables[:, :, :2].sum(axis=2, keepdims=True)
        tables[:, :, NOTHING] = 1.0
        model = WeakLabels(float(np.clip((q * counts).sum() / total, 1e-3, 1 - 1e-3)), tables)
        after = model.posterior(patterns)
        if np.abs(after - q).max() < 1e-9:
            break
        q = after
    return model


def _code(pattern: np.ndarray) -> np.ndarray:
    return pattern @ (3 ** np.arange(pattern.shape[1]))


def weak_labels(docs: DataFrame) -> WeakLabels:
    """Vote patterns counted over all whole texts, at most 3**7 of them, and their estimate.

    A null text counts as an empty one, which no labeller votes on; repeated
    rows count each.  Repeated words are looked for within ``grams.CHUNK``
    bytes of a text.  An empty table gives a prior of one half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for batch in batches:
            for part in grams.slices(batch, 0):
                seen += np.bincount(_code(votes(part.column(0))), minlength=len(seen))
        code = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(seen[code], pa.int64())], ["code", "n"])

    texts = docs.select(F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    code, n = np.array([r["code"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=np.float64)
    if not len(code):
        return WeakLabels(0.5, np.ones((len(LABELLERS), 2, 3)))
    return estimate(code[:, None] // 3 ** np.arange(len(LABELLERS)) % 3, n)


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray  # by trigram bucket
    bias: float


def _buckets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(row, bucket)`` of every trigram of every text."""
    for rows, starts, stops, data in grams.chunks(column, 2):
        bucket = grams.hashed(data, 3, BITS)
        owner = grams.owners(starts, stops, 3, len(bucket))
        ok = owner >= 0
        yield rows[owner[ok]], bucket[ok]


def fit(docs: DataFrame, labels: WeakLabels, per_class: int = PER_CLASS) -> Scorer:
    """Train the scorer on posteriors; at most ``per_class`` texts of each side reach the driver, as counts.

    The sample is picked by a hash of the text, so it does not depend on how
    the table is dealt out, and equal texts count once.  Null and empty texts
    take no part; without any text the scorer knows only the prior.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grams.slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(labels.posterior(votes(part.column(1))))], ["pick", "good"])

    source = docs.select(F.xxhash64("text").alias("pick"), F.col("text").cast("string").alias("text")).where(F.col("text") != "")
    labelled = materialize(source.mapInArrow(label, "pick long, good double").distinct(), "quality-labels")
    sides = [labelled.where(F.col("good") >= 0.5), labelled.where(F.col("good") < 0.5)]
    picked = sides[0].orderBy("pick").limit(per_class).unionByName(sides[1].orderBy("pick").limit(per_class))
    sample = source.join(F.broadcast(picked), "pick").dropDuplicates(["pick"])  # at most 2 * per_class ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                dense = np.zeros((part.num_rows, 1 << BITS), dtype=np.int32)
                for row, bucket in _buckets(part.column(0)):
                    np.add.at(dense, (row, bucket), 1)
                share = dense / np.maximum(dense.sum(axis=1, keepdims=True), 1)
                used = [np.flatnonzero(d) for d in dense]
                index = [u.astype(np.uint16).tobytes() for u in used]
                value = [share[i, u].astype(np.float32).tobytes() for i, u in enumerate(used)]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(index, pa.binary()), pa.array(value, pa.binary())], ["good", "buckets", "shares"])

    rows = sample.select("text", "good").mapInArrow(count, "good double, buckets binary, shares binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["good"], r["buckets"], r["shares"]))  # the same sums whatever the tasks' order
    if not rows:
        return Scorer(np.zeros(1 << BITS), float(np.log(labels.prior / (1 - labels.prior))))
    index = np.concatenate([np.frombuffer(r["buckets"], dtype=np.uint16) for r in rows]).astype(np.int64)
    value = np.concatenate([np.frombuffer(r["shares"], dtype=np.float32) for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r["buckets"]) // 2 for r in rows])
    y = np.array([r["good"] for r in rows])
    n_good = max(int((y >= 0.5).sum()), 1)
    weight = np.where(y >= 0.5, 1.0, n_good / max(len(y) - n_good, 1))
    # adaptive gradient descent on the weighted logistic loss
    w, b = np.zeros(1 << BITS), 0.0
    squares, b_square = np.full(1 << BITS, 1e-8), 1e-8
    for _ in range(150):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[index], minlength=len(y)) + b, -30, 30)))
        g = weight * (p - y) / weight.sum()
        slope = np.bincount(index, value * g[row], minlength=len(w)) + 1e-7 * w
        squares += slope**2
        b_square += g.sum() ** 2
        w -= 4.0 * slope / np.sqrt(squares)
        b -= 0.5 * g.sum() / np.sqrt(b_square)
    return Scorer(w, b)


def score(docs: DataFrame, scorer: Scorer, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``score double`` (0 to 1, higher is better) added.

    A null, empty or very short text has no trigram to count against it and
    gets the score of no features; a column named ``score`` is replaced.
    """
    names = [c for c in (columns or docs.columns) if c != "score"]
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grams.slices(batch, len(names)):
                total, n = np.zeros(part.num_rows), np.zeros(part.num_rows)
                for row, bucket in _buckets(part.column(len(names))):
                    total += np.bincount(row, scorer.weights[bucket], minlength=part.num_rows)
                    n += np.bincount(row, minlength=part.num_rows)
                z = total / np.maximum(n, 1) + scorer.bias
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [*names, "score"])

    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add("score", "double")
    return source.mapInArrow(run, schema)


def train(docs: DataFrame) -> tuple[WeakLabels, Scorer]:
    """Labellers' accuracies over all of ``docs(text)`` and the scorer fitted on their posteriors.

    Nulls, repeats and empty tables are as ``weak_labels`` and ``fit`` say.
    """
    labels = weak_labels(docs)
    return labels, fit(docs, labels)
