"""Language identification by a byte convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; the
largest answer of each filter in a window feeds a softmax layer.  The network
is trained in numpy on windows of a bounded sample of labelled texts.  A text
is cut into windows whole, and its windows' log chances are averaged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm import grams

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
#: Labelled texts of each language that the network is fitted on, and windows of each text, at most.
PER_LANGUAGE = 1000
WINDOWS_PER_TEXT = 4
#: Steps of training at least; a small sample is gone through more often.
LEAST_STEPS = 400

#: Kinds of bytes the network tells apart: white space and other ASCII signs, letters without case, other bytes.
KINDS = 160
_KIND = np.zeros(256, dtype=np.int64)
_KIND[[b for b in range(128) if chr(b).isalpha()]] = [grams.LOWER[b] - 96 for b in range(128) if chr(b).isalpha()]
_KIND[[b for b in range(33, 128) if not chr(b).isalpha()]] = 27
_KIND[128:] = np.arange(128) + 28


@dataclass(frozen=True)
class Network:
    languages: list[str]
    embedding: np.ndarray  # (KINDS, EMBEDDING)
    filters: list[np.ndarray]  # per width: (width * EMBEDDING, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    out_bias: np.ndarray


def windows(column: pa.Array, size: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, kinds)``: every window of every text, padded with spaces; ``kinds`` is (windows, WINDOW).

    Windows of a text start WINDOW - 3 bytes apart, so that no n-gram of a
    filter is cut.
    """
    step = WINDOW - max(WIDTHS) + 1
    for rows, starts, stops, data in grams.chunks(column, max(WIDTHS) - 1, size):
        kinds = _KIND[grams.lower(data)]
        kinds = np.concatenate((kinds, np.zeros(WINDOW, dtype=np.int64)))
        n = np.maximum(1, -(-(stops - starts - max(WIDTHS) + 1) // step))
        owner = np.repeat(np.arange(len(starts)), n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        begin = starts[owner] + nth * step
        place = begin[:, None] + np.arange(WINDOW)[None, :]
        inside = place < stops[owner][:, None]
        yield rows[owner], np.where(inside, kinds[np.minimum(place, len(kinds) - 1)], 0)


def _pair_tables(net: Network) -> list[list[np.ndarray]]:
    """Of each width: what each pair (or last single) of neighbouring kinds adds to each filter."""
    tables = []
    for width, w in zip(WIDTHS, net.filters, strict=True):
        single = [(net.embedding @ w[k * EMBEDDING : (k + 1) * EMBEDDING]).astype(np.float32) for k in range(width)]
        own = [(single[k][:, None, :] + single[k + 1][None, :, :]).reshape(KINDS * KINDS, FILTERS) for k in range(0, width - 1, 2)]
        tables.append(own + ([single[-1]] if width % 2 else []))
    return tables


def log_chances(net: Network, tables: list[list[np.ndarray]], kinds: np.ndarray) -> np.ndarray:
    """(windows, languages) log softmax; sums of looked-up pairs are the convolutions."""
    pairs = kinds[:, :-1] * KINDS + kinds[:, 1:]
    pooled = []
    for width, own, bias in zip(WIDTHS, tables, net.biases, strict=True):
        count = WINDOW - width + 1
        total = None
        for k, t in enumerate(own):
            index = pairs[:, 2 * k : 2 * k + count] if len(t) > KINDS else kinds[:, 2 * k : 2 * k + count]
            part = t[index]
            total = part if total is None else np.add(total, part, out=total)
        pooled.append(np.maximum(total.max(axis=1) + bias, 0))
    z = np.concatenate(pooled, axis=1) @ net.out + net.out_bias
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train_network(kinds: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, seed: int = 7) -> Network:
    """Adam on the cross entropy; only the largest answer of a filter passes its gradient on.

    ``epochs`` is raised where the windows are so few that it would give less
    than LEAST_STEPS steps.
    """
    rng = np.random.default_rng(seed)
    epochs = max(epochs, math.ceil(LEAST_STEPS / math.ceil(len(labels) / batch)))
    k = len(languages)
    p: dict[str, np.ndarray] = {"e": rng.normal(0, 0.5, (KINDS, EMBEDDING))}
    for w in WIDTHS:
        p[f"w{w}"] = rng.normal(0, (2 / (w * EMBEDDING)) ** 0.5, (w * EMBEDDING, FILTERS))
        p[f"b{w}"] = np.zeros(FILTERS)
    p["o"], p["ob"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, k)), np.zeros(k)
    p = {name: v.astype(np.float32) for name, v in p.items()}
    first, second = ({name: np.zeros_like(v) for name, v in p.items()} for _ in range(2))
    share = np.bincount(labels, minlength=k)
    weight = (len(labels) / (k * np.maximum(share, 1))).astype(np.float32)
    t = 0
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            x, y, n = kinds[pick], labels[pick], len(pick)
            embedded = p["e"][x]
            pooled, best, columns = [], {}, {}
            for w in WIDTHS:
                count = WINDOW - w + 1
                cols = np.concatenate([embedded[:, j : j + count] for j in range(w)], axis=2)
                answer = cols @ p[f"w{w}"]
                best[w] = answer.argmax(axis=1)  # (n, FILTERS)
                columns[w] = cols
                pooled.append(np.take_along_axis(answer, best[w][:, None, :], axis=1)[:, 0] + p[f"b{w}"])
            raw = np.concatenate(pooled, axis=1)
            hidden = np.maximum(raw, 0)
            z = hidden @ p["o"] + p["ob"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), y] -= 1
            z *= (weight[y] / n)[:, None]
            g = {name: np.zeros_like(v) for name, v in p.items()}
            g["o"], g["ob"] = hidden.T @ z, z.sum(axis=0)
            back = (z @ p["o"].T) * (raw > 0)
            for i, w in enumerate(WIDTHS):
                d = back[:, i * FILTERS : (i + 1) * FILTERS]
                g[f"b{w}"] = d.sum(axis=0)
                at_best = columns[w][np.arange(n)[:, None], best[w]]  # (n, FILTERS, w * EMBEDDING)
                g[f"w{w}"] = np.einsum("nfc,nf->cf", at_best, d)
                to_cols = d[:, :, None] * p[f"w{w}"].T[None]
                for j in range(w):
                    np.add.at(g["e"], x[np.arange(n)[:, None], best[w] + j], to_cols[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
            t += 1
            rate = 0.003 if epoch < epochs - 2 else 0.001
            for name in p:
                first[name] = 0.9 * first[name] + 0.1 * g[name]
                second[name] = 0.999 * second[name] + 0.001 * g[name] ** 2
                p[name] -= rate * (first[name] / (1 - 0.9**t)) / (np.sqrt(second[name] / (1 - 0.999**t)) + 1e-8)
    return Network(languages, p["e"], [p[f"w{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["o"], p["ob"])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Network | None:
    """Fit on ``docs(text, lang)``: at most ``per_language`` different texts a language, of least hash.

    Of each text up to WINDOWS_PER_TEXT windows, spread over it, reach the
    driver.  Rows with a null language or text, or a text without a letter,
    take no part.  Without any labelled text there is no network: None.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    picked = usable.select("lang", F.xxhash64("text").alias("pick")).distinct()
    # the least hashes of a language lie in its first slices; only their rows meet in one task
    slices = picked.groupBy("lang", F.shiftright("pick", 52).alias("slice")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("slice")) - F.col("n")
    last = slices.withColumn("__before", before).where(F.col("__before") < per_language).groupBy("lang").agg(F.max("slice").alias("last"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("pick"))
    # one row a language, as many as the network has answers
    first = picked.join(F.broadcast(last), "lang").where(F.shiftright("pick", 52) <= F.col("last")).select("lang", "pick")
    picked = first.withColumn("__rank", rank).where(F.col("__rank") <= per_language).select("lang", "pick")
    # at most per_language small rows a language
    sample = usable.select("lang", F.xxhash64("text").alias("pick"), F.col("text").cast("string").alias("text"))
    sample = sample.join(F.broadcast(picked), ["lang", "pick"]).select("lang", "pick", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, picks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple[str, int, bytes]] = []
            held: dict[int, list[np.ndarray]] = {}
            for rows, kinds in windows(batch.column(2)) if batch.num_rows else ():
                for row in np.unique(rows):
                    held.setdefault(int(row), []).append(kinds[rows == row])
            for row, parts in held.items():
                all_of = np.concatenate(parts)
                at = np.unique(np.linspace(0, len(all_of) - 1, WINDOWS_PER_TEXT).astype(int))
                out += [(langs[row], picks[row], all_of[i].astype(np.uint8).tobytes()) for i in at]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["lang", "pick", "kinds"])

    rows = sample.mapInArrow(cut, "lang string, pick long, kinds binary").distinct().toArrow().to_pylist()
    rows.sort(key=lambda r: (r["lang"], r["pick"], r["kinds"]))  # the same network whatever the tasks' order
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    kinds = np.stack([np.frombuffer(r["kinds"], dtype=np.uint8) for r in rows]).astype(np.int64)
    return train_network(kinds, np.array([languages.index(r["lang"]) for r in rows]), languages)


def identify(docs: DataFrame, net: Network | None, columns: list[str] | None = None) -> DataFrame:
    """All rows of ``docs`` with ``lang_pred string`` and ``score double`` added to ``columns``.

    ``und`` with score 0 where the text is null or has no letter, or where
    there is no network.  Columns with the added names are replaced.
    """
    names = [c for c in (columns or docs.columns) if c not in ("lang_pred", "score")]
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) & F.lit(net is not None)
    kept = [F.col(f"`{c}`") for c in names]
    if net is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    source = docs.select(*kept, letters.alias("__letters"), F.when(letters, F.col("text").cast("string")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _pair_tables(net)
        for part in (x for batch in batches for x in grams.slices(batch, len(names) + 1)):
            total, n = np.zeros((part.num_rows, len(net.languages))), np.zeros(part.num_rows)
            for rows, kinds in windows(part.column(len(names) + 1)):
                for at in range(0, len(rows), 256):
                    logs = log_chances(net, tables, kinds[at : at + 256])
                    np.add.at(total, rows[at : at + 256], logs)
                    n += np.bincount(rows[at : at + 256], minlength=part.num_rows)
            mean = total / np.maximum(n, 1)[:, None]
            chance = np.exp(mean - mean.max(axis=1, keepdims=True))
            chance /= np.maximum(chance.sum(axis=1, keepdims=True), 1e-300)
            seen = np.asarray(part.column(len(names)).to_numpy(zero_copy_only=False), dtype=bool)
            best = chance.argmax(axis=1)
            lang = [net.languages[b] if ok else "und" for b, ok in zip(best, seen, strict=True)]
            score = np.where(seen, chance[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    return source.mapInArrow(run, schema)
