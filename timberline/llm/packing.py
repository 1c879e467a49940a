"""Best-fit-decreasing packing of token sequences.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens.
Best fit decreasing depends on nothing but the lengths, and there are at most
``capacity`` of them: their histogram is summed on the cluster, the packing is
planned on the histogram with a segment tree over remaining capacities, and
every piece finds its place by its rank among the pieces of its length.  The
plan is exactly what best fit decreasing gives document by document, because
pieces of one length are interchangeable and are placed in runs.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm import grams
from timberline.llm.tables import materialize

CAPACITY = 4096
END_ID = 1
#: Buckets that the pieces of one length are dealt to, so that no length is one task's work.
RANK_BUCKETS = 1024
#: Words that a task keeps with their ids.
CACHED_WORDS = 300_000

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordTokenizer:
    """Ids of whole texts, equal to those of the tokenizer file, word by word.

    The tokenizer's normaliser and splitter work within words, so the ids of a
    text are those of its words in order.  Words are kept with their ids; new
    ones are encoded together.  Texts with characters outside Latin letters,
    with unusual white space or with a special token of the file go to the
    tokenizer as they are.
    """

    #: Anything whose case mapping, composition or spacing is not plain here.
    UNUSUAL = re.compile("[^\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u0148\\u014a-\\u017e]")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = sorted({t.content for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.openings = sorted({t[:2].lower() for t in special})  # looked for before the slower pattern
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)", regex.IGNORECASE)
        # a word of the tokenizer: a contraction, letters, one digit, or other signs
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {"": b""}  # by what stands between spaces
        self.known_words: dict[str, bytes] = {}

    def _holds_special(self, text: str) -> bool:
        return any(x in text for x in self.openings) and self.special.search(text) is not None

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            ids = self._encode([" ".join(part)])[0]
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part):  # not one word each: ask for each
                self.known_words.update(zip(part, (x.tobytes() for x in self._encode(part)), strict=True))
                continue
            raw, stops = ids.tobytes(), (cuts * 4).tolist()
            self.known_words.update(zip(part, (raw[a:b] for a, b in zip([0, *stops], stops, strict=False)), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > CACHED_WORDS:
            self.known = {"": b""}
        if len(self.known_words) > CACHED_WORDS:
            self.known_words = {}
        plain = [not self.UNUSUAL.search(t) and not self._holds_special(t) for t in texts]
        chunks = [unicodedata.normalize("NFC", t).lower().replace("\n", " ").split(" ") if ok else [] for t, ok in zip(texts, plain, strict=True)]
        new = list(set().union(*chunks).difference(self.known))
        if new:
            words = [self.find(c) for c in new]
            unknown = set().union(*words).difference(self.known_words)
            if unknown:
                self._learn(list(unknown))
            get = self.known_words.__getitem__
            self.known.update((c, b"".join(map(get, w))) for c, w in zip(new, words, strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) if ok else self._encode([t])[0].tobytes() for t, c, ok in zip(texts, chunks, plain, strict=True)]


def text_parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A long text in parts that end at a space or line feed, where no word goes on."""
    at = 0
    while len(text) - at > size:
        cut = max(text.rfind(" ", at, at + size), text.rfind("\n", at, at + size))
        if cut <= at:
            near = [x for x in (text.find(" ", at + size), text.find("\n", at + size)) if x >= 0]
            if not near:
                break
            cut = min(near)
        yield text[at:cut]
        at = cut
    yield text[at:]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of all pieces of all documents.

    A null text counts as empty, so every row has the end id and one piece at
    least; repeated rows give repeated pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer(tokenizer_path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for part in (x for batch in batches for x in grams.slices(batch, 1)):
            doc_ids = part.column(0).to_pylist()
            texts, owner = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                for piece in text_parts(text or ""):
                    texts.append(piece)
                    owner.append(i)
            whole: list[list[bytes]] = [[] for _ in doc_ids]
            for lo in range(0, len(texts), 256):
                for i, ids in zip(owner[lo : lo + 256], tokenizer.ids(texts[lo : lo + 256]), strict=True):
                    whole[i].append(ids)
            out: list[tuple] = []
            for doc_id, ids in zip(doc_ids, whole, strict=True):
                raw = b"".join(ids) + end
                for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[start : start + 4 * capacity]
                    out.append((doc_id, piece, start // 4, len(cut) // 4, zlib.crc32(cut)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, PIECE_SCHEMA)


class CapacityTree:
    """Segment tree over remaining capacities: the least one with an open bin that still fits."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves < capacity + 1:
            self.leaves *= 2
        self.open = [0] * (2 * self.leaves)

    def set(self, remaining: int, is_open: bool) -> None:
        node = self.leaves + remaining
        self.open[node] = int(is_open)
        while node > 1:
            node //= 2
            self.open[node] = self.open[2 * node] | self.open[2 * node + 1]

    def tightest(self, length: int) -> int | None:
        """The least open capacity that is ``length`` or more."""
        node = self.leaves + length
        if self.open[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.leaves
            node //= 2
        return None


def plan_best_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over a histogram of lengths.

    Returns runs ``(length, first_rank, count, per_bin, first_bin, offset)``:
    of the pieces of that length, the ``count`` ranks from ``first_rank`` go
    ``per_bin`` to a bin, from bin ``first_bin`` on, the first at ``offset``.
    """
    tree = CapacityTree(capacity)
    open_bins: dict[int, deque[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def release(remaining: int, first: int, count: int) -> None:
        if remaining and count:
            if not open_bins.get(remaining):
                open_bins[remaining] = deque()
                tree.set(remaining, True)
            open_bins[remaining].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, first = capacity, bins
                count = -(-left // (capacity // length))
                bins += count
            else:
                first, count = open_bins[remaining].popleft()
                if not open_bins[remaining]:
                    tree.set(remaining, False)
            per_bin = remaining // length
            full = min(count, left // per_bin)
            if full:
                runs.append((length, rank, full * per_bin, per_bin, first, capacity - remaining))
                release(remaining - per_bin * length, first, full)
                rank, left, first, count = rank + full * per_bin, left - full * per_bin, first + full, count - full
            if left and count:  # fewer than fill a bin
                runs.append((length, rank, left, left, first, capacity - remaining))
                release(remaining - left * length, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            release(remaining, first, count)
    return runs


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``,
    one row per piece.  What the driver holds is the histogram of lengths (at
    most ``capacity`` rows) and its plan.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    pieces = materialize(tokenized_pieces(docs, tokenizer_path, capacity), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = plan_best_fit(histogram, capacity)

    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int")
    dealt = pieces.withColumn("__bucket", bucket)
    counts = dealt.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("__row", F.row_number().over(within)).join(base, ["length", "__bucket"])
    ranked = ranked.withColumn("__rank", F.col("__base") + F.col("__row") - 1)

    # the plan, one row per length: bounded by `capacity`, so it may be broadcast
    by_length: dict[int, list[tuple]] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    run_type = "array<struct<first_rank:long,n:long,per_bin:long,first_bin:long,offset:long>>"
    plan = spark.createDataFrame(list(by_length.items()), f"length long, runs {run_type}")
    placed = ranked.join(F.broadcast(plan), "length")
    run = F.filter("runs", lambda r: (r["first_rank"] <= F.col("__rank")) & (F.col("__rank") < r["first_rank"] + r["n"]))[0]
    placed = placed.withColumn("__run", run)
    nth = F.col("__rank") - F.col("__run.first_rank")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("__run.first_bin") + F.floor(nth / F.col("__run.per_bin"))).cast("long").alias("sequence_id"),
        (F.col("__run.offset") + F.pmod(nth, F.col("__run.per_bin")) * F.col("length")).cast("long").alias("offset"),
    )
