"""Alignment of two tokenizers' tokens over the same bytes.

Both token lists of a text are byte intervals in order.  The intervals of B
stand in a static index (their sorted starts and ends); each token of A finds
the B tokens that it overlaps by two bisections, and marks the gaps between B
tokens that it spans.  Gaps that no token spans are places where both lists
end: they cut the text into groups, and the tokens of a group are linked.

Neither tokenizer merges across a space that follows a visible sign, so a text
is worked out piece by piece, and a piece that came before is looked up.

How many documents hold a pair is known only after all are read.  Documents
are written in slices of bounded text with their own pairs; a slice counts each
of its pairs once, the counts are summed by pair, and each slice gets back the
sums of the pairs that it holds.  So a pair that every document holds is one
row a slice, and no document's pairs are shuffled by pair.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from timberline.llm.tables import materialize

#: Bytes of text of a slice, about; one longer text is a slice.
SLICE_BYTES = 1 << 24
#: Text that is worked out at a time, and pieces and their pairs that a task keeps.
BLOCK_BYTES = 1 << 20
CACHED_PIECES = 200_000
CACHED_PAIRS = 2_000_000
#: Pieces that are encoded as one text, and that are worked out together.
TOGETHER = 256
AT_ONCE = 16_384
#: Longer pieces are not kept.
CACHED_CHARS = 64
#: Groups of more token pairs are counted by distinct ids.
WIDE = 1 << 16
#: Documents that the last pass takes at a time.
AT_LAST = 256
#: Pairs in one row that a slice sends out.
PER_ROW = 8192

_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it is visible, else one from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteTokens:
    """Tokenizer A: a byte-level vocabulary; a text is encoded with a space before it."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        signs = byte_signs()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(signs[c] for c in t) if all(c in signs for c in t) else t.encode() for t in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        return [e.ids for e in self.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]


class PieceTokens:
    """Tokenizer B: pieces with byte fallback, which writes a space as U+2581 and adds one before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.space = self.model.piece_to_id("▁")
        #: No piece goes on with a space after a visible sign, so pieces of text can be encoded apart.
        self.apart = not any("▁" in n.lstrip("▁") for n in names)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text; of the empty piece of a text, which is only the space before it, too."""
        out = self.model.encode(texts, num_threads=1) if texts else []
        return [ids if t else [self.space] for t, ids in zip(texts, out, strict=True)]


class Vocabulary:
    """Bytes of each id's token, and the ids written with each sign that may follow."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        self.len_a, self.len_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (bytes_a, bytes_b))
        self.width = len(bytes_b)
        ids = range(max(len(bytes_a), len(bytes_b)))
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{sign}" for i in ids], dtype=object) for sign in ",|;")


def pieces(text: str) -> list[str]:
    """``text`` cut at spaces that follow a visible sign; those spaces are left out."""
    parts = text.split(" ")
    if not text.startswith(" ") and not any(w + " " in text for w in _SPACES):
        return parts
    out, held = [], None
    for p in parts:
        held = p if held is None else f"{held} {p}"
        if p and not p[-1].isspace():
            out.append(held)
            held = None
    return out if held is None else [*out, held]


class Links:
    """Groups and linked id pairs of texts, all worked out together; arrays with one entry a text.

    ``ids_a`` and ``ids_b`` are the tokens of all texts in order, and ``ends``
    the bytes at which the texts end, which are ends of tokens in both lists.
    """

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, ends: np.ndarray, vocabulary: Vocabulary):
        n, width = len(ends), vocabulary.width
        end_a, end_b = np.cumsum(vocabulary.len_a[ids_a]), np.cumsum(vocabulary.len_b[ids_b])
        begin_a, begin_b = end_a - vocabulary.len_a[ids_a], end_b - vocabulary.len_b[ids_b]
        # stab the index of B with each interval of A: tokens first to last - 1 overlap it
        first = np.searchsorted(end_b, begin_a, side="right")
        last = np.searchsorted(begin_b, end_a, side="left")
        spans = np.bincount(first + 1, minlength=len(ids_b) + 2) - np.bincount(last, minlength=len(ids_b) + 2)
        cut = np.cumsum(spans)[: len(ids_b)] == 0  # no A token spans the gap before this B token
        group_b = np.cumsum(cut) - 1
        group_a = group_b[first] if len(first) else first
        groups = int(group_b[-1]) + 1 if len(ids_b) else 0
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        text_of = np.searchsorted(ends, end_b[at_b], side="left") if groups else np.zeros(0, dtype=np.int64)
        self.n_a = np.diff(np.searchsorted(end_a, ends, side="right"), prepend=0)
        self.n_b = np.diff(np.searchsorted(end_b, ends, side="right"), prepend=0)
        self.n_groups = np.bincount(text_of, minlength=n)
        self.n_links = np.zeros(n, dtype=np.int64)
        np.add.at(self.n_links, text_of, in_a * in_b)
        # all ids in writing order, each with the sign that follows it
        signs = np.empty(len(ids_a) + len(ids_b), dtype=object)
        last_a, last_b = at_a + in_a - 1, at_b + in_b - 1
        signs[np.arange(len(ids_a)) + at_b[group_a]] = vocabulary.comma[ids_a]
        signs[last_a + at_b] = vocabulary.bar[ids_a[last_a]]
        signs[np.arange(len(ids_b)) + (at_a + in_a)[group_b]] = vocabulary.comma[ids_b]
        signs[last_a + last_b + 1] = vocabulary.semicolon[ids_b[last_b]]
        signs, stops = signs.tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        #: The groups of each text, each group followed by a semicolon.
        self.written = ["".join(signs[lo:hi]) for lo, hi in zip([0, *stops], stops, strict=False)]
        # all pairs of narrow groups, pairs of distinct ids of wide ones
        narrow = in_a * in_b <= WIDE
        here = np.flatnonzero(narrow[group_a]) if groups else np.zeros(0, dtype=np.int64)
        times = in_b[group_a[here]]
        left = np.repeat(here, times)
        step = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        right = at_b[group_a[left]] + step
        text = [text_of[group_a[left]]]
        codes, weights = [ids_a[left] * width + ids_b[right]], [np.ones(len(left), dtype=np.int64)]
        for g in np.flatnonzero(~narrow):
            x, nx = np.unique(ids_a[at_a[g] : at_a[g] + in_a[g]], return_counts=True)
            y, ny = np.unique(ids_b[at_b[g] : at_b[g] + in_b[g]], return_counts=True)
            codes.append((x[:, None] * width + y).reshape(-1))
            weights.append((nx[:, None] * ny).reshape(-1))
            text.append(np.full(len(codes[-1]), text_of[g]))
        text, self.codes, self.weights = summed(np.concatenate(text), np.concatenate(codes), np.concatenate(weights))
        self.sizes = np.bincount(text, minlength=n)


def summed(owner: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights summed by ``(owner, code)``, in that order."""
    if not len(codes):
        return owner, codes, weights
    high = int(codes.max()) + 1
    if int(owner.max()) < (1 << 62) // high:
        order = np.argsort(owner * high + codes)
    else:
        order = np.lexsort((codes, owner))
    owner, codes, weights = owner[order], codes[order], weights[order]
    new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (codes[1:] != codes[:-1]))))
    return owner[new], codes[new], np.add.reduceat(weights, new)


class Aligner:
    """Aligned texts; pieces that came before are looked up."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.vocabulary = Vocabulary(self.a.bytes, self.b.bytes)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.written: list[str] = []
        none = np.zeros(0, dtype=np.int64)
        #: Whether a piece comes back byte for byte, its numbers and count of pairs; and all pairs.
        self.kept = (none.astype(bool), np.zeros((0, 4), dtype=np.int64), none, none, none)
        self.asked, self.missed = 0, 0

    def _links(self, texts: list[str], a: list[list[int]], b: list[list[int]], together: int) -> Links | None:
        """Links of ``texts``, whose ids come for ``together`` texts at a time, or None if they do not come back byte for byte."""
        want = [t.encode() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in want])
        whole = b" " + b" ".join(want)
        ids_a, ids_b = [i for x in a for i in x], [i for x in b for i in x]
        if b"".join(map(self.a.bytes.__getitem__, ids_a)) != whole or b"".join(map(self.b.bytes.__getitem__, ids_b)) != whole:
            return None
        if together == 1:  # each text by itself
            sizes = np.array([[sum(len(side.bytes[i]) for i in x) for x in ids] for side, ids in ((self.a, a), (self.b, b))])
            if (np.cumsum(sizes, axis=1) != ends).any():
                return None
        return Links(np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64), ends, self.vocabulary)

    def _one(self, text: str) -> Links | None:
        return self._links([text], self.a.encode([text]), self.b.encode([text]), 1)

    def _added(self, texts: list[str], links: Links | None) -> tuple[np.ndarray, ...]:
        """Tables of ``texts``; those without links do not come back byte for byte."""
        n = len(texts)
        self.index.update(zip(texts, range(len(self.written), len(self.written) + n), strict=True))
        if links is None:
            none = np.zeros(n, dtype=np.int64)
            self.written += [""] * n
            return np.zeros(n, dtype=bool), np.zeros((n, 4), dtype=np.int64), none, none[:0], none[:0]
        self.written += links.written
        numbers = np.stack((links.n_a, links.n_b, links.n_groups, links.n_links), axis=1)
        return np.ones(n, dtype=bool), numbers, links.sizes, links.codes, links.weights

    def _learn(self, known: tuple[np.ndarray, ...], texts: list[str]) -> tuple[np.ndarray, ...]:
        """``known`` with ``texts`` added; their places are noted in ``index``."""
        if not texts:
            return known
        plain = [t for t in texts if t and t[0] != " " and not t[-1].isspace()]
        tables = [known]
        for t in set(texts).difference(plain):
            tables.append(self._added([t], self._one(t)))
        for at in range(0, len(plain), AT_ONCE):
            tables += self._of_plain(plain[at : at + AT_ONCE])
        return tuple(np.concatenate(x) for x in zip(*tables, strict=True))

    def _of_plain(self, plain: list[str]) -> list[tuple[np.ndarray, ...]]:
        """A text of plain pieces has the tokens of its pieces, so many are encoded as one."""
        joined = [" ".join(plain[k : k + TOGETHER]) for k in range(0, len(plain), TOGETHER)]
        links = self._links(plain, self.a.encode(joined), self.b.encode(joined), TOGETHER)
        if links is None and len(plain) > 1:
            half = len(plain) // 2
            return self._of_plain(plain[:half]) + self._of_plain(plain[half:])
        return [self._added(plain, links)]

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """``(numbers, digests, owner, codes, weights)`` of non-empty texts.

        ``numbers`` holds tokens of A and of B, groups and links of each text;
        the last three list each text's distinct pairs, ``A id * width + B id``,
        with their occurrences.
        """
        cut = [pieces(t) if self.b.apart else [t] for t in texts]
        fresh = {p for parts in cut for p in parts}
        self.asked += len(fresh)
        fresh = list(fresh.difference(self.index))
        self.missed += len(fresh)
        # once full, what was met first stays, and other pieces are kept for these texts only
        full = len(self.written) > CACHED_PIECES or len(self.kept[-1]) > CACHED_PAIRS
        last = [] if full else [p for p in fresh if len(p) <= CACHED_CHARS]
        brief = fresh if full else [p for p in fresh if len(p) > CACHED_CHARS]
        self.kept = self._learn(self.kept, last)
        held = len(self.written)
        same, numbers, sizes, codes, weights = self._learn(self.kept, brief)
        begin = np.cumsum(sizes) - sizes
        rows = [list(map(self.index.__getitem__, parts)) for parts in cut]
        owner = np.repeat(np.arange(len(texts)), [len(r) for r in rows])
        flat = np.fromiter(itertools.chain.from_iterable(rows), dtype=np.int64, count=len(owner))
        out = np.stack([np.bincount(owner, weights=numbers[flat, c], minlength=len(texts)).astype(np.int64) for c in range(4)], axis=1)
        digests = [_digest("".join(map(self.written.__getitem__, r))) for r in rows]
        # each text's distinct pieces with their occurrences, then their pairs
        who, piece, times = summed(owner, flat, np.ones(len(flat), dtype=np.int64))
        odd = np.zeros(len(texts), dtype=bool)
        odd[who[~same[piece]]] = True
        n = sizes[piece]
        source = np.repeat(begin[piece], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        who, code, weight = summed(np.repeat(who, n), codes[source], weights[source] * np.repeat(times, n))
        if odd.any():  # a piece does not come back byte for byte: the whole text decides
            keep = ~odd[who]
            parts = [(who[keep], code[keep], weight[keep])]
            for k in np.flatnonzero(odd).tolist():
                links = self._one(texts[k])
                out[k], digests[k] = 0, ""
                if links is not None:
                    out[k] = [x[0] for x in (links.n_a, links.n_b, links.n_groups, links.n_links)]
                    digests[k] = _digest(links.written[0])
                    parts.append((np.full(len(links.codes), k), links.codes, links.weights))
            who, code, weight = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        for p in brief:
            del self.index[p]
        del self.written[held:]
        if full and self.missed > self.asked // 2:  # texts of another kind
            self._forget()
        return out, digests, who, code, weight


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def shared_aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for all tasks of a worker."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _digest(written: str) -> str:
    return hashlib.sha256(written[:-1].encode()).hexdigest()


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def _lists(values: np.ndarray, starts: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values, kind))


def _narrow(owner: np.ndarray, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights beyond 32 bits in several parts, each with its code."""
    most = (1 << 31) - 1
    if not len(weights) or weights.max() <= most:
        return owner, codes, weights
    times = -(-weights // most)
    owner, codes, weights = (np.repeat(x, times) for x in (owner, codes, weights))
    step = np.arange(len(codes)) - np.repeat(np.cumsum(times) - times, times)
    return owner, codes, np.minimum(weights - step * most, most)


def _aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of kind 1 are documents; rows of kind 0 are a slice's distinct pairs with the slice's documents that hold them."""
    small = len(ByteTokens(path_a).bytes) * len(PieceTokens(path_b).bytes) < 1 << 31
    code = pa.int32() if small else pa.int64()
    fields = [("slice", pa.int64()), ("kind", pa.int32()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in _NUMBERS], ("groups_sha256", pa.string())]
    schema = pa.schema([*fields, ("codes", pa.list_(code)), ("weights", pa.list_(pa.int32()))])
    spark_schema = f"slice long, kind int, doc_id long, {', '.join(f'{c} long' for c in _NUMBERS)}, groups_sha256 string, codes array<{'int' if small else 'long'}>, weights array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = shared_aligner(path_a, path_b)
        number, held = TaskContext.get().partitionId() << 32, 0
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, counts = (np.concatenate(x) for x in zip(*seen, strict=True))
            return summed(np.zeros(len(codes), dtype=np.int64), codes, counts)[1:]

        def close() -> Iterator[pa.RecordBatch]:
            if seen:
                codes, counts = merged()
                starts = np.append(np.arange(0, len(codes), PER_ROW), len(codes))
                n = len(starts) - 1
                none = [pa.nulls(n, t) for t in (*[pa.int64()] * 5, pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), pa.array(np.zeros(n, np.int32)), *none, _lists(codes, starts, code), _lists(counts, starts, pa.int32())], schema=schema)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            at = 0
            while at < len(ids):
                block, size = [], 0
                while at + len(block) < len(ids) and (not block or size < BLOCK_BYTES):
                    block.append(texts[at + len(block)].as_py() or "")
                    size += len(block[-1])
                full = [k for k, t in enumerate(block) if t]
                numbers, digests = np.zeros((len(block), 4), dtype=np.int64), [""] * len(block)
                found, sums, who, codes, weights = aligner.align([block[k] for k in full])
                numbers[full] = found
                for k, s in zip(full, sums, strict=True):
                    digests[k] = s
                n = len(block)
                if len(codes):
                    distinct, counts = np.unique(codes, return_counts=True)
                    seen.append((distinct, counts))
                    if len(seen) > 16:
                        seen = [merged()]
                who, codes, weights = _narrow(who, codes, weights)
                starts = np.searchsorted(np.array(full, dtype=np.int64)[who] if len(who) else who, np.arange(n + 1))
                columns = [pa.array(np.full(n, number)), pa.array(np.ones(n, np.int32)), ids.slice(at, n), *[pa.array(numbers[:, c]) for c in range(4)], pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, _lists(codes, starts, code), _lists(weights, starts, pa.int32())], schema=schema)
                at += n
                held += size
                if held >= SLICE_BYTES:
                    yield from close()
                    number, held, seen = number + 1, 0, []
        yield from close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, spark_schema)


def align_documents(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Token groups, links and their corpus-wide counts, one row for each row of ``docs``.

    ``path_a`` names a byte-level tokenizer file, ``path_b`` a piece model.
    Result: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``; see the functions above.  A pair counts once in each row
    that holds it linked, so repeated rows and ids count as often as they stand;
    of equal counts all are an A id's best.  Null and empty texts, and texts that
    a tokenizer does not give back byte for byte, have zeros and an empty digest;
    null ids stay null; columns other than ``doc_id`` and ``text`` are not read.
    """
    aligned = materialize(_aligned(docs, path_a, path_b), "aligned")
    width = len(PieceTokens(path_b).bytes)
    pair = F.explode(F.arrays_zip("codes", "weights")).alias("p")
    held = aligned.where(F.col("kind") == 0).select("slice", pair).select("slice", F.col("p.codes").alias("code"), F.col("p.weights").alias("n"))
    counts = held.groupBy("code").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("code") / F.lit(width)))
    # at most B's vocabulary of rows for one A id
    best = F.max("n").over(Window.partitionBy("a"))
    counts = counts.select("code", "n", (F.col("n") == best).alias("best"))
    back = held.select("slice", "code").join(counts, "code")
    empty = lambda name: F.lit(None).cast(aligned.schema[name].dataType).alias(name)
    own = aligned.where(F.col("kind") == 1)
    names = [c for c in aligned.columns if c not in ("slice", "kind")]
    rows = back.select("slice", F.lit(0).alias("kind"), "code", "n", "best", *[empty(c) for c in names]).unionByName(
        own.select("slice", "kind", F.lit(None).cast(held.schema["code"].dataType).alias("code"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"), *names)
    )
    rows = rows.repartition("slice").sortWithinPartitions("slice", "kind", "code")

    def summed_up(part: pa.RecordBatch, known: np.ndarray, counts: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
        codes, weights = np.asarray(part.column("codes").flatten()), np.asarray(part.column("weights").flatten()).astype(np.int64)
        owner = np.repeat(np.arange(len(part)), np.asarray(part.column("codes").value_lengths()))
        place = np.searchsorted(known, codes)
        n_best, count_sum = np.zeros((2, len(part)), dtype=np.int64)
        if len(codes):
            np.add.at(n_best, owner, weights * best[place])
            np.add.at(count_sum, owner, weights * counts[place])
        first = [part.column(c) for c in ("doc_id", *_NUMBERS)]
        names = ["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"]
        return pa.RecordBatch.from_arrays([*first, pa.array(n_best), pa.array(count_sum), part.column("groups_sha256")], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's counts come before its documents, sorted by pair."""
        here, parts, table = None, [], None
        for batch in batches:
            slices, kinds = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.concatenate(([0], np.flatnonzero((slices[1:] != slices[:-1]) | (kinds[1:] != kinds[:-1])) + 1, [len(slices)]))
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if slices[lo] != here:
                    here, parts, table = slices[lo], [], None
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    parts.append([np.asarray(part.column("code")), np.asarray(part.column("n")), np.asarray(part.column("best").cast(pa.int8()))])
                    continue
                if table is None:
                    table = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, dtype=np.int64)] * 3
                for at in range(0, len(part), AT_LAST):
                    yield summed_up(part.slice(at, AT_LAST), *table)

    return rows.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
