"""Byte n-grams of Arrow text columns, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes worked on at a time; bounds a task's memory whatever the texts' lengths.
CHUNK = 1 << 18
#: Bytes of text of the rows that are looked at together.
SLICE = 1 << 20

#: Lower case of ASCII letters; white space as spaces.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER[[9, 10, 11, 12, 13]] = 32

#: The same, and every ASCII sign and digit as a space.
LETTERS = LOWER.copy()
LETTERS[[b for b in range(128) if not 97 <= LOWER[b] <= 122]] = 32

_MIX = np.uint64(0x9E3779B97F4A7C15)


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``size`` bytes of text in ``column``, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def chunks(column: pa.Array, overlap: int, size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield ``(rows, starts, stops, data)`` of consecutive texts.

    Text ``rows[k]``, between two spaces, is ``data[starts[k]:stops[k]]``.  A
    text longer than ``size`` bytes comes in parts that share ``overlap`` bytes,
    so every n-gram of up to ``overlap + 1`` bytes is in some part; the parts
    of one text have the same row number.  Nulls are empty texts.
    """
    texts = [memoryview(x.as_buffer() or b"") for x in column.cast(pa.binary())]
    rows: list[int] = []
    parts: list = []
    held = 0

    def joined():
        data = np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)
        lengths = np.fromiter((len(p) for p in parts), np.int64, len(parts))
        ends = np.cumsum(lengths + 1) + 1
        return np.array(rows, dtype=np.int64), ends - lengths - 2, ends, data

    for row, text in enumerate(texts):
        for at in range(0, max(1, len(text) - overlap), size - overlap):
            part = text[at : at + size]
            if parts and held + len(part) > size:
                yield joined()
                rows, parts, held = [], [], 0
            rows.append(row)
            parts.append(part)
            held += len(part)
    if parts:
        yield joined()


def lower(data: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """Lower case of ASCII and of the Latin letters that UTF-8 writes after 0xC3."""
    out = table[data]
    two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[two] |= 0x20
    return out


def hashed(data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket below ``2**bits`` of the n-gram (n up to 8) that starts at each byte."""
    count = max(0, len(data) - n + 1)
    key = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        key |= data[k : k + count].astype(np.uint64) << np.uint64(8 * k)
    key += np.uint64(n)
    key *= _MIX
    key ^= key >> np.uint64(29)
    key *= _MIX
    return (key >> np.uint64(64 - bits)).astype(np.int64)


def owners(starts: np.ndarray, stops: np.ndarray, n: int, count: int) -> np.ndarray:
    """Index of the text that each n-gram position lies in whole, or -1.

    The last of a text's two spaces is the first of the next, so spans overlap
    by one byte; an n-gram of two bytes or more lies in one span at most.
    """
    out = np.full(count, -1, dtype=np.int64)
    lengths = np.maximum(stops - starts - n + 1, 0)
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
    out[at] = np.repeat(np.arange(len(starts)), lengths)
    return out
