"""Word shingles of Arrow text columns, as numpy arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x`` (uint64)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, made once per task."""

    def __init__(self):
        self.up = np.ones(0, dtype=np.uint64)
        self.down = np.ones(0, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            steps = np.full((2, n), 1, dtype=np.uint64)
            steps[0, 1:], steps[1, 1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self.up, self.down = np.cumprod(steps, axis=1, dtype=np.uint64)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def hash_words(text: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and hash of each word of ``text``, the bytes between those that ``space`` marks."""
    space = np.concatenate(([True], space, [True]))
    begin = np.flatnonzero(space[:-1] & ~space[1:])
    end = np.flatnonzero(~space[:-1] & space[1:])
    up, down = _POWERS.of(len(text))
    total = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return begin, mixed((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))


def _lower_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words end at ASCII white space; A-Z count as a-z."""
    text = _LOWER[data]
    return hash_words(text, _SPACE[text])


def words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """``(row, word hashes)`` of every text with a word, in order; whole texts, in bounded pieces."""
    texts = [memoryview(x.as_buffer() or b"") for x in column.cast(pa.binary())]
    at = 0
    while at < len(texts):
        stop, held = at, 0
        while stop < len(texts) and (stop == at or held + len(texts[stop]) < _CHUNK):
            held += len(texts[stop]) + 1
            stop += 1
        if held > 2 * _CHUNK:  # one long text: in parts that end at white space
            data, found, lo = np.frombuffer(texts[at], dtype=np.uint8), [], 0
            while lo < len(data):
                hi = min(lo + _CHUNK, len(data))
                while hi < len(data):
                    gap = np.flatnonzero(_SPACE[data[max(lo, hi - 4096) : hi]])
                    if len(gap):
                        hi = max(lo, hi - 4096) + int(gap[-1]) + 1
                        break
                    hi = min(hi + 4096, len(data))
                found.append(_lower_words(data[lo:hi])[1])
                lo = hi
            each = np.concatenate(found)
            if len(each):
                yield at, each
        else:
            data = np.frombuffer(b" ".join(texts[at:stop]), dtype=np.uint8)
            ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts[at:stop]), np.int64, stop - at))
            begin, each = _lower_words(data)
            cuts = np.searchsorted(begin, np.concatenate(([0], ends)))
            for k in range(stop - at):
                if cuts[k + 1] > cuts[k]:
                    yield at + k, each[cuts[k] : cuts[k + 1]]
        at = stop


def shingle_set(each: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; fewer words are one shingle, the whole sequence."""
    n = len(each)
    if n < WORDS:
        return mixed((each * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
    total = each[: n - WORDS + 1] * _PLACES[0]
    for k in range(1, WORDS):
        total = total + each[k : n - WORDS + 1 + k] * _PLACES[k]
    return np.unique(mixed(total))
