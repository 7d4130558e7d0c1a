"""Whole batches of texts as flat numpy arrays: words, word hashes and shingles without a Python object per word.

The operators of this package call these inside Arrow tasks.  A batch of strings is one byte array with row offsets;
words are the runs of bytes outside ``[\\x20\\x09-\\x0D]``, which never occur inside a UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers, the same on every machine."""
    steps = np.arange(1, n + 1, dtype=np.uint64) + np.uint64((seed * 1_000_003) & 0xFFFFFFFF)
    return mix(steps * np.uint64(0x9E3779B97F4A7C15))


BYTE_VALUES = stream(1, 256)
PLACES = stream(2, 8) | np.uint64(1)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15
#: Spans are hashed in pieces of so many bytes, whose numbers stay in a core's cache.
HASH_BYTES = 1 << 16
_POWERS = powers(_BASE, HASH_BYTES)
_BACK = powers(pow(_BASE, -1, 1 << 64), HASH_BYTES)


def lowered(data: np.ndarray) -> np.ndarray:
    """``LOWER`` of each byte, without a look-up for each."""
    return data + ((data - np.uint8(65) < 26).view(np.uint8) << np.uint8(5))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of whole rows of about ``limit`` bytes, so that temporaries stay small: first row, bytes, offsets."""
    lo, rows = 0, len(offsets) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and row of every word."""
    inside = (data != 32) & (data - np.uint8(9) > 4)
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return starts, np.flatnonzero(last) + 1 - starts, rows


def hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; spans are in order and none holds another.

    The hash is a polynomial of the bytes, so a span's is the difference of two running sums, moved back to the span's start.
    """
    ends, out, lo = starts + lengths, np.zeros(len(starts), np.uint64), 0
    while lo < len(starts):
        first = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, first + HASH_BYTES, side="right")))
        n = int(ends[hi - 1] - first)
        power = _POWERS if n <= HASH_BYTES else powers(_BASE, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data[first : first + n]] * power[:n], out=sums[1:])
        at = starts[lo:hi] - first
        out[lo:hi] = mix((sums[ends[lo:hi] - first] - sums[at]) * _BACK[at] + lengths[lo:hi].astype(np.uint64))
        lo = hi
    return out


def shingles(word_hashes: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of ``size`` words; a row with fewer words, but one at least, is a single run."""
    counts = np.bincount(rows, minlength=n_rows)
    m = max(0, len(word_hashes) - size + 1)
    out = np.zeros(m, dtype=np.uint64)
    for k in range(size):
        out += word_hashes[k : k + m] * PLACES[k]
    whole = rows[:m] == rows[size - 1 :]
    out, at = mix(out + np.uint64(size))[whole], rows[:m][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        begins = np.cumsum(counts) - counts
        lone = np.zeros(len(short), dtype=np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            lone[has] += word_hashes[begins[short[has]] + k] * PLACES[k]
        out = np.concatenate([out, mix(lone + counts[short].astype(np.uint64))])
        at = np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def shingle_sets(column: pa.Array, size: int, lower: bool = True) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row's text, in row order."""
    data, offsets = flat(column)
    for _, part, bounds in chunks(data, offsets):
        part = lowered(part) if lower else part
        starts, lengths, rows = words(part, bounds)
        n = len(bounds) - 1
        found, at = shingles(hashes(part, starts, lengths), rows, n, size)
        cuts = np.searchsorted(at, np.arange(n + 1))
        for i in range(n):
            yield np.unique(found[cuts[i] : cuts[i + 1]])
