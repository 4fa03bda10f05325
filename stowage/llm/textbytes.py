"""Vectorised word and window hashing over a batch of UTF-8 texts.

A batch of texts is one flat byte array plus start offsets, so the work per
text is a few numpy passes and never a Python loop over characters or words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACES = (0x20, *range(0x09, 0x0E))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values without visible structure."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte, and the same with A-Z as a-z.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(_SPACES)] = True


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    done, top = 1, np.uint64(base)
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * top
        done += step
        top = top * top
    return out


_INVERSE = pow(int(_BASE), -1, 1 << 64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, int(n).bit_length())
    if size not in _tables:
        if len(_tables) > 1:
            _tables.clear()
        with np.errstate(over="ignore"):
            _tables[size] = _powers(int(_BASE), size), _powers(_INVERSE, size)
    return _tables[size]


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty. Text i is bytes[offsets[i]:offsets[i + 1]]."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """P with P[i] the polynomial hash of values[:i]; see span_hash."""
    power, _ = _tables_for(len(values) + 1)
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] that doesn't depend on where the span lies."""
    _, inverse = _tables_for(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * _M2)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, number of words before each text) of the runs of non-space bytes; words end at the end of a text."""
    space = IS_SPACE[data]
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= space[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def shingle_sets(column, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles.

    Words are lower-cased in A-Z only. A text with fewer than `width` words but
    at least one has its whole word sequence as one shingle; one without words
    has the empty set.
    """
    out: list[np.ndarray] = []
    for _, data, offsets in slices(*flat(column)):
        start, end, counts = words(data, offsets)
        hashes = span_hash(prefix_hash(LOWER_VALUES[data]), start, end)
        shingles = np.zeros(max(0, len(hashes) - width + 1), dtype=np.uint64)
        for j in range(width):
            shingles = mix(shingles * _BASE + hashes[j : j + len(shingles)])
        for a, b in zip(counts[:-1].tolist(), counts[1:].tolist()):
            if b - a >= width:
                out.append(np.unique(shingles[a : b - width + 1]))
            elif b > a:
                whole = np.zeros(1, dtype=np.uint64)
                for j in range(a, b):
                    whole = mix(whole * _BASE + hashes[j])
                out.append(mix(whole + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
    return out


def slices(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20):
    """(first text, bytes, offsets) of runs of whole texts of about `most` bytes, so that temporaries stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
