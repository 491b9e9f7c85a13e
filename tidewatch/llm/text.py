"""Whole texts as flat numpy arrays: words, lines and their 64-bit hashes, a few MB at a time.

Every function works on the UTF-8 bytes of many documents at once. A document longer than a slice
is a slice of its own; hashing goes through it in pieces, so only a few bytes per byte are held.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)  # fixed values: what ends a word
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_BASE, _INVERSE = 0x5851F42D4C957F2D, pow(0x5851F42D4C957F2D, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_set(members, inverted: bool = False) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return ~table if inverted else table


SPACE = byte_set(SPACES)
NEWLINE = byte_set([0x0A])


@lru_cache(2)
def _byte_codes(lower: bool) -> np.ndarray:
    source = np.arange(256, dtype=np.uint64)
    if lower:
        source[65:91] += np.uint64(32)
    return mix(source + np.uint64(_ODD[0]))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base):
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return run(_BASE), run(_INVERSE)


def utf8_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `limit` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = texts.cast(pa.large_string()).fill_null("")
    n = len(wide)
    if not n:
        return
    _, starts, data = wide.buffers()
    offsets = np.frombuffer(starts, np.int64, n + 1, 8 * wide.offset)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the longest runs of bytes outside `gap`; runs end with their row."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~gap[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside & (cut[:-1] | np.append(True, ~inside[:-1])))
    ends = np.flatnonzero(inside & (cut[1:] | np.append(~inside[1:], True))) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span's bytes; equal bytes have equal hashes everywhere.

    Spans are ordered and may overlap only in their order. Sums of byte codes times powers, cut out
    of running totals; pieces of SLICE_BYTES, a longer span is a piece of its own.
    """
    out = np.zeros(len(starts), np.uint64)
    codes, first = _byte_codes(lower), 0
    while first < len(starts):
        base = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, base + SLICE_BYTES, "right")))
        part = data[base:ends[last - 1]]
        size = SLICE_BYTES if len(part) < SLICE_BYTES else len(part) + 1
        power, inverse = _powers(size + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(codes[part] * power[:len(part)], out=total[1:])
        s, e = starts[first:last] - base, ends[first:last] - base
        out[first:last] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(_ODD[1]))
        first = last
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of `n` neighbouring word hashes."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(count, np.uint64)
    factor = 1
    for i in range(n):
        factor = factor * _ODD[2] % (1 << 64)
        total += words[i:i + count] * np.uint64(factor)
    return mix(total + np.uint64(n))


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of `n` rows begins in an ordered list of row numbers, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def per_row(rows: np.ndarray, n: int, weights=None) -> np.ndarray:
    return np.bincount(rows, weights, n).astype(np.int64) if len(rows) else np.zeros(n, np.int64)


def quoted_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_names(table, *wanted: str) -> list[str]:
    """The wanted column names, each made longer until `table` has no such column."""
    out = []
    for name in wanted:
        while name.lower() in {c.lower() for c in (*table.columns, *out)}:
            name += "_"
        out.append(name)
    return out
