"""Words of Arrow text columns as 64-bit hashes, vectorised over whole batches.

The helpers work on the UTF-8 buffer of a text column. A word hash is a
polynomial over the word's bytes modulo 2**64, read off prefix sums, so a batch
costs a handful of numpy passes and no Python step per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_SEGMENT = 1 << 17
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
UPPER, LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * _BASE)


@lru_cache(maxsize=8)
def byte_values(separators: bytes, fold: bool) -> np.ndarray:
    """One random value per byte; with `fold`, A-Z share the values of a-z."""
    values = stream(7, 256)
    if fold:
        values[list(UPPER)] = values[list(LOWER)]
    values[list(separators)] = 0
    return values


@lru_cache(maxsize=8)
def byte_flags(chosen: bytes) -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[list(chosen)] = True
    return flags


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << max(_SEGMENT.bit_length(), (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0][:n], _powers[1][:n]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about `limit` bytes (a longer row is a run of its own): first row, end row, bytes, offsets."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the number of words before it (one more than rows)."""
    inside = ~byte_flags(separators)[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.empty(len(inside) + 1, dtype=bool)
    edge[0], edge[-1] = True, True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[offsets] = True
    starts = np.flatnonzero(edge[:-1] & inside)
    ends = np.flatnonzero(edge[1:] & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Hash of every byte span; the spans are sorted by start and by end."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _SEGMENT, side="right")))
        b = int(ends[j - 1])
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray, separators: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the word offsets of the rows."""
    starts, ends, rows = word_bounds(data, offsets, separators)
    return span_hashes(data, starts, ends, byte_values(separators, fold)), rows


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k neighbouring values; run i starts at value i."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    for a in range(0, n, _SEGMENT):
        b = min(n, a + _SEGMENT)
        up, down = powers(b - a + k)
        sums = np.zeros(b - a + k, np.uint64)
        np.cumsum(words[a : b + k - 1] * up[: b - a + k - 1], out=sums[1:])
        out[a:b] = (sums[k:] - sums[:-k]) * down[: b - a]
    return mix(out)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the values of every run [start, end); starts and ends are sorted."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + _SEGMENT, side="right")))
        b = int(ends[j - 1])
        up, down = powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[a:b] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        i = j
    return mix(out)


def whole_windows(rows: np.ndarray, k: int, n_windows: int) -> np.ndarray:
    """True for the runs of k words that lie within one row; `rows` are word offsets."""
    if n_windows <= 0:
        return np.zeros(0, bool)
    inside = np.zeros(n_windows + 1, np.int64)
    first, last = rows[:-1], rows[1:] - k + 1
    some = last > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, np.minimum(last[some], n_windows), -1)
    return np.cumsum(inside[:-1]) > 0


def row_sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of per-byte (or per-word) counts for every row."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def as_long(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as signed values, as Spark's bigint holds them."""
    return x.view(np.int64)
