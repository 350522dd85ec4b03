"""Circulant MinHash: all coordinates of a signature from two permutations, one of them shifted.

The first permutation places a shingle on a ring of RING places (its hash is
well mixed, so its low bits are that place). The second gives every place a
rank. Coordinate k is the smallest rank among the places of the set, each moved
on by k. The ranks a place meets under all shifts are neighbours in the rank
table, so one gather of a slice per shingle yields all coordinates.

`binned` is the cheaper kind for very many short sets: a hash function deals the
shingles into bins and keeps the smallest hash of each, so a shingle costs one
step per function and not one per coordinate.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

from scorebook.llm import hashing as H

RING = 1 << 20
_CHUNK = 2048


@lru_cache(maxsize=4)
def _ranks(size: int) -> np.ndarray:
    """The rank table, one row of `size` shifted ranks per place (a view, not a copy)."""
    ranks = np.argsort(H.stream(3, RING), kind="stable").astype(np.uint32)
    return sliding_window_view(np.concatenate([ranks, ranks[:size]]), size)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """The `size` coordinates of one set of shingle hashes."""
    ranks, places = _ranks(size), (shingles & np.uint64(RING - 1)).astype(np.int64)
    out = ranks[places[:_CHUNK]].min(axis=0)
    for i in range(_CHUNK, len(places), _CHUNK):
        np.minimum(out, ranks[places[i : i + _CHUNK]].min(axis=0), out=out)
    return out


@lru_cache(maxsize=4)
def _weights(bands: int, rows: int) -> np.ndarray:
    return H.stream(5, bands * rows).reshape(bands, rows) | np.uint64(1)


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band of every signature (a row each); bands do not share keys."""
    cut = signatures[..., : bands * rows].reshape(*signatures.shape[:-1], bands, rows).astype(np.uint64)
    return H.mix((cut * _weights(bands, rows)).sum(axis=-1, dtype=np.uint64) + H.stream(9, bands))


@lru_cache(maxsize=4)
def _orders(functions: int, bins: int) -> np.ndarray:
    """For every function and bin an order of the bins drawn by hash."""
    return np.argsort(H.stream(31, functions * bins * bins).reshape(functions, bins, bins), axis=-1)


def binned(shingles: np.ndarray, owner: np.ndarray, n: int, bins: int, functions: int) -> np.ndarray:
    """Smallest hash of every set, bin and function (sets, bins, functions); `owner` is the set of each shingle.

    An empty bin takes what the first filled one holds in an order of the bins of
    its own, so in sets with fewer shingles than bins the bins still agree or
    differ independently of each other.
    """
    top = np.uint32(0xFFFFFFFF)
    out = np.full((functions, n * bins), top, np.uint32)
    factors = H.stream(29, functions) | np.uint64(1)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    for i in range(0, len(shingles), 1 << 16):
        part, first = shingles[i : i + (1 << 16)], owner[i : i + (1 << 16)] * bins
        for f in range(functions):
            x = part * factors[f]
            place = first + (((x & low) * np.uint64(bins)) >> half).astype(np.int64)
            np.minimum.at(out[f], place, (x >> half).astype(np.uint32))
    own = out.reshape(functions, n, bins)
    out, orders = own.copy(), _orders(functions, bins)
    for f in range(functions):
        row, bin_ = np.nonzero(own[f] == top)
        for k in range(bins):
            if not len(row):
                break
            out[f, row, bin_] = found = own[f, row, orders[f, bin_, k]]
            row, bin_ = row[found == top], bin_[found == top]
    return out.transpose(1, 2, 0)


def bin_keys(cut: np.ndarray) -> np.ndarray:
    """One 64-bit key per set and bin of `binned`."""
    _, bins, functions = cut.shape
    return H.mix((cut.astype(np.uint64) * _weights(bins, functions)).sum(axis=-1, dtype=np.uint64) + H.stream(9, bins))


SKETCH_BITS = 2048


def sketch(shingles: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """The last bit of `size` coordinates as 64-bit numbers: two sets differ in about half of 1 - similarity of them."""
    return np.packbits((signature(shingles, size) & 1).astype(np.uint8)).view(np.int64)


def odd_sketch(shingles: np.ndarray, owner: np.ndarray, n: int, size: int) -> np.ndarray:
    """For each of n sets `size` bits as 64-bit numbers: whether an odd number of its hashes fall on the bit.

    `owner` is the set of each hash; no set holds a hash twice. What two sets
    share cancels out, so they differ in at most as many bits as in elements.
    """
    out = np.zeros(n * (size // 64), np.uint64)
    place = owner * (size // 64) + ((shingles >> np.uint64(6)) % np.uint64(size // 64)).astype(np.int64)
    np.bitwise_xor.at(out, place, np.uint64(1) << (shingles & np.uint64(63)))
    return out.view(np.int64)


def set_print(shingles: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a set of hashes that does not depend on their order."""
    hi = H.mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    lo = H.mix(shingles ^ np.uint64(0x3C3C3C3CC3C3C3C3)).sum(dtype=np.uint64)
    return int(hi.astype(np.int64)), int(lo.astype(np.int64))
