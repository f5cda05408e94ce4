"""Vectorised word and window hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Texts are handled whole, in slices of about
SLICE bytes of documents at a time, so memory follows the longest document and not the Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD1342543DE82EF95)


def trimmed(f: Callable) -> Callable:
    """f for mapInArrow; at its end the worker, which stays for later tasks, hands freed memory back to the system."""

    def g(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library: nothing to do
            pass

    return g


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64; x is uint64."""
    x = x + _BASE
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64) * _STEP + _U(7))
_BYTE_LOWER = _BYTE[LOWER]


@lru_cache(maxsize=4)
def _powers(n: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, p, np.uint64)
    down = np.full(n, pow(p, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """p to the power i, and its inverse, modulo 2 to the 64."""
    size = 1 << max(18, int(n).bit_length())
    up, down = _powers(size, p)
    return up[:n], down[:n]


def slices(batch: pa.RecordBatch, name: str, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of these rows in them); a null text is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(col.type) or not pa.types.is_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and for each row the index of its first word (one more entry than rows)."""
    n = len(data)
    inside = np.empty(n + 1, bool)
    np.logical_not(SPACE[data], out=inside[:n])
    inside[n] = False
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside[:n]
    starts = np.flatnonzero(inside & (edge | ~before))
    ends = np.flatnonzero(before & (edge | ~inside))
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with lower, of the word with A-Z in lower case."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1, 0x2545F4914F6CDD1D)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of the word sequences hashes[first:last]."""
    if not len(first):
        return np.zeros(0, np.uint64)
    up, down = powers(len(hashes) + 1, 0x5851F42D4C957F2D)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes ^ _U(seed * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * up[:-1], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def window_starts(bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all k-word windows that lie in one row, and how many each row has."""
    n = int(bounds[-1])
    sizes = np.diff(bounds)
    ok = np.zeros(n + 1, np.int32)
    long = sizes >= k
    np.add.at(ok, bounds[:-1][long], 1)
    np.add.at(ok, bounds[1:][long] - k + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:n])), np.maximum(sizes - k + 1, 0)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
