"""Whole texts as arrays: words and their hashes for a batch of texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: An odd multiplier for rolling hashes modulo 2^64.
MULTIPLIER = 0x9E3779B97F4A7C15
U64 = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(MULTIPLIER, -1, 1 << 64)
    def run(m):
        out = np.full(n, U64(m))
        out[0] = 1
        return np.multiply.accumulate(out)
    return run(MULTIPLIER), run(inverse)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M^0 .. M^(n-1) and those of its inverse, modulo 2^64."""
    size = 1 << max(16, (n - 1).bit_length())
    return _powers(size)


def parts(texts: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row runs of about ``limit`` bytes: first row, bytes, offsets (from 0; a null is empty). Texts stay whole."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def word_bounds(inside: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each run of True; a run ends where its row ends, and at ``cuts``."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[1:n] = inside[1:] != inside[:-1]
    edge[offsets] = True
    if cuts is not None:
        edge[cuts] = True
    at = np.flatnonzero(edge[:n])
    ends = np.append(at[1:], n)
    real = inside[at]
    starts, ends = at[real], ends[real]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U64)
    m, inverse = powers(len(data))
    values = (data.astype(U64) + U64(1)) * m[:len(data)]
    values *= inside
    return mixed(np.add.reduceat(values, starts) * inverse[starts])
