"""Vectorised text kernels shared by the operators: words, shingles, batches.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D after lower-casing
A-Z, which is what ``[^\\x20\\x09-\\x0D]+`` finds, because no byte of a
multi-byte UTF-8 character falls in those ranges.  Word and shingle identities
are 64-bit hashes; where a result hangs on equality of texts the callers
compare the texts themselves.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; one longer document is handled alone.
SLICE_BYTES = 2 << 20

U64 = np.uint64
_R = U64(0x9E3779B97F4A7C15 | 1)
_R_INV = U64(pow(int(_R), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(SLICE_BYTES, 1 << int(n).bit_length())
    if size not in _powers:
        base = np.full(size, _R, dtype=U64)
        inverse = np.full(size, _R_INV, dtype=U64)
        base[0] = inverse[0] = 1
        tables = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
        if size > SLICE_BYTES:  # an outsized document: not kept
            return tables
        _powers[size] = tables
    return _powers[size]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column end to end, and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of at most `limit` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, and for each row where its words start (n + 1)."""
    n = len(raw)
    if not n:
        return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
    low = LOWER[raw]
    sep = _SEPARATOR[low]
    cut = np.zeros(n + 1, dtype=bool)  # a row starts here
    cut[offsets] = True
    begins = ~sep
    begins[1:] &= sep[:-1] | cut[1:n]
    ends = ~sep
    ends[:-1] &= sep[1:] | cut[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power_tables(n)
    total = np.empty(n + 1, dtype=U64)
    total[0] = 0
    np.cumsum(_BYTE[low] * power[:n], out=total[1:])
    hashes = mix64((total[end] - total[start]) * inverse[start] + (end - start).astype(U64))
    return hashes, np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's k-word shingles in order, and where each row's start.

    A row with fewer than k words, but at least one, has one: the whole sequence.
    """
    lengths = np.diff(at)
    counts = np.where(lengths >= k, lengths - k + 1, (lengths > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(counts)])
    if not len(words):
        return np.zeros(0, U64), out_at
    padded = np.concatenate([words, np.zeros(k, U64)])
    rolled = np.zeros(len(words), dtype=U64)
    for j in range(k):
        rolled = (rolled + padded[j : j + len(words)]) * _R
    keep = np.arange(len(words)) < np.repeat(at[1:] - k + 1, lengths)
    short = np.flatnonzero((lengths > 0) & (lengths < k))
    keep[at[short]] = True
    for i in short:
        h = np.array([lengths[i]], dtype=U64)
        for w in range(at[i], at[i + 1]):
            h = (h + words[w : w + 1]) * _R
        rolled[at[i]] = h[0]
    return mix64(rolled[keep]), out_at


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's sorted distinct shingle hashes, end to end, and n + 1 offsets."""
    words, at = word_hashes(raw, offsets)
    hashes, at = shingle_hashes(words, at, k)
    parts = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else hashes), np.concatenate([[0], np.cumsum(sizes)])


def grouped_min(values: np.ndarray, at: np.ndarray, empty: int) -> np.ndarray:
    """The least value of each group [at[i], at[i+1]); `empty` for none."""
    out = np.full(len(at) - 1, empty, dtype=values.dtype)
    some = at[1:] > at[:-1]
    if some.any():
        out[some] = np.minimum.reduceat(values, at[:-1][some])
    return out


def minhash(shingles: np.ndarray, at: np.ndarray, multipliers: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """rows x hashes: for each hash function its least value over the row's shingles."""
    out = np.empty((len(at) - 1, len(multipliers)), dtype=U64)
    for i, (a, b) in enumerate(zip(multipliers, masks, strict=True)):
        out[:, i] = grouped_min((shingles ^ b) * a, at, 0xFFFFFFFFFFFFFFFF)
    return out


def hash_family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def row_hashes(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's bytes."""
    power, inverse = _power_tables(len(raw) + 1)
    total = np.empty(len(raw) + 1, dtype=U64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * power[: len(raw)], out=total[1:])
    sizes = np.diff(offsets).astype(U64)
    return mix64((total[offsets[1:]] - total[offsets[:-1]]) * inverse[offsets[:-1]] + sizes)


@contextlib.contextmanager
def without_cycles() -> Iterator[None]:
    """No search for reference cycles meanwhile: code that makes millions of small objects, none in cycles, spends much time on it."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def _trim() -> None:
    """Free memory of this process goes back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which its process, which waits for other tasks, keeps no free memory."""

    @functools.wraps(run)
    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _trim()

    return out


def lean_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for a function of one group; its name and signature are Spark's to look at."""

    def out(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            _trim()

    return out
