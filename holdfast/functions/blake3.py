"""BLAKE3-256 from the published algorithm, over binary columns.

The chunks of a content are compressed side by side in numpy; the tree above them is
small.  Fixed values: the initial words and the message permutation of the specification.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK = 64, 1024


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, message: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values of many compressions: cv 8 x n, message 16 x n."""
    n = cv.shape[1]
    v = [*cv, *[np.full(n, w, np.uint32) for w in IV[:4]], (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32), (counter >> np.uint64(32)).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = list(message)

    def mix(a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
        for word, first, second in ((x, 16, 12), (y, 8, 7)):
            v[a] = v[a] + v[b] + word
            v[d] = _rotated(v[d] ^ v[a], first)
            v[c] = v[c] + v[d]
            v[b] = _rotated(v[b] ^ v[c], second)

    for turn in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        if turn < 6:
            m = [m[p] for p in PERMUTATION]
    return np.stack([v[i] ^ v[i + 8] for i in range(8)])


def blake3_hex(data: bytes) -> str:
    """64 lowercase hex digits."""
    chunks = max(1, -(-len(data) // CHUNK))
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    blocks = padded.view("<u4").reshape(chunks, CHUNK // BLOCK, 16)
    sizes = np.minimum(CHUNK, np.maximum(0, len(data) - np.arange(chunks) * CHUNK))
    last = np.maximum(1, -(-sizes // BLOCK)) - 1
    cv = np.repeat(IV[:, None], chunks, axis=1)
    single = ROOT if chunks == 1 else 0
    for b in range(int(last.max()) + 1):
        on = np.flatnonzero(last >= b)
        flags = np.where(b == 0, CHUNK_START, 0) | np.where(last[on] == b, CHUNK_END | single, 0)
        length = np.where(last[on] == b, sizes[on] - b * BLOCK, BLOCK)
        cv[:, on] = _compress(cv[:, on], blocks[on, b].T, on.astype(np.uint64), length, flags)
    nodes = cv.T
    # The left subtree of a node is the largest power of two of chunks: pairs from the left, a lone last one going up.
    while len(nodes) > 1:
        pairs = len(nodes) // 2
        message = np.ascontiguousarray(nodes[: 2 * pairs].reshape(pairs, 16).T)
        flags = np.full(pairs, PARENT | (ROOT if len(nodes) == 2 else 0))
        joined = _compress(np.repeat(IV[:, None], pairs, axis=1), message, np.zeros(pairs, np.uint64), np.full(pairs, BLOCK), flags).T
        nodes = np.concatenate([joined, nodes[2 * pairs :]])
    return nodes[0].astype("<u4").tobytes().hex()


def blake3(content: Column) -> Column:
    """The digest of a binary column; null where it is null."""
    digest = F.pandas_udf(_series, "string")
    return digest(content.cast("binary"))


def _series(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else blake3_hex(bytes(b)))
