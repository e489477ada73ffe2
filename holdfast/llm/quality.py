"""A quality classifier: a byte-level convolutional network in numpy.

Filters of WIDTH bytes run over the whole text, in chunks of CHUNK positions
whose windows overlap by WIDTH - 1 bytes.  Each chunk is max-pooled; a document
is described by the mean and the maximum of its chunks and by its length, from
which a small dense layer makes one probability.

Training sees a bounded sample of labelled rows.  Scoring sees every byte; there
the filters are tabulated by byte pairs, so that a window costs WIDTH / 2 look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import _text as X

WIDTH, FILTERS, CHUNK, HIDDEN = 6, 16, 64, 16
#: Below this score a document is rejected.  Most labelled rows and bytes of a text that training sees.
THRESHOLD, MAX_ROWS, MAX_BYTES = 0.3, 4096, 1 << 17
_SCORED_BYTES = 1 << 18


class ByteNet:
    """parameters: taps (WIDTH, 256, FILTERS), bias, and the dense head."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = 2 * FILTERS + 1
        self.p = {
            "taps": rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32),
            "bias": np.zeros(FILTERS, np.float32),
            "w1": rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)).astype(np.float32),
            "b1": np.zeros(HIDDEN, np.float32),
            "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32),
            "b2": np.zeros(1, np.float32),
        }
        self.p["taps"][:, 0] = 0  # byte 0 pads

    @staticmethod
    def lay_out(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Texts with WIDTH - 1 zero bytes after each; where they start; starts of chunks; chunks before each text."""
        sizes = np.diff(offsets)
        starts = offsets[:-1] + np.arange(len(sizes)) * (WIDTH - 1)
        padded = np.zeros(len(raw) + len(sizes) * (WIDTH - 1), np.uint8)
        padded[np.arange(len(raw)) + np.repeat(starts - offsets[:-1], sizes)] = raw
        chunks = np.maximum(1, -(-sizes // CHUNK))
        first = np.concatenate([[0], np.cumsum(chunks)])
        at = np.repeat(starts, chunks) + (np.arange(first[-1]) - np.repeat(first[:-1], chunks)) * CHUNK
        return padded, starts, at, first

    def head(self, pooled: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """pooled: chunks x FILTERS, after bias and ReLU."""
        count = np.diff(first)[:, None].astype(np.float32)
        mean = np.add.reduceat(pooled, first[:-1], axis=0) / count
        top = np.maximum.reduceat(pooled, first[:-1], axis=0)
        x = np.concatenate([mean, top, np.log1p(sizes)[:, None].astype(np.float32) / 8], axis=1)
        hidden = np.tanh(x @ self.p["w1"] + self.p["b1"])
        logit = hidden @ self.p["w2"] + self.p["b2"][0]
        return x, hidden, 1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -40, 40)))

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = 10, batch: int = 24, rate: float = 4e-3, seed: int = 11) -> ByteNet:
        rng = np.random.default_rng(seed)
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, total = 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                grads = self._gradients([texts[r] for r in rows], labels[rows])
                step += 1
                now = rate * (1 - step / (total + 1))
                for k, g in grads.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[k] -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        return self

    def _gradients(self, texts: list[bytes], y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        sizes = np.array([len(t) for t in texts])
        raw = np.frombuffer(b"".join(texts), np.uint8)
        padded, starts, at, first = self.lay_out(raw, np.concatenate([[0], np.cumsum(sizes)]))
        chunks = np.diff(first)
        place = np.arange(CHUNK)
        owner = np.repeat(np.arange(len(texts)), chunks)
        last = starts[owner] + np.maximum(sizes[owner], 1) - 1
        positions = np.minimum(at[:, None] + place, last[:, None])  # a short chunk repeats its last window
        padded = np.concatenate([padded, np.zeros(WIDTH, np.uint8)])
        out = p["taps"][0][padded[positions]]
        for k in range(1, WIDTH):
            out += p["taps"][k][padded[positions + k]]
        best = out.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(out, best[:, None], axis=1)[:, 0] + p["bias"], 0)
        x, hidden, score = self.head(pooled, first, sizes)
        d = ((score - y) / len(texts)).astype(np.float32)
        grads = {"w2": hidden.T @ d, "b2": np.array([d.sum()], np.float32)}
        dh = d[:, None] * p["w2"] * (1 - hidden * hidden)
        grads |= {"w1": x.T @ dh + 1e-4 * p["w1"], "b1": dh.sum(axis=0)}
        dx = dh @ p["w1"].T
        top = x[:, FILTERS : 2 * FILTERS][owner] == pooled
        dpool = (dx[:, :FILTERS] / chunks[:, None])[owner] + dx[:, FILTERS : 2 * FILTERS][owner] * top
        dpool *= pooled > 0
        grads["bias"] = dpool.sum(axis=0)
        taps = np.zeros_like(p["taps"])
        where = np.take_along_axis(positions, best, axis=1)
        filters = np.broadcast_to(np.arange(FILTERS), where.shape)
        for k in range(WIDTH):
            flat = padded[where + k].astype(np.int64) * FILTERS + filters
            taps[k] = np.bincount(flat.ravel(), weights=dpool.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
        taps += 1e-5 * p["taps"]
        taps[:, 0] = 0
        grads["taps"] = taps
        return grads

    def tables(self) -> list[np.ndarray]:
        """For each two taps, their sum by byte pair (first * 256 + second)."""
        t = self.p["taps"]
        return [(t[k][:, None] + t[k + 1][None]).reshape(65536, FILTERS) for k in range(0, WIDTH, 2)]

    def scores(self, raw: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        parts = [self._pooled(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], tables) for i, j in X.slices(offsets, _SCORED_BYTES)]
        pooled = np.concatenate([p for p, _ in parts])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, f in parts]))])
        return self.head(pooled, first, np.diff(offsets))[2]

    def _pooled(self, raw: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(offsets)
        padded, starts, at, first = self.lay_out(raw, offsets)
        padded = np.concatenate([padded, np.zeros(WIDTH, np.uint8)])
        pooled = np.empty((len(at), FILTERS), np.float32)
        stretch = max(1, _SCORED_BYTES // CHUNK)  # chunks at a time: one long text needs no more memory than many short ones
        ends = np.minimum(at + CHUNK, np.repeat(starts + np.maximum(sizes, 1), np.diff(first)))
        for c in range(0, len(at), stretch):
            begin, end = at[c], ends[min(c + stretch, len(at)) - 1]
            pair = padded[begin : end + WIDTH].astype(np.int32)
            pair = pair[:-1] * 256 + pair[1:]
            n = end - begin
            out = tables[0].take(pair[:n], axis=0)
            for k in range(1, WIDTH // 2):
                out += tables[k].take(pair[2 * k : 2 * k + n], axis=0)
            bounds = np.empty(2 * (min(c + stretch, len(at)) - c), np.int64)
            bounds[0::2], bounds[1::2] = at[c : c + stretch] - begin, ends[c : c + stretch] - begin
            pooled[c : c + stretch] = np.maximum.reduceat(out, bounds[:-1], axis=0)[0::2]
        return np.maximum(pooled + self.p["bias"], 0), first


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, text: str, key: str) -> tuple[list[bytes], np.ndarray]:
    """The bounded sample: rows of the least key hashes among labelled rows outside the held-out fifth."""
    named = labels.select(F.col(key).cast("long").alias("k"), F.col("quality").cast("int").alias("y")).where("k is not null and y is not null")
    fold = named.where(F.crc32(F.col("k").cast("string")) % 5 != 0)
    chosen = fold.groupBy("k").agg(F.max("y").alias("y")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)
    found = rows.join(F.broadcast(chosen), "k").select("k", "y", F.coalesce("text", F.lit("")).alias("text")).toPandas().sort_values(["k", "text"])
    return [t.encode() for t in found["text"]], found["y"].to_numpy(np.float64)


@dataclass
class Scorer:
    """A trained network, or with fewer than two classes to learn from one score for all."""

    net: ByteNet | None
    share: float

    @classmethod
    def trained(cls, docs: DataFrame, labels: DataFrame, max_rows: int, max_bytes: int, text: str, key: str) -> Scorer:
        texts, y = training_rows(docs, labels, max_rows, max_bytes, text, key)
        mixed = len(set(y.tolist())) > 1
        return cls(ByteNet().fit(texts, y) if mixed else None, (float(y.sum()) + 1) / (len(y) + 2))

    def scores(self, column: pa.Array, tables: list[np.ndarray]) -> np.ndarray:
        if self.net is None or not len(column):
            return np.full(len(column), self.share)
        return self.net.scores(*X.utf8(column), tables)

    def tables(self) -> list[np.ndarray]:
        return self.net.tables() if self.net else []


def quality_classifier(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Labels are learnt only where crc32(key as text) mod 5 is not 0, from at most
    max_rows labelled keys, of texts of at most max_bytes; of labels repeated for
    a key the largest counts.  Every row is scored on its whole text; null counts
    as empty.  With fewer than two classes to learn from, the score is the
    smoothed share of label 1 (0.5 without labels).  A null key is not held out.
    Other columns are never read.  No rows give no rows.
    """
    scorer = Scorer.trained(docs, labels, max_rows, max_bytes, text, key)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = scorer.tables()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scorer.scores(batch.column(1), tables))], ["doc_id", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return rows.mapInArrow(X.lean(run), "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the rows that quality_classifier rejects; all columns as they are, nothing shuffled."""
    scorer = Scorer.trained(docs, labels, max_rows, max_bytes, text, key)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = scorer.tables()
        for batch in batches:
            yield batch.filter(pa.array(scorer.scores(batch.column(at), tables) >= threshold))

    return docs.mapInArrow(X.lean(run), docs.schema)
