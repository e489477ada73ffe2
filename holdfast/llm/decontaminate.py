"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity to it, so that
plain MinHash misses it.  Items are therefore partitioned by the size of their
shingle sets, in powers of two, and each partition meets documents as windows of
twice its largest size, half overlapping: an item that a window contains makes up
a fifth of it at least, whatever the document's length.  Any of HASHES equal
MinHash values makes a candidate (a fifth gives a miss of one in a million), and
every candidate is verified on the exact shingles of item and whole document.

Items travel to the tasks in blocks of bounded size; a larger benchmark takes
more blocks.  Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import _text as X

HASHES, SEED, ITEMS_PER_BLOCK = 64, 5, 20_000
_FILTER_BITS = 18


def exact_shingles(text: bytes, k: int) -> set[bytes]:
    words = text.translate(bytes(X.LOWER)).split()
    if len(words) < k:
        return {b" ".join(words)} if words else set()
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


@dataclass
class ItemIndex:
    """A block of items: their shingle hashes, and by size class and hash function their MinHash values."""

    k: int
    ids: list[int] = field(default_factory=list)
    texts: list[bytes] = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)
    classes: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, ids: list[int], texts: list[bytes], k: int) -> ItemIndex:
        raw, offsets = X.utf8(pa.array(texts, pa.binary()))
        sets, at = X.shingle_sets(raw, offsets, k)
        out = cls(k)
        keep = np.flatnonzero(np.diff(at))
        out.ids, out.texts = [ids[i] for i in keep], [texts[i] for i in keep]
        out.sets = [sets[at[i] : at[i + 1]] for i in keep]
        multipliers, masks = X.hash_family(HASHES, SEED)
        by_class: dict[int, list[int]] = {}
        for i, s in enumerate(out.sets):
            by_class.setdefault(len(s).bit_length() - 1, []).append(i)
        for c, items in sorted(by_class.items()):
            joined = np.concatenate([out.sets[i] for i in items])
            starts = np.concatenate([[0], np.cumsum([len(out.sets[i]) for i in items])])
            out.classes[c] = (np.array(items), X.minhash(joined, starts, multipliers, masks))
        return out

    def search(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) for every candidate of some texts, with its count of shared hashes."""
        words, at = X.word_hashes(raw, offsets)
        hashes, at = X.shingle_hashes(words, at, self.k)
        if not len(hashes) or not self.classes:
            return
        multipliers, masks = X.hash_family(HASHES, SEED)
        step = 2 << min(self.classes)  # places between windows of the smallest class
        counts = np.diff(at)
        blocks = -(-counts // step)
        first = np.concatenate([[0], np.cumsum(blocks)])
        owner = np.repeat(np.arange(len(counts)), blocks)
        starts = at[:-1][owner] + (np.arange(first[-1]) - first[owner]) * step
        levels = {}
        for c in self.classes:
            wide = (2 << c) // step
            n = -(-blocks // wide)
            own = np.repeat(np.arange(len(counts)), n)
            f = np.concatenate([[0], np.cumsum(n)])
            levels[c] = (own, first[own] + (np.arange(f[-1]) - f[own]) * wide, own[1:] == own[:-1])
        found: set[tuple[int, int]] = set()
        for h in range(HASHES):
            least = np.minimum.reduceat((hashes ^ masks[h]) * multipliers[h], starts)
            for c, (items, signature) in self.classes.items():
                own, begin, joined = levels[c]
                window = least if (2 << c) == step else np.minimum.reduceat(least, begin)
                window = window.copy()
                window[:-1] = np.where(joined, np.minimum(window[:-1], window[1:]), window[:-1])
                for w in np.flatnonzero(self._filter(c, h)[(window >> X.U64(20)).astype(np.int64) & ((1 << _FILTER_BITS) - 1)]):
                    for i in items[signature[:, h] == window[w]]:
                        found.add((int(own[w]), int(i)))
        sets: dict[int, np.ndarray] = {}
        for row, item in sorted(found):
            if row not in sets:
                sets[row] = np.unique(hashes[at[row] : at[row + 1]])
            yield row, item, int(np.isin(self.sets[item], sets[row], assume_unique=True).sum())

    def _filter(self, c: int, h: int) -> np.ndarray:
        made = self.__dict__.setdefault("filters", {})
        if (c, h) not in made:
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(self.classes[c][1][:, h] >> X.U64(20)).astype(np.int64) & ((1 << _FILTER_BITS) - 1)] = True
            made[c, h] = bits
        return made[c, h]


def _matches(batch_column: pa.Array, index: ItemIndex, percent: int) -> Iterator[tuple[int, int, int]]:
    """(row, item, exactly shared shingles) with containment of at least percent."""
    raw, offsets = X.utf8(batch_column)
    for i, j in X.slices(offsets):
        kept: dict[int, set[bytes]] = {}
        for row, item, shared in index.search(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
            if 100 * shared >= percent * len(index.sets[item]):
                if row not in kept:
                    kept[row] = exact_shingles(raw[offsets[i + row] : offsets[i + row + 1]].tobytes(), index.k)
                wanted = exact_shingles(index.texts[item], index.k)
                shared = len(wanted & kept[row])
                if 100 * shared >= percent * len(wanted):
                    yield i + row, item, shared


def item_blocks(benchmark: DataFrame, k: int, text: str, key: str, per_block: int) -> Iterator[ItemIndex]:
    rows = benchmark.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null and text is not null")
    blocks = max(1, -(-rows.count() // per_block))
    for b in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
        yield ItemIndex.of(part["id"].to_pylist(), [t.encode() for t in part["text"].to_pylist()], k)


def find_contained(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", item_key: str = "item_id", per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """One row for each document and item it contains: doc_id, item_id, n_shingles (of the item), n_shared.

    An item is contained when 100 * shared >= percent * its distinct k-word
    shingles (words lower-cased in A-Z); with fewer than k words its one shingle
    is the whole sequence, which only an equal sequence has.  Null and empty
    texts contain nothing and are contained in nothing.  Repeated rows give
    repeated results.  Rows with a null key are reported with it; items without
    one are left out.  Other columns play no part.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for index in item_blocks(benchmark, k, text, item_key, per_block):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in batches:
                found = list(_matches(batch.column(1), index, percent))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([r for r, _, _ in found], pa.int64())),
                        pa.array([index.ids[i] for _, i, _ in found], pa.int64()),
                        pa.array([len(index.sets[i]) for _, i, _ in found], pa.int64()),
                        pa.array([n for _, _, n in found], pa.int64()),
                    ],
                    ["doc_id", "item_id", "n_shingles", "n_shared"],
                )

        part = rows.mapInArrow(X.lean(run), "doc_id long, item_id long, n_shingles long, n_shared long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, text: str = "text", item_key: str = "item_id", per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """docs without the rows that contain an item (see find_contained); all columns as they are, nothing shuffled."""
    at = docs.columns.index(text)
    for index in item_blocks(benchmark, k, text, item_key, per_block):
        held = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[r for r, _, _ in _matches(batch.column(at), held.value, percent)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(X.lean(run), docs.schema)
    return docs
