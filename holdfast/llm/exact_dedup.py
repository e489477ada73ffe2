"""Exact dedup by content-defined chunk recipes.

A text is cut into chunks where a rolling hash of its bytes says so, so that
equal stretches are cut alike.  Its recipe is the ordered list of its chunks'
digests.  Only documents whose recipe occurs again take part in verification:
a filter of fixed size names their recipes to the scan, which gives their chunks
on.  These are deduplicated by digest and content, and a digest that stands for
several contents is split into numbered variants.  Documents are equal when their
ordered lists of verified identifiers are.  No text moves but as distinct chunks of
documents whose recipe repeats; recipes move in their stead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm import _text as X
from holdfast.llm._stage import Stages
from holdfast.llm.suffix_dedup import FILTER_BITS, anchor_filter

#: One cut in so many bytes on average, and the fewest and most bytes of a chunk.
MEAN_CHUNK, MIN_CHUNK, MAX_CHUNK = 1024, 256, 16384
_GEAR = np.random.Generator(np.random.PCG64(77)).integers(0, 1 << 63, 256, dtype=np.uint64)


def chunk_ends(low: np.ndarray) -> list[int]:
    """Ends of the chunks of a text's bytes; none for an empty text."""
    n = len(low)
    if n <= MIN_CHUNK:
        return [n] if n else []
    gear = _GEAR[low]
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(16):  # the last 16 bytes decide about a cut
        rolled[j:] += gear[: n - j] << np.uint64(j)
    wanted = np.flatnonzero((rolled >> np.uint64(8)) % np.uint64(MEAN_CHUNK) == 0) + 1
    ends, last = [], 0
    for at in wanted.tolist():
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if at - last >= MIN_CHUNK:
            last = at
            ends.append(last)
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def _digest(chunk: bytes, bits: int) -> bytes:
    return (int.from_bytes(hashlib.blake2b(chunk, digest_size=16).digest(), "big") >> (128 - bits)).to_bytes(16, "big")


def _recipes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = X.utf8(batch.column(1))
            shas, sizes, recipes = [], [], []
            for i in range(batch.num_rows):
                low = X.LOWER[raw[offsets[i] : offsets[i + 1]]]
                data = low.tobytes()
                shas.append(hashlib.sha256(data).hexdigest())
                sizes.append(len(data))
                at, parts = 0, []
                for end in chunk_ends(low):
                    parts.append(_digest(data[at:end], bits))
                    at = end
                recipes.append(b"".join(parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(recipes, pa.binary()), pa.array(shas, pa.string())], ["doc_id", "row", "n_bytes", "recipe", "text_sha256"])

    return run


def _pieces(data: bytes, low: np.ndarray, bits: int) -> list[tuple[bytes, bytes]]:
    """The chunks of a text with their digests, in order."""
    ends = chunk_ends(low)
    return [(_digest(data[a:b], bits), data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]


def _repeats(pieces: list[tuple[bytes, bytes]], held: np.ndarray) -> bool:
    """Whether the filter lets the recipe through.  The hash is the one of F.xxhash64."""
    slot = xxhash.xxh64_intdigest(b"".join([d for d, _ in pieces]), seed=42) & (FILTER_BITS - 1)
    return bool(held[slot >> 3] >> (slot & 7) & 1)


def _chunks(bits: int, again):
    """Distinct chunks of the texts whose recipe repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(again.value, np.uint8)
        for batch in batches:
            raw, offsets = X.utf8(batch.column(0))
            seen: set[tuple[bytes, bytes]] = set()
            for i in range(batch.num_rows):
                low = X.LOWER[raw[offsets[i] : offsets[i + 1]]]
                pieces = _pieces(low.tobytes(), low, bits)
                if _repeats(pieces, held):
                    seen.update(pieces)
            rows = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["digest", "chunk"])

    return run


def _placed(bits: int, again):
    """Every chunk of the texts whose recipe repeats, with its place; texts are named by key and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(again.value, np.uint8)
        for batch in batches:
            raw, offsets = X.utf8(batch.column(1))
            rows = []
            for i, doc in enumerate(batch.column(0).to_pylist()):
                low = X.LOWER[raw[offsets[i] : offsets[i + 1]]]
                data = low.tobytes()
                pieces = _pieces(data, low, bits)
                if _repeats(pieces, held):
                    sha = hashlib.sha256(data).hexdigest()
                    rows += [(doc, sha, place, digest, chunk) for place, (digest, chunk) in enumerate(pieces)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text_sha256", "place", "digest", "chunk"])

    return run


def exact_dedup(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", digest_bits: int = 128, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_bytes, n_chunks.

    Texts are equal when identical after lower-casing A-Z; of equal texts the
    largest key stays.  Null text counts as empty, and empty texts are equal to
    each other.  A null key never stays before another; in a group of null keys
    only, keep_id is null and nothing is kept.  Repeated rows with one key and
    one text are all kept or all dropped and each counts in group_size.  Other
    columns of docs play no part.  No rows give no rows.

    `row` names a column of numbers that tell rows apart: with it there are two
    more columns, row and stays, and of each group exactly one row stays, the
    largest by key (null the least) and then by row.
    """
    stages = Stages(spark, "exact-dedup")
    number = (F.lit(0) if row is None else F.col(row)).cast("long").alias("row")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), number)
    recipes = stages.keep(rows.mapInArrow(X.lean(_recipes(digest_bits)), "doc_id long, row long, n_bytes long, recipe binary, text_sha256 string"))
    largest, size = F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size")
    again = stages.keep(recipes.groupBy("recipe").agg(largest, size).where("group_size > 1"))
    held = spark.sparkContext.broadcast(anchor_filter(again.select(F.xxhash64("recipe").alias("anchor"))))
    # Distinct (digest, content) of the documents concerned: partial aggregation keeps one of each copy per task.
    verified = rows.select("text").mapInArrow(X.lean(_chunks(digest_bits, held)), "digest binary, chunk binary").distinct()
    clashing = stages.keep(verified.groupBy("digest").agg(F.count("*").alias("contents")).where("contents > 1"))
    if clashing.isEmpty():
        # Every digest stands for one content: the recipes are the ordered lists of verified identifiers.
        grouped = recipes.join(again, "recipe", "left")
    else:
        numbered = verified.join(clashing.select("digest"), "digest").withColumn("variant", F.dense_rank().over(Window.partitionBy("digest").orderBy("chunk")))
        placed = rows.select("doc_id", "text").mapInArrow(_placed(digest_bits, held), "doc_id long, text_sha256 string, place int, digest binary, chunk binary")
        marks = placed.join(numbered, ["digest", "chunk"]).groupBy("doc_id", "text_sha256").agg(F.array_join(F.array_sort(F.collect_set(F.struct("place", "variant").cast("string"))), ";").alias("variants"))
        named = marks.select(F.col("doc_id").alias("d"), F.col("text_sha256").alias("s"), "variants")
        lists = stages.keep(recipes.join(named, recipes.doc_id.eqNullSafe(named.d) & (recipes.text_sha256 == named.s), "left").drop("d", "s").na.fill("", ["variants"]))
        both = lists.groupBy("recipe", "variants").agg(largest, size)
        grouped = lists.join(both, ["recipe", "variants"])
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id"))
    columns = [
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"),
        "text_sha256",
        "n_bytes",
        (F.length("recipe") / 16).cast("long").alias("n_chunks"),
    ]
    return grouped.select(*columns, *([] if row is None else ["row", (alone | (F.col("row") == F.col("keep.row"))).alias("stays")]))
