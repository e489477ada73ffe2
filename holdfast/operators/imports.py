"""Import: which files are new, changed or safely skippable, and what the catalog becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["source_root", "relative_path"]


def digests(listing: DataFrame, content: str = "content") -> DataFrame:
    """Adds hash and size_bytes of the content; SHA-256, the built-in digest of 64 hex digits."""
    return listing.withColumns({"hash": F.sha2(F.col(content).cast("binary"), 256), "size_bytes": F.octet_length(content).cast("long")})


def known_files(source_files: DataFrame, blobs: DataFrame) -> DataFrame:
    """source_files with the size and mark of their blobs."""
    b = blobs.select(F.col("hash").alias("blob_hash"), F.col("size_bytes").alias("blob_size_bytes"), F.col("deleted_at_ms").alias("blob_deleted_at_ms"))
    return source_files.select(*KEY, "blob_hash", F.col("size_bytes").alias("source_size_bytes"), F.col("modified_at_ms").alias("known_modified_at_ms")).join(b, "blob_hash")


def with_known(candidates: DataFrame, known: DataFrame) -> DataFrame:
    return candidates.join(known, KEY, "left")


def disposition(metadata_skip: bool = True) -> Column:
    """The reason to hash a candidate, or 'skip'; over with_known() and the store's sizes as cas_size_bytes (null: missing)."""
    mtimes = F.col("known_modified_at_ms").isNull() | F.col("modified_at_ms").isNull()
    return (
        F.when(F.lit(not metadata_skip), "metadata-skipping-disabled")
        .when(F.col("blob_hash").isNull(), "no-catalog-observation")
        .when(F.col("source_size_bytes") != F.col("size_bytes"), "size-changed")
        .when(mtimes, "modified-time-unavailable")
        .when(F.col("known_modified_at_ms") != F.col("modified_at_ms"), "modified-time-changed")
        .when(F.col("blob_size_bytes") != F.col("source_size_bytes"), "catalog-source-inconsistency")
        .when(F.col("cas_kind").isNull(), "cas-blob-missing")
        .when((F.col("cas_kind") != "file") | (F.col("cas_size_bytes") != F.col("source_size_bytes")), "cas-blob-invalid")
        .otherwise("skip")
    )


def classify_import(candidates: DataFrame, known: DataFrame, cas: DataFrame, metadata_skip: bool = True) -> DataFrame:
    """Each candidate with its disposition and whether skipping it clears a mark.  cas: hash, kind, size_bytes."""
    listed = cas.select(F.col("hash").alias("blob_hash"), F.col("kind").alias("cas_kind"), F.col("size_bytes").alias("cas_size_bytes"))
    joined = with_known(candidates, known).join(listed, "blob_hash", "left").withColumn("disposition", disposition(metadata_skip))
    return joined.withColumn("resurrects", (F.col("disposition") == "skip") & F.col("blob_deleted_at_ms").isNotNull())


def first_occurrences(hashed: DataFrame, cas: DataFrame) -> DataFrame:
    """Outcome 'created' for the first file of a content that the store has not, 'reused' for the others.

    A content in the store with another size is an error.
    """
    listed = cas.select("hash", F.col("size_bytes").alias("cas_size_bytes"))
    least = hashed.groupBy("hash").agg(F.min("sequence").alias("first_sequence"))
    joined = hashed.join(listed, "hash", "left").join(least, "hash")
    wrong = F.col("cas_size_bytes").isNotNull() & (F.col("cas_size_bytes") != F.col("size_bytes"))
    created = F.col("cas_size_bytes").isNull() & (F.col("sequence") == F.col("first_sequence"))
    outcome = F.when(wrong, F.raise_error(F.concat(F.lit("store has another size for "), F.col("hash")))).when(created, "created").otherwise("reused")
    return joined.withColumn("outcome", outcome)


def import_report(classified: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row of totals.  outcomes: the hashed files with outcome and source_outcome (inserted, updated)."""
    total = lambda cond, what: F.coalesce(F.sum(F.when(cond, F.col(what))), F.lit(0)).cast("long")
    skipped = F.col("disposition") == "skip"
    seen = classified.agg(
        F.count("*").alias("files_seen"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes_seen"),
        F.count_if(skipped).alias("files_skipped"),
        total(skipped, "size_bytes").alias("bytes_skipped"),
    )
    created = F.col("outcome") == "created"
    done = outcomes.agg(
        F.count("*").alias("files_hashed"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes_hashed"),
        F.count_if(created).alias("blobs_created"),
        F.count_if(~created).alias("blobs_reused_hashing"),
        total(created, "size_bytes").alias("bytes_written"),
        F.count_if(F.col("source_outcome") == "inserted").alias("source_records_inserted"),
        F.count_if(F.col("source_outcome") == "updated").alias("source_records_updated_hashing"),
    )
    both = seen.crossJoin(done)  # one row each
    return both.select(
        "files_seen", "bytes_seen", "blobs_created",
        (F.col("blobs_reused_hashing") + F.col("files_skipped")).alias("blobs_reused"),
        "bytes_written", "source_records_inserted",
        (F.col("source_records_updated_hashing") + F.col("files_skipped")).alias("source_records_updated"),
        "files_skipped", "bytes_skipped", "files_hashed", "bytes_hashed",
    )


def source_outcome(observed: DataFrame, source_files: DataFrame) -> DataFrame:
    """'inserted' or 'updated' for each observed key."""
    known = source_files.select(*KEY, F.lit(True).alias("_known")).distinct()
    return observed.join(known, KEY, "left").withColumn("source_outcome", F.when(F.col("_known"), "updated").otherwise("inserted")).drop("_known")


def collapsed(observations: DataFrame) -> DataFrame:
    """One row for each key of a batch: its last observation by sequence, its first time, and their number.

    Grouped aggregates only, so that a key of very many observations is combined before it moves.
    """
    last = F.struct("sequence", "kind", "blob_hash", "size_bytes", "modified_at_ms", "observed_at_ms")
    return observations.groupBy(*KEY).agg(F.max(last).alias("last"), F.min(F.struct("sequence", "observed_at_ms")).alias("first"), F.count("*").alias("n")).select(
        *KEY, F.col("first.sequence").alias("sequence"), "last.kind", "last.blob_hash", "last.size_bytes", "last.modified_at_ms", F.col("last.observed_at_ms").alias("last_seen_at_ms"), F.col("first.observed_at_ms").alias("first_seen_at_ms"), "n"
    )


def upsert_sources(source_files: DataFrame, observations: DataFrame) -> DataFrame:
    """The next source_files: new keys are inserted, known ones replaced but for id and first time, counts added.

    last_seen_at_ms is that of the last observation written, even if an earlier one is later.  New ids follow the
    largest id in the order of writing: by the first sequence of a key, and of one sequence by key.
    """
    new = collapsed(observations)
    old = source_files.alias("o")
    joined = old.join(new.alias("n"), KEY, "full_outer")
    top = source_files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    here = F.col("n.n").isNotNull()
    merged = joined.select(
        F.col("o.id").alias("id"), *KEY, F.col("n.sequence").alias("sequence"),
        F.when(here, F.col("n.blob_hash")).otherwise(F.col("o.blob_hash")).alias("blob_hash"),
        F.when(here, F.col("n.size_bytes")).otherwise(F.col("o.size_bytes")).alias("size_bytes"),
        F.when(here, F.col("n.modified_at_ms")).otherwise(F.col("o.modified_at_ms")).alias("modified_at_ms"),
        F.coalesce("o.first_seen_at_ms", "n.first_seen_at_ms").alias("first_seen_at_ms"),
        F.coalesce("n.last_seen_at_ms", "o.last_seen_at_ms").alias("last_seen_at_ms"),
        (F.coalesce("o.seen_count", F.lit(0)) + F.coalesce("n.n", F.lit(0))).cast("long").alias("seen_count"),
    )
    return numbered(merged, top)


def numbered(rows: DataFrame, top: DataFrame) -> DataFrame:
    """Gives rows without id the next ids in the order of sequence, and of one sequence by key; the column sequence goes.

    Rows are counted by 4096 ranges of sequence first, so that the numbering is a window within each range and a
    running sum over the ranges' counts.
    """
    fresh = rows.where("id is null")
    ends = fresh.agg(F.min("sequence").alias("low"), F.max("sequence").alias("high"))
    slot = F.floor((F.col("sequence") - F.col("low")) * 4096.0 / (F.col("high") - F.col("low") + 1)).cast("long")
    fresh = fresh.crossJoin(F.broadcast(ends)).withColumn("slot", slot).drop("low", "high")
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = fresh.groupBy("slot").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("slot", "before")
    within = F.row_number().over(Window.partitionBy("slot").orderBy("sequence", *KEY))
    given = fresh.withColumn("within", within).join(offsets, "slot").crossJoin(F.broadcast(top)).withColumn("id", F.col("top") + F.col("before") + F.col("within"))
    return rows.where("id is not null").unionByName(given.select(*rows.columns)).drop("sequence")


def insert_blobs(blobs: DataFrame, records: DataFrame) -> DataFrame:
    """The next blobs: new contents with the first time they were recorded; the mark of every imported one cleared.

    A record of another size than the catalog's is an error.  records: hash, size_bytes, created_at_ms.
    """
    new = records.groupBy("hash").agg(F.min("created_at_ms").alias("n_created"), F.min("size_bytes").alias("n_size"), F.max("size_bytes").alias("n_most"))
    joined = blobs.join(new, "hash", "full_outer")
    clash = F.col("n_size").isNotNull() & ((F.col("n_size") != F.col("n_most")) | (F.col("size_bytes").isNotNull() & (F.col("size_bytes") != F.col("n_size"))))
    size = F.when(clash, F.raise_error(F.concat(F.lit("size disagreement for "), F.col("hash"))).cast("long")).otherwise(F.coalesce("size_bytes", "n_size"))
    return joined.select(
        "hash", size.alias("size_bytes"), F.coalesce("created_at_ms", "n_created").alias("created_at_ms"),
        F.when(F.col("n_size").isNull(), F.col("deleted_at_ms")).alias("deleted_at_ms"),
    )


def resurrect(blobs: DataFrame, touched: DataFrame) -> DataFrame:
    """blobs with the marks of the touched hashes cleared."""
    hit = touched.select("hash").distinct().withColumn("_hit", F.lit(True))
    return blobs.join(hit, "hash", "left").withColumn("deleted_at_ms", F.when(F.col("_hit").isNull(), F.col("deleted_at_ms"))).drop("_hit")


def observe_known(source_files: DataFrame, observations: DataFrame) -> DataFrame:
    """The next source_files after skips: time, mtime and count; a skip of an unknown key or of another hash or size is an error."""
    new = collapsed(observations).select(*KEY, *[F.col(c).alias(f"n_{c}") for c in ("blob_hash", "size_bytes", "modified_at_ms", "last_seen_at_ms", "n")])
    joined = source_files.join(new, KEY, "full_outer")
    lost = F.col("n_n").isNotNull() & (F.col("id").isNull() | (F.col("blob_hash") != F.col("n_blob_hash")) | (F.col("size_bytes") != F.col("n_size_bytes")))
    hit = F.col("n_n").isNotNull()
    return joined.select(
        F.when(lost, F.raise_error(F.concat(F.lit("no such source: "), F.col("relative_path"))).cast("long")).otherwise(F.col("id")).alias("id"), *KEY, "blob_hash", "size_bytes",
        F.when(hit, F.col("n_modified_at_ms")).otherwise(F.col("modified_at_ms")).alias("modified_at_ms"), "first_seen_at_ms",
        F.coalesce("n_last_seen_at_ms", "last_seen_at_ms").alias("last_seen_at_ms"),
        (F.col("seen_count") + F.coalesce("n_n", F.lit(0))).cast("long").alias("seen_count"),
    )


def write_outcomes(records: DataFrame, blobs: DataFrame, source_files: DataFrame) -> DataFrame:
    """For each record of a batch: whether its blob and its source row are new, counting earlier records of the batch.

    The first record of a content and of a key are grouped minima, combined before they move; sequence is unique.
    """
    first_b = records.groupBy("blob_hash").agg(F.min("sequence").alias("first_b")).join(blobs.select(F.col("hash").alias("blob_hash")).distinct(), "blob_hash", "left_anti")
    first_s = records.groupBy(*KEY).agg(F.min("sequence").alias("first_s")).join(source_files.select(*KEY).distinct(), KEY, "left_anti")
    joined = records.join(first_b, "blob_hash", "left").join(first_s, KEY, "left")
    new_b, new_s = (F.coalesce(F.col("sequence") == F.col(c), F.lit(False)) for c in ("first_b", "first_s"))
    return joined.select("sequence", *KEY, "blob_hash", F.when(new_b, "inserted").otherwise("already-present").alias("blob_outcome"), F.when(new_s, "inserted").otherwise("updated").alias("source_outcome"))
