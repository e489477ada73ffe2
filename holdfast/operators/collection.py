"""Collection of unreachable content: a mark, resurrect and sweep plan from run-start state, and the catalog after it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions import text as T
from holdfast.operators.audit import finding


def reachability(blobs: DataFrame, references: DataFrame) -> DataFrame:
    """blobs with referenced: whether any reference holds their hash.  references: blob_hash, repeats allowed."""
    held = references.select(F.col("blob_hash").alias("hash")).where("hash is not null").distinct().withColumn("_r", F.lit(True))
    return blobs.join(held, "hash", "left").withColumn("referenced", F.col("_r").isNotNull()).drop("_r")


def classified(reachable: DataFrame) -> DataFrame:
    marked = F.col("deleted_at_ms").isNotNull()
    kind = F.when(F.col("referenced"), F.when(marked, "resurrect").otherwise("unchanged")).otherwise(F.when(marked, "sweep").otherwise("mark"))
    return reachable.withColumn("kind", kind)


def plan(classes: DataFrame, store: DataFrame) -> DataFrame:
    """The actions: kind, hash, size_bytes, sweep_source_state; ordered by kind (mark, resurrect, sweep), then hash."""
    there = store.select("hash", F.lit(True).alias("_there"))
    joined = classes.where("kind <> 'unchanged'").join(there, "hash", "left")
    state = F.when(F.col("kind") == "sweep", F.when(F.col("_there"), "present").otherwise("already-absent"))
    rank = F.when(F.col("kind") == "mark", 0).when(F.col("kind") == "resurrect", 1).otherwise(2)
    return joined.select(rank.alias("kind_rank"), "kind", "hash", "size_bytes", state.alias("sweep_source_state")).orderBy("kind_rank", "hash")


def next_blobs(classes: DataFrame, now_ms: int, swept: DataFrame | None = None) -> DataFrame:
    """The catalog after the plan: one time for all new marks, marks of resurrected ones cleared, swept rows gone.

    swept: the hashes whose files did go, if not all; the others keep their rows and marks.
    """
    rows = classes
    if swept is None:
        rows = rows.where("kind <> 'sweep'")
    else:
        rows = rows.join(swept.select("hash").distinct().withColumn("_gone", F.lit(True)), "hash", "left").where("_gone is null")
    mark = F.when(F.col("kind") == "mark", F.lit(now_ms).cast("long")).when(F.col("kind") == "resurrect", F.lit(None).cast("long")).otherwise(F.col("deleted_at_ms"))
    return rows.select("hash", "size_bytes", "created_at_ms", mark.alias("deleted_at_ms"))


def missing_findings(classes: DataFrame, listing: DataFrame, complete: bool = True) -> DataFrame:
    """Catalog blobs that are not in the store as files; an absent one is accepted if marked and unreferenced.

    listing: hash, kind, io_error.  Only a complete walk of the store can show absence.
    """
    listed = listing.select("hash", F.col("kind").alias("entry_kind"), "io_error")
    joined = classes.join(listed, "hash", "left")
    path = F.concat(F.lit("path="), T.shard_path(F.col("hash")))
    broken, other = joined.where("io_error is not null"), joined.where("io_error is null and entry_kind <> 'file'")
    absent = joined.where("entry_kind is null and io_error is null and not (deleted_at_ms is not null and not referenced)")
    out = finding(broken, "BLOB_IO_ERROR", F.col("hash"), F.concat(path, F.lit(" reason="), F.col("io_error"))).unionByName(finding(other, "NON_REGULAR_BLOB", F.col("hash"), path))
    return out.unionByName(finding(absent, "MISSING_BLOB", F.col("hash"), path)) if complete else out


def orphan_findings(store: DataFrame, blobs: DataFrame, complete: bool = True) -> DataFrame:
    lost = store.join(blobs.select("hash").distinct(), "hash", "left_anti")
    return finding(lost if complete else lost.where("false"), "ORPHAN_BLOB", F.col("hash"), F.concat(F.lit("path="), T.shard_path(F.col("hash"))))


def verify_findings(classes: DataFrame, store: DataFrame) -> DataFrame:
    """Sizes of all blobs that are there, and the content of sweep candidates only."""
    s = store.select("hash", F.col("size_bytes").alias("metadata_size"), "actual_hash", "actual_size")
    joined = classes.join(s, "hash")
    sized = joined.where("metadata_size <> size_bytes")
    sweeps = joined.where("kind = 'sweep'")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    short = text("expected=", F.col("size_bytes"), " metadata=", F.col("metadata_size"))
    long = text("expected=", F.col("size_bytes"), " metadata=", F.col("metadata_size"), " actual=", F.col("actual_size"))
    return (
        finding(sized, "SIZE_MISMATCH", F.col("hash"), short)
        .unionByName(finding(sweeps.where("actual_size <> size_bytes or metadata_size <> actual_size"), "SIZE_MISMATCH", F.col("hash"), long))
        .unionByName(finding(sweeps.where("actual_hash <> hash"), "HASH_MISMATCH", F.col("hash"), text("expected=", F.col("hash"), " actual=", F.col("actual_hash"))))
    )


def report(classes: DataFrame, actions: DataFrame) -> DataFrame:
    """One row: catalog rows, reachable ones, actions by kind, bytes to reclaim (present sweeps only), candidates hashed."""
    seen = classes.agg(F.count("*").alias("catalog_blobs"), F.count_if("referenced").alias("reachable_blobs"))
    present = F.col("sweep_source_state") == "present"
    planned = actions.agg(
        *[F.count_if(F.col("kind") == k).alias(f"planned_{k}s") for k in ("mark", "resurrect", "sweep")],
        F.coalesce(F.sum(F.when(present, F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes_reclaimable"),
        F.count_if(present).alias("candidates_hashed"),
    )
    return seen.crossJoin(planned)  # one row each


def progress(done: DataFrame) -> DataFrame:
    """Totals of completed actions; sums that leave 64 bits are an error."""
    present = (F.col("kind") == "sweep") & (F.col("sweep_source_state") == "present")
    return done.agg(
        *[F.count_if(F.col("kind") == k).alias(f"completed_{k}s") for k in ("mark", "resurrect", "sweep")],
        F.count_if(present).alias("files_removed"),
        F.coalesce(F.sum(F.when(present, F.col("size_bytes"))), F.lit(0)).cast("long").alias("bytes_reclaimed"),
    )
