"""Audit: rows and keys against their rules, and the catalog against the store in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions import text as T

FINDING = ["category", "sort_identity", "identity", "details"]


def finding(df: DataFrame, category: str | Column, identity: Column, details: Column, raw: Column | None = None) -> DataFrame:
    """raw: the bytes that findings are told apart and ordered by, where identity is only how they are shown."""
    name = F.lit(category) if isinstance(category, str) else category
    return df.select(name.alias("category"), (identity.cast("string").cast("binary") if raw is None else raw).alias("sort_identity"), identity.cast("string").alias("identity"), details.alias("details"))


def _reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that fail, comma-joined in order; '' if none does."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), name) for name, bad in rules])), ",")


def _is(kind: str, c: str) -> Column:
    return F.col(f"{c}_class") == kind


def checked_blobs(raw: DataFrame) -> DataFrame:
    """Untyped blob rows (each column as text with its storage class) with the reasons they are invalid."""
    size = F.expr("try_cast(size_bytes as bigint)")
    return raw.withColumn(
        "reasons",
        _reasons(
            ("invalid-hash", ~(_is("text", "hash") & T.valid_hash(F.col("hash")))),
            ("invalid-size", ~(_is("integer", "size_bytes") & F.coalesce(size >= 0, F.lit(False)))),
            ("invalid-created-at", ~_is("integer", "created_at_ms")),
            ("invalid-deleted-at", ~F.col("deleted_at_ms_class").isin("null", "integer")),
            ("invalid-reachability", ~F.coalesce(F.col("referenced").isin("0", "1"), F.lit(False))),
        ),
    )


def valid_blobs(checked: DataFrame) -> DataFrame:
    return checked.where("reasons = ''").select("hash", F.col("size_bytes").cast("long").alias("size_bytes"), F.col("deleted_at_ms").cast("long").alias("deleted_at_ms"), (F.col("referenced") == "1").alias("referenced"))


def blob_row_findings(checked: DataFrame) -> DataFrame:
    return finding(checked.where("reasons <> ''"), "INVALID_BLOB_ROW", F.col("rowid"), F.concat(F.lit("reason="), F.col("reasons")))


def source_row_findings(raw: DataFrame, blobs: DataFrame) -> DataFrame:
    """Untyped source rows against their rules and the valid blobs."""
    b = blobs.select(F.col("hash").alias("_hash"), F.col("size_bytes").alias("_size"))
    joined = raw.join(b, F.col("blob_hash") == F.col("_hash"), "left")
    size, first, last, seen = (F.expr(f"try_cast({c} as bigint)") for c in ("size_bytes", "first_seen_at_ms", "last_seen_at_ms", "seen_count"))
    good_hash = _is("text", "blob_hash") & T.valid_hash(F.col("blob_hash"))
    good_size = _is("integer", "size_bytes") & F.coalesce(size >= 0, F.lit(False))
    times = _is("integer", "first_seen_at_ms") & _is("integer", "last_seen_at_ms")
    reasons = _reasons(
        ("invalid-source-root", ~(_is("text", "source_root") & F.coalesce(F.col("source_root") != "", F.lit(False)))),
        ("invalid-relative-path", ~(_is("text", "relative_path") & T.valid_catalog_path(F.col("relative_path")))),
        ("invalid-blob-hash", ~good_hash),
        ("invalid-size", ~good_size),
        ("invalid-modified-at", ~F.col("modified_at_ms_class").isin("null", "integer")),
        ("invalid-first-seen", ~_is("integer", "first_seen_at_ms")),
        ("invalid-last-seen", ~_is("integer", "last_seen_at_ms")),
        ("reversed-seen-times", times & (first > last)),
        ("invalid-seen-count", ~(_is("integer", "seen_count") & F.coalesce(seen > 0, F.lit(False)))),
        ("blob-size-disagreement", good_hash & good_size & (F.col("_size") != size)),
        ("missing-valid-blob", good_hash & good_size & F.col("_hash").isNull()),
    )
    bad = joined.withColumn("reasons", reasons).where("reasons <> ''")
    return finding(bad, "INVALID_SOURCE_ROW", F.col("rowid"), F.concat(F.lit("reason="), F.col("reasons")))


def fk_findings(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, child_table: str, parent_table: str, rowid: Column, fk: int = 0) -> DataFrame:
    """Rows whose key no parent has; null keys refer to nothing."""
    p = parent.select(F.col(parent_key).alias("_parent")).distinct()
    lost = child.where(F.col(child_key).isNotNull()).join(p, F.col(child_key) == F.col("_parent"), "left_anti")
    return finding(lost, "CATALOG_INTEGRITY", F.concat(F.lit(f"{child_table}:"), F.coalesce(rowid.cast("string"), F.lit("null"))), F.lit(f"reason=foreign-key parent={parent_table} fk={fk}"))


def integrity_findings(messages: DataFrame) -> DataFrame:
    """Each message of an integrity check but 'ok'."""
    return finding(messages.where("message <> 'ok'"), "CATALOG_INTEGRITY", F.lit("integrity_check"), F.concat(F.lit("reason=integrity-check detail="), T.bounded(F.col("message"))))


def _path_bytes(listing: DataFrame) -> Column:
    return F.col("rel_path_bytes") if "rel_path_bytes" in listing.columns else F.col("rel_path").cast("binary")


def classified_entries(listing: DataFrame) -> DataFrame:
    """The store's entries with what they are; listing: rel_path, kind, ancestors_valid, size_bytes, io_error, and rel_path_bytes where names need not be UTF-8."""
    parts = F.split(T.byte_text(_path_bytes(listing)), "/")
    return listing.withColumn("class", F.when(F.col("io_error").isNull(), T.cas_class(parts, F.col("kind"), F.col("ancestors_valid"))))


def entry_findings(entries: DataFrame) -> DataFrame:
    raw = F.concat(F.lit(b"blobs/"), _path_bytes(entries))
    path = T.escape_bytes(raw)
    bad = entries.where("class not in ('valid-directory', 'valid-blob')")
    broken = entries.where("io_error is not null")
    return finding(bad, "INVALID_CAS_ENTRY", path, F.concat(F.lit("reason="), F.col("class")), raw).unionByName(finding(broken, "CAS_IO_ERROR", path, F.concat(F.lit("reason="), F.col("io_error")), raw))


def reconciled(blobs: DataFrame, store: DataFrame) -> DataFrame:
    """Catalog and store by hash: 'missing', 'orphan' or 'both'.  store: hash, size_bytes, actual_hash, actual_size, kind."""
    b = blobs.select("hash", F.col("size_bytes").alias("catalog_size"))
    s = store.select("hash", F.col("size_bytes").alias("metadata_size"), "actual_hash", "actual_size", "kind")
    side = F.when(F.col("kind").isNull(), "missing").when(F.col("catalog_size").isNull(), "orphan").otherwise("both")
    return b.join(s, "hash", "full_outer").withColumn("side", side)


def reconciliation_findings(joined: DataFrame) -> DataFrame:
    path = F.concat(F.lit("path="), T.shard_path(F.col("hash")))
    h = F.col("hash")
    gone, there = joined.where("side = 'missing'"), joined.where("side <> 'missing' and kind = 'file'")
    other = joined.where("side <> 'missing' and kind <> 'file'")
    expected = F.coalesce("catalog_size", "metadata_size")
    sized = there.where((expected != F.col("actual_size")) | (F.col("metadata_size") != F.col("actual_size")))
    sizes = F.concat(F.lit("expected="), expected.cast("string"), F.lit(" metadata="), F.col("metadata_size").cast("string"), F.lit(" actual="), F.col("actual_size").cast("string"))
    hashed = there.where("actual_hash <> hash")
    return (
        finding(gone, "MISSING_BLOB", h, path)
        .unionByName(finding(other, "NON_REGULAR_BLOB", h, path))
        .unionByName(finding(joined.where("side = 'orphan'"), "ORPHAN_BLOB", h, path))
        .unionByName(finding(sized, "SIZE_MISMATCH", h, sizes))
        .unionByName(finding(hashed, "HASH_MISMATCH", h, F.concat(F.lit("expected="), h, F.lit(" actual="), F.col("actual_hash"))))
    )


def deduplicated(findings: DataFrame) -> DataFrame:
    """One finding for each category and identity bytes, the least by identity and details; ordered."""
    one = findings.groupBy("category", "sort_identity").agg(F.min(F.struct("identity", "details")).alias("x"))
    return one.select("category", "sort_identity", "x.identity", "x.details").orderBy("category", "sort_identity", "identity", "details")


def audit_report(raw_blobs: DataFrame, store: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: blob rows seen, collection candidates (any integer mark), store files, files hashed, findings."""
    rows = raw_blobs.agg(F.count("*").alias("blob_rows_seen"), F.count_if(_is("integer", "deleted_at_ms")).alias("gc_candidates"))
    files = store.agg(F.count("*").alias("cas_blob_files"), F.count_if(F.col("kind") == "file").alias("blobs_hashed"))
    return rows.crossJoin(files).crossJoin(findings.agg(F.count("*").alias("findings")))  # one row each


def schema_findings(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Objects (object, definition) that only one side has."""
    joined = expected.withColumn("_e", F.lit(True)).join(actual.withColumn("_a", F.lit(True)), ["object", "definition"], "full_outer")
    return finding(joined.where("_e is null or _a is null"), "CATALOG_INTEGRITY", F.col("object"), F.concat(F.lit("reason=schema-mismatch definition="), F.col("definition")))
