"""Queries over the reference's own operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions import text as T
from holdfast.operators import audit, collection, events, imports, tree
from holdfast.plans.bindings import NOW_MS, Relations, with_relations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f: Callable[[Relations], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Relations(spark, sf_dir))
        if sql is not None:
            SQL[name] = with_relations(sql)
        return f

    return add


# Import


@query("import_report", """
    SELECT count(*) AS files_seen, sum(size_bytes)::BIGINT AS bytes_seen, count(DISTINCT hash) AS blobs_created, count(*) - count(DISTINCT hash) AS blobs_reused,
        (SELECT sum(s) FROM (SELECT min(size_bytes) AS s FROM candidates GROUP BY hash))::BIGINT AS bytes_written, count(*) AS source_records_inserted, 0::BIGINT AS source_records_updated,
        0::BIGINT AS files_skipped, 0::BIGINT AS bytes_skipped, count(*) AS files_hashed, sum(size_bytes)::BIGINT AS bytes_hashed FROM candidates""")
def import_report(r: Relations) -> DataFrame:
    """A first import: no catalog, an empty store."""
    files = r.candidates()
    classified = imports.classify_import(files, r.known().where("false"), r.cas().where("false"))
    outcomes = imports.source_outcome(imports.first_occurrences(files, r.cas().where("false")), r.source_files().where("false"))
    return imports.import_report(classified, outcomes)


@query("import_report_again", """
    SELECT count(*) AS files_seen, sum(size_bytes)::BIGINT AS bytes_seen, count(*) FILTER (o = 'created') AS blobs_created, count(*) FILTER (coalesce(o, '') <> 'created') AS blobs_reused, coalesce(sum(size_bytes) FILTER (o = 'created'), 0)::BIGINT AS bytes_written,
        count(*) FILTER (disposition <> 'skip' AND sequence % 10 = 9) AS source_records_inserted, count(*) FILTER (NOT (disposition <> 'skip' AND sequence % 10 = 9)) AS source_records_updated,
        count(*) FILTER (disposition = 'skip') AS files_skipped, coalesce(sum(size_bytes) FILTER (disposition = 'skip'), 0)::BIGINT AS bytes_skipped, count(*) FILTER (disposition <> 'skip') AS files_hashed, coalesce(sum(size_bytes) FILTER (disposition <> 'skip'), 0)::BIGINT AS bytes_hashed
    FROM (SELECT c.*, CASE WHEN disposition <> 'skip' THEN CASE WHEN hash NOT IN (SELECT hash FROM cas) AND row_number() OVER (PARTITION BY hash, disposition <> 'skip' ORDER BY sequence) = 1 THEN 'created' ELSE 'reused' END END AS o FROM classified c)""")
def import_report_again(r: Relations) -> DataFrame:
    """A later import: skips, changes, and contents new to the store."""
    classified = imports.classify_import(r.candidates(), r.known(), r.cas())
    hashed = classified.where("disposition <> 'skip'").select("source_root", "relative_path", "hash", "size_bytes", "sequence")
    return imports.import_report(classified, imports.source_outcome(imports.first_occurrences(hashed, r.cas()), r.source_files()))


@query("import_disposition", "SELECT relative_path, disposition, disposition = 'skip' AND blob_deleted_at_ms IS NOT NULL AS resurrects FROM classified")
def import_disposition(r: Relations) -> DataFrame:
    return imports.classify_import(r.candidates(), r.known(), r.cas()).select("relative_path", "disposition", "resurrects")


@query("import_reason_counts", "SELECT disposition, count(*) AS files, sum(size_bytes)::BIGINT AS bytes FROM classified GROUP BY disposition")
def import_reason_counts(r: Relations) -> DataFrame:
    return imports.classify_import(r.candidates(), r.known(), r.cas()).groupBy("disposition").agg(F.count("*").alias("files"), F.sum("size_bytes").cast("long").alias("bytes"))


@query("import_no_skip", "SELECT 'metadata-skipping-disabled' AS disposition, count(*) AS files FROM candidates")
def import_no_skip(r: Relations) -> DataFrame:
    return imports.classify_import(r.candidates(), r.known(), r.cas(), metadata_skip=False).groupBy("disposition").agg(F.count("*").alias("files"))


@query("dry_run_first_occurrence", """
    SELECT sequence, hash, CASE WHEN hash NOT IN (SELECT hash FROM cas) AND row_number() OVER (PARTITION BY hash ORDER BY sequence) = 1 THEN 'created' ELSE 'reused' END AS outcome FROM candidates""")
def dry_run_first_occurrence(r: Relations) -> DataFrame:
    return imports.first_occurrences(r.candidates(), r.cas()).select("sequence", "hash", "outcome")


_UPSERT = """
    SELECT coalesce(f.id, (SELECT max(id) FROM chat_files) + row_number() OVER (PARTITION BY f.id IS NULL ORDER BY q, source_root, relative_path)) AS id, source_root, relative_path, b AS blob_hash, s AS size_bytes, m AS modified_at_ms, CASE WHEN f.id IS NULL THEN fo ELSE -10 END AS first_seen_at_ms, lo AS last_seen_at_ms, n + CASE WHEN f.id IS NULL THEN 0 ELSE 4 END AS seen_count
    FROM (SELECT source_root, relative_path, arg_max(blob_hash, sequence) AS b, arg_max(size_bytes, sequence) AS s, arg_max_null(modified_at_ms, sequence) AS m, arg_min(observed_at_ms, sequence) AS fo, arg_max(observed_at_ms, sequence) AS lo, count(*) AS n, min(sequence) AS q FROM observed GROUP BY ALL)
    LEFT JOIN chat_files f USING (source_root, relative_path)"""


@query("source_upsert", _UPSERT)
def source_upsert(r: Relations) -> DataFrame:
    return imports.upsert_sources(r.chat_files(), r.observations())


@query("source_upsert_ids", "SELECT count(*) AS rows, count(DISTINCT id) AS ids, min(id) AS least, max(id) - (SELECT max(id) FROM chat_files) AS added FROM (" + _UPSERT + ")")
def source_upsert_ids(r: Relations) -> DataFrame:
    """Known rows keep their ids; new ones follow the largest without a gap."""
    top = r.chat_files().agg(F.max("id").alias("top"))
    return imports.upsert_sources(r.chat_files(), r.observations()).crossJoin(top).groupBy("top").agg(F.count("*").alias("rows"), F.count_distinct("id").alias("ids"), F.min("id").alias("least"), F.max("id").alias("most")).select("rows", "ids", "least", (F.col("most") - F.col("top")).alias("added"))


@query("blob_insert_dedup", """
    SELECT coalesce(b.hash, n.hash) AS hash, coalesce(b.size_bytes, n.s) AS size_bytes, coalesce(b.created_at_ms, n.c) AS created_at_ms, CASE WHEN n.hash IS NULL THEN b.deleted_at_ms END AS deleted_at_ms
    FROM blobs b FULL JOIN (SELECT hash, min(size_bytes) AS s, min(50) AS c FROM (SELECT hash, size_bytes FROM mirrored) GROUP BY hash) n ON b.hash = n.hash""")
def blob_insert_dedup(r: Relations) -> DataFrame:
    return imports.insert_blobs(r.blobs(), r.mirrored().select("hash", "size_bytes", F.lit(50).cast("long").alias("created_at_ms")))


@query("observe_known", """
    SELECT id, source_root, relative_path, blob_hash, size_bytes, modified_at_ms + CASE WHEN hit THEN 1 ELSE 0 END AS modified_at_ms, first_seen_at_ms, CASE WHEN hit THEN 1500 ELSE last_seen_at_ms END AS last_seen_at_ms, seen_count + CASE WHEN hit THEN 2 ELSE 0 END AS seen_count
    FROM (SELECT *, id % 2 = 0 AS hit FROM source_files)""")
def observe_known(r: Relations) -> DataFrame:
    """Every second file is seen unchanged twice; the last time written wins, although it is earlier."""
    seen = r.source_files().where("id % 2 = 0").select("source_root", "relative_path", F.lit("known").alias("kind"), "blob_hash", "size_bytes", (F.col("modified_at_ms") + 1).alias("modified_at_ms"))
    twice = seen.select("*", F.explode(F.array(F.struct(F.lit(1).alias("sequence"), F.lit(9000).cast("long").alias("observed_at_ms")), F.struct(F.lit(2).alias("sequence"), F.lit(1500).cast("long").alias("observed_at_ms")))).alias("x")).select("*", "x.*").drop("x")
    return imports.observe_known(r.source_files(), twice)


@query("import_resurrect", """
    SELECT hash, size_bytes, created_at_ms, CASE WHEN hash IN (SELECT blob_hash FROM classified WHERE disposition = 'skip') THEN NULL ELSE deleted_at_ms END AS deleted_at_ms FROM blobs""")
def import_resurrect(r: Relations) -> DataFrame:
    skipped = imports.classify_import(r.candidates(), r.known(), r.cas()).where("disposition = 'skip'").select(F.col("blob_hash").alias("hash"))
    return imports.resurrect(r.blobs(), skipped)


@query("import_write_outcomes", """
    SELECT sequence, source_root, relative_path, hash AS blob_hash, CASE WHEN hash NOT IN (SELECT hash FROM cas) AND row_number() OVER (PARTITION BY hash ORDER BY sequence) = 1 THEN 'inserted' ELSE 'already-present' END AS blob_outcome,
        CASE WHEN sequence % 10 = 9 THEN 'inserted' ELSE 'updated' END AS source_outcome FROM candidates""")
def import_write_outcomes(r: Relations) -> DataFrame:
    return imports.write_outcomes(r.candidates().withColumnRenamed("hash", "blob_hash"), r.cas(), r.source_files())


# Functions of paths and hashes


@query("hash_validity", "SELECT rowid AS id, coalesce(regexp_full_match(h, '[0-9a-f]{64}'), false) AS valid FROM (SELECT doc_id AS rowid, CASE doc_id % 4 WHEN 0 THEN sha256(text) WHEN 1 THEN upper(sha256(text)) WHEN 2 THEN sha256(text)[1:63] ELSE sha256(text) || chr(10) END AS h FROM documents)")
def hash_validity(r: Relations) -> DataFrame:
    h, m = F.sha2(F.col("text").cast("binary"), 256), F.col("doc_id") % 4
    given = F.when(m == 0, h).when(m == 1, F.upper(h)).when(m == 2, F.substring(h, 1, 63)).otherwise(F.concat(h, F.lit("\n")))
    return r.table("documents").select(F.col("doc_id").alias("id"), T.valid_hash(given).alias("valid"))


_ODD_PATHS = "SELECT page_id, CASE page_id % 8 WHEN 0 THEN substr(url, 9) WHEN 1 THEN url WHEN 2 THEN '/' || substr(url, 9) WHEN 3 THEN 'a/../' || page_id WHEN 4 THEN 'a/./b/' || page_id WHEN 5 THEN 'a' || chr(92) || 'b' WHEN 6 THEN '' ELSE 'x/y z/' || page_id || '.tar.gz' END AS p FROM pages"


def _odd_paths(r: Relations) -> DataFrame:
    m, url = F.col("page_id") % 8, F.col("url")
    p = (
        F.when(m == 0, F.substring(url, 9, 1 << 20)).when(m == 1, url).when(m == 2, F.concat(F.lit("/"), F.substring(url, 9, 1 << 20))).when(m == 3, F.concat(F.lit("a/../"), "page_id"))
        .when(m == 4, F.concat(F.lit("a/./b/"), "page_id")).when(m == 5, F.lit("a\\b")).when(m == 6, F.lit("")).otherwise(F.concat(F.lit("x/y z/"), "page_id", F.lit(".tar.gz")))
    )
    return r.table("pages").select("page_id", p.alias("p"))


@query("catalog_path_validity", f"SELECT page_id, p <> '' AND NOT starts_with(p, '/') AND NOT contains(p, chr(92)) AND len(list_filter(string_split(p, '/'), lambda s: s IN ('', '.', '..'))) = 0 AS valid FROM ({_ODD_PATHS})")
def catalog_path_validity(r: Relations) -> DataFrame:
    return _odd_paths(r).select("page_id", T.valid_catalog_path(F.col("p")).alias("valid"))


@query("path_normalize", f"""SELECT page_id, CASE WHEN NOT starts_with(p, '/') AND NOT list_contains(x, '..') AND len(x) > 0 THEN array_to_string(x, '/') END AS path
    FROM (SELECT page_id, p, list_filter(string_split(p, '/'), lambda s: s NOT IN ('', '.')) AS x FROM ({_ODD_PATHS}))""")
def path_normalize(r: Relations) -> DataFrame:
    return _odd_paths(r).select("page_id", T.normalized_relative(F.col("p")).alias("path"))


@query("shard_path", "SELECT hash, 'blobs/' || hash[1:2] || '/' || hash[3:4] || '/' || hash AS path FROM candidates")
def shard_path(r: Relations) -> DataFrame:
    return r.candidates().select("hash", T.shard_path(F.col("hash")).alias("path"))


@query("hash_suffix_path", """SELECT page_id, CASE WHEN regexp_matches(n, '(?s)^.+\\.[^.]*$') THEN regexp_replace(n, '(?s)^(.+)\\.([^.]*)$', '\\1_' || h || '.\\2') ELSE n || '_' || h END AS name
    FROM (SELECT page_id, sha256(html)[1:6] AS h, CASE page_id % 5 WHEN 0 THEN 'photo.jpg' WHEN 1 THEN 'archive.tar.gz' WHEN 2 THEN 'README' WHEN 3 THEN '.env' ELSE '東京.mov' END AS n FROM pages)""")
def hash_suffix_path(r: Relations) -> DataFrame:
    m = F.col("page_id") % 5
    n = F.when(m == 0, "photo.jpg").when(m == 1, "archive.tar.gz").when(m == 2, "README").when(m == 3, ".env").otherwise("東京.mov")
    return r.table("pages").select("page_id", T.suffixed_name(n, F.substring(F.sha2(F.col("html").cast("binary"), 256), 1, 6)).alias("name"))


@query("finding_escape", "SELECT p_partkey, replace(replace(p_name, ' ', '\\x20'), chr(9), '\\x09') || '\\x0a\\xe2\\x80\\xa8é' AS escaped FROM part")
def finding_escape(r: Relations) -> DataFrame:
    return r.table("part").select("p_partkey", T.escape_identity(F.concat("p_name", F.lit("\n é"))).alias("escaped"))


@query("output_escape", "SELECT p_partkey, p_name || '\\x0a\\x7fé ' AS escaped FROM part")
def output_escape(r: Relations) -> DataFrame:
    return r.table("part").select("p_partkey", T.escape_output(F.concat("p_name", F.lit("\n\x7fé "))).alias("escaped"))


@query("ancestor_dirs", "SELECT DISTINCT d FROM (SELECT lang AS d FROM documents UNION ALL SELECT lang || '/' || source FROM documents)")
def ancestor_dirs(r: Relations) -> DataFrame:
    return r.candidates().select(F.explode(T.ancestors(F.col("relative_path"))).alias("d")).distinct()


@query("lexical_paths", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/a/c' WHEN 1 THEN '/x' WHEN 2 THEN '/' ELSE '/a/b/' || page_id END AS path, CASE page_id % 3 WHEN 0 THEN '../../c/f' WHEN 1 THEN 'f' ELSE '../b/f' END AS target FROM pages")
def lexical_paths(r: Relations) -> DataFrame:
    m, k = F.col("page_id") % 4, F.col("page_id") % 3
    given = F.when(m == 0, "/a/./b/../c").when(m == 1, "/../x/").when(m == 2, "/a/..").otherwise(F.concat(F.lit("/a//b/"), "page_id"))
    parent = F.when(k == 0, "/s/a/b").when(k == 1, "/s/a").otherwise("/s/a")
    file = F.when(k == 0, "/s/c/f").when(k == 1, "/s/a/f").otherwise("/s/b/f")
    return r.table("pages").select("page_id", T.lexical_normalize(given).alias("path"), T.relative_target(parent, file).alias("target"))


# Catalog reads


@query("live_entries", "SELECT relative_path, blob_hash, min(f.size_bytes) AS blob_size_bytes FROM source_files f JOIN blobs b ON b.hash = f.blob_hash WHERE deleted_at_ms IS NULL GROUP BY ALL")
def live_entries(r: Relations) -> DataFrame:
    return tree.live_entries(r.source_files(), r.blobs())


@query("known_lookup", "SELECT c.relative_path, c.sequence, f.blob_hash, f.size_bytes AS source_size_bytes, b.size_bytes AS blob_size_bytes, b.deleted_at_ms AS blob_deleted_at_ms FROM candidates c LEFT JOIN (source_files f JOIN blobs b ON b.hash = f.blob_hash) USING (source_root, relative_path)")
def known_lookup(r: Relations) -> DataFrame:
    return imports.with_known(r.candidates(), imports.known_files(r.source_files(), r.blobs())).select("relative_path", "sequence", "blob_hash", "source_size_bytes", "blob_size_bytes", "blob_deleted_at_ms")


@query("source_outcome", "SELECT relative_path, CASE WHEN sequence % 10 = 9 THEN 'inserted' ELSE 'updated' END AS source_outcome FROM candidates")
def source_outcome(r: Relations) -> DataFrame:
    return imports.source_outcome(r.candidates(), r.source_files()).select("relative_path", "source_outcome")


@query("blob_reachability", "SELECT hash, size_bytes, deleted_at_ms, EXISTS (SELECT 1 FROM refs WHERE blob_hash = hash) AS referenced FROM blobs")
def blob_reachability(r: Relations) -> DataFrame:
    return collection.reachability(r.blobs(), r.references()).select("hash", "size_bytes", "deleted_at_ms", "referenced").orderBy("hash")


# Audit


@query("fk_violations", "SELECT 'CATALOG_INTEGRITY' AS category, 'lineitem:' || o_orderkey AS identity, 'reason=foreign-key parent=orders fk=0' AS details FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def fk_violations(r: Relations) -> DataFrame:
    """Orders as children of line items, which some have none of."""
    return audit.fk_findings(r.table("orders"), r.table("lineitem"), "o_orderkey", "l_orderkey", "lineitem", "orders", F.col("o_orderkey")).drop("sort_identity")


@query("fk_violations_none", "SELECT n AS violations FROM (SELECT count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def fk_violations_none(r: Relations) -> DataFrame:
    return audit.fk_findings(r.table("lineitem"), r.table("orders"), "l_orderkey", "o_orderkey", "lineitem", "orders", F.col("l_orderkey")).agg(F.count("*").alias("violations"))


@query("blob_row_findings", """
    SELECT 'INVALID_BLOB_ROW' AS category, sequence::VARCHAR AS identity, 'reason=' || CASE sequence % 12 WHEN 1 THEN 'invalid-hash' WHEN 2 THEN 'invalid-hash' WHEN 3 THEN 'invalid-size' WHEN 4 THEN 'invalid-size' WHEN 5 THEN 'invalid-created-at' WHEN 6 THEN 'invalid-deleted-at' ELSE 'invalid-reachability' END AS details
    FROM candidates LEFT JOIN labels ON doc_id = sequence WHERE sequence % 12 BETWEEN 1 AND 7 AND NOT (sequence % 12 = 6 AND coalesce(toxic, 0) = 1)""")
def blob_row_findings(r: Relations) -> DataFrame:
    return audit.blob_row_findings(audit.checked_blobs(r.raw_blobs())).drop("sort_identity")


@query("source_row_findings", """
    SELECT 'INVALID_SOURCE_ROW' AS category, sequence::VARCHAR AS identity, 'reason=' || CASE sequence % 14 WHEN 1 THEN 'invalid-source-root' WHEN 2 THEN 'invalid-relative-path' WHEN 3 THEN 'invalid-relative-path' WHEN 4 THEN 'invalid-blob-hash' WHEN 5 THEN 'invalid-size'
        WHEN 6 THEN 'blob-size-disagreement' WHEN 7 THEN 'invalid-modified-at' WHEN 8 THEN 'reversed-seen-times' WHEN 9 THEN 'invalid-first-seen' WHEN 10 THEN 'invalid-last-seen' ELSE 'invalid-seen-count' END AS details
    FROM candidates WHERE sequence % 14 BETWEEN 1 AND 11""")
def source_row_findings(r: Relations) -> DataFrame:
    return audit.source_row_findings(r.raw_sources(), r.candidates().groupBy("hash").agg(F.min("size_bytes").alias("size_bytes"))).drop("sort_identity")


@query("cas_layout_classify", "SELECT page_id, rel_path, class FROM entries")
def cas_layout_classify(r: Relations) -> DataFrame:
    return audit.classified_entries(r.listing()).select("page_id", "rel_path", "class")


@query("cas_entry_findings", "SELECT 'INVALID_CAS_ENTRY' AS category, 'blobs/' || rel_path AS identity, 'reason=' || class AS details FROM entries WHERE class NOT IN ('valid-directory', 'valid-blob') UNION ALL SELECT 'CAS_IO_ERROR', 'blobs/' || rel_path, 'reason=' || io_error FROM entries WHERE io_error IS NOT NULL")
def cas_entry_findings(r: Relations) -> DataFrame:
    return audit.entry_findings(audit.classified_entries(r.listing())).drop("sort_identity")


@query("reconcile_full_outer", "SELECT hash, side, catalog_size, metadata_size FROM reconciled")
def reconcile_full_outer(r: Relations) -> DataFrame:
    return audit.reconciled(r.blobs(), r.verified_store()).select("hash", "side", "catalog_size", "metadata_size")


def _recon(r: Relations) -> DataFrame:
    return audit.reconciliation_findings(audit.reconciled(r.blobs(), r.verified_store())).drop("sort_identity")


@query("orphan_blobs", "SELECT * FROM recon_findings WHERE category = 'ORPHAN_BLOB'")
def orphan_blobs(r: Relations) -> DataFrame:
    return _recon(r).where("category = 'ORPHAN_BLOB'")


@query("missing_blobs", "SELECT * FROM recon_findings WHERE category IN ('MISSING_BLOB', 'NON_REGULAR_BLOB')")
def missing_blobs(r: Relations) -> DataFrame:
    return _recon(r).where("category in ('MISSING_BLOB', 'NON_REGULAR_BLOB')")


@query("size_hash_mismatch", "SELECT * FROM recon_findings WHERE category IN ('SIZE_MISMATCH', 'HASH_MISMATCH')")
def size_hash_mismatch(r: Relations) -> DataFrame:
    return _recon(r).where("category in ('SIZE_MISMATCH', 'HASH_MISMATCH')")


@query("findings_union_dedup", "SELECT category, identity, min(details) AS details FROM (SELECT * FROM recon_findings UNION ALL SELECT category, identity, details || '!' FROM recon_findings) GROUP BY ALL")
def findings_union_dedup(r: Relations) -> DataFrame:
    found = audit.reconciliation_findings(audit.reconciled(r.blobs(), r.verified_store()))
    return audit.deduplicated(found.unionByName(found.withColumn("details", F.concat("details", F.lit("!"))))).drop("sort_identity")


@query("schema_conformance", "SELECT 'CATALOG_INTEGRITY' AS category, object AS identity, 'reason=schema-mismatch definition=' || definition AS details FROM (VALUES ('blobs.size_bytes', 'bigint'), ('blobs.size_bytes', 'string'), ('blobs.extra', 'int')) t(object, definition)")
def schema_conformance(r: Relations) -> DataFrame:
    """The catalog's columns against a table with one of another type and one too many."""
    from holdfast.schemas import BLOBS, columns_of

    actual = r.blobs().select("hash", F.col("size_bytes").cast("string").alias("size_bytes"), "created_at_ms", "deleted_at_ms", F.lit(1).alias("extra"))
    return audit.schema_findings(columns_of(r.spark, "blobs", BLOBS), columns_of(r.spark, "blobs", actual.schema)).drop("sort_identity")


@query("integrity_messages", "SELECT 'CATALOG_INTEGRITY' AS category, 'integrity_check' AS identity, 'reason=integrity-check detail=' || left(text, 256) AS details FROM benchmark")
def integrity_messages(r: Relations) -> DataFrame:
    given = r.table("benchmark").select(F.col("text").alias("message"))
    return audit.integrity_findings(given.unionByName(given.select(F.lit("ok").alias("message")))).drop("sort_identity")


@query("audit_report", "SELECT (SELECT count(*) FROM candidates) AS blob_rows_seen, (SELECT count(*) FROM candidates JOIN labels ON doc_id = sequence WHERE toxic = 1) AS gc_candidates, (SELECT count(*) FROM verified_store) AS cas_blob_files, (SELECT count(*) FROM verified_store WHERE kind = 'file') AS blobs_hashed, (SELECT count(*) FROM recon_findings) AS findings")
def audit_report(r: Relations) -> DataFrame:
    return audit.audit_report(r.raw_blobs(), r.verified_store(), _recon(r))


# Collection


def _orders(r: Relations) -> DataFrame:
    return collection.classified(collection.reachability(r.order_blobs(), r.order_references()))


@query("gc_classify", "SELECT kind, count(*) AS blobs, sum(size_bytes)::BIGINT AS bytes FROM classes GROUP BY kind")
def gc_classify(r: Relations) -> DataFrame:
    return collection.classified(collection.reachability(r.blobs(), r.references())).groupBy("kind").agg(F.count("*").alias("blobs"), F.sum("size_bytes").cast("long").alias("bytes"))


def _set(kind: str):
    @query(f"gc_{kind}_set", f"SELECT hash, size_bytes FROM order_classes WHERE kind = '{kind}'")
    def one(r: Relations) -> DataFrame:
        return _orders(r).where(F.col("kind") == kind).select("hash", "size_bytes")


for _kind in ("mark", "resurrect", "sweep"):
    _set(_kind)


@query("gc_missing_classify", """
    SELECT CASE WHEN size_bytes % 13 = 0 THEN 'BLOB_IO_ERROR' WHEN size_bytes % 11 = 0 THEN 'NON_REGULAR_BLOB' ELSE 'MISSING_BLOB' END AS category, hash AS identity FROM order_classes
    WHERE size_bytes % 13 = 0 OR size_bytes % 11 = 0 OR (size_bytes % 7 = 0 AND NOT (deleted_at_ms IS NOT NULL AND NOT referenced))""")
def gc_missing_classify(r: Relations) -> DataFrame:
    size = F.col("size_bytes")
    listing = r.order_blobs().where("size_bytes % 13 = 0 or size_bytes % 11 = 0 or size_bytes % 7 <> 0").select(
        "hash", F.when((size % 11 == 0) & (size % 13 != 0), "directory").when(size % 13 != 0, "file").alias("kind"), F.when(size % 13 == 0, "stat-failed").alias("io_error")
    )
    return collection.missing_findings(_orders(r), listing).select("category", "identity")


@query("gc_orphans", "SELECT 'ORPHAN_BLOB' AS category, hash AS identity FROM verified_store WHERE hash NOT IN (SELECT hash FROM blobs)")
def gc_orphans(r: Relations) -> DataFrame:
    return collection.orphan_findings(r.verified_store(), r.blobs()).select("category", "identity")


@query("gc_verify", """
    SELECT 'SIZE_MISMATCH' AS category, hash AS identity, min(d) AS details FROM (SELECT c.hash, 'expected=' || c.size_bytes || ' metadata=' || s.size_bytes AS d FROM classes c JOIN verified_store s USING (hash) WHERE c.size_bytes <> s.size_bytes
        UNION ALL SELECT c.hash, 'expected=' || c.size_bytes || ' metadata=' || s.size_bytes || ' actual=' || actual_size FROM classes c JOIN verified_store s USING (hash) WHERE c.kind = 'sweep' AND (actual_size <> c.size_bytes OR s.size_bytes <> actual_size)) GROUP BY hash
    UNION ALL SELECT 'HASH_MISMATCH', hash, 'expected=' || hash || ' actual=' || actual_hash FROM classes c JOIN verified_store s USING (hash) WHERE c.kind = 'sweep' AND actual_hash <> hash""")
def gc_verify(r: Relations) -> DataFrame:
    classes = collection.classified(collection.reachability(r.blobs(), r.references()))
    return audit.deduplicated(collection.verify_findings(classes, r.verified_store())).drop("sort_identity")


@query("gc_action_plan", "SELECT * FROM order_plan")
def gc_action_plan(r: Relations) -> DataFrame:
    return collection.plan(_orders(r), r.order_store())


@query("gc_report", """
    SELECT (SELECT count(*) FROM order_classes) AS catalog_blobs, (SELECT count(*) FROM order_classes WHERE referenced) AS reachable_blobs, count(*) FILTER (kind = 'mark') AS planned_marks, count(*) FILTER (kind = 'resurrect') AS planned_resurrects,
        count(*) FILTER (kind = 'sweep') AS planned_sweeps, coalesce(sum(size_bytes) FILTER (sweep_source_state = 'present'), 0)::BIGINT AS bytes_reclaimable, count(*) FILTER (sweep_source_state = 'present') AS candidates_hashed FROM order_plan""")
def gc_report(r: Relations) -> DataFrame:
    return collection.report(_orders(r), collection.plan(_orders(r), r.order_store()))


@query("gc_progress", """
    SELECT count(*) FILTER (kind = 'mark') AS completed_marks, count(*) FILTER (kind = 'resurrect') AS completed_resurrects, count(*) FILTER (kind = 'sweep') AS completed_sweeps, count(*) FILTER (sweep_source_state = 'present') AS files_removed,
        coalesce(sum(size_bytes) FILTER (sweep_source_state = 'present'), 0)::BIGINT AS bytes_reclaimed FROM order_plan""")
def gc_progress(r: Relations) -> DataFrame:
    return collection.progress(collection.plan(_orders(r), r.order_store()))


@query("gc_next_blobs", f"SELECT hash, size_bytes, created_at_ms, CASE kind WHEN 'mark' THEN {NOW_MS} WHEN 'resurrect' THEN NULL ELSE deleted_at_ms END AS deleted_at_ms FROM order_classes WHERE kind <> 'sweep'")
def gc_next_blobs(r: Relations) -> DataFrame:
    return collection.next_blobs(_orders(r), NOW_MS)


@query("gc_two_run", f"""
    SELECT kind2, count(*) AS blobs FROM (SELECT CASE WHEN referenced THEN 'unchanged' ELSE 'sweep' END AS kind2 FROM order_classes WHERE kind <> 'sweep') GROUP BY kind2""")
def gc_two_run(r: Relations) -> DataFrame:
    """What a second run plans: first marks are swept, nothing else changes."""
    again = collection.classified(collection.reachability(collection.next_blobs(_orders(r), NOW_MS), r.order_references()))
    return again.groupBy(F.col("kind").alias("kind2")).agg(F.count("*").alias("blobs"))


# Browse tree


def _tree(r: Relations) -> tuple[DataFrame, DataFrame]:
    links = r.links()
    return links, tree.owned(r.existing(links), "/store")


@query("desired_links", "SELECT output_path, target_text, blob_hash FROM links")
def desired_links(r: Relations) -> DataFrame:
    return r.links().select("output_path", "target_text", "blob_hash")


@query("link_diff", "SELECT * FROM diff")
def link_diff(r: Relations) -> DataFrame:
    return tree.link_diff(*_tree(r))


@query("stale_links", "SELECT path FROM stale")
def stale_links(r: Relations) -> DataFrame:
    return tree.stale_links(*_tree(r))


@query("dirs_to_create", "SELECT directory FROM to_create")
def dirs_to_create(r: Relations) -> DataFrame:
    return tree.directories_to_create(*_tree(r), "/tree")


@query("dirs_to_prune", "SELECT directory FROM to_prune")
def dirs_to_prune(r: Relations) -> DataFrame:
    return tree.directories_to_prune(*_tree(r), "/tree")


@query("suffix_collisions", "SELECT regexp_replace(relative_path, 'doc_.*$', 'f_' || blob_hash[1:2]) AS output_path, count(*) AS wanted, min(blob_hash) AS first_hash, max(blob_hash) AS other_hash FROM (SELECT DISTINCT regexp_replace(relative_path, 'doc_.*$', 'f') AS relative_path, blob_hash FROM entries_live) GROUP BY regexp_replace(relative_path, 'f$', 'f_' || blob_hash[1:2]), 1 HAVING count(*) > 1".replace("regexp_replace(relative_path, 'doc_.*$', 'f_' || blob_hash[1:2]) AS output_path", "regexp_replace(relative_path, 'f$', 'f_' || blob_hash[1:2]) AS output_path"))
def suffix_collisions(r: Relations) -> DataFrame:
    """With two digits and one name in each folder, contents collide."""
    short = r.links().select(F.concat(F.regexp_replace("relative_path", "doc_.*$", "f")).alias("relative_path"), "blob_hash").distinct()
    return tree.collisions(short.select(T.output_path(F.col("relative_path"), F.col("blob_hash"), 2).alias("output_path"), "blob_hash"))


@query("invalid_link_targets", "SELECT output_path, blob_hash, CASE WHEN s.kind IS NULL THEN 'missing' WHEN s.kind <> 'file' THEN 'non-regular' ELSE 'size-mismatch' END AS reason FROM links l LEFT JOIN verified_store s ON s.hash = l.blob_hash WHERE s.kind IS NULL OR s.kind <> 'file' OR s.size_bytes <> blob_size_bytes")
def invalid_link_targets(r: Relations) -> DataFrame:
    return tree.invalid_targets(r.links(), r.verified_store())


@query("build_tree_report", """
    SELECT count(*) AS desired_links, count(*) FILTER (status = 'created') AS links_created, count(*) FILTER (status = 'unchanged') AS links_unchanged, count(*) FILTER (status = 'replaced') AS links_replaced,
        (SELECT count(*) FROM stale) AS stale_links_removed, (SELECT count(*) FROM to_create) AS directories_created, (SELECT count(*) FROM to_prune) AS directories_pruned FROM diff""")
def build_tree_report(r: Relations) -> DataFrame:
    links, existing = _tree(r)
    return tree.report(tree.link_diff(links, existing), tree.stale_links(links, existing), tree.directories_to_create(links, existing, "/tree"), tree.directories_to_prune(links, existing, "/tree"))


# Events


@query("event_delta_rollup", "SELECT command, event, stage, count(*) AS events, sum(count)::BIGINT AS delta FROM telemetry GROUP BY ALL")
def event_delta_rollup(r: Relations) -> DataFrame:
    return events.delta_rollup(r.events())


@query("gauge_last_value", "SELECT command, event, stage, arg_max(count, seq) AS value, max(seq) AS seq FROM telemetry GROUP BY ALL")
def gauge_last_value(r: Relations) -> DataFrame:
    return events.gauge_last(r.events())


@query("dashboard_fold", """
    SELECT command, count(*) AS events, sum(count)::BIGINT AS total, arg_max(count, seq) AS last_count, max(count) AS most, max(at_ms) - min(at_ms) AS elapsed_ms, (count(*) * 1000 // (max(at_ms) - min(at_ms)))::BIGINT AS events_per_second FROM telemetry GROUP BY command""")
def dashboard_fold(r: Relations) -> DataFrame:
    return events.dashboard(r.events())


@query("queue_high_water", "SELECT stage, max(count) AS high_water, count(*) AS observations FROM telemetry GROUP BY stage")
def queue_high_water(r: Relations) -> DataFrame:
    return events.high_water(r.events())


@query("mount_occupancy", "SELECT mount_id, count(*) AS pending, least(count(*), 1)::BIGINT AS active FROM candidates GROUP BY mount_id")
def mount_occupancy(r: Relations) -> DataFrame:
    return events.mount_occupancy(r.candidates())


@query("writer_totals", "SELECT count(DISTINCT sequence // 32) AS batches, count(*) AS records, count(DISTINCT sequence // 32) // 8 + 1 AS checkpoints FROM candidates")
def writer_totals(r: Relations) -> DataFrame:
    return events.writer_totals(r.candidates().select(F.col("sequence").alias("place")))


@query("jsonl_encode", """SELECT '{"schema_version":1,"command":"import","event":"' || event || '","seq":' || seq || CASE WHEN stage > 0 THEN ',"stage":' || stage ELSE '' END || '}' AS value FROM telemetry""")
def jsonl_encode(r: Relations) -> DataFrame:
    return events.as_json_lines(r.events().select("command", "event", "seq", F.when(F.col("stage") > 0, F.col("stage")).alias("stage")))


# Streaming


@query("observation_stream_upsert", _UPSERT)
def observation_stream_upsert(r: Relations) -> DataFrame:
    """The same merge as source_upsert, micro-batch by micro-batch in the order of turns."""
    from holdfast.streaming.observations import upsert_in_batches

    return upsert_in_batches(r.spark, r.chat_files(), r.observations(), "sequence")
