"""The model's relations, derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.sources.snapshots import written

#: Files named by documents; every third also below a second root, there with other content where the id is odd.
NOW_MS, MTIME_BASE = 1_800_000_000_000, 1_700_000_000_000


class Relations:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def candidates(self) -> DataFrame:
        d = self.table("documents")
        return d.select(
            F.lit("/docs").alias("source_root"), F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))).alias("relative_path"),
            F.octet_length("text").cast("long").alias("size_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("hash"),
            (F.lit(MTIME_BASE) + F.col("doc_id") * 1000).alias("modified_at_ms"), F.col("doc_id").alias("sequence"), (F.col("doc_id") % 4).alias("mount_id"),
        )

    def mirrored(self) -> DataFrame:
        d = self.table("documents").where("doc_id % 3 = 0").withColumn("body", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x"))))
        return d.select(
            F.lit("/mirror").alias("source_root"), F.concat_ws("/", "lang", "source", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))).alias("relative_path"),
            F.octet_length("body").cast("long").alias("size_bytes"), F.sha2(F.col("body").cast("binary"), 256).alias("hash"), (F.lit(MTIME_BASE) + F.col("doc_id") * 1000).alias("modified_at_ms"),
            (F.col("doc_id") + 1_000_000_000).alias("sequence"), (F.col("doc_id") % 4).alias("mount_id"),
        )

    def known(self) -> DataFrame:
        """As from known_files(): perturbed by the id's last digit, so that each rule of classification is met."""
        r = F.col("sequence") % 10
        c = self.candidates().where(r != 9)
        size = F.when(r == 0, F.col("size_bytes") - 1).otherwise(F.col("size_bytes"))
        mtime = F.when(r == 1, None).when(r == 2, F.col("modified_at_ms") + 1).otherwise(F.col("modified_at_ms"))
        return c.select(
            "source_root", "relative_path", F.col("hash").alias("blob_hash"), size.alias("source_size_bytes"), mtime.alias("known_modified_at_ms"),
            F.when(r == 3, size + 1).otherwise(size).alias("blob_size_bytes"), F.when(r == 4, F.lit(7).cast("long")).alias("blob_deleted_at_ms"),
        )

    def cas(self) -> DataFrame:
        """The store: contents of all documents but those whose id ends in 5."""
        return self.candidates().where("sequence % 10 <> 5").groupBy("hash").agg(F.min("size_bytes").alias("size_bytes")).withColumn("kind", F.lit("file"))

    def source_files(self) -> DataFrame:
        c = self.candidates().where("sequence % 10 <> 9")
        return c.select(
            (F.col("sequence") + 1).alias("id"), "source_root", "relative_path", F.col("hash").alias("blob_hash"), "size_bytes", "modified_at_ms",
            (F.lit(1000) + F.col("sequence")).alias("first_seen_at_ms"), (F.lit(2000) + F.col("sequence")).alias("last_seen_at_ms"), F.lit(1).cast("long").alias("seen_count"),
        )

    def blobs(self) -> DataFrame:
        """One for each content, referenced and marked by its documents' labels."""
        d = self.candidates().join(self.table("labels").select(F.col("doc_id").alias("sequence"), "quality", "toxic"), "sequence", "left")
        return d.groupBy("hash").agg(
            F.min("size_bytes").alias("size_bytes"), (F.lit(1000) + F.min("sequence")).alias("created_at_ms"),
            F.when(F.max(F.coalesce("toxic", F.lit(0))) == 1, F.lit(7).cast("long")).alias("deleted_at_ms"),
        )

    def references(self) -> DataFrame:
        d = self.candidates().join(self.table("labels").select(F.col("doc_id").alias("sequence"), "quality"), "sequence", "left")
        return d.where("coalesce(quality, 1) <> 0").select(F.col("hash").alias("blob_hash"))

    def order_blobs(self) -> DataFrame:
        """A large catalog: orders as blobs, every third marked."""
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderkey").cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("created_at_ms"),
            F.when(F.col("o_orderkey") % 3 == 0, F.lit(7).cast("long")).alias("deleted_at_ms"),
        )

    def order_references(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").cast("string").alias("blob_hash"))

    def order_store(self) -> DataFrame:
        return self.order_blobs().where("size_bytes % 7 <> 0").select("hash")

    def verified_store(self) -> DataFrame:
        """The store as read: some files of another size or content, orphans named by pages, one that is no file."""
        c = self.candidates().where("sequence % 10 <> 5").groupBy("hash").agg(F.min("size_bytes").alias("size_bytes"), F.min("sequence").alias("s"))
        mine = c.select(
            "hash", (F.col("size_bytes") + F.when(F.col("s") % 11 == 0, 1).otherwise(0)).alias("size_bytes"),
            F.when(F.col("s") % 13 == 0, F.sha2(F.col("hash"), 256)).otherwise(F.col("hash")).alias("actual_hash"),
            (F.col("size_bytes") + F.when(F.col("s") % 17 == 0, 2).when(F.col("s") % 11 == 0, 1).otherwise(0)).alias("actual_size"), F.when(F.col("s") % 19 == 0, "symlink").otherwise("file").alias("kind"),
        )
        p = self.table("pages").select(F.sha2(F.col("html").cast("binary"), 256).alias("hash"), F.octet_length("html").cast("long").alias("size_bytes")).distinct()
        return mine.unionByName(p.select("hash", "size_bytes", F.col("hash").alias("actual_hash"), F.col("size_bytes").alias("actual_size"), F.lit("file").alias("kind")))

    def listing(self) -> DataFrame:
        """Entries below the blob folder, malformed in many ways by page id."""
        p = self.table("pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("h"))
        r, h = F.col("page_id") % 11, F.col("h")
        good = F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), h)
        path = (
            F.when(r == 1, F.substring(h, 1, 2)).when(r == 2, F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2))).when(r == 3, F.lit("AA"))
            .when(r == 4, F.concat(good, F.lit("/deep"))).when(r == 5, h).when(r == 6, F.concat_ws("/", F.lit("zz"), F.substring(h, 3, 2), h))
            .when(r == 7, F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2), F.upper(h))).when(r == 8, F.concat_ws("/", F.lit("ab"), F.lit("cd"), h)).otherwise(good)
        )
        kind = F.when(r.isin(1, 2, 3, 4), "directory").when(r == 9, "symlink").when(r == 10, "other").otherwise("file")
        return p.select("page_id", path.alias("rel_path"), kind.alias("kind"), (F.col("page_id") % 29 != 5).alias("ancestors_valid"), F.when(F.col("page_id") % 31 == 7, "stat-failed").alias("io_error"))

    def raw_blobs(self) -> DataFrame:
        """Untyped blob rows, one malformed cell in each by id."""
        c, r = self.candidates(), F.col("sequence") % 12
        ref = self.table("labels").select(F.col("doc_id").alias("sequence"), "toxic")
        j = c.join(ref, "sequence", "left")
        return j.select(
            F.col("sequence").cast("string").alias("rowid"),
            F.when(r == 1, F.upper("hash")).when(r == 2, None).otherwise(F.col("hash")).alias("hash"), F.when(r == 2, "null").otherwise("text").alias("hash_class"),
            F.when(r == 3, "-1").when(r == 4, "abc").otherwise(F.col("size_bytes").cast("string")).alias("size_bytes"), F.when(r == 4, "text").otherwise("integer").alias("size_bytes_class"),
            F.lit("1000").alias("created_at_ms"), F.when(r == 5, "real").otherwise("integer").alias("created_at_ms_class"),
            F.when(F.col("toxic") == 1, "7").when(r == 6, "x").alias("deleted_at_ms"), F.when(F.col("toxic") == 1, "integer").when(r == 6, "text").otherwise("null").alias("deleted_at_ms_class"),
            F.when(r == 7, "2").otherwise("1").alias("referenced"),
        )

    def raw_sources(self) -> DataFrame:
        """Untyped source rows, malformed in one or two cells by id."""
        c, r = self.candidates(), F.col("sequence") % 14
        text = lambda col: F.col(col).cast("string")
        return c.select(
            text("sequence").alias("rowid"), F.when(r == 1, "").otherwise(F.col("source_root")).alias("source_root"), F.lit("text").alias("source_root_class"),
            F.when(r == 2, F.concat(F.lit("/"), "relative_path")).when(r == 3, F.concat(F.lit("a//"), "relative_path")).otherwise(F.col("relative_path")).alias("relative_path"), F.lit("text").alias("relative_path_class"),
            F.when(r == 4, "00").otherwise(F.col("hash")).alias("blob_hash"), F.lit("text").alias("blob_hash_class"),
            F.when(r == 5, F.lit("-5")).when(r == 6, (F.col("size_bytes") + 1).cast("string")).otherwise(text("size_bytes")).alias("size_bytes"), F.lit("integer").alias("size_bytes_class"),
            text("modified_at_ms").alias("modified_at_ms"), F.when(r == 7, "blob").otherwise("integer").alias("modified_at_ms_class"),
            F.when(r == 8, "9").when(r == 9, "x").otherwise("1").alias("first_seen_at_ms"), F.when(r == 9, "text").otherwise("integer").alias("first_seen_at_ms_class"),
            F.lit("1").alias("last_seen_at_ms"), F.when(r == 10, "real").otherwise("integer").alias("last_seen_at_ms_class"),
            F.when(r == 11, "0").otherwise("2").alias("seen_count"), F.lit("integer").alias("seen_count_class"),
        )

    def observations(self) -> DataFrame:
        """Writes by conversation and role, in the order of turns."""
        c = self.table("conversations")
        return c.select(
            F.lit("/chats").alias("source_root"), F.concat(F.lit("conv_"), "conv_id", F.lit("/"), "role").alias("relative_path"), F.lit("imported").alias("kind"),
            F.sha2(F.col("text").cast("binary"), 256).alias("blob_hash"), F.octet_length("text").cast("long").alias("size_bytes"),
            F.when(F.col("turn") % 2 == 0, F.lit(5000) + F.col("turn")).cast("long").alias("modified_at_ms"), F.col("turn").alias("observed_at_ms"), F.col("turn").alias("sequence"),
        )

    def chat_files(self) -> DataFrame:
        """A catalog that knows the users' files."""
        o = self.table("conversations").where("role = 'user'").select("conv_id").distinct()
        return o.select(
            (F.col("conv_id") + 1).alias("id"), F.lit("/chats").alias("source_root"), F.concat(F.lit("conv_"), "conv_id", F.lit("/user")).alias("relative_path"), F.lit("0" * 64).alias("blob_hash"),
            F.lit(3).cast("long").alias("size_bytes"), F.lit(None).cast("long").alias("modified_at_ms"), F.lit(-10).cast("long").alias("first_seen_at_ms"), F.lit(-5).cast("long").alias("last_seen_at_ms"), F.lit(4).cast("long").alias("seen_count"),
        )

    def events(self) -> DataFrame:
        e = self.table("events")
        at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) div 1000")
        return e.select(
            F.col("event_id").alias("seq"), F.lit("import").alias("command"), F.col("event_type").alias("event"), (F.col("user_id") % 5).alias("stage"), (F.col("event_id") % 100).alias("count"), at.alias("at_ms"),
        )

    def existing(self, links: DataFrame) -> DataFrame:
        """A browse tree of an earlier run: links kept, replaced and stale, a user's link, files, and directories."""
        d = links.select("output_path", "target_text", "blob_hash", F.substring("blob_hash", 1, 1).alias("c"), F.substring("blob_hash", 2, 1).alias("e"))
        kept = d.where("c in ('0', '1', '2')").select(F.col("output_path").alias("path"), F.lit("symlink").alias("kind"), "target_text")
        moved = d.where("c in ('3', '4')").select(F.col("output_path").alias("path"), F.lit("symlink").alias("kind"), F.concat(F.lit("/store/blobs/00/00/"), "blob_hash").alias("target_text"))
        stale = d.where("c in ('5', '6')").select(F.concat(F.lit("/tree/old/"), "e", F.lit("/"), "blob_hash").alias("path"), F.lit("symlink").alias("kind"), F.concat(F.lit("../../../store/blobs/aa/bb/"), "blob_hash").alias("target_text"))
        mine = d.where("c = '7' and e in ('0', '1', '2')").select(F.concat(F.lit("/tree/old/"), "e", F.lit("/mine")).alias("path"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("target_text")).distinct()
        entries = kept.unionByName(moved).unionByName(stale).unionByName(mine)
        folders = entries.select(F.regexp_replace("path", "/[^/]*$", "").alias("f")).distinct()
        up = folders.select("f").unionByName(folders.select(F.regexp_replace("f", "/[^/]*$", "").alias("f"))).where("f <> '/tree' and f <> ''").distinct()
        return written(entries.unionByName(up.select(F.col("f").alias("path"), F.lit("directory").alias("kind"), F.lit(None).cast("string").alias("target_text"))), "existing")

    def links(self) -> DataFrame:
        from holdfast.operators import tree

        files = self.source_files().select("relative_path", "blob_hash").unionByName(self.mirrored().select("relative_path", F.col("hash").alias("blob_hash")))
        blobs = self.candidates().select("hash", "size_bytes").unionByName(self.mirrored().select("hash", "size_bytes")).groupBy("hash").agg(F.min("size_bytes").alias("size_bytes"))
        live = blobs.withColumn("deleted_at_ms", F.when(F.substring("hash", 1, 1) == "f", F.lit(7).cast("long")))
        return written(tree.desired_links(tree.live_entries(files, live), "/tree", "/store", 6), "links")


_PATH = "lang || '/' || source || '/doc_' || doc_id || '.txt'"

#: The same relations in SQL, by name.
CTE: dict[str, str] = {
    "candidates": f"SELECT '/docs' AS source_root, {_PATH} AS relative_path, strlen(text)::BIGINT AS size_bytes, sha256(text) AS hash, {MTIME_BASE} + doc_id * 1000 AS modified_at_ms, doc_id AS sequence, doc_id % 4 AS mount_id FROM documents",
    "mirrored": f"SELECT '/mirror' AS source_root, {_PATH} AS relative_path, strlen(body)::BIGINT AS size_bytes, sha256(body) AS hash FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN text ELSE text || 'x' END AS body FROM documents WHERE doc_id % 3 = 0)",
    "known": """SELECT source_root, relative_path, hash AS blob_hash, s AS source_size_bytes, m AS known_modified_at_ms, CASE WHEN r = 3 THEN s + 1 ELSE s END AS blob_size_bytes, CASE WHEN r = 4 THEN 7 END AS blob_deleted_at_ms
        FROM (SELECT *, sequence % 10 AS r, CASE WHEN sequence % 10 = 0 THEN size_bytes - 1 ELSE size_bytes END AS s, CASE sequence % 10 WHEN 1 THEN NULL WHEN 2 THEN modified_at_ms + 1 ELSE modified_at_ms END AS m FROM candidates) WHERE r <> 9""",
    "cas": "SELECT hash, min(size_bytes) AS size_bytes, 'file' AS kind FROM candidates WHERE sequence % 10 <> 5 GROUP BY hash",
    "source_files": "SELECT sequence + 1 AS id, source_root, relative_path, hash AS blob_hash, size_bytes, modified_at_ms, 1000 + sequence AS first_seen_at_ms, 2000 + sequence AS last_seen_at_ms, 1::BIGINT AS seen_count FROM candidates WHERE sequence % 10 <> 9",
    "blobs": "SELECT hash, min(size_bytes) AS size_bytes, 1000 + min(sequence) AS created_at_ms, CASE WHEN max(coalesce(toxic, 0)) = 1 THEN 7::BIGINT END AS deleted_at_ms FROM candidates LEFT JOIN labels ON doc_id = sequence GROUP BY hash",
    "refs": "SELECT hash AS blob_hash FROM candidates LEFT JOIN labels ON doc_id = sequence WHERE coalesce(quality, 1) <> 0",
    "order_blobs": "SELECT o_orderkey::VARCHAR AS hash, o_orderkey::BIGINT AS size_bytes, 1::BIGINT AS created_at_ms, CASE WHEN o_orderkey % 3 = 0 THEN 7::BIGINT END AS deleted_at_ms FROM orders",
    "order_classes": """SELECT *, CASE WHEN referenced THEN CASE WHEN deleted_at_ms IS NULL THEN 'unchanged' ELSE 'resurrect' END ELSE CASE WHEN deleted_at_ms IS NULL THEN 'mark' ELSE 'sweep' END END AS kind
        FROM (SELECT *, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey::VARCHAR = hash) AS referenced FROM order_blobs)""",
    "order_store": "SELECT hash FROM order_blobs WHERE size_bytes % 7 <> 0",
    "order_plan": """SELECT CASE kind WHEN 'mark' THEN 0 WHEN 'resurrect' THEN 1 ELSE 2 END AS kind_rank, kind, hash, size_bytes,
        CASE WHEN kind = 'sweep' THEN CASE WHEN hash IN (SELECT hash FROM order_store) THEN 'present' ELSE 'already-absent' END END AS sweep_source_state FROM order_classes WHERE kind <> 'unchanged'""",
    "classes": """SELECT *, CASE WHEN referenced THEN CASE WHEN deleted_at_ms IS NULL THEN 'unchanged' ELSE 'resurrect' END ELSE CASE WHEN deleted_at_ms IS NULL THEN 'mark' ELSE 'sweep' END END AS kind
        FROM (SELECT *, EXISTS (SELECT 1 FROM refs WHERE blob_hash = hash) AS referenced FROM blobs)""",
    "classified": """SELECT c.*, k.blob_hash, k.blob_deleted_at_ms, CASE WHEN k.blob_hash IS NULL THEN 'no-catalog-observation' WHEN source_size_bytes <> c.size_bytes THEN 'size-changed'
        WHEN known_modified_at_ms IS NULL OR c.modified_at_ms IS NULL THEN 'modified-time-unavailable' WHEN known_modified_at_ms <> c.modified_at_ms THEN 'modified-time-changed'
        WHEN blob_size_bytes <> source_size_bytes THEN 'catalog-source-inconsistency' WHEN s.kind IS NULL THEN 'cas-blob-missing' WHEN s.kind <> 'file' OR s.size_bytes <> source_size_bytes THEN 'cas-blob-invalid' ELSE 'skip' END AS disposition
        FROM candidates c LEFT JOIN known k USING (source_root, relative_path) LEFT JOIN cas s ON s.hash = k.blob_hash""",
    "verified_store": """SELECT hash, size_bytes + CASE WHEN s % 11 = 0 THEN 1 ELSE 0 END AS size_bytes, CASE WHEN s % 13 = 0 THEN sha256(hash) ELSE hash END AS actual_hash,
        size_bytes + CASE WHEN s % 17 = 0 THEN 2 WHEN s % 11 = 0 THEN 1 ELSE 0 END AS actual_size, CASE WHEN s % 19 = 0 THEN 'symlink' ELSE 'file' END AS kind
        FROM (SELECT hash, min(size_bytes) AS size_bytes, min(sequence) AS s FROM candidates WHERE sequence % 10 <> 5 GROUP BY hash)
        UNION ALL SELECT DISTINCT sha256(html), strlen(html)::BIGINT, sha256(html), strlen(html)::BIGINT, 'file' FROM pages""",
    "reconciled": """SELECT coalesce(b.hash, s.hash) AS hash, b.size_bytes AS catalog_size, s.size_bytes AS metadata_size, actual_hash, actual_size, s.kind,
        CASE WHEN s.kind IS NULL THEN 'missing' WHEN b.hash IS NULL THEN 'orphan' ELSE 'both' END AS side FROM blobs b FULL JOIN verified_store s ON b.hash = s.hash""",
    "recon_findings": """SELECT 'MISSING_BLOB' AS category, hash AS identity, 'path=blobs/' || hash[1:2] || '/' || hash[3:4] || '/' || hash AS details FROM reconciled WHERE side = 'missing'
        UNION ALL SELECT 'NON_REGULAR_BLOB', hash, 'path=blobs/' || hash[1:2] || '/' || hash[3:4] || '/' || hash FROM reconciled WHERE side <> 'missing' AND kind <> 'file'
        UNION ALL SELECT 'ORPHAN_BLOB', hash, 'path=blobs/' || hash[1:2] || '/' || hash[3:4] || '/' || hash FROM reconciled WHERE side = 'orphan'
        UNION ALL SELECT 'SIZE_MISMATCH', hash, 'expected=' || coalesce(catalog_size, metadata_size) || ' metadata=' || metadata_size || ' actual=' || actual_size FROM reconciled
            WHERE side <> 'missing' AND kind = 'file' AND (coalesce(catalog_size, metadata_size) <> actual_size OR metadata_size <> actual_size)
        UNION ALL SELECT 'HASH_MISMATCH', hash, 'expected=' || hash || ' actual=' || actual_hash FROM reconciled WHERE side <> 'missing' AND kind = 'file' AND actual_hash <> hash""",
    "entries": """SELECT *, CASE WHEN io_error IS NOT NULL THEN NULL WHEN kind = 'symlink' THEN 'symlink' WHEN kind = 'other' THEN 'non-regular' WHEN NOT ancestors_valid THEN 'malformed-ancestor'
        WHEN kind = 'directory' AND len(p) <= 2 AND len(list_filter(p, lambda x: NOT regexp_full_match(x, '[0-9a-f]{2}'))) = 0 THEN 'valid-directory' WHEN kind = 'directory' AND len(p) >= 3 THEN 'directory-at-blob-depth' WHEN kind = 'directory' THEN 'invalid-shard'
        WHEN len(p) <> 3 THEN 'file-at-invalid-depth' WHEN NOT regexp_full_match(p[1], '[0-9a-f]{2}') OR NOT regexp_full_match(p[2], '[0-9a-f]{2}') THEN 'invalid-shard'
        WHEN NOT regexp_full_match(p[3], '[0-9a-f]{64}') THEN 'invalid-blob-name' WHEN p[1] <> p[3][1:2] OR p[2] <> p[3][3:4] THEN 'shard-mismatch' ELSE 'valid-blob' END AS class
        FROM (SELECT *, string_split(rel_path, '/') AS p FROM (SELECT page_id, CASE page_id % 11 WHEN 1 THEN h[1:2] WHEN 2 THEN h[1:2] || '/' || h[3:4] WHEN 3 THEN 'AA' WHEN 4 THEN g || '/deep' WHEN 5 THEN h WHEN 6 THEN 'zz/' || h[3:4] || '/' || h
            WHEN 7 THEN h[1:2] || '/' || h[3:4] || '/' || upper(h) WHEN 8 THEN 'ab/cd/' || h ELSE g END AS rel_path,
            CASE WHEN page_id % 11 IN (1, 2, 3, 4) THEN 'directory' WHEN page_id % 11 = 9 THEN 'symlink' WHEN page_id % 11 = 10 THEN 'other' ELSE 'file' END AS kind, page_id % 29 <> 5 AS ancestors_valid, CASE WHEN page_id % 31 = 7 THEN 'stat-failed' END AS io_error
            FROM (SELECT page_id, sha256(html) AS h, sha256(html)[1:2] || '/' || sha256(html)[3:4] || '/' || sha256(html) AS g FROM pages)))""",
    "observed": """SELECT '/chats' AS source_root, 'conv_' || conv_id || '/' || role AS relative_path, 'imported' AS kind, sha256(text) AS blob_hash, strlen(text)::BIGINT AS size_bytes,
        CASE WHEN turn % 2 = 0 THEN 5000 + turn END AS modified_at_ms, turn AS observed_at_ms, turn AS sequence FROM conversations""",
    "chat_files": "SELECT DISTINCT conv_id + 1 AS id, '/chats' AS source_root, 'conv_' || conv_id || '/user' AS relative_path FROM conversations WHERE role = 'user'",
    "telemetry": "SELECT event_id AS seq, 'import' AS command, event_type AS event, user_id % 5 AS stage, event_id % 100 AS count, epoch_us(ts) // 1000 AS at_ms FROM events",
    "entries_live": """SELECT relative_path, blob_hash, min(size_bytes) AS blob_size_bytes FROM (SELECT relative_path, hash AS blob_hash, size_bytes FROM candidates WHERE sequence % 10 <> 9
        UNION ALL SELECT relative_path, hash, size_bytes FROM mirrored) WHERE blob_hash[1:1] <> 'f' GROUP BY ALL""",
    "links": """SELECT relative_path, blob_hash, blob_size_bytes, '/tree/' || regexp_replace(relative_path, '\\.txt$', '_' || blob_hash[1:6] || '.txt') AS output_path, '/store/blobs/' || blob_hash[1:2] || '/' || blob_hash[3:4] || '/' || blob_hash AS target_path,
        '../../../store/blobs/' || blob_hash[1:2] || '/' || blob_hash[3:4] || '/' || blob_hash AS target_text FROM entries_live""",
    "tree_links": """SELECT output_path AS path, 'symlink' AS kind, target_text FROM links WHERE blob_hash[1:1] IN ('0', '1', '2')
        UNION ALL SELECT output_path, 'symlink', '/store/blobs/00/00/' || blob_hash FROM links WHERE blob_hash[1:1] IN ('3', '4')
        UNION ALL SELECT '/tree/old/' || blob_hash[2:2] || '/' || blob_hash, 'symlink', '../../../store/blobs/aa/bb/' || blob_hash FROM links WHERE blob_hash[1:1] IN ('5', '6')
        UNION ALL SELECT DISTINCT '/tree/old/' || blob_hash[2:2] || '/mine', 'file', NULL FROM links WHERE blob_hash[1:1] = '7' AND blob_hash[2:2] IN ('0', '1', '2')""",
    "tree_folders": """SELECT DISTINCT f FROM (SELECT regexp_replace(path, '/[^/]*$', '') AS f FROM tree_links UNION ALL SELECT regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', '') FROM tree_links) WHERE f NOT IN ('', '/tree')""",
    "stale": "SELECT path FROM tree_links WHERE kind = 'symlink' AND path LIKE '/tree/old/%' AND path NOT IN (SELECT output_path FROM links)",
    "diff": """SELECT output_path, l.target_text, blob_hash, CASE WHEN t.path IS NULL THEN 'created' WHEN t.kind <> 'symlink' THEN 'blocked-by-entry' WHEN t.target_text = l.target_text THEN 'unchanged' ELSE 'replaced' END AS status
        FROM links l LEFT JOIN tree_links t ON t.path = l.output_path""",
    "wanted_folders": "SELECT DISTINCT f AS directory FROM (SELECT regexp_replace(output_path, '/[^/]*$', '') AS f FROM links UNION ALL SELECT regexp_replace(regexp_replace(output_path, '/[^/]*$', ''), '/[^/]*$', '') FROM links) WHERE f NOT IN ('', '/tree')",
    "to_create": "SELECT directory FROM wanted_folders WHERE directory NOT IN (SELECT f FROM tree_folders)",
    "to_prune": """SELECT f AS directory FROM tree_folders WHERE EXISTS (SELECT 1 FROM stale WHERE path LIKE f || '/%') AND NOT EXISTS (SELECT 1 FROM tree_links t WHERE t.path LIKE f || '/%' AND t.path NOT IN (SELECT path FROM stale))""",
}


def with_relations(sql: str) -> str:
    """The statement with the relations it names, and those they name, before it."""
    import re

    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\w+", text):
            if name in CTE and name not in needed:
                visit(CTE[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTE[n]})" for n in needed) + "\n" + sql if needed else sql
