"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.bpe import encode_decode
from holdfast.llm.decontaminate import find_contained
from holdfast.llm.exact_dedup import exact_dedup
from holdfast.llm.line_dedup import removed_lines
from holdfast.llm.minhash_dedup import minhash_dedup
from holdfast.llm.pitman_yor import score_texts
from holdfast.llm.quality import quality_classifier
from holdfast.llm.secrets import secret_scan
from holdfast.llm.sharding import assign_shards
from holdfast.llm.suffix_dedup import remove_repeats


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(spark, table(spark, sf_dir, "documents"), k=4)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The shards of the registered query.
SHARDS = [f"shard-{i:03d}" for i in range(128)]


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(spark, table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark, table(spark, sf_dir, "documents"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark, table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(spark, table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = removed_lines(spark, table(spark, sf_dir, "documents"))
    return gone.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_sharding": op3_sharding,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_secret_scan": op5_secret_scan,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_language_model": op7_language_model,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_line_dedup": op9_line_dedup,
    "op10_suffix_dedup": op10_suffix_dedup,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _shingles(table: str, key: str, k: int) -> str:
    """Distinct k-word shingles of a table's texts, or the whole sequence of fewer words."""
    return f"""
        SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {k} THEN [array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k} + 2)]
                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM (SELECT {key}, {_WORDS.format(_LOWER)} AS w FROM {table})"""


SQL = {
    "op1_minhash_dedup": f"""
        WITH RECURSIVE sets AS ({_shingles("documents", "doc_id", 4)}),
        sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN links ON x = other)
        SELECT r.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
        FROM reach r LEFT JOIN sizes USING (doc_id) GROUP BY r.doc_id""",
    "op2_decontaminate": f"""
        WITH d AS ({_shingles("documents", "doc_id", 5)}), b AS ({_shingles("benchmark", "item_id", 5)}),
        sizes AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
        SELECT doc_id, item_id, n_shingles, count(*) AS n_shared FROM d JOIN b USING (s) JOIN sizes USING (item_id)
        GROUP BY ALL HAVING 100 * count(*) >= 80 * n_shingles""",
    "op8_exact_dedup": f"""
        WITH low AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               coalesce(doc_id = max(doc_id) OVER w, false) AS kept, sha256(t) AS text_sha256
        FROM low WINDOW w AS (PARTITION BY t)""",
    "op9_line_dedup": f"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS line_no FROM docs),
        worded AS (SELECT doc_id, line_no, list_sort(list_distinct({_WORDS.format("lower(line)")})) AS w FROM lines),
        classes AS (SELECT w, min((doc_id, line_no)) AS first FROM worded WHERE len(w) > 0 GROUP BY w),
        tokens AS (SELECT first, len(w) AS n, unnest(w) AS t FROM classes),
        rare AS (SELECT t, count(*) AS c FROM tokens GROUP BY t),
        placed AS (SELECT first, n, t, row_number() OVER (PARTITION BY first ORDER BY c, t) AS p FROM tokens JOIN rare USING (t)),
        prefix AS (SELECT * FROM placed WHERE p <= n - ceil(0.8 * n) + 1),
        pairs AS (SELECT DISTINCT a.first AS x, b.first AS y FROM prefix a JOIN prefix b ON a.t = b.t AND a.first < b.first
                  AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
        gone AS (SELECT DISTINCT y FROM pairs JOIN classes p ON p.first = x JOIN classes q ON q.first = y
                 WHERE 100 * len(list_intersect(p.w, q.w)) >= 80 * (len(p.w) + len(q.w) - len(list_intersect(p.w, q.w)))),
        judged AS (SELECT doc_id, line_no, coalesce(first < (doc_id, line_no) OR y IS NOT NULL, false) AS goes
                   FROM worded LEFT JOIN classes USING (w) LEFT JOIN gone ON y = first)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed,
               coalesce(string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (goes), '') AS removed
        FROM judged GROUP BY doc_id""",
}
