"""The corpus pipeline: classify, deduplicate, decontaminate, and encode documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet and reads again as the next stage's docs.  All but the last return the
columns of documents.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm._stage import Stages, small_batches
from holdfast.llm.bpe import encode_decode
from holdfast.llm.decontaminate import decontaminate
from holdfast.llm.exact_dedup import exact_dedup
from holdfast.llm.minhash_dedup import minhash_dedup
from holdfast.llm.quality import keep_quality

#: Tells rows apart within a stage, for keys may repeat or be null.
ROW = "_pipeline_row"


def _lean(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """stage, whose result is written in small batches whoever writes it."""

    @functools.wraps(stage)
    def out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with a number for each row, in a written table, so that rows keep their numbers."""
    return Stages(spark, "pipeline-rows").keep(docs.withColumn(ROW, F.monotonically_increasing_id()))


@_lean
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject: those that score THRESHOLD or more.

    Every row is judged by its own text, null as empty; a null key is no
    hindrance.  All columns stay.  No rows give no rows.
    """
    return keep_quality(spark, docs, _table(spark, sf_dir, "labels"))


@_lean
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows with equal texts one: of the largest doc_id (null the least), and of rows that share it any.

    Null and empty texts are equal.  Rows that share a doc_id but not a text are
    not copies.  All columns stay.  No rows give no rows.
    """
    rows = _numbered(spark, docs)
    gone = exact_dedup(spark, rows, row=ROW).where("not stays").select(F.col("row").alias(ROW))
    return rows.join(gone, ROW, "left_anti").drop(ROW)


@_lean
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: of the least doc_id (null the last), and of rows that share it any.

    Texts without words are in no group and all stay.  All columns stay.  No rows
    give no rows.
    """
    rows = _numbered(spark, docs)
    near = minhash_dedup(spark, rows, key=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    groups = near.groupBy("component_id").count().where("count > 1").select("component_id")
    members = near.join(groups, "component_id").join(rows.select(ROW, F.col("doc_id").alias("key")), ROW)
    stays = members.groupBy("component_id").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", ROW)).alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    gone = members.select(ROW).join(stays, ROW, "left_anti")
    return rows.join(gone, ROW, "left_anti").drop(ROW)


@_lean
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.

    Every row is judged by its own text; null and empty texts contain nothing
    and stay.  All columns stay.  No rows give no rows.
    """
    return decontaminate(spark, docs, _table(spark, sf_dir, "benchmark"))


@_lean
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids and the decoded text of each document that is left, with their digests: one row per row.

    Null texts have no ids.  No rows give no rows.
    """
    return encode_decode(spark, docs, with_ids=True)


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("encode", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = Stages(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stages.keep(stage(spark, docs, sf_dir))
    return stages.keep(STAGES[-1][1](spark, docs, sf_dir))


#: The classifier and the tokenizer cannot be written in SQL.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
