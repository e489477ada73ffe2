"""Fixed schemas of the durable relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCHEMA_VERSION = 1

BLOBS = T.StructType([T.StructField("hash", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("size_bytes", "created_at_ms", "deleted_at_ms")]])

SOURCE_FILES = T.StructType(
    [T.StructField("id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("source_root", "relative_path", "blob_hash")]
    + [T.StructField(c, T.LongType()) for c in ("size_bytes", "modified_at_ms", "first_seen_at_ms", "last_seen_at_ms", "seen_count")]
)


def columns_of(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """A schema as rows (object, definition)."""
    return spark.createDataFrame([(f"{table}.{f.name}", f.dataType.simpleString()) for f in schema.fields], "object string, definition string")
