"""Versioned snapshots: copy-on-write tables below a store, published by one manifest file."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from holdfast.schemas import BLOBS, SCHEMA_VERSION, SOURCE_FILES


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.mkdtemp(prefix="holdfast-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a written table: computed once, however often it is used."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Catalog:
    """blobs and source_files in versions; readers pin the one the manifest names.

    A new version is written whole and then published by renaming a manifest over the old one, so that a failed or dry run
    leaves nothing that a reader sees.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    @property
    def manifest(self) -> str:
        return os.path.join(self.root, "catalog.json")

    def version(self) -> int | None:
        """The current version; None without a catalog.  Another schema version is an error."""
        try:
            with open(self.manifest) as f:
                found = json.load(f)
        except FileNotFoundError:
            return None
        if found["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"unsupported catalog schema version {found['schema_version']}")
        return found["version"]

    def read(self) -> tuple[DataFrame, DataFrame]:
        v = self.version()
        if v is None:
            return self.spark.createDataFrame([], BLOBS), self.spark.createDataFrame([], SOURCE_FILES)
        folder = os.path.join(self.root, f"v={v}")
        return self.spark.read.schema(BLOBS).parquet(f"{folder}/blobs"), self.spark.read.schema(SOURCE_FILES).parquet(f"{folder}/source_files")

    def publish(self, blobs: DataFrame, source_files: DataFrame) -> int:
        v = (self.version() or 0) + 1
        folder = os.path.join(self.root, f"v={v}")
        blobs.select(*BLOBS.names).write.mode("overwrite").parquet(f"{folder}/blobs")
        source_files.select(*SOURCE_FILES.names).write.mode("overwrite").parquet(f"{folder}/source_files")
        fresh = f"{self.manifest}.{uuid.uuid4().hex}"
        with open(fresh, "w") as f:
            json.dump({"schema_version": SCHEMA_VERSION, "version": v}, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(fresh, self.manifest)
        return v
