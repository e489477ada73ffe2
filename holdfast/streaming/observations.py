"""Observations applied to the catalog micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.imports import upsert_sources
from holdfast.schemas import SOURCE_FILES
from holdfast.sources.snapshots import work_folder


class CatalogSink:
    """foreachBatch target: each micro-batch makes the next version of source_files; a batch that comes again is ignored.

    Version n + 1 is written whole from version n and the batch before it is named in `version`, so that a failed
    batch leaves the catalog as it was.
    """

    def __init__(self, spark: SparkSession, folder: str, start: DataFrame):
        self.spark, self.folder, self.done = spark, folder, -1
        start.write.parquet(f"{folder}/v=0")
        self.version = 0

    def current(self) -> DataFrame:
        return self.spark.read.schema(SOURCE_FILES).parquet(f"{self.folder}/v={self.version}")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.done:
            return
        upsert_sources(self.current(), batch).write.mode("overwrite").parquet(f"{self.folder}/v={self.version + 1}")
        self.version, self.done = self.version + 1, batch_id


def upsert_stream(spark: SparkSession, source: DataFrame, start: DataFrame, name: str = "observations") -> DataFrame:
    """Runs a stream of observations that is there already to its end and returns source_files after it."""
    folder = work_folder(spark, name)
    sink = CatalogSink(spark, f"{folder}/catalog", start)
    source.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    return sink.current()


def upsert_in_batches(spark: SparkSession, start: DataFrame, observations: DataFrame, order: str, batches: int = 3) -> DataFrame:
    """observations as a file stream, in ranges of `order`, one file to a micro-batch."""
    landing = work_folder(spark, "landing")
    for b in range(batches):  # in order: the file source takes older files first
        part = observations.where(F.least(F.col(order), F.lit(batches - 1)) == b)
        part.coalesce(1).write.mode("append").parquet(landing)
    stream = spark.readStream.schema(observations.schema).option("maxFilesPerTrigger", 1).parquet(landing)
    return upsert_stream(spark, stream, start)
