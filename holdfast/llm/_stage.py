"""Cutting lineage with written tables, and connected components over them."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SOME_MEGABYTES = "8m"


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset, in local mode only, a new temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local*")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="holdfast-")
    return _own[app]


def small_batches(spark: SparkSession) -> None:
    """From now on queries of the session give Python batches of some megabytes: for results that the caller writes."""
    spark.conf.set(_BATCH, _SOME_MEGABYTES)


class Stages:
    """Tables that an operator writes between its steps, so that a lost executor costs one step.

    keep(df) writes df as Parquet in the shared folder and reads it back;
    drop(df...) removes such tables once nothing reads them any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        self.count = 0

    @contextlib.contextmanager
    def clean(self) -> Iterator[None]:
        """Queries that run meanwhile remove their shuffle files when they end, and give Python batches of some megabytes."""
        wanted = {_CLEANUP: "true", _BATCH: _SOME_MEGABYTES}
        was = {name: self.spark.conf.get(name) for name in wanted}
        for name, value in wanted.items():
            self.spark.conf.set(name, value)
        try:
            yield
        finally:
            for name, value in was.items():
                self.spark.conf.set(name, value)

    def keep(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        with self.clean():
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm = self.spark._jvm
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(df)))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Held:
    """One table that a task's process keeps for the next task of the same step; the last step's goes before another is made."""

    def __init__(self):
        self.name, self.value = None, None

    def get(self, name: str, make: Callable[[], Any]) -> Any:
        if self.name != name:
            self.name = self.value = None
            self.value = make()
            self.name = name
        return self.value


def components(stages: Stages, edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b): a row (node, root) for each node, root its least node.

    Alternating large-star and small-star steps over pairs (v, m) with m < v.
    The large star hangs v under the least neighbour of m: a grouped minimum with
    map-side combining, and a join that splits a hot m.  The small star hangs v
    and its lesser neighbours under the least of these.  About log(n) rounds of
    three shuffles, each written to a table.
    """
    pairs = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v <> m")
    star = stages.keep(pairs.distinct())
    changed = not star.isEmpty()
    while changed:
        low = star.groupBy("v").agg(F.min("m").alias("r")).select(F.col("v").alias("m"), "r")
        large = star.join(low, "m", "left").select("v", F.coalesce("r", "m").alias("m"), F.col("r").isNotNull().alias("moved"))
        down = large.repartition("v").groupBy("v", "m").agg(F.max("moved").alias("moved"))
        least = down.withColumn("r", F.min("m").over(Window.partitionBy("v"))).withColumn("moved", F.col("moved") | (F.col("m") != F.col("r")))
        both = least.select(F.explode(F.array(F.struct("v", F.col("r").alias("m"), "moved"), F.struct(F.col("m").alias("v"), F.col("r").alias("m"), "moved"))).alias("x")).select("x.*").where("v <> m")
        seen = Observation()
        after = stages.keep(both.observe(seen, F.max(F.col("moved").cast("int")).alias("moved")).select("v", "m"))
        stages.drop(star)
        star, changed = after, bool(seen.get["moved"])
    star = star.distinct()
    return stages.keep(star.select(F.col("v").alias("node"), F.col("m").alias("root")).unionByName(star.select(F.col("m").alias("node"), F.col("m").alias("root"))).distinct())
