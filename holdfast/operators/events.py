"""Roll-ups of the event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delta_rollup(events: DataFrame) -> DataFrame:
    """Counts and sums by command, event and stage: what runs of equal events are coalesced to."""
    return events.groupBy("command", "event", "stage").agg(F.count("*").alias("events"), F.sum("count").cast("long").alias("delta"))


def gauge_last(events: DataFrame) -> DataFrame:
    """The last value of each gauge by seq."""
    return events.groupBy("command", "event", "stage").agg(F.max_by("count", "seq").alias("value"), F.max("seq").alias("seq"))


def high_water(events: DataFrame) -> DataFrame:
    return events.groupBy("stage").agg(F.max("count").alias("high_water"), F.count("*").alias("observations"))


def rate(total: Column, elapsed_ms: Column) -> Column:
    """Per second, rounded down; 0 without elapsed time."""
    return F.when(elapsed_ms > 0, F.floor(total * 1000 / elapsed_ms)).otherwise(0).cast("long")


def dashboard(events: DataFrame) -> DataFrame:
    """One row for each command: totals of counting events, last gauges, and the rate over its span."""
    span = F.max("at_ms") - F.min("at_ms")
    return events.groupBy("command").agg(
        F.count("*").alias("events"), F.sum("count").cast("long").alias("total"), F.max_by("count", "seq").alias("last_count"),
        F.max("count").alias("most"), span.cast("long").alias("elapsed_ms"), rate(F.count("*"), span).alias("events_per_second"),
    )


def mount_occupancy(candidates: DataFrame, cap: int = 1) -> DataFrame:
    """Files by mount, and how many of them may be read at once."""
    return candidates.groupBy("mount_id").agg(F.count("*").alias("pending"), F.least(F.count("*"), F.lit(min(cap, 8))).cast("long").alias("active"))


def writer_totals(records: DataFrame, batch_size: int = 32, checkpoint_every: int = 8) -> DataFrame:
    """Batches, records and checkpoints (periodic, and one at the end) of a run of records numbered from 0 in `place`."""
    batches = F.count_distinct(F.floor(F.col("place") / batch_size))
    return records.agg(batches.alias("batches"), F.count("*").alias("records"), (F.floor(batches / checkpoint_every) + 1).cast("long").alias("checkpoints"))


def as_json_lines(events: DataFrame) -> DataFrame:
    """One object a row with schema_version first; absent fields are left out."""
    return events.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), *[c for c in events.columns])).alias("value"))
