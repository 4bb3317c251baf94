"""Sinks of micro-batches (foreachBatch): alerts that are not stored yet, events with rejects. A batch that is given again
after a failure writes the same place again, so each counts once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.sources.normalize import NAMES
from watchfire.storage import exists

Sink = Callable[[DataFrame, int], None]
_KEY = ["rule_id", "entity_key", "event_id"]


def read_alerts(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored alerts with run, batch and day; None before the first ones."""
    return spark.read.parquet(path) if exists(spark, f"{path}/run=*/batch=*/day=*/*") else None


def new_alerts_sink(path: str, run: str) -> Sink:
    """Adds a batch's alerts (rule_id, entity_key, event_id, us and others) to the table at path, save those that it has from
    other batches or runs, and repeats within the batch. run names the checkpoint: a query that starts again from the same
    checkpoint keeps it, one with a new checkpoint takes a new one. The table is by run, batch and day; of what is stored
    only the days of the batch are read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("day", F.to_date(F.timestamp_micros("us"))).persist()
        try:
            first, last = batch.agg(F.min("day"), F.max("day")).first()
            if first is None:
                return
            fresh, stored = batch.dropDuplicates(_KEY), read_alerts(spark, path)
            if stored is not None:
                own = (F.col("run") == run) & (F.col("batch") == batch_id)
                known = stored.where(F.col("day").between(first, last) & ~own).select(*_KEY)
                fresh = fresh.join(known, _KEY, "left_anti")
            fresh.write.mode("overwrite").partitionBy("day").parquet(f"{path}/run={run}/batch={batch_id}")
        finally:
            batch.unpersist()

    return write


def events_and_rejects_sink(path: str, run: str) -> Sink:
    """Writes the lines of sorted_out() as two tables, path/events and path/rejects, from one parse of the batch: together
    they have every line exactly once. run: as in new_alerts_sink()."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            place = f"run={run}/batch={batch_id}"
            batch.where("problem IS NULL").drop("problem", "line").write.mode("overwrite").parquet(f"{path}/events/{place}")
            batch.where("problem IS NOT NULL").drop(*NAMES).write.mode("overwrite").parquet(f"{path}/rejects/{place}")
        finally:
            batch.unpersist()

    return write


def drain(stream: DataFrame, sink: Sink, checkpoint: str) -> None:
    """Runs the stream through the sink on all that its source has now."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
