"""The table of stored events: ids given at the write, gapless over batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchfire.sources.normalize import stored_events
from watchfire.storage import exists, written

_COMMITS = "first_id long, n long, batch string"


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, first_id, n) of every batch that is whole."""
    return spark.read.schema(_COMMITS).parquet(f"{path}/commits") if exists(spark, f"{path}/commits/batch=*/*.parquet") else spark.createDataFrame([], _COMMITS)


def append_events(events: DataFrame, path: str, batch: str, ingest_us: int) -> tuple[int, int]:
    """Adds events to the table as the batch of that name; gives its first id and its number of events.

    Rows are written once with their place in their partition; partitions' numbers of rows, summed in order, give each its
    first id, from the highest id that is committed. So ids rise without gaps, with no shuffle and no counter. A batch that is
    committed is not added again; one that failed before its commit writes the same folder again, from the same
    high-water mark. Ids that events bring are kept as given_id. One writer at a time.
    """
    spark = events.sparkSession
    done = commits(spark, path).where(F.col("batch") == batch).collect()
    if done:
        return done[0].first_id, done[0].n
    given = F.col("id").cast("string") if "id" in events.columns else F.lit(None).cast("string")
    place = F.monotonically_increasing_id()
    placed = written(events.withColumn("given_id", given).drop("id").withColumn("place", place))
    part, within = F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    high = commits(spark, path).agg(F.coalesce(F.max(F.col("first_id") + F.col("n") - 1), F.lit(0))).first()[0]
    # One row for each partition of the write.
    sizes = placed.groupBy(part).agg(F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", (before + high + 1).alias("start"))
    rows = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("id", F.col("start") + within).drop("part", "start", "place")
    folder = f"{path}/events/batch={batch}"
    stored_events(rows, ingest_us).withColumn("event_date", F.to_date(F.timestamp_micros("us"))).write.mode("overwrite").partitionBy("event_date").parquet(folder)
    n = placed.count()
    spark.createDataFrame([(high + 1, n)], "first_id long, n long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch}")
    return high + 1, n


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events of committed batches, with batch and event_date."""
    whole = [r.batch for r in commits(spark, path).where("n > 0").select("batch").collect()]  # a name a batch
    if not whole:
        raise ValueError(f"no batch is committed in {path}")
    return spark.read.option("basePath", f"{path}/events").parquet(*[f"{path}/events/batch={b}" for b in whole])
