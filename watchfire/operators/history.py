"""What changes over time: versions of rules, and counts that late slices add to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.operators.analytics import upsert_rules

#: Alerts raised before any version of their rule have none; the version that stands is valid without end.
_EVER = (1 << 63) - 1


def import_pack(catalogue: DataFrame, history: DataFrame | None, pack: DataFrame, payload: list[str], at_us: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """An import at a time: (the catalogue after it, the versions after it, created and updated counts in one row).

    history: rule_id, version, payload, valid_from_us, valid_to_us (exclusive). A changed rule's version is closed at at_us and a
    new one opened; other versions stay as they are.
    """
    after = upsert_rules(catalogue, pack, payload)
    changed = after.where("change <> 'same'")
    opened = changed.select("rule_id", "version", *payload, F.lit(at_us).cast("long").alias("valid_from_us"), F.lit(_EVER).alias("valid_to_us"))
    if history is not None:
        ended = history.join(changed.select("rule_id", F.lit(True).alias("ends")), "rule_id", "left")
        closing = F.col("ends") & (F.col("valid_to_us") == _EVER)
        opened = ended.withColumn("valid_to_us", F.when(closing, F.lit(at_us)).otherwise(F.col("valid_to_us"))).drop("ends").unionByName(opened)
    counts = after.agg(F.count_if(F.col("change") == "created").alias("created"), F.count_if(F.col("change") == "updated").alias("updated"))
    return after.drop("change"), opened, counts


def as_of(alerts: DataFrame, history: DataFrame, us: str = "us") -> DataFrame:
    """alerts with the columns of the version of their rule that was valid when they were raised; null before the first. An
    equi-join on the rule with a condition on time: a rule has few versions, and Spark splits the alerts of a rule that has
    very many."""
    versions = history.withColumnRenamed("rule_id", "__rule")
    hit = (F.col("rule_id") == F.col("__rule")) & (F.col(us) >= F.col("valid_from_us")) & (F.col(us) < F.col("valid_to_us"))
    return alerts.join(versions, hit, "left").drop("__rule", "valid_from_us", "valid_to_us")


class HourlyCounts:
    """Counts of events by hour and columns, kept as a table of partial counts, a folder for each slice of events. A slice that
    is given again writes its folder again, so it counts once; late events only add to the hours they belong to."""

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = ("source", "severity")):
        self.spark, self.path, self.by = spark, path, by

    def add(self, events: DataFrame, slice_name: str) -> None:
        """Adds a slice of events: one aggregation of the slice, of what is stored nothing is read."""
        hour = F.expr("us - pmod(us, 3600000000)").alias("hour_us")
        events.groupBy(hour, *self.by).agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{self.path}/slice={slice_name}")

    def read(self) -> DataFrame:
        """hour_us, the columns, n: sums of the partial counts."""
        return self.spark.read.parquet(self.path).groupBy("hour_us", *self.by).agg(F.sum("n").alias("n"))

    def timeline(self, hours: int = 24) -> DataFrame:
        """The newest hours that have events, with their counts."""
        by_hour = self.read().groupBy("hour_us").agg(F.sum("n").alias("n")).orderBy(F.desc("hour_us")).limit(hours)
        return by_hour.select(F.date_format(F.timestamp_micros("hour_us"), "MM-dd HH:00").alias("hour"), "n")

    def events_since(self, us: int) -> DataFrame:
        """One row: events from that time on (rounded down to its hour), and in all; from counts alone."""
        recent = F.when(F.col("hour_us") >= us - us % 3_600_000_000, F.col("n")).otherwise(0)
        return self.read().agg(F.coalesce(F.sum(recent), F.lit(0)).alias("recent"), F.coalesce(F.sum("n"), F.lit(0)).alias("events"))
