"""The batch operators run continuously: ingest, single-event alerts, incident sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.functions.rules import SEVERITY_WEIGHT, Rule
from watchfire.operators import detect, incidents
from watchfire.sources.normalize import normalise, split_lines


def event_stream(spark: SparkSession, path: str, source_type: str = "auto", default_year: int = 1970, ingest_us: int = 0) -> DataFrame:
    """Normalised events of text files that arrive in path, with the event time as `at`."""
    return normalise(split_lines(spark.readStream.text(path)), source_type, default_year, ingest_us).withColumn("at", F.timestamp_micros("us"))


def alert_stream(events: DataFrame, rules: list[Rule], lateness: str = "1 hour") -> DataFrame:
    """Single-event alerts; a fingerprint that comes again within the watermark is dropped. events: id, at and fields."""
    single = [r for r in rules if r.kind == "single"]
    found = detect.matched_events(events.withWatermark("at", lateness), single).withColumn("entity_key", detect.default_key())
    mark = detect.fingerprint(F.col("rule_id"), F.col("entity_key"), F.col("id"))
    level = F.create_map(*[x for r in single for x in (F.lit(r.id), F.lit(r.level))])
    out = found.select("rule_id", "entity_key", F.col("id").alias("event_id"), "us", "at", F.element_at(level, F.col("rule_id")).alias("severity"), mark.alias("alert_fingerprint"))
    return out.dropDuplicatesWithinWatermark(["alert_fingerprint"])


def incident_stream(alerts: DataFrame, lateness: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions of an entity's alerts with count, rules and score. alerts: entity_key, rule_id, severity, at."""
    weights = [F.max(F.when(F.col("severity") == k, F.lit(v)).otherwise(0)).alias(k) for k, v in SEVERITY_WEIGHT.items()]
    known = F.greatest(*[F.col(k) for k in SEVERITY_WEIGHT])
    n, kinds = F.col("alert_count"), F.size("rules")
    score = F.least(F.lit(100), F.when(known > 0, known).otherwise(50) + F.least(F.lit(15), 3 * (n - 1)) + F.least(F.lit(10), 3 * (kinds - 1)))
    return (
        alerts.withWatermark("at", lateness)
        .groupBy("entity_key", F.session_window("at", gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("alert_count"), F.collect_set("rule_id").alias("rules"), *weights)
        .select("entity_key", F.unix_micros("w.start").alias("session_start"), "alert_count", score.cast("double").alias("risk_score"))
        .withColumn("severity", incidents.severity_of(F.col("risk_score")))
    )
