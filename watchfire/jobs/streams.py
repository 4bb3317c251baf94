"""The streaming jobs as queries: each runs over the given table in slices of time with a short lateness, some rows coming too
late, writes its result as a table and reads that back, so that it can be held against SQL on what came in time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.jobs.security import _E, _NORMALISED, ORACLES, PACK, _lines, alerts
from watchfire.sources.normalize import sorted_out, split_lines
from watchfire.sources.security_events import security_events
from watchfire.storage import new_path, temporary, written
from watchfire.streaming import sinks
from watchfire.streaming.correlation import correlation_stream
from watchfire.streaming.security import alert_stream, event_stream, incident_stream

_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: An event so much later than all others closes whatever is open.
_FAR_US = 400 * 86_400_000_000
#: Rows come in so many slices of equal time, one after another; those of the first two whose id divides by LATE come two slices
#: later, which is beyond the lateness.
SLICES, LATE, LATENESS = 4, 97, "1 hour"


def _folders(spark: SparkSession) -> tuple[str, str]:
    """A source and a result folder, which go when the driver ends, with the checkpoint beside the result."""
    source, out = new_path(spark, "stream-in"), new_path(spark, "stream-out")
    fs = spark._jvm.org.apache.hadoop.fs.Path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    for path in (source, out, f"{out}-state", f"{out}-again"):
        fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
        temporary(spark, path)
    return source, out


def _drained(stream: DataFrame, out: str, mode: str = "append") -> None:
    """Runs the stream on what its source has, adding to the table out."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()


def _arrivals(rows: DataFrame, id_col: str) -> tuple[DataFrame, Column]:
    """rows with the slice that they arrive in."""
    low, high = rows.agg(F.min("us"), F.max("us")).first()
    if low is None:
        return rows.withColumn("arrives", F.lit(0)), F.col("arrives")
    part = F.floor((F.col("us") - low) * SLICES / (high - low + 1))
    return rows.withColumn("arrives", (part + F.when((F.col(id_col) % LATE == 0) & (part < 2), 2).otherwise(0)).cast("int")), F.col("arrives")


def _live(spark: SparkSession, source: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(source).withColumn("at", F.timestamp_micros("us"))


def _in_slices(spark: SparkSession, rows: DataFrame, id_col: str, closing: dict, run: Callable[[DataFrame], None], source: str) -> None:
    """Adds the slices of rows (with us) to the source, one after another, then one more row, changed so that it means nothing
    itself, which is late enough for the watermark to pass all others; run(stream) is called after each."""
    rows = written(rows)
    arriving, arrives = _arrivals(rows, id_col)
    last = rows.orderBy(F.desc("us")).limit(1).withColumn("us", F.col("us") + _FAR_US).withColumns(closing).select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    before = spark.conf.get(*_STORE)
    spark.conf.set(*_STORE)
    try:
        for part in [*(arriving.where(arrives == k).drop("arrives") for k in range(SLICES)), last]:
            part.write.mode("append").parquet(source)
            run(_live(spark, source, rows.schema))
    finally:
        spark.conf.set(_STORE[0], before)


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines that arrive as text files, normalised."""
    source, out = _folders(spark)
    _lines(spark, sf_dir, "suricata").select("line").write.mode("append").text(source)
    _drained(event_stream(spark, source, default_year=2024), out)
    return spark.read.parquet(out).select(*[c for c in _NORMALISED if c != "id"])


def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of two sensors, of which some cannot be read, in two slices: events and rejects by kind, from one pass."""
    source, out = _folders(spark)
    broken = F.regexp_replace("line", '"severity": [^}]+', '"severity": "high"')
    network = _lines(spark, sf_dir, "suricata").withColumn("line", F.when(F.col("id") % 5 == 0, broken).otherwise(F.col("line")))
    lines = network.unionByName(_lines(spark, sf_dir, "nginx"))
    stream = lambda: sorted_out(split_lines(spark.readStream.text(source)), default_year=2024)
    for half in (0, 1):
        lines.where(F.col("id") % 2 == half).select("line").write.mode("append").text(source)
        sinks.drain(stream(), sinks.events_and_rejects_sink(out, "first"), f"{out}-state")
    events, rejects = spark.read.parquet(f"{out}/events"), spark.read.parquet(f"{out}/rejects")
    kinds = events.select(F.lit("event").alias("kind"), F.concat_ws(" ", "source", "event_type").alias("what")).unionByName(rejects.select(F.lit("reject").alias("kind"), F.col("problem").alias("what")))
    return kinds.groupBy("kind", "what").agg(F.count(F.lit(1)).alias("n"))


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = security_events(spark, sf_dir)
    return events.unionByName(events.where("id % 3 = 0"))


def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-event alerts of a stream in which a third of the events come twice."""
    source, out = _folders(spark)
    _in_slices(spark, _repeated(spark, sf_dir), "id", {"source": F.lit("none"), "event_type": F.lit("none")}, lambda live: _drained(alert_stream(live, PACK, LATENESS), out), source)
    return spark.read.parquet(out).select("rule_id", "entity_key", "event_id", "us")


def stream_alerts_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same into a table of alerts; then a second query with a new checkpoint starts from the beginning: it adds what came
    too late for the first one, and nothing twice."""
    source, out = _folders(spark)
    closing = {"source": F.lit("none"), "event_type": F.lit("none")}
    _in_slices(spark, _repeated(spark, sf_dir), "id", closing, lambda live: sinks.drain(alert_stream(live, PACK, LATENESS), sinks.new_alerts_sink(out, "first"), f"{out}-state"), source)
    schema = spark.read.parquet(source).schema
    sinks.drain(alert_stream(_live(spark, source, schema), PACK, LATENESS), sinks.new_alerts_sink(out, "second"), f"{out}-again")
    return sinks.read_alerts(spark, out).select("rule_id", "entity_key", "event_id", "us", "run")


def stream_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and sequence alerts of a stream."""
    source, out = _folders(spark)
    _in_slices(spark, security_events(spark, sf_dir), "id", {"event_type": F.lit("none")}, lambda live: _drained(correlation_stream(live, PACK, LATENESS), out), source)
    return spark.read.parquet(out).select("rule_id", "entity_key", "event_id", "us")


def stream_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident sessions of a stream of alerts."""
    source, out = _folders(spark)
    given = alerts(spark, sf_dir).select("rule_id", "entity_key", "event_id", "us", "severity")
    _in_slices(spark, given, "event_id", {"entity_key": F.lit("none")}, lambda live: _drained(incident_stream(live, LATENESS), out), source)
    return spark.read.parquet(out).select("entity_key", "session_start", "alert_count", "risk_score", "severity")


STREAM_QUERIES = {f.__name__: f for f in (stream_events, stream_rejects, stream_alerts, stream_alerts_stored, stream_correlation, stream_incidents)}

_LATE = lambda id_col: f"{id_col} % {LATE} = 0 AND floor((us - low) * CAST({SLICES} AS DOUBLE) / (high - low + 1)) < 2"
_E_IN_TIME = f"e0 AS ({_E.removeprefix('e AS (')}, el AS (SELECT min(us) AS low, max(us) AS high FROM e0), e AS (SELECT e0.* FROM e0, el WHERE NOT ({_LATE("id")}))"
_A_END = "a AS (SELECT * FROM a0 JOIN m USING (rule_id))"
_A_IN_TIME = f"a1 AS (SELECT * FROM a0 JOIN m USING (rule_id)), al AS (SELECT min(us) AS low, max(us) AS high FROM a1), a AS (SELECT a1.* FROM a1, al WHERE NOT ({_LATE("event_id")}))"
assert _E in ORACLES["alerts_single"] and _A_END in ORACLES["incidents"]
#: The SQL of the batch twins on what came in time.
STREAM_ORACLES = {
    "stream_events": f"SELECT * EXCLUDE (id) FROM ({ORACLES['normalize_suricata']})",
    "stream_rejects": f"""WITH n AS ({ORACLES['normalize_suricata']}), x AS (SELECT * FROM ({ORACLES['normalize_nginx']})), r AS ({ORACLES['normalize_rejects']}), {_E}
        SELECT 'event' AS kind, source || ' ' || event_type AS what, count(*) AS n FROM (SELECT * FROM n WHERE id NOT IN (SELECT id FROM r) UNION ALL SELECT * FROM x) GROUP BY ALL
        UNION ALL SELECT 'reject', problem, count(*) FROM r GROUP BY ALL
        UNION ALL SELECT 'reject', 'no parser reads the line', count(*) FROM e WHERE source = 'nginx' AND id NOT IN (SELECT id FROM x) HAVING count(*) > 0""",
    "stream_alerts": ORACLES["alerts_single"].replace(_E, _E_IN_TIME),
    "stream_alerts_stored": f"""WITH late AS ({ORACLES['alerts_single'].replace(_E, _E_IN_TIME)}) SELECT f.*, CASE WHEN l.event_id IS NULL THEN 'second' ELSE 'first' END AS run
        FROM ({ORACLES['alerts_single']}) f LEFT JOIN late l ON l.rule_id = f.rule_id AND l.event_id = f.event_id""",
    "stream_correlation": f"({ORACLES['alerts_count'].replace(_E, _E_IN_TIME)}) UNION ALL ({ORACLES['alerts_sequence'].replace(_E, _E_IN_TIME)})",
    "stream_incidents": f"SELECT entity_key, session_start, alert_count, risk_score, severity FROM ({ORACLES['incidents'].replace(_A_END, _A_IN_TIME)})",
}
