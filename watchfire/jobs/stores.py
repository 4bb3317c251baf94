"""Queries of what is kept over time (stored events, rule versions, partial counts), of rule packs as tables and of fixtures, and
their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.functions.rules import checked_rules, parse_pack
from watchfire.jobs.security import _A, _E, _NORMALISED, PACK, _lines, stored_alerts
from watchfire.jobs.security import ORACLES as SECURITY
from watchfire.operators import analytics, detect, fixtures
from watchfire.operators.history import HourlyCounts, as_of, import_pack
from watchfire.sources import normalize, store
from watchfire.sources.security_events import security_events
from watchfire.storage import new_path, temporary, written

_DAY = 86_400_000_000


def _folder(spark: SparkSession, stem: str) -> str:
    path = new_path(spark, stem)
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(spark._jvm.org.apache.hadoop.fs.Path(path))
    return temporary(spark, path)


def event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches of events go to the table of stored events: the second fails before its commit and is given again, the
    first is given twice. What ids each batch has."""
    path, events = _folder(spark, "events"), security_events(spark, sf_dir)
    parts = {name: events.where(F.col("id") % 3 == k) for k, name in enumerate(("first", "second", "third"))}
    store.append_events(parts["first"], path, "first", 0)
    parts["second"].limit(5).withColumns({"event_date": F.current_date(), "id": F.lit(1)}).write.partitionBy("event_date").parquet(f"{path}/events/batch=second")
    for name in ("second", "first", "third"):
        store.append_events(parts[name], path, name, 0)
    found = store.read_events(spark, path)
    return found.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.sum(F.col("given_id").cast("long")).alias("given"),
        F.count_distinct("event_date").alias("days"),
    )


def _middle(events: DataFrame) -> int:
    """The second half of the time of events begins here; a number."""
    return events.agg(F.expr("(min(us) + max(us)) DIV 2")).first()[0] or 0


def alert_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with the version of their rule that was valid when they were raised. The pack is imported before all events, and
    again in the middle of their time, when two rules have changed."""
    found, middle = stored_alerts(spark, sf_dir), _middle(security_events(spark, sf_dir))
    table = analytics.rule_table(spark, PACK).select("rule_id", "title", "level")
    none = table.where("false").select("*", F.lit(1).alias("version"), F.lit(True).alias("enabled"))
    catalogue, history, _ = import_pack(none, None, table, ["title", "level"], 0)
    renamed = table.withColumn("title", F.when(F.col("rule_id").isin("WF-001", "WF-010"), F.upper("title")).otherwise(F.col("title")))
    _, history, _ = import_pack(written(catalogue), written(history), renamed, ["title", "level"], middle)
    return as_of(found.select("rule_id", "event_id", "us"), history).select("rule_id", "event_id", "version", "title")


def pack_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import of the parts as rules creates and updates, and the versions that follow."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_brand").alias("title"), F.col("p_partkey").alias("k"))
    none = p.where("false").select("rule_id", "title", F.lit(1).alias("version"), F.lit(True).alias("enabled"))
    catalogue, history, one = import_pack(none, None, p.where("k % 5 <> 0").select("rule_id", "title"), ["title"], 10)
    again = p.where("k % 3 = 0").select("rule_id", F.when(F.col("k") % 2 == 0, F.lit("new")).otherwise(F.col("title")).alias("title"))
    _, history, two = import_pack(written(catalogue), written(history), again, ["title"], 20)
    counts = one.withColumn("at", F.lit(10)).unionByName(two.withColumn("at", F.lit(20)))
    kept = history.groupBy(F.col("valid_from_us").cast("int").alias("at")).agg(F.count(F.lit(1)).alias("opened"), F.count_if(F.col("valid_to_us") == 20).alias("closed"))
    return counts.join(kept, "at")


def _slices(spark: SparkSession, sf_dir: str) -> HourlyCounts:
    """Hourly counts after three slices, the second late for the hours of the first and given twice."""
    counts, events = HourlyCounts(spark, _folder(spark, "hours")), security_events(spark, sf_dir)
    for name, k in (("a", 0), ("b", 1), ("b", 1), ("c", 2)):
        counts.add(events.where(F.col("id") % 3 == k), name)
    return counts


def timeline_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _slices(spark, sf_dir).timeline()


def dashboard_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last two whole days of the table, and in all, by hourly counts."""
    return _slices(spark, sf_dir).events_since(1_706_600_000_000_000)


def alerts_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of which a third come again with the same id, an hour earlier or later, some with another type: of an id its
    first event counts."""
    e = security_events(spark, sf_dir)
    shift = F.when(F.col("id") % 2 == 0, 3_600_000_000).otherwise(-3_600_000_000)
    again = e.where("id % 3 = 0").withColumns({"us": F.col("us") + shift, "event_type": F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("event_type"))})
    return detect.all_alerts(e.unionByName(again), PACK).select("rule_id", "entity_key", "event_id", "us")


def _yaml(part: DataFrame) -> Column:
    """Each part as the YAML text of a rule; some have a bad id, a level that is none, a condition that breaks off, no
    detection, or a modifier in capitals."""
    k, line = F.col("p_partkey"), lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x], F.lit("\n"))
    return F.concat(
        line("id: ", F.when(k % 11 == 0, F.lit("P?")).otherwise(F.concat(F.lit("PART-"), k.cast("string")))),
        line('title: "', F.col("p_brand"), '"'), line("level: ", F.when(k % 13 == 0, "severe").when(k % 2 == 0, "high").otherwise("low")), line("logsource: {category: part}"),
        F.when(k % 4 == 0, line("mitre: {technique: t1110}")).otherwise(F.lit("")), F.when(k % 3 == 0, line("tags: [attack.t1059.001, attack.T1110, other]")).otherwise(F.lit("")),
        F.when(k % 19 == 0, F.lit("")).otherwise(F.concat(
            line("detection:"), line("  s: {source: x, ", F.when(k % 7 == 0, F.lit("message|CONTAINS")).otherwise(F.lit("message|contains")), ": y}"),
            line("  condition: ", F.when(k % 17 == 0, F.lit("s and")).otherwise(F.lit("s"))),
        )),
    )


def pack_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as rule files in a folder, read, checked and mapped to techniques."""
    path = _folder(spark, "pack")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    parts.select(F.to_json(F.struct(F.col("p_partkey").alias("k"), _yaml(parts).alias("t"))).alias("value")).write.mode("overwrite").text(f"{path}/lines")
    texts = spark.read.schema("k long, t string").json(f"{path}/lines").withColumnRenamed("t", "yaml_content")
    return _checked(texts.select("k", "yaml_content"))


def _checked(texts: DataFrame) -> DataFrame:
    found = checked_rules(texts)
    return found.select("k", F.col("problem").isNull().alias("valid"), "rule_id", "level", F.array_join("techniques", ",").alias("techniques"), "tactic", F.size("warnings").cast("long").alias("warnings"))


def pack_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations as rule files, a file each below a folder, read as a table and checked."""
    path = _folder(spark, "files")
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("p_partkey"), F.col("n_name").alias("p_brand"))
    text = nations.select(_yaml(nations).alias("value"), F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("n"))
    text.repartition(1).write.mode("overwrite").partitionBy("n").option("lineSep", "\n").text(f"{path}/txt")
    # Spark names its text files itself; their folder says which rule they are.
    read = spark.read.option("recursiveFileLookup", True).text(f"{path}/txt", wholetext=True).select("value", F.regexp_extract("_metadata.file_path", r"n=n(\d+)", 1).cast("long").alias("k"))
    return _checked(read.select("k", F.col("value").alias("yaml_content")))


def _fixture_rules(spark: SparkSession, sf_dir: str):
    """A rule for each nation (25 in every table) with fixtures: one single, one or two in groups, some of them wrong."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()
    specs = []
    for key, name, region in rows:
        event = {"id": f"e{key}", "source": name, "raw_data": {"region": region}}
        specs.append({
            "id": f"NAT-{key:02d}", "title": name, "level": "low", "logsource": {"category": "nation"},
            "detection": {"s": {"source": name.lower(), "region|gte": region}, "condition": "s"}, "test": {"name": "own", "event": event},
            "tests": {"positive": [{"name": "higher", "event": event | {"raw_data": {"region": region + 1 - 2 * (key % 5 == 0)}}}], "negative": [event | {"source": "elsewhere" if key % 4 else name}]},
        })
    return parse_pack(specs)


def fixture_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.run_fixtures(spark, _fixture_rules(spark, sf_dir))


def fixture_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = fixtures.fixture_summary(fixture_results(spark, sf_dir))
    return row.select("fixtures", "passed", "failed", *[F.size(c).cast("long").alias(c) for c in ("matched_event_ids", "missed_positives", "unexpected_matches")])


def fixture_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history of two runs: passes by test."""
    path, results = _folder(spark, "history"), fixture_results(spark, sf_dir)
    for k in (1, 2):
        fixtures.write_history(results, path, k, 1.5)
    return spark.read.parquet(path).groupBy("rule_id", "test_name").agg(F.count(F.lit(1)).alias("runs"), F.count_if("passed").alias("passed"), F.max(F.unix_micros("created_at")).alias("newest"))


def _as_array(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a partition as the lines of one JSON array."""
    text, held = (lambda x: pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["value"])), ["["]
    first = True
    for b in batches:
        items = [x for x in b.column("line").to_pylist()]
        for x in items:
            held.append(x if first else f",{x}")
            first = False
        yield text(held)
        held = []
    yield text([*held, "]"])


def ingest_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written out as files that are one JSON array each, and read in byte ranges."""
    path = _folder(spark, "arrays")
    _lines(spark, sf_dir, "generic").select("line").mapInArrow(_as_array, "value string").write.mode("overwrite").text(path)
    return normalize.ingest(spark, path, "json", documents=True, default_year=2024).select(*[c for c in _NORMALISED if c != "id"])


QUERIES = {f.__name__: f for f in (ingest_arrays, event_store, alert_versions, pack_import, timeline_rollup, dashboard_rollup, alerts_repeats, pack_check, pack_files, fixture_results, fixture_summary, fixture_history)}

_CHECK = lambda k, source: f"""SELECT k, valid, CASE WHEN valid THEN 'PART-' || k END AS rule_id, CASE WHEN valid THEN CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END END AS level,
        CASE WHEN valid THEN CASE WHEN k % 4 = 0 AND k % 3 = 0 THEN 'T1110,T1059.001' WHEN k % 4 = 0 THEN 'T1110' WHEN k % 3 = 0 THEN 'T1059.001,T1110' ELSE '' END END AS techniques,
        CASE WHEN valid THEN CASE WHEN k % 4 = 0 THEN 'Credential Access' WHEN k % 3 = 0 THEN 'Execution' ELSE 'Unmapped' END END AS tactic, CASE WHEN valid THEN CAST(k % 7 = 0 AS BIGINT) END AS warnings
    FROM (SELECT CAST({k} AS BIGINT) AS k, {k} % 11 <> 0 AND {k} % 13 <> 0 AND {k} % 17 <> 0 AND {k} % 19 <> 0 AS valid FROM {source})"""  # noqa: E731
_FIX = """f AS (SELECT n_nationkey AS k, 'own' AS name, true AS expected, true AS actual FROM nation UNION ALL SELECT n_nationkey, 'higher', true, n_nationkey % 5 <> 0 FROM nation
    UNION ALL SELECT n_nationkey, 'negative 1', false, n_nationkey % 4 = 0 FROM nation)"""
_E_FIRST = f"""e0 AS ({_E.removeprefix('e AS (')}, e1 AS (SELECT * FROM e0 UNION ALL SELECT * REPLACE (us + CASE WHEN id % 2 = 0 THEN 3600000000 ELSE -3600000000 END AS us,
    CASE WHEN id % 5 = 0 THEN 'other' ELSE event_type END AS event_type) FROM e0 WHERE id % 3 = 0), e AS (SELECT * FROM e1 QUALIFY row_number() OVER (PARTITION BY id ORDER BY us) = 1)"""
ORACLES = {
    "ingest_arrays": f"SELECT * EXCLUDE (id) FROM ({SECURITY['normalize_generic']})",
    "event_store": f"""WITH {_E}, b AS (SELECT *, ['first', 'second', 'third'][1 + id % 3] AS batch FROM e),
        s AS (SELECT batch, count(*) AS n, CAST(sum(id) AS BIGINT) AS given, count(DISTINCT us // {_DAY}) AS days, CASE batch WHEN 'first' THEN 1 WHEN 'second' THEN 2 ELSE 3 END AS place FROM b GROUP BY ALL)
        SELECT batch, n, n AS ids, CAST(coalesce(sum(n) OVER w, 0) + 1 AS BIGINT) AS first_id, CAST(coalesce(sum(n) OVER w, 0) + n AS BIGINT) AS last_id, given, days
        FROM s WINDOW w AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "alert_versions": f"""WITH {_A}, t AS (SELECT (min(us) + max(us)) // 2 AS middle FROM e) SELECT rule_id, event_id, CASE WHEN late THEN 2 ELSE 1 END AS version, CASE WHEN late THEN upper(title) ELSE title END AS title
        FROM (SELECT *, us >= middle AND rule_id IN ('WF-001', 'WF-010') AS late FROM a, t)""",
    "pack_import": """WITH p AS (SELECT p_partkey AS k, p_brand AS title FROM part), n AS (SELECT count(*) FILTER (k % 5 <> 0) AS one, count(*) FILTER (k % 5 = 0 AND k % 3 = 0) AS two,
            count(*) FILTER (k % 5 <> 0 AND k % 6 = 0 AND title <> 'new') AS changed FROM p)
        SELECT 10 AS at, one AS created, CAST(0 AS BIGINT) AS updated, one AS opened, changed AS closed FROM n UNION ALL SELECT 20, two, changed, two + changed, 0 FROM n""",
    "timeline_rollup": SECURITY["timeline"],
    "dashboard_rollup": f"WITH {_E} SELECT count(*) FILTER (us >= 1706600000000000 - 1706600000000000 % 3600000000) AS recent, count(*) AS events FROM e",
    "alerts_repeats": SECURITY["alerts_all"].replace(_E, _E_FIRST).replace("SELECT rule_id, entity_key, event_id, us, title, severity, risk_score,", "SELECT rule_id, entity_key, event_id, us FROM (SELECT *,") + ")",
    "pack_check": _CHECK("p_partkey", "part"),
    "pack_files": _CHECK("n_nationkey", "nation"),
    "fixture_results": f"WITH {_FIX} SELECT 'NAT-' || lpad(CAST(k AS VARCHAR), 2, '0') AS rule_id, name, expected, actual, expected = actual AS passed, 'e' || k AS event_id FROM f",
    "fixture_summary": f"""WITH {_FIX} SELECT count(*) AS fixtures, count(*) FILTER (expected = actual) AS passed, count(*) FILTER (expected <> actual) AS failed, count(*) FILTER (actual) AS matched_event_ids,
        count(*) FILTER (expected AND NOT actual) AS missed_positives, count(*) FILTER (actual AND NOT expected) AS unexpected_matches FROM f""",
    "fixture_history": f"""WITH {_FIX} SELECT 'NAT-' || lpad(CAST(k AS VARCHAR), 2, '0') AS rule_id, name AS test_name, CAST(2 AS BIGINT) AS runs, CASE WHEN expected = actual THEN CAST(2 AS BIGINT) ELSE 0 END AS passed,
        CAST(2 AS BIGINT) AS newest FROM f""",
}
