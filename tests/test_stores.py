import pytest
from pyspark.sql import functions as F

from tests.test_rules import spec
from watchfire.functions.rules import checked_rules, parse_rule, read_rule_texts
from watchfire.operators.history import HourlyCounts, as_of, import_pack
from watchfire.sources import store
from watchfire.sources.normalize import sorted_out
from watchfire.storage import written
from watchfire.streaming import sinks

HOUR = 3_600_000_000


def some(spark, n, start=0):
    return spark.range(start, start + n).select("id", (F.col("id") * HOUR).alias("us"), *[F.lit(None).cast("string").alias(c) for c in ("source", "event_type", "severity", "message", "raw_data")])


def test_ids_are_dense_over_retried_batches(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    assert store.append_events(some(spark, 50).repartition(4), path, "a", 0) == (1, 50)
    # The second batch fails after its events and before its commit.
    real = spark.createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: (_ for _ in ()).throw(RuntimeError("lost")) if data and data[0] == (51, 30) else real(data, *a, **k))
    with pytest.raises(RuntimeError):
        store.append_events(some(spark, 30, 1000).repartition(3), path, "b", 0)
    monkeypatch.undo()
    assert store.read_events(spark, path).count() == 50
    assert store.append_events(some(spark, 30, 1000).repartition(7), path, "b", 0) == (51, 30)
    assert store.append_events(some(spark, 50), path, "a", 0) == (1, 50)  # committed: not added again
    assert store.append_events(some(spark, 0), path, "empty", 0) == (81, 0)
    assert store.append_events(some(spark, 5), path, "c", 0) == (81, 5)
    rows = store.read_events(spark, path).collect()
    assert sorted(r.id for r in rows) == list(range(1, 86))
    assert sorted(int(r.given_id) for r in rows if r.batch == "b") == list(range(1000, 1030))
    assert {(r.source, r.event_type, r.severity, r.message, r.raw_data) for r in rows} == {("generic", "generic_event", "info", "", "{}")}


def test_reading_needs_a_committed_batch(spark, tmp_path):
    with pytest.raises(ValueError):
        store.read_events(spark, str(tmp_path / "none"))


def test_versions_as_of(spark):
    pack = lambda *rows: spark.createDataFrame(rows, "rule_id string, title string")
    none = spark.createDataFrame([], "rule_id string, title string, version int, enabled boolean")
    catalogue, history, counts = import_pack(none, None, pack(("A", "a1"), ("B", "b1")), ["title"], 100)
    assert tuple(counts.first()) == (2, 0)
    catalogue, history, counts = import_pack(written(catalogue), written(history), pack(("A", "a2"), ("C", "c1")), ["title"], 200)
    assert tuple(counts.first()) == (1, 1)
    catalogue, history, counts = import_pack(written(catalogue), written(history), pack(("A", "a2"), ("B", "b1")), ["title"], 300)
    assert tuple(counts.first()) == (0, 0)
    assert sorted(map(tuple, catalogue.collect())) == [("A", "a2", 2, True), ("B", "b1", 1, True), ("C", "c1", 1, True)]
    alerts = spark.createDataFrame([("A", 99), ("A", 100), ("A", 199), ("A", 200), ("A", 999), ("B", 250), ("C", 150), ("X", 5)], "rule_id string, us long")
    got = sorted((r.rule_id, r.us, r.version, r.title) for r in as_of(alerts, history).collect())
    assert got == [("A", 99, None, None), ("A", 100, 1, "a1"), ("A", 199, 1, "a1"), ("A", 200, 2, "a2"), ("A", 999, 2, "a2"), ("B", 250, 1, "b1"), ("C", 150, None, None), ("X", 5, None, None)]


def test_hourly_counts_of_late_slices(spark, tmp_path):
    counts = HourlyCounts(spark, str(tmp_path / "h"), by=("source",))
    events = spark.createDataFrame([(h * HOUR + k, "ab"[k % 2]) for h in range(-2, 30) for k in range(h % 4 + 1)], "us long, source string")
    for name, part in (("1", "us % 3 = 0"), ("2", "us % 3 <> 0"), ("1", "us % 3 = 0")):
        counts.add(events.where(part), name)
    want = events.groupBy(F.expr("us - pmod(us, 3600000000)").alias("hour_us"), "source").count()
    assert sorted(map(tuple, counts.read().collect())) == sorted(map(tuple, want.collect()))
    assert counts.timeline(24).count() == 24
    assert tuple(counts.events_since(29 * HOUR + 5).first()) == (2, events.count())


def test_alert_sink_counts_a_batch_once(spark, tmp_path):
    path = str(tmp_path / "alerts")
    batch = lambda *rows: spark.createDataFrame(rows, "rule_id string, entity_key string, event_id long, us long")
    first, second = sinks.new_alerts_sink(path, "r1"), sinks.new_alerts_sink(path, "r2")
    first(batch(("A", "e", 1, 10), ("A", "e", 1, 10), ("A", "e", 2, 20)), 0)
    first(batch(("A", "e", 2, 20), ("A", "e", 3, 24 * HOUR)), 1)
    first(batch(("A", "e", 2, 20), ("A", "e", 3, 24 * HOUR)), 1)  # given again
    second(batch(("A", "e", 3, 24 * HOUR), ("A", "f", 3, 24 * HOUR)), 0)
    second(batch(), 1)
    got = sorted((r.entity_key, r.event_id, r.run, r.batch) for r in sinks.read_alerts(spark, path).collect())
    assert got == [("e", 1, "r1", 0), ("e", 2, "r1", 0), ("e", 3, "r1", 1), ("f", 3, "r2", 0)]


def test_events_and_rejects_are_all_lines(spark, tmp_path):
    lines = ['{"event_type": "alert", "src_ip": "1.1.1.1", "alert": {"severity": "high"}}', '{"message": "x"}', "nobody reads this", "{broken", "Mar  4 08:00:00 b sshd[1]: Failed password for a from 1.1.1.1 port 2 ssh2"]
    sink = sinks.events_and_rejects_sink(str(tmp_path), "r")
    batch = sorted_out(spark.createDataFrame([(x,) for x in lines], "line string"))
    for _ in range(2):
        sink(batch, 0)
    events, rejects = spark.read.parquet(str(tmp_path / "events")), spark.read.parquet(str(tmp_path / "rejects"))
    assert events.count() == 2 and sorted(r.line for r in rejects.collect()) == sorted([lines[0], lines[2], lines[3]])
    assert {r.problem for r in rejects.collect()} == {"alert severity is no number", "no parser reads the line"}


def test_packs_as_tables(spark, tmp_path):
    good = "id: ABC-1\ntitle: t\nlevel: high\nlogsource: {category: x}\ntags: [attack.t1110]\ndetection:\n  s: {'a|RE': b}\n  condition: s\n"
    (tmp_path / "sub").mkdir()
    for name, text in {"a.yml": good, "sub/b.yaml": good.replace("high", "huge"), "sub/c.yml": "id: [", "d.txt": good}.items():
        (tmp_path / name).write_text(text)
    got = {r.file.rsplit("/", 1)[1]: r for r in checked_rules(read_rule_texts(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.yml", "b.yaml", "c.yml"}
    a = got["a.yml"]
    assert (a.rule_id, a.level, a.technique, a.tactic, a.problem, len(a.warnings)) == ("ABC-1", "high", "T1110", "Credential Access", None, 1)
    assert got["b.yaml"].rule_id is None and "level" in got["b.yaml"].problem and "YAML" in got["c.yml"].problem


def test_all_problems_are_named_at_once():
    with pytest.raises(ValueError) as e:
        parse_rule(spec({"s": {"a|near": 1}, "condition": " "}, id="?", level="severe", tags=[1]))
    assert all(x in str(e.value) for x in ("rule.id", "rule.level", "rule.tags[0]", "rule.detection.condition", "a|near"))
    assert parse_rule(spec({"s": {"a|RE": 1}, "condition": "s"})).warnings and not parse_rule(spec({"s": {"a|re": 1}, "condition": "s"})).warnings
