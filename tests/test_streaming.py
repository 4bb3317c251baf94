import json
import random

import pytest

from pyspark.sql import functions as F

from tests.test_rules import SCHEMA, spec
from watchfire.functions.rules import parse_pack
from watchfire.operators import detect, incidents
from watchfire.sources.normalize import normalise
from watchfire.streaming.correlation import correlation_stream
from watchfire.streaming.security import alert_stream, event_stream, incident_stream


RULES = parse_pack([spec({"s": {"severity": "high"}, "condition": "s"}, level="high")])


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [json.dumps({"timestamp": f"2024-01-01T00:{m:02d}:00", "severity": "HIGH" if m % 2 else "low", "hostname": f"h{m % 3}", "message": str(m)}) for m in range(40)]
    (source / "a.txt").write_text("\n".join(lines + lines[:3]))
    keyed = lambda e: e.withColumn("id", F.col("message").cast("long")).withColumn("at", F.timestamp_micros("us"))
    got = drain(alert_stream(keyed(event_stream(spark, str(source))), RULES), "alerts").collect()
    batch = keyed(normalise(spark.read.text(str(source)).select(F.col("value").alias("line")))).dropDuplicates(["id"])
    want = detect.single_alerts(batch, RULES).collect()
    assert sorted((r.rule_id, r.entity_key, r.event_id) for r in got) == sorted((r.rule_id, r.entity_key, r.event_id) for r in want)
    schema = "rule_id string, entity_key string, event_id long, us long, severity string"
    rows = [("A", "e", i, i * 20 * 60_000_000, "high") for i in range(3)] + [("B", "e", 9, 10 * 3_600_000_000, "low")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "alerts"))
    live = spark.readStream.schema(schema).parquet(str(tmp_path / "alerts")).withColumn("at", F.timestamp_micros("us"))
    out = drain(incident_stream(live), "incidents", "complete").collect()
    plain = incidents.incidents(spark.read.parquet(str(tmp_path / "alerts")), RULES).collect()
    pick = lambda r: (r.entity_key, r.session_start, r.alert_count, r.risk_score, r.severity)
    assert sorted(map(pick, out)) == sorted(map(pick, plain))


def correlated(spark, folder, batches, rules, rearm="never"):
    """Alerts of a stream whose files come one a batch, closed by an event far beyond the others."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    name = f"correlated_{random.getrandbits(40)}"
    end = (10**6, None, None, None, None, None, None, None, None, None, None, None, None, None, None, 10**13)
    for i, rows in enumerate([*batches, [end]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        events = spark.readStream.schema(SCHEMA).parquet(str(folder)).withColumn("at", F.timestamp_micros("us"))
        q = (
            correlation_stream(events, rules, "1 hour", rearm).writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", f"{folder}-{name}-state").trigger(availableNow=True).start(f"{folder}-{name}-out")
        )
        q.awaitTermination(120)
    out = spark.read.parquet(f"{folder}-{name}-out").collect()
    return sorted((r.rule_id, r.entity_key, r.event_id, r.us, list(r.event_ids)) for r in out)


CORRELATED = parse_pack(
    [
        spec({"s": {"event_type": "a"}, "condition": "s", "correlation": {"type": "count", "threshold": 3, "timeframe": "5m", "group_by": ["hostname"]}}, id="N-1"),
        spec({"a": {"event_type": "a"}, "b": {"event_type": "b"}, "c": {"event_type": ["a", "c"]}, "condition": "a or b or c",
              "correlation": {"type": "sequence", "sequence": ["a", "b", "c"], "timeframe": "4m", "group_by": ["hostname"]}}, id="N-2"),
    ]
)


def event(i, us, kind, host):
    return (i, None, "x", kind, "low", None, None, None, None, None, host, None, None, "", "{}", us)


@pytest.mark.parametrize("seed", [1, 2])
def test_correlation_stream_equals_batch(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [event(i, 10**12 + rng.randrange(20) * 60_000_000 // (1 + rng.randrange(2)), rng.choice("abc"), rng.choice(["h1", "h2", "h3", "h4", None])) for i in range(60)]
    got = correlated(spark, tmp_path / "events", [rows[:25], rows[25:]], CORRELATED)
    batch = spark.createDataFrame(rows, SCHEMA)
    found = detect.count_alerts(batch, CORRELATED).unionByName(detect.sequence_alerts(batch, CORRELATED)).collect()
    want = sorted((r.rule_id, r.entity_key, r.event_id, r.us, list(r.event_ids)) for r in found)
    assert want and got == want


def test_correlation_stream_rearms(spark, tmp_path):
    rows = [event(i, 10**12 + i * 60_000_000, "a", "h") for i in range(20)]
    got = correlated(spark, tmp_path / "events", [rows], CORRELATED[:1], "after_timeframe")
    # An alert at minute 2; matches up to minute 7 are passed over.
    assert [x[2] for x in got] == [2, 10, 18]


class Counted:
    """A state store in memory that counts what is read and written, rows of packed lots one by one."""

    def __init__(self):
        self.n, self.timers, self.map, self.value, self.list = 0, set(), {}, {}, {}

    def getMapState(self, name, *_):
        store, self_ = self.map.setdefault(name, {}), self

        class Map:
            def updateValue(_, k, v):
                store[k] = v
                self_.n += len(v[0]) // 24

            def getValue(_, k):
                self_.n += len(store[k][0]) // 24
                return store[k]

            def removeKey(_, k):
                del store[k]

        return Map()

    def _cell(self, kind, name, size):
        store, self_ = kind, self

        class Cell:
            def exists(_):
                return name in store

            def get(_):
                self_.n += size(store[name])
                return store[name]

            def update(_, v):
                store[name] = v
                self_.n += size(v)

            put = update

            def clear(_):
                store.pop(name, None)

        return Cell()

    def getValueState(self, name, *_):
        return self._cell(self.value, name, lambda v: 1)

    def getListState(self, name, *_):
        return self._cell(self.list, name, len)

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


def fed(rows, batches, plan, lateness_ms=3_600_000, rearm="never"):
    """Rows of one key in batches through the processor: (alerts, state rows read and written, most timers at a time)."""
    import pandas as pd

    from watchfire.streaming.correlation import _Correlator

    store, p = Counted(), _Correlator({"R": plan}, rearm)
    p.init(store)
    out, watermark, timers = [], 0, 0
    times = lambda: type("T", (), {"getCurrentWatermarkInMs": lambda s: watermark, "getExpiryTimeInMs": lambda s: at})()
    step = max(1, -(-len(rows) // batches))
    for i in range(0, len(rows) + step, step):
        part, at = rows[i : i + step], 0
        if part:
            list(p.handleInputRows(("R", "e"), iter([pd.DataFrame(part, columns=["us", "id", "stages"])]), times()))
            top = max(r[0] for r in part) // 1000 - lateness_ms
        else:
            top = 10**14
        watermark, timers = max(watermark, top), max(timers, len(store.timers))
        while due := [t for t in store.timers if t <= watermark]:
            at = min(due)
            store.timers.remove(at)
            for f in p.handleExpiredTimer(("R", "e"), times(), times()):
                out += f.values.tolist()
    assert not store.map["waiting"] and not store.list and not store.timers
    return out, store.n, timers


@pytest.mark.parametrize("plan", [("count", 5, 60_000_000), ("sequence", 3, 60_000_000)])
def test_state_grows_linearly(plan):
    """Ten times the rows of one key, in ten times the batches: ten times the state rows."""
    def run(n, batches):
        # Every second row is a start; no count fires, since rows are 20 s apart, and no sequence ends.
        rows = [(i * 20_000_000, i, 1 if i % 2 else 2) for i in range(n)]
        return fed(rows, batches, plan)

    few, many = run(400, 40), run(4000, 400)
    assert few[0] == many[0] == [] and few[2] == many[2] == 1
    assert many[1] <= 12 * few[1] and many[1] <= 40 * 4000


@pytest.mark.parametrize("seed", range(4))
def test_processor_equals_plain_versions(seed):
    """Rows out of order within the lateness, in batches of any size."""
    from tests.test_detection import plain_count, plain_sequence

    rng = random.Random(seed)
    minute = 60_000_000
    rows = [{"id": i, "us": (100 + rng.randrange(90)) * minute + rng.randrange(3) * 500_000, "event_type": rng.choice("ffst"), "source_ip": "e", "username": "e"} for i in range(rng.choice([5, 30, 80]))]
    bits = {"f": 1, "s": 2, "t": 4}
    given = sorted(((r["us"], r["id"], bits[r["event_type"]]) for r in rows), key=lambda r: r[0] + rng.randrange(50) * minute)
    for batches in (1, 3, 17):
        got = fed([r for r in given if r[2] == 1], batches, ("count", 3, 5 * minute))[0]
        assert [(x[2], tuple(x[4])) for x in got] == [w[2:] for w in plain_count(rows)]
        got = fed(given, batches, ("sequence", 3, 10 * minute))[0]
        assert [(x[2], tuple(x[4])) for x in got] == [w[2:] for w in plain_sequence(rows)]


class Calls(Counted):
    """The same, which also counts the calls."""

    def __init__(self):
        super().__init__()
        self.calls = 0

    def _counting(self, state):
        outer = self

        class Counting:
            def __getattr__(_, name):
                outer.calls += 1
                return getattr(state, name)

        return Counting()

    def getMapState(self, *a):
        return self._counting(super().getMapState(*a))

    def getValueState(self, *a):
        return self._counting(super().getValueState(*a))

    def getListState(self, *a):
        return self._counting(super().getListState(*a))


@pytest.mark.parametrize("kind", ["count", "sequence"])
def test_entities_share_state(kind):
    """Entities of a share: each has its own alerts, in whatever lots its rows waited, and the calls of the state store do not grow
    with the entities."""
    import pandas as pd

    from tests.test_detection import plain_count, plain_sequence
    from watchfire.streaming import correlation

    minute, bits = 60_000_000, {"f": 1, "s": 2, "t": 4}
    plan, plain = (("count", 3, 5 * minute), plain_count) if kind == "count" else (("sequence", 3, 10 * minute), plain_sequence)

    def run(n, each, batches=5):
        rng = random.Random(n)
        rows = [{"id": i, "us": (100 + rng.randrange(400)) * minute, "event_type": rng.choice("f" if kind == "count" else "fst"), "source_ip": f"ü{i % n}", "username": f"ü{i % n}"} for i in range(n * each)]
        given = sorted(rows, key=lambda r: r["us"] + rng.randrange(50) * minute)
        store, p, out, watermark = Calls(), correlation._Correlator({"R": plan}, "never"), [], 0
        p.init(store)
        times = lambda at=0: type("T", (), {"getCurrentWatermarkInMs": lambda s: watermark, "getExpiryTimeInMs": lambda s: at})()
        step = -(-len(given) // batches)
        for i in range(0, len(given) + step, step):
            if part := [(r["us"], r["id"], bits[r["event_type"]], r["username"]) for r in given[i : i + step]]:
                list(p.handleInputRows(("R", 7), iter([pd.DataFrame(part, columns=["us", "id", "stages", "entity_key"])]), times()))
            watermark = max(watermark, max(r[0] for r in part) // 1000 - 3_600_000) if part else 10**14
            while due := [t for t in store.timers if t <= watermark]:
                store.timers.remove(at := min(due))
                for f in p.handleExpiredTimer(("R", 7), times(), times(at)):
                    out += f.values.tolist()
        assert not store.map["waiting"] and not store.timers
        want = sorted(("R", w[1], *w[2:]) for e in range(n) for w in plain([r for r in rows if r["username"] == f"ü{e}"]))
        assert want and sorted((x[0], x[1], x[2], tuple(x[4])) for x in out) == want
        return store.calls

    few, many = run(40, 100), run(400, 10)
    assert many < 1.5 * few and many < 600


def test_open_rows_before_waiting_ones():
    """What is open stays for a row that waits in the slot of the watermark, before it."""
    second = 1_000_000
    rows = [(1000 * second, 1, 1), (1064 * second, 2, 1), (4_665_500_000, 3, 1)]
    got = fed(rows, 1, ("count", 2, 64 * second))[0]
    assert [(x[2], list(x[4])) for x in got] == [(2, [1, 2])]
    got = fed(rows, 1, ("count", 1, 64 * second), rearm="after_timeframe")[0]
    assert [x[2] for x in got] == [1, 3]
