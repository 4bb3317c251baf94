import random

from pyspark.sql import functions as F

from tests.test_rules import events, spec
from watchfire.functions.rules import parse_pack
from watchfire.jobs import security
from watchfire.operators import detect, incidents

MINUTE = 60_000_000
COUNT = parse_pack([spec({"s": {"event_type": "f"}, "condition": "s", "correlation": {"type": "count", "threshold": 3, "timeframe": "5m", "group_by": ["source_ip"]}})])
SEQUENCE = parse_pack([spec({"a": {"event_type": "f"}, "b": {"event_type": "s"}, "c": {"event_type": "t"}, "condition": "a or b or c",
                             "correlation": {"type": "sequence", "sequence": ["a", "b", "c"], "timeframe": "10m", "group_by": ["username"]}})])


def found(df):
    return sorted((r.rule_id, r.entity_key, r.event_id, tuple(r.event_ids)) for r in df.collect())


def ev(i, minute, kind="f", ip="1.1.1.1", user="u"):
    return {"id": i, "us": int(minute * MINUTE), "event_type": kind, "source_ip": ip, "username": user}


def test_count_boundaries(spark):
    run = lambda *e: found(detect.count_alerts(events(spark, *e), COUNT))
    assert run(ev(1, 0), ev(2, 1)) == []
    assert run(ev(1, 0), ev(2, 1), ev(3, 5)) == [("T-1", "1.1.1.1", 3, (1, 2, 3))]
    assert run(ev(1, 0), ev(2, 1), ev(3, 5.01)) == []
    assert run(*[ev(i, 0, ip=None) for i in range(3)]) == []
    assert run(ev(1, 0), ev(2, 1), ev(2, 1)) == []  # an event that is given twice counts once
    assert run(ev(1, 0), ev(2, 0), ev(3, 0)) == [("T-1", "1.1.1.1", 3, (1, 2, 3))]
    assert run(*[ev(i, i, ip="x") for i in range(9)]) == [("T-1", "x", 2, (0, 1, 2))]


def plain_count(rows, threshold=3, frame=5 * MINUTE):
    out = []
    for ip in sorted({r["source_ip"] for r in rows}):
        own = sorted((r["us"], r["id"]) for r in rows if r["source_ip"] == ip and r["event_type"] == "f")
        for k, (us, i) in enumerate(own):
            window = [x for x in own[: k + 1] if x[0] >= us - frame]
            if len(window) >= threshold:
                out.append(("T-1", ip, i, tuple(x[1] for x in window)))
                break
    return out


def plain_sequence(rows, stages=("f", "s", "t"), frame=10 * MINUTE, stored=()):
    out = []
    for user in sorted({r["username"] for r in rows}):
        own = sorted((r["us"], r["id"], r["event_type"]) for r in rows if r["username"] == user and r["event_type"] in stages)
        for k, start in enumerate(own):
            if start[2] != stages[0]:
                continue
            path, at = [start], k + 1
            for stage in stages[1:]:
                hit = next((j for j in range(at, len(own)) if own[j][2] == stage and own[j][0] - start[0] <= frame), None)
                if hit is None:
                    break
                path.append(own[hit])
                at = hit + 1
            if len(path) == len(stages) and (user, path[-1][1]) not in stored:
                out.append(("T-1", user, path[-1][1], tuple(p[1] for p in path)))
                break
    return out


def test_random_against_plain_versions(spark):
    rng = random.Random(7)
    rows = [ev(i, rng.randrange(120), rng.choice("fffst"), f"ip{rng.randrange(12)}", f"u{rng.randrange(12)}") for i in range(400)]
    e = events(spark, *rows).persist()
    assert found(detect.count_alerts(e, COUNT)) == plain_count(rows)
    assert found(detect.count_alerts(e, COUNT, hot_rows=2, share=10**9)) == plain_count(rows)
    first = detect.sequence_alerts(e, SEQUENCE)
    want = plain_sequence(rows)
    assert found(first) == want and found(detect.sequence_alerts(e, SEQUENCE, hot_rows=2, share=10**9)) == want
    twice = e.unionByName(e.where("id % 3 = 0"))
    assert found(detect.count_alerts(twice, COUNT)) == plain_count(rows) and found(detect.sequence_alerts(twice, SEQUENCE)) == want
    assert found(detect.sequence_alerts(e, SEQUENCE, stored=first)) == plain_sequence(rows, stored={(w[1], w[2]) for w in want})


def test_sessions_and_scores(spark):
    gap = 30 * MINUTE
    alerts = spark.createDataFrame(
        [("A", "e", 1, 0, "critical"), ("B", "e", 2, gap, "low"), ("A", "e", 3, 2 * gap + 1, "info"), ("A", None, 4, 0, "odd")],
        "rule_id string, entity_key string, event_id long, us long, severity string",
    )
    out = sorted((r.entity_key, r.session_start, r.alert_count, r.risk_score, r.severity, r.summary) for r in incidents.incidents(alerts, COUNT).collect())
    assert out == [
        ("e", 0, 2, 100.0, "critical", "2 alert(s), 0 MITRE technique(s): unmapped"), ("e", 2 * gap + 1, 1, 10.0, "low", "1 alert(s), 0 MITRE technique(s): unmapped"),
        ("unknown", 0, 1, 50.0, "medium", "1 alert(s), 0 MITRE technique(s): unmapped"),
    ]
    known = alerts.withColumn("incident_id", F.when(F.col("event_id") == 3, "old"))
    assert {r.event_id for r in incidents.assigned_alerts(known).collect()} == {1, 2, 4}


def test_sessions_against_plain_version(spark):
    """Buckets of any width give the sessions of one pass."""
    rng = random.Random(5)
    gap = 30 * MINUTE
    rows = [("A", rng.choice(["x", "y", "z", ""]), i, rng.randrange(-200, 4000) * MINUTE, "low") for i in range(300)] + [("B", "x", 900 + i, 5000 * MINUTE + i * gap, "low") for i in range(9)]
    want = {}
    for key in {r[1] for r in rows}:
        last = start = None
        for us, i in sorted((r[3], r[2]) for r in rows if r[1] == key):
            start = us if last is None or us - last > gap else start
            last = us
            want[i] = (key or "unknown", start)
    alerts = spark.createDataFrame(rows, "rule_id string, entity_key string, event_id long, us long, severity string").persist()
    for width in (MINUTE, 45 * MINUTE, 3600 * MINUTE):
        assert {r.event_id: (r.entity_key, r.session_start) for r in incidents.assign_sessions(alerts, bucket_us=width).collect()} == want


def plain_similar(rows, k):
    out = []
    for q in rows:
        scored = []
        for o in rows:
            same = 60 * (bool(q[1]) and q[1] == o[1]) + min(30, 10 * len(set(q[3] or ()) & set(o[3] or ()))) + 10 * (q[2] is not None and q[2] == o[2])
            if o[0] != q[0] and same:
                shared = sorted(set(q[3] or ()) & set(o[3] or ()))
                why = ["same entity"] * bool(q[1] and q[1] == o[1]) + ([f"shared MITRE: {', '.join(shared)}"] if shared else []) + ["same severity"] * bool(q[2] is not None and q[2] == o[2])
                scored.append((-same, o[0], why))
        out += [(q[0], i, -s, n, why) for n, (s, i, why) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_similar_of_all_incidents(spark):
    rng = random.Random(3)
    sets = [None, [], ["T1"], ["T1", "T2"], ["T2", "T1", "T3", "T4"], ["T3"], ["T5"]]
    rows = [(f"{rng.randrange(10**9):09d}", rng.choice(["", None, "hot", "hot", *"abcdef"]), rng.choice(["low", "high", "critical", None]), rng.choice(sets)) for _ in range(300)]
    found = spark.createDataFrame(rows, "incident_id string, entity_key string, severity string, techniques array<string>").persist()
    for k in (1, 5):
        got = sorted((r.q_id, r.incident_id, r.score, r.rank, r.reasons) for r in incidents.similar_incidents(found, found, k).collect())
        assert got == plain_similar(rows, k)
        assert incidents.similar_candidates(found, found, k).count() <= 2 * (k + 1) * len(rows)


def test_similar_kinds_form_no_pairs(spark):
    """Many kinds that share techniques and severities: candidates grow with the kinds, not with their square."""
    rng = random.Random(8)
    techniques = [f"T{i}" for i in range(12)]
    kinds = {(rng.choice("abcd"), tuple(sorted(rng.sample(techniques, rng.randint(0, 6))))) for _ in range(6000)}
    rows = spark.createDataFrame([(f"{i:06d}", {"techniques": list(t), "severity": s}) for i, (s, t) in enumerate(sorted(kinds))], "incident_id string, kind struct<techniques:array<string>,severity:string>").persist()
    n = rows.count()
    met = incidents.kind_candidates(rows.select(F.col("kind").alias("q_kind")), rows, 6).count()
    assert n > 3000 and met < 160 * n < 0.1 * n * n


def test_similar_query_asks_every_incident(spark):
    sf = "/root/testdata/sf0.001"
    everyone = {(r.entity_key, r.session_start) for r in security.flagship(spark, sf).collect()}
    asked = {(r.q_entity, r.q_start) for r in security.QUERIES["similar_incidents"](spark, sf).collect()}
    assert asked == everyone


def test_empty_tables(spark):
    none = events(spark)
    assert found(detect.count_alerts(none, COUNT)) == found(detect.sequence_alerts(none, SEQUENCE)) == []
    assert detect.all_alerts(none, COUNT).count() == 0
