import random

import pytest
from pyspark.sql import functions as F

from tests.test_rules import events, spec
from watchfire.functions.rules import parse_pack, parse_rule
from watchfire.jobs import packs
from watchfire.operators import detect, rule_index

FIELDS = {
    "event_type": ["a", "b", "C"], "source": ["x", "y", None], "severity": ["low", "HIGH"], "username": ["ann", "Bob", "", None], "message": ["Hello world", "hello", "powershell -enc", "", None, "12"],
    "source_port": [0, 22, 80, None], "command_line": ["net  user /domain", None, "1_000", "nan"], "raw_data": ['{"k": 1, "m": {"n": "Deep"}}', '{"k": "2", "f": 1.5}', "{}", "no json"],
}
ENTRIES = [
    ("event_type", ["a", "C", ["a", "b"], []]), ("source", ["X", "y"]), ("severity", ["high", ["low", "high"]]), ("username", ["ANN", "bob", ""]), ("message|contains", ["HELLO", ["wor", "-enc"], "o w", ""]),
    ("message|startswith", ["hel", "Pow"]), ("message|endswith", ["world", ["enc", "12"]]), ("message|re", ["^hel+o", "w.r", "(", "a" * 300, ["x", r"\d+"]]), ("source_port|gte", [22, "80", "x", [1, 79]]), ("source_port|lt", [23]),
    ("command_line|exists", [True, False, [True, False]]), ("raw_data.k", [1, "2"]), ("m.n|contains", ["eep"]), ("f|gt", [1, float("nan")]), ("command_line|lte", [1000]), ("message|CONTAINS", ["hello"]), ("raw_data|contains", ["deep"]),
    ("source_port", [22, 0]), ("username|regex", [r"(?P<n>ann)\Z"]), ("source.x", ["y"]),
]
CONDITIONS = ["a", "not a", "a and b", "a or b", "a and not b", "not (a or b) and c", "(a or b) and (b or c)", "not not a or b and c", "((a)) or not (b and (c or not a))"]


def random_rules(rng, n):
    def selection():
        return {k: rng.choice(v) for k, v in rng.sample(ENTRIES, rng.randint(1, 3))}

    rules = []
    for i in range(n):
        more = {"correlation": {"type": "sequence", "sequence": rng.sample(["a", "b", "c"], 2), "timeframe": "5m"}} if i % 5 == 0 else {}
        rules.append(spec({"a": selection(), "b": selection(), "c": selection(), "condition": rng.choice(CONDITIONS), **more}, id=f"R-{i:03d}"))
    return parse_pack(rules)


@pytest.mark.parametrize("seed", [1, 2])
def test_index_equals_columns(spark, seed, monkeypatch):
    """Random rules and events: the same matches and stages from the index as from one column a rule."""
    rng = random.Random(seed)
    rules = random_rules(rng, 60)
    e = events(spark, *[{"id": i, "us": i, **{k: rng.choice(v) for k, v in FIELDS.items()}} for i in range(150)]).persist()
    pick = lambda df: sorted((r.id, r.rule_id, r.mask) for r in df.select("id", "rule_id", "mask").collect())
    got = pick(detect.matched_events(e, rules))
    monkeypatch.setattr(detect, "COLUMN_RULES", 60)
    assert got == pick(detect.matched_events(e, rules)) and got


def test_necessary_values():
    need = lambda detection: rule_index.necessary(parse_rule(spec(detection)))
    a, b, c = {"event_type": "A", "username": "U"}, {"source": ["X", "y"]}, {"message|contains": "evil thing"}
    assert need({"a": a, "condition": "a"}) == {("username", "=", "u")}
    assert need({"a": a, "b": b, "condition": "a or b"}) == {("username", "=", "u"), ("source", "=", "x"), ("source", "=", "y")}
    assert need({"b": b, "c": c, "condition": "b and c"}) == {("message", "~", "evil thing")}
    assert need({"a": a, "b": b, "condition": "not a and b"}) == {("source", "=", "x"), ("source", "=", "y")}
    for free in ({"a": a, "condition": "not a"}, {"a": a, "b": {"k": 1}, "condition": "a or b"}, {"a": {"message|re": "x"}, "condition": "a"}, {"a": {"message|contains": ""}, "condition": "a"}):
        assert need(free) is None


def test_candidates_are_few(spark):
    """Of a thousand rules an event meets those that share a value with it, each once."""
    rules = list(packs.thousand())
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    from watchfire.sources.security_events import adapted

    e = adapted(e)
    index, _, keys, left = rule_index.indexed(spark, rules)
    assert {r.id[:3] for r in left} == {"PYT"}
    met = rule_index.candidates(e, index, keys)
    assert met.groupBy("id", "rule_id").count().where("count > 1").count() == 0
    assert met.count() < 0.08 * e.count() * len(rules)
    plan = detect.matched_events(e, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "BroadcastHashJoin" in plan


def test_candidates_are_no_rows(spark):
    """A thousand rules are tested in one pass over events in batches; only matches become rows. Patterns that only Python reads
    take no pass of their own, and parts get lists of their own."""
    from watchfire.sources.security_events import adapted

    rules = list(packs.thousand())
    e = adapted(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    plan = detect.matched_events(e, rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1 and "explode" not in plan
    parts = [i % 3 for i in range(len(rules))]
    lists = e.select("id", F.inline(rule_index.hits(rules, parts))).select("id", "part", F.inline("hits"))
    got = sorted((r.id, rules[r.rule].id) for r in lists.collect() if parts[r.rule] == r.part)
    assert got == sorted((r.id, r.rule_id) for r in detect.matched_events(e, rules).collect()) and len(got) == lists.count()


def test_a_repeated_id_counts_by_its_first_event(spark):
    rules = parse_pack([
        spec({"s": {"event_type": "f"}, "condition": "s"}, id="S-1"),
        spec({"s": {"event_type": "f"}, "condition": "s", "correlation": {"type": "count", "threshold": 3, "timeframe": "5m", "group_by": ["source_ip"]}}, id="C-1"),
        spec({"a": {"event_type": "f"}, "b": {"event_type": "g"}, "condition": "a or b", "correlation": {"type": "sequence", "sequence": ["a", "b"], "timeframe": "5m", "group_by": ["source_ip"]}}, id="Q-1"),
    ])
    row = lambda i, us, kind="f", ip="1.1.1.1": {"id": i, "us": us, "event_type": kind, "source_ip": ip}
    found = lambda *rows: sorted((r.rule_id, r.event_id, r.us) for r in detect.all_alerts(events(spark, *rows), rules).collect())
    # One id at three times is one event; the earliest stands.
    assert found(row(1, 9), row(1, 5), row(1, 7)) == [("S-1", 1, 5)]
    # The first event of an id does not match: later ones of that id do not count.
    assert found(row(1, 1, "x"), row(1, 2), row(2, 3)) == [("S-1", 2, 3)]
    assert found(row(1, 1), row(2, 2), row(1, 3, "g"), row(3, 4)) == [("C-1", 3, 4), ("S-1", 1, 1), ("S-1", 2, 2), ("S-1", 3, 4)]
    # Rows without an id all count.
    assert [x[0] for x in found(row(None, 1), row(None, 2), row(None, 3))] == ["C-1", "S-1", "S-1", "S-1"]


def test_a_hot_key_is_split(spark):
    """A key with a third of all matches and one busy slot: buckets are bounded, and alerts are those of one bucket."""
    rules = parse_pack([
        spec({"s": {"event_type": "f"}, "condition": "s", "correlation": {"type": "count", "threshold": 4, "timeframe": "1m", "group_by": ["source_ip"]}}, id="C-1"),
        spec({"a": {"event_type": "f"}, "b": {"event_type": "g"}, "condition": "a or b", "correlation": {"type": "sequence", "sequence": ["a", "b"], "timeframe": "1m", "group_by": ["source_ip"]}}, id="Q-1"),
    ])
    rng, minute = random.Random(4), 60_000_000
    rows = [{"id": i, "us": rng.randrange(300) * minute, "event_type": rng.choice("fg") if i % 50 else "g", "source_ip": "hot" if i % 3 == 0 else f"ip{i % 40}"} for i in range(900)]
    rows += [{"id": 1000 + i, "us": 301 * minute + i, "event_type": "f", "source_ip": "hot"} for i in range(300)]
    e = events(spark, *rows).persist()
    pick = lambda df: sorted((r.rule_id, r.entity_key, r.event_id, tuple(r.event_ids)) for r in df.collect())
    assert pick(detect.correlated_alerts(e, rules, hot_rows=40, share=10**9)) == pick(detect.correlated_alerts(e, rules))
    matches = detect.keyed(detect.matched_events(e, rules), rules).select("rule_id", "entity_key", "id", "us", "mask", "frame", "stages", "needs").persist()
    split = detect._split_by_time(matches, 40, 10**9).groupBy("rule_id", "entity_key", "bucket").agg(F.count("*").alias("n")).where("entity_key = 'hot'").collect()
    assert len([r for r in split if r.rule_id == "C-1"]) >= 4 and max(r.n for r in split if r.rule_id == "C-1") <= 60


@pytest.mark.parametrize("known", [False, True])
def test_matches_of_large_packs_are_no_rows(spark, monkeypatch, known):
    """Counts and sequences of a large pack: the alerts of the windows over matches, of which none becomes a row; ties in time, ids
    and keys that are null or empty, ports of 0, stored alerts, entities longer than a task's part."""
    from watchfire.operators import correlate

    rng, keys = random.Random(7), [["source_ip"], ["hostname"], ["source_ip", "source_port"], ["source_port"], ["username"]]
    rules = []
    for i in range(50):
        how = {"timeframe": f"{rng.randint(1, 9)}m", "group_by": keys[i % 5]}
        if i % 2:
            more = {"type": "sequence", "sequence": rng.choice([["a", "b"], ["b", "a", "b"], ["a", "a"]]), **how}
        else:
            more = {"type": "count", "threshold": rng.randint(1, 4), **how}
        rules.append(spec({"a": {"event_type": rng.choice("fg")}, "b": {"severity": ["low", "high"]}, "condition": "a or b", "correlation": more}, id=f"M-{i:02d}"))
    rules = parse_pack(rules)
    values = {"event_type": ["f", "g", "h"], "severity": ["low", "high", "none"], "source_ip": ["1.1.1.1", "1.1.1.2", "", None], "hostname": ["hot"], "source_port": [0, 22, None]}
    rows = [{"id": i, "us": rng.randrange(-200, 400) * 15_000_000, **{k: rng.choice(v) for k, v in values.items()}} for i in range(500)]
    e = events(spark, *rows).persist()
    pick = lambda df: sorted((r.rule_id, r.entity_key, r.event_id, r.us, tuple(r.event_ids)) for r in df.collect())
    monkeypatch.setattr(detect, "COLUMN_RULES", 100)
    stored = detect.correlated_alerts(e, rules, repeats=False).select("rule_id", "entity_key", "event_id").persist() if known else None
    wanted = pick(detect.correlated_alerts(e, rules, stored, repeats=False))
    monkeypatch.setattr(detect, "COLUMN_RULES", 40)
    for size in (50_000, 7):
        monkeypatch.setattr(correlate, "ROWS", size)
        found = detect.correlated_alerts(e, rules, stored, repeats=False)
        assert pick(found) == wanted and len({x[0] for x in wanted}) > 30
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert known or "Window" not in plan and "MapInArrow" in plan  # the stored alerts' own plan has windows
