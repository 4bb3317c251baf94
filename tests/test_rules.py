import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from watchfire.functions import rules
from watchfire.functions.rules import RuleError, condition_tree, parse_pack, parse_rule, seconds
from watchfire.operators import analytics, detect, fixtures
from watchfire.sources.security_events import EVENT_FIELDS

SCHEMA = ", ".join(f"{c} {'long' if c == 'id' else 'int' if c.endswith('port') else 'timestamp' if c == 'timestamp' else 'string'}" for c in EVENT_FIELDS) + ", us long"


def spec(detection, **more):
    return {"id": "T-1", "title": "t", "level": "low", "logsource": {"category": "x"}, "detection": detection} | more


def events(spark, *rows):
    return spark.createDataFrame([tuple(r.get(c) for c in (*EVENT_FIELDS, "us")) for r in rows], SCHEMA)


def matching(spark, detection, *rows):
    return {r.id for r in detect.matched_events(events(spark, *rows), [parse_rule(spec(detection))]).collect()}


def test_precedence_and_limits():
    assert condition_tree("a or b and not c", set("abc")) == ("or", ("is", "a"), ("and", ("is", "b"), ("not", ("is", "c"))))
    assert condition_tree("(a OR b) And c", set("abc"))[0] == "and"
    assert condition_tree("not " * 17 + "a", {"a"})[0] == "not"  # only parentheses nest
    assert condition_tree(" ( a )or(x.y-z_1)", {"a", "x.y-z_1"}) == ("or", ("is", "a"), ("is", "x.y-z_1"))
    assert condition_tree("(" * 16 + "a" + ")" * 16, {"a"}) == ("is", "a")
    for bad in ("a and", "(a", "a b", "1 of a", "d", "", "a" * 3000, "(" * 17 + "a" + ")" * 17, " or ".join("a" * 70), "a && b", "a)", "A", "and", "not", "a or or b", "__import__('os')"):
        with pytest.raises(RuleError):
            condition_tree(bad, set("abc"))


def test_timeframes():
    assert [seconds(x) for x in ("5m", "2 h", 90, "1d", "x", None)] == [300, 7200, 90, 86400, 300, 300]


def test_validation():
    ok = {"s": {"source": "x"}, "condition": "s"}
    count = {"type": "count", "threshold": 2}
    sequence = {"s": {"a": 1}, "t": {"a": 2}, "condition": "s or t"}
    bad = [
        spec(ok, id="?"), spec(ok, id="ab"), spec(ok, id="x" * 129), spec(ok, id=7), spec(ok, title=" "), spec(ok, title=3), spec(ok, level="Low"), spec(ok, level="severe"),
        spec(ok, logsource={}), spec(ok, logsource="x"), spec(ok, tags="x"), spec(ok, tags=[1]), spec(ok, references=[None]), spec("s"),
        spec({"s": {"a|near": 1}, "condition": "s"}), spec({"s": {"a|re|contains": 1}, "condition": "s"}), spec({"s": {"": 1}, "condition": "s"}), spec({"s": {1: 1}, "condition": "s"}),
        spec({"s": {}, "condition": "s"}), spec({"s": ["x"], "condition": "s"}), spec({"condition": "s"}), spec({"s": {"a": 1}}), spec({"s": {"a": 1}, "condition": " "}), spec({"s": {"a": 1}, "condition": "t"}),
        *[spec({**ok, "correlation": c}) for c in (
            "count", {}, {"type": "sum"}, {"type": "count"}, {"threshold": 0}, {"threshold": "3"}, count | {"group_by": []}, count | {"group_by": "source_ip"}, count | {"group_by": [""]},
            count | {"timeframe": "5 m"}, count | {"timeframe": "0m"}, count | {"timeframe": 0}, count | {"timeframe": -5}, count | {"timeframe": "soon"}, count | {"timeframe": None},
        )],
        *[spec({**sequence, "correlation": {"type": "sequence", **c}}) for c in ({}, {"sequence": ["s"]}, {"sequence": ["s", "u"]}, {"sequence": "s"})],
        [], None,
    ]
    for given in bad:
        with pytest.raises(RuleError):
            parse_rule(given)
    with pytest.raises(RuleError):
        parse_pack([spec(ok), spec(ok)])
    for good in (spec(ok, id="ORG:RULE-1.a_b"), spec({**ok, "correlation": count | {"timeframe": "15M"}}), spec({**ok, "correlation": count | {"timeframe": 90}}), spec({"s": {"a|RE": 1}, "condition": "S or s".replace("S or ", "")})):
        parse_rule(good)
    assert parse_rule(spec(ok, mitre={"technique": "t1110"}, tags=["attack.t1059.001", "attack.T1110", "x"])).techniques == ["T1110", "T1059.001"]
    r = parse_rule(spec(ok, tags=["attack.T1059.001"]))
    assert (r.technique, r.technique_name, r.tactic) == ("T1059.001", "PowerShell", "Execution")
    assert (parse_rule(spec(ok)).tactic, parse_rule(spec(ok, mitre={"technique": "T9", "tactic": "Own"})).tactic, parse_rule(spec(ok, mitre={"technique": "T9"})).technique_name) == ("Unmapped", "Own", "Custom Mapping")


def test_yaml():
    text = "id: ABC-1\ntitle: t\nlogsource: {category: x}\ndetection:\n  s: {source: a}\n  condition: s\n"
    assert rules.parse_yaml(text).content == text
    for bad in ("- a", "id: [", "", text + "# " + "x" * 256 * 1024):
        with pytest.raises(RuleError):
            rules.parse_yaml(bad)


def test_patterns_that_java_reads_otherwise(spark):
    values = ["abab", "x", "x\n", "a[b", "tab\tx", "ABC-12", "caf\u00e9", "&&", "aaa", "line\rend", None, "z" * 20_000]
    patterns = [
        "(?P<a_b>x)", "(?P<a>a)(?P=a)", r"x\Z", "x$", "[a[]", "[&&]", r"(ab)\1", "(a|b){2}c?", "a{,2}b", r"\w+\W", "(?a)\\w\u00e9", "^.+$", r"[\d-]+$", "(?i:abc)-", "(?s)e.e", "\u00c9$", r"\v", "(", "e(?=nd)",
    ]
    rows = [{"id": i, "message": v} for i, v in enumerate(values)]
    for p in patterns:
        try:
            want = {i for i, v in enumerate(values) if v is not None and len(v) <= 16_384 and re.search(p, v, re.I)}
        except re.error:
            want = set()
        assert matching(spark, {"s": {"message|re": p}, "condition": "s"}, *rows) == want, p


def test_predicates(spark):
    rows = [
        {"id": 1, "source": "Nginx", "command_line": "PowerShell -Enc ABC", "source_port": 0, "raw_data": '{"a": {"b": "X"}, "n": "1_000", "d": "1d", "z": null, "f": "NaN"}'},
        {"id": 2, "source": None, "command_line": None, "source_port": 80, "raw_data": "{}"},
    ]
    cases = [
        ({"source": "nginx"}, {1}), ({"source": ["x", "NGINX"]}, {1}), ({"source": []}, set()), ({"command_line|contains": "shell"}, {1}),
        ({"command_line|startswith": "power"}, {1}), ({"command_line|endswith": "abc"}, {1}), ({"command_line|re": r"-e(nc)?\s+\w"}, {1}),
        ({"command_line|regex": "(a+)+b"}, set()), ({"command_line|re": "("}, set()), ({"command_line|re": "a" * 257}, set()),
        ({"source|exists": False}, {2}), ({"raw_data.z|exists": True}, set()), ({"a.b": "x"}, {1}), ({"raw_data.n|gte": 1000}, {1}),
        ({"raw_data.d|gt": 0}, set()), ({"raw_data.f|gt": 0}, set()), ({"source_port|lt": 80}, {1}), ({"command_line|CONTAINS": "shell"}, set()),
    ]
    for selection, want in cases:
        assert matching(spark, {"s": selection, "condition": "s"}, *rows) == want, selection
    # Two-valued: NOT of a comparison with null is true.
    assert matching(spark, {"s": {"source": "nginx"}, "condition": "not s"}, *rows) == {2}
    assert rules.SEVERITY_WEIGHT["critical"] == 95


def test_fixtures_and_catalogue(spark):
    rule = parse_rule(
        spec(
            {"s": {"port|gte": 10, "source": "x"}, "condition": "s"},
            test={"event": {"id": 7, "source": "X", "raw_data": {"port": 12}}},
            tests={"positive": [{"source": "x", "raw_data": {"port": 1}, "name": "low"}], "negative": [{"event": {"raw_data": {"source": "x", "port": 99}}}]},
        )
    )
    got = [tuple(r) for r in fixtures.run_fixtures(spark, [rule]).collect()]
    assert got == [("T-1", "Legacy fixture", True, True, True, "7"), ("T-1", "low", True, False, False, None), ("T-1", "negative 1", False, True, False, None)]
    row = fixtures.fixture_summary(fixtures.run_fixtures(spark, [rule])).first()
    assert tuple(row) == (3, 1, 2, ["7"], ["low"], ["negative 1"])
    assert fixtures.run_fixtures(spark, []).count() == 0
    with pytest.raises(RuleError):
        fixtures.rule_fixtures(parse_rule(spec({"s": {"a": 1}, "condition": "s"}, tests={"positive": [1]})))
    catalogue = spark.createDataFrame([("T-1", "old", 1, True), ("T-2", "x", 4, False)], "rule_id string, title string, version int, enabled boolean")
    edited = analytics.edit_rule(catalogue, rule, "T-1", {"title": F.lit("new")})
    assert sorted(map(tuple, edited.collect())) == [("T-1", "new", 2, True), ("T-2", "x", 4, False)]
    with pytest.raises(ValueError):
        analytics.edit_rule(catalogue, rule, "T-2", {})
    assert sorted(r.enabled for r in analytics.toggle_rule(catalogue, "T-2").collect()) == [True, True]


def test_fingerprint(spark):
    keys = ["plain", 'q"u\\o', "tab\t\n\r\b\f\x01\x1f\x7f", "\u00e9\u20ac\U0001f600", "", "end\n"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i long")
    got = df.select("k", "i", detect.fingerprint(F.lit("WF-1"), F.col("k"), F.col("i")).alias("f")).collect()
    for r in got:
        assert r.f == hashlib.sha256(json.dumps(["WF-1", r.k, r.i], separators=(",", ":")).encode()).hexdigest(), r.k
