"""Queries with a pack of a thousand rules, and their SQL."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.functions.rules import Rule, parse_pack
from watchfire.jobs.security import _E, _H
from watchfire.operators import analytics, detect
from watchfire.sources.security_events import security_events

_TYPES = ["failed_login", "successful_login", "network_connection", "web_request", "process_create"]
_SOURCES = ["linux_auth", "suricata", "nginx", "windows"]
_LEVELS = ["low", "medium", "high", "critical"]


def _rule(id: str, detection: dict, correlation: dict | None = None) -> dict:
    more = {"correlation": correlation} if correlation else {}
    return {"id": id, "title": f"Rule {id}", "level": _LEVELS[int(id[-1]) % 4], "logsource": {"category": "any"}, "detection": detection | more}


@lru_cache(maxsize=1)
def thousand() -> tuple[Rule, ...]:
    """Rules of six families: users, literals in messages, conditions with or and not, patterns with numbers, raw fields and
    patterns that only Python reads."""
    rules = [_rule(f"USR-{i:03d}", {"s": {"event_type": _TYPES[i % 5], "username": f"USER{i}"}, "condition": "s"}) for i in range(400)]
    rules += [_rule(f"LIT-{i:03d}", {"s": {"message|contains": f"Event {11 * i} of"}, "t": {"message|startswith": f"event {i}"}, "u": {"message|endswith": "click"}, "condition": "s or t and u"}) for i in range(250)]
    rules += [
        _rule(f"CND-{i:03d}", {"a": {"source": _SOURCES[i % 4]}, "b": {"hostname": [f"host-{i % 20}", f"host-{i * 7 % 20}"]}, "c": {"severity": ["critical", "high"]}, "d": {"destination_port|lt": i % 9}, "condition": "(a or d) and b and not c"})
        for i in range(150)
    ]
    rules += [_rule(f"PAT-{i:03d}", {"s": {"source": _SOURCES[i % 4], "source_ip|re": rf"^10\.0\.{i % 7}\.{i}$", "destination_port|gte": i % 50}, "condition": "s"}) for i in range(150)]
    rules += [_rule(f"RAW-{i:03d}", {"s": {"k": [i, i + 1]}, "t": {"severity": "high"}, "u": {"command_line|exists": True}, "condition": "not u and s and t"}) for i in range(45)]
    rules += [_rule(f"PYT-{i:03d}", {"s": {"username|re": rf"^(?P<a>user{i})\Z"}, "condition": "s"}) for i in range(5)]
    return tuple(parse_pack(rules))


def match_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event against a thousand rules."""
    return detect.matched_events(security_events(spark, sf_dir), list(thousand())).select("id", "rule_id")


@lru_cache(maxsize=1)
def correlated() -> tuple[Rule, ...]:
    """400 rules of single events, 400 counts and 200 sequences, with different keys, thresholds and timeframes."""
    keys = [["source_ip"], ["hostname"], ["username"], ["source_ip", "hostname"], ["destination_port"]]
    rules = [_rule(f"CNT-{i:03d}", {"s": {"event_type": _TYPES[i % 5], "hostname": f"host-{i * 3 % 20}"}, "condition": "s"},
                   {"type": "count", "threshold": 2 + i % 4, "timeframe": f"{6 + i % 30}h", "group_by": keys[i // 5 % 5]}) for i in range(400)]
    rules += [_rule(f"SEQ-{i:03d}", {"a": {"event_type": _TYPES[i % 5]}, "b": {"event_type": _TYPES[i // 5 % 5], "severity": _LEVELS[i % 4]}, "condition": "a or b"},
                    {"type": "sequence", "sequence": ["a", "b"], "timeframe": f"{1 + i % 40}h", "group_by": ["username"]}) for i in range(200)]
    return tuple(parse_pack(rules)) + thousand()[:400]


def alerts_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a thousand rules of all kinds."""
    found = detect.all_alerts(security_events(spark, sf_dir), list(correlated()), repeats=False)
    return found.select("rule_id", "entity_key", "event_id", "us", "severity", "title")


def backtest_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a labelled example of one of the thousand rules, expected where it is a failed login."""
    ids = F.array(*[F.lit(r.id) for r in thousand()])
    e = security_events(spark, sf_dir).withColumns({"rule_id": F.get(ids, (F.col("id") % len(thousand())).cast("int")), "expected": F.col("event_type") == "failed_login"})
    return analytics.backtest(e, list(thousand()))


QUERIES = {"match_many": match_many, "alerts_many": alerts_many, "backtest_many": backtest_many}

_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
_ID = lambda kind: f"'{kind}-' || lpad(CAST(i AS VARCHAR), 3, '0')"
_USERS = f"SELECT id, us, {_ID('USR')} AS rule_id, concat_ws('|', source_ip, hostname, username) AS entity_key FROM e JOIN range(400) r(i) ON username = 'user' || i AND event_type = {_LIST(_TYPES)}[1 + i % 5]"
_MANY = f"""{_E}, single AS ({_USERS}),
    c0 AS (SELECT {_ID('CNT')} AS rule_id, id, us, 2 + i % 4 AS n, (6 + i % 30) * {_H} AS frame, CASE i // 5 % 5 WHEN 0 THEN source_ip WHEN 1 THEN hostname WHEN 2 THEN username
            WHEN 3 THEN source_ip || '|' || hostname ELSE CASE WHEN destination_port IS NULL THEN NULL WHEN destination_port = 0 THEN 'unknown' ELSE CAST(destination_port AS VARCHAR) END END AS entity_key
        FROM e JOIN range(400) r(i) ON event_type = {_LIST(_TYPES)}[1 + i % 5] AND hostname = 'host-' || (i * 3 % 20)),
    c1 AS (SELECT *, us - CASE n WHEN 2 THEN lag(us, 1) OVER w WHEN 3 THEN lag(us, 2) OVER w WHEN 4 THEN lag(us, 3) OVER w ELSE lag(us, 4) OVER w END AS gap
        FROM c0 WHERE entity_key IS NOT NULL WINDOW w AS (PARTITION BY rule_id, entity_key ORDER BY us, id)),
    c2 AS (SELECT *, row_number() OVER (PARTITION BY rule_id, entity_key ORDER BY us, id) AS first FROM c1 WHERE gap <= frame),
    s0 AS (SELECT {_ID('SEQ')} AS rule_id, username, id, us, event_type = {_LIST(_TYPES)}[1 + i % 5] AS a, event_type = {_LIST(_TYPES)}[1 + i // 5 % 5] AND severity = {_LIST(_LEVELS)}[1 + i % 4] AS b,
            (1 + i % 40) * {_H} AS frame FROM e, range(200) r(i)),
    s1 AS (SELECT *, min(CASE WHEN b THEN {{'us': us, 'id': id}} END) OVER (PARTITION BY rule_id, username ORDER BY us, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS t FROM s0 WHERE a OR b),
    s2 AS (SELECT *, row_number() OVER (PARTITION BY rule_id, username ORDER BY us, id) AS first FROM s1 WHERE a AND t.us - us <= frame),
    found AS (SELECT rule_id, entity_key, id AS event_id, us FROM single UNION ALL SELECT rule_id, entity_key, id, us FROM c2 WHERE first = 1
        UNION ALL SELECT rule_id, username, t.id, t.us FROM s2 WHERE first = 1)"""
ORACLES = {
    "match_many": f"""WITH {_E} SELECT id, rule_id FROM ({_USERS})
        UNION ALL SELECT id, {_ID("LIT")} FROM e JOIN range(250) r(i) ON contains(message, 'event ' || 11 * i || ' of') OR starts_with(message, 'event ' || i) AND ends_with(message, 'click')
        UNION ALL SELECT id, {_ID("CND")} FROM e JOIN range(150) r(i) ON (source = {_LIST(_SOURCES)}[1 + i % 4] OR coalesce(destination_port < i % 9, false))
            AND hostname IN ('host-' || i % 20, 'host-' || i * 7 % 20) AND severity NOT IN ('critical', 'high')
        UNION ALL SELECT id, {_ID("PAT")} FROM e JOIN range(150) r(i) ON source = {_LIST(_SOURCES)}[1 + i % 4] AND source_ip = '10.0.' || i % 7 || '.' || i AND destination_port >= i % 50
        UNION ALL SELECT id, {_ID("RAW")} FROM e JOIN range(45) r(i) ON json_extract_string(raw_data, '$.k') IN (CAST(i AS VARCHAR), CAST(i + 1 AS VARCHAR)) AND severity = 'high'
        UNION ALL SELECT id, {_ID("PYT")} FROM e JOIN range(5) r(i) ON username = 'user' || i""",
    "alerts_many": f"""WITH {_MANY} SELECT rule_id, entity_key, event_id, us, {_LIST(_LEVELS)}[1 + CAST(rule_id[-1:] AS INT) % 4] AS severity, 'Rule ' || rule_id AS title FROM found""",
}
_FAMILIES = "[" + ", ".join(f"{{'kind': '{k}', 'n': {n}}}" for k, n in (("USR", 400), ("LIT", 250), ("CND", 150), ("PAT", 150), ("RAW", 45), ("PYT", 5))) + "]"
ORACLES["backtest_many"] = f"""WITH f AS (SELECT unnest({_FAMILIES}, recursive := true)), ids AS (SELECT kind || '-' || lpad(CAST(i AS VARCHAR), 3, '0') AS rule_id,
        row_number() OVER (ORDER BY list_position(['USR', 'LIT', 'CND', 'PAT', 'RAW', 'PYT'], kind), i) - 1 AS place FROM f JOIN range(400) r(i) ON i < n),
    hits AS ({ORACLES['match_many']}), {_E.replace('e AS', 'l0 AS')}, l AS (SELECT l0.id, rule_id, event_type = 'failed_login' AS x FROM l0 JOIN ids ON place = l0.id % 1000),
    y AS (SELECT l.rule_id, x, hits.id IS NOT NULL AS y FROM l LEFT JOIN hits ON hits.id = l.id AND hits.rule_id = l.rule_id)
    SELECT rule_id, count(*) AS total, count(*) FILTER (x = y) AS passed, count(*) FILTER (x AND NOT y) AS missed_positives, count(*) FILTER (y AND NOT x) AS unexpected_matches FROM y GROUP BY ALL"""
