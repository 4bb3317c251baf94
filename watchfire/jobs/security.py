"""The registered queries of the security library and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.functions.rules import parse_pack, parse_rule
from watchfire.operators import analytics, detect, incidents, reports
from watchfire.sources import normalize
from watchfire.sources.security_events import adapter_cte, security_events
from watchfire.storage import written


def _rule(id, title, level, detection, technique=None):
    return {"id": id, "title": title, "level": level, "logsource": {"category": "any"}, "detection": detection, "mitre": {"technique": technique} if technique else {}}


#: The pack that the queries run: one rule of each kind and predicates of each modifier.
PACK = parse_pack(
    [
        _rule("WF-001", "Critical network event", "high", {"selection": {"source": "suricata", "severity|contains": "crit"}, "condition": "selection"}, "T1046"),
        _rule("WF-002", "Process start of low users", "critical", {"a": {"event_type": "process_create"}, "b": {"username|re": "^user1\\d$"}, "condition": "a and b"}, "T1059.001"),
        _rule("WF-010", "Failed logins", "high", {"selection": {"event_type": "failed_login"}, "condition": "selection",
              "correlation": {"type": "count", "threshold": 3, "timeframe": "24h", "group_by": ["source_ip"]}}, "T1110"),
        _rule("WF-011", "Connections of a host", "medium", {"selection": {"event_type": "network_connection"}, "condition": "selection",
              "correlation": {"type": "count", "threshold": 5, "timeframe": "12h", "group_by": ["hostname"]}}, "T1046"),
        _rule("WF-020", "Login after failures", "critical", {"fail": {"event_type": "failed_login"}, "ok": {"event_type": "successful_login"}, "condition": "fail or ok",
              "correlation": {"type": "sequence", "sequence": ["fail", "ok"], "timeframe": "12h", "group_by": ["username"]}}, "T1078"),
    ]
)

#: name -> (selections and condition, the same as SQL over the adapter's columns).
PREDICATES = {
    "equals": ({"s": {"event_type": "FAILED_LOGIN"}, "condition": "s"}, "lower(event_type) = 'failed_login'"),
    "list": ({"s": {"severity": ["high", "CRITICAL"]}, "condition": "s"}, "severity IN ('high', 'critical')"),
    "contains": ({"s": {"message|contains": "PURCH"}, "condition": "s"}, "contains(lower(message), 'purch')"),
    "prefix": ({"s": {"username|startswith": "USER1"}, "condition": "s"}, "starts_with(username, 'user1')"),
    "suffix": ({"s": {"hostname|endswith": "-7"}, "condition": "s"}, "ends_with(hostname, '-7')"),
    "regex": ({"s": {"source_ip|re": "^10\\.0\\.[0-3]\\.\\d+$"}, "condition": "s"}, "regexp_matches(source_ip, '^10\\.0\\.[0-3]\\.\\d+$')"),
    "exists": ({"s": {"destination_port|exists": True, "command_line|exists": False}, "condition": "s"}, "destination_port IS NOT NULL AND command_line IS NULL"),
    "numeric": ({"s": {"destination_port|gte": 50, "raw_data.k|lt": 80}, "condition": "s"}, "destination_port >= 50 AND CAST(json_extract_string(raw_data, '$.k') AS DOUBLE) < 80"),
    "condition": (
        {"a": {"source": "nginx"}, "b": {"severity": "info"}, "c": {"process_name|exists": True}, "condition": "a and not (b or c)"},
        "source = 'nginx' AND NOT (severity = 'info' OR process_name IS NOT NULL)",
    ),
    "rawpath": ({"s": {"k": [1, 2, 3]}, "condition": "s"}, "json_extract_string(raw_data, '$.k') IN ('1', '2', '3')"),
}


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.all_alerts(security_events(spark, sf_dir), PACK, repeats=False)


def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as the jobs after detection read them: from the table that detection wrote."""
    return written(alerts(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, matches, alerts of all three kinds, scored incidents."""
    return incidents.incidents(stored_alerts(spark, sf_dir), PACK).drop("techniques")


def _match(detection: dict):
    rule = parse_pack([_rule("WF-900", "predicate", "low", detection)])

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return detect.matched_events(security_events(spark, sf_dir), rule).select("id", "rule_id")

    return query


def _kind(function):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return function(security_events(spark, sf_dir), PACK, repeats=False).select("rule_id", "entity_key", "event_id", "us")

    return query


def alerts_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run over the same events when the alerts of the first are stored."""
    events = security_events(spark, sf_dir)
    return detect.all_alerts(events, PACK, stored=stored_alerts(spark, sf_dir), repeats=False).select("rule_id", "entity_key", "event_id", "us")


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every incident is queried, and all are candidates."""
    found = written(incidents.incidents(stored_alerts(spark, sf_dir), PACK))
    named = found.select("incident_id", "entity_key", "session_start")
    best = incidents.similar_incidents(found, found).withColumn("reasons", F.array_join("reasons", "; "))
    a, b = named.select(F.col("incident_id").alias("q_id"), F.col("entity_key").alias("q_entity"), F.col("session_start").alias("q_start")), named
    return best.join(a, "q_id").join(b, "incident_id").select("q_entity", "q_start", "entity_key", "session_start", "score", "rank", "reasons")


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.assigned_alerts(stored_alerts(spark, sf_dir)).select("rule_id", "event_id", "entity_key", "session_start", "incident_id", "status")


def alert_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the evidence of every alert says, field by field."""
    get = lambda path: F.get_json_object("evidence", path)
    listed = lambda path: F.array_join(F.from_json(get(path), "array<string>"), ",")
    return alerts(spark, sf_dir).select(
        "rule_id", "entity_key", "event_id", get("$.type").alias("type"), get("$.count").cast("long").alias("count"), get("$.threshold").cast("long").alias("threshold"),
        get("$.timeframe").alias("timeframe"), listed("$.group_by").alias("group_by"), listed("$.stages").alias("stages"), listed("$.event_ids").alias("event_ids"),
        get("$.event.username").alias("username"), (get("$.alert_fingerprint") == F.col("alert_fingerprint")).alias("signed"),
    )


def _lines(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Events of a kind written out as raw lines of its sensor, in all the forms that it has, by id."""
    e = security_events(spark, sf_dir)
    t, k = F.timestamp_micros("us"), F.col("destination_port")
    form = lambda n, *values: F.get(F.array(*values), (F.col("id") % n).cast("int"))
    six = F.concat(F.lit("2001:0DB8:0:0::"), (k + 1).cast("string"))
    if kind == "linux":
        e = e.where("source = 'linux_auth'")
        failed, accepted = F.lit("Failed password for "), F.lit("Accepted publickey for ")
        text = lambda verb, user, host: F.concat(verb, user, F.lit(" from "), host, F.lit(" port "), k.cast("string"))
        user, four = F.col("username"), F.col("source_ip")
        said = form(
            8, text(failed, F.concat(F.lit("invalid user "), user), four), text(failed, user, four), text(accepted, user, four), text(failed, user, four), text(failed, user, six),
            F.lit("new user: name=x"), text(failed, user, F.lit("evil.example")), text(accepted, user, six),
        )
        line = F.concat(form(8, *[F.lit("<34>" if i == 3 else "") for i in range(8)]), F.date_format(t, "MMM d HH:mm:ss"), F.lit(" srv sshd[1]: "), said)
    elif kind == "nginx":
        e = e.where("source = 'nginx'")
        host = form(6, *["source_ip"] * 5, F.concat(F.lit("proxy: "), six))
        path = form(6, *map(F.lit, ("/a/../b", "/q?x=UNION+SELECT", "/index.html", "/%2E%2e/x", "/index.html", "/<SCRIPT>")))
        tail = form(6, *map(F.lit, ['"-" "agent"'] * 4 + ['"-"', '"-" "agent"']))
        line = F.concat(host, F.lit(" - - ["), F.date_format(t, "dd/MMM/yyyy:HH:mm:ss"), F.lit(' +0000] "GET '), path, F.lit(' HTTP/1.1" 200 12 '), tail)
    elif kind == "suricata":
        e = e.where("source = 'suricata'")
        alert = lambda severity: F.concat(F.lit('"alert": {"signature": "Sig", "severity": '), severity, F.lit("}"))
        what = form(
            8, F.concat(F.lit('"alert", '), alert((k % 5).cast("string"))), F.lit('"alert"'), F.concat(F.lit('"flow", '), alert(F.lit("1"))), F.lit('"dns", "dns": {"rrname": "a.example"}'), F.lit('"dns"'),
            F.concat(F.lit('"alert", '), alert(F.lit('"2"'))), F.concat(F.lit('"alert", '), alert(F.lit("null"))), F.lit('"network_connection"'),
        )
        line = F.concat(
            F.lit('{"timestamp": "'), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('", "src_ip": "'), F.when(k % 2 == 1, six).otherwise(F.col("source_ip")),
            F.lit('", "dest_ip": "10.0.0.300", "dest_port": '), k.cast("string"), F.lit(', "event_type": '), what, F.lit("}"),
        )
    elif kind == "windows":
        e = e.where("source = 'windows'")
        code = form(10, *map(F.lit, (1, 3, 1102, 4624, 4625, 4688, 4720, 4728, 7045, 9999)))
        none = F.lit(None).cast("string")
        inner = F.struct(form(3, F.lit("inner"), F.col("username"), none).alias("targetusername"), F.lit("192.0.2.9").alias("IpAddress"))
        line = F.to_json(F.struct(
            code.alias("EventID"), F.date_format(t, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("UtcTime"), F.col("hostname").alias("Computer"), form(3, F.col("username"), none, F.lit("subject")).alias("User"),
            form(3, none, none, F.col("username")).alias("TargetUserName"), form(3, F.col("source_ip"), none, none).alias("SourceIp"), form(2, F.lit("whoami"), none).alias("ProcessCommandLine"), inner.alias("EventData"),
        ))
    else:
        line = F.to_json(F.struct(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.upper("severity").alias("severity"), F.col("username"), F.col("message")))
    return e.select(F.col("id"), line.alias("line"))


_NORMALISED = ["id", "us", "source", "event_type", "severity", "source_ip", "destination_ip", "source_port", "destination_port", "username", "hostname", "command_line", "message", "ts_defaulted"]


def _normalised(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return normalize.normalise(_lines(spark, sf_dir, kind), "auto", default_year=2024, ingest_us=0).select(*_NORMALISED)

    return query


def _as_long(found: DataFrame, name: str) -> DataFrame:
    """found, a small table whose column name has exact sums as DECIMAL: as BIGINT, the type that SQL gives them, if all of them
    are in its range; else as they are, so that no sum fails or is cut."""
    found = written(found)
    most = found.agg(F.max(F.abs(name))).first()[0]
    return found if most is not None and most >= 2**63 else found.withColumn(name, F.col(name).cast("long"))


def normalize_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all sensors in one input: what each becomes. Sums of times pass the range of BIGINT from some 5400 rows on."""
    lines = [_lines(spark, sf_dir, k) for k in ("linux", "nginx", "suricata", "windows", "generic")]
    found = normalize.normalise(reduce(DataFrame.unionByName, lines), "auto", default_year=2024, ingest_us=0)
    found = found.groupBy("source", "event_type", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("us").cast("decimal(28,0)")).alias("us"))
    return _as_long(found, "us")


def normalize_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suricata lines, of which every fifth has a severity that is no number: those are put aside."""
    broken = F.regexp_replace("line", '"severity": [^}]+', '"severity": "high"')
    lines = _lines(spark, sf_dir, "suricata").withColumn("line", F.when(F.col("id") % 5 == 0, broken).otherwise(F.col("line")))
    return normalize.rejects(lines).select("id", "problem")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found = stored_alerts(spark, sf_dir).withColumn("status", F.when(F.col("event_id") % 3 == 0, "resolved").otherwise("new"))
    inc = incidents.incidents(found, PACK).withColumn("status", F.when(F.col("alert_count") > 1, "open").otherwise("closed"))
    return found, inc


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, inc = _stored(spark, sf_dir)
    tests = security_events(spark, sf_dir).select((F.col("id") % 8 != 0).alias("passed"))
    return analytics.dashboard(security_events(spark, sf_dir), found, inc, tests, now_us=1_706_600_000_000_000)


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = analytics.rule_table(spark, PACK).select("rule_id", "tactic", "technique", (F.col("rule_id") != "WF-002").alias("enabled"))
    e = security_events(spark, sf_dir)
    tests = e.select(F.when(F.col("source") == "nginx", "WF-001").when(F.col("source") == "suricata", "WF-010").otherwise("WF-002").alias("rule_id"), ((F.col("source") != "suricata") | (F.col("id") % 50 == 0)).alias("passed"))
    return analytics.coverage(rules, tests)


def _part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts table stands for a large catalogue: a rule with no, one or two techniques, a tactic or none, enabled or not."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    known = F.array(*[F.lit(t) for t in ("T1110", "T1078", "T1046", "T1190", "T9999")])
    one, two = F.get(known, (k % 5).cast("int")), F.get(known, (k % 3).cast("int"))
    listed = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(one)).otherwise(F.array_distinct(F.array(one, two)))
    tactic = F.when(k % 7 == 0, F.lit(None)).when(k % 7 == 1, "").when(k % 7 < 5, "Discovery").otherwise("Execution")
    return p.select(F.concat(F.lit("R"), k.cast("string")).alias("rule_id"), F.col("p_name").alias("title"), F.get(F.array(*map(F.lit, ("low", "medium", "high"))), (k % 3).cast("int")).alias("level"),
                    listed.alias("techniques"), F.get(listed, F.lit(0)).alias("technique"), tactic.alias("tactic"), (k % 6 != 0).alias("enabled"))


def attack_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.attack_techniques(_part_rules(spark, sf_dir).where("enabled"))
    return found.select("technique", "name", "tactic", F.size("rules").cast("long").alias("rules"))


def attack_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.attack_summary(_part_rules(spark, sf_dir).where("enabled"))


def rules_by_tactic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.count_by(_part_rules(spark, sf_dir).where("enabled"), "tactic", "Unmapped")


def search_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.search(_part_rules(spark, sf_dir), "t10", ["title", "rule_id", "technique"], {"level": "medium"}, None, "rule_id")
    return found.select("rule_id", "technique", "level")


def quality_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.count_by(coverage_matrix(spark, sf_dir), "status")


def rule_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a labelled example of one rule: expected where its source is the rule's."""
    e = security_events(spark, sf_dir)
    rule = F.when(F.col("id") % 2 == 0, "WF-001").otherwise("WF-002")
    return analytics.backtest(e.withColumns({"rule_id": rule, "expected": F.col("source").isin("suricata", "windows")}), PACK[:2])


def rule_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts table stands for a catalogue, of which a pack changes some rules and adds others."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("rule_id"), F.col("p_brand").alias("title"), F.col("p_type").alias("level"), F.col("p_partkey").alias("k"))
    old = p.where("k % 5 <> 0").select("rule_id", "title", "level", F.lit(3).alias("version"), (F.col("k") % 2 == 0).alias("enabled"))
    pack = p.where("k % 3 = 0").select("rule_id", F.when(F.col("k") % 2 == 0, F.upper("title")).otherwise(F.lit("new")).alias("title"), "level")
    return analytics.upsert_rules(old, pack, ["title", "level"])


def rule_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same catalogue after an edit of one rule, which raises its version, and a toggle of another."""
    rules = _part_rules(spark, sf_dir).select("rule_id", "title", "level", F.lit(1).alias("version"), "enabled")
    edited = analytics.edit_rule(rules, parse_rule(_rule("R10", "New title", "high", {"s": {"a": 1}, "condition": "s"})), "R10", {"title": F.lit("New title"), "level": F.lit("high")})
    return analytics.toggle_rule(edited, "R12")


def rule_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items stand for a pack whose rules are the parts: ids that it has more than once."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("R"), F.col("l_partkey").cast("string")).alias("rule_id"))
    return analytics.duplicate_rules(items)


def newest_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = security_events(spark, sf_dir).where("source = 'windows'")
    tests = e.select("id", "us", (F.col("id") % 8 != 0).alias("passed"))
    return analytics.newest(tests, "us", "id", 30)


def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the audit rows, where the events of each user and source are a batch."""
    rows = normalize.audit_rows(security_events(spark, sf_dir), ["username", "source"])
    rows = rows.withColumn("n", F.col("entity_id").cast("long"))
    return analytics.page(analytics.search(rows, None, [], {"action": "events_ingested"}, "n", "n"), 2, 30).select("username", "source", "entity_id", "details")


def report_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidents with their alerts as sorted lists, an hour and a thousand alerts at most in a row."""
    found = stored_alerts(spark, sf_dir)
    parts = reports.incident_payloads(incidents.incidents(found, PACK), incidents.assigned_alerts(found), analytics.rule_table(spark, PACK))
    shown = F.transform("alerts", lambda x: F.concat_ws(":", x["rule_id"], x["event_id"].cast("string"), x["mitre_technique"], x["mitre_tactic"], x["status"]))
    return parts.select("entity_key", "session_start", "title", "status", F.col("hour").cast("long").alias("hour"), F.col("part").cast("long").alias("part"), F.array_join(shown, ",").alias("alerts"))


def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.alert_rows(incidents.assigned_alerts(stored_alerts(spark, sf_dir)), analytics.rule_table(spark, PACK))
    return rows.drop("created_at")


def alert_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, events = stored_alerts(spark, sf_dir), security_events(spark, sf_dir).select("id", "hostname", "source_ip")
    rows = reports.alert_details(incidents.assigned_alerts(found), analytics.rule_table(spark, PACK), events, incidents.incidents(found, PACK))
    return rows.select("rule_id", "rule", "mitre_tactic", "entity_key", "event_id", "event.hostname", "event.source_ip", "incident.risk_score", F.col("incident.severity").alias("incident_severity"), "alert_fingerprint")


def incident_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.incident_timeline(incidents.assigned_alerts(stored_alerts(spark, sf_dir)), analytics.rule_table(spark, PACK))
    return rows.select("entity_key", "session_start", "rule_id", "event_id", F.col("place").cast("long").alias("place"))


def audit_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row for each ingested batch: here, each source is a batch."""
    return normalize.audit_rows(security_events(spark, sf_dir), ["source"])


_COLUMNS = ["id", "us", "source", "severity", "message"]


def search_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.search(security_events(spark, sf_dir), "user1", ["message", "source_ip", "username", "hostname"], {"source": "windows", "severity": "high"}, "us", "id").select(*_COLUMNS)


def search_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.search(alerts(spark, sf_dir), "host-1", ["title", "entity_key"], {"severity": "high"}, "us", "event_id").select("rule_id", "event_id", "entity_key")


def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.page(analytics.search(security_events(spark, sf_dir), None, [], {"source": "nginx"}, "us", "id"), 3, 25).select(*_COLUMNS)


def search_page_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.page_info(security_events(spark, sf_dir).where("source = 'nginx'"), 3, 25)


def search_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.search(_stored(spark, sf_dir)[1], "user1", ["title", "entity_key", "summary"], {"severity": "critical", "status": "closed"}, "session_end", "incident_id")
    return found.select("entity_key", "session_start", "title", "severity")


def newest_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.newest(incidents.incidents(stored_alerts(spark, sf_dir), PACK), "session_end", "incident_id", 6).select("incident_id", "entity_key", "session_end")


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.newest(security_events(spark, sf_dir), "us", "id", 100).select(*_COLUMNS)


def newest_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.newest(alerts(spark, sf_dir).withColumn("tie", F.concat_ws("|", "rule_id", F.lpad(F.col("event_id").cast("string"), 12, "0"))), "us", "tie", 8).select("rule_id", "event_id", "us")


def _by(column: str):
    return lambda spark, sf_dir: analytics.count_by(security_events(spark, sf_dir), column)


def alerts_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.count_by(alerts(spark, sf_dir), "severity")


def incidents_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.count_by(_stored(spark, sf_dir)[1], "status")


def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security_events(spark, sf_dir).select("source").distinct()


def alerts_count_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count correlation with keys of more than 20 matches split into time buckets: the same result."""
    return detect.count_alerts(security_events(spark, sf_dir), PACK, hot_rows=20, share=10**9, repeats=False).select("rule_id", "entity_key", "event_id", "us")


QUERIES = {
    "incidents": flagship, "alerts_single": _kind(detect.single_alerts), "alerts_count": _kind(detect.count_alerts),
    "alerts_count_bucketed": alerts_count_bucketed, "alerts_sequence": _kind(detect.sequence_alerts), "alerts_all": lambda s, d: alerts(s, d).drop("event_ids", "evidence"), "alert_evidence": alert_evidence,
    "alerts_replay": alerts_replay, "incident_assignments": assignments, "similar_incidents": similar, "stats_dashboard": stats,
    "timeline": lambda s, d: analytics.timeline(security_events(s, d)).select("hour", "n"), "events_by_source": _by("source"), "events_by_severity": _by("severity"),
    "alerts_by_severity": alerts_by_severity, "incidents_by_status": incidents_by_status, "coverage_matrix": coverage_matrix, "quality_summary": quality_summary,
    "search_events": search_events, "search_alerts": search_alerts, "search_page": search_page, "newest_events": newest_events, "newest_alerts": newest_alerts,
    "distinct_sources": distinct_sources, "report_payload": report_payload, "report_rows": report_rows, "rule_upsert": rule_upsert, "rule_backtest": rule_backtest,
    "audit_batch": audit_batch, "attack_coverage": attack_coverage, "attack_summary": attack_summary, "rules_by_tactic": rules_by_tactic, "search_rules": search_rules,
    "search_page_info": search_page_info, "search_incidents": search_incidents, "newest_incidents": newest_incidents, "alert_details": alert_details, "incident_timeline": incident_timeline,
    "rule_edits": rule_edits, "rule_duplicates": rule_duplicates, "newest_tests": newest_tests, "audit_page": audit_page, "normalize_auto": normalize_auto, "normalize_rejects": normalize_rejects,
    **{f"match_{k}": _match(d) for k, (d, _) in PREDICATES.items()},
    **{f"normalize_{k}": _normalised(k) for k in ("linux", "nginx", "suricata", "windows", "generic")},
}

# --- the same as SQL ---------------------------------------------------------------------------------------------------

_E = f"e AS ({adapter_cte()})"
_H = 3_600_000_000
_COUNT = lambda rule, kind, key, n, hours: f"""
    SELECT '{rule}' AS rule_id, {key} AS entity_key, id AS event_id, us FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY us, id) AS first FROM (
            SELECT *, us - lag(us, {n - 1}) OVER (PARTITION BY {key} ORDER BY us, id) AS gap FROM e WHERE event_type = '{kind}')
        WHERE gap <= {hours * _H}) WHERE first = 1"""  # noqa: E731
_SINGLE_KEY = "concat_ws('|', source_ip, hostname, username)"
_SINGLE = f"""
    SELECT 'WF-001' AS rule_id, {_SINGLE_KEY} AS entity_key, id AS event_id, us FROM e WHERE source = 'suricata' AND contains(severity, 'crit')
    UNION ALL SELECT 'WF-002', {_SINGLE_KEY}, id, us FROM e WHERE event_type = 'process_create' AND regexp_matches(username, '^user1\\d$')"""
_COUNTS = _COUNT("WF-010", "failed_login", "source_ip", 3, 24) + " UNION ALL " + _COUNT("WF-011", "network_connection", "hostname", 5, 12)
_NEXT = f"""n AS (SELECT f.username, f.us AS start_us, f.id AS start_id, (SELECT min({{'us': o.us, 'id': o.id}}) FROM e o
    WHERE o.event_type = 'successful_login' AND o.username = f.username AND (o.us > f.us OR (o.us = f.us AND o.id > f.id))) AS t
    FROM e f WHERE f.event_type = 'failed_login'),
    ok AS (SELECT username, start_us, start_id, t.id AS event_id, t.us AS us FROM n WHERE t.us - start_us <= {12 * _H})"""
_FIRST = lambda source: f"""SELECT 'WF-020' AS rule_id, username AS entity_key, event_id, us FROM (
    SELECT *, row_number() OVER (PARTITION BY username ORDER BY start_us, start_id) AS first FROM {source}) WHERE first = 1"""  # noqa: E731
_META = """m(rule_id, title, severity, risk_score, technique) AS (VALUES ('WF-001', 'Critical network event', 'high', 75.0::DOUBLE, 'T1046'),
    ('WF-002', 'Process start of low users', 'critical', 95.0::DOUBLE, 'T1059.001'), ('WF-010', 'Failed logins', 'high', 75.0::DOUBLE, 'T1110'),
    ('WF-011', 'Connections of a host', 'medium', 50.0::DOUBLE, 'T1046'), ('WF-020', 'Login after failures', 'critical', 95.0::DOUBLE, 'T1078'))"""
_A = f"{_E}, {_NEXT}, {_META}, a0 AS ({_SINGLE} UNION ALL {_COUNTS} UNION ALL {_FIRST('ok')}), a AS (SELECT * FROM a0 JOIN m USING (rule_id))"
_S = f"""{_A}, g AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM a WINDOW w AS (PARTITION BY entity_key ORDER BY us, event_id, rule_id)),
    s0 AS (SELECT *, sum(fresh) OVER (PARTITION BY entity_key ORDER BY us, event_id, rule_id ROWS UNBOUNDED PRECEDING) AS nth FROM g),
    s AS (SELECT *, min(us) OVER (PARTITION BY entity_key, nth) AS session_start FROM s0)"""
_I = f"""{_S}, i0 AS (SELECT entity_key, session_start, max(us) AS session_end, count(*) AS alert_count, count(DISTINCT rule_id) AS rule_count,
        max(CAST(risk_score AS INT)) AS top, list_sort(list(DISTINCT technique)) AS techniques FROM s GROUP BY ALL),
    i1 AS (SELECT *, CAST(least(100, top + least(15, 3 * (alert_count - 1)) + least(10, 3 * (rule_count - 1))) AS DOUBLE) AS risk_score FROM i0),
    i AS (SELECT sha256(concat_ws('|', entity_key, CAST(session_start AS VARCHAR))) AS incident_id, entity_key, session_start, session_end, alert_count, rule_count, risk_score,
        CASE WHEN risk_score >= 90 THEN 'critical' WHEN risk_score >= 70 THEN 'high' WHEN risk_score >= 45 THEN 'medium' ELSE 'low' END AS severity,
        techniques, alert_count || ' alert(s), ' || len(techniques) || ' MITRE technique(s): ' || array_to_string(techniques, ', ') AS summary,
        'Correlated activity involving ' || entity_key AS title, 'open' AS status FROM i1)"""
_COVER = f"""{_E}, {_META}, r AS (SELECT rule_id, technique, rule_id <> 'WF-002' AS enabled, CASE technique WHEN 'T1046' THEN 'Discovery' WHEN 'T1059.001' THEN 'Execution'
        WHEN 'T1110' THEN 'Credential Access' ELSE 'Defense Evasion / Persistence' END AS tactic FROM m),
    t AS (SELECT CASE source WHEN 'nginx' THEN 'WF-001' WHEN 'suricata' THEN 'WF-010' ELSE 'WF-002' END AS rule_id, source <> 'suricata' OR id % 50 = 0 AS passed FROM e),
    p AS (SELECT rule_id, count(*) AS n, count(*) FILTER (passed) AS ok FROM t GROUP BY ALL),
    c AS (SELECT rule_id, tactic, technique, coalesce(n, 0) AS tests, CASE WHEN NOT enabled THEN 'disabled' WHEN n IS NULL THEN 'untested' WHEN ok < n THEN 'failed' ELSE 'passed' END AS status,
        CASE WHEN n > 0 THEN round_even(100 * ok / n, 1) ELSE 0 END AS pass_rate,
        CASE tactic WHEN 'Execution' THEN 3 WHEN 'Credential Access' THEN 7 WHEN 'Discovery' THEN 8 ELSE 999 END AS tactic_rank FROM r LEFT JOIN p USING (rule_id))"""
_ID = "sha256(concat_ws('|', entity_key, CAST(session_start AS VARCHAR)))"
_WHOLE = "(us // 1000000) * 1000000"
_NULL = lambda *names: ", ".join(f"CAST(NULL AS VARCHAR) AS {n}" for n in names)

_RULES = """r AS (SELECT 'R' || p_partkey AS rule_id, p_name AS title, ['low', 'medium', 'high'][1 + p_partkey % 3] AS level, p_partkey % 6 <> 0 AS enabled,
    CASE WHEN p_partkey % 4 = 0 THEN [] WHEN p_partkey % 4 = 1 THEN [o] WHEN o = t THEN [o] ELSE [o, t] END AS techniques,
    CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 7 = 1 THEN '' WHEN p_partkey % 7 < 5 THEN 'Discovery' ELSE 'Execution' END AS tactic
    FROM (SELECT *, ['T1110', 'T1078', 'T1046', 'T1190', 'T9999'][1 + p_partkey % 5] AS o, ['T1110', 'T1078', 'T1046'][1 + p_partkey % 3] AS t FROM part))"""
_SIX = "'2001:db8::' || (destination_port + 1)"
#: Normalised forms, from the documented meaning of each line, event id and severity.
_N = {
    "linux": f"""SELECT id, CASE WHEN f = 5 THEN 0 ELSE {_WHOLE} END AS us, 'linux_auth' AS source, CASE WHEN f IN (2, 7) THEN 'successful_login' WHEN f = 5 THEN 'user_created' ELSE 'failed_login' END AS event_type,
        CASE WHEN f IN (2, 7) THEN 'info' ELSE 'medium' END AS severity, CASE WHEN f IN (4, 7) THEN {_SIX} WHEN f <> 5 THEN source_ip END AS source_ip, {_NULL("destination_ip")},
        CASE WHEN f <> 5 THEN destination_port END AS source_port, CAST(NULL AS INT) AS destination_port, CASE WHEN f <> 5 THEN username END AS username, {_NULL("hostname", "command_line")},
        CASE WHEN f = 3 THEN '<34>' ELSE '' END || strftime("timestamp", '%b %-d %H:%M:%S') || ' srv sshd[1]: ' || CASE WHEN f = 5 THEN 'new user: name=x' ELSE
            CASE WHEN f IN (2, 7) THEN 'Accepted publickey for ' WHEN f = 0 THEN 'Failed password for invalid user ' ELSE 'Failed password for ' END || username || ' from '
            || CASE WHEN f IN (4, 7) THEN '2001:0DB8:0:0::' || (destination_port + 1) ELSE source_ip END || ' port ' || destination_port END AS message, f = 5 AS ts_defaulted
        FROM (SELECT *, id % 8 AS f FROM e) WHERE source = 'linux_auth' AND f <> 6""",
    "nginx": f"""SELECT id, {_WHOLE} AS us, 'nginx' AS source, CASE WHEN f IN (0, 3) THEN 'directory_traversal' WHEN f IN (1, 5) THEN 'web_attack' ELSE 'web_request' END AS event_type,
        CASE WHEN f = 2 THEN 'info' ELSE 'high' END AS severity, CASE WHEN f = 5 THEN {_SIX} ELSE source_ip END AS source_ip, {_NULL("destination_ip")}, CAST(NULL AS INT) AS source_port,
        CAST(NULL AS INT) AS destination_port, {_NULL("username", "hostname", "command_line")},
        'GET ' || ['/a/../b', '/q?x=UNION+SELECT', '/index.html', '/%2E%2e/x', '', '/<SCRIPT>'][1 + f] || ' -> 200' AS message, false AS ts_defaulted
        FROM (SELECT *, id % 6 AS f FROM e) WHERE source = 'nginx' AND f <> 4""",
    "suricata": f"""SELECT id, us, 'suricata' AS source, ['alert', 'alert', 'flow', 'dns', 'dns', 'alert', 'alert', 'network_connection'][1 + f] AS event_type,
        CASE WHEN f = 0 THEN CASE destination_port % 5 WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 4 THEN 'low' ELSE 'medium' END WHEN f IN (1, 6) THEN 'medium' WHEN f = 5 THEN 'high' ELSE 'info' END AS severity,
        CASE WHEN destination_port % 2 = 1 THEN {_SIX} ELSE source_ip END AS source_ip, {_NULL("destination_ip")}, CAST(NULL AS INT) AS source_port, destination_port, {_NULL("username", "hostname", "command_line")},
        ['Sig', 'Suricata alert', 'flow', 'DNS query: a.example', 'DNS query: unknown', 'Sig', 'Sig', 'network_connection'][1 + f] AS message, false AS ts_defaulted
        FROM (SELECT *, id % 8 AS f FROM e) WHERE source = 'suricata'""",
    "windows": f"""SELECT id, us, 'windows' AS source, ['process_create', 'network_connection', 'security_log_cleared', 'successful_login', 'failed_login', 'process_create', 'user_created',
            'user_added_to_privileged_group', 'service_installed', 'windows_event'][1 + id % 10] AS event_type,
        ['info', 'info', 'critical', 'info', 'medium', 'info', 'high', 'high', 'high', 'info'][1 + id % 10] AS severity,
        CASE WHEN id % 3 = 0 THEN source_ip ELSE '192.0.2.9' END AS source_ip, {_NULL("destination_ip")}, CAST(NULL AS INT) AS source_port, CAST(NULL AS INT) AS destination_port, username, hostname,
        CASE WHEN id % 2 = 0 THEN 'whoami' END AS command_line, 'Windows event ' || [1, 3, 1102, 4624, 4625, 4688, 4720, 4728, 7045, 9999][1 + id % 10] AS message, false AS ts_defaulted
        FROM e WHERE source = 'windows'""",
    "generic": f"""SELECT id, us, 'generic' AS source, 'generic_event' AS event_type, severity, {_NULL("source_ip", "destination_ip")}, CAST(NULL AS INT) AS source_port,
        CAST(NULL AS INT) AS destination_port, username, {_NULL("hostname", "command_line")}, message, false AS ts_defaulted FROM e""",
}

ORACLES = {
    "incidents": f"WITH {_I} SELECT * EXCLUDE (techniques) FROM i",
    "alerts_single": f"WITH {_E} {_SINGLE}",
    "alerts_count": f"WITH {_E} {_COUNTS}",
    "alerts_count_bucketed": f"WITH {_E} {_COUNTS}",
    "alerts_sequence": f"WITH {_E}, {_NEXT} {_FIRST('ok')}",
    "alerts_all": f"""WITH {_A} SELECT rule_id, entity_key, event_id, us, title, severity, risk_score,
        sha256('["' || rule_id || '","' || entity_key || '",' || event_id || ']') AS alert_fingerprint FROM a""",
    "alerts_replay": f"WITH {_E}, {_NEXT}, seen AS ({_FIRST('ok')}), rest AS (SELECT * FROM ok o WHERE NOT EXISTS (SELECT 1 FROM seen WHERE entity_key = o.username AND event_id = o.event_id)) {_FIRST('rest')}",
    "incident_assignments": f"WITH {_S} SELECT rule_id, event_id, entity_key, session_start, {_ID} AS incident_id, 'investigating' AS status FROM s",
    "alert_evidence": f"""WITH {_A}, w(rule_id, type, threshold, timeframe, group_by, stages, kind, key, n) AS (VALUES
            ('WF-010', 'correlation', 3, '24h', 'source_ip', NULL, 'failed_login', 'source_ip', 3), ('WF-011', 'correlation', 5, '12h', 'hostname', NULL, 'network_connection', 'hostname', 5)),
        c AS (SELECT 'WF-010' AS rule_id, source_ip AS entity_key, id AS event_id, list(id) OVER (PARTITION BY source_ip ORDER BY us, id ROWS 2 PRECEDING) AS ids FROM e WHERE event_type = 'failed_login'
            UNION ALL SELECT 'WF-011', hostname, id, list(id) OVER (PARTITION BY hostname ORDER BY us, id ROWS 4 PRECEDING) FROM e WHERE event_type = 'network_connection'),
        q AS (SELECT 'WF-020' AS rule_id, username AS entity_key, event_id, arg_min(start_id, {{'us': start_us, 'id': start_id}}) AS start_id FROM ok GROUP BY ALL)
        SELECT a.rule_id, a.entity_key, a.event_id, CASE WHEN a.rule_id < 'WF-010' THEN 'single_event' WHEN a.rule_id = 'WF-020' THEN 'sequence' ELSE 'correlation' END AS type,
            CAST(w.n AS BIGINT) AS count, CAST(w.threshold AS BIGINT) AS threshold, coalesce(w.timeframe, CASE WHEN a.rule_id = 'WF-020' THEN '12h' END) AS timeframe,
            coalesce(w.group_by, CASE WHEN a.rule_id = 'WF-020' THEN 'username' END) AS group_by, CASE WHEN a.rule_id = 'WF-020' THEN 'fail,ok' END AS stages,
            CASE WHEN w.n IS NOT NULL THEN array_to_string(c.ids, ',') WHEN a.rule_id = 'WF-020' THEN q.start_id || ',' || a.event_id END AS event_ids,
            CASE WHEN a.rule_id < 'WF-010' THEN e.username END AS username, true AS signed
        FROM a LEFT JOIN w ON w.rule_id = a.rule_id LEFT JOIN c ON c.rule_id = a.rule_id AND c.entity_key = a.entity_key AND c.event_id = a.event_id
            LEFT JOIN q ON q.rule_id = a.rule_id AND q.entity_key = a.entity_key AND q.event_id = a.event_id LEFT JOIN e ON e.id = a.event_id""",
    "similar_incidents": f"""WITH {_I}, x AS (SELECT q.entity_key AS q_entity, q.session_start AS q_start, q.incident_id AS q_id, o.incident_id, o.entity_key, o.session_start,
            CASE WHEN q.entity_key = o.entity_key THEN 60 ELSE 0 END + least(30, 10 * len(list_intersect(q.techniques, o.techniques))) + CASE WHEN q.severity = o.severity THEN 10 ELSE 0 END AS score,
            concat_ws('; ', CASE WHEN q.entity_key = o.entity_key THEN 'same entity' END, CASE WHEN len(list_intersect(q.techniques, o.techniques)) > 0
                THEN 'shared MITRE: ' || array_to_string(list_sort(list_intersect(q.techniques, o.techniques)), ', ') END, CASE WHEN q.severity = o.severity THEN 'same severity' END) AS reasons
            FROM i q, i o WHERE q.incident_id <> o.incident_id),
        y AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, incident_id) AS rank FROM x WHERE score > 0)
        SELECT q_entity, q_start, entity_key, session_start, CAST(score AS BIGINT) AS score, rank, reasons FROM y WHERE rank <= 5""",
    "stats_dashboard": f"""WITH {_I} SELECT (SELECT count(*) FROM e) AS events, (SELECT count(*) FROM e WHERE us >= 1706600000000000 - 86400000000) AS events_24h,
        (SELECT count(*) FROM a WHERE event_id % 3 <> 0) AS open_alerts, (SELECT count(*) FROM i WHERE alert_count > 1) AS open_incidents,
        (SELECT round_even(100 * count(*) FILTER (id % 8 <> 0) / count(*), 1) FROM e) AS test_success""",
    "timeline": f"""WITH {_E}, h AS (SELECT strftime("timestamp", '%m-%d %H:00') AS hour, count(*) AS n, min(us) AS f FROM e GROUP BY ALL) SELECT hour, n FROM h ORDER BY f DESC LIMIT 24""",
    "events_by_source": f"WITH {_E} SELECT source, count(*) AS n FROM e GROUP BY ALL",
    "events_by_severity": f"WITH {_E} SELECT severity, count(*) AS n FROM e GROUP BY ALL",
    "alerts_by_severity": f"WITH {_A} SELECT severity, count(*) AS n FROM a GROUP BY ALL",
    "incidents_by_status": f"WITH {_I} SELECT CASE WHEN alert_count > 1 THEN 'open' ELSE 'closed' END AS status, count(*) AS n FROM i GROUP BY ALL",
    "coverage_matrix": f"WITH {_COVER} SELECT * FROM c",
    "quality_summary": f"WITH {_COVER} SELECT status, count(*) AS n FROM c GROUP BY ALL",
    "search_events": f"""WITH {_E} SELECT id, us, source, severity, message FROM e WHERE source = 'windows' AND severity = 'high'
        AND (message ILIKE '%user1%' OR source_ip ILIKE '%user1%' OR username ILIKE '%user1%' OR hostname ILIKE '%user1%')""",
    "search_alerts": f"WITH {_A} SELECT rule_id, event_id, entity_key FROM a WHERE severity = 'high' AND (title ILIKE '%host-1%' OR entity_key ILIKE '%host-1%')",
    "search_page": f"WITH {_E} SELECT id, us, source, severity, message FROM e WHERE source = 'nginx' ORDER BY us DESC, id LIMIT 25 OFFSET 50",
    "newest_events": f"WITH {_E} SELECT id, us, source, severity, message FROM e ORDER BY us DESC, id LIMIT 100",
    "newest_alerts": f"WITH {_A} SELECT rule_id, event_id, us FROM a ORDER BY us DESC, rule_id, event_id LIMIT 8",
    "distinct_sources": f"WITH {_E} SELECT DISTINCT source FROM e",
    "report_payload": f"""WITH {_S}, r AS (SELECT *, CASE technique WHEN 'T1046' THEN 'Discovery' WHEN 'T1059.001' THEN 'Execution' WHEN 'T1110' THEN 'Credential Access'
            ELSE 'Defense Evasion / Persistence' END AS tactic, (us - session_start) // 3600000000 AS hour FROM s),
        p AS (SELECT *, (row_number() OVER (PARTITION BY entity_key, session_start, hour ORDER BY us, event_id, rule_id) - 1) // 1000 AS part FROM r)
        SELECT entity_key, session_start, 'Correlated activity involving ' || entity_key AS title, 'open' AS status, hour, part,
            string_agg(rule_id || ':' || event_id || ':' || technique || ':' || tactic || ':investigating', ',' ORDER BY us, event_id, rule_id) AS alerts FROM p GROUP BY ALL""",
    "report_rows": f"""WITH {_S} SELECT {_ID} AS incident_id, sha256('["' || rule_id || '","' || entity_key || '",' || event_id || ']') AS alert_fingerprint, title AS alert_title, severity, risk_score,
        title AS rule, technique AS mitre_technique, CASE technique WHEN 'T1046' THEN 'Discovery' WHEN 'T1059.001' THEN 'Execution' WHEN 'T1110' THEN 'Credential Access'
            ELSE 'Defense Evasion / Persistence' END AS mitre_tactic FROM s""",
    "alert_details": f"""WITH {_I} SELECT s.rule_id, s.title AS rule, CASE technique WHEN 'T1046' THEN 'Discovery' WHEN 'T1059.001' THEN 'Execution' WHEN 'T1110' THEN 'Credential Access'
            ELSE 'Defense Evasion / Persistence' END AS mitre_tactic, s.entity_key, event_id, hostname, source_ip, i.risk_score, i.severity AS incident_severity,
        sha256('["' || rule_id || '","' || s.entity_key || '",' || event_id || ']') AS alert_fingerprint
        FROM s LEFT JOIN e ON e.id = event_id LEFT JOIN i ON i.entity_key = s.entity_key AND i.session_start = s.session_start""",
    "incident_timeline": f"WITH {_S} SELECT entity_key, session_start, rule_id, event_id, row_number() OVER (PARTITION BY entity_key, session_start ORDER BY us, event_id, rule_id) AS place FROM s",
    "search_page_info": f"WITH {_E} SELECT CAST(3 AS INT) AS page, count(*) AS total, CAST(greatest(1, ceil(count(*) / 25)) AS BIGINT) AS pages FROM e WHERE source = 'nginx'",
    "search_incidents": f"""WITH {_I} SELECT entity_key, session_start, title, severity FROM i WHERE severity = 'critical' AND alert_count = 1
        AND (title ILIKE '%user1%' OR entity_key ILIKE '%user1%' OR summary ILIKE '%user1%')""",
    "newest_incidents": f"WITH {_I} SELECT incident_id, entity_key, session_end FROM i ORDER BY session_end DESC, incident_id LIMIT 6",
    "attack_coverage": f"""WITH {_RULES}, t AS (SELECT DISTINCT rule_id, unnest(techniques) AS technique FROM r WHERE enabled)
        SELECT technique, CASE technique WHEN 'T1110' THEN 'Brute Force' WHEN 'T1078' THEN 'Valid Accounts' WHEN 'T1046' THEN 'Network Service Discovery' WHEN 'T1190' THEN 'Exploit Public-Facing Application' ELSE 'Custom Mapping' END AS name,
            CASE technique WHEN 'T1110' THEN 'Credential Access' WHEN 'T1078' THEN 'Defense Evasion / Persistence' WHEN 'T1046' THEN 'Discovery' WHEN 'T1190' THEN 'Initial Access' ELSE 'Unmapped' END AS tactic,
            count(*) AS rules FROM t GROUP BY ALL""",
    "attack_summary": f"WITH {_RULES} SELECT count(*) FILTER (len(techniques) > 0) AS mapped_rules, count(*) AS total_rules FROM r WHERE enabled",
    "rules_by_tactic": f"WITH {_RULES} SELECT coalesce(nullif(tactic, ''), 'Unmapped') AS tactic, count(*) AS n FROM r WHERE enabled GROUP BY 1",
    "search_rules": f"WITH {_RULES} SELECT rule_id, techniques[1] AS technique, level FROM r WHERE level = 'medium' AND (title ILIKE '%t10%' OR rule_id ILIKE '%t10%' OR techniques[1] ILIKE '%t10%')",
    "rule_upsert": """WITH p AS (SELECT 'R' || p_partkey AS rule_id, p_brand AS title, p_type AS level, p_partkey AS k FROM part)
        SELECT rule_id, CASE WHEN k % 3 <> 0 THEN title WHEN k % 2 = 0 THEN upper(title) ELSE 'new' END AS title, level,
            CAST(CASE WHEN k % 5 = 0 THEN 1 WHEN k % 3 = 0 AND (CASE WHEN k % 2 = 0 THEN upper(title) ELSE 'new' END) <> title THEN 4 ELSE 3 END AS INT) AS version,
            CASE WHEN k % 5 = 0 THEN true ELSE k % 2 = 0 END AS enabled,
            CASE WHEN k % 5 = 0 THEN 'created' WHEN k % 3 = 0 AND (CASE WHEN k % 2 = 0 THEN upper(title) ELSE 'new' END) <> title THEN 'updated' ELSE 'same' END AS change
        FROM p WHERE k % 5 <> 0 OR k % 3 = 0""",
    "rule_backtest": f"""WITH {_E}, l AS (SELECT CASE WHEN id % 2 = 0 THEN 'WF-001' ELSE 'WF-002' END AS rule_id, source IN ('suricata', 'windows') AS x,
            CASE WHEN id % 2 = 0 THEN source = 'suricata' AND contains(severity, 'crit') ELSE event_type = 'process_create' AND regexp_matches(username, '^user1\\d$') END AS y FROM e)
        SELECT rule_id, count(*) AS total, count(*) FILTER (x = y) AS passed, count(*) FILTER (x AND NOT y) AS missed_positives, count(*) FILTER (y AND NOT x) AS unexpected_matches FROM l GROUP BY ALL""",
    "rule_edits": f"""WITH {_RULES} SELECT rule_id, CASE rule_id WHEN 'R10' THEN 'New title' ELSE title END AS title, CASE rule_id WHEN 'R10' THEN 'high' ELSE level END AS level,
        CASE rule_id WHEN 'R10' THEN 2 ELSE 1 END AS version, enabled <> (rule_id = 'R12') AS enabled FROM r""",
    "rule_duplicates": "SELECT 'R' || l_partkey AS rule_id, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "newest_tests": f"WITH {_E} SELECT id, us, id % 8 <> 0 AS passed FROM e WHERE source = 'windows' ORDER BY us DESC, id LIMIT 30",
    "audit_page": f"""WITH {_E} SELECT username, source, CAST(min(id) AS VARCHAR) AS entity_id, '{{"count":' || count(*) || '}}' AS details FROM e GROUP BY username, source
        ORDER BY min(id) DESC LIMIT 30 OFFSET 30""",
    "audit_batch": f"""WITH {_E} SELECT source, CAST(min(id) AS VARCHAR) AS entity_id, '{{"count":' || count(*) || '}}' AS details, 'events_ingested' AS action,
        'event_batch' AS entity_type, 'system' AS actor FROM e GROUP BY ALL""",
    **{f"match_{k}": f"WITH {_E} SELECT id, 'WF-900' AS rule_id FROM e WHERE coalesce({sql}, false)" for k, (_, sql) in PREDICATES.items()},
    **{f"normalize_{k}": f"WITH {_E} {sql}" for k, sql in _N.items()},
    "normalize_auto": f"WITH {_E}, n AS ({' UNION ALL '.join(_N.values())}) SELECT source, event_type, severity, count(*) AS n, CAST(sum(us) AS BIGINT) AS us FROM n GROUP BY ALL",
    "normalize_rejects": f"WITH {_E} SELECT id, 'alert severity is no number' AS problem FROM e WHERE source = 'suricata' AND id % 5 = 0 AND id % 8 IN (0, 5, 6)",
}
