"""Logs of four sensors and a pack of fifteen rules, from files to incidents: 40 events, 15 alerts, 13 incidents."""

import json

import pytest
import yaml
from pyspark.sql import functions as F

from watchfire.functions.rules import RuleError, catalogue_rows, load_pack
from watchfire.operators import analytics, detect, fixtures, incidents, reports
from watchfire.sources.normalize import ingest, stored_events

SHELL = "C:\\Windows\\System32\\WindowsPowerShell\\v1.0\\powershell.exe"
LINUX = [f"Mar  4 08:0{i // 3}:{i % 3 * 20:02d} box sshd[{i}]: Failed password for admin from 198.51.100.7 port {4000 + i} ssh2" for i in range(5)] + [
    "Mar  4 08:02:10 box sshd[9]: Accepted password for admin from 198.51.100.7 port 4100 ssh2",
    "Mar  4 08:03:00 box useradd[11]: new user: name=helper",
]
NGINX = [
    f'{ip} - - [04/Mar/2025:09:00:0{i} +0000] "GET {path} HTTP/1.1" {status} 10 "-" "agent"'
    for i, (ip, path, status) in enumerate([("198.51.100.21", "/x/../../secret", 400), ("198.51.100.22", "/find?q=UNION+SELECT", 400), ("192.0.2.1", "/", 200), ("192.0.2.2", "/about", 200)])
]
WINDOWS = [
    {"EventID": 1, "UtcTime": "2025-03-04T10:00:00Z", "Computer": "PC-1", "User": "LAB\\ann", "Image": SHELL, "CommandLine": "powershell.exe -enc AAAA"},
    {"EventID": 1102, "TimeCreated": "2025-03-04T10:01:00Z", "Computer": "SRV-1", "EventData": {"SubjectUserName": "temp"}},
    {"EventID": 7045, "TimeCreated": "2025-03-04T10:02:00Z", "Computer": "PC-2"},
    {"EventID": "4728", "TimeCreated": "2025-03-04T10:03:00Z", "Computer": "SRV-1", "TargetUserName": "temp"},
    {"EventID": 1, "UtcTime": "2025-03-04T10:04:00Z", "Computer": "PC-3", "User": "LAB\\bob", "Image": "cmd.exe", "CommandLine": "net  group /domain"},
    {"EventID": 1, "UtcTime": "2025-03-04T10:05:00Z", "Computer": "PC-4", "User": "LAB\\cid", "Image": SHELL, "CommandLine": "sc stop windefend"},
]
SURICATA = [{"timestamp": "2025-03-04T11:00:00Z", "event_type": "alert", "src_ip": "198.51.100.40", "dest_ip": "10.0.0.5", "alert": {"signature": "Exploit", "severity": 2}}]
SURICATA += [{"timestamp": f"2025-03-04T11:10:{i:02d}Z", "event_type": "dns", "src_ip": "10.0.0.9", "dest_ip": "10.0.0.53", "dns": {"rrname": f"part{i}.example.org"}} for i in range(12)]
SURICATA += [{"timestamp": f"2025-03-04T11:20:{i:02d}Z", "event_type": "network_connection", "src_ip": "192.0.2.90", "dest_ip": "10.0.0.8", "dest_port": 20 + i} for i in range(10)]


def rule(id, level, technique, selection, test, correlation=None, condition="selection", **more):
    detection = (selection if "selection" not in condition else {"selection": selection}) | {"condition": condition}
    detection |= {"correlation": correlation} if correlation else {}
    return {"id": id, "title": f"Rule {id}", "level": level, "logsource": {"category": id[:4]}, "mitre": {"technique": technique}, "detection": detection,
            "test": {"name": f"{id} fires", "expected": True, "event": test}} | more


def count(n, frame):
    return {"type": "count", "group_by": ["source_ip"], "threshold": n, "timeframe": frame}


FAILED, LOGIN = {"source": "linux_auth", "event_type": "failed_login"}, {"source": "linux_auth", "event_type": "successful_login"}
STARTED = {"source": "windows", "event_type": "process_create"}
PACK = {
    "linux/a.yml": rule("HOST-1", "high", "T1110", FAILED, FAILED, count(5, "5m")),
    "linux/b.yml": rule("HOST-2", "critical", "T1078", {"failed": FAILED, "success": LOGIN}, LOGIN,
                        {"type": "sequence", "group_by": ["source_ip", "username"], "sequence": ["failed", "success"], "timeframe": "10m"}, "failed or success"),
    "linux/c.yml": rule("HOST-3", "medium", "T1136.001", {"event_type": "user_created", "source": "linux_auth"}, {"source": "linux_auth", "event_type": "user_created"}),
    "linux/d.yml": rule("HOST-4", "high", "T1078", LOGIN | {"username": "ADMIN"}, LOGIN | {"username": "admin"}),
    "web/a.yml": rule("SITE-1", "high", "T1190", {"source": "nginx", "event_type": "directory_traversal"}, {"source": "nginx", "event_type": "directory_traversal"}),
    "web/b.yml": rule("SITE-2", "high", "T1190", {"source": "nginx", "event_type": "web_attack"}, {"source": "nginx", "event_type": "web_attack"}),
    "net/a.yaml": rule("WIRE-1", "high", "T1190", {"event_type": "alert", "severity": ["critical", "high"]}, {"event_type": "alert", "severity": "High"}),
    "net/b.yml": rule("WIRE-2", "medium", "T1046", {"event_type": "network_connection"}, {"event_type": "network_connection"}, count(8, "2m")),
    "net/c.yml": rule("WIRE-3", "medium", "T1048", {"source": "suricata", "event_type": "dns"}, {"source": "suricata", "event_type": "dns"}, count(10, "1m")),
    "win/a.yml": rule("DESK-1", "high", "T1059.001", STARTED | {"process_name|contains": "windowspowershell", "command_line|contains": [" -enc", " -w hidden"]},
                      STARTED | {"process_name": SHELL, "command_line": "x -EncodedCommand y"},
                      tests={"negative": [{"name": "plain shell", "event": STARTED | {"id": "n-1", "process_name": "cmd.exe", "command_line": "whoami"}}]}),
    "win/b.yml": rule("DESK-2", "critical", "T1070.001", {"event_type": "security_log_cleared"}, {"event_type": "security_log_cleared"}),
    "win/c.yml": rule("DESK-3", "high", "T1543.003", {"event_type": "service_installed"}, {"event_type": "service_installed"}),
    "win/d.yml": rule("DESK-4", "high", "T1136.001", {"event_type": "user_added_to_privileged_group"}, {"event_type": "user_added_to_privileged_group"}),
    "win/e.yml": rule("DESK-5", "medium", "T1087", STARTED | {"command_line|startswith": "net ", "command_line|contains": ["user", "/domain"]}, STARTED | {"command_line": "net user"}),
    "win/f.yml": rule("DESK-6", "critical", "T1562.001", STARTED | {"command_line|startswith": "sc ", "command_line|re": " stop .*e(nd|nse)?$"}, STARTED | {"command_line": "sc stop Sense"}),
}
#: rule -> (entity, severity, score) of its one alert.
WANT = {
    "HOST-1": ("198.51.100.7", "high", 75.0), "HOST-2": ("198.51.100.7|admin", "critical", 95.0), "HOST-3": ("unknown", "medium", 50.0), "HOST-4": ("198.51.100.7|admin", "high", 75.0),
    "SITE-1": ("198.51.100.21", "high", 75.0), "SITE-2": ("198.51.100.22", "high", 75.0), "WIRE-1": ("198.51.100.40", "high", 75.0), "WIRE-2": ("192.0.2.90", "medium", 50.0),
    "WIRE-3": ("10.0.0.9", "medium", 50.0), "DESK-1": ("PC-1|LAB\\ann", "high", 75.0), "DESK-2": ("SRV-1|temp", "critical", 95.0), "DESK-3": ("PC-2", "high", 75.0),
    "DESK-4": ("SRV-1|temp", "high", 75.0), "DESK-5": ("PC-3|LAB\\bob", "medium", 50.0), "DESK-6": ("PC-4|LAB\\cid", "critical", 95.0),
}


@pytest.fixture(scope="module")
def pack(tmp_path_factory):
    root = tmp_path_factory.mktemp("pack")
    for name, spec in PACK.items():
        (root / name).parent.mkdir(exist_ok=True)
        (root / name).write_text(yaml.safe_dump(spec))
    return root


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("logs")
    for name, lines in {"auth.log": LINUX, "access.log": NGINX, "sysmon.jsonl": map(json.dumps, WINDOWS), "eve.json": map(json.dumps, SURICATA)}.items():
        (root / name).write_text("\n".join(lines) + "\n")
    found = stored_events(ingest(spark, str(root), default_year=2025, ingest_us=1_741_075_200_000_000), ingest_us=0)
    found.write.parquet(str(root / "stored"))
    return spark.read.parquet(str(root / "stored"))


def test_golden(spark, events, pack):
    rules = load_pack(pack)
    assert [r.id for r in rules] == sorted((r for r in WANT if r != "WIRE-1"), key=lambda i: ("HOST", "WIRE", "SITE", "DESK").index(i[:4])) + ["WIRE-1"]
    assert events.count() == 40 and events.where("ts_defaulted").count() == 1
    alerts = detect.all_alerts(events, rules)
    got = {r.rule_id: (r.entity_key, r.severity, r.risk_score) for r in alerts.collect()}
    assert alerts.count() == 15 and got == WANT
    # Alerts of one run are stored at one time.
    run = alerts.withColumns({"us": F.lit(5).cast("long"), "status": F.lit("new")})
    found = {r.entity_key: r for r in incidents.incidents(run, rules).collect()}
    assert len(found) == 13 and all(r.status == "open" and r.title == f"Correlated activity involving {k}" for k, r in found.items())
    top = found["198.51.100.7|admin"]
    assert (top.risk_score, top.severity, top.summary) == (100.0, "critical", "2 alert(s), 1 MITRE technique(s): T1078")
    assert found["SRV-1|temp"].summary == "2 alert(s), 2 MITRE technique(s): T1070.001, T1136.001"
    again = detect.all_alerts(events, rules, stored=alerts)
    assert again.where("rule_id <> 'HOST-2'").count() == 0
    # The sequence rule goes on to the next start: the same success follows it, which is stored already.
    assert again.count() == 0
    evidence = {r.rule_id: json.loads(r.evidence) for r in alerts.collect()}
    by_line = {r.id: r.message for r in events.collect()}
    assert [by_line[i] for i in evidence["HOST-1"].pop("event_ids")] == LINUX[:5]
    assert {k: v for k, v in evidence["HOST-1"].items() if k != "alert_fingerprint"} == {"type": "correlation", "count": 5, "threshold": 5, "timeframe": "5m", "group_by": ["source_ip"]}
    assert (evidence["HOST-2"]["type"], evidence["HOST-2"]["stages"], len(evidence["HOST-2"]["event_ids"])) == ("sequence", ["failed", "success"], 2)
    assert evidence["DESK-3"]["type"] == "single_event" and evidence["DESK-3"]["event"]["hostname"] == "PC-2" and evidence["DESK-3"]["event"]["raw_data"]["EventID"] == 7045


def test_golden_reports(spark, events, pack, tmp_path):
    rules = load_pack(pack)
    run = detect.all_alerts(events, rules).withColumns({"us": F.lit(5).cast("long"), "status": F.lit("new")})
    found, assigned, table = incidents.incidents(run, rules), incidents.assigned_alerts(run), analytics.rule_table(spark, rules)
    top = found.where("entity_key = 'SRV-1|temp'").first().incident_id
    notes = spark.createDataFrame([(top, "me", "looked", 9), (top, "me", "first", 1)], "incident_id string, author string, body string, us long")
    reports.write_report(str(tmp_path / "report"), found, assigned, table, notes)
    payload = {r["incident_id"]: r for r in map(json.loads, "\n".join(p.read_text() for p in (tmp_path / "report/incidents.json").glob("part-*")).splitlines())}
    assert len(payload) == 13 and sum(len(r["alerts"]) for r in payload.values()) == 15
    assert [(a["rule_id"], a["mitre_technique"], a["mitre_tactic"], a["status"]) for a in payload[top]["alerts"]] and [n["body"] for n in payload[top]["notes"]] == ["first", "looked"]
    assert {a["rule"] for a in payload[top]["alerts"]} == {"Rule DESK-2", "Rule DESK-4"}
    assert spark.read.option("header", True).csv(str(tmp_path / "report/alerts.csv")).count() == 15
    details = reports.alert_details(assigned, table, events, found)
    assert details.count() == 15 and details.where("incident.entity_key = entity_key AND event.id = event_id AND rule IS NOT NULL").count() == 15
    assert {r.place for r in reports.incident_timeline(assigned, table).where(F.col("incident_id") == top).collect()} == {1, 2}
    techniques = analytics.attack_techniques(table).collect()
    assert [r.technique for r in techniques] == sorted({r.technique for r in rules})
    assert {r.technique: (r.name, r.tactic, r.rules) for r in techniques}["T1078"] == ("Valid Accounts", "Defense Evasion / Persistence", ["HOST-2", "HOST-4"])
    assert tuple(analytics.attack_summary(table).first()) == (15, 15)


def test_golden_fixtures(spark, pack, tmp_path):
    results, summary = fixtures.test_folder(spark, pack)
    row = summary.first()
    assert (row.valid_rules, row.total_rules, row.fixtures, row.passed, row.failed, row.errors) == (15, 15, 16, 16, 0, [])
    assert row.missed_positives == row.unexpected_matches == row.matched_event_ids == []
    fixtures.write_history(results, str(tmp_path / "h"), 7, 1.5)
    fixtures.write_history(results, str(tmp_path / "h"), 8, 2.5)
    assert spark.read.parquet(str(tmp_path / "h")).where("passed AND expected_match = actual_match").count() == 32
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.yml").write_text("id: [")
    (tmp_path / "bad/b.yml").write_text(yaml.safe_dump(PACK["win/a.yml"]))
    (tmp_path / "bad/c.yaml").write_text(yaml.safe_dump(PACK["win/a.yml"]))
    row = fixtures.test_folder(spark, tmp_path / "bad")[1].first()
    assert (row.valid_rules, row.total_rules, row.fixtures) == (1, 3, 2) and [e.file[-6:] for e in row.errors] == ["/a.yml", "c.yaml"]
    with pytest.raises(RuleError):
        load_pack(tmp_path / "bad")


def test_catalogue_of_a_pack(spark, pack):
    rows = {r.rule_id: r for r in catalogue_rows(spark, load_pack(pack)).collect()}
    r = rows["HOST-2"]
    assert len(rows) == 15 and yaml.safe_load(r.yaml_content)["id"] == "HOST-2"
    assert (r.source_category, r.mitre_technique, r.mitre_name, r.mitre_tactic, r.author) == ("HOST", "T1078", "Valid Accounts", "Defense Evasion / Persistence", "unknown")
