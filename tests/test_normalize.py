import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from watchfire.functions.addresses import ip_text
from watchfire.sources import normalize
from watchfire.sources.normalize import ingest, normalise, rejects, stored_events


def many(spark, lines, kind="auto", **kwargs):
    rows = normalise(spark.createDataFrame(list(enumerate(lines)), "n int, line string"), kind, default_year=2024, ingest_us=5, **kwargs).collect()
    return {r.n: r for r in rows}


def test_text_lines(spark):
    failed = "Jul  9 10:00:01 srv sshd[1]: Failed password for invalid user bob from 203.0.113.9 port 4242 ssh2"
    lines = [
        failed, "Jul  9 10:00:01 srv sshd[1]: Accepted publickey for amy from 10.0.0.1 port 22", "Jul  9 10:00:01 srv useradd[3]: new user: name=x",
        '1.2.3.4 - - [09/Jul/2024:10:00:01 +0200] "GET /a/%2E%2e/b HTTP/1.1" 404 1 "-" "ua"', "nothing known", "{bad json",
        f"<34>{failed}", failed.replace("203.0.113.9", "evil.example"), failed.replace("203.0.113.9", "2001:DB8::1"), failed.replace("203.0.113.9", "999.1.1.1"), failed.upper(),
        '1.2.3.4 - - [09/Jul/2024:10:00:01 +0200] "GET / HTTP/1.1" 404 1 "-"', '1.2.3.4 - - [09/Jul/2024:10:00:01 +0200] "GET / HTTP/1.1" 404 x "-" "ua"',
        'h - - [bad time] "GET /<ScRiPt> HTTP/1.1" 200 - "" ""', '1.2.3.4 - - [09/Jul/2024:10:00:01 +0200] "GET /useradd HTTP/1.1" 404 1 "-" "ua"', "Feb 30 1:2:3 s: Accepted x for a from 1.1.1.1 port 7", '{"a": 1} trailing useradd',
    ]
    got = many(spark, lines)
    r = got[0]
    assert (r.event_type, r.severity, r.username, r.source_ip, r.source_port, r.us, r.ts_defaulted) == ("failed_login", "medium", "bob", "203.0.113.9", 4242, 1720519201000000, False)
    assert json.loads(r.raw_data) == {"line": failed} and r.message == failed
    assert (got[1].event_type, got[1].severity, got[1].username) == ("successful_login", "info", "amy")
    assert (got[2].event_type, got[2].us, got[2].username, got[2].ts_defaulted) == ("user_created", 5, None, True)
    r = got[3]
    assert (r.event_type, r.severity, r.us, r.message) == ("directory_traversal", "high", 1720512001000000, "GET /a/%2E%2e/b -> 404")
    assert json.loads(r.raw_data) == {"method": "GET", "path": "/a/%2E%2e/b", "status": 404, "user_agent": "ua"}
    assert (got[6].us, got[6].message) == (got[0].us, lines[6]) and (got[8].source_ip, got[9].source_ip) == ("2001:db8::1", None)
    assert (got[10].event_type, got[10].us) == ("failed_login", got[0].us)
    assert (got[13].event_type, got[13].source_ip, got[13].us, got[13].ts_defaulted) == ("web_attack", None, 5, True)
    assert got[14].event_type == "user_created" and (got[15].us, got[15].event_type) == (5, "successful_login") and got[16].event_type == "user_created"
    assert set(got) == set(range(17)) - {4, 5, 7, 11, 12}
    assert set(many(spark, lines, "nginx")) == {3, 13, 14} and set(many(spark, lines, "AUTH")) == {0, 1, 2, 6, 8, 9, 10, 14, 15, 16} and not many(spark, lines, "suricata")


def test_suricata(spark):
    given = [
        {"event_type": "dns", "src_ip": "2001:DB8::1", "dest_ip": "300.1.1.1", "dns": {"rrname": "a.b"}, "timestamp": "2024-07-09T10:00:01Z", "src_port": 53, "dest_port": "x"},
        {"event_type": "alert", "src_ip": "1.1.1.1"}, {"event_type": "flow", "alert": {"severity": 1}}, {"event_type": "dns", "dns": None}, {"event_type": "alert", "alert": {"severity": "1", "signature": None}},
        {"event_type": "alert", "alert": {"severity": 0}}, {"event_type": "alert", "alert": {"severity": 4}}, {"event_type": "alert", "alert": {"severity": "high"}}, {"event_type": "alert", "alert": "text"},
        {"event_type": None, "dns": {}}, {"event_type": "alert", "alert": {"severity": 2.9, "signature": "S"}}, {"event_type": "dns", "dns": [1]}, {"event_type": "alert", "alert": {}},
    ]
    lines = list(map(json.dumps, given))
    got = many(spark, lines)
    r = got[0]
    assert (r.source, r.event_type, r.message, r.source_ip, r.destination_ip, r.us, r.source_port, r.destination_port) == ("suricata", "dns", "DNS query: a.b", "2001:db8::1", None, 1720519201000000, 53, None)
    shown = {i: (r.event_type, r.severity, r.message) for i, r in got.items()}
    assert shown == {
        0: ("dns", "info", "DNS query: a.b"), 1: ("alert", "medium", "Suricata alert"), 2: ("flow", "info", "flow"), 3: ("dns", "info", "DNS query: unknown"), 4: ("alert", "critical", "None"),
        5: ("alert", "medium", "Suricata alert"), 6: ("alert", "low", "Suricata alert"), 9: ("None", "info", "None"), 10: ("alert", "high", "S"), 12: ("alert", "medium", "Suricata alert"),
    }
    df = spark.createDataFrame(list(enumerate(lines)), "n int, line string")
    assert {r.n: r.problem for r in rejects(df).collect()} == {7: "alert severity is no number", 8: "alert is no object", 11: "dns is no object"}
    with pytest.raises(Exception, match="record cannot be read"):
        normalise(df, strict=True).collect()
    assert many(spark, ["{}"], "eve")[0].event_type == "network_event"


def test_windows(spark):
    given = [
        {"EVENTID": "4625", "EventData": {"TARGETUSERNAME": "bob"}, "Computer": "c"}, {"EventID": "x"}, {"User": "top", "event_id": 1, "EventData": {"TargetUserName": "inner"}},
        {"EventID": 4720, "TargetUserName": None, "User": "u", "EventData": {"TargetUserName": "inner"}}, {"EventID": 1102, "SourceIp": "1.1.1.1", "IpAddress": "2.2.2.2", "SourceNetworkAddress": "3.3.3.3"},
        {"EventID": 4728, "EventData": {"SourceNetworkAddress": "3.3.3.3", "ProcessName": "p", "ProcessCommandLine": "c"}}, {"EventID": 1, "Message": "", "user": "a", "USER": "b"}, {"EventID": 3, "EventData": "text"},
        {"EventID": 7, "EventData": {}, "event_data": {"User": "second"}}, {"EventID": 1, "SourcePort": 4, "DestinationIp": "1.1.1.1", "UtcTime": "2024-07-09 10:00:01.250", "Message": "m"},
    ]
    got = many(spark, list(map(json.dumps, given)))
    r = got[0]
    assert (r.source, r.event_type, r.severity, r.username, r.hostname, r.message, r.us) == ("windows", "failed_login", "medium", "bob", "c", "Windows event 4625", 5)
    assert (got[1].event_type, got[1].message) == ("windows_event", "Windows event 0") and got[2].username == "top"
    assert (got[3].event_type, got[3].severity, got[3].username) == ("user_created", "high", None)  # a null that is present counts
    assert (got[4].event_type, got[4].severity, got[4].source_ip) == ("security_log_cleared", "critical", "2.2.2.2")
    assert (got[5].event_type, got[5].severity, got[5].source_ip, got[5].process_name, got[5].command_line) == ("user_added_to_privileged_group", "high", "3.3.3.3", "p", "c")
    assert (got[6].message, got[6].username) == ("Windows event 1", "b") and got[7].event_type == "network_connection" and got[8].username == "second"
    assert (got[9].source_port, got[9].destination_ip, got[9].us, got[9].message) == (None, None, 1720519201250000, "m")
    assert many(spark, ['{"source": "x"}'], "sysmon")[0].source == "windows"


def test_generic(spark):
    got = many(spark, ['{"severity": null, "source": "S", "message": "m"}', '{"severity": "HIGH", "destination_port": "80", "source_ip": " 1.1.1.1 "}', '{"a": {"b": 1}, "timestamp": "junk"}', "{}", "[1]", '{"event_id": 4625}'], "Generic")
    assert (got[0].severity, got[0].source, got[0].event_type) == ("none", "S", "generic_event")
    assert (got[1].severity, got[1].destination_port, got[1].source_ip, got[1].message) == ("high", 80, "1.1.1.1", "")
    assert (got[2].raw_data, got[2].ts_defaulted) == ('{"a": {"b": 1}, "timestamp": "junk"}', True) and got[5].source == "generic" and set(got) == {0, 1, 2, 3, 5}


def test_times(spark):
    cases = {
        "2024-07-09T10:00:01Z": 1720519201000000, "2024-07-09 10:00:01.5+02:00": 1720512001500000, "2024-07-09T10:00:01,25": 1720519201250000, "2024-07-09": 1720483200000000, "2024-07-09T10:00": 1720519200000000,
        "2024-07-09T10:00:01+0200": 1720512001000000, "Jul  9 10:00:01": 1720519201000000, "jul 9 1:2:3": 1720486923000000, "09/Jul/2024:10:00:01 +0200": 1720512001000000, "2024-7-9 1:2:3": 1720486923000000,
        "2024-13-01": None, "Feb 29 00:00:00": 1709164800000000, "Foo 1 00:00:00": None, "2024": None, "T10:00": None, "": None, "2024-02-30T00:00:00": None, " 2024-07-09T10:00:01Z ": 1720519201000000,
    }
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([(c,) for c in cases], "t string")
        assert {r.t: r.us for r in df.select("t", normalize.time_us(F.col("t"), 2024).alias("us")).collect()} == cases
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_addresses(spark):
    rng = random.Random(1)

    def one():
        if rng.random() < 0.3:
            return ".".join(str(rng.choice([0, 1, 10, 255, 256, "01", 99])) for _ in range(rng.choice([3, 4, 4, 4, 5])))
        groups = [rng.choice(["0", "0", "0", "0000", "1", "ab", "FFFF", "ffff", "0db8", "12345", "g"][: 11 if rng.random() < 0.1 else 9]) for _ in range(rng.choice([8, 8, 8, 7, 6, 5, 3, 2, 9]))]
        at = rng.randrange(len(groups) * 2)
        text = ":".join(groups) if at >= len(groups) else ":".join(groups[:at]) + "::" + ":".join(groups[at:])
        return text + rng.choice([""] * 12 + [":1.2.3.4", ":1.2.3.400", "%eth0", "%", "%a%b", " "])

    given = [one() for _ in range(3000)] + ["::ffff:1.2.3.4", "::ffff:0:0", ":::", "::", "1::2::3", ":1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:", ":", "", " ::1 ", "::1.2.3.4", "a:b", None]

    def plain(v):
        try:
            return str(ipaddress.ip_address(v.strip())) if v else None
        except ValueError:
            return None

    got = spark.createDataFrame([(v,) for v in given], "v string").select("v", ip_text(F.col("v")).alias("g")).collect()
    assert [(r.v, r.g) for r in got] == [(v, plain(v)) for v in given] and sum(r.g is not None for r in got) > 500


def test_files(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines/a.log").write_bytes(b'  {"source": "a\xff"}  \n\n \t \n{"source": "b"}\x0b{"source": "c"}\r\n')
    got = ingest(spark, str(tmp_path / "lines"))
    assert sorted(r.source for r in got.collect()) == ["a�", "b", "c"] and all(r.file.endswith("a.log") for r in got.collect())
    (tmp_path / "arrays").mkdir()
    (tmp_path / "arrays/good.json").write_text('\n [{"source": "x"},\n 7, null, {"source": "y"}]')
    (tmp_path / "arrays/none.json").write_text("[]")
    (tmp_path / "arrays/bad.json").write_text('[{"source": "z"},')
    assert sorted(r.source for r in ingest(spark, str(tmp_path / "arrays"), documents=True).collect()) == ["x", "y"]
    bad = rejects(normalize.read_array_documents(spark, str(tmp_path / "arrays"))).collect()
    assert [(r.file[-8:], r.problem) for r in bad] == [("bad.json", "malformed JSON array")]
    with pytest.raises(Exception, match="malformed JSON array"):
        ingest(spark, str(tmp_path / "arrays"), documents=True, strict=True).collect()


def test_stored_events(spark, tmp_path):
    rows = [(None, 1, None, None, None, None, None), (7, 86_400_000_000, "s", "t", "low", "m", "{}")]
    df = spark.createDataFrame(rows, "id long, us long, source string, event_type string, severity string, message string, raw_data string")
    normalize.write_events(df, str(tmp_path / "e"), ingest_us=9, first_id=100)
    got = {r.us: r for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert tuple(got[1][c] for c in ("source", "event_type", "severity", "message", "raw_data")) == ("generic", "generic_event", "info", "", "{}") and got[1].id >= 100
    assert got[86_400_000_000].id == 7 and str(got[86_400_000_000].event_date) == "1970-01-02"
    ids = [r.id for r in stored_events(df.drop("id").repartition(3), 0).collect()]
    assert len(set(ids)) == 2
    row = normalize.audit_rows(stored_events(df, 0, 100), []).first()
    assert (row.entity_id, json.loads(row.details), row.action, row.actor) == ("7", {"count": 2}, "events_ingested", "system")


def test_clashing_and_extra_columns(spark):
    df = spark.createDataFrame([('{"source": "a", "message": "m"}', "own", 1)], "line string, message string, n int")
    r = normalise(df).first()
    assert (r.message, r.n, r.line) == ("m", 1, df.first().line)
    assert normalise(df.limit(0)).count() == 0 and normalise(spark.createDataFrame([(None,)], "line string")).count() == 0


def test_sums_of_times_beyond_64_bits(spark, tmp_path):
    """Groups of more than 5400 rows: the sums are whole; small ones stay BIGINT, as in SQL."""
    import duckdb

    from watchfire.jobs import security

    with duckdb.connect() as c:
        c.sql(f"COPY (SELECT * REPLACE (event_id + 10000 * k AS event_id) FROM '/root/testdata/sf0.01/events.parquet', range(6) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        c.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
        sql = security.ORACLES["normalize_auto"].replace("CAST(sum(us) AS BIGINT)", "CAST(sum(us) AS VARCHAR)")
        want = sorted((*r[:4], int(r[4])) for r in c.sql(sql).fetchall())
    got = security.normalize_auto(spark, str(tmp_path))
    assert max(w[4] for w in want) >= 2**63
    assert sorted((*r[:4], int(r[4])) for r in got.collect()) == want
    assert security.normalize_auto(spark, "/root/testdata/sf0.001").schema["us"].dataType.simpleString() == "bigint"
