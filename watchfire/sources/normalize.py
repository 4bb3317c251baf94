"""Raw sensor lines to normalised events: projections only, no shuffle, and every line is parsed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.functions.addresses import ip_texts

#: The text formats. Groups: time, user, address, port / address, time, method, path, protocol, status,
#: size, referer, agent. The first two ignore case; all are searched anywhere in the line.
FAILED = r"(\w{3}\s+\d+\s+\d+:\d+:\d+).*Failed password for (?:invalid user )?(\S+) from ([0-9a-fA-F:.]+) port (\d+)"
ACCEPTED = r"(\w{3}\s+\d+\s+\d+:\d+:\d+).*Accepted \S+ for (\S+) from ([0-9a-fA-F:.]+) port (\d+)"
ACCESS = r'(\S+) \S+ \S+ \[([^\]]+)\] "(\S+) (\S+) ([^"]+)" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'
#: Windows event ids and what they mean (event type, severity); all others are windows_event, info.
WINDOWS = {
    1: ("process_create", "info"),
    3: ("network_connection", "info"),
    1102: ("security_log_cleared", "critical"),
    4624: ("successful_login", "info"),
    4625: ("failed_login", "medium"),
    4688: ("process_create", "info"),
    4720: ("user_created", "high"),
    4728: ("user_added_to_privileged_group", "high"),
    7045: ("service_installed", "high"),
}
#: The names under which Windows records have a field, in order of precedence.
WINDOWS_NAMES = {
    "code": ("EventID", "event_id"),
    "time": ("UtcTime", "TimeCreated", "timestamp"),
    "source_ip": ("IpAddress", "SourceIp", "SourceNetworkAddress"),
    "username": ("TargetUserName", "User", "SubjectUserName"),
    "hostname": ("Computer", "Hostname"),
    "process_name": ("Image", "NewProcessName", "ProcessName"),
    "command_line": ("CommandLine", "ProcessCommandLine"),
    "message": ("Message",),
}
#: What marks a path as a traversal (as it is; in lower case) and as an attack (in lower case).
TRAVERSAL, TRAVERSAL_LOW = "../", "%2e%2e"
ATTACKS = ("union+select", "union%20select", "<script", "%3cscript")
#: The column that is true where no usable time was in the record, so that ingest_us stands for it.
FIELDS = (
    "us long, source string, event_type string, severity string, source_ip string, destination_ip string, source_port int, "
    "destination_port int, username string, hostname string, process_name string, command_line string, message string, raw_data string, "
    "ts_defaulted boolean"
)
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]
#: Line ends besides the usual ones, and what is trimmed from a line.
_BREAKS = r"[\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_JSON = {"allowSingleQuotes": "false"}
_MARK = "\x00"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-blank lines (column line) with their file."""
    return split_lines(spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")))


def split_lines(read: DataFrame) -> DataFrame:
    """read: value, as a text source gives it, and other columns. Rarer line ends also separate lines."""
    parts = F.transform(F.split("value", _BREAKS), lambda x: F.regexp_replace(x, _EDGES, ""))
    others = [c for c in read.columns if c != "value"]
    return read.select(F.explode(F.filter(parts, lambda x: x != "")).alias("line"), *others)


def read_array_documents(spark: SparkSession, path: str) -> DataFrame:
    """Records (column line) of files that are one JSON array each, with their file, each file whole in a task (for large ones
    there is arrays.read_array_items()); items that are no objects are dropped. A file that is no JSON array gives one row with a null line and the column problem."""
    items = F.filter(F.from_json("value", "array<string>", _JSON), lambda x: x.startswith("{"))
    read = spark.read.text(path, wholetext=True).select(F.explode(F.coalesce(items, F.array(F.lit("")))).alias("line"), F.col("_metadata.file_path").alias("file"))
    broken = F.col("line") == ""
    return read.select(F.when(~broken, F.col("line")).alias("line"), "file", F.when(broken, "malformed JSON array").alias("problem"))


def time_us(text: Column, default_year: int) -> Column:
    """Microseconds since 1970 of an ISO, syslog, access-log or plain time (UTC if it names no zone); null if it is none.
    Does not depend on the session's time zone."""

    def of(t: Column) -> Column:
        day, clock, zone = r"\d{4}-\d\d-\d\d", r"\d\d:\d\d(?::\d\d(?:[.,]\d+)?)?", r"(?:Z|[+-]\d\d(?::?\d\d)?)"
        zoned = F.when(t.rlike(f"{zone}$"), F.regexp_replace(F.regexp_replace(t, r"([+-]\d\d):?(\d\d)$", "$1:$2"), r"(:\d\d(?:\.\d+)?[+-]\d\d)$", "$1:00")).otherwise(F.concat(t, F.lit("Z")))
        zoned = F.regexp_replace(zoned, rf"^({day}).(\d\d:\d\d)({zone})$", "$1T$2:00$3")
        iso = F.when(t.rlike(f"^{day}$"), F.try_to_timestamp(F.concat(t, F.lit("T00:00:00Z")))).when(
            t.rlike(f"^{day}.{clock}{zone}?$"), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(zoned, ",", "."), f"^({day}).", "$1T"))
        )
        syslog = F.when(
            t.rlike(r"^[A-Za-z]{3} \d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
            F.try_to_timestamp(F.concat(F.lit(f"{default_year} "), F.initcap(t), F.lit(" +0000")), F.lit("yyyy MMM d H:m:s Z")),
        )
        access = F.when(
            t.rlike(r"^\d{1,2}/[A-Za-z]{3}/\d{4}:"),
            F.try_to_timestamp(F.regexp_replace(F.regexp_replace(t, r" Z$", " +0000"), r"([+-]\d\d):(\d\d)$", "$1$2"), F.lit("d/MMM/yyyy:H:m:s Z")),
        )
        plain = F.when(t.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), F.try_to_timestamp(F.concat(t, F.lit(" +0000")), F.lit("yyyy-M-d H:m:s Z")))
        return F.unix_micros(F.coalesce(iso, syslog, access, plain))

    return F.transform(F.array(F.regexp_replace(F.regexp_replace(text, _EDGES, ""), r"\s+", " ")), of)[0]


def _captures(line: Column, pattern: str, flags: str, groups: int) -> Column:
    """The groups of the pattern's first match, all by one replacement."""
    whole = F.regexp_replace(line, f"(?s{flags})^.*?{pattern}.*$", _MARK.join(f"${i + 1}" for i in range(groups)))
    return F.split(whole, _MARK)


def _present(keys: Column, name: str) -> Column:
    return F.array_contains(keys, name)


def _value(keys: Column, values: Column, name: str) -> Column:
    """The value of the first such key; null where there is none. Keys are in reverse order, so a repeated one counts as
    it was given last."""
    return F.get(values, (F.array_position(keys, name) - 1).cast("int"))


def _any(text: Column, tokens: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for t in tokens:
        out = out | F.contains(text, F.lit(t))
    return out


def _truthy(value: Column) -> Column:
    """A JSON value's text, null if the value is null, false, zero or empty."""
    return F.when(~value.isin("", "0", "0.0", "false", "[]", "{}"), value)


def _parsed(lines: DataFrame, source_type: str, default_year: int, ingest_us: int, unread: bool = False) -> DataFrame:
    """The columns of lines, FIELDS and `problem` of every line that some parser reads, or with unread of every line. Each step is a projection whose
    columns the next one uses more than once, so that the optimiser computes them once; the explode keeps the choice
    of the parser from being computed again for the filter."""
    kind_of = source_type.lower()
    line = F.col("line")
    others = [c for c in lines.columns if c != "line" and c not in (*NAMES, "problem")]
    given = F.col("problem") if "problem" in lines.columns else F.lit(None).cast("string")
    json = F.when(line.startswith("{") & line.endswith("}"), F.from_json(line, "map<string,string>", _JSON))

    # 1. A JSON object as two arrays.
    one = lines.select("line", given.alias("_problem"), F.struct(*others).alias("_others") if others else F.lit(0).alias("_others"), json.alias("_m"))
    one = one.select("line", "_problem", "_others", F.reverse(F.map_keys("_m")).alias("_k"), F.reverse(F.map_values("_m")).alias("_v"))
    # 2. The parser.
    keys, low = F.col("_k"), F.transform("_k", lambda k: F.lower(k))
    if kind_of in ("suricata", "eve"):
        record = F.lit("suricata")
    elif kind_of in ("windows", "sysmon"):
        record = F.lit("windows")
    elif kind_of == "auto":
        network = F.arrays_overlap(keys, F.array(*map(F.lit, ("src_ip", "dest_ip", "alert", "dns"))))
        windows = F.arrays_overlap(low, F.array(*map(F.lit, ("eventid", "event_id", "eventdata"))))
        record = F.when(_present(keys, "event_type") & network, "suricata").when(windows, "windows").otherwise("generic")
    else:
        record = F.lit("generic")
    parser = F.when(F.col("_problem").isNotNull(), "bad").when(keys.isNotNull(), record)
    if kind_of in ("auto", "linux", "linux_auth", "auth"):
        created = _any(F.lower(line), ("useradd", "new user"))
        parser = parser.when(line.rlike(f"(?diuU){FAILED}"), "failed").when(line.rlike(f"(?diuU){ACCEPTED}"), "accepted").when(created, "created")
    if kind_of in ("auto", "nginx", "web"):
        parser = parser.when(line.rlike(f"(?dU){ACCESS}"), "access")
    if unread:
        parser = parser.otherwise(F.lit("unread"))
    two = one.select("line", "_problem", "_others", "_k", "_v", parser.alias("_p"))
    two = two.select("*", F.explode(F.when(F.col("_p").isNotNull(), F.array("_p"))).alias("_by"))
    by = lambda *names: F.col("_by").isin(*names)
    # 3. The groups of a text line; a Windows record's names in lower case, and its inner record.
    groups = F.when(by("failed"), _captures(line, FAILED, "iuU", 4)).when(by("accepted"), _captures(line, ACCEPTED, "iuU", 4)).when(by("access"), _captures(line, ACCESS, "U", 9))
    inside = F.from_json(F.coalesce(_truthy(_value(keys, F.col("_v"), "EventData")), _value(keys, F.col("_v"), "event_data")), "map<string,string>", _JSON)
    three = two.select("line", "_problem", "_others", "_by", "_k", "_v", groups.alias("_g"), F.when(by("windows"), low).alias("_wk"), F.when(by("windows"), inside).alias("_in"))
    three = three.select("*", F.reverse(F.transform(F.map_keys("_in"), lambda k: F.lower(k))).alias("_ik"), F.reverse(F.map_values("_in")).alias("_iv"))
    # 4. What each parser reads, as text.
    values, g = F.col("_v"), lambda i: F.get("_g", F.lit(i))
    get = lambda name: _value(keys, values, name)

    def found(field: str) -> Column:
        """A Windows field: under any of its names at the top, else under any of them inside."""
        places = [(F.col("_wk"), values, n.lower()) for n in WINDOWS_NAMES[field]] + [(F.col("_ik"), F.col("_iv"), n.lower()) for n in WINDOWS_NAMES[field]]
        out = F.when(F.lit(False), F.lit(""))
        for k, v, n in places:
            out = out.when(_present(k, n), _value(k, v, n))
        return out

    def text_of(name: str, default: str) -> Column:
        """A field's text: the default if it is absent, None if it is null."""
        return F.when(_present(keys, name), F.coalesce(get(name), F.lit("None"))).otherwise(F.lit(default))

    alert = F.from_json(_truthy(get("alert")), "map<string,string>", _JSON)
    dns = F.from_json(_truthy(get("dns")), "map<string,string>", _JSON)
    four = three.select(
        "line", "_problem", "_others", "_by", "_k", "_v", "_g",
        F.when(by("suricata"), text_of("event_type", "network_event")).alias("_eve"),
        F.when(by("suricata"), alert).alias("_alert"), F.when(by("suricata"), dns).alias("_dns"),
        F.when(by("windows"), F.coalesce(found("code").try_cast("int"), F.lit(0))).alias("_code"),
        F.when(by("failed", "accepted"), g(0)).when(by("access"), g(1)).when(by("windows"), found("time")).when(by("suricata", "generic"), get("timestamp")).alias("_time"),
        F.when(by("failed", "accepted"), g(2)).when(by("access"), g(0)).when(by("windows"), found("source_ip")).when(by("suricata"), get("src_ip")).when(by("generic"), get("source_ip")).alias("_src"),
        F.when(by("suricata"), get("dest_ip")).when(by("generic"), get("destination_ip")).alias("_dst"),
        *[F.when(by("windows"), found(c)).when(by("generic"), get(c)).alias(f"_{c}") for c in ("username", "hostname", "process_name", "command_line", "message")],
    )
    # 5. The event.
    is_alert, is_dns, path = F.col("_eve") == "alert", F.col("_eve") == "dns", g(3)
    field = lambda m, name, default: F.when(_present(F.map_keys(m), name), F.coalesce(F.col(m)[name], F.lit("None"))).otherwise(F.lit(default))
    rank = F.coalesce(_truthy(F.col("_alert")["severity"]), F.lit("3"))
    whole = F.when(rank == "true", F.lit(1)).otherwise(F.when(rank.rlike(r"^\s*[+-]?\d+(\.\d+)?\s*$"), F.trim(rank).try_cast("double").cast("int")))
    traversal = F.contains(path, F.lit(TRAVERSAL)) | F.contains(F.lower(path), F.lit(TRAVERSAL_LOW))
    attack = _any(F.lower(path), ATTACKS)
    kinds = F.create_map(*[F.lit(x) for k, v in WINDOWS.items() for x in (k, v[0])])
    grades = F.create_map(*[F.lit(x) for k, v in WINDOWS.items() for x in (k, v[1])])
    problem = F.coalesce(
        F.col("_problem"),
        F.when(is_alert & _truthy(get("alert")).isNotNull() & F.col("_alert").isNull(), "alert is no object"),
        F.when(is_alert & whole.isNull(), "alert severity is no number"),
        F.when(is_dns & _truthy(get("dns")).isNotNull() & F.col("_dns").isNull(), "dns is no object"),
    )
    text = by("failed", "accepted", "created")
    us = time_us(F.col("_time"), default_year)
    as_line = F.to_json(F.struct("line"))
    as_request = F.to_json(F.struct(g(2).alias("method"), path.alias("path"), g(5).cast("int").alias("status"), g(8).alias("user_agent")))
    event = {
        "us": F.coalesce("_us", F.lit(ingest_us)),
        "source": F.when(text, "linux_auth").when(by("access"), "nginx").when(by("suricata"), "suricata").when(by("windows"), "windows").otherwise(text_of("source", "generic")),
        "event_type": F.when(by("failed"), "failed_login").when(by("accepted"), "successful_login").when(by("created"), "user_created")
        .when(by("access"), F.when(traversal, "directory_traversal").when(attack, "web_attack").otherwise("web_request"))
        .when(by("suricata"), F.col("_eve")).when(by("windows"), F.coalesce(F.try_element_at(kinds, F.col("_code")), F.lit("windows_event"))).otherwise(text_of("event_type", "generic_event")),
        "severity": F.when(by("failed", "created"), "medium").when(by("accepted"), "info").when(by("access"), F.when(traversal | attack, "high").otherwise("info"))
        .when(by("suricata"), F.when(is_alert, F.when(whole == 1, "critical").when(whole == 2, "high").when(whole == 3, "medium").otherwise("low")).otherwise("info"))
        .when(by("windows"), F.coalesce(F.try_element_at(grades, F.col("_code")), F.lit("info"))).otherwise(F.lower(text_of("severity", "info"))),
        "source_ip": F.col("_ips")[0], "destination_ip": F.col("_ips")[1],
        "source_port": F.when(by("failed", "accepted"), g(3)).when(by("suricata"), get("src_port")).when(by("generic"), get("source_port")).try_cast("int"),
        "destination_port": F.when(by("suricata"), get("dest_port")).when(by("generic"), get("destination_port")).try_cast("int"),
        "username": F.when(by("failed", "accepted"), g(1)).otherwise(F.col("_username")),
        "hostname": F.col("_hostname"), "process_name": F.col("_process_name"), "command_line": F.col("_command_line"),
        "message": F.when(text, line).when(by("access"), F.concat(g(2), F.lit(" "), path, F.lit(" -> "), g(5)))
        .when(by("suricata"), F.when(is_alert, field("_alert", "signature", "Suricata alert")).when(is_dns, F.concat(F.lit("DNS query: "), field("_dns", "rrname", "unknown"))).otherwise(F.col("_eve")))
        .when(by("windows"), F.coalesce(F.when(F.col("_message") != "", F.col("_message")), F.concat(F.lit("Windows event "), F.col("_code").cast("string")))).otherwise(text_of("message", "")),
        "raw_data": F.when(text, as_line).when(by("access"), as_request).otherwise(line),
        "ts_defaulted": F.col("_us").isNull(),
    }
    return four.withColumns({"_us": us, "_ips": ip_texts(F.col("_src"), F.col("_dst"))}).select("line", *[F.col(f"_others.{c}").alias(c) for c in others], *[event[n].alias(n) for n in NAMES], F.when(by("unread"), F.lit("no parser reads the line")).otherwise(problem).alias("problem"))


def sorted_out(lines: DataFrame, source_type: str = "auto", default_year: int = 1970, ingest_us: int = 0) -> DataFrame:
    """Every line once, from one parse: an event (FIELDS) where `problem` is null, else a reject, those that no parser reads
    among them."""
    return _parsed(lines, source_type, default_year, ingest_us, unread=True)


def normalise(lines: DataFrame, source_type: str = "auto", default_year: int = 1970, ingest_us: int = 0, strict: bool = False) -> DataFrame:
    """Events (FIELDS) of the column `line`; other columns stay, save those that an event has itself. JSON objects go by
    source_type or by their keys, other lines to the text parsers; lines that none of them reads are dropped.

    A syslog time has the year default_year; a record without a usable time, and a line on a new account, gets ingest_us
    and ts_defaulted. A record that cannot be read as what it claims to be (a Suricata alert whose severity is no number, a
    malformed array document) is left out and shown by rejects(), or with strict fails the job.
    """
    out = _parsed(lines, source_type, default_year, ingest_us)
    if strict:
        fail = F.raise_error(F.concat(F.lit("record cannot be read: "), F.col("problem")))
        out = out.withColumn("us", F.when(F.col("problem").isNotNull(), fail.cast("long")).otherwise(F.col("us")))
    else:
        out = out.where("problem IS NULL")
    return out.select(*[c for c in lines.columns if c not in (*NAMES, "problem")], *NAMES)


def rejects(lines: DataFrame, source_type: str = "auto") -> DataFrame:
    """The lines that normalise() leaves out for what they hold, with the problem."""
    return _parsed(lines, source_type, 1970, 0).where("problem IS NOT NULL").select(*[c for c in lines.columns if c not in (*NAMES, "problem")], "problem")


def ingest(spark: SparkSession, path: str, source_type: str = "auto", documents: bool = False, **kwargs) -> DataFrame:
    """Events of text files, or with documents of files that are one JSON array each, with their file."""
    from watchfire.sources.arrays import read_array_items

    lines = read_array_items(spark, path) if documents else read_lines(spark, path)
    return normalise(lines, source_type, **kwargs).drop("line")


def stored_events(events: DataFrame, ingest_us: int, first_id: int = 1) -> DataFrame:
    """Events as they are stored: defaults for what is missing, an id where the caller gives none, and ingested_at. New
    ids rise from first_id, are unique and need no shuffle; they are facts once written, so write before use."""
    defaults = {"source": "generic", "event_type": "generic_event", "severity": "info", "message": "", "raw_data": "{}"}
    out = events.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
    new = F.monotonically_increasing_id() + first_id
    return out.withColumns({"id": F.coalesce("id", new) if "id" in events.columns else new, "ingested_at": F.timestamp_micros(F.lit(ingest_us))})


def write_events(events: DataFrame, path: str, ingest_us: int, first_id: int = 1) -> None:
    """Appends stored_events() to a Parquet table by day."""
    day = F.to_date(F.timestamp_micros("us"))
    stored_events(events, ingest_us, first_id).withColumn("event_date", day).write.mode("append").partitionBy("event_date").parquet(path)


def audit_rows(events: DataFrame, batch: list[str], actor: str = "system") -> DataFrame:
    """One audit row for each batch of stored events (a batch is what shares the columns `batch`; all of it without any):
    its least id and its number of events."""
    n = F.count(F.lit(1))
    found = events.groupBy(*batch).agg(F.min("id").cast("string").alias("entity_id"), F.to_json(F.struct(n.alias("count"))).alias("details"))
    return found.withColumns({"action": F.lit("events_ingested"), "entity_type": F.lit("event_batch"), "actor": F.lit(actor)})
