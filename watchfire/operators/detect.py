"""Matching rules against events, correlation per entity, alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchfire.functions.rules import SEVERITY_WEIGHT, Rule
from watchfire.operators import correlate, rule_index
from watchfire.sources.security_events import EVENT_FIELDS
from watchfire.storage import written

DEFAULT_KEY = ("source_ip", "hostname", "username")
#: Rules whose predicates are columns of one projection; packs of more rules are matched by the index of rules.
COLUMN_RULES = 40
#: Columns of an alert; evidence is JSON text.
ALERT_COLUMNS = ["rule_id", "entity_key", "event_id", "us", "title", "severity", "risk_score", "alert_fingerprint", "event_ids", "evidence"]
#: Matches of one rule and entity beyond so many, or a SHARE of all matches, are split by time.
HOT_ROWS, SHARE = 200_000, 2_000


def default_key() -> Column:
    """The non-empty ones of source address, host and user, or unknown."""
    key = F.concat_ws("|", *[F.when(F.col(c) != "", F.col(c)) for c in DEFAULT_KEY])
    return F.when(key == "", "unknown").otherwise(key)


def _json_string(text: Column) -> Column:
    """The text as a JSON string in ASCII: what is not printable ASCII is escaped, by UTF-16 units."""
    short = F.create_map(*[F.lit(x) for kv in (('"', '\\"'), ("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")) for x in kv])

    def escape(c: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.coalesce(F.try_element_at(short, c), F.when(c.rlike("^[ -~]$"), c).otherwise(units))

    escaped = F.array_join(F.transform(F.split(text, ""), escape), "")
    plain = text.rlike('^[ !#-\\[\\]-~]*$') & ~F.contains(text, F.lit("\n"))
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(escaped), F.lit('"'))


def fingerprint(rule: Column, entity: Column, event_id: Column) -> Column:
    """sha256 of the compact ASCII JSON list [rule, entity, event]."""
    parts = [F.lit("["), _json_string(rule), F.lit(","), _json_string(entity), F.lit(","), event_id.cast("string"), F.lit("]")]
    return F.sha2(F.concat(*parts), 256)


def matched_events(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """(event, rule) pairs: the columns of events, rule_id, and mask: of a sequence rule, bit k is set if the event fits
    stage k. No shuffle.

    Up to COLUMN_RULES rules are Boolean columns of one projection. More of them are tested in Arrow batches, each on the
    events that have what its matches must have (rule_index), so neither code nor work grows with rules that share nothing
    with the events. An event that is given twice gives its pairs twice.
    """
    parts, left = [], rules
    if len(rules) > COLUMN_RULES:
        left = []
        for i in range(0, len(rules), rule_index.RULES_A_PASS):
            parts.append(rule_index.indexed_matches(events, rules[i : i + rule_index.RULES_A_PASS]))
    for i in range(0, len(left), COLUMN_RULES):
        hits = F.array_compact(F.array(*[F.when(r.matches(), F.struct(F.lit(r.id).alias("rule_id"), _mask(r).alias("mask"))) for r in left[i : i + COLUMN_RULES]]))
        parts.append(events.select(*events.columns, F.inline(hits)))
    return reduce(DataFrame.unionByName, parts) if parts else events.withColumns({"rule_id": F.lit(""), "mask": F.lit(0).cast("long")}).where("false")


def _mask(rule: Rule) -> Column:
    bits = [F.when(rule.selection(name), F.lit(1 << k)).otherwise(F.lit(0)) for k, name in enumerate(rule.stages if rule.kind == "sequence" else [])]
    return reduce(Column.__add__, bits, F.lit(0)).cast("long")


#: What correlation and alerts need of a rule, as a row.
_RULE_ROW = (
    "rule_id string, kind string, title string, severity string, risk_score double, frame long, timeframe string, threshold int, group_by array<string>, stage_names array<string>, "
    "stages int, needs int"
)


def _rule_rows(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a small table, to be broadcast: a row for each rule of the pack that the driver holds."""
    rows = [
        (r.id, r.kind, r.title, r.level, float(SEVERITY_WEIGHT.get(r.level, 50)), r.frame_us, r.timeframe, r.threshold if r.kind == "count" else None, r.group_by, r.stages,
         len(r.stages) if r.kind == "sequence" else 0, r.threshold if r.kind == "count" else 0)
        for r in rules
    ]
    return F.broadcast(spark.createDataFrame(rows, _RULE_ROW))


def first_of_repeated(matched: DataFrame, events: DataFrame) -> DataFrame:
    """matched without the rows of repeated ids whose id came earlier, matched or not: of an id, only its first event in time
    counts. Of events just ids and times are read again, and only matched ids are shuffled. Rows of one id and time all stay:
    what follows takes one of them for each rule."""
    asked = matched.where("id IS NOT NULL").select("id").distinct()
    first = events.select("id", "us").join(asked, "id", "left_semi").groupBy("id").agg(F.min("us").alias("first_us"))
    return matched.join(first, "id", "left").where("id IS NULL OR us = first_us").select(*matched.columns)


def keyed(matched: DataFrame, rules: list[Rule]) -> DataFrame:
    """Matches with columns of their rule (_RULE_ROW) and its group-by key as entity_key. Those without a key, since a
    member is null, empty or no event column, are left out. A numeric 0 is left out of the key's text."""
    fields = [f for f in dict.fromkeys(f for r in rules for f in r.group_by) if f in matched.columns]
    known = _rule_rows(matched.sparkSession, rules)
    values = F.array(*[F.col(f).cast("string") for f in fields]) if fields else F.array().cast("array<string>")
    names, zeros = F.array(*map(F.lit, fields)), F.array(*[F.lit(f) for f in fields if f.endswith("_port") or f == "id"])
    value = lambda f: F.get(values, F.array_position(names if fields else F.array().cast("array<string>"), f).cast("int") - 1)
    whole = F.forall("group_by", lambda f: F.coalesce(value(f) != "", F.lit(False)))
    shown = F.filter("group_by", lambda f: ~(F.array_contains(zeros, f) & (value(f) == "0"))) if fields else F.col("group_by")
    key = F.array_join(F.transform(shown, value), "|")
    return matched.join(known, "rule_id").where(whole).withColumn("entity_key", F.when(key == "", "unknown").otherwise(key))


def single_alerts(events: DataFrame, rules: list[Rule], repeats: bool = True) -> DataFrame:
    """An alert for each event that a rule without correlation matches. Evidence: the event. repeats: ids may come more than
    once, of which the first in time counts (rows without an id all count); False if the source has each id once."""
    rules = [r for r in rules if r.kind == "single"]
    found = matched_events(events, rules)
    if repeats:
        found = first_of_repeated(found, events)
    found = found.withColumn("entity_key", default_key())
    raw = F.coalesce(F.try_parse_json("raw_data"), F.parse_json(F.lit("{}"))).alias("raw_data")
    shown = F.to_json(F.struct(*[raw if c == "raw_data" else F.col(c) for c in EVENT_FIELDS if c in events.columns]))
    found = found.select("rule_id", "entity_key", F.col("id").alias("event_id"), "us", F.array("id").alias("event_ids"), shown.alias("event"))
    if not repeats:
        return found
    apart = F.when(F.col("event_id").isNull(), F.monotonically_increasing_id())
    return found.withColumn("apart", apart).dropDuplicates(["rule_id", "event_id", "apart"]).drop("apart")


def _split_by_time(matches: DataFrame, hot_rows: int, share: int) -> DataFrame:
    """matches (a written table) with the time bucket they are in. An entity of a rule has one bucket, unless it has more than
    hot_rows matches, or a share of all: then its slots, each a timeframe long, are cut into buckets of about that many rows.

    Rows of the slot before a cut are given to the next bucket too (home false), since counts look back a timeframe; those
    of the slot after it to the bucket before, since sequences look ahead. Of a count rule's slot only the first `needs`
    rows matter, since an alert fires at the last of them at the latest; of very frequent keys no others are kept. There are
    at most `share` buckets more than keys, so cuts are broadcast.
    """
    most = max(hot_rows, matches.count() // share)
    key, one = ["rule_id", "entity_key"], F.lit(0).cast("long")
    hot = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*key, F.lit(True).alias("hot"))
    plain = matches.withColumns({"bucket": one, "home": F.lit(True)})
    if hot.isEmpty():
        return plain
    slot = F.expr("(us - pmod(us, frame)) DIV frame")
    marked = matches.join(F.broadcast(hot), key, "left").withColumn("slot", slot)
    needs = matches.agg(F.coalesce(F.max("needs"), F.lit(0))).first()[0]
    busy = marked.where("hot AND stages = 0")
    if needs:
        place = F.row_number().over(Window.partitionBy(*key, "slot").orderBy("us", "id"))
        busy = busy.withColumn("place", place).where(F.col("place") <= needs).drop("place")
    busy = written(busy.unionByName(marked.where("hot AND stages > 0")))
    sizes = busy.groupBy(*key, "slot").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = sizes.withColumn("part", F.floor(before / most)).groupBy(*key, "part").agg(F.min("slot").alias("cut")).groupBy(*key).agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    placed = busy.join(F.broadcast(cuts), key).withColumn("bucket", F.size(F.filter("cuts", lambda c: c <= F.col("slot"))).cast("long"))
    other = F.when((F.col("stages") == 0) & F.array_contains("cuts", F.col("slot") + 1), F.col("bucket") + 1).when((F.col("stages") > 0) & F.array_contains("cuts", F.col("slot")), F.col("bucket") - 1)
    places = F.array_compact(F.array(F.struct("bucket", F.lit(True).alias("home")), F.when(other.isNotNull(), F.struct(other.alias("bucket"), F.lit(False).alias("home")))))
    rest = marked.where("hot IS NULL").withColumns({"bucket": one, "home": F.lit(True)})
    return rest.drop("hot", "slot").unionByName(placed.select(*matches.columns, F.inline(places)))


def correlated_alerts(events: DataFrame, rules: list[Rule], stored: DataFrame | None = None, hot_rows: int = HOT_ROWS, share: int = SHARE, repeats: bool = True) -> DataFrame:
    """Alerts of the count and sequence rules, from one scan of events and one shuffle of the matches, which are written
    first: keys of many matches are split by time as their numbers ask (_split_by_time).

    Count: per rule and entity the first event, in time order, that ends a window of at least `threshold` matches.
    threshold matches lie in [t - timeframe, t] exactly if the one threshold - 1 rows before is not older than that.
    Sequence: per rule and entity the first start whose stages follow one another within the timeframe of the start. From
    the last stage back, the next later event of each stage is the last one seen in reverse time order. So a sort each
    way does it, whatever the number of rules and stages. Starts whose terminal event is stored already are passed over.

    Packs of more than COLUMN_RULES rules on ids that come once go by correlate.first_windows() instead: the same alerts, of
    which a match never is a row.

    Ties in time go by id. repeats: as in single_alerts().
    """
    rules = [r for r in rules if r.kind != "single"]
    if not rules:
        return _no_alerts(events)
    if len(rules) > COLUMN_RULES and not repeats:
        passes = [correlate.first_windows(events, rules[i : i + rule_index.RULES_A_PASS], stored is not None) for i in range(0, len(rules), rule_index.RULES_A_PASS)]
        return _first_found(reduce(DataFrame.unionByName, passes), stored)
    counts, longest = sorted({r.threshold for r in rules if r.kind == "count"}), max(len(r.stages) if r.kind == "sequence" else 0 for r in rules)
    matched = matched_events(events, rules)
    rows = keyed(first_of_repeated(matched, events) if repeats else matched, rules)
    rows = rows.select("rule_id", "entity_key", "id", "us", "mask", "frame", "stages", "needs")
    if repeats:
        apart = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
        rows = rows.withColumn("apart", apart).dropDuplicates(["rule_id", "id", "apart"]).drop("apart")
    rows = _split_by_time(written(rows), hot_rows, share)
    key = Window.partitionBy("rule_id", "entity_key", "bucket")
    counted = F.lit(False)
    if counts:
        order = key.orderBy("us", "id")
        starts = [F.when(F.col("needs") == n, F.lag("us", n - 1).over(order) if n > 1 else F.col("us")) for n in counts]
        rows = rows.withColumns({"place": F.row_number().over(order), "fires": F.coalesce(F.col("us") - F.coalesce(*starts) <= F.col("frame"), F.lit(False))})
        # Of a count, the rows of the first window that fires; their ids are listed only then.
        rows = rows.withColumn("first", F.min(F.when(F.col("fires") & F.col("home"), F.col("place"))).over(key))
        counted = (F.col("stages") == 0) & (F.col("place") <= F.col("first")) & (F.col("place") > F.col("first") - F.col("needs"))
    later = key.orderBy(F.desc("us"), F.desc("id")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("next", F.lit(None).cast("struct<end_us:bigint,end_id:bigint,ids:array<bigint>>"))
    for k in range(longest - 1, 0, -1):
        here = F.col("mask").bitwiseAND(F.lit(1 << k)) > 0
        end = F.struct(F.col("us").alias("end_us"), F.col("id").alias("end_id"), F.array("id").alias("ids"))
        onward = F.struct("next.end_us", "next.end_id", F.concat(F.array("id"), F.col("next.ids")).alias("ids"))
        step = F.when(here & (F.col("stages") == k + 1), end).when(here & (F.col("stages") > k + 1) & F.col("next").isNotNull(), onward)
        rows = rows.withColumn("next", F.last(step, ignorenulls=True).over(later))
    started = (F.col("mask").bitwiseAND(F.lit(1)) > 0) & (F.col("next.end_us") - F.col("us") <= F.col("frame")) & F.col("home")
    done = (
        rows.where(counted | started)
        .withColumn("start", F.when(F.col("stages") > 0, F.struct("us", "id")))
        .groupBy("rule_id", "entity_key", "bucket", "start")  # as it is dealt out already
        .agg(F.first("next").alias("next"), F.sort_array(F.collect_list(F.struct("us", "id"))).alias("window"))
    )
    last = F.element_at("window", -1)
    window = F.struct(last["us"].alias("end_us"), last["id"].alias("end_id"), F.transform("window", lambda x: x["id"]).alias("ids"))
    path = F.struct("next.end_us", "next.end_id", F.concat(F.array("start.id"), F.col("next.ids")).alias("ids"))
    done = done.select(
        "rule_id", "entity_key", F.coalesce("start", last).alias("at"), F.col("start").isNotNull().alias("sequence"),
        F.when(F.col("start").isNotNull(), path).otherwise(window).alias("f"),
    )
    return _first_found(done, stored)


def _first_found(done: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Of what each rule and entity found (at: place in time, sequence, f: end_us, end_id, ids) the first, as correlated_alerts()
    gives it; sequences that end in a stored event are passed over."""
    if stored is not None:
        done = done.withColumn("event_id", F.col("f.end_id"))
        known = stored.select("rule_id", "entity_key", "event_id").distinct().withColumn("known", F.lit(True))
        done = done.join(known, ["rule_id", "entity_key", "event_id"], "left").where("known IS NULL OR NOT sequence")
    found = done.groupBy("rule_id", "entity_key").agg(F.min_by("f", "at").alias("f"))
    return found.select("rule_id", "entity_key", F.col("f.end_id").alias("event_id"), F.col("f.end_us").alias("us"), F.col("f.ids").alias("event_ids"), F.lit(None).cast("string").alias("event"))


def count_alerts(events: DataFrame, rules: list[Rule], **how) -> DataFrame:
    """correlated_alerts() of the count rules alone."""
    return correlated_alerts(events, [r for r in rules if r.kind == "count"], **how)


def sequence_alerts(events: DataFrame, rules: list[Rule], stored: DataFrame | None = None, **how) -> DataFrame:
    """correlated_alerts() of the sequence rules alone."""
    return correlated_alerts(events, [r for r in rules if r.kind == "sequence"], stored, **how)


def _unless_stored(found: DataFrame, stored: DataFrame) -> DataFrame:
    known = ["rule_id", "entity_key", "event_id"]
    return found.join(stored.select(*known).distinct(), known, "left_anti")


def _no_alerts(events: DataFrame) -> DataFrame:
    return events.sparkSession.createDataFrame([], "rule_id string, entity_key string, event_id long, us long, event_ids array<long>, event string")


def _evidence() -> Column:
    """What an alert rests on, as JSON: the event, or the events that were counted or follow one another, with the rule's
    threshold or stages, timeframe and key (columns of _RULE_ROW)."""
    mark, ids = F.col("alert_fingerprint"), F.col("event_ids")
    kind = lambda name: F.lit(name).alias("type")
    rest = ("timeframe", ids, "group_by", mark)
    count = F.struct(kind("correlation"), F.size(ids).alias("count"), "threshold", *rest)
    sequence = F.struct(kind("sequence"), F.col("stage_names").alias("stages"), *rest)
    single = F.struct(kind("single_event"), F.parse_json("event").alias("event"), mark)
    return F.when(F.col("kind") == "count", F.to_json(count)).when(F.col("kind") == "sequence", F.to_json(sequence)).otherwise(F.to_json(single))


def all_alerts(events: DataFrame, rules: list[Rule], stored: DataFrame | None = None, repeats: bool = True, **how) -> DataFrame:
    """Alerts of all rules, without those that are stored already (rule, entity and terminal event).

    Count alerts are chosen first and then dropped if stored, as in an incremental run over a slice; sequences pass
    over stored ones. Two scans of events, whatever the number of rules: one for the rules without correlation, whose
    matches need no window, one for all others. Columns: ALERT_COLUMNS. repeats: as in single_alerts(); how: hot_rows and
    share of correlated_alerts().
    """
    found = single_alerts(events, rules, repeats).unionByName(correlated_alerts(events, rules, stored, repeats=repeats, **how)) if rules else _no_alerts(events)
    if stored is not None:
        found = _unless_stored(found, stored)
    found = found.join(_rule_rows(events.sparkSession, rules), "rule_id").withColumn("alert_fingerprint", fingerprint(F.col("rule_id"), F.col("entity_key"), F.col("event_id")))
    return found.withColumn("evidence", _evidence()).select(*ALERT_COLUMNS)
