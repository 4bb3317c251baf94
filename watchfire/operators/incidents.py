"""Incidents: alerts of an entity without a long gap, their scores, and similar incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchfire.functions.rules import SEVERITY_WEIGHT, Rule

GAP_US = 30 * 60 * 1_000_000


def severity_weight(level: Column) -> Column:
    pairs = [F.lit(x) for kv in SEVERITY_WEIGHT.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit(50))


def severity_of(score: Column) -> Column:
    return F.when(score >= 90, "critical").when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")


#: Sessions are first found within time buckets of so many microseconds, so that no entity is one task's work.
BUCKET_US = 3_600_000_000


def assign_sessions(alerts: DataFrame, gap_us: int = GAP_US, bucket_us: int = BUCKET_US) -> DataFrame:
    """alerts with entity_key (empty or null: unknown) and session_start: a gap of more than gap_us starts a session.
    Alerts that have an incident_id already are left out.

    An entity's alerts are dealt by time bucket. A second, small pass over one row for each entity and bucket says
    which buckets go on with the session before; equal times are one alert's, so ties do not matter.
    """
    if "incident_id" in alerts.columns:
        alerts = alerts.where("incident_id IS NULL").drop("incident_id")
    keyed = alerts.withColumn("entity_key", F.coalesce(F.when(F.col("entity_key") != "", F.col("entity_key")), F.lit("unknown")))
    keyed = keyed.withColumn("_bucket", F.expr(f"(us - pmod(us, {bucket_us}L)) DIV {bucket_us}L"))
    order = Window.partitionBy("entity_key", "_bucket").orderBy("us")
    before = F.lag("us").over(order)
    first = F.when(before.isNull() | (F.col("us") - before > gap_us), F.col("us"))
    local = keyed.withColumn("_start", F.last(first, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = local.groupBy("entity_key", "_bucket").agg(F.min("us").alias("_first"), F.max("us").alias("_last"), F.max("_start").alias("_own"))
    along = Window.partitionBy("entity_key").orderBy("_bucket")
    goes_on = F.coalesce(F.col("_first") - F.lag("_last").over(along) <= gap_us, F.lit(False))
    parts = parts.withColumn("_on", goes_on)
    # The start of the session that a bucket ends with: its own last one, or that of the bucket before if it is all one.
    ends = F.last(F.when(~F.col("_on") | (F.col("_own") > F.col("_first")), F.col("_own")), ignorenulls=True).over(along)
    parts = parts.withColumn("_ends", ends).withColumn("_carried", F.when(F.col("_on"), F.lag("_ends").over(along)))
    carried = parts.where("_carried IS NOT NULL").select("entity_key", "_bucket", "_first", "_carried")
    start = F.when(F.col("_start") == F.col("_first"), F.col("_carried"))
    return local.join(carried, ["entity_key", "_bucket"], "left").withColumn("session_start", F.coalesce(start, "_start")).drop("_bucket", "_start", "_first", "_carried")


def _incident_id() -> Column:
    return F.sha2(F.concat_ws("|", "entity_key", F.col("session_start").cast("string")), 256)


def assigned_alerts(alerts: DataFrame, gap_us: int = GAP_US) -> DataFrame:
    """alerts without an incident, with the id of the one they belong to, and status investigating."""
    return assign_sessions(alerts, gap_us).withColumns({"incident_id": _incident_id(), "status": F.lit("investigating")})


def incidents(alerts: DataFrame, rules: list[Rule], gap_us: int = GAP_US) -> DataFrame:
    """One row for each session: score (highest weight, more for more alerts and rules, 100 at most), severity, title,
    status open, summary. techniques: those that the session's rules count for, sorted.

    Rules and techniques are as few as the pack has, so all parts are partial aggregates.
    """
    mapped = {r.id: r.technique for r in rules if r.technique}
    techniques = F.create_map(*[F.lit(x) for kv in mapped.items() for x in kv]) if mapped else F.create_map(F.lit(""), F.lit(""))
    n, kinds = F.col("alert_count"), F.col("rule_count")
    score = F.least(F.lit(100), F.col("top") + F.least(F.lit(15), 3 * (n - 1)) + F.least(F.lit(10), 3 * (kinds - 1)))
    listed = F.when(F.size("techniques") > 0, F.array_join("techniques", ", ")).otherwise("unmapped")
    return (
        assign_sessions(alerts, gap_us)
        .groupBy("entity_key", "session_start")
        .agg(
            F.max(severity_weight(F.col("severity"))).alias("top"),
            F.count(F.lit(1)).alias("alert_count"),
            F.size(F.collect_set("rule_id")).cast("long").alias("rule_count"),
            F.max("us").alias("session_end"),
            F.array_sort(F.collect_set(F.try_element_at(techniques, F.col("rule_id")))).alias("techniques"),
        )
        .withColumn("risk_score", score.cast("double"))
        .select(
            _incident_id().alias("incident_id"), F.concat(F.lit("Correlated activity involving "), F.col("entity_key")).alias("title"),
            F.lit("open").alias("status"), "entity_key", "session_start", "session_end", "alert_count", "rule_count", "risk_score",
            severity_of(F.col("risk_score")).alias("severity"), "techniques",
            F.concat(F.col("alert_count").cast("string"), F.lit(" alert(s), "), F.size("techniques").cast("string"), F.lit(" MITRE technique(s): "), listed).alias("summary"),
        )
    )


def _kind(severity: str, techniques: str) -> Column:
    """What a score depends on besides the entity."""
    names = F.array_sort(F.array_distinct(F.array_compact(F.coalesce(techniques, F.array().cast("array<string>")))))
    return F.struct(names.alias("techniques"), F.col(severity).alias("severity"))


#: All sets of one, two and three of a kind's techniques; three shared ones count as much as more do.
_SETS = """concat(transform(kind.techniques, x -> array(x)),
    flatten(transform(kind.techniques, (x, i) -> transform(slice(kind.techniques, i + 2, size(kind.techniques)), y -> array(x, y)))),
    flatten(transform(kind.techniques, (x, i) -> flatten(transform(slice(kind.techniques, i + 2, size(kind.techniques)),
        (y, j) -> transform(slice(kind.techniques, i + j + 3, size(kind.techniques)), z -> array(x, y, z)))))))"""


def _lowest(rows: DataFrame, n: int, *by: str) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("incident_id"))).where(F.col("r") <= n).drop("r")


def kind_candidates(asked: DataFrame, rows: DataFrame, n: int, by: tuple[str, ...] = (), anyone: bool = False) -> DataFrame:
    """For each asked kind (columns `by` and q_kind) incidents of rows (columns `by`, incident_id, kind) among which are the n that
    score highest by techniques and severity, lowest ids first among equals; with anyone, also those that share nothing.

    A score counts three shared techniques at most. So for each set of one to three techniques the n lowest ids of those that
    have all of it are kept, once for each severity and once for all, and the asked kind takes the lists of its own sets:
    who is in none of them is beaten by n others. The number of candidates is that of a kind's sets times 2 n, whatever the
    number of kinds; no pairs of kinds are formed.
    """
    low = _lowest(rows, n, *by, "kind")
    none = F.array(F.array().cast("array<string>"))
    sets = F.concat(F.expr(_SETS), none)
    listed = _lowest(low.withColumn("set", F.explode(sets)).withColumn("severity", F.col("kind.severity")), n, *by, "set", "severity")
    over_all = _lowest(listed.drop("severity") if anyone else listed.drop("severity").where(F.size("set") > 0), n, *by, "set")
    wanted = asked.withColumn("kind", F.col("q_kind")).select(*by, "q_kind", F.explode(sets).alias("set"), F.col("q_kind.severity").alias("severity"))
    with_severity = wanted.join(listed, [*by, "set", "severity"]).drop("set", "severity")
    without = wanted.drop("severity").join(over_all, [*by, "set"]).drop("set")
    return with_severity.unionByName(without).dropDuplicates([*by, "q_kind", "incident_id"])


def similar_candidates(found: DataFrame, queried: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, incident_id, score, reasons): at most 2 * (k + 1) rows for each queried incident, its k most similar others among them.

    Without the entity, a score depends only on both sides' kinds (technique set and severity). So each queried kind has
    one list of its k + 1 best (kind_candidates), and each queried (entity, kind) one of the same entity. An incident of another
    entity that k others beat in the first list is beaten by them in any case.
    """
    q = queried.select(F.col("incident_id").alias("q_id"), F.col("entity_key").alias("q_entity"), _kind("severity", "techniques").alias("q_kind"))
    others = found.select("incident_id", "entity_key", _kind("severity", "techniques").alias("kind"))
    shared = F.array_intersect(F.col("kind.techniques"), F.col("q_kind.techniques"))
    alike = F.coalesce(F.col("kind.severity") == F.col("q_kind.severity"), F.lit(False))
    base = F.least(F.lit(30), 10 * F.size(shared)) + F.when(alike, 10).otherwise(0)
    why = F.array_compact(F.array(F.when(F.size(shared) > 0, F.concat(F.lit("shared MITRE: "), F.array_join(F.array_sort(shared), ", "))), F.when(alike, "same severity")))

    def best(pairs: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("base"), "incident_id")
        return pairs.withColumns({"base": base, "why": why}).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")

    of_kind = best(kind_candidates(q.select("q_kind").distinct(), others, k + 1), "q_kind").drop("kind")
    named = F.coalesce(F.col("q_entity"), F.lit("")) != ""
    own = others.withColumnRenamed("entity_key", "q_entity").where(named)
    of_entity = best(kind_candidates(q.where(named).select("q_entity", "q_kind").distinct(), own, k + 1, ("q_entity",), anyone=True), "q_entity", "q_kind").drop("kind")

    same = F.coalesce(named & (F.col("entity_key") == F.col("q_entity")), F.lit(False))

    def shown(same: Column) -> list[Column]:
        reasons = F.when(same, F.concat(F.array(F.lit("same entity")), F.col("why"))).otherwise(F.col("why"))
        return [F.col("q_id"), F.col("incident_id"), (F.col("base") + F.when(same, 60).otherwise(0)).cast("long").alias("score"), reasons.alias("reasons")]

    out = q.join(of_kind, "q_kind").select(*shown(same)).unionByName(q.join(of_entity, ["q_entity", "q_kind"]).select(*shown(F.lit(True))))
    return out.where("q_id <> incident_id AND score > 0").dropDuplicates(["q_id", "incident_id"])


def similar_incidents(found: DataFrame, queried: DataFrame, k: int = 5) -> DataFrame:
    """For each queried incident the k most similar others: 60 for the same entity, 10 for each shared technique up to 30,
    10 for the same severity; ties by id; with the reasons in that order. queried may be all of found: no pairs within a
    group are formed."""
    best = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "incident_id"))
    return similar_candidates(found, queried, k).withColumn("rank", best).where(F.col("rank") <= k).select("q_id", "incident_id", "score", "rank", "reasons")
