"""Alert and incident details, and reports as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Alerts in one row of a payload at most.
PART = 1000


def _rules(rules: DataFrame) -> DataFrame:
    return F.broadcast(rules.select("rule_id", F.col("title").alias("rule"), F.col("technique").alias("mitre_technique"), F.col("tactic").alias("mitre_tactic")))


def alert_details(alerts: DataFrame, rules: DataFrame, events: DataFrame, incidents: DataFrame) -> DataFrame:
    """Every alert with its rule (a small table, broadcast), its terminal event and its incident; what is missing is null.
    alerts: incident_id, event_id and rule_id among others; columns of events and incidents come as structs."""
    event = events.select(F.col("id").alias("event_id"), F.struct(*events.columns).alias("event"))
    incident = incidents.select("incident_id", F.struct(*[c for c in incidents.columns if c != "incident_id"]).alias("incident"))
    return alerts.join(_rules(rules), "rule_id", "left").join(event, "event_id", "left").join(incident, "incident_id", "left")


def _placed(alerts: DataFrame, *by: str) -> DataFrame:
    """alerts with their place among those of the same `by`, in order of time (then event, then rule), from 1. Minutes are ranked
    on their own and start after the sum of those before, so an incident of very many alerts is not one task."""
    minute, key = F.expr("us DIV 60000000L"), [*by, "minute"]
    rows = alerts.withColumn("minute", minute)
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, before.alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy(*key).orderBy("us", "event_id", "rule_id"))
    return rows.join(sizes, key).withColumn("place", place).drop("minute", "before")


def incident_timeline(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts of incidents with their rule and their place within their incident by time (then event, then rule), from 1."""
    return _placed(alerts.where("incident_id IS NOT NULL"), "incident_id").join(_rules(rules), "rule_id", "left")


def incident_payloads(incidents: DataFrame, alerts: DataFrame, rules: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """Incidents with their alerts, in order of time, and notes as nested lists: incident_id, hour, part, the incident's
    other columns, alerts, notes.

    An incident may hold any number of alerts, so they come in parts: of one hour, and of PART alerts at most. hour counts
    from the incident's start; the parts in order of (hour, part) are the whole list. An incident without alerts has one part.
    notes (incident_id, author, body, us) come with the first part.
    """
    item = F.struct("us", "event_id", "rule_id", "title", "severity", "risk_score", "status", "rule", "mitre_technique", "mitre_tactic")
    known = alerts.join(incidents.select("incident_id", F.col("session_start").alias("_start")), "incident_id").join(_rules(rules), "rule_id", "left")
    known = _placed(known.withColumn("hour", F.expr("(us - _start) DIV 3600000000L")), "incident_id", "hour")
    known = known.withColumn("part", F.floor((F.col("place") - 1) / PART).cast("int"))
    parts = known.groupBy("incident_id", "hour", "part").agg(F.sort_array(F.collect_list(item)).alias("alerts"))
    out = incidents.join(parts, "incident_id", "left").withColumns({"hour": F.coalesce("hour", F.lit(0)), "part": F.coalesce("part", F.lit(0))})
    none = F.array().cast("array<struct<us:bigint,author:string,body:string>>")
    if notes is None:
        return out.withColumn("notes", none)
    listed = notes.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("us", "author", "body"))).alias("_notes"))
    out = out.join(listed, "incident_id", "left")
    # An incident begins with an alert, so its first part is that of hour 0.
    return out.withColumn("notes", F.when((F.col("hour") == 0) & (F.col("part") == 0), F.coalesce("_notes", none)).otherwise(none)).drop("_notes")


def incident_rows(incidents: DataFrame) -> DataFrame:
    """The incident table of a CSV report."""
    return incidents.select("incident_id", "title", "severity", "risk_score", "status", "entity_key")


def alert_rows(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """The alert table of a CSV report; what a rule lacks is empty."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return alerts.join(_rules(rules), "rule_id", "left").select(
        "incident_id", "alert_fingerprint", F.col("title").alias("alert_title"), "severity", "risk_score", text("rule"), text("mitre_technique"),
        text("mitre_tactic"), F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
    )


def write_report(path: str, incidents: DataFrame, alerts: DataFrame, rules: DataFrame, notes: DataFrame | None = None) -> None:
    """Writes path/incidents.json (payloads, one a line), path/incidents.csv and path/alerts.csv (with headers)."""
    incident_payloads(incidents, alerts, rules, notes).write.mode("overwrite").json(f"{path}/incidents.json")
    incident_rows(incidents).write.mode("overwrite").option("header", True).csv(f"{path}/incidents.csv")
    alert_rows(alerts, rules).write.mode("overwrite").option("header", True).csv(f"{path}/alerts.csv")
