"""Operational statistics, rule coverage and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.functions.attack import TACTICS, TECHNIQUES, technique_info
from watchfire.functions.rules import Rule
from watchfire.operators.detect import matched_events

DAY_US = 86_400_000_000


def dashboard(events: DataFrame, alerts: DataFrame, incidents: DataFrame, tests: DataFrame, now_us: int) -> DataFrame:
    """One row of counts; each part is a partial aggregate of its own table, and the one-row results are put together."""
    parts = [
        events.agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("us") >= now_us - DAY_US).alias("events_24h")),
        alerts.agg(F.count_if(F.col("status").isin("new", "investigating")).alias("open_alerts")),
        incidents.agg(F.count_if(F.col("status") != "closed").alias("open_incidents")),
        tests.agg(F.coalesce(F.bround(100 * F.count_if("passed") / F.nullif(F.count(F.lit(1)), F.lit(0)), 1), F.lit(0.0)).alias("test_success")),
    ]
    keyed = [p.withColumn("k", F.lit(1)) for p in parts]
    out = keyed[0]
    for p in keyed[1:]:
        out = out.join(p, "k")
    return out.drop("k")


def hour_label(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "MM-dd HH:00")


def timeline(events: DataFrame, hours: int = 24) -> DataFrame:
    """Events per hour label for the `hours` labels that begin last; hours without events are not filled in."""
    per = events.groupBy(hour_label(F.col("us")).alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"))
    return per.orderBy(F.desc("first_us")).limit(hours).orderBy("first_us")


def count_by(df: DataFrame, column: str, missing: str | None = None) -> DataFrame:
    c = F.col(column)
    if missing is not None:
        c = F.coalesce(F.when(c != "", c), F.lit(missing))
    return df.groupBy(c.alias(column)).agg(F.count(F.lit(1)).alias("n"))


def coverage(rules: DataFrame, tests: DataFrame) -> DataFrame:
    """rules (rule_id, tactic, technique, enabled) with status, tests and pass rate, in order of the tactic's rank (999 for
    one that is not in the list) and technique. tests (rule_id, passed) are counted before the join."""
    per = tests.groupBy("rule_id").agg(F.count(F.lit(1)).alias("tests"), F.count_if("passed").alias("ok"))
    rank = F.create_map(*[x for i, t in enumerate(TACTICS) for x in (F.lit(t), F.lit(i))])
    n = F.coalesce("tests", F.lit(0))
    out = rules.join(per, "rule_id", "left").select(
        "rule_id", "tactic", "technique", n.cast("long").alias("tests"),
        F.when(~F.col("enabled"), "disabled").when(n == 0, "untested").when(F.col("ok") < n, "failed").otherwise("passed").alias("status"),
        F.when(n > 0, F.bround(100 * F.col("ok") / n, 1)).otherwise(F.lit(0.0)).alias("pass_rate"),
        F.coalesce(F.try_element_at(rank, F.col("tactic")), F.lit(999)).alias("tactic_rank"),
    )
    return out.orderBy("tactic_rank", F.coalesce("technique", F.lit("")), "rule_id")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_id, title, level, technique, technique_name, tactic, techniques): the first technique is the one that the
    rule's alerts count for; the rule's own name and tactic go before those of the table."""
    rows = [(r.id, r.title, r.level, r.technique, r.technique_name, r.tactic, r.techniques) for r in rules]
    return spark.createDataFrame(rows, "rule_id string, title string, level string, technique string, technique_name string, tactic string, techniques array<string>")


def attack_techniques(rules: DataFrame) -> DataFrame:
    """(technique, name, tactic, rules) for each technique that a rule of rules (rule_id, techniques) names, sorted; rules is
    the sorted list of those that do."""
    each = rules.select("rule_id", F.explode("techniques").alias("technique")).groupBy("technique").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))
    names, tactics = (F.create_map(*[F.lit(x) for k, v in TECHNIQUES.items() for x in (k, v[i])]) for i in (0, 1))
    other = technique_info("other")
    name = F.coalesce(F.try_element_at(names, F.col("technique")), F.lit(other[0]))
    tactic = F.coalesce(F.try_element_at(tactics, F.col("technique")), F.lit(other[1]))
    return each.select("technique", name.alias("name"), tactic.alias("tactic"), "rules").orderBy("technique")


def attack_summary(rules: DataFrame) -> DataFrame:
    """One row: rules with a technique, and all rules, of rules (rule_id, techniques)."""
    return rules.agg(F.count_if(F.size("techniques") > 0).alias("mapped_rules"), F.count(F.lit(1)).alias("total_rules"))


def search(df: DataFrame, text: str | None, columns: list[str], equal: dict[str, str], newest: str | None, tie: str) -> DataFrame:
    """Rows where any of the columns is like %text% (ignoring case; % and _ of the text are live) and all of `equal` hold,
    newest first; without newest, in order of tie."""
    if text:
        like = F.lit(False)
        for c in columns:
            like = like | F.col(c).ilike("%" + text.replace("\\", "\\\\") + "%")
        df = df.where(like)
    for c, v in equal.items():
        if v:
            df = df.where(F.col(c) == v)
    return df.orderBy(*([F.desc(newest)] if newest else []), tie)


def page(df: DataFrame, number: int, size: int) -> DataFrame:
    """One page of an ordered DataFrame, from 1."""
    return df.offset((max(1, number) - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    """One row: the page that is meant (1 at least), rows in all, and pages (1 at least)."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(max(1, number)).alias("page"), "total", F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("long").alias("pages")
    )


def newest(df: DataFrame, by: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(n)


def upsert_rules(catalogue: DataFrame, pack: DataFrame, payload: list[str]) -> DataFrame:
    """The catalogue after an import by rule_id: new rules get version 1 and are enabled; a changed payload is overwritten
    and raises the version; enabled and missing rules stay. `change` says created, updated or same."""
    old, new = catalogue.alias("o"), pack.alias("n")
    both = old.join(new, F.col("o.rule_id") == F.col("n.rule_id"), "full_outer")
    same = F.lit(True)
    for c in payload:
        same = same & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    created, given = F.col("o.rule_id").isNull(), F.col("n.rule_id").isNotNull()
    return both.select(
        F.coalesce("n.rule_id", "o.rule_id").alias("rule_id"),
        *[F.when(given, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in payload],
        F.when(created, 1).when(given & ~same, F.col("o.version") + 1).otherwise(F.col("o.version")).cast("int").alias("version"),
        F.coalesce("o.enabled", F.lit(True)).alias("enabled"),
        F.when(created, "created").when(given & ~same, "updated").otherwise("same").alias("change"),
    )


def duplicate_rules(pack: DataFrame) -> DataFrame:
    """(rule_id, n) of ids that a pack has more than once: such a pack is refused before anything is changed."""
    return pack.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def edit_rule(catalogue: DataFrame, rule: Rule, rule_id: str, payload: dict[str, Column]) -> DataFrame:
    """The catalogue with the payload columns of one rule replaced and its version raised, changed or not; the id stays."""
    if rule.id != rule_id:
        raise ValueError("a rule's id cannot be edited")
    here = F.col("rule_id") == rule_id
    new = {c: F.when(here, v).otherwise(F.col(c)) for c, v in payload.items()}
    return catalogue.withColumns(new | {"version": F.when(here, F.col("version") + 1).otherwise(F.col("version"))})


def toggle_rule(catalogue: DataFrame, rule_id: str) -> DataFrame:
    """The catalogue with one rule enabled if it was disabled, and the other way round."""
    return catalogue.withColumn("enabled", F.col("enabled") != (F.col("rule_id") == rule_id))


def backtest(labelled: DataFrame, rules: list[Rule]) -> DataFrame:
    """Confusion counts of each rule on labelled events (rule_id, expected, event columns). Every event meets the rules as in
    detection, so a large pack goes by its index; of the matches those with the event's own rule count. Rules that are not
    given match nothing."""
    own = labelled.withColumnRenamed("rule_id", "own_rule")
    hits = matched_events(own, rules).where("rule_id = own_rule").groupBy("rule_id").agg(F.count_if("expected").alias("right"), F.count_if(~F.col("expected")).alias("wrong"))
    totals = labelled.groupBy("rule_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("expected").alias("positive"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return totals.join(hits, "rule_id", "left").select(
        "rule_id", "total", (n("right") + F.col("total") - F.col("positive") - n("wrong")).alias("passed"), (F.col("positive") - n("right")).alias("missed_positives"), n("wrong").alias("unexpected_matches"),
    )
