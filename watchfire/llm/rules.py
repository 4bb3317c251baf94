"""Quality rules as a short-circuit cascade, in built-in functions only."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfire.llm.common import materialise

#: The measures that quality_cascade returns; the others are only made for rows that need them.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """rejects is true for a row that goes; it may use the columns that text_measures() adds."""

    name: str
    rejects: Column


def _words(text: Column) -> Column:
    # A blank alone is split without a pattern; the other white space is rare.
    return F.array_remove(F.split(F.regexp_replace(text, r"[\x09-\x0D]+", " "), " "), "")


#: A 64-bit hash of each window of five words.
_WINDOWS = (
    "transform(arrays_zip(slice(__words, 1, greatest(size(__words) - 4, 0)), slice(__words, 2, size(__words)), "
    "slice(__words, 3, size(__words)), slice(__words, 4, size(__words)), slice(__words, 5, size(__words))), x -> xxhash64(x))"
)
_WINDOWS = f"IF(size(__words) > 4, slice({_WINDOWS}, 1, size(__words) - 4), CAST(array() AS array<bigint>))"
#: Words in a window that the text has twice or more. Only where some hash repeats: the windows' places are sorted
#: by a part of the hash, in one long with the place (30 bits hold any text's), and those with an equal neighbour by the
#: whole hash, so that equal ones are neighbours; then the union of the windows is summed by the gaps between starts.
_SORTED = "sort_array(transform(__h, (h, i) -> (h & -1073741824L) | i))"
_LIKELY = (
    f"transform(array({_SORTED}), c -> transform(filter(c, (x, j) -> "
    "(j > 0 AND shiftright(c[j - 1], 30) = shiftright(x, 30)) OR (j + 1 < size(c) AND shiftright(c[j + 1], 30) = shiftright(x, 30))), "
    "x -> CAST(x & 1073741823L AS INT)))[0]"
)
_PLACED = f"sort_array(transform({_LIKELY}, i -> named_struct('h', __h[i], 'i', i)))"
_STARTS = (
    f"transform(array({_PLACED}), s -> sort_array(transform(filter(s, (x, j) -> "
    "(j > 0 AND s[j - 1].h = x.h) OR (j + 1 < size(s) AND s[j + 1].h = x.h)), x -> x.i)))[0]"
)
_COVERED = (
    f"transform(array({_STARTS}), p -> aggregate(transform(p, (x, j) -> IF(j + 1 < size(p), least(5, p[j + 1] - x), 5)), "
    "0L, (a, x) -> a + x))[0]"
)
_REPEAT_WORDS = f"CASE WHEN size(__h) > 1 AND size(array_distinct(__h)) < size(__h) THEN {_COVERED} ELSE 0L END"


def text_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_chars, n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_shouts (pairs of
    exclamation marks), n_letters (A-Z, a-z and all beyond ASCII), n_bullets (lines that begin with a bullet) and n_broken (lines
    that end in three dots) to every row. Null text counts as empty: all are 0. What a query does not use costs nothing."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return (
        docs.withColumn("__text", text)
        .withColumn("__words", _words(F.col("__text")))
        .withColumn("__h", F.expr(_WINDOWS))
        .withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
        .withColumns(
            {
                "n_chars": F.length("__text").cast("long"),
                "n_letters": F.length(F.regexp_replace("__text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", "")).cast("long"),
                "n_bullets": F.size(F.filter("__lines", lambda x: x.rlike(r"^[\x20\x09]*[-*\u2022]"))).cast("long"),
                "n_broken": F.size(F.filter("__lines", lambda x: x.rlike(r"(\.\.\.|\u2026)[\x20\x09-\x0D]*$"))).cast("long"),
                "n_words": F.size("__words").cast("long"),
                "word_chars": F.length(F.array_join("__words", "")).cast("long"),
                "n_symbols": (F.length("__text") - F.length(F.regexp_replace("__text", f"[{SYMBOLS}]+", ""))).cast("long"),
                "n_lines": F.size("__lines").cast("long"),
                "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
                "n_repeat_words": F.expr(_REPEAT_WORDS).cast("long"),
                "n_shouts": F.floor((F.length("__text") - F.length(F.replace("__text", F.lit("!!"), F.lit("")))) / 2).cast("long"),
            }
        )
        .drop("__text", "__words", "__h", "__lines")
    )


def default_rules() -> list[Rule]:
    """Thresholds far beyond what prose shows: symbols in place of words, shouting, lists of the same line. The last five use
    measures that no result shows, so only rows that are still undecided pay for them."""
    n, lines = F.col("n_words"), F.col("n_lines")
    return [
        Rule("few_words", n < 10),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 20 * n),
        Rule("symbols", 10 * F.col("n_symbols") > 3 * n),
        Rule("duplicate_lines", 2 * F.col("n_dup_lines") > F.col("n_lines")),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 25 * n)),
        Rule("shouting", 10 * F.col("n_shouts") > 3 * n),
        Rule("few_letters", 100 * F.col("n_letters") < 30 * F.col("n_chars")),
        Rule("bullets", (lines > 3) & (10 * F.col("n_bullets") > 9 * lines)),
        Rule("broken_lines", (lines > 3) & (10 * F.col("n_broken") > 7 * lines)),
    ]


def order_by_rejection_per_cost(sample: DataFrame, rules: list[Rule], text_col: str = "text", repeats: int = 3) -> list[Rule]:
    """Rules in the order in which a cascade rejects most per second, as measured on the sample (a written table).

    A rule's cost is the least time of `repeats` passes over the sample that compute only what the rule needs, less the
    least time of passes that compute nothing. Greedy: at each step the rule with the highest share rejected, among
    rows that the earlier rules leave, per cost; of equal ones the earlier. The order changes the work, never the verdict.
    """
    measured = text_measures(sample, text_col)

    def seconds(column: Column) -> float:
        took = []
        for _ in range(repeats):
            began = time.perf_counter()
            measured.agg(F.count_if(column)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    base = seconds(F.lit(True))
    flags = [F.coalesce(r.rejects, F.lit(False)) for r in rules]
    cost = [max(1e-4, seconds(f) - base) for f in flags]
    # One row for each pattern of rejections: at most 2 ** rules, however large the sample.
    named = [f.alias(f"r{i}") for i, f in enumerate(flags)]
    patterns = measured.select(*named).groupBy(*[f"r{i}" for i in range(len(rules))]).count().collect()
    return [rules[i] for i in greedy_order(cost, [(tuple(p[:-1]), p[-1]) for p in patterns])]


def greedy_order(cost: list[float], patterns: list[tuple[tuple[bool, ...], int]]) -> list[int]:
    """Rules' numbers: at each step the one that rejects most, of the rows that those before leave, for its cost.
    patterns: which rules reject a row, and how many rows there are of it."""
    left, out = list(range(len(cost))), []
    while left:
        alive = [(flags, n) for flags, n in patterns if not any(flags[i] for i in out)]
        out.append(max(left, key=lambda i: (sum(n for flags, n in alive if flags[i]) / cost[i], -i)))
        left.remove(out[-1])
    return out


def verdict(rules: list[Rule]) -> Column:
    """True if no rule rejects. Rules are tried in this order, and those after one that rejects are not evaluated."""
    out = F.when(F.lit(False), F.lit(False))
    for r in rules:
        out = out.when(F.coalesce(r.rejects, F.lit(False)), F.lit(False))
    return out.otherwise(F.lit(True))


def quality_cascade(
    docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = 500, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Judges every row by rules that are tried in turn until one rejects.

    Costs and selectivities come from sample_rows rows, as the scan gives them, written once (a documented bound; they only
    set the order of the rules). The cascade is one CASE expression: a rule, and a measure that only it uses and the result does
    not show (shouts, letters, bullets, broken lines), is evaluated only for rows that the rules before leave. Returns doc_id, the measures that
    describe a text, and kept. Null and empty texts have all measures 0 and are rejected as too short. Every row is
    judged on its own, so ties and repeated rows agree; other columns are ignored.
    """
    rules = rules or default_rules()
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__in"))
    sample = materialise(slim.select("__in").limit(sample_rows))
    kept = verdict(order_by_rejection_per_cost(sample, rules, "__in"))
    return text_measures(slim, "__in").select("doc_id", *MEASURES, kept.alias("kept"))
