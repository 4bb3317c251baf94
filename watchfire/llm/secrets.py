"""Secrets in texts: fixed patterns and a battery of randomness tests, in built-in functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern, least characters, group that the limit is on). Fixed values, in the order of kinds.
BASE = {
    "assign": (
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        12,
        1,
    ),
    "access": (r"AKIA[A-Z0-9]+", 18, 0),
    "hex": (r"[0-9a-f]+", 16, 0),
}
#: What the battery looks at: long runs of characters of the usual encodings.
LEAST_TOKEN = 20


def _run(chars: str) -> str:
    """Runs of LEAST_TOKEN or more of chars; '=' counts where it ends the run (padding), and cuts it elsewhere."""
    padded = f"(?=[{chars}]{{16,}}+=+(?![={chars}]))[={chars}]{{{LEAST_TOKEN},}}"
    return f"{padded}|[{chars}]{{{LEAST_TOKEN},}}"


CANDIDATE = _run("A-Za-z0-9+/_-")
#: Pieces of a candidate: of base64url between '+' and '/', of base64 between '_' and '-', between all four.
PIECES = (_run("A-Za-z0-9_-"), _run("A-Za-z0-9+/"), _run("A-Za-z0-9"))
#: name -> (alphabet, pattern that a whole token fits). The first that fits is the inferred encoding.
ENCODINGS = {
    "decimal": ("0123456789", "^[0-9]+$"),
    "hex_lower": ("0123456789abcdef", "^[0-9a-f]+$"),
    "hex_upper": ("0123456789ABCDEF", "^[0-9A-F]+$"),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^[A-Z2-7]+$"),
    "base36": ("0123456789abcdefghijklmnopqrstuvwxyz", "^[0-9a-z]+$"),
    "base62": ("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "^[0-9A-Za-z]+$"),
    "base64url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", "^[A-Za-z0-9_-]+$"),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "^[A-Za-z0-9+/]+$"),
}
#: Lengths from which the strata of the false-discovery control begin.
STRATA = (0, 32, 64, 128)
#: log evidence is counted up to here, in steps of one; doubt up to here.
TOP_EVIDENCE = 200
TOP_DOUBT = 40
#: Character classes of ordinary text and their sizes within CANDIDATE's alphabet; the rest of a text counts as other.
CLASSES = {"digit": ("0-9", 10), "upper": ("A-Z", 26), "other": ("a-z+/_=-", 31)}


def _spans(text: Column, pattern: str, group: int, may: Column) -> Column:
    """array<struct<start, end, value>> of a pattern's leftmost non-overlapping matches: the pieces between matches
    and the matches alternate, so a start is the sum of the lengths before it. Empty where nothing matches. may: a
    cheap condition that every text with a match fulfils."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), whole.alias("m"), inner.alias("v")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    folded = F.aggregate(
        parts,
        start,
        lambda acc, x: F.struct(
            (acc["at"] + x["gap"] + F.coalesce(F.length(x["m"]), F.lit(0))).alias("at"),
            F.when(x["m"].isNull(), acc["out"])
            .otherwise(
                F.concat(
                    acc["out"],
                    F.array(
                        F.struct(
                            (acc["at"] + x["gap"]).alias("start"),
                            (acc["at"] + x["gap"] + F.length(x["m"])).alias("end"),
                            x["v"].alias("value"),
                        )
                    ),
                )
            )
            .alias("out"),
        ),
    )["out"]
    return F.when(may & text.rlike(pattern), folded).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array of spans that are long enough."""
    may = {
        "assign": F.contains(text, F.lit(":")) | F.contains(text, F.lit("=")),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": F.lit(True),
    }
    out = {}
    for kind, (pattern, least, group) in BASE.items():
        # A run's short matches hold no long one, so its limit may stand in the pattern.
        p = pattern if group else pattern[:-1] + f"{{{least - (4 if kind == 'access' else 0)},}}"
        spans = _spans(text, p, group, may[kind])
        out[kind] = F.filter(spans, _long_enough(least)) if group else spans
    return out


def _long_enough(least: int):
    return lambda s: F.length(s["value"]) >= least


def _of_kind(order: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"))


def count_of(spans: Column, order: int) -> Column:
    """Spans of the kind of that order."""
    return F.size(F.filter(spans, lambda s: s["ord"] == order)).cast("long")


def candidate_tokens(text: Column) -> Column:
    """All matches of CANDIDATE: they hold no blank, so only words as long need the search."""
    long = F.filter(F.split(text, " "), lambda w: F.length(w) >= LEAST_TOKEN)
    return F.flatten(F.transform(long, lambda w: F.regexp_extract_all(w, F.lit(CANDIDATE), F.lit(0))))


def tested_tokens(text: Column) -> Column:
    """All candidates and, after each, its pieces that are not the whole of it."""

    def with_pieces(token: Column) -> Column:
        pieces = [F.regexp_extract_all(token, F.lit(p), F.lit(0)) for p in PIECES]
        return F.when(token.rlike("[+/_-]"), F.array_distinct(F.concat(F.array(token), *pieces))).otherwise(F.array(token))

    return F.flatten(F.transform(candidate_tokens(text), with_pieces))


def _upper_tail(z: Column) -> Column:
    """Of the standard normal distribution, by a logistic form (absolute error under 0.0002)."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070565992 * z * z * z)))


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * _upper_tail(F.abs(z)))


def _let(value: Column, body):
    """body(value) with value computed once: a lambda over an array of one element."""
    return F.transform(F.array(value), body)[0]


def _stripped(token: Column) -> Column:
    return F.regexp_replace(token, "=+$", "")


def _alphabet(bare: Column) -> Column:
    """Of the inferred encoding; null where none fits."""
    out = F.when(F.lit(False), F.lit(""))
    for alphabet, pattern in ENCODINGS.values():
        out = out.when(bare.rlike(pattern), F.lit(alphabet))
    return out


def randomness_p(token: Column) -> Column:
    """The token's p-value as uniform independent characters of its encoding: the least of three p-values times 3.

    chi-squared: the counts of the characters, by Wilson and Hilferty's cube root; runs: of characters in the upper or
    lower half of the alphabet, two-sided; serial correlation: of neighbours' places in the alphabet, two-sided. 0
    where no encoding fits or fewer than 16 characters are left without padding.
    """
    seen = F.struct(_stripped(token).alias("t"), _alphabet(_stripped(token)).alias("a"))

    def with_places(x: Column) -> Column:
        chars = F.filter(F.split(x["t"], ""), lambda c: c != "")
        return F.struct(
            F.transform(chars, lambda c: F.call_function("locate", c, x["a"])).alias("at"),
            # At most as many different ones as the alphabet has, however long the token.
            F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda n, c: n + F.pow((F.length(x["t"]) - F.length(F.replace(x["t"], c, F.lit("")))).cast("double"), F.lit(2.0))).alias("squares"),
            F.length(x["a"]).cast("double").alias("size"),
            F.length(x["t"]).cast("double").alias("n"),
        )

    def with_sums(x: Column) -> Column:
        """The sums that lambdas below use: within a lambda they would be made again for every character."""
        upper = F.aggregate(x["at"], F.lit(0.0), lambda a, i: a + (i > x["size"] / 2).cast("double"))
        mean = F.aggregate(x["at"], F.lit(0.0), lambda a, i: a + i) / x["n"]
        return F.struct(x["at"].alias("at"), x["squares"].alias("squares"), x["size"].alias("size"), x["n"].alias("n"), upper.alias("upper"), mean.alias("mean"))

    def tests(x: Column) -> Column:
        at, n, size, n1, mean = x["at"], x["n"], x["size"], x["upper"], x["mean"]
        df = size - 1
        chi = F.greatest(x["squares"] * size / n - n, F.lit(1e-9))
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        n0 = n - n1
        places = F.sequence(F.lit(1), F.size(at) - 1)
        runs = F.aggregate(places, F.lit(1.0), lambda a, i: a + ((at[i] > size / 2) != (at[i - 1] > size / 2)).cast("double"))
        mu = 2 * n1 * n0 / n + 1
        var = (mu - 1) * (mu - 2) / (n - 1)
        p_runs = F.when(var > 0, _two_sided((runs - mu) / F.sqrt(var))).otherwise(F.lit(0.0))
        spread = F.aggregate(at, F.lit(0.0), lambda a, i: a + (i - mean) * (i - mean))
        joint = F.aggregate(places, F.lit(0.0), lambda a, i: a + (at[i] - mean) * (at[i - 1] - mean))
        p_serial = F.when(spread > 0, _two_sided(joint / spread * F.sqrt(n))).otherwise(F.lit(0.0))
        return F.least(F.lit(1.0), 3 * F.least(_upper_tail(z_chi), p_runs, p_serial))

    tested = _let(seen, lambda x: F.when(x["a"].isNotNull() & (F.length(x["t"]) >= 16), _let(_let(with_places(x), with_sums), tests)))
    return F.coalesce(tested, F.lit(0.0))


def _evidence(token: Column, ordinary: dict[str, float]) -> Column:
    """log of how much likelier the token is as uniform characters of its encoding than as ordinary characters."""
    bare = _stripped(token)
    size = F.lit(64.0)
    for alphabet, pattern in reversed(list(ENCODINGS.values())):
        size = F.when(bare.rlike(pattern), F.lit(float(len(alphabet)))).otherwise(size)
    out = -F.length(bare) * F.log(size)
    for name, (chars, n) in CLASSES.items():
        count = F.length(bare) - F.length(F.regexp_replace(bare, f"[{chars}]", ""))
        out = out - count * math.log(ordinary[name] / n)
    return out


def _stratum(token: Column) -> Column:
    out = F.lit(0)
    for i, least in enumerate(STRATA[1:], 1):
        out = F.when(F.length(token) >= least, i).otherwise(out)
    return out


def ordinary_classes(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The share of each character class among the characters of all texts (one added to each count)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept = {k: F.sum(F.length(F.regexp_replace(text, f"[^{CLASSES[k][0]}]+", ""))) for k in ("digit", "upper")}
    row = docs.agg(F.sum(F.length(text)).alias("all"), *[v.alias(k) for k, v in kept.items()]).first()
    counts = {k: (row[k] or 0) + 1 for k in kept}
    counts["other"] = (row["all"] or 0) + 3 - sum(counts.values())
    return {k: v / sum(counts.values()) for k, v in counts.items()}


def _doubt(p: Column) -> Column:
    """How much a battery's p-value speaks against uniformity: whole steps of a quarter of a decimal place."""
    return F.least(F.lit(TOP_DOUBT), F.floor(-4 * F.log10(F.greatest(p, F.lit(1e-12))))).cast("int")


def control(counts: dict[tuple[int, int, int], int], rate: float, missed: float) -> dict[int, tuple[int, int]]:
    """stratum -> (doubt from which a token is refuted as random, least log evidence of a discovery), from the number of
    tokens of each (stratum, doubt, evidence). Two controls of false discoveries, each within a stratum of lengths:

    Benjamini and Hochberg's on the battery's p-values says which tokens are not random, so that among those at most the
    share `missed` are; the doubt's step stands for its largest p-value, so this is never looser. Of what is left,
    evidence against ordinary text is an e-value, so the e-value form of the rule holds whatever the dependence: with n
    tokens, take those of evidence e or more if at least n / (rate * exp(e)) have it. No entry: no discoveries.
    """
    out = {}
    for stratum in {k[0] for k in counts}:
        own = {k[1:]: n for k, n in counts.items() if k[0] == stratum}
        total = sum(own.values())
        refuted = [d for d in range(TOP_DOUBT + 1) if total * 10 ** (-d / 4) <= missed * sum(n for (x, _), n in own.items() if x >= d)]
        least_doubt = min(refuted, default=TOP_DOUBT + 1)
        random = {e: sum(n for (d, x), n in own.items() if d < least_doubt and x == e) for e in range(TOP_EVIDENCE + 1)}
        found = [e for e in range(TOP_EVIDENCE + 1) if total <= rate * math.exp(e) * sum(n for x, n in random.items() if x >= e)]
        if found:
            out[stratum] = (least_doubt, min(found))
    return out


def discovery_limits(tokens: DataFrame, rate: float, missed: float) -> dict[int, tuple[int, int]]:
    """control() of all tokens (stratum, doubt, evidence): the counts are at most strata times steps of both."""
    step = F.least(F.greatest(F.floor("evidence"), F.lit(-1)), F.lit(TOP_EVIDENCE)).cast("int")
    rows = tokens.groupBy("stratum", "doubt", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
    return control({(r[0], r[1], r[2]): r[3] for r in rows}, rate, missed)


def _secret_spans(docs: DataFrame, text_col: str, rate: float, missed: float) -> Column:
    """The column that find_secrets adds. What is ordinary, and the limits, are measured on docs here."""
    none = "array<struct<start:int,ord:int,end:int>>"
    text = F.coalesce(F.col(text_col), F.lit(""))
    ordinary = ordinary_classes(docs, text_col)
    listed = docs.select(F.explode(tested_tokens(text)).alias("token"))
    limits = discovery_limits(
        listed.select(
            _stratum(F.col("token")).alias("stratum"),
            _evidence(F.col("token"), ordinary).alias("evidence"),
            _doubt(randomness_p(F.col("token"))).alias("doubt"),
        ),
        rate,
        missed,
    )
    base = base_spans(text)
    known = F.concat(*[F.transform(base[k], _of_kind(i)) for i, k in enumerate(BASE)])

    def discovered(token: Column) -> Column:
        out, least_doubt = F.lit(False), F.lit(0)
        for stratum, (doubt, least) in limits.items():
            out = F.when(_stratum(token) == stratum, F.floor(_evidence(token, ordinary)) >= least).otherwise(out)
            least_doubt = F.when(_stratum(token) == stratum, doubt).otherwise(least_doubt)
        return out & (_doubt(randomness_p(token)) < least_doubt)

    found = F.filter(F.array_distinct(tested_tokens(text)), discovered) if limits else F.array().cast("array<string>")

    def added(found: Column, known: Column) -> Column:
        def usable(s: Column) -> Column:
            return F.array_contains(found, s["value"]) & ~F.exists(known, lambda k: (k["start"] < s["end"]) & (s["start"] < k["end"]))

        def placed(token: Column, pattern: str) -> Column:
            moved = F.transform(
                _spans(token["value"], pattern, 0, F.lit(True)),
                lambda s: F.struct((token["start"] + s["start"]).alias("start"), (token["start"] + s["end"]).alias("end"), s["value"].alias("value")),
            )
            return F.filter(moved, usable)

        def longest(spans: Column) -> Column:
            inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (s != o)
            return F.filter(spans, lambda s: ~F.exists(spans, lambda o: inside(s, o)))

        def pieces(token: Column) -> Column:
            return _let(F.array_distinct(F.concat(*[placed(token, p) for p in PIECES])), longest)

        tokens = _spans(text, CANDIDATE, 0, F.size(found) > 0)
        spans = F.flatten(F.transform(tokens, lambda t: F.when(usable(t), F.array(t)).otherwise(pieces(t))))
        return F.transform(spans, _of_kind(len(BASE)))

    def joined(known: Column) -> Column:
        return F.array_sort(F.concat(known, _let(found, lambda found: added(found, known)))).cast(none)

    return _let(known, joined)


def find_secrets(
    docs: DataFrame, text_col: str = "text", rate: float = 0.001, missed: float = 0.001
) -> DataFrame:
    """All columns of docs and `spans`: array of (start, ord, end), sorted; ord 0 assign, 1 access, 2 hex, 3 random.

    Base kinds are leftmost non-overlapping matches of fixed patterns. Kind random is a token of 20 or more characters
    ('=' only as padding at its end), or else such a piece of it between '+' and '/', between '-' and '_' or between all
    four (not within a longer one that is found; two may overlap), that shares no character with a base span and passes
    both controls of its stratum of lengths (see control()): the battery of its inferred encoding (chi-squared uniformity,
    runs, serial correlation) does not refute uniformity, at a share `missed` of refutations that are wrong, and its
    evidence against ordinary text is a discovery at `rate`. What is ordinary, and the limits, come from all
    texts of docs. Positions are code points from 0, end exclusive. Null and empty texts have no spans; equal texts in
    one table have equal spans; an empty table gives no rows. Columns of docs named like __text are not touched; one
    named spans is replaced.
    """
    return docs.withColumn("spans", _secret_spans(docs, text_col, rate, missed))


def mask_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rate: float = 0.001, missed: float = 0.001) -> DataFrame:
    """docs with every span that find_secrets gives replaced by mark (overlapping spans by one); a null text stays.

    All other columns, whatever their names, and the order of columns stay as they were.
    """
    text = F.col(text_col)

    def masked(spans: Column) -> Column:
        fold = F.aggregate(
            spans,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.when(
                s["start"] >= acc["at"],
                F.struct(s["end"].alias("at"), F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out")),
            ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
            lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))),
        )
        return F.when(F.size(spans) > 0, fold).otherwise(text)

    return docs.withColumn(text_col, _let(_secret_spans(docs, text_col, rate, missed), masked))


KINDS = (*BASE, "random")


def span_text(spans: Column, least: int = 0, most: int = len(BASE)) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            F.filter(spans, lambda s: (s["ord"] >= least) & (s["ord"] <= most)),
            lambda s: F.concat(names[s["ord"]], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        ),
        ",",
    )
