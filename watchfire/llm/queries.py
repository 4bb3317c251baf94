"""The numbered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.llm import alignment, exact, minhash, packing, quality, resample, rules, secrets, sharding, substring, toxicity, urlfilter
from watchfire.llm.common import table
from watchfire.llm.decontam import contaminated

#: The tokenizer file of the packing query, by its name in the public collection.
TOKENIZER = "byte_bpe_50k.json"
#: The piece model that the alignment query holds against it.
PIECES = "piece_bpe_32k.model"
#: (verdict, rule) of the URL query.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secrets.count_of(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(secrets.BASE)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(secrets.span_text(F.col("spans"), 0, len(secrets.BASE) - 1), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans")).alias("spans"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), urlfilter.parse_rules(spark, URL_RULES))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_words")
    return rules.quality_cascade(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((n < 10) | (100 * F.col("n_repeat_words") > 20 * n)).alias("base_failed"), "kept",
    )


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_toxicity, op3_substring_dedup, op4_secret_scan, op5_quality, op6_url_filter, op7_minhash,
        op8_decontamination, op9_sharding, op10_quality_rules, op11_resample, op12_alignment, op13_exact_dedup,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES = {
    "op3_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        v AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
              FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) > 12)),
        first AS (SELECT s, min(doc_id) AS f FROM v GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM v JOIN first USING (s) WHERE f < doc_id),
        gone_list AS (SELECT doc_id, list(p) AS g FROM gone GROUP BY doc_id),
        k AS (SELECT doc_id, len(w) AS n_words, coalesce(len(g), 0) AS n_removed,
                     CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, generate_series(1, len(w))), lambda x: NOT list_contains(g, x[2])), lambda x: x[1]) END AS kept
              FROM d LEFT JOIN gone_list USING (doc_id))
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
               sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k""",
    "op6_url_filter": rf"""
        WITH r(rule, rh, rp, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
            ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        a AS (SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS n FROM a),
        m AS (SELECT n, r.rule, r.verdict, row_number() OVER (PARTITION BY n ORDER BY length(r.rule) DESC) AS k
              FROM p JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) USING (n)""",
    "op7_minhash": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g
              FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * n_both >= 85 * (p.n + q.n - n_both)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        reach(a, b) AS (SELECT x, y FROM e UNION SELECT reach.a, e.y FROM reach JOIN e ON reach.b = e.x),
        c AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(c, doc_id)) AS component_id,
               doc_id = least(doc_id, coalesce(c, doc_id)) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op9_sharding": """
        WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS crc_table FROM steps WHERE k = 8),
        t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        h AS (SELECT DISTINCT t, hex(encode(t)) AS h FROM t),
        c AS (SELECT t, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS INTEGER), 2) AS BIGINT)),
                     lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1]), 4294967295)) AS text_crc32 FROM h, crc),
        s AS (SELECT doc_id, CAST(strlen(t) + 1 AS BIGINT) AS size, text_crc32 FROM t JOIN c USING (t)),
        w AS (SELECT *, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM s),
        p AS (SELECT doc_id, size, text_crc32, CAST(((2 * upto - size) * 16) // (2 * total) AS INTEGER) AS shard FROM w)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op10_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
        v AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s
              FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) > 4)),
        twice AS (SELECT doc_id, s FROM v GROUP BY ALL HAVING count(*) > 1),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS p FROM v JOIN twice USING (doc_id, s)) GROUP BY doc_id),
        m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                     CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                     coalesce(rep.n, 0) AS n_repeat_words,
                     (length(t) - length(replace(t, '!!', ''))) // 2 AS n_shouts, length(t) AS n_chars,
                     length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]+', '', 'g')) AS n_letters,
                     len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*\x{{2022}}]'))) AS n_bullets,
                     len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_broken
              FROM l LEFT JOIN rep USING (doc_id))
        SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
               NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR 2 * n_dup_lines > n_lines
                    OR 10 * n_shouts > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
                    OR 100 * n_letters < 30 * n_chars OR (n_lines > 3 AND (10 * n_bullets > 9 * n_lines OR 10 * n_broken > 7 * n_lines))) AS kept FROM m""",
    "op11_resample": rf"""
        WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS crc_table FROM steps WHERE k = 8),
        texts AS (SELECT 'doc' AS side, doc_id, text FROM documents UNION ALL SELECT 'goal', NULL, text FROM benchmark),
        lists AS (SELECT side, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM texts),
        words AS (SELECT side, doc_id, unnest(ws) AS w FROM lists),
        vocabulary AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM words)),
        hashed AS (SELECT w, xor(4294967295, list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, CAST(i AS INTEGER), 2) AS BIGINT)),
                         lambda c, b: xor(c >> 8, crc_table[xor(c & 255, b) + 1]), 4294967295)) % 10000 AS bucket FROM vocabulary, crc),
        totals AS (SELECT bucket, count(*) FILTER (side = 'doc') AS s, count(*) FILTER (side = 'goal') AS t FROM words JOIN hashed USING (w) GROUP BY bucket),
        sums AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM totals),
        gains AS (SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (all_s + 10000) / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS gain FROM totals, sums),
        weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM words JOIN hashed USING (w) JOIN gains USING (bucket) WHERE side = 'doc' GROUP BY doc_id),
        noisy AS (SELECT doc_id, len(ws) AS n, CAST('0x' || sha256('2024:' || doc_id)[1:8] AS BIGINT) AS h FROM lists WHERE side = 'doc'),
        scored AS (SELECT doc_id, n, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score
                   FROM noisy LEFT JOIN weights USING (doc_id)),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n >= 20)
        SELECT doc_id, CAST(n AS BIGINT) AS n_features, weight, score,
               CASE WHEN rank <= (SELECT count(*) FROM ranked) * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (doc_id)""",
    "op13_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
}
