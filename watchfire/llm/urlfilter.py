"""URL lists: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from watchfire.llm.common import ascii_lower

#: 64-bit words in a block: 512 bits, one cache line.
BLOCK_WORDS = 8
#: Bits that a key sets in its block.
KEY_BITS = 6


def url_parts(url):
    """(host, path) columns: the host is lower-cased in A-Z and holds whatever lies between :// and / ? # or the end."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def parse_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """A list DataFrame (rule, host, path, verdict) from pairs like ('block', 'example.com/de/')."""
    rows = [(r, r.partition("/")[0].lower(), "/" + r.partition("/")[2], v) for v, r in rules]
    return spark.createDataFrame(rows, "rule string, host string, path string, verdict string")


def _key(host, path):
    return F.concat(host, F.lit("\x00"), path)


#: Blocks of the filter that one task makes: 256 kB.
RANGE = 4096


def bloom_filter(listed: DataFrame, bits_per_key: int, max_bytes: int) -> np.ndarray:
    """The filter as an array of (blocks, BLOCK_WORDS) words, made on executors in ranges of blocks. Its size is set
    from the number of keys and never exceeds max_bytes, of which the driver collects a row for each range: beyond that only
    the share of false hits rises, which the exact join removes."""
    n = max(1, listed.count())
    blocks = max(1, min(-(-n * bits_per_key // (64 * BLOCK_WORDS)), max_bytes // (8 * BLOCK_WORDS)))
    key = _key(F.col("host"), F.col("path"))
    hashed = listed.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.xxhash64(key, F.lit(1)).alias("bits"))
    schema = pa.schema([("part", pa.int64()), ("words", pa.binary())])

    def fill(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        words = np.zeros((min(RANGE, blocks - part * RANGE), BLOCK_WORDS), np.uint64)
        block = t["block"].to_numpy() - part * RANGE
        for word, bit in _places(t["bits"].to_numpy()):
            np.bitwise_or.at(words, (block, word), np.uint64(1) << bit)
        return pa.table([[part], [words.tobytes()]], schema=schema)

    parts = hashed.withColumn("part", F.expr(f"block DIV {RANGE}")).groupBy("part").applyInArrow(fill, "part long, words binary").collect()
    out = np.zeros((blocks, BLOCK_WORDS), np.uint64)
    for part, words in parts:
        out[part * RANGE : (part + 1) * RANGE] = np.frombuffer(words, np.uint64).reshape(-1, BLOCK_WORDS)
    return out


def _places(hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bit within it) of each of the bits that keys set in their block, by nine bits of the hash."""
    u = hashes.view(np.uint64)
    for i in range(KEY_BITS):
        at = (u >> np.uint64(9 * i)) & np.uint64(64 * BLOCK_WORDS - 1)
        yield (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)


def judge_urls(
    pages: DataFrame,
    listed: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    bits_per_key: int = 12,
    max_filter_bytes: int = 64 << 20,
) -> DataFrame:
    """Judges every row's url by the listed (rule, host, path, verdict).

    An entry fits its host and all subdomains if the url's path starts with the entry's path; of several the longest
    rule wins (then the longer host, then the smaller text). For each url the host suffixes and path prefixes of the
    lengths that the list has are hashed; the Bloom filter drops nearly all that are not listed, and an equi-join on
    the full key removes the rest. Neither side is cut: the join is broadcast only if Spark finds it small.

    Returns page_id, host, path, rule, verdict. A url that is null, empty or has no :// has an empty host and path
    and the default verdict, as has every url that no entry fits. Repeated rows are each judged; an empty list gives
    the default for all. An empty entry host fits nothing. Further columns of pages are ignored.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col(url_col))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    listed = listed.where(F.length("host") > 0).select("rule", "host", "path", "verdict")
    # Which lengths occur: labels of a host (127 at most) times characters of a path, not entries.
    shapes = listed.select(F.size(F.split("host", r"\.")).alias("k"), F.length("path").alias("n")).distinct().collect()
    if not shapes:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    filt = spark.sparkContext.broadcast(bloom_filter(listed, bits_per_key, max_filter_bytes))

    @F.pandas_udf(BooleanType())
    def possible(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        words = filt.value
        for h, h2 in batches:
            block = np.mod(h.to_numpy(np.int64), len(words))
            hit = np.ones(len(block), dtype=bool)
            for word, bit in _places(h2.to_numpy(np.int64)):
                hit &= (words[block, word] >> bit) & np.uint64(1) > 0
            yield pd.Series(hit)

    labels = F.split("host", r"\.")
    # All shapes as one constant, whose size the list sets: an expression for each would not do for a long one.
    every = F.from_json(F.lit(json.dumps(sorted(tuple(r) for r in shapes))), "array<array<int>>")
    fits = F.filter(every, lambda s: (F.size(labels) >= s[0]) & (F.length("path") >= s[1]))
    keys = F.transform(
        fits,
        lambda s: F.struct(
            F.array_join(F.slice(labels, F.size(labels) - s[0] + 1, s[0]), ".").alias("key_host"),
            F.col("path").substr(F.lit(1), s[1]).alias("key_path"),
        ),
    )
    key = _key(F.col("key.key_host"), F.col("key.key_path"))
    hits = (
        urls.where(F.length("host") > 0)
        .select("host", "path")
        .distinct()
        .select("host", "path", F.explode(keys).alias("key"))
        .where(possible(F.xxhash64(key), F.xxhash64(key, F.lit(1))))
        .select("host", "path", "key.key_host", "key.key_path")
    )
    entries = listed.select("rule", "verdict", F.col("host").alias("key_host"), F.col("path").alias("key_path"))
    best = (
        hits.join(entries, ["key_host", "key_path"])
        .groupBy("host", "path")
        .agg(
            F.min_by(
                F.struct("rule", "verdict"), F.struct(-F.length("rule"), -F.length("key_host"), F.col("rule"), F.col("verdict"))
            ).alias("best")
        )
        .select("host", "path", "best.rule", "best.verdict")
    )
    # Urls without a host, maybe very many, have no match; a number of their own deals them over all tasks.
    apart = F.when(F.length("host") == 0, F.pmod(F.xxhash64("page_id"), F.lit(1 << 16))).otherwise(F.lit(0))
    dealt = urls.withColumn("__apart", apart).join(best.withColumn("__apart", F.lit(0).cast("long")), ["host", "path", "__apart"], "left")
    return dealt.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
