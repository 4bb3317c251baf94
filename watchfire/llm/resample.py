"""Importance resampling towards a target distribution, by hashed n-gram features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchfire.llm.common import materialise, shuffle_width, slices, unused

#: Every ASCII byte that is no letter or digit becomes a space, capitals become small; other bytes stay.
_PLAIN = bytes(b if b > 0x7F or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: What a task writes: a row for each document (kind 0), and its totals of the buckets (kind 1, doc_id null).
_COUNTS = "kind int, doc_id long, n_words long, n_features long, buckets array<int>, counts array<long>"
_ARROW = pa.schema([
    ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()),
    ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])


def _gram_sql(least: int, most: int, n_buckets: int) -> str:
    """(r, bucket, n) of the texts in the view `part` (r, t, own): bucket -1 has the number of words. own: so many words
    of t are counted, those after them only complete the grams that begin before; null: all."""
    grams = []
    for n in range(least, most + 1):
        words = " || ' ' || ".join(["w", *(f"lead(w, {k}) OVER nexts" for k in range(1, n))])
        grams.append(f"SELECT r, i, own, {words} AS g FROM words" + (" WINDOW nexts AS (PARTITION BY r, piece ORDER BY i)" if n > 1 else ""))
    return f"""
        WITH split AS (SELECT r, piece, own, unnest(s) AS w, generate_subscripts(s, 1) AS pos FROM (SELECT r, piece, own, string_split(t, ' ') AS s FROM part)),
        words AS (SELECT r, piece, own, w, {"row_number() OVER (PARTITION BY r, piece ORDER BY pos)" if most > 1 else "0"} AS i FROM split WHERE w <> ''),
        grams AS ({" UNION ALL ".join(grams)}),
        counted AS (SELECT r, g, count(*) AS n FROM grams WHERE g IS NOT NULL AND (own IS NULL OR i <= own) GROUP BY r, g)
        SELECT r, CAST(crc32_of(g) % {int(n_buckets)} AS INTEGER) AS bucket, CAST(sum(n) AS BIGINT) AS n FROM counted GROUP BY 1, 2
        UNION ALL SELECT r, -1, count(*) FROM words WHERE own IS NULL OR i <= own GROUP BY r
        ORDER BY 1, 2"""


def _pieces(plain: bytes, most: int, context: int) -> Iterator[tuple[bytes, int | None]]:
    """The text in pieces of about most bytes, cut between words; each brings the next `context` words with it, and says
    how many words are its own."""
    at = 0
    while len(plain) - at > most and (cut := plain.find(b" ", at + most)) >= 0:
        if context:
            own, end = len(plain[at:cut].split()), cut
            for _ in range(context):
                while end < len(plain) and plain[end] == 0x20:
                    end += 1
                end = stop if (stop := plain.find(b" ", end)) >= 0 else len(plain)
            yield plain[at:end], own
        else:
            yield plain[at:cut], None
        at = cut
    yield plain[at:], None


def _parts(texts: list[bytes | None], most: int, context: int) -> Iterator[pa.Table]:
    """The texts as tables (r: position, piece, t, own) of about most bytes each."""
    rows, size = [], 0
    for r, text in enumerate(texts):
        for k, (piece, own) in enumerate(_pieces((text or b"").translate(_PLAIN), most, context)):
            rows.append((r, k, piece, own))
            size += len(piece)
            if size >= most:
                yield _part(rows)
                rows, size = [], 0
    if rows:
        yield _part(rows)


def _part(rows: list[tuple]) -> pa.Table:
    r, k, t, own = zip(*rows)
    return pa.table({"r": pa.array(r, pa.int32()), "piece": pa.array(k, pa.int32()), "t": pa.array(t, pa.binary()).cast(pa.string()), "own": pa.array(own, pa.int64())})


def _crc32(column: pa.ChunkedArray) -> pa.Array:
    return pa.array([zlib.crc32(g) for g in column.cast(pa.binary()).to_pylist()], pa.int64())


def bucket_counts(docs: DataFrame, ngrams: tuple[int, int] = (1, 1), n_buckets: int = 10_000, part_bytes: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's words, features and buckets with counts (kind 0), and each task's totals of all buckets (kind 1),
    written as Parquet in the shared folder.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z made small; features are the runs of
    ngrams[0] to ngrams[1] consecutive words, joined by a space. A task hands its texts in parts of part_bytes to DuckDB,
    which splits, unnests, joins neighbours by a window and counts; longer texts go in pieces whose counts are added.
    So a task holds one part, and for each document and for its totals at most n_buckets counts.
    """
    least, most = ngrams
    if not 1 <= least <= most:
        raise ValueError("ngrams must be 1 or more, the least first")
    sql = _gram_sql(least, most, n_buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as con:
            con.create_function("crc32_of", _crc32, ["VARCHAR"], "BIGINT", type="arrow")
            totals = np.zeros(n_buckets, np.int64)
            for batch in slices(batches):
                got = []
                for part in _parts(batch.column("text").to_pylist(), part_bytes, most - 1):
                    con.register("part", part)
                    found = con.execute(sql).fetchnumpy()
                    con.unregister("part")
                    got.append([np.asarray(found[c], np.int64) for c in ("r", "bucket", "n")])
                r, bucket, n = (np.concatenate(x) for x in zip(*got))
                key, where = np.unique(r * (n_buckets + 1) + bucket + 1, return_inverse=True)
                n = np.bincount(where, n, len(key)).astype(np.int64)  # pieces of a text come together
                r, bucket = key // (n_buckets + 1), key % (n_buckets + 1) - 1
                total = bucket < 0
                n_words = np.zeros(batch.num_rows, np.int64)
                n_words[r[total]] = n[total]
                r, bucket, n = r[~total], bucket[~total], n[~total]
                np.add.at(totals, bucket, n)
                n_features = np.bincount(r, n, batch.num_rows).astype(np.int64)
                offsets = pa.array(np.searchsorted(r, np.arange(batch.num_rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("doc_id"), pa.array(n_words), pa.array(n_features),
                    pa.ListArray.from_arrays(offsets, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(n)),
                ], schema=_ARROW)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_pylist([{"kind": 1, "buckets": used.tolist(), "counts": totals[used].tolist()}], schema=_ARROW)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return materialise(slim.mapInArrow(count, _COUNTS))


def _totals(counts: DataFrame, name: str) -> DataFrame:
    """bucket and its count over all documents: one row a bucket and task meets before the sum."""
    return counts.where("kind = 1").select(F.explode(F.arrays_zip("buckets", "counts")).alias("x")).groupBy(F.col("x.buckets").alias("bucket")).agg(F.sum("x.counts").alias(name))


def gains(source: DataFrame, target: DataFrame, n_buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for every bucket: floor(1000 ln) of the smoothed target share over the smoothed source share.
    source, target: of bucket_counts(). Holds n_buckets rows whatever the size of the inputs."""
    buckets = source.sparkSession.range(n_buckets).select(F.col("id").cast("int").alias("bucket"))
    both = buckets.join(_totals(source, "s"), "bucket", "left").join(_totals(target, "t"), "bucket", "left").na.fill(0, ["s", "t"])
    everything = F.broadcast(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))
    s, t, all_s, all_t = (F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t"))
    ratio = (t + 1) * (all_s + n_buckets) / ((s + 1) * (all_t + n_buckets))
    return both.join(everything).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, ngrams: tuple[int, int] = (1, 1), n_buckets: int = 10_000,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Draws percent of the documents of min_words words or more, without replacement, in proportion to how much likelier
    their features are in the target's texts than in all documents' texts (Gumbel top-k; noise from seed and id only).

    One pass of DuckDB in the tasks counts the buckets of every text (see bucket_counts) and spills them as Parquet. Spark
    adds the tasks' totals and makes the gains, n_buckets numbers that go to all tasks; weights are sums over the spilled
    counts, so texts are read once. The draw is a range-partitioned sort with prefix sums of partition sizes.

    Returns one row for each input row: doc_id, n_words, n_features, weight, score, rank (1 for the highest score of those
    drawn, ties to the smaller id; null if not drawn). Null and empty texts have no words, features or weight. Null ids hash
    as the empty string and come first in ties; rows that share an id and a score are ranked in any order, each with a
    rank of its own. An empty target has gains of a uniform distribution; an empty table gives no rows. Other columns of
    either input are ignored.
    """
    counts = bucket_counts(docs, ngrams, n_buckets, id_col=id_col, text_col=text_col)
    goal = bucket_counts(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text")), ngrams, n_buckets)
    gain = np.zeros(n_buckets, np.int64)
    for bucket, g in gains(counts, goal, n_buckets).collect():  # n_buckets rows
        gain[bucket] = g

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buckets, n = b.column("buckets"), b.column("counts")
            offsets = np.asarray(buckets.offsets)
            sums = np.concatenate(([0], np.cumsum(gain[np.asarray(buckets.values)] * np.asarray(n.values))))
            weight = pa.array(sums[offsets[1:]] - sums[offsets[:-1]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_features"), weight], names=["doc_id", "n_words", "n_features", "weight"])

    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = (
        counts.where("kind = 0").select("doc_id", "n_words", "n_features", "buckets", "counts")
        .mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
        .withColumn("score", (F.col("weight") + gumbel).cast("long"))
    )
    return _ranked(scored, F.col("n_words") >= min_words, percent)


def _ranked(scored: DataFrame, eligible, percent: int) -> DataFrame:
    """scored with rank: 1, 2, 3 ... for the percent of eligible rows with the highest scores."""
    spark = scored.sparkSession
    part, before, tie = (unused(scored.columns, c) for c in ("part", "before", "tie"))
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc(tie)]
    # Written once: which partition holds a row is then a fact, not the result of sampling that a rerun may change.
    dealt = materialise(
        scored.withColumns({tie: F.xxhash64(F.monotonically_increasing_id()), "rank": F.when(eligible, F.lit(1))})
        .repartitionByRange(max(2, shuffle_width(spark)), F.asc_nulls_last("rank"), *order)
        .withColumn(part, F.spark_partition_id())
    )
    sizes = dealt.groupBy(part).agg(F.count("rank").alias("n")).orderBy(part).collect()  # a row a partition
    wanted = sum(n for _, n in sizes) * percent // 100
    starts, at = [], 0
    for p, n in sizes:
        if n and at < wanted:
            starts.append((p, at))
        at += n
    starts = F.broadcast(spark.createDataFrame(starts, f"{part} int, {before} long"))
    # Only partitions that hold drawn rows are sorted.
    nth = F.row_number().over(Window.partitionBy(part).orderBy(*order)) + F.col(before)
    within = dealt.where("rank IS NOT NULL").join(starts, part).withColumn("rank", nth).withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")).cast("long"))
    rest = dealt.join(starts.select(part), part, "left_anti").unionByName(dealt.where("rank IS NULL").join(starts.select(part), part, "left_semi"))
    return within.drop(part, before, tie).unionByName(rest.withColumn("rank", F.lit(None).cast("long")).drop(part, tie))
