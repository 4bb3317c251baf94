import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from watchfire.llm import resample
from watchfire.llm.queries import op11_resample

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [
    (1, None, "a"), (2, "", "b"), (3, " \n\t\x00 ", "c"), (4, "one", None), (4, "one", None), (5, "x Y " * 3000, "d"), (None, "lost row here", "e"),
    (6, "  É　ß KK <|endoftext|> 's  double  spaces\u0085", "f"), (7, "y" * 5000, "g"), (8, "x Y " * 3000, "h"),
]


def features(text, least=1, most=1):
    ws = WORD.findall((text or "").translate(LOWER))
    return len(ws), Counter(zlib.crc32(" ".join(ws[i : i + n]).encode()) % 10_000 for n in range(least, most + 1) for i in range(len(ws) - n + 1))


def plain(docs, goal, percent=10, min_words=20, least=1, most=1):
    """{doc_id: (n_features, weight, score, rank)} in order of the definition."""
    counted = [(d, *features(t, least, most)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in counted:
        s.update(c)
    for x in goal:
        t.update(features(x, least, most)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out, able = [], []
    for d, n, c in counted:
        weight = sum(gain(b) * k for b, k in c.items())
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, c.total(), weight, score, None])
        if n >= min_words:
            able.append(out[-1])
    for k, row in enumerate(sorted(able, key=lambda r: (-r[3], r[0] is not None, r[0] or 0))[: len(able) * percent // 100]):
        row[4] = k + 1
    return out


def key(row):
    return [(x is not None, x or 0) for x in row]


def test_the_query_equals_the_definition(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    goal = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    got = [list(r) for r in op11_resample(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    assert sorted(got, key=key) == sorted(plain(docs, goal), key=key)


@pytest.mark.parametrize("ngrams,percent", [((1, 1), 50), ((1, 3), 100), ((2, 2), 10)])
def test_odd_rows_and_longer_runs(spark, ngrams, percent):
    df = spark.createDataFrame(ODD, "doc_id long, text string, weight string").withColumns({c: F.lit("z") for c in ("score", "rank", "kind", "bucket", "__part")})
    goal = ["x y one", None, "", "double spaces x"]
    target = spark.createDataFrame([(g, 1) for g in goal], "text string, doc_id int")
    got = [[r.doc_id, r.n_features, r.weight, r.score, r["rank"]] for r in resample.resample(df, target, percent, min_words=1, ngrams=ngrams).collect()]
    want = plain([r[:2] for r in ODD], goal, percent, 1, *ngrams)
    assert sorted(r[:4] for r in got if r[0]) == sorted(r[:4] for r in want if r[0])
    assert sorted(key(r) for r in got) == sorted(key(r) for r in want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    (row,) = resample.resample(some, none, percent=100, min_words=3).collect()
    assert (row.n_words, row["rank"]) == (3, 1)


@pytest.mark.parametrize("most", [1, 2, 4])
def test_long_texts_are_counted_in_pieces(spark, most):
    text = " ".join(f"w{i * i % 97}  w{i}" for i in range(3000))
    df = spark.createDataFrame([(1, text), (2, "short one"), (3, text[5000:])], "doc_id long, text string")
    got = {r.doc_id: r for r in resample.bucket_counts(df, (1, most), part_bytes=700).where("kind = 0").collect()}
    for d, t in ((1, text), (2, "short one"), (3, text[5000:])):
        n, c = features(t, 1, most)
        assert (got[d].n_words, dict(zip(got[d].buckets, got[d].counts))) == (n, dict(c))


def test_totals_of_tasks_add_up(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(5)
    counts = resample.bucket_counts(df)
    want = Counter()
    for r in df.collect():
        want.update(features(r.text)[1])
    assert {r.bucket: r.n for r in resample._totals(counts, "n").collect()} == dict(want)
    assert counts.where("kind = 1").count() == 5
