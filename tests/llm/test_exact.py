import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from watchfire.llm import exact
from watchfire.llm.queries import op13_exact_dedup

SF = "/root/testdata/sf0.001"
LOWER = {c: c + 32 for c in range(65, 91)}
ODD = [
    (1, None), (2, ""), (3, "Same TEXT"), (4, "same text"), (9, "SAME text"), (9, "SAME text"), (None, "same text"), (None, "only null"), (None, "only null"), (5, "É"), (6, "é"), (7, "x" * 50_000), (8, "X" * 50_000),
    (10, "tail"), (11, "tail "), (-5, "low"), (-7, "LOW"), (1 << 62, "far"), (12, "İ"), (13, "i̇"),
]


def sha(text):
    return hashlib.sha256((text or "").translate(LOWER).encode()).hexdigest()


def plain(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[sha(t)].append(d)
    top = {s: max(ids, key=lambda d: (d is not None, d or 0)) for s, ids in groups.items()}
    return [(d, top[sha(t)], len(groups[sha(t)]), sha(t)) for d, t in docs]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


def same(got, docs):
    assert order(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "text_sha256")) for r in got) == order(plain(docs))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) <= {1} and set(kept) == {sha(t) for _, t in docs}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_the_query_equals_grouping(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(op13_exact_dedup(spark, SF).collect(), docs)


@pytest.mark.parametrize("old", [None, "true", "false", "doc_id % 2 = 0", "CAST(NULL AS BOOLEAN)"])
def test_odd_rows_whatever_is_history(spark, old):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("row", "digest", "keep_id", "bucket", "kind", "old", "at", "n")})
    same(exact.exact_duplicates(df.repartition(3), old and F.expr(old), per_bucket=2).collect(), ODD)


def test_dropping_keeps_rows_as_they_are(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ODD)], "doc_id long, text string, at int").withColumns({"__at": F.lit("z"), "old": F.lit(1)})
    got = exact.drop_exact_duplicates(df)
    assert got.columns == df.columns
    rows = got.collect()
    assert len(rows) == len({sha(t) for _, t in ODD}) and {(r.doc_id, r.text, r["at"]) for r in rows} <= {(*r, i) for i, r in enumerate(ODD)}
    top = {s: k for _, k, _, s in plain(ODD)}
    assert all(r.doc_id == top[sha(r.text)] for r in rows)


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_duplicates(none).count() == 0 and exact.drop_exact_duplicates(none).count() == 0


def test_groups_beyond_the_broadcast_ones_and_small_task_memory(spark, monkeypatch):
    docs = [(i, f"t{i % 1500}" if i % 3 else "hot") for i in range(6000)]
    monkeypatch.setattr(exact, "_MOST", 50)
    same(exact.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), per_bucket=100).collect(), docs)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_the_hash_is_perfect_minimal_and_checked(n):
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(n + 50)), np.uint64).reshape(-1, 4)
    h = exact.PerfectHash.of(keys[:n])
    again = exact.PerfectHash(h.shape, h.bits)
    assert sorted(again(keys[:n]).tolist()) == list(range(n))
    others = again(keys[n:])
    assert ((others >= -1) & (others < max(n, 1))).all()


def test_digests_that_share_slots_are_not_taken_for_members(spark):
    """A new digest that the hash sends to a filled slot is told apart by its bytes."""
    old = [(i, f"old {i}") for i in range(300)]
    new = [(1000 + i, f"new {i}") for i in range(300)]
    got = exact.exact_duplicates(spark.createDataFrame(old + new, "doc_id long, text string"), F.col("doc_id") < 1000, per_bucket=10).collect()
    assert all(r.group_size == 1 and r.kept for r in got)
