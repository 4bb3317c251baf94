"""Every column of the queries against plain versions, and the trained scorers against plain forms of themselves."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from watchfire.llm import quality, queries, rules, toxicity
from watchfire.llm.common import materialise, tidy

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op4_columns(spark, docs):
    for r in queries.op4_secret_scan(spark, SF).collect():
        t = docs[r.doc_id]
        found = [[(m.start(), m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]]
        found += [[(m.start(), m.end()) for m in re.finditer(p, t) if len(m[0]) >= n] for p, n in ((r"AKIA[A-Z0-9]+", 18), (r"[0-9a-f]+", 16))]
        assert [r.n_assign, r.n_access, r.n_hex] == [len(x) for x in found]
        base = [f"{k}:{a}:{b}" for a, n, k, b in sorted((a, n, k, b) for n, k in enumerate(("assign", "access", "hex")) for a, b in found[n])]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s.split(":")[0] in ("assign", "access", "hex")] == base
        places = [int(s.split(":")[1]) for s in spans]
        assert places == sorted(places) and all(0 <= a < int(s.split(":")[2]) <= len(t) for s, a in zip(spans, places))


def test_op9_columns(spark, docs):
    rows = queries.op9_sharding(spark, SF).collect()
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(rows) == len(docs) and set(sizes) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    most = max(r.size for r in rows)
    assert all(abs(s - sum(sizes.values()) / 16) <= most for s in sizes.values())


@pytest.mark.parametrize("query,modulus,rest", [(queries.op2_toxicity, 5, 0), (queries.op5_quality, 3, 1)])
def test_scorers_columns(spark, docs, query, modulus, rest):
    rows = query(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)


def test_op8_and_op1_columns(spark, docs):
    for r in queries.op8_decontamination(spark, SF).collect():
        assert r.doc_id in docs and 0.5 <= r.coverage <= 1
    total = defaultdict(int)
    for r in queries.op1_packing(spark, SF).collect():
        total[r.doc_id] += r.length
        assert r.offset + r.length <= 2048 and total[r.doc_id] <= r.doc_tokens
    assert set(total) == set(docs)


def test_quality_score_is_the_plain_form(spark):
    """Block sizes under the dictionaries, and the logistic form, text by text."""
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = quality.train(df, spark.read.parquet(f"{SF}/labels.parquet"))
    pair = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in quality.score(df, model).join(df, "doc_id").collect():
        raw = (r.text or "").encode()
        good, bad = (sum(len(c.compress(raw[i : i + 1024])) for i in range(0, len(raw), 1024)) for c in pair)
        x = [1.0, (bad - good) / len(raw), (bad + good) / (2 * len(raw))] if raw else [1.0, 0.0, 0.0]
        z = min(30, max(-30, float(np.dot(model.weights, x))))
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9


def test_machine_is_a_plain_support_vector_machine():
    """On some windows: kernel values with the landmarks, squared hinge loss by gradient descent, and the same decisions."""
    up = [f"\x02{a}{b}\x02" for a in ("grum", "blot", "snarp") for b in ("folk", "wick", "eting")]
    down = [f"\x02{a}{b}\x02" for a in ("river", "table", "stone") for b in ("bank", "cloth", "house", "work")]
    machine = toxicity.train_machine(up, down, landmarks=40)
    every = np.arange(1 << toxicity.BITS)
    rows = [*up, *down]
    x = toxicity.phi(rows, every, len(every)).astype(float)
    got = x @ machine.weights + machine.bias
    marks = x  # fewer windows than landmarks: all are landmarks
    vals, vecs = np.linalg.eigh(marks @ marks.T)
    ok = vals > 1e-4 * vals.max()
    z = np.hstack([x @ marks.T @ vecs[:, ok] / np.sqrt(vals[ok]), np.ones((len(rows), 1))])
    y = np.repeat([1.0, -1.0], [len(up), len(down)])
    cost, ridge = np.where(y > 0, 1 / len(up), 1 / len(down)), np.array([1e-3] * (z.shape[1] - 1) + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(60_000):
        gap = np.maximum(0, 1 - y * (z @ w))
        w -= 0.05 * (ridge * w - z.T @ (cost * gap * y))
    assert np.abs(got - z @ w).max() < 0.02 and (np.sign(got) == y).all()


def test_chosen_windows_are_the_plain_ones(spark):
    """The likeliest windows of each document, of all its sentences, whatever the partitions."""
    rng = np.random.default_rng(2)
    words = ["alpha", "beta", "gammas", "delta", "grumfolk", "x"]
    rows = [(i, int(i % 3 == 0), " ".join(rng.choice(words, 12)) + ". " + " ".join(rng.choice(words, 5)) + "!\n" + str(rng.choice(words))) for i in range(12)]
    weights = rng.normal(size=1 << toxicity.BITS).astype(np.float32)
    df = spark.createDataFrame(rows, "doc_id long, toxic long, text string")
    every = np.arange(1 << toxicity.BITS)
    picked = []
    for parts in (1, 5):
        found = toxicity._chosen(df.repartition(parts), weights, 2)
        picked.append(found.values.tolist())
        for i, toxic, text in rows:
            all_of = {w.text(k) for w, _ in toxicity._streams_of([text]) for k in range(len(w.start))}
            score = {t: float(toxicity.phi([t], every, len(every))[0] @ weights) for t in all_of}
            got = found[(found["doc"] == i) & (found["place"] >= 0)]["text"].tolist()
            assert np.allclose(sorted(score.values(), reverse=True)[:2], [score[t] for t in got], atol=1e-3)
            assert set(found[(found["doc"] == i) & (found["place"] < 0)]["text"]) <= all_of
    assert [r[-1] for r in picked[0]] == [r[-1] for r in picked[1]]


def test_tables_go_with_their_block(spark):
    from watchfire.storage import exists

    df = spark.range(5)
    with tidy(spark):
        outer = materialise(df)
        with tidy(spark):
            inner = materialise(df)
            (path,) = {f.rsplit("/", 1)[0] for f in inner.inputFiles()}
            assert exists(spark, path)
        assert not exists(spark, path) and outer.count() == 5
    assert materialise(df).agg(F.sum("id")).first()[0] == 10


def test_rules_after_a_rejection_are_not_evaluated(spark):
    """A rule that fails the job when it is evaluated never is, on rows that an earlier one rejects; nor is its measure."""
    fails = rules.Rule("fails", F.raise_error(F.col("text")).cast("boolean"))
    early = [rules.Rule("early", F.length("text") > 3), fails]
    rows = spark.createDataFrame([(f"text {i}",) for i in range(50)], "text string")
    assert rows.select(rules.verdict(early).alias("kept")).where("NOT kept").count() == 50
    with pytest.raises(Exception, match="text"):
        rows.select(rules.verdict(early[::-1]).alias("kept")).collect()


@pytest.mark.parametrize("text,kept", [
    ("- a b c d e f g h i j\n" * 2 + "* one more line here\n\u2022 and the last one there", False), ("- a list line one\nprose goes on here as it does everywhere\nmore of it\nand more to come", True),
    ("one line of words ...\nand another that goes on ...\na third that ends...\nthe fourth one too \u2026 ", False), (" ".join(str(7919 * i) for i in range(1, 15)), False), (" ".join(f"\u65e5\u672c{chr(0x8a9e + i)}" for i in range(12)), True),
    ("really!! wow!! no!! yes!! ok!! go!! on!! so!! it!! is!!", False),
])
def test_each_added_rule(spark, text, kept):
    got = rules.quality_cascade(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.kept is kept


def test_new_chunks_of_a_text_are_encoded_together(monkeypatch):
    """A text with many new chunks takes few calls of the encoder, and its ids are those of the tokenizer."""
    import random

    import numpy as np
    from tokenizers import Tokenizer

    from watchfire.llm import packing
    from watchfire.llm.queries import tokenizer_path

    calls, make = [], packing.rank_encoder

    def counted(path):
        fast = make(path)
        return lambda text: calls.append(text) or fast(text)

    monkeypatch.setattr(packing, "rank_encoder", counted)
    encode, tok = packing.byte_tokens(tokenizer_path(), 1, memo_size=500), Tokenizer.from_file(tokenizer_path())
    ids = lambda text: np.array([*tok.encode(text, add_special_tokens=False).ids, 1], "<u4").tobytes()
    many = " ".join(f"w{i}x Ġ{i} café{i}\n{i}" for i in range(300))
    assert encode(many) == ids(many) and len(calls) <= 2
    rng, letters = random.Random(3), [" ", " ", "a", "Ġ", "é", "\n", "\t", "'s", "1", " ", "　", "<", "\x1c", "Zx"]
    for text in ("".join(rng.choices(letters, k=rng.randint(1, 40))) for _ in range(2000)):
        assert encode(text) == ids(text)
