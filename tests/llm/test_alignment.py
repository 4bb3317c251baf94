import hashlib
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from watchfire.llm import alignment
from watchfire.llm.queries import PIECES, op12_alignment, tokenizer_path

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "x " * 3000), (None, "lost row here"), (9, " lead"), (10, "trail  "), (11, "a▁b"), (12, "nul\x00 byte"),
    (6, "  é　ß <|endoftext|> 's  double  spaces\u0085 <s> </s> <unk>"), (7, "y" * 5000), (8, "x " * 3000), (13, "日本語 テスト\r\n🙂🙂 don't  stop\n\n\tdef f(x):\n    return 1"), (14, "<0x41> \x1f x\x1c y"),
]


@lru_cache
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECES))


def plain_bytes_a(piece):
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {c: c for c in keep} | {256 + i: c for i, c in enumerate(sorted(set(range(256)) - set(keep)))}
    return bytes(back[ord(c)] for c in piece)


def plain_bytes_b(piece):
    return bytes([int(piece[3:5], 16)]) if len(piece) == 6 and piece.startswith("<0x") else piece.replace("▁", " ").encode()


def plain(docs):
    """Whole texts by the tokenizers' own libraries, all links of the corpus in one dictionary."""
    a, b = encoders()
    links, out = [], []
    for _, text in docs:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        ends = []
        for ids, spell in ((ids_a, lambda i: plain_bytes_a(a.id_to_token(i))), (ids_b, lambda i: plain_bytes_b(b.id_to_piece(i)))):
            joined, end = b"", {}
            for k, i in enumerate(ids):
                joined += spell(i)
                end[len(joined)] = k
            ends.append((joined, end))
        if not text or {ends[0][0], ends[1][0]} != {(" " + text).encode()}:
            links.append([])
            out.append((0, 0, 0, ""))
            continue
        both = sorted(ends[0][1].keys() & ends[1][1].keys())
        cuts = [(ends[0][1][e] + 1, ends[1][1][e] + 1) for e in both]
        groups = [f"{','.join(map(str, ids_a[p:i]))}|{','.join(map(str, ids_b[q:j]))}" for (p, q), (i, j) in zip([(0, 0), *cuts], cuts)]
        links.append([(ids_a[i - 1], ids_b[j - 1]) for i, j in cuts])
        out.append((len(ids_a), len(ids_b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = Counter(x for some in links for x in some)
    top = defaultdict(int)
    for (_, j), n in count.items():
        top[j] = max(top[j], n)
    return [
        (d, n_a, n_b, n, len(some), sum(count[x] == top[x[1]] for x in some), sum(count[x] for x in some), sha)
        for (d, _), some, (n_a, n_b, n, sha) in zip(docs, links, out)
    ]


def same(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert order(tuple(r[c] for c in COLUMNS) for r in got) == order(want)


def test_the_query_equals_whole_text_encoding(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    same(op12_alignment(spark, SF).collect(), plain(docs))


@pytest.mark.parametrize("n_buckets,splits,partitions", [(16, None, 1), (3, 4, 5), (1, 1, 2)])
def test_odd_rows(spark, n_buckets, splits, partitions):
    df = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({c: F.lit("z") for c in ("row", "kind", "bucket", "n_best", "cell", "pairs")})
    got = alignment.align(df.repartition(partitions), tokenizer_path(), tokenizer_path(PIECES), n_buckets, splits).collect()
    same(got, plain(ODD))
    assert {r.doc_id: r.n_links for r in got}[11] == 0


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path(), tokenizer_path(PIECES)).count() == 0


def test_long_texts_go_in_blocks_and_lots(spark, monkeypatch):
    """Small blocks and lots, a memory of few segments, and multiplicities beyond a word's."""
    words = ["the", "quick", "café", "naïve", "x" * 300, "12,345.67", "\n\nnew", "a\tb"]
    text = " ".join(words[i * i % 8] + ("" if i % 5 else f"{i % 11}") for i in range(4000))
    docs = [(1, text), (2, text[:9000]), (3, "the " * 500), (4, f"{text}  {text}")]
    monkeypatch.setattr(alignment, "_BLOCK", 500)
    monkeypatch.setattr(alignment, "_LOT", 300)
    out = []
    monkeypatch.setattr(alignment.TaskContext, "get", classmethod(lambda cls: type("T", (), {"partitionId": staticmethod(lambda: 1)})()))
    task = alignment._Task(alignment.Aligner(tokenizer_path(), tokenizer_path(PIECES), 4, most=40))
    for d, t in docs:
        out += task.take([task.document(d, t)])
    task.flush()
    task.totals(chunk=7)
    out += task.take([])
    rows = [r for b in out for r in b.to_pylist()]
    found = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["groups_sha256"]) for r in rows if r["kind"] == 0}
    want = {d: (n_a, n_b, n, sha) for d, n_a, n_b, n, _, _, _, sha in plain(docs)}
    assert found == want
    lay = task.lay
    import numpy as np

    posted, total = Counter(), Counter()
    for r in rows:
        if r["kind"] == 1:
            for w in np.frombuffer(r["postings"], lay.word).tolist():
                posted[r["bucket"] * lay.span + w // lay.most] += w % lay.most + 1
        if r["kind"] == 2:
            total.update(dict(zip(r["pairs"], r["counts"])))
    assert posted == total and posted.total() == sum(n for _, _, n, _ in want.values())
    assert max(posted.values()) > lay.most
