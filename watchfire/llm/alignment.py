"""Alignment of two tokenizers' tokens by byte offsets, with corpus-wide counts of the id pairs that end together."""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfire.llm.common import materialise, shuffle_width, slices
from watchfire.llm.packing import rank_encoder

#: A single space between two characters that are no white space: both tokenizers always cut before it.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Without white space at an edge or beside other white space, each space is such a one.
_UNEVEN = re.compile(r"\s\s|^\s|\s$")
#: A text is read in blocks of about so many characters, links are counted in lots of about so many.
_BLOCK, _LOT = 1_000_000, 1_000_000
_DOC, _POSTING, _TOTAL = 0, 1, 2
_ROWS = (
    "kind int, row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, bucket int, postings binary, pairs array<long>, counts array<long>"
)
_ARROW = pa.schema([
    ("kind", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
    ("groups_sha256", pa.string()), ("bucket", pa.int32()), ("postings", pa.binary()), ("pairs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])


def _bytes_of_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level BPE file; ids of special tokens, which texts never give, have none."""
    import json

    spec = json.load(open(path, encoding="utf-8"))
    # Bytes that print stand for themselves, the others are moved up from 256: the usual byte alphabet.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    special = {t["content"] for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    out = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]))
    for word, i in vocab.items():
        if word not in special:
            out[i] = bytes(alphabet[c] for c in word)
    return out


def _bytes_of_b(model) -> list[bytes]:
    """The bytes of each piece: the mark of a space as a space, byte pieces as their byte."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return out


class Aligner:
    """Segments of texts and what both tokenizers make of them; remembered, and forgotten beyond a number of segments.

    A text is cut before single spaces between other characters. A byte-level pre-tokenizer cuts there, and so does a
    piece model none of whose pieces has a space after another character (checked; else texts are encoded whole). So a
    segment's groups do not depend on what is around it, and both sides end where it ends.
    """

    def __init__(self, a_path: str, b_path: str, n_buckets: int, most: int = 600_000, most_chars: int = 24_000_000):
        import sentencepiece
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(a_path)
        tok.encode_special_tokens = True
        self.encode_a = rank_encoder(a_path) or (lambda text: tok.encode(text, add_special_tokens=False).ids)
        model = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.encode_b = lambda texts: model.encode(texts, num_threads=1)
        self.a, self.b = _bytes_of_a(a_path), _bytes_of_b(model)
        self.apart = not any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(len(self.b)))
        self.size_a, self.size_b = [len(x) for x in self.a], [len(x) for x in self.b]
        self.layout = Layout(len(self.a), len(self.b), n_buckets)
        self.base = [self.layout.key(0, i) for i in range(len(self.b))]
        self.most, self.most_chars = most, most_chars
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.links, self.first, self.n_a, self.n_b = array("q"), array("q", [0]), array("q"), array("q")
        self.chars = 0

    def full(self) -> bool:
        return len(self.groups) > self.most or self.chars > self.most_chars

    def _learn(self, segments: list[str]) -> None:
        """Takes in new segments. One that either side does not give back has no tokens."""
        pick_a, pick_b, size_a, size_b, base = self.a.__getitem__, self.b.__getitem__, self.size_a.__getitem__, self.size_b.__getitem__, self.base
        encode_a, links, first, known, groups = self.encode_a, self.links, self.first, self.known, self.groups
        for segment, b in zip(segments, self.encode_b(segments)):
            spaced = " " + segment
            a, text, shown = encode_a(spaced), spaced.encode(), ""
            if b"".join(map(pick_a, a)) == text == b"".join(map(pick_b, b)):
                ends_a, ends_b = list(accumulate(map(size_a, a))), list(accumulate(map(size_b, b)))
                if ends_a == ends_b:
                    shown = ";".join([f"{x}|{y}" for x, y in zip(a, b)])
                    links.extend([base[y] + x for x, y in zip(a, b)])
                else:
                    at_b, found, p, q = dict(zip(ends_b, range(1, len(b) + 1))), [], 0, 0
                    for i, end in enumerate(ends_a, 1):
                        if j := at_b.get(end):
                            found.append(f"{a[p]}|{b[q]}" if i - p == j - q == 1 else f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
                            links.append(base[b[j - 1]] + a[i - 1])
                            p, q = i, j
                    shown = ";".join(found)
            first.append(len(links))
            self.n_a.append(len(a) if shown else 0)
            self.n_b.append(len(b) if shown else 0)
            known[segment] = len(groups)
            groups.append(shown)
            self.chars += len(segment) + len(shown)

    def segments(self, text: str) -> np.ndarray:
        """The numbers of the text's segments, in order."""
        out, at = [], 0
        while at < len(text):
            cut = _CUT.search(text, at + _BLOCK) if self.apart and len(text) - at > _BLOCK else None
            block = text[at : cut.start()] if cut else text[at:]
            at = cut.end() if cut else len(text)
            parts = [block] if not self.apart else _CUT.split(block) if _UNEVEN.search(block) else block.split(" ")
            got = list(map(self.known.get, parts))
            if None in got:
                self._learn([*dict.fromkeys(p for p, n in zip(parts, got) if n is None)])
                got = list(map(self.known.__getitem__, parts))
            out.append(np.array(got, np.int32))
        return np.concatenate(out)


class Layout:
    """How an id pair is written as one number. B ids are dealt over n_buckets; within a bucket a pair is a number below
    span, and with its multiplicity in a document (less one, up to `most`) it fills one unsigned word."""

    def __init__(self, n_a: int, n_b: int, n_buckets: int):
        self.n_a, self.n_buckets = n_a, n_buckets
        self.span = n_a * -(-n_b // n_buckets)
        self.word = np.dtype("<u4" if 8 * self.span <= 1 << 32 else "<u8")
        self.most = (1 << 32) // self.span if self.word.itemsize == 4 else 256

    def key(self, a: int, b: int) -> int:
        return (b % self.n_buckets) * self.span + (b // self.n_buckets) * self.n_a + a


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    all_keys, where = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.zeros(len(all_keys), np.int64)
    np.add.at(sums, where, np.concatenate(counts))
    return all_keys, sums


class _Task:
    """What one task writes: documents, their postings by bucket, and its totals of all pairs."""

    def __init__(self, aligner: Aligner):
        self.it, self.lay = aligner, aligner.layout
        self.row = (TaskContext.get().partitionId() << 36) - 1
        self.wait: list[tuple[int, np.ndarray]] = []
        self.n_wait = 0
        self.keys: list[np.ndarray] = [np.empty(0, np.int64)]
        self.counts: list[np.ndarray] = [np.empty(0, np.int64)]
        self.out: list[pa.RecordBatch] = []

    def document(self, doc_id, text: str | None) -> tuple:
        self.row += 1
        if not text:
            return self.row, doc_id, 0, 0, 0, 0, ""
        if self.it.full():
            self.flush()
            self.it.forget()
        at = self.it.segments(text)
        n_a, n_b, first = (np.frombuffer(x, np.int64) for x in (self.it.n_a, self.it.n_b, self.it.first))
        if not n_a[at].all():
            return self.row, doc_id, 0, 0, 0, 0, ""
        digest, groups = hashlib.sha256(), self.it.groups
        for i in range(0, len(at), 100_000):
            digest.update((";" * (i > 0) + ";".join([groups[k] for k in at[i : i + 100_000].tolist()])).encode())
        n = 0
        for i in range(0, len(at), _LOT):
            some = at[i : i + _LOT]
            lot = int((first[some + 1] - first[some]).sum())
            n += lot
            self.wait.append((self.row, some))
            self.n_wait += lot
            if self.n_wait > _LOT:
                self.flush()
        return self.row, doc_id, int(n_a[at].sum()), int(n_b[at].sum()), n, n, digest.hexdigest()

    def flush(self) -> None:
        """Postings of what waits: for each document and bucket one row, a word for each pair."""
        if not self.n_wait:
            self.wait = []
            return
        rows, (links, first) = np.array([r for r, _ in self.wait]), (np.frombuffer(x, np.int64) for x in (self.it.links, self.it.first))
        at = np.concatenate([x for _, x in self.wait])
        n = first[at + 1] - first[at]
        nth = np.repeat(np.arange(len(rows)), [len(x) for _, x in self.wait])
        whole = self.lay.n_buckets * self.lay.span
        key = np.repeat(first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        key, m = np.unique(np.repeat(nth, n) * whole + links[key], return_counts=True)
        self.wait, self.n_wait = [], 0
        self.keys.append(key % whole)
        self.counts.append(m)
        if sum(map(len, self.keys)) > 4 * _LOT:
            merged = _merged(self.keys, self.counts)
            self.keys, self.counts = [merged[0]], [merged[1]]
            if len(merged[0]) > 2 * _LOT:
                self.totals()
        times = -(-m // self.lay.most)  # what is met oftener than a word can say takes several
        if times.max() > 1:
            last = np.cumsum(times) - 1
            key, rest = np.repeat(key, times), m - (times - 1) * self.lay.most
            m = np.full(len(key), self.lay.most)
            m[last] = rest
        words = (key % self.lay.span * self.lay.most + m - 1).astype(self.lay.word)
        cell = key // self.lay.span
        begin = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        offsets = (np.concatenate((begin, [len(cell)])) * self.lay.word.itemsize).astype(np.int32)
        postings = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(words)])
        self._emit(_POSTING, row=pa.array(rows[cell[begin] // self.lay.n_buckets]), bucket=pa.array((cell[begin] % self.lay.n_buckets).astype(np.int32)), postings=postings)

    def totals(self, chunk: int = 20_000) -> None:
        key, n = _merged(self.keys, self.counts)
        self.keys, self.counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        offsets = pa.array([*range(0, len(key), chunk), len(key)], pa.int32())
        self._emit(_TOTAL, pairs=pa.ListArray.from_arrays(offsets, pa.array(key)), counts=pa.ListArray.from_arrays(offsets, pa.array(n)))

    def _emit(self, kind: int, **columns: pa.Array) -> None:
        size = len(next(iter(columns.values())))
        columns["kind"] = pa.array(np.full(size, kind, np.int32))
        self.out.append(pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in _ARROW], schema=_ARROW))

    def take(self, documents: list[tuple]) -> list[pa.RecordBatch]:
        if documents:
            names = ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            self._emit(_DOC, **{c: pa.array(x, _ARROW.field(c).type) for c, x in zip(names, zip(*documents))})
        out, self.out = self.out, []
        return out


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(*key) -> Aligner:
    """A worker keeps its tokenizers and segments from task to task."""
    return _ALIGNERS.get(key) or _ALIGNERS.setdefault(key, Aligner(*key))


def align(docs: DataFrame, a_path: str, b_path: str, n_buckets: int = 16, splits: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Aligns the tokens that a byte-level BPE (A, on a space and the text) and a piece model (B, which adds that space)
    make of every text, and weighs each link by how often its id pair is linked in the whole corpus.

    Byte offsets where tokens of both end cut them into groups; the two tokens that end there are a link. The first pass
    encodes each text, finds groups and links, and writes, as Parquet: a row a document, its postings (each pair and
    its multiplicity, in one row a document and bucket of B ids), and each task's totals of the pairs. Then totals
    and postings are cogrouped: both are dealt by bucket of B ids and split of documents and sorted by Spark, which spills,
    so that a cell's totals come before its postings; the reader adds counts, finds each B id's highest, and streams the
    postings, each of which gives a document's part. Parts are summed by document. A common B id is no hot group: a document has it in
    one posting row, rows of a bucket are dealt over splits (default: as the number of shuffle partitions asks), and only
    totals, bounded by the vocabularies, are repeated for each split.

    Returns one row for each input row: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair has its B id's
    highest count, ties included), count_sum (of the links' pair counts), groups_sha256 (of `a1,a2|b1;a3|b2`). Null and
    empty texts, and texts whose bytes either side does not give back, have zeros and ''. Null ids and rows that share an
    id are documents of their own; an empty table gives no rows. Other columns are ignored. Special tokens' strings in
    texts are plain text. Memory of a task: one block of segments and links, and the pairs of a bucket.
    """
    spark = docs.sparkSession
    splits = splits or -(-shuffle_width(spark) // n_buckets)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(_aligner(a_path, b_path, n_buckets))
        for b in slices(batches, 200):
            yield from task.take([task.document(d, t) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())])
        task.flush()
        task.totals()
        yield from task.take([])

    first = materialise(slim.mapInArrow(encode, _ROWS))
    layout = Layout(*_sizes(a_path, b_path), n_buckets)
    total = first.where(f"kind = {_TOTAL}").select(F.explode(F.arrays_zip("pairs", "counts")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    # Some 64 rows a bucket instead of one for each pair; they go to every split.
    bucket, within = F.expr(f"CAST(pair DIV {layout.span} AS INT)"), F.expr(f"pair % {layout.span}")
    totals = (
        total.groupBy(bucket.alias("bucket"), F.pmod(F.hash("pair"), F.lit(64)).alias("chunk")).agg(F.collect_list(F.struct(within.alias("pair"), "n")).alias("x"))
        .select("bucket", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(_DOC).alias("order"), F.lit(None).cast("long").alias("row"), F.lit(None).cast("binary").alias("postings"), F.col("x.pair").alias("pairs"), F.col("x.n").alias("counts"))
    )
    postings = first.where(f"kind = {_POSTING}").select("bucket", F.pmod(F.xxhash64("row"), F.lit(splits)).cast("int").alias("split"), F.lit(_POSTING).alias("order"), "row", "postings", "pairs", "counts")
    sizes = (layout.n_a, layout.most, layout.word)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _weigh(batches, *sizes)

    cell = F.expr(f"split * {n_buckets} + bucket")
    parts = (
        totals.unionByName(postings).select(cell.alias("cell"), "order", "row", "postings", "pairs", "counts")
        .repartitionById(n_buckets * splits, F.col("cell")).sortWithinPartitions("cell", "order")
        .mapInArrow(weigh, "row long, n_best long, count_sum long")
        .groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    )
    documents = first.where(f"kind = {_DOC}").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return documents.join(parts, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), "groups_sha256"
    )


def _sizes(a_path: str, b_path: str) -> tuple[int, int]:
    import sentencepiece

    return len(_bytes_of_a(a_path)), sentencepiece.SentencePieceProcessor(model_file=b_path).get_piece_size()


def _weigh(batches: Iterator[pa.RecordBatch], n_a: int, most: int, word: np.dtype) -> Iterator[pa.RecordBatch]:
    """Streams of (cell, order, ...), totals of a cell first: each posting row's links with the highest count of their B id,
    and the sum of its links' counts."""
    here, keys, counts, fresh = None, [], [], False
    pairs = count = top = None
    for b in batches:
        cell, order = np.asarray(b.column("cell")), np.asarray(b.column("order"))
        cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (order[1:] != order[:-1])) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if at == end:
                continue
            part = b.slice(at, end - at)
            if cell[at] != here:
                here, keys, counts = cell[at], [], []
            if order[at] == _DOC:
                keys.append(part.column("pairs").flatten().to_numpy(zero_copy_only=False))
                counts.append(part.column("counts").flatten().to_numpy(zero_copy_only=False))
                fresh = True
                continue
            if fresh:
                pairs, count = _merged(keys, counts)
                start = np.flatnonzero(np.concatenate(([True], pairs[1:] // n_a != pairs[:-1] // n_a)))
                top = np.repeat(np.maximum.reduceat(count, start), np.diff(np.append(start, len(pairs))))
                keys, counts, fresh = [], [], False
            column = part.column("postings")
            ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            words = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(word).astype(np.int64)
            where, m = np.searchsorted(pairs, words // most), words % most + 1
            first = (ends[:-1] - ends[0]) // word.itemsize
            n_best = np.add.reduceat(m * (count[where] == top[where]), first)
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(n_best), pa.array(np.add.reduceat(m * count[where], first))], names=["row", "n_best", "count_sum"])
