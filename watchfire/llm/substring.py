"""Repeated passages: suffix automata of reference shards, with documents streamed for matching statistics."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfire.llm.common import materialise
from watchfire.llm.wordhash import WordHashes, window_hashes

#: Words in an anchor; the anchor of a window is its seed of least hash, so equal windows have equal anchors.
SEED = 6
#: Shards' reference words, words streamed against one copy of a shard, and words of both that a task is to take.
SHARD_WORDS, STREAM_WORDS, TASK_WORDS = 100_000, 1_000_000, 5_000_000
#: Documents whose ids share all but the last bits stay in one chunk, since copies often have ids near each other.
CHUNK_RUN = 64
_HASHES = WordHashes()


class SuffixAutomaton:
    """Of a sequence of passages, each with an owner. For a word sequence it gives the longest match that ends at each
    word, and the least owner among the places where its last `window` words occur."""

    def __init__(self, window: int):
        self.window = window
        self.next: list[dict] = [{}]
        self.link, self.len, self.owner = [-1], [0], [None]
        self._separator = -1

    def add(self, words: list, owner: int) -> None:
        last = 0
        nxt, link, length, own = self.next, self.link, self.len, self.owner
        # A symbol of its own before each passage keeps matches from crossing passages.
        for c in (self._separator, *words):
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            own.append(owner)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p == -1:
                link.append(0)
            else:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link.append(q)
                else:
                    clone = cur + 1
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    own.append(own[q])
                    link.append(clone)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = clone
            last = cur
        self._separator -= 1

    def close(self) -> None:
        """Hands each state the least owner of the states whose suffix it is."""
        own, link = self.owner, self.link
        for s in sorted(range(1, len(own)), key=self.len.__getitem__, reverse=True):
            p = link[s]
            if p > 0 and own[s] < own[p]:
                own[p] = own[s]

    def covered(self, words: list, owner: int) -> list[tuple[int, int]]:
        """Maximal spans (start, end) of words that lie in a window which an owner less than `owner` has."""
        nxt, link, length, own, w = self.next, self.link, self.len, self.owner, self.window
        out: list[list[int]] = []
        v = n = 0
        for i, c in enumerate(words):
            t = nxt[v].get(c)
            while t is None and v:
                v = link[v]
                n = length[v]
                t = nxt[v].get(c)
            if t is None:
                continue
            v, n = t, n + 1
            if n >= w:
                while length[link[v]] >= w:  # only the last `window` words count
                    v = link[v]
                    n = length[v]
                if own[v] < owner:
                    start = i + 1 - w
                    if out and start <= out[-1][1]:
                        out[-1][1] = i + 1
                    else:
                        out.append([start, i + 1])
        return [(a, b) for a, b in out]


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _anchors(h: np.ndarray, window: int) -> np.ndarray:
    """The least seed hash of each window."""
    m, have, need = window_hashes(h, SEED), 1, window - SEED + 1
    while have < need:
        step = min(have, need - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m


def _chunk_anchors(anchors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct anchors of a chunk's documents, whether two or more of its documents have each)."""
    # Neighbouring windows mostly share their anchor.
    own = [np.unique(a[np.concatenate(([True], a[1:] != a[:-1]))]) for a in anchors if len(a)]
    if not own:
        return np.empty(0, np.uint64), np.empty(0, bool)
    keys, n = np.unique(np.concatenate(own), return_counts=True)
    return keys, n > 1


def _hashed(words: list[bytes], window: int) -> np.ndarray:
    return _anchors(_HASHES.of(words), window) if len(words) >= window else np.empty(0, np.uint64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the known, sorted ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _among_runs(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """_among where neighbours are mostly equal: one search for each run."""
    if not len(values):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return np.repeat(_among(values[starts], known), np.diff(np.append(starts, len(values))))


def _slices(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys: a bucket is a key's first bits."""
    if not bits:
        yield 0, 0, len(keys)
        return
    first = (keys >> np.uint64(64 - bits)).astype(np.int64)
    buckets, at = np.unique(first, return_index=True)
    for b, i, j in zip(buckets.tolist(), at.tolist(), [*at[1:].tolist(), len(keys)]):
        yield b, i, j


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_KEYS = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("docs", pa.binary())])
_FOUND = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("found", pa.binary())])
_STATE = pa.schema(
    [("doc_id", pa.int64()), ("chunk", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("near", pa.binary())]
)
_SEGMENT = pa.schema(
    [("owner", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("reference", pa.bool_()), ("n", pa.int64()), ("text", pa.string())]
)
_SPAN = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
_RESULT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())]
)
_SQL = {pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"`{f.name}` {_SQL[f.type]}" for f in schema)


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of each run of true."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _candidates(docs: DataFrame, window: int, bits: int) -> DataFrame:
    """A row for each document: with its text and a bitmap of its windows whose anchor another document has, if any;
    else without.

    Documents are dealt by chunk (a range of ids). A chunk sends its distinct anchors to their buckets; a bucket sends
    back a bitmap in the same order: whether another chunk has them. So a passage that a third of all documents share
    costs a row for each chunk, not for each document.
    """
    by_chunk = docs.groupBy("chunk")

    def emit(t: pa.Table) -> pa.Table:
        keys, _ = _chunk_anchors([_hashed(_words(x), window) for x in t["text"].to_pylist()])
        chunk, shift = t["chunk"][0].as_py(), np.uint64(32 - bits)
        return _batch(
            _KEYS, [(b, chunk, (keys[i:j] >> shift).astype("<u4").tobytes(), None) for b, i, j in _slices(keys, bits)]
        )

    def meet(t: pa.Table) -> pa.Table:
        chunks = t["chunk"].to_pylist()
        parts = [np.frombuffer(k, "<u4") for k in t["keys"].to_pylist()]
        values, n = np.unique(np.concatenate([np.unique(p) for p in parts]), return_counts=True)
        shared = values[n > 1]
        b = t["bucket"][0].as_py()
        return _batch(_FOUND, [(c, b, np.packbits(_among(p, shared)).tobytes()) for c, p in zip(chunks, parts)])

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _STATE.empty_table()
        ids, texts = left["doc_id"].to_pylist(), left["text"].to_pylist()
        words = [_words(x) for x in texts]
        anchors = [_hashed(w, window) for w in words]
        keys, shared = _chunk_anchors(anchors)
        found = dict(zip(right["bucket"].to_pylist(), right["found"].to_pylist()))
        for b, i, j in _slices(keys, bits) if len(keys) else ():
            shared[i:j] |= np.unpackbits(np.frombuffer(found[b], np.uint8), count=j - i).astype(bool)
        keys = keys[shared]
        rows, chunk = [], left["chunk"][0].as_py()
        for doc, text, w, a in zip(ids, texts, words, anchors):
            hit = _among_runs(a, keys)
            near = np.packbits(hit).tobytes() if hit.any() else None
            if near:
                rows.append((doc, chunk, len(w), None, text, near))
            else:
                rows.append((doc, chunk, len(w), hashlib.sha256(b" ".join(w)).hexdigest(), None, None))
        return _batch(_STATE, rows)

    found = by_chunk.applyInArrow(emit, _ddl(_KEYS)).groupBy("bucket").applyInArrow(meet, _ddl(_FOUND))
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(mark, _ddl(_STATE))


def _chunk_windows(t: pa.Table, window: int) -> tuple[list, list, list, list, np.ndarray, np.ndarray, np.ndarray]:
    """ids, words, and places of candidate windows of a chunk's documents, then for each of these windows its place
    among the chunk's sorted distinct ones; and of those: the windows' hashes, the least id that has each, and whether
    two or more of the chunk's ids have it."""
    ids = t["doc_id"].to_pylist()
    words = [_words(x) for x in t["text"].to_pylist()]
    at, parts = [], []
    for w, near in zip(words, t["near"].to_pylist()):
        hit = np.unpackbits(np.frombuffer(near, np.uint8), count=len(w) - window + 1).astype(bool)
        used = np.zeros(len(w), bool)
        for k in range(window):
            used[k : k + len(hit)] |= hit
        # Only words of candidate windows need a hash.
        h, where = np.zeros(len(w), np.uint64), np.flatnonzero(used)
        h[where] = _HASHES.of([w[i] for i in where.tolist()] if len(where) < len(w) else w)
        at.append(np.flatnonzero(hit))
        parts.append(window_hashes(h, window)[at[-1]])
    sizes = [len(p) for p in parts]
    keys, owner = np.concatenate(parts), np.repeat(np.array(ids, np.int64), sizes)
    order = np.argsort(keys)
    keys, owner = keys[order], owner[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1]))
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    least, most = np.minimum.reduceat(owner, starts), np.maximum.reduceat(owner, starts)
    return ids, words, at, np.split(place, np.cumsum(sizes)[:-1]), keys[starts], least, most > least


def _segments(near: DataFrame, window: int, bits: int) -> DataFrame:
    """Passages that go to the shard of their owner, the first document that seems to have them: from that document as
    reference, from the others to be streamed. Fingerprints only choose the shard; the automaton there decides."""
    by_chunk = near.groupBy("chunk")

    def emit(t: pa.Table) -> pa.Table:
        *_, keys, least, _ = _chunk_windows(t, window)
        chunk = t["chunk"][0].as_py()
        return _batch(
            _KEYS,
            [(b, chunk, keys[i:j].tobytes(), least[i:j].tobytes()) for b, i, j in _slices(keys, bits)],
        )

    def meet(t: pa.Table) -> pa.Table:
        chunks = t["chunk"].to_pylist()
        parts = [np.frombuffer(k, np.uint64) for k in t["keys"].to_pylist()]
        owner = np.concatenate([np.frombuffer(d, np.int64) for d in t["docs"].to_pylist()])
        keys = np.concatenate(parts)
        values, place, n = np.unique(keys, return_inverse=True, return_counts=True)
        least = np.full(len(values), np.iinfo(np.int64).max)
        np.minimum.at(least, place, owner)
        # Least owner, then whether a second chunk has the window.
        answer, several = least[place], (n > 1)[place]
        b, at, rows = t["bucket"][0].as_py(), 0, []
        for c, p in zip(chunks, parts):
            part = answer[at : at + len(p)].tobytes() + np.packbits(several[at : at + len(p)]).tobytes()
            rows.append((c, b, part))
            at += len(p)
        return _batch(_FOUND, rows)

    def route(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SEGMENT.empty_table()
        ids, words, at, places, keys, least, several = _chunk_windows(left, window)
        found = dict(zip(right["bucket"].to_pylist(), right["found"].to_pylist()))
        for b, i, j in _slices(keys, bits):
            least[i:j] = np.frombuffer(found[b][: 8 * (j - i)], np.int64)
            several[i:j] |= np.unpackbits(np.frombuffer(found[b][8 * (j - i) :], np.uint8), count=j - i).astype(bool)
        rows = []
        for doc, w, own, place in zip(ids, words, at, places):
            hit, owner = np.zeros(len(w) - window + 1, bool), np.full(len(w) - window + 1, np.int64(-1))
            hit[own] = several[place]
            owner[own] = np.where(several[place], least[place], np.int64(-1))
            cuts = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (hit[1:] != hit[:-1]), [True])))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if hit[i]:
                    o, end = int(owner[i]), j - 1 + window
                    rows.append((o, doc, i, o == doc, end - i, b" ".join(w[i:end]).decode("utf-8", "surrogatepass")))
        return _batch(_SEGMENT, rows)

    found = by_chunk.applyInArrow(emit, _ddl(_KEYS)).groupBy("bucket").applyInArrow(meet, _ddl(_FOUND))
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(route, _ddl(_SEGMENT))


def _match(segments: DataFrame, window: int) -> DataFrame:
    """Spans that the automata find. Shards hold about SHARD_WORDS reference words each, whatever the corpus; a shard
    that much is streamed against is copied, so that each copy streams about STREAM_WORDS. There are as many tasks as the
    words need: a task takes its shards one after another."""
    row = segments.agg(F.sum(F.when(F.col("reference"), F.col("n"))), F.sum("n")).first()
    total, words = row[0] or 0, row[1] or 0
    shards = max(1, -(-total // SHARD_WORDS))
    segments = segments.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)))
    copies = (
        segments.where("NOT reference")
        .groupBy("shard")
        .agg(F.ceil(F.sum("n") / STREAM_WORDS).cast("int").alias("copies"))
    )
    dealt = segments.join(copies, "shard").withColumn(
        "copy",
        F.explode(
            F.when(F.col("reference"), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(
                F.array(F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int"))
            )
        ),
    )
    spark = segments.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // TASK_WORDS), 1)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, automaton, closed = None, None, False
        for b in batches:
            rows = []
            for shard, copy, reference, doc, at, text in zip(
                *(b.column(c).to_pylist() for c in ("shard", "copy", "reference", "doc_id", "at", "text"))
            ):
                if (shard, copy) != here:
                    here, automaton, closed = (shard, copy), SuffixAutomaton(window), False
                if reference:
                    automaton.add(text.encode("utf-8", "surrogatepass").split(b" "), doc)
                    continue
                if not closed:
                    automaton.close()
                    closed = True
                for i, j in automaton.covered(text.encode("utf-8", "surrogatepass").split(b" "), doc):
                    rows.append((doc, at + i, at + j))
            yield from _batch(_SPAN, rows).to_batches()

    return (
        dealt.repartition(width, "shard", "copy")
        .sortWithinPartitions("shard", "copy", F.desc("reference"))
        .select("shard", "copy", "reference", "doc_id", "at", "text")
        .mapInArrow(stream, _ddl(_SPAN))
    )


def remove_repeats(
    docs: DataFrame,
    window: int = 13,
    chunk_bytes: int = 2 << 20,
    bucket_bytes: int = 64 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Removes every word covered by a window of `window` words that also starts in a document of smaller id.

    1. Candidates: windows whose anchor (least-hash seed) two documents have. 2. Each candidate passage is routed to
    the reference shard of the first document that has its fingerprint; that document gives the reference text.
    3. Each shard's suffix automaton (about SHARD_WORDS words, so its memory does not grow with the corpus) streams
    the passages routed to it; words in a match of at least `window` whose owner has a smaller id go. An automaton of
    the whole corpus could not be broadcast; a shard's automaton goes only where its passages go.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) and kept_text (null where
    nothing is removed). Null or empty texts have no words. Windows are judged on the input. Rows with null id are
    returned untouched; rows that share an id are one document's parts: a repeat between them stays. An empty table
    gives no rows; other columns are ignored. Documents are handled in chunks of about chunk_bytes, each document whole.
    """
    bare = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = bare.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))

    def chunk_of(doc):
        return F.pmod(F.xxhash64(F.shiftright(doc, CHUNK_RUN.bit_length() - 1)), F.lit(chunks)).alias("chunk")

    slim = bare.select("doc_id", chunk_of(F.col("doc_id")), "text")
    known = slim.where("doc_id IS NOT NULL")
    bits = min(20, max(0, (size // bucket_bytes)).bit_length())
    state = materialise(_candidates(known, window, bits))
    near = state.where("near IS NOT NULL")
    spans = _match(materialise(_segments(near.select("doc_id", "chunk", "text", "near"), window, bits)), window)
    spans = spans.withColumn("chunk", chunk_of(F.col("doc_id")))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        gone: dict[int, list[tuple[int, int]]] = {}
        for doc, i, j in zip(*(right[c].to_pylist() for c in ("doc_id", "start", "end"))):
            gone.setdefault(doc, []).append((i, j))
        rows = []
        for doc, text in zip(left["doc_id"].to_pylist(), left["text"].to_pylist()):
            w = _words(text)
            keep = np.ones(len(w), bool)
            for i, j in gone.get(doc, ()):
                keep[i:j] = False
            n = int(keep.sum())
            kept = b" ".join(w if n == len(w) else [w[i] for i in np.flatnonzero(keep).tolist()])
            out = None if n == len(w) else kept.decode("utf-8", "surrogatepass")
            rows.append((doc, len(w), len(w) - n, hashlib.sha256(kept).hexdigest(), out))
        return _batch(_RESULT, rows)

    changed = (
        near.select("doc_id", "chunk", "text").groupBy("chunk").cogroup(spans.groupBy("chunk")).applyInArrow(cut, _ddl(_RESULT))
    )
    same = state.where("near IS NULL").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text")
    )
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    unknown = slim.where("doc_id IS NULL").select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.lit(0).cast("long").alias("n_removed"),
        F.sha2(F.array_join(words, " "), 256).alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept_text"),
    )
    return changed.unionByName(same).unionByName(unknown)
