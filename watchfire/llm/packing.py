"""Packing token sequences into fixed windows: bounded-space online best-fit."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfire.llm.common import materialise

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Final pieces have no ids; leftovers carry theirs to the merge, where they may be cut again.
WITH_IDS = PIECE + ", leftover boolean, ids binary"


def byte_tokens(path: str, end_id: int, memo_size: int = 400_000) -> Callable[[str], bytes]:
    """A function from a text to its ids (little-endian unsigned 32-bit), end_id last, by the tokenizer file at path.

    A byte-level pre-tokenizer always cuts before a single space between two other characters, so such chunks are
    encoded apart and remembered; texts with other runs of white space at a chunk's edge, or with a special token's
    text, are encoded whole. A text's new chunks are encoded in one go: each begins with the only space that it has, so its
    ids begin where one that stands for a space does.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    special = [t.content for t in tok.get_added_tokens_decoder().values()]
    end = np.array([end_id], dtype="<u4").tobytes()
    fast = rank_encoder(path)
    memo: dict[str, bytes] = {}
    vocab = tok.get_vocab()
    begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
    begins[[i for w, i in vocab.items() if w.startswith("\u0120") and w not in special]] = True  # a space in the byte alphabet

    def whole(text: str) -> bytes:
        if fast and not any(s in text for s in special):
            return np.array(fast(text), dtype="<u4").tobytes()
        return np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def apart(chunks: list[str]) -> list[bytes]:
        if fast:
            ids = np.array(fast(" " + " ".join(chunks)), dtype="<u4")
            at = np.flatnonzero(begins[ids])
            if len(at) == len(chunks):
                raw, at = ids.tobytes(), (4 * at).tolist()
                return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)])]
        return [whole(" " + c) for c in chunks]

    def encode(text: str) -> bytes:
        if not text:
            return end
        chunks = text.split(" ")
        if len(chunks) < 2 or any(s in text for s in special):
            return whole(text) + end
        first, rest = chunks[0], chunks[1:]
        if not first or first[-1].isspace():
            return whole(text) + end
        got = list(map(memo.get, rest))
        if None in got:
            if len(memo) > memo_size:
                memo.clear()
            new = list(dict.fromkeys([c for c, g in zip(rest, got) if g is None]))
            if any(not c or c[0].isspace() or c[-1].isspace() for c in new):
                return whole(text) + end
            memo.update(zip(new, apart(new)))
            got = [memo[c] if g is None else g for c, g in zip(rest, got)]
        return b"".join((whole(first), *got, end))

    return encode


def rank_encoder(path: str) -> Callable[[str], list[int]] | None:
    """A faster encoder with the same ids, if the file is a byte-level BPE whose ids follow the order of its merges."""
    import json

    import tiktoken

    spec = json.load(open(path, encoding="utf-8"))
    vocab, merges = spec["model"].get("vocab"), spec["model"].get("merges")
    pre = spec.get("pre_tokenizer") or {}
    if spec["model"].get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer"):
        return None
    # Bytes that print stand for themselves, the others are moved up from 256: the usual byte alphabet.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    ids = [vocab["".join(p)] for p in pairs]
    if any(b <= a for a, b in zip(ids, ids[1:])) or len(vocab) - len(ids) < 256:
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(alphabet[c] for c in w): i for w, i in vocab.items() if w not in special}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Windows:
    """A fixed number of open windows. What fits goes to the window it leaves least room in; what fits none completes
    the fullest one, if the gap there is worth a cut, and that window is given out."""

    def __init__(self, size: int, slots: int, least_cut: int, ident: Callable[[], int]):
        self.size, self.slots, self.least, self.ident = size, slots, least_cut, ident
        self.open: list[tuple[int, list]] = []
        self.done: list[tuple] = []

    def _emit(self, pieces: list, leftover: bool) -> None:
        n, at = self.ident(), 0
        for doc, start, ids, total in pieces:
            length = len(ids) // 4
            self.done.append((doc, start, length, zlib.crc32(ids), total, n, at, leftover, ids if leftover else None))
            at += length

    def add(self, doc, start: int, ids: bytes, total: int) -> None:
        while ids:
            n = len(ids) // 4
            if n >= self.size:
                self._emit([(doc, start, ids[: 4 * self.size], total)], False)
                ids, start = ids[4 * self.size :], start + self.size
                continue
            fits = [(self.size - used - n, i) for i, (used, _) in enumerate(self.open) if used + n <= self.size]
            if fits:
                room, i = min(fits)
                used, pieces = self.open[i]
                pieces.append((doc, start, ids, total))
                self.open[i] = (used + n, pieces)
                if not room:
                    self._emit(self.open.pop(i)[1], False)
                return
            if len(self.open) < self.slots:
                self.open.append((n, [(doc, start, ids, total)]))
                return
            i = max(range(len(self.open)), key=lambda k: self.open[k][0])
            used, pieces = self.open.pop(i)
            gap = self.size - used
            if gap >= self.least:
                pieces.append((doc, start, ids[: 4 * gap], total))
                ids, start = ids[4 * gap :], start + gap
            self._emit(pieces, False)

    def close(self, leftover: bool) -> None:
        for _, pieces in self.open:
            self._emit(pieces, leftover)
        self.open = []

    def take(self, schema: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*self.done)) or [()] * 9
        self.done = []
        return pa.RecordBatch.from_arrays([pa.array(columns[i], f.type) for i, f in enumerate(schema)], schema=schema)


def _identities(step: int) -> Callable[[], int]:
    """Sequence ids that no other task of this step (0: packing, 1: merge) gives out."""
    base = [((TaskContext.get().partitionId() * 2 + step) << 34) - 1]

    def nxt() -> int:
        base[0] += 1
        return base[0]

    return nxt


_ARROW_PIECE = pa.schema([(c.split()[0], pa.int64()) for c in PIECE.split(", ")])
_ARROW = _ARROW_PIECE.append(pa.field("leftover", pa.bool_())).append(pa.field("ids", pa.binary()))
_ENCODERS: dict[tuple, Callable[[str], bytes]] = {}


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    size: int = 2048,
    end_id: int = 1,
    slots: int = 16,
    least_cut: int = 16,
    merge_width: int = 32,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Packs every document's ids (end_id after each document) into sequences of at most size ids.

    Each partition streams its documents through `slots` open windows, so its memory does not grow with its rows.
    Documents of size ids or more give whole sequences first; the rest is placed best-fit. If it fits no open window,
    the fullest is completed with its first ids (a gap under least_cut is left as padding) and given out. At the end
    the leftover windows of up to merge_width partitions are packed together by the same rule, ids and all, in
    parallel; only the last windows of each merge stay unfilled, and those are filled up to one.

    Returns one row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Each id of a
    document lies in exactly one piece. Null or empty text: only end_id, one piece. Null doc_id: kept. Repeated rows
    are documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, end_id)
        encode = _ENCODERS.get(key) or _ENCODERS.setdefault(key, byte_tokens(tokenizer_path, end_id))
        w = _Windows(size, slots, least_cut, _identities(0))
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text or "")
                w.add(doc, 0, ids, len(ids) // 4)
            yield w.take(_ARROW)
        w.close(leftover=True)
        yield w.take(_ARROW)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = _Windows(size, slots, 1, _identities(1))
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
                w.add(*row)
            yield w.take(_ARROW_PIECE)
        # The windows still open now fill each other up, so at most one of them stays short.
        last = _Windows(size, 1, 1, w.ident)
        for _, pieces in sorted(w.open, key=lambda x: -x[0]):
            for p in pieces:
                last.add(*p)
        last.close(leftover=False)
        yield last.take(_ARROW_PIECE)

    columns = [c.split()[0] for c in PIECE.split(", ")]
    # Tokenizing is the costly part, and two consumers follow: written once.
    first = materialise(slim.mapInArrow(stream, WITH_IDS))
    origin = F.shiftright("sequence_id", 35)
    origins = first.where("leftover").select(origin).distinct().count()
    rest = (
        first.where("leftover")
        .select("doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset")
        .repartition(max(1, -(-origins // merge_width)), origin)
        .sortWithinPartitions("sequence_id", "offset")
        .mapInArrow(merge, PIECE)
    )
    return first.where("NOT leftover").select(*columns).unionByName(rest)
