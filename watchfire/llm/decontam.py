"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfire.llm.common import slices
from watchfire.llm.wordhash import WordHashes, window_hashes

_MARKS = re.compile(r"[\W_]+")


class Tokens(WordHashes):
    """A token is a word in lower case without its marks; a word of marks alone is none (0)."""

    @staticmethod
    def hash(word: bytes) -> int:
        bare = _MARKS.sub("", word.decode("utf-8", "replace").lower())
        return WordHashes.hash(bare.encode()) or 1 if bare else 0

    def text(self, text: str | None) -> np.ndarray:
        h = self.of(text.encode("utf-8", "replace").split()) if text else np.empty(0, np.uint64)
        return h[h > 0]


_TOKENS = Tokens()


def tile(item: list[int], doc: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (item start, document start, length): again and again the longest matches of tokens that are not yet in a
    tile, down to `least` tokens; first in the item, then in the document, goes first.

    Windows of the search length are compared by a running hash (Karp-Rabin), equal ones in full; a match is extended
    as far as it goes. The search length halves until it is `least`; it jumps up where matches turn out far longer.
    """
    base, mod = 1_000_003, (1 << 61) - 1
    free_i, free_d = bytearray(b"\x01") * len(item), bytearray(b"\x01") * len(doc)
    tiles: list[tuple[int, int, int]] = []

    def windows(seq: list[int], free: bytearray, n: int) -> Iterator[tuple[int, int]]:
        top, h, run = pow(base, n - 1, mod), 0, 0
        for k, c in enumerate(seq):
            if not free[k]:
                h = run = 0
                continue
            if run == n:
                h = (h - seq[k - n] * top) % mod
                run -= 1
            h = (h * base + c) % mod
            run += 1
            if run == n:
                yield h, k - n + 1

    n = max(least, min(len(item), len(doc)))
    while True:
        at: dict[int, list[int]] = {}
        for h, k in windows(item, free_i, n):
            at.setdefault(h, []).append(k)
        matches = []
        for h, d in windows(doc, free_d, n) if at else ():
            for i in at.get(h, ()):
                if item[i : i + n] != doc[d : d + n]:
                    continue
                e = n
                while i + e < len(item) and d + e < len(doc) and item[i + e] == doc[d + e] and free_i[i + e] and free_d[d + e]:
                    e += 1
                matches.append((-e, i, d))
        if not matches:
            if n == least:
                return tiles
            n = max(least, n // 2)
            continue
        matches.sort()
        if -matches[0][0] > 2 * n:
            n = -matches[0][0]
            continue
        # The first is always free; what overlaps a new tile is searched again for its free part.
        for e, i, d in matches:
            e = -e
            if all(free_i[i : i + e]) and all(free_d[d : d + e]):
                free_i[i : i + e] = free_d[d : d + e] = bytes(e)
                tiles.append((i, d, e))


def covered_by_tiles(item: np.ndarray, doc: np.ndarray, seeds: np.ndarray, least: int, need: float) -> float:
    """Share of the item's tokens in tiles; 0 if the shared seeds cannot reach `need`. seeds: the document's windows."""
    own = window_hashes(item, least)
    lit = np.isin(own, seeds)
    cover = np.zeros(len(item), bool)
    for k in range(least):
        cover[k : k + len(lit)] |= lit
    if cover.sum() < need * len(item):
        return 0.0
    near = np.zeros(len(doc), bool)
    hit = np.isin(seeds, own)
    for k in range(least):
        near[k : k + len(hit)] |= hit
    # Tiles lie within runs of shared windows; a token of its own after each run keeps them apart.
    seq: list[int] = []
    at = np.flatnonzero(near)
    for a, b in zip(at.tolist(), [-1, *at.tolist()]):
        if seq and a != b + 1:
            seq.append(-1)
        seq.append(int(doc[a]))
    return sum(t[2] for t in tile([int(x) for x in item], seq, least)) / len(item)


Block = tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]


def _item_blocks(benchmark: DataFrame, least: int, max_tokens: int, item_col: str, item_text: str) -> Iterator[Block]:
    """(items with their tokens, sorted seeds, the seeds' items) for one block of items after another, each of about
    max_tokens tokens at most, so that neither driver nor executors hold more than that."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // max_tokens))
    for k in range(blocks):
        block = [
            (r[0], t)
            for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator()
            if len(t := _TOKENS.text(r[1])) >= least
        ]
        if block:
            seeds = np.concatenate([window_hashes(t, least) for _, t in block])
            owner = np.concatenate([np.full(len(t) - least + 1, i, np.int64) for i, (_, t) in enumerate(block)])
            order = np.argsort(seeds, kind="stable")
            yield block, seeds[order], owner[order]


def _covered(text: str | None, shared: Block, least: int, threshold: float) -> Iterator[tuple[int, float]]:
    """(item, coverage) of the block's items that the text tiles by the threshold or more."""
    block, seeds, owner = shared
    tokens = _TOKENS.text(text)
    own = window_hashes(tokens, least)
    if not len(own):
        return
    at = np.searchsorted(seeds, own)
    at[at == len(seeds)] = 0
    hits = np.unique(own[seeds[at] == own])
    if not len(hits):
        return
    a, b = np.searchsorted(seeds, hits, "left"), np.searchsorted(seeds, hits, "right")
    for i in np.unique(np.concatenate([owner[x:y] for x, y in zip(a, b)])).tolist():
        item, words = block[i]
        share = covered_by_tiles(words, tokens, own, least, threshold)
        if share >= threshold:
            yield item, share


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = 4,
    threshold: float = 0.5,
    max_tokens: int = 2_000_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, coverage) of every document that tiles a benchmark item by `threshold` or more.

    Tokens are words in lower case without marks. A document's windows of `least` tokens are joined with the items'
    (the broadcast side: blocks of at most max_tokens item tokens, a pass over docs for each block); items whose shared
    seeds could reach the threshold are tiled. Tiles need no order, so shuffled passages count in full.

    Null and empty texts, documents or items of fewer than `least` tokens, and empty tables give no rows; a null id
    is carried. Repeated rows give repeated results; items with equal texts each match. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64())])
    out = None
    for block in _item_blocks(benchmark, least, max_tokens, item_col, item_text):
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                rows = [(doc, *found) for doc, text in zip(ids, texts) for found in _covered(text, shared.value, least, threshold)]
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        found = slim.mapInArrow(search, "doc_id long, item_id long, coverage double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, coverage double")


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    least: int = 4,
    threshold: float = 0.5,
    max_tokens: int = 2_000_000,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """docs without the rows whose text tiles a benchmark item by `threshold` or more, as contaminated() has it: a pass
    for each block of items, without a shuffle. Rows are judged by their text alone, so null and repeated ids and rows
    need no rule; null texts stay. All columns, whatever their names, stay as they were."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())
    out = docs
    for block in _item_blocks(benchmark, least, max_tokens, item_col, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                keep = [next(_covered(t, shared.value, least, threshold), None) is None for t in b.column(at).to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out
