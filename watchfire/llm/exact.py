"""Exact duplicates: a minimal perfect hash over the digests of history, looked up by what is new."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfire.llm.common import materialise, shuffle_width, unused
from watchfire.llm.wordhash import mix

#: Digests of a bucket of the index, about; a bucket is built and looked up in one task.
PER_BUCKET = 50_000
#: A task forgets the digests it has counted, and writes them, beyond so many.
_MOST = 200_000
#: kind 0: a row's digest; kind 1: a task's count of a digest and its last row (winner: row of the largest id).
_ROWS = "kind int, old boolean, digest binary, doc_id long, row long, n long"
_ARROW = pa.schema([("kind", pa.int32()), ("old", pa.bool_()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())])
_INDEX = "bucket int, size long, shape array<long>, bits binary, digests binary, doc_ids array<long>, rows array<long>, counts array<long>"
_INDEX_ARROW = pa.schema([
    ("bucket", pa.int32()), ("size", pa.int64()), ("shape", pa.list_(pa.int64())), ("bits", pa.binary()), ("digests", pa.binary()),
    ("doc_ids", pa.list_(pa.int64())), ("rows", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
])
_FOUND = pa.schema([("member", pa.bool_()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64())])


class PerfectHash:
    """Distinct 32-byte digests to the numbers from 0 to their number less one, each its own.

    Levels of bit arrays: a level has two bits for each key still without a place; keys alone on their bit keep it, the
    others go to the next level, which hashes anew, until none is left. A key's number is the rank of its bit.
    """

    def __init__(self, shape: np.ndarray, bits: np.ndarray):
        """shape: bits of each level; bits: all levels, eight to a byte."""
        self.shape, self.bits = shape, bits
        self.start = np.concatenate(([0], np.cumsum(shape)))
        self.flags = np.unpackbits(bits, count=int(self.start[-1])).astype(bool)
        self.rank = np.concatenate(([0], np.cumsum(self.flags)))

    @staticmethod
    def _spot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        """keys: digests as four words each. A level mixes all four with its own number."""
        h = np.full(len(keys), level, np.uint64)
        for i in range(4):
            h = mix(h + keys[:, i] + np.uint64(0x9E3779B97F4A7C15))
        return (h % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        shape, levels, left = [], [], keys
        while len(left):
            size = max(8, 2 * len(left))
            at = cls._spot(left, len(shape), size)
            alone = np.bincount(at, minlength=size) == 1
            shape.append(size)
            levels.append(alone)
            left = left[~alone[at]]
        return cls(np.array(shape, np.int64), np.packbits(np.concatenate(levels)) if levels else np.empty(0, np.uint8))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; for what was not a key some slot or -1, so the slot's digest must be compared."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.shape.tolist()):
            at = self._spot(keys[left], level, size) + self.start[level]
            hit = self.flags[at]
            out[left[hit]] = self.rank[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out


def _words(column: pa.Array) -> np.ndarray:
    """Binaries of 32 bytes as rows of four words."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, 4)


def digests(docs: DataFrame, old: Column, id_col: str = "doc_id", text_col: str = "text", at: Column | None = None) -> DataFrame:
    """Each row's digest (SHA-256 of the UTF-8 text, A-Z made small, null as empty) and locator, and each task's distinct
    digests with count and last row, written as Parquet. old: whether a row belongs to history; at: the rows' locators
    (default: numbered)."""
    row = F.monotonically_increasing_id() if at is None else at
    slim = docs.select(F.coalesce(old, F.lit(False)).alias("old"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), row.alias("row"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[bool, bytes], tuple[int, tuple]] = {}

        def counted() -> pa.RecordBatch:
            keys, found = list(seen), list(seen.values())
            seen.clear()
            return pa.RecordBatch.from_arrays([
                pa.array([1] * len(keys), pa.int32()), pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.binary()),
                pa.array([w[0] if w[1] else None for _, w in found], pa.int64()), pa.array([w[2] for _, w in found], pa.int64()), pa.array([n for n, _ in found], pa.int64()),
            ], schema=_ARROW)

        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                # bytes.lower() changes A-Z only.
                found = [hashlib.sha256((t or b"").lower()).digest() for t in part.column("text").to_pylist()]
                for is_old, d, doc_id, row in zip(part.column("old").to_pylist(), found, part.column("doc_id").to_pylist(), part.column("row").to_pylist()):
                    n, last = seen.get((is_old, d), (0, ()))
                    seen[is_old, d] = n + 1, max(last, _place(doc_id, row))
                size = part.num_rows
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(size, np.int32)), part.column("old"), pa.array(found, pa.binary()), part.column("doc_id"),
                    part.column("row"), pa.nulls(size, pa.int64()),
                ], schema=_ARROW)
                if len(seen) > _MOST:
                    yield counted()
        if seen:
            yield counted()

    return materialise(slim.mapInArrow(digest, _ROWS))


def _place(doc_id: int | None, row: int) -> tuple[int, bool, int]:
    """In order of which row stays; a null id is below all others."""
    return (_LEAST if doc_id is None else doc_id, doc_id is not None, row)


_LEAST = -(1 << 63)


def _winner(doc_id: str = "doc_id", row: str = "row") -> Column:
    """The row that stays: largest id (nulls below all), then the last by locator."""
    return F.max(F.struct(doc_id, row))


def _bucket(digest: str, n_buckets: int) -> Column:
    """By the first four bytes, which are spread evenly whatever the texts."""
    return (F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long") % n_buckets).cast("int")


def build_index(history: DataFrame, n_buckets: int) -> DataFrame:
    """The index of history: a row a bucket with its perfect hash and, slot by slot, full digest, winner locator (id
    and row) and count. history: digest, doc_id, row, n; partial counts of a digest may come in several rows."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for b in batches:
            bucket = np.asarray(b.column("bucket"))
            cuts = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
            for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
                if at < end and bucket[at] != here and held:
                    yield _indexed(here, held)
                    held = []
                if at < end:
                    here = int(bucket[at])
                    held.append(b.slice(at, end - at))
        if held:
            yield _indexed(here, held)

    distinct = history.groupBy("digest").agg(_winner().alias("w"), F.sum("n").alias("n"))
    dealt = distinct.select(_bucket("digest", n_buckets).alias("bucket"), "digest", "w.doc_id", "w.row", "n").repartitionById(n_buckets, F.col("bucket"))
    return materialise(dealt.sortWithinPartitions("bucket").mapInArrow(build, _INDEX))


def _indexed(bucket: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(parts).combine_chunks()
    keys = np.concatenate([_words(c) for c in t.column("digest").chunks])
    hash_ = PerfectHash.of(keys)
    order = np.argsort(hash_(keys))
    return pa.RecordBatch.from_pylist([{
        "bucket": bucket, "size": len(keys), "shape": hash_.shape.tolist(), "bits": hash_.bits.tobytes(), "digests": keys[order].tobytes(),
        **{c: t.column(s).take(pa.array(order)).to_pylist() for c, s in (("doc_ids", "doc_id"), ("rows", "row"), ("counts", "n"))},
    }], schema=_INDEX_ARROW)


def _look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams of a bucket's index row followed by what is looked up. Members are added to their slot, and the slots are
    given out at the bucket's end; nonmembers are given out as they come."""
    slots = None
    for b in batches:
        bucket, kind = np.asarray(b.column("bucket")), np.asarray(b.column("order"))
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1])) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows]):
            if at == end:
                continue
            part = b.slice(at, end - at)
            if slots is not None and slots.bucket != bucket[at]:
                yield slots.found()
                slots = None
            if kind[at] == 0:
                slots = _Slots(int(bucket[at]), part.slice(0, 1).to_pylist()[0])
            elif slots is None:
                yield _batch(False, part.column("digest"), *(part.column(c) for c in ("doc_id", "row", "n")))
            else:
                yield slots.absorb(part)
    if slots is not None:
        yield slots.found()


def _batch(member: bool, digest: pa.Array, *rest: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(digest), member)), digest, *rest], schema=_FOUND)


class _Slots:
    """An index bucket in memory: PER_BUCKET digests, about."""

    def __init__(self, bucket: int, row: dict):
        self.bucket = bucket
        self.hash = PerfectHash(np.array(row["shape"], np.int64), np.frombuffer(row["bits"], np.uint8))
        self.digests = np.frombuffer(row["digests"], np.uint64).reshape(-1, 4)
        self.last = [_place(d, r) for d, r in zip(row["doc_ids"], row["rows"])]
        self.counts = np.array(row["counts"], np.int64)

    def absorb(self, part: pa.RecordBatch) -> pa.RecordBatch:
        """Adds members to their slots; returns the others."""
        keys = _words(part.column("digest"))
        slot = self.hash(keys)
        member = (slot >= 0) & (self.digests[slot] == keys).all(axis=1)  # all 32 bytes
        some = part.filter(pa.array(member))
        np.add.at(self.counts, slot[member], some.column("n").to_numpy())
        for s, d, r in zip(slot[member].tolist(), some.column("doc_id").to_pylist(), some.column("row").to_pylist()):
            self.last[s] = max(self.last[s], _place(d, r))
        rest = part.filter(pa.array(~member))
        return _batch(False, rest.column("digest"), *(rest.column(c) for c in ("doc_id", "row", "n")))

    def found(self) -> pa.RecordBatch:
        raw = self.digests.tobytes()
        digest = pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary())
        return _batch(True, digest, pa.array([d if known else None for d, known, _ in self.last], pa.int64()), pa.array([r for *_, r in self.last], pa.int64()), pa.array(self.counts))


def exact_duplicates(docs: DataFrame, old: Column | None = None, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = PER_BUCKET) -> DataFrame:
    """Groups rows of equal text (A-Z made small, null as empty) and says which one stays: that of the largest id.

    old marks the rows of history (default: ids up to the middle of the range of ids). The distinct digests of history
    get a minimal perfect hash, in buckets of about per_bucket digests by their first bytes; a slot holds the full digest,
    the winner's locator and a count. Digests of new rows, counted in each task first, are dealt by bucket and streamed
    against it: all 32 bytes equal means a member, which is added to the slot; nonmembers are grouped separately. Every
    row then gets its group's result; groups of one need none, the largest groups (each over a thousandth of the rows, so
    a thousand at most) are broadcast, and the others are joined. No text is shuffled, and no task holds a group's rows.

    Returns one row for each input row: doc_id, keep_id, group_size, kept, text_sha256. Null ids are below all others.
    Rows that share largest id and text are one group, of which just one row (the last by position) is kept. An empty
    table gives no rows. Equal SHA-256 of the normalised text counts as equal text. Other columns are ignored.
    """
    rows, groups = _grouped(docs, old, id_col, text_col, per_bucket)
    return _joined(rows, groups).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, old: Column | None = None, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = PER_BUCKET) -> DataFrame:
    """docs without the rows that exact_duplicates() does not keep, all columns as they are. docs is written once, so that
    locators fit the rows."""
    mark, old_mark = (unused(docs.columns, c) for c in ("at", "old"))
    middle = _middle(docs, id_col) if old is None else old
    stored = materialise(docs.withColumns({mark: F.monotonically_increasing_id(), old_mark: middle}))
    rows, groups = _grouped(stored.select(F.col(old_mark).alias("old"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(mark).alias("at")), F.col("old"), "id", "text", per_bucket, F.col("at"))
    lost = _joined(rows, groups).where("row <> keep_row").select(F.col("row").alias(mark))
    return stored.join(lost, mark, "left_anti").drop(mark, old_mark)


def _middle(docs: DataFrame, id_col: str) -> Column:
    """Whether an id is in the lower half of the range of ids; two numbers come to the driver."""
    least, most = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    return F.col(id_col).cast("long") <= F.lit(0 if least is None else (least + most) // 2)


def _grouped(docs: DataFrame, old: Column | None, id_col: str, text_col: str, per_bucket: int, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, row, digest; groups: digest, keep_id, keep_row, group_size of groups of two or more)."""
    written = digests(docs, _middle(docs, id_col) if old is None else old, id_col, text_col, at)
    rows, counts = written.where("kind = 0").select("doc_id", "row", "digest"), written.where("kind = 1").select("old", "digest", "doc_id", "row", "n")
    n_old = counts.where("old").count()
    n_buckets = max(shuffle_width(docs.sparkSession), -(-n_old // per_bucket))
    index = build_index(counts.where("old").drop("old"), n_buckets)
    new = counts.where("NOT old").select(
        _bucket("digest", n_buckets).alias("bucket"), F.lit(1).alias("order"), "digest", "doc_id", "row", "n", *(F.lit(None).cast(t).alias(c) for c, t in _columns(_INDEX)[1:])
    )
    slots = index.select("bucket", F.lit(0).alias("order"), *(F.lit(None).cast(t).alias(c) for c, t in _columns(_ROWS)[2:]), *(c for c, _ in _columns(_INDEX)[1:]))
    found = materialise(
        slots.unionByName(new).repartitionById(n_buckets, F.col("bucket")).sortWithinPartitions("bucket", "order").mapInArrow(_look_up, "member boolean, digest binary, doc_id long, row long, n long")
    )
    members = found.where("member").select("digest", F.struct("doc_id", "row").alias("w"), "n")
    others = found.where("NOT member").groupBy("digest").agg(_winner().alias("w"), F.sum("n").alias("n"))
    groups = members.unionByName(others).where("n > 1").select("digest", F.col("w.doc_id").alias("keep_id"), F.col("w.row").alias("keep_row"), F.col("n").alias("group_size"))
    return rows, materialise(groups)


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split(" ")) for c in schema.split(", ")]


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with keep_id, keep_row and group_size."""
    large = rows.count() // 1000
    hot = groups.where(F.col("group_size") > large).withColumns({f"hot_{c}": F.col(c) for c in ("keep_id", "keep_row", "group_size")}).select("digest", "hot_keep_id", "hot_keep_row", "hot_group_size")
    once = rows.join(F.broadcast(hot), "digest", "left")
    found = F.col("hot_group_size").isNotNull()
    rest = once.where(~found).select("doc_id", "row", "digest").join(groups.where(F.col("group_size") <= large), "digest", "left")
    alone = F.col("group_size").isNull()
    return once.where(found).select("doc_id", "row", "digest", *(F.col(f"hot_{c}").alias(c) for c in ("keep_id", "keep_row", "group_size"))).unionByName(
        rest.select("doc_id", "row", "digest", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(alone, F.col("row")).otherwise(F.col("keep_row")).alias("keep_row"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    )
