"""Counts and sequences of large packs: rows of events with the codes of their matches, dealt out by entity and read in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchfire.functions.rules import Rule
from watchfire.operators import rule_index

#: Rows that a task looks at together, at least.
ROWS = 50_000
#: An entity's time is cut into parts of so many of the longest timeframes.
FRAMES_A_SLOT = 4
_AT = "struct<us:bigint,id:bigint>"
FOUND = f"rule int, entity_key string, at {_AT}, sequence boolean, f struct<end_us:bigint,end_id:bigint,ids:array<bigint>>"


def _key(fields: list[str], columns: list[str]) -> Column:
    """The group-by key, as detect.keyed() gives it; null where there is none."""
    if not set(fields) <= set(columns):
        return F.lit(None).cast("string")
    text = {f: F.col(f).cast("string") for f in fields}
    shown = F.concat_ws("|", *[F.when(text[f] != "0", text[f]) if f.endswith("_port") or f == "id" else text[f] for f in fields])
    whole = F.lit(True)
    for f in fields:
        whole = whole & F.coalesce(text[f] != "", F.lit(False))
    return F.when(whole, F.when(shown == "", "unknown").otherwise(shown))


class _Rows:
    """Sorted rows of entities (us, id, codes), and what rules find in them."""

    def __init__(self, rows: pa.Table, plans: list[tuple[int, int, int, int]], n_codes: int):
        self.n, self.plans = rows.num_rows, plans
        self.rows = rows = rows.combine_chunks()
        self.us = rows["us"].to_numpy()
        self.entity, part, slot = rows["entity_key"].combine_chunks(), rows["part"].to_numpy(), rows["slot"].to_numpy()
        other = (part[1:] != part[:-1]) | (slot[1:] != slot[:-1]) | pc.not_equal(self.entity[1:], self.entity[:-1]).to_numpy(zero_copy_only=False)
        self.group = np.r_[0, np.cumsum(other)] if self.n else np.empty(0, np.int64)
        kind = rule_index.code_type(n_codes)
        packed = rows["codes"].combine_chunks()
        sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False) // kind.itemsize
        ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + self.n + 1]
        codes = np.frombuffer(packed.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)
        order = np.argsort(codes, kind="stable")
        self.of_code = np.repeat(np.arange(self.n), sizes)[order]
        self.starts = np.r_[0, np.cumsum(np.bincount(codes, minlength=n_codes))]

    def _with(self, code: int) -> np.ndarray:
        return self.of_code[self.starts[code] : self.starts[code + 1]]

    def found(self, may: np.ndarray, all_starts: bool) -> Iterator[tuple[int, bool, np.ndarray]]:
        """(rule, whether it is a sequence, its windows as rows by first to last event), of each group the first one that a row
        which may starts; of sequences all of them if all_starts."""
        for rule, code, (needs, stages, frame) in ((p[0], p[1], p[2:]) for p in self.plans):
            first = self._with(code)
            if stages:
                windows = first[may[first]][:, None]
                for k in range(1, stages):
                    then = self._with(code + k)
                    at = np.searchsorted(then, windows[:, -1], "right")
                    windows = windows[at < len(then)]
                    windows = np.c_[windows, then[at[at < len(then)]]]
            else:
                windows = np.lib.stride_tricks.sliding_window_view(first, needs) if len(first) >= needs else np.empty((0, needs), np.int64)
                windows = windows[may[windows[:, 0]]]
            start, end = windows[:, 0], windows[:, -1]
            windows = windows[(self.group[start] == self.group[end]) & (self.us[end] - self.us[start] <= frame)]
            if not (stages and all_starts) and len(windows):
                group = self.group[windows[:, 0]]
                windows = windows[np.r_[True, group[1:] != group[:-1]]]
            if len(windows):
                yield rule, bool(stages), windows

    def as_batches(self, may: np.ndarray, all_starts: bool, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        ids, out = self.rows["id"].combine_chunks(), []
        for rule, sequence, windows in self.found(may, all_starts):
            first, last, n = windows[:, 0].copy(), windows[:, -1].copy(), len(windows)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * windows.shape[1]), ids.take(pa.array(windows.ravel())))
            at = pa.StructArray.from_arrays([pa.array(self.us[first]), ids.take(pa.array(first))], ["us", "id"])
            f = pa.StructArray.from_arrays([pa.array(self.us[last]), ids.take(pa.array(last)), lists], ["end_us", "end_id", "ids"])
            columns = [pa.array(np.full(n, rule, np.int32)), self.entity.take(pa.array(first)), at, pa.array(np.full(n, sequence)), f]
            out.append(pa.RecordBatch.from_arrays([c.cast(s.type) for c, s in zip(columns, schema)], schema=schema))
        # Rules find few windows each: given out together.
        yield from pa.Table.from_batches(out, schema).combine_chunks().to_batches(10_000)


def first_windows(events: DataFrame, rules: list[Rule], all_starts: bool = False) -> DataFrame:
    """(rule_id, entity_key, at, sequence, f) of count and sequence rules: the first windows of rules and entities, some of
    them not the first of all; all windows of sequences if all_starts. An event that is given twice counts twice.

    A match is no row. Events are tested once (rule_index.coded_hits()), and an event is dealt out once for each different
    group-by key, with the codes of all its matches. An entity's time is cut into slots of FRAMES_A_SLOT of the longest timeframe of
    its rules, and rows of the next slot's first timeframe are given to a slot too, since windows that begin in a slot may end
    there; so a frequent key is many tasks' work. Tasks read their rows in order of time, in parts, of which they keep the rows
    of one entity's last timeframe.

    Count: threshold matches in a row within the timeframe. Sequence: from each start the next later event of each stage,
    within the timeframe of the start.
    """
    spark = events.sparkSession
    keys = list(dict.fromkeys(tuple(r.group_by) for r in rules))
    parts = [keys.index(tuple(r.group_by)) for r in rules]
    sizes = [len(r.stages) if r.kind == "sequence" else 1 for r in rules]
    codes = [sum(sizes[:i]) for i in range(len(rules))]
    n_codes = max(1, sum(sizes))
    # (rule, its first code, threshold, stages, timeframe); a sequence of less than two stages finds nothing.
    plans = [(i, codes[i], r.threshold if r.kind == "count" else 0, sizes[i] if r.kind == "sequence" else 0, r.frame_us) for i, r in enumerate(rules) if r.kind == "count" or sizes[i] > 1]
    longest = [max([1, *(r.frame_us for r, p in zip(rules, parts) if p == k)]) for k in range(len(keys))]

    found = events.where("us IS NOT NULL").withColumn("found", rule_index.coded_hits(rules, parts, codes, n_codes))
    rows = found.select("us", "id", F.array(*[_key(list(k), events.columns) for k in keys]).alias("keys"), F.inline("found"))
    frame = F.get(F.array(*[F.lit(x).cast("long") for x in longest]), F.col("part"))
    rows = rows.withColumns({"entity_key": F.get("keys", F.col("part")), "frame": frame}).where("entity_key IS NOT NULL")
    width = F.col("frame") * FRAMES_A_SLOT
    rows = rows.withColumns({"into": F.pmod("us", width)}).withColumn("here", F.expr(f"(us - into) DIV (frame * {FRAMES_A_SLOT})"))
    ahead = F.when(F.col("into") < F.col("frame"), F.struct((F.col("here") - 1).alias("slot"), F.lit(False).alias("home")))
    places = F.array_compact(F.array(F.struct(F.col("here").alias("slot"), F.lit(True).alias("home")), ahead))
    rows = rows.select("part", "entity_key", "us", "id", "codes", F.inline(places))
    rows = rows.withColumn("dealt", F.xxhash64("part", "entity_key", "slot")).repartition("dealt").sortWithinPartitions("dealt", "part", "entity_key", "slot", "us", "id")
    schema = spark.createDataFrame([], FOUND).schema
    arrow = pa.schema([
        ("rule", pa.int32()), ("entity_key", pa.string()), ("at", pa.struct([("us", pa.int64()), ("id", pa.int64())])), ("sequence", pa.bool_()),
        ("f", pa.struct([("end_us", pa.int64()), ("end_id", pa.int64()), ("ids", pa.list_(pa.int64()))])),
    ])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        old = new = 0
        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            new += b.num_rows
            if new < max(ROWS, old):
                continue
            table = pa.Table.from_batches(kept)
            rows = _Rows(table, plans, n_codes)
            # Of the last entity more may come: what begins in its last timeframe waits.
            waits = (rows.group == rows.group[-1]) & (rows.us >= rows.us[-1] - longest[table["part"][-1].as_py()])
            yield from rows.as_batches(table["home"].to_numpy() & ~waits, all_starts, arrow)
            # Copied, so that what has been read can go.
            kept = table.take(pa.array(np.flatnonzero(waits))).combine_chunks().to_batches()
            old, new = int(waits.sum()), 0
        if kept:
            table = pa.Table.from_batches(kept)
            yield from _Rows(table, plans, n_codes).as_batches(table["home"].to_numpy(), all_starts, arrow)

    ids = F.broadcast(spark.createDataFrame(list(enumerate(r.id for r in rules)), "rule int, rule_id string"))
    return rows.mapInArrow(windows, schema).join(ids, "rule").select("rule_id", "entity_key", "at", "sequence", "f")


__all__ = ["first_windows"]
