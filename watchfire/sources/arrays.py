"""JSON array files of any size, read in byte ranges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.storage import written

_ESCAPE = re.compile(r"\\.", re.S)
_TOKEN = re.compile(r'\\.|["\[\]{},]', re.S)
_NOT_STRUCTURE = bytes(set(range(256)) - set(b'"[]{}'))
#: kind 0: an item; 1: text before a range's first border; 2: text after its last border; 3: a range without a border; 4: a fault.
_ITEM, _HEAD, _TAIL, _MIDDLE, _FAULT = range(5)
_PIECES = pa.schema([("file", pa.string()), ("at", pa.int64()), ("kind", pa.int32()), ("text", pa.string())])
_JSON = {"allowSingleQuotes": "false"}


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """The files' text up to each closing brace, in byte ranges that Spark deals out as it does lines: file, at (where the range
    begins), value. Rows of a range follow one another."""
    read = spark.read.option("lineSep", "}").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value", F.col("_metadata.file_size").alias("size"))


def _ranges(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, list[str], pa.RecordBatch]]:
    """(file, at, size, fragments, rows) of each range in a batch."""
    files, at, size = (batch.column(c).to_pylist() for c in ("file", "at", "size"))
    cuts = [i for i in range(1, len(at)) if at[i] != at[i - 1] or files[i] != files[i - 1]]
    for a, b in zip([0, *cuts], [*cuts, len(at)]):
        if a < b:
            yield files[a], at[a], size[a], batch.column("value").slice(a, b - a).to_pylist(), batch.slice(a, b - a)


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Of each range: whether it has an odd number of quotes, and by how much it goes deeper if it begins outside a string, and if
    inside; its bytes and fragments."""
    rows: dict[tuple[str, int], list[int]] = {}
    for b in batches:
        for file, at, size, fragments, _ in _ranges(b):
            got = rows.setdefault((file, at), [0, 0, 0, 0, 0, size])
            text = "}".join(fragments).encode() + b"}"
            marks = np.frombuffer(_ESCAPE.sub("", text.decode()).encode().translate(None, _NOT_STRUCTURE), np.uint8)
            quote = marks == 0x22
            inside = (np.cumsum(quote) + got[0]) % 2
            step = np.where(np.isin(marks, list(b"[{")), 1, -1) * ~quote
            got[0] = (got[0] + int(quote.sum())) % 2
            got[1] += int(step[inside == 0].sum())
            got[2] += int(step[inside == 1].sum())
            got[3] += len(text) - len(fragments)
            got[4] += len(fragments)
    yield pa.RecordBatch.from_pylist([{"file": f, "at": a, "odd": v[0], "outside": v[1], "inside": v[2], "bytes": v[3], "n": v[4], "size": v[5]} for (f, a), v in rows.items()],
                                     schema=pa.schema([("file", pa.string()), *((c, pa.int64()) for c in ("at", "odd", "outside", "inside", "bytes", "n", "size"))]))


def _begin(ranges: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one file in order: how deep each begins, and whether in a string. Whether the file ends with a brace follows
    from its size; the one that is added after its last fragment otherwise is taken back."""
    ranges = ranges.sort_values("at")
    extra = int(ranges["bytes"].sum() + ranges["n"].sum() > ranges["size"].iloc[0])
    depth, inside, out = 0, 0, []
    for r in ranges.itertuples():
        out.append((r.file, r.at, depth, bool(inside), extra))
        depth += r.inside if inside else r.outside
        inside ^= r.odd
    return pd.DataFrame(out, columns=["file", "at", "depth", "in_string", "extra"])


class _Range:
    """Finds the borders of the array's items in one range, from how it begins."""

    def __init__(self, depth: int, in_string: bool):
        self.depth, self.in_string, self.seen, self.closed = depth, in_string, False, False
        self.held: list[str] = []
        self.out: list[tuple[int, str]] = []

    def _border(self, text: str) -> None:
        self.out.append((_ITEM if self.seen else _HEAD, "".join([*self.held, text])))
        self.held, self.seen = [], True

    def feed(self, text: str) -> None:
        at = 0
        for m in _TOKEN.finditer(text):
            t = m[0]
            if t == '"':
                self.in_string = not self.in_string
            elif self.in_string or t[0] == "\\":
                continue
            elif t == "," and self.depth == 1:
                self._border(text[at : m.start()])
                at = m.end()
            elif t in "[{":
                if self.depth == 0:
                    before = "".join([*self.held, text[at : m.start()]])
                    if t == "{" or before.strip("\ufeff \t\r\n") or self.closed:
                        self.out.append((_FAULT, "no array"))
                    self.held, self.seen, at = [], True, m.end()
                self.depth += 1
            elif t in "]}":
                self.depth -= 1
                if self.depth == 0:
                    if t == "}":
                        self.out.append((_FAULT, "brace"))
                    self._border(text[at : m.start()])
                    at, self.closed = m.end(), True
                elif self.depth < 0:
                    if "".join([*self.held, text[at : m.start()]]).strip():
                        self.out.append((_FAULT, "text"))
                    self.out.append((_FAULT, "end"))
                    self.held, self.depth, at = [], 0, m.end()
        self.held.append(text[at:])

    def end(self) -> list[tuple[int, str]]:
        rest = "".join(self.held)
        if self.depth > 0 or rest.strip():
            self.out.append((_TAIL if self.seen else _MIDDLE, rest))
        return self.out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    here, scan = None, None

    def given(rows: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([here[0]] * len(rows), pa.string()), pa.array([here[1]] * len(rows), pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.string())], schema=_PIECES)

    for b in batches:
        for file, at, _, fragments, rows in _ranges(b):
            if (file, at) != here:
                if scan:
                    yield given(scan.end())
                here, scan = (file, at), _Range(rows.column("depth")[0].as_py(), rows.column("in_string")[0].as_py())
            scan.feed("}".join(fragments) + "}")
            yield given(scan.out)
            scan.out = []
    if scan:
        yield given(scan.end())


def _stitch(pieces: pd.DataFrame) -> pd.DataFrame:
    """The items of one file that lie over range borders, and its faults: a text behind the array, none before it, no end."""
    out, open_, file = [], None, pieces["file"].iloc[0]
    order = {_MIDDLE: 0, _HEAD: 0, _FAULT: 1, _TAIL: 2}
    for r in pieces.assign(o=pieces["kind"].map(order)).sort_values(["at", "o"]).itertuples():
        if r.kind == _HEAD:
            out.append((_ITEM, (open_ or "") + r.text))
            open_ = None
        elif r.kind == _FAULT:
            out.append((_FAULT, r.text))
        else:
            open_ = (open_ or "") + r.text
    rest = (open_ or "").strip()
    return pd.DataFrame([(file, *x) for x in out] + ([(file, _TAIL, rest)] if rest else []), columns=["file", "kind", "text"])


def read_array_items(spark: SparkSession, path: str) -> DataFrame:
    """Records (column line) of files that are one JSON array each, with their file; items that are no objects are dropped. A
    file that is no JSON array gives one row with a null line and the column problem, and no records.

    Files are read in Spark's byte ranges, so one large file is many tasks. A first pass counts, of each range, quotes and how
    much deeper it gets, once for a beginning outside a string and once for inside; from these each range's beginning follows,
    range by range. A second pass finds the items' borders; items over a border of ranges are joined from their pieces. No
    task holds more than a batch of text, an item, and a file's pieces at range borders.
    """
    fragments = _fragments(spark, path)
    counted = fragments.mapInArrow(_summarise, "file string, at long, odd long, outside long, inside long, bytes long, n long, size long")
    begin = written(counted.groupBy("file").applyInPandas(_begin, "file string, at long, depth long, in_string boolean, extra int"))
    # A row for each range of about a block of a file: small beside what is read.
    placed = fragments.join(F.broadcast(begin), ["file", "at"])
    pieces = written(placed.mapInArrow(_cut, "file string, at long, kind int, text string"))
    joined = pieces.where(F.col("kind") != _ITEM).groupBy("file").applyInPandas(_stitch, "file string, kind int, text string")
    every = pieces.where(F.col("kind") == _ITEM).select("file", "kind", "text").unionByName(joined)
    value = F.get(F.from_json(F.concat(F.lit("["), F.col("text"), F.lit("]")), "array<string>", _JSON), F.lit(0))
    blank, item = F.trim(F.regexp_replace("text", r"[\s]+", "")) == "", F.col("kind") == _ITEM
    nothing = F.regexp_replace("text", r"\s+", "") == "null"
    every = written(every.select("file", "kind", value.alias("line"), (item & blank).alias("blank"), (item & ~blank & value.isNull() & ~nothing).alias("wrong"), F.col("text").alias("rest")))
    # The brace that was added after the last fragment is all that may follow the array, if the file does not end with one.
    ends = begin.groupBy("file").agg(F.max("extra").alias("extra"))
    state = every.groupBy("file").agg(
        F.count_if(F.col("kind") == _ITEM).alias("n"), F.count_if("blank").alias("blanks"), F.count_if("wrong").alias("wrongs"), F.count_if((F.col("kind") == _FAULT) & (F.col("rest") != "end")).alias("faults"),
        F.count_if((F.col("kind") == _FAULT) & (F.col("rest") == "end")).alias("ends"), F.count_if(F.col("kind") == _TAIL).alias("tails"),
    )
    bad = (F.col("n") == 0) | (F.col("wrongs") > 0) | (F.col("faults") > 0) | (F.col("tails") > 0) | (F.col("ends") != F.col("extra")) | ((F.col("blanks") > 0) & (F.col("n") > 1))
    broken = ends.join(state, "file", "left").where(F.coalesce(bad, F.lit(True))).select("file")
    good = every.where((F.col("kind") == _ITEM) & F.col("line").startswith("{")).select("line", "file").join(broken, "file", "left_anti")
    return good.select("line", "file", F.lit(None).cast("string").alias("problem")).unionByName(broken.select(F.lit(None).cast("string").alias("line"), "file", F.lit("malformed JSON array").alias("problem")))
