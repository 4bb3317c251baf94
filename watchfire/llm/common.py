"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchfire.storage import new_path, remove, shared_dir, temporary

#: Words everywhere in this subpackage: maximal runs of what is not ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables that the innermost open tidy() block of this thread is to remove.
_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, all tables that materialise() wrote within it. Results must be written before."""
    mine: list[str] = []
    token = _OPEN.set((*_OPEN.get(), mine))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path in mine:
            remove(spark, path)


def materialise(df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
    """Writes df to a table in the shared folder and reads it back: a lost executor then costs no recomputation,
    and several readers of df see the same rows. Parquet keeps it columnar and compressed. replaces: an earlier such
    table that nothing but df reads; it is deleted."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path)
    if _OPEN.get():
        _OPEN.get()[-1].append(path)
    else:
        temporary(spark, path)
    if replaces is not None:
        for folder in {f.rsplit("/", 1)[0] for f in replaces.inputFiles()}:
            remove(spark, folder)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], stem: str) -> str:
    """A column name that none of the columns has, in any case of letters."""
    taken, name = {c.lower() for c in columns}, f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(col):
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, so that a task holds few texts as Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


__all__ = ["ascii_lower", "materialise", "new_path", "remove", "shared_dir", "shuffle_width", "slices", "table", "tidy", "unused"]
