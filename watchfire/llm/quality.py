"""Quality: zstandard dictionaries of good and bad texts; the compressed-size difference becomes a calibrated score."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfire.llm.common import slices
from watchfire.llm.logistic import fit_logistic

#: A text is compressed in blocks of so many bytes, each against the whole dictionary, so that its length does not matter.
BLOCK = 1024
#: Features of a text: its compressed size with the bad dictionary less that with the good one, over its bytes, and
#: the mean of both over its bytes (how compressible it is at all, which the difference is judged by).
FEATURES = 2


def held_out(id_col: str = "doc_id"):
    """crc32 of the id's text mod 3 is 1: rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def train_dictionary(blocks: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of the blocks; where the trainer finds too little, their own last bytes."""
    try:
        return zstandard.train_dictionary(size, blocks).as_bytes()
    except zstandard.ZstdError:
        return b"".join(blocks)[-size:]


class Compressor:
    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.pair = [
            zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
            for d in (self._loaded(good, level), self._loaded(bad, level))
        ]

    @staticmethod
    def _loaded(data: bytes, level: int) -> zstandard.ZstdCompressionDict | None:
        if len(data) < 8:
            return None
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=level)
        return d

    def features(self, text: str | None) -> list[float]:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if not raw:
            return [0.0] * FEATURES
        n = len(raw)
        good, bad = (sum(len(c.compress(raw[i : i + BLOCK])) for i in range(0, n, BLOCK)) for c in self.pair)
        return [(bad - good) / n, (bad + good) / (2 * n)]


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: np.ndarray


def _features(docs: DataFrame, good: bytes, bad: bytes, others: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))
    schema = pa.schema([*[(c, pa.int64()) for c in others], ("x", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Compressor(*shared.value)
        for b in slices(batches):
            x = pa.array([c.features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[b.column(o) for o in others], x], schema=schema)

    return docs.select(*others, "text").mapInArrow(run, ", ".join(f"{c} long" for c in others) + ", x array<double>")


def _blocks(docs: DataFrame) -> DataFrame:
    """(quality, block, h) of all blocks of the texts, h a hash by which a sample of them can be taken."""
    schema = pa.schema([("quality", pa.int64()), ("block", pa.binary()), ("h", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for y, t in zip(b.column("y").to_pylist(), b.column("text").to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                rows += [(y, raw[i : i + BLOCK], zlib.crc32(raw[i : i + BLOCK])) for i in range(0, len(raw), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("quality").cast("long").alias("y"), "text").mapInArrow(run, "quality long, block binary, h long")


def _taken(blocks: DataFrame) -> list[bytes]:
    """The blocks in an order that does not depend on how they are dealt out; of a sample's rows, so bounded by it."""
    return sorted((bytes(r.block) for r in blocks.select("block").toLocalIterator()), key=lambda b: (zlib.crc32(b), b))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 2000, dictionary: int = 112_640) -> QualityModel:
    """Learns from at most most_rows good and most_rows bad labelled documents, those of least hash of their id, never
    from held-out ones: the only bound. Half of them (by a bit of the hash) make the dictionaries, from all blocks of their
    whole texts. The other half, whole, calibrates on sizes under dictionaries that have not seen it. docs: doc_id, text;
    labels: doc_id, quality."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("h", F.xxhash64("doc_id"))
    picked = [known.where(F.col("quality") == y).orderBy("h", "doc_id").limit(most_rows) for y in (0, 1)]
    sample = docs.select("doc_id", "text").where("text IS NOT NULL AND text <> ''").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    sample = sample.groupBy("doc_id", "quality", "h").agg(F.min("text").alias("text")).persist()
    try:
        blocks = _blocks(sample.where(F.pmod(F.shiftright("h", 7), F.lit(2)) == 0))
        bad, good = (train_dictionary(_taken(blocks.where(F.col("quality") == y)), dictionary) for y in (0, 1))
        rest = sample.where(F.pmod(F.shiftright("h", 7), F.lit(2)) == 1)
        fitted = _features(rest.select("text", F.col("quality").cast("long").alias("y")), good, bad, ["y"]).toPandas()
    finally:
        sample.unpersist()
    x = np.array(fitted["x"].tolist(), float).reshape(len(fitted), FEATURES)
    return QualityModel(good, bad, fit_logistic(x, fitted["y"].to_numpy(float)))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (probability that the text is good), predicted (1 from 0.5) for every row of docs.

    Null and empty texts have all features 0 and the score that follows. Every text is compressed whole and on its own,
    so repeated rows agree; null ids are carried; an empty table gives no rows. Other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    z = F.lit(float(model.weights[0]))
    for i in range(FEATURES):
        z = z + F.col("x")[i] * F.lit(float(model.weights[i + 1]))
    p = 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))
    x = _features(slim, model.good, model.bad, ["doc_id"])
    return x.select("doc_id", p.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
