"""Contiguous balanced shards from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchfire.llm.common import materialise, shuffle_width


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts the rows, in order of id, into n_shards contiguous shards of nearly equal bytes.

    A row's size is the UTF-8 bytes of its text plus 1 (null text: 1). Rows are range-partitioned by id without
    their texts; each partition gives its total, the running sum of the totals gives each partition's start, and a
    row's global byte position decides its shard: the one of n_shards equal byte intervals that holds the row's
    middle. So no shard is off its target by more than the row at each of its two cuts.

    Returns doc_id, size, text_crc32, shard, slot (position in the shard, gapless from 0). Null ids come first;
    rows that share an id are ordered by checksum, size and then arbitrarily, but each gets its own slot. An empty
    table gives no rows; a shard stays empty only if a neighbour's single row covers it. Other columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("__tie"),
    )
    order = ["doc_id", "text_crc32", "size", "__tie"]
    # Written once: the part number of a row is then a fact, not a result of sampling that a rerun may change.
    ranged = materialise(
        slim.repartitionByRange(max(2, shuffle_width(spark)), *order).withColumn("__part", F.spark_partition_id())
    )
    # One row for each partition: its number is the number of shuffle partitions, so it is small by construction.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.groupBy("__part")
        .agg(F.sum("size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
        .select(
            "__part",
            F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__bytes_before"),
            F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__rows_before"),
            F.sum("__bytes").over(Window.partitionBy()).alias("__total"),
        )
    )
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumns({"__upto": F.sum("size").over(within), "__nth": F.row_number().over(within)})
        .join(F.broadcast(parts), "__part")
        .withColumn("__twice_middle", 2 * (F.col("__bytes_before") + F.col("__upto")) - F.col("size"))
        .withColumn("__row", F.col("__rows_before") + F.col("__nth") - 1)
        .withColumn("shard", F.expr(f"CAST((__twice_middle * {int(n_shards)}) DIV (2 * __total) AS INT)"))
    )
    firsts = placed.groupBy("shard").agg(F.min("__row").alias("__first"))
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__row") - F.col("__first")).alias("slot")
    )
