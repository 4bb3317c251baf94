"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchfire.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least node among its neighbours and itself. Edges may repeat, at
    most as many as came in; the small star makes them distinct."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (u, v): component is the least node reachable.

    A round is one large-star and one small-star step; the edges become stars around the least nodes, and when a round
    changes nothing they are. Each round is written to the shared folder, which cuts the lineage. Rounds grow with the
    logarithm of the longest path. Loops and repeated edges are allowed; null ends are dropped; no edges give no rows.
    """
    kept = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct()
    mark, before = None, None
    for _ in range(most_rounds):
        kept = before = materialise(_small_star(_large_star(kept)), replaces=before)
        row = kept.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not row[0] or (row[0], row[1]) == mark:
            break
        mark = (row[0], row[1])
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
