"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Few edges are held in so many partitions, and in more beyond so many edges for each of these.
FEW_PARTS, PART_EDGES = 32, 1 << 14


def _gathered(edges: DataFrame, n: int) -> DataFrame:
    """edges, at most n of them, in fewer partitions than a shuffle makes, if that is enough: each partition is a task, its
    shuffle files and a file of the round's table, however few rows it has. Nothing is shuffled for it."""
    parts = max(FEW_PARTS, -(-n // PART_EDGES))
    return edges.coalesce(parts) if parts < int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) else edges


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _gathered(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
    return _gathered(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """edges: u > v in every row."""
    least = _gathered(edges.groupBy("u").agg(F.min("v").alias("m")), n)
    linked = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _gathered(linked.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), n)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(u long, v long): component is the smallest node reachable.

    Each round keeps at most as many edges as there were, whatever a node's degree, and the number of
    rounds grows with the logarithm of the longest chain. Self-loops and nulls are dropped; no edges
    give no rows. Each round's edges are written to the shared folder, so a lost executor costs one round.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = written(now, "edges"), None
    for _ in range(most_rounds):
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if said[0] == 0 or said == before:
            break
        before, now = said, written(_small_star(_large_star(now, said[0]), said[0]), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
