"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to the smallest node that it knows."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("least").alias("a"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of them. Edges come with a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("least"))
    moved = edges.join(least, "b").select(F.col("a").alias("b"), F.col("least").alias("a"))
    return moved.unionByName(least.select("b", F.col("least").alias("a"))).filter("a < b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge table (a long, b long); root: the smallest node of its component.

    The edges stay in Spark; the driver sees their number and a checksum for each round. A round cuts the lineage with a
    table in the shared folder. Null nodes and self links are left out; repeated edges change nothing.
    """
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    seen = None
    while True:
        digest = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if digest == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        if digest["n"] == 0:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = digest
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "edges")
