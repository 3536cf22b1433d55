"""Connected components by alternating large-star and small-star rounds on edge tables.

A round moves each edge's larger end to the smallest neighbour of its other end; rounds
stop when the edges are stars. Every round is two aggregations and joins whose
small side has one row per vertex, so a hub's edges may be split among tasks; each round's
edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm._io import cut


def _settled(edges: DataFrame) -> bool:
    """Whether the edges (a > b) are stars already: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("b"), F.lit(0), F.lit(1)))
    return ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every vertex of an edge with the smallest id that it is connected to."""
    edges = cut(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    while not _settled(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionAll(least.select("a", F.col("m").alias("b")))
        edges = cut(small.distinct())
    return edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
