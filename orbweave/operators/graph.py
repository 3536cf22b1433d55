"""Graphs as tables of edges: neighbours, paths, degrees, components, communities, centrality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.sources.io import materialized


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst").where("src <> dst")
    return e.union(e.select("dst", "src")).toDF("src", "dst").distinct()


def hops(edges: DataFrame, start: DataFrame, k: int) -> DataFrame:
    """(id, hop) of what can be reached within k steps, with the fewest steps; start holds ids."""
    return reach(materialized(undirected(edges)), start, k)


def degrees(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles through each vertex; edges point from fewer to more neighbours, which bounds the wedges at hubs."""
    d = degrees(edges)
    e = undirected(edges).join(d.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = e.where((F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))).select("src", "dst")
    a, b, c = (up.select(F.col("src").alias(f"{s}1"), F.col("dst").alias(f"{s}2")) for s in "abc")
    t = a.join(b, F.col("a1") == F.col("b1")).where("a2 <> b2").join(c, (F.col("a2") == F.col("c1")) & (F.col("b2") == F.col("c2")))
    return t.select(F.explode(F.array("a1", "a2", "b2")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def reach(edges: DataFrame, start: DataFrame, depth: int, back: bool = False) -> DataFrame:
    """(id, hop) of what lies down (or, back, up) the edges' direction within ``depth`` steps of start's ids, with the fewest steps."""
    e = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if back else edges.select("src", "dst")
    seen = start.select("id").distinct().withColumn("hop", F.lit(0))
    front = seen
    for h in range(1, depth + 1):
        step = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct()
        front = materialized(step.join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(h)))
        if front.isEmpty():
            break
        seen = seen.unionAll(front)
    return seen


def shortest_path(edges: DataFrame, source: int, target: int, longest: int = 20) -> DataFrame:
    """One row (hops, path) with the fewest undirected steps from source to target, the path of least ids; no row if it is longer than ``longest``.

    Breadth first, a level at a time: a level keeps one path for each vertex, so it never holds more rows than the graph has vertices.
    """
    both = materialized(undirected(edges))
    one = both.sparkSession.range(1)
    front = one.select(F.lit(source).cast("long").alias("id"), F.array(F.lit(source).cast("long")).alias("path"))
    seen = front.select("id")
    for _ in range(longest):
        hit = front.where(F.col("id") == target)
        if not hit.isEmpty():
            break
        step = front.join(both, front["id"] == both["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        front = materialized(step.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionAll(front.select("id"))
    return front.where(F.col("id") == target).select((F.size("path") - 1).alias("hops"), "path")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each vertex's component; vertices without edges are their own.

    Every round takes the least label around, hooks the vertex that gave a label to the least its holders saw, and
    replaces each label by its vertex's own, so long chains shrink by doubling. Rounds are written to the shared
    folder; labels are rows, nothing comes to the driver.
    """
    both = materialized(undirected(edges))
    lab = vertices.select("id").distinct().withColumn("component", F.col("id"))
    while True:
        near = both.join(lab.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.min("component").alias("_near"))
        low = materialized(lab.join(near, "id", "left").select("id", F.col("component").alias("_was"), F.least("component", F.coalesce("_near", "component")).alias("_low")))
        if low.where("_low <> _was").isEmpty():
            return lab
        hook = low.groupBy(F.col("_was").alias("id")).agg(F.min("_low").alias("_to"))
        hooked = materialized(low.join(hook, "id", "left").select("id", F.least("_low", F.coalesce("_to", "_low")).alias("_low")))
        its = hooked.select(F.col("id").alias("_low"), F.col("_low").alias("component"))
        lab = materialized(hooked.join(its, "_low").select("id", "component"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label) after so many rounds of label propagation: each vertex takes its neighbours' most frequent label, ties to the smaller."""
    both = materialized(undirected(edges))
    lab = both.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id"))
    for _ in range(rounds):
        votes = both.join(lab.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"), "label").agg(F.count("*").alias("_n"))
        lab = materialized(votes.groupBy("id").agg(F.min_by("label", F.struct(-F.col("_n"), F.col("label"))).alias("label")))
    return lab


def eigenvector(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(id, centrality) by power iteration with the identity added (so that bipartite graphs settle), the largest value 1."""
    both = materialized(undirected(edges))
    x = both.select(F.col("src").alias("id")).distinct().withColumn("centrality", F.lit(1.0))
    for _ in range(rounds):
        around = both.join(x.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("centrality").alias("_s"))
        grown = x.join(around, "id").select("id", (F.col("centrality") + F.col("_s")).alias("centrality"))
        most = grown.agg(F.max("centrality").alias("_m"))
        x = materialized(grown.crossJoin(F.broadcast(most)).select("id", (F.col("centrality") / F.col("_m")).alias("centrality")))  # one row
    return x
