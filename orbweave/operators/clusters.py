"""Clusters of points, patches of pixels, and fronts of candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.graph import components
from orbweave.sources.io import materialized


def _near(points: DataFrame, key: str, eps: float, x: str, y: str) -> DataFrame:
    """(a, b) of all places within eps of each other, a itself among them, by cells of eps and the eight around."""
    p = points.select(F.col(key).alias("a"), F.col(x).alias("x"), F.col(y).alias("y")).withColumns({"_i": F.floor(F.col("x") / eps), "_j": F.floor(F.col("y") / eps)})
    around = F.explode(F.array(*(F.struct((F.col("_i") + i).alias("i"), (F.col("_j") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    q = p.select(F.col("a").alias("b"), F.col("x").alias("x2"), F.col("y").alias("y2"), around.alias("c"))
    d = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    return p.join(q, (F.col("_i") == F.col("c.i")) & (F.col("_j") == F.col("c.j"))).where(d <= eps * eps).select("a", "b")


def dbscan(points: DataFrame, key: str, eps: float, least: int, x: str = "x", y: str = "y") -> DataFrame:
    """(key, cluster): the least key among a cluster's core points, -1 for noise; a border point goes to the smallest cluster in reach.

    Rows at one place are one weighted place first, so copies cost nothing; work is the number of pairs of distinct
    places within eps. Rows with a null coordinate are noise.
    """
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    places = materialized(points.where(there).groupBy(x, y).agg(F.min(key).alias("_k"), F.count("*").alias("_w")))
    near = materialized(_near(places, "_k", eps, x, y))
    core = near.join(places.select(F.col("_k").alias("b"), "_w"), "b").groupBy("a").agg(F.sum("_w").alias("_n")).where(F.col("_n") >= least).select(F.col("a").alias("id"))
    core = materialized(core)
    links = near.where("a < b").join(core.withColumnRenamed("id", "a"), "a", "left_semi").join(core.withColumnRenamed("id", "b"), "b", "left_semi")
    of = components(core, links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    border = near.join(of.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("_k")).agg(F.min("component").alias("_near"))
    got = places.join(border, "_k", "left").join(of.withColumnRenamed("id", "_k"), "_k", "left")
    got = got.select(x, y, F.coalesce("component", "_near", F.lit(-1)).cast("long").alias("cluster"))
    return points.select(key, x, y).join(got, [x, y], "left").select(key, F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def patches(pixels: DataFrame, value: str) -> DataFrame:
    """Pixels (row, col, value) with the patch they are in: equal values that touch by a side; patches have the least pixel number of their own."""
    bounds = pixels.agg(F.min("row").alias("_r0"), F.min("col").alias("_c0"), F.max("col").alias("_w"))  # one row
    number = (F.col("row") - F.least("_r0", F.lit(0))) * (F.col("_w") - F.least("_c0", F.lit(0)) + 1) + F.col("col") - F.least("_c0", F.lit(0))
    p = materialized(pixels.where(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).withColumn("id", number.cast("long")).drop("_r0", "_c0", "_w"))
    there = p.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col(value).alias("_v"), F.col("id").alias("dst"))
    next_to = p.select("id", value, F.explode(F.array(F.struct(F.col("row").alias("r"), (F.col("col") + 1).alias("c")), F.struct((F.col("row") + 1).alias("r"), F.col("col").alias("c")))).alias("n"))
    links = next_to.join(there, (F.col("n.r") == F.col("_r")) & (F.col("n.c") == F.col("_c")) & (F.col(value) == F.col("_v"))).select(F.col("id").alias("src"), "dst")
    return p.join(components(p, links), "id").select("row", "col", value, F.col("component").alias("patch"))


def landscape(patched: DataFrame, cell: float = 1.0) -> DataFrame:
    """One row per class: patches, largest patch in percent of all pixels, patches a unit of area, from the result of ``patches``."""
    each = patched.groupBy(*[c for c in patched.columns if c not in ("row", "col", "patch")], "patch").agg(F.count("*").alias("_n"))
    by = [c for c in each.columns if c not in ("patch", "_n")]
    whole = each.agg(F.sum("_n").alias("_all"))
    out = each.groupBy(*by).agg(F.count("*").alias("patches"), F.max("_n").alias("_most")).crossJoin(F.broadcast(whole))  # one row
    return out.select(*by, "patches", (F.col("_most") * 100 / F.col("_all")).alias("largest_percent"), (F.col("patches") / (F.col("_all") * cell * cell)).alias("density"))


def fronts(df: DataFrame, key: str, goals: list[str], most: int) -> DataFrame:
    """(key, front): 0 for rows that none beats in every goal (smaller is better), then 1 for those beaten only by these, up to ``most`` fronts.

    A front is found by the skyline of what is left and written before the next one is looked for.
    """
    from orbweave.operators.relational import skyline

    left = df.select(key, *goals).dropna()
    found = []
    for k in range(most):
        front = materialized(skyline(left, key, [], goals).select(key))
        if front.isEmpty():
            break
        found.append(front.withColumn("front", F.lit(k)))
        left = materialized(left.join(front, key, "left_anti"))
    return reduce(DataFrame.unionAll, found) if found else left.select(key, F.lit(0).alias("front"))


def crowding(df: DataFrame, front: str, key: str, goals: list[str]) -> DataFrame:
    """Each row with its crowding distance within its front: per goal the gap between its neighbours over the front's range; infinite at the ends."""
    gaps = []
    for c in goals:
        by, whole = Window.partitionBy(front).orderBy(c, key), Window.partitionBy(front)
        before, after = F.lag(c).over(by), F.lead(c).over(by)
        wide = F.max(c).over(whole) - F.min(c).over(whole)
        gaps.append(F.when(before.isNull() | after.isNull(), F.lit(float("inf"))).otherwise(F.coalesce(F.try_divide(after - before, wide), F.lit(0.0))))
    return df.withColumn("crowding", reduce(lambda a, b: a + b, gaps))
