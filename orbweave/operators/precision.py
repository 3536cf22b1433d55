"""How far measured places lie from reference places, and how much neighbours' vectors agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.functions.expressions import cosine
from orbweave.operators.quantiles import quantiles
from orbweave.operators.spatial import nearest
from orbweave.sources.io import materialized


def offsets(measured: DataFrame, reference: DataFrame, key: str, same_key: bool = False, size: float = 100.0, degrees: bool = False) -> DataFrame:
    """key, reference_key and distance of each measured place (key, x, y) to the reference place of its key, or to the nearest one (ties to the smaller key).

    ``degrees``: x and y are degrees, and the distance is in metres with 111,320 cos(y) and 110,540 a degree. Places with a null coordinate, and keys that the reference lacks, have no row.
    """
    m, r = (df.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna() for df in (measured, reference))
    if same_key:
        pairs = m.join(r.select(key, F.col("x").alias("r_x"), F.col("y").alias("r_y")), key).withColumn(f"r_{key}", F.col(key))
    else:
        met = nearest(m, r, key, size)
        one = met.where("distance IS NOT NULL").groupBy(key, "x", "y").agg(F.min(F.struct(f"r_{key}", "r_x", "r_y")).alias("_r"))
        pairs = one.select(key, "x", "y", F.col(f"_r.r_{key}").alias(f"r_{key}"), F.col("_r.r_x").alias("r_x"), F.col("_r.r_y").alias("r_y"))
    dx, dy = F.col("x") - F.col("r_x"), F.col("y") - F.col("r_y")
    if degrees:
        dx, dy = dx * 111_320 * F.cos(F.radians("y")), dy * 110_540
    return pairs.select(key, F.col(f"r_{key}").alias("reference_key"), F.sqrt(dx * dx + dy * dy).alias("distance"))


def accuracy(found: DataFrame, tolerance: float, fine: float = 0.05, fair: float = 0.10) -> DataFrame:
    """One row over the result of ``offsets``: n, mean, median, largest, rmse, how many lie within the tolerance, and the grade of the rmse (high, medium, low); nulls for no rows."""
    kept = materialized(found.select("distance"))
    d = F.col("distance")
    one = kept.agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.max(d).alias("largest"), F.sqrt(F.avg(d * d)).alias("rmse"), F.count_if(d <= tolerance).alias("within"))
    row = one.crossJoin(F.broadcast(quantiles(kept, "distance", [0.5]).select(F.col("q")[0].alias("median"))))  # single rows
    return row.withColumn("grade", F.when(F.col("rmse") <= fine, "high").when(F.col("rmse") <= fair, "medium").when(F.col("rmse").isNotNull(), "low"))


def coherence(vectors: DataFrame, edges: DataFrame, key: str, vector: str) -> DataFrame:
    """key, neighbours, coherence: the mean cosine of a row's vector with those of its neighbours (src, dst); rows without neighbours, or with null vectors, have no row."""
    v = vectors.where(F.col(vector).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_v"))
    a, b = v.select(F.col("_k").alias("src"), F.col("_v").alias("_a")), v.select(F.col("_k").alias("dst"), F.col("_v").alias("_b"))
    met = edges.select("src", "dst").where("src <> dst").distinct().join(a, "src").join(b, "dst")
    return met.groupBy(F.col("src").alias(key)).agg(F.count("*").alias("neighbours"), F.avg(cosine(F.col("_a"), F.col("_b"))).alias("coherence"))
