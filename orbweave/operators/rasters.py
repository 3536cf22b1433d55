"""Rasters as pixel tables (row, col and one column a band): band arithmetic, terrain, sampling, zones."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.quantiles import quantiles
from orbweave.sources.io import materialized

#: The usual formulas of spectral indices over bands named blue, green, red, rededge, nir, swir1, swir2.
INDICES = {
    "ndvi": "try_divide(nir - red, nir + red)",
    "evi": "try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1)",
    "savi": "try_divide(1.5 * (nir - red), nir + red + 0.5)",
    "gndvi": "try_divide(nir - green, nir + green)",
    "arvi": "try_divide(nir - (2 * red - blue), nir + (2 * red - blue))",
    "ndre": "try_divide(nir - rededge, nir + rededge)",
    "ndwi": "try_divide(green - nir, green + nir)",
    "mndwi": "try_divide(green - swir1, green + swir1)",
    "ndbi": "try_divide(swir1 - nir, swir1 + nir)",
    "bsi": "try_divide((swir1 + red) - (nir + blue), (swir1 + red) + (nir + blue))",
    "nbr": "try_divide(nir - swir2, nir + swir2)",
    "ndsi": "try_divide(green - swir1, green + swir1)",
    "ci": "try_divide(red - green, red + green)",
    "lai": "3.618 * try_divide(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1) - 0.118",
    "ndmi": "try_divide(nir - swir1, nir + swir1)",
}


def band_math(pixels: DataFrame, out: str, expression: str) -> DataFrame:
    """A band from SQL over the others (try_divide where a divisor may be 0); what is not finite is null."""
    x = F.expr(expression).cast("double")
    return pixels.withColumn(out, F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x))


def spectral_index(pixels: DataFrame, name: str, out: str | None = None) -> DataFrame:
    return band_math(pixels, out or name, INDICES[name])


def _neighbours(pixels: DataFrame, value: str) -> DataFrame:
    """Each pixel with the values next to it in the four directions, null where no pixel is: one shuffle, no window over missing pixels."""
    steps = {"here": (0, 0), "left": (0, 1), "right": (0, -1), "up": (1, 0), "down": (-1, 0)}
    each = F.explode(F.array(*(F.struct((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.lit(k).alias("from"), F.col(value).alias("v")) for k, (dr, dc) in steps.items())))
    sent = pixels.select(each.alias("p")).select("p.*")
    near = sent.groupBy("row", "col").agg(F.max(F.col("from") == "here").alias("real"), *(F.max(F.when(F.col("from") == k, F.col("v"))).alias(k) for k in steps))
    return near.where("real").drop("real")


def terrain(pixels: DataFrame, value: str, cell: float = 1.0) -> DataFrame:
    """row, col, slope and aspect in degrees: central differences, one-sided where a neighbour is missing.

    Aspect is the compass direction (0 north, 90 east) in which the surface falls; flat pixels have none.
    Rows count southward.
    """

    def gradient(lo: str, hi: str) -> Column:
        a, b, h = F.col(lo), F.col(hi), F.col("here")
        return F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b - h).when(b.isNull(), h - a).otherwise((b - a) / 2) / cell

    g = _neighbours(pixels, value).select("row", "col", gradient("left", "right").alias("dx"), gradient("up", "down").alias("dy"))
    aspect = F.pmod(F.degrees(F.atan2(-F.col("dx"), F.col("dy"))) + 360, F.lit(360.0))
    return g.select("row", "col", F.degrees(F.atan(F.hypot("dx", "dy"))).alias("slope"), F.when((F.col("dx") != 0) | (F.col("dy") != 0), aspect).alias("aspect"))


def sample(points: DataFrame, pixels: DataFrame, origin: tuple[float, float], cell: float, bands: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Points with the bands of the pixel they fall in (null off the raster); origin is the upper left corner."""
    at = points.withColumns({"_r": F.floor((origin[1] - F.col(y)) / cell), "_c": F.floor((F.col(x) - origin[0]) / cell)})
    p = pixels.select(F.col("row").alias("_pr"), F.col("col").alias("_pc"), *bands)
    return at.join(p, (F.col("_r") == F.col("_pr")) & (F.col("_c") == F.col("_pc")), "left").drop("_r", "_c", "_pr", "_pc")


def zonal(pixels: DataFrame, zones: dict[str, Column], value: str) -> DataFrame:
    """Count, least, largest and mean value of the pixels of each zone, zones given as columns over row and col."""
    return pixels.groupBy(*(c.alias(k) for k, c in zones.items())).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean"))


def band_stats(pixels: DataFrame, bands: list[str]) -> DataFrame:
    """One row per band: pixels with a value, least, largest, mean and deviation."""
    row = pixels.agg(*(F.struct(F.count(b).alias("n"), F.min(b).cast("double").alias("low"), F.max(b).cast("double").alias("high"), F.avg(b).alias("mean"), F.stddev_pop(b).alias("sd")).alias(b) for b in bands))
    each = F.array(*(F.struct(F.lit(b).alias("band"), *(F.col(f"`{b}`.{c}").alias(c) for c in ("n", "low", "high", "mean", "sd"))) for b in bands))
    return row.select(F.explode(each).alias("x")).select("x.*")


def band_percentiles(pixels: DataFrame, bands: list[str], shares: list[float]) -> DataFrame:
    """band and ``q``, the exact percentiles of each band's values; nulls do not count."""
    stacked = pixels.select(F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in bands))).alias("x")).select("x.*")
    return quantiles(stacked, "v", shares, ["band"])


def cluster_pixels(pixels: DataFrame, bands: list[str], classes: int = 5, rounds: int = 40) -> DataFrame:
    """Each pixel with ``class``, from 1 by rising mean of the first band (then the others): k-means of its bands; pixels with a null band have none."""
    there = materialized(pixels.where(reduce(lambda a, b: a & b, (F.col(b).isNotNull() for b in bands))))
    empty = pixels.withColumn("class", F.lit(None).cast("int"))
    if there.isEmpty():
        return empty
    vectors = VectorAssembler(inputCols=bands, outputCol="_v").transform(there)
    model = KMeans(k=classes, maxIter=rounds, seed=42, featuresCol="_v", predictionCol="_c").fit(vectors)
    order = sorted(range(len(model.clusterCenters())), key=lambda i: tuple(model.clusterCenters()[i]))  # one row a class
    number = F.array(*(F.lit(order.index(i) + 1) for i in range(len(order))))
    found = model.transform(vectors).withColumn("class", F.get(number, F.col("_c"))).select(*pixels.columns, "class")
    return found.unionByName(empty.where(reduce(lambda a, b: a | b, (F.col(b).isNull() for b in bands))))


def class_statistics(classified: DataFrame, bands: list[str]) -> DataFrame:
    """class, pixels, percent of all classified pixels, and the mean of each band."""
    there = classified.where("class IS NOT NULL")
    whole = there.agg(F.count("*").alias("_all"))
    each = there.groupBy("class").agg(F.count("*").alias("pixels"), *(F.avg(b).alias(f"mean_{b}") for b in bands)).crossJoin(F.broadcast(whole))  # one row
    return each.select("class", "pixels", (F.col("pixels") * 100 / F.col("_all")).alias("percent"), *(f"mean_{b}" for b in bands))


def composite(stacks: list[DataFrame], value: str) -> DataFrame:
    """Pixels of several rasters of one grid as one: count and mean of what each has there."""
    return reduce(DataFrame.unionByName, (s.select("row", "col", value) for s in stacks)).groupBy("row", "col").agg(F.count(value).alias("n"), F.avg(value).alias(value))


def cell_rings(pixels: DataFrame, origin: tuple[float, float], cell: float) -> DataFrame:
    """Pixels with their square as a ring column, corners anticlockwise; origin is the upper left corner."""
    x0, y1 = origin[0] + F.col("col") * cell, origin[1] - F.col("row") * cell
    corner = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return pixels.withColumn("ring", F.array(corner(x0, y1 - cell), corner(x0 + cell, y1 - cell), corner(x0 + cell, y1), corner(x0, y1)))
