"""Surfaces from points: kernel density, inverse distance, trend; resampling and flow over pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.sources.io import materialized

Grid = tuple[float, float, float, int, int]  # minx, miny, cell, columns, rows


def _spread(points: DataFrame, grid: Grid, radius: float | None, x: str, y: str) -> DataFrame:
    """Each point with the grid cells whose centres may lie within radius (all cells if None) and the squared distance ``_d2``.

    Points meet cells by generating them, so nothing is joined, and sums per cell combine before the shuffle.
    """
    minx, miny, cell, nx, ny = grid
    cells = []
    for c, lo, n in ((x, minx, nx), (y, miny, ny)):
        first, last = F.lit(0), F.lit(n - 1)
        if radius is not None:
            first = F.greatest(first, F.ceil((F.col(c) - radius - lo) / cell - 0.5).cast("int"))
            last = F.least(last, F.floor((F.col(c) + radius - lo) / cell - 0.5).cast("int"))
        cells.append(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>")))
    p = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_c", cells[0]).withColumn("_r", cells[1])
    p = p.withColumn("col", F.explode("_c")).withColumn("row", F.explode("_r"))
    dx, dy = F.col(x) - (minx + (F.col("col") + 0.5) * cell), F.col(y) - (miny + (F.col("row") + 0.5) * cell)
    p = p.withColumn("_d2", dx * dx + dy * dy)
    return p if radius is None else p.where(F.col("_d2") <= radius * radius)


def density(points: DataFrame, grid: Grid, bandwidth: float, reach: float | None = None, weight: str | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """row, col, density: the sum of Gaussian kernels at cell centres; with ``reach``, kernels end after so many bandwidths. Cells out of every reach have no row."""
    w = F.abs(F.col(weight)) if weight else F.lit(1.0)
    k = F.exp(-F.col("_d2") / (2 * bandwidth * bandwidth)) / (2 * F.pi() * bandwidth * bandwidth)
    return _spread(points, grid, None if reach is None else reach * bandwidth, x, y).groupBy("row", "col").agg(F.sum(w * k).alias("density"))


def inverse_distance(points: DataFrame, grid: Grid, value: str, power: float = 2.0, radius: float | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """row, col, value at cell centres: the mean of the points' values weighted by distance to the power, of all points or of those within radius."""
    d = F.greatest(F.sqrt("_d2"), F.lit(1e-10))
    p = _spread(points.where(F.col(value).isNotNull()), grid, radius, x, y).withColumn("_w", 1 / F.pow(d, F.lit(power)))
    return p.groupBy("row", "col").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))


def trend_residuals(df: DataFrame, value: str, x: str = "x", y: str = "y") -> DataFrame:
    """Each row with the plane a + b x + c y of least squares at its place and what the plane leaves; one pass for the coefficients."""
    there = df.where(F.col(value).isNotNull() & F.col(x).isNotNull() & F.col(y).isNotNull())
    m = there.agg(
        F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.avg(value).alias("_mv"), F.var_pop(x).alias("_xx"), F.var_pop(y).alias("_yy"),
        F.covar_pop(x, y).alias("_xy"), F.covar_pop(x, value).alias("_xv"), F.covar_pop(y, value).alias("_yv"),
    )
    det = F.col("_xx") * F.col("_yy") - F.col("_xy") * F.col("_xy")
    m = m.select("_mx", "_my", "_mv", F.try_divide(F.col("_xv") * F.col("_yy") - F.col("_yv") * F.col("_xy"), det).alias("_b"), F.try_divide(F.col("_yv") * F.col("_xx") - F.col("_xv") * F.col("_xy"), det).alias("_c"))
    fit = F.col("_mv") + F.col("_b") * (F.col(x) - F.col("_mx")) + F.col("_c") * (F.col(y) - F.col("_my"))
    out = df.crossJoin(F.broadcast(m)).withColumn("trend", fit)  # one row
    return out.withColumn("residual", F.col(value) - F.col("trend")).drop("_mx", "_my", "_mv", "_b", "_c")


def resample(pixels: DataFrame, factor: int, bands: list[str]) -> DataFrame:
    """Coarser pixels: means of blocks of factor by factor pixels, whatever of them is there."""
    block = [F.floor(F.col(c) / factor).alias(c) for c in ("row", "col")]
    return pixels.groupBy(*block).agg(*(F.avg(b).alias(b) for b in bands))


#: The eight neighbours of a pixel: steps in row and column, and how far they are.
STEPS = [(i, j, (i * i + j * j) ** 0.5) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def flow_direction(pixels: DataFrame, height: str) -> DataFrame:
    """row, col, and the pixel (to_row, to_col) of steepest descent among the eight around, null in pits; ties to the smaller row, then column."""
    p = pixels.where(F.col(height).isNotNull()).select("row", "col", F.col(height).alias("_h"))
    out = F.explode(F.array(*(F.struct((F.col("row") + i).alias("r"), (F.col("col") + j).alias("c"), F.lit(d).alias("d")) for i, j, d in STEPS)))
    seen = p.select(F.col("row").alias("_tr"), F.col("col").alias("_tc"), F.col("_h").alias("_th"), out.alias("n"))
    fall = seen.join(p, (F.col("n.r") == p["row"]) & (F.col("n.c") == p["col"])).select("row", "col", "_tr", "_tc", ((F.col("_h") - F.col("_th")) / F.col("n.d")).alias("_fall")).where("_fall > 0")
    best = fall.groupBy("row", "col").agg(F.min_by(F.struct("_tr", "_tc"), F.struct(-F.col("_fall"), F.col("_tr"), F.col("_tc"))).alias("_to"))
    return p.join(best, ["row", "col"], "left").select("row", "col", F.col("_to._tr").alias("to_row"), F.col("_to._tc").alias("to_col"))


def flow_accumulation(directions: DataFrame) -> DataFrame:
    """row, col, upstream: how many pixels drain into each, by pointers that double their length every round.

    Invariant: a pixel's sum covers all pixels fewer than 2^k steps up, its pointer leads 2^k steps down; so a
    river of n pixels takes log2 n rounds, each written to the shared folder. Directions that go round in circles are an error.
    """
    now = materialized(directions.select("row", "col", "to_row", "to_col", F.lit(1).cast("long").alias("n")))
    rounds = int(now.count()).bit_length() + 1
    while not now.where("to_row IS NOT NULL").isEmpty():
        if not rounds:
            raise ValueError("the directions go round in circles")
        rounds -= 1
        gift = now.where("to_row IS NOT NULL").groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.sum("n").alias("_g"))
        ahead = now.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("_r"), F.col("to_col").alias("_c"))
        step = now.join(ahead, ["to_row", "to_col"], "left").join(gift, ["row", "col"], "left")
        now = materialized(step.select("row", "col", F.col("_r").alias("to_row"), F.col("_c").alias("to_col"), (F.col("n") + F.coalesce("_g", F.lit(0))).alias("n")))
    return now.select("row", "col", (F.col("n") - 1).alias("upstream"))


def streams(accumulated: DataFrame, threshold: int) -> DataFrame:
    return accumulated.where(F.col("upstream") > threshold)


def cloud_cover(bands: list[str], bright: float = 0.3) -> Column:
    """Share in percent of pixels whose mean over bands is brighter than ``bright``; an aggregate column over values in 0 to 1."""
    mean = sum((F.col(b) for b in bands[1:]), F.col(bands[0])) / len(bands)
    return F.avg(F.when(mean.isNotNull(), (mean > bright).cast("int"))) * 100
