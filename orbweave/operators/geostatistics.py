"""Variograms, ordinary kriging and geographically weighted regression over bounded neighbourhoods.

Points meet through grid cells as wide as the search distance, so work is the number of pairs within it.
Systems are bounded (neighbours of a target, moments of a place) and solved many at a time with numpy.

Defined cases: rows with null or non-finite coordinates or values take no part; places without neighbours and systems that do not
determine an answer have nulls; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _finite(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        v = F.col(c).cast("double")
        df = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df


def _pairs(a: DataFrame, b: DataFrame, reach: float) -> DataFrame:
    """Rows of a and b (with ax, ay and bx, by) up to ``reach`` apart, with their distance d; b is entered in the nine cells around it."""
    cell = lambda c: F.floor(F.col(c) / reach)
    around = F.explode(F.array(*(F.struct((cell("bx") + i).alias("i"), (cell("by") + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    # Statistics do not see the ninefold entries nor the width of decoded rows: unhinted, millions of them go through the driver as a broadcast.
    met = a.withColumn("_c", F.struct(cell("ax").alias("i"), cell("ay").alias("j"))).join(b.withColumn("_c", around).hint("merge"), "_c").drop("_c")
    return met.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= reach)


def _placed(df: DataFrame, key: str, value: str, x: str, y: str) -> DataFrame:
    return _finite(df, x, y, value).select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(value).cast("double").alias("v"))


def variogram(points: DataFrame, key: str, value: str, lag: float, bins: int, x: str = "x", y: str = "y") -> DataFrame:
    """bin, n, distance, gamma: half the mean squared difference of pairs whose distance lies in each of ``bins`` bins of width ``lag``; key tells rows apart."""
    p = _placed(points, key, value, x, y)
    a, b = (p.select(*(F.col(c).alias(f"{s}{c}") for c in p.columns)) for s in "ab")
    met = _pairs(a, b, lag * bins).where("aid < bid").withColumn("bin", F.floor(F.col("d") / lag).cast("int")).where(F.col("bin") < bins)
    diff = F.col("av") - F.col("bv")
    return met.groupBy("bin").agg(F.count("*").alias("n"), F.avg("d").alias("distance"), (F.avg(diff * diff) / 2).alias("gamma"))


@dataclass(frozen=True)
class Model:
    """A variogram: ``nugget`` beside 0, ``sill`` far away, reached at ``range`` (in part for the models that only approach it)."""

    kind: str
    nugget: float
    sill: float
    range: float

    SHAPES = {
        "spherical": lambda h: np.where(h < 1, 1.5 * h - 0.5 * h**3, 1.0),
        "exponential": lambda h: 1 - np.exp(-3 * h),
        "gaussian": lambda h: 1 - np.exp(-3 * h * h),
        "linear": lambda h: np.minimum(h, 1.0),
    }

    def __call__(self, d: np.ndarray) -> np.ndarray:
        """Semivariance at distances; 0 at 0, so that points are met exactly."""
        return np.where(d > 0, self.nugget + (self.sill - self.nugget) * self.SHAPES[self.kind](d / self.range), 0.0)


def fitted(bins: DataFrame, kind: str = "spherical", steps: int = 200) -> Model:
    """The model nearest to a variogram's bins, weighted by their pairs: ranges are searched, nugget and sill are the least squares of each (neither negative)."""
    rows = [r for r in bins.select("n", "distance", "gamma").orderBy("distance").collect() if r["gamma"] is not None]  # one row a bin
    if not rows:
        raise ValueError("a variogram without pairs")
    n, d, g = (np.array([float(r[c]) for r in rows]) for c in ("n", "distance", "gamma"))
    w, best = np.sqrt(n), None
    for reach in np.linspace(d.max() / steps * 2, d.max() * 2, steps):
        s = Model.SHAPES[kind](d / reach)
        a = np.column_stack([np.ones(len(d)), s]) * w[:, None]
        c, *_ = np.linalg.lstsq(a, g * w, rcond=None)
        if c.min() < 0:  # the better of the two with one of them 0
            alone = [(np.array([0.0, max(0.0, (s * w * w) @ g / max((s * w) @ (s * w), 1e-300))])), np.array([max(0.0, (w * w) @ g / (w @ w)), 0.0])]
            c = min(alone, key=lambda c: float(((a @ c - g * w) ** 2).sum()))
        left = float(((a @ c - g * w) ** 2).sum())
        if best is None or left < best[0]:
            best = left, Model(kind, float(c[0]), float(c[0] + c[1]), float(reach))
    return best[1]


def krige(points: DataFrame, targets: DataFrame, key: str, value: str, model: Model, radius: float, neighbours: int = 16, x: str = "x", y: str = "y") -> DataFrame:
    """key, estimate, variance, n of each target (key, x, y): ordinary kriging from its nearest ``neighbours`` points within ``radius``.

    Points at one place count once, by their mean. Ties in distance go to the smaller x, then y.
    """
    p = _finite(points, x, y, value).groupBy(F.col(x).cast("double").alias("bx"), F.col(y).cast("double").alias("by")).agg(F.avg(F.col(value).cast("double")).alias("bv"))
    t = targets.select(F.col(key).alias("id"), F.col(x).cast("double").alias("ax"), F.col(y).cast("double").alias("ay"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy("d", "bx", "by"))
    near = _pairs(_finite(t, "ax", "ay"), p, radius).withColumn("_k", rank).where(F.col("_k") <= neighbours)
    systems = near.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_k", "d", "bx", "by", "bv"))).alias("near"))
    systems = systems.select("id", *(F.col(f"near.{c}").alias(c) for c in ("d", "bx", "by", "bv")))
    kind = T.StructType([systems.schema["id"], *(T.StructField(c, T.DoubleType()) for c in ("estimate", "variance")), T.StructField("n", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, bx, by, bv = (batch.column(c).to_pylist() for c in ("d", "bx", "by", "bv"))
            size = np.array([len(r) for r in d])
            estimate, variance = np.full(len(d), np.nan), np.full(len(d), np.nan)
            for n in np.unique(size):
                rows = np.flatnonzero(size == n)
                far, px, py, v = (np.array([c[k] for k in rows], np.float64).reshape(-1, n) for c in (d, bx, by, bv))
                a = np.ones((len(rows), n + 1, n + 1))
                a[:, :n, :n] = model(np.hypot(px[:, :, None] - px[:, None, :], py[:, :, None] - py[:, None, :]))
                a[:, n, n] = 0
                b = np.concatenate([model(far), np.ones((len(rows), 1))], axis=1)
                c = np.einsum("nij,nj->ni", np.linalg.pinv(a), b)
                estimate[rows], variance[rows] = (c[:, :n] * v).sum(1), np.maximum((c * b).sum(1), 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(estimate, from_pandas=True), pa.array(variance, from_pandas=True), pa.array(size, pa.int32())], ["id", "estimate", "variance", "n"])

    got = systems.mapInArrow(run, kind)
    return t.select("id").join(got, "id", "left").select(F.col("id").alias(key), "estimate", "variance", F.coalesce("n", F.lit(0)).alias("n"))


#: Weights by distance in bandwidths, and how many bandwidths they reach.
KERNELS = {
    "bisquare": (lambda h: (1 - h * h) * (1 - h * h), 1.0),
    "gaussian": (lambda h: F.exp(-h * h / 2), 4.0),
    "exponential": (lambda h: F.exp(-h), 8.0),
}


def _moments(df: DataFrame, key: str, y_name: str, xs: list[str], bandwidth: float, kernel: str, x: str, y: str) -> DataFrame:
    """id, own values, and the weighted sums of products of (1, xs, y) around each place, upper triangle by rows; the place's own row counts."""
    shape, reach = KERNELS[kernel]
    there = _finite(df, x, y, y_name, *xs)
    values = F.array(F.lit(1.0), *(F.col(c).cast("double") for c in xs), F.col(y_name).cast("double"))
    a = there.select(F.col(key).alias("id"), F.col(x).cast("double").alias("ax"), F.col(y).cast("double").alias("ay"), values.alias("own"))
    b = there.select(F.col(x).cast("double").alias("bx"), F.col(y).cast("double").alias("by"), values.alias("_v"))
    size = len(xs) + 2
    w = shape(F.col("d") / bandwidth)
    product = lambda i, j: F.sum(F.col("_w") * F.col("_v")[i] * F.col("_v")[j])
    met = _pairs(a, b, bandwidth * reach).withColumn("_w", w)
    return met.groupBy("id").agg(F.any_value("own").alias("own"), F.count("*").alias("n"), F.array(*(product(i, j) for i in range(size) for j in range(i, size))).alias("m"))


def _solved(batch: pa.RecordBatch, size: int, leave_out: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, local R2 and own residual; null (nan) where the places around do not tell the predictors apart."""
    upper = np.array(batch.column("m").to_pylist(), np.float64).reshape(-1, size * (size + 1) // 2)
    own = np.array(batch.column("own").to_pylist(), np.float64).reshape(-1, size)
    m = np.zeros((len(upper), size, size))
    i, j = np.triu_indices(size)
    m[:, i, j] = m[:, j, i] = upper
    if leave_out:
        m = m - own[:, :, None] * own[:, None, :]  # a row's own weight is 1
    k = size - 1
    a, b = m[:, :k, :k], m[:, :k, k]
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
    a = a / scale[:, :, None] / scale[:, None, :]
    fine = np.linalg.det(a) >= 1e-9
    c = np.full((len(a), k), np.nan)
    if fine.any():
        c[fine] = np.linalg.solve(a[fine], (b / scale)[fine][:, :, None])[:, :, 0] / scale[fine]
    left = m[:, k, k] - (c * b).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        r2 = 1 - left / (m[:, k, k] - m[:, 0, k] ** 2 / m[:, 0, 0])
    return c, np.where(np.isfinite(r2), r2, np.nan), own[:, k] - (c * own[:, :k]).sum(1)


def weighted_regression(df: DataFrame, key: str, value: str, xs: list[str], bandwidth: float, kernel: str = "bisquare", x: str = "x", y: str = "y") -> DataFrame:
    """key, n, intercept, one coefficient for each predictor (coef_<name>), local_r2 and residual at every row's place."""
    size = len(xs) + 2
    m = _moments(df, key, value, xs, bandwidth, kernel, x, y)
    names = ["intercept", *(f"coef_{c}" for c in xs), "local_r2", "residual"]
    kind = T.StructType([m.schema["id"], T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, r2, left = _solved(batch, size, False)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n"), *(pa.array(v, from_pandas=True) for v in (*c.T, r2, left))], ["id", "n", *names])

    return m.mapInArrow(run, kind).withColumnRenamed("id", key)


def best_bandwidth(df: DataFrame, key: str, value: str, xs: list[str], candidates: list[float], kernel: str = "bisquare", x: str = "x", y: str = "y") -> float:
    """The candidate whose predictions of each row from the others miss least on the mean (rows that the others cannot predict take the overall mean)."""
    size = len(xs) + 2
    mean = _finite(df, x, y, value, *xs).agg(F.avg(value)).first()[0]

    def missed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                *_, left = _solved(batch, size, True)
                own = np.array([v[-1] for v in batch.column("own").to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array([float((np.where(np.isnan(left), own - mean, left) ** 2).sum())])], ["missed"])

    score = {b: _moments(df, key, value, xs, b, kernel, x, y).mapInArrow(missed, "missed double").agg(F.sum("missed")).first()[0] for b in candidates}
    if all(v is None for v in score.values()):
        raise ValueError("no rows to fit")
    return min(candidates, key=lambda b: (score[b], b))
