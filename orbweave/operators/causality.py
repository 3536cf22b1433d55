"""Causality of series and of places.

Granger causality of many series at once: moments of lagged values by one aggregation, small systems solved together. Cross mapping of places:
neighbours' values as a state of a place, and libraries of a stated size that every place is held against.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.operators.geostatistics import _finite, _pairs
from orbweave.sources.io import materialized


def beta_part(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_part(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    value = 1.0
    for k in range(100 + 6 * int(math.sqrt(max(a, b))), 0, -1):  # from the innermost term out
        m = k // 2
        term = m * (b - m) / ((a + 2 * m - 1) * (a + 2 * m)) if k % 2 == 0 else -(a + m) * (a + b + m) / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + term * x / value
    return front / value


def f_above(f: float, d1: int, d2: int) -> float:
    """The probability that an F value with d1 and d2 degrees of freedom is above f."""
    return 1.0 if f <= 0 else beta_part(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def granger(df: DataFrame, time: str, cause: str, effect: str, lag: int, by: list[str] | None = None) -> DataFrame:
    """by, n, f, p: whether past values of ``cause`` help to tell ``effect`` beyond its own past, at ``lag`` steps back.

    Each series (the rows of one ``by``) is ordered by time; rows at one time count by their means, rows with a null cause or effect
    take no part. The regressions with and without the cause's lags come from one aggregation of products of values (taken from the series'
    means); f and p are null where too few rows or no variation determine them. A series is one window task, series are spread.
    """
    keys = by or []
    there = df.where(F.col(time).isNotNull() & F.col(cause).isNotNull() & F.col(effect).isNotNull())
    each = there.groupBy(*keys, F.col(time).alias("_t")).agg(F.avg(F.col(cause).cast("double")).alias("_x"), F.avg(F.col(effect).cast("double")).alias("_y"))
    order = Window.partitionBy(*keys).orderBy("_t")
    whole = Window.partitionBy(*keys)
    each = each.withColumns({"_x": F.col("_x") - F.avg("_x").over(whole), "_y": F.col("_y") - F.avg("_y").over(whole)})
    past = [*(F.lag("_y", k).over(order).alias(f"_y{k}") for k in range(1, lag + 1)), *(F.lag("_x", k).over(order).alias(f"_x{k}") for k in range(1, lag + 1))]
    rows = each.select(*keys, "_y", *past).where(F.col(f"_y{lag}").isNotNull())
    terms = [F.lit(1.0), *(F.col(f"_{v}{k}") for v in "yx" for k in range(1, lag + 1)), F.col("_y")]
    size = len(terms)
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*(F.sum(terms[i] * terms[j]) for i in range(size) for j in range(i, size))).alias("m"))
    kind = T.StructType([*(m.schema[c] for c in (*keys, "n")), T.StructField("f", T.DoubleType()), T.StructField("p", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f, p = [], []
            for n, upper in zip(batch.column("n").to_pylist(), batch.column("m").to_pylist()):
                full = np.zeros((size, size))
                full[np.triu_indices(size)] = upper
                full = full + np.triu(full, 1).T
                left, free = [], n - 2 * lag - 1
                for k in (lag + 1, 2 * lag + 1):
                    scale = np.sqrt(np.maximum(np.diag(full)[:k], 1e-300))
                    a = full[:k, :k] / scale[:, None] / scale[None]
                    fine = np.linalg.det(a) > 1e-12
                    left.append(full[-1, -1] - full[:k, -1] / scale @ np.linalg.solve(a, full[:k, -1] / scale) if fine else None)
                if free <= 0 or None in left or left[1] <= 1e-12 * full[-1, -1]:
                    f.append(None)
                    p.append(None)
                else:
                    f.append(float(max(0.0, (left[0] - left[1]) / lag / (left[1] / free))))
                    p.append(f_above(f[-1], lag, free))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "n")), pa.array(f, pa.float64()), pa.array(p, pa.float64())], [*keys, "n", "f", "p"])

    return m.mapInArrow(run, kind)


def granger_table(df: DataFrame, time: str, variables: list[str], lags: int, by: list[str] | None = None, significance: float = 0.05) -> DataFrame:
    """by, cause, effect, lag, f, p, significant: for every ordered pair of variables the lag up to ``lags`` with the smallest p (ties to the shorter)."""
    keys, found = by or [], None
    for cause in variables:
        for effect in variables:
            for lag in range(1, lags + 1) if cause != effect else ():
                one = granger(df, time, cause, effect, lag, by).select(*keys, F.lit(cause).alias("cause"), F.lit(effect).alias("effect"), F.struct("p", F.lit(lag).alias("lag"), "f").alias("_r"))
                found = one if found is None else found.unionByName(one)
    best = found.where("_r.p IS NOT NULL").groupBy(*keys, "cause", "effect").agg(F.min("_r").alias("_r"))
    return best.select(*keys, "cause", "effect", "_r.lag", "_r.f", "_r.p", (F.col("_r.p") < significance).alias("significant"))


def ranked_neighbours(points: DataFrame, key: str, k: int, reach: float, x: str = "x", y: str = "y") -> DataFrame:
    """src, dst, rank (from 0): the up to ``k`` nearest other places within ``reach`` of each, ties to the smaller key."""
    p = points.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    a, b = (_finite(p, "x", "y").select(*(F.col(c).alias(f"{s}{c}") for c in p.columns)) for s in "ab")
    order = Window.partitionBy("aid").orderBy("d", "bid")
    met = _pairs(a, b, reach).where("aid <> bid").withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k)
    return met.select(F.col("aid").alias("src"), F.col("bid").alias("dst"), "rank")


def states(places: DataFrame, neighbours: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """id and state: the values of a place's ``size`` nearest neighbours in order of rank, its own where it has fewer; places without a value have no state."""
    own = places.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(F.col(value).cast("double")).alias("v"))
    near = neighbours.where(F.col("rank") < size).join(own.select(F.col("id").alias("dst"), "v"), "dst")
    each = near.groupBy(F.col("src").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("_m"))  # at most ``size`` entries
    full = own.join(each, "id", "left")
    return full.select("id", F.array(*(F.coalesce(F.try_element_at("_m", F.lit(r)), F.col("v")) for r in range(size))).alias("state"))


#: The most numbers that all libraries of a call may hold together.
MOST_NUMBERS = 4_000_000


def cross_map(places: DataFrame, neighbours: DataFrame, key: str, cause: str, effect: str, sizes: list[int], dimension: int = 3, repeats: int = 1) -> DataFrame:
    """size, repeat, n, rho: how well the effect's states tell the cause, with libraries of growing size; rho that grows with size speaks for causation.

    A place's state is the effect at its ``dimension`` nearest neighbours. The cause at a place is guessed by the mean of the causes of the
    dimension + 1 places of a library whose states are nearest to its own (never itself; ties to the smaller key), weighted by exp(-d / least d), and rho
    is the correlation of guess and truth over all places. A library holds the ``size`` places of least md5 of ``repeat:key``, so the small ones lie in the large
    ones; the sizes are the method's parameter, together at most MOST_NUMBERS numbers, which go to all tasks. Every place is a row
    of the work and is held against the libraries in blocks. Rows with a null or non-finite key, cause or effect take no part; libraries of
    fewer than dimension + 2 places and guesses that do not vary have a null rho.
    """
    there = _finite(places, cause, effect)
    told = there.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.min(F.col(cause).cast("double")).alias("cause"))
    known = materialized(states(there, neighbours, key, effect, dimension).join(told, "id"))
    most, need = max(sizes), dimension + 1
    if most * repeats * (dimension + 2) > MOST_NUMBERS:
        raise ValueError(f"libraries of {most} places, {repeats} times, are over {MOST_NUMBERS} numbers")
    libraries = []
    for r in range(repeats):
        first = known.orderBy(F.md5(F.concat(F.lit(f"{r}:"), F.col("id").cast("string"))), "id").limit(most)
        rows = first.collect()  # bounded above
        libraries.append((np.array([x.id for x in rows], np.int64), np.array([x.state for x in rows], float).reshape(len(rows), dimension), np.array([x.cause for x in rows], float)))
    held = known.sparkSession.sparkContext.broadcast(libraries)
    kind = "size long, repeat long, n long, a double, b double, aa double, bb double, ab double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, truth = batch.column("id").to_numpy(), batch.column("cause").to_numpy()
            at = batch.column("state").flatten().to_numpy().reshape(len(ids), dimension)
            rows = []
            for r, (keys, lib, causes) in enumerate(held.value):
                for size in sizes:
                    inside = np.argsort(keys[:size], kind="stable")  # by key, so that a stable sort settles ties
                    if len(inside) < need + 1:
                        continue
                    mean, block = causes[inside].mean(), max(1, 2_000_000 // (len(inside) * dimension))
                    for start in range(0, len(ids), block):
                        part = slice(start, start + block)
                        d = np.sqrt(((at[part, None] - lib[inside][None]) ** 2).sum(2))
                        d[ids[part, None] == keys[inside][None]] = np.inf
                        near = np.argsort(d, axis=1, kind="stable")[:, :need]
                        far = np.take_along_axis(d, near, 1)
                        w = np.exp(-far / np.maximum(far[:, :1], 1e-10))
                        guess = (w * causes[inside][near]).sum(1) / w.sum(1) - mean
                        true = truth[part] - mean
                        rows.append((size, r, len(true), true.sum(), guess.sum(), (true * true).sum(), (guess * guess).sum(), (true * guess).sum()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if i < 3 else pa.float64()) for i, c in enumerate(zip(*rows))], names)

    names = "size repeat n a b aa bb ab".split()
    parts = known.select("id", "state", "cause").mapInArrow(run, kind)
    total = parts.groupBy("size", "repeat").agg(*(F.sum(c).alias(c) for c in names[2:]))
    ab, aa, bb = (F.col(p) - F.col(q) * F.col(r) / F.col("n") for p, q, r in (("ab", "a", "b"), ("aa", "a", "a"), ("bb", "b", "b")))
    rho = F.when((aa > 1e-12 * F.col("aa")) & (bb > 1e-12 * F.col("bb")), ab / F.sqrt(aa * bb))
    every = known.sparkSession.createDataFrame([(s, r) for s in sizes for r in range(repeats)], "size long, repeat long")
    return every.join(total, ["size", "repeat"], "left").select("size", "repeat", F.coalesce("n", F.lit(0)).alias("n"), rho.alias("rho"))


def cross_mapping(places: DataFrame, neighbours: DataFrame, key: str, a: str, b: str, sizes: list[int], dimension: int = 3, repeats: int = 1) -> DataFrame:
    """cause, effect, first, last, slope, convergent for both directions: mean rho at the least and the largest size, its slope over the
    logarithm of size, and whether the last is positive and above the first."""
    out = None
    for cause, effect in ((a, b), (b, a)):
        mean = cross_map(places, neighbours, key, cause, effect, sizes, dimension, repeats).groupBy("size").agg(F.avg("rho").alias("rho"))
        one = mean.where("rho IS NOT NULL").agg(F.min_by("rho", "size").alias("first"), F.max_by("rho", "size").alias("last"), F.regr_slope("rho", F.log("size")).alias("slope"))
        one = one.select(F.lit(cause).alias("cause"), F.lit(effect).alias("effect"), "first", "last", "slope", ((F.col("last") > 0) & (F.col("last") > F.col("first"))).alias("convergent"))
        out = one if out is None else out.unionAll(one)
    return out
