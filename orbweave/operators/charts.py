"""The tables behind charts and dashboards: profiles, histograms, box plots, breaks, time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.operators.quantiles import quantiles


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column, from one pass: null share, min, max, mean, distinct values."""
    aggs = [F.count("*").alias("n")]
    for c in columns:
        aggs += [F.count(c).alias(f"{c}|k"), F.min(c).cast("double").alias(f"{c}|lo"), F.max(c).cast("double").alias(f"{c}|hi"), F.avg(c).alias(f"{c}|mean")]
    row = df.agg(*aggs)
    each = F.array(*(F.struct(F.lit(c).alias("column"), (1 - F.col(f"`{c}|k`") / F.col("n")).alias("null_share"), F.col(f"`{c}|lo`").alias("low"), F.col(f"`{c}|hi`").alias("high"), F.col(f"`{c}|mean`").alias("mean")) for c in columns))
    return row.select(F.explode(each).alias("x")).select("x.*")


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Bins of equal width, the last one closed; empty bins have no row."""
    edge = df.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))
    x = df.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edge))  # one row
    at = F.least(F.lit(bins - 1), F.floor((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins).cast("int"))
    return x.select(F.coalesce(at, F.lit(0)).alias("bin"), "_lo", "_hi").groupBy("bin").agg(F.count("*").alias("n"), F.first(F.col("_lo") + (F.col("_hi") - F.col("_lo")) / bins * F.col("bin")).alias("low"))


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles with linear interpolation and whiskers at 1.5 interquartile ranges within the data."""
    ends = df.groupBy(F.col(by).alias("_by")).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    q = quantiles(df, value, [0.25, 0.5, 0.75], [by]).join(ends, F.col(by).eqNullSafe(F.col("_by")))
    iqr = F.col("q")[2] - F.col("q")[0]
    return q.select(by, F.greatest("lo", F.col("q")[0] - 1.5 * iqr).alias("low"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), F.least("hi", F.col("q")[2] + 1.5 * iqr).alias("high"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson of every pair, pairwise complete, rounded to 3; undefined ones 0."""
    pairs = [(a, b) for a in columns for b in columns if a < b]
    row = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    each = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.coalesce(F.nanvl(f"`{a}|{b}`", F.lit(0.0)), F.lit(0.0)), 3).alias("r")) for a, b in pairs))
    return row.select(F.explode(each).alias("x")).select("x.*")


def grouped_sum(df: DataFrame, x: str, y: str, group: str) -> DataFrame:
    """Sums by x and group, 0 where a pair of values has no rows; both value lists are aggregated, not collected."""
    have = df.groupBy(x, group).agg(F.sum(y).alias("total"))
    grid = df.select(x).distinct().crossJoin(df.select(group).distinct())  # the result itself is this grid
    return grid.join(have, [x, group], "left").na.fill(0, ["total"])


def equal_breaks(df: DataFrame, value: str, classes: int = 5) -> DataFrame:
    row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    return row.select(F.explode(F.sequence(F.lit(0), F.lit(classes))).alias("k"), "lo", "hi").select("k", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / classes).alias("edge"))


def quantile_breaks(df: DataFrame, value: str, classes: int = 5) -> DataFrame:
    return quantiles(df, value, [k / classes for k in range(classes + 1)]).select(F.posexplode("q").alias("k", "edge"))


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    return df.groupBy(before, after).agg(F.count("*").alias("n"))


def shares(df: DataFrame, by: str) -> DataFrame:
    """Count and percentage of every class."""
    n = df.groupBy(by).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.col("n") * 100 / F.sum("n").over(Window.partitionBy()))


def nearest_rank(df: DataFrame, value: str, ranks: dict[str, float]) -> DataFrame:
    """Percentiles by rank (the smallest value with at least that share at or below it), with count, mean, min and max."""
    one = df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    q = quantiles(df, value, list(ranks.values()), nearest_rank=True)
    return one.crossJoin(F.broadcast(q)).select("n", "mean", "low", "high", *(F.col("q")[k].alias(c) for k, c in enumerate(ranks)))  # single rows
