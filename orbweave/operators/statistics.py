"""Regression, balance, panel effects and neighbours by aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.expressions import cosine


def balance(df: DataFrame, treatment: str, covariates: list[str]) -> DataFrame:
    """Standardised mean difference of each covariate between treated and others."""
    t = F.col(treatment) == 1
    row = df.agg(*(F.struct(F.avg(F.when(t, F.col(c))).alias("m1"), F.avg(F.when(~t, F.col(c))).alias("m0"), F.var_pop(F.when(t, F.col(c))).alias("v1"), F.var_pop(F.when(~t, F.col(c))).alias("v0")).alias(c) for c in covariates))
    each = F.array(*(F.struct(F.lit(c).alias("covariate"), F.try_divide(F.col(c)["m1"] - F.col(c)["m0"], F.sqrt((F.col(c)["v1"] + F.col(c)["v0"]) / 2)).alias("smd")) for c in covariates))
    return row.select(F.explode(each).alias("x")).select("x.*")


def diff_in_diff(df: DataFrame, treated: str, post: str, outcome: str) -> DataFrame:
    """The interaction's coefficient from the four cell means."""
    m = lambda a, b: F.avg(F.when((F.col(treated) == a) & (F.col(post) == b), F.col(outcome)))
    return df.agg(((m(1, 1) - m(1, 0)) - (m(0, 1) - m(0, 0))).alias("effect"), F.count("*").alias("n"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def similar(df: DataFrame, target: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """The k rows most alike (cosine, rounded to 4) to the one target row, which is broadcast."""
    t = target.select(F.col(vector).alias("_t"), F.col(key).alias("_k")).limit(1)
    one = df.crossJoin(F.broadcast(t)).where(F.col(key) != F.col("_k"))
    return one.select(key, F.round(cosine(F.col(vector), F.col("_t")), 4).alias("similarity")).where("similarity IS NOT NULL").orderBy(F.desc("similarity"), key).limit(k)


def what_if(df: DataFrame, column: str, scenarios: dict[str, float]) -> DataFrame:
    """Mean of a column under each multiplier, and the change in percent; rank by change."""
    row = df.agg(F.avg(column).alias("base"))
    each = F.array(*(F.struct(F.lit(s).alias("scenario"), F.lit(float(m)).alias("m")) for s, m in scenarios.items()))
    out = row.select("base", F.explode(each).alias("x")).select("x.scenario", "base", (F.col("base") * F.col("x.m")).alias("mean"), ((F.col("x.m") - 1) * 100).alias("percent"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("percent"), "scenario")))


def ndvi(red: str, nir: str):
    return F.try_divide(F.col(nir) - F.col(red), F.col(nir) + F.col(red))
