"""Aggregates of usage and audit logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def success(df: DataFrame, by: list[str], ok: Column, duration: str) -> DataFrame:
    """Per group: runs, failures, success rate in percent and mean duration."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(~ok).alias("failures"), (F.avg(ok.cast("int")) * 100).alias("rate"), F.avg(duration).alias("mean_s"))


def per_day(df: DataFrame, time: str, amounts: list[str]) -> DataFrame:
    """Per day: runs, and of each amount the sum and the amount a run."""
    sums = [x for a in amounts for x in (F.sum(a).alias(f"{a}_total"), F.avg(a).alias(f"{a}_a_run"))]
    return df.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("runs"), *sums)


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Dollars of a call from prices for a million tokens, to six places."""
    return F.round((tokens_in * price_in + tokens_out * price_out) / 1e6, 6)


def access(df: DataFrame, asset: str, user: str, kind: str, kinds: list[str]) -> DataFrame:
    """Per asset: uses, distinct users, and uses of each kind."""
    return df.groupBy(asset).agg(F.count("*").alias("uses"), F.count_distinct(user).alias("users"), *(F.count_if(F.col(kind) == k).alias(f"n_{k}") for k in kinds))


def ratings(df: DataFrame, asset: str, stars: str) -> DataFrame:
    return df.groupBy(asset).agg(F.round(F.avg(stars), 1).alias("rating"), F.count(stars).alias("votes"))


def radius(df: DataFrame, value: str, least: float = 3.0, most: float = 30.0) -> DataFrame:
    """Bubble radii between least and most, in proportion to a value's place in its range."""
    edge = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    part = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    return df.crossJoin(F.broadcast(edge)).withColumn("radius", least + part * (most - least)).drop("_lo", "_hi")  # one row


def totals(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Sum, count and mean of an amount per group."""
    return df.groupBy(*by).agg(F.sum(amount).alias("total"), F.count("*").alias("n"), F.avg(amount).alias("mean"))


def decisions(df: DataFrame, state: str, groups: dict[str, list[str]], waited: str) -> DataFrame:
    """One row: how many requests there are, how many ended in each group of states, and the mean wait."""
    return df.agg(F.count("*").alias("n"), *(F.count_if(F.col(state).isin(states)).alias(name) for name, states in groups.items()), F.avg(waited).alias("mean"))


def trend(df: DataFrame, time: str, score: str, days: int = 7) -> DataFrame:
    """Per day the mean score, its count, and the mean of the last ``days`` days that have rows; days are few, rows are reduced first."""
    day = df.groupBy(F.to_date(time).alias("day")).agg(F.avg(score).alias("score"), F.count("*").alias("n"))
    return day.withColumn("week", F.avg("score").over(Window.orderBy("day").rowsBetween(-(days - 1), 0)))


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with the number of rows of each table."""
    return reduce(DataFrame.crossJoin, [df.agg(F.count("*").alias(n)) for n, df in tables.items()])  # single rows


def tools(df: DataFrame, log: str) -> DataFrame:
    """Per tool of a log column (JSON list of objects with tool, ok and seconds): calls, errors, success in percent, mean duration; logs that do not parse hold no calls."""
    calls = df.select(F.explode(F.from_json(log, "array<struct<tool:string,ok:boolean,seconds:double>>")).alias("c")).select("c.*")
    ok = F.coalesce("ok", F.lit(False))
    return calls.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(~ok).alias("errors"), (F.avg(ok.cast("int")) * 100).alias("rate"), F.avg("seconds").alias("mean_s"))
