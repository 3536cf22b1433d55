"""Exact quantiles without holding a column in one task: distinct values are counted, dealt by range, and ranks picked from running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.sources.io import materialized


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, nearest_rank: bool = False) -> DataFrame:
    """by and ``q``, an array of the quantiles of ``value`` at ``shares`` (0 to 1): linear between ranks, or the smallest value with at least that share at or below it.

    Equal values are one row before anything is sorted, so a common value is no hot key; ranges are sorted apart, each in its own task, and
    meet by the sums of their counts. Nulls do not count; a group of nulls alone, and a whole table without values, has null quantiles.
    """
    keys = list(by or [])
    there = df.where(F.col(value).isNotNull())
    counted = there.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    dealt = materialized(counted.repartitionByRange(*keys, "_v").withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy(*keys, "_p").agg(F.sum("_n").alias("_s"))
    group = Window.partitionBy(*keys)  # a row for each range of a group
    sums = sums.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_p").alias("_part"), (F.sum("_s").over(group.orderBy("_p")) - F.col("_s")).alias("_before"), F.sum("_s").over(group).alias("_all"))
    same = F.col("_p") == F.col("_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    run = F.sum("_n").over(Window.partitionBy(*keys, "_p").orderBy("_v"))
    ranked = dealt.withColumn("_run", run).join(sums, same).withColumn("_last", F.col("_before") + F.col("_run") - 1).withColumn("_first", F.col("_last") - F.col("_n") + 1)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("_first") <= k) & (k <= F.col("_last")), F.col("_v")))

    picked, answers = [], []
    for i, share in enumerate(shares):
        if nearest_rank:
            picked.append(at(F.greatest(F.lit(0), F.ceil(F.col("_all") * share - 1e-9) - 1)).alias(f"_q{i}"))
            answers.append(F.col(f"_q{i}"))
            continue
        place = (F.col("_all") - 1) * F.lit(share)
        picked += [at(F.floor(place)).alias(f"_l{i}"), at(F.ceil(place)).alias(f"_h{i}"), F.max(place - F.floor(place)).alias(f"_f{i}")]
        answers.append(F.when(F.col(f"_f{i}") == 0, F.col(f"_l{i}")).otherwise((1 - F.col(f"_f{i}")) * F.col(f"_l{i}") + F.col(f"_f{i}") * F.col(f"_h{i}")))
    found = ranked.groupBy(*keys).agg(*picked).select(*keys, F.array(*answers).alias("q"))
    if not keys:
        return found
    every = df.select(*keys).distinct()
    match = F.lit(True)
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    renamed = found.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), "q")
    return every.join(renamed, match, "left").select(*keys, F.coalesce("q", F.array(*(F.lit(None).cast("double") for _ in shares))).alias("q"))
