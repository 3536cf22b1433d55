"""Quantiles by range, pixels' patches and circles of flow."""

import random

import pytest
from pyspark.sql import functions as F

from orbweave.operators import clusters, surfaces
from orbweave.operators.quantiles import quantiles

SHARES = [0.0, 0.1, 0.25, 0.5, 0.95, 1.0]


def test_quantiles_equal_percentiles(spark):
    rand = random.Random(2)
    rows = [(rand.choice(["a", "b", None]), rand.choice([1.0, 2.5, rand.uniform(-9, 9), None])) for _ in range(500)] + [("c", None), ("d", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).collect()}
    got = {r.g: r.q for r in quantiles(df, "v", SHARES, ["g"]).collect()}
    assert set(got) == set(want) and got["c"] == [None] * 6
    assert all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want if want[k] is not None)
    whole = df.agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).first().q
    assert quantiles(df, "v", SHARES).first().q == pytest.approx(whole, abs=1e-12)
    ranks = df.agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY v)").alias(f"x{k}") for k, p in enumerate(SHARES))).first()
    assert quantiles(df, "v", SHARES, nearest_rank=True).first().q == list(ranks)
    assert [r.q for r in quantiles(df.limit(0), "v", [0.5]).collect()] == [[None]] and quantiles(df.limit(0), "v", [0.5], ["g"]).count() == 0


def test_patches_of_negative_columns(spark):
    p = spark.createDataFrame([(0, -1, 1), (-1, 5, 1), (0, 5, 1), (2, 2, 1)], "row long, col long, v int")
    got = {(r.row, r.col): r.patch for r in clusters.patches(p, "v").collect()}
    assert len(set(got.values())) == 3 and got[-1, 5] == got[0, 5]


def test_flow_in_circles_is_an_error(spark):
    d = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 0)], "row long, col long, to_row long, to_col long")
    with pytest.raises(ValueError):
        surfaces.flow_accumulation(d)
