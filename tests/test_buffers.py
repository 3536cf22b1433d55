"""Buffers of many small shapes write no edges; small shapes merged whole and large ones merged by cells give the same."""

import math

import pytest
from pyspark.sql import functions as F

from orbweave.operators import overlay


def _shapes(spark):
    star = [(0.0, 0.0), (5.0, 1.3), (9.0, -0.4), (7.5, 4.0), (9.5, 8.8), (4.2, 6.1), (0.3, 9.0), (2.0, 4.4)]
    hole = [(3.0, 2.0), (3.5, 4.0), (5.5, 3.2)]
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    beside = [(3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (3.0, 7.0)]
    rows = [(1, [star, hole]), (2, [square]), (2, [beside]), (3, [square]), (None, [beside]), (4, []), (5, None)]
    return spark.createDataFrame(rows, "k int, rings array<array<struct<x:double,y:double>>>")


def _areas(shapes, distance):
    return {r.k: (r.area, r.length) for r in overlay.measured(overlay.buffered(shapes, "k", distance, 2.0, 4), ["k"]).collect()}


@pytest.mark.parametrize("distance", [0.0, 0.4, 1.5])
def test_whole_and_by_cells(spark, monkeypatch, distance):
    shapes = _shapes(spark)
    whole = _areas(shapes, distance)
    assert set(whole) == {1, 2, 3, None}
    assert all(whole[k][0] == pytest.approx(16 + 16 * distance + 8 * distance**2 * math.sin(math.pi / 8), abs=1e-5) for k in (3, None))
    monkeypatch.setattr(overlay, "WHOLE", 0)
    cells = _areas(shapes, distance)
    assert all(whole[k] == pytest.approx(cells[k], abs=1e-5) for k in (1, 2, 3))


def test_small_shapes_write_no_edges(spark, monkeypatch):
    seen, write = [], overlay.materialized
    monkeypatch.setattr(overlay, "materialized", lambda df: seen.append(write(df)) or seen[-1])
    shapes = spark.range(300).select("id", F.array(F.array(*(F.struct((F.lit(x) + F.col("id")).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))))).alias("rings"))
    grown = overlay.measured(overlay.buffered(shapes, "id", 0.5, 1.0), ["id"])
    assert grown.count() == 300 and grown.agg(F.max("area") - F.min("area")).first()[0] < 1e-5
    assert sum(df.count() for df in seen) == 0


def test_keys_that_span_batches(spark, monkeypatch):
    """A batch ends within a key, and a key is longer than what is merged at once."""
    monkeypatch.setattr(overlay, "AT_ONCE", 10)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        shapes = _shapes(spark).where("k is not null")
        held = _areas(shapes, 0.4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.undo()
    assert held == _areas(shapes, 0.4)
