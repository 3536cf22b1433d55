"""Outlines are traced tile by tile: rings that run through many tiles, holes, islands in holes and corners that touch come out as in one tile."""

import pytest
from pyspark.sql import functions as F

from orbweave.operators import overlay


def _square(x, y, n):
    return [(x, y), (x + n, y), (x + n, y + n), (x, y + n)]


def _edges(spark, rows):
    shapes = spark.createDataFrame([(g, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for g, rings in rows], f"g int, rings {overlay.RINGS}")
    return overlay.materialized(overlay.boundary(shapes, ["g"]))


def _parts(edges, size):
    return {(r.g, r.part): [[tuple(p) for p in ring] for ring in r.rings] for r in overlay.outlines(edges, ["g"], size).collect()}


def _area(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2


@pytest.mark.parametrize("size", [0.05, 0.3, None])
def test_tiles_of_any_width(spark, size):
    lake = [_square(-20, -20, 60), _square(-10, -10, 40)]
    island = [_square(-5, -5, 20), _square(0, 0, 5), _square(6, 6, 5)]  # its second hole holds an island again
    rows = [(1, lake), (1, island), (1, [_square(7, 7, 2)]), (1, [_square(40, 40, 3)]), (None, [_square(0, 0, 1)]), (None, [_square(1, 1, 1)])]
    got = _parts(_edges(spark, rows), size)
    areas = {k: [_area(r) for r in v] for k, v in got.items()}
    assert areas == {(1, 0): [4.0], (1, 1): [9.0], (1, 2): [400.0, -25.0, -25.0], (1, 3): [3600.0, -1600.0], (None, 0): [1.0], (None, 1): [1.0]}
    assert all(len(r) == 4 and r[0] == min(r) for rings in got.values() for r in rings)


def test_no_task_holds_a_group(spark, monkeypatch):
    """A group of many parts far apart is chained in many tiles."""
    calls, large = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    edges = _edges(spark, [(1, [_square(k % 20 * 50, k // 20 * 50, 2 + k % 3)]) for k in range(300)])
    chained = overlay._chained
    monkeypatch.setattr(overlay, "_chained", lambda rows: calls.add(1) or large.add(len(rows) > 100) or chained(rows))
    parts = overlay.outlines(edges, ["g"], 1.0)
    assert tuple(parts.agg(F.max("part") + 1, F.count_distinct("part"), F.count("*")).first()) == (300, 300, 300)
    assert calls.value > 100 and large.value == 0
