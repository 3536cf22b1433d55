"""Terrain on small surfaces; tests/test_queries.py compares with SQL on larger ones."""

import heapq
import math
import random

import pytest

from orbweave.operators import surfaces, terrain


def table(spark, heights):
    return spark.createDataFrame([(r, c, float(z)) for (r, c), z in heights.items()], "row long, col long, h double")


def bumps(seed, n, holes=0.0):
    rand = random.Random(seed)
    return {(r, c): rand.randrange(30) for r in range(-3, n) for c in range(2, n) if rand.random() >= holes}


def around(p):
    return [(p[0] + i, p[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def brute_filled(h):
    heap = [(z, p) for p, z in h.items() if any(q not in h for q in around(p))]
    heapq.heapify(heap)
    out = {}
    while heap:
        w, p = heapq.heappop(heap)
        if p not in out:
            out[p] = float(w)
            for q in around(p):
                if q in h and q not in out:
                    heapq.heappush(heap, (max(w, h[q]), q))
    return out


@pytest.mark.parametrize("tile,holes", [(4, 0.0), (5, 0.05), (64, 0.02)])
def test_filled(spark, tile, holes):
    h = bumps(tile, 20, holes)
    got = {(r.row, r.col): r.height for r in terrain.filled(table(spark, h), "h", tile).collect()}
    assert got == brute_filled(h)
    assert terrain.filled(table(spark, h).limit(0), "h", tile).count() == 0


def test_every_pixel_of_a_filled_surface_drains(spark):
    h = {(r, c): abs(r - 6) + abs(c - 6) for r in range(13) for c in range(13)} | {(0, 6): -1}  # a bowl that spills at one place
    directions = terrain.flow_over(terrain.filled(table(spark, h), "h", 4))
    way = {(r.row, r.col): (r.to_row, r.to_col) for r in directions.collect()}
    assert len(way) == 169 and all(t != (None, None) or any(q not in h for q in around(p)) for p, t in way.items())
    basin = terrain.watersheds(directions, spark.createDataFrame([(7, 0, 6), (9, 50, 50)], "id int, row long, col long"))
    got = {(r.row, r.col) for r in basin.collect()}
    assert (6, 6) in got and len(got) > 80 and {r.id for r in basin.collect()} == {7}
    most = surfaces.flow_accumulation(directions).where("row = 0 AND col = 6").first().upstream
    assert most == len(got) - 1


def test_circles_end(spark):
    d = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 0), (5, 5, None, None)], "row long, col long, to_row long, to_col long")
    assert [tuple(r) for r in terrain.watersheds(d, spark.createDataFrame([(1, 5, 5)], "id int, row long, col long")).collect()] == [(5, 5, 1)]


def brute_seen(h, at, eye, radius):
    top = h[at] + eye
    out = {}
    for p, z in h.items():
        dr, dc = p[0] - at[0], p[1] - at[1]
        if math.hypot(dr, dc) > radius:
            continue
        n = max(abs(dr), abs(dc))
        way = [(round(at[0] + dr * s / n), round(at[1] + dc * s / n)) for s in range(1, n)]
        out[p] = not any(q in h and (h[q] - top) / math.hypot(q[0] - at[0], q[1] - at[1]) > (z - top) / math.hypot(dr, dc) for q in way)
    return out


@pytest.mark.parametrize("sectors", [1, 7, 64, 500])
def test_viewshed(spark, sectors):
    h = bumps(3, 30, 0.05) | {(10, 12): 25}
    got = {(r.row, r.col): r.visible for r in terrain.viewshed(table(spark, h), "h", 10, 12, 1.7, 14.0, 1.0, sectors).collect()}
    assert got == brute_seen(h, (10, 12), 1.7, 14.0) and set(got.values()) == {True, False}
    assert terrain.viewshed(table(spark, h), "h", 900, 900).count() == 0
