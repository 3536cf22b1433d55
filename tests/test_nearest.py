"""Nearest places where the other side is narrow, dense, repeated or far away, against brute force."""

import time

import numpy as np
import pytest

from orbweave.operators import spatial


def _table(spark, name, x, y):
    return spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], f"{name} int, x double, y double")


def _brute(ax, ay, bx, by):
    """(left, right, distance) of all nearest ones."""
    out = []
    for i in range(len(ax)):
        d = np.sqrt((ax[i] - bx) ** 2 + (ay[i] - by) ** 2)
        out += [(i, int(k), float(d[k])) for k in np.flatnonzero(d == d.min())]
    return sorted(out)


def _found(left, right):
    return sorted((r.id, r.r_rid, r.distance) for r in spatial.nearest(left, right, "id", 2.0).collect())


def _each_case():
    g = np.random.default_rng(7)
    n = 3000
    yield "uniform", g.uniform(0, 100, 300), g.uniform(0, 100, 300), g.uniform(0, 100, n), g.uniform(0, 100, n)
    yield "line, far", g.uniform(0, 100, 300), g.uniform(1e5, 1e6, 300), g.uniform(0, 100, n), np.zeros(n)
    yield "one dense place and few others", g.uniform(-5, 5, 300), g.uniform(-5, 5, 300), np.append(g.normal(0, 1e-7, n), [1e9, -4.0]), np.append(g.normal(0, 1e-7, n), [1e9, 4.0])
    yield "whole numbers, many ties", g.integers(0, 20, 300).astype(float), g.integers(0, 20, 300).astype(float), g.integers(0, 20, 200) + 0.5, g.integers(0, 20, 200) + 0.5
    yield "one place", g.uniform(0, 9, 30), g.uniform(0, 9, 30), np.full(20, 3.0), np.full(20, 4.0)


CASES = list(_each_case())


@pytest.mark.parametrize("name, ax, ay, bx, by", CASES, ids=[c[0] for c in CASES])
def test_nearest_by_brute_force(spark, name, ax, ay, bx, by):
    assert _found(_table(spark, "id", ax, ay), _table(spark, "rid", bx, by)) == _brute(ax, ay, bx, by)


def test_far_rows_do_not_meet_the_whole_other_side(spark):
    """30,000 rows far above a strip of 30,000: met part by part, each would meet thousands."""
    n = 30_000
    left = spark.range(n).selectExpr("CAST(id AS INT) id", "CAST(id * 7919 % 11000 AS DOUBLE) x", "CAST(500000 + 20 * id AS DOUBLE) y")
    right = spark.range(n).selectExpr("CAST(id AS INT) rid", "CAST(id * 104729 % 11003 AS DOUBLE) x", "CAST(id AS DOUBLE) y")
    begun = time.time()
    got = {r.id: (r.r_rid, r.distance) for r in spatial.nearest(left, right, "id", 200.0).where("id % 300 = 0").collect()}
    assert time.time() - begun < 60
    k = np.arange(n)
    assert len(got) == 100
    for i, (rid, distance) in got.items():
        d = np.sqrt((i * 7919 % 11000 - k * 104729 % 11003) ** 2.0 + (500000 + 20 * i - k) ** 2.0)
        assert (rid, distance) == (int(d.argmin()), float(d.min()))


def test_places_without_finite_coordinates_keep_nulls(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, float("inf"), 1.0), (3, float("nan"), 1.0)], "id int, x double, y double")
    right = spark.createDataFrame([(7, 3.0, 4.0), (8, float("nan"), 0.0)], "rid int, x double, y double")
    got = {r.id: (r.r_rid, r.distance) for r in spatial.nearest(left, right, "id", 2.0).collect()}
    assert got == {1: (7, 5.0), 2: (None, None), 3: (None, None)}
