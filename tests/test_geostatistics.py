"""Kriging and weighted regression against systems solved whole."""

import math
import random

import numpy as np
import pytest

from orbweave.operators import geostatistics as G


def scattered(seed, n, side=10.0):
    rand = random.Random(seed)
    rows = [(k, rand.uniform(0, side), rand.uniform(0, side)) for k in range(n)]
    return [(k, x, y, math.sin(x) + 0.3 * y, rand.uniform(-1, 1)) for k, x, y in rows]


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, v double, u double")


@pytest.mark.parametrize("kind", list(G.Model.SHAPES))
def test_kriging_matches_the_global_solution(spark, kind):
    rows, model = scattered(1, 30), G.Model(kind, 0.1, 2.0, 6.0)
    targets = [(k, 0.5 + k, 9.5 - k) for k in range(9)] + [(100, *rows[3][1:3]), (101, 500.0, 500.0), (102, None, 1.0)]
    got = {r.id: r for r in G.krige(table(spark, [*rows, (*rows[5][:3], rows[5][3], 0.0), (900, None, 1.0, 2.0, 0.0)]), spark.createDataFrame(targets, "id long, x double, y double"), "id", "v", model, 30.0, 64).collect()}
    p, v = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    a = np.ones((31, 31))
    a[:30, :30], a[30, 30] = model(np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))), 0
    for k, x, y in targets[:9]:
        b = np.append(model(np.hypot(*(p - (x, y)).T)), 1)
        c = np.linalg.solve(a, b)
        assert got[k].estimate == pytest.approx(c[:30] @ v, abs=1e-6) and got[k].variance == pytest.approx(c @ b, abs=1e-6) and got[k].n == 30
    assert got[100].estimate == pytest.approx(rows[3][3], abs=1e-6) and got[100].variance == pytest.approx(0, abs=1e-6)  # exact at the points
    assert (got[101].estimate, got[101].n) == (None, 0) and got[102].estimate is None
    assert G.krige(table(spark, rows), spark.createDataFrame(targets[:1], "id long, x double, y double"), "id", "v", model, 30.0, 5).first().n == 5


def test_variogram_and_fit(spark):
    rows = scattered(2, 60)
    bins = G.variogram(table(spark, rows), "id", "v", 1.0, 6)
    want = {}
    for k, a in enumerate(rows):
        for b in rows[:k]:
            d = math.dist(a[1:3], b[1:3])
            if d < 6:
                want.setdefault(int(d), []).append((a[3] - b[3]) ** 2 / 2)
    assert {r.bin: (r.n, round(r.gamma, 9)) for r in bins.collect()} == {k: (len(v), round(sum(v) / len(v), 9)) for k, v in want.items()}
    true = G.Model("spherical", 0.5, 3.0, 4.0)
    drawn = spark.createDataFrame([(100, float(d), float(true(np.array([d]))[0])) for d in np.arange(0.25, 8, 0.5)], "n long, distance double, gamma double")
    found = G.fitted(drawn, "spherical")
    assert found.range == pytest.approx(4.0, abs=0.1) and found.nugget == pytest.approx(0.5, abs=0.05) and found.sill == pytest.approx(3.0, abs=0.05)
    with pytest.raises(ValueError):
        G.fitted(bins.limit(0))


def test_weighted_regression(spark):
    rows = [(k, x, y, (1 + x) * u + 2 * y + 3, u) for k, x, y, _, u in scattered(3, 80)]  # the slope grows with x
    df = table(spark, [*rows, (900, 1.0, 1.0, None, 1.0), (901, 400.0, 400.0, 1.0, 1.0)]).selectExpr("*", "y AS yy")
    got = {r.id: r for r in G.weighted_regression(df, "id", "v", ["u", "yy"], 4.0).collect()}
    for k, x, y, v, _ in rows[:20]:
        w = np.array([max(0.0, 1 - math.dist((x, y), r[1:3]) ** 2 / 16) ** 2 if math.dist((x, y), r[1:3]) <= 4 else 0.0 for r in rows])
        a = np.array([[1, r[4], r[2]] for r in rows])
        c = np.linalg.solve(a.T @ (a * w[:, None]), a.T @ (w * np.array([r[3] for r in rows])))
        assert (got[k].intercept, got[k].coef_u, got[k].coef_yy) == pytest.approx(tuple(c), abs=1e-6)
    assert 900 not in got and got[901].coef_u is None and got[901].n == 1
    assert np.corrcoef([got[r[0]].coef_u for r in rows], [r[1] for r in rows])[0, 1] > 0.9
    assert G.best_bandwidth(df, "id", "v", ["u", "yy"], [3.0, 5.0, 40.0]) < 40


def test_neighbours_are_never_broadcast(spark):
    """Nine entries of every row must not go through the driver, however small the statistics say the table is."""
    from orbweave.operators import causality, spatial

    p = spark.range(40).selectExpr("id", "double(id % 7) AS x", "double(id % 5) AS y", "double(id % 3) AS v", "double(id % 4) AS u")
    found = [
        G.variogram(p, "id", "v", 1.0, 3), G.weighted_regression(p, "id", "v", ["u"], 3.0),
        causality.ranked_neighbours(p, "id", 2, 2.0), spatial.within_distance(p, p.select("x", "y"), 1.0),
    ]
    for df in found:
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
