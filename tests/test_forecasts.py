"""Forecasts, precision of places and classes of pixels against plain computations."""

import datetime
import random

import numpy as np
import pytest

from orbweave.operators import forecasts, precision, rasters


def monthly(spark, values, name="a"):
    rows = [(name, datetime.datetime(2000 + i // 12, i % 12 + 1, 1 + k), v + k - 0.5) for i, v in enumerate(values) for k in (0, 1)]
    return spark.createDataFrame(rows, "g string, ts timestamp, v double")


def test_holt(spark):
    rand = random.Random(2)
    noisy = [10 + 2 * i + rand.gauss(0, 3) for i in range(40)]
    df = monthly(spark, noisy).union(monthly(spark, [5.0 + 3 * i for i in range(24)], "line")).union(monthly(spark, [1.0, 2.0, 3.0], "short"))
    df = df.union(spark.createDataFrame([("a", None, 1.0), ("a", datetime.datetime(2001, 1, 1), None)], df.schema))
    got = {}
    for r in forecasts.holt(df, "ts", "v", 4, "month", ["g"]).orderBy("g", "period").collect():
        got.setdefault(r.g, []).append(r)
    assert set(got) == {"a", "line"}
    assert [r.forecast for r in got["line"]] == pytest.approx([5 + 3 * i for i in range(24, 28)])
    best = None
    for i in range(1, 10):
        for j in range(1, 10):
            a, b, level, trend, sse = i / 10, j / 10, noisy[1], noisy[1] - noisy[0], 0.0
            for v in noisy[2:]:
                sse += (v - level - trend) ** 2
                old = level
                level = a * v + (1 - a) * (level + trend)
                trend = b * (level - old) + (1 - b) * trend
            if best is None or sse < best[0]:
                best = sse, level, trend
    assert [r.forecast for r in got["a"]] == pytest.approx([best[1] + h * best[2] for h in range(1, 5)])
    widths = [r.high - r.low for r in got["a"]]
    assert widths == sorted(widths) and widths[0] > 0
    assert forecasts.holt(df.limit(0), "ts", "v").count() == 0


def test_autoregression_is_least_squares():
    rand = np.random.default_rng(1)
    y = np.zeros(300)
    for t in range(1, 300):
        y[t] = 0.7 * y[t - 1] + rand.normal()
    y += 20
    model, f, se = forecasts.arima_fit(y, 3, [(1, 0, 0)])
    slope, at = np.polyfit(y[:-1], y[1:], 1)
    want = [y[-1]]
    for _ in range(3):
        want.append(at + slope * want[-1])
    assert model == "arima(1,0,0)" and f == pytest.approx(want[1:], abs=1e-3)
    left = y[1:] - at - slope * y[:-1]
    assert se[0] == pytest.approx(np.sqrt((left**2).sum() / (299 - 2)), rel=1e-4)
    assert se[2] == pytest.approx(se[0] * np.sqrt(1 + slope**2 + slope**4), rel=1e-3)


def test_orders_are_found():
    rand = np.random.default_rng(7)
    e = rand.normal(size=2001)
    _, f, se = forecasts.arima_fit(np.cumsum(e[1:] + 0.6 * e[:-1]), 2, [(0, 1, 1)])
    assert se[1] / se[0] == pytest.approx(np.sqrt(1 + 1.6**2), abs=0.08) and f[0] == f[1]
    walk = np.cumsum(rand.normal(size=400))
    assert forecasts.arima_fit(walk, 2, [(0, 0, 0), (0, 1, 0)])[0] == "arima(0,1,0)"
    assert np.isfinite(forecasts.arima_fit(np.full(30, 4.0), 3, forecasts.ORDERS)[1]).all()
    assert forecasts.arima_fit(np.arange(5.0), 2, [(2, 1, 2)])[0] == "last"


def test_arima_of_many_series(spark):
    rand = random.Random(4)
    df = monthly(spark, [rand.gauss(5, 1) for _ in range(30)]).union(monthly(spark, [float(i % 3) for i in range(20)], "b"))
    got = forecasts.arima(df, "ts", "v", 6, "month", ["g"])
    assert sorted((r.g, r.period) for r in got.collect()) == [(g, h) for g in "ab" for h in range(1, 7)]
    assert got.where("low <= forecast AND forecast <= high").count() == 12


def test_accuracy(spark):
    kind = "id long, x double, y double"
    m = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, None, 1.0), (4, 5.0, 5.0)], kind)
    r = spark.createDataFrame([(1, 3.0, 4.0), (2, 10.0, 1.0), (9, 5.0, 5.0)], kind)
    got = {x.id: (x.reference_key, x.distance) for x in precision.offsets(m, r, "id", same_key=True).collect()}
    assert got == {1: (1, 5.0), 2: (2, 1.0)}
    got = {x.id: (x.reference_key, x.distance) for x in precision.offsets(m, r, "id").collect()}
    assert got == {1: (1, 5.0), 2: (2, 1.0), 4: (9, 0.0)}
    one = precision.accuracy(precision.offsets(m, r, "id"), 1.0).first()
    assert (one.n, one["median"], one.largest, one.within, one.grade) == (3, 1.0, 5.0, 2, "low") and one.rmse == pytest.approx((26 / 3) ** 0.5)
    none = precision.accuracy(precision.offsets(m.limit(0), r, "id", same_key=True), 1.0).first()
    assert none.n == 0 and none.rmse is None and none.grade is None
    far = precision.offsets(spark.createDataFrame([(1, 10.0, 60.0)], kind), spark.createDataFrame([(1, 10.001, 60.0)], kind), "id", same_key=True, degrees=True).first()
    assert far.distance == pytest.approx(55.66, abs=0.01)


def test_coherence(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, None)], "id long, v array<double>")
    e = spark.createDataFrame([(1, 2), (1, 3), (1, 3), (1, 1), (1, 4), (4, 1), (3, 1)], "src long, dst long")
    assert {r.id: (r.neighbours, r.coherence) for r in precision.coherence(v, e, "id", "v").collect()} == {1: (2, 0.5), 3: (1, 1.0)}


def test_pixel_classes(spark):
    rand = random.Random(6)
    rows = [(r, c, 10.0 * (r // 5) + rand.random(), rand.random() if (r, c) != (0, 0) else None) for r in range(15) for c in range(10)]
    p = spark.createDataFrame(rows, "row long, col long, a double, b double")
    got = rasters.cluster_pixels(p, ["a", "b"], 3)
    assert {(r.row, r.col): r["class"] for r in got.collect()} == {(r, c): None if (r, c) == (0, 0) else r // 5 + 1 for r in range(15) for c in range(10)}
    stats = {r["class"]: (r.pixels, r.percent) for r in rasters.class_statistics(got, ["a", "b"]).collect()}
    assert stats == {1: (49, 4900 / 149), 2: (50, 5000 / 149), 3: (50, 5000 / 149)}
    assert rasters.cluster_pixels(p.limit(0), ["a"], 3).count() == 0
    q = {r.band: r.q for r in rasters.band_percentiles(p, ["a", "b"], [0.0, 0.5]).collect()}
    assert q["b"][0] == pytest.approx(min(x[3] for x in rows if x[3] is not None)) and q["a"][1] == pytest.approx(np.median([x[2] for x in rows]))
