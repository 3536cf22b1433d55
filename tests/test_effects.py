"""Effects, exposure-response curves and cross mapping on planted data, against plain computations."""

import hashlib
import math
import random

import numpy as np
import pytest

from orbweave.operators import causality, effects


def planted(spark, n=1500, seed=3):
    rand = random.Random(seed)
    rows = []
    for i in range(n):
        c, d = rand.gauss(0, 1), rand.random()
        t = int(rand.random() < 1 / (1 + math.exp(-1.5 * c)))
        e = 2 * c + rand.gauss(0, 1)
        y = 3 * c + t * (2.0 if d < 0.5 else 6.0) + rand.gauss(0, 0.2)
        rows.append((i, None if i % 97 == 0 else c, d, t, y, e, e * 0.5 + 4 * c + rand.gauss(0, 0.1)))
    return rows, spark.createDataFrame(rows, "id long, c double, d double, t int, y double, e double, z double")


def test_propensity_and_matching(spark):
    rows, df = planted(spark)
    got = effects.propensity(df, "t", ["c"]).collect()
    assert len(got) == len(rows) and all(0 < r.score < 1 for r in got)
    by = sorted((r for r in got if r.c is not None), key=lambda r: r.c)
    assert [r.score for r in by] == sorted(r.score for r in by)
    assert sum(r.score for r in got) == pytest.approx(sum(r.t for r in got), rel=1e-3)  # the intercept's equation
    one = effects.matched_by_propensity(df, "id", "t", "y", ["c"]).first()
    plain = np.mean([r[4] for r in rows if r[3]]) - np.mean([r[4] for r in rows if not r[3]])
    assert abs(one.effect - 4) < 0.4 < abs(plain - 4) and one.pairs <= sum(r[3] for r in rows)
    assert effects.propensity(df.where("t = 1"), "t", ["c"]).count() == 0


def test_effects_by_row(spark):
    rows, df = planted(spark)
    got = effects.effects_by_row(df, "id", "t", "y", ["c", "d"], folds=2, trees=15)
    assert got.count() == len(rows)
    low, high = (np.mean([r.effect for r in got.where(f"d {s} 0.5").collect()]) for s in ("<", ">="))
    assert abs(low - 2) < 0.6 and abs(high - 6) < 0.6
    one = effects.average_effect(got).first()
    assert one.n == len(rows) and one.low < one.effect < one.high
    assert effects.effects_by_row(df.where("t = 1"), "id", "t", "y", ["c"], folds=2).where("effect IS NOT NULL").count() == 0


def test_exposure_response(spark):
    rows, df = planted(spark)
    e, y = np.array([r[5] for r in rows]), np.array([r[6] for r in rows])
    c = np.array([np.nan if r[1] is None else r[1] for r in rows])
    c[np.isnan(c)] = np.nanmedian(c)
    lo, hi = np.percentile(e, [1, 99])
    kept = (e >= lo) & (e <= hi)
    e, y, c = e[kept], y[kept], c[kept]
    left = e - np.polyval(np.polyfit(c, e, 1), c)
    given = np.exp(-0.5 * (left / left.std()) ** 2) / (left.std() * np.sqrt(2 * np.pi))
    h = e.std() * len(e) ** -0.2
    own = np.exp(-0.5 * ((e[:, None] - e[None]) / h) ** 2).mean(1) / (h * np.sqrt(2 * np.pi))
    w = own / np.maximum(given, 1e-10)
    w = np.minimum(w, np.percentile(w, 99))
    got = effects.exposure_response(df, "e", "z", ["c"], points=20).orderBy("point").collect()
    grid = np.linspace(e.min(), e.max(), 20)
    k = np.exp(-0.5 * ((e[None] - grid[:, None]) / (1.06 * h)) ** 2) * w[None]
    want = (k * y).sum(1) / k.sum(1)
    assert [r.exposure for r in got] == pytest.approx(list(grid))
    assert [r.response for r in got] == pytest.approx(list(want), rel=0.01, abs=0.02)  # the density is linear between steps
    slope = np.polyfit(grid[5:15], [r.response for r in got][5:15], 1)[0]
    biased = np.polyfit(e, y, 1)[0]
    assert slope < biased - 0.3  # confounding weighted away in part
    assert effects.exposure_response(df.limit(0), "e", "z", ["c"]).count() == 0
    assert effects.exposure_response(df.withColumn("e", df.e * 0 + 1), "e", "z", ["c"]).count() == 1


def test_cross_map(spark):
    rand = random.Random(8)
    side, size = 14, 3
    cells = [(r * side + q, float(q), float(r)) for r in range(side) for q in range(side)]
    cause = {i: math.sin(x / 2) + math.cos(y / 3) + rand.gauss(0, 0.05) for i, x, y in cells}
    effect = {i: cause[i] * 2 + math.sin(x) + rand.gauss(0, 0.05) for i, x, y in cells}
    places = spark.createDataFrame([(i, x, y, cause[i], effect[i]) for i, x, y in cells] + [(999, 1.5, 1.5, None, 2.0)], "id long, x double, y double, cause double, effect double")
    near = causality.ranked_neighbours(places.where("id < 999"), "id", size, 3.0)
    order = {i: sorted((math.dist((x, y), (u, v)), j) for j, u, v in cells if j != i)[:size] for i, x, y in cells}
    assert {(r.src, r.rank): r.dst for r in near.collect()} == {(i, k): j for i, o in order.items() for k, (_, j) in enumerate(o)}
    state = {i: np.array([effect[j] for _, j in o]) for i, o in order.items()}
    got = {(r.size, r.repeat): r for r in causality.cross_map(places, near, "id", "cause", "effect", [4, 30, 150], size, 2).collect()}
    for repeat in (0, 1):
        ranked = sorted(cause, key=lambda i: (hashlib.md5(f"{repeat}:{i}".encode()).hexdigest(), i))
        for count in (30, 150):
            guess = []
            for i in cause:
                d = sorted((math.sqrt(((state[i] - state[j]) ** 2).sum()), j) for j in ranked[:count] if j != i)[: size + 1]
                w = [math.exp(-x / max(d[0][0], 1e-10)) for x, _ in d]
                guess.append(sum(a * cause[j] for a, (_, j) in zip(w, d)) / sum(w))
            assert got[count, repeat].rho == pytest.approx(np.corrcoef(list(cause.values()), guess)[0, 1], abs=1e-9)
            assert got[count, repeat].n == side * side
        assert got[4, repeat].rho is None
    both = {r.cause: r for r in causality.cross_mapping(places, near, "id", "cause", "effect", [10, 150], size).collect()}
    assert both["cause"].convergent and both["cause"].last == pytest.approx(got[150, 0].rho)
    assert causality.cross_map(places.limit(0), near, "id", "cause", "effect", [10], size).first().rho is None
    with pytest.raises(ValueError):
        causality.cross_map(places, near, "id", "cause", "effect", [10_000_000], size)


def test_effects_by_row_read_their_input_once(spark, monkeypatch):
    plans, kept = [], effects.filled
    monkeypatch.setattr(effects, "filled", lambda df, columns: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or kept(df, columns))
    d = spark.range(400).selectExpr("id k", "id % 2 t", "id % 7 * 1.0 x").groupBy("k", "t").agg({"x": "max"}).toDF("k", "t", "x").selectExpr("k", "t", "x", "x + 3.0 * t y")
    got = effects.effects_by_row(d, "k", "t", "y", ["x"], folds=2, trees=2, depth=2)
    assert got.count() == 400 and "Aggregate" not in plans[0]
