"""Centrality, communities and causality on small graphs and series."""

import itertools
import math
import random

import numpy as np
import pytest

from orbweave.operators import allpairs, causality, centrality


def graph(spark, edges):
    return spark.createDataFrame(list(edges), "src long, dst long")


def brute_paths(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    far, ways = {}, {}
    for s in near:
        far[s, s], ways[s, s], front = 0, 1, [s]
        while front:
            new = {}
            for v in front:
                for w in near[v]:
                    if (s, w) not in far:
                        new[w] = new.get(w, 0) + ways[s, v]
            for w, n in new.items():
                far[s, w], ways[s, w] = far[s, front[0]] + 1, n
            front = list(new)
    return near, far, ways


def test_betweenness_and_closeness(spark):
    rand = random.Random(4)
    edges = [(rand.randrange(24), rand.randrange(24)) for _ in range(40)] + [(100, 101), (7, 7), (3, 4), (4, 3)]
    near, far, ways = brute_paths(edges)
    n = len(near)
    want = {v: sum(ways[s, v] * ways[v, t] / ways[s, t] for s, t in itertools.permutations(near, 2) if v not in (s, t) and (s, t) in far and (s, v) in far and far.get((s, v), 99) + far.get((v, t), 99) == far[s, t]) for v in near}
    got = {r.id: r.betweenness for r in centrality.betweenness(graph(spark, edges)).collect()}
    assert got == pytest.approx({v: b / ((n - 1) * (n - 2)) for v, b in want.items()})
    plain = {r.id: r.betweenness for r in centrality.betweenness(graph(spark, edges), normalized=False).collect()}
    assert plain == pytest.approx({v: b / 2 for v, b in want.items()})
    some = centrality.betweenness(graph(spark, edges), spark.createDataFrame([(3,), (5,)], "id long"))
    assert some.count() == n
    close = {r.id: r.closeness for r in centrality.closeness(graph(spark, edges)).collect()}
    reached = {v: [d for (s, w), d in far.items() if w == v] for v in near}
    assert close == pytest.approx({v: (len(d) - 1) ** 2 / (sum(d) * (n - 1)) for v, d in reached.items()})
    assert centrality.betweenness(graph(spark, [(1, 2)])).count() == 2 and centrality.betweenness(graph(spark, edges).limit(0)).count() == 0


def test_betweenness_and_closeness_write_no_row_for_a_pair(spark, monkeypatch):
    """Trees, a ring, hubs of many leaves and a lone edge: results of brute force, and rounds as small as the graph."""
    rand = random.Random(8)
    edges = [(k, k // 2) for k in range(2, 160)] + [(k, k // 3) for k in range(5, 160, 5)] + [(1, 1000 + k) for k in range(300)] + [(2000, 2001)]
    edges += [(3000 + k, 3000 + (k + 1) % 9) for k in range(9)] + [(3000, 3100), (3100, 3101), (3100, 3102)] + [(4000, 4001), (4001, 4002), (4002, 4003)]
    rand.shuffle(edges)
    near, far, ways = brute_paths(edges)
    held, kept = [], centrality.materialized
    monkeypatch.setattr(centrality, "materialized", lambda df: held.append(kept(df)) or held[-1])
    n, want = len(near), dict.fromkeys(near, 0.0)
    for (s, t), d in far.items():
        for v in near:
            if v not in (s, t) and (s, v) in far and far[s, v] + far[v, t] == d:
                want[v] += ways[s, v] * ways[v, t] / ways[s, t]
    got = {r.id: r.betweenness for r in centrality.betweenness(graph(spark, edges), normalized=False).collect()}
    assert got == pytest.approx({v: b / 2 for v, b in want.items()})
    close = {r.id: r.closeness for r in centrality.closeness(graph(spark, edges)).collect()}
    reached = {v: [d for (_, w), d in far.items() if w == v] for v in near}
    assert close == pytest.approx({v: (len(d) - 1) ** 2 / (sum(d) * (n - 1)) for v, d in reached.items()})
    assert max(df.count() for df in held) <= 2 * len(edges)
    monkeypatch.setattr(allpairs, "HUB", 1)
    assert {r.id: r.betweenness for r in centrality.betweenness(graph(spark, edges), normalized=False).collect()} == pytest.approx(got)
    monkeypatch.setattr(allpairs, "EDGES", 0)
    few = edges[:60]
    assert {r.id: r.closeness for r in centrality.closeness(graph(spark, few)).collect()}.keys() == {v for e in few for v in e}


def test_modular_communities(spark):
    rings = [(10 * c + i, 10 * c + j) for c in range(5) for i in range(6) for j in range(i)] + [(10 * c, 10 * c + 10) for c in range(4)]
    labels, history = centrality.modular_communities(graph(spark, rings))
    got = {}
    for r in labels.collect():
        got.setdefault(r.community, set()).add(r.id)
    assert {k: v for k, v in got.items()} == {10 * c: {10 * c + i for i in range(6)} for c in range(5)}
    assert history == sorted(history) and history[-1] == pytest.approx(centrality.modularity(graph(spark, rings), labels))
    m = len(rings)
    degree = {v: sum(v in e for e in rings) for e in rings for v in e}
    assert history[-1] == pytest.approx(sum(sum(a in c and b in c for a, b in rings) / m - (sum(degree[v] for v in c) / (2 * m)) ** 2 for c in got.values()))
    assert centrality.modular_communities(graph(spark, rings).limit(0))[0].count() == 0


def test_a_round_of_moves_joins_few_tables(spark, monkeypatch):
    joins, kept = [], centrality.materialized

    def counted(df):
        if "g" in df.columns:
            joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return kept(df)

    monkeypatch.setattr(centrality, "materialized", counted)
    assert centrality.modular_communities(graph(spark, [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4)]))[0].count() == 6
    assert joins and max(joins) <= 4


def test_granger(spark):
    rand = random.Random(6)
    x, y = [rand.gauss(0, 1) for _ in range(90)], [0.0, 0.0]
    for t in range(2, 90):
        y.append(0.3 * y[-1] + 0.9 * x[t - 2] + rand.gauss(0, 0.4))
    rows = [("a", t, x[t], y[t]) for t in range(90)] + [("b", t, 1.0, 2.0) for t in range(9)] + [("c", 1, 1.0, 2.0), ("a", 200, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, t int, x double, y double")
    got = {(r.g, lag): (r.n, r.f, r.p) for lag in (1, 2) for r in causality.granger(df, "t", "x", "y", lag, ["g"]).collect()}
    for lag in (1, 2):
        a = np.array([[1, *(y[t - k] for k in range(1, lag + 1)), *(x[t - k] for k in range(1, lag + 1))] for t in range(lag, 90)])
        b = np.array(y[lag:])
        left = [float(((b - a[:, :k] @ np.linalg.lstsq(a[:, :k], b, rcond=None)[0]) ** 2).sum()) for k in (lag + 1, 2 * lag + 1)]
        free = 90 - lag - 2 * lag - 1
        f = (left[0] - left[1]) / lag / (left[1] / free)
        assert got["a", lag][:2] == (90 - lag, pytest.approx(f, rel=1e-6))
        assert got["b", lag][1:] == (None, None)
    assert got["a", 2][2] < 1e-10
    best = {(r.cause, r.effect): (r.lag, r.significant) for r in causality.granger_table(df.where("g = 'a'"), "t", ["x", "y"], 3).collect()}
    assert best["x", "y"] == (2, True) or best["x", "y"][1]
    assert not best["y", "x"][1]


def test_f_probabilities():
    for n in (3, 10, 41):
        for f in (0.1, 1.0, 5.0, 30.0):
            assert causality.f_above(f, 2, n) == pytest.approx((1 + 2 * f / n) ** (-n / 2), rel=1e-9)
    assert causality.f_above(161.4476, 1, 1) == pytest.approx(0.05, abs=1e-6) and causality.f_above(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert causality.beta_part(0.4, 2, 3) == pytest.approx(sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in range(2, 5)))
