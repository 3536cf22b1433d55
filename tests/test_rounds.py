"""Small cases of operators that work in rounds, and of catalogs: nulls, repeats, ties, empty tables."""

import random

from pyspark.sql import functions as F

from orbweave.operators import catalogs, clusters, graph, surfaces


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_components_of_a_long_chain(spark):
    n = 60
    e = edges(spark, [(k + 1, k) for k in range(n)] + [(100, 101), (102, 102)])
    got = dict(graph.components(spark.range(n + 1).union(spark.createDataFrame([(100,), (101,), (102,), (103,)], "id long")), e).collect())
    assert got == {**dict.fromkeys(range(n + 1), 0), 100: 100, 101: 100, 102: 102, 103: 103}


def test_components_without_edges(spark):
    assert graph.components(spark.range(0), edges(spark, [])).collect() == []
    assert sorted(graph.components(spark.range(2), edges(spark, [])).collect()) == [(0, 0), (1, 1)]


def test_shortest_path_and_none(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 4), (4, 3), (8, 9), (3, None)])
    assert [tuple(r) for r in graph.shortest_path(e, 1, 3).collect()] == [(2, [1, 2, 3])]
    assert graph.shortest_path(e, 1, 9).collect() == []
    assert [tuple(r) for r in graph.shortest_path(e, 1, 1).collect()] == [(0, [1])]


def test_dbscan_against_brute_force(spark):
    r = random.Random(3)
    rows = [(k, r.uniform(0, 10), r.uniform(0, 10)) for k in range(120)] + [(k, 3.0, 3.0) for k in range(120, 160)] + [(160, None, 1.0)]
    got = dict(clusters.dbscan(spark.createDataFrame(rows, "k long, x double, y double"), "k", 0.8, 4).collect())
    pts = [p for p in rows if p[1] is not None]
    near = {a[0]: [b[0] for b in pts if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.64] for a in pts}
    core = {k for k, v in near.items() if len(v) >= 4}
    of = {}
    for k in sorted(core):
        todo = [k] if k not in of else []
        while todo:
            a = todo.pop()
            if a not in of:
                of[a] = k
                todo += [b for b in near[a] if b in core]
    want = {k: of.get(k, min((of[b] for b in v if b in core), default=-1)) for k, v in near.items()}
    assert got == {**want, 160: -1}


def test_flow_down_a_slope_of_one_row(spark):
    p = spark.createDataFrame([(0, k, float(9 - k)) for k in range(9)] + [(5, 5, None)], "row long, col long, h double")
    got = {(r.row, r.col): r.upstream for r in surfaces.flow_accumulation(surfaces.flow_direction(p, "h")).collect()}
    assert got == {(0, k): k for k in range(9)}


def test_patches_touch_by_sides_only(spark):
    p = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 2, 1), (1, 0, 2), (3, 3, None)], "row long, col long, v int")
    got = {(r.row, r.col): r.patch for r in clusters.patches(p, "v").collect()}
    assert got[0, 0] == got[0, 1] != got[1, 2] and len(got) == 4


def test_fronts_and_crowding(spark):
    d = spark.createDataFrame([(1, 1.0, 9.0), (2, 2.0, 5.0), (3, 9.0, 1.0), (4, 3.0, 9.0), (5, None, 1.0), (6, 2.0, 5.0)], "k long, a double, b double")
    assert dict(clusters.fronts(d, "k", ["a", "b"], 5).collect()) == {1: 0, 2: 0, 3: 0, 6: 0, 4: 1}
    c = {r.k: r.crowding for r in clusters.crowding(d.where("k < 4").withColumn("f", F.lit(0)), "f", "k", ["a", "b"]).collect()}
    assert c == {1: float("inf"), 2: 2.0, 3: float("inf")}


def test_inverse_distance_within_a_radius(spark):
    p = spark.createDataFrame([(0.5, 0.5, 4.0), (2.5, 0.5, 8.0), (None, 1.0, 5.0), (1.0, 1.0, None)], "x double, y double, v double")
    got = {r.col: r.v for r in surfaces.inverse_distance(p, (0.0, 0.0, 1.0, 4, 1), "v", radius=1.2).collect()}
    assert round(got[0], 6) == 4 and round(got[1], 6) == 6 and round(got[2], 6) == 8 and round(got[3], 6) == 8


def test_matched_effect_against_brute_force(spark):
    r = random.Random(5)
    rows = [(k, int(r.random() < 0.3), r.randrange(64) / 64, float(r.randrange(20))) for k in range(300)] + [(400, 1, None, 1.0), (401, 0, 0.5, None)]
    df = spark.createDataFrame(rows, "k long, t int, s double, y double")
    for caliper in (None, 0.02):
        got = catalogs.matched_effect(df, "k", "t", "s", "y", caliper).first()
        others = {}
        for k, t, s, y in sorted(rows[:300], reverse=True):
            if not t:
                others[s] = y
        d = []
        for _, t, s, y in rows[:300]:
            if t:
                m = min(others, key=lambda o: (abs(o - s), o))
                if caliper is None or abs(m - s) < caliper:
                    d.append(y - others[m])
        mean = sum(d) / len(d)
        se = (sum((x - mean) ** 2 for x in d) / (len(d) - 1) / len(d)) ** 0.5
        assert got.pairs == len(d) and abs(got.effect - mean) < 1e-9 and abs(got.se - se) < 1e-9
    assert catalogs.matched_effect(df.where("t = 1"), "k", "t", "s", "y").first().effect is None


def test_search_entities_and_inserts_with_nulls(spark):
    d = spark.createDataFrame([(1, "Road map 12"), (2, None), (3, ""), (4, "12 and 12")], "k long, text string")
    assert [r.k for r in catalogs.search(d, "k", "text", "road MAP").collect()] == [1]
    got = {(r.k, r.name, r.type) for r in catalogs.entities(d, "k", "text", {"n": "[0-9]+", "w": "[A-Z][a-z]+", "also": "12"}).collect()}
    assert got == {(1, "12", "n"), (1, "Road", "w"), (4, "12", "n")}
    new = spark.createDataFrame([(7, "a"), (8, "a"), (8, "b"), (9, None)], "k long, text string")
    assert sorted((r.k, r.text) for r in catalogs.insert_new(d, new, "text", "k").collect()) == [(7, "a"), (8, "b")]


def test_expanded_prefixes(spark):
    tree = spark.createDataFrame([("a", "1"), ("b", "12"), (None, "123"), ("c", "2"), ("d", None)], "name string, code string")
    got = catalogs.expanded(spark.createDataFrame([("b",), ("c",), ("z",), ("d",)], "term string"), tree, "term", "name", "code")
    assert sorted(map(tuple, got.collect())) == [("b", "12"), ("b", "123"), ("c", "2")]


def test_expanded_deals_codes_before_they_are_kept_apart(spark, monkeypatch):
    """Repeated codes and nested roots give each row once, and no task keeps apart rows of codes that it was not dealt."""
    tree = spark.createDataFrame([("a", "1"), ("a", "12"), (None, "123"), (None, "123"), ("b", "2"), ("b", None), ("b", "")], "name string, code string")
    terms = spark.createDataFrame([("a",), ("a",), ("b",)], "term string")
    want = [("a", "1"), ("a", "12"), ("a", "123"), ("b", "2")]
    got = catalogs.expanded(terms, tree, "term", "name", "code")
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(term" not in plan
    monkeypatch.setattr(catalogs, "ROOTS", 0)
    assert sorted(map(tuple, catalogs.expanded(terms, tree, "term", "name", "code").collect())) == want
