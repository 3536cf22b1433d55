"""Field matching, entity merging and the vector index against all pairs."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from orbweave.operators import matching, vectors


def matched(spark, left, right, **more):
    make = lambda rows: spark.createDataFrame(rows, "field string, type string")
    return {(r.left, r.right): (r.confidence, r.kind) for r in matching.match_fields(make(left), make(right), **more).collect()}


def test_tiers_of_field_matches(spark):
    left = [("AREA", "double"), ("population", "bigint"), ("land_use_type", "string"), ("len_km", "double"), ("id", "bigint"), ("slope_type", "double"), ("ab", "int"), (None, "int"), ("wholly_other", "int")]
    right = [("area", "double"), ("rk", "int"), ("landUseType", "object"), ("len_mu", "double"), ("objectid", "int"), ("slope_type_name", "string"), ("abc", "int"), ("zmj", "double")]
    got = matched(spark, left, right)
    assert got["AREA", "area"] == (1.0, "exact") and got["population", "rk"] == (0.8, "equivalent") and got["id", "objectid"] == (0.8, "equivalent")
    assert got["len_km", "len_mu"] == (0.75, "unit_aware")
    ratio = SequenceMatcher(None, "land_use_type", "landusetype").ratio()
    assert got["land_use_type", "landUseType"] == (round(0.5 + 0.2 * (0.6 + 0.4 * ratio), 2), "fuzzy")
    assert len(got) == 5  # other types, short names and unlike names stay apart
    assert matched(spark, left, []) == {} and matched(spark, [], right) == {}
    assert matched(spark, [("aa", "int")], [("bb", "int")], same=[["aa", "bb"]]) == {("aa", "bb"): (0.8, "equivalent")}


def test_units_and_similarity(spark):
    names = spark.createDataFrame([("area_mu",), ("面积_亩",), ("area_m2",), ("公顷面积",), ("OBJECTID",), ("mu",), ("road-km ",)], "n string")
    from pyspark.sql import functions as F

    got = {r.n: (r.u, r.b) for r in names.select("n", matching.unit(F.col("n")).alias("u"), matching.base(F.col("n")).alias("b")).collect()}
    assert got["area_mu"] == ("mu", "area") and got["面积_亩"] == ("mu", "面积") and got["area_m2"] == ("m2", "area") and got["公顷面积"][0] == "ha" and got["OBJECTID"] == (None, "objectid") and got["mu"] == ("mu", "mu")


def brute_clusters(rows, least):
    ids = sorted({(n.lower(), t) for n, t, _ in rows})
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and a[1] == b[1] and SequenceMatcher(None, a[0], b[0]).ratio() >= least:
                root[find(b)] = find(a)
    out = {}
    for n, t, c in rows:
        out.setdefault(find((n.lower(), t)), []).append((-(c or 0.0), n, t, c))
    return sorted(((min(v)[1], min(v)[2], min(v)[3], len(v)) for v in out.values()), key=repr)


@pytest.mark.parametrize("least", [0.81, 0.85, 0.95])
def test_merged_entities(spark, least):
    rand = random.Random(int(least * 100))
    rows = []
    for k in range(60):
        word = "".join(rand.choice("abcde") for _ in range(rand.randrange(1, 14)))
        rows.append((word, rand.choice("xy"), rand.random()))
        for _ in range(2):
            p = rand.randrange(len(word) + 1)
            rows.append((rand.choice([str.upper, str])(word[:p] + rand.choice(["", "q", "aa"]) + word[p + rand.randrange(2) :]) or "z", rows[-1][1], rand.random()))
    rows += [("Same", "x", None), ("Same", "x", 0.2)]
    df = spark.createDataFrame([*rows, (None, "x", 1.0), ("none", None, 1.0)], "name string, type string, confidence double")
    got = sorted(map(tuple, matching.merged_entities(df, least).collect()), key=repr)
    assert got == brute_clusters(rows, least)
    assert matching.merged_entities(df.limit(0)).count() == 0


def test_assignment_is_one_to_one(spark):
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.8), ("b", "x", 0.9), ("b", "y", 0.1), ("c", "z", 0.5)], "left string, right string, score double")
    assert sorted(tuple(r) for r in matching.assigned(pairs).collect()) == [("a", "x", 0.9), ("b", "y", 0.1), ("c", "z", 0.5)]


def test_vector_index(spark):
    rand = np.random.default_rng(8)
    centers = rand.normal(size=(12, 16))
    x = centers[rand.integers(0, 12, 900)] + rand.normal(size=(900, 16)) * 0.3
    rows = [(k, list(map(float, v))) for k, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0]), (1004, []), (5, list(map(float, x[5]))), (None, list(map(float, x[0])))]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = vectors.Index(df, "id", "v", lists=12, sample=300, block=100)
    queries = df.where("id % 20 = 0")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    ids, unit = np.append(np.arange(900), 5), np.vstack([unit, unit[5]])
    want = {}
    for q in range(0, 900, 20):
        s = unit @ unit[q]
        at = np.flatnonzero(ids != q)
        want[q] = [int(ids[k]) for k in at[np.lexsort((ids[at], -s[at]))[:5]]]
    got = {}
    for r in index.search(queries, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want
    some = vectors.recall(index.search(queries, 5, probes=4), index.search(queries, 5)).first()
    assert some.n == 45 * 5 and some.recall >= 0.9
    assert index.search(queries, 5, least=0.999).count() < 45 * 5
    assert vectors.Index(df.limit(0), "id", "v").search(queries, 5).count() == 0
