"""Checks of fused tables and chunks of texts."""

import random

import pytest
from orbweave.operators import chunks, fusion_quality as Q


def test_ten_checks(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    square = lambda s: ring((0, 0), (s, 0), (s, s), (0, s))
    rows = [(k, float(k), None if k % 3 else 1.0, square(10)) for k in range(16)] + [(16, 1e9, 1.0, square(0.01)), (17, 1e9, 1.0, ring((0, 0), (2, 2), (2, 0), (0, 2))), (18, 2.0, 1.0, ring((0, 0), (1, 1))), (19, 3.0, 1.0, None)]
    schema = "k int, v double, w double, r array<struct<x:double,y:double>>"
    df = spark.createDataFrame(rows, schema)
    source = spark.createDataFrame([(k, float(k), 100.0 + k) for k in range(60)], "k int, v double, w double")
    found = Q.checks(df, [source], "r", "EPSG:3857", ["EPSG:4326"])
    got = {(r.check, r.column): (round(r.value, 4), r.penalty) for r in found.collect()}
    assert got["null_rate", "w"] == (0.5, 0.05) and got["null_rate", "v"] == (0.0, 0.0)
    assert got["row_completeness", None] == (round(20 / 60, 4), 0.15) and got["column_completeness", None] == (0.75, 0.0)
    assert got["outliers", "v"] == (0.1, 0.05) and got["outliers", "k"] == (0.0, 0.0)
    assert got["invalid_geometry", None] == (0.1, 0.15) and got["crossed_geometry", None] == (0.05, 0.1)
    assert got["micro_polygons", None][0] == pytest.approx(0.15) and got["crs_changed", None] == (1.0, 0.0)
    assert got["distribution_shift", "w"][0] == pytest.approx(1 - 1 / 60, abs=1e-4)
    assert Q.score(found).first().score == pytest.approx(round(1 - sum(p for _, p in got.values()), 2))
    assert [tuple(r) for r in Q.checks(df.limit(0)).collect()] == [("empty", None, 1.0, 1.0)]


def test_rings_that_cross_themselves(spark):
    rings = {1: [(0, 0), (4, 0), (4, 4), (0, 4)], 2: [(0, 0), (4, 4), (4, 0), (0, 4)], 3: [(0, 0), (4, 0), (2, 0), (2, 3)], 4: [(0, 0), (3, 0), (1, 2)], 5: [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)]}
    df = spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in r]) for k, r in rings.items()] + [(9, None)], "k int, r array<struct<x:double,y:double>>")
    assert {r.k for r in df.where(Q.crosses_itself("r")).collect()} == {2, 3, 5}


def test_chunks(spark):
    rand = random.Random(1)
    word = lambda: "".join(rand.choice("abcdefg") for _ in range(rand.randrange(1, 9)))
    texts = ["\n\n".join(" ".join(word() + rand.choice(["", "", ".", "!"]) for _ in range(rand.randrange(1, 90))) for _ in range(rand.randrange(1, 9))) for _ in range(40)]
    texts += [None, "", "  \n\n ", "x" * 2000, "短句。" * 300, "one para", "a\n \nb", "e.g. this. that.\n\nthen"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    got = {}
    for r in chunks.chunked(df, "id", "body", 200, 20).orderBy("id", "chunk").collect():
        got.setdefault(r.id, []).append(r.text)
    for k, t in enumerate(texts):
        own = got.get(k, [])
        if not (t or "").strip():
            assert not own
            continue
        assert all(0 < len(c) <= 222 for c in own)
        if t.startswith(("xxx", "短句")):  # overlaps of repeated text are ambiguous
            assert sum(map(len, own)) >= len(t)
            continue
        plain = lambda s: "".join(s.split())
        whole, at = plain(t), 0
        for c in map(plain, own):  # chunks follow each other in the text, overlaps aside, and leave nothing out
            start = next(s for s in range(45) if whole.startswith(c[s:], at))
            at += len(c) - start
        assert at == len(whole)
    assert got[40 + 5] == ["one para"] and got[40 + 6] == ["a\n\nb"] and got[40 + 7] == ["e.g. this. that.\n\nthen"]
    with pytest.raises(ValueError):
        chunks.chunked(df, "id", "body", 10, 10)
    assert chunks.chunked(df.limit(0), "id", "body").count() == 0
