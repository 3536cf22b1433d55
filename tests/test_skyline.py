"""Skylines in one meeting and in blocks, against all pairs."""

import random

import pytest

from orbweave.operators.clusters import fronts
from orbweave.operators.relational import skyline


@pytest.mark.parametrize("block", [4096, 7])
def test_skyline(spark, block):
    rand = random.Random(11)
    rows = [(i, rand.randrange(40), rand.random() if i % 3 else 0.5, None if i == 5 else float(rand.randrange(30))) for i in range(300)]
    rows += [(1000 + i, r[1], r[2], r[3]) for i, r in enumerate(rows[:60])] + [(7, 39, 0.0, 0.0), (2000, None, 0.1, 0.1)]
    df = spark.createDataFrame(rows, "id long, a long, b double, c double")
    whole = [r for r in rows if None not in r]
    best = [r for r in whole if not any(o[1] >= r[1] and o[2] <= r[2] and o[3] <= r[3] and o[1:] != r[1:] for o in whole)]
    got = skyline(df, "id", ["a"], ["b", "c"], sample=2, block=block)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == sorted(best)
    assert skyline(df.limit(0), "id", ["a"], ["b"], block=block).count() == 0


def test_fronts_end(spark):
    df = spark.createDataFrame([(i, float(i % 5), float(i % 7)) for i in range(35)], "id long, a double, b double")
    got = {r.id: r.front for r in fronts(df, "id", ["a", "b"], 3).collect()}
    assert got[0] == 0 and set(got.values()) == {0, 1, 2}
