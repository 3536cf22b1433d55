"""Vector codes against an exhaustive search and SQL."""

import hashlib
import math
import random

import numpy as np
import pytest

from orbweave.llm import codes, queries
from tests import oracle

SF = "/root/testdata/sf0.001"
MOST = (1 << 63) - 1


def brute(rows, parts, entries, rounds, scale=256):
    kept = []
    for i, label, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, label, [max(-MOST - 1, min(MOST, math.floor(scale * x))) for x in v]))
    wide = -(-max(len(v) for *_, v in kept) // parts)
    kept = [(i, label, v + [0] * (parts * wide - len(v)), v) for i, label, v in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))[:entries]
    cut = lambda v: [v[p * wide : (p + 1) * wide] for p in range(parts)]
    books = [[cut(r[2])[p] for r in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda p, v: min((far(v, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [[] for _ in books[p]]
            for r in kept:
                v = cut(r[2])[p]
                own[best(p, v)[1]].append(v)
            new.append([[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = [(i, label, [best(p, v) for p, v in enumerate(cut(x))]) for i, label, x, _ in kept]
    out = [(i, label, "".join(f"{k:02x}" for _, k in b), min(MOST, sum(f for f, _ in b))) for i, label, b in out]
    return sorted(((i, c, e, min(MOST, sum(x[3] for x in out if x[1] == label)), digest) for i, label, c, e in out), key=repr)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, code string")


def test_codes(spark):
    rand = random.Random(2)
    rows = [(k, k % 3 or None, [rand.gauss(0, 0.3) for _ in range(12)]) for k in range(200)]
    rows += [(5, 1, [0.5] * 12), (5, 1, [0.5] * 12), (None, 2, [0.25] * 12), (900, None, [1.0, -1.0]), (901, 4, []), (902, 4, None), (903, 4, [None] * 12), (904, 4, [float("nan")] * 12), (905, 4, [float("inf")] * 12)]
    d = table(spark, rows)
    out = codes.encode(d, parts=4, entries=8, rounds=2)
    assert got(out) == brute(rows, 4, 8, 2)
    assert out.selectExpr("avg(evaluated)").first()[0] < 4 * 8 * 0.8  # the annulus leaves entries out
    assert got(codes.encode(d.limit(0))) == []
    assert got(codes.encode(table(spark, [(1, 1, []), (2, 1, [])]))) == brute([(1, 1, []), (2, 1, [])], 16, 64, 2)


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e17, 1e300])
def test_integers_of_any_length(spark, scale):
    rand = random.Random(4)
    rows = [(k, k % 2, [rand.gauss(0, 1) * scale for _ in range(4)]) for k in range(40)] + [(100, None, [0.01, 0.02, 0.03, 0.04])]
    assert got(codes.encode(table(spark, rows), parts=2, entries=6, rounds=2)) == brute(rows, 2, 6, 2)


def test_annulus_finds_the_first_of_the_nearest():
    rand = np.random.default_rng(1)
    for _ in range(200):
        entries, x = (rand.integers(-3, 4, (n, 3)) for n in (rand.integers(1, 20), 50))
        index, best, count = codes.Codebook(entries).nearest(x)
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (best == far.min(1)).all() and (index == far.argmin(1)).all() and (count <= len(entries)).all()


def test_codes_on_table(spark):
    oracle.same(queries.op12_vector_codes(spark, SF), oracle.connect(SF), queries.ORACLES["op12_vector_codes"])
