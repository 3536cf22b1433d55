"""Overlay, clip, erase, dissolve and buffer of polygons against unit cells and clipped triangles."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from orbweave.operators import overlay


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def shapes(spark, rows):
    return spark.createDataFrame([(k, [ring(r) for r in rings] if rings is not None else None) for k, rings in rows], f"k int, rings {overlay.RINGS}")


def lshape(x, y, n):
    return [[(x, y), (x + 2 * n, y), (x + 2 * n, y + n), (x + n, y + n), (x + n, y + 3 * n), (x, y + 3 * n)]]


def donut(x, y, n):
    return [[(x, y), (x, y + 3 * n), (x + 3 * n, y + 3 * n), (x + 3 * n, y)], [(x + n, y + n), (x + 2 * n, y + n), (x + 2 * n, y + 2 * n), (x + n, y + 2 * n)]]


def units(rings):
    """The unit cells of a shape with whole corners."""
    inside = lambda r, x, y: sum((p[1] > y) != (q[1] > y) and x < p[0] + (y - p[1]) * (q[0] - p[0]) / (q[1] - p[1]) for p, q in zip(r, r[1:] + r[:1])) % 2
    xs, ys = [p[0] for p in rings[0]], [p[1] for p in rings[0]]
    return {(x, y) for x in range(min(xs), max(xs)) for y in range(min(ys), max(ys)) if sum(inside(r, x + 0.5, y + 0.5) for r in rings) % 2}


def random_shapes(seed, n, extent=40):
    rand = random.Random(seed)
    return [(k, rand.choice([lshape, donut])(rand.randrange(-5, extent), rand.randrange(-5, extent), rand.randrange(1, 6))) for k in range(n)]


def areas(df, *names):
    return {tuple(r[n] for n in names): round(r["area"], 5) for r in df.collect() if abs(r["area"]) > 1e-6}


@pytest.mark.parametrize("size", [3.0, 7.3])
def test_overlay_of_concave_rings_with_holes(spark, size):
    a, b = random_shapes(1, 12), random_shapes(2, 12)
    left, right = overlay.Layer(shapes(spark, a), "k", size), overlay.Layer(shapes(spark, b), "k", size)
    ua, ub = ({k: units(r) for k, r in s} for s in (a, b))
    want = {(x, y): float(len(ua[x] & ub[y])) for x in ua for y in ub if ua[x] & ub[y]}
    got = areas(overlay.overlay(left, right), "a", "b")
    assert got == want
    all_a, all_b = set().union(*ua.values()), set().union(*ub.values())
    rest = {(x, None): float(len(ua[x] - all_b)) for x in ua if ua[x] - all_b} | {(None, y): float(len(ub[y] - all_a)) for y in ub if ub[y] - all_a}
    assert areas(overlay.overlay(left, right, "symmetric_difference"), "a", "b") == rest
    assert areas(overlay.overlay(left, right, "union"), "a", "b") == want | rest
    clipped = areas(overlay.measured(overlay.masked(left, right, "intersection"), ["a"]), "a")
    assert clipped == {(x,): float(len(ua[x] & all_b)) for x in ua if ua[x] & all_b}


def clip_area(s, c):
    """The area that two triangles share, by cutting one along the other's sides."""
    turn = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    if turn(*c) < 0:
        c = c[::-1]
    for p, q in zip(c, c[1:] + c[:1]):
        out = []
        for u, v in zip(s, s[1:] + s[:1]):
            du, dv = turn(p, q, u), turn(p, q, v)
            if du >= 0:
                out.append(u)
            if (du >= 0) != (dv >= 0):
                out.append((u[0] + (v[0] - u[0]) * du / (du - dv), u[1] + (v[1] - u[1]) * du / (du - dv)))
        s = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(s, s[1:] + s[:1]))) / 2 if s else 0.0


def test_overlay_of_slanted_triangles(spark):
    rand = random.Random(9)
    make = lambda: [tuple(rand.uniform(0, 20) for _ in "xy") for _ in range(3)]
    a, b = ([(k, [make()]) for k in range(10)] for _ in "ab")
    left, right = overlay.Layer(shapes(spark, a), "k", 2.5), overlay.Layer(shapes(spark, b), "k", 2.5)
    got = {k: v for k, v in areas(overlay.overlay(left, right), "a", "b").items() if v > 1e-4}
    want = {(x, y): clip_area(r[0], q[0]) for (x, r), (y, q) in itertools.product(a, b)}
    assert {k for k, v in want.items() if v > 1e-4} == set(got)
    assert all(abs(want[k] - v) < 1e-4 for k, v in got.items())
    whole = {r.k: r.area for r in overlay.shape_areas(shapes(spark, a), "k").collect()}
    clipped, erased = (areas(overlay.measured(overlay.masked(left, right, how), ["a"]), "a") for how in ("intersection", "difference"))
    assert all(abs(clipped.get((k,), 0) + erased.get((k,), 0) - v) < 1e-4 for k, v in whole.items())


def test_related(spark):
    square = lambda x, y, n: [[(x, y), (x + n, y), (x + n, y + n), (x, y + n)]]
    a = [(1, square(0, 0, 10)), (2, square(20, 0, 4)), (3, donut(40, 0, 5)), (4, None), (5, []), (6, [[(0, 0), (1, 1)]])]
    b = [(1, square(2, 2, 3)), (2, square(10, 4, 2)), (3, square(24, 4, 4)), (4, square(46, 6, 2)), (5, square(30, 0, 2)), (6, square(0, 0, 10)), (7, square(14, 0, 6))]
    got = {(r.a, r.b): (round(r.shared_area, 6), r.within, r.contains) for r in overlay.related(overlay.Layer(shapes(spark, a), "k", 4.0), overlay.Layer(shapes(spark, b), "k", 4.0)).collect()}
    assert got == {(1, 1): (9.0, False, True), (1, 2): (0.0, False, False), (1, 6): (100.0, True, True), (2, 3): (0.0, False, False), (2, 7): (0.0, False, False)}


def test_dissolve_and_outlines(spark):
    rows = random_shapes(5, 40, 25)
    by = shapes(spark, rows).withColumn("g", F.col("k") % 3)
    edges = overlay.dissolved(by, "g", 4.0)
    want = {(g,): float(len(set().union(*(units(r) for k, r in rows if k % 3 == g)))) for g in range(3)}
    assert areas(overlay.measured(edges, ["g"]), "g") == want
    parts = overlay.outlines(edges, ["g"])
    assert areas(overlay.shape_areas(parts, "g"), "g") == want
    for r in parts.collect():
        assert all(len(x) >= 4 for x in r.rings) and all((p.x == q.x) != (p.y == q.y) for x in r.rings for p, q in zip(x, x[1:] + x[:1]))
    assert overlay.outlines(overlay.dissolved(by.limit(0), "g", 4.0), ["g"]).count() == 0
    two = shapes(spark, [(1, [[(0, 0), (2, 0), (2, 2), (0, 2)]]), (1, [[(2, 2), (4, 2), (4, 4), (2, 4)]])])
    assert sorted(len(r.rings[0]) for r in overlay.outlines(overlay.dissolved(two, "k", 1.5), ["k"]).collect()) == [4, 4]  # parts that touch at a corner stay parts


@pytest.mark.parametrize("quarter", [4, 16])
def test_buffer(spark, quarter):
    s = shapes(spark, [(1, [[(0, 0), (30, 0), (30, 20), (0, 20)]]), (2, lshape(100, 50, 10)), (3, donut(-60, -60, 10))])
    d, sector = 3.0, quarter * math.sin(math.pi / (2 * quarter)) / 2 * 9
    got = {k[0]: v for k, v in areas(overlay.measured(overlay.buffered(s, "k", d, 5.0, quarter), ["k"]), "k").items()}
    want = {1: 600 + 100 * d + 4 * sector, 2: 400 + 100 * d + 5 * sector - d * d, 3: 900 + 120 * d + 4 * sector - 4 * 4}
    assert all(abs(got[k] - want[k]) < 1e-3 for k in want) and len(got) == 3
    assert abs(4 * sector - math.pi * 9) <= math.pi * 9 * (1 - math.sin(math.pi / 2 / quarter) / (math.pi / 2 / quarter)) + 1e-9
    inner = {k[0]: v for k, v in areas(overlay.measured(overlay.buffered(s, "k", -d, 5.0, quarter), ["k"]), "k").items()}
    assert abs(inner[1] - 24 * 14) < 1e-3


def test_rims_add_what_capsules_add(spark):
    """Shapes of any angles, with holes and inner corners, grow alike by rims and by whole capsules; rims make fewer pieces."""
    star = [(0.0, 0.0), (5.0, 1.3), (9.0, -0.4), (7.5, 4.0), (9.5, 8.8), (4.2, 6.1), (0.3, 9.0), (2.0, 4.4)]
    hole = [(3.0, 2.0), (3.5, 4.0), (5.5, 3.2)]
    rings = lambda *r: [[{"x": x, "y": y} for x, y in ring] for ring in r]
    shapes = spark.createDataFrame([(1, rings(star, hole)), (2, rings([(20.0, 0.0), (20.0, 0.0), (23.0, 0.5), (21.0, 2.0)]))], f"k int, rings {overlay.RINGS}")
    capsules, rims = overlay._capsules(shapes, "k", 0.4, 4, "rings", 7), overlay._rims(shapes, "k", 0.4, 4, "rings", 7)
    grown = [{r.k: r.area for r in overlay.measured(overlay.dissolved(shapes.unionByName(x), "k", 2.0), ["k"]).collect()} for x in (capsules, rims)]
    assert grown[0].keys() == grown[1].keys() == {1, 2}
    assert all(abs(grown[0][k] - grown[1][k]) < 1e-5 for k in (1, 2))
    pieces = [overlay.boundary(x, ["k"]).count() for x in (capsules, rims)]
    assert pieces[1] < pieces[0]


def test_edges_of_one_file_are_cut_in_many_tasks(spark):
    shapes = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 0.0}, {"x": 0.0, "y": 4.0}]])], f"k int, rings {overlay.RINGS}").coalesce(1)
    plan = overlay.pieces(overlay.boundary(shapes, ["k"]), 2.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan
