"""Boolean operations on polygons with holes, cell by cell: overlay, clip, erase, dissolve, buffer.

A shape is the rows of one key, each a part: ``rings``, an array of rings (arrays of (x, y),
first corner not repeated), the outline first and then its holes, in either direction.

1. Edges are directed with the inside on their left and cut at the lines of a grid.
2. A row of cells is summed up from the left once per shape: which cells lie inside, and the
   winding number at each cell's left border, come from the crossings of one line of the row.
3. In a cell the pieces that meet (those of one pair, one shape and a layer, or one group)
   are split where they cross or touch, equal segments become one, and the coverage on the
   left of each segment follows from the border's winding number and the pieces of that cell.
4. A segment is kept where the operation's answer differs between its sides. Areas and lengths
   are sums over kept segments; rings are traced from them where they are asked for.

All steps are equality joins and groupings on keys and cells, so a large shape is spread over
its cells, no side is broadcast or crossed, and a group of any size is merged without being
held in one task. The work of a cell is the square of the pieces that meet there: choose
``size`` near the length of an edge. Coordinates are rounded to ``digits``; slivers thinner than that are lost.

Defined cases: null and empty rings and rings of fewer than three corners hold nothing; empty tables give empty results;
parts of one shape may touch or overlap (what any part covers is inside).
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbweave.operators.temporal import _numbered
from orbweave.sources.io import materialized

RINGS = "array<array<struct<x:double,y:double>>>"
SEGMENT = ("x1", "y1", "x2", "y2")
#: Where in a row of cells its line of reference runs, off the places that corners like.
LINE = 0.3819660113
#: Shapes whose buffer has at most so many edges are merged whole, each in one place; of larger ones each cell.
WHOLE = 2048
#: Edges of whole shapes that are merged at once, and pairs of them.
AT_ONCE, PAIRS = 50_000, 500_000
#: Rounds in which chains of edges are linked; by then a tile is wider than any coordinates that keep their digits.
LEVELS = 24


def _ring_edges(ring: Column) -> Column:
    return F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1)).alias("q"))


def _signed(ring: Column) -> Column:
    return F.aggregate(_ring_edges(ring), F.lit(0.0), lambda s, e: s + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def _turned(shapes: DataFrame, keys: list[str], rings: str, digits: int) -> DataFrame:
    """keys and _r: each ring, rounded, with the inside on the left of its edges."""
    part = shapes.where(F.col(rings).isNotNull()).select(*keys, F.posexplode(F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(F.round(p["x"], digits).alias("x"), F.round(p["y"], digits).alias("y"))))).alias("_k", "_r"))
    part = part.where(F.size("_r") >= 3).withColumn("_a", _signed(F.col("_r"))).where("_a <> 0")
    return part.select(*keys, F.when((F.col("_a") > 0) == (F.col("_k") == 0), F.col("_r")).otherwise(F.reverse("_r")).alias("_r"))


def boundary(shapes: DataFrame, keys: list[str], rings: str = "rings", digits: int = 7) -> DataFrame:
    """keys and x1, y1, x2, y2: the directed edges, inside on the left."""
    edge = _turned(shapes, keys, rings, digits).select(*keys, F.explode(_ring_edges(F.col("_r"))).alias("_e"))
    return edge.select(*keys, F.col("_e.p.x").alias("x1"), F.col("_e.p.y").alias("y1"), F.col("_e.q.x").alias("x2"), F.col("_e.q.y").alias("y2")).where("x1 <> x2 OR y1 <> y2")


def pieces(edges: DataFrame, size: float, digits: int = 7) -> DataFrame:
    """Edges cut at the lines of the grid, with their cell (i, j); what runs along a line is in the cell left of it, or above it."""

    def cuts(a1: str, b1: str, a2: str, b2: str, flip: bool) -> Column:
        first, last = F.ceil(F.least(a1, a2) / size), F.floor(F.greatest(a1, a2) / size)
        at = lambda k: F.round(F.col(b1) + (F.round(k * size, digits) - F.col(a1)) * F.try_divide(F.col(b2) - F.col(b1), F.col(a2) - F.col(a1)), digits)
        point = lambda k: F.struct(*((F.round(k * size, digits) if own else at(k)).alias(c) for c, own in (("x", not flip), ("y", flip))))
        none = F.array().cast("array<struct<x:double,y:double>>")
        return F.when((F.col(a1) != F.col(a2)) & (first <= last), F.transform(F.sequence(first, last), point)).otherwise(none)

    # A file of a few megabytes is one task, its edges are many: they are dealt first, since to cut an edge is the work.
    edges = edges.repartition(*SEGMENT)
    ends = F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)))
    points = F.concat(ends, cuts("x1", "y1", "x2", "y2", False), cuts("y1", "x1", "y2", "x2", True))
    rest = [c for c in edges.columns if c not in SEGMENT]
    cut = edges.select(*rest, F.explode(_chain(points)).alias("_e"))
    return cut.select(*rest, *_segment("_e"), (F.ceil((F.col("_e.p.x") + F.col("_e.q.x")) / 2 / size) - 1).cast("long").alias("i"), F.floor((F.col("_e.p.y") + F.col("_e.q.y")) / 2 / size).cast("long").alias("j"))


def _segment(e: str) -> list[Column]:
    return [F.col(f"{e}.{a}.{b}").alias(c) for c, a, b in zip(SEGMENT, "ppqq", "xyxy")]


def _chain(points: Column) -> Column:
    """Points on the segment (x1, y1) to (x2, y2), in its direction, as pairs of neighbours."""
    along = lambda p: (p["x"] - F.col("x1")) * (F.col("x2") - F.col("x1")) + (p["y"] - F.col("y1")) * (F.col("y2") - F.col("y1"))
    length = along({"x": F.col("x2"), "y": F.col("y2")})
    xy = lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))
    # A value bound by a lambda is computed once; named twice in an expression like this one it would be computed twice.
    bound = lambda value, f: F.transform(F.array(value), f)[0]

    def ordered(ps: Column) -> Column:
        there = F.filter(ps, lambda p: (along(p) >= 0) & (along(p) <= length))
        return F.transform(F.array_sort(F.array_distinct(F.transform(there, lambda p: F.struct(along(p).alias("d"), p["x"].alias("x"), p["y"].alias("y"))))), xy)

    linked = lambda s: F.arrays_zip(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))).alias("p"), F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("q"))
    pairs = bound(bound(points, lambda ps: F.when(F.size(ps) == 2, ps).otherwise(ordered(ps))), linked)  # two: the ends alone
    return F.filter(pairs, lambda e: (e["p"]["x"] != e["q"]["x"]) | (e["p"]["y"] != e["q"]["y"]))


def cover(cut: DataFrame, keys: list[str], size: float) -> DataFrame:
    """keys, i, j, w, n: every cell that a shape meets; w is its winding number at the cell's left border, n its number of pieces there."""
    line = (F.col("j") + LINE) * size
    crossing = F.when((F.col("y1") > line) != (F.col("y2") > line), F.when(F.col("y1") > F.col("y2"), 1).otherwise(-1)).otherwise(0)
    cells = cut.groupBy(*keys, "i", "j").agg(F.sum(crossing).alias("_c"), F.count("*").alias("n"))
    row = Window.partitionBy(*keys, "j").orderBy("i")
    cells = cells.select(*keys, "i", "j", "n", F.coalesce(F.sum("_c").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("w"), F.sum("_c").over(row).alias("_after"), F.lead("i").over(row).alias("_next"))
    none = F.array().cast("array<struct<i:bigint,w:bigint,n:bigint>>")
    one = lambda i, w, n: F.struct(i.cast("long").alias("i"), w.cast("long").alias("w"), n.cast("long").alias("n"))
    inner = F.when((F.col("_after") != 0) & (F.col("_next") > F.col("i") + 1), F.transform(F.sequence(F.col("i") + 1, F.col("_next") - 1), lambda k: one(k, F.col("_after"), F.lit(0)))).otherwise(none)
    return cells.select(*keys, "j", F.explode(F.concat(F.array(one(F.col("i"), F.col("w"), F.col("n"))), inner)).alias("_x")).select(*keys, "_x.i", "j", "_x.w", "_x.n")


def _less(a: list[Column], b: list[Column]) -> Column:
    """Whether a comes before b, place by place."""
    out = a[-1] < b[-1]
    for x, y in zip(a[-2::-1], b[-2::-1]):
        out = (x < y) | ((x == y) & out)
    return out


def arranged(cut: DataFrame, borders: DataFrame, group: list[str], size: float, digits: int = 7) -> DataFrame:
    """The segments of each group in each cell with what covers them.

    cut: group, side (0 or 1), segment, i, j. borders: group, i, j, w0, w1: the winding number of each side at the cell's left border.
    Gives group, i, j, the segment in its canonical direction, and how many shapes of each side cover its left and right: l0, r0, l1, r1.
    """
    where = [*group, "i", "j"]
    q = 10.0**-digits
    own, others = [F.col(c) for c in SEGMENT], [F.col(f"o{c}") for c in SEGMENT]
    first = _less(own[:2], own[2:])
    d = F.when(first, 1).otherwise(-1)
    way = [F.when(first, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(SEGMENT, ("x2", "y2", "x1", "y1"))]

    def merged(df: DataFrame) -> DataFrame:
        """One row for equal segments, with the sum of the directions on each side."""
        return df.select(*where, *way, *(F.when(F.col("side") == s, d).otherwise(0).alias(f"d{s}") for s in (0, 1))).groupBy(*where, *SEGMENT).agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))

    # Dealt by cell; segments whose directions cancel bound nothing.
    one = materialized(merged(cut.repartition(*where)).where("d0 <> 0 OR d1 <> 0"))
    theirs = [f"o{c}" for c in SEGMENT]
    other = one.select(*where, *(F.col(c).alias(o) for c, o in zip(SEGMENT, theirs)))
    near = (F.greatest("x1", "x2") + q >= F.least("ox1", "ox2")) & (F.greatest("ox1", "ox2") + q >= F.least("x1", "x2")) & (F.greatest("y1", "y2") + q >= F.least("oy1", "oy2")) & (F.greatest("oy1", "oy2") + q >= F.least("y1", "y2"))
    # Each pair once, so that both get the very same point. Step by step: one expression of all this would be more code than the JVM compiles.
    met = one.select(*where, *SEGMENT).join(other, where).where(near & _less(own, others))
    both = [*where, *SEGMENT, *theirs]
    met = met.select(*both, *(F.expr(f"{s}{c}2 - {s}{c}1").alias(f"{n}{c}") for s, n in (("", "_a"), ("o", "_b")) for c in "xy"))
    ways = ["_ax", "_ay", "_bx", "_by"]
    met = met.select(*both, *ways, F.expr("_ax * _by - _ay * _bx").alias("_cross"), F.hypot("_ax", "_ay").alias("_la"), F.hypot("_bx", "_by").alias("_lb"))
    part = lambda c: F.expr(f"try_divide((ox1 - x1) * {c}y - (oy1 - y1) * {c}x, _cross)")
    ends_on = [F.expr(f"abs(({s}x{k} - {o}x1) * {v}y - ({s}y{k} - {o}y1) * {v}x)") <= q * F.col(size_) for s, o, v, size_ in (("o", "", "_a", "_la"), ("", "o", "_b", "_lb")) for k in (1, 2)]
    met = met.select(*both, "_ax", "_ay", F.when(F.abs("_cross") > 1e-12 * F.col("_la") * F.col("_lb"), part("_b")).alias("_t"), part("_a").alias("_u"), *(e.alias(f"_on{n}") for n, e in enumerate(ends_on)))
    crossed = F.col("_t").between(0, 1) & F.col("_u").between(0, 1)
    met = met.select(*both, *(F.when(crossed, F.round(F.col(f"{c}1") + F.col("_t") * F.col(f"_a{c}"), digits)).alias(f"_c{c}") for c in "xy"), *(f"_on{n}" for n in range(4)))
    touch = ", ".join(f"{m}, IF(_on{n}, {s}x{k}, NULL), IF(_on{n}, {s}y{k}, NULL)" for n, (m, s, k) in enumerate((("true", "o", 1), ("true", "o", 2), ("false", "", 1), ("false", "", 2))))
    spot = met.select(*both, F.expr(f"stack(6, true, _cx, _cy, false, _cx, _cy, {touch}) AS (_own, _qx, _qy)")).where("_qx IS NOT NULL")
    spot = spot.select(*where, *(F.when(F.col("_own"), F.col(c)).otherwise(F.col(o)).alias(c) for c, o in zip(SEGMENT, theirs)), "_qx", "_qy")
    # Only what lies between a segment's ends splits it: neighbours that share a corner or run on in its line, the most, split nothing.
    inside = spot.where("NOT (_qx = x1 AND _qy = y1) AND NOT (_qx = x2 AND _qy = y2)")
    inside = inside.where("(_qx - x1) * (x2 - x1) + (_qy - y1) * (y2 - y1) BETWEEN 0 AND (x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)")
    split = materialized(inside.groupBy(*where, *SEGMENT).agg(F.collect_set(F.struct(F.col("_qx").alias("x"), F.col("_qy").alias("y"))).alias("_p")))
    whole = one.join(split, [*where, *SEGMENT], "left_anti").select(*where, "d0", "d1", *SEGMENT)
    ends = F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)))
    parts = one.join(split, [*where, *SEGMENT]).select(*where, "d0", "d1", F.explode(_chain(F.concat(ends, F.col("_p")))).alias("_e")).select(*where, "d0", "d1", *_segment("_e")).unionByName(whole)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # Rounding may turn a short part around; then its direction counts the other way.
    turn = F.when(first, 1).otherwise(-1)
    parts = parts.select(*where, *way, (F.col("d0") * turn).alias("d0"), (F.col("d1") * turn).alias("d1")).groupBy(*where, *SEGMENT).agg(F.sum("d0").alias("d0"), F.sum("d1").alias("d1"))
    parts = materialized(parts.where("d0 <> 0 OR d1 <> 0"))  # both sides of the join below
    # A point just left of each segment's middle, which lies in the segment's cell, and the pieces between it and the left border's reference.
    length = F.hypot(dx, dy)
    spot = parts.select("*", ((F.col("x1") + F.col("x2")) / 2 - dy / length * (q / 4)).alias("_px"), ((F.col("y1") + F.col("y2")) / 2 + dx / length * (q / 4)).alias("_py"))
    seen = parts.select(*where, *(F.col(c).alias(f"o{c}") for c in SEGMENT), F.col("d0").alias("e0"), F.col("d1").alias("e1"))
    px, py = F.col("_px"), F.col("_py")
    level = (F.col("oy1") > py) != (F.col("oy2") > py)
    xc = F.col("ox1") + (py - F.col("oy1")) * F.try_divide(F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1"))
    across = F.when(level & (xc < px), F.when(F.col("oy1") > F.col("oy2"), 1).otherwise(-1)).otherwise(0)
    left, line = F.round(F.col("i") * size, digits), (F.col("j") + LINE) * size
    # Canonical segments run to the right: those that begin on the border lead away from it, with their left above them.
    climbed = F.when((F.col("ox1") <= left) & (F.col("ox2") > left), F.when((F.col("oy1") > line) & (F.col("oy1") <= py), 1).when((F.col("oy1") <= line) & (F.col("oy1") > py), -1).otherwise(0)).otherwise(0)
    step = across + climbed
    counted = spot.join(seen, where).groupBy(*where, *SEGMENT, "d0", "d1").agg(F.sum(F.col("e0") * step).alias("_s0"), F.sum(F.col("e1") * step).alias("_s1"))
    out = counted.join(borders.select(*where, "w0", "w1"), where, "left")
    left_of = [(F.coalesce(f"w{s}", F.lit(0)) + F.col(f"_s{s}")).alias(f"l{s}") for s in (0, 1)]
    return out.select(*where, *SEGMENT, *left_of, "d0", "d1").select(*where, *SEGMENT, "l0", "l1", (F.col("l0") - F.col("d0")).alias("r0"), (F.col("l1") - F.col("d1")).alias("r1"))


#: What is inside, given the coverage by either side.
RULES = {
    "intersection": lambda a, b: (a > 0) & (b > 0),
    "difference": lambda a, b: (a > 0) & (b <= 0),
    "union": lambda a, b: (a > 0) | (b > 0),
    "symmetric_difference": lambda a, b: (a > 0) != (b > 0),
}


def kept(segments: DataFrame, group: list[str], how: str) -> DataFrame:
    """The directed edges of an operation's result, inside on the left."""
    rule = RULES[how]
    left, right = rule(F.col("l0"), F.col("l1")), rule(F.col("r0"), F.col("r1"))
    way = [F.when(left, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(SEGMENT, ("x2", "y2", "x1", "y1"))]
    return segments.where(left != right).select(*group, *way)


class Layer:
    """A table of shapes cut to cells, with the cells that each covers; both are written once."""

    def __init__(self, shapes: DataFrame, key: str, size: float, rings: str = "rings", digits: int = 7) -> None:
        self.key, self.size, self.digits = key, size, digits
        self.pieces = materialized(pieces(boundary(shapes, [key], rings, digits), size, digits))
        self.cover = materialized(cover(self.pieces, [key], size))

    def named(self, name: str, side: int) -> tuple[DataFrame, DataFrame]:
        cut = self.pieces.withColumnRenamed(self.key, name).withColumn("side", F.lit(side))
        return cut, self.cover.select(F.col(self.key).alias(name), "i", "j", F.col("w").alias(f"w{side}"), F.col("n").alias(f"n{side}"))


def _pairs(left: Layer, right: Layer) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments of each pair (a, b) in the cells that both meet, and those cells."""
    cut_a, cover_a = left.named("a", 0)
    cut_b, cover_b = right.named("b", 1)
    cells = cover_a.join(cover_b, ["i", "j"])
    held = materialized(cells)
    edges = cut_a.join(held.select("a", "b", "i", "j"), ["a", "i", "j"]).unionByName(cut_b.join(held.select("a", "b", "i", "j"), ["b", "i", "j"]))
    return arranged(edges, held.where("n0 > 0 OR n1 > 0"), ["a", "b"], left.size, left.digits), held, edges


def intersections(left: Layer, right: Layer) -> DataFrame:
    """a, b and the directed edges of what each pair shares (pairs that share an area only)."""
    return kept(_pairs(left, right)[0], ["a", "b"], "intersection")


def masked(left: Layer, right: Layer, how: str = "difference") -> DataFrame:
    """a and the directed edges of each left shape without (difference) or within (intersection) all of the right layer together."""
    if how not in ("difference", "intersection"):
        raise ValueError("how is difference or intersection")
    cut_a, cover_a = left.named("a", 0)
    cut_b, cover_b = right.named("b", 1)
    both = cover_a.join(cover_b.groupBy("i", "j").agg(F.sum("w1").alias("w1"), F.sum("n1").alias("n1")), ["i", "j"], "left").na.fill(0, ["w1", "n1"])
    held = materialized(both.where("n0 > 0 OR n1 > 0"))
    edges = cut_a.unionByName(held.where("n1 > 0").select("a", "i", "j").join(cut_b.drop("b"), ["i", "j"]))
    return kept(arranged(edges, held, ["a"], left.size, left.digits), ["a"], how)


def dissolved(shapes: DataFrame, by: str, size: float, rings: str = "rings", digits: int = 7) -> DataFrame:
    """by and the directed edges of the union of its shapes; a group's cells are merged each on its own."""
    return _united(boundary(shapes, [by], rings, digits), by, size, digits)


def _united(edges: DataFrame, by: str, size: float, digits: int) -> DataFrame:
    """by and the directed edges of what the given ones surround."""
    cut = materialized(pieces(edges, size, digits))
    cells = cover(cut, [by], size).select(by, "i", "j", F.col("w").alias("w0"), F.lit(0).alias("w1"), "n").where("n > 0")
    return kept(arranged(cut.withColumn("side", F.lit(0)), cells, [by], size, digits), [by], "union")


def _capsules(shapes: DataFrame, key: str, distance: float, quarter: int, rings: str, digits: int) -> DataFrame:
    """key and rings: around each edge all that lies within the distance, its ends rounded by ``quarter`` chords to a right angle."""
    edges = boundary(shapes, [key], rings, digits)
    half = 2 * quarter
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    # Chords lie at the same angles in every capsule, so that ends of neighbours coincide; the sides follow the edge.
    at = F.atan2(dy, dx)
    turn = lambda k, x, y, base: F.struct((F.col(x) + distance * F.cos(base + k * math.pi / half)).alias("x"), (F.col(y) + distance * F.sin(base + k * math.pi / half)).alias("y"))
    ring = F.array(*(turn(k, "x2", "y2", at - math.pi / 2) for k in range(half + 1)), *(turn(k, "x1", "y1", at + math.pi / 2) for k in range(half + 1)))
    return edges.select(key, F.array(ring).alias("rings"))


def _rims(shapes: DataFrame, key: str, distance: float, quarter: int, rings: str, digits: int) -> DataFrame:
    """key and rings: what the capsules around a shape's edges add to it: a rectangle outside each edge, and at each corner that juts out the chords of either edge's end.

    The rest of a capsule lies within the shape or within its neighbours, and would only meet them piece by piece.
    """
    step = math.pi / (2 * quarter)
    n = F.size("_r")
    at = lambda i: F.get(F.col("_r"), (i + n) % n)
    # Written, since a lambda would compute the ring anew for each of its corners.
    plain = materialized(_turned(shapes, [key], rings, digits)).select(key, F.filter("_r", lambda p, i: (p["x"] != at(i - 1)["x"]) | (p["y"] != at(i - 1)["y"])).alias("_r"))
    corner = materialized(plain).select(key, F.explode(F.transform("_r", lambda p, i: F.struct(at(i - 1).alias("o"), p.alias("p"), at(i + 1).alias("q")))).alias("_c"))
    way = lambda a, b: F.atan2(F.col(f"_c.{b}.y") - F.col(f"_c.{a}.y"), F.col(f"_c.{b}.x") - F.col(f"_c.{a}.x")) - math.pi / 2
    corner = corner.select(key, "_c", way("o", "p").alias("_in"), way("p", "q").alias("_out"))
    turn = F.col("_out") - F.col("_in")
    steps = F.when(turn <= -math.pi, turn + 2 * math.pi).when(turn > math.pi, turn - 2 * math.pi).otherwise(turn) / step
    corner = materialized(corner.withColumn("_s", steps))
    on = lambda c, a: F.struct((F.col(f"_c.{c}.x") + distance * F.cos(a)).alias("x"), (F.col(f"_c.{c}.y") + distance * F.sin(a)).alias("y"))
    plain_point = lambda c: F.struct(F.col(f"_c.{c}.x").alias("x"), F.col(f"_c.{c}.y").alias("y"))
    count = F.ceil(F.col("_s") - 1e-9).cast("int")
    fan = lambda first, sign: F.concat(F.array(plain_point("p")), F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1))), lambda k: on("p", F.col(first) + sign * k * step)))
    none = F.array().cast(RINGS)
    side = F.array(F.array(plain_point("p"), on("p", F.col("_out")), on("q", F.col("_out")), plain_point("q")))
    juts = F.col("_s") > 1e-9
    ends = F.when(juts, F.array(fan("_in", 1))).otherwise(none), F.when(juts & (F.abs(F.col("_s") - F.round("_s")) > 1e-9), F.array(fan("_out", -1))).otherwise(none)
    return corner.select(key, F.explode(F.concat(side, *ends)).alias("_ring")).select(key, F.array("_ring").alias("rings"))


def _outset(turned: DataFrame, key: str, distance: float, quarter: int, digits: int) -> DataFrame:
    """key and the directed edges of shapes with their rims, from rings with the inside on the left: without those that rims and shapes share, which cancel.

    Outside each edge runs its side; from side to side lead chords at corners that jut out, and ways by the corner itself elsewhere.
    """
    step = math.pi / (2 * quarter)
    n = F.size("_r")
    apart = turned.select(key, F.filter("_r", lambda p, i: (p["x"] != F.get(F.col("_r"), (i + n - 1) % n)["x"]) | (p["y"] != F.get(F.col("_r"), (i + n - 1) % n)["y"])).alias("_r"))
    round_ = F.arrays_zip(F.concat(F.slice("_r", -1, 1), F.slice("_r", 1, n - 1)).alias("o"), F.col("_r").alias("p"), F.concat(F.slice("_r", 2, n), F.slice("_r", 1, 1)).alias("q"))
    corner = apart.select(key, F.explode(round_).alias("_c"))
    way = lambda a, b: F.atan2(F.col(f"_c.{b}.y") - F.col(f"_c.{a}.y"), F.col(f"_c.{b}.x") - F.col(f"_c.{a}.x")) - math.pi / 2
    corner = corner.select(key, "_c", way("o", "p").alias("_in"), way("p", "q").alias("_out"))
    turn = F.col("_out") - F.col("_in")
    corner = corner.withColumn("_s", F.when(turn <= -math.pi, turn + 2 * math.pi).when(turn > math.pi, turn - 2 * math.pi).otherwise(turn) / step)
    on = lambda c, a: F.struct(F.round(F.col(f"_c.{c}.x") + distance * F.cos(a), digits).alias("x"), F.round(F.col(f"_c.{c}.y") + distance * F.sin(a), digits).alias("y"))
    own = F.struct(F.col("_c.p.x").alias("x"), F.col("_c.p.y").alias("y"))
    first, last, side = on("p", F.col("_in")), on("p", F.col("_out")), on("q", F.col("_out"))
    count = F.greatest(F.ceil(F.col("_s") - 1e-9).cast("int"), F.lit(1))
    even = F.abs(F.col("_s") - F.round("_s")) <= 1e-9
    # Chords lie at the incoming edge's angles; where they don't end at the outgoing edge's, both edges' chords run past each other.
    chords = F.transform(F.sequence(F.lit(1), count), lambda k: on("p", F.col("_in") + k * step))
    back = F.transform(F.sequence(count, F.lit(1)), lambda k: on("p", F.col("_out") - k * step))
    path = F.when(F.col("_s") <= 1e-9, F.array(first, own, last, side)).when(even, F.concat(F.array(first), F.slice(chords, 1, count - 1), F.array(last, side))).otherwise(F.concat(F.array(first), chords, F.array(own), back, F.array(last, side)))
    linked = F.arrays_zip(F.slice("_path", 1, F.size("_path") - 1).alias("p"), F.slice("_path", 2, F.size("_path")).alias("q"))
    return corner.select(key, path.alias("_path")).select(key, F.explode(linked).alias("_e")).select(key, *_segment("_e")).where("x1 <> x2 OR y1 <> y2")


def _one_way(c: np.ndarray, s: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal segments of a shape as one, in order, with the sum of their directions; those that cancel bound nothing."""
    back = (s[:, 2] < s[:, 0]) | ((s[:, 2] == s[:, 0]) & (s[:, 3] < s[:, 1]))
    s, d = np.where(back[:, None], s[:, [2, 3, 0, 1]], s), np.where(back, -d, d)
    order = np.lexsort((*s.T[::-1], c))
    c, s, d = c[order], s[order], d[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(len(c), 1), bool), (c[1:] != c[:-1]) | (s[1:] != s[:-1]).any(axis=1)]))
    d = np.add.reduceat(d, new) if len(new) else d
    return c[new][d != 0], s[new][d != 0], d[d != 0]


def _with(c: np.ndarray, later: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of pairs of segments of one shape: each with all, or with later ones only."""
    start = np.arange(1, len(c) + 1) if later else np.searchsorted(c, c, "left")
    count = np.searchsorted(c, c, "right") - start
    total = np.concatenate([[0], np.cumsum(count)])
    low = 0
    while low < len(c):
        high = max(low + 1, int(np.searchsorted(total, total[low] + PAIRS, "right")) - 1)
        a = np.repeat(np.arange(low, high), count[low:high])
        yield a, np.arange(len(a)) + np.repeat(start[low:high] - total[low:high] + total[low], count[low:high])
        low = high


def _points_on(c: np.ndarray, s: np.ndarray, digits: int) -> np.ndarray:
    """segment, x, y: where segments of one shape cross or touch within one of them; the same steps as in ``arranged``."""
    q, found = 10.0**-digits, [np.empty((0, 3))]
    for a, b in _with(c, True):
        near = (s[a, 2] + q >= s[b, 0]) & (s[b, 2] + q >= s[a, 0])
        a, b = a[near], b[near]
        low, high = np.minimum(s[:, 1], s[:, 3]), np.maximum(s[:, 1], s[:, 3])
        near = (high[a] + q >= low[b]) & (high[b] + q >= low[a])
        a, b = a[near], b[near]
        (x1, y1, x2, y2), (ox1, oy1, ox2, oy2) = s[a].T, s[b].T
        ax, ay, bx, by = x2 - x1, y2 - y1, ox2 - ox1, oy2 - oy1
        cross, la, lb = ax * by - ay * bx, np.hypot(ax, ay), np.hypot(bx, by)
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = ((ox1 - x1) * by - (oy1 - y1) * bx) / cross, ((ox1 - x1) * ay - (oy1 - y1) * ax) / cross
        met = (np.abs(cross) > 1e-12 * la * lb) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        x, y = (np.round(p[met] + t[met] * v[met], digits) for p, v in ((x1, ax), (y1, ay)))
        found += [np.column_stack([k[met], x, y]) for k in (a, b)]
        found += [np.column_stack([a, x, y])[np.abs((x - x1) * ay - (y - y1) * ax) <= q * la] for x, y in ((ox1, oy1), (ox2, oy2))]
        found += [np.column_stack([b, x, y])[np.abs((x - ox1) * by - (y - oy1) * bx) <= q * lb] for x, y in ((x1, y1), (x2, y2))]
    points = np.concatenate(found)
    x1, y1, x2, y2 = s[points[:, 0].astype(int)].T
    along = (points[:, 1] - x1) * (x2 - x1) + (points[:, 2] - y1) * (y2 - y1)
    ends = ((points[:, 1] == x1) & (points[:, 2] == y1)) | ((points[:, 1] == x2) & (points[:, 2] == y2))
    return points[~ends & (along >= 0) & (along <= (x2 - x1) ** 2 + (y2 - y1) ** 2)]


def _union(c: np.ndarray, s: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """The directed edges (c: the shape of each, in order) of what those of each shape surround."""
    c, s, d = _one_way(c, s, np.ones(len(c), np.int64))
    points = _points_on(c, s, digits)
    if len(points):
        cut = np.unique(points[:, 0].astype(int))
        points = np.concatenate([points, *(np.column_stack([cut, s[cut, k], s[cut, k + 1]]) for k in (0, 2))])
        of = points[:, 0].astype(int)
        along = (points[:, 1] - s[of, 0]) * (s[of, 2] - s[of, 0]) + (points[:, 2] - s[of, 1]) * (s[of, 3] - s[of, 1])
        points = points[np.lexsort((points[:, 2], points[:, 1], along, of))]
        next_ = (points[1:, 0] == points[:-1, 0]) & (points[1:, 1:] != points[:-1, 1:]).any(axis=1)
        of, whole = points[:-1, 0].astype(int)[next_], np.ones(len(c), bool)
        whole[cut] = False
        parts = np.column_stack([points[:-1, 1:], points[1:, 1:]])[next_]
        c, s, d = _one_way(np.concatenate([c[whole], c[of]]), np.concatenate([s[whole], parts]), np.concatenate([d[whole], d[of]]))
    # How many times what is left of a segment's middle is surrounded: the segments between it and the far left.
    x1, y1, x2, y2 = s.T
    length = np.hypot(x2 - x1, y2 - y1)
    px, py = (x1 + x2) / 2 - (y2 - y1) / length * (10.0**-digits / 4), (y1 + y2) / 2 + (x2 - x1) / length * (10.0**-digits / 4)
    left = np.zeros(len(c))
    for a, b in _with(c, False):
        level = (y1[b] > py[a]) != (y2[b] > py[a])
        a, b = a[level], b[level]
        at = x1[b] + (py[a] - y1[b]) * (x2[b] - x1[b]) / (y2[b] - y1[b])
        left += np.bincount(a, np.where(at < px[a], np.where(y1[b] > y2[b], d[b], -d[b]), 0), len(c))
    inside, beyond = left > 0, left - d > 0
    edge = inside != beyond
    return c[edge], np.where(inside[:, None], s, s[:, [2, 3, 0, 1]])[edge]


def _changes(column: pa.Array) -> np.ndarray:
    """Whether a value differs from the one before it; nulls are alike."""
    values = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return values[1:] != values[:-1]


def _merged_whole(edges: DataFrame, key: str, digits: int) -> DataFrame:
    """key and the directed edges of what those of each key surround. The edges of a key lie one after the other in one partition, and are merged without a grid."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, needed = [], 0, AT_ONCE

        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            first = np.concatenate([[0], np.flatnonzero(_changes(table[key].combine_chunks())) + 1])
            c = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(table))))
            c, s = _union(c, np.column_stack([table[n].to_numpy() for n in SEGMENT]), digits)
            columns = [table[key].take(pa.array(first[c])), *(pa.array(v) for v in s.T)]
            yield from pa.table(columns, names=[key, *SEGMENT]).to_batches(max_chunksize=10_000)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= needed:
                table = pa.Table.from_batches(held)
                ends = np.flatnonzero(_changes(table[key].combine_chunks())) + 1
                end = int(ends[-1]) if len(ends) else 0  # the last key may go on in the next batch
                if end:
                    yield from done(table.slice(0, end))
                held, rows = table.slice(end).to_batches(), len(table) - end
                needed = max(AT_ONCE, 2 * rows)
        if rows:
            yield from done(pa.Table.from_batches(held))

    return edges.select(key, *SEGMENT).mapInArrow(merged, T.StructType([edges.schema[key], *(T.StructField(n, T.DoubleType()) for n in SEGMENT)]))


def buffered(shapes: DataFrame, key: str, distance: float, size: float, quarter: int = 8, rings: str = "rings", digits: int = 7) -> DataFrame:
    """key and the directed edges of all within ``distance`` of each shape, or, if it is negative, of all deeper inside than it.

    Round corners are chords, ``quarter`` to a right angle: inside the true arc by less than distance * (1 - cos(pi / (4 * quarter))),
    and of it in area by the factor sin(t) / t with t = pi / (2 * quarter).
    """
    if distance >= 0:
        turned = _turned(shapes, [key], rings, digits)
        large = materialized(turned.groupBy(key).agg(F.sum(F.size("_r")).alias("_n")).where(F.col("_n") * (quarter + 3) > WHOLE).select(key))
        # Dealt as rings, a fraction of their edges, to as many tasks as are set, since few bytes are much work; what follows takes them in this order.
        tasks = int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        small = turned.join(large, key, "left_anti").repartition(tasks, key).sortWithinPartitions(key)
        whole = _merged_whole(_outset(small, key, distance, quarter, digits), key, digits)
        rest = _outset(turned.join(large, key, "left_semi").repartition(key, "_r"), key, distance, quarter, digits)
        return whole.unionByName(_united(rest, key, size, digits))
    plain = shapes.select(key, F.col(rings).alias("rings"))
    around = _capsules(shapes, key, -distance, quarter, rings, digits)
    parts = [materialized(pieces(boundary(df, [key], "rings", digits), size, digits)) for df in (plain, around)]
    cells = [cover(p, [key], size).select(key, "i", "j", F.col("w").alias(f"w{s}"), F.col("n").alias(f"n{s}")) for s, p in enumerate(parts)]
    borders = cells[0].join(cells[1], [key, "i", "j"], "full").na.fill(0)
    edges = parts[0].withColumn("side", F.lit(0)).unionByName(parts[1].withColumn("side", F.lit(1)))
    return kept(arranged(edges, borders, [key], size, digits), [key], "difference")


def measured(edges: DataFrame, group: list[str]) -> DataFrame:
    """group, area and length of directed edges."""
    return edges.groupBy(*group).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"), F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"))


def shape_areas(shapes: DataFrame, key: str, rings: str = "rings", digits: int = 7) -> DataFrame:
    """key and area; parts of a key count each."""
    return measured(boundary(shapes, [key], rings, digits), [key]).select(key, "area")


def related(left: Layer, right: Layer) -> DataFrame:
    """a, b, shared_area of every pair that shares a point, and whether a lies within b and contains b."""
    segments, cells, _ = _pairs(left, right)
    segments = materialized(segments)
    area = measured(kept(segments, ["a", "b"], "intersection"), ["a", "b"]).select("a", "b", F.col("area").alias("shared_area"))
    both = F.array(*(F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in (1, 2)))
    ends = segments.select("a", "b", (F.col("l0") != F.col("r0")).alias("_on0"), (F.col("l1") != F.col("r1")).alias("_on1"), F.explode(both).alias("_p"))
    touch = ends.groupBy("a", "b", "_p").agg(F.max("_on0").alias("_on0"), F.max("_on1").alias("_on1")).where("_on0 AND _on1").select("a", "b")
    # Corners on lines of the grid may meet although their pieces lie in different cells.
    on_line = lambda c: F.col(f"_p.{c}") == F.round(F.round(F.col(f"_p.{c}") / left.size) * left.size, left.digits)
    corner = [layer.pieces.select(F.col(layer.key).alias(n), F.explode(both).alias("_p")).where(on_line("x") | on_line("y")).distinct() for layer, n in ((left, "a"), (right, "b"))]
    touch = touch.unionAll(corner[0].join(corner[1], "_p").select("a", "b"))
    inner = cells.where("n0 = 0 AND n1 = 0 AND w0 > 0 AND w1 > 0").select("a", "b")
    pairs = touch.unionAll(inner).unionAll(area.where("shared_area > 0").select("a", "b")).distinct()
    own = [measured(layer.pieces, [layer.key]).select(F.col(layer.key).alias(n), F.col("area").alias(f"area_{n}")) for layer, n in ((left, "a"), (right, "b"))]
    out = pairs.join(area, ["a", "b"], "left").na.fill(0.0, ["shared_area"]).join(own[0], "a").join(own[1], "b")
    whole = lambda n: F.col("shared_area") >= F.col(f"area_{n}") * (1 - 1e-9)
    return out.select("a", "b", "shared_area", whole("a").alias("within"), whole("b").alias("contains"))


def _chained(edges: list[tuple]) -> list[tuple]:
    """Directed edges of a tile as chains: (edge it comes from or none, edge it goes to or none, corners, whether it is closed).

    An edge is (x1, y1, x2, y2, whether it begins in the tile, whether it ends there). What begins or ends elsewhere links the chain to one of another tile.
    At a corner of several rings the sharpest turn to the left is taken; where an edge was lost to rounding, a chain begins or ends without a link.
    """
    out = defaultdict(list)
    for k, e in enumerate(edges):
        if e[4]:
            out[e[:2]].append(k)
    after, before = {}, {}
    for k, (x1, y1, x2, y2, _, here) in enumerate(edges):
        ahead = out.get((x2, y2)) if here else None
        if ahead:
            way = math.atan2(y2 - y1, x2 - x1)
            n = ahead[0] if len(ahead) == 1 else max(ahead, key=lambda n: (math.atan2(edges[n][3] - y2, edges[n][2] - x2) - way + math.pi + 1e-9) % (2 * math.pi))
            ahead.remove(n)
            after[k], before[n] = n, k

    def corner(k: int, n: int) -> bool:
        """Not so where the grid cut an edge: there a corner lies between its neighbours."""
        (x1, y1, x2, y2), (_, _, x3, y3) = edges[k][:4], edges[n][:4]
        return abs((x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2)) > 1e-9 * math.hypot(x2 - x1, y2 - y1) * math.hypot(x3 - x2, y3 - y2)

    chains, done = [], set()
    for k in [*(k for k in range(len(edges)) if k not in before), *range(len(edges))]:
        if k in done:
            continue
        points = [edges[k][:2]] if k not in before and edges[k][4] else []
        at = k
        while at not in done:
            done.add(at)
            n = after.get(at)
            if n is None:
                break
            if corner(at, n):
                points.append(edges[at][2:4])
            at = n
        if k in before:
            chains.append((None, None, points, True))
            continue
        head, tail = (None if edges[e][4 + end] else edges[e][:4] for e, end in ((k, 0), (at, 1)))
        points += [edges[at][2:4]] if edges[at][5] else []
        chains.append((head, tail, points, head is None and tail is None))
    return chains


def _linked(chains: list[tuple]) -> list[tuple]:
    """Chains as ``_chained`` gives them, those that meet within the tile as one."""
    heads = {c[0]: k for k, c in enumerate(chains) if c[0] is not None}
    tails = {c[1] for c in chains if c[1] is not None}
    out, done = [], set()
    for k in [*(k for k, c in enumerate(chains) if c[0] not in tails), *range(len(chains))]:
        if k in done:
            continue
        points, at, closed = [], k, False
        while True:
            done.add(at)
            points += chains[at][2]
            n = heads.get(chains[at][1]) if chains[at][1] is not None else None
            if n is None:
                break
            if n in done:
                closed = True
                break
            at = n
        head, tail = (None, None) if closed else (chains[k][0], chains[at][1])
        out.append((head, tail, points, closed or (head is None and tail is None)))
    return out


def _rings_of(points: list[tuple[float, float]]) -> list[list[tuple[float, float]]]:
    """A closed chain from its least corner on; a ring that comes by there again is closed there."""
    if not points:
        return []
    least = min(points)
    first = points.index(least)
    points = points[first:] + points[:first]
    starts = [k for k, p in enumerate(points) if p == least]
    return [points[a:b] for a, b in zip(starts, [*starts[1:], len(points)]) if b - a > 2]


def _rings(edges: DataFrame, group: list[str], side: float) -> DataFrame:
    """group, ring and area of all rings that directed edges bound, outlines above zero and holes below.

    Edges are chained tile by tile; chains that leave their tile are linked in tiles four times as wide, which lie elsewhere, until all are closed.
    """
    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    link = [(f"{e}{n}", pa.float64()) for e in "ht" for n in SEGMENT]
    schema = T.StructType([*(edges.schema[g] for g in group), *T.StructType.fromDDL(", ".join(f"{n} double" for n, _ in link) + ", ring array<struct<x:double,y:double>>, area double")])

    def table(key: tuple, chains: list[tuple]) -> pa.Table:
        rows = []
        for head, tail, points, closed in chains:
            for ring in _rings_of(points) if closed else [points]:
                area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1])) / 2 if closed else None
                if area != 0:
                    rows.append((*(head or (None,) * 4), *(tail or (None,) * 4), [{"x": x, "y": y} for x, y in ring], area))
        kinds = [*link, ("ring", pa.list_(point)), ("area", pa.float64())]
        own = [pa.array([k.as_py()] * len(rows), k.type) for k in key[: len(group)]]
        return pa.table([*own, *(pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds))], names=[*group, *(n for n, _ in kinds)])

    def chain(key: tuple, rows: pa.Table) -> pa.Table:
        return table(key, _chained(sorted(zip(*(rows[c].to_pylist() for c in (*SEGMENT, "_s", "_e"))))))

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        links = list(zip(*(rows[n].to_pylist() for n, _ in link)))
        rings = [[(p["x"], p["y"]) for p in r] for r in rows["ring"].to_pylist()]
        return table(key, _linked([(k[:4] if k[0] is not None else None, k[4:] if k[4] is not None else None, r, False) for k, r in zip(links, rings)]))

    def tile(x: Column, y: Column, level: int) -> Column:
        # Shifted from level to level, so that what lies across a border of tiles does not do so for long.
        return F.struct(*(F.floor(v / (side * 4.0**level) + (level + 1) * LINE % 1).alias(n) for n, v in (("i", x), ("j", y))))

    tiles = F.array_distinct(F.array(tile(F.col("x1"), F.col("y1"), 0), tile(F.col("x2"), F.col("y2"), 0)))
    dealt = edges.select(*group, *SEGMENT, F.explode(tiles).alias("_t"))
    dealt = dealt.select("*", *((tile(F.col(f"x{k}"), F.col(f"y{k}"), 0) == F.col("_t")).alias(n) for k, n in ((1, "_s"), (2, "_e"))))
    rounds = [materialized(dealt.groupBy(*group, "_t").applyInArrow(chain, schema))]
    open_, level = rounds[0].where("area IS NULL"), 1
    while not open_.isEmpty():
        if level == LEVELS:  # edges that another should have met were lost: what is left is closed where it ends
            open_ = open_.select(*group, *(F.lit(None).cast("double").alias(n) for n, _ in link), "ring", "area", F.monotonically_increasing_id().alias("_t"))
            rounds.append(materialized(open_.groupBy(*group, "_t").applyInArrow(join, schema)))
            break
        ends = [tile(F.coalesce(f"{a}x1", f"{b}x1"), F.coalesce(f"{a}y1", f"{b}y1"), level) for a, b in ("ht", "th")]
        placed = open_.select("*", ends[0].alias("_t"), (ends[0] == ends[1]).alias("_met"))
        met = placed.where("_met").drop("_met").groupBy(*group, "_t").applyInArrow(join, schema)
        rounds.append(materialized(met.unionByName(placed.where("NOT _met").drop("_t", "_met"))))
        open_, level = rounds[-1].where("area IS NULL"), level + 1
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.where("area IS NOT NULL").select(*group, "ring", "area")


def _owners(outer: DataFrame, holes: DataFrame) -> DataFrame:
    """_g, _o, ring: the holes, each with the smallest outline of its group that it lies in.

    Boxes of outlines meet holes in cells as wide as the box; corners are looked at only where several boxes hold a hole, and never those of the largest.
    """
    box = outer.select("_g", "_o", "area", *(f(F.col(f"ring.{c}")).alias(f"{c}{n}") for c in "xy" for n, f in ((0, F.array_min), (1, F.array_max))))
    box = box.withColumn("_l", F.ceil(F.log2(F.greatest(F.expr("x1 - x0"), F.expr("y1 - y0")))))
    cells = lambda c: F.sequence(F.floor(F.col(f"{c}0") / F.pow(F.lit(2.0), "_l")), F.floor(F.col(f"{c}1") / F.pow(F.lit(2.0), "_l")))
    spread = box.withColumn("_i", F.explode(cells("x"))).withColumn("_j", F.explode(cells("y")))
    middle = lambda c: ((F.col("ring")[0][c] + F.col("ring")[1][c]) / 2).alias(f"p{c}")
    spot = holes.select("_g", F.col("_o").alias("_h"), (-F.col("area")).alias("_a"), middle("x"), middle("y"))
    at = lambda c: F.floor(F.col(f"p{c}") / F.pow(F.lit(2.0), "_l"))
    spot = spot.join(box.select("_g", "_l").distinct(), "_g").withColumn("_i", at("x")).withColumn("_j", at("y"))
    met = spot.join(spread, ["_g", "_l", "_i", "_j"]).where("px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1 AND area > _a")
    held = materialized(met.groupBy("_g", "_h", "px", "py").agg(F.array_sort(F.collect_list(F.struct("area", "_o"))).alias("_c")))
    asked = held.where("size(_c) > 1").select("_g", "_h", "px", "py", F.explode(F.slice("_c", F.lit(1), F.size("_c") - 1)).alias("_x")).select("_g", "_h", "px", "py", "_x.area", "_x._o")
    rises = lambda e: (e["p"]["y"] > F.col("py")) != (e["q"]["y"] > F.col("py"))
    left = lambda e: F.col("px") < e["p"]["x"] + (F.col("py") - e["p"]["y"]) * F.try_divide(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"])
    inside = F.size(F.filter(_ring_edges(F.col("ring")), lambda e: rises(e) & left(e))) % 2 == 1
    least = asked.join(outer.select("_g", "_o", "ring"), ["_g", "_o"]).where(inside).groupBy("_g", "_h").agg(F.min_by("_o", "area").alias("_in"))
    owner = held.join(least, ["_g", "_h"], "left").select("_g", "_h", F.coalesce("_in", F.element_at("_c", -1)["_o"]).alias("_o"))
    return owner.join(holes.select("_g", F.col("_o").alias("_h"), "ring"), ["_g", "_h"]).select("_g", "_o", "ring")


def outlines(edges: DataFrame, group: list[str], size: float | None = None) -> DataFrame:
    """group, part and rings: the parts that directed edges bound, ready to be shapes again; parts are numbered by area. A task holds the edges of a tile of 64 cells of ``size`` (else of 64 mean edges) or one part, as its row does."""
    if size is None:
        edges = materialized(edges)
        size = edges.agg(F.avg(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))).first()[0] or 1.0
    rings = _rings(edges, group, 64 * size).select(F.struct(*group).alias("_g"), "ring", "area", F.struct(F.col("ring")[0].alias("p"), F.col("ring")[1].alias("q")).alias("_o"))
    outer, holes = rings.where("area > 0"), rings.where("area < 0")
    within = _owners(outer, holes).groupBy("_g", "_o").agg(F.array_sort(F.collect_list("ring")).alias("_holes"))
    parts = outer.join(within, ["_g", "_o"], "left").select("_g", "_o", "area", F.concat(F.array("ring"), F.coalesce("_holes", F.array().cast(RINGS))).alias("rings"))
    return _numbered(parts, ["_g", "area", "_o"]).select(*(F.col("_g")[g].alias(g) for g in group), F.col("_n").cast("int").alias("part"), "rings")


def overlay(left: Layer, right: Layer, how: str = "intersection") -> DataFrame:
    """a, b, area of the pieces that an overlay of two layers makes; a or b is null where only the other layer is.

    intersection: of each pair; difference: left shapes without the right layer; symmetric_difference: both layers' rests; identity: intersection and the left's rests; union: all.
    """
    parts = {"intersection": "ab", "difference": "a", "symmetric_difference": "a b", "identity": "ab a", "union": "ab a b"}[how].split()
    tables = []
    for p in parts:
        if p == "ab":
            got = measured(intersections(left, right), ["a", "b"])
        else:
            got = measured(masked(left, right) if p == "a" else masked(right, left), ["a"])
            layer, other = (left, right) if p == "a" else (right, left)
            null = F.lit(None).cast(other.pieces.schema[other.key].dataType)
            got = got.select(*((F.col("a").alias("a"), null.alias("b")) if p == "a" else (null.alias("a"), F.col("a").alias("b"))), "area")
        tables.append(got.select("a", "b", "area"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def tabulated(zones: Layer, classes: Layer, zone_areas: DataFrame, class_of: DataFrame) -> DataFrame:
    """zone, class, area and percent of the zone that each class covers, by overlay.

    zone_areas: the zones' key and area; class_of: the other layer's key and ``class``.
    """
    shared = measured(intersections(zones, classes), ["a", "b"]).where("area > 0").select(F.col("a").alias("zone"), F.col("b").alias("_b"), "area")
    named = shared.join(class_of.select(F.col(classes.key).alias("_b"), "class").distinct(), "_b").groupBy("zone", "class").agg(F.sum("area").alias("area"))
    whole = zone_areas.select(F.col(zones.key).alias("zone"), F.col("area").alias("_whole"))
    return named.join(whole, "zone").select("zone", "class", "area", F.try_divide(F.col("area") * 100, F.col("_whole")).alias("percent"))
