"""Joins and measures of points, boxes and polygons through grid cells.

A spatial join is an equality join on grid cells followed by the exact predicate: boxes and
polygons are entered in each cell that their bounds touch, points in one. Only cell size
and bounds decide how often a shape is entered, so no side is broadcast or crossed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.expressions import haversine
from orbweave.sources.io import materialized


def tessellate(bounds: tuple[float, float, float, float], size: float, df: DataFrame) -> DataFrame:
    """Square cells over bounds: zone_id, minx, miny, maxx, maxy; df only lends its session."""
    minx, miny, maxx, maxy = bounds
    nx, ny = (max(1, int(-(-(b - a) // size))) for a, b in ((minx, maxx), (miny, maxy)))
    cells = df.sparkSession.range(nx * ny)
    c, r = F.col("id") % nx, F.floor(F.col("id") / nx)
    return cells.select(F.col("id").alias("zone_id"), (minx + c * size).alias("minx"), (miny + r * size).alias("miny"), (minx + (c + 1) * size).alias("maxx"), (miny + (r + 1) * size).alias("maxy"))


def hexagons(bounds: tuple[float, float, float, float], size: float, df: DataFrame) -> DataFrame:
    """Centres of hexagonal cells: columns 1.5 sizes apart, rows by the square root of 3, odd columns shifted by half a row."""
    minx, miny, maxx, maxy = bounds
    nx, ny = int((maxx - minx) / (1.5 * size)) + 1, int((maxy - miny) / (3**0.5 * size)) + 1
    c, r = F.col("id") % nx, F.floor(F.col("id") / nx)
    return df.sparkSession.range(nx * ny).select(F.col("id").alias("zone_id"), (minx + c * 1.5 * size).alias("x"), (miny + (r + F.when(c % 2 == 1, 0.5).otherwise(0.0)) * 3**0.5 * size).alias("y"))


def _cells(lo: str, hi: str, size: float) -> Column:
    return F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor(F.col(hi) / size)))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float, how: str = "inner", x: str = "x", y: str = "y") -> DataFrame:
    """Points with the boxes that hold them (lower edges in, upper edges out)."""
    b = boxes.withColumn("_cx", _cells("minx", "maxx", size)).withColumn("_cy", _cells("miny", "maxy", size))
    p = points.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})
    held = (p["_cx"] == b["_cx"]) & (p["_cy"] == b["_cy"]) & (F.col(x) >= F.col("minx")) & (F.col(x) < F.col("maxx")) & (F.col(y) >= F.col("miny")) & (F.col(y) < F.col("maxy"))
    return p.join(b, held, how).drop("_cx", "_cy")


def summarize_within(zones: DataFrame, points: DataFrame, size: float, value: str, zone: str = "zone_id") -> DataFrame:
    """Count and sum of the points in each zone; zones without points keep their id, with zeros."""
    inside = points_in_boxes(points, zones, size).groupBy(zone).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return zones.select(zone).join(inside, zone, "left").na.fill({"n": 0, "total": 0.0})


def box_pairs(boxes: DataFrame, size: float, key: str) -> DataFrame:
    """Pairs a < b of boxes that share at least a boundary point, with the area that they share."""
    cells = boxes.withColumn("_cx", _cells("minx", "maxx", size)).withColumn("_cy", _cells("miny", "maxy", size))
    a, b = (cells.select(*(F.col(c).alias(f"{s}_{c}") for c in cells.columns)) for s in "ab")
    w = F.least("a_maxx", "b_maxx") - F.greatest("a_minx", "b_minx")
    h = F.least("a_maxy", "b_maxy") - F.greatest("a_miny", "b_miny")
    met = a.join(b, (F.col("a__cx") == F.col("b__cx")) & (F.col("a__cy") == F.col("b__cy")) & (F.col(f"a_{key}") < F.col(f"b_{key}")) & (w >= 0) & (h >= 0))
    return met.select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), (w * h).alias("shared_area"), F.greatest(w, h).alias("shared_edge")).distinct()


def within_distance(target: DataFrame, reference: DataFrame, distance: float, mode: str = "within", x: str = "x", y: str = "y") -> DataFrame:
    """Targets that have (or, beyond, lack) a reference point within the distance."""
    r = reference.select(F.col(x).alias("_rx"), F.col(y).alias("_ry"))
    near = F.explode(F.array(*(F.struct((F.floor(F.col("_rx") / distance) + i).alias("i"), (F.floor(F.col("_ry") / distance) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    r = r.select("*", near.alias("_c")).hint("merge")  # statistics do not see the ninefold entries; unhinted, they may go through the driver
    close = (F.floor(target[x] / distance) == r["_c.i"]) & (F.floor(target[y] / distance) == r["_c.j"]) & (F.hypot(target[x] - r["_rx"], target[y] - r["_ry"]) <= distance)
    return target.join(r, close, "left_semi" if mode == "within" else "left_anti")


LEAF, FAN = 8, 16  # places in a box of the lowest level, boxes in a box of the next
SMALL = 400_000  # places at most that nearest() sends to all tasks
DEALT = 25_000  # left places a task


def _along_curve(batches: Iterator[pa.RecordBatch], lows: tuple[float, float], wide: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """_px, _py and _d, where the place stands on Hilbert's curve of 31 bits a side, so that what is near in order is near in space."""
    for batch in batches:
        at = [np.asarray(batch.column(c), dtype=np.float64) for c in ("_px", "_py")]
        x, y = (np.clip((v - lo) / (w or 1.0) * (2.0**31 - 1), 0, 2.0**31 - 1).astype(np.int64) for v, lo, w in zip(at, lows, wide))
        d = np.zeros(len(x), dtype=np.int64)
        for bit in range(30, -1, -1):
            rx, ry = x >> bit & 1, y >> bit & 1
            d = d * 4 + (3 * rx ^ ry)
            flip = (ry == 0) & (rx == 1)
            x, y = np.where(flip, 2**31 - 1 - x, x), np.where(flip, 2**31 - 1 - y, y)
            x, y = np.where(ry == 0, y, x), np.where(ry == 0, x, y)
        yield pa.RecordBatch.from_arrays([*map(pa.array, at), pa.array(d)], names=["_px", "_py", "_d"])


def _numbered_places(places: DataFrame, n: int, bounds: list[float]) -> DataFrame:
    """_px, _py and _n, the rank of each place along the curve, dealt by range of it."""
    lows, wide = (bounds[0], bounds[2]), (bounds[1] - bounds[0], bounds[3] - bounds[2])
    dealt = places.mapInArrow(lambda batches: _along_curve(batches, lows, wide), "_px double, _py double, _d long")
    dealt = materialized(dealt.repartitionByRange(-(-n // 100_000), "_d").withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy("_p").agg(F.count("*").alias("_s")).withColumn("_before", F.sum("_s").over(Window.orderBy("_p")) - F.col("_s"))  # a row for each task
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_d", "_px", "_py")) - 1
    return materialized(dealt.withColumn("_own", own).join(F.broadcast(sums.drop("_s")), "_p").select("_px", "_py", (F.col("_own") + F.col("_before")).alias("_n")))


def nearest(left: DataFrame, right: DataFrame, key: str, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each left row with all its nearest right rows (ties kept) and the distance; left rows with a coordinate that is null or not finite keep nulls; with no right rows the result is empty.

    Distinct places meet instead of rows. Those of the right side are ranked along Hilbert's curve: LEAF in a row make a box, FAN boxes in a row one of the next level,
    up to FAN at the top, however the places lie. A left place begins at the top and goes down level by level, into the boxes only that may hold a place as
    near as one surely is: a box is tight, so each of its sides touches a place. ``key`` and ``size`` have no part in this any more.
    """
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < F.lit(float("inf")), F.lit(False))
    there = finite(x) & finite(y)
    r = right.where(there).select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    nulls = [F.lit(None).cast(r.schema[c].dataType).alias(c) for c in r.columns]
    alone = left.where(~there).select("*", F.lit(None).cast("double").alias("distance"), *nulls)
    at = lambda c: F.col(c).cast("double")
    places = materialized(r.select(at(f"r_{x}").alias("_px"), at(f"r_{y}").alias("_py")).distinct())
    *bounds, n = places.agg(*(f(c) for c in ("_px", "_py") for f in (F.min, F.max)), F.count("*")).first()  # one row
    if not n:
        return alone.limit(0)
    few = F.broadcast if n <= SMALL else (lambda df: df)
    places = _numbered_places(places, n, bounds)
    low = places.withColumn("_c", F.floor(F.col("_n") / LEAF))
    levels = [materialized(low.groupBy("_c").agg(*(f(c).alias(a) for c, a, f in (("_px", "_lx", F.min), ("_px", "_hx", F.max), ("_py", "_ly", F.min), ("_py", "_hy", F.max)))))]
    boxes = -(-n // LEAF)
    while boxes > FAN:
        up = levels[-1].groupBy(F.floor(F.col("_c") / FAN).alias("_c"))
        levels.append(materialized(up.agg(*(f(c).alias(c) for c, f in (("_lx", F.min), ("_hx", F.max), ("_ly", F.min), ("_hy", F.max))))))
        boxes = -(-boxes // FAN)

    own = materialized(left.where(there).select(at(x).alias("_x"), at(y).alias("_y")).distinct())
    # Dealt by place once: joins with what goes to all tasks keep the rows of a place together and in order.
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-own.count() // DEALT))
    open_ = own.repartition(tasks, "_x", "_y").crossJoin(F.broadcast(levels[-1])).withColumn("_b", F.lit(float("inf")))  # FAN boxes
    one = Window.partitionBy("_x", "_y")
    off = lambda p, lo, hi: F.greatest(F.col(lo) - F.col(p), F.lit(0.0), F.col(p) - F.col(hi))
    ends = lambda f, p, lo, hi: f(F.abs(F.col(p) - F.col(lo)), F.abs(F.col(p) - F.col(hi)))
    square = lambda a, b: a * a + b * b
    for depth in range(len(levels) - 1, -1, -1):
        wx, wy = ("_x", "_lx", "_hx"), ("_y", "_ly", "_hy")
        sure = F.least(square(ends(F.least, *wx), ends(F.greatest, *wy)), square(ends(F.greatest, *wx), ends(F.least, *wy)))
        near = square(off(*wx), off(*wy))
        open_ = open_.select("_x", "_y", "_c", near.alias("_near"), F.least("_b", F.min(sure).over(one)).alias("_b")).where(F.col("_near") <= F.col("_b") * (1 + 1e-12)).drop("_near")
        if depth:
            below = levels[depth - 1].select(F.col("_c").alias("_d"), F.floor(F.col("_c") / FAN).alias("_c"), "_lx", "_hx", "_ly", "_hy")
            open_ = open_.join(few(below), "_c").drop("_c").withColumnRenamed("_d", "_c")
    pairs = open_.join(few(low.select("_c", "_px", "_py")), "_c").withColumn("distance", F.sqrt(square(F.col("_x") - F.col("_px"), F.col("_y") - F.col("_py"))))
    best = materialized(pairs.withColumn("_b", F.min("distance").over(one)).where("distance = _b").select("_x", "_y", "distance", "_px", "_py"))
    met = left.where(there).withColumns({"_lx": at(x), "_ly": at(y)}).join(best, (F.col("_lx") == F.col("_x")) & (F.col("_ly") == F.col("_y")))
    met = met.join(r, (F.col("_px") == at(f"r_{x}")) & (F.col("_py") == at(f"r_{y}")))
    return met.select(*left.columns, "distance", *r.columns).unionByName(alone)


def accessibility(d: Column, threshold: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / threshold))


def moran(df: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """Global Moran I over edges (a, b) in both directions, weights standardised by row, with expectation, z and p under normality."""
    mean = df.agg(F.avg(value).alias("m"))
    z = df.crossJoin(F.broadcast(mean)).select(F.col(key).alias("k"), (F.col(value) - F.col("m")).alias("z"))  # one row
    lag = edges.join(z.withColumnRenamed("k", "b"), "b").groupBy("a").agg(F.avg("z").alias("lag"))
    both = z.join(lag.withColumnRenamed("a", "k"), "k", "left")
    got = both.agg(F.count("*").alias("n"), (F.sum(F.col("z") * F.col("lag")) / F.count("lag") * F.count("*") / F.sum(F.col("z") * F.col("z"))).alias("moran_i"))
    w = edges.join(edges.groupBy("a").agg((1 / F.count("*")).alias("w")), "a")
    back = w.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("w").alias("back"))
    s1 = w.join(back, ["a", "b"], "left").agg(F.sum("w").alias("s0"), (F.sum(F.pow(F.col("w") + F.coalesce("back", F.lit(0.0)), 2)) / 2).alias("s1"))
    ends = w.select(F.col("a").alias("k"), "w").unionAll(w.select(F.col("b"), "w")).groupBy("k").agg(F.pow(F.sum("w"), 2).alias("q")).agg(F.sum("q").alias("s2"))
    one = got.crossJoin(s1).crossJoin(ends)  # three single rows
    expected = -1 / (F.col("n") - 1)
    variance = F.try_divide(F.col("n") * F.col("n") * F.col("s1") - F.col("n") * F.col("s2") + 3 * F.col("s0") * F.col("s0"), (F.col("n") * F.col("n") - 1) * F.col("s0") * F.col("s0")) - expected * expected
    scored = one.select("n", "moran_i", expected.alias("expected"), F.try_divide(F.col("moran_i") - expected, F.sqrt(variance)).alias("z"))
    return scored.withColumn("p", two_sided("z"))


def two_sided(z: str) -> Column:
    """Probability of a normal value as far from 0, by a rational approximation (error below 1.5e-7)."""
    a = F.abs(F.col(z)) / 2**0.5
    t = 1 / (1 + 0.3275911 * a)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-a * a)


def local_moran(df: DataFrame, edges: DataFrame, key: str, value: str) -> DataFrame:
    """Each row with an edge: its deviation z in standard deviations, its neighbours' mean deviation, local I and quadrant (HH, LL, HL, LH)."""
    m = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = df.crossJoin(F.broadcast(m)).select(F.col(key), F.try_divide(F.col(value) - F.col("_m"), F.col("_s")).alias("z"))  # one row
    lag = edges.join(z.withColumnRenamed(key, "b"), "b").groupBy("a").agg(F.avg("z").alias("lag"))
    both = z.join(lag.withColumnRenamed("a", key), key)
    side = lambda c: F.when(F.col(c) > 0, "H").otherwise("L")
    return both.select(key, "z", "lag", (F.col("z") * F.col("lag")).alias("local_i"), F.concat(side("z"), side("lag")).alias("quadrant"))


def hot_spots(df: DataFrame, edges: DataFrame, key: str, value: str, significance: float = 0.05) -> DataFrame:
    """Getis-Ord Gi* with binary weights, each row its own neighbour: z, p and whether it is a hot or a cold spot."""
    g = df.agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"), F.count(value).alias("_n"))
    own = edges.select("a", "b").unionAll(df.select(F.col(key).alias("a"), F.col(key).alias("b")))
    sums = own.join(df.select(F.col(key).alias("b"), F.col(value).cast("double").alias("v")), "b").groupBy("a").agg(F.sum("v").alias("sum"), F.count("v").alias("w"))
    x = sums.crossJoin(F.broadcast(g))  # one row
    spread = F.col("_s") * F.sqrt((F.col("_n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("_n") - 1))
    z = x.select(F.col("a").alias(key), F.try_divide(F.col("sum") - F.col("_m") * F.col("w"), spread).alias("z")).withColumn("p", two_sided("z"))
    return z.withColumn("spot", F.when((F.col("p") <= significance) & (F.col("z") > 0), "hot").when((F.col("p") <= significance) & (F.col("z") < 0), "cold").otherwise("none"))


def weights(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with weights that add up to one for each a."""
    return edges.join(edges.groupBy("a").agg((1 / F.count("*")).alias("weight")), "a").select("a", "b", "weight")


def to_mercator(lng: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857, metres; latitudes are held within the projection's square."""
    r, held = 6378137.0, F.greatest(F.lit(-85.06), F.least(F.lit(85.06), lat))
    return F.radians(lng) * r, F.log(F.tan(F.radians(held) / 2 + 0.7853981633974483)) * r


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326, degrees."""
    r = 6378137.0
    return F.degrees(x / r), F.degrees(2 * F.atan(F.exp(y / r)) - 1.5707963267948966)


def near_points(points: DataFrame, lng: float, lat: float, radius_m: float, limit: int, key: str) -> DataFrame:
    """At most ``limit`` points within a radius of a place, nearest first, with the distance in metres."""
    d = haversine(F.lit(lat), F.lit(lng), F.col("lat"), F.col("lng"))
    box = F.col("lat").between(lat - radius_m / 110_000, lat + radius_m / 110_000)  # reaches the scan
    return points.where(box).withColumn("metres", d).where(F.col("metres") <= radius_m).orderBy("metres", key).limit(limit)


def _edges(ring: str) -> Column:
    """The edges of a ring column (array of (x, y) corners, first not repeated) as pairs of corners."""
    r = F.col(ring)
    return F.arrays_zip(r.alias("p"), F.concat(F.slice(r, 2, F.size(r)), F.slice(r, 1, 1)).alias("q"))


def ring_area(ring: str) -> Column:
    """Signed area of a ring column, positive when its corners run anticlockwise."""
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + (e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])) / 2


def ring_length(ring: str) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]))


def in_ring(x: Column, y: Column, ring: str) -> Column:
    """Whether a point lies inside a ring column of any shape, by crossings."""
    at = lambda e: (y - e["p"]["y"]) * F.try_divide(e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]) + e["p"]["x"]
    crossed = F.filter(_edges(ring), lambda e: ((e["p"]["y"] > y) != (e["q"]["y"] > y)) & (x < at(e)))
    return F.size(crossed) % 2 == 1


def points_in_rings(points: DataFrame, shapes: DataFrame, size: float, ring: str = "ring", how: str = "inner", x: str = "x", y: str = "y") -> DataFrame:
    """Points with the polygons (rings of any shape) that hold them; how may be left, left_semi or left_anti.

    An equality join on grid cells, entered for the cells that a shape's bounds touch, then the exact predicate.
    """
    bound = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    s = shapes.withColumns({"_lx": bound(F.array_min, "x"), "_hx": bound(F.array_max, "x"), "_ly": bound(F.array_min, "y"), "_hy": bound(F.array_max, "y")})
    s = s.withColumn("_cx", _cells("_lx", "_hx", size)).withColumn("_cy", _cells("_ly", "_hy", size))
    p = points.withColumns({"_px": F.floor(F.col(x) / size), "_py": F.floor(F.col(y) / size)})
    held = (p["_px"] == s["_cx"]) & (p["_py"] == s["_cy"]) & in_ring(F.col(x), F.col(y), ring)
    return p.join(s, held, how).drop("_px", "_py", "_cx", "_cy", "_lx", "_hx", "_ly", "_hy")


def clip(subject: str, window: tuple[float, float, float, float]) -> Column:
    """A ring column cut to a box (minx, miny, maxx, maxy), side by side; convex rings give exact results, an empty ring where nothing is left."""
    minx, miny, maxx, maxy = window
    ring = F.col(subject)
    for axis, other, edge, keep in (("x", "y", minx, 1), ("x", "y", maxx, -1), ("y", "x", miny, 1), ("y", "x", maxy, -1)):
        ring = _cut_side(ring, axis, other, edge, keep)
    return ring


def _cut_side(ring: Column, axis: str, other: str, edge: float, keep: int) -> Column:
    pairs = F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.greatest(F.size(ring), F.lit(1))), F.slice(ring, 1, 1)).alias("q"))
    inside = lambda c: (c[axis] - edge) * keep >= 0

    def crossing(e: Column) -> Column:
        at = e["p"][other] + (e["q"][other] - e["p"][other]) * F.try_divide(edge - e["p"][axis], e["q"][axis] - e["p"][axis])
        return F.struct(*((F.lit(float(edge)) if c == axis else at).alias(c) for c in ("x", "y")))

    none = F.filter(ring, lambda c: F.lit(False))
    step = lambda e: F.concat(F.when(inside(e["p"]) != inside(e["q"]), F.array(crossing(e))).otherwise(none), F.when(inside(e["q"]), F.array(e["q"])).otherwise(none))
    return F.flatten(F.transform(pairs, step))


def boxes_meet(left: DataFrame, right: DataFrame, key: str, right_key: str, size: float) -> DataFrame:
    """(key, right_key) of boxes of two tables that share at least a boundary point, each pair once: in the cell that holds the lower corner of what they share."""
    a, b = (
        d.select(*(F.col(c).alias(f"{s}_{c}") for c in (k, "minx", "miny", "maxx", "maxy")), _cells("minx", "maxx", size).alias(f"{s}_cx")).withColumn(f"{s}_cy", _cells(f"{s}_miny", f"{s}_maxy", size))
        for s, d, k in (("l", left, key), ("r", right, right_key))
    )
    x, y = F.greatest("l_minx", "r_minx"), F.greatest("l_miny", "r_miny")
    met = (F.col("l_cx") == F.col("r_cx")) & (F.col("l_cy") == F.col("r_cy")) & (x <= F.least("l_maxx", "r_maxx")) & (y <= F.least("l_maxy", "r_maxy"))
    once = (F.floor(x / size) == F.col("l_cx")) & (F.floor(y / size) == F.col("l_cy"))
    return a.join(b, met & once).select(F.col(f"l_{key}").alias(key), F.col(f"r_{right_key}").alias(right_key))


def changes_by_place(before: DataFrame, after: DataFrame, key: str, size: float) -> DataFrame:
    """(key, change): boxes of before that meet one of after are modified, others removed; boxes of after that meet none are added."""
    new = after.withColumnRenamed(key, "_new")
    met = materialized(boxes_meet(before, new, key, "_new", size))
    old = before.select(key).join(met.select(key).distinct().withColumn("_m", F.lit(True)), key, "left").select(key, F.when(F.col("_m"), "modified").otherwise("removed").alias("change"))
    added = new.select("_new").join(met.select("_new"), "_new", "left_anti").select(F.col("_new").alias(key), F.lit("added").alias("change"))
    return old.unionAll(added)
