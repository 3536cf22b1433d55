"""Terrain over pixels (row, col, height): pits filled, flow over flats, watersheds, viewsheds.

Rasters are tables; a pixel without a row is outside. Work that must follow the surface is done
tile by tile, and only tiles' edges meet in rounds, so a round moves a small part of the pixels.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbweave.operators.surfaces import STEPS
from orbweave.sources.io import materialized

INF = float("inf")
_AROUND = [(i, j) for i, j, _ in STEPS]


def _flooded(h: dict[tuple[int, int], float], seeds: dict[tuple[int, int], float]):
    """Pixels in the order in which water rising from the seeds reaches them: pixel, level, seed, and where floods of two seeds met before."""
    heap = [(max(level, h[p]), 0, p, p) for p, level in seeds.items()]  # of equal levels seeds come first, so that each floods itself
    heapq.heapify(heap)
    level, source = {}, {}
    while heap:
        w, _, p, s = heapq.heappop(heap)
        if p in level:
            continue
        level[p], source[p] = w, s
        met = []
        for i, j in _AROUND:
            q = p[0] + i, p[1] + j
            if q not in h:
                continue
            if q in level:
                if source[q] != s:
                    met.append((source[q], max(w, level[q])))
            else:
                heapq.heappush(heap, (max(w, h[q]), 1, q, s))
        yield p, w, s, met


_TILE = "row long, col long, height double, level double, src_row long, src_col long, node boolean, open boolean, links array<struct<row:long,col:long,level:double>>"


def _tile(tile: int):
    """One tile flooded from its edge: each pixel's level and the edge pixel that floods it; edge pixels with the levels at which they reach others."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        h = {(r, c): z for r, c, z in zip(rows["row"].to_pylist(), rows["col"].to_pylist(), rows["height"].to_pylist())}
        r0, c0 = key[0].as_py() * tile, key[1].as_py() * tile
        inside = lambda r, c: r0 <= r < r0 + tile and c0 <= c < c0 + tile
        gone = {p: any((q := (p[0] + i, p[1] + j)) not in h and inside(*q) for i, j in _AROUND) for p in h}
        edge = {p: z for p, z in h.items() if gone[p] or p[0] in (r0, r0 + tile - 1) or p[1] in (c0, c0 + tile - 1)}
        found, links = [], {p: {} for p in edge}
        for p, w, s, met in _flooded(h, edge):
            found.append((p, w, s))
            for other, at in met:
                a, b = min(s, other), max(s, other)
                links[a][b] = min(at, links[a].get(b, INF))
        out = [(*p, h[p], w, *s, p in edge, gone[p], [{"row": q[0], "col": q[1], "level": v} for q, v in links.get(p, {}).items()]) for p, w, s in found]
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.struct([("row", pa.int64()), ("col", pa.int64()), ("level", pa.float64())]))]
        names = ["row", "col", "height", "level", "src_row", "src_col", "node", "open", "links"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


def _relaxed(key: tuple, rows: pa.Table) -> pa.Table:
    """The least level at which each edge pixel of a tile drains, given some pixels' levels."""
    pixels = list(zip(rows["row"].to_pylist(), rows["col"].to_pylist()))
    near = {p: [] for p in pixels}
    for p, links in zip(pixels, rows["links"].to_pylist()):
        for x in links:
            near[p].append(((x["row"], x["col"]), x["level"]))
            near[x["row"], x["col"]].append((p, x["level"]))
    heap = [(v, p) for p, v in zip(pixels, rows["at"].to_pylist()) if v is not None]
    heapq.heapify(heap)
    level: dict[tuple[int, int], float] = {}
    while heap:
        w, p = heapq.heappop(heap)
        if p not in level:
            level[p] = w
            for q, at in near[p]:
                if q not in level:
                    heapq.heappush(heap, (max(w, at), q))
    return pa.table([pa.array([p[0] for p in level], pa.int64()), pa.array([p[1] for p in level], pa.int64()), pa.array(list(level.values()), pa.float64())], names=["row", "col", "at"])


def _tile_of(tile: int) -> list[Column]:
    return [F.floor(F.col("row") / tile).cast("long").alias("tr"), F.floor(F.col("col") / tile).cast("long").alias("tc")]


def _neighbours(df: DataFrame) -> DataFrame:
    """Rows with ``n``: the place of each of the eight pixels around."""
    return df.withColumn("n", F.explode(F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in _AROUND))))


def filled(pixels: DataFrame, height: str, tile: int = 256) -> DataFrame:
    """row, col, height (double): the surface with its pits filled to where they spill.

    A pixel's height becomes the lowest level at which it drains, over neighbours, to a pixel that has a neighbour outside.
    Each tile is flooded from its edge once; the graph of its edge pixels (the levels at which their floods meet) and the steps
    between tiles are solved in rounds, as many as tiles that water crosses on its way out; the solution is then given back to the
    pixels. Null heights are outside; repeated pixels count by their lowest height; an empty table gives an empty result.
    """
    p = pixels.where(F.col(height).isNotNull()).groupBy(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).agg(F.min(F.col(height).cast("double")).alias("height"))
    flooded = materialized(p.withColumns({"tr": _tile_of(tile)[0], "tc": _tile_of(tile)[1]}).groupBy("tr", "tc").applyInArrow(_tile(tile), _TILE))
    nodes = flooded.where("node").select("row", "col", "height", "open", "links", *_tile_of(tile))
    other = nodes.select(F.struct("row", "col").alias("n"), F.col("height").alias("_h"))
    away = (F.floor(F.col("n.row") / tile) != F.col("tr")) | (F.floor(F.col("n.col") / tile) != F.col("tc"))
    steps = _neighbours(nodes.select("row", "col", "height", "tr", "tc")).where(away)
    steps = materialized(steps.join(other, "n", "left"))
    outside = nodes.where("open").select("row", "col", F.col("height").alias("at")).unionAll(steps.where("_h IS NULL").select("row", "col", F.col("height").alias("at")))
    across = steps.where("_h IS NOT NULL").select("row", "col", F.col("n.row").alias("to_row"), F.col("n.col").alias("to_col"), F.greatest("height", "_h").alias("w"))
    levels = materialized(outside.groupBy("row", "col").agg(F.min("at").alias("at")))
    changed = levels
    while not changed.isEmpty():
        active = nodes.join(changed.select(*_tile_of(tile)).distinct(), ["tr", "tc"])
        now = materialized(active.join(levels, ["row", "col"], "left").groupBy("tr", "tc").applyInArrow(_relaxed, "row long, col long, at double"))
        gift = now.join(across, ["row", "col"]).groupBy(F.col("to_row").alias("row"), F.col("to_col").alias("col")).agg(F.min(F.greatest("at", "w")).alias("at"))
        held = materialized(levels.unionAll(now).groupBy("row", "col").agg(F.min("at").alias("at")))
        changed = materialized(gift.join(held.withColumnRenamed("at", "_held"), ["row", "col"], "left").where("_held IS NULL OR at < _held").select("row", "col", "at"))
        levels = materialized(held.unionAll(changed).groupBy("row", "col").agg(F.min("at").alias("at")))
    ends = levels.select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), "at")
    return flooded.join(ends, ["src_row", "src_col"], "left").select("row", "col", F.greatest("level", "at").alias("height"))


def flow_over(surface: DataFrame, height: str = "height") -> DataFrame:
    """row, col, to_row, to_col: steepest descent, and on flats towards the nearest pixel of the flat that drains.

    Pixels with a neighbour outside drain where nothing around is lower (null). On a flat a pixel leads to the neighbour with the fewest
    steps to go, ties to the smaller row, then column; rounds are as many as the widest flat has steps, over its pixels only.
    """
    from orbweave.operators.surfaces import flow_direction

    p = surface.where(F.col(height).isNotNull()).select("row", "col", F.col(height).alias("_h"))
    beside = _neighbours(p.select("row", "col")).join(p.select(F.struct("row", "col").alias("n"), F.col("_h").alias("_nh")), "n").groupBy("row", "col").agg(F.count("*").alias("_around"))
    down = flow_direction(surface, height).join(p, ["row", "col"]).join(beside, ["row", "col"], "left")
    now = materialized(down.select("row", "col", "_h", "to_row", "to_col", (F.col("to_row").isNotNull() | (F.coalesce("_around", F.lit(0)) < len(_AROUND))).alias("_drains")))
    done, todo = [now.where("_drains").select("row", "col", "to_row", "to_col")], now.where("NOT _drains").select("row", "col", "_h")
    front = now.where("_drains").select("row", "col", "_h")
    while not todo.isEmpty():
        ahead = front.select(F.struct("row", "col").alias("n"), F.col("_h").alias("_nh"))
        met = _neighbours(todo).join(ahead, "n").where("_h = _nh").groupBy("row", "col", "_h").agg(F.min("n").alias("_to"))
        front = materialized(met)
        if front.isEmpty():  # flats that nothing drains: only on surfaces that were not filled
            done.append(todo.select("row", "col", F.lit(None).cast("long").alias("to_row"), F.lit(None).cast("long").alias("to_col")))
            break
        done.append(front.select("row", "col", F.col("_to.row").alias("to_row"), F.col("_to.col").alias("to_col")))
        todo = materialized(todo.join(front.select("row", "col"), ["row", "col"], "left_anti"))
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def snapped(accumulated: DataFrame, points: DataFrame, threshold: int, reach: int) -> DataFrame:
    """points (id, row, col) moved to the nearest pixel, within ``reach`` rows and columns, with over ``threshold`` pixels upstream; ties to the smaller row, then column; others stay."""
    near = points.withColumn("_x", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("_y", F.explode(F.sequence(F.lit(-reach), F.lit(reach))))
    near = near.select("id", (F.col("row") + F.col("_x")).alias("row"), (F.col("col") + F.col("_y")).alias("col"), (F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")).alias("_d"))
    best = near.join(accumulated.where(F.col("upstream") > threshold).select("row", "col"), ["row", "col"]).groupBy("id").agg(F.min(F.struct("_d", "row", "col")).alias("_b"))
    return points.join(best, "id", "left").select("id", F.coalesce("_b.row", "row").alias("row"), F.coalesce("_b.col", "col").alias("col"))


def watersheds(directions: DataFrame, outlets: DataFrame) -> DataFrame:
    """row, col, id: all pixels that drain through an outlet (id, row, col), each to the first outlet on its way; two outlets at one place are the smaller id.

    Pointers double their length every round, so a river of n pixels takes log2 n rounds; directions that go round in circles
    belong to no outlet and end after as many rounds as pixels need.
    """
    at = outlets.groupBy("row", "col").agg(F.min("id").alias("id"))
    here = directions.join(at, ["row", "col"], "left")
    stop = F.col("id").isNotNull()
    now = materialized(here.select("row", "col", F.when(~stop, F.col("to_row")).alias("to_row"), F.when(~stop, F.col("to_col")).alias("to_col"), "id"))
    rounds = max(1, int(now.count()).bit_length())
    for _ in range(rounds):
        ahead = now.select(F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.col("to_row").alias("_r"), F.col("to_col").alias("_c"), F.col("id").alias("_id"))
        if now.where("to_row IS NOT NULL").isEmpty():
            break
        step = now.join(ahead, ["to_row", "to_col"], "left")
        now = materialized(step.select("row", "col", F.col("_r").alias("to_row"), F.col("_c").alias("to_col"), F.coalesce("id", "_id").alias("id")))
    return now.where("id IS NOT NULL").select("row", "col", "id")


_SEEN = "row long, col long, visible boolean"


def _sighted(row0: int, col0: int, eye: float):
    """The targets of a sector with whether any pixel on the way to them rises above the line of sight."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        r, c, h, own = (rows[n].to_numpy() for n in ("row", "col", "height", "own"))
        dr, dc = r - row0, c - col0
        # Pixels by place, and the slope at which each is seen.
        wide = int(np.abs(dc).max(initial=0)) * 2 + 3
        code = dr * wide + dc
        order = np.argsort(code)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = (h - eye) / np.sqrt((dr * dr + dc * dc).astype(np.float64))
        code, seen = code[order], slope[order]
        own = own.astype(bool)
        dr, dc, target = dr[own], dc[own], slope[own]
        steps = np.maximum(np.abs(dr), np.abs(dc))
        top = np.full(len(dr), -np.inf)
        for s in range(1, int(steps.max(initial=1))):
            on = np.flatnonzero((steps > s) & (top <= target))
            if not len(on):
                continue
            y = np.rint(row0 + dr[on] * s / steps[on]).astype(np.int64) - row0
            x = np.rint(col0 + dc[on] * s / steps[on]).astype(np.int64) - col0
            want = y * wide + x
            k = np.minimum(np.searchsorted(code, want), len(code) - 1)
            there = code[k] == want
            top[on[there]] = np.maximum(top[on[there]], seen[k[there]])
        return pa.table([pa.array(dr + row0), pa.array(dc + col0), pa.array((top <= target) | (steps == 0))], names=["row", "col", "visible"])

    return run


def viewshed(pixels: DataFrame, height: str, row: int, col: int, eye: float = 1.7, radius: float = 5000.0, cell: float = 1.0, sectors: int = 64) -> DataFrame:
    """row, col, visible of every pixel within ``radius`` of an observer ``eye`` above the pixel (row, col).

    A pixel is seen if no pixel on the straight way to it (one per step of the longer axis, the nearest on the other) appears under a
    steeper angle. Pixels are dealt to sectors around the observer; a sector's lines of sight stay in it but for a pixel at its borders,
    which it gets as well, so a task holds one sector whose size the number of sectors sets. Heights are in the unit of ``cell``.
    Missing pixels block nothing; an observer off the surface sees nothing.
    """
    p = pixels.where(F.col(height).isNotNull()).select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), (F.col(height).cast("double") / cell).alias("height"))
    reach = radius / cell
    dr, dc = F.col("row") - row, F.col("col") - col
    p = p.where(dr.between(-reach, reach) & dc.between(-reach, reach) & (dr * dr + dc * dc <= reach * reach))
    own = p.where((dr == 0) & (dc == 0)).first()  # one row
    if own is None:
        return p.limit(0).select("row", "col", F.lit(True).alias("visible"))
    home = F.pmod(F.floor((F.atan2(dr, dc) / (2 * np.pi) + 0.5) * sectors).cast("int"), F.lit(sectors))
    # A way leaves its straight line by half a pixel at most, an angle below 1 / distance: the sectors so near get the pixel, too.
    wide = F.least(F.lit(sectors // 2), F.ceil(sectors / (2 * np.pi * F.greatest(F.sqrt(dr * dr + dc * dc), F.lit(1.0)))).cast("int"))
    every = F.array_distinct(F.transform(F.sequence(-wide, wide), lambda k: F.pmod(home + k, F.lit(sectors))))
    dealt = p.withColumn("_s", F.explode(every)).withColumn("own", F.col("_s") == home)
    return dealt.groupBy("_s").applyInArrow(_sighted(row, col, own["height"] + eye / cell), _SEEN)
