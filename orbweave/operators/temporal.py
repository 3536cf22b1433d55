"""As-of joins, event alignment, gaps and trajectories."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbweave.functions.expressions import bearing, haversine, micros
from orbweave.operators.quantiles import quantiles
from orbweave.operators.spatial import nearest
from orbweave.sources.io import materialized


def as_of(left: DataFrame, right: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Each left row with the last right value (that is not null) at or before its time: no range join.

    Rows of both sides are dealt by range of key and time and run through one window a range, so a key of any size is many tasks; the last value of
    a range is carried into the next ranges of its key, a row for each range. Where both sides have one time the right row comes first; null keys are one key.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(*keys, time, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    both = a.unionByName(b, allowMissingColumns=True).repartitionByRange(*keys, time, "_side").withColumn("_p", F.spark_partition_id())
    both = materialized(both)
    ends = both.groupBy(*keys, "_p").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(time, "_side"))).alias("_end"))
    before = F.last("_end", True).over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_p").alias("_part"), before.alias("_before")).where("_before IS NOT NULL")
    own = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys, "_p").orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, 0))
    same = F.col("_p") == F.col("_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    found = both.withColumn("_v", own).where("_side = 1").join(carried, same, "left")
    return found.select(*left.columns, F.coalesce("_v", "_before").alias(f"asof_{value}"))


def _closest(points: DataFrame, others: DataFrame, reach: int) -> DataFrame:
    """The points (t and whatever else) with u, the nearest of the others' distinct times within ``reach`` microseconds, the earlier of two as near.

    Buckets as long as the reach; others stand in three of them and are carried to the points by windows, so no pairs are formed.
    """
    bucket = F.floor(F.col("t") / reach)
    a = points.withColumns({"_b": bucket, "_at": F.col("t"), "_o": F.lit(None).cast("long")})
    b = others.select("t").distinct().select(F.explode(F.sequence(bucket - 1, bucket + 1)).alias("_b"), F.col("t").alias("_at"), F.col("t").alias("_o"))
    # Both frames begin at the first row: one that ends at the last row would be gone through anew for each row.
    w = lambda at: Window.partitionBy("_b").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    sides = {"_lo": F.last("_o", True).over(w(F.asc("_at"))), "_hi": F.last("_o", True).over(w(F.desc("_at")))}
    both = a.unionByName(b, allowMissingColumns=True).withColumns(sides).where("t IS NOT NULL")
    down, up = F.col("t") - F.col("_lo"), F.col("_hi") - F.col("t")
    u = F.when((down <= reach) & (up.isNull() | (down <= up)), F.col("_lo")).when(up <= reach, F.col("_hi"))
    return both.withColumn("u", u).where("u IS NOT NULL").drop("_b", "_at", "_o", "_lo", "_hi")


def event_pairs(left: DataFrame, right: DataFrame, time: str, key: str, window_s: int) -> DataFrame:
    """Each left event with its nearest right event within the window, ties to the smaller right id; events without time are in no pair.

    Distinct times meet instead of events, so a busy second is one row on either side.
    """
    a = left.where(F.col(time).isNotNull()).select(F.col(key).alias("left_id"), micros(time).alias("t"))
    b = right.where(F.col(time).isNotNull()).groupBy(micros(time).alias("t")).agg(F.min(key).alias("right_id"))
    reach = int(window_s * 1_000_000)
    mirror = b.withColumn("u", F.col("t"))
    times = a.select("t").distinct()
    near = _closest(times, b, reach)
    # Two times may be equally near; then the smaller id of both decides.
    both = near.select("t", F.explode(F.array_distinct(F.array("u", 2 * F.col("t") - F.col("u")))).alias("u"))
    best = both.join(mirror.select("u", "right_id"), "u").groupBy("t").agg(F.min("right_id").alias("right_id"), F.min(F.abs(F.col("u") - F.col("t"))).alias("g"))
    return a.join(best, "t").select("left_id", "right_id", (F.col("g") / 1e6).alias("gap_s"))


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with _n, from 0 within the first of ``order``, by the rest: dealt by range, so that a value of many rows is many tasks."""
    first = order[0]
    dealt = materialized(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    sums = dealt.groupBy(first, "_p").agg(F.count("*").alias("_s")).withColumn("_before", F.sum("_s").over(Window.partitionBy(first).orderBy("_p")) - F.col("_s"))
    own = F.row_number().over(Window.partitionBy(first, "_p").orderBy(*order[1:])) - 1
    return dealt.withColumn("_own", own).join(sums.drop("_s"), [first, "_p"]).withColumn("_n", F.col("_own") + F.col("_before")).drop("_own", "_before", "_p")


#: Remaining times that a task of ``matched_times`` holds at once.
CHUNK = 50_000


def _settled(t: np.ndarray, side: np.ndarray, n: np.ndarray, lo: float, hi: float, reach: int) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a stretch [lo, hi) of times that no time outside can undo, and what is left: rows kept, their counts, how many of each went.

    t, side: in order; n: events of a time. The closest neighbours go first (of two as near the earlier ones). A pair that something outside
    the stretch might break stays, and whoever would have been next to either of them stays too.
    """
    size = len(t)
    before, after = list(range(-1, size - 1)), [*range(1, size), -1]
    times, sides, left, gone = t.tolist(), side.tolist(), n.tolist(), [0] * size
    held, pairs = [False] * size, []
    heap = [(times[k + 1] - times[k], times[k], k, k + 1) for k in range(size - 1) if sides[k] != sides[k + 1]]
    heapq.heapify(heap)
    while heap:
        d, _, a, b = heapq.heappop(heap)
        if d > reach:
            break
        if not left[a] or not left[b] or after[a] != b:
            continue
        if held[a] or held[b] or d > times[a] - lo or d > hi - times[b]:
            held[a] = held[b] = True
            continue
        take = min(left[a], left[b])
        x, y = (a, b) if sides[a] == 0 else (b, a)
        pairs.append((times[x], times[y], gone[x], gone[y], take))
        for k in (a, b):
            left[k] -= take
            gone[k] += take
            if not left[k]:
                p, q = before[k], after[k]
                if p >= 0:
                    after[p] = q
                if q >= 0:
                    before[q] = p
        a, b = a if left[a] else before[a], b if left[b] else after[b]
        if a >= 0 and b >= 0 and sides[a] != sides[b]:
            heapq.heappush(heap, (times[b] - times[a], times[a], a, b))
    n, gone = np.array(left, np.int64), np.array(gone, np.int64)
    alive = np.flatnonzero(n)
    near = (t[alive] - lo < reach) | (hi - t[alive] <= reach)
    for s in (0, 1):  # a time without a partner within reach, here or outside, is done
        own, other = side[alive] == s, t[alive][side[alive] == 1 - s]
        near[own] |= np.searchsorted(other, t[alive][own] - reach, "left") < np.searchsorted(other, t[alive][own] + reach, "right")
    alive = alive[near]
    return pairs, alive, n[alive], gone[alive]


MATCHED = ("t", "u", "used", "gone", "n", "side")


def _settler(bounds: list[float], reach: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Rows of a stretch to pairs of times (side is null) and the times that are left (u is null)."""

    def settle(key: tuple, part: pa.Table) -> pa.Table:
        t, side, n, used = (part[name].to_numpy() for name in ("t", "side", "n", "used"))
        order = np.lexsort((side, t))
        t, side, n, used = t[order], side[order], n[order], used[order]
        k = key[0].as_py()
        pairs, alive, m, gone = _settled(t, side, n, bounds[k], bounds[k + 1], reach)
        first = {(s, x): w for s, x, w in zip(side.tolist(), t.tolist(), used.tolist()) if w}
        rows = [(x, y, i + first.get((0, x), 0), j + first.get((1, y), 0), w, None) for x, y, i, j, w in pairs]
        rows += zip(t[alive].tolist(), [None] * len(alive), (used[alive] + gone).tolist(), [None] * len(alive), m.tolist(), side[alive].tolist())
        return pa.table([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(MATCHED))], names=MATCHED)

    return settle


def matched_times(left: DataFrame, right: DataFrame, time: str, key: str, window_s: float) -> DataFrame:
    """left_id, right_id, gap_s: a one-to-one choice of pairs within the window, the closest first.

    Pairs whose times are nearest to each other go first, then those nearest among the rest, and so on; of two times as near the earlier one,
    and events of one time by their keys (which tell rows apart). Rows without a time are in no pair. Times are matched, all
    events of a time at once. A round deals the remaining times in stretches of about CHUNK and settles in each, one task a stretch, all that no time outside it
    can undo, so what is left lies near the ends of stretches; the next round's ends lie elsewhere, and there are the fewer stretches the fewer times are left.
    A round that settles nothing doubles the stretches.
    """
    reach = max(1, int(window_s * 1_000_000))
    side = lambda df: _numbered(df.where(F.col(time).isNotNull()).select(micros(time).alias("t"), F.col(key).alias("id")), ["t", "id"])
    rows = [materialized(side(df)) for df in (left, right)]
    each_side = [r.groupBy("t").agg(F.count("*").alias("n")).select("t", F.lit(i).cast("long").alias("side"), "n", F.lit(0).cast("long").alias("used")) for i, r in enumerate(rows)]
    rest = materialized(each_side[0].unionAll(each_side[1]))
    found, stretch, turn, before = None, CHUNK, 0, None
    while True:
        n, sides = rest.agg(F.count("*"), F.count_distinct("side")).first()
        if found is not None and sides < 2:
            break
        stretch, before = 2 * stretch if n == before else stretch, n
        parts = -(-n // stretch)
        shift = 0.5 * (turn % 2)
        at = [(k + shift) / parts for k in range(parts + 1) if 0 < k + shift < parts] if parts > 1 else []
        ends = sorted({int(x) for x in rest.approxQuantile("t", at, 0.1 / parts)}) if at else []
        bounds, turn = [float("-inf"), *ends, float("inf")], turn + 1
        stretch_of = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in ends)).cast("array<bigint>"), lambda e: e <= F.col("t")))
        out = materialized(rest.groupBy(stretch_of.alias("_k")).applyInArrow(_settler(bounds, reach), ", ".join(f"{c} long" for c in MATCHED)))
        both = out.where("side IS NULL").select("t", "u", "used", "gone", F.col("n").alias("take"))
        found = both if found is None else found.unionAll(both)
        rest = out.where("side IS NOT NULL").select("t", "side", "n", "used")
    ids = [r.select(F.col("t").alias(c), F.col("_n").alias(f"_{c}"), F.col("id").alias(n)) for r, c, n in zip(rows, "tu", ("left_id", "right_id"))]
    each = found.select("t", "u", "used", "gone", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)).alias("_k"))
    each = each.select("t", "u", (F.col("used") + F.col("_k")).alias("_t"), (F.col("gone") + F.col("_k")).alias("_u"))
    return each.join(ids[0], ["t", "_t"]).join(ids[1], ["u", "_u"]).select("left_id", "right_id", (F.abs(F.col("t") - F.col("u")) / 1e6).alias("gap_s"))


def aligned_events(sources: list[DataFrame], time: str, keys: list[str], window_s: float) -> DataFrame:
    """Events of many sources side by side: the time, and each source's other columns as ``src<i>_<name>``.

    Sources are folded in order: an event of the next source joins at most one row so far (``matched_times``) whose time is within the
    window, and the row keeps its own time; what matches nothing stays as a row of its own. Every row of every source is there once, those without a time too.
    """
    def named(df: DataFrame, i: int) -> DataFrame:
        return df.select(F.col(time).alias("_time"), *(F.col(c).alias(f"src{i}_{c}") for c in df.columns if c != time))

    out = named(sources[0], 0).withColumn("_id", F.array(F.struct(F.lit(0).alias("i"), F.col(f"src0_{keys[0]}").cast("string").alias("k"))))
    for i, df in enumerate(sources[1:], 1):
        out = materialized(out)
        new = materialized(named(df, i).withColumn("_new", F.array(F.struct(F.lit(i).alias("i"), F.col(f"src{i}_{keys[i]}").cast("string").alias("k")))))
        pairs = matched_times(out.select("_time", "_id"), new.select("_time", F.col("_new").alias("_id")), "_time", "_id", window_s)
        pairs = pairs.select(F.col("left_id").alias("_id"), F.col("right_id").alias("_new"))
        with_new = out.join(pairs, "_id", "left").join(new.withColumnRenamed("_time", "_other"), "_new", "full")
        out = with_new.withColumn("_time", F.when(F.col("_id").isNull(), F.col("_other")).otherwise(F.col("_time"))).withColumn("_id", F.coalesce("_id", "_new")).drop("_other", "_new")
    return out.drop("_id").withColumnRenamed("_time", time)


def track_to_places(track: DataFrame, places: DataFrame, key: str, time: str, window_s: float, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each fix with the place nearest to it (ties kept; the place's columns as ``r_<name>``, the distance), if both times lie within the window.

    The place is chosen by distance alone and then held against the window, so a fix whose nearest place is at another time has no row; places
    without a time column are kept whatever the time, and a null time on either side is within no window.
    """
    met = nearest(track, places, key, size, x, y)
    if time not in track.columns or time not in places.columns:
        return met
    return met.where(F.abs(micros(time) - micros(f"r_{time}")) <= int(window_s * 1_000_000))


#: Parts of a column's name that speak of time.
TEMPORAL_NAMES = ("date", "time", "timestamp", "year", "month", "日期", "时间", "年份")


def temporal_columns(df: DataFrame, share: float = 0.5) -> list[str]:
    """Columns that hold times: dates and timestamps by type; text columns by name, if more than ``share`` of their values that are not null read as dates or times.

    All rows are looked at, in one pass with one row of counts.
    """
    kinds = dict(df.dtypes)
    typed = [c for c in df.columns if kinds[c] == "date" or kinds[c].startswith("timestamp")]
    named = [c for c in df.columns if kinds[c] == "string" and any(n in c.lower() for n in TEMPORAL_NAMES)]
    if not named:
        return typed
    q = lambda c: F.col(f"`{c.replace('`', '``')}`")
    counts = df.agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(map(q, named)) for n, f in (("n", F.count), ("p", lambda c: F.count(F.try_to_timestamp(c))))), F.lit(1).alias("one")).first()
    good = {c for i, c in enumerate(named) if counts[f"p{i}"] > share * counts[f"n{i}"]}
    return [c for c in df.columns if c in typed or c in good]


def gaps(df: DataFrame, keys: list[str], time: str, times: float = 10.0) -> DataFrame:
    """Per key: nulls, repeated times, and steps longer than ``times`` the median step."""
    w = Window.partitionBy(*keys).orderBy(time)
    step = (micros(time) - micros(F.lag(time).over(w))) / 1e6
    s = materialized(df.where(F.col(time).isNotNull()).select(*keys, step.alias("step")))
    median = quantiles(s, "step", [0.5], keys).select(*keys, F.col("q")[0].alias("median_s"))
    wide = s.join(median, keys).groupBy(*keys).agg(F.first("median_s").alias("median_s"), F.count_if(F.col("step") == 0).alias("repeats"), F.count_if(F.col("step") > times * F.col("median_s")).alias("n_gaps"))
    return wide


def trajectories(df: DataFrame, device: str, time: str, lat: str, lng: str) -> DataFrame:
    """Per device: fixes, length in metres, and the last heading."""
    w = Window.partitionBy(device).orderBy(time)
    before = [F.lag(c).over(w) for c in (lat, lng)]
    step = df.select(device, time, haversine(before[0], before[1], F.col(lat), F.col(lng)).alias("m"), bearing(before[0], before[1], F.col(lat), F.col(lng)).alias("h"))
    return step.groupBy(device).agg(F.count("*").alias("fixes"), F.coalesce(F.sum("m"), F.lit(0.0)).alias("metres"), F.max_by("h", time).alias("heading"))


def nearest_in_time(df: DataFrame, keys: list[str], time: str, at: str, value: str) -> DataFrame:
    gap = F.abs(micros(F.col(time)) - micros(F.lit(at).cast("timestamp")))
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(gap, F.col(time))).alias(value))


def interpolate(df: DataFrame, keys: list[str], time: str, at: str, value: str) -> DataFrame:
    """Linear between the last row at or before and the first at or after; the nearer one at the ends."""
    t, u = F.col(time), F.lit(at).cast("timestamp")
    g = df.groupBy(*keys).agg(
        F.max(F.when(t <= u, t)).alias("t0"), F.max_by(F.when(t <= u, F.col(value)), F.when(t <= u, t)).alias("v0"),
        F.min(F.when(t >= u, t)).alias("t1"), F.min_by(F.when(t >= u, F.col(value)), F.when(t >= u, t)).alias("v1"),
    )
    part = F.try_divide((micros(u) - micros("t0")).cast("double"), (micros("t1") - micros("t0")).cast("double"))
    return g.select(*keys, F.coalesce(F.col("v0") + (F.col("v1") - F.col("v0")) * F.coalesce(part, F.lit(0.0)), "v0", "v1").alias(value))


def exits(df: DataFrame, device: str, time: str, inside: Column) -> DataFrame:
    """Fixes outside a fence whose device was inside at its fix before; a fix of unknown place counts as neither."""
    known = df.withColumn("_in", inside).where(F.col("_in").isNotNull())
    was = F.lag("_in").over(Window.partitionBy(device).orderBy(time))
    return known.withColumn("_was", was).where(F.col("_was") & ~F.col("_in")).drop("_in", "_was")
