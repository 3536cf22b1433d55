"""Tracks of devices with state: fixes in order of event time, path lengths, headings and exits from a fence, on streams and on tables.

On a stream a device's fixes wait in state until the watermark has passed them, so rows that come out of order within the allowed delay
count in their order; later ones are dropped by the watermark. A timer at each waiting fix takes it into the track; another,
``idle`` after the last fix, ends the track and drops its state. What a stream gives for all fixes that the watermark has passed is what
``tracks`` gives for them as a table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orbweave.functions.expressions import bearing, haversine, micros

RADIUS = 6371000.0
_OUT = "device string, time timestamp, fixes long, metres double, heading double, exited boolean"


def _step(lat1: float, lng1: float, lat2: float, lng2: float) -> tuple[float, float]:
    """Metres and degrees from one place to another, as the column expressions give them."""
    a1, a2, d = math.radians(lat1), math.radians(lat2), math.radians(lng2 - lng1)
    h = math.sin((a2 - a1) / 2) ** 2 + math.cos(a1) * math.cos(a2) * math.sin(d / 2) ** 2
    way = math.degrees(math.atan2(math.sin(d) * math.cos(a2), math.cos(a1) * math.sin(a2) - math.sin(a1) * math.cos(a2) * math.cos(d)))
    return 2 * RADIUS * math.asin(math.sqrt(min(1.0, h))), (way + 360) % 360


class Track(StatefulProcessor):
    """One device: waiting fixes, and the last fix, the path so far and where it was by the fence."""

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "micros long, lat double, lng double, inside boolean")
        self.track = handle.getValueState("track", "micros long, lat double, lng double, inside boolean, fixes long, metres double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            micros = df["time"].astype("datetime64[us]").astype("int64")
            inside = [None if pd.isna(v) else bool(v) for v in df["inside"]]
            self.waiting.appendList([(int(t), float(a), float(b), i) for t, a, b, i in zip(micros, df["lat"], df["lng"], inside)])
            for t in {int(t) // 1000 + 1 for t in micros}:
                self.handle.registerTimer(t)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready, rest = [], []
        for fix in self.waiting.get():
            (ready if fix[0] < passed else rest).append(tuple(fix))
        held = tuple(self.track.get()) if self.track.exists() else None
        if not ready:
            if not rest and held is not None and held[0] // 1000 + self.idle_ms <= timerValues.getCurrentWatermarkInMs():
                self.track.clear()
                self.waiting.clear()
            return
        out = []
        for t, lat, lng, inside in sorted(ready, key=lambda f: f[:3]):
            if held is not None and t - held[0] > self.idle_ms * 1000:
                held = None  # a track of its own after a long silence
            metres, heading = _step(held[1], held[2], lat, lng) if held else (0.0, None)
            was = held[3] if held else None
            held = (t, lat, lng, was if inside is None else inside, held[4] + 1 if held else 1, held[5] + metres if held else 0.0)
            out.append((key[0], pd.Timestamp(t, unit="us"), held[4], held[5], heading, bool(was) and inside is False))
        self.track.update(held)
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        self.handle.registerTimer(held[0] // 1000 + self.idle_ms)
        yield pd.DataFrame(out, columns=["device", "time", "fixes", "metres", "heading", "exited"])


def _fixes(df: DataFrame, device: str, time: str, lat: str, lng: str, inside: Column) -> DataFrame:
    d = df.select(F.col(device).cast("string").alias("device"), F.col(time).alias("time"), F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"), inside.alias("inside"))
    return d.where("device IS NOT NULL AND time IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")


def tracks(df: DataFrame, device: str, time: str, lat: str, lng: str, inside: Column, late: str = "10 minutes", idle_ms: int = 86_400_000) -> DataFrame:
    """device, time, fixes, metres, heading, exited for every fix: its number in the track, the path up to it, the way to it, and whether it left the fence.

    A track ends after ``idle_ms`` without a fix. A fix whose place by the fence is unknown (null) neither leaves nor enters. Fixes
    without device, time or place take no part; of fixes at one time the smaller latitude, then longitude, goes first. A stream's session needs
    the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    fixes = _fixes(df, device, time, lat, lng, inside)
    if fixes.isStreaming:
        return fixes.withColumn("time", F.col("time").cast("timestamp")).withWatermark("time", late).groupBy("device").transformWithStateInPandas(Track(idle_ms), _OUT, "append", "eventTime")
    order = Window.partitionBy("device").orderBy("time", "lat", "lng")
    gap = micros("time") - F.lag(micros("time")).over(order)
    part = fixes.withColumn("_new", F.when(gap.isNull() | (gap > idle_ms * 1000), 1).otherwise(0)).withColumn("_track", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy("device", "_track").orderBy("time", "lat", "lng")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    before = [F.lag(c).over(own) for c in ("lat", "lng")]
    was = F.last("inside", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    step = part.select("device", "_track", "time", "lat", "lng", F.coalesce(haversine(*before, F.col("lat"), F.col("lng")), F.lit(0.0)).alias("_m"), bearing(*before, F.col("lat"), F.col("lng")).alias("heading"), (F.coalesce(was, F.lit(False)) & ~F.coalesce("inside", F.lit(True))).alias("exited"))
    return step.select("device", "time", F.row_number().over(own).cast("long").alias("fixes"), F.sum("_m").over(upto).alias("metres"), "heading", "exited")
