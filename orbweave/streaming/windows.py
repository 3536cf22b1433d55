"""Structured Streaming over location events: windows with watermarks, geofences, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, window: str, value: str, device: str, late: str = "10 minutes") -> DataFrame:
    """Count, devices, centroid and spread per window of event time; works on streams and, alike, on tables.

    The spread around the centroid comes from sums of squares, so that one pass and constant state per
    window do; distinct devices are approximate on a stream (exact counts have no bounded state).
    """
    kinds = F.approx_count_distinct(device) if events.isStreaming else F.count_distinct(F.col(device))
    e = events.withWatermark(time, late) if events.isStreaming else events
    g = e.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), kinds.alias("devices"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"))
    return g.select(F.col("w.start").alias("start"), "n", "devices", "mean", "spread")


def sliding(events: DataFrame, time: str, window: str, step: str, value: str, late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(F.window(time, window, step).alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, time: str, gap: str, device: str, late: str = "10 minutes") -> DataFrame:
    e = events.withWatermark(time, late) if events.isStreaming else events
    return e.groupBy(device, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(device, F.col("w.start").alias("start"), "n")


def geofence_alerts(events: DataFrame, inside: Column) -> DataFrame:
    """Events outside the fence; stateless, so it runs on either kind of table."""
    return events.where(~F.coalesce(inside, F.lit(True)))
