"""Queries over tracks of users, as a table and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.plans.catalog import Catalog
from orbweave.streaming import tracks

FOUND = Catalog()
add = FOUND.add

IDLE_HOURS = 12
_TRACKS = f"""
p AS (SELECT user_id::VARCHAR AS device, ts AS time, value % 90 AS lat, (event_id % 180)::DOUBLE AS lng, value % 90 < 45 AS inside FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
g AS (SELECT *, CASE WHEN epoch_us(time) - lag(epoch_us(time)) OVER w <= {IDLE_HOURS} * 3600000000 THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY device ORDER BY time, lat, lng)),
t AS (SELECT *, sum(new) OVER (PARTITION BY device ORDER BY time, lat, lng ROWS UNBOUNDED PRECEDING) AS track FROM g),
s AS (
  SELECT *, row_number() OVER w AS fixes, lag(lat) OVER w AS a, lag(lng) OVER w AS b, lag(inside) OVER w AS was FROM t WINDOW w AS (PARTITION BY device, track ORDER BY time, lat, lng)),
m AS (
  SELECT *, CASE WHEN a IS NULL THEN 0 ELSE 2 * 6371000 * asin(sqrt(least(1, sin(radians(lat - a) / 2) ** 2 + cos(radians(a)) * cos(radians(lat)) * sin(radians(lng - b) / 2) ** 2))) END AS m FROM s)
SELECT device, time, fixes, round(sum(m) OVER (PARTITION BY device, track ORDER BY time, lat, lng ROWS UNBOUNDED PRECEDING), 2) AS metres, coalesce(was, false) AND NOT inside AS exited FROM m"""


def _fixes(df: DataFrame) -> DataFrame:
    return df.select("user_id", "ts", (F.col("value") % 90).alias("lat"), (F.col("event_id") % 180).cast("double").alias("lng"))


def _tracks(df: DataFrame, late: str = "1 hour") -> DataFrame:
    found = tracks.tracks(_fixes(df), "user_id", "ts", "lat", "lng", F.col("lat") < 45, late, IDLE_HOURS * 3_600_000)
    return found.select("device", "time", "fixes", F.round("metres", 2).alias("metres"), "exited")


@add(f"WITH {_TRACKS}")
def m08_tracks(t):
    return _tracks(t("events"))
