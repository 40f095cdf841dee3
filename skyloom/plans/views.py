"""Domain inputs derived from the plain tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trajectory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since the epoch of a time without zone, whatever the session's zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts.cast("timestamp_ntz")) / 1e6


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return e.select(
        "event_id", F.col("user_id").alias("id"), seconds(F.col("ts")).alias("t"),
        (30.0 + (k * 37 % 4200) / 100.0).alias("lat"), (-15.0 + (k * 53 % 5500) / 100.0).alias("lon"),
        (k * 17 % 360).cast("double").alias("hdg"), (F.col("value") * 40.0).alias("alt"),
    )


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trajectory.legs(points(spark, sf_dir))


POINTS = """points AS (
  SELECT event_id, user_id AS id, epoch_us(ts) / 1e6 AS t, 30e0 + (event_id * 37 % 4200) / 100e0 AS lat,
    -15e0 + (event_id * 53 % 5500) / 100e0 AS lon, CAST(event_id * 17 % 360 AS DOUBLE) AS hdg, value * 40e0 AS alt FROM events)"""


def haversine(a: str, b: str, c: str, d: str, r: str = "6371e0") -> str:
    h = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))"
    return f"(2 * {r} * atan2(sqrt({h}), sqrt(greatest(1e0 - {h}, 0e0))))"


LEGS = f"""legs AS (
  SELECT *, CASE WHEN to_time > from_time THEN {haversine("from_lat", "from_lon", "to_lat", "to_lon")} / (to_time - from_time) ELSE 0e0 END AS speed FROM (
    SELECT id, event_id AS leg_id, t AS from_time, lead(t) OVER w AS to_time, lat AS from_lat, lon AS from_lon, lead(lat) OVER w AS to_lat, lead(lon) OVER w AS to_lon,
      alt AS from_alt, lead(alt) OVER w AS to_alt FROM points WINDOW w AS (PARTITION BY id ORDER BY t, event_id)) WHERE to_time IS NOT NULL)"""
