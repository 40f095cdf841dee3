"""Simulator scenarios from trajectories, and weather grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import KMS_TO_KNOTS, dms, fixed2

CLOCK, AIRCRAFT = "00:00:00.00>", "A320"


def commands(points: DataFrame, keep_sign: bool = False) -> DataFrame:
    """(id, k, j, line): each flight's creation, speed and altitude, then its waypoints; vertical navigation starts at the first waypoint.

    points: id, callsign, t, event_id, lat, lon, alt, hdg, speed (km/s).
    """
    w = Window.partitionBy("id").orderBy("t", "event_id")
    rows = points.withColumns({"k": F.row_number().over(w) - 1, "acid": F.trim(F.first("callsign").over(w))})
    knots = F.col("speed") * KMS_TO_KNOTS
    text = lambda *xs: F.concat(F.lit(CLOCK), *[F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs])
    c = F.col
    create = text("CRE ", c("acid"), f",{AIRCRAFT},", c("lat"), ",", c("lon"), ",", c("alt"), ",", c("hdg"), ",", fixed2(knots))
    speed = text("SPD ", c("acid"), " ", F.bround(knots, 0).cast("long"))
    alt = text("ALT ", c("acid"), " ", c("alt"))
    lat, lon = dms(c("lat"), keep_sign), dms(c("lon"), keep_sign)
    point = text(c("acid"), " ADDWPT ", lat, ",", lon, ", ", c("alt"))
    vnav = text(c("acid"), " AT ", lat, ",", lon, " STACK ", c("acid"), " VNAV ON")
    lines = F.when(c("k") == 0, F.array(create, speed, alt)).when(c("k") == 1, F.array(point, vnav)).otherwise(F.array(point))
    return rows.select("id", "k", F.posexplode(lines).alias("j", "line"))


def scenario_lines(points: DataFrame) -> DataFrame:
    """The script's lines in order: the header, then flight by flight."""
    body = commands(points).select(F.lit(1).alias("part"), "id", "k", "j", "line")
    head = points.sparkSession.createDataFrame([(0, 0, f"{CLOCK}ASAS OFF")], "k int, j int, line string").select(F.lit(0).alias("part"), F.lit(None).cast(points.schema["id"].dataType).alias("id"), "k", "j", "line")
    return head.unionByName(body).orderBy("part", "id", "k", "j")


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def grid_subset(grid: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Grid points of a box, with wind speed. Rows carry their own coordinates, so north stays north."""
    return grid.filter(F.col("latitude").between(*lat) & F.col("longitude").between(*lon)).withColumn("wind_speed", wind_speed(F.col("u_wind"), F.col("v_wind")))
