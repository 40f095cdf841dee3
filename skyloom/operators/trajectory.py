"""Trajectory operators: cleaning, legs, sessions, drift-compensated headings, change points, takeoff and landing.

Points: id, t (seconds), lat, lon, and where needed hdg, alt. ``order`` breaks ties in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import kernels

#: Edge between ground and air, in metres.
AIRBORNE_M = 500.0


def by_time(order: str = "event_id") -> Window:
    return Window.partitionBy("id").orderBy("t", order)


def clean_by_speed(points: DataFrame, low_kmh: float = 100.0, high_kmh: float = 1000.0, order: str = "event_id") -> DataFrame:
    """Drops a point whose speed from its original predecessor is out of bounds, or that is not later than it. Null positions stay."""
    w = by_time(order)
    prev = {c: F.lag(c).over(w) for c in ("t", "lat", "lon")}
    hours = (F.col("t") - prev["t"]) / 3600.0
    km = geo.haversine(prev["lat"], prev["lon"], F.col("lat"), F.col("lon"), geo.R_CLEAN_KM)
    speed = F.try_divide(km, hours)
    bad = (hours <= 0) & km.isNotNull() | (speed > high_kmh) | (speed < low_kmh)
    return points.withColumn("_bad", F.coalesce(bad, F.lit(False))).filter("not _bad").drop("_bad")


def legs(points: DataFrame, order: str = "event_id") -> DataFrame:
    """Each point paired with the next of its id; speed in km/s over the leg."""
    w = by_time(order)
    nxt = lambda c: F.lead(c).over(w)
    out = points.select(
        "id", F.col(order).alias("leg_id"),
        F.col("t").alias("from_time"), nxt("t").alias("to_time"),
        F.col("lat").alias("from_lat"), F.col("lon").alias("from_lon"), nxt("lat").alias("to_lat"), nxt("lon").alias("to_lon"),
        F.col("alt").alias("from_alt"), nxt("alt").alias("to_alt"),
    )
    out = out.filter(F.col("to_time").isNotNull())
    km = geo.haversine(*(F.col(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")))
    return out.withColumn("speed", F.coalesce(F.try_divide(km, F.col("to_time") - F.col("from_time")), F.lit(0.0)))


def forward_fill(df: DataFrame, cols: list[str], order: str = "event_id") -> DataFrame:
    """Nulls take the last value before them; leading nulls stay."""
    w = by_time(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def sessions(points: DataFrame, gap_s: float = 18_000.0, order: str = "event_id") -> DataFrame:
    """Numbers the sessions of each id: a gap longer than ``gap_s`` starts a new one."""
    w = by_time(order)
    new = (F.col("t") - F.lag("t").over(w) > gap_s).cast("int")
    return points.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_new")


def session_table(points: DataFrame, gap_s: float = 18_000.0, least: int = 1) -> DataFrame:
    """One row a session: instance id, bounds and count."""
    rows = sessions(points, gap_s).groupBy("id", "session").agg(F.min("t").alias("from_t"), F.max("t").alias("to_t"), F.count("*").alias("n"))
    return rows.filter(F.col("n") >= least).select(F.concat_ws("|", "id", F.col("from_t").cast("long")).alias("instance"), "from_t", "to_t", "n")


def session_points(points: DataFrame, gap_s: float = 18_000.0, least: int = 2, order: str = "event_id") -> DataFrame:
    """Points with their session's instance id and its number of points; sessions of fewer than ``least`` go."""
    w = Window.partitionBy("id", "session")
    rows = sessions(points, gap_s, order).select("*", F.min("t").over(w).alias("_t0"), F.count("*").over(w).alias("n")).filter(F.col("n") >= least)
    return rows.withColumn("instance", F.concat_ws("|", "id", F.col("_t0").cast("long"))).drop("_t0")


def leg_stats(legs_: DataFrame) -> DataFrame:
    """Per id: mean and deviations of the speed, and the slope of altitude over time."""
    aggs = [F.avg("speed").alias("mean"), F.stddev_samp("speed").alias("std_sample"), F.stddev_pop("speed").alias("std_population"), F.regr_slope("from_alt", "from_time").alias("slope")]
    return legs_.groupBy("id").agg(*aggs)


def drift_heading(points: DataFrame, order: str = "event_id") -> DataFrame:
    """Heading less the drift that great circles add since the first point; the first point's is 0. Also the speed to the next point in km/s."""
    w = by_time(order)
    lag = lambda c: F.lag(c).over(w)
    km = geo.haversine(lag("lat"), lag("lon"), F.col("lat"), F.col("lon"))
    out = points.withColumns({"_km": km, "_drift": geo.drift_rate(lag("lat"), lag("lon"), lag("hdg")) * km, "_dt": F.col("t") - lag("t"), "_n": F.row_number().over(w)})
    total = F.sum(F.coalesce("_drift", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    hdg = F.when(F.col("_n") == 1, 0.0).otherwise(F.pmod(F.col("hdg") - total, F.lit(360.0)))
    vel = F.coalesce(F.lead(F.try_divide(F.col("_km"), F.col("_dt"))).over(w), F.lit(0.0))
    return out.withColumns({"hdg_comp": hdg, "vel": vel}).drop("_km", "_drift", "_dt", "_n")


def airborne_edges(points: DataFrame, limit: float = AIRBORNE_M, order: str = "event_id") -> DataFrame:
    """Per id: position of the first point above the limit after one that isn't (takeoff), and of the first at or below it after one above (landing), from 0; -1 if none."""
    w = by_time(order)
    up = F.col("alt") > limit
    rows = points.select("id", (F.row_number().over(w) - 1).alias("k"), up.alias("up"), F.lag(up).over(w).alias("was"))
    first = lambda c: F.coalesce(F.min(F.when(c, F.col("k"))), F.lit(-1)).cast("long")
    return rows.groupBy("id").agg(first(F.col("up") & ~F.col("was")).alias("takeoff"), first(~F.col("up") & F.col("was")).alias("landing"))


POINT = ("time", "lat", "lon", "alt", "vel")
TURNS = ", ".join(["landed boolean", *(f"{c} array<struct<{','.join(f'{x}:double' for x in POINT)}>>" for c in ("tp", "dp"))])


def turns_and_rises(points: DataFrame) -> DataFrame:
    """Turning points and altitude change points of each id, by change-point search on the compensated heading and the altitude.

    Everything up to the search is window functions; one task sees one flight at a time. Flights are grouped by the id as it is, so they meet as the windows left them.
    """
    ready = drift_heading(points.dropna(subset=["t", "lat", "lon", "hdg", "alt"])).select("id", "t", "event_id", "lat", "lon", "alt", "vel", "hdg_comp")

    def listed(found: list[tuple]) -> pa.Array:
        own = pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in np.array(found).T], POINT)
        return pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), own)

    def run(flight: pa.Table) -> pa.Table:
        flight = flight.sort_by([("t", "ascending"), ("event_id", "ascending")])
        col = lambda c: flight.column(c).to_numpy().astype(float)
        cols = np.column_stack([col(c) for c in ("t", *POINT[1:])])
        tp, landed = kernels.turning_points(cols, col("hdg_comp"), AIRBORNE_M)
        return pa.table([flight.column("id").slice(0, 1), pa.array([landed]), listed(tp), listed(kernels.altitude_points(cols))], names=["id", "landed", "tp", "dp"])

    found = ready.groupBy("id").applyInArrow(run, f"id {ready.schema['id'].dataType.simpleString()}, {TURNS}")
    return found.withColumn("id", F.col("id").cast("string"))


def waypoints(turns: DataFrame, which: str = "tp") -> DataFrame:
    """One row a change point, named by flight and position."""
    rows = turns.select("id", F.posexplode(which).alias("k", "p"))
    return rows.select("id", F.concat_ws("_", "id", "k").alias("waypoint_name"), *[F.col(f"p.{c}").alias(f"waypoint_{c}") for c in ("lat", "lon", "alt", "time")], F.col("p.vel").alias("waypoint_speed"), "k")


def route_legs(points: DataFrame, low_kmh: float = 100.0, high_kmh: float = 1000.0) -> DataFrame:
    """Cleaned points to legs between consecutive turning points."""
    w = waypoints(turns_and_rises(clean_by_speed(points, low_kmh, high_kmh)))
    nxt = Window.partitionBy("id").orderBy("k")
    pairs = {"time": "waypoint_time", "lat": "waypoint_lat", "lon": "waypoint_lon", "alt": "waypoint_alt", "speed": "waypoint_speed"}
    cols = [F.col("id")] + [x for n, c in pairs.items() for x in (F.col(c).alias(f"from_{n}"), F.lead(c).over(nxt).alias(f"to_{n}"))]
    return w.select(*cols).filter(F.col("to_time").isNotNull())


def regrouped(turns: DataFrame, rises: DataFrame, landed_below: float = 1000.0) -> DataFrame:
    """Waypoint rows of turns and rises back to one row a flight; landed if the last point of either is low."""

    def packed(df: DataFrame, name: str) -> DataFrame:
        p = F.struct(*[F.col(f"waypoint_{c}").alias(c) for c in ("time", "lat", "lon", "alt")], F.col("waypoint_speed").alias("vel"))
        return df.groupBy("id").agg(F.array_sort(F.collect_list(p)).alias(name))

    both = packed(turns, "tp").join(packed(rises, "dp"), "id")
    last = lambda c: F.try_element_at(c, F.lit(-1))["alt"]
    return both.withColumn("landed", (last("tp") < landed_below) | (last("dp") < landed_below))


def tola(points: DataFrame, at_hz: float = 1.0) -> DataFrame:
    """Takeoff and landing times by the slope of the altitude around the transition altitude; null where none."""
    rows = points.select(F.col("id").cast("string").alias("id"), "t", "event_id", "lat", "lon", "alt")

    def sampled(grid: np.ndarray, t: np.ndarray, x: np.ndarray) -> np.ndarray:
        # at a point's own time its value counts, also beside one without a value
        out, k = np.interp(grid, t, x), np.searchsorted(t, grid, side="right") - 1
        return np.where(np.isnan(out) & (t[k] == grid), x[k], out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "event_id"], kind="stable")
        t, h = pdf["t"].to_numpy(), pdf["alt"].to_numpy()
        grid = np.arange(t[0], t[-1], at_hz)
        to, la = kernels.slope_takeoff_landing(grid, sampled(grid, t, h)) if len(grid) > 1 else (None, None)
        out = []
        for kind, k in (("takeoff", to), ("landing", la)):
            if k is not None:
                out.append((pdf["id"].iloc[0], kind, grid[k], *(float(sampled(grid[k : k + 1], t, pdf[c].to_numpy())[0]) for c in ("lat", "lon"))))
        return pd.DataFrame(out, columns=["id", "kind", "time", "lat", "lon"])

    return rows.groupBy("id").applyInPandas(run, "id string, kind string, time double, lat double, lon double")


def resampled(legs_: DataFrame, step: float) -> DataFrame:
    """(id, t, lat, lon, alt) at multiples of ``step``, linear between a leg's ends; each instant belongs to the leg that it begins or lies inside."""
    k = F.sequence(F.ceil(F.col("from_time") / step), F.ceil(F.col("to_time") / step) - 1)
    rows = legs_.filter(F.ceil(F.col("to_time") / step) > F.ceil(F.col("from_time") / step)).select("*", (F.explode(k)).alias("k"))
    rows = rows.withColumn("t", F.col("k") * F.lit(float(step))).withColumn("w", (F.col("t") - F.col("from_time")) / (F.col("to_time") - F.col("from_time")))
    at = lambda c: (F.col(f"from_{c}") + F.col("w") * (F.col(f"to_{c}") - F.col(f"from_{c}"))).alias(c)
    return rows.select("id", "t", at("lat"), at("lon"), at("alt"))


def relative_time(points: DataFrame) -> DataFrame:
    """Seconds since the flight's first point, and their share of its duration (0 for a flight of one instant)."""
    w = Window.partitionBy("id")
    first, last = F.min("t").over(w), F.max("t").over(w)
    return points.withColumns({"t_rel": F.col("t") - first, "t_share": F.coalesce(F.try_divide(F.col("t") - first, last - first), F.lit(0.0))})


def nearest_site(points: DataFrame, sites: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, site and error: the site (site, site_lat, site_lon, site_no) nearest in degrees to each point; ties to the smaller number. Repeated points stay.

    Sites become a k-d tree of at most ``TREE_ROWS``, which is built once and sent to every executor; a batch of points goes down
    the tree together, so a point sees a few sites and nothing is shuffled. More sites are several trees, one after the other. Sites or points without a
    place meet nothing; a point without a site has null.
    """
    sc = sites.sparkSession.sparkContext
    placed = sites.filter("site_lat is not null and site_lon is not null and not isnan(site_lat) and not isnan(site_lon)")
    placed = placed.select(F.col("site_lat").cast("double"), F.col("site_lon").cast("double"), F.col("site_no").cast("long"), F.col("site").cast("string"))
    blocks = -(-max(placed.count(), 1) // TREE_ROWS)
    out = points.select(*keep, F.col("lat").cast("double").alias("_lat"), F.col("lon").cast("double").alias("_lon"), F.lit(None).cast("double").alias("error"), F.lit(None).cast("long").alias("_no"), F.lit(None).cast("string").alias("site"))
    for k in range(blocks):
        own = placed.filter(F.pmod(F.xxhash64("site_no"), F.lit(blocks)) == k).toArrow()
        col = lambda c: own.column(c).to_numpy()  # noqa: B023, E731
        sent = sc.broadcast((kernels.Tree(col("site_lat"), col("site_lon"), col("site_no")), own.column("site").combine_chunks()))
        out = out.mapInArrow(_nearest(sent, keep), out.schema)
    return out.select(*keep, "site", "error")


def _nearest(sent: Broadcast, keep: list[str]):
    """Batches of points with the nearest of the tree's sites, where it is nearer than the one so far."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, names = sent.value
        for b in it:
            col = lambda c: b.column(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            far, at = tree.nearest(col("_lat").astype(float), col("_lon").astype(float))
            no = pa.array(tree.no[at] if len(tree.no) else np.zeros(len(at), np.int64), pa.int64(), mask=at < 0)
            site = names.take(pa.array(at, mask=at < 0)) if len(tree.no) else pa.nulls(len(at), pa.string())
            error = pa.array(far, pa.float64(), mask=at < 0)
            old = np.where(b.column("error").is_valid(), col("error"), np.inf)
            tie = (far == old) & (np.where(no.is_valid(), tree.no[at] if len(tree.no) else 0, np.iinfo(np.int64).max) < np.where(b.column("_no").is_valid(), b.column("_no").fill_null(0).to_numpy(), np.iinfo(np.int64).max))
            new = pa.array((at >= 0) & ((far < old) | tie))
            pick = lambda c, x: pc.if_else(new, x, b.column(c))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*keep, "_lat", "_lon")), pick("error", error), pick("_no", no), pick("site", site)], schema=b.schema)

    return run


#: Sites of one tree.
TREE_ROWS = 1_000_000
#: Rows of a dimension that may be broadcast.
DIMENSION_ROWS = 200_000


def checked_broadcast(dim: DataFrame, most: int = DIMENSION_ROWS) -> DataFrame:
    """``dim`` with a broadcast hint if it is small enough, else as it is."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim




def of_flight(legs: DataFrame, flight: str) -> DataFrame:
    """The legs of one flight in order; the filter reaches the scan."""
    return legs.filter(F.col("id") == F.lit(flight)).orderBy("from_time", "leg_id")


def flight_route(points: DataFrame, flight: str | int, low_kmh: float = 100.0, high_kmh: float = 1000.0) -> DataFrame:
    """The legs between turning points of one flight, in order, from its points; the other flights are never read beyond the scan's filter."""
    return route_legs(points.filter(F.col("id") == F.lit(flight)), low_kmh, high_kmh).orderBy("from_time")


def sliced(rows: DataFrame, order: list[str], first: int, last: int) -> DataFrame:
    """Rows ``first`` up to but not ``last`` of an order; a top-k, never a sort of all."""
    return rows.orderBy(*order).offset(first).limit(last - first)
