"""All queries of the engine by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars, sql_tables
from ..operators import airspace, flows, graph, linkage, networks, occupancy, polygons, scenario, stitch, trajectory
from ..operators import spectral as spectra
from ..sources import grids, tables
from . import stepwise_sql, views
from .views import LEGS, POINTS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Grid of the counting queries: coarse, as the derived legs are long.
GRID = occupancy.Grid(cell=5.0, window=3600.0)
#: A concave region, and a polyline, of (lon, lat).
REGION = [(-5.0, 40.0), (20.0, 38.0), (25.0, 60.0), (10.0, 48.5), (-3.0, 58.0)]
LINE = [(-10.0, 35.0), (5.0, 45.0), (15.0, 50.0), (35.0, 68.0)]
DAY = 86_400


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _r(*cols: str, digits: int = 6) -> list:
    return [scalars.rounded(F.col(c), digits).alias(c) for c in cols]


def _rs(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


# ---------------------------------------------------------------- ingest and stitching


@query("snapshot_minute_max", f"WITH {POINTS}, p AS (SELECT *, max(t) OVER (PARTITION BY floor(t / 3600)) AS m FROM points) SELECT event_id, id, t FROM p WHERE t = m AND lat BETWEEN 30 AND 60 AND lon BETWEEN -15 AND 30")
def snapshot_minute_max(spark, d):
    # the latest of all rows first, the box afterwards: a bucket whose latest row lies outside gives nothing
    return stitch.fresh_in_box(stitch.latest_snapshot(views.points(spark, d), 3600.0), (30.0, 60.0), (-15.0, 30.0)).select("event_id", "id", "t")


@query("fresh_points", f"WITH {POINTS} SELECT event_id, id FROM points WHERE lat BETWEEN 30 AND 60 AND lon BETWEEN -15 AND 30 AND event_id % 120 <= 60")
def fresh_points(spark, d):
    p = views.points(spark, d).withColumn("lastcontact", F.col("t") - F.col("event_id") % 120)
    return stitch.fresh_in_box(p, (30.0, 60.0), (-15.0, 30.0), 60.0).select("event_id", "id")


@query("snapshot_per_flight", f"WITH {POINTS} SELECT event_id, id, t FROM points QUALIFY t = max(t) OVER (PARTITION BY id, floor(t / 86400))")
def snapshot_per_flight(spark, d):
    return stitch.latest_snapshot(views.points(spark, d), float(DAY), ["id"]).select("event_id", "id", "t")


def _catalogue(spark, d) -> DataFrame:
    return stitch.catalogue(views.points(spark, d), (F.floor(F.col("t") / DAY) * DAY).cast("long"))


_CAT = f"{POINTS}, days AS (SELECT DISTINCT id, CAST(floor(t / 86400) AS BIGINT) * 86400 AS f FROM points)"


@query("catalogue_files", f"WITH {_CAT} SELECT id, string_agg(f::VARCHAR, ',' ORDER BY f) AS files, array_to_string(list_slice(list(f ORDER BY f), 1, 5), ',') AS first_files, count(*) AS n FROM days GROUP BY id")
def catalogue_files(spark, d):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _catalogue(spark, d).select("id", text(F.col("files")).alias("files"), text(F.slice("files", 1, 5)).alias("first_files"), F.size("files").cast("long").alias("n"))


@query("catalogue_inverted", f"WITH {_CAT} SELECT f AS file, count(*) AS ids, string_agg(id::VARCHAR, ',' ORDER BY id) AS list FROM days GROUP BY f")
def catalogue_inverted(spark, d):
    inv = stitch.inverted(_catalogue(spark, d))
    return inv.groupBy("file").agg(F.count("*").alias("ids"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), ",").alias("list"))


@query("gap_filter", f"WITH {_CAT}, g AS (SELECT id, f, f - lag(f) OVER (PARTITION BY id ORDER BY f) AS gap FROM days) SELECT id, count(*) AS n FROM g GROUP BY id HAVING coalesce(bool_and(gap <= 2 * 86400), true)")
def gap_filter(spark, d):
    # on these sparse points "consecutive" is a gap of at most two days
    return stitch.consecutive_only(_catalogue(spark, d), 2 * DAY, at_most=True).select("id", F.size("files").cast("long").alias("n"))


@query("gap_consecutive", f"WITH {POINTS}, files AS (SELECT DISTINCT id, CAST(floor(t / 259200) AS BIGINT) * 259200 AS f FROM points), g AS (SELECT id, f, f - lag(f) OVER (PARTITION BY id ORDER BY f) AS gap FROM files) SELECT id, count(*) AS n FROM g GROUP BY id HAVING coalesce(bool_and(gap = 259200), true)")
def gap_consecutive(spark, d):
    # the whole catalogue in files of three days
    cat = stitch.catalogue(views.points(spark, d), (F.floor(F.col("t") / (3 * DAY)) * (3 * DAY)).cast("long"))
    return stitch.consecutive_only(cat, 3 * DAY).select("id", F.size("files").cast("long").alias("n"))


@query("gap_consecutive_all", f"WITH {POINTS}, files AS (SELECT DISTINCT id, CAST(floor(t / 172800) AS BIGINT) * 172800 AS f FROM points), g AS (SELECT id, f, f - lag(f) OVER (PARTITION BY id ORDER BY f) AS gap FROM files) SELECT id, count(*) AS n FROM g GROUP BY id HAVING coalesce(bool_and(gap = 172800), true)")
def gap_consecutive_all(spark, d):
    # the whole catalogue; files of two days, as nearly every id misses some single day
    cat = stitch.catalogue(views.points(spark, d), (F.floor(F.col("t") / (2 * DAY)) * (2 * DAY)).cast("long"))
    return stitch.consecutive_only(cat, 2 * DAY).select("id", F.size("files").cast("long").alias("n"))


@query("gap_truncate", f"WITH {_CAT}, g AS (SELECT id, f, coalesce(f - lag(f) OVER w > 86400, false) AS brk FROM days WINDOW w AS (PARTITION BY id ORDER BY f)), s AS (SELECT id, f, sum(brk::INT) OVER (PARTITION BY id ORDER BY f) AS k FROM g) SELECT id, count(*) AS n, max(f) AS last FROM s WHERE k = 0 GROUP BY id HAVING count(*) >= 2")
def gap_truncate(spark, d):
    return stitch.truncated(_catalogue(spark, d), DAY, 2).select("id", F.size("files").cast("long").alias("n"), F.array_max("files").alias("last"))


@query("gather_listed", f"WITH {_CAT}, k AS (SELECT id FROM days GROUP BY id HAVING count(*) >= 20) SELECT event_id, id FROM points WHERE id IN (SELECT id FROM k)")
def gather_listed(spark, d):
    p = views.points(spark, d).withColumn("file", (F.floor(F.col("t") / DAY) * DAY).cast("long"))
    return stitch.gathered(p, _catalogue(spark, d).filter(F.size("files") >= 20)).select("event_id", "id")


@query("relocate_rows", f"WITH {_CAT}, h AS (SELECT id, min(f) AS home FROM days GROUP BY id HAVING count(*) <= 22) SELECT coalesce(home, CAST(floor(t / 86400) AS BIGINT) * 86400) AS file, count(*) AS n FROM points LEFT JOIN h USING (id) GROUP BY 1")
def relocate_rows(spark, d):
    p = views.points(spark, d).withColumn("file", (F.floor(F.col("t") / DAY) * DAY).cast("long"))
    return stitch.relocated(p, _catalogue(spark, d), 22).groupBy("file").agg(F.count("*").alias("n"))


_SESS = f"{POINTS}, g AS (SELECT *, coalesce(t - lag(t) OVER w > 18000, false)::INT AS new FROM points WINDOW w AS (PARTITION BY id ORDER BY t, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)"


@query("sessions_5h", f"WITH {_SESS} SELECT id || '|' || CAST(trunc(min(t)) AS BIGINT) AS instance, min(t) AS from_t, max(t) AS to_t, count(*) AS n FROM s GROUP BY id, session")
def sessions_5h(spark, d):
    return trajectory.session_table(views.points(spark, d))


@query("session_files", f"WITH {_CAT}, c AS (SELECT id, f, coalesce(f - lag(f) OVER (PARTITION BY id ORDER BY f) > 86400, false)::INT AS new FROM days), s AS (SELECT id, f, sum(new) OVER (PARTITION BY id ORDER BY f ROWS UNBOUNDED PRECEDING) AS k FROM c) SELECT id || '|' || min(f) AS instance, min(f) AS from_file, max(f) AS to_file, string_agg(f::VARCHAR, '/' ORDER BY f) AS files FROM s GROUP BY id, k")
def session_files(spark, d):
    s = stitch.session_files(views.points(spark, d), (F.floor(F.col("t") / DAY) * DAY).cast("long"), DAY)
    return s.withColumn("files", F.array_join(F.transform("files", lambda x: x.cast("string")), "/"))


_DAY_FILES = f"{POINTS}, fs AS (SELECT DISTINCT id, CAST(floor(t / 172800) AS BIGINT) * 172800 AS f FROM points), g AS (SELECT id, f, f - lag(f) OVER (PARTITION BY id ORDER BY f) AS gap FROM fs), ok AS (SELECT id FROM g GROUP BY id HAVING coalesce(bool_and(gap = 172800), true) AND min(f) BETWEEN 1703980800 AND 1704326400)"


@query("day_flights", f"WITH {_DAY_FILES} SELECT event_id, id, t FROM points WHERE id IN (SELECT id FROM ok)")
def day_flights(spark, d):
    # files of two days, flights that begin in the first three of them
    return stitch.day_flights(views.points(spark, d), (F.floor(F.col("t") / (2 * DAY)) * (2 * DAY)).cast("long"), 2 * DAY, 1703980800, 1704326400).select("event_id", "id", "t")


@query("full_days", f"""WITH {POINTS}, f AS (SELECT DISTINCT id, CAST(floor(t / 86400) AS BIGINT) * 86400 AS day, CAST(floor(t / 21600) AS BIGINT) * 21600 AS file FROM points), b AS (SELECT day, min(file) AS lo, max(file) AS hi FROM f GROUP BY day),
c AS (SELECT id, day, bool_or(file = lo) AS starts, bool_or(file = hi) AS ends FROM f JOIN b USING (day) GROUP BY id, day),
x AS (SELECT id, day, file FROM f UNION ALL SELECT c.id, c.day, f.file FROM c JOIN c n ON n.id = c.id AND n.day = c.day + 86400 AND c.ends AND n.starts JOIN f ON f.id = n.id AND f.day = n.day),
g AS (SELECT *, coalesce(file - lag(file) OVER (PARTITION BY id, day ORDER BY file) > 43200, false) AS brk FROM x), s AS (SELECT *, sum(brk::INT) OVER (PARTITION BY id, day ORDER BY file) AS k FROM g), k AS (SELECT * FROM s WHERE k = 0 QUALIFY count(*) OVER (PARTITION BY id, day) >= 2)
SELECT k.id, k.day, count(DISTINCT k.file) AS files, count(*) AS n, max(k.file) AS last FROM k JOIN points p ON p.id = k.id AND CAST(floor(p.t / 21600) AS BIGINT) * 21600 = k.file GROUP BY ALL""")
def full_days(spark, d):
    # on these sparse points a file is six hours, and a gap of two files no break
    _, rows = stitch.full_days(views.points(spark, d), 21_600, DAY, 43_200, 2)
    return rows.groupBy("id", "day").agg(F.count_distinct("file").alias("files"), F.count("*").alias("n"), F.max("file").alias("last"))


@query("flight_legs", f"WITH {POINTS}, {LEGS} SELECT leg_id, from_time, to_time FROM legs WHERE id = 7")
def flight_legs(spark, d):
    return trajectory.of_flight(views.legs(spark, d), 7).select("leg_id", "from_time", "to_time")


@query("flight_ids", "SELECT event_id, 'a' || user_id || 'F' || (event_id % 90) AS craft_first, 'F' || (event_id % 90) || 'a' || user_id AS call_first, 'F' || (event_id % 90) || '_a' || user_id AS underscored, 'A' || user_id || 'F' || (event_id % 90) AS clean, substr(sha256(user_id || chr(31) || event_id), 1, 10) AS short FROM events")
def flight_ids(spark, d):
    craft, call = F.concat(F.lit("a"), F.col("user_id").cast("string")), F.concat(F.lit("F"), (F.col("event_id") % 90).cast("string"))
    forms = [scalars.flight_id(craft, call, f).alias(f) for f in ("craft_first", "call_first", "underscored")]
    clean = scalars.flight_id(craft, F.concat(F.lit(" "), F.lower(call), F.lit("  "))).alias("clean")
    return table(spark, d, "events").select("event_id", *forms, clean, scalars.stable_id(F.col("user_id"), F.col("event_id")).alias("short"))


@query("id_slice", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 20")
def id_slice(spark, d):
    return trajectory.sliced(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], 20, 70)


@query("sites_shared", "SELECT DISTINCT s_nationkey AS key FROM supplier INTERSECT SELECT DISTINCT c_nationkey FROM customer")
def sites_shared(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("key")).intersect(table(spark, d, "customer").select("c_nationkey"))


@query("session_instances", f"WITH {_SESS}, i AS (SELECT id, session, id || '|' || CAST(trunc(min(t)) AS BIGINT) AS instance, count(*) AS n FROM s GROUP BY id, session HAVING count(*) >= 2) SELECT event_id, instance, n FROM s JOIN i USING (id, session)")
def session_instances(spark, d):
    return trajectory.session_points(views.points(spark, d)).select("event_id", "instance", "n")


@query("keep_first", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def keep_first(spark, d):
    return stitch.keep_first(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


# ---------------------------------------------------------------- trajectories


@query("speed_clean", f"""WITH {POINTS}, s AS (SELECT event_id, id, (t - lag(t) OVER w) / 3600 AS h, {views.haversine("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon", "6371.0088e0")} AS km FROM points WINDOW w AS (PARTITION BY id ORDER BY t, event_id))
SELECT event_id, id FROM s WHERE h IS NULL OR (h > 0 AND km / h BETWEEN 50 AND 1000)""")
def speed_clean(spark, d):
    return trajectory.clean_by_speed(views.points(spark, d), 50.0, 1000.0).select("event_id", "id")


@query("legs_lead", f"WITH {POINTS}, {LEGS} SELECT leg_id, id, from_time, to_time, from_lat, from_lon, to_lat, to_lon, {_rs('speed', digits=7)} FROM legs")
def legs_lead(spark, d):
    return views.legs(spark, d).select("leg_id", "id", "from_time", "to_time", "from_lat", "from_lon", "to_lat", "to_lon", *_r("speed", digits=7))


_DRIFT = "((((degrees(atan2(sin(radians(h0)) * cos(radians(a0)), cos(10e0 / 6371e0) * cos(radians(h0)) * cos(radians(a0)) - sin(10e0 / 6371e0) * sin(radians(a0)))) - h0 + 180) % 360 + 360) % 360 - 180) / 10e0)"


@query("drift_heading", f"""WITH {POINTS}, l AS (SELECT *, lag(lat) OVER w AS a0, lag(lon) OVER w AS o0, lag(hdg) OVER w AS h0, row_number() OVER w AS rn FROM points WINDOW w AS (PARTITION BY id ORDER BY t, event_id)),
k AS (SELECT *, {_DRIFT} * {views.haversine("a0", "o0", "lat", "lon")} AS drift FROM l),
c AS (SELECT event_id, rn, hdg - sum(coalesce(drift, 0e0)) OVER (PARTITION BY id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS x FROM k)
SELECT event_id, round(CASE WHEN rn = 1 THEN 0e0 ELSE ((x % 360) + 360) % 360 END, 5) AS hdg_comp FROM c""")
def drift_heading(spark, d):
    return trajectory.drift_heading(views.points(spark, d)).select("event_id", *_r("hdg_comp", digits=5))


@query("airborne_edges", f"""WITH {POINTS}, e AS (SELECT id, row_number() OVER w - 1 AS k, alt > 500 AS up, lag(alt > 500) OVER w AS was FROM points WINDOW w AS (PARTITION BY id ORDER BY t, event_id))
SELECT id, coalesce(min(CASE WHEN up AND NOT was THEN k END), -1) AS takeoff, coalesce(min(CASE WHEN NOT up AND was THEN k END), -1) AS landing FROM e GROUP BY id""")
def airborne_edges(spark, d):
    return trajectory.airborne_edges(views.points(spark, d))


@query("forward_fill", f"WITH {POINTS} SELECT event_id, last_value(CASE WHEN hdg < 180 THEN hdg END IGNORE NULLS) OVER (PARTITION BY id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS hdg FROM points")
def forward_fill(spark, d):
    return trajectory.forward_fill(views.points(spark, d).withColumn("hdg", F.when(F.col("hdg") < 180, F.col("hdg"))), ["hdg"]).select("event_id", "hdg")


def _flown(points: str) -> str:
    """CTEs ending in ``flown``: points with the compensated heading and the speed to the next one, by position."""
    return f"""l AS (SELECT *, lag(lat) OVER w AS a0, lag(lon) OVER w AS o0, lag(hdg) OVER w AS h0, t - lag(t) OVER w AS dt, row_number() OVER w AS rn FROM {points} WHERE t + lat + lon + hdg + alt IS NOT NULL WINDOW w AS (PARTITION BY id ORDER BY t, event_id)),
km AS (SELECT *, {views.haversine("a0", "o0", "lat", "lon")} AS km FROM l), dr AS (SELECT *, hdg - sum(coalesce({_DRIFT} * km, 0e0)) OVER (PARTITION BY id ORDER BY rn ROWS UNBOUNDED PRECEDING) AS x, coalesce(lead(km / nullif(dt, 0)) OVER (PARTITION BY id ORDER BY rn), 0e0) AS vel FROM km),
flown AS (SELECT CAST(id AS VARCHAR) AS id, rn AS k, t AS time, lat, lon, alt, vel, CASE WHEN rn = 1 THEN 0e0 ELSE ((x % 360) + 360) % 360 END AS hdg FROM dr)"""


_CHANGES = f"{POINTS}, {_flown('points')}, {stepwise_sql.change_points('flown')}"
_CLEANED = f"""{POINTS}, pace AS (SELECT *, (t - lag(t) OVER w) / 3600 AS h, {views.haversine("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon", "6371.0088e0")} AS leg_km FROM points WINDOW w AS (PARTITION BY id ORDER BY t, event_id)),
cleaned AS (SELECT event_id, id, t, lat, lon, hdg, alt FROM pace WHERE NOT coalesce(h <= 0 AND leg_km IS NOT NULL OR leg_km / nullif(h, 0) > 1000 OR leg_km / nullif(h, 0) < 50, false))"""
_TURNED = (("time", "time", 3), ("lat", "lat", 6), ("lon", "lon", 6), ("alt", "alt", 6), ("speed", "vel", 6))


def _route_sql(where: str) -> str:
    pairs = ", ".join(f"round({c}, {n}) AS from_{x}, round(lead({c}) OVER w, {n}) AS to_{x}" for x, c, n in _TURNED)
    return f"WITH RECURSIVE {_CLEANED}, {_flown('cleaned')}, {stepwise_sql.change_points('flown')} SELECT id, {pairs} FROM points_of WHERE kind = 'turn' AND {where} WINDOW w AS (PARTITION BY id ORDER BY k) QUALIFY lead(time) OVER w IS NOT NULL"


def _rounded_route(route: DataFrame) -> DataFrame:
    return route.select("id", *[F.round(f"{end}_{x}", n).alias(f"{end}_{x}") for x, _, n in _TURNED for end in ("from", "to")])


@query("change_points", f"WITH RECURSIVE {_CHANGES} SELECT id, id || '_' || k AS waypoint_name, {', '.join(f'round({c}, {n}) AS waypoint_{x}' for x, c, n in _TURNED)}, k, kind FROM points_of")
def change_points(spark, d):
    turns = trajectory.turns_and_rises(views.points(spark, d))
    both = trajectory.waypoints(turns).withColumn("kind", F.lit("turn")).unionByName(trajectory.waypoints(turns, "dp").withColumn("kind", F.lit("rise")))
    return both.select("id", "waypoint_name", *[F.round(f"waypoint_{x}", n).alias(f"waypoint_{x}") for x, _, n in _TURNED], "k", "kind")


@query("route_legs", _route_sql("true"))
def route_legs(spark, d):
    return _rounded_route(trajectory.route_legs(views.points(spark, d), 50.0, 1000.0))


@query("change_points_sql", f"WITH RECURSIVE {_CHANGES} SELECT CAST(id AS BIGINT) AS id, CASE kind WHEN 'turn' THEN 'tp' ELSE 'dp' END AS kind, k, {', '.join(f'round({c}, {n}) AS {c}' for _, c, n in _TURNED)} FROM points_of")
def change_points_sql(spark, d):
    sql_tables.register(spark)
    trajectory.drift_heading(views.points(spark, d).dropna(subset=["t", "lat", "lon", "hdg", "alt"])).createOrReplaceTempView("skyloom_flown")
    return spark.sql(f"SELECT id, kind, k, {', '.join(f'round({c}, {n}) AS {c}' for _, c, n in _TURNED)} FROM change_points(TABLE(skyloom_flown) PARTITION BY id ORDER BY (t, event_id))")


@query("flight_route", _route_sql("id = '7'"))
def flight_route(spark, d):
    return _rounded_route(trajectory.flight_route(views.points(spark, d), 7, 50.0, 1000.0))


@query("flight_turns_regrouped", f"""WITH RECURSIVE {_CHANGES},
ends AS (SELECT id, kind, count(*) AS n, arg_max(alt, (time, lat, lon, alt, vel)) AS alt FROM points_of GROUP BY id, kind)
SELECT x.id, x.alt < 1000 OR y.alt < 1000 AS landed, CAST(x.n AS INT) AS turns, CAST(y.n AS INT) AS rises FROM ends x JOIN ends y ON x.id = y.id AND x.kind = 'turn' AND y.kind = 'rise'""")
def flight_turns_regrouped(spark, d):
    turns = trajectory.turns_and_rises(views.points(spark, d))
    return trajectory.regrouped(trajectory.waypoints(turns), trajectory.waypoints(turns, "dp")).select("id", "landed", F.size("tp").alias("turns"), F.size("dp").alias("rises"))


@query("tola", f"WITH {POINTS}, {stepwise_sql.slopes('points')} SELECT id, kind, time, lat, lon FROM tola")
def tola(spark, d):
    # the points are hours apart: they are taken as one sample a second
    w = trajectory.by_time()
    return trajectory.tola(views.points(spark, d).withColumn("t", F.row_number().over(w).cast("double")))


def _sites(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(F.col("n_name").alias("site"), k.alias("site_no"), (32.0 + k * 1.5).alias("site_lat"), (-14.0 + (k * 7 % 25) * 2.0).alias("site_lon"))


_SITES = "sites AS (SELECT n_name AS site, n_nationkey AS site_no, 32e0 + n_nationkey * 1.5e0 AS site_lat, -14e0 + (n_nationkey * 7 % 25) * 2e0 AS site_lon FROM nation)"


@query("nearest_site", f"""WITH {POINTS}, {_SITES}, x AS (SELECT event_id, site, site_no, sqrt(pow(lat - site_lat, 2) + pow(lon - site_lon, 2)) AS error FROM points, sites)
SELECT event_id, site, round(error, 6) AS error FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY error, site_no) = 1""")
def nearest_site(spark, d):
    return trajectory.nearest_site(views.points(spark, d), _sites(spark, d), ["event_id"]).select("event_id", "site", *_r("error"))


@query("id_chunks", "WITH r AS (SELECT l_partkey, dense_rank() OVER (ORDER BY l_partkey) - 1 AS r FROM lineitem) SELECT CAST(r // 100 AS BIGINT) AS chunk, count(DISTINCT l_partkey) AS ids, count(*) AS n, min(l_partkey) AS first FROM r GROUP BY 1")
def id_chunks(spark, d):
    rows = tables.chunked(table(spark, d, "lineitem").select("l_partkey"), 100, "l_partkey")
    return rows.groupBy("chunk").agg(F.count_distinct("l_partkey").alias("ids"), F.count("*").alias("n"), F.min("l_partkey").alias("first"))


def _polygons(spark, d) -> DataFrame:
    """A region for each nation: shared borders, a notch, and a hole in every other one."""
    n = F.col("n_nationkey")
    x, y = -15.0 + 11.0 * (n % 5), 30.0 + 8.4 * F.floor(n / 5)
    outer = [(0.0, 0.0), (11.0, 0.0), (11.0, 8.4), (5.5, 6.0), (0.0, 8.4)]
    hole = [(3.0, 2.0), (5.0, 2.0), (5.0, 4.0), (3.0, 4.0)]
    corner = lambda ring, k, p: F.struct(F.lit(ring).alias("ring"), F.lit(k).alias("k"), (x + p[0]).alias("lon"), (y + p[1]).alias("lat"))
    rings = F.concat(F.array(*[corner(0, k, p) for k, p in enumerate(outer)]), F.when(n % 2 == 0, F.array(*[corner(1, k, p) for k, p in enumerate(hole)])).otherwise(F.array()))
    return table(spark, d, "nation").select(F.col("n_name").alias("designator"), F.explode(rings).alias("v")).select("designator", "v.*")


_RINGS = """base AS (SELECT n_name AS designator, n_nationkey AS n, -15e0 + 11e0 * (n_nationkey % 5) AS x, 30e0 + 8.4e0 * (n_nationkey // 5) AS y FROM nation),
pedges AS (SELECT designator, x + dx1 AS x1, y + dy1 AS y1, x + dx2 AS x2, y + dy2 AS y2 FROM base, (VALUES (0e0, 0e0, 11e0, 0e0, 0), (11e0, 0e0, 11e0, 8.4e0, 0), (11e0, 8.4e0, 5.5e0, 6e0, 0), (5.5e0, 6e0, 0e0, 8.4e0, 0), (0e0, 8.4e0, 0e0, 0e0, 0),
  (3e0, 2e0, 5e0, 2e0, 1), (5e0, 2e0, 5e0, 4e0, 1), (5e0, 4e0, 3e0, 4e0, 1), (3e0, 4e0, 3e0, 2e0, 1)) r(dx1, dy1, dx2, dy2, ring) WHERE ring = 0 OR n % 2 = 0)"""


def _located_sql(lon: str, lat: str, key: str, rows: str) -> str:
    hit = f"(y1 > {lat}) <> (y2 > {lat}) AND {lon} < (x2 - x1) * ({lat} - y1) / (y2 - y1) + x1"
    on = f"(x2 - x1) * ({lat} - y1) = (y2 - y1) * ({lon} - x1) AND {lon} BETWEEN least(x1, x2) AND greatest(x1, x2) AND {lat} BETWEEN least(y1, y2) AND greatest(y1, y2)"
    return f"SELECT {key}, designator FROM {rows}, pedges GROUP BY ALL HAVING count_if({hit}) % 2 = 1 AND count_if({on}) = 0"


@query("points_in_polygons", f"WITH {POINTS}, {_RINGS} {_located_sql('lon', 'lat', 'event_id', 'points')}")
def points_in_polygons(spark, d):
    return polygons.located(views.points(spark, d), _polygons(spark, d)).select("event_id", "designator")


@query("legs_in_polygons", f"WITH {POINTS}, {LEGS}, {_RINGS}, e AS (SELECT leg_id, from_lon AS lon, from_lat AS lat, 0 AS e FROM legs UNION ALL SELECT leg_id, to_lon, to_lat, 1 FROM legs), i AS ({_located_sql('lon', 'lat', 'leg_id, e', 'e')}) SELECT leg_id, designator, count(DISTINCT e) = 2 AS both FROM i GROUP BY ALL")
def legs_in_polygons(spark, d):
    return polygons.legs_by_polygon(views.legs(spark, d), _polygons(spark, d))


# ---------------------------------------------------------------- counts


def _lines_sql(lo: str, hi: str, low: int, steps: int) -> str:
    return f"list_transform(list_filter(range(0, {steps}), lambda k: least({lo}, {hi}) < {low}e0 + k * 5e0 AND {low}e0 + k * 5e0 < greatest({lo}, {hi})), lambda k: ({low}e0 + k * 5e0 - {lo}) / ({hi} - {lo}))"


_BOUNDS = ", ".join(f"{x}e0" for t in occupancy.TRENCHES for x in t)
_TRENCH = "CASE " + " ".join(f"WHEN alt >= {a}e0 AND alt < {b}e0 THEN {i}" for i, (a, b) in enumerate(occupancy.TRENCHES)) + " END"
_PIECES = f"""{POINTS}, {LEGS},
wl AS (SELECT *, to_time - from_time AS dur, unnest(range(CAST(floor(from_time / 3600) AS BIGINT), CAST(greatest(ceil(to_time / 3600) - 1, floor(from_time / 3600)) AS BIGINT) + 1)) AS k FROM legs WHERE to_time > from_time),
wt AS (SELECT *, k * 3600 AS window_start, (greatest(from_time, k * 3600e0) - from_time) / dur AS a, (least(to_time, k * 3600e0 + 3600) - from_time) / dur AS b FROM wl),
cr AS (SELECT *, list_sort(list_distinct(list_concat([a, b], list_filter(list_concat(list_concat({_lines_sql("from_lat", "to_lat", 30, 10)}, {_lines_sql("from_lon", "to_lon", -15, 12)}),
  list_transform(list_filter([{_BOUNDS}], lambda x: (x - from_alt) * (x - to_alt) < 0), lambda x: (x - from_alt) / (to_alt - from_alt))), lambda x: a < x AND x < b)))) AS taus FROM wt WHERE b > a),
px AS (SELECT *, unnest(range(1, len(taus))) AS i FROM cr),
pm AS (SELECT id, window_start, from_time, dur, taus[i] AS p0, taus[i + 1] AS p1, (taus[i] + taus[i + 1]) / 2 AS m, from_lat, to_lat, from_lon, to_lon, from_alt, to_alt FROM px),
pc AS (SELECT *, from_lat + m * (to_lat - from_lat) AS lat, from_lon + m * (to_lon - from_lon) AS lon, from_alt + m * (to_alt - from_alt) AS alt FROM pm),
pieces AS (SELECT id, window_start, {_TRENCH} AS trench, CAST(floor((lat - 30) / 5) AS INT) AS lat_idx, CAST(floor((lon + 15) / 5) AS INT) AS lon_idx, from_time + p0 * dur AS t0, from_time + p1 * dur AS t1
  FROM pc WHERE lat BETWEEN 30 AND 72 AND lon BETWEEN -15 AND 40 AND {_TRENCH} IS NOT NULL)"""
_CELL = "window_start, trench, lat_idx, lon_idx"


@query("occupancy_fraction", f"WITH {_PIECES} SELECT {_CELL}, round(sum(t1 - t0) / 3600, 5) AS weight FROM pieces GROUP BY ALL")
def occupancy_fraction(spark, d):
    return occupancy.fractional(views.legs(spark, d), GRID).select(*occupancy.CELL, *_r("weight", digits=5))


_PEAK = f"""{_PIECES},
un AS (SELECT *, coalesce(t0 > max(t1) OVER (PARTITION BY {_CELL}, id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM pieces),
ug AS (SELECT *, sum(new) OVER (PARTITION BY {_CELL}, id ORDER BY t0, t1 ROWS UNBOUNDED PRECEDING) AS g FROM un),
ui AS (SELECT {_CELL}, id, g, min(t0) AS t0, max(t1) AS t1 FROM ug GROUP BY ALL),
ev AS (SELECT {_CELL}, t0 AS t, 1 AS d FROM ui UNION ALL SELECT {_CELL}, t1, -1 FROM ui),
run AS (SELECT {_CELL}, sum(d) OVER (PARTITION BY {_CELL} ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS n FROM ev),
peak AS (SELECT {_CELL}, max(n)::BIGINT AS max_count FROM run GROUP BY ALL)"""


@query("peak_concurrency", f"WITH {_PEAK} SELECT * FROM peak")
def peak_concurrency(spark, d):
    return occupancy.peak(views.legs(spark, d), GRID)


@query("reaggregate", f"""WITH {_PEAK}, s AS (SELECT CAST(floor(window_start / 14400) AS BIGINT) * 14400 AS w, window_start, trench, CAST(floor((lat_idx + 0.5e0) * 5 / 10) AS INT) AS lat_idx, CAST(floor((lon_idx + 0.5e0) * 5 / 10) AS INT) AS lon_idx, sum(max_count) AS s FROM peak GROUP BY ALL)
SELECT w AS window_start, trench, lat_idx, lon_idx, max(s)::BIGINT AS max_count FROM s GROUP BY ALL""")
def reaggregate(spark, d):
    return occupancy.reaggregate(occupancy.peak(views.legs(spark, d), GRID), 14_400.0, 10.0, GRID)


@query("window_overlap_distinct", f"WITH {POINTS}, {LEGS}, w AS (SELECT 1704067200 + unnest(range(0, 30)) * 86400 AS s) SELECT s AS window_start, count(DISTINCT id) AS flights, count(*) AS n FROM w JOIN legs ON (from_time >= s AND from_time < s + 86400) OR (to_time > s AND to_time <= s + 86400) OR (from_time < s AND to_time > s + 86400) GROUP BY s")
def window_overlap_distinct(spark, d):
    return occupancy.window_flights(views.legs(spark, d), DAY, 1704067200, 30)


@query("dense_cells", f"WITH {_PEAK}, g AS (SELECT CAST(a AS INT) AS lat_idx, CAST(b AS INT) AS lon_idx FROM range(0, 9) x(a), range(0, 11) y(b)) SELECT g.lat_idx, g.lon_idx, coalesce(max_count, 0) AS max_count FROM g LEFT JOIN peak p ON p.lat_idx = g.lat_idx AND p.lon_idx = g.lon_idx AND window_start = 1705276800 AND trench = 1")
def dense_cells(spark, d):
    return occupancy.dense_grid(occupancy.peak(views.legs(spark, d), GRID), 1705276800, 1, GRID)


# ---------------------------------------------------------------- airspace


def _inside_sql(lon: str, lat: str) -> str:
    terms = [f"((({y1}e0 > {lat}) <> ({y2}e0 > {lat})) AND {lon} < ({lat} - ({y1}e0)) * {(x2 - x1) / (y2 - y1)!r}::DOUBLE + ({x1}e0))::INT" for (x1, y1), (x2, y2) in zip(REGION, REGION[1:] + REGION[:1], strict=True) if y1 != y2]
    return f"(({' + '.join(terms)}) % 2 = 1)"


_FROM_IN, _TO_IN = _inside_sql("from_lon", "from_lat"), _inside_sql("to_lon", "to_lat")


@query("polygon_filter_any", f"WITH {POINTS}, {LEGS} SELECT leg_id, id FROM legs WHERE {_FROM_IN} OR {_TO_IN}")
def polygon_filter_any(spark, d):
    return airspace.touching(views.legs(spark, d), REGION).select("leg_id", "id")


@query("polygon_filter_all", f"WITH {POINTS}, {LEGS} SELECT leg_id, id FROM legs WHERE {_FROM_IN} AND {_TO_IN}")
def polygon_filter_all(spark, d):
    return airspace.within(views.legs(spark, d), REGION).select("leg_id", "id")


@query("sites_inside", f"WITH {_SITES} SELECT site FROM sites WHERE {_inside_sql('site_lon', 'site_lat')}")
def sites_inside(spark, d):
    return airspace.points_inside(_sites(spark, d), REGION, "site_lat", "site_lon").select("site")


_EDGES = ", ".join(f"({x1}e0, {y1}e0, {x2}e0, {y2}e0)" for (x1, y1), (x2, y2) in zip(REGION, REGION[1:] + REGION[:1], strict=True))


@query("entry_exit_points", f"""WITH {POINTS}, {LEGS}, e(x1, y1, x2, y2) AS (VALUES {_EDGES}),
m AS (SELECT leg_id, id, from_lon, from_lat, to_lon - from_lon AS dx, to_lat - from_lat AS dy, {_FROM_IN} AS inside, x1, y1, x2 - x1 AS ex, y2 - y1 AS ey FROM legs, e),
tu AS (SELECT *, ((x1 - from_lon) * ey - (y1 - from_lat) * ex) / (dx * ey - dy * ex) AS t, ((x1 - from_lon) * dy - (y1 - from_lat) * dx) / (dx * ey - dy * ex) AS u FROM m WHERE dx * ey - dy * ex <> 0),
h AS (SELECT leg_id, id, from_lon, from_lat, dx, dy, inside, min(t) AS t0, max(t) AS t1, count(DISTINCT t) AS n FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 GROUP BY ALL),
k AS (SELECT *, 'exit' AS kind, t1 AS t FROM h WHERE inside OR n > 1 UNION ALL SELECT *, 'entry', t0 FROM h WHERE NOT inside OR n > 1)
SELECT leg_id, kind, round(from_lon + t * dx, 6) AS lon, round(from_lat + t * dy, 6) AS lat FROM k""")
def entry_exit_points(spark, d):
    return airspace.boundary_points(views.legs(spark, d), REGION).select("leg_id", "kind", *_r("lon", "lat"))


@query("time_in_area", f"WITH {POINTS}, {LEGS} SELECT id, round(max(from_time) - min(from_time), 3) AS seconds FROM legs WHERE {_FROM_IN} OR {_TO_IN} GROUP BY id HAVING max(from_time) - min(from_time) >= 300")
def time_in_area(spark, d):
    return airspace.time_inside(views.legs(spark, d), REGION).select("id", *_r("seconds", digits=3))


_CONFLICTS = f"""{POINTS}, {LEGS}, pr AS (SELECT a.leg_id AS leg_a, b.leg_id AS leg_b, a.from_time AS at_, a.to_time AS au, b.from_time AS bt, b.to_time AS bu, a.from_lon AS ax, a.from_lat AS ay, b.from_lon AS bx, b.from_lat AS by_,
  a.to_lon - a.from_lon AS dx, a.to_lat - a.from_lat AS dy, b.to_lon - b.from_lon AS ex, b.to_lat - b.from_lat AS ey
  FROM legs a JOIN legs b ON a.leg_id < b.leg_id AND a.id <> b.id AND a.from_time <= b.to_time + 600 AND b.from_time <= a.to_time + 600 AND abs(a.from_alt - b.from_alt) <= 1000),
tu AS (SELECT *, ((bx - ax) * ey - (by_ - ay) * ex) / (dx * ey - dy * ex) AS t, ((bx - ax) * dy - (by_ - ay) * dx) / (dx * ey - dy * ex) AS u FROM pr WHERE abs(dx * ey - dy * ex) > 1e-9),
cf AS (SELECT leg_a, leg_b, ax + t * dx AS lon, ay + t * dy AS lat, at_ + t * (au - at_) AS t1, bt + u * (bu - bt) AS t2 FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1 AND abs(at_ + t * (au - at_) - bt - u * (bu - bt)) <= 600)"""


def _conflicts(spark, d) -> DataFrame:
    return airspace.conflicts(views.legs(spark, d), cell=2.5, slot_s=3600.0, time_s=600.0)


@query("conflict_pairs", f"WITH {_CONFLICTS} SELECT leg_a, leg_b, {_rs('lon', 'lat', digits=9)}, {_rs('t1', 't2', digits=3)} FROM cf")
def conflict_pairs(spark, d):
    return _conflicts(spark, d).select("leg_a", "leg_b", *_r("lon", "lat", digits=9), *_r("t1", "t2", digits=3))


@query("conflict_gaps", f"WITH {_CONFLICTS} SELECT leg_a, leg_b, round(t1 - lag(t1) OVER w, 3) AS since, round({views.haversine('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 4) AS km FROM cf WINDOW w AS (PARTITION BY floor(t1 / 86400) ORDER BY t1, leg_a, leg_b)")
def conflict_gaps(spark, d):
    c = _conflicts(spark, d).withColumn("day", F.floor(F.col("t1") / DAY))
    return airspace.near_misses(c, ["day"]).select("leg_a", "leg_b", *_r("since", digits=3), *_r("km", digits=4))


# ---------------------------------------------------------------- schedules


def _schedule(spark, d) -> DataFrame:
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")  # noqa: E741
    code = lambda c: (c % 30).cast("string")
    none = F.lit(None)
    arrivals = o.select(
        F.col("o_orderkey").alias("flight_key"), F.concat(F.lit("A"), "o_orderkey").alias("iata_number"), F.substring("o_orderpriority", 1, 1).alias("airline_iata"),
        F.when(F.col("o_orderstatus") == "F", F.lit("X")).alias("codeshare_iata"), code(F.col("o_custkey")).alias("departure_airport"), code(F.col("o_orderkey")).alias("arrival_airport"),
        none.cast("timestamp_ntz").alias("scheduled_departure"), F.col("o_orderdate").alias("scheduled_arrival"),
    )
    departures = l.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("flight_key"), F.concat(F.lit("D"), "l_orderkey").alias("iata_number"), F.col("l_returnflag").alias("airline_iata"),
        F.when(F.col("l_linestatus") == "F", F.lit("Y")).alias("codeshare_iata"), code(F.col("l_suppkey")).alias("departure_airport"), code(F.col("l_partkey")).alias("arrival_airport"),
        F.col("l_shipdate").alias("scheduled_departure"), none.cast("timestamp_ntz").alias("scheduled_arrival"),
    )
    return linkage.union_schedule(arrivals, departures)


_SCHEDULE = """sched AS (
  SELECT o_orderkey AS flight_key, 'A' || o_orderkey AS iata_number, substr(o_orderpriority, 1, 1) AS airline_iata, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'X' END, substr(o_orderpriority, 1, 1)) AS codeshare_iata,
    (o_custkey % 30)::VARCHAR AS departure_airport, (o_orderkey % 30)::VARCHAR AS arrival_airport, NULL::TIMESTAMP AS scheduled_departure, o_orderdate::TIMESTAMP AS scheduled_arrival, 'arrival' AS type, o_orderdate::TIMESTAMP AS time, (o_orderkey % 30)::VARCHAR AS airport FROM orders
  UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'D' || l_orderkey, l_returnflag, coalesce(CASE WHEN l_linestatus = 'F' THEN 'Y' END, l_returnflag), (l_suppkey % 30)::VARCHAR, (l_partkey % 30)::VARCHAR, l_shipdate::TIMESTAMP, NULL, 'departure', l_shipdate::TIMESTAMP, (l_suppkey % 30)::VARCHAR FROM lineitem)"""


@query("schedule_union", f"WITH {_SCHEDULE} SELECT type, airport, codeshare_iata, count(*) AS n, min(time) AS first, max(time) AS last FROM sched GROUP BY ALL")
def schedule_union(spark, d):
    return _schedule(spark, d).groupBy("type", "airport", "codeshare_iata").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last"))


def _airlines(spark, d) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(F.when(F.col("n_nationkey") % 7 != 3, F.element_at(F.array(*[F.lit(x) for x in "ANRFOP"]), (F.col("n_nationkey") % 6 + 1).cast("int"))).alias("iata"), F.when(F.col("n_nationkey") % 5 != 4, F.upper(F.substring("n_name", 1, 3))).alias("icao"), F.col("n_nationkey").alias("no"))


@query("airline_codes", f"WITH {_SCHEDULE}, al AS (SELECT n_nationkey AS no, CASE WHEN n_nationkey % 7 <> 3 THEN substr('ANRFOP', n_nationkey % 6 + 1, 1) END AS iata, CASE WHEN n_nationkey % 5 <> 4 THEN upper(substr(n_name, 1, 3)) END AS icao FROM nation), dim AS (SELECT lower(iata) AS code, arg_max(icao, no) AS airline_icao FROM al WHERE iata IS NOT NULL AND icao IS NOT NULL GROUP BY 1) SELECT flight_key, type, airline_icao, airline_icao || substr(iata_number, 3) AS callsign FROM sched LEFT JOIN dim ON code = lower(airline_iata)")
def airline_codes(spark, d):
    rows = _schedule(spark, d).withColumn("airline_iata", F.lower("airline_iata"))
    return linkage.airline_codes(rows, _airlines(spark, d), "no").select("flight_key", "type", "airline_icao", "callsign")


_AL = "al AS (SELECT n_nationkey AS no, CASE WHEN n_nationkey % 7 <> 3 THEN substr('ANRFOP', n_nationkey % 6 + 1, 1) END AS iata, CASE WHEN n_nationkey % 5 <> 4 THEN upper(substr(n_name, 1, 3)) END AS icao FROM nation), dim AS (SELECT lower(iata) AS code, arg_max(icao, no) AS airline_icao FROM al WHERE iata IS NOT NULL AND icao IS NOT NULL GROUP BY 1)"


@query("schedule_tails", f"""WITH {_SCHEDULE}, {_AL}, c AS (SELECT flight_key, type, airline_icao || substr(iata_number, 3) AS callsign FROM sched LEFT JOIN dim ON code = lower(airline_iata)),
seen AS (SELECT lower(upper(substr(n_name, 1, 3)) || user_id) AS callsign, 'a' || (event_id % 7) AS icao24, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS file, event_id FROM events JOIN nation ON n_nationkey = event_id % 25),
f AS (SELECT callsign, file, arg_min(icao24, event_id) AS icao24 FROM seen GROUP BY ALL), t AS (SELECT callsign AS k, arg_max(icao24, file) AS icao24 FROM f GROUP BY 1) SELECT flight_key, type, callsign, icao24 FROM c LEFT JOIN t ON k = lower(callsign)""")
def schedule_tails(spark, d):
    nation = table(spark, d, "nation").select((F.col("n_nationkey").cast("long")).alias("k"), F.upper(F.substring("n_name", 1, 3)).alias("icao"))
    e = table(spark, d, "events").withColumn("k", F.col("event_id") % 25).join(nation, "k")
    seen = e.select(F.concat(F.lit(" "), "icao", "user_id", F.lit(" ")).alias("callsign"), F.concat(F.lit("a"), (F.col("event_id") % 7)).alias("icao24"), F.floor(views.seconds(F.col("ts")) / DAY).alias("file"), F.col("event_id").alias("row"))
    return linkage.with_tails(_schedule(spark, d), _airlines(spark, d), seen, "no").select("flight_key", "type", "callsign", "icao24")


@query("schedule_first", f"WITH {_SCHEDULE} SELECT flight_key, type, time, airport, iata_number FROM sched ORDER BY time NULLS LAST, airport NULLS LAST, iata_number NULLS LAST, flight_key LIMIT 500")
def schedule_first(spark, d):
    # the report's first page; ties in flight number go by key
    return linkage.ordered_schedule(_schedule(spark, d)).select("flight_key", "type", "time", "airport", "iata_number").orderBy(*[F.col(c).asc_nulls_last() for c in ("time", "airport", "iata_number", "flight_key")]).limit(500)


@query("schedule_hours", f"WITH {_SCHEDULE}, e AS (SELECT epoch(date_trunc('hour', min(time)))::BIGINT AS a, epoch(date_trunc('hour', max(time)))::BIGINT AS b FROM sched) SELECT unnest(range(a, b + 6 * 3600, 3600)) AS hour FROM e")
def schedule_hours(spark, d):
    return linkage.schedule_hours(_schedule(spark, d))


@query("codes_in_use", f"WITH {_SCHEDULE} SELECT departure_airport AS code FROM sched UNION SELECT arrival_airport FROM sched")
def codes_in_use(spark, d):
    return linkage.codes_in_use(_schedule(spark, d))


@query("haul_type", f"WITH {_SCHEDULE}, {_SITES}, j AS (SELECT s.type, a.site_no AS x, b.site_no AS y, {views.haversine('a.site_lat', 'a.site_lon', 'b.site_lat', 'b.site_lon')} AS km FROM sched s LEFT JOIN sites a ON a.site_no::VARCHAR = s.departure_airport LEFT JOIN sites b ON b.site_no::VARCHAR = s.arrival_airport), h AS (SELECT type, CASE WHEN x IS NULL OR y IS NULL THEN -1e0 ELSE km END AS distance FROM j) SELECT type, CASE WHEN distance < 1500 THEN 'short_haul' WHEN distance < 4000 THEN 'medium_haul' ELSE 'long_haul' END AS haul_type, round(distance, 4) AS distance, count(*) AS n FROM h GROUP BY ALL")
def haul_type(spark, d):
    airports = _sites(spark, d).select(F.col("site_no").cast("string").alias("iata"), F.col("site_lat").alias("lat"), F.col("site_lon").alias("lon"))
    return linkage.with_haul(_schedule(spark, d), airports).groupBy("type", "haul_type", F.round("distance", 4).alias("distance")).agg(F.count("*").alias("n"))


_KEY = "codeshare_iata || '_' || departure_airport || '_' || arrival_airport || '_' || coalesce(strftime(scheduled_departure, '%Y-%m-%d %H:%M:%S'), 'nan') || '_' || coalesce(strftime(scheduled_arrival, '%Y-%m-%d %H:%M:%S'), 'nan')"


@query("codeshare_collapse", f"WITH {_SCHEDULE} SELECT flight_key, type, airport, codeshare_iata FROM sched QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY time, airport, iata_number, type, flight_key, airline_iata) = 1")
def codeshare_collapse(spark, d):
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    key = linkage.codeshare_key(F.col("codeshare_iata"), F.col("departure_airport"), F.col("arrival_airport"), text("scheduled_departure"), text("scheduled_arrival"))
    out = linkage.collapse_codeshares(_schedule(spark, d), key, ["time", "airport", "iata_number", "type", "flight_key", "airline_iata"])
    return out.select("flight_key", "type", "airport", "codeshare_iata")


def _movements(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").withColumn("t", views.seconds(F.col("ts")))
    keys = [(F.col("user_id") % 10).alias("airport"), (F.col("user_id") % 3).alias("airline")]
    side = lambda kind, p: e.filter(F.col("event_type") == kind).select(*keys, F.col("event_id").alias(f"{p}_key"), F.col("t").alias(f"{p}_t"), (F.col("value") > 245).alias(f"{p}_long"))
    return side("view", "a"), side("click", "d")


def _scores(spark, d) -> DataFrame:
    a, dep = _movements(spark, d)
    return linkage.connection_scores(linkage.connection_candidates(a, dep, ["airport", "airline"]))


import math as _math  # noqa: E402

_WAIT = "CASE " + " ".join(
    f"WHEN a_long = {str(a).lower()} AND d_long = {str(b).lower()} AND hours > {w.loc}e0 THEN {_math.log(w.weight) - _math.log(w.scale)!r}::DOUBLE - lgamma({w.shape}e0) + ({w.shape}e0 - 1) * ln((hours - {w.loc}e0) / {w.scale}e0) - (hours - {w.loc}e0) / {w.scale}e0"
    for (a, b), w in scalars.WAITS.items()
) + " END"
_SCORES = f"""m AS (SELECT *, user_id % 10 AS airport, user_id % 3 AS airline, epoch_us(ts) / 1e6 AS t, value > 245 AS long FROM events),
cand AS (SELECT a.airport, a.airline, a.event_id AS a_key, d.event_id AS d_key, floor((d.t - a.t) / 3600) AS hours, a.long AS a_long, d.long AS d_long FROM m a JOIN m d ON a.airport = d.airport AND a.airline = d.airline AND a.event_type = 'view' AND d.event_type = 'click' AND d.t > a.t AND d.t < a.t + 28800),
scores AS (SELECT *, {_WAIT} AS score FROM cand WHERE hours > 0 AND hours < 8)"""


@query("connection_score", f"WITH {_SCORES} SELECT airport, airline, a_key, d_key, CAST(hours AS BIGINT) AS hours, round(score, 6) AS score FROM scores WHERE score IS NOT NULL")
def connection_score(spark, d):
    return _scores(spark, d).select("airport", "airline", "a_key", "d_key", "hours", *_r("score"))


@query("assignment")
def assignment(spark, d):
    return linkage.assign_by_time(*_movements(spark, d), ["airport", "airline"])


@query("likeliest_connections", f"""WITH {_SCORES}, best AS (SELECT a_key, d_key FROM scores WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY a_key ORDER BY round(score, 9) DESC, d_key) = 1)
SELECT a.event_id AS a_key, coalesce(d.event_id, -1) AS d_key, round((d.t - a.t) / 3600, 6) AS connection_time FROM m a LEFT JOIN best ON a_key = a.event_id LEFT JOIN m d ON d.event_id = d_key WHERE a.event_type = 'view'""")
def likeliest_connections(spark, d):
    # each arrival's likeliest departure, whoever else takes it; -1 if it has none
    a, dep = _movements(spark, d)
    best = linkage.likeliest(_scores(spark, d).withColumn("score", F.round("score", 9)))
    return linkage.connection_times(a, best, dep).select("a_key", F.coalesce("d_key", F.lit(-1)).alias("d_key"), *_r("connection_time"))


@query("connection_times")
def connection_times(spark, d):
    a, dep = _movements(spark, d)
    return linkage.connection_times(a, assignment(spark, d), dep).select("a_key", "d_key", "connection_time")


@query("tail_match", "WITH s AS (SELECT lower(trim(' F' || user_id || ' ')) AS callsign, 'a' || (event_id % 7) AS icao24, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS file, event_id FROM events), f AS (SELECT callsign, file, arg_min(icao24, event_id) AS icao24 FROM s WHERE callsign IN (SELECT 'f' || c_custkey FROM customer) GROUP BY ALL) SELECT callsign, arg_max(icao24, file) AS icao24 FROM f GROUP BY callsign")
def tail_match(spark, d):
    e = table(spark, d, "events")
    seen = e.select(F.concat(F.lit(" F"), "user_id", F.lit(" ")).alias("callsign"), F.concat(F.lit("a"), (F.col("event_id") % 7)).alias("icao24"), F.floor(views.seconds(F.col("ts")) / DAY).alias("file"), F.col("event_id").alias("row"))
    return linkage.tails(seen, table(spark, d, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("callsign")))


@query("od_pairs", f"WITH {_SCHEDULE} SELECT DISTINCT a.n_name AS from_name, b.n_name AS to_name FROM sched s LEFT JOIN nation a ON a.n_nationkey::VARCHAR = s.departure_airport LEFT JOIN nation b ON b.n_nationkey::VARCHAR = s.arrival_airport")
def od_pairs(spark, d):
    dim = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("code"), F.col("n_name").alias("name"))
    return linkage.od_pairs(_schedule(spark, d), "departure_airport", "arrival_airport", dim)


@query("hour_hist", "SELECT CAST(floor((hour(ts) * 60 + minute(ts)) * 48 / 1440) AS INT) AS bin, count(*) AS n FROM events GROUP BY 1")
def hour_hist(spark, d):
    return linkage.hour_histogram(table(spark, d, "events"), F.col("ts"), 48)


@query("speed_stats", f"WITH {POINTS}, {LEGS} SELECT id, round(avg(speed), 7) AS mean, round(stddev_samp(speed), 7) AS std_sample, round(stddev_pop(speed), 7) AS std_population, round(regr_slope(from_alt, from_time), 9) AS slope FROM legs GROUP BY id")
def speed_stats(spark, d):
    return trajectory.leg_stats(views.legs(spark, d)).select("id", *_r("mean", "std_sample", "std_population", digits=7), *_r("slope", digits=9))


# ---------------------------------------------------------------- flows


def _unit_sql(p: str, e: str) -> str:
    lat, lon = f"radians({p}{e}_lat)", f"radians({p}{e}_lon)"
    return f"cos({lat}) * cos({lon}) AS {p}{e}x, cos({lat}) * sin({lon}) AS {p}{e}y, sin({lat}) AS {p}{e}z"


def _norm_sql(u: str, v: str) -> str:
    return f"sqrt(pow({v}x - {u}x, 2) + pow({v}y - {u}y, 2) + pow({v}z - {u}z, 2))"


def _dot_sql(u: str, v: str, own: str) -> str:
    return f"abs(({v}x - {u}x) * {own}x + ({v}y - {u}y) * {own}y + ({v}z - {u}z) * {own}z)"


_CORNERS = [("a_from", "a_to"), ("a_from", "b_from"), ("a_from", "b_to"), ("a_to", "b_from"), ("a_to", "b_to"), ("b_from", "b_to")]


def _seg_sql(px: str, py: str, s: str) -> str:
    ax, ay, bx, by = f"{s}from_la", f"{s}from_lo", f"{s}to_la", f"{s}to_lo"
    t = f"least(greatest(coalesce((({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / nullif(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2), 0), 0e0), 0e0), 1e0)"
    return f"sqrt(pow({px} - {ax} - {t} * ({bx} - {ax}), 2) + pow({py} - {ay} - {t} * ({by} - {ay}), 2))"


def _left_sql(p: str, q: str, r: str) -> str:
    return f"(({q}_la - {p}_la) * ({r}_lo - {p}_lo) - ({q}_lo - {p}_lo) * ({r}_la - {p}_la) > 0)"


def _tdf_sql(x: str) -> str:
    return f"CASE WHEN {x} <= 0.1e0 THEN 1e0 ELSE exp(-15e0 * ({x} - 0.1e0)) END"


def _similarity_sql(pairs: str) -> str:
    """CTEs after one named ``pairs`` with a_ and b_ ends; the last is ``sims``."""
    ends = [f"{p}{e}" for p in ("a_", "b_") for e in ("from", "to")]
    rad = ", ".join(f"radians({e}_lat) AS {e}_la, radians({e}_lon) AS {e}_lo" for e in ends)
    units = ", ".join(_unit_sql(p, e) for p in ("a_", "b_") for e in ("from", "to"))
    cross = ", ".join(f"{p}fromy * {p}toz - {p}fromz * {p}toy AS {p}nx, {p}fromz * {p}tox - {p}fromx * {p}toz AS {p}ny, {p}fromx * {p}toy - {p}fromy * {p}tox AS {p}nz" for p in ("a_", "b_"))
    longest = f"greatest({', '.join(_norm_sql(u, v) for u, v in _CORNERS)})"
    pick = "CASE " + " ".join(f"WHEN {_norm_sql(u, v)} = longest THEN {_dot_sql(u, v, 'own')}" for u, v in _CORNERS) + " END"
    hit = f"{_left_sql('a_from', 'b_from', 'b_to')} <> {_left_sql('a_to', 'b_from', 'b_to')} AND {_left_sql('a_from', 'a_to', 'b_from')} <> {_left_sql('a_from', 'a_to', 'b_to')}"
    apart = f"least({_seg_sql('a_from_la', 'a_from_lo', 'b_')}, {_seg_sql('a_to_la', 'a_to_lo', 'b_')}, {_seg_sql('b_from_la', 'b_from_lo', 'a_')}, {_seg_sql('b_to_la', 'b_to_lo', 'a_')})"
    size = lambda p: f"sqrt(pow({p}from_la - {p}to_la, 2) + pow({p}from_lo - {p}to_lo, 2))"
    return f"""{pairs}, u1 AS (SELECT *, {rad}, {units} FROM pairs), u2 AS (SELECT *, {cross}, a_tox - a_fromx AS ownx, a_toy - a_fromy AS owny, a_toz - a_fromz AS ownz, {longest} AS longest FROM u1),
u3 AS (SELECT *, (a_nx * b_nx + a_ny * b_ny + a_nz * b_nz) / nullif(sqrt(a_nx * a_nx + a_ny * a_ny + a_nz * a_nz) * sqrt(b_nx * b_nx + b_ny * b_ny + b_nz * b_nz), 0) AS cosine,
  {pick} / nullif(sqrt(ownx * ownx + owny * owny + ownz * ownz), 0) / nullif({_norm_sql("a_from", "a_to")} + {_norm_sql("b_from", "b_to")}, 0) AS overlap, CASE WHEN {hit} THEN 0e0 ELSE {apart} END AS separation FROM u2),
sims AS (SELECT *, CASE WHEN cosine > 0 AND {size("a_")} >= 1e-6 AND {size("b_")} >= 1e-6 THEN (({_tdf_sql("1 - abs(cosine)")}) + ({_tdf_sql("1 - abs(cosine)")}) * ({_tdf_sql("overlap")}) + ({_tdf_sql("1 - abs(cosine)")}) * ({_tdf_sql("separation")})) / 3 ELSE 0e0 END AS similarity FROM u3)"""


_SIMS = _similarity_sql(f"{POINTS}, {LEGS}, pairs AS (SELECT a.id, a.leg_id AS a, b.leg_id AS b, {', '.join(f'{p}.{e}_{c} AS {p}_{e}_{c}' for p in 'ab' for e in ('from', 'to') for c in ('lat', 'lon'))} FROM legs a JOIN legs b ON a.id = b.id AND a.leg_id < b.leg_id)")


@query("seg_similarity", f"WITH {_SIMS} SELECT a, b, round(overlap, 6) AS overlap, round(separation, 6) AS separation, round(similarity, 6) AS similarity FROM sims")
def seg_similarity(spark, d):
    s = flows.similarity(views.legs(spark, d), group=["id"])
    return s.select(F.col("a_leg_id").alias("a"), F.col("b_leg_id").alias("b"), *_r("overlap", "separation", "similarity"))


#: The legs that start in one hour, across flights, as the hour's file of segments.
_HOUR_SIMS = _similarity_sql(f"{POINTS}, {LEGS}, hourly AS (SELECT *, CAST(floor(from_time / 3600) AS BIGINT) AS hour FROM legs), pairs AS (SELECT a.hour, a.leg_id AS a, b.leg_id AS b, {', '.join(f'{p}.{e}_{c} AS {p}_{e}_{c}' for p in 'ab' for e in ('from', 'to') for c in ('lat', 'lon'))} FROM hourly a JOIN hourly b ON a.hour = b.hour AND a.leg_id < b.leg_id)")


def _hourly(spark, d) -> DataFrame:
    return views.legs(spark, d).select("*", F.floor(F.col("from_time") / 3600).cast("long").alias("grp"))


def _sims(spark, d) -> DataFrame:
    s = flows.similarity(_hourly(spark, d), group=["grp"])
    return s.select("grp", F.col("a_leg_id").alias("a"), F.col("b_leg_id").alias("b"), "overlap", "separation", "similarity")


@query("flow_similarity", f"WITH {_HOUR_SIMS} SELECT a, b, round(overlap, 6) AS overlap, round(separation, 6) AS separation, round(similarity, 6) AS similarity FROM sims")
def flow_similarity(spark, d):
    return _sims(spark, d).select("a", "b", *_r("overlap", "separation", "similarity"))


_PARTS = ", ".join(f"({j}, {y1}e0, {x1}e0, {y2}e0, {x2}e0)" for j, ((x1, y1), (x2, y2)) in enumerate(zip(LINE, LINE[1:], strict=False)))


@query("polyline_similarity", f"WITH {_similarity_sql(f'{POINTS}, {LEGS}, line(part, b_from_lat, b_from_lon, b_to_lat, b_to_lon) AS (VALUES {_PARTS}), pairs AS (SELECT leg_id, part, from_lat AS a_from_lat, from_lon AS a_from_lon, to_lat AS a_to_lat, to_lon AS a_to_lon, b_from_lat, b_from_lon, b_to_lat, b_to_lon FROM legs, line)')} SELECT leg_id, part, round(similarity, 6) AS similarity FROM sims QUALIFY max((similarity <> 0)::INT) OVER (PARTITION BY leg_id) = 1")
def polyline_similarity(spark, d):
    s = flows.polyline_similarity(views.legs(spark, d), LINE)
    kept = Window.partitionBy("a_leg_id")
    s = s.withColumn("any", F.max((F.col("similarity") != 0).cast("int")).over(kept)).filter("any = 1")
    return s.select(F.col("a_leg_id").alias("leg_id"), "part", *_r("similarity"))


_NEAR = " OR ".join(f"sqrt(pow({x}e0 - {lon}, 2) + pow({y}e0 - {lat}, 2)) <= 3" for x, y in LINE for lon, lat in (("from_lon", "from_lat"), ("to_lon", "to_lat")))


@query("flight_length", f"WITH {POINTS}, s AS (SELECT event_id, coalesce(sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)), 0e0) AS step, id, t FROM points WINDOW w AS (PARTITION BY id ORDER BY t)) SELECT id, count(*) AS n, round(sum(step), 5) AS length FROM s GROUP BY id")
def flight_length(spark, d):
    rows = flows.along(views.points(spark, d), ["id"], "t")
    return rows.groupBy("id").agg(F.count("*").alias("n"), F.round(F.max("along"), 5).alias("length"))


@query("eps_neighbours", f"WITH {POINTS}, {LEGS} SELECT leg_id, id FROM legs WHERE ({_NEAR}) AND sqrt(pow(from_lat - to_lat, 2) + pow(from_lon - to_lon, 2)) >= 5")
def eps_neighbours(spark, d):
    return flows.long_enough(flows.near_polyline(views.legs(spark, d), LINE, 3.0), 5.0).select("leg_id", "id")


def _flown_legs(spark, d) -> DataFrame:
    return views.legs(spark, d).withColumn("grp", F.col("id").cast("long"))


@query("base_graph_edges", f"WITH {_HOUR_SIMS}, hs AS (SELECT hour AS grp, a, b, similarity FROM sims), {stepwise_sql.base_graphs('hs')} SELECT grp, graph, round(threshold, 6) AS threshold, a, b FROM based")
def base_graph_edges(spark, d):
    return networks.leg_base_graphs(_hourly(spark, d)).select("grp", "graph", *_r("threshold"), "a", "b")


@query("spectral")
def spectral(spark, d):
    return spectra.leg_embedding(_hourly(spark, d))


@query("spectral_clusters")
def spectral_clusters(spark, d):
    return spectra.clusters(flows.similar(_flown_legs(spark, d), group=["grp"]), once=True)


@query("dbscan")
def dbscan(spark, d):
    # the spectral coordinates of each hour's legs; two legs alone have one
    e = spectra.leg_embedding(_hourly(spark, d)).select("grp", F.col("node").alias("id"), F.slice(F.concat("coords", F.array(F.lit(0.0))), 1, 2).alias("x"))
    return flows.dbscan(e, 0.02, 4, 2, group=["grp"])


#: In degrees; no two points are at just this distance, as they lie on hundredths.
_DENSE = 5.005


@query("density_clusters", f"""WITH RECURSIVE {POINTS}, p AS (SELECT event_id AS id, floor(t / 3600) AS grp, lat, lon FROM points),
near AS (SELECT x.id AS p, y.id AS q FROM p x JOIN p y ON x.grp = y.grp AND sqrt(pow(x.lat - y.lat, 2) + pow(x.lon - y.lon, 2)) <= {_DENSE}),
core AS (SELECT p AS id FROM near GROUP BY p HAVING count(*) >= 4), links AS (SELECT p, q FROM near WHERE p IN (FROM core) AND q IN (FROM core)),
met AS (SELECT id, id AS seen FROM core UNION SELECT met.id, q FROM met JOIN links ON p = seen), named AS (SELECT id, min(seen) AS cluster FROM met GROUP BY id),
edge AS (SELECT q AS id, min(p) AS p FROM near WHERE p IN (FROM core) AND q NOT IN (FROM core) GROUP BY q)
SELECT p.id, coalesce(a.cluster, b.cluster, -1) AS cluster FROM p LEFT JOIN named a ON a.id = p.id LEFT JOIN edge ON edge.id = p.id LEFT JOIN named b ON b.id = edge.p""")
def density_clusters(spark, d):
    # where the points of an hour crowd
    rows = views.points(spark, d).select(F.col("event_id").alias("id"), F.floor(F.col("t") / 3600).alias("grp"), F.array("lat", "lon").alias("x"))
    return flows.dbscan(rows, _DENSE, 4, 2, group=["grp"])


def _weighted(legs: DataFrame) -> DataFrame:
    return flows.similar(legs, 0.5, group=["grp"]).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("similarity").alias("w"))


def _quality(legs: DataFrame) -> DataFrame:
    # legs are compared inside their community, so that tasks add up and no pair is joined; a leg that comes twice needs the joins, as it has two homes
    homes = legs.select(F.col("leg_id").alias("node"), "community")
    if homes.groupBy("node").count().filter("count > 1").isEmpty():
        edges = flows.similar_sums(legs, 0.5, ["grp", "community"]).select("community", "w")
    else:
        edges = _weighted(legs)
    return graph.cpm_quality(edges, homes, 0.7).select("community", *_r("quality", digits=4))


@query("communities")
def communities(spark, d):
    return networks.leg_communities(_hourly(spark, d), 0.5, 0.5)


@query("cpm_quality", f"WITH {_SIMS}, e AS (SELECT a AS u, b AS v, similarity AS w FROM sims WHERE similarity > 0.5), n AS (SELECT leg_id AS node, id % 40 AS community FROM legs), i AS (SELECT x.community, sum(w) AS w FROM e JOIN n x ON x.node = u JOIN n y ON y.node = v WHERE x.community = y.community GROUP BY 1) SELECT n.community, round(coalesce(any_value(i.w), 0) - 0.7e0 * count(*) * (count(*) - 1) / 2e0, 4) AS quality FROM n LEFT JOIN i ON i.community = n.community GROUP BY n.community")
def cpm_quality(spark, d):
    return _quality(_flown_legs(spark, d).withColumn("community", F.col("id") % 40))


@query("flow_quality", f"WITH {_HOUR_SIMS}, e AS (SELECT a AS u, b AS v, similarity AS w FROM sims WHERE similarity > 0.5), n AS (SELECT leg_id AS node, hour AS community FROM hourly), i AS (SELECT x.community, sum(w) AS w FROM e JOIN n x ON x.node = u JOIN n y ON y.node = v WHERE x.community = y.community GROUP BY 1) SELECT n.community, round(coalesce(any_value(i.w), 0) - 0.7e0 * count(*) * (count(*) - 1) / 2e0, 4) AS quality FROM n LEFT JOIN i ON i.community = n.community GROUP BY n.community")
def flow_quality(spark, d):
    return _quality(_hourly(spark, d).withColumn("community", F.floor(F.col("from_time") / 3600).cast("long")))


@query("components", f"WITH RECURSIVE {_SIMS}, e AS (SELECT a, b FROM sims WHERE similarity > 0.6 UNION SELECT b, a FROM sims WHERE similarity > 0.6), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS label FROM r GROUP BY node")
def components(spark, d):
    return graph.components(flows.similar(_flown_legs(spark, d), 0.6, group=["grp"], thin=graph.joining_rows).select("a", "b"))


@query("flow_components", f"WITH RECURSIVE {_HOUR_SIMS}, e AS (SELECT a, b FROM sims WHERE similarity > 0.6 UNION SELECT b, a FROM sims WHERE similarity > 0.6), r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen) SELECT node, min(seen) AS label FROM r GROUP BY node")
def flow_components(spark, d):
    return flows.leg_parts(_hourly(spark, d), 0.6, group=["grp"])


#: Items of an order point at two of its items, by part and by supplier.
_ARCS = "o AS (SELECT *, l_orderkey * 8 + l_linenumber AS a, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem), arcs AS (SELECT a, l_orderkey * 8 + l_partkey % n + 1 AS b FROM o UNION SELECT a, l_orderkey * 8 + l_suppkey % n + 1 FROM o)"


@query("strong_components", f"WITH RECURSIVE {_ARCS}, r AS (SELECT a AS node, a AS seen FROM arcs UNION SELECT b, b FROM arcs UNION SELECT r.node, arcs.b FROM r JOIN arcs ON arcs.a = r.seen) SELECT x.node, min(y.node) AS label FROM r x JOIN r y ON x.node = y.seen AND x.seen = y.node GROUP BY x.node")
def strong_components(spark, d):
    n = F.count("*").over(Window.partitionBy("l_orderkey"))
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("a"), (F.col("l_orderkey") * 8).alias("o"), F.array(F.col("l_partkey") % n, F.col("l_suppkey") % n).alias("to"))
    return networks.strong_components(rows.select("a", F.explode("to").alias("t"), "o").select("a", (F.col("o") + F.col("t") + 1).alias("b")))


@query("spanning_forest", f"WITH {_SIMS}, pairs_ AS (SELECT id AS grp, a, b, similarity AS w FROM sims WHERE similarity > 0), {stepwise_sql.forest('pairs_')} SELECT a, b, round(w, 6) AS w FROM forest")
def spanning_forest(spark, d):
    sims = flows.similar(_flown_legs(spark, d), 0.0, group=["grp"], thin=graph.forest_rows)
    return networks.spanning_forest(sims.select("a", "b", F.col("similarity").alias("w"))).select("a", "b", *_r("w"))


# ---------------------------------------------------------------- routes


def _airways(spark, d) -> DataFrame:
    s = _sites(spark, d)
    side = lambda p, k: s.select(F.col("site_no").alias(k), F.col("site_lat").alias(f"{p}_lat"), F.col("site_lon").alias(f"{p}_lon"))
    pairs = side("efrom", "a").join(side("eto", "b"), (F.col("a") != F.col("b")) & ((F.col("b") - F.col("a") + 25) % 25 <= 6))
    return pairs.withColumn("edge_id", (F.col("a") * 100 + F.col("b")).cast("long"))


def _flights(spark, d) -> DataFrame:
    w = Window.partitionBy("id").orderBy("from_time", "leg_id")
    rows = views.legs(spark, d).withColumn("n", F.row_number().over(w) - 1)
    return rows.withColumn("flight", F.concat_ws("-", "id", F.floor(F.col("n") / 3).cast("string"))).withColumn("k", (F.col("n") % 3).cast("int"))


_BEAR = "((degrees(atan2(sin(radians({d} - {b})) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos(radians({d} - {b})))) % 360 + 360) % 360)"
_FB = _BEAR.format(a="from_lat", b="from_lon", c="to_lat", d="to_lon")
_EB = _BEAR.format(a="efrom_lat", b="efrom_lon", c="eto_lat", d="eto_lon")
_XY = "radians({lon} - efrom_lon) * cos(radians(efrom_lat)) * 6371000e0 AS {n}x, radians({lat} - efrom_lat) * 6371000e0 AS {n}y"
_ROUTE = f"""{POINTS}, {LEGS}, {_SITES}, edges AS (SELECT CAST(x.site_no AS BIGINT) * 100 + y.site_no AS edge_id, x.site_lat AS efrom_lat, x.site_lon AS efrom_lon, y.site_lat AS eto_lat, y.site_lon AS eto_lon FROM sites x, sites y WHERE x.site_no <> y.site_no AND (y.site_no - x.site_no + 25) % 25 <= 6),
nl AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY from_time, leg_id) - 1 AS n FROM legs), fl AS (SELECT *, id || '-' || (n // 3) AS flight, n % 3 AS k FROM nl),
bx AS (SELECT flight, min(least(from_lat, to_lat)) - 0.5 AS la, max(greatest(from_lat, to_lat)) + 0.5 AS lb, min(least(from_lon, to_lon)) - 0.5 AS oa, max(greatest(from_lon, to_lon)) + 0.5 AS ob FROM fl GROUP BY flight),
cd AS (SELECT fl.*, edges.* FROM fl JOIN bx USING (flight) JOIN edges ON efrom_lat BETWEEN la AND lb AND efrom_lon BETWEEN oa AND ob AND eto_lat BETWEEN la AND lb AND eto_lon BETWEEN oa AND ob),
xy AS (SELECT *, {_XY.format(lon="eto_lon", lat="eto_lat", n="e")}, {_XY.format(lon="from_lon", lat="from_lat", n="p")}, {_XY.format(lon="to_lon", lat="to_lat", n="q")}, abs({_FB} - {_EB}) AS turn, {views.haversine("from_lat", "from_lon", "to_lat", "to_lon", "6371000e0")} AS len FROM cd),
ab AS (SELECT *, sqrt(ex * ex + ey * ey) AS el, greatest(0e0, 1 - least(turn, 360 - turn) / 90) AS ori, (px * ex + py * ey) / sqrt(ex * ex + ey * ey) AS s1, (qx * ex + qy * ey) / sqrt(ex * ex + ey * ey) AS s2 FROM xy),
ft AS (SELECT flight, k, leg_id, edge_id, ori, least(greatest(0e0, least(el, greatest(s1, s2)) - greatest(0e0, least(s1, s2))) / (len + 1e-6), 1e0) AS cov FROM ab)"""


@query("route_candidates", f"WITH {_ROUTE}, g AS (SELECT *, CASE WHEN k = 0 THEN 0.8e0 * ori + 0.2e0 * cov ELSE 0.5e0 * ori + 0.5e0 * cov END AS fitness FROM ft) SELECT flight, k, edge_id, round(fitness, 6) AS fitness FROM g WHERE fitness > 0.3")
def route_candidates(spark, d):
    s = graph.scored_edges(_flights(spark, d), _airways(spark, d))
    fitness = F.when(F.col("k") == 0, F.col("first")).otherwise(F.col("rest"))
    return s.select("flight", F.col("k").cast("long").alias("k"), "edge_id", scalars.rounded(fitness, 6).alias("fitness"))


def _routes(spark, d) -> tuple[DataFrame, DataFrame]:
    f = _flights(spark, d)
    return graph.scored_edges(f, _airways(spark, d)), f.groupBy("flight").agg(F.count("*").cast("int").alias("n"))


_FITS = f"""{_ROUTE}, g AS (SELECT flight, k, edge_id, CASE WHEN k = 0 THEN 0.8e0 * ori + 0.2e0 * cov ELSE 0.5e0 * ori + 0.5e0 * cov END AS s FROM ft),
n AS (SELECT flight, count(*) AS n FROM fl GROUP BY flight), fit AS (SELECT * FROM g WHERE s > 0.3)"""


# depth first, best score first, of equal ones the smaller edge and staying last: the order of the lists of (-score, stays, edge)
@query("routes_greedy", f"""WITH RECURSIVE {_FITS},
r AS (SELECT flight, 0 AS k, edge_id AS e, s AS total, [edge_id] AS route, [-s, 0e0, edge_id] AS turn FROM fit WHERE k = 0
  UNION ALL SELECT r.flight, r.k + 1, f.edge_id, total + s, list_append(route, f.edge_id), list_concat(turn, [-s, (f.edge_id = r.e)::INT, f.edge_id]) FROM r JOIN fit f ON f.flight = r.flight AND f.k = r.k + 1 WHERE f.edge_id = r.e OR f.edge_id // 100 = r.e % 100),
met AS (SELECT flight, route, total, turn FROM r JOIN n USING (flight) WHERE r.k + 1 = n QUALIFY row_number() OVER (PARTITION BY flight ORDER BY turn) <= 5)
SELECT flight, CAST(row_number() OVER (PARTITION BY flight ORDER BY total DESC, turn) AS INT) AS rank, route AS edges, round(total, 6) AS fitness FROM met""")
def routes_greedy(spark, d):
    return graph.greedy_routes(*_routes(spark, d)).select("flight", "rank", "edges", *_r("fitness"))


@query("routes_exact", f"""WITH RECURSIVE {_FITS},
r AS (SELECT flight, 0 AS k, edge_id AS e, s AS total, [edge_id] AS route FROM fit WHERE k = 0
  UNION ALL SELECT r.flight, r.k + 1, f.edge_id, total + s, list_append(route, f.edge_id) FROM r JOIN fit f ON f.flight = r.flight AND f.k = r.k + 1 WHERE f.edge_id = r.e OR f.edge_id // 100 = r.e % 100),
best AS (SELECT flight, route, total, CAST(row_number() OVER (PARTITION BY flight ORDER BY total DESC, route) AS INT) AS rank FROM r JOIN n USING (flight) WHERE r.k + 1 = n)
SELECT flight, rank, route AS edges, round(total, 6) AS fitness FROM best WHERE rank <= 5""")
def routes_exact(spark, d):
    return graph.best_routes(*_routes(spark, d)).select("flight", "rank", "edges", *_r("fitness"))


# ---------------------------------------------------------------- formats


@query("json_flatten", "SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_flatten(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int, missing string"))
    return e.select("event_id", "p.k", "p.missing")


@query("flight_json", "SELECT o_orderkey AS key, upper(CASE WHEN o_orderkey % 2 = 0 THEN 'ba' ELSE 'af' END || o_orderkey) AS iata_number, CASE WHEN o_orderkey % 2 = 0 THEN 'BA' ELSE 'AF' END AS airline_iata, CASE WHEN o_orderkey % 3 = 0 THEN 'KL' END AS codeshare_iata, 'A' || (o_custkey % 30) AS departure_airport, o_orderdate::TIMESTAMP AS scheduled_departure, 'B' || (o_orderkey % 30) AS arrival_airport FROM orders")
def flight_json(spark, d):
    # the orders as flight JSON lines, parsed and flattened as the reader does
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    line = F.when(k % 2 == 0, "ba").otherwise("af")
    code = lambda x, n: F.struct(F.concat(F.lit(x), (n % 30).cast("string")).alias("iataCode"))
    times = F.lower(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss.SSS"))
    out = F.to_json(F.struct(
        F.struct(line.alias("iataCode")).alias("airline"), F.struct(F.concat(line, k).alias("iataNumber")).alias("flight"),
        F.when(k % 3 == 0, F.struct(F.struct(F.lit("kl").alias("iataCode")).alias("airline"))).alias("codeshared"),
        code("a", F.col("o_custkey")).withField("scheduledTime", times).alias("departure"), code("b", k).alias("arrival"),
    ))
    flights = o.select(k.alias("key"), F.from_json(out, tables.FLIGHT_JSON).alias("f")).select("key", "f.*")
    return tables.flat_flights(flights, "key").select("key", "iata_number", "airline_iata", "codeshare_iata", "departure_airport", "scheduled_departure", "arrival_airport")


_DMS = "(CASE WHEN {x} < 0 AND floor(abs({x})) > 0 THEN '-' ELSE '' END || CAST(floor(abs({x})) AS BIGINT) || '''' || CAST(floor((abs({x}) - floor(abs({x}))) * 60) AS BIGINT) || '''' || CAST(round_even(((abs({x}) - floor(abs({x}))) * 60 - floor((abs({x}) - floor(abs({x}))) * 60)) * 60, 0) AS BIGINT))"


@query("dms", f"WITH {POINTS}, q AS (SELECT event_id, floor(lat) + (event_id % 60) / 64e0 AS la, (event_id % 50) * -1e0 - (event_id % 61) / 64e0 AS lo FROM points) SELECT event_id, {_DMS.format(x='la')} AS lat, {_DMS.format(x='lo')} AS lon FROM q")
def dms(spark, d):
    p = views.points(spark, d)
    k = F.col("event_id")
    lat, lon = F.floor("lat") + (k % 60) / 64.0, (k % 50) * -1.0 - (k % 61) / 64.0
    return p.select("event_id", scalars.dms(lat.cast("double")).alias("lat"), scalars.dms(lon).alias("lon"))


_ARC = "CAST(floor(abs({x})) * 3600 + floor((abs({x}) - floor(abs({x}))) * 60) * 60 + round_even(((abs({x}) - floor(abs({x}))) * 60 - floor((abs({x}) - floor(abs({x}))) * 60)) * 60, 0) AS BIGINT)"
_ARC_TEXT = "(CASE WHEN {x} < 0 AND {s} >= 3600 THEN '-' ELSE '' END || concat_ws(chr(39), {s} // 3600, {s} % 3600 // 60, {s} % 60))"


@query("scenario_text", f"""WITH {POINTS}, hop AS (SELECT *, {views.haversine("lag(lat) OVER w", "lag(lon) OVER w", "lat", "lon")} / nullif(t - lag(t) OVER w, 0) AS kms, row_number() OVER w - 1 AS k FROM points WINDOW w AS (PARTITION BY id ORDER BY t, event_id)),
q AS (SELECT *, 'F' || id AS acid, coalesce(lead(kms) OVER (PARTITION BY id ORDER BY k), 0e0) * {scalars.KMS_TO_KNOTS}e0 AS knots, {_ARC.format(x="lat")} AS las, {_ARC.format(x="lon")} AS los FROM hop),
x AS (SELECT *, {_ARC_TEXT.format(x="lat", s="las")} || ',' || {_ARC_TEXT.format(x="lon", s="los")} AS place FROM q),
y(part, id, k, j, rest) AS (SELECT 0, NULL::BIGINT, 0, 0, 'ASAS OFF'
  UNION ALL SELECT 1, id, k, 0, 'CRE ' || acid || ',A320,' || lat || ',' || lon || ',' || alt || ',' || hdg || ',' || printf('%.2f', knots) FROM x WHERE k = 0
  UNION ALL SELECT 1, id, k, 1, 'SPD ' || acid || ' ' || CAST(round_even(knots, 0) AS BIGINT) FROM x WHERE k = 0
  UNION ALL SELECT 1, id, k, 2, 'ALT ' || acid || ' ' || alt FROM x WHERE k = 0
  UNION ALL SELECT 1, id, k, 0, acid || ' ADDWPT ' || place || ', ' || alt FROM x WHERE k > 0
  UNION ALL SELECT 1, id, k, 1, acid || ' AT ' || place || ' STACK ' || acid || ' VNAV ON' FROM x WHERE k = 1)
SELECT CAST(part AS INT) AS part, coalesce(CAST(id AS VARCHAR), '') AS id, CAST(k AS INT) AS k, CAST(j AS INT) AS j, '00:00:00.00>' || rest AS line FROM y""")
def scenario_text(spark, d):
    p = trajectory.drift_heading(views.points(spark, d)).withColumn("callsign", F.concat(F.lit("F"), "id")).withColumn("speed", F.col("vel"))
    return scenario.scenario_lines(p).withColumn("id", F.coalesce(F.col("id").cast("string"), F.lit("")))


_GRIDSQL = "grid AS (SELECT CAST(epoch(o_orderdate) AS BIGINT) AS ts, 30e0 + o_custkey % 85 * 0.5e0 AS latitude, -15e0 + o_orderkey % 111 * 0.5e0 AS longitude, o_totalprice / 1e4 AS u, (o_orderkey % 40) * 1e0 AS v FROM orders)"


def _grid(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(views.seconds(F.col("o_orderdate")).cast("long").alias("ts"), (30.0 + (F.col("o_custkey") % 85) * 0.5).alias("latitude"), (-15.0 + (F.col("o_orderkey") % 111) * 0.5).alias("longitude"), (F.col("o_totalprice") / 1e4).alias("u_wind"), (F.col("o_orderkey") % 40).cast("double").alias("v_wind"), F.col("o_orderkey"))


@query("weather_speed", f"WITH {_GRIDSQL} SELECT ts, latitude, longitude, round(sqrt(u * u + v * v), 6) AS wind_speed FROM grid WHERE latitude BETWEEN 35 AND 60 AND longitude BETWEEN -10 AND 30")
def weather_speed(spark, d):
    return scenario.grid_subset(_grid(spark, d), (35.0, 60.0), (-10.0, 30.0)).select("ts", "latitude", "longitude", *_r("wind_speed"))


@query("weather_gaps", f"WITH {_GRIDSQL}, s AS (SELECT DISTINCT latitude, ts FROM grid), g AS (SELECT latitude, ts, ts - lag(ts) OVER (PARTITION BY latitude ORDER BY ts) AS gap FROM s) SELECT latitude, ts, gap FROM g WHERE gap <> 86400")
def weather_gaps(spark, d):
    stamps = _grid(spark, d).select("latitude", "ts").distinct()
    return stitch.gap_audit(stamps, DAY, ["latitude"]).select("latitude", "ts", "gap")


@query("grid_messages", "WITH g AS (SELECT CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS hour, CASE WHEN o_orderkey % 2 = 0 THEN 250 ELSE 500 END AS level, 30e0 + o_custkey % 85 * 0.5e0 AS latitude, -15e0 + o_orderkey % 111 * 0.5e0 AS longitude, o_totalprice / 1e4 AS value FROM orders) SELECT level, hour, count(*) AS n, round(sum(value), 4) AS total, max(latitude) AS north FROM g WHERE level = 250 GROUP BY ALL")
def grid_messages(spark, d):
    # both winds written as messages by level and month; one wind of one level read back
    g = _grid(spark, d)
    month = views.seconds(F.date_trunc("month", F.timestamp_seconds("ts"))).cast("long")
    level = F.when(F.col("o_orderkey") % 2 == 0, 250).otherwise(500)
    field = lambda name: g.select(F.lit(name[0]).alias("name"), level.alias("level"), month.alias("hour"), "latitude", "longitude", F.col(name).alias("value"))
    path = f"{tables.shared_dir(spark)}/grid-{uuid.uuid4().hex[:12]}"
    grids.write_grid(field("u_wind").unionByName(field("v_wind")), path)
    kept = grids.read_grid(spark, path).filter("name = 'u' and level = 250")
    return kept.groupBy("level", "hour").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("latitude").alias("north"))


@query("attenuations", f"WITH {POINTS} SELECT event_id, round(CASE WHEN alt / 2e4 <= 0.3e0 THEN 1e0 ELSE exp(-4e0 * (alt / 2e4 - 0.3e0)) END, 7) AS tdf, round(CASE WHEN alt / 2e4 <= 0.4e0 THEN exp(-1e0 * alt / 2e4) ELSE exp(-0.4e0) * exp(-5e0 * (alt / 2e4 - 0.4e0)) END, 7) AS dsa FROM points")
def attenuations(spark, d):
    x = F.col("alt") / 2e4
    return views.points(spark, d).select("event_id", F.round(scalars.tdf(x, scalars.Tail(0.3, 4.0, 1.0)), 7).alias("tdf"), F.round(scalars.dsa(x, 0.4, 1.0, 5.0), 7).alias("dsa"))


@query("file_ranges", "SELECT o_orderkey, list_distinct(list_append(range(0, (o_orderkey % 9) * 1800 + 1, 3600), (o_orderkey % 9) * 1800)).list_sort().list_transform(lambda x: x::VARCHAR).array_to_string(',') AS files FROM orders")
def file_ranges(spark, d):
    files = F.array_sort(stitch.hour_range(0, (F.col("o_orderkey") % 9) * 1800))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(F.transform(files, lambda x: x.cast("string")), ",").alias("files"))


@query("sampled_ids", f"WITH {POINTS} SELECT id FROM (SELECT DISTINCT id FROM points) ORDER BY md5(id || ':42'), id LIMIT 50")
def sampled_ids(spark, d):
    return stitch.sample_ids(views.points(spark, d), 50)


@query("sampled_per_file", f"WITH {POINTS}, f AS (SELECT DISTINCT CAST(floor(t / 86400) AS BIGINT) AS file, id FROM points) SELECT file, id FROM f QUALIFY row_number() OVER (PARTITION BY file ORDER BY md5(file || ':' || id || ':42'), id) <= 5")
def sampled_per_file(spark, d):
    return stitch.sample_per_file(views.points(spark, d).withColumn("file", F.floor(F.col("t") / DAY)), 5)


@query("sampled_rows", f"WITH {POINTS} SELECT * FROM points WHERE CAST('0x' || substr(md5(event_id || ':42'), 1, 8) AS BIGINT) < 2147483648 ORDER BY md5(event_id || ':42'), event_id LIMIT 100")
def sampled_rows(spark, d):
    return stitch.sample_rows(stitch.bernoulli(views.points(spark, d), 0.5, ["event_id"]), 100, ["event_id"])


@query("resampled", f"WITH {POINTS}, {LEGS}, g AS (SELECT *, unnest(range(CAST(ceil(from_time / 3600) AS BIGINT), CAST(ceil(to_time / 3600) AS BIGINT))) * 3600e0 AS t FROM legs) SELECT id, t, round(from_lat + (t - from_time) / (to_time - from_time) * (to_lat - from_lat), 6) AS lat, round(from_lon + (t - from_time) / (to_time - from_time) * (to_lon - from_lon), 6) AS lon, round(from_alt + (t - from_time) / (to_time - from_time) * (to_alt - from_alt), 5) AS alt FROM g")
def resampled(spark, d):
    return trajectory.resampled(views.legs(spark, d), 3600.0).select("id", "t", *_r("lat", "lon"), *_r("alt", digits=5))


@query("relative_time", f"WITH {POINTS} SELECT event_id, round(t - min(t) OVER w, 4) AS t_rel, round((t - min(t) OVER w) / (max(t) OVER w - min(t) OVER w), 7) AS t_share FROM points WINDOW w AS (PARTITION BY id)")
def relative_time(spark, d):
    return trajectory.relative_time(views.points(spark, d)).select("event_id", *_r("t_rel", digits=4), *_r("t_share", digits=7))


@query("value_histogram", "SELECT CAST(least(floor((value - 0) / 500e0 * 50), 49) AS INT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1")
def value_histogram(spark, d):
    return stitch.histogram(table(spark, d, "events"), "value", 0.0, 500.0, 50)


@query("longest_legs", f"WITH {POINTS}, {LEGS} SELECT id, leg_id, row_number() OVER (PARTITION BY id ORDER BY to_time - from_time DESC, leg_id) AS rank FROM legs QUALIFY rank <= 3")
def longest_legs(spark, d):
    legs = views.legs(spark, d).withColumn("dur", F.col("to_time") - F.col("from_time"))
    return stitch.top_per_key(legs, ["id"], [F.desc("dur"), "leg_id"], 3).select("id", "leg_id", F.col("rank").cast("long").alias("rank"))


@query("bag_difference", "SELECT c_nationkey, c_mktsegment FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000)")
def bag_difference(spark, d):
    right = table(spark, d, "supplier").filter("s_acctbal > 8000").select(F.col("s_nationkey").alias("c_nationkey"))
    return stitch.bag_difference(table(spark, d, "customer"), right, ["c_nationkey"]).select("c_nationkey", "c_mktsegment")


@query("parameter_grid", "SELECT d AS day, c AS cycle, h AS hour FROM (VALUES ('2024-01-01'), ('2024-01-02')) a(d), (VALUES (0), (6), (12), (18)) b(c), (VALUES (0), (3)) x(h)")
def parameter_grid(spark, d):
    return stitch.parameter_grid(spark, day=["2024-01-01", "2024-01-02"], cycle=[0, 6, 12, 18], hour=[0, 3])


@query("gamma_parameters", f"WITH {POINTS}, q AS (SELECT event_id, 1 + alt / 4e4 AS lo, 1.2e0 + alt / 3e4 AS hi FROM points) SELECT event_id, round(pow((lo + hi) / 2 - 0.5e0, 2) / pow((hi - lo) / 2, 2), 6) AS shape, round(pow((hi - lo) / 2, 2) / ((lo + hi) / 2 - 0.5e0), 6) AS scale FROM q")
def gamma_parameters(spark, d):
    low, high = 1.0 + F.col("alt") / 4e4, 1.2 + F.col("alt") / 3e4
    shape, scale = scalars.gamma_params(low, high, F.lit(0.5))
    return views.points(spark, d).select("event_id", F.round(shape, 6).alias("shape"), F.round(scale, 6).alias("scale"))
