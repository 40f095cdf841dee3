"""Operators on small inputs with results worked out by hand, and kernels against plain enumeration."""

import itertools
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.functions import scalars
from skyloom.operators import airspace, flows, graph, kernels, linkage, networks, occupancy, scenario, spectral, stitch, trajectory
from skyloom.sources import tables
from skyloom.streaming import twins


def points(spark, rows):
    """(id, t, lat, lon, hdg, alt) rows with event ids by position."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, id string, t double, lat double, lon double, hdg double, alt double")


# ---------------------------------------------------------------- trajectories


def test_speed_cleaning_uses_original_neighbours(spark):
    # a step of 0.1 degree in 60 s is about 667 km/h; the outlier drops itself and its successor; a repeated time drops; a null position stays
    rows = [("a", 60.0 * k, 50 + 0.1 * k, 0.0, 0.0, 1e4) for k in range(6)]
    rows[2] = ("a", 120.0, 55.0, 0.0, 0.0, 1e4)
    rows += [("b", 0.0, 50.0, 0.0, 0.0, 1e4), ("b", 0.0, 50.1, 0.0, 0.0, 1e4), ("c", 0.0, 50.0, 0.0, 0.0, 1e4), ("c", 60.0, None, 0.0, 0.0, 1e4)]
    kept = {r.event_id for r in trajectory.clean_by_speed(points(spark, rows)).collect()}
    assert kept == {0, 1, 4, 5, 6, 8, 9}


def test_sessions(spark):
    rows = [("a", h * 3600.0, 0.0, 0.0, 0.0, 0.0) for h in (0, 1, 2, 8, 13)]
    got = {(r.instance, r.n) for r in trajectory.session_table(points(spark, rows)).collect()}
    assert got == {("a|0", 3), ("a|28800", 2)}


def test_turning_points_find_the_turn(spark):
    rows = [("a", 60.0 * k, 50.0 + 0.1 * min(k, 20), 5.0 + 0.15 * max(k - 20, 0), 0.0 if k < 20 else 90.0, 10_000.0) for k in range(40)]
    got = trajectory.turns_and_rises(points(spark, rows)).first()
    times = [p.time for p in got.tp]
    assert got.landed is False and times[0] == 0 and times[-1] == 39 * 60
    assert any(abs(t - 1200) <= 120 for t in times[1:-1])
    legs = trajectory.route_legs(points(spark, rows)).collect()
    assert len(legs) == len(times) - 1 or len(legs) >= 2


def test_takeoff_and_landing_edges(spark):
    alt = [0, 100, 600, 900, 700, 400, 100]
    rows = [("a", float(k), 50.0, 5.0, 0.0, float(a)) for k, a in enumerate(alt)] + [("b", 0.0, 0.0, 0.0, 0.0, 900.0)]
    got = {r.id: (r.takeoff, r.landing) for r in trajectory.airborne_edges(points(spark, rows)).collect()}
    assert got == {"a": (2, 5), "b": (-1, -1)}


def test_waypoints_go_back_to_flights(spark):
    rows = [("a", 60.0 * k, 50.0 + 0.1 * k, 5.0, 0.0, 10_000.0 - 250 * k) for k in range(40)]
    turns = trajectory.turns_and_rises(points(spark, rows))
    back = trajectory.regrouped(trajectory.waypoints(turns), trajectory.waypoints(turns, "dp")).first()
    assert back.landed is True and [p.time for p in back.tp] == [p.time for p in turns.first().tp]


def test_pelt_against_full_search():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = np.concatenate([rng.normal(m, 1, rng.integers(3, 8)) for m in rng.normal(0, 6, rng.integers(1, 4))])
        n, beta = len(x), np.log(len(x))
        best, last = [-beta], [0]
        for t in range(1, n + 1):
            c = [best[s] + ((x[s:t] - x[s:t].mean()) ** 2).sum() + beta for s in range(t)]
            best.append(min(c))
            last.append(int(np.argmin(c)))
        cut, t = set(), n
        while t:
            t = last[t]
            cut.add(t)
        assert kernels.pelt_mean(x, 1.0) == sorted(cut)


def test_merging_is_pairwise():
    rows = np.array([[0.0, 0.0], [30.0, 2.0], [50.0, 4.0], [200.0, 0.0]])
    assert kernels.merge_close(rows, 60.0) == [(32.5, 2.5), (200.0, 0.0)]


def test_slope_takeoff_and_landing():
    climb = np.concatenate([np.zeros(3), np.arange(1, 60) * 50.0, np.full(40, 2950.0), np.arange(59, 0, -1) * 50.0])
    to, la = kernels.slope_takeoff_landing(np.arange(len(climb), dtype=float), climb)
    assert to == 3 and la == len(climb) - 1
    assert kernels.slope_takeoff_landing(np.arange(30.0), np.full(30, 5000.0)) == (None, None)


def test_nearest_site_ties(spark):
    p = points(spark, [("a", 0.0, 0.0, 0.0, 0.0, 0.0)])
    sites = spark.createDataFrame([("x", 2, 0.0, 1.0), ("y", 1, 1.0, 0.0), ("z", 3, 5.0, 5.0)], "site string, site_no int, site_lat double, site_lon double")
    r = trajectory.nearest_site(p, sites, ["event_id"]).first()
    assert (r.site, r.error) == ("y", 1.0)


def test_nearest_site_in_several_arrays_for_repeated_points(spark, monkeypatch):
    monkeypatch.setattr(trajectory, "TREE_ROWS", 7)
    rng = np.random.default_rng(5)
    at = rng.random((30, 2)) * 10
    sites = spark.createDataFrame([(f"s{i}", i, float(x), float(y)) for i, (x, y) in enumerate(at)] + [("none", 99, None, 1.0)], "site string, site_no int, site_lat double, site_lon double")
    where = [(float(x), float(y)) for x, y in rng.random((20, 2)) * 10] * 2
    p = spark.createDataFrame(where, "lat double, lon double")
    got = sorted((r.lat, r.lon, r.site) for r in trajectory.nearest_site(p, sites, ["lat", "lon"]).collect())
    assert got == sorted((x, y, f"s{int(np.hypot(*(at - (x, y)).T).argmin())}") for x, y in where)


def test_airline_codes_take_the_last_row(spark):
    s = spark.createDataFrame([("ba", "BA123"), ("zz", "ZZ9"), (None, "QQ1")], "airline_iata string, iata_number string")
    a = spark.createDataFrame([("BA", "OLD", 1), ("BA", "BAW", 2), ("BA", None, 3), (None, "XXX", 4)], "iata string, icao string, no int")
    got = {r.iata_number: (r.airline_icao, r.callsign) for r in linkage.airline_codes(s, a, "no").collect()}
    assert got == {"BA123": ("BAW", "BAW123"), "ZZ9": (None, None), "QQ1": (None, None)}


def test_session_files_keep_single_files_and_gaps_of_exactly_the_limit(spark):
    df = spark.createDataFrame([("a", h * 3600) for h in (0, 1, 2, 8, 13, 1)] + [("b", 7200)], "id string, f long")
    got = {r.instance: (r.from_file, r.to_file, r.files) for r in stitch.session_files(df, F.col("f"), 5 * 3600).collect()}
    assert got == {"a|0": (0, 7200, [0, 3600, 7200]), "a|28800": (28800, 46800, [28800, 46800]), "b|7200": (7200, 7200, [7200])}


def test_day_flights(spark):
    rows = [("a", h * 3600.0) for h in (0, 1, 2)] + [("b", 0.0), ("b", 7200.0)] + [("c", 3600.0 * 30)]
    df = spark.createDataFrame(rows, "id string, t double")
    got = stitch.day_flights(df, (F.floor(F.col("t") / 3600) * 3600).cast("long"), 3600, 0, 82_800)
    assert sorted((r.id, r.t) for r in got.collect()) == [("a", 0.0), ("a", 3600.0), ("a", 7200.0)]


def test_ids_slices_and_hours(spark):
    df = spark.createDataFrame([("abc", "XY1")], "i string, c string")
    assert [df.select(scalars.flight_id(F.col("i"), F.col("c"), f)).first()[0] for f in ("craft_first", "call_first", "underscored")] == ["abcXY1", "XY1abc", "XY1_abc"]
    assert [r.id for r in trajectory.sliced(spark.range(50), ["id"], 10, 13).collect()] == [10, 11, 12]
    s = spark.createDataFrame([("1970-01-01 01:20:00",), ("1970-01-01 02:59:00",), (None,)], "t string").select(F.col("t").cast("timestamp_ntz").alias("time"))
    assert [r.hour for r in linkage.schedule_hours(s).collect()] == [3600 * k for k in range(1, 8)]
    empty = s.filter("time is null")
    assert linkage.schedule_hours(empty).collect() == []
    o = spark.createDataFrame([(None, "B", "1"), (2, "A", None), (2, "A", "9"), (1, None, "3")], "time int, airport string, iata_number string")
    assert [tuple(r) for r in linkage.ordered_schedule(o).collect()] == [(1, None, "3"), (2, "A", "9"), (2, "A", None), (None, "B", "1")]


# ---------------------------------------------------------------- stitching


def catalogue(spark, **files):
    return spark.createDataFrame(list(files.items()), "id string, files array<long>")


def test_continuity(spark):
    cat = catalogue(spark, keep=[0, 3600, 7200], gap=[0, 7200], one=[0])
    assert {r.id for r in stitch.consecutive_only(cat).collect()} == {"keep", "one"}
    cut = stitch.truncated(catalogue(spark, a=[0, 3600, 10800, 14400], b=[0, 7200]))
    assert [(r.id, list(r.files)) for r in cut.collect()] == [("a", [0, 3600])]


def test_across_days(spark):
    rows = [("a", 0, [1, 2], False, True), ("a", 86400, [3], True, False), ("b", 0, [1], True, False)]
    cat = spark.createDataFrame(rows, "id string, day long, files array<long>, starts boolean, ends boolean")
    got = {(r.id, r.day): list(r.files) for r in stitch.across_days(cat).collect()}
    assert got == {("a", 0): [1, 2, 3], ("a", 86400): [3], ("b", 0): [1]}


def test_relocate_and_remap(spark):
    pts = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.7), ("b", 2, 0.1)], "id string, file long, v double")
    cat = catalogue(spark, a=[1, 2], b=[2])
    assert sorted((r.id, r.file) for r in stitch.relocated(pts, cat).collect()) == [("a", 1), ("a", 1), ("b", 2)]
    inst = spark.createDataFrame([("a|0", "a", [1]), ("a|9", "a", [2])], "instance string, base_id string, files array<long>")
    assert sorted(r.instance for r in stitch.remapped(pts, inst).collect()) == ["a|0", "a|9"]
    single, several = stitch.split_by_files(cat)
    assert [r.id for r in single.collect()] == ["b"] and [r.id for r in several.collect()] == ["a"]


def test_snapshots(spark):
    p = points(spark, [("a", 10.0, 50.0, 0.0, 0.0, 0.0), ("b", 50.0, 50.0, 0.0, 0.0, 0.0), ("a", 70.0, 50.0, 0.0, 0.0, 0.0)])
    assert {r.event_id for r in stitch.latest_snapshot(p).collect()} == {1, 2}
    assert {r.event_id for r in stitch.latest_snapshot(p, keys=["id"]).collect()} == {0, 1, 2}


# ---------------------------------------------------------------- counts


def leg(i, lo, hi, lat=50.1, alt=9000.0):
    return (i, lo, hi, lat, 5.1, lat, 5.1, alt, alt)


LEG = "id string, from_time double, to_time double, from_lat double, from_lon double, to_lat double, to_lon double, from_alt double, to_alt double"


def test_occupancy_and_peak(spark):
    x, y, z = leg("X", 0.0, 300.0), leg("Y", 300.0, 600.0), leg("Z", 200.0, 400.0)
    split = [leg("X", 0.0, 150.0), leg("X", 150.0, 300.0)]
    df = lambda rows: spark.createDataFrame(rows, LEG)
    assert occupancy.fractional(df([x, y, z])).first().weight == pytest.approx(0.888889, abs=1e-6)
    assert [occupancy.peak(df(r)).first().max_count for r in ([x, y], [x, y, z], [*split, y], [*split, y, z])] == [1, 2, 1, 2]


def test_pieces_keep_all_the_time(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), 100.0 * i, 100.0 * i + 5000, *map(float, rng.uniform((35, -5, 35, -5), (65, 35, 65, 35))), 8000.0, 11000.0) for i in range(30)]
    got = occupancy.pieces(spark.createDataFrame(rows, LEG), occupancy.Grid(cell=1.0)).groupBy("id").agg(F.sum(F.col("t1") - F.col("t0")).alias("s")).collect()
    assert len(got) == 30 and all(r.s == pytest.approx(5000) for r in got)


def test_reaggregate(spark):
    fine = spark.createDataFrame([(0, 0, 0, 0, 2), (0, 0, 0, 1, 3), (900, 0, 0, 0, 4)], "window_start long, trench int, lat_idx int, lon_idx int, max_count long")
    assert [tuple(r) for r in occupancy.reaggregate(fine, 3600.0, 0.5).collect()] == [(0, 0, 0, 0, 5)]
    assert sorted(map(tuple, occupancy.reaggregate(fine, 900.0, 0.25).collect())) == sorted(map(tuple, fine.collect()))


# ---------------------------------------------------------------- airspace


def test_conflict(spark):
    cols = "id string, leg_id long, from_time double, to_time double, from_lat double, from_lon double, to_lat double, to_lon double, from_alt double"
    rows = [("a", 1, 0.0, 100.0, 0.0, 0.0, 1.0, 1.0, 0.0), ("b", 2, 0.0, 100.0, 1.0, 0.0, 0.0, 1.0, 900.0), ("a", 3, 0.0, 100.0, 1.0, 0.0, 0.0, 1.0, 0.0), ("c", 4, 500.0, 600.0, 1.0, 0.0, 0.0, 1.0, 0.0), ("d", 5, 0.0, 100.0, 1.0, 0.0, 0.0, 1.0, 5000.0)]
    got = airspace.conflicts(spark.createDataFrame(rows, cols)).collect()
    assert [(r.leg_a, r.leg_b, r.lon, r.lat) for r in got] == [(1, 2, 0.5, 0.5)]


def test_entry_and_exit(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    cols = "id string, leg_id long, from_lon double, from_lat double, to_lon double, to_lat double"
    rows = [("through", 1, -5.0, 5.0, 15.0, 5.0), ("in", 2, -5.0, 5.0, 5.0, 5.0), ("out", 3, 5.0, 5.0, 15.0, 5.0), ("far", 4, -5.0, 20.0, 5.0, 20.0)]
    got = sorted((r.leg_id, r.kind, r.lon) for r in airspace.boundary_points(spark.createDataFrame(rows, cols), ring).collect())
    assert got == [(1, "entry", 0.0), (1, "exit", 10.0), (2, "entry", 0.0), (3, "exit", 10.0)]


def test_a_corner_is_one_meeting(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = [(str(k), k, x, y, x + dx, y + dy) for k, (x, y, dx, dy) in enumerate((x, y, dx, dy) for x, y in ring for dx, dy in ((-3.0, -2.0), (-3.0, 2.0), (3.0, -2.0), (3.0, 2.0)) if not (0 < x + dx < 10 and 0 < y + dy < 10))]
    legs = spark.createDataFrame(rows, "id string, leg_id long, from_lon double, from_lat double, to_lon double, to_lat double")
    assert sorted(r.leg_id for r in airspace.boundary_points(legs, ring).collect()) == [r[1] for r in rows]


# ---------------------------------------------------------------- schedules


def test_assignment(spark):
    rows = [("x", 0, 0, -1.0), ("x", 0, 1, -5.0), ("x", 1, 0, -2.0)]
    df = spark.createDataFrame(rows, "k string, a_key long, d_key long, score double")
    assert sorted((r.a_key, r.d_key) for r in linkage.assign(df, ["k"]).collect()) == [(0, 1), (1, 0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.integers(0, 10**6))
def test_matching_against_enumeration(n, m, seed):
    rng = np.random.default_rng(seed)
    w = np.where(rng.random((n, m)) < 0.3, -np.inf, rng.integers(1, 20, (n, m)).astype(float))
    if n > m:
        w = w.T
    pairs = kernels.max_matching(w)
    got = sum(w[i, j] for i, j in pairs)
    pad = np.concatenate([np.where(np.isfinite(w), w, 0.0), np.zeros((w.shape[0], w.shape[0]))], axis=1)
    best = max(sum(pad[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(pad.shape[1]), pad.shape[0]))
    assert got == best and len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})


def test_connection_hours_are_whole_for_scores_and_exact_for_times(spark):
    a = spark.createDataFrame([("q", 1, 36_000.0, False)], "k string, a_key long, a_t double, a_long boolean")
    d = spark.createDataFrame([("q", 7, 36_000.0 + 1.98333 * 3600, False), ("q", 8, 36_000.0 + 9 * 3600, False), ("q", 9, 36_000.0 + 1800, False)], "k string, d_key long, d_t double, d_long boolean")
    c = linkage.connection_candidates(a, d, ["k"]).collect()
    assert [(r.d_key, r.hours) for r in c] == [(7, 1)]
    pairs = linkage.assign(linkage.connection_scores(linkage.connection_candidates(a, d, ["k"])), ["k"])
    assert linkage.connection_times(a, pairs, d).first().connection_time == pytest.approx(1.98333)


def test_codeshares(spark):
    rows = [("BA", "LHR", "CDG", "t1", "t2", "departure", 1), ("BA", "LHR", "CDG", "t1", "t2", "arrival", 2), ("AF", None, "X", "t", "t", "arrival", 3), ("AF", None, "Y", "t", "t", "arrival", 4)]
    df = spark.createDataFrame(rows, "c string, dep string, arr string, sd string, sa string, type string, n int")
    key = linkage.codeshare_key(*[F.col(x) for x in ("c", "dep", "arr", "sd", "sa")])
    assert sorted(r.n for r in linkage.collapse_codeshares(df, key, ["n"]).collect()) == [1, 3]


def test_haul(spark):
    s = spark.createDataFrame([(1, "aa", "BB"), (2, "AA", "ZZ"), (3, "AA", "NN")], "n int, departure_airport string, arrival_airport string").withColumns({c: F.upper(c) for c in ("departure_airport", "arrival_airport")})
    air = spark.createDataFrame([("AA", 0.0, 0.0), ("bb", 0.0, 20.0), ("NN", None, None)], "iata string, lat double, lon double")
    got = {r.n: (r.haul_type, r.distance) for r in linkage.with_haul(s, air).collect()}
    assert got[1][0] == "medium_haul" and got[2] == ("short_haul", -1.0) and got[3] == ("long_haul", None)


def test_haul_takes_an_airports_first_row(spark):
    s = spark.createDataFrame([(1, "AA", "BB")], "n int, departure_airport string, arrival_airport string")
    air = spark.createDataFrame([("AA", 0.0, 0.0, 1), ("BB", 40.0, 40.0, 1), ("BB", 0.0, 5.0, 2), ("AA", -50.0, -50.0, 3)], "iata string, lat double, lon double, no int").coalesce(1)
    want = 6371 * 2 * np.arcsin(np.sqrt((1 - np.cos(np.radians(40)) ** 2) / 2))
    for order in (None, "no"):
        assert linkage.with_haul(s, air, order).first().distance == pytest.approx(want, rel=1e-6)


def test_the_latest_snapshot_comes_before_the_box(spark):
    # the minute's latest row lies outside the box, so its earlier row inside is no snapshot either
    df = spark.createDataFrame([(1, 10.0, 50.0, 5.0), (2, 20.0, 10.0, 5.0), (3, 70.0, 50.0, 5.0)], "n int, t double, lat double, lon double")
    got = stitch.fresh_in_box(stitch.latest_snapshot(df), (30.0, 72.0), (-15.0, 40.0)).collect()
    assert [r.n for r in got] == [3]


def test_time_inside_runs_from_start_to_start(spark):
    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = [("a", 0.0, 400.0, 5.0, 5.0, 6.0, 6.0), ("a", 400.0, 900.0, 6.0, 6.0, 7.0, 7.0), ("b", 0.0, 5000.0, 5.0, 5.0, 6.0, 6.0)]
    legs = spark.createDataFrame(rows, "id string, from_time double, to_time double, from_lat double, from_lon double, to_lat double, to_lon double")
    assert {r.id: r.seconds for r in airspace.time_inside(legs, ring).collect()} == {"a": 400.0}
    assert {r.id: r.seconds for r in airspace.time_inside(legs, ring, to_end=True).collect()} == {"a": 900.0, "b": 5000.0}


def test_tails(spark):
    rows = [(" BA1 ", "x", 0, 1), ("ba1", "y", 0, 2), ("BA1", "z", 1, 1), ("BA2", "q", 0, 1)]
    seen = spark.createDataFrame(rows, "callsign string, icao24 string, file int, row int")
    got = linkage.tails(seen, spark.createDataFrame([("Ba1",)], "callsign string")).collect()
    assert [tuple(r) for r in got] == [("ba1", "z")]


# ---------------------------------------------------------------- flows and graphs


def test_similarity_of_four_segments(spark):
    cols = "leg_id long, from_lat double, from_lon double, to_lat double, to_lon double"
    rows = [(0, 0.0, 0.0, 0.0, 10.0), (1, 1.0, 0.0, 1.0, 10.0), (2, 0.0, 10.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0)]
    got = {(r.a_leg_id, r.b_leg_id): r.similarity for r in flows.similarity(spark.createDataFrame(rows, cols)).collect()}
    assert got[(0, 1)] > 0.6 and got[(0, 2)] == 0 and got[(0, 3)] == 0
    near = flows.similar_segments(spark.createDataFrame(rows, cols)).collect()
    assert [(r.a_leg_id, r.b_leg_id) for r in near] == [(0, 1)]


def test_base_graphs(spark):
    sims = spark.createDataFrame([(0, 0, 1, 0.5), (0, 0, 2, 0.3), (0, 1, 2, 0.2)], "grp long, a long, b long, similarity double")
    got = networks.base_graphs(sims).groupBy("graph").agg(F.count("*").alias("n")).orderBy("graph").collect()
    assert kernels.connected_threshold(np.array([[1, 0.5, 0.3], [0.5, 1, 0.2], [0.3, 0.2, 1]])) == 0.2
    assert [r.n for r in got] == [2, 1]  # a third graph has no edges
    assert kernels.base_thresholds(0.2, 1.0)[:4] == pytest.approx([0.2, 0.266667, 0.388889, 0.541667], abs=1e-5)


TRIANGLES = [(a, b, 1.0) for t in range(4) for a, b in ((3 * t + 1, 3 * t + 2), (3 * t + 2, 3 * t + 3), (3 * t + 1, 3 * t + 3))]


def test_communities_and_quality(spark):
    bridges = [(3, 4, 0.1), (6, 7, 0.1), (9, 10, 0.1)]
    e = spark.createDataFrame(TRIANGLES + bridges, "u long, v long, w double")
    homes = networks.communities(e, 0.7)
    by = {r.node: r.community for r in homes.collect()}
    assert {frozenset(n for n in by if by[n] == c) for c in set(by.values())} == {frozenset({3 * t + 1, 3 * t + 2, 3 * t + 3}) for t in range(4)}
    assert graph.cpm_quality(e, homes, 0.7).agg(F.sum("quality")).first()[0] == pytest.approx(3.6)
    alone = homes.select("node", F.col("node").alias("community"))
    assert graph.cpm_quality(e, alone, 0.7).agg(F.sum("quality")).first()[0] == 0


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(30, 31)], "a long, b long")
    got = {r.node: r.label for r in graph.components(e).collect()}
    assert got == {k: 0 for k in range(21)} | {30: 30, 31: 30}


def test_dbscan(spark):
    rng = np.random.default_rng(0)
    xy = np.concatenate([rng.normal(0, 0.01, (20, 2)), rng.normal(5, 0.01, (20, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(xy)], "id long, x array<double>")
    got = {r.id: r.cluster for r in flows.dbscan(df, 0.2, 4, 2).collect()}
    assert [got[i] for i in (0, 19, 20, 39, 40)] == [0, 0, 20, 20, -1]


def test_spectral_separates(spark):
    rows = [(0, a, b, 0.9 if (a < 4) == (b < 4) else 0.01) for a in range(8) for b in range(a + 1, 8)]
    got = spectral.embedding(spark.createDataFrame(rows, "grp long, a long, b long, similarity double")).orderBy("node").collect()
    side = [r.coords[0] > 0 for r in got]
    assert len(set(side[:4])) == 1 and len(set(side[4:])) == 1 and side[0] != side[7]


def test_routes_against_enumeration():
    rng = np.random.default_rng(5)
    ends = {e: (int(a), int(b)) for e, (a, b) in enumerate(rng.integers(0, 4, (10, 2)))}
    scores = [dict(enumerate(rng.random(10))) for _ in range(3)]
    every = []
    for r in itertools.product(ends, repeat=3):
        ok = all(s[e] > 0.3 for s, e in zip(scores, r, strict=True)) and all(b == a or ends[b][0] == ends[a][1] for a, b in zip(r, r[1:], strict=False))
        if ok:
            every.append((sum(s[e] for s, e in zip(scores, r, strict=True)), list(r)))
    best = sorted(every, key=lambda x: -x[0])[:5]
    assert [t for _, t in kernels.top_routes(scores[1:], scores[0], ends)] == pytest.approx([t for t, _ in best])
    greedy = kernels.route_search(scores[1:], scores[0], ends)
    assert len(greedy) == min(5, len(every)) and all(any(r == x for _, x in every) for r, _ in greedy)


def test_polyline_helpers(spark):
    line = flows.resample([(0.0, 0.0), (2.0, 0.0)], 0.5)
    assert line == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0), (1.5, 0.0), (2.0, 0.0)]


# ---------------------------------------------------------------- sources, sinks, scenarios, streams


def test_scenario(spark):
    rows = [("a", 0.0, 46.17704772949219, 6.1, 90.0, 400.0), ("a", 60.0, 46.5, 6.5, 90.0, 500.0), ("a", 120.0, 47.0, 7.0, 90.0, 600.0)]
    p = points(spark, rows).withColumn("callsign", F.lit(" BA1 ")).withColumn("speed", F.lit(0.1))
    lines = [r.line for r in scenario.scenario_lines(p).collect()]
    assert lines[0].endswith("ASAS OFF") and lines[1].startswith("00:00:00.00>CRE BA1,A320,46.17704772949219,6.1,400.0,90.0,194.38")
    assert lines[2:4] == ["00:00:00.00>SPD BA1 194", "00:00:00.00>ALT BA1 400.0"]
    assert lines[4:6] == ["00:00:00.00>BA1 ADDWPT 46'30'0,6'30'0, 500.0", "00:00:00.00>BA1 AT 46'30'0,6'30'0 STACK BA1 VNAV ON"] and len(lines) == 7


def test_headerless_csv_with_provenance(spark, tmp_path):
    d = tmp_path / "2024-05-01"
    d.mkdir()
    (d / "1714521600.csv").write_text("1.0,abc,50.0,5.0,90.0, BA1 ,1000.0\n2.0,abc,,5.0,90.0, BA1 ,1000.0\n")
    (d / "._1714521600.csv").write_text("junk\n")
    df = tables.read_headerless(spark, str(tmp_path)).select("*", tables.file_stamp().alias("hour"), tables.file_day().cast("string").alias("day"))
    got = df.orderBy("time").collect()
    assert [(r.time, r.lat, r.hour, r.day) for r in got] == [(1.0, 50.0, 1714521600, "2024-05-01"), (2.0, None, 1714521600, "2024-05-01")]
    assert tables.read_detecting_header(spark, str(d), tables.STATE_VECTORS).count() == 2


def test_flight_json(spark, tmp_path):
    end = lambda c, t: {"iataCode": c, "scheduledTime": t}
    one = {"type": "arrival", "airline": {"iataCode": "ba"}, "flight": {"iataNumber": "ba1"}, "departure": end("lhr", "2024-05-24t08:00:00.000"), "arrival": end("cdg", None)}
    (tmp_path / "a.json").write_text(json.dumps([one, one | {"codeshared": {"airline": {"iataCode": "af"}}}]))
    got = tables.read_flights(spark, str(tmp_path)).orderBy(F.col("codeshare_iata").asc_nulls_first()).collect()
    assert [(r.iata_number, r.codeshare_iata, str(r.scheduled_departure), r.scheduled_arrival) for r in got] == [("BA1", None, "2024-05-24 08:00:00", None), ("BA1", "AF", "2024-05-24 08:00:00", None)]


def test_route_plans(spark, tmp_path):
    node = lambda i: {"type": "FIX", "ident": i, "lat": 1.123456785, "lon": 2.0, "alt": 0.0}
    plan = lambda a: {"fromICAO": a, "toICAO": "Z", "distance": 5.0, "route": {"nodes": [node("P"), node("Q")]}}
    (tmp_path / "a.json").write_text(json.dumps([plan("A"), plan("B")]))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text("[]")
    plans = tables.read_route_plans(spark, str(tmp_path))
    assert [(r.fromICAO, r.ident) for r in tables.route_nodes(plans).orderBy("k").collect()] == [("A", "P"), ("A", "Q")]
    assert tables.route_metadata(plans).first().distance == 5.0


def test_labels_and_config(spark):
    text = "admitted_indices:\n- 3\n- 5\n- 3\nlabelled_indices:\n- 5\nlabel:\n- north\n"
    assert sorted((r.segment, r.label) for r in tables.read_labels(spark, text).collect() if r.label) == [(5, "north")]
    assert tables.parse_config("airports: 'LHR,CDG'\ndate_from: 2024-05-24\n") == {"airports": "LHR,CDG", "date_from": "2024-05-24"}
    assert tables.read_lines(spark, "[(1.0, 2.0), (3, 4)]\n").first().line[1].lat == 4.0


def test_idempotent_partitions_and_chunks(spark, tmp_path):
    df = spark.createDataFrame([(f"i{k}", k % 2) for k in range(20)], "id string, day int")
    for _ in range(2):
        tables.write_by(df, str(tmp_path / "out"), "day")
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 20 and tables.not_done(df, back.filter("day = 0"), ["day"]).count() == 10
    rows = df.union(df).union(spark.createDataFrame([(None, 0)], df.schema))
    chunks = tables.chunked(rows.repartition(5), 4).collect()
    order = [None, *sorted(f"i{k}" for k in range(20))]
    assert len(chunks) == 41 and all(r.chunk == order.index(r.id) // 4 for r in chunks)


def test_file_pairs(spark):
    name = lambda *xs: spark.createDataFrame([(x,) for x in xs], "name string")
    got = tables.paired_files(name("f_1_x"), name("f_1_seg", "f_2_seg")).collect()
    assert [(r.flow, r.segment) for r in got] == [("f_1_x", "f_1_seg")]
    with pytest.raises(Exception, match="not exactly one"):
        tables.paired_files(name("f_9_x"), name("f_1_seg")).collect()


def test_streaming_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = spark.range(60).select((F.col("id") % 3).cast("string").alias("id"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("id"))).alias("ts"))
    rows.write.parquet(src)
    q = twins.tumbling_counts(twins.new_files(spark, src, rows.schema)).writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("tumbling").collect()) == [15, 15, 15, 15]


def test_change_points_meet_as_the_windows_left_them(spark):
    rows = spark.range(200).selectExpr("id % 3 AS id", "CAST(id AS DOUBLE) * 30 AS t", "id AS event_id", "50D AS lat", "id / 10D AS lon", "CAST(id * 37 % 360 AS DOUBLE) AS hdg", "id * 40D AS alt")
    turns = trajectory.turns_and_rises(rows)
    plan = turns._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert dict(turns.dtypes)["id"] == "string" and turns.count() == 3
