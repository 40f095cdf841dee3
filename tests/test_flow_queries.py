"""Flow queries compare the legs of an hour across flights; checked by enumeration on the smallest tables."""

import os
from itertools import combinations

import pytest

from skyloom.operators import flows
from skyloom.plans import catalog, views

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def legs(spark):
    return {r.leg_id: r for r in views.legs(spark, DATA).select("leg_id", "id", "from_time").collect()}


def test_flows_pair_the_legs_of_an_hour_across_flights(spark, legs):
    hour = lambda k: legs[k].from_time // 3600
    want = {(a, b) for a, b in combinations(sorted(legs), 2) if hour(a) == hour(b)}
    assert {(r.a, r.b) for r in catalog.QUERIES["flow_similarity"](spark, DATA).collect()} == want
    nodes = {r.node for r in catalog.QUERIES["spectral"](spark, DATA).collect()}
    assert nodes == {k for pair in want for k in pair}


@pytest.mark.parametrize("name", ["base_graph_edges", "communities"])
def test_graphs_join_legs_of_several_flights(spark, legs, name):
    found = catalog.QUERIES[name](spark, DATA).collect()
    if name == "communities":
        homes = {}
        for r in found:
            homes.setdefault(r.community, set()).add(legs[r.node].id)
        assert any(len(ids) > 1 for ids in homes.values())
    else:
        assert any(legs[r.a].id != legs[r.b].id for r in found)


def test_consecutive_files_of_the_whole_catalogue(spark):
    step, files = 2 * 86_400, {}
    for r in views.points(spark, DATA).select("id", "t").collect():
        files.setdefault(r.id, set()).add(r.t // step)
    want = {i: len(f) for i, f in files.items() if max(f) - min(f) + 1 == len(f)}
    assert {r.id: r.n for r in catalog.QUERIES["gap_consecutive_all"](spark, DATA).collect()} == want
    assert max(want.values()) > 2  # more than the first four days hold


def test_dbscan_takes_every_spectral_coordinate_and_stays_in_its_group(spark):
    got = {r.id: r.cluster for r in catalog.QUERIES["dbscan"](spark, DATA).collect()}
    groups = {}
    for r in catalog.QUERIES["spectral"](spark, DATA).collect():
        groups.setdefault(r.grp, []).append(r.node)
    assert set(got) == {k for g in groups.values() for k in g}
    assert all(got[k] == -1 for g in groups.values() if len(g) < 4 for k in g)
    rows = [(g, 10 * g + i, [0.001 * i, 0.0]) for g in range(2) for i in range(4)]
    apart = flows.dbscan(spark.createDataFrame(rows, "grp long, id long, x array<double>"), 0.02, 4, 2, group=["grp"])
    assert {r.id: r.cluster for r in apart.collect()} == {i: 10 * g for g, i, _ in rows}


def test_pairs_spread_over_tasks_whatever_the_size_of_the_legs(spark):
    s = flows.similarity(views.legs(spark, DATA), group=["id"])
    assert s.rdd.getNumPartitions() == flows.TASKS_A_CORE * spark.sparkContext.defaultParallelism  # at most the 4 shuffle partitions before


def test_terms_of_legs_without_an_end_or_a_length(spark):
    rows = [(1, 1.0, 1.0, 2.0, 2.0), (2, 1.0, 1.0, None, 2.0), (3, 1.0, 1.0, 1.0, 1.0)]
    legs = spark.createDataFrame([("x", *r) for r in rows], "id string, leg_id long, from_lat double, from_lon double, to_lat double, to_lon double")
    got = {(r.a_leg_id, r.b_leg_id): (r.cosine, r.separation, r.similarity) for r in flows.similarity(legs, group=["id"]).collect()}
    assert got == {(1, 2): (None, None, 0.0), (1, 3): (None, 0.0, 0.0), (2, 3): (None, None, 0.0)}
