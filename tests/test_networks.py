"""Graph rounds, assignment by parts, routes by joins, the tree of sites and polygon covers against plain enumeration."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyloom.operators import graph, kernels, linkage, networks, occupancy, polygons, spectral, trajectory


def reached(arcs):
    nxt, nodes = {}, {x for a in arcs for x in a}
    for a, b in arcs:
        nxt.setdefault(a, set()).add(b)
    out = {}
    for x in nodes:
        seen, stack = {x}, [x]
        while stack:
            for y in nxt.get(stack.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        out[x] = seen
    return out


def test_strong_components(spark):
    rng = random.Random(3)
    arcs = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)] + [(100 + i, 101 + i) for i in range(9)] + [(200 + i, 200 + (i + 1) % 7) for i in range(7)] + [(300, 300)]
    far = reached(arcs)
    want = {x: min(y for y in far[x] if x in far[y]) for x in far}
    df = spark.createDataFrame([*arcs, *arcs[:5], (None, 1), (1, None)], "a long, b long")
    assert {r.node: r.label for r in networks.strong_components(df).collect()} == want
    assert networks.strong_components(spark.createDataFrame([], "a long, b long")).collect() == []


def groups(rng):
    rows, base = [], 0
    for g, n in enumerate([2, 3, 7, 12, 25]):
        for i, j in itertools.combinations(range(n), 2):
            w = rng.choice([0, 0, 0, 0.5]) if g == 3 else rng.choice([0.0, 0.2, 0.5, 0.50001, 0.9, rng.random()])
            rows.append((g, base + i, base + j, float(w)))
        base += n
    return rows


def matrix(rows):
    nodes = sorted({x for _, a, b, _ in rows for x in (a, b)})
    m = np.eye(len(nodes))
    for _, a, b, w in rows:
        m[nodes.index(a), nodes.index(b)] = m[nodes.index(b), nodes.index(a)] = w
    return m


def test_forest_and_base_graphs(spark):
    rows = groups(random.Random(4))
    sims = spark.createDataFrame(rows, "grp long, a long, b long, similarity double")
    found = networks.spanning_forest(sims.filter("similarity > 0").select("a", "b", F.col("similarity").alias("w"))).collect()
    # Kruskal over the same order: heaviest first, then smaller ends
    root, want = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for _, a, b, w in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if w > 0 and find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b, w))
    assert {(r.a, r.b, r.w) for r in found} == want and len(found) == len(want)
    low = {r.grp: r.threshold for r in networks.connected_thresholds(sims).collect()}
    got = networks.base_graphs(sims).collect()
    for g in low:
        own = [r for r in rows if r[0] == g]
        m = matrix(own)
        assert low[g] == kernels.connected_threshold(m)
        graphs = []
        for t in kernels.base_thresholds(low[g], 1.0):
            edges = {(a, b) for _, a, b, w in own if w > t}
            if edges not in graphs:
                graphs.append(edges)
        assert [{(r.a, r.b) for r in got if r.grp == g and r.graph == k} for k in range(len(graphs))] == graphs


def quality(edges, homes, gamma, sizes):
    inner = sum(w for a, b, w in edges if a != b and homes[a] == homes[b])
    return inner - gamma * sum((sum(sizes[n] for n in c) ** 2 - sum(sizes[n] ** 2 for n in c)) / 2 for c in ([n for n in homes if homes[n] == h] for h in set(homes.values())))


@pytest.mark.parametrize(("gamma", "by"), [(0.3, "nodes"), (0.02, "degrees")])
def test_communities(spark, gamma, by):
    # eight groups of ten, dense inside and sparse between
    rng = random.Random(6)
    edges = [(a, b, rng.random()) for a, b in itertools.combinations(range(80), 2) if rng.random() < (0.7 if a // 10 == b // 10 else 0.04)]
    edges += edges[:9] + [(3, 3, 5.0)]
    got = networks.communities(spark.createDataFrame(edges, "u long, v long, w double"), gamma, by, levels=2 if by == "nodes" else 1).collect()
    homes = {r.node: r.community for r in got}
    strength = {n: sum(w for a, b, w in edges if a != b and n in (a, b)) for n in homes}
    sizes = strength if by == "degrees" else dict.fromkeys(homes, 1.0)
    assert got[0].settled and all(c == min(n for n in homes if homes[n] == c) for c in homes.values())
    found = quality(edges, homes, gamma, sizes)
    assert found > quality(edges, {n: n for n in homes}, gamma, sizes)
    if by == "nodes":
        assert found >= 0.98 * quality(edges, kernels.cpm_communities(edges, gamma), gamma, sizes)
    for c in set(homes.values()):  # each is connected
        inside = [(a, b) for a, b, _ in edges if homes[a] == homes[b] == c]
        assert reached(inside + [(b, a) for a, b in inside] + [(c, c)])[c] == {n for n in homes if homes[n] == c}


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_sparse_matching_against_the_dense_one(n, m, seed):
    rng = np.random.default_rng(seed)
    w = np.where(rng.random((n, m)) < 0.4, -np.inf, rng.choice([1.0, 2.0, 5.5, -1.0, 2000.25, 1999.5], (n, m)))
    dense = w if n <= m else w.T
    best = sum(dense[i, j] for i, j in kernels.max_matching(dense))
    r, c = np.nonzero(np.isfinite(w))
    k = kernels.sparse_matching(r, c, w[r, c])
    assert len(set(r[k])) == len(k) == len(set(c[k])) and w[r[k], c[k]].sum() == pytest.approx(best)


def test_assignment_of_parts(spark):
    rng = random.Random(9)
    rows = [(k, a, d, -rng.random() * 9) for k in ("x", "y", None) for a in range(12) for d in range(a // 3 * 3, a // 3 * 3 + 4) if rng.random() < 0.6]
    df = spark.createDataFrame([*rows, *rows[:4], ("x", 50, 50, None)], "k string, a_key long, d_key long, score double")
    got = linkage.assign(df, ["k"]).collect()
    for g in ("x", "y", None):
        w = np.full((12, 13), -np.inf)
        for k, a, d, s in rows:
            if k == g:
                w[a, d] = s + linkage.SLACK
        own = [r for r in got if r.k == g]
        assert sum(r.score + linkage.SLACK for r in own) == pytest.approx(sum(w[i, j] for i, j in kernels.max_matching(w)))
        assert len({r.a_key for r in own}) == len(own) == len({r.d_key for r in own})
    assert linkage.assign(df.limit(0), ["k"]).collect() == []


def test_best_routes_equal_the_search(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for f in range(12):
        n = rng.randint(1, 4)
        ends = {e: (rng.randrange(4), rng.randrange(4)) for e in range(9)}
        by = [{e: round(rng.random(), 3) for e in ends if rng.random() < 0.8} for _ in range(n)]
        rows += [(f"f{f}", k, 0, e, *ends[e], s if k == 0 else 0.0, 0.0 if k == 0 else s) for k, own in enumerate(by) for e, s in own.items()]
        want[f"f{f}"] = (n, kernels.top_routes(by[1:], by[0], ends))
    scored = spark.createDataFrame(rows + rows[:3], "flight string, k int, leg_id int, edge_id long, a long, b long, first double, rest double")
    n_legs = spark.createDataFrame([(f, n) for f, (n, _) in want.items()], "flight string, n int")
    got = {}
    for r in graph.best_routes(scored, n_legs).orderBy("flight", "rank").collect():
        got.setdefault(r.flight, []).append((list(r.edges), r.fitness))
    assert got == {f: x for f, (_, x) in want.items() if x}
    assert graph.best_routes(scored.limit(0), n_legs).collect() == []


@pytest.mark.parametrize("n", [0, 1, 15, 400])
def test_tree_finds_the_nearest(n):
    rng = np.random.default_rng(n)
    at = np.round(rng.random((n, 2)) * 8) / (1 if n > 100 else 3)
    no = rng.permutation(n)
    asked = np.concatenate([np.round(rng.random((300, 2)) * 10), rng.random((100, 2)) * 50 - 20, [[np.nan, 1.0]]])
    far, who = kernels.Tree(at[:, 0], at[:, 1], no).nearest(asked[:, 0], asked[:, 1])
    for (x, y), d, k in zip(asked[:-1], far, who, strict=False):
        if n:
            every = np.sqrt((at[:, 0] - x) ** 2 + (at[:, 1] - y) ** 2)
            assert d == every.min() and no[k] == no[every == every.min()].min()
    assert who[-1] == -1 and (n or (who == -1).all())


def test_tree_of_a_million_sites_is_not_scanned():
    rng = np.random.default_rng(1)
    tree = kernels.Tree(*rng.random((2, 200_000)) * 100, np.arange(200_000))
    seen = []
    tree._off, own = (lambda node, asked, f=tree._off: (seen.append(len(asked)), f(node, asked))[1]), None
    tree.nearest(*rng.random((2, 500)) * 100)
    assert sum(seen) < 500 * 400 and own is None


def test_nearest_without_sites_or_places(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (1, 0.0, 0.0)], "k int, lat double, lon double")
    none = spark.createDataFrame([("x", 1, None, 1.0)], "site string, site_no int, site_lat double, site_lon double")
    assert sorted((r.k, r.site, r.error) for r in trajectory.nearest_site(p, none, ["k"]).collect()) == [(1, None, None), (1, None, None), (2, None, None)]
    one = spark.createDataFrame([("x", 1, 3.0, 4.0), ("y", 0, 3.0, 4.0)], "site string, site_no int, site_lat double, site_lon double")
    assert sorted((r.k, r.site, r.error) for r in trajectory.nearest_site(p, one, ["k"]).collect()) == [(1, "y", 5.0), (1, "y", 5.0), (2, None, None)]


def test_polygons_with_holes_parts_and_borders(spark):
    rng = random.Random(7)
    ring = lambda name, no, pts: [(name, no, k, float(x), float(y)) for k, (x, y) in enumerate(pts)]
    rows = ring("a", 0, [(0, 0), (8, 0), (8, 8), (4, 3), (0, 8)]) + ring("a", 1, [(1, 1), (2, 1), (2, 2), (1, 2)])
    rows += ring("b", 0, [(8, 0), (12, 0), (12, 8), (8, 8)]) + ring("b", 1, [(20, 20), (21.3, 20.4), (20.6, 21.7), (20, 20)])
    rows += ring("closed", 0, [(-3, -3), (-1, -3), (-1, -1), (-3, -1), (-3, -3)])
    by = {}
    for name, no, _, x, y in rows:
        by.setdefault(name, {}).setdefault(no, []).append((x, y))
    edges = {name: [e for r in rs.values() for e in zip(r, r[1:] + r[:1], strict=True)] for name, rs in by.items()}

    def inside(name, x, y):
        odd = False
        for (x1, y1), (x2, y2) in edges[name]:
            if (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return False
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                odd = not odd
        return odd

    pts = [(k, rng.choice([rng.uniform(-4, 13), float(rng.randint(-4, 13))]), rng.choice([rng.uniform(-4, 9), float(rng.randint(-4, 9))])) for k in range(600)] + [(900 + k, rng.uniform(19.5, 22), rng.uniform(19.5, 22)) for k in range(60)]
    table = spark.createDataFrame(rows + [("a", 0, 9, None, 1.0)], "designator string, ring int, k int, lon double, lat double")
    want = {(k, name) for k, x, y in pts for name in edges if inside(name, x, y)}
    points = spark.createDataFrame([*pts, (9999, None, 1.0)], "id long, lon double, lat double")
    for cell in (0.5, 1.0, 7.0):
        assert {(r.id, r.designator) for r in polygons.located(points, table, cell=cell).collect()} == want
    # cells that are inside as a whole need no edges
    cover = polygons.cover(table, 0.5).collect()
    assert any(r.inner for r in cover) and all((r.edges is None) == r.inner for r in cover)
    legs = spark.createDataFrame([(i, *p[1:], *q[1:]) for i, (p, q) in enumerate(zip(pts, pts[1:], strict=False))], "leg_id long, from_lon double, from_lat double, to_lon double, to_lat double")
    want = {(i, n): inside(n, *p[1:]) and inside(n, *q[1:]) for i, (p, q) in enumerate(zip(pts, pts[1:], strict=False)) for n in edges if inside(n, *p[1:]) or inside(n, *q[1:])}
    assert {(r.leg_id, r.designator): r.both for r in polygons.legs_by_polygon(legs, table).collect()} == want


@pytest.mark.parametrize("whole", [4])  # three groups in rounds, two by a matrix
def test_spectral_coordinates_equal_the_dense_ones(spark, whole):
    rng = random.Random(1)
    rows, base, mats = [], 0, {}
    for g, n in enumerate([2, 3, 5, 9, 30]):
        m = np.eye(n)
        for i, j in itertools.combinations(range(n), 2):
            w = rng.random() * (1 if (i < n // 3) == (j < n // 3) else 0.15) if rng.random() < 0.8 else 0.0
            m[i, j] = m[j, i] = w
            rows.append((g, base + i, base + j, w) if rng.random() < 0.5 else (g, base + j, base + i, w))
        mats[g] = (base, m)
        base += n
    rows += [(g, b, a, w) for g, a, b, w in rows[:20]]  # given both ways
    got = {r.node: r.coords for r in spectral.embedding(spark.createDataFrame(rows, "grp long, a long, b long, similarity double"), whole=whole).collect()}
    for b, m in mats.values():
        n = len(m)
        want = kernels.spectral_embedding(m, min(2, n - 1)) * np.sqrt(m.sum(axis=1))[:, None]
        x = np.array([got[b + i] for i in range(n)]) * np.sqrt(m.sum(axis=1))[:, None]
        assert x.shape == want.shape and np.abs(x @ x.T - want @ want.T).max() < 1e-3


def test_spectral_clusters_and_symmetry(spark):
    rows = [(0, a, b, 0.9 if a // 5 == b // 5 else 0.01) for a, b in itertools.combinations(range(15), 2)]
    by = {}
    for r in spectral.clusters(spark.createDataFrame(rows, "grp long, a long, b long, similarity double"), 3).collect():
        by.setdefault(r.cluster, set()).add(r.node)
    assert sorted(map(sorted, by.values())) == [list(range(k, k + 5)) for k in (0, 5, 10)]
    with pytest.raises(ValueError, match="symmetric"):
        spectral.embedding(spark.createDataFrame([(0, 1, 2, 0.5), (0, 2, 1, 0.6)], "grp long, a long, b long, similarity double"))
    pts = spark.createDataFrame([(0, i, [float(i > 5) * 3 + 0.01 * i, 0.0]) for i in range(12)] + [(1, 100, [1.0]), (2, 7, [0.0, 0.0]), (2, 8, [0.0, 0.0])], "grp long, node long, coords array<double>")
    got = {(r.grp, r.node): r.cluster for r in spectral.k_means(pts).collect()}
    assert [got[0, i] for i in range(12)] == [1] * 6 + [0] * 6 and got[1, 100] == got[2, 7] == got[2, 8] == 0


def _parts(edges):
    label = {x: x for e in edges for x in e[:2]}
    while any(label[a] != label[b] for a, b, *_ in edges):
        for a, b, *_ in edges:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("seed", range(4))
def test_thinned_edges_keep_parts_and_forest(spark, seed, monkeypatch):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 60, 150), rng.integers(0, 60, 150)
    rows = [(int(min(x, y)), int(max(x, y)), float(w)) for x, y, w in zip(a, b, rng.integers(1, 6, 150), strict=True) if x != y]
    node, label = kernels.stars(*(np.array([r[k] for r in rows]) for k in (0, 1)))
    assert dict(zip(node.tolist(), label.tolist(), strict=True)) == _parts(rows)
    kept, want = [rows[k] for k in kernels.forest_rows(*(np.array([r[k] for r in rows]) for k in range(3)))], []
    for r in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        label = _parts(want) if want else {}
        if r[0] not in label or r[1] not in label or label[r[0]] != label[r[1]]:
            want.append(r)
    assert sorted(kept) == sorted(want)
    monkeypatch.setattr(graph, "THIN_ROWS", 20)  # of this process, where batches are gathered below
    batches = pa.table({"a": [r[0] for r in rows], "b": [r[1] for r in rows]}).to_batches(max_chunksize=7)
    thin = lambda t: pa.table(dict(zip("ab", kernels.stars(t.column("a").to_numpy(), t.column("b").to_numpy()), strict=True)))
    out = pa.Table.from_batches(graph._gathered(iter(batches), thin)).to_pylist()
    assert _parts([(r["a"], r["b"]) for r in out]) == _parts(rows)
    df = spark.createDataFrame([*rows, (99, 99, 1.0)], "a long, b long, w double").repartition(3)
    assert {r.node: r.label for r in graph.components(df).collect()} == {**_parts(rows), 99: 99}
    assert sorted(map(tuple, networks.spanning_forest(df).collect())) == sorted(want)


def test_what_components_write_grows_with_the_nodes(spark):
    n = 400
    pairs = spark.range(n).crossJoin(spark.range(n).withColumnRenamed("id", "b")).withColumnRenamed("id", "a").filter("a < b")
    assert graph.contracted(pairs.coalesce(2)).count() <= 2 * n  # 79,800 before
    w = pairs.withColumn("w", F.rand(1)).coalesce(2)
    assert graph.thinned_forest(w).count() < 2 * n


def test_likeliest_sends_no_pairs(spark):
    rows = spark.createDataFrame([(a, d, float((a * d) % 3)) for a in range(7) for d in range(40)], "a_key long, d_key long, score double")
    got = linkage.likeliest(rows)
    assert {r.a_key: r.d_key for r in got.collect()} == {a: min(range(40), key=lambda d: (-((a * d) % 3), d)) for a in range(7)}
    # pairs are combined before the first shuffle, without a sort or a window
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "Window" not in plan and plan.count("HashAggregate") >= 2


def test_strong_components_across_gatherings(spark, monkeypatch):
    began = []
    trimmed = networks._trimmed
    monkeypatch.setattr(networks, "_trimmed", lambda arcs: (began.append(arcs.count()), trimmed(arcs))[1])
    draw = np.random.default_rng(4)
    for n, m, parts in ((12, 20, 5), (30, 45, 7), (25, 26, 3)):
        arcs = [(int(a), int(b)) for a, b in draw.integers(0, n, (m, 2))]
        reach = np.eye(n, dtype=bool)
        for a, b in arcs:
            reach[a, b] = True
        for k in range(n):
            reach |= reach[:, k : k + 1] & reach[k]
        want = {x: int(np.flatnonzero(reach[x] & reach[:, x])[0]) for x in {e for arc in arcs for e in arc}}
        node, label = kernels.strong_parts(*np.array(arcs).T)
        assert dict(zip(node.tolist(), label.tolist(), strict=True)) == want
        df = spark.createDataFrame(arcs, "a long, b long").repartition(parts)
        assert {r.node: r.label for r in networks.strong_components(df).collect()} == want
    # rings that a task gathers whole need no round
    began.clear()
    rings = spark.createDataFrame([(4 * k + i, 4 * k + (i + 1) % 4) for k in range(50) for i in range(4)], "a long, b long").coalesce(1)
    assert {r.label for r in networks.strong_components(rings).collect()} == set(range(0, 200, 4)) and began == [0]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 9), st.integers(0, 9), st.integers(0, 10**6))
def test_matching_by_time_equals_matching_of_pairs(n, m, seed):
    rng = np.random.default_rng(seed)
    # whole hours and ties in time come often
    at, dt = rng.integers(0, 40, n) * 900.0, rng.integers(0, 60, m) * 900.0
    al, dl = rng.random(n) < 0.3, rng.random(m) < 0.3
    worth = rng.choice([np.nan, -1.0, 2000.25, 1999.5, 1990.125, 3.0], (2, 2, 4))
    x, y = kernels.timed_matching(at, al, dt, dl, worth)
    full = np.full((n, m), -np.inf)
    for i in range(n):
        for j in range(m):
            h = int((dt[j] - at[i]) // 3600)
            if 0 <= h < 4 and worth[int(al[i]), int(dl[j]), h] > 0:
                full[i, j] = worth[int(al[i]), int(dl[j]), h]
    r, c = np.nonzero(np.isfinite(full))
    k = kernels.sparse_matching(r, c, full[r, c])
    assert len(set(x)) == len(x) == len(set(y)) and full[x, y].sum() == full[r[k], c[k]].sum()


def test_matching_by_time_of_a_busy_group_is_not_cubic():
    # 4,068 arrivals of which each has some 36 departures took 7 s pair by pair
    rng = np.random.default_rng(3)
    at, dt = rng.random(4000) * 30 * 86_400, rng.random(3700) * 30 * 86_400
    worth = np.array([[[np.nan, *(2000.0 - 5 * h for h in range(7))]] * 2] * 2)
    none = lambda x: np.zeros(len(x), bool)
    tracked = []
    real = kernels.heappop
    try:
        kernels.heappop = lambda q: tracked.append(1) or real(q)
        x, _ = kernels.timed_matching(at, none(at), dt, none(dt), worth)
    finally:
        kernels.heappop = real
    assert len(x) > 3000 and len(tracked) < 40 * 4000


def test_assignment_by_time_equals_that_of_pairs(spark):
    rng = random.Random(4)
    kinds = "k string, {0}_key long, {0}_t double, {0}_long boolean"
    day = lambda: rng.choice([0, 3]) * 86_400.0 + rng.random() * 90_000
    a = [(k, i, day(), rng.random() < 0.3) for k in ("x", "y", None) for i in range(30)] + [("x", 90, None, False), ("x", 91, float("nan"), True), ("x", 92, 5.0, None)]
    d = [(k, i, day(), rng.random() < 0.3) for k in ("x", "y", None) for i in range(30)]
    for more in ([], [("x", 7, 86_400 * 3.5, False)]):  # a key at two times is still one arrival
        left, right = spark.createDataFrame([*a, *more, a[0]], kinds.format("a")), spark.createDataFrame(d, kinds.format("d"))
        got = linkage.assign_by_time(left, right, ["k"]).collect()
        want = linkage.assign(linkage.connection_scores(linkage.connection_candidates(left, right, ["k"])), ["k"]).collect()
        total = lambda rows: sum(r.score + linkage.SLACK for r in rows)
        assert len(got) == len(want) > 20 and total(got) == pytest.approx(total(want), abs=1e-6)
        assert len({(r.k, r.a_key) for r in got}) == len(got) == len({(r.k, r.d_key) for r in got})
    assert linkage.assign_by_time(left.limit(0), right, ["k"]).collect() == []


def test_flights_without_a_call_sign_are_spread(spark):
    schedule = spark.range(4000).select(F.col("id").alias("flight_key"), F.when(F.col("id") % 4 == 0, "A").otherwise("?").alias("airline_iata"), F.concat(F.lit("XX"), F.col("id") % 5).alias("iata_number"))
    airlines = spark.createDataFrame([("A", "AAA", 1)], "iata string, icao string, no int")
    seen = spark.createDataFrame([(" aaa0 ", "a1", 1, 1), ("aaa0", "a2", 2, 2), ("", "a9", 1, 3)], "callsign string, icao24 string, file int, row int")
    for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(c, "false" if c.endswith("enabled") else "-1")
    try:
        df = linkage.with_tails(schedule, airlines, seen, "no")
        rows = df.withColumn("_p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(rows) == 4000
    assert all(r.icao24 == ("a2" if r.callsign == "AAA0" else None) for r in rows) and sum(r.callsign is None for r in rows) == 3000
    assert len({r._p for r in rows if r.callsign is None}) > 1


def test_legs_outside_the_bands_are_not_cut_into_pieces(spark, capsys):
    leg = lambda i, a, b: (i, 0.0, 7200.0, 40.1, 44.9, 0.1, 4.9, a, b)
    high, nan = occupancy.TRENCHES[0][0], float("nan")
    rows = [leg(1, 100.0, high), leg(2, 100.0, high - 1), leg(3, high, high), leg(4, 5000.0, 9000.0), leg(5, 21_243.0, 30_000.0), leg(6, 30_000.0, 20_000.0), leg(7, nan, 9000.0), leg(8, None, 9000.0)]
    legs = spark.createDataFrame(rows, "id int, from_time double, to_time double, from_lat double, to_lat double, from_lon double, to_lon double, from_alt double, to_alt double")
    got = occupancy.pieces(legs)
    span = {r.id: (r.a, r.b) for r in got.groupBy("id").agg(F.min("t0").alias("a"), F.max("t1").alias("b")).collect()}
    assert set(span) == {3, 4, 6} and span[3] == (0.0, 7200.0)
    assert span[4] == pytest.approx((7200 * 2315.2 / 4000, 7200.0)) and span[6] == pytest.approx((7200 * 0.8757, 7200.0))
    # of the legs, and of their windows, only those that may meet a band are left before the cutting
    got.explain("extended")
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("1.0E-9") >= 4


def test_quality_of_legs_compared_inside_communities(spark, tmp_path, monkeypatch):
    from skyloom.plans import catalog

    rng = random.Random(6)
    rows = [(i, i % 7, float(i), rng.random(), rng.random(), rng.random() + 1, rng.random() + 1, i % 7) for i in range(90)]
    names = "leg_id long, id long, from_time double, from_lat double, from_lon double, to_lat double, to_lon double, grp long"
    asked = []
    weighted = catalog._weighted
    monkeypatch.setattr(catalog, "_weighted", lambda legs: asked.append(1) or weighted(legs))
    for more in ([], [rows[3]]):
        legs = spark.createDataFrame([*rows, *more], names).withColumn("community", F.col("id") % 3)
        homes = legs.select(F.col("leg_id").alias("node"), "community")
        want = {r.community: r.quality for r in graph.cpm_quality(weighted(legs), homes, 0.7).collect()}
        got = {r.community: r.quality for r in catalog._quality(legs).collect()}
        assert set(got) == {0, 1, 2} and got == pytest.approx(want, abs=1e-4)
        assert len(asked) == len(more)
