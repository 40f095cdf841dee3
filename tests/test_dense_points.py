"""Density clusters by tiles: those of plain enumeration, whatever the tiles, with points at just eps and with clusters across tiles."""

import numpy as np
import pytest

from skyloom.operators import flows, kernels


def _plain(x, eps, least):
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = near.sum(axis=1) >= least
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.where(core, np.where(near & core[None], label[None], len(x)).min(axis=1, initial=len(x)), -1)
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        first = np.flatnonzero(near[i] & core)
        label[i] = label[first[0]] if len(first) else -1
    return core, label


def _points(seed, n, d):
    rng = np.random.default_rng(seed)
    spread = (0.3, 1.0, 3.0)[seed % 3]
    x = rng.normal(0, spread, (n, d)) + rng.integers(0, 4, (n, 1)) * 2.5
    # on a grid many distances are just eps, and many points the same
    return np.round(x, 1) if seed % 2 else x


@pytest.mark.parametrize("d", [1, 2])
@pytest.mark.parametrize("seed", range(12))
def test_clusters_of_one_tile(seed, d):
    x = _points(seed, 30 + 25 * seed, d)
    for eps, least in ((0.3, 4), (0.5, 1), (1.0, 7)):
        core, label = kernels.density_clusters(x, eps, least, np.ones(len(x), bool))
        want = _plain(x, eps, least)
        assert (core == want[0]).all() and (label == want[1]).all()


@pytest.mark.parametrize("seed,tile", [(0, 16), (1, 5), (2, 5), (4, 8), (5, 16)])
def test_tiles_give_the_clusters_of_joins_and_of_enumeration(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(flows, "TILE", tile)
    groups = [_points(seed, 220, 2), _points(seed + 6, 90, 2)]
    rows = [(g, 1000 * g + i, list(map(float, p))) for g, x in enumerate(groups) for i, p in enumerate(x)]
    odd = [(0, 5000, [float("nan"), 0.0]), (0, 5001, [None, 0.0]), (1, 5002, [float("inf"), 0.0]), (None, 5003, [0.0, 0.0])]
    pts = spark.createDataFrame(rows + odd, "grp long, id long, x array<double>")
    want = {1000 * g + i: (1000 * g + int(c) if c >= 0 else -1) for g, x in enumerate(groups) for i, c in enumerate(_plain(x, 0.4, 4)[1])} | {r[1]: -1 for r in odd}
    joined = {r.id: r.cluster for r in flows.dbscan(pts, 0.4, 4, 2, group=["grp"]).collect()} if seed == 0 else want
    monkeypatch.setattr(flows, "JOINED", 0)
    monkeypatch.setattr(flows, "_joined_clusters", None)
    got = flows.dbscan(pts, 0.4, 4, 2, group=["grp"]).collect()
    assert len(got) == len(want)
    assert {r.id: r.cluster for r in got} == want == joined


def test_points_of_one_place_are_never_paired(monkeypatch):
    most, crossed = [0], kernels._crossed

    def counted(*args):
        for k, i, j in crossed(*args):
            most[0] += len(i)
            yield k, i, j

    monkeypatch.setattr(kernels, "_crossed", counted)
    x = np.random.default_rng(0).normal(0, 1.0, (20_000, 2))
    core, label = kernels.density_clusters(x, 1.0, 4, np.ones(len(x), bool))
    assert core.sum() > 19_900 and (label[core] == label[core][0]).all()
    assert most[0] < 20 * len(x)
