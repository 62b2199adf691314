"""Identities that don't depend on any library: potentials, landmarks, layout, cells, dimension."""

import numpy as np
import pytest

from manifoldry.operators import cells as C
from manifoldry.operators import graph as G
from manifoldry.operators import knn as N
from manifoldry.plans import layout as L
from manifoldry.plans import potential as V
from manifoldry.plans.settings import settings


def random_graph(n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 2))
    sq = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    w = np.exp(-sq / (2 * 0.1**2))
    np.fill_diagonal(w, 0)
    p = rng.random(n)
    return w, p / p.sum(), x


def test_potentials_are_grounded_means():
    w, p, _ = random_graph()
    for rho in (1e-6, 0.05, 10.0):
        v = V.Conductor(w, p).maps(rho)
        mean = (v * p) @ w / (rho + w @ p)
        off = ~np.eye(len(p), dtype=bool)
        assert np.abs((v - mean)[off]).max() < 1e-9
        assert (np.diag(v) == 1).all() and v.min() >= 0 and v.max() <= 1


def test_greedy_information_equals_the_formula():
    w, p, _ = random_graph(25)
    v = V.Conductor(w, p).maps(0.05)
    v = np.where(v >= 1e-3, v, 0)
    chosen = V.greedy_information(v, p, 3, 0.1)
    for i in range(3):
        direct = [V.information(v[[*chosen[:i], c]], p, 0.1) if c not in chosen[:i] else -np.inf for c in range(25)]
        assert direct[chosen[i]] == pytest.approx(max(direct), abs=1e-9)


def test_ground_is_the_largest_that_reaches():
    w, p, _ = random_graph()
    s = settings(landmarks__count="fixed", landmarks__n=6)
    marks, rho = V.choose_landmarks(w, p, 2.0, s)
    g = V.Conductor(w, p)
    assert len(set(marks.tolist())) == 6
    assert V.reach(g.maps(rho, marks), p, 1e-3, 0.9) >= 6 > V.reach(g.maps(rho * 1.06, marks), p, 1e-3, 0.9)


def test_falling_limit():
    assert V.falling_limit(lambda r: -r, -3.0, (1e-6, 1e6), 1e-6) == pytest.approx(3, rel=1e-5)
    assert V.falling_limit(lambda r: -r, -3.0, (1e-6, 1e6), 1e-6, guess=100) == pytest.approx(3, rel=1e-5)
    assert V.falling_limit(lambda r: 1, 0, (0.5, 2), 0.1) == 2
    assert V.falling_limit(lambda r: -1, 0, (0.5, 2), 0.1) == 0.5


def test_plane_comes_back():
    rng = np.random.default_rng(1)
    x = rng.random((40, 2))
    marks = np.arange(6)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    layout = L.Layout.of_maps(np.exp(-d[marks]), marks, 2, 1e-10)
    z = layout.triangulate(np.exp(-d[:, marks]))
    assert L.procrustes(z, x) < 1e-12
    assert np.abs(np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2)) - d).max() < 1e-9


def test_far_distances_are_chained():
    rng = np.random.default_rng(2)
    d = np.sqrt(((rng.random((12, 1, 2)) * 14 - rng.random((1, 12, 2)) * 14) ** 2).sum(axis=2))
    d = (d + d.T) / 2
    np.fill_diagonal(d, 0)
    known = np.where(d <= 10, d, np.inf)
    direct = known.copy()
    for k in range(12):
        direct = np.minimum(direct, direct[:, k, None] + direct[None, k])
    assert np.abs(L.shortest(known) - direct).max() < 1e-12
    v = np.exp(-d)
    layout = L.Layout.of_maps(v, np.arange(12), 2, np.exp(-10))
    assert np.isfinite(layout.item_distances(v)).all()
    assert layout.item_distances(np.zeros((1, 12))).max() == pytest.approx(10)


def test_pieces_are_joined_by_the_nearest_pair():
    rng = np.random.default_rng(3)
    c = np.concatenate([rng.random((30, 2)), [[10.0, 10.0]]])
    sq = ((c[:, None] - c[None]) ** 2).sum(axis=2)
    w = (sq < 0.3).astype(float)
    np.fill_diagonal(w, 0)
    out = G.connected(w, c)
    assert len(set(G.pieces(out).tolist())) == 1
    assert np.flatnonzero(out[30]).tolist() == [int(sq[30, :30].argmin())] and out[30].max() == 1


def test_allocation():
    assert C.allocate([100, 50, 30, 15, 5, 0], 20) == [10, 5, 3, 1, 1, 0]
    assert C.allocate([3, 1], 4) == [3, 1]
    assert sum(C.allocate([7, 9, 1000, 2], 100)) == 100
    # less than one for each: no floor, and never more than the budget
    assert C.allocate([5, 5, 5], 2) == [1, 1, 0]
    assert C.allocate([1, 0, 9, 2], 2) == [0, 0, 2, 0]


def test_farthest_covers_sparse_parts():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.random((9000, 2)), rng.random((1000, 2)) + 3])
    chosen = C.farthest(x, 50)
    assert 0.4 <= (chosen >= 9000).mean() <= 0.6


@pytest.mark.parametrize("shift", [0, 1000])
def test_kmeans_finds_blobs(shift):
    rng = np.random.default_rng(5)
    centres = rng.random((8, 5)) * 20
    x = np.repeat(centres, 50, axis=0) + rng.normal(0, 0.1, (400, 5)) + shift
    c = C.kmeans(x, 40, 10)
    assert np.sqrt(((centres[:, None] + shift - c[None]) ** 2).sum(axis=2)).min(axis=1).max() < 0.5


@pytest.mark.parametrize("d", [2, 5])
def test_dimension(spark, d):
    rng = np.random.default_rng(d)
    x = rng.random((1500, d)) @ np.linalg.qr(rng.normal(size=(30, d)))[0].T
    pts = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    found = N.mle_dimension(N.knn_join(pts, pts, 20, exclude_self=True), 20).first()[0]
    assert abs(found - d) < 0.25 * d


def test_exact_nearest_ties_and_copies():
    c = np.array([[0.0, 0], [0, 0], [1, 0], [2, 0]])
    i, j, d = N.exact_nearest(c, np.arange(4), c, np.arange(4), 2)
    assert j.reshape(4, 2).tolist() == [[1, 2], [0, 2], [0, 1], [2, 0]]
    assert d[0] == 0


def test_settings_are_checked():
    for bad in ({"cells": {"n_cell": 3}}, {"nothing": 1}):
        with pytest.raises(KeyError):
            settings(bad)
    for name, value in (("cells__n_cells", 0), ("graph__kernel", "flat"), ("landmarks__rho_bounds", [2, 1]), ("landmarks__share", 1.5)):
        with pytest.raises(ValueError):
            settings(**{name: value})
    assert settings({"cells": {"n_cells": 7}}, cells__n_cells=9)["cells"]["n_cells"] == 9


def test_native_assignment_is_exact_and_looks_at_few_differences(spark):
    """Before: each point met every cell feature by feature, which grows with points times cells."""
    from manifoldry.operators import cells as C

    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5)) + 1e4
    c = np.concatenate([x[:40], x[:40], (x[40:80] + x[80:120]) / 2, np.full((1, 5), 1e4)])
    x[130:150] = c[85] + rng.choice([-0.5, 0.5], (20, 5))
    x[399, 0] = np.inf
    pts = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "id long, k string, x array<double>")
    d = np.zeros((len(x), len(c)))
    with np.errstate(invalid="ignore"):
        for f in range(5):
            d += (x[:, f, None] - c[None, :, f]) ** 2
    for some in (c, c[:1]):
        got = C.assign(pts, some, native=True)
        assert got.columns == ["id", "k", "x", "cell", "sq"]
        rows = sorted(got.collect())
        assert [r.cell for r in rows] == d[:, : len(some)].argmin(axis=1).tolist() and [r.sq for r in rows] == d[:, : len(some)].min(axis=1).tolist()
    plan = C.assign(pts, c, native=True)._jdf.queryExecution().optimizedPlan().toString()
    # distances are those of a broadcast cell to a point, not of a list of all cells
    assert "transform(__cells" not in plan and "array_min" not in plan
