"""References pass by groups of queries: nothing is left to merge, what is sent follows from the groups, and single precision decides nothing."""

import numpy as np
import pytest

from manifoldry.operators import knn as N
from manifoldry.operators import pieces as J
from manifoldry.operators import pruned as Q


def frame(spark, x, **more):
    names = ", ".join(f"{n} long" for n in more)
    return spark.createDataFrame([(i, [float(v) for v in r], *(int(m[i]) for m in more.values())) for i, r in enumerate(x)], "id long, x array<double>" + (f", {names}" if names else ""))


def plain(x, y, k, own):
    d = np.zeros((len(x), len(y)))
    for f in range(x.shape[1]):
        d += (x[:, f, None] - y[None, :, f]) ** 2
    if own:
        np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    return at, np.take_along_axis(d, at, axis=1)


def clouds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(700, 5))
    copies = x.copy()
    copies[50:600] = x[3]
    far = x * 1e-3
    far[::2] += 1e5
    return {"noise": x, "copies": copies, "far apart": far, "tiny": x * 1e-25, "huge": x * 1e18, "lattice": np.round(x)}


@pytest.mark.parametrize("kind", sorted(clouds()))
def test_exact_whatever_the_scale(kind, monkeypatch):
    monkeypatch.setattr(N, "ROWS", 64)
    monkeypatch.setattr(N, "COLUMNS", 150)
    monkeypatch.setattr(N, "HITS", 500)
    x = clouds()[kind]
    ids, k = np.arange(len(x)), 6
    at, sq = plain(x, x, k, True)
    i, j, d = N.exact_nearest(x, ids, x, ids, k)
    assert (j.reshape(-1, k) == at).all() and (d.reshape(-1, k) == sq).all()
    # a bound leaves out what lies beyond it, and nothing at it
    i, j, d = N.exact_nearest(x, ids, x, ids, k, sq[:, 2])
    assert all((j[i == a] == at[a][sq[a] <= sq[a, 2]]).all() for a in range(len(x)))


def test_copies_are_thinned():
    x = clouds()["copies"]
    ids = np.arange(len(x))[::-1].copy()
    some = N.thinned(x, ids, 4)
    assert len(some) == 700 - 551 + 4 and sorted(ids[some][(x[some] == x[3]).all(axis=1)]) == sorted(ids[(x == x[3]).all(axis=1)])[:4]


def test_a_query_is_one_task_s(spark):
    x = clouds()["lattice"][:400]
    p = frame(spark, x).repartition(5)
    found = N.knn_join(p, p, 5, exclude_self=True, block_values=200)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    at, _ = plain(x, x, 5, True)
    assert {(r.id, r["rank"]): r.other for r in found.collect()} == {(i, n + 1): int(at[i, n]) for i in range(400) for n in range(5)}


def test_ranks_on_a_lattice(spark):
    x = clouds()["lattice"][:300]
    p = frame(spark, x)
    at, _ = plain(x, x, 299, True)
    pairs = [(i, int(at[i, n])) for i in range(0, 300, 7) for n in (0, 3, 150, 298)]
    got = N.pair_ranks(spark.createDataFrame(pairs, "id long, other long"), p, block_values=200)
    assert {(r.id, r.other): r.r for r in got.collect()} == {(i, o): int(np.flatnonzero(at[i] == o)[0]) + 1 for i, o in pairs}


def test_counts_of_true():
    mask = np.random.default_rng(1).random((5, 5000)) < 0.9
    assert (N.trues(mask) == mask.sum(axis=1)).all() and (N.trues(np.ones((2, 4096), dtype=bool)) == 4096).all()


@pytest.mark.parametrize("values", [10**6, 200])
def test_one_row_a_point_of_a_smaller_piece(spark, values):
    x = clouds()["lattice"][:300]
    rank = np.arange(300) % 7
    p = frame(spark, x, rank=rank)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    d[rank[:, None] <= rank[None]] = np.inf
    rows = J.nearest_of_larger(p.where("rank > 0"), p, values).collect()
    assert sorted((r.id, r.other, r.sq) for r in rows) == [(i, int(d[i].argmin()), float(d[i].min())) for i in range(300) if rank[i]]


def test_visits_send_a_block_to_a_group_once(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=(800, 12))
    p, sent = frame(spark, x), []
    kind, deal = type(p), type(p).repartitionById
    monkeypatch.setattr(kind, "repartitionById", lambda df, n, by: sent.append((n, df.where("role = 1").count())) or deal(df, n, by))
    q = Q.PrunedNeighbours(p, p, 4, exclude_self=True, pivots=60)
    assert q.visited > 0.9
    # a visit a pair of cells would be 3,600
    assert len(sent) == 2 and all(n == 12 and rows <= 12 * 60 for n, rows in sent)
    at, _ = plain(x, x, 4, True)
    assert {(r.id, r["rank"]): r.other for r in q.found.collect()} == {(i, n + 1): int(at[i, n]) for i in range(800) for n in range(4)}


@pytest.mark.parametrize("tile", [7, 10_000])
def test_pairs_within_radii_by_tiles(spark, tile, monkeypatch):
    monkeypatch.setattr(Q, "TILE", tile)
    x = clouds()["lattice"][:200]
    p = frame(spark, x).selectExpr("id", "x", "CASE WHEN id % 3 = 0 THEN 1.5D ELSE 1D END AS r")
    r = np.where(np.arange(200) % 3 == 0, 1.5, 1.0)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    near = (d <= np.maximum(r[:, None], r[None]) ** 2) & ~np.eye(200, dtype=bool)
    assert sorted((e.src, e.dst, e.sq) for e in Q.region_pairs(p).collect()) == [(int(i), int(j), float(d[i, j])) for i, j in zip(*np.nonzero(near))]
