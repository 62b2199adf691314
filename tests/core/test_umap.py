"""UMAP against a plain numpy version: kernel widths, the fuzzy union, and how trustworthy the layouts are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from manifoldry.operators import blocks as B
from manifoldry.operators import knn as N
from manifoldry.plans import umap as U

K = 15


def roll(n, seed=0):
    rng = np.random.default_rng(seed)
    t = 1.5 * np.pi * (1 + 2 * rng.random(n))
    return np.stack([t * np.cos(t), 21 * rng.random(n), t * np.sin(t)], axis=1)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def near(x, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    return at, np.take_along_axis(d, at, axis=1)


def plain_graph(x, k):
    at, d = near(x, k)
    w = np.zeros((len(x),) * 2)
    for i in range(len(x)):
        rho = d[i].min()
        lo, hi = 1e-9, 1e4
        for _ in range(200):
            s = (lo + hi) / 2
            lo, hi = (s, hi) if np.exp(-np.maximum(0, d[i] - rho) / s).sum() < np.log2(k) else (lo, s)
        w[i, at[i]] = np.exp(-np.maximum(0, d[i] - rho) / s)
    return w + w.T - w * w.T


def plain_layout(x, w, a, b, epochs, seed=0):
    """The same law, edge by edge on all points at once, from the first principal axes."""
    rng = np.random.default_rng(seed)
    c = x - x.mean(axis=0)
    v = np.linalg.svd(c, full_matrices=False)[2][:2]
    y = c @ v.T
    y = y / y[:, 0].std()
    i, j = np.nonzero(w)
    for e in range(epochs):
        on = rng.random(len(i)) < w[i, j]
        U.step(y, i[on], j[on], a, b, 1 - e / epochs, rng)
    return y


def trust(x, y, k=K):
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    rank = np.argsort(np.argsort(d + np.diag(np.full(n, -1.0)), axis=1), axis=1)
    at, _ = near(y, k)
    over = np.maximum(0, np.take_along_axis(rank, at, axis=1) - k).sum()
    return 1 - 2 * over / (n * k * (2 * n - 3 * k - 1))


def array(df, n):
    out = np.full((n, 2), np.nan)
    for r in df.collect():
        out[r.id] = r.z
    return out


def test_curve():
    # the published values for these distances
    assert np.allclose(U.curve(0.1), (1.577, 0.8951), atol=2e-3)
    assert np.allclose(U.curve(0.0), (1.9328, 0.7905), atol=2e-3)
    assert np.allclose(U.curve(0.5), (0.5830, 1.3342), atol=2e-3)


def test_widths_are_roots():
    rng = np.random.default_rng(0)
    sq = np.sort(rng.random((50, 12)), axis=1)
    sq[3, 5:] = np.nan
    sq[4, :2] = 0
    rho, sigma = U.widths(sq)
    there = ~np.isnan(sq)
    sums = np.where(there, np.exp(-np.maximum(0, np.sqrt(sq) - rho[:, None]) / sigma[:, None]), 0).sum(axis=1)
    assert np.allclose(sums, np.log2(there.sum(axis=1)))
    assert rho[4] == np.sqrt(sq[4, 2]) and rho[0] == np.sqrt(sq[0, 0])
    # as many nearest at one distance as the sum allows at most: the bound holds
    assert (U.widths(np.ones((2, 9)))[1] > 0).all() and (U.widths(np.zeros((2, 9)))[1] > 0).all()


def test_graph_is_the_plain_one(spark):
    x = roll(300)
    p = frame(spark, x).repartition(3)
    got = np.zeros((300, 300))
    for r in U.fuzzy_graph(N.knn_join(p, p, K, exclude_self=True)).collect():
        got[r.src, r.dst] = r.w
    assert np.allclose(got, plain_graph(x, K), atol=1e-9)


def test_every_two_blocks_meet_once():
    for g in (2, 6, 10):
        rounds = B.matches(g)
        assert sorted(p for r in rounds for p in r) == [(a, b) for a in range(g) for b in range(a + 1, g)]
        assert all(len({b for p in r for b in p}) == g for r in rounds)


def test_chunks_hold_every_edge_once(spark):
    rng = np.random.default_rng(3)
    ids = rng.choice(10**6, 200, replace=False)
    edges = [(int(ids[a]), int(ids[b]), float(w)) for a, b, w in zip(rng.integers(0, 200, 3000), rng.integers(0, 200, 3000), rng.random(3000))]
    nodes = spark.createDataFrame([(int(i),) for i in ids], "id long")
    g = B.BlockGraph(nodes, spark.createDataFrame([*edges, (-1, int(ids[0]), 1.0)], "src long, dst long, w double"), blocks=4, chunk=50)
    name = {(r.block, r["at"]): r.id for r in g.index.collect()}
    got = []
    for r in g.chunks.collect():
        i, j = (np.frombuffer(bytes(v), dtype=np.int32) for v in (r.i, r.j))
        assert 0 < len(i) <= 50
        got += [(name[r.p, a], name[r.q, b], w) for a, b, w in zip(i.tolist(), j.tolist(), np.frombuffer(bytes(r.w)).tolist())]
    assert sorted(got) == sorted(edges)
    values = spark.createDataFrame([(int(i), [float(i), -1.0]) for i in ids[:150]], "id long, v array<double>")
    back = {r.id: r.z for r in g.rows(g.numbers(values, "v", 2), 2).collect()}
    assert back == {int(i): ([float(i), -1.0] if k < 150 else [0.0, 0.0]) for k, i in enumerate(ids)}


@pytest.mark.parametrize("blocks", [2, 6])
def test_swiss_roll_is_as_trustworthy_as_the_plain_layout(spark, blocks):
    x = roll(700)
    plain = plain_layout(x, plain_graph(x, K), *U.curve(0.1), 200)
    sweeps, epochs = (20, 10) if blocks == 2 else (12, 6)
    got = array(U.Umap(frame(spark, x), n_neighbors=K, sweeps=sweeps, epochs=epochs, blocks=blocks).placed(), 700)
    assert trust(x, got) > trust(x, plain) - 0.02


def test_any_partitions_and_new_points(spark):
    x = roll(200)
    p = frame(spark, x)
    a = U.Umap(p.repartition(1), sweeps=2, epochs=4, blocks=4)
    b = U.Umap(p.repartition(7), sweeps=2, epochs=4, blocks=4)
    za, zb = array(a.placed(), 200), array(b.placed(), 200)
    assert (za == zb).all()
    assert not (za == array(U.Umap(p, sweeps=2, epochs=4, blocks=4, seed=1).placed(), 200)).all()
    # a new point beside a fitted one lands near it, next to the others
    new = array(a.transform(frame(spark, x[:50] + 1e-6)), 50)
    assert np.median(np.linalg.norm(new - za[:50], axis=1)) < np.median(np.linalg.norm(za[:50] - za[50:100], axis=1))


def test_embeddings_are_as_trustworthy_as_the_plain_layout(spark):
    p = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = p.orderBy("id").collect()
    x = np.array([r.x for r in rows])
    plain = plain_layout(x, plain_graph(x, K), *U.curve(0.1), 200)
    z = {r.id: r.z for r in U.Umap(p, n_neighbors=K).placed().collect()}
    got = np.array([z[r.id] for r in rows])
    assert trust(x, got) > trust(x, plain) - 0.02
    layout = U.Umap(p, n_neighbors=K, sweeps=1, epochs=1).placed().select("id", F.col("z").alias("x"))
    assert layout.count() == len(rows)
