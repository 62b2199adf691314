"""Eigenvectors of tables' graphs against dense ones."""

import numpy as np
import pytest

from manifoldry.operators import knn as N
from manifoldry.operators.geodesics import neighbour_graph
from manifoldry.plans.spectral import best_pair, eigenmaps
from test_umap import frame, roll


def dense(w, k):
    root = np.sqrt(w.sum(axis=1))
    value, vector = np.linalg.eigh(w / root[:, None] / root[None])
    return value[::-1][1 : k + 1], vector[:, ::-1][:, 1 : k + 1]


def array(df, n, k):
    out = np.full((n, k), np.nan)
    for r in df.collect():
        out[r.id] = r.z
    return out


def angle(a, b):
    """The largest angle between two spaces."""
    q, r = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return np.linalg.norm(q - r @ (r.T @ q), 2)


def test_a_ring_whose_eigenvalues_all_come_twice(spark):
    n = 120
    edges = spark.createDataFrame([(i, (i + 1) % n, 1.0) for i in range(n)], "src long, dst long, w double")
    found = eigenmaps(edges, 2, blocks=4, basis=60, tolerance=1e-6)
    assert np.allclose(found.values, np.cos(2 * np.pi / n), atol=1e-9)
    z = array(found.placed(False), n, 2)
    at = 2 * np.pi * np.arange(n) / n
    assert angle(z, np.stack([np.cos(at), np.sin(at)], axis=1)) < 1e-4


def test_neighbour_graph_of_a_roll(spark):
    x = roll(500)
    p = frame(spark, x)
    edges = neighbour_graph(N.knn_join(p, p, 8, exclude_self=True)).selectExpr("src", "dst", "1.0D AS w")
    w = np.zeros((500, 500))
    for r in edges.collect():
        w[r.src, r.dst] = w[r.dst, r.src] = 1
    value, vector = dense(w, 5)
    found = eigenmaps(edges.repartition(5), 4, blocks=4, tolerance=1e-6)
    assert np.allclose(found.values, value[:4], atol=1e-8) and (found.residuals <= 1e-6).all()
    z = array(found.placed(False), 500, 4)
    assert np.allclose(z.T @ z, np.eye(4), atol=1e-8)
    if value[3] - value[4] > 1e-3:
        assert angle(z, vector[:, :4]) < 1e-3
    assert (z.max(axis=0) >= -z.min(axis=0) * (1 - 1e-5)).all()


def test_few_points_and_pieces(spark):
    # two triangles and a pair: eigenvalue 1 three times, and a basis that ends early
    edges = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (6, 7)]
    w = np.zeros((8, 8))
    for a, b in edges:
        w[a, b] = w[b, a] = 1.0
    found = eigenmaps(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src int, dst int, w double"), 3, blocks=2)
    assert np.allclose(found.values, dense(w, 3)[0], atol=1e-8)
    with pytest.raises(ValueError):
        eigenmaps(spark.createDataFrame([(1, 1, 1.0)], "src long, dst long, w double"), 1)


def test_best_pair(spark):
    rng = np.random.default_rng(0)
    truth = rng.random((200, 2))
    rows = lambda *c: spark.createDataFrame([(i, [float(v[i]) for v in c]) for i in range(200)], "id long, z array<double>")
    noise = rng.random(200)
    good = rows(noise, -truth[:, 1], np.exp(truth[:, 0]))
    bad = rows(truth[:, 0], truth[:, 0], noise)
    t = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(truth)], "id long, position double, height double")
    found = best_pair({5: bad, 10: good, 20: bad}, t, 3)
    assert found["neighbours"] == 10 and found["axes"] == (2, 1) and np.isclose(found["weaker"], 1)
