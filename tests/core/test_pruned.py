"""Neighbours with pruning are those without."""

import numpy as np
import pytest

from manifoldry.operators import knn as N
from manifoldry.operators import pruned as Q


def table(spark, x, first=0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")


def rows(df):
    return sorted((r.id, r.rank, r.other, r.sq) for r in df.collect())


@pytest.mark.parametrize("kind", ["clusters", "noise", "ties"])
def test_same_as_without(spark, kind, monkeypatch):
    rng = np.random.default_rng(1)
    x = {"clusters": rng.normal(size=(900, 5)) * 0.1 + rng.random((30, 5))[rng.integers(0, 30, 900)] * 20, "noise": rng.random((400, 16)), "ties": rng.integers(0, 4, (500, 2)).astype(float)}[kind]
    monkeypatch.setattr(Q, "ROWS", 64)
    p = table(spark, x).repartition(3)
    got = Q.PrunedNeighbours(p, p, 7, exclude_self=True)
    assert rows(got.found) == rows(N.knn_join(p, p, 7, exclude_self=True))
    if kind == "clusters":
        assert got.visited < 0.3
    other = table(spark, x[:100] + 0.05, 10**6)
    assert rows(Q.PrunedNeighbours(other, p, 3, pivots=9).found) == rows(N.knn_join(other, p, 3))


def test_few_points(spark):
    p = table(spark, np.arange(6.0)[:, None])
    for k in (1, 5, 9):
        assert rows(Q.PrunedNeighbours(p, p, k, exclude_self=True).found) == rows(N.knn_join(p, p, k, exclude_self=True))
    assert Q.PrunedNeighbours(p, p.limit(0), 3).found.collect() == [] and Q.PrunedNeighbours(p.limit(0), p, 3).found.collect() == []


@pytest.mark.parametrize("pivots", [1, 7, 40])
def test_pairs_within_the_larger_radius(spark, pivots, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(Q, "ROWS", 50)
    x = rng.integers(0, 12, (300, 2)).astype(float)
    r = rng.choice([0.0, 1.0, 2.0, 5.0], 300)
    df = spark.createDataFrame([(i, v.tolist(), float(r[i])) for i, v in enumerate(x)], "id long, x array<double>, r double").repartition(3)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {(i, j, d[i, j]) for i in range(300) for j in range(300) if i != j and d[i, j] <= max(r[i], r[j]) ** 2}
    got = [tuple(v) for v in Q.region_pairs(df, pivots).collect()]
    assert len(got) == len(want) and set(got) == want


def test_graphs_of_many_cells(spark, monkeypatch):
    """As with all pairs, when no table is sent to all tasks."""
    from manifoldry.operators import graph as G

    c = np.random.default_rng(5).random((120, 3))
    cells = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "cell int, c array<double>")
    made = {}
    for few in (2000, 10):
        monkeypatch.setattr(G, "FEW", few)
        for strategy in ("adaptive_per_cell", "knn", "centroid_spacing"):
            radius = G.radii(cells, strategy, 6)
            for kind in ("radial", "gaussian") if strategy == "adaptive_per_cell" else ("tapered",):
                made.setdefault((strategy, kind), []).append(sorted(map(tuple, G.edges(cells, radius, kind).collect())))
    assert all(a == b and a for a, b in made.values())
