"""t-SNE against the exact sums: perplexities, affinities, the grid's field, the gradient, and how trustworthy the layout is beside a plain numpy version."""

import numpy as np
import pytest

from manifoldry.operators import knn as N
from manifoldry.plans import tsne as T
from test_umap import frame, near, roll, trust

PERPLEXITY = 15.0


def array(df, n, c="z"):
    out = np.full((n, 2), np.nan)
    for r in df.collect():
        out[r.id] = r[c]
    return out


def plain_affinities(x, perplexity, k):
    at, d = near(x, k)
    p = np.zeros((len(x),) * 2)
    for i in range(len(x)):
        lo, hi = 1e-12, 1e12
        for _ in range(300):
            beta = np.sqrt(lo * hi)
            q = np.exp(-beta * (d[i] ** 2 - d[i, 0] ** 2))
            q = q / q.sum()
            entropy = -(q * np.log(np.maximum(q, 1e-300))).sum()
            lo, hi = (beta, hi) if entropy > np.log(perplexity) else (lo, beta)
        p[i, at[i]] = q
    return (p + p.T) / (2 * len(x))


def exact_gradient(y, p, exaggeration=1.0):
    gap = y[:, None] - y[None]
    k = 1 / (1 + (gap**2).sum(axis=2))
    np.fill_diagonal(k, 0)
    return ((exaggeration * p * k - k * k / k.sum())[:, :, None] * gap).sum(axis=1)


def plain_layout(y, p, steps, rate):
    v, gain = np.zeros_like(y), np.ones_like(y)
    for number, exaggeration, momentum in steps:
        for _ in range(number):
            g = exact_gradient(y, p, exaggeration)
            gain = np.maximum(np.where((g > 0) == (v > 0), gain * 0.8, gain + 0.2), 0.01)
            v = momentum * v - rate * gain * g
            y = y + v
    return y


def test_probabilities_have_the_stated_perplexity():
    rng = np.random.default_rng(0)
    sq = np.sort(rng.random((40, 30)), axis=1) * 10.0 ** rng.integers(-6, 6, (40, 1))
    sq[7, 20:] = np.nan
    p = T.precisions(sq, 8.0)
    assert np.allclose(p.sum(axis=1), 1)
    assert np.allclose(-(p * np.log(np.maximum(p, 1e-300))).sum(axis=1), np.log(8))
    assert (p[7, 20:] == 0).all()
    # equal and coincident neighbours, and fewer than the perplexity: all alike, or as even as may be
    assert np.allclose(T.precisions(np.zeros((1, 5)), 3.0), 0.2) and np.allclose(T.precisions(np.array([[1.0, 2.0]]), 9.0), 0.5, atol=1e-6)


def test_affinities_are_the_plain_ones(spark):
    x = roll(300)
    p = frame(spark, x).repartition(3)
    got = np.zeros((300, 300))
    for r in T.affinities(N.knn_join(p, p, 45, exclude_self=True), PERPLEXITY, 300).collect():
        got[r.src, r.dst] = r.w
    assert np.allclose(got, plain_affinities(x, PERPLEXITY, 45), atol=1e-10)
    assert np.isclose(got.sum(), 1)


@pytest.mark.parametrize("extent, within", [(0.01, 1e-3), (3.0, 1e-3), (40.0, 2e-2)])
def test_field_of_the_grid_is_the_sum(extent, within):
    """Few points spread thinly are the hardest case: single pairs a fraction of an interval apart."""
    y = np.random.default_rng(1).normal(size=(400, 2)) * extent
    grid = T.Grid(y.min(axis=0), y.max(axis=0))
    fields, total = grid.field(grid.deposit(y))
    gap = y[:, None] - y[None]
    k = 1 / (1 + (gap**2).sum(axis=2))
    np.fill_diagonal(k, 0)
    want = ((k * k)[:, :, None] * gap).sum(axis=1)
    assert np.isclose(total, k.sum(), rtol=1e-3)
    assert np.linalg.norm(grid.push(y, fields) - want) < within * np.linalg.norm(want)


def test_gradient_on_500_points(spark):
    x = roll(500)
    y = np.random.default_rng(2).normal(size=(500, 2)) * 8
    start = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id long, z array<double>")
    t = T.Tsne(frame(spark, x), PERPLEXITY, steps=(), start=start, blocks=4)
    got = array(t.gradient(), 500, "g")
    want = exact_gradient(y, plain_affinities(x, PERPLEXITY, 45))
    assert np.linalg.norm(got - want) < 1e-3 * np.linalg.norm(want)


def test_any_partitions(spark, monkeypatch):
    x = roll(150)
    p = frame(spark, x)
    steps = ((10, 12.0, 0.5), (10, 2.0, 0.8))
    one, many = (array(T.Tsne(p.repartition(n), steps=steps, blocks=4).placed(), 150) for n in (1, 6))
    assert (one == many).all()
    still = T.Tsne(p, steps=(), blocks=4)
    monkeypatch.setattr(T, "GRIDS", 2)
    # grids added up in the cluster first
    added = T.Tsne(p, steps=(), blocks=4)
    assert np.allclose(added.fields, still.fields, rtol=1e-9) and np.isclose(added.total, still.total, rtol=1e-9)


def test_as_trustworthy_as_the_plain_layout(spark):
    x = roll(600)
    steps = ((60, 12.0, 0.5), (100, 2.0, 0.8))
    t = T.Tsne(frame(spark, x), PERPLEXITY, steps=steps)
    got = array(t.placed(), 600)
    c = x - x.mean(axis=0)
    y = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    plain = plain_layout(y / y[:, 0].std() * 1e-4, plain_affinities(x, PERPLEXITY, 45), steps, 50.0)
    assert trust(x, got) > trust(x, plain) - 0.02


def test_points_that_leave_the_grid_are_pushed_as_at_its_edge():
    y = np.random.default_rng(3).normal(size=(300, 2)) * 1e-4
    grid = T.Grid(y.min(axis=0), y.max(axis=0))
    fields, _ = grid.field(grid.deposit(y))
    edge = grid.low + grid.m * grid.h
    assert np.allclose(grid.push(edge[None] + 50, fields), grid.push(edge[None], fields))
    # and a small layout has room to move
    assert grid.holds(y.min(axis=0) - 5, y.max(axis=0) + 5)


def test_hubs_stay_in_the_layout(spark):
    """Neighbours of noise in many dimensions have hubs; at the rate of a large table one step of theirs used to end far outside, and all others after them."""
    x = np.random.default_rng(4).normal(size=(500, 40))
    t = T.Tsne(frame(spark, x), steps=((12, 12.0, 0.5),), rate=500 / 12 * 5, blocks=2)
    z = array(t.placed(), 500)
    assert np.abs(z).max() < 5
    # grids that are added up by parts, of more blocks than come to the driver
    some = T.Tsne(frame(spark, x), steps=((6, 12.0, 0.5),), blocks=6)
    assert some.blocked.blocks > T.GRIDS and np.isfinite(array(some.placed(), 500)).all()


def test_query_takes_all_steps(spark, monkeypatch):
    """Before: 150 of the default's 750 steps."""
    import inspect

    from manifoldry.plans import registry as R

    whole = inspect.signature(T.Tsne.__init__)
    init, taken = T.Tsne.__init__, []

    def started(self, *args, **kwargs):
        given = whole.bind(self, *args, **kwargs)
        given.apply_defaults()
        taken.append(sum(number for number, *_ in given.arguments["steps"]))
        given.arguments["steps"] = ((3, 12.0, 0.5),)
        init(*given.args, **given.kwargs)

    monkeypatch.setattr(T.Tsne, "__init__", started)
    assert R.QUERIES["tsne_layout"](spark, "/root/testdata/sf0.001").count() == 500 and taken == [750]
