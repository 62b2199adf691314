"""The ways taken beyond one broadcast or one task give the same rows as the plain ones, and stored state comes back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from manifoldry.operators import cells as C
from manifoldry.operators import geodesics as D
from manifoldry.operators import knn as N
from manifoldry.operators import metrics as M
from manifoldry.operators import points as P
from manifoldry.plans.layout import aligned, procrustes
from manifoldry.plans.model import Embedder
from manifoldry.sources import files
from manifoldry.streaming import streams


def frame(spark, x, name="x"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"id long, {name} array<double>")


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 4))
    # coincident points, and ties
    x[40:60] = x[3]
    x[100:110] = np.round(x[100:110])
    return x


def plain_nearest(x, y, k, own):
    d = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    out = []
    for i in range(len(x)):
        order = [j for j in sorted(range(len(y)), key=lambda j: (d[i, j], j)) if not (own and i == j)][:k]
        out += [(i, r + 1, j) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("values", [10**6, 600, 64])
def test_knn_in_blocks(spark, cloud, values):
    p = frame(spark, cloud).repartition(3)
    got = N.knn_join(p, p, 7, exclude_self=True, block_values=values).collect()
    assert sorted((r.id, r["rank"], r.other) for r in got) == plain_nearest(cloud, cloud, 7, True)
    few = N.knn_join(p.where("id < 5"), p, 400, block_values=values).collect()
    assert sorted((r.id, r["rank"], r.other) for r in few) == plain_nearest(cloud[:5], cloud, 400, False)
    assert N.knn_join(p, p.where("id < 0"), 3, block_values=values).count() == 0
    assert N.knn_join(p.where("id < 0"), p, 3, block_values=values).count() == 0


@pytest.mark.parametrize("values", [10**6, 600])
def test_ranks_of_pairs(spark, cloud, values):
    p = frame(spark, cloud).repartition(3)
    rng = np.random.default_rng(1)
    pairs = {(int(i), int(j)) for i, j in rng.integers(0, 300, (500, 2)) if i != j} | {(3, 45), (45, 3), (50, 51)}
    truth = {(i, j): r for i, r, j in plain_nearest(cloud, cloud, 300, True)}
    got = N.pair_ranks(spark.createDataFrame(list(pairs), "id long, other long"), p, block_values=values).collect()
    assert {(r.id, r.other): r.r for r in got} == {x: truth[x] for x in pairs} and len(got) == len(pairs)


def test_trustworthiness_of_a_layout(spark, cloud):
    p, z = frame(spark, cloud), frame(spark, cloud[:, :2])
    n, k = 300, 6
    near = plain_nearest(cloud[:, :2], cloud[:, :2], k, True)
    rank = {(i, j): r for i, r, j in plain_nearest(cloud, cloud, n, True)}
    expected = 1 - sum(max(0, rank[(i, j)] - k) for i, _, j in near) * 2 / (n * k * (2 * n - 3 * k - 1))
    q = M.quality(p, z, p.select("id", (F.col("id") % 3).alias("label")), k, k, sample=None).first()
    assert q.trustworthiness == pytest.approx(expected, abs=1e-9)
    some = M.quality(p, z, None, 4, 4, sample=100, seed=5)
    assert set(some.columns) == {"trustworthiness", "continuity", "density_preservation", "density_slope"} and 0 < some.first().continuity <= 1


def test_order_statistics(spark):
    rng = np.random.default_rng(2)
    rows = [(("a", "b", "c")[i % 3], float(v) if i % 11 else None) for i, v in enumerate(np.round(rng.normal(size=2000), 2))] + [("one", 5.0), ("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r.q for r in M.quantiles(df, "v", [0.0, 0.005, 0.5, 0.9, 1.0], ["g"]).collect()}
    for g in ("a", "b", "c", "one", "two"):
        assert np.allclose(got[g], np.quantile([v for x, v in rows if x == g and v is not None], [0.0, 0.005, 0.5, 0.9, 1.0]))
    assert "none" not in got
    assert np.allclose(M.quantiles(df, "v", [0.25]).first().q, np.quantile([v for _, v in rows if v is not None], 0.25))
    assert M.quantiles(df.where("v > 100"), "v", [0.5]).count() == 0
    counts = {(r.g, r.v): (r.n, r.before) for r in M.ordered_counts(df.where("v is not null"), "v", ["g"]).collect()}
    a = sorted(v for x, v in rows if x == "a" and v is not None)
    assert all(counts[("a", v)] == (a.count(v), sum(w < v for w in a)) for v in set(a))
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(9)], "a double, b double")
    assert M.rank_correlation(flat, "a", "b").first()[0] is None
    assert M.rank_correlation(flat.select("b", (-F.col("b")).alias("c")), "b", "c").first()[0] == pytest.approx(-1)
    assert M.rank_correlation(flat.withColumn("a", F.lit(float("nan"))), "a", "b").first()[0] is None


def test_shuffle_and_fingerprint(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    one, two = P.shuffled(df, 3), P.shuffled(df.repartition(9), 3)
    order = [r.id for r in one.orderBy("number").collect()]
    assert order == [r.id for r in two.orderBy("number").collect()] and sorted(order) == list(range(500)) and order != list(range(500))
    assert [r.number for r in one.orderBy("number").collect()] == list(range(500))
    digest = lambda rows, schema="a int, b string": tuple(P.fingerprint(spark.createDataFrame(rows, schema)).first())
    assert digest([(1, "x"), (1, "x"), (2, "y")]) != digest([(9, "z"), (9, "z"), (2, "y")])
    assert digest([(1, None)], "a int, b string") != digest([(1, None)], "a int, c string") and digest([(1, "x"), (2, "y")]) == digest([(2, "y"), (1, "x")])
    assert digest([])[0] == 0


def test_minibatch_is_a_running_mean(spark, cloud):
    start, ids = cloud[:6].copy(), np.arange(300) * 10
    p = spark.createDataFrame([(int(i), r.tolist()) for i, r in zip(ids, cloud)], "id long, x array<double>")
    near = lambda x, c: ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    c, n = start.copy(), np.bincount(near(cloud[:50], start), minlength=6).astype(float)
    for step in range(2):
        for lo in range(0, 300, 70):
            some = cloud[max(lo, 0 if step else 50) : lo + 70]
            j = near(some, c)
            more = np.bincount(j, minlength=6)
            s = np.array([some[j == i].sum(axis=0) for i in range(6)])
            n += more
            c += (s - more[:, None] * c) / np.maximum(n, 1)[:, None]
    got = C.minibatch(p.repartition(4), C.cells_frame(spark, start), 2, 70, sample=p.where("id < 500"), skip=500).orderBy("cell").collect()
    assert np.allclose([r.c for r in got], c)


def test_parents_of_any_size_split_alike(spark, cloud):
    p = frame(spark, cloud).withColumn("parent", F.when(F.col("id") < 180, 0).when(F.col("id") < 280, 1).otherwise(2))
    order = [r.id for r in p.orderBy(P.hash_order(F.col("id"), 4), "id").collect()]
    plain = {}
    for parent, k in zip((0, 1, 2), C.allocate([180, 100, 20], 24)):
        x = cloud[[i for i in order if (i >= 180) + (i >= 280) == parent]]
        c = x[:k].copy()
        for _ in range(6):
            j = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            c = np.array([x[j == i].mean(axis=0) if (j == i).any() else c[i] for i in range(k)])
        plain |= {(parent, i): v for i, v in enumerate(c)}
    for most in (10**6, 300, 0):
        got = {(r.parent, r.child): r.c for r in C.split(p.repartition(3), 24, 10, 6, seed=4, most=most).collect()}
        assert set(got) == set(plain) and all(np.allclose(got[x], plain[x]) for x in plain)


@pytest.mark.parametrize("init", ["random", "spread"])
def test_library_kmeans_is_a_fixed_point(spark, cloud, init):
    c = np.array([r.c for r in C.table_kmeans(frame(spark, cloud), 5, init, max_iter=60, tol=1e-9).orderBy("cell").collect()])
    j = ((cloud[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(c, [cloud[j == i].mean(axis=0) for i in range(5)], atol=1e-6)


def test_spread_start_finds_every_blob(spark):
    rng = np.random.default_rng(8)
    centres = rng.random((12, 3)) * 100
    # one blob holds two thirds of all points
    x = np.concatenate([centres[rng.integers(0, 12, 300)], np.repeat(centres[:1], 600, axis=0)]) + rng.normal(size=(900, 3)) * 0.1
    c = np.array([r.c for r in C.table_kmeans(frame(spark, x), 12, "spread").collect()])
    assert np.sqrt(((centres[:, None] - c[None]) ** 2).sum(axis=2)).min(axis=1).max() < 0.2
    # no more points than cells, and repeated ones
    assert len(C.table_kmeans(frame(spark, x[:4]), 9, "spread").collect()) <= 9
    same = C.table_kmeans(frame(spark, np.ones((20, 2))), 3, "spread").collect()
    assert len(same) == 3 and all(r.c == [1.0, 1.0] for r in same)


def test_geodesics_by_plain_relaxing(spark, cloud):
    near = N.knn_join(frame(spark, cloud), frame(spark, cloud), 5, exclude_self=True)
    d = np.full((300, 300), np.inf)
    np.fill_diagonal(d, 0)
    for i, _, j in plain_nearest(cloud, cloud, 5, True):
        d[i, j] = d[j, i] = min(d[i, j], np.linalg.norm(cloud[i] - cloud[j]))
    for k in range(300):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    got = {(r.source, r.node): r.d for r in D.shortest_from(D.neighbour_graph(near), [0, 7, 250]).collect()}
    assert set(got) == {(s, int(j)) for s in (0, 7, 250) for j in np.flatnonzero(np.isfinite(d[s]))}
    assert all(abs(v - d[s, j]) < 1e-9 for (s, j), v in got.items())


def test_isomap_places_new_points(spark):
    old, new = frame(spark, [[2 * i, 0.0] for i in range(15)]), spark.createDataFrame([(100 + i, [2.0 * i + 1, 0.0]) for i in range(14)], "id long, x array<double>")
    m = D.LandmarkIsomap(N.knn_join(old, old, 2, exclude_self=True), [0, 5, 14], 2)
    fitted = {r.id: r.z[0] for r in m.placed().collect()}
    placed = {r.id: r.z[0] for r in m.transform(N.knn_join(new, old, 2)).collect()}
    sign = np.sign(fitted[14] - fitted[0])
    assert all(sign * (placed[100 + i] - fitted[i]) == pytest.approx(1, abs=0.35) for i in range(14))


def test_layout_scores_by_numpy(spark, cloud):
    rng = np.random.default_rng(3)
    a, b = cloud[:, :3], cloud[:, :3] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] * 2 + 5 + 0.1 * rng.normal(size=(300, 3))
    one, two = frame(spark, a, "z"), frame(spark, b, "z")
    assert M.disparity(one, two, 3).first()[0] == pytest.approx(procrustes(a, b), abs=1e-9)
    got = np.array([r.z for r in M.align(one, two, 3).orderBy("id").collect()])
    assert np.allclose(got, aligned(a, b)) and np.abs(got - b).mean() < 0.2


def test_charts_on_demand_are_stored(spark, cloud, tmp_path):
    p = frame(spark, cloud)
    m = Embedder(cells__n_cells=20, landmarks__count="fixed", landmarks__n=5, embedding__local_chart="none").fit(p)
    path = str(tmp_path / "model")
    m.fit_charts(p).save(spark, path)
    again = Embedder.load(spark, path)
    a, b = ({r.id: r.z for r in x.transform(p, chart=True).collect()} for x in (m, again))
    assert again.region.chart is not None and a == b and np.isfinite(list(a.values())).all()
    assert a != {r.id: r.z for r in m.transform(p).collect()}
    size = Embedder.stored_bytes(spark, path)
    m.region.chart = None
    m.save(spark, path)
    assert Embedder.load(spark, path).region.chart is None and 0 < Embedder.stored_bytes(spark, path) < size
    marks = m.landmark_positions(spark).collect()
    cells = spark.createDataFrame([(i, m.region.centroids[r.cell].tolist()) for i, r in enumerate(marks)], "id long, x array<double>")
    assert [r.z for r in marks] == [r.z for r in m.transform(cells).orderBy("id").collect()]


def test_stream_goes_on_after_a_restart(spark, cloud, tmp_path):
    p, cells = frame(spark, cloud), C.cells_frame(spark, cloud[:5])
    p.where("id < 150").write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    state, check = str(tmp_path / "state"), str(tmp_path / "check")
    streams.RunningCentroids(cells, path=state).start(read(), check).awaitTermination(120)
    p.where("id >= 150").write.mode("append").parquet(str(tmp_path / "in"))
    second = streams.RunningCentroids(cells, path=state)
    assert second.n.sum() == 150
    second.start(read(), check).awaitTermination(120)
    assert second.n.sum() == 300
    expected = C.minibatch(p, cells, 1, 150).orderBy("cell").collect()
    assert np.allclose(second.c, [r.c for r in expected])
    second(p, second._last)
    assert second.n.sum() == 300


def test_libsvm_csv_and_regions(spark, tmp_path):
    (tmp_path / "a.svm").write_text("".join(f"{i % 3} 1:{i} 3:{i / 2}\n" for i in range(20)))
    got = files.libsvm(spark, str(tmp_path / "a.svm"), 3).collect()
    assert sorted((r.id, r.label, tuple(r.x)) for r in got) == [(i, i % 3, (i, 0.0, i / 2)) for i in range(20)]
    (tmp_path / "a.csv").write_text("k,a,b\n" + "".join(f"{i},{i / 4},{-i}\n" for i in range(9)))
    assert sorted((r.id, tuple(r.x)) for r in files.csv(spark, str(tmp_path / "a.csv"), "k", ["a", "b"]).collect()) == [(i, (i / 4, -i)) for i in range(9)]
    df = spark.range(30).withColumn("region", (F.col("id") % 3).cast("int"))
    files.write_regions(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(x.name for x in (tmp_path / "out").iterdir() if x.is_dir()) == [f"region={i}" for i in range(3)]
    assert sorted(map(tuple, back.select("id", "region").collect())) == [(i, i % 3) for i in range(30)]


def test_region_tree(spark, tmp_path):
    from manifoldry.plans.tree import RegionTree

    rng = np.random.default_rng(6)
    x = np.repeat(rng.random((5, 3)) * 30, 200, axis=0) + rng.normal(0, 1, (1000, 3))
    p = frame(spark, x).repartition(4)
    tree = RegionTree.fit(p, 2, min_points=60, cells__n_cells=60, landmarks__count="fixed", landmarks__n=4, dimension__strategy="fixed", dimension__d=3.0)
    assert len(tree.regions(0)) == 1 and 2 <= len(tree.regions(1)) <= 4 and all(r.path[:1] in tree.by_path for r in tree.regions(2))
    routed = {r.id: tuple(r.path) for r in tree.route(p, 1).collect()}
    root = tree.by_path[()]
    near = ((x[:, None] - root.centroids[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert routed == {i: (int(root.maps[:, near[i]].argmax()),) for i in range(1000)}
    placed = {r.id: (tuple(r.path), tuple(r.z)) for r in tree.transform(p, 2).collect()}
    assert all(np.isfinite(z).all() for _, z in placed.values()) and {q for q, _ in placed.values()} <= set(tree.by_path)
    tree.save(spark, str(tmp_path / "tree"))
    again = RegionTree.load(spark, str(tmp_path / "tree"), tree.settings)
    assert {r.id: (tuple(r.path), tuple(r.z)) for r in again.transform(p, 2).collect()} == placed


def test_laplacian_eigenmaps_of_a_ring(spark):
    from manifoldry.plans.spectral import laplacian_eigenmaps

    n = 40
    edges = spark.createDataFrame([(i, (i + 1) % n, 1.0) for i in range(n)], "src int, dst int, w double")
    z = np.array([r.z for r in laplacian_eigenmaps(edges, 2).orderBy("id").collect()])
    # a ring is laid out as a circle, in order
    r = np.linalg.norm(z, axis=1)
    turn = np.diff(np.unwrap(np.arctan2(z[:, 1], z[:, 0])))
    assert np.allclose(r, r[0]) and np.allclose(np.abs(turn), 2 * np.pi / n)


def test_coarse_graining_keeps_distances(spark):
    from manifoldry.plans.coarse import CoarseGraining
    from manifoldry.plans.potential import Conductor

    x = np.random.default_rng(7).random((600, 2))
    fine = CoarseGraining(frame(spark, x), 150, 6, rel_tolerance=0.1, blocks=4)
    # the points' graph is the dense one, and its leak the largest that reaches half the points
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.isclose(fine.radius, np.median(np.sort(d, axis=1)[:, 40]))
    near = (d <= fine.radius).astype(float)
    np.fill_diagonal(near, 0)
    whole = Conductor(near, np.full(600, 1 / 600))
    truth = {r.id: r.t for r in fine.truth.collect()}
    assert np.allclose([truth[i] for i in range(600)], whole.maps(fine.rho, np.array(fine.landmarks)).T, atol=1e-6)
    share = lambda rho: np.median((whole.maps(rho, np.array(fine.landmarks)) >= 1e-3).mean(axis=1))
    assert share(fine.rho) >= 0.5 > share(fine.rho * 1.11)
    good = fine.score()
    assert good["rank_correlation"] > 0.95 and good["reached_share"] > 0.9 and good["median_relative_error"] < 0.5
    rough = CoarseGraining(frame(spark, x), 20, 6, rel_tolerance=0.5).score("farthest", "uniform")
    assert rough["rank_correlation"] < good["rank_correlation"]


def test_falling_limit_from_any_guess():
    from manifoldry.plans.potential import falling_limit

    for limit in (1e-9, 3e-4, 0.5, 77.0, 1e6):
        for guess in (None, 1e-12, 1e-3, 0.4, 80.0, 1e9):
            calls = []
            got = falling_limit(lambda r: calls.append(r) or -r, -limit, (1e-8, 1e3), 0.01, guess)
            assert got == pytest.approx(min(max(limit, 1e-8), 1e3), rel=0.0101) and (got <= limit * (1 + 1e-9) or got == 1e-8)
            assert len(calls) == len(set(calls)) <= 30


def test_regions_are_fitted_as_alone(spark, cloud):
    from manifoldry.plans.model import fit_local, fit_regions
    from manifoldry.plans.settings import settings

    s = settings(cells__n_cells=15, landmarks__count="fixed", landmarks__n=4, dimension__strategy="fixed", dimension__d=3.0)
    p = frame(spark, cloud).withColumn("region", F.when(F.col("id") < 180, 0).when(F.col("id") < 298, 1).otherwise(2))
    got = {r.id: r.z for r in fit_regions(p.repartition(3), s).collect()}
    assert set(got) == set(range(298))
    for lo, hi in ((0, 180), (180, 298)):
        z = fit_local(cloud[lo:hi], s).place(cloud[lo:hi], s, s["embedding"]["local_chart"] != "none")
        assert np.allclose([got[i] for i in range(lo, hi)], z)


def test_placement_by_plain_means(spark, cloud):
    """Fitted potentials spread to points by weighted means of their nearest cells, then distances by landmark triangulation."""
    m = Embedder(cells__n_cells=25, landmarks__count="fixed", landmarks__n=5, embedding__local_chart="none").fit(frame(spark, cloud))
    r, e = m.region, m.settings["extension"]
    placed = {x.id: x.z for x in m.transform(frame(spark, cloud)).collect()}
    for i in range(0, 300, 17):
        d = ((cloud[i] - r.centroids) ** 2).sum(axis=1)
        near = np.argsort(d, kind="stable")[: e["k"]]
        excess = d[near] - d[near[0]]
        w = np.exp(-e["sharpness"] * excess / (2 * (excess.mean() or 1))) * r.masses[near]
        v = (w[:, None] * r.maps.T[near]).sum(axis=0) / (w.sum() + (r.rho if e["strategy"] == "grounded" else 0))
        dist = np.where(v >= r.layout.floor, -np.log(np.maximum(v, r.layout.floor)), np.inf)
        via = np.min(np.where(np.isfinite(dist), dist, np.inf)[:, None] + r.layout.distances, axis=0)
        dist = np.where(np.isfinite(dist), dist, via)
        assert np.allclose(placed[i], -0.5 * (dist**2 - r.layout.mean_sq) @ r.layout.projection.T, atol=1e-7)


@pytest.mark.parametrize("strategy", ["adaptive_per_cell", "knn", "centroid_spacing", "point_knn"])
def test_graphs_in_memory_equal_tables(spark, cloud, strategy):
    from manifoldry.operators import graph as G
    from manifoldry.plans.model import graph_kernel
    from manifoldry.plans.settings import settings

    c, x = cloud[5:45] + 0.0, cloud[150:200]
    cells = C.cells_frame(spark, c)
    near = N.knn_join(frame(spark, x), frame(spark, c), 4)
    radius = G.radii(cells, strategy, 4, 2.0, near)
    sq = sum((c[:, f, None] - c[None, :, f]) ** 2 for f in range(4))
    last = np.sort(((x[:, None] - c[None]) ** 2).sum(axis=2), axis=1)[:, 3]
    mine = G.sq_radii(sq, strategy, 4, 2.0, last)
    assert np.allclose([r.sq_radius for r in radius.orderBy("cell").collect()], mine)
    for kernel in ("radial", "tapered", "gaussian"):
        s = settings(graph__kernel=kernel)
        w, _ = G.dense(G.edges(cells, radius, kernel, s["graph"]["sigma"], s["graph"]["cutoff"]), len(c))
        v = graph_kernel(sq, np.maximum(mine[:, None], mine[None]), s)
        np.fill_diagonal(v, 0)
        assert np.allclose(w, v)
    k = frame(spark, x)
    assert N.dimension_of(x, 6) == pytest.approx(N.mle_dimension(N.knn_join(k, k, 6, exclude_self=True), 6).first()[0])
    ids = np.array([3, 10, 2, 77, 41])
    assert ids[P.hash_places(ids, 9)].tolist() == [r.id for r in spark.createDataFrame([(int(i),) for i in ids], "id long").orderBy(P.hash_order(F.col("id"), 9), "id").collect()]


def test_pieces_are_joined_by_the_edges_of_all_differences():
    from manifoldry.operators import graph as G

    rng = np.random.default_rng(11)
    for _ in range(300):
        n, d = int(rng.integers(2, 30)), int(rng.integers(1, 4))
        c = rng.integers(0, 12, (n, d)).astype(float) if rng.random() < 0.5 else rng.random((n, d))
        w = np.triu(rng.random((n, n)) < 0.04, 1).astype(float)
        w = w + w.T
        label = G.pieces(w)
        names, sizes = np.unique(label, return_counts=True)
        order = names[np.argsort(-sizes, kind="stable")]
        want, main = w.copy(), label == order[0]
        for name in order[1:]:
            inside, outside = np.flatnonzero(label == name), np.flatnonzero(main)
            sq = ((c[inside, None] - c[None, outside]) ** 2).sum(axis=2)
            i, j = np.unravel_index(int(sq.argmin()), sq.shape)
            want[inside[i], outside[j]] = want[outside[j], inside[i]] = 1.0
            main[inside] = True
        assert (G.connected(w, c) == want).all()


def test_shapes_of_layouts(spark):
    from manifoldry.operators import metrics as M

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    x[:, 2] = np.abs(x[:, 2])
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    layout = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x @ turn * 3 + 7)], "id long, z array<double>")
    r = M.shape(frame(spark, x), layout).first()
    assert abs(r.disparity) < 1e-9 and r.height == pytest.approx(1)
    flat = np.array([r.z for r in M.unfolded(frame(spark, x)).orderBy("id").collect()])
    assert np.allclose(np.linalg.norm(flat, axis=1), np.arccos(x[:, 2])) and np.allclose(np.arctan2(flat[:, 1], flat[:, 0]), np.arctan2(x[:, 1], x[:, 0]))
    s = np.linalg.svd(flat - flat.mean(axis=0), compute_uv=False)
    plane = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(flat)], "id long, z array<double>")
    assert M.aspect(plane).first().aspect == pytest.approx(s[1] / s[0])


def test_cover_of_a_table(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.random((1500, 2)), rng.random((300, 2)) * 0.01 + 5, [[50.0, 50.0]]])
    p = frame(spark, x)
    for parts in (1, 5):
        got, bound = C.farthest_cover(p.repartition(parts), 20, rows=150)
        at = [r.id for r in got.orderBy("step").collect()]
        assert len(set(at)) == 20 and 1800 in at
        radius = np.sqrt(((x[:, None] - x[at][None]) ** 2).sum(axis=2)).min(axis=1).max()
        plain = x[C.farthest(x, 20)]
        assert radius <= bound
        # the sequential choice is no better than the least radius, and two levels no worse than four times that
        assert bound <= 4 * np.sqrt(((x[:, None] - plain[None]) ** 2).sum(axis=2)).min(axis=1).max()
        if parts > 1:
            assert at == before
        before = at
    # one block: the sequential choice itself
    assert [r.id for r in C.farthest_cover(p, 20)[0].orderBy("step").collect()] == C.farthest(x, 20).tolist()
    assert C.farthest_cover(p.limit(0), 3)[0].collect() == [] and len(C.farthest_cover(p.limit(2), 3)[0].collect()) == 2
