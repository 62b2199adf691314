import numpy as np
import pytest
from pyspark.sql import functions as F

from manifoldry.operators import cells as C
from manifoldry.operators import geodesics as D
from manifoldry.operators import knn as N
from manifoldry.operators import points as P
from manifoldry.plans.layout import procrustes
from manifoldry.plans.model import Embedder, fit_chart
from manifoldry.sources import files, synthetic
from manifoldry.streaming import streams


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(np.asarray(x, dtype=float))], "id long, x array<double>")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(0)
    x = np.repeat(rng.random((4, 5)) * 20, 100, axis=0) + rng.normal(0, 0.5, (400, 5))
    return x[rng.permutation(400)]


def test_save_and_load_place_alike(spark, blobs, tmp_path):
    pts = frame(spark, blobs)
    m = Embedder(cells__n_cells=40, landmarks__count="fixed", landmarks__n=6).fit(pts)
    m.save(spark, str(tmp_path / "model"))
    again = Embedder.load(spark, str(tmp_path / "model"))
    a, b = ({r.id: r.z for r in x.transform(pts).collect()} for x in (m, again))
    assert a == b and len(a) == 400 and np.isfinite(list(a.values())).all()
    with pytest.raises(Exception, match="features"):
        m.transform(frame(spark, blobs[:, :3])).collect()


def test_masses_and_passes(spark, blobs):
    pts = frame(spark, np.concatenate([np.full((100, 2), 0.0), np.full((300, 2), 5.0), np.full((600, 2), 9.0)]))
    cells = C.cells_frame(spark, np.array([[0.0, 0], [5, 5], [9, 9], [50, 50]]))
    assigned = C.assign(pts, cells)
    assert [r.mass for r in C.masses(assigned, cells).orderBy("cell").collect()] == [0.1, 0.3, 0.6, 0.0]
    kept = C.without_empty(cells, C.masses(assigned, cells)).orderBy("cell").collect()
    assert [(r.cell, r.old_cell) for r in kept] == [(0, 0), (1, 1), (2, 2)]
    x = frame(spark, blobs)
    start = C.cells_frame(spark, blobs[:8])
    five, made = C.lloyd(x, start, 5)
    c = blobs[:8].copy()
    for _ in range(5):
        near = ((blobs[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([blobs[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(8)])
    assert made == 5 and np.allclose(np.array([r.c for r in five.orderBy("cell").collect()]), c)
    mini = C.minibatch(x, start, 1, 100)
    assert np.isfinite(np.array([r.c for r in mini.collect()])).all()


def test_early_stop_counts_whole_chunks(spark):
    df = spark.range(10_000).select("id", (F.col("id") % 2).cast("int").alias("cell"))
    assert C.enough_points(df, "id", 100, 0.5, 2) == 100
    assert C.enough_points(df, "id", 100, 0.5, 3) == 10_000


def test_child_cells(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(p * 10, 1, 3).tolist(), p) for i, p in enumerate(np.repeat([0, 1, 2, 3], [500, 300, 150, 50]).tolist())]
    pts = spark.createDataFrame(rows, "id long, x array<double>, parent int")
    n = {r.parent: r["count"] for r in C.split(pts, 40, 10).groupBy("parent").count().collect()}
    assert n == {0: 20, 1: 12, 2: 6, 3: 2}


def test_chart_scales_cells_exactly():
    rng = np.random.default_rng(2)
    x, z, cell = [], [], []
    for c in range(3):
        basis = np.linalg.qr(rng.normal(size=(10, 2)))[0]
        u = rng.normal(size=(100, 2))
        x.append(u @ basis.T + c * 50)
        z.append(0.01 * u + [[c, 0]])
        cell += [c] * 100
    x, z, cell = np.concatenate(x), np.concatenate(z), np.array(cell)
    chart = fit_chart(x, cell, z, 3, {"max_points": 256, "fill": 0.6, "origin": "anchor"})
    y = chart.place(x, cell, z)
    for c in range(3):
        on = cell == c
        assert procrustes(y[on], z[on]) < 1e-9
        r = np.sort(np.linalg.norm(y[on] - chart.anchors[c], axis=1))[50]
        assert r == pytest.approx(0.6, rel=0.05)


def test_sources(spark, tmp_path):
    raw = np.arange(60, dtype=np.uint8).reshape(20, 3)
    raw[:12].tofile(tmp_path / "a.bin")
    raw[12:].tofile(tmp_path / "b.bin")
    got = files.fixed_width(spark, str(tmp_path / "*.bin"), 3).orderBy("id").collect()
    assert [r.id for r in got] == list(range(20)) and np.allclose([r.x for r in got], raw / 255)
    split = files.fixed_width(spark, str(tmp_path / "*.bin"), 3, whole=30).orderBy("id").collect()
    assert [(r.id, r.x) for r in split] == [(r.id, r.x) for r in got]
    x = np.arange(46.0).reshape(23, 2)
    assert np.allclose([r.x for r in files.from_chunks(spark, [x[:4], (x[4:13], "y"), x[13:]]).orderBy("id").collect()], x)
    with pytest.raises(TypeError):
        files.from_chunks(spark, iter([x]))
    with pytest.raises(TypeError):
        files.from_chunks(spark, [x[0]])
    with pytest.raises(ValueError):
        files.from_array(spark, x[0])
    with pytest.raises(TypeError):
        P.points(spark.range(3).withColumn("x", F.lit("a")), "id", "x")
    s = np.array([r.x for r in synthetic.half_sphere(spark, 500).collect()])
    assert np.allclose(np.linalg.norm(s, axis=1), 1) and (s[:, 2] >= 0).all()
    for made in (synthetic.swiss_roll, synthetic.swiss_roll_even):
        from manifoldry.functions.arrays import unrolled

        a, b = unrolled(F.col("x"))
        worst = made(spark, 300).select(F.max(F.abs(a - F.col("sheet")[0])), F.max(F.abs(b - F.col("sheet")[1]))).first()
        assert max(worst) < 1e-6


def test_isomap_on_a_line(spark):
    pts = frame(spark, [[i, 0.0] for i in range(30)])
    near = N.knn_join(pts, pts, 2, exclude_self=True)
    d = {(r.source, r.node): r.d for r in D.shortest_from(D.neighbour_graph(near), [0, 29]).collect()}
    assert d[(0, 29)] == pytest.approx(29) and d[(29, 10)] == pytest.approx(19)
    z = {r.id: r.z[0] for r in D.isomap(near, [0, 10, 20, 29], 2).collect()}
    assert np.allclose(np.abs(np.diff([z[i] for i in range(30)])), 1)


def test_swiss_roll_unrolls(spark):
    """Distances in the layout follow those on the true sheet, to the published rank correlation of about 0.97."""
    roll = synthetic.swiss_roll_even(spark, 20_000, 1)
    m = Embedder(graph__k=5, landmarks__count="fixed", landmarks__n=12, embedding__local_chart="none").fit(roll)
    rows = m.transform(roll).where("id < 400").collect()
    z, sheet = np.array([r.z for r in rows]), np.array([r.sheet for r in rows])
    pair = [np.sqrt(((a[:, None] - a[None]) ** 2).sum(axis=2))[np.triu_indices(len(a), 1)] for a in (z, sheet)]
    ranks = [np.argsort(np.argsort(d)) for d in pair]
    assert np.corrcoef(*ranks)[0, 1] > 0.94


def test_streams(spark, blobs, tmp_path):
    pts = frame(spark, blobs)
    pts.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    cells = C.cells_frame(spark, blobs[:8])
    q = streams.running_counts(stream, cells).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.cell: r.n for r in spark.table("counts").collect()} == {r.cell: r["count"] for r in C.assign(pts, cells).groupBy("cell").count().collect()}
    running = streams.RunningCentroids(cells)
    running.start(stream, str(tmp_path / "ck")).awaitTermination(120)
    assert running.n.sum() == 400
    m = Embedder(cells__n_cells=40, landmarks__count="fixed", landmarks__n=6).fit(pts)
    q = m.transform(stream).writeStream.format("memory").queryName("placed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("placed").count() == 400
    q = streams.quota(C.assign(stream, cells), 5).writeStream.format("memory").queryName("quota").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert max(r["count"] for r in spark.table("quota").groupBy("cell").count().collect()) <= 5
