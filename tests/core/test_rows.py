"""Byte rows as a source of batches and streams, pieces that tasks load, and streams with state."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from manifoldry.operators import cells as C
from manifoldry.operators import points as P
from manifoldry.sources import files, rows
from manifoldry.streaming import streams


def x_of(df):
    got = sorted(df.collect())
    assert [r.id for r in got] == list(range(len(got)))
    return np.array([r.x for r in got])


def test_byte_rows_in_parts(spark, tmp_path):
    raw = np.random.default_rng(0).integers(0, 256, (5000, 7), dtype=np.uint8)
    raw[:3000].tofile(tmp_path / "a.bin")
    raw[3000:].tofile(tmp_path / "b.bin")
    (tmp_path / "_hidden").write_bytes(b"1")
    df = rows.byte_rows(spark, str(tmp_path), 7, part=700)
    assert df.rdd.getNumPartitions() == 50
    assert np.allclose(x_of(df), raw / 255)
    assert np.allclose(x_of(rows.byte_rows(spark, f"file://{tmp_path}/a.bin", 7)), raw[:3000] / 255)
    assert np.allclose(x_of(files.fixed_width(spark, f"{tmp_path}/*.bin", 7, whole=15_000)), raw / 255)
    (tmp_path / "c.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="whole rows"):
        rows.byte_rows(spark, str(tmp_path), 7).collect()
    empty = tmp_path / "none"
    empty.mkdir()
    assert rows.byte_rows(spark, str(empty), 7).collect() == []


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    raw = np.random.default_rng(1).integers(0, 256, (900, 3), dtype=np.uint8)
    there = tmp_path / "in"
    there.mkdir()

    def run():
        q = rows.byte_rows(spark, str(there), 3, part=300, stream=True).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()
        return spark.read.parquet(str(tmp_path / "out"))

    raw[:500].tofile(there / "a.bin")
    assert np.allclose(x_of(run()), raw[:500] / 255)
    raw[500:].tofile(there / "b.bin")
    # half a row more: not read yet
    with open(there / "b.bin", "ab") as f:
        f.write(b"x")
    assert np.allclose(x_of(run()), raw / 255)


def test_pieces_that_tasks_load(spark):
    x = np.random.default_rng(2).random((11_000, 2))
    cuts = [0, 10, 10, 9000, 11_000]
    df = rows.from_loaders(spark, 4, lambda k: (x[cuts[k] : cuts[k + 1]], "label") if k % 2 else x[cuts[k] : cuts[k + 1]])
    assert df.rdd.getNumPartitions() == 4 and np.allclose(x_of(df), x)
    with pytest.raises(Exception, match="matrix"):
        rows.from_loaders(spark, 1, lambda k: [1, 2]).collect()
    assert rows.from_loaders(spark, 0, lambda k: x).collect() == []
    assert np.allclose(x_of(files.from_chunks(spark, [x[:4], x[4:4], x[4:900]])), x[:900])


def stream_of(spark, tmp_path, df, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")


def test_reservoir_over_micro_batches_and_restarts(spark, tmp_path):
    ids = spark.range(0, 3000, 1, 6).withColumnRenamed("id", "id")
    stream = stream_of(spark, tmp_path, ids, "in")
    kept = []

    def keep(batch, number):
        kept.extend(tuple(r) for r in batch.collect())

    def run(limit=None):
        q = streams.reservoir(stream, 100, seed=3, parts=4).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    run()
    spark.range(3000, 4000, 1, 2).write.mode("append").parquet(f"{tmp_path}/in")
    # started again: state and place in the stream are kept
    run()
    got = {r.id for r in streams.sample_of(spark.createDataFrame(kept, "part int, seen long, place string, id long"), 100).collect()}
    assert got == {r.id for r in P.uniform_sample(spark.range(4000), 100, 3).collect()}
    assert sum({p: max(s for q, s, *_ in kept if q == p) for p, *_ in kept}.values()) == 4000


def test_places_are_uniform(spark):
    """Over many seeds each id is drawn about equally often."""
    n = np.zeros(60)
    for seed in range(120):
        n[P.hash_places(np.arange(60), seed)[:15]] += 1
    assert abs(n / 120 - 0.25).max() < 0.16 and n.sum() == 120 * 15


def test_quota_and_early_stop(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.random((4000, 1))
    df = spark.createDataFrame([(i, [float(v[0])], int(v[0] > 0.5)) for i, v in enumerate(x)], "id long, x array<double>, cell int").repartition(8)
    stream = stream_of(spark, tmp_path, df, "in")
    q = streams.quota(stream, 5).writeStream.format("memory").queryName("quotas").outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    assert {r.cell: r.n for r in spark.table("quotas").groupBy("cell").agg(F.count("id").alias("n")).collect()} == {0: 5, 1: 5}
    cells = C.cells_frame(spark, np.array([[0.25], [0.75]]))
    every = streams.MassCounts(cells, None)
    assert np.allclose(every.run(stream, str(tmp_path / "c1")), [np.mean(x < 0.5), np.mean(x >= 0.5)], atol=1e-9)
    some = streams.MassCounts(cells, 0.1)
    share = some.run(stream, str(tmp_path / "c2"))
    assert some.enough and 200 <= some.n.sum() < 4000 and abs(share[0] - 0.5) < 0.1
