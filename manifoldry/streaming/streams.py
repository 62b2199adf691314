"""Structured Streaming forms: running masses, running centroids by micro-batch, and placement of a stream."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from manifoldry.operators import cells as C
from manifoldry.operators.points import hash_order


def running_counts(stream: DataFrame, cells: DataFrame) -> DataFrame:
    """(cell, n) of a stream of (id, x), for update or complete mode."""
    return C.assign(stream, cells).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


class RunningCentroids:
    """Mini-batch k-means over micro-batches: each adds its counts and moves centroids to running means.

    With a path, the model after each micro-batch is written there under the batch's number; a stream that is started again goes on from the last batch that its checkpoint knows of,
    and a batch that is tried again starts from the model before it, so each counts once. Without one, the state is this object's alone.
    """

    def __init__(self, cells: DataFrame, seen: np.ndarray | None = None, path: str | None = None):
        self.c = C.centroid_matrix(cells)[1].copy()
        self.n = np.zeros(len(self.c)) if seen is None else np.asarray(seen, dtype=float)
        self.path, self._last = path, -1
        if path is not None:
            self._restore(cells.sparkSession, None)

    def _restore(self, spark, before: int | None) -> None:
        """The latest stored model, or the latest of batches before a number."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [int(x.getPath().getName().removeprefix("batch=")) for x in (fs.listStatus(p) if fs.exists(p) else []) if x.getPath().getName().startswith("batch=")]
        found = [b for b in found if (before is None or b < before) and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/batch={b}/_SUCCESS"))]
        if found:
            rows = spark.read.parquet(f"{self.path}/batch={max(found)}").orderBy("cell").collect()  # the model: a row a cell
            self.c, self.n, self._last = np.array([r.c for r in rows]), np.array([r.n for r in rows]), max(found)

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number <= self._last:  # a batch that is tried again counts once
            return
        spark = batch.sparkSession
        more, s, _ = C.partial_sums(batch, self.c)
        self.n = self.n + more
        self.c = self.c + (s - more[:, None] * self.c) / np.maximum(self.n, 1)[:, None]
        self._last = number
        if self.path is not None:
            rows = [(i, c.tolist(), float(n)) for i, (c, n) in enumerate(zip(self.c, self.n))]
            spark.createDataFrame(rows, "cell int, c array<double>, n double").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(stream: DataFrame, key: str, processor, schema: str, mode: str) -> DataFrame:
    """processor over the rows of each key. State of several kinds needs the store in ROCKS, which is set here for the session's queries that start from now on."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return stream.groupBy(key).transformWithStateInPandas(processor, schema, mode, "none")


def quota(stream: DataFrame, most: int) -> DataFrame:
    """The first `most` rows of each cell that a stream of (cell, id) brings, in append mode."""
    from .state import Quota

    return _with_state(stream.select("cell", "id"), "cell", Quota(most), "cell int, id long", "Append")


def reservoir(stream: DataFrame, n: int, seed: int = 0, parts: int = 8) -> DataFrame:
    """(part, seen, place, id): what a stream of ids keeps as a uniform sample of n, in update mode, each part after each micro-batch that it has rows in.

    A row's place is its seeded hash, and the n least places of all rows are a uniform sample, whatever the micro-batches: the rows fall into parts, each keeps its n least, and the n least of all
    parts are the sample (`sample_of`). It is the same as uniform_sample's of all rows.
    """
    from .state import Reservoir

    placed = stream.select("id", hash_order(F.col("id"), seed).alias("place"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"))
    return _with_state(placed, "part", Reservoir(n), "part int, seen long, place string, id long", "Update")


def sample_of(kept: DataFrame, n: int) -> DataFrame:
    """(id): the sample in all that `reservoir` has brought out so far."""
    last = kept.groupBy("part").agg(F.max("seen").alias("seen"))
    return kept.join(F.broadcast(last), ["part", "seen"]).orderBy("place", "id").limit(n).select("id")


class MassCounts:
    """Counts of a stream's points by cell, until every cell has 1 / rel_error ** 2 of them; for streams in random order. `run` ends the stream then."""

    def __init__(self, cells: DataFrame, rel_error: float | None):
        self.cells, self.need = C.centroid_matrix(cells), None if rel_error is None else int(np.ceil(1 / rel_error**2))
        self.n, self._last = np.zeros(len(self.cells[1]), dtype=np.int64), -1

    @property
    def enough(self) -> bool:
        return self.need is not None and bool((self.n >= self.need).all())

    def __call__(self, batch: DataFrame, number: int) -> None:
        if number > self._last and not self.enough:
            self.n += C.partial_sums(batch, self.cells[1])[0].astype(np.int64)
            self._last = number

    def run(self, stream: DataFrame, checkpoint: str, **trigger) -> np.ndarray:
        """The share of each cell. trigger: as for writeStream.trigger; by default all that is there."""
        query = stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
        while not query.awaitTermination(0.2):
            if self.enough:
                query.stop()
        return self.n / max(1, self.n.sum())
