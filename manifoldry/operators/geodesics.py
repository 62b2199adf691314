"""Shortest paths over a neighbour graph from given sources, by rounds of relaxation in the cluster; and Landmark Isomap on top."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import BlockGraph, floats, number_of_blocks
from .shared import cut, drop_scratch


def neighbour_graph(neighbours: DataFrame) -> DataFrame:
    """(src, dst, w) both ways, of the union of all points' neighbours (id, rank, other, sq), which are searched for once."""
    one = cut(neighbours.select(F.col("id").alias("src"), F.col("other").alias("dst"), F.sqrt("sq").alias("w")), "neighbours")
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.min("w").alias("w"))


def shortest_from(edges: DataFrame, sources: list[int], blocks: int | None = None) -> DataFrame:
    """(source, node, d): shortest distances from a few sources, rounds of relaxing until none gets shorter. Unreached nodes are absent.

    A round is one job over blocks of nodes: each chunk of edges offers what its changed nodes have become plus the edge, the least for each node and source, and a block takes what is shorter. Edges stay where they were
    written; distances travel, those of a block to the chunks that start there.
    """
    spark, sources = edges.sparkSession, sorted(set(sources))
    n = len(sources)
    # nodes and chunks both read them
    edges = cut(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w")), "edges")
    own = spark.createDataFrame([(s,) for s in sources], "id long")
    nodes = cut(own.union(edges.select("src")).union(edges.select("dst")).distinct(), "nodes")
    # a node takes over an edge that ends in it
    graph = BlockGraph(nodes, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"), blocks or number_of_blocks(nodes.count() * (1 + n // 8)))
    drop_scratch(spark, edges)
    at = {s: k for k, s in enumerate(sources)}
    places: dict[int, list[tuple[int, int]]] = {}
    for r in graph.index.where(F.col("id").isin(sources)).collect():  # a row a source
        places.setdefault(r["block"], []).append((r["at"], at[r["id"]]))
    sizes = graph.sizes

    def state_row(block: int, d: np.ndarray, changed: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([d.tobytes()], pa.binary()), pa.array([changed.tobytes()], pa.binary()), pa.array([int(changed.sum())], pa.int64())], names=["block", "d", "changed", "n"])

    schema = "block int, d binary, changed binary, n long"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                d, changed = np.full((sizes[b], n), np.inf), np.zeros(sizes[b], dtype=bool)
                for i, s in places.get(b, []):
                    d[i, s], changed[i] = 0.0, True
                yield state_row(b, d, changed)

    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                i, j = (np.frombuffer(batch.column(c)[r].as_buffer(), dtype=np.int32) for c in (1, 2))
                on = np.flatnonzero(np.frombuffer(batch.column(5)[r].as_buffer(), dtype=bool)[j])
                if len(on):
                    i = i[on]
                    d = floats(batch.column(4), r, n)[j[on]] + np.frombuffer(batch.column(3)[r].as_buffer())[on, None]
                    first = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([i[first].tobytes()], pa.binary()), pa.array([np.minimum.reduceat(d, first, axis=0).tobytes()], pa.binary())], names=["block", "at", "d"])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = d = old = None
        for batch in batches:
            for r in range(batch.num_rows):
                if not batch.column(1)[r].is_valid:
                    if now is not None:
                        yield state_row(now, d, (d < old).any(axis=1))
                    now, old = batch.column(0)[r].as_py(), floats(batch.column(2), r, n)
                    d = old.copy()
                else:
                    i = np.frombuffer(batch.column(1)[r].as_buffer(), dtype=np.int32)
                    d[i] = np.minimum(d[i], floats(batch.column(2), r, n))
        if now is not None:
            yield state_row(now, d, (d < old).any(axis=1))

    state = cut(graph.index.select("block").distinct().mapInArrow(begin, schema), "round")
    while True:
        ends = state.where("n > 0").select(F.col("block").alias("q"), "d", "changed")
        offered = graph.chunks.join(ends, "q").select("p", "i", "j", "w", "d", "changed").mapInArrow(offer, "block int, at binary, d binary")
        rows = state.select("block", F.lit(None).cast("binary").alias("at"), "d").union(offered)
        new = cut(rows.repartition(graph.blocks, "block").sortWithinPartitions("block", F.col("at").isNotNull()).mapInArrow(take, schema), "round")
        drop_scratch(spark, state)
        state = new
        if not state.agg(F.sum("n")).first()[0]:
            break
    found = graph.rows(state.select("block", F.col("d").alias("y")), n, "d").select(F.col("id").alias("node"), F.posexplode("d").alias("k", "d")).where(F.col("d") < float("inf"))
    return found.select(F.array(*map(F.lit, sources))[F.col("k")].cast("long").alias("source"), "node", "d")


def _placed(distances: DataFrame, landmarks: list[int], far: float, layout) -> DataFrame:
    """(id, z) of (node, source, d) by their distances to the landmarks; a landmark without a distance stands at `far`."""
    per = distances.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("source", "d"))).alias("m"))
    ordered = F.array(*(F.coalesce(F.col("m")[F.lit(s)], F.lit(float(far))) for s in landmarks))
    pull = [F.aggregate(F.zip_with(F.array(*map(F.lit, layout.mean_sq.tolist())), F.zip_with("o", F.array(*map(F.lit, layout.projection[i].tolist())), lambda a, p: F.struct(a.alias("a"), p.alias("p"))), lambda m, e: -0.5 * e["p"] * (e["a"] * e["a"] - m)), F.lit(0.0), lambda s, v: s + v) for i in range(len(layout.projection))]
    return per.select(F.col("node").alias("id"), ordered.alias("o")).select("id", F.array(*pull).alias("z"))


def distances_via(distances: DataFrame, nearest: DataFrame) -> DataFrame:
    """(node, source, d) of new points: over their nearest fitted points (id, other, sq), the shortest way to each source. distances: (source, node, d) of the fitted ones."""
    way = nearest.join(distances.withColumnRenamed("node", "other"), "other")
    return way.groupBy(F.col("id").alias("node"), "source").agg(F.min(F.sqrt("sq") + F.col("d")).alias("d"))


class LandmarkIsomap:
    """Landmark Isomap of k axes: fit to a table of neighbours, place fitted points and new ones."""

    def __init__(self, neighbours: DataFrame, landmarks: list[int], k: int):
        from manifoldry.plans.layout import Layout

        self.landmarks = landmarks
        self.distances = cut(shortest_from(neighbour_graph(neighbours), landmarks), "distances")
        order = {s: i for i, s in enumerate(landmarks)}
        # a landmark that a point can't reach stands as far as the farthest that was reached
        self.far = self.distances.agg(F.max("d")).first()[0] or 0.0
        table = np.full((len(landmarks),) * 2, self.far)
        for r in self.distances.where(F.col("node").isin(landmarks)).collect():  # landmarks x landmarks
            table[order[r.source], order[r.node]] = r.d
        self.layout = Layout.fit((table + table.T) / 2, k, 1e-10)

    def placed(self) -> DataFrame:
        """(id, z) of the fitted points."""
        return _placed(self.distances, self.landmarks, self.far, self.layout)

    def transform(self, nearest: DataFrame) -> DataFrame:
        """(id, z) of new points, from their nearest fitted points (id, rank, other, sq)."""
        return _placed(distances_via(self.distances, nearest), self.landmarks, self.far, self.layout)


def isomap(neighbours: DataFrame, landmarks: list[int], k: int) -> DataFrame:
    """(id, z): Landmark Isomap of k axes."""
    return LandmarkIsomap(neighbours, landmarks, k).placed()
