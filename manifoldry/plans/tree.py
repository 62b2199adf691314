"""Regions inside regions: each landmark's basin of a fitted region is a region of its own, fitted from its own points, and so on down."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from manifoldry.operators import knn as N
from manifoldry.operators import points as P

from .layout import Layout
from .model import Chart, Embedder, Region, fit_local

_CHART = ("anchors", "bases", "centres", "turns", "scales", "valid")


def packed(r: Region) -> bytes:
    """A region's model tables as one compressed archive."""
    out = {"dimension": r.dimension, "centroids": r.centroids, "masses": r.masses, "sq_radius": r.sq_radius, "rho": r.rho, "landmarks": r.landmarks, "maps": r.maps,
           "distances": r.layout.distances, "mean_sq": r.layout.mean_sq, "projection": r.layout.projection, "floor": r.layout.floor}
    if r.chart is not None:
        out |= {f"chart_{c}": getattr(r.chart, c) for c in _CHART} | {"chart_origin": r.chart.origin}
    sink = io.BytesIO()
    np.savez_compressed(sink, **out)
    return sink.getvalue()


def unpacked(raw: bytes, path: tuple[int, ...]) -> Region:
    with np.load(io.BytesIO(raw), allow_pickle=False) as t:
        chart = Chart(*(t[f"chart_{c}"] for c in _CHART), str(t["chart_origin"])) if "chart_origin" in t else None
        layout = Layout(t["distances"], t["mean_sq"], t["projection"], float(t["floor"]))
        return Region(path, float(t["dimension"]), t["centroids"], t["masses"], t["sq_radius"], float(t["rho"]), t["landmarks"], t["maps"], layout, chart)


class RegionTree:
    """A root region and its children by path: (), (landmark,), (landmark, landmark), and so on. A region of under min_points points has no model, and its points stay with its parent's."""

    def __init__(self, settings: dict, regions: dict[tuple[int, ...], Region]):
        self.settings, self.by_path = settings, regions

    @classmethod
    def fit(cls, df: DataFrame, depth: int, id_col: str = "id", x_col: str = "x", min_points: int = 50, **over) -> RegionTree:
        """Levels 0 to depth. The root is fitted from all points; regions of one level side by side, each in one task."""
        root = Embedder(**over).fit(df, id_col, x_col)
        tree = cls(root.settings, {(): root.region})
        pts = P.points(df, id_col, x_col)
        for level in range(1, depth + 1):
            routed = tree.route(pts, level).where(F.size("path") == level)
            enough = routed.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points).select("path")
            settings = tree.settings

            def run(key: tuple, table: pa.Table) -> pa.Table:
                table = table.sort_by("id")
                r = fit_local(N.matrix(table.column("x").combine_chunks()), settings)  # noqa: B023
                return pa.table({"path": pa.array([key[0].as_py()], pa.list_(pa.int32())), "model": pa.array([packed(r)], pa.binary())})

            # a row a region, each of some hundred cells
            for row in routed.join(enough, "path", "left_semi").groupBy("path").applyInArrow(run, "path array<int>, model binary").collect():
                tree.by_path[tuple(row.path)] = unpacked(row.model, tuple(row.path))
        return tree

    def regions(self, depth: int) -> list[Region]:
        """The regions at a depth, in order of their paths."""
        return [self.by_path[p] for p in sorted(self.by_path) if len(p) == depth]

    def _walk(self, x: np.ndarray, depth: int) -> list[tuple[tuple[int, ...], np.ndarray]]:
        """(path, rows): where rows end that go down by basins, up to depth steps and as long as the region they are in has a model."""
        here, ends = [((), np.arange(len(x)))], []
        while here:
            path, rows = here.pop()
            region = self.by_path.get(path)
            if region is None or len(path) == depth:
                ends.append((path, rows))
                continue
            _, cell, _ = N.exact_nearest(x[rows], None, region.centroids, np.arange(len(region.centroids)), 1)
            basin = region.maps.argmax(axis=0)[cell]
            here += [((*path, int(b)), rows[basin == b]) for b in np.unique(basin)]
        return ends

    def route(self, pts: DataFrame, depth: int) -> DataFrame:
        """(id, x, path) of (id, x): the basins a point lies in, from the root down, at most depth of them."""
        shared = pts.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths: list = [None] * batch.num_rows
                for path, rows in shared.value._walk(N.matrix(batch.column(1)), depth):
                    for i in rows.tolist():
                        paths[i] = list(path)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(paths, pa.list_(pa.int32()))], names=["id", "x", "path"])

        return pts.select("id", "x").mapInArrow(run, "id long, x array<double>, path array<int>")

    def transform(self, pts: DataFrame, depth: int) -> DataFrame:
        """(id, path, z): points placed in the coordinates of the deepest region with a model on their way, at most depth steps down; path is that region's."""
        shared = pts.sparkSession.sparkContext.broadcast(self)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tree, x = shared.value, N.matrix(batch.column(1))
                paths, z = [None] * len(x), [None] * len(x)
                for path, rows in tree._walk(x, depth):
                    while path not in tree.by_path:
                        path = path[:-1]
                    placed = tree.by_path[path].place(x[rows], tree.settings, tree.settings["embedding"]["local_chart"] != "none")
                    for i, y in zip(rows.tolist(), placed.tolist()):
                        paths[i], z[i] = list(path), y
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(paths, pa.list_(pa.int32())), pa.array(z, pa.list_(pa.float64()))], names=["id", "path", "z"])

        return pts.select("id", "x").mapInArrow(run, "id long, path array<int>, z array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        """A row a region."""
        rows = [(list(p), bytearray(packed(r))) for p, r in self.by_path.items()]
        spark.createDataFrame(rows, "path array<int>, model binary").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: dict) -> RegionTree:
        return cls(settings, {tuple(r.path): unpacked(r.model, tuple(r.path)) for r in spark.read.parquet(path).collect()})
