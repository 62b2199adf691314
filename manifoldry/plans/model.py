"""Fit an embedding of a table of points, and place any points with it.

What grows with the points (sample, refinement, masses, placement) runs in Spark; the model, of a few hundred to a few thousand cells, is solved in numpy.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manifoldry.operators import cells as C
from manifoldry.operators import graph as G
from manifoldry.operators import knn as N
from manifoldry.operators import points as P

from .layout import Layout, principal_directions, rotation
from .potential import Conductor, choose_landmarks
from .settings import settings

FORMAT = 1
#: Points up to which all pairs of a sample are compared on the driver.
ALONE = 4096


@dataclass
class Chart:
    """How points spread inside their cells: y = origin + scale (x - mean) basis turn."""

    anchors: np.ndarray
    bases: np.ndarray
    centres: np.ndarray
    turns: np.ndarray
    scales: np.ndarray
    valid: np.ndarray
    origin: str

    def place(self, x: np.ndarray, cell: np.ndarray, z: np.ndarray) -> np.ndarray:
        out = z.copy()
        for c in np.unique(cell):
            if self.valid[c]:
                on = np.flatnonzero(cell == c)
                local = x[on] @ self.bases[c] - self.centres[c]
                out[on] = (self.anchors[c] if self.origin == "anchor" else z[on]) + self.scales[c] * local @ self.turns[c]
        return out


@dataclass
class Region:
    """A fitted region: its model tables as arrays, and its children by path."""

    path: tuple[int, ...]
    dimension: float
    centroids: np.ndarray
    masses: np.ndarray
    sq_radius: np.ndarray
    rho: float
    landmarks: np.ndarray
    maps: np.ndarray
    layout: Layout
    chart: Chart | None = None
    seconds: dict[str, float] = field(default_factory=dict)
    passes: int = 0

    def voltages(self, x: np.ndarray, s: dict) -> tuple[np.ndarray, np.ndarray]:
        """Potentials of points from those of the cells around them; and each point's nearest cell."""
        e = s["extension"]
        cells = np.arange(len(self.centroids))
        k = min(e["k"], len(cells)) if e["kernel"] == "nearest" else len(cells)
        i, j, d = N.exact_nearest(x, None, self.centroids, cells, k)
        j, d = j.reshape(-1, k), d.reshape(-1, k)
        if e["kernel"] == "nearest":
            excess = d - d[:, :1]
            spread = excess.mean(axis=1, keepdims=True)
            w = np.exp(-e["sharpness"] * excess / (2 * np.where(spread > 0, spread, 1)))
        else:
            w = graph_kernel(d, self.sq_radius[j], s)
        w = w * self.masses[j]
        total = w.sum(axis=1)
        v = np.einsum("nk,nkl->nl", w, self.maps.T[j])
        under = total + (self.rho if e["strategy"] == "grounded" else 0)
        near = self.maps.T[j[:, 0]]
        return np.where(total[:, None] > 0, v / np.where(under > 0, under, 1)[:, None], near), j[:, 0]

    def place(self, x: np.ndarray, s: dict, chart: bool) -> np.ndarray:
        v, cell = self.voltages(x, s)
        z = self.layout.triangulate(v)
        return self.chart.place(x, cell, z) if chart and self.chart is not None else z


def graph_kernel(sq: np.ndarray, sq_radius: np.ndarray, s: dict) -> np.ndarray:
    g = s["graph"]
    safe = np.where(sq_radius > 0, sq_radius, 1)
    point = np.where(sq == 0, 1.0, 0.0)
    if g["kernel"] == "radial":
        return (sq <= sq_radius).astype(float)
    if g["kernel"] == "tapered":
        return np.where(sq_radius > 0, np.maximum(0, 1 - sq / safe), point)
    width = g["sigma"] ** 2 * safe
    return np.where(sq_radius > 0, np.where(sq <= g["cutoff"] ** 2 * width, np.exp(-sq / (2 * width)), 0), point)


def fit_chart(x: np.ndarray, cell: np.ndarray, z: np.ndarray, n_cells: int, o: dict) -> Chart:
    """A chart from sample points with their cells and coordinates. Rows are in sample order; directions come from a cell's first max_points."""
    d, k = x.shape[1], z.shape[1]
    anchors, centres, scales = np.zeros((n_cells, k)), np.zeros((n_cells, k)), np.zeros(n_cells)
    bases, turns = np.zeros((n_cells, d, k)), np.tile(np.eye(k), (n_cells, 1, 1))
    count, middle = np.bincount(cell, minlength=n_cells), np.full(n_cells, np.nan)
    for c in np.flatnonzero(count):
        on = np.flatnonzero(cell == c)
        mean = x[on].mean(axis=0)
        anchors[c] = z[on].mean(axis=0)
        bases[c] = principal_directions(x[on[: o["max_points"]]] - mean, k)
        centres[c] = mean @ bases[c]
        local = x[on] @ bases[c] - centres[c]
        turns[c] = rotation(local, z[on] - anchors[c])
        middle[c] = np.sort(np.linalg.norm(local, axis=1))[len(on) // 2]  # the upper median
    at = np.flatnonzero(count)
    if len(at) > 1:
        gap = np.sqrt(((anchors[at, None] - anchors[None, at]) ** 2).sum(axis=2))
        np.fill_diagonal(gap, np.inf)
        with np.errstate(divide="ignore", invalid="ignore"):
            scales[at] = o["fill"] * gap.min(axis=1) / middle[at]
    valid = (count > k) & np.isfinite(scales) & (scales > 0)
    return Chart(anchors, bases, centres, turns, np.where(valid, scales, 0), valid, o["origin"])


def solve_region(centroids: np.ndarray, masses: np.ndarray, kernel: np.ndarray, sq_radius: np.ndarray, dimension: float, s: dict, path: tuple[int, ...] = ()) -> Region:
    """Landmarks, potentials and layout of a graph of cells: a pure function of its model tables."""
    if s["graph"]["connect"] and len(centroids) > 1:
        kernel = G.connected(kernel, centroids)
    landmarks, rho = choose_landmarks(kernel, masses, dimension, s)
    maps = Conductor(kernel, masses).maps(rho, landmarks)
    layout = Layout.of_maps(maps, landmarks, s["embedding"]["n_components"], s["embedding"]["distance_floor"])
    return Region(path, dimension, centroids, masses, sq_radius, rho, landmarks, maps, layout)


class Embedder:
    """fit(points) then transform(points): points have an id, a vector, and any other columns. Order is by id: a prefix sample is the first ids."""

    def __init__(self, given: dict | str | None = None, **over):
        self.settings = settings(given, **over)
        self.region: Region | None = None

    def fit(self, df: DataFrame, id_col: str = "id", x_col: str = "x", mass_from: DataFrame | None = None) -> Embedder:
        """mass_from: other points, with the same columns, whose counts give the cells' masses."""
        s, spark, seconds = self.settings, df.sparkSession, {}
        clock = time.monotonic()

        def lap(step: str) -> None:
            nonlocal clock
            seconds[step] = time.monotonic() - clock
            clock = time.monotonic()

        pts = P.points(df, id_col, x_col)
        self.n_features = P.n_features(pts)
        take = P.prefix if s["sample"]["strategy"] == "prefix" else P.uniform_sample
        sample = take(pts, s["sample"]["size"]) if take is P.prefix else take(pts, s["sample"]["size"], s["seed"])
        # bounded by sample.size; from here on the sample is a local table
        held = sample.toArrow().sort_by("id")
        x = N.matrix(held.column("x").combine_chunks())
        local = spark.createDataFrame(held)
        lap("sample")
        ids = held.column("id").to_numpy()
        dimension = self._dimension(local, ids, x)
        lap("dimension")
        centroids = self._cells(pts, x)
        lap("cells")
        centroids, passes = self._refine(pts, centroids, local)
        lap("refine")
        masses = self._masses(P.points(mass_from, id_col, x_col) if mass_from is not None else pts, centroids)
        centroids, masses = centroids[masses > 0], masses[masses > 0] / masses.sum()
        lap("masses")
        kernel, sq_radius = self._graph(centroids, ids, x)
        lap("graph")
        self.region = solve_region(centroids, masses, kernel, sq_radius, dimension, s)
        self.region.seconds, self.region.passes = seconds, passes
        lap("landmarks")
        if s["embedding"]["local_chart"] != "none":
            self._chart(x)
        lap("chart")
        return self

    def _dimension(self, local: DataFrame, ids: np.ndarray, x: np.ndarray) -> float:
        o = self.settings["dimension"]
        if o["strategy"] == "fixed":
            return float(o["d"])
        k = min(o["k"], min(len(x), o["sample_size"]) - 1)
        if k < 2:
            raise ValueError("too few points for an estimate of the dimension; set dimension.strategy to fixed")
        if min(len(x), o["sample_size"]) <= ALONE:
            some = x[P.hash_places(ids, self.settings["seed"])[: o["sample_size"]]] if len(x) > o["sample_size"] else x
            return N.dimension_of(some, k)
        # all pairs of a large sample are shared by all tasks
        some = P.uniform_sample(local, o["sample_size"], self.settings["seed"]) if len(x) > o["sample_size"] else local
        return float(N.mle_dimension(N.knn_join(some, some, k, exclude_self=True), k).first()[0])

    def _cells(self, pts: DataFrame, x: np.ndarray) -> np.ndarray:
        o = self.settings["cells"]
        if len(x) <= o["n_cells"]:
            return x
        if o["placement"] == "farthest":
            first = int(np.random.default_rng(self.settings["seed"]).integers(len(x)))
            return x[C.farthest(x, o["n_cells"], first)]
        if o["engine"] == "spark_ml":
            return C.centroid_matrix(C.table_kmeans(pts, o["n_cells"], seed=self.settings["seed"]))[1]
        return C.kmeans(x, o["n_cells"], o["iterations"], self.settings["seed"])

    def _refine(self, pts: DataFrame, centroids: np.ndarray, local: DataFrame) -> tuple[np.ndarray, int]:
        o = self.settings["refine"]
        if not o["passes"]:
            return centroids, 0
        some = pts if o["max_points"] is None else P.prefix(pts, o["max_points"])
        if o["strategy"] == "lloyd":
            cells, made = C.lloyd(some, centroids, o["passes"], o["tolerance"])
            return C.centroid_matrix(cells)[1], made
        # the sample's points count as seen; where it is the beginning of the points, the first pass goes on behind it
        skip = (local.agg(F.max("id")).first()[0] + 1) if self.settings["sample"]["strategy"] == "prefix" else None
        return C.centroid_matrix(C.minibatch(some, centroids, o["passes"], o["chunk_size"], sample=local, skip=skip))[1], o["passes"]

    def _masses(self, pts: DataFrame, centroids: np.ndarray) -> np.ndarray:
        o = self.settings["masses"]
        some = pts if o["max_points"] is None else P.prefix(pts, o["max_points"])
        assigned = C.assign(some, centroids).select("id", "cell")
        if o["rel_error"] is not None:
            n = C.enough_points(assigned, "id", self.settings["refine"]["chunk_size"], o["rel_error"], len(centroids))
            assigned = assigned.where(F.col("id") < n)
        counts = np.zeros(len(centroids))
        for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # one row a cell
            counts[r.cell] = r.n
        return {"counted": counts / max(counts.sum(), 1), "uniform": np.full(len(counts), 1 / len(counts)), "smoothed": (counts + 1) / (counts.sum() + len(counts))}[o["strategy"]]

    def _graph(self, centroids: np.ndarray, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The kernel between cells, as a matrix, and their squared radii. x: the sample, ordered by ids."""
        o, n = self.settings["graph"], len(centroids)
        if n < 2:
            return np.zeros((n, n)), np.zeros(n)
        last = None
        if o["radius"] == "point_knn":
            k = min(o["k"], n)
            some = x[P.hash_places(ids, self.settings["seed"])[: o["sample_size"]]]
            last = N.exact_nearest(some, None, centroids, np.arange(n), k)[2].reshape(-1, k)[:, -1]
        sq = np.zeros((n, n))
        for f in range(centroids.shape[1]):
            sq += (centroids[:, f, None] - centroids[None, :, f]) ** 2
        sq_radius = G.sq_radii(sq, o["radius"], o["k"], o["multiplier"], last)
        w = graph_kernel(sq, np.maximum(sq_radius[:, None], sq_radius[None]), self.settings)
        np.fill_diagonal(w, 0)
        return w, sq_radius

    def _chart(self, x: np.ndarray) -> None:
        r, s = self.region, self.settings
        v, cell = r.voltages(x, s)
        r.chart = fit_chart(x, cell, r.layout.triangulate(v), len(r.centroids), s["embedding"])

    def fit_charts(self, df: DataFrame, id_col: str = "id", x_col: str = "x") -> Embedder:
        """Charts on demand, from at most max_points points of each cell, the first by id: a ranked window, so each cell's quota is kept inside the cluster."""
        region, s = self.region, self.settings
        shared = df.sparkSession.sparkContext.broadcast(region)
        cells = C.assign(P.points(df, id_col, x_col), C.cells_frame(df.sparkSession, region.centroids))
        rank = F.row_number().over(Window.partitionBy("cell").orderBy("id"))
        held = cells.withColumn("r", rank).where(F.col("r") <= s["embedding"]["max_points"]).select("id", "x", "cell").toArrow().sort_by("id")
        x = N.matrix(held.column("x").combine_chunks())
        z = shared.value.layout.triangulate(region.voltages(x, s)[0])
        region.chart = fit_chart(x, held.column("cell").to_numpy(), z, len(region.centroids), s["embedding"])
        return self

    def transform(self, df: DataFrame, x_col: str = "x", chart: bool | None = None) -> DataFrame:
        """df with z array<double>. Each row on its own, so a stream works as well as a table."""
        if self.region is None:
            raise RuntimeError("not fitted")
        use = self.settings["embedding"]["local_chart"] != "none" if chart is None else chart
        # on a stream's or a table's tasks: one broadcast of the model
        shared = df.sparkSession.sparkContext.broadcast((self.region, self.settings))
        names = [c for c in df.columns if c != "z"]
        at, width = names.index(x_col), self.region.centroids.shape[1]
        schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names) + ", z array<double>"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            region, s = shared.value
            for batch in batches:
                x = N.matrix(batch.column(at))
                if len(x) and x.shape[1] != width:
                    raise ValueError(f"vectors have {x.shape[1]} features; the model has {width}")
                z = region.place(x, s, use) if len(x) else np.zeros((0, 1))
                z = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, z], names=[*names, "z"])

        return df.select(*names).mapInArrow(run, schema)

    def landmark_positions(self, spark: SparkSession) -> DataFrame:
        """(landmark, cell, z): where the landmarks' own cells lie when they are placed like points."""
        r = self.region
        rows = [(i, int(c), r.centroids[c].tolist()) for i, c in enumerate(r.landmarks)]
        return self.transform(spark.createDataFrame(rows, "landmark int, cell int, x array<double>")).drop("x")

    # storing

    @staticmethod
    def stored_bytes(spark: SparkSession, path: str) -> int:
        """The size of a stored model."""
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()

    def save(self, spark: SparkSession, path: str) -> None:
        """Model tables as Parquet, settings as one JSON row."""
        r = self.region
        table = lambda rows, schema, name: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        head = {"format": FORMAT, "settings": self.settings, "dimension": r.dimension, "rho": r.rho, "path": list(r.path), "passes": r.passes, "n_features": int(r.centroids.shape[1]), "chart": r.chart is not None}
        table([(json.dumps(head),)], "head string", "head")
        table([(i, r.centroids[i].tolist(), float(r.masses[i]), float(r.sq_radius[i]), r.maps[:, i].tolist()) for i in range(len(r.masses))], "cell int, c array<double>, mass double, sq_radius double, v array<double>", "cells")
        table([(i, int(r.landmarks[i]), r.layout.distances[i].tolist(), float(r.layout.mean_sq[i]), r.layout.projection[:, i].tolist()) for i in range(len(r.landmarks))], "landmark int, cell int, d array<double>, mean_sq double, p array<double>", "landmarks")
        # a chart of a model that was stored here before doesn't belong to this one
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/chart")
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
        if r.chart is not None:
            c = r.chart
            table([(i, c.anchors[i].tolist(), c.bases[i].ravel().tolist(), c.centres[i].tolist(), c.turns[i].ravel().tolist(), float(c.scales[i]), bool(c.valid[i])) for i in range(len(c.scales))], "cell int, anchor array<double>, basis array<double>, centre array<double>, turn array<double>, scale double, valid boolean", "chart")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Embedder:
        head = json.loads(spark.read.parquet(f"{path}/head").first()[0])
        if head["format"] != FORMAT:
            raise ValueError(f"format {head['format']} is not {FORMAT}")
        out = cls(head["settings"])
        cells = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
        marks = spark.read.parquet(f"{path}/landmarks").orderBy("landmark").collect()
        layout = Layout(np.array([m.d for m in marks]), np.array([m.mean_sq for m in marks]), np.array([m.p for m in marks]).T, head["settings"]["embedding"]["distance_floor"])
        out.region = Region(tuple(head["path"]), head["dimension"], np.array([c.c for c in cells]), np.array([c.mass for c in cells]), np.array([c.sq_radius for c in cells]), head["rho"], np.array([m.cell for m in marks]), np.array([c.v for c in cells]).T, layout, passes=head["passes"])
        out.n_features = head["n_features"]
        if head.get("chart", out.settings["embedding"]["local_chart"] != "none"):
            rows = spark.read.parquet(f"{path}/chart").orderBy("cell").collect()
            k, d = len(rows[0].anchor), head["n_features"]
            out.region.chart = Chart(np.array([r.anchor for r in rows]), np.array([r.basis for r in rows]).reshape(-1, d, k), np.array([r.centre for r in rows]), np.array([r.turn for r in rows]).reshape(-1, k, k), np.array([r.scale for r in rows]), np.array([r.valid for r in rows]), out.settings["embedding"]["origin"])
        return out


def fit_regions(pts: DataFrame, s: dict, min_points: int = 3) -> DataFrame:
    """(region, id, z): each region of pts (id, x, region) fitted by itself, all side by side, and its points placed in its own coordinates. Regions of under min_points points are skipped; a region must fit into a task."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = N.matrix(table.column("x").combine_chunks())
        empty = pa.table({"region": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "z": pa.array([], pa.list_(pa.float64()))})
        if len(x) < min_points:
            return empty
        region = fit_local(x, s, (key[0].as_py(),))
        z = region.place(x, s, s["embedding"]["local_chart"] != "none")
        return pa.table({"region": pa.array([key[0].as_py()] * len(x), pa.int32()), "id": table.column("id"), "z": pa.array(z.tolist(), pa.list_(pa.float64()))})

    return pts.select("id", "x", F.col("region").cast("int").alias("region")).groupBy("region").applyInArrow(run, "region int, id long, z array<double>")


def fit_local(x: np.ndarray, s: dict, path: tuple[int, ...] = ()) -> Region:
    """The same fit on rows in memory: for regions inside a task."""
    if s["dimension"]["strategy"] == "fixed" or len(x) < 100:
        dimension = float(s["dimension"]["d"])
    else:
        dimension = N.dimension_of(x, min(s["dimension"]["k"], len(x) - 1))
    n = min(s["cells"]["n_cells"], max(3, len(x) // s["cells"]["min_points_per_cell"]))
    c = x.copy() if len(x) <= n else C.kmeans(x, n, s["cells"]["iterations"], s["seed"])
    _, cell, _ = N.exact_nearest(x, None, c, np.arange(len(c)), 1)
    count = np.bincount(cell, minlength=len(c))
    c, count = c[count > 0], count[count > 0]
    at = np.arange(len(c))
    k = min(s["graph"]["k"], len(c) - 1)
    _, _, d = N.exact_nearest(c, at, c, at, k)
    sq_radius = d.reshape(-1, k)[:, -1]
    sq = ((c[:, None] - c[None]) ** 2).sum(axis=2)
    w = graph_kernel(sq, np.maximum(sq_radius[:, None], sq_radius[None]), s)
    np.fill_diagonal(w, 0)
    region = solve_region(c, count / count.sum(), w, sq_radius, dimension, s, path)
    if s["embedding"]["local_chart"] != "none":
        v, cell = region.voltages(x, s)
        region.chart = fit_chart(x, cell, region.layout.triangulate(v), len(c), s["embedding"])
    return region
