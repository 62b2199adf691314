"""The graph of cells: radii, weighted edges by a range join, and joining its pieces. Cells are a model table; edges are (src, dst, sq, w), both ways."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from manifoldry.functions.arrays import kernel, sq_distance

from .knn import exact_nearest, knn_join
from .pruned import region_pairs


#: Cells whose pairs are all looked at, by a join of their table with itself. More of them meet by region.
FEW = 2000


def few(cells: DataFrame) -> bool:
    return cells.limit(FEW + 1).count() <= FEW


def cell_pairs(cells: DataFrame) -> DataFrame:
    """(src, dst, sq) of every two cells, of which there are FEW at most: a checked size."""
    a = cells.select(F.col("cell").alias("src"), F.col("c").alias("a"))
    b = cells.select(F.col("cell").alias("dst"), F.col("c").alias("b"))
    return a.join(F.broadcast(b), F.col("src") != F.col("dst")).select("src", "dst", sq_distance(F.col("a"), F.col("b")).alias("sq"))


def kth_radius(pairs: DataFrame, k: int) -> DataFrame:
    """(cell, sq_radius): squared distance to the k-th nearest other cell, or to the last if there are fewer."""
    w = Window.partitionBy("src").orderBy("sq", "dst")
    ranked = pairs.select("src", "sq", F.row_number().over(w).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("src")).alias("n"))
    return ranked.where(F.col("r") == F.least(F.lit(k), F.col("n"))).select(F.col("src").alias("cell"), F.col("sq").alias("sq_radius"))


def kth_of(cells: DataFrame, k: int) -> DataFrame:
    """kth_radius of cells of any number."""
    if few(cells):
        return kth_radius(cell_pairs(cells), k)
    pts = cells.select(F.col("cell").cast("long").alias("id"), F.col("c").alias("x"))
    near = knn_join(pts, pts, k, exclude_self=True).groupBy("id").agg(F.max("sq").alias("sq_radius"))
    return near.select(F.col("id").cast("int").alias("cell"), "sq_radius")


def one_radius(cells: DataFrame, value: DataFrame) -> DataFrame:
    """The same radius for every cell; value: one row with r."""
    return cells.select("cell").join(F.broadcast(value)).select("cell", (F.col("r") * F.col("r")).alias("sq_radius"))


def radii(cells: DataFrame, strategy: str, k: int = 10, multiplier: float = 3.0, point_neighbours: DataFrame | None = None) -> DataFrame:
    """(cell, sq_radius). point_neighbours: (id, rank, other, sq) of sample points among the cells, for point_knn. Medians interpolate."""
    median = lambda df, c: df.agg(F.expr(f"percentile(sqrt({c}), 0.5)").alias("r"))
    if strategy == "adaptive_per_cell":
        return kth_of(cells, k)
    if strategy == "knn":
        return one_radius(cells, median(kth_of(cells, k), "sq_radius"))
    if strategy == "centroid_spacing":
        return one_radius(cells, median(kth_of(cells, 1), "sq_radius").select((F.col("r") * multiplier).alias("r")))
    last = point_neighbours.where(F.col("rank") <= k).groupBy("id").agg(F.max("sq").alias("sq"))
    return one_radius(cells, median(last, "sq"))


def sq_radii(sq: np.ndarray, strategy: str, k: int = 10, multiplier: float = 3.0, last: np.ndarray | None = None) -> np.ndarray:
    """The squared radius of each cell by the same laws, from all squared distances of cells in memory. last: for point_knn, each sample point's squared distance to its k-th nearest cell."""
    n = len(sq)
    kth = lambda j: np.partition(sq + np.diag(np.full(n, np.inf)), j - 1, axis=1)[:, j - 1]
    if strategy == "adaptive_per_cell":
        return kth(min(k, n - 1))
    if strategy == "knn":
        r = np.median(np.sqrt(kth(min(k, n - 1))))
    elif strategy == "centroid_spacing":
        r = np.median(np.sqrt(kth(1))) * multiplier
    else:
        r = np.median(np.sqrt(last))
    return np.full(n, r * r)


def edges(cells: DataFrame, radius: DataFrame, kind: str = "radial", sigma: float = 0.3333, cutoff: float = 3.0) -> DataFrame:
    """(src, dst, sq, w): pairs with positive weight within the larger of their two radii."""
    r = lambda side: radius.select(F.col("cell").alias(side), F.col("sq_radius").alias(f"r_{side}"))
    if few(cells):
        # tables of FEW rows at most
        joined = cell_pairs(cells).join(F.broadcast(r("src")), "src").join(F.broadcast(r("dst")), "dst")
    else:
        # a gaussian reaches `cutoff` of its widths; the rest is for rounding
        reach = (max(1.0, cutoff * sigma) if kind == "gaussian" else 1.0) * (1 + 1e-9)
        pts = cells.join(radius, "cell").select(F.col("cell").cast("long").alias("id"), F.col("c").alias("x"), (F.sqrt("sq_radius") * reach).alias("r"))
        joined = region_pairs(pts).select(F.col("src").cast("int").alias("src"), F.col("dst").cast("int").alias("dst"), "sq").join(r("src"), "src").join(r("dst"), "dst")
    return joined.select("src", "dst", "sq", kernel(kind, F.col("sq"), F.greatest("r_src", "r_dst"), sigma, cutoff).alias("w")).where("w > 0")


def dense(edge_rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, squared distances of the edges) as matrices."""
    t = edge_rows.toArrow()
    w, sq = np.zeros((n, n)), np.zeros((n, n))
    i, j = t.column("src").to_numpy(), t.column("dst").to_numpy()
    w[i, j], sq[i, j] = t.column("w").to_numpy(), t.column("sq").to_numpy()
    return w, sq


def pieces(w: np.ndarray) -> np.ndarray:
    """The connected piece of each cell, named by its lowest cell."""
    label = np.arange(len(w))
    while True:
        near = np.where(w > 0, label[None, :], len(w)).min(axis=1, initial=len(w))
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def connected(w: np.ndarray, c: np.ndarray) -> np.ndarray:
    """w with each piece, from the largest down, joined to the growing main one by its closest pair of cells, at weight 1."""
    label = pieces(w)
    names, sizes = np.unique(label, return_counts=True)
    order = names[np.argsort(-sizes, kind="stable")]
    w, main = w.copy(), label == order[0]
    for name in order[1:]:
        inside, outside = np.flatnonzero(label == name), np.flatnonzero(main)
        # a tile of pairs at a time; ties to the lowest cell inside, then outside
        _, nearest, sq = exact_nearest(c[inside], None, c[outside], outside, 1)
        i = int(sq.argmin())
        w[inside[i], outside[nearest[i]]] = w[outside[nearest[i]], inside[i]] = 1.0
        main[inside] = True
    return w
