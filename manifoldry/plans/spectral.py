"""Laplacian eigenmaps of graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.operators import metrics as M
from manifoldry.operators.blocks import BlockGraph
from manifoldry.operators.lanczos import Lanczos
from manifoldry.operators.shared import cut, drop_scratch


def symmetric(edges: DataFrame) -> DataFrame:
    """(src, dst, w) both ways: the larger of the two ways' weights; edges from a point to itself are left out."""
    given = edges.select("src", "dst", "w").where("src <> dst")
    return given.union(given.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def eigenmaps(edges: DataFrame, k: int, blocks: int | None = None, **how) -> Lanczos:
    """The k eigenvectors of least eigenvalue above the known 0 of the symmetric normalised Laplacian of edges (src, dst, w); its eigenvalues are 1 - `values`. how: as for Lanczos."""
    # points, their number and chunks are all read from them
    both = cut(symmetric(edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"))), "edges")
    graph = BlockGraph(both.select(F.col("src").alias("id")).distinct(), both, blocks)
    drop_scratch(both.sparkSession, both)
    return Lanczos(graph, k, **how)


def laplacian_eigenmaps(edges: DataFrame, k: int, **how) -> DataFrame:
    """(id, z): the eigenvectors of `eigenmaps`, divided by the root of the degrees. Pieces of the graph are joined only by what edges join. Each axis is turned so that its largest entry is positive."""
    return eigenmaps(edges, k, **how).placed()


def best_pair(layouts: dict[int, DataFrame], truth: DataFrame, n: int) -> dict:
    """Of layouts (id, z) of n axes, by number of neighbours, the axis that follows `position` best and the other that follows `height` best, for the number of neighbours whose weaker of the two
    rank correlations is highest. truth: (id, position, height). Ties go to the earlier axis and layout."""
    best: dict = {"weaker": -1.0}
    for neighbours, z in layouts.items():
        both = z.join(truth, "id").select("position", "height", *(F.col("z")[c].alias(f"z{c}") for c in range(n)))
        follow = {side: [abs(M.rank_correlation(both, f"z{c}", side).first()[0] or 0.0) for c in range(n)] for side in ("position", "height")}
        a = max(range(n), key=lambda c: follow["position"][c])
        b = max((c for c in range(n) if c != a), key=lambda c: follow["height"][c])
        weaker = min(follow["position"][a], follow["height"][b])
        if weaker > best["weaker"]:
            best = {"weaker": weaker, "neighbours": neighbours, "axes": (a, b), "position_correlation": follow["position"][a], "height_correlation": follow["height"][b]}
    return best
