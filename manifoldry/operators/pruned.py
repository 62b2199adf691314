"""Exact nearest neighbours, and pairs within radii, that leave out what the triangle inequality rules out.

References fall into cells around pivots, a bounded number of them, whose distances and reaches the driver knows. Queries of a cell first visit the nearest cells, until those hold enough points; the distances found bound what can still
enter. A second visit goes only to cells that come as near as the farthest of those bounds, and there only queries take part whose own bound the cell's reach meets. What both find is merged.

Cells of queries that lie side by side are a group and one task; a block of references that any of them visits is sent to the group once, and what a query has found bounds what it still looks at. So what is sent grows with the references,
not with the visits, and what comes back with the queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import cells as C
from .knn import BLOCK_VALUES, Products, exact_nearest, first_of, matrix, squares, thinned
from .points import uniform_sample
from .shared import cut

#: Pivots at most, rows of a block, rows of it that meet another at a time, and what rounding may hide of a distance.
PIVOTS, ROWS, TILE, SLACK = 1000, 4096, 256, 1e-7

_FOUND = "id long, other long, sq double"


def _assigned(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """df in cells, each dealt to parts of about ROWS rows: a cell with very many rows is many blocks."""
    return _parts(cut(C.assign(df, pivots), "cells"))


def _parts(df: DataFrame) -> DataFrame:
    """df (cell, ...) with parts of about ROWS rows of a cell."""
    # as many rows as pivots at most
    parts = df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("__parts"))
    return df.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("__parts")).cast("int")).drop("__parts")


def _packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """(cell, part, payload): the columns of each part as an Arrow stream."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        table = table.select(columns).sort_by("id").combine_chunks()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "payload": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    return cut(df.select("cell", "part", *columns).groupBy("cell", "part").applyInArrow(run, "cell int, part int, payload binary"), "blocks")


def _open(payload: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    t = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()
    return t.column("id").to_numpy(), matrix(t.column("x").combine_chunks()), t.column("kth").to_numpy() if "kth" in t.column_names else None


class PrunedNeighbours:
    """The k nearest references of each query, as knn_join gives them, in `found`. Both are (id, x) with an id of its own for each row. visited: the share of all pairs of cells that were visited."""

    def __init__(self, queries: DataFrame, references: DataFrame, k: int, exclude_self: bool = False, pivots: int | None = None, seed: int = 0):
        self.spark, self.k, self.exclude = queries.sparkSession, k, exclude_self
        n = references.count()
        if not n or k < 1:
            self.visited, self.found = 0.0, self.spark.createDataFrame([], "id long, rank int, other long, sq double")
            return
        m = min(PIVOTS, max(1, int(np.sqrt(n)))) if pivots is None else pivots
        rows = uniform_sample(references.select("id", "x"), m, seed).orderBy("id").toArrow()
        self.pivots = matrix(rows.column("x").combine_chunks())
        m = len(self.pivots)
        held, asked = (_assigned(df.select("id", F.col("x").cast("array<double>").alias("x")), self.pivots) for df in (references, queries))
        reach, count = self._reach(held, m)
        near, many = self._reach(asked, m)
        self.reach = reach
        centre = self.pivots
        apart = np.sqrt(np.maximum(((centre * centre).sum(axis=1)[:, None] - 2 * centre @ centre.T + (centre * centre).sum(axis=1)[None]), 0))
        self.references = _packed(held, ["id", "x"])
        # nearest cells first, until they hold enough
        order = np.argsort(apart, axis=1, kind="stable")
        first = np.zeros((m, m), dtype=bool)
        for q in np.flatnonzero(many):
            full = np.cumsum(count[order[q]])
            first[q, order[q][: int(np.searchsorted(full, k + exclude_self)) + 1]] = True
        first &= (count > 0)[None]
        # groups of about as many queries each, along the pivots' longest axis
        parts = -(-many // ROWS)
        line = np.argsort((centre - centre.mean(axis=0)) @ np.linalg.svd(centre - centre.mean(axis=0), full_matrices=False)[2][0], kind="stable")
        cell = np.repeat(line, parts[line])
        part = np.arange(len(cell)) - np.repeat(np.cumsum(parts[line]) - parts[line], parts[line])
        before = np.cumsum(many[cell] / parts[cell])
        self.groups = max(3 * self.spark.sparkContext.defaultParallelism, -(-int(many.sum()) * centre.shape[1] // BLOCK_VALUES))
        group = np.minimum((before * self.groups / max(1.0, before[-1] if len(before) else 1.0)).astype(np.int64), self.groups - 1)
        self.units = cell, part, group
        one = cut(self._visit(_packed(asked, ["id", "x"]), first), "first")
        kth = one.groupBy("id").agg(F.when(F.count(F.lit(1)) == k, F.max("sq")).otherwise(float("inf")).alias("kth"))
        asked = cut(asked.join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("inf")))), "asked")
        bound = np.zeros(m)
        for r in asked.groupBy("cell").agg(F.max("kth").alias("kth")).collect():  # a row a pivot
            bound[r.cell] = np.sqrt(r.kth)
        size = 1 + apart.max(initial=0) + reach.max(initial=0) + near.max(initial=0)
        second = (apart - near[:, None] - reach[None] <= bound[:, None] + SLACK * size) & (many > 0)[:, None] & (count > 0)[None] & ~first
        pairs = max(1, int((many > 0).sum() * (count > 0).sum()))
        self.visited = float((first.sum() + second.sum()) / pairs)
        rest = self._visit(_packed(asked, ["id", "x", "kth"]), second)
        rank = F.row_number().over(Window.partitionBy("id").orderBy("sq", "other"))
        self.found = one.union(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "other", "sq")

    def _reach(self, placed: DataFrame, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Each cell's farthest member, and how many it has: a row a pivot."""
        reach, count = np.zeros(m), np.zeros(m, dtype=np.int64)
        for r in placed.groupBy("cell").agg(F.max("sq").alias("sq"), F.count(F.lit(1)).alias("n")).collect():
            reach[r.cell], count[r.cell] = np.sqrt(r.sq), r.n
        return reach, count

    def _visit(self, asked: DataFrame, which: np.ndarray) -> DataFrame:
        """(id, other, sq): of each query, the nearest in the cells that it visits, as far as they can enter."""
        cell, part, group = self.units
        dealt = self.spark.createDataFrame(pa.table({"cell": pa.array(cell, pa.int32()), "part": pa.array(part, pa.int32()), "group": pa.array(group, pa.int32())}))
        to = np.zeros((self.groups, len(which)), dtype=bool)
        np.logical_or.at(to, group, which[cell])
        g, r = np.nonzero(to)
        sent = self.spark.createDataFrame(pa.table({"group": pa.array(g, pa.int32()), "cell": pa.array(r, pa.int32())}))
        # tables of a row a block, and of a row a group and pivot at most
        hosts = asked.join(F.broadcast(dealt), ["cell", "part"]).select("group", F.lit(0).alias("role"), "cell", "part", "payload")
        guests = self.references.join(F.broadcast(sent), "cell").select("group", F.lit(1).alias("role"), "cell", "part", "payload")
        rows = hosts.union(guests).repartitionById(self.groups, "group").sortWithinPartitions("role", "cell", "part")
        pivots, reach, k, exclude = self.pivots, self.reach, self.k, self.exclude

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, group = [], None
            for batch in batches:
                for role, at, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    opened = _open(payload)
                    if role == 0:
                        held.append((at, *opened))
                        continue
                    if group is None and held:
                        group, held = _Group(held, k), []
                    if group is not None:
                        group.meet(*opened[:2], pivots[at], reach[at], which[:, at], exclude)
            if group is not None:
                yield from group.found()

        return rows.select("role", "cell", "payload").mapInArrow(run, _FOUND)


class _Group:
    """Blocks (cell, ids, vectors, bounds or None) of queries, and the k nearest that each has found."""

    def __init__(self, blocks: list[tuple], k: int):
        self.k = k
        self.cell = np.repeat([b[0] for b in blocks], [len(b[1]) for b in blocks])
        self.ids, self.x = (np.concatenate([b[i] for b in blocks]) for i in (1, 2))
        self.kth = np.full(len(self.ids), np.inf) if blocks[0][3] is None else np.concatenate([b[3] for b in blocks])
        self.d, self.other = np.full((len(self.ids), k), np.inf), np.zeros((len(self.ids), k), dtype=np.int64)

    def meet(self, cids: np.ndarray, c: np.ndarray, pivot: np.ndarray, reach: float, which: np.ndarray, exclude: bool) -> None:
        on = np.flatnonzero(which[self.cell])
        bound = np.minimum(self.kth, self.d[:, -1])[on]
        away = np.sqrt(((self.x[on] - pivot) ** 2).sum(axis=1))
        may = away - reach <= np.sqrt(bound) + SLACK * (1 + away + reach)
        on, bound = on[may], bound[may]
        some = thinned(c, cids, self.k + exclude)
        if len(some) < len(c):
            c, cids = c[some], cids[some]
        i, j, d = exact_nearest(self.x[on], self.ids[on] if exclude else None, c, cids, self.k, bound)
        if not len(i):
            return
        at, row = np.unique(i, return_inverse=True)
        old, slot = np.nonzero(self.d[on[at]] < np.inf)
        row = np.concatenate([old, row])
        d, other = np.concatenate([self.d[on[at[old]], slot], d]), np.concatenate([self.other[on[at[old]], slot], cids[j]])
        keep = first_of(row, d, other, self.k)
        row, d, other = row[keep], d[keep], other[keep]
        slot = np.arange(len(row)) - np.searchsorted(row, row)
        # a row never has fewer than before
        self.d[on[at[row]], slot], self.other[on[at[row]], slot] = d, other

    def found(self) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(self.ids), 20_000):
            i, slot = np.nonzero(self.d[lo : lo + 20_000] < np.inf)
            i += lo
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[i], pa.int64()), pa.array(self.other[i, slot], pa.int64()), pa.array(self.d[i, slot])], names=["id", "other", "sq"])


def region_pairs(points: DataFrame, pivots: int | None = None, seed: int = 0) -> DataFrame:
    """(src, dst, sq) both ways, of every two different points (id, x, r) no farther apart than the larger of their radii r, the edge included.

    Points live in the region of their nearest pivot, and visit each region that their radius reaches. A pair is found where a point visits the other's region with the other inside its radius; where that is true of one of the
    two alone, the same visit gives the other way as well, so every pair comes up once each way.
    """
    spark = points.sparkSession
    n = points.count()
    if not n:
        return spark.createDataFrame([], "src long, dst long, sq double")
    m = min(PIVOTS, max(1, int(np.sqrt(n)))) if pivots is None else pivots
    rows = uniform_sample(points.select("id", "x"), m, seed).orderBy("id").toArrow()
    centre = matrix(rows.column("x").combine_chunks())
    m = len(centre)
    home = cut(C.assign(points.select("id", F.col("x").cast("array<double>").alias("x"), F.col("r").cast("double").alias("r")), centre), "homes")
    reach = np.full(m, -np.inf)
    for r in home.groupBy("cell").agg(F.max("sq").alias("sq")).collect():  # a row a pivot
        reach[r.cell] = np.sqrt(r.sq)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, r = matrix(batch.column(1)), batch.column(2).to_numpy()
            if not len(x):
                continue
            away = np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centre.T + (centre * centre).sum(axis=1)[None], 0))
            i, to = np.nonzero(away - reach[None] <= r[:, None] + SLACK * (1 + away + np.abs(x).max()))
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), *(batch.column(c).take(at) for c in range(3))], names=["cell", "id", "x", "r"])

    guests = cut(home.select("id", "x", "r").mapInArrow(visits, "cell int, id long, x array<double>, r double"), "visits")
    columns = ["id", "x", "r"]
    hosts, guests = (_packed(_parts(df), columns) for df in (home.select("cell", *columns), guests))
    pairs = guests.select("cell", "payload").join(hosts.select("cell", F.col("payload").alias("host")), "cell").select("payload", "host")

    def opened(payload: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.ipc.open_stream(payload.as_buffer()).read_all().combine_chunks()
        return t.column("id").to_numpy(), matrix(t.column("x").combine_chunks()), t.column("r").to_numpy()

    tile = TILE

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (a, x, ra), (b, y, rb) = (opened(batch.column(c)[k]) for c in range(2))
                if not len(x) or not len(y):
                    continue
                p = Products(x, y)
                if not p.fits:
                    p = Products(x, y, np.float64)
                # a tile of pairs at a time
                for lo in range(0, len(x), tile):
                    rows = slice(lo, min(lo + tile, len(x)))
                    limit = p.limit(ra[rows] * ra[rows], rows) + (np.finfo(p.q.dtype).eps * ra[rows] * ra[rows]).astype(p.q.dtype)
                    i, j = np.nonzero(p.near(rows, slice(0, len(y))) <= limit[:, None])
                    i += lo
                    other = a[i] != b[j]
                    i, j = i[other], j[other]
                    d = squares(x, i, y, j)
                    on = d <= ra[i] * ra[i]
                    i, j, d = i[on], j[on], d[on]
                    alone = d > rb[j] * rb[j]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a[i], b[j[alone]]]), pa.int64()), pa.array(np.concatenate([b[j], a[i[alone]]]), pa.int64()), pa.array(np.concatenate([d, d[alone]]))], names=["src", "dst", "sq"])

    return pairs.mapInArrow(meet, "src long, dst long, sq double")
