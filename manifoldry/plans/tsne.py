"""t-SNE: affinities of a stated perplexity between nearest neighbours, and a layout in the plane whose repulsion goes by way of a grid.

Between two exchanges every point takes a few steps by itself. Before each, tasks add up what pulls a point, along the edges of one pair of blocks after another: a weight and a weighted sum of its neighbours'
places. What pushes it is a field: each block lays its points as charges on a grid of bounded size, five nodes an interval and direction, the sum of the grids is multiplied by the kernel with a
Fourier transform, and tasks read the field back where their points stand. So a job's data follow from the number of edges and the size of the grid, never from pairs of points. Sums are
added up in order of blocks, so the result is the same for any partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.operators.blocks import BlockGraph, floats
from manifoldry.operators.knn import BLOCK_VALUES, knn_join
from manifoldry.operators.shared import cut, drop_scratch

from .umap import principal_layout

#: Intervals of the grid in each direction, at least and at most; they are WIDTH wide at most if that many suffice, and wider, with a less exact field, in a layout of over 120. Nodes of an interval, and the width of the
#: grid at least, so that small layouts have room to move between two exchanges.
INTERVALS, WIDTH, NODES, ROOM = (45, 240), 0.5, 5, 15.0
#: Grids that come to the driver at a time, and parts in which more of them are added up before.
GRIDS, PARTS = 4, 32


def precisions(sq: np.ndarray, perplexity: float) -> np.ndarray:
    """Each row's probabilities exp(-beta sq) / sum whose entropy is ln perplexity, or as near as its neighbours allow. NaN: no such neighbour."""
    there = ~np.isnan(sq)
    least = np.where(there, sq, np.inf).min(axis=1, initial=np.inf)
    over = np.where(there, sq - np.where(np.isinf(least), 0, least)[:, None], np.inf)
    scale = np.where(there, over, 0).sum(axis=1) / np.maximum(1, there.sum(axis=1))
    over = over / np.where(scale > 0, scale, 1)[:, None]
    target = np.log(perplexity)
    lo, hi, beta = np.zeros(len(sq)), np.full(len(sq), np.inf), np.ones(len(sq))
    for _ in range(100):
        p = np.exp(-np.where(there, over, 0) * beta[:, None]) * there
        total = np.maximum(p.sum(axis=1), 1e-300)
        entropy = np.log(total) + beta * (p * np.where(there, over, 0)).sum(axis=1) / total
        lo, hi = np.where(entropy > target, beta, lo), np.where(entropy > target, hi, beta)
        beta = np.where(np.isinf(hi), np.minimum(beta * 2, 1e12), (lo + hi) / 2)
    return p / total[:, None]


def affinities(neighbours: DataFrame, perplexity: float, n: int) -> DataFrame:
    """(src, dst, w) both ways, of the neighbours (id, rank, other, sq) of n points: the mean of the two points' probabilities of each other, over n. All of them add up to 1."""
    lists = neighbours.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "sq"))).alias("l")).select("id", F.col("l.other").alias("other"), F.col("l.sq").alias("sq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = np.diff(batch.column(1).offsets.to_numpy())
            row = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            sq = np.full((len(size), int(size.max())), np.nan)
            sq[row, at] = batch.column(2).flatten().to_numpy()
            p = precisions(sq, perplexity)[row, at]
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row], pa.int64()), batch.column(1).flatten(), pa.array(p)], names=["src", "dst", "w"])

    one = lists.mapInArrow(run, "src long, dst long, w double")
    both = one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") / (2.0 * n)).alias("w"))


def _smooth(n: int) -> int:
    """The next number without prime factors over 5, of which Fourier transforms are fast."""
    while True:
        rest = n
        for f in (2, 3, 5):
            while rest % f == 0:
                rest //= f
        if rest == 1:
            return n
        n += 1


@lru_cache(1)
def _kernel(side: int, step: float) -> np.ndarray:
    """The transform of 1 / (1 + d^2)^2 between nodes."""
    d = np.minimum(np.arange(2 * side), 2 * side - np.arange(2 * side)) * step
    return np.fft.rfft2(1 / (1 + d[:, None] ** 2 + d[None] ** 2) ** 2)


class Grid:
    """A square of intervals around a box; charges are laid on its nodes, and fields read from them, by polynomials through an interval's nodes in each direction."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        span = max(float((high - low).max()) * 1.02, ROOM)
        self.m = min(max(INTERVALS[0], _smooth(math.ceil(span / WIDTH))), INTERVALS[1])
        self.h = span / self.m
        self.low = (low + high - span) / 2
        self.side = self.m * NODES

    def wide(self, low: np.ndarray, high: np.ndarray) -> bool:
        """Whether the box needs much less room."""
        return self.m > INTERVALS[0] and (high - low).max() < 0.5 * self.m * self.h

    def holds(self, low: np.ndarray, high: np.ndarray) -> bool:
        return bool((low >= self.low).all() and (high <= self.low + self.m * self.h).all())

    def weights(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, weights) of each point: NODES squared of each."""
        at = (y - self.low) / self.h
        cell = np.clip(np.floor(at), 0, self.m - 1).astype(np.int64)
        t = at - cell
        # Lagrange's polynomials of nodes in the middle of equal parts
        at = (np.arange(NODES) + 0.5) / NODES
        w = np.stack([np.prod([(t - at[o]) / (at[k] - at[o]) for o in range(NODES) if o != k], axis=0) for k in range(NODES)], axis=2)
        node = cell[:, :, None] * NODES + np.arange(NODES)
        nodes = node[:, 0, :, None] * self.side + node[:, 1, None, :]
        return nodes.reshape(len(y), -1), (w[:, 0, :, None] * w[:, 1, None, :]).reshape(len(y), -1)

    def deposit(self, y: np.ndarray) -> np.ndarray:
        """The charges 1, x, y and their squared length of all points, node by node; and at the end, what the points do to themselves by way of the grid."""
        nodes, w = self.weights(y)
        charges = (np.ones(len(y)), y[:, 0], y[:, 1], (y * y).sum(axis=1))
        laid = [np.bincount(nodes.ravel(), (w * c[:, None]).ravel(), minlength=self.side**2) for c in charges]
        at = np.arange(NODES) * self.h / NODES
        d = (at[:, None] - at[None]) ** 2
        own = 1 / (1 + d[:, None, :, None] + d[None, :, None, :]) ** 2
        return np.concatenate([*laid, [((w @ own.reshape(NODES**2, NODES**2)) * w).sum()]])

    def field(self, charges: np.ndarray) -> tuple[np.ndarray, float]:
        """The fields of the first three charges under 1 / (1 + d^2)^2, and the sum of 1 / (1 + d^2) over all pairs of different points."""
        s = self.side
        kernel = _kernel(s, self.h / NODES)
        squares = charges[:-1].reshape(4, s, s)

        def one(c: np.ndarray) -> np.ndarray:
            held = np.fft.rfft2(c, (2 * s, 2 * s))
            held *= kernel
            return np.fft.irfft(np.fft.ifft(held, axis=0)[:s], 2 * s, axis=1)[:, :s].ravel()

        with ThreadPoolExecutor(2) as two:  # transforms run beside each other
            fields = np.stack(list(two.map(one, squares)))
        one, x, y, sq = (c.ravel() for c in squares)
        # 1 / (1 + d^2) is (1 + |a|^2 - 2 a b + |b|^2) times the kernel
        total = ((one + sq) * fields[0]).sum() - 2 * (x * fields[1]).sum() - 2 * (y * fields[2]).sum() + (one * fields[3]).sum()
        return fields[:3], max(float(total - charges[-1]), 1e-300)

    def push(self, y: np.ndarray, fields: np.ndarray) -> np.ndarray:
        """Each point's sum over all points of the difference times the kernel. A point that has left the grid is pushed as at its edge: polynomials hold no further."""
        y = np.clip(y, self.low, self.low + self.m * self.h)
        nodes, w = self.weights(y)
        one, x1, x2 = ((w * f[nodes]).sum(axis=1) for f in fields)
        return y * one[:, None] - np.stack([x1, x2], axis=1)


_PULL = "p int, q int, no int, at binary, pull binary"
_STATE = "block int, y binary, v binary, gain binary, low array<double>, high array<double>, grid binary"


class Tsne:
    """A fitted layout in the plane; `placed()` gives (id, z) of the points (id, x).

    steps: (number, exaggeration, momentum) one after another; together: steps between two exchanges. The rate is for the gradient without its factor 4.
    """

    def __init__(self, pts: DataFrame, perplexity: float = 15.0, n_neighbors: int | None = None, steps: tuple = ((250, 12.0, 0.5), (500, 2.0, 0.8)), together: int = 3, rate: float | None = None, start: DataFrame | None = None, blocks: int | None = None):
        self.spark = pts.sparkSession
        points = cut(pts.select("id", F.col("x").cast("array<double>").alias("x")), "points")
        n = points.count()
        k = min(int(3 * perplexity) if n_neighbors is None else n_neighbors, max(n - 1, 1))
        self.graph = cut(affinities(knn_join(points, points, k, exclude_self=True), perplexity, n), "affinities")
        self.blocked = BlockGraph(points, self.graph, blocks)
        self.n, self.rate = n, max(n / 12, 50.0) if rate is None else rate
        start = principal_layout(points, 2, 1e-3) if start is None else start
        y = cut(self.blocked.numbers(start, "z", 2), "start")
        self.grid: Grid | None = None
        self.state = cut(self._laid(y), "state")
        self._field()
        for number, exaggeration, momentum in steps:
            for at in range(0, number, together):
                moved, sent = self._moved(min(together, number - at), exaggeration, momentum)
                new = cut(moved, "state")
                drop_scratch(self.spark, self.state)
                for b in sent:
                    b.destroy()
                self.state = new
                self._field()

    def _laid(self, y: DataFrame) -> DataFrame:
        """The state of points that haven't moved yet, without a grid."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    z = floats(batch.column(1), r, 2)
                    yield _state_row(batch.column(0)[r].as_py(), z, np.zeros_like(z), np.ones_like(z), None)

        return y.select("block", "y").mapInArrow(run, _STATE)

    def _field(self) -> None:
        """The field of the state's points: from the grids that came with it, or from a new grid if a point has left the old one or all of them need much less room."""
        few, held = self.blocked.blocks <= GRIDS, 2 * self.n <= BLOCK_VALUES
        # one job: boxes, one row a block, and what is of checked size of grids and places
        here = self.state.select("block", "low", "high", *(["grid"] if few else []), *(["y"] if held else [])).toArrow().sort_by("block")
        box = [(x, y) for x, y in zip(here.column("low").to_pylist(), here.column("high").to_pylist()) if x is not None]
        low, high = (np.array([r[i] for r in box]) for i in (0, 1))
        low, high = low.min(axis=0), high.max(axis=0)
        self.places = {b: np.frombuffer(y.as_buffer()).reshape(-1, 2) for b, y in zip(here.column("block").to_pylist(), here.column("y"))} if held else None
        old, laid = self.grid, None
        rows = self.state.select("block", "grid")
        if old is None or not old.holds(low, high) or old.wide(low, high):
            # room to move for a while
            margin = 0.1 * float((high - low).max())
            grid = self.grid = Grid(low - margin, high + margin)

            def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for r in range(batch.num_rows):
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, 1), pa.array([grid.deposit(floats(batch.column(1), r, 2)).tobytes()], pa.binary())], names=["block", "grid"])

            rows = self.state.select("block", "y").mapInArrow(lay, "block int, grid binary")
        elif few:
            laid = here
        if not few:

            def add(key: tuple, table: pa.Table) -> pa.Table:
                total = None
                for r in table.sort_by("block").to_batches():
                    for g in r.column(1):
                        total = np.frombuffer(g.as_buffer()) + (0 if total is None else total)
                return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "grid": pa.array([total.tobytes()], pa.binary())})

            # each part of all grids by itself, so that one grid's worth comes to the driver
            length = 8 * -(-(4 * self.grid.side**2 + 1) // PARTS)
            some = rows.select("block", "grid", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
            some = some.select("block", F.expr(f"substring(grid, part * {length} + 1, {length})").alias("grid"), "part").where("length(grid) > 0")
            found = some.groupBy("part").applyInArrow(add, "part int, grid binary").toArrow().sort_by("part")
            total = np.concatenate([np.frombuffer(g.as_buffer()) for g in found.column("grid")])
        else:
            total = np.zeros(4 * self.grid.side**2 + 1)
            for g in (rows.toArrow().sort_by("block") if laid is None else laid).column("grid"):  # of a bounded number and size
                if g.is_valid:
                    total += np.frombuffer(g.as_buffer())
        self.fields, self.total = self.grid.field(total)

    def _pulls(self) -> tuple[DataFrame, Broadcast | None]:
        """What each chunk of edges pulls its first points with: points, and for each the sum of the weights and of the neighbours' places by weight. Places of checked size are sent to where chunks are read."""

        def pull(batch: pa.RecordBatch, r: int, yp: np.ndarray, yq: np.ndarray) -> pa.RecordBatch:
            i, j = (np.frombuffer(batch.column(c)[r].as_buffer(), dtype=np.int32) for c in (3, 4))
            w, a, b = np.frombuffer(batch.column(5)[r].as_buffer()), yp[i], yq[j]
            w = w / (1 + ((a - b) ** 2).sum(axis=1))
            # edges of a chunk stand in order of i
            first = np.flatnonzero(np.diff(i, prepend=-1))
            sums = np.add.reduceat(np.column_stack([w, w[:, None] * b]), first, axis=0)
            return pa.RecordBatch.from_arrays([*(batch.column(c).slice(r, 1) for c in range(3)), pa.array([i[first].tobytes()], pa.binary()), pa.array([np.ascontiguousarray(sums).tobytes()], pa.binary())], names=["p", "q", "no", "at", "pull"])

        if self.places is not None:
            shared = self.spark.sparkContext.broadcast(self.places)

            def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                y = shared.value
                for batch in batches:
                    for r in range(batch.num_rows):
                        yield pull(batch, r, y[batch.column(0)[r].as_py()], y[batch.column(1)[r].as_py()])

            return self.blocked.chunks.select("p", "q", "no", "i", "j", "w").mapInArrow(held, _PULL), shared
        y = self.state.select("block", "y")
        ends = self.blocked.chunks.join(y.select(F.col("block").alias("p"), F.col("y").alias("yp")), "p").join(y.select(F.col("block").alias("q"), F.col("y").alias("yq")), "q")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    yield pull(batch, r, floats(batch.column(6), r, 2), floats(batch.column(7), r, 2))

        return ends.select("p", "q", "no", "i", "j", "w", "yp", "yq").mapInArrow(run, _PULL), None

    def _moved(self, together: int, exaggeration: float, momentum: float) -> tuple[DataFrame, list[Broadcast]]:
        """The state after so many steps, and what was sent to all tasks for them."""
        none = F.lit(None).cast("binary")
        own = self.state.select(F.col("block").alias("p"), F.lit(-1).alias("q"), F.lit(-1).alias("no"), none.alias("at"), none.alias("pull"), "y", "v", "gain")
        pulls, places = self._pulls()
        rows = own.union(pulls.select("p", "q", "no", "at", "pull", none, none, none))
        dealt = rows.repartitionById(self.blocked.blocks, "p").sortWithinPartitions("p", "q", "no")
        shared = self.spark.sparkContext.broadcast((self.grid, self.fields, self.total))
        rate = self.rate

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            grid, fields, total = shared.value
            now = y = v = gain = pull = None

            def done() -> pa.RecordBatch:
                nonlocal y, v, gain
                # weights stay as they are between two exchanges, so a step beyond where they pull a point to, as of hubs, would be followed by longer ones
                most = 1 / np.maximum(exaggeration * pull[:, :1], 1e-300)
                for _ in range(together):
                    g = exaggeration * (pull[:, :1] * y - pull[:, 1:]) - grid.push(y, fields) / total
                    gain = np.maximum(np.where((g > 0) == (v > 0), gain * 0.8, gain + 0.2), 0.01)
                    v = momentum * v - np.minimum(rate * gain, most) * g
                    y = y + v
                return _state_row(now, y, v, gain, grid)

            for batch in batches:
                for r in range(batch.num_rows):
                    if batch.column(1)[r].as_py() < 0:
                        if now is not None:
                            yield done()
                        now = batch.column(0)[r].as_py()
                        y, v, gain = (floats(batch.column(c), r, 2) for c in (5, 6, 7))
                        pull = np.zeros((len(y), 3))
                    else:
                        pull[np.frombuffer(batch.column(3)[r].as_buffer(), dtype=np.int32)] += floats(batch.column(4), r, 3)
            if now is not None:
                yield done()

        return dealt.mapInArrow(run, _STATE), [b for b in (shared, places) if b is not None]

    def gradient(self) -> DataFrame:
        """(id, g): the gradient of the divergence at the state's layout, without its factor 4."""
        pulls = self._pulls()[0].select("p", "q", "no", "at", "pull", F.lit(None).cast("binary").alias("y"))
        own = self.state.select(F.col("block").alias("p"), F.lit(-1).alias("q"), F.lit(-1).alias("no"), F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("pull"), "y")
        grid, fields, total = self.grid, self.fields, self.total

        def run(key: tuple, table: pa.Table) -> pa.Table:
            rows = table.sort_by([("q", "ascending"), ("no", "ascending")]).to_pylist()
            y = np.frombuffer(rows[0]["y"]).reshape(-1, 2)
            pull = np.zeros((len(y), 3))
            for r in rows[1:]:
                pull[np.frombuffer(r["at"], dtype=np.int32)] += np.frombuffer(r["pull"]).reshape(-1, 3)
            g = pull[:, :1] * y - pull[:, 1:] - grid.push(y, fields) / total
            return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "y": pa.array([g.tobytes()], pa.binary())})

        return self.blocked.rows(own.union(pulls).groupBy("p").applyInArrow(run, "block int, y binary"), 2, "g")

    def placed(self) -> DataFrame:
        return self.blocked.rows(self.state.select("block", "y"), 2)


def _state_row(block: int, y: np.ndarray, v: np.ndarray, gain: np.ndarray, grid: Grid | None) -> pa.RecordBatch:
    low, high = (y.min(axis=0).tolist(), y.max(axis=0).tolist()) if len(y) else (None, None)
    laid = None if grid is None or low is None or not grid.holds(np.array(low), np.array(high)) else grid.deposit(y).tobytes()
    held = [pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in (y, v, gain)]
    boxes = [pa.array([x], pa.list_(pa.float64())) for x in (low, high)]
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *held, *boxes, pa.array([laid], pa.binary())], names=["block", "y", "v", "gain", "low", "high", "grid"])
