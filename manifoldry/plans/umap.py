"""UMAP: the fuzzy graph of nearest neighbours, laid out by sampled attraction along its edges and repulsion from random points.

Widths of the points' kernels are roots found for whole batches at a time. The layout goes in rounds: blocks of points are paired so that no two pairs share one, and each pair's task pulls and
pushes its own points along the edges between and inside them. As blocks are random samples, the random points that push are drawn from the pair's own. A sweep brings every two blocks
together once. All draws follow from the seed, the round and the chunk of edges, so the result is the same for any partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from manifoldry.operators.blocks import BlockGraph, floats, matches
from manifoldry.operators.knn import knn_join, matrix
from manifoldry.operators.shared import cut, drop_scratch

#: Push per pull, the learning rate at the start, and the longest step of one pull or push.
NEGATIVE, RATE, LONGEST = 5, 1.0, 4.0
#: Edges that a task takes in turns; more of them come after one another.
HELD = 8_000_000


def widths(sq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rho, sigma) of each row of squared distances to k neighbours: rho is the least positive distance, and the memberships exp(-max(0, d - rho) / sigma) sum up to log2 k. NaN: no such neighbour.

    No sigma is below a thousandth of the row's mean distance, which bounds rows whose neighbours are all about as near.
    """
    d = np.sqrt(sq)
    there = ~np.isnan(d)
    rho = np.where(there & (d > 0), d, np.inf).min(axis=1, initial=np.inf)
    rho[np.isinf(rho)] = 0.0
    over = np.where(there, np.maximum(0.0, d - rho[:, None]), np.inf)
    target = np.log2(np.maximum(2, there.sum(axis=1)))
    lo, hi = np.zeros(len(d)), np.full(len(d), np.inf)
    sigma = np.ones(len(d))
    with np.errstate(divide="ignore", invalid="ignore"):
        for _ in range(100):
            total = np.exp(-over / sigma[:, None]).sum(axis=1)
            lo, hi = np.where(total < target, sigma, lo), np.where(total < target, hi, sigma)
            sigma = np.where(np.isinf(hi), sigma * 2, (lo + hi) / 2)
    mean = np.where(there, d, 0).sum(axis=1) / np.maximum(1, there.sum(axis=1))
    return rho, np.maximum(sigma, np.maximum(1e-3 * mean, 1e-12))


def memberships(neighbours: DataFrame) -> DataFrame:
    """(src, dst, w) one way, of neighbours (id, rank, other, sq): how far each point's neighbours belong to it. A list of neighbours is one row; the number of neighbours bounds it."""
    lists = neighbours.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "sq"))).alias("l")).select("id", F.col("l.other").alias("other"), F.col("l.sq").alias("sq"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = np.diff(batch.column(1).offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            sq = np.full((len(n), int(n.max())), np.nan)
            sq[row, at] = batch.column(2).flatten().to_numpy()
            rho, sigma = widths(sq)
            w = np.exp(-np.maximum(0.0, np.sqrt(sq[row, at]) - rho[row]) / sigma[row])
            yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).to_numpy()[row], pa.int64()), batch.column(1).flatten(), pa.array(w)], names=["src", "dst", "w"])

    return lists.mapInArrow(run, "src long, dst long, w double")


def fuzzy_graph(neighbours: DataFrame) -> DataFrame:
    """(src, dst, w) both ways: the fuzzy union a + b - a b of the memberships of two points in each other."""
    one = memberships(neighbours)
    both = one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    # a pair has two rows at most: a sum and a product of what is missing
    return both.groupBy("src", "dst").agg((F.sum("w") - F.when(F.count("w") > 1, F.min("w") * F.max("w")).otherwise(0.0)).alias("w"))


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^2b), the least-squares fit to 1 up to min_dist and exp(-(d - min_dist) / spread) beyond, at 300 distances up to 3 spreads."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    v, damping = np.array([0.0, 0.0]), 1e-3  # of ln a and ln b

    def residual(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(v[0]) * x ** (2 * np.exp(v[1]))) - y

    r = residual(v)
    for _ in range(200):
        f = r + y
        slope = -f * (1 - f)
        j = np.stack([slope, slope * 2 * np.exp(v[1]) * np.log(x)], axis=1)
        h = j.T @ j
        step = np.linalg.solve(h + damping * np.diag(np.diag(h)), -j.T @ r)
        new = residual(v + step)
        if new @ new < r @ r:
            v, r, damping = v + step, new, damping / 3
        else:
            damping *= 3
    return float(np.exp(v[0])), float(np.exp(v[1]))


def principal_layout(pts: DataFrame, k: int, extent: float = 10.0) -> DataFrame:
    """(id, z): the points (id, x) on their first k principal axes, scaled so that the first axis' standard deviation is a tenth of extent; a stated small spread by id keeps coincident points apart.

    Sums of products are added up in the cluster, a matrix of width x width in all.
    """

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, None, None
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                n, s, q = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if q is None else q)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([s.tolist()]), pa.array([q.ravel().tolist()])], names=["n", "s", "q"])

    part = pts.select("x").mapInArrow(moments, "n double, s array<double>, q array<double>")
    # one row a task, added by position
    add = lambda c: part.select(F.posexplode(c)).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").toArrow().column("v").to_numpy()
    n, s, q = part.agg(F.sum("n")).first()[0], add("s"), add("q")
    mean, width = s / n, len(s)
    value, vector = np.linalg.eigh(q.reshape(width, width) / n - np.outer(mean, mean))
    axes = vector[:, ::-1][:, :k]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)
    # rounded, so that the order of the additions doesn't show
    axes = np.round(axes * extent / 10 / np.sqrt(max(value[-1], 1e-300)), 8)
    mean = np.round(mean, 8)
    if axes.shape[1] < k:
        axes = np.pad(axes, ((0, 0), (0, k - axes.shape[1])))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = matrix(batch.column(1)) - mean
            z = np.zeros((len(ids), k))
            for f in range(width if len(ids) else 0):  # feature by feature: the same for any batch
                z += x[:, f, None] * axes[None, f]
            z += 1e-4 * np.sin(ids[:, None] * (1.0 + np.arange(k)[None]) * 12.9898)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], names=["id", "z"])

    return pts.select("id", "x").mapInArrow(place, "id long, z array<double>")


def step(y: np.ndarray, i: np.ndarray, j: np.ndarray, a: float, b: float, rate: float, rng: np.random.Generator) -> None:
    """Pull the points of the given edges together, and push each first one away from NEGATIVE random points of y."""
    n, k = y.shape

    def move(at: np.ndarray, by: np.ndarray) -> None:
        for c in range(k):
            y[:, c] += np.bincount(at, by[:, c], minlength=n)

    gap = y[i] - y[j]
    sq = np.maximum((gap * gap).sum(axis=1), 1e-12)
    pull = np.clip((-2 * a * b * sq ** (b - 1) / (1 + a * sq**b))[:, None] * gap, -LONGEST, LONGEST) * rate
    other = rng.integers(0, n, size=len(i) * NEGATIVE)
    head = np.repeat(i, NEGATIVE)
    apart = y[head] - y[other]
    sq = (apart * apart).sum(axis=1)
    push = np.clip((2 * b / ((0.001 + sq) * (1 + a * sq**b)))[:, None] * apart, -LONGEST, LONGEST) * rate
    push[head == other] = 0
    move(i, pull)
    move(j, -pull)
    move(head, push)


class Umap:
    """A fitted layout: `placed()` gives (id, z) of the points (id, x), `transform` places others.

    sweeps: how often every two blocks meet; epochs: how often each edge may be drawn at a meeting, while the rate falls. Both together are the epochs of the layout.
    """

    def __init__(self, pts: DataFrame, k: int = 2, n_neighbors: int = 15, min_dist: float = 0.1, sweeps: int = 20, epochs: int = 10, seed: int = 0, start: DataFrame | None = None, blocks: int | None = None):
        self.k, self.n_neighbors = k, n_neighbors
        self.points = cut(pts.select("id", F.col("x").cast("array<double>").alias("x")), "points")
        self.a, self.b = curve(min_dist)
        self.graph = cut(fuzzy_graph(knn_join(self.points, self.points, n_neighbors, exclude_self=True)), "graph")
        self.blocked = BlockGraph(self.points, self.graph, blocks)
        layout = self.blocked.numbers(principal_layout(self.points, k) if start is None else start, "z", k)
        self.layout = cut(layout, "layout")
        for sweep in range(sweeps):
            for number, pairs in enumerate(matches(self.blocked.blocks)):
                new = cut(self._meet(pairs, number == 0, sweep, sweeps, epochs, (seed, sweep, number)), "layout")
                drop_scratch(pts.sparkSession, self.layout)
                self.layout = new

    def _meet(self, pairs: list[tuple[int, int]], inside: bool, sweep: int, sweeps: int, epochs: int, seed: tuple[int, ...]) -> DataFrame:
        """The layout after each pair of blocks has met. inside: edges inside the blocks take part."""
        slot = np.zeros(self.blocked.blocks, dtype=int)
        for s, pair in enumerate(pairs):
            slot[list(pair)] = s
        slots = F.array(*map(F.lit, slot.tolist()))
        k, a, b, sizes = self.k, self.a, self.b, self.blocked.sizes
        mine = self.layout.select(slots[F.col("block")].alias("slot"), F.col("block").alias("p"), F.lit(-1).alias("q"), F.lit(-1).alias("no"), F.col("y").alias("i"), F.lit(None).cast("binary").alias("j"), F.lit(None).cast("binary").alias("w"))
        met = self.blocked.chunks.where(slots[F.col("p")] == slots[F.col("q")])
        met = met if inside else met.where("p <> q")
        rows = mine.union(met.select(slots[F.col("p")].alias("slot"), "p", "q", "no", "i", "j", "w"))
        # a task a pair; its points come first, then its chunks, one by one
        dealt = rows.repartitionById(len(pairs), "slot").sortWithinPartitions("slot", F.col("no") >= 0, "p", "q", "no")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, at, y, held = None, {}, None, []

            def turns() -> None:
                for e in range(epochs):
                    rate = RATE * (1 - (sweep + e / epochs) / sweeps)
                    for i, j, w, rng in held:
                        drawn = np.flatnonzero(rng.random(len(w)) < w)
                        step(y, i[drawn], j[drawn], a, b, rate, rng)
                held.clear()

            def done() -> pa.RecordBatch:
                turns()
                names = sorted(at)
                return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([y[at[p] : at[p] + sizes[p]].tobytes() for p in names], pa.binary())], names=["block", "y"])

            for batch in batches:
                for r in range(batch.num_rows):
                    s, p, q, no = (batch.column(c)[r].as_py() for c in range(4))
                    if s != now:
                        if at:
                            yield done()
                        now, at, y = s, {}, np.zeros((0, k))
                    if no < 0:
                        at[p] = len(y)
                        y = np.concatenate([y, floats(batch.column(4), r, k)])
                        continue
                    i, j = (np.frombuffer(batch.column(c)[r].as_buffer(), dtype=np.int32).astype(np.int64) for c in (4, 5))
                    held.append((at[p] + i, at[q] + j, np.frombuffer(batch.column(6)[r].as_buffer()).copy(), np.random.default_rng((*seed, p, q, no))))
                    if sum(len(h[0]) for h in held) >= HELD:
                        turns()
            if at:
                yield done()

        return dealt.mapInArrow(run, "block int, y binary")

    def placed(self) -> DataFrame:
        return self.blocked.rows(self.layout, self.k)

    def transform(self, pts: DataFrame) -> DataFrame:
        """(id, z) of new points (id, x): the mean of their nearest fitted points, weighted by membership."""
        near = memberships(knn_join(pts.select("id", F.col("x").cast("array<double>").alias("x")), self.points, self.n_neighbors))
        placed = near.join(self.placed().withColumnRenamed("id", "dst"), "dst")
        return placed.groupBy(F.col("src").alias("id")).agg(F.array(*(F.sum(F.col("w") * F.col("z")[c]) / F.sum("w") for c in range(self.k))).alias("z"))
