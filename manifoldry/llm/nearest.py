"""Exact nearest neighbours by a block matrix join of int8 tiles.

Vectors are scaled to unit length and rounded to int8 with one scale a vector, once, when they are packed into blocks. A tile multiplies a block of queries by a block
of candidates in integers; the product is off from the cosine by at most a bound that follows from the two rounding errors (Cauchy-Schwarz). Pairs whose
upper bound stays under the k-th best lower bound, or the k-th best score so far, of their query are dropped; the others are computed again in double precision on the
original vectors, which travel in their own type. A heap of k a query goes from tile to tile, and the heaps of all tasks are merged.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Vectors in a block, and queries of a block that meet it at once: they bound a tile's products.
BLOCK, TILE = 4096, 512

PACKED = "block long, width int, n int, ids binary, codes binary, scales binary, errors binary, data binary"


def _blocks(vectors: DataFrame, parts: int, kind: str, most: int) -> DataFrame:
    """Vectors (id, v) in blocks of up to `most` of one width, written to the shared folder. Rows are dealt evenly first, so blocks are full however many tasks read the input."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for x, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy(zero_copy_only=False)
                some = held.setdefault(len(v), [])
                some.append((x, v))
                if len(some) >= most:
                    yield row(number, held.pop(len(v)))
                    number += 1
        for some in held.values():
            yield row(number, some)
            number += 1

    def row(block: int, some: list) -> pa.RecordBatch:
        x = np.stack([v for _, v in some])
        code, scale, error = quantised(x)
        out = [block, x.shape[1], len(some), np.array([i for i, _ in some], dtype=np.int64).tobytes(), code.tobytes(), scale.tobytes(), error.tobytes(), x.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5))], names=["block", "width", "n", "ids", "codes", "scales", "errors", "data"])

    return cut(vectors.repartition(parts).select("id", F.col("v").cast(f"array<{kind}>")).mapInArrow(pack, PACKED), "blocks")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of the rows' unit vectors, their scales, and the length of what rounding leaves."""
    x = x.astype(np.float64)
    # by the largest component first, so that no square overflows or vanishes
    x = x / np.abs(x).max(axis=1, keepdims=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scale = np.abs(u).max(axis=1) / 127
    code = np.rint(u / scale[:, None]).astype(np.int8)
    return code, scale, np.linalg.norm(u - code * scale[:, None], axis=1)


class Block:
    """A packed block's arrays."""

    def __init__(self, width: int, kind: type, ids, codes, scales, errors, data):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.codes = np.frombuffer(codes, dtype=np.int8).reshape(-1, width)
        self.scales, self.errors = np.frombuffer(scales), np.frombuffer(errors)
        self.data = np.frombuffer(data, dtype=kind).reshape(-1, width)

    @staticmethod
    def of(ids: np.ndarray, x: np.ndarray) -> Block:
        return Block(x.shape[1], x.dtype.type, ids.astype(np.int64).tobytes(), *(a.tobytes() for a in quantised(x)), x.tobytes())


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact int8 products: in float32 while every sum stays a whole number below 2**24, else in double."""
    kind = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return q.astype(kind) @ c.astype(kind).T


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of rows side by side, in double precision, added in one fixed order whatever the tile: the same pair always gets the same score."""
    dot, nq, nc = np.zeros(len(q)), np.zeros(len(q)), np.zeros(len(q))
    for d in range(q.shape[1]):
        a, b = q[:, d].astype(np.float64), c[:, d].astype(np.float64)
        dot += a * b
        nq += a * a
        nc += b * b
    return dot / (np.sqrt(nq) * np.sqrt(nc))


class Heaps:
    """The k best (score, candidate id) of each query of a block, ties to the smaller id; a query's row of another candidate of the same id counts as well."""

    def __init__(self, queries: Block, k: int):
        self.q, self.k = queries, k
        self.held: list[list[tuple[float, int]]] = [[] for _ in queries.ids]
        self.least = np.full(len(queries.ids), -np.inf)

    def meet(self, c: Block) -> None:
        for lo in range(0, len(self.q.ids), TILE):
            self._tile(lo, min(lo + TILE, len(self.q.ids)), c)

    def _tile(self, lo: int, hi: int, c: Block) -> None:
        q, k = self.q, self.k
        near = _product(q.codes[lo:hi], c.codes) * (q.scales[lo:hi, None] * c.scales[None])
        # u.w - code.code = e.w + code.f, with |w| = 1 and |code| <= 1 + |e|; the last term covers rounding in this line
        e = q.errors[lo:hi]
        bound = e[:, None] + (1 + e)[:, None] * c.errors[None] + 1e-9
        own = q.ids[lo:hi, None] == c.ids[None]
        low = np.where(own, -np.inf, near - bound)
        least = self.least[lo:hi]
        if len(c.ids) > k:
            least = np.maximum(least, np.partition(low, len(c.ids) - k, axis=1)[:, len(c.ids) - k] - 1e-12)
        i, j = np.nonzero((near + bound >= least[:, None]) & ~own)
        if not len(i):
            return
        i += lo
        score = cosines(q.data[i], c.data[j])
        ids = c.ids[j]
        # of many survivors of one query, no more than the k best are worth a step on its heap
        order = np.lexsort((ids, -score, i))
        i, ids, score = i[order], ids[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        for at, s, x in zip(i[best].tolist(), score[best].tolist(), ids[best].tolist()):
            heap = self.held[at]
            if len(heap) < k:
                heapq.heappush(heap, (s, -x))
            elif (s, -x) > heap[0]:
                heapq.heapreplace(heap, (s, -x))
            if len(heap) == k:
                self.least[at] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        flat = [(q, -x, s) for q, heap in zip(self.q.ids.tolist(), self.held) for s, x in heap]
        cols = list(zip(*flat)) if flat else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])


def _copies(vectors: DataFrame, k: int) -> DataFrame:
    """(id, v, copy): of equal rows k at most, numbered from 1."""
    n = vectors.groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    return n.select("v", "id", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))


def _few_copies(vectors: DataFrame, k: int) -> DataFrame:
    """(id, v) without rows that can't be among any query's k best: of equal rows k stay, and of equal vectors the 2 k rows of smallest ids,
    of which k at least have another id than a query's own. Counts combine before the shuffle and each task keeps its least, so copies are no hot group."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id", "copy"))
    return _copies(vectors, k).withColumn("r", rank).where(F.col("r") <= 2 * k).select("id", "v")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k nearest rows of vectors by cosine of each row of queries, all of them if there are fewer: query_id, rank, vec_id, score.

    A row is no neighbour of rows of its own id. Ties go to the smaller id. Null, zero or empty vectors, vectors with a null or non-finite component, and rows
    of null id take no part; vectors of other widths than the query's are no candidates. Repeated rows, equal or not: each is ranked, for each row of a repeated
    query, as in the registered SQL. Other columns are not read. No queries or no vectors: empty result.
    """
    spark = vectors.sparkSession
    given = vectors.schema[vector_col].dataType
    kind = "float" if isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType) else "double"

    def usable(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector_col}`").cast(f"array<{kind}>")
        d = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v"))
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        return d.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))

    slots = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    every = _blocks(_few_copies(usable(vectors), k), slots, kind, block)
    n = every.agg(F.sum("n")).first()[0] or 0
    asked = _blocks(_copies(usable(queries), k).select("id", "v"), max(1, min(slots, math.ceil(n / block / 8))), kind, block)
    # each block of the stated query set meets each block of rows in one slot; how often queries are sent doesn't grow with the rows
    slot = F.pmod(F.xxhash64("block"), F.lit(slots))
    names = ["ids", "codes", "scales", "errors", "data"]
    c = every.select(slot.alias("slot"), "width", *names)
    q = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"), "width", F.col("block").alias("of"), *(F.col(x).alias(f"q_{x}") for x in names))
    dtype = np.float32 if kind == "float" else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heaps = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                width, of = batch.column("width")[row].as_py(), (batch.column("of")[row].as_py(), batch.column("width")[row].as_py())
                take = lambda prefix: [batch.column(prefix + x)[row].as_buffer() for x in names]  # noqa: B023, E731
                if of != now:
                    if heaps is not None:
                        yield heaps.rows()
                    now, heaps = of, Heaps(Block(width, dtype, *take("q_")), k)
                heaps.meet(Block(width, dtype, *take("")))
        if heaps is not None:
            yield heaps.rows()

    # a sort-merge join keeps a query block's rows together and can spill
    met = q.hint("merge").join(c, ["slot", "width"]).select("of", "width", *(f"q_{x}" for x in names), *names)
    best = met.mapInArrow(run, "query_id long, vec_id long, score double")
    order: Column = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", order.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
