"""Cells: nearest-centroid assignment, masses, sums, and ways to place and refine centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.common import _py2java
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manifoldry.functions.arrays import sq_distance

from .knn import exact_nearest, matrix, spread
from .points import hash_order, renumbered
from .shared import cut, scratch_path

#: Most numbers in a set of centroids that is sent to every task (64 MB).
MOST = 8_000_000


def centroid_matrix(cells: DataFrame | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell ids, centroids), in order of cell. A model table of checked size, or the centroids themselves, which are numbered in order."""
    if isinstance(cells, np.ndarray):
        if cells.size > MOST:
            raise ValueError(f"{len(cells)} centroids are too many for one broadcast")
        return np.arange(len(cells), dtype=np.int32), cells
    rows = cells.select("cell", "c").orderBy("cell").toArrow()
    c = matrix(rows.column("c").combine_chunks()) if rows.num_rows else np.zeros((0, 0))
    if c.size > MOST:
        raise ValueError(f"{len(c)} centroids are too many for one broadcast")
    return rows.column("cell").to_numpy(), c


def cells_frame(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(centroids)], "cell int, c array<double>")


def assign(pts: DataFrame, cells: DataFrame | np.ndarray, native: bool = False) -> DataFrame:
    """pts with cell (the nearest centroid, ties to the lowest) and sq, its squared distance. native: all in the JVM, else by matrix products in Arrow batches."""
    if native:
        return _assign_native(pts, *centroid_matrix(cells))
    ids, c = centroid_matrix(cells)
    shared = pts.sparkSession.sparkContext.broadcast((ids, c))
    at = pts.columns.index("x")
    schema = ", ".join(f"`{n}` {t}" for n, t in pts.dtypes) + ", cell int, sq double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        for batch in batches:
            _, j, d = exact_nearest(matrix(batch.column(at)), None, c, ids, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[j], pa.int32()), pa.array(d)], names=[*batch.schema.names, "cell", "sq"])

    return spread(pts, c.size).mapInArrow(run, schema)


def _products(spark: SparkSession, c: np.ndarray, offsets: np.ndarray) -> Callable[[DataFrame], DataFrame]:
    """What adds to a table with a vector __v the vector __raw: c times it, plus the offsets. Spark ML's matrix product in the JVM, by which a linear model makes its raw predictions."""
    sc = spark.sparkContext
    weights, intercepts = (_py2java(sc, x) for x in (DenseMatrix(*c.shape, c.ravel(), True), DenseVector(offsets)))
    model = sc._jvm.org.apache.spark.ml.classification.LogisticRegressionModel("manifoldry", weights, intercepts, len(c), True)
    model.setFeaturesCol("__v").setRawPredictionCol("__raw").setProbabilityCol("").setPredictionCol("")
    return lambda df: DataFrame(model.transform(df._jdf), spark)


def _assign_native(pts: DataFrame, ids: np.ndarray, c: np.ndarray) -> DataFrame:
    """Products about the centroids' mean leave the centroids that rounding could make the nearest, mostly one; their distances are then computed by differences."""
    spark = pts.sparkSession
    if not len(c):
        return pts.select("*", F.lit(None).cast("int").alias("cell"), F.lit(None).cast("double").alias("sq"))
    # of equal centroids the lowest
    some = np.sort(np.unique(c + 0.0, axis=0, return_index=True)[1])
    ids, c = ids[some], c[some]
    centre = c.mean(axis=0)
    about = c - centre
    norms = (about * about).sum(axis=1)
    q = F.zip_with("x", F.array(*(F.lit(float(v)) for v in centre)), lambda a, b: a - b)
    size = F.aggregate("__q", F.lit(0.0), lambda s, v: s + v * v) + F.lit(float(norms.max()))
    # half of it is what rounding may hide of a squared distance, of which the products are halves
    slack = F.lit(4 * (c.shape[1] + 8) * float(np.finfo(float).eps)) * size + 1e-300
    asked = spread(pts, c.size).withColumn("__q", q).withColumn("__size", size).withColumn("__slack", slack).withColumn("__v", array_to_vector("__q"))
    met = _products(spark, about, -norms / 2)(asked).withColumn("__raw", vector_to_array("__raw"))
    met = met.withColumn("__best", F.array_max("__raw")).withColumn("__least", F.col("__best") - F.col("__slack"))
    met = met.withColumn("__n", F.size(F.filter("__raw", lambda v: v >= F.col("__least"))))
    every, fits = F.sequence(F.lit(0), F.size("__raw") - 1), F.col("__size") < 1e100
    alone = F.array((F.array_position("__raw", F.col("__best")) - 1).cast("int"))
    places = F.when(fits & (F.col("__n") == 1), alone).when(fits, F.filter(every, lambda i: F.col("__raw")[i] >= F.col("__least"))).otherwise(every)
    found = cut(met.select(*pts.columns, places.alias("__places"), F.monotonically_increasing_id().alias("__row")), "places")
    # a model table of checked size
    at = spark.createDataFrame(pa.table({"__place": pa.array(np.arange(len(c)), pa.int32()), "cell": pa.array(ids, pa.int32()), "__c": pa.array(list(c), pa.list_(pa.float64()))}))
    with_sq = lambda df: df.join(F.broadcast(at), "__place").withColumn("sq", sq_distance(F.col("x"), F.col("__c")))
    one = with_sq(found.where(F.size("__places") == 1).withColumn("__place", F.col("__places")[0])).select(*pts.columns, "cell", "sq")
    many = with_sq(found.where(F.size("__places") > 1).withColumn("__place", F.explode("__places")))
    least = many.groupBy("__row").agg(*(F.first(n).alias(n) for n in pts.columns), F.min(F.struct("sq", "cell")).alias("__best"))
    return one.union(least.select(*pts.columns, F.col("__best.cell").alias("cell"), F.col("__best.sq").alias("sq")))


def masses(assigned: DataFrame, cells: DataFrame, strategy: str = "counted") -> DataFrame:
    """(cell, n, mass) of every cell: its share of the points; "uniform": all alike; "smoothed": one point more in every cell."""
    counts = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    every = cells.select("cell").join(counts, "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n"))
    totals = every.agg(F.sum("n").alias("__total"), F.count(F.lit(1)).alias("__cells"))
    mass = {"counted": F.col("n") / F.col("__total"), "uniform": F.lit(1.0) / F.col("__cells"), "smoothed": (F.col("n") + 1) / (F.col("__total") + F.col("__cells"))}[strategy]
    return every.join(F.broadcast(totals)).select("cell", "n", mass.alias("mass"))


def enough_points(assigned: DataFrame, order: str, chunk: int, rel_error: float, n_cells: int) -> int:
    """How many rows, in whole chunks of the order column (0, 1, ...), it takes until every cell has 1 / rel_error ** 2; all if none do. For data in random order."""
    need = int(np.ceil(1 / rel_error**2))
    per = assigned.groupBy("cell", F.floor(F.col(order) / chunk).alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    run = per.withColumn("s", F.sum("n").over(Window.partitionBy("cell").orderBy("chunk"))).where(F.col("s") >= need)
    first = run.groupBy("cell").agg(F.min("chunk").alias("chunk")).agg(F.count(F.lit(1)).alias("cells"), F.max("chunk").alias("last")).first()
    total = assigned.count()
    return min(total, (first["last"] + 1) * chunk) if first["cells"] == n_cells else total


def without_empty(cells: DataFrame, mass: DataFrame) -> DataFrame:
    """(cell, c, mass) of the cells that have points, numbered anew from 0 in the old order. A model table: small."""
    kept = cells.join(mass.where("mass > 0").select("cell", "mass"), "cell")
    return kept.select((F.row_number().over(Window.orderBy("cell")) - 1).cast("int").alias("cell"), "c", "mass", F.col("cell").alias("old_cell"))


def sums(assigned: DataFrame) -> DataFrame:
    """(cell, n, sum, squares): count, vector sum and sum of squared lengths of each cell. Tasks send one row a cell and feature."""
    flat = assigned.select("cell", F.posexplode("x").alias("pos", "v"))
    per = flat.groupBy("cell", "pos").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.count(F.lit(1)).alias("n"))
    packed = per.groupBy("cell").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "s"))).alias("p"), F.sum("q").alias("squares"))
    return packed.select("cell", "n", F.transform("p", lambda e: e["s"]).alias("sum"), "squares")


def partial_sums(pts: DataFrame, cells: DataFrame | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, sums, sums of squared lengths) by cell, in order of cell: one pass in which each task sends one row a cell it met."""
    ids, c = centroid_matrix(cells)
    shared = pts.sparkSession.sparkContext.broadcast((ids, c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, c = shared.value
        n, s, q = np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c))
        for batch in batches:
            x = matrix(batch.column(0))
            _, j, _ = exact_nearest(x, None, c, ids, 1)
            n += np.bincount(j, minlength=len(c))
            np.add.at(s, j, x)
            q += np.bincount(j, (x * x).sum(axis=1), minlength=len(c))
        on = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[on], pa.int32()), pa.array(n[on]), pa.array(s[on].tolist(), pa.list_(pa.float64())), pa.array(q[on])], names=["cell", "n", "sum", "squares"])

    part = pts.select("x").mapInArrow(run, "cell int, n double, sum array<double>, squares double")
    d = c.shape[1]
    total = part.groupBy("cell").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sum")[i]) for i in range(d))).alias("sum"), F.sum("squares").alias("squares"))
    n, s, q = np.zeros(len(c)), np.zeros_like(c), np.zeros(len(c))
    place = {int(x): i for i, x in enumerate(ids)}
    for r in total.collect():  # one row a cell
        i = place[r.cell]
        n[i], s[i], q[i] = r.n, r["sum"], r.squares
    return n, s, q


def lloyd(pts: DataFrame, start: DataFrame, passes: int, tolerance: float | None = None) -> tuple[DataFrame, int]:
    """Lloyd's algorithm over all points, one pass a step: (cells, passes made). An empty cell keeps its centroid. tolerance: stop when no centroid moves more than this share of its cell's RMS radius."""
    spark = pts.sparkSession
    ids, c = centroid_matrix(start)
    made = 0
    for _ in range(passes):
        n, s, q = partial_sums(pts, c)
        made += 1
        on = n > 0
        new = c.copy()
        new[on] = s[on] / n[on, None]
        # mean of |x - c|^2 about the old centroid
        spread = np.zeros(len(c))
        spread[on] = np.maximum(q[on] - 2 * (c[on] * s[on]).sum(axis=1) + n[on] * (c[on] ** 2).sum(axis=1), 0) / n[on]
        shift = np.linalg.norm(new - c, axis=1)
        c = new
        if tolerance is not None and (shift[on] <= tolerance * np.sqrt(spread[on])).all():
            break
    return cells_frame(spark, c), made


def minibatch(pts: DataFrame, start: DataFrame, passes: int = 1, chunk: int = 10_000, order: str = "id", sample: DataFrame | None = None, skip: int | None = None) -> DataFrame:
    """Mini-batch k-means: after each chunk of rows in order, every centroid is the running mean of all points assigned to it so far, all passes together.

    sample: points (id, x) that the start was made from; they are assigned to it and counted first. skip: rows of a lower order value are left out of the first pass, as a sample that
    is the beginning of the points is, so that it counts once. Points are dealt to a folder a chunk once, and a step reads its own chunk alone; sparse order values make no empty steps.
    """
    spark = pts.sparkSession
    c = centroid_matrix(start)[1].copy()
    n = np.zeros(len(c)) if sample is None else partial_sums(sample, c)[0]
    dealt = renumbered(pts.select(order, "x"), F.col(order), name="__number").withColumn("__chunk", F.floor(F.col("__number") / chunk))
    path = scratch_path(spark, "chunks")
    dealt.select(F.col(order).alias("o"), "x", "__chunk").repartition("__chunk").write.partitionBy("__chunk").parquet(path)
    held = spark.read.parquet(path)
    chunks = sorted(r[0] for r in held.select("__chunk").distinct().collect())  # a number a step of this loop
    for p in range(passes):
        for at in chunks:
            some = held.where(F.col("__chunk") == at)
            if p == 0 and skip is not None:
                some = some.where(F.col("o") >= skip)
            more, s, _ = partial_sums(some, c)
            n += more
            c += (s - more[:, None] * c) / np.maximum(n, 1)[:, None]
    return cells_frame(spark, c)


def kmeans(sample: np.ndarray, k: int, iterations: int = 25, seed: int = 0, start: np.ndarray | None = None) -> np.ndarray:
    """Lloyd on a sample in memory, from k distinct random rows, or from a given start."""
    c = (sample[np.random.default_rng(seed).choice(len(sample), k, replace=False)] if start is None else start).copy()
    at = np.arange(k)
    for _ in range(iterations):
        _, j, _ = exact_nearest(sample, None, c, at, 1)
        n = np.bincount(j, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, j, sample)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def _spread_start(pts: DataFrame, k: int, seed: int, rounds: int = 5, per_round: int = 2) -> np.ndarray:
    """k starting centroids by oversampling (Bahmani and others, 2012): in a few passes each point is drawn by its share of the squared distances to what was drawn before, about per_round * k a pass; the drawn points, weighted by
    how many points they are nearest to, are thinned to k by the same law in the driver. Draws are hashes of the ids."""
    spark = pts.sparkSession
    drawn = matrix(pts.orderBy(hash_order(F.col("id"), seed), "id").limit(1).select("x").toArrow().column("x").combine_chunks())
    for r in range(rounds):
        near = assign(pts.select("id", "x"), drawn)
        total = near.agg(F.sum("sq")).first()[0]
        if not total:
            break
        u = F.conv(F.substring(hash_order(F.col("id"), seed + 7919 * (r + 1)), 1, 8), 16, 10).cast("double") / float(1 << 32)
        more = near.where(u < F.col("sq") * (per_round * k / total)).orderBy("id").select("x").toArrow()  # per_round * k rows are expected, whatever the table
        if more.num_rows:
            drawn = np.concatenate([drawn, matrix(more.column("x").combine_chunks())])
    drawn = np.unique(drawn, axis=0)
    if len(drawn) < k:
        first = matrix(pts.orderBy(hash_order(F.col("id"), seed), "id").limit(k).select("x").toArrow().column("x").combine_chunks())
        return np.concatenate([drawn, first])[: max(k, 1)] if len(first) >= k else first
    weight = partial_sums(pts.select("x"), cells_frame(spark, drawn))[0]
    rng = np.random.default_rng(seed)
    chosen = [int(rng.choice(len(drawn), p=weight / weight.sum()))]
    least = ((drawn - drawn[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(1, k):
        p = weight * least
        # of a few draws the one that leaves least
        tried = rng.choice(len(drawn), 2 + int(np.log(k)), p=p / p.sum()) if p.sum() > 0 else [int(least.argmax())]
        left = [np.minimum(least, ((drawn - drawn[t]) ** 2).sum(axis=1)) for t in tried]
        best = int(np.argmin([(weight * v).sum() for v in left]))
        chosen.append(int(tried[best]))
        least = left[best]
    return drawn[chosen]


def table_kmeans(pts: DataFrame, k: int, init: str = "random", max_iter: int = 30, tol: float = 1e-4, seed: int = 0) -> DataFrame:
    """(cell, c): k-means over all points (id, x), one pass a step, until no centroid moves more than `tol` of its cell's RMS radius. init: "random" rows, or "spread" out by oversampling. Fewer points than k: each is a cell."""
    if init == "spread":
        start = _spread_start(pts, k, seed)
    else:
        start = matrix(pts.orderBy(hash_order(F.col("id"), seed), "id").limit(k).select("x").toArrow().column("x").combine_chunks())
    return lloyd(pts, cells_frame(pts.sparkSession, start), max_iter, tol)[0]


def farthest(sample: np.ndarray, k: int, first: int = 0) -> np.ndarray:
    """Rows of sample chosen one by one, each farthest from those before (Gonzalez); ties to the lowest row."""
    chosen = [first]
    least = ((sample - sample[first]) ** 2).sum(axis=1)
    for _ in range(1, min(k, len(sample))):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def farthest_points(pts: DataFrame, k: int, first: int) -> DataFrame:
    """(step, id): farthest-point order over a whole table from a given id, one pass a step; ties to the lowest id."""
    spark = pts.sparkSession
    chosen = [(0, first)]
    centres = [pts.where(F.col("id") == first).first()["x"]]
    for step in range(1, k):
        near = F.least(*(sq_distance(F.col("x"), F.array(*map(F.lit, c))) for c in centres)) if len(centres) > 1 else sq_distance(F.col("x"), F.array(*map(F.lit, centres[0])))
        best = pts.select("id", "x", near.alias("d")).orderBy(F.desc("d"), "id").first()
        chosen.append((step, best["id"]))
        centres.append(best["x"])
    return spark.createDataFrame(chosen, "step int, id long")


def farthest_cover(pts: DataFrame, k: int, rows: int = 8192) -> tuple[DataFrame, float]:
    """((step, id, c), radius): k points (id, x) of a table of any size that no point lies farther from than `radius`: at most twice the least possible for k points, for each level of blocks.

    Points fall into blocks of about `rows` by a hash of their ids; each block keeps its k farthest points, one by one, and how far the others are from those. What is kept goes through the same again until it is one block, whose
    farthest points are the result: two levels up to rows * rows / k points. The radius adds up what each level has left out, so it holds for this table and not only in theory. A block has 4 k points at least.
    """
    spark, rows = pts.sparkSession, max(rows, 4 * k)
    left, out = pts.select("id", F.col("x").cast("array<double>").alias("x")), 0.0
    schema = "step int, id long, x array<double>, sq double"

    def keep(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, x = table.column("id").to_numpy(), matrix(table.column("x").combine_chunks())
        at = farthest(x, k)
        # what the last choice has left farthest away
        sq = float(exact_nearest(x, None, x[at], np.arange(len(at)), 1)[2].max(initial=0))
        return pa.table({"step": pa.array(np.arange(len(at)), pa.int32()), "id": pa.array(ids[at], pa.int64()), "x": pa.array(x[at].tolist(), pa.list_(pa.float64())), "sq": pa.array([sq] * len(at), pa.float64())})

    while True:
        blocks = max(1, -(-left.count() // rows))
        block = F.pmod(F.xxhash64(F.lit(blocks), "id"), F.lit(blocks))
        kept = cut(left.select("id", "x", block.alias("__block")).groupBy("__block").applyInArrow(keep, schema), "kept")
        out += np.sqrt(kept.agg(F.max("sq")).first()[0] or 0.0)
        if blocks == 1:
            return kept.select("step", "id", F.col("x").alias("c")), float(out)
        left = kept.select("id", "x")


def allocate(counts: list[int], budget: int) -> list[int]:
    """A budget dealt in proportion to counts by largest remainders: never more than the points, and at least 1 where there are points if the budget has that many; ties to the lower index."""
    n = np.asarray(counts, dtype=float)
    out = np.zeros(len(n), dtype=int)
    open_ = n > 0
    left = min(budget, int(n.sum()))
    if left >= open_.sum():
        out[open_] = 1
    while out.sum() < left:
        share = np.where(open_, n * left / n.sum(), 0)
        lack = np.where(open_ & (out < n), share - out, -np.inf)
        whole = np.minimum(np.floor(np.maximum(lack, 0)), n - out).astype(int)
        if whole.sum() and out.sum() + whole.sum() <= left:
            out += whole
            continue
        out[int(lack.argmax())] += 1
    return out.tolist()


def split(pts: DataFrame, n_cells: int, min_points: int = 10, iterations: int = 25, seed: int = 0, most: int = MOST) -> DataFrame:
    """(parent, child, c): child cells of the parents in pts (id, x, parent), k-means inside each from its first rows in seeded hash order.

    Parents of up to `most` numbers run side by side, each in one task. A larger one is spread over all tasks, a pass a step, to the same cells up to rounding.
    """
    spark = pts.sparkSession
    counts = {r.parent: r.n for r in pts.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a parent
    width = pts.select(F.max(F.size("x"))).first()[0] or 1
    parents = sorted(counts)
    total = sum(counts.values())
    shares = dict(zip(parents, allocate([counts[p] for p in parents], min(n_cells, max(3, total // min_points)))))
    ordered = pts.select("id", "x", F.col("parent").cast("int").alias("parent"), hash_order(F.col("id"), seed).alias("h"))
    large = [p for p in parents if counts[p] * width > most and shares[p]]

    def rows(parent: int, c: np.ndarray) -> pa.Table:
        return pa.table({"parent": pa.array([parent] * len(c), pa.int32()), "child": pa.array(range(len(c)), pa.int32()), "c": pa.array(c.tolist(), pa.list_(pa.float64()))})

    def run(key: tuple, table: pa.Table) -> pa.Table:
        parent = key[0].as_py()
        x = matrix(table.sort_by([("h", "ascending"), ("id", "ascending")]).column("x").combine_chunks())
        k = shares[parent]
        return rows(parent, kmeans(x, k, iterations, start=x[:k]) if k else x[:0])

    schema = "parent int, child int, c array<double>"
    out = ordered.where(~F.col("parent").isin(large)).groupBy("parent").applyInArrow(run, schema)
    if not large:
        return out
    # the large parents' cells are a model table: at most n_cells rows
    now = {p: np.array([r.x for r in ordered.where(F.col("parent") == p).orderBy("h", "id").limit(shares[p]).collect()]) for p in large}
    theirs = ordered.where(F.col("parent").isin(large)).select("x", "parent")
    for _ in range(iterations):
        shared = spark.sparkContext.broadcast(now)

        def sums(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            n = {p: np.zeros(len(c)) for p, c in shared.value.items()}
            s = {p: np.zeros_like(c) for p, c in shared.value.items()}
            for batch in batches:
                x, parent = matrix(batch.column(0)), batch.column(1).to_numpy()
                for p in np.unique(parent).tolist():
                    c, mine = shared.value[p], x[parent == p]
                    _, j, _ = exact_nearest(mine, None, c, np.arange(len(c)), 1)
                    n[p] += np.bincount(j, minlength=len(c))
                    np.add.at(s[p], j, mine)
            met = [(p, i, n[p][i], s[p][i].tolist()) for p in n for i in np.flatnonzero(n[p]).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in met], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64())))], names=["parent", "child", "n", "s"])

        part = theirs.mapInArrow(sums, "parent int, child int, n double, s array<double>")
        for r in part.groupBy("parent", "child").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(width))).alias("s")).collect():  # one row a cell
            now[r.parent][r.child] = np.array(r.s) / r.n
        shared.destroy()
    return out.union(spark.createDataFrame(pa.concat_tables([rows(p, c) for p, c in now.items()])))
