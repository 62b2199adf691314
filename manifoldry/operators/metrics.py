"""Scores of an embedding against its points, from tables of neighbours (id, rank, other, sq) and from coordinates. DataFrame expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def ordered_counts(df: DataFrame, value: str, groups: list[str] | None = None) -> DataFrame:
    """(groups, value, n, before): how often each value occurs in its group, and how many of the group's rows lie below it.

    Equal values combine first; values are dealt by range, counted inside each range, and each range is told what lies below it: a row a range and group. So a group of any size is shared by many tasks.
    """
    groups = groups or []
    counts = df.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    dealt = cut(counts.repartitionByRange(*groups, value).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*groups, "__part").agg(F.sum("n").alias("__s"))
    below = sums.withColumn("__below", F.sum("__s").over(Window.partitionBy(*groups).orderBy("__part")) - F.col("__s")).drop("__s")
    inside = F.sum("n").over(Window.partitionBy(*groups, "__part").orderBy(value)) - F.col("n")
    return dealt.withColumn("__inside", inside).join(below, [*groups, "__part"]).select(*groups, value, "n", (F.col("__below") + F.col("__inside")).alias("before"))


def quantiles(df: DataFrame, value: str, shares: list[float], groups: list[str] | None = None) -> DataFrame:
    """(groups, q array<double>): exact quantiles of each group's values that aren't null, linear between neighbours."""
    groups = groups or []
    ranked = ordered_counts(df.where(F.col(value).isNotNull()), value, groups)
    total = ranked.groupBy(*groups).agg(F.sum("n").alias("__n"))
    joined = ranked.join(total, groups) if groups else ranked.join(F.broadcast(total))
    picks = []
    for i, share in enumerate(shares):
        at = (F.col("__n") - 1) * share
        lo = F.floor(at)
        holds = lambda row: (F.col("before") <= row) & (row < F.col("before") + F.col("n"))
        a, b = F.max(F.when(holds(lo), F.col(value))), F.max(F.when(holds(F.ceil(at)), F.col(value)))
        picks.append((a, b, at - lo, i))
    # a group has two rows at most that hold a place that is asked for, for each share
    wanted = joined.where(" OR ".join(f"(before <= ceil((__n - 1) * {s}D) AND before + n > floor((__n - 1) * {s}D))" for s in shares))
    per = wanted.groupBy(*groups, "__n").agg(*(x.alias(f"__{name}{i}") for a, b, _, i in picks for name, x in (("a", a), ("b", b))))
    return per.select(*groups, F.array(*(F.col(f"__a{i}") + (F.col(f"__b{i}") - F.col(f"__a{i}")) * f for _, _, f, i in picks)).alias("q"))


def rank_penalty(ranked: DataFrame, n: int, k: int) -> DataFrame:
    """One row with 1 - the normalised sum of how far the ranks r of the pairs (id, other, r), k a point, exceed k.

    Pairs near in the embedding with their ranks among the points: trustworthiness; the other way round: continuity.
    """
    excess = ranked.agg(F.coalesce(F.sum(F.when(F.col("r") > k, F.col("r") - k)), F.lit(0)).alias("t"))
    return excess.select((1 - F.col("t") * 2.0 / (n * k * (2.0 * n - 3 * k - 1))).alias("score"))


def mean_radius(neighbours: DataFrame, k: int) -> DataFrame:
    """(id, r): mean distance to the k nearest."""
    return neighbours.where(F.col("rank") <= k).groupBy("id").agg(F.avg(F.sqrt("sq")).alias("r"))


def density(points_r: DataFrame, layout_r: DataFrame) -> DataFrame:
    """One row: correlation and slope of the log mean radius in the layout on that of the points; null where a radius is 0."""
    both = points_r.select("id", F.ln("r").alias("a")).join(layout_r.select("id", F.ln("r").alias("b")), "id")
    return both.agg(F.corr("a", "b").alias("density_preservation"), F.expr("regr_slope(b, a)").alias("density_slope"))


def room(points_r: DataFrame, layout_r: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, room): the median ratio of layout radius to point radius in each label."""
    both = points_r.withColumnRenamed("r", "a").join(layout_r.withColumnRenamed("r", "b"), "id").join(labels, "id").where("a > 0")
    return quantiles(both.select("label", (F.col("b") / F.col("a")).alias("v")), "v", [0.5], ["label"]).select("label", F.col("q")[0].alias("room"))


def local_radius(points_r: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, radius): the median in each label of the mean radius, against the median of all."""
    # one row
    whole = quantiles(points_r, "r", [0.5]).select(F.col("q")[0].alias("m"))
    per = quantiles(points_r.join(labels, "id").select("label", "r"), "r", [0.5], ["label"])
    return per.join(F.broadcast(whole)).select("label", (F.col("q")[0] / F.col("m")).alias("radius"))


def rank_correlation(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Spearman's correlation of the finite pairs; ties share the mean rank."""
    fine = pairs.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND abs({a}) < double('Infinity') AND abs({b}) < double('Infinity') AND NOT isnan({a}) AND NOT isnan({b})")
    # rows combine by pair of values, so a frequent value is no hot key
    pairs = fine.select(F.col(a).alias("a"), F.col(b).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("w"))
    pairs = cut(pairs, "pairs")
    ranks = lambda c: ordered_counts(fine.select(F.col(a if c == "a" else b).alias(c)), c).select(c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}"))
    # about their mean, which is known, so that nothing cancels
    middle = pairs.agg(((F.sum("w") + 1) / 2).alias("m"))
    x, y, w = F.col("ra") - F.col("m"), F.col("rb") - F.col("m"), F.col("w")
    joined = pairs.join(ranks("a"), "a").join(ranks("b"), "b").join(F.broadcast(middle))
    sums = joined.agg(F.sum(w * x * y).alias("xy"), F.sum(w * x * x).alias("xx"), F.sum(w * y * y).alias("yy"))
    return sums.select(F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.col("xx")) / F.sqrt(F.col("yy"))).alias("rank_correlation"))


def agreement(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """One row: the mean share of common members in two sets of k neighbours (Jaccard)."""
    a = one.where(F.col("rank") <= k).groupBy("id").agg(F.collect_set("other").alias("x"))
    b = two.where(F.col("rank") <= k).groupBy("id").agg(F.collect_set("other").alias("y"))
    s = F.size(F.array_intersect("x", "y"))
    return a.join(b, "id").agg(F.avg(s / (F.size("x") + F.size("y") - s)).alias("agreement"))


def torn(neighbours: DataFrame, layout: DataFrame, k: int, share: float = 0.1) -> DataFrame:
    """One row: the share of points that have a true neighbour farther away in the layout (id, z1, z2) than `share` of its width."""
    width = layout.agg(F.greatest(F.max("z1") - F.min("z1"), F.max("z2") - F.min("z2")).alias("w"))
    other = layout.select(F.col("id").alias("other"), F.col("z1").alias("o1"), F.col("z2").alias("o2"))
    joined = neighbours.where(F.col("rank") <= k).join(layout, "id").join(other, "other").join(F.broadcast(width))
    far = F.hypot(F.col("z1") - F.col("o1"), F.col("z2") - F.col("o2")) > share * F.col("w")
    return joined.groupBy("id").agg(F.max(far).alias("t")).agg(F.avg(F.col("t").cast("double")).alias("torn_share"))


def purity(assigned: DataFrame) -> DataFrame:
    """One row: the share of points that have their cell's commonest label."""
    per = assigned.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("cell").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return per.agg((F.sum("top") / F.sum("n")).alias("purity"), F.count(F.lit(1)).alias("n_cells"))


def mass_shift(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: total variation of two mass tables, the share of cells off by twice or more, and the correlation of log masses where both are positive."""
    both = a.select("cell", F.col("mass").alias("p")).join(b.select("cell", F.col("mass").alias("q")), "cell", "full").fillna(0.0, ["p", "q"])
    off = (F.greatest("p", "q") >= 2 * F.least("p", "q")).cast("double")
    logs = [F.when((F.col("p") > 0) & (F.col("q") > 0), F.ln(c)) for c in ("p", "q")]
    return both.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"), F.avg(off).alias("off_by_two"), F.corr(*logs).alias("log_correlation"))


def spread(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Mean and population deviation of the finite values of each group, and how many there are."""
    fine = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")) & (F.abs(value) < float("inf")))
    return fine.groupBy(*groups).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count(F.lit(1)).alias("n"))


def weighted_mean(df: DataFrame, value: str, weight: str, least: float) -> DataFrame:
    """One row: the mean by weight over rows of at least `least` weight with a finite value."""
    fine = df.where((F.col(weight) >= least) & F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return fine.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"), F.count(F.lit(1)).alias("n_regions"))


def majority(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label): the commonest label, ties to the lowest."""
    per = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(group).agg(F.max_by(label, F.struct("n", -F.col(label))).alias(label))


def decay(edge_rows: DataFrame, maps: DataFrame, tau: float) -> DataFrame:
    """(landmark, decay): the median over edges, whose two ends reach tau, of the change of log potential by distance."""
    a = maps.select("landmark", F.col("cell").alias("src"), F.col("v").alias("u"))
    b = maps.select("landmark", F.col("cell").alias("dst"), F.col("v").alias("v"))
    joined = edge_rows.where("src < dst AND sq > 0").join(F.broadcast(a), "src").join(F.broadcast(b), ["landmark", "dst"]).where((F.col("u") >= tau) & (F.col("v") >= tau))
    change = joined.select("landmark", (F.abs(F.ln("u") - F.ln("v")) / F.sqrt("sq")).alias("change"))
    return quantiles(change, "change", [0.5], ["landmark"]).select("landmark", F.col("q")[0].alias("decay"))


def decay_by_cell(edge_rows: DataFrame, maps: DataFrame, tau: float, radius: DataFrame, dimension: float) -> DataFrame:
    """(cell, log_density, log_rate): minus the dimension times the log of a cell's radius in radius (cell, sq_radius), and the log of the median change of log potential by distance over the cell's
    edges and the maps that reach tau at both ends, ends that are a map's own source left out. Cells without such an edge are left out."""
    a = maps.where("cell <> source AND v >= %r" % tau).select("landmark", F.col("cell").alias("src"), F.col("v").alias("u"))
    b = a.select("landmark", F.col("src").alias("dst"), F.col("u").alias("v"))
    joined = edge_rows.where("src <> dst AND sq > 0").join(F.broadcast(a), "src").join(F.broadcast(b), ["landmark", "dst"])
    change = joined.select(F.col("src").alias("cell"), (F.abs(F.ln("u") - F.ln("v")) / F.sqrt("sq")).alias("change"))
    rate = quantiles(change, "change", [0.5], ["cell"]).select("cell", F.ln(F.col("q")[0]).alias("log_rate"))
    return rate.join(radius, "cell").select("cell", (-dimension * F.ln(F.sqrt("sq_radius"))).alias("log_density"), "log_rate")


def shortcuts(edge_rows: DataFrame, sheet: DataFrame, ratio: float = 2.0) -> DataFrame:
    """One row: edges much longer on the sheet (cell, s1, s2) than in space, and cells that have one."""
    a = sheet.select(F.col("cell").alias("src"), F.col("s1").alias("a1"), F.col("s2").alias("a2"))
    b = sheet.select(F.col("cell").alias("dst"), F.col("s1").alias("b1"), F.col("s2").alias("b2"))
    far = edge_rows.where("sq > 0").join(F.broadcast(a), "src").join(F.broadcast(b), "dst").where(F.hypot(F.col("a1") - F.col("b1"), F.col("a2") - F.col("b2")) > ratio * F.sqrt("sq"))
    return far.agg(F.sum(F.when(F.col("src") < F.col("dst"), 1).otherwise(0)).alias("n_shortcuts"), F.count_distinct("src").alias("n_cells"))


def histogram(df: DataFrame, x: str, y: str, bins: int = 60, trim: float = 0.005) -> DataFrame:
    """(bx, by, n): counts on a grid between the trim and 1 - trim quantiles of both axes; rows outside are left out."""
    inside = _trimmed(df, x, y, trim)
    return inside.groupBy(_bin(x, bins).alias("bx"), _bin(y, bins).alias("by")).agg(F.count(F.lit(1)).alias("n"))


def _trimmed(df: DataFrame, x: str, y: str, trim: float) -> DataFrame:
    """Rows inside the trim and 1 - trim quantiles of both axes, with those as x_0, x_1, y_0, y_1."""
    out = df
    for c in (x, y):
        # one row
        out = out.join(F.broadcast(quantiles(df, c, [trim, 1 - trim]).select(F.col("q")[0].alias(f"{c}_0"), F.col("q")[1].alias(f"{c}_1"))))
    return out.where(" AND ".join(f"{c} >= {c}_0 AND {c} <= {c}_1" for c in (x, y)))


def _bin(c: str, bins: int) -> Column:
    return F.least(F.floor((F.col(c) - F.col(f"{c}_0")) / (F.col(f"{c}_1") - F.col(f"{c}_0")) * bins), F.lit(bins - 1)).cast("int")


def area_share(df: DataFrame, x: str, y: str, member: Column, bins: int = 60, trim: float = 0.005) -> DataFrame:
    """One row: the share of the grid's occupied bins in which over half the rows are members."""
    inside = _trimmed(df.withColumn("__member", member.cast("int")), x, y, trim)
    per = inside.groupBy(_bin(x, bins).alias("bx"), _bin(y, bins).alias("by")).agg(F.count(F.lit(1)).alias("n"), F.sum("__member").alias("m"))
    return per.agg(F.avg((F.col("m") > F.col("n") / 2).cast("double")).alias("area_share"), F.count(F.lit(1)).alias("n_bins"))


def cross_sums(one: DataFrame, two: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
    """Of two layouts (id, z) of k axes: their means, the k x k sums of products about the means, and both sums of squares. One aggregate row."""
    both = one.select("id", F.col("z").alias("a")).join(two.select("id", F.col("z").alias("b")), "id")
    means = both.agg(*(F.avg(F.col(c)[i]).alias(f"{c}{i}") for c in "ab" for i in range(k))).first()
    ma, mb = np.array(means[:k], dtype=float), np.array(means[k:], dtype=float)
    a, b = ([F.col(c)[i] - F.lit(float(m[i])) for i in range(k)] for c, m in (("a", ma), ("b", mb)))
    row = both.agg(*(F.sum(x * y) for x in a for y in b), sum(F.sum(x * x) for x in a), sum(F.sum(y * y) for y in b)).first()
    return ma, mb, np.array(row[: k * k], dtype=float).reshape(k, k), row[-2], row[-1]


def disparity(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """One row: what is left of one layout's spread after the best shift, rotation and scale of the other onto it, as a share."""
    _, _, m, aa, bb = cross_sums(one, two, k)
    return one.sparkSession.createDataFrame([(float(1 - np.linalg.svd(m, compute_uv=False).sum() ** 2 / (aa * bb)),)], "disparity double")


def align(one: DataFrame, two: DataFrame, k: int) -> DataFrame:
    """(id, z): layout one shifted, turned or reflected, and scaled onto layout two."""
    ma, mb, m, aa, _ = cross_sums(one, two, k)
    u, s, v = np.linalg.svd(m)
    turn = u @ v * (s.sum() / aa)
    z = [sum((F.col("z")[i] - float(ma[i])) * float(turn[i, j]) for i in range(k)) + float(mb[j]) for j in range(k)]
    return one.select("id", F.array(*z).alias("z"))


def rings(points: DataFrame, layout: DataFrame) -> DataFrame:
    """One row: the rank correlation of height, a point's third coordinate in points (id, x), and closeness to the middle of layout (id, z)."""
    k = layout.select(F.max(F.size("z"))).first()[0]
    middle = layout.agg(*(F.avg(F.col("z")[i]).alias(f"__m{i}") for i in range(k)))
    off = F.sqrt(sum((F.col("z")[i] - F.col(f"__m{i}")) * (F.col("z")[i] - F.col(f"__m{i}")) for i in range(k)))
    joined = points.select("id", F.col("x")[2].alias("height")).join(layout, "id").join(F.broadcast(middle)).select("height", (-off).alias("closeness"))
    return rank_correlation(joined, "height", "closeness").withColumnRenamed("rank_correlation", "rings")


def along(place: DataFrame, layout: DataFrame) -> DataFrame:
    """One row: the absolute rank correlation of place (id, s), a position along a sheet, and the position along the main axis of layout (id, z)."""
    k = layout.select(F.max(F.size("z"))).first()[0]
    means, _, m, _, _ = cross_sums(layout, layout, k)
    axis = np.linalg.eigh((m + m.T) / 2)[1][:, -1]
    at = sum((F.col("z")[i] - float(means[i])) * float(axis[i]) for i in range(k))
    return rank_correlation(place.join(layout, "id").select("s", at.alias("t")), "s", "t").select(F.abs("rank_correlation").alias("along"))


def unfolded(points: DataFrame) -> DataFrame:
    """(id, z): points (id, x) of the upper half of the unit sphere laid flat: each keeps its angle around the pole, and lies as far from the middle as from the pole along the sphere."""
    height = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("x")[2]))
    far, angle = F.acos(height), F.atan2(F.col("x")[1], F.col("x")[0])
    return points.select("id", F.array(far * F.cos(angle), far * F.sin(angle)).alias("z"))


def aspect(layout: DataFrame) -> DataFrame:
    """One row: the short side over the long side of layout (id, z) of two axes, the ratio of its two principal deviations; null if it has no extent."""
    a, b = F.col("z")[0], F.col("z")[1]
    sums = layout.agg(F.var_pop(a).alias("aa"), F.var_pop(b).alias("bb"), F.covar_pop(a, b).alias("ab"))
    middle, off = (F.col("aa") + F.col("bb")) / 2, F.hypot((F.col("aa") - F.col("bb")) / 2, F.col("ab"))
    return sums.select(F.when(middle + off > 0, F.sqrt(F.greatest(middle - off, F.lit(0.0)) / (middle + off))).alias("aspect"))


def shape(points: DataFrame, layout: DataFrame) -> DataFrame:
    """One row: what is left of points (id, x) of three axes after layout (id, z) of three is turned, shifted and scaled onto them, and the rank correlation of true and turned height."""
    true = points.select("id", F.col("x").alias("z"))
    turned = align(layout, true, 3).select("id", F.col("z")[2].alias("turned"))
    height = rank_correlation(points.select("id", F.col("x")[2].alias("height")).join(turned, "id"), "height", "turned")
    # one row each
    return disparity(true, layout, 3).join(height.select(F.col("rank_correlation").alias("height")))


def cross_validated(pts: DataFrame, labels: DataFrame, fold: Column, folds: int, k: int = 5) -> DataFrame:
    """One row: the mean over folds of the accuracy of votes of the k nearest points in the other folds, ties to the lowest label. pts: (id, x); labels: (id, label); fold: 0 to folds - 1."""
    from .knn import knn_join

    dealt = pts.select("id", "x", fold.alias("__fold"))
    per = None
    for f in range(folds):
        found = knn_join(dealt.where(F.col("__fold") == f).select("id", "x"), dealt.where(F.col("__fold") != f).select("id", "x"), k)
        one = knn_accuracy(found, labels, k)
        per = one if per is None else per.union(one)
    return per.agg(F.avg("accuracy").alias("accuracy"))


def quality(pts: DataFrame, layout: DataFrame, labels: DataFrame | None = None, k: int = 10, k_density: int = 30, sample: int | None = 5000, seed: int = 0) -> DataFrame:
    """One row: trustworthiness, continuity, density_preservation, density_slope and, with labels, knn_accuracy of a layout (id, x) of points (id, x).

    sample: on so many points, drawn by seed as stated for uniform_sample; None: on all of them.
    """
    from .knn import knn_join, pair_ranks
    from .points import hash_order, uniform_sample

    if sample is not None:
        ids = cut(uniform_sample(pts.select("id"), sample, seed), "sample")
        pts, layout = pts.join(ids, "id", "left_semi"), layout.join(ids, "id", "left_semi")
        labels = labels if labels is None else labels.join(ids, "id", "left_semi")
    pts, layout = cut(pts.select("id", "x"), "points"), cut(layout.select("id", "x"), "layout")
    n, most = pts.count(), max(k, k_density)
    near, near_z = (cut(knn_join(p, p, most, exclude_self=True), "near") for p in (pts, layout))
    first = lambda t: t.where(F.col("rank") <= k)
    out = rank_penalty(pair_ranks(first(near_z), pts), n, k).withColumnRenamed("score", "trustworthiness")
    out = out.join(rank_penalty(pair_ranks(first(near), layout), n, k).withColumnRenamed("score", "continuity"))
    out = out.join(density(mean_radius(near, k_density), mean_radius(near_z, k_density)))
    if labels is not None:
        fold = F.pmod(F.conv(F.substring(hash_order(F.col("id"), seed), 1, 8), 16, 10).cast("long"), F.lit(5))
        out = out.join(cross_validated(layout, labels, fold, 5).withColumnRenamed("accuracy", "knn_accuracy"))
    return out


def knn_accuracy(neighbours: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """One row: the share of points whose label is the commonest among their k nearest in the layout, themselves left out."""
    other = labels.select(F.col("id").alias("other"), F.col("label").alias("vote"))
    votes = majority(neighbours.where(F.col("rank") <= k).join(other, "other").select("id", "vote"), "id", "vote")
    return votes.join(labels, "id").agg(F.avg((F.col("vote") == F.col("label")).cast("double")).alias("accuracy"))
