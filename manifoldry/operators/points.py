"""Point sets (id, x): checks, samples, scans and gathers. Order is always a column; partitions have none."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from manifoldry.functions.arrays import as_vector

from .shared import cut


def points(df: DataFrame, id_col: str, x_col: str, *more: str) -> DataFrame:
    """A table of vectors as (id, x, ...). Refuses columns that aren't arrays of numbers."""
    kind = df.schema[x_col].dataType
    if not isinstance(kind, T.ArrayType) or not isinstance(kind.elementType, T.NumericType):
        raise TypeError(f"{x_col} is no array of numbers")
    return df.select(F.col(id_col).cast("long").alias("id"), as_vector(x_col).alias("x"), *more)


def from_columns(df: DataFrame, id_col: Column, columns: list[str]) -> DataFrame:
    """Numeric columns as one vector."""
    return df.select(id_col.cast("long").alias("id"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))


def n_features(pts: DataFrame) -> int:
    """The one width of all vectors; raises if there are several, or none."""
    lo, hi = pts.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if lo is None or lo != hi or lo < 1:
        raise ValueError(f"vectors have {lo} to {hi} features")
    return lo


def prefix(df: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first n rows in order: a top-n per task, then one merge."""
    return df.orderBy(order).limit(n)


def row_range(df: DataFrame, first: int, n: int, order: str = "id") -> DataFrame:
    """Rows whose order column lies in a range; reaches the scan as a pushed filter."""
    return df.where((F.col(order) >= first) & (F.col(order) < first + n))


def wrapped_range(df: DataFrame, first: int, n: int, total: int, order: str = "id") -> DataFrame:
    """n rows from first on, going on at 0 after the last."""
    return df.where(F.pmod(F.col(order) - first, F.lit(total)) < n)


def hash_order(column: Column, seed: int) -> Column:
    """A seeded order that other engines can repeat."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), column.cast("string")))


def hash_places(ids: np.ndarray, seed: int) -> np.ndarray:
    """The places of ids in hash_order, ties by id: the same order for rows in memory."""
    keys = [(hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i) for i in ids.tolist()]
    return np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)


def uniform_sample(df: DataFrame, n: int, seed: int = 0, key: str = "id") -> DataFrame:
    """A uniform sample of n rows in one pass, the least in seeded hash order; the same rows whatever the partitions."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def hash_split(df: DataFrame, shares: list[float], seed: int = 0, key: str = "id") -> DataFrame:
    """A column split: disjoint parts of about the given shares."""
    u = F.conv(F.substring(hash_order(F.col(key), seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    edge, out = 0.0, F.lit(len(shares) - 1)
    parts = []
    for i, s in enumerate(shares[:-1]):
        edge += s
        parts.append((edge, i))
    for edge, i in reversed(parts):
        out = F.when(u < edge, i).otherwise(out)
    return df.withColumn("split", out.cast("int"))


def stratified(df: DataFrame, label: str, most: Column, order: str = "id") -> DataFrame:
    """Of each label the first `most` rows in order."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def gather(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is among ids."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def renumbered(df: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """df with a column that counts its rows from 0 in the given order. Rows are dealt by range and counted inside each range, then each range is told how many come before: a row a range."""
    keys = [f"__o{i}" for i in range(len(order))]
    dealt = df.select("*", *(o.alias(k) for o, k in zip(order, keys))).repartitionByRange(*keys).withColumn("__part", F.spark_partition_id())
    dealt = cut(dealt, "ranges")
    sums = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    below = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__below"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) - 1
    return dealt.withColumn("__inside", inside).join(F.broadcast(below), "__part").withColumn(name, F.col("__below") + F.col("__inside")).select(*df.columns, name)


def shuffled(df: DataFrame, seed: int, key: str = "id", name: str = "number") -> DataFrame:
    """df in a seeded random order of the whole table, as a column that counts from 0; the same whatever the partitions."""
    return renumbered(df, hash_order(F.col(key), seed), F.col(key), name=name)


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: how many rows, and a digest of their contents, nulls and repeats included, that doesn't depend on their order: two sums, which no pair of rows cancels in."""
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)") for at in (1, 16)]
    sums = df.select(*(p.alias(f"h{i}") for i, p in enumerate(parts))).agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.sum(f"h{i}"), F.lit(0)).cast("string").alias(f"h{i}") for i in range(2)))
    return sums.select("n", F.concat_ws("-", "h0", "h1").alias("digest"))
