"""Generated surfaces with a known truth, as (id, x, ...). Rows are made in parallel, as many as are asked for, or one for each id of a table; a seed fixes the rows for a given number of partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOW, HIGH, HEIGHT = 1.5 * math.pi, 4.5 * math.pi, 21.0


def hashed(column: Column, seed: int, part: int) -> Column:
    """A number in [0, 1) for each value: the first 32 bits of a seeded md5, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}-{part}"), column.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)


def half_sphere_of(ids: DataFrame, seed: int = 0) -> DataFrame:
    """A unit vector for each id, uniform on the upper half: its height and its angle are hashes of the id, so the rows don't depend on partitions."""
    height, angle = hashed(F.col("id"), seed, 0), 2 * math.pi * hashed(F.col("id"), seed, 1)
    flat = F.sqrt(1 - height * height)
    return ids.select("id", F.array(flat * F.cos(angle), flat * F.sin(angle), height).alias("x"))


def swiss_roll_of(ids: DataFrame, seed: int = 0) -> DataFrame:
    """A roll's point for each id, uniform in its angle, by hashes of the id; sheet: the true coordinates."""
    return _rolled(ids.select("id", (LOW + (HIGH - LOW) * hashed(F.col("id"), seed, 0)).alias("t"), (HEIGHT * hashed(F.col("id"), seed, 1)).alias("h")))


def half_sphere(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """Unit vectors, uniform on the upper half."""
    g = spark.range(n).select("id", *(F.randn(seed + i).alias(f"g{i}") for i in range(3)))
    r = F.sqrt(sum(F.col(f"g{i}") * F.col(f"g{i}") for i in range(3)))
    return g.select("id", F.array(F.col("g0") / r, F.col("g1") / r, F.abs(F.col("g2") / r)).alias("x"))


def _arc(t):
    return 0.5 * (t * F.sqrt(1 + t * t) + F.asinh(t))


def _rolled(df: DataFrame) -> DataFrame:
    t, h = F.col("t"), F.col("h")
    return df.select("id", F.array(t * F.cos(t), h, t * F.sin(t)).alias("x"), F.array(_arc(t), h).alias("sheet"))


def swiss_roll(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A roll, uniform in its angle; sheet: the true coordinates."""
    return _rolled(spark.range(n).select("id", (LOW + (HIGH - LOW) * F.rand(seed)).alias("t"), (HEIGHT * F.rand(seed + 1)).alias("h")))


def swiss_roll_even(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A roll, uniform on its sheet: the angle of a given arc length by Newton's steps."""
    lo, hi = _arc(F.lit(LOW)), _arc(F.lit(HIGH))
    df = spark.range(n).select("id", (lo + (hi - lo) * F.rand(seed)).alias("s"), (HEIGHT * F.rand(seed + 1)).alias("h"))
    df = df.withColumn("t", F.sqrt(2 * F.col("s")))
    for _ in range(6):
        df = df.withColumn("t", F.col("t") - (_arc(F.col("t")) - F.col("s")) / F.sqrt(1 + F.col("t") * F.col("t")))
    return _rolled(df)
