"""Column expressions on arrays of doubles, kernels and distances. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 1e-10


def as_vector(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("array<double>")


def _fold(a: Column, b: Column, each) -> Column:
    return F.aggregate(F.zip_with(a, b, each), F.lit(0.0), lambda s, v: s + v)


def sq_distance(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda u, v: (u - v) * (u - v))


def dot(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda u, v: u * v)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sq_distance(a, b))


def radial(sq: Column, sq_radius: Column) -> Column:
    """1 within the radius, its edge included; else 0."""
    return F.when(sq <= sq_radius, 1.0).otherwise(0.0)


def tapered(sq: Column, sq_radius: Column) -> Column:
    """Falls from 1 to 0 at the radius. Two coincident points of radius 0 are joined with weight 1."""
    return F.when(sq_radius > 0, F.greatest(F.lit(0.0), 1 - sq / sq_radius)).otherwise(F.when(sq == 0, 1.0).otherwise(0.0))


def gaussian(sq: Column, sq_radius: Column, sigma: float = 0.3333, cutoff: float = 3.0) -> Column:
    """A bell of width sigma radii, cut at cutoff widths. Two coincident points of radius 0 are joined with weight 1."""
    width = F.lit(sigma * sigma) * sq_radius
    inside = F.when(sq <= cutoff * cutoff * width, F.exp(-sq / (2 * width))).otherwise(0.0)
    return F.when(sq_radius > 0, inside).otherwise(F.when(sq == 0, 1.0).otherwise(0.0))


def kernel(name: str, sq: Column, sq_radius: Column, sigma: float = 0.3333, cutoff: float = 3.0) -> Column:
    if name == "gaussian":
        return gaussian(sq, sq_radius, sigma, cutoff)
    return {"radial": radial, "tapered": tapered}[name](sq, sq_radius)


def support(v: Column, tau: float = 1e-3) -> Column:
    """v where it reaches tau, else 0."""
    return F.when(v >= tau, v).otherwise(0.0)


def voltage_distance(v: Column, floor: float = FAR) -> Column:
    """-ln v, infinite below the floor."""
    return F.when(v >= floor, -F.ln(v)).otherwise(F.lit(float("inf")))


def unrolled(x: Column) -> tuple[Column, Column]:
    """Sheet coordinates of a swiss roll's point (t cos t, height, t sin t): arc length and height."""
    t = F.hypot(x[0], x[2])
    return 0.5 * (t * F.sqrt(1 + t * t) + F.asinh(t)), x[1]
