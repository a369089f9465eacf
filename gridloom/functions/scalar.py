"""Scalar functions of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elementwise functions by name: each takes a column and its parameters.
FUNCTORS = {
    "constant": lambda v, c: F.lit(c),
    "clamp": lambda v, lo, hi: F.greatest(F.least(v, F.lit(hi)), F.lit(lo)),
    "max": lambda v, r: F.greatest(v, F.lit(r)),
    "min": lambda v, r: F.least(v, F.lit(r)),
    "equal": lambda v, r: v == r,
    "not_equal": lambda v, r: v != r,
    "reciprocal": lambda v: F.try_divide(F.lit(1.0), v),
    "abs": lambda v: F.abs(v),
    "modulo": lambda v, m: v % m,
    "pow": lambda v, e: F.pow(v, F.lit(e)),
    "exp": lambda v: F.exp(v),
    "log": lambda v: F.ln(v),
    "divides": lambda v, r: F.try_divide(v, F.lit(r)),
    "multiplies": lambda v, r: v * r,
    "minus": lambda v, r: v - r,
    "plus": lambda v, r: v + r,
}


def floored(v: Column) -> Column:
    """At least 1/255, so that no intensity is zero."""
    return F.greatest(v, F.lit(1.0) / 255)


def quantize(v: Column) -> Column:
    """0..255: clamped to 0..1, scaled, half up."""
    return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def gamma_bytes(v: Column, gamma: float = 1 / 2.2) -> Column:
    return F.floor(F.pow(v / 255.0, F.lit(gamma)) * 255).cast("int")


def gamma(v: Column, gamma: float = 1 / 2.2) -> Column:
    return F.pow(v, F.lit(gamma))


def length(x: Column, y: Column, z: Column) -> Column:
    return F.sqrt(x * x + y * y + z * z)


def unit(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The vector at length one, its z never negative; null for the zero vector."""
    n = length(x, y, z)
    return F.try_divide(x, n), F.try_divide(y, n), F.abs(F.try_divide(z, n))


def pair_key(a: Column, b: Column) -> Column:
    """Two non-negative 31-bit numbers as one."""
    return F.shiftleft(a.cast("long"), 31) + b


def transposed_index(i: Column, rows: int, columns: int) -> Column:
    """Where element i of a rows x columns matrix, row by row, stands in its transpose."""
    return (i % columns) * rows + F.floor(i / columns)


def contributions(x: Column, y: Column, width: Column, height: Column, side: int = 16) -> Column:
    """Windows that count a pixel (over-counts where the image is narrower than 30)."""
    return F.least(x + 1, F.lit(side), width - x) * F.least(y + 1, F.lit(side), height - y)


def chroma_slot(a: Column, b: Column, most_a: Column, most_b: Column, slots: int = 20) -> Column:
    """The place of two chroma values in a table of slots - 1 columns."""
    cell = lambda v, m: F.coalesce(F.floor(F.try_divide(v, m) * (slots - 1)), F.lit(0))
    return (cell(b, most_b) * (slots - 1) + cell(a, most_a)).cast("int")
