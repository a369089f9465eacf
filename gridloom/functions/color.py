"""Colour conversions as functions of three columns to three columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Triple = tuple[Column, Column, Column]

# sRGB (D65) matrices and white point, transfer and Lab constants.
TO_XYZ = [(0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)]
TO_RGB = [(3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252)]
WHITE = (95.047, 100.0, 108.883)
LAB_STEP, LAB_SLOPE, LAB_SHIFT = 0.008856, 7.787, 16.0 / 116.0


def _apply(matrix: list[tuple[float, float, float]], v: Triple) -> Triple:
    return tuple(v[0] * a + v[1] * b + v[2] * c for a, b, c in matrix)


def rgb_to_xyz(r: Column, g: Column, b: Column) -> Triple:
    expand = lambda v: F.when(v > 0.04045, F.pow((v + 0.055) / 1.055, 2.4)).otherwise(v / 12.92) * 100
    return _apply(TO_XYZ, (expand(r), expand(g), expand(b)))


def xyz_to_rgb(x: Column, y: Column, z: Column) -> Triple:
    compress = lambda v: F.when(v > 0.0031308, F.pow(v, 1 / 2.4) * 1.055 - 0.055).otherwise(v * 12.92)
    return tuple(map(compress, _apply(TO_RGB, (x / 100, y / 100, z / 100))))


def xyz_to_lab(x: Column, y: Column, z: Column) -> Triple:
    f = lambda t: F.when(t > LAB_STEP, F.cbrt(t)).otherwise(t * LAB_SLOPE + LAB_SHIFT)
    fx, fy, fz = f(x / WHITE[0]), f(y / WHITE[1]), f(z / WHITE[2])
    return fy * 116 - 16, (fx - fy) * 500, (fy - fz) * 200


def lab_to_xyz(lightness: Column, a: Column, b: Column) -> Triple:
    y = (lightness + 16) / 116
    f = lambda t: F.when(t * t * t > LAB_STEP, t * t * t).otherwise((t - LAB_SHIFT) / LAB_SLOPE)
    return f(a / 500 + y) * WHITE[0], f(y) * WHITE[1], f(y - b / 200) * WHITE[2]


def rgb_to_lab(r: Column, g: Column, b: Column) -> Triple:
    return xyz_to_lab(*rgb_to_xyz(r, g, b))


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> Triple:
    return xyz_to_rgb(*lab_to_xyz(lightness, a, b))


def rgb_to_ic(r: Column, g: Column, b: Column) -> Triple:
    """Intensity and two chroma columns (the third is 3 less both); null chroma of black pixels."""
    i = (r + g + b) / 3
    return i, F.try_divide(r, i), F.try_divide(g, i)


def convert(pixels: DataFrame, converter: Callable[[Column, Column, Column], Triple], into: tuple[str, str, str] = ("c0", "c1", "c2"), of: tuple[str, str, str] = ("c0", "c1", "c2")) -> DataFrame:
    """Replace or add three channels by any converter of three columns."""
    return pixels.withColumns(dict(zip(into, converter(*map(F.col, of)), strict=True)))


def convert_batches(pixels: DataFrame, converter: Callable[[np.ndarray], np.ndarray], into: tuple[str, ...] = ("c0", "c1", "c2"), of: tuple[str, ...] = ("c0", "c1", "c2")) -> DataFrame:
    """Replace or add channels by a converter that is no column expression: it takes and gives arrays, a row a pixel.

    It sees an Arrow batch at a time (channels as 64-bit numbers, null as NaN), and may be a table, a model
    or a library's function. What it gives must be numbers, a row a pixel and ``len(into)`` columns; anything else is an error. NaN
    becomes null where the pixel had a null channel. Other columns pass through; rows stay in their partitions.
    """
    at = [pixels.columns.index(c) for c in of]
    kept = [k for k, c in enumerate(pixels.columns) if c not in into]
    schema = T.StructType([*(pixels.schema.fields[k] for k in kept), *(T.StructField(c, T.DoubleType()) for c in into)])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            given = [batch.column(k).cast(pa.float64()) for k in at]
            missing = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in given])
            found = np.asarray(converter(np.stack([c.to_numpy(zero_copy_only=False) for c in given], axis=1)))
            if found.shape != (batch.num_rows, len(into)) or found.dtype.kind not in "fiu":
                raise ValueError(f"the converter gave {found.dtype} of shape {found.shape}, not numbers of shape {(batch.num_rows, len(into))}")
            new = [pa.array(np.ascontiguousarray(found[:, k], np.float64), mask=missing & np.isnan(found[:, k].astype(np.float64))) for k in range(len(into))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *new], schema.names)

    return pixels.mapInArrow(run, schema).select(*pixels.columns, *(c for c in into if c not in pixels.columns))
