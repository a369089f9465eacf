"""Shape from shading: normals, relative heights, absolute heights."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import unit
from ..sources.raster import grid_edges
from ..sources.storage import join_small, saved
from . import linalg, tiles
from .linalg import neighbour_sums
from .windows import sobel_derivative

EPSILON = 1e-7


def sobel_normals(heights: DataFrame, value: str = "v", depth: float = 1.0) -> DataFrame:
    """Unit normals (nx, ny, nz) of a height field."""
    df = sobel_derivative(sobel_derivative(heights, value, "__dy"), value, "__dx", transposed=True)
    n = unit(F.col("__dx"), F.col("__dy"), F.lit(1.0 / max(0.001, depth)))
    return df.withColumns({"nx": n[0], "ny": n[1], "nz": n[2]}).drop("__dx", "__dy")


def slope(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """The step between two unit vectors of a plane; where they agree, the step along the first one's surface."""
    x, y = a0 - b0, a1 - b1
    own = F.when(a0 == 0, F.lit(0.0)).when(a1 == 0, F.lit(1 / EPSILON)).otherwise(F.try_divide(a0, a1))
    return F.when(F.abs(x) > EPSILON, F.try_divide(y, x)).otherwise(own)


def relative_heights(normals: DataFrame) -> DataFrame:
    """(image_id, i, j, v) for each directed pair of 4-neighbours."""
    e = grid_edges(normals, "nx", "ny", "nz")
    across = F.col("dir").isin(1, 2)
    side = lambda end: F.when(across, F.col(f"{end}_nx")).otherwise(F.col(f"{end}_ny"))
    size = lambda end: F.sqrt(side(end) * side(end) + F.col(f"{end}_nz") * F.col(f"{end}_nz"))
    e = e.withColumns({f"{end}_{k}": F.try_divide(v, size(end)) for end in ("src", "dst") for k, v in (("p", side(end)), ("q", F.col(f"{end}_nz")))})
    q = slope(F.col("src_p"), F.col("src_q"), F.col("dst_p"), F.col("dst_q"))
    return e.select("image_id", F.col("src").alias("i"), F.col("dst").alias("j"), F.when(F.col("src") > F.col("dst"), -q).otherwise(q).alias("v"))


def height_rhs(relative: DataFrame) -> DataFrame:
    return relative.groupBy("image_id", "i").agg(F.sum("v").alias("v"))


def estimate_normals(pixels: DataFrame, light: tuple[float, float, float], weight: float = 1.0, shading: str = "s", tol: float = 1e-5, max_iter: int = 1500, solver: str = "tiles", tile: int = tiles.TILE, halo: int = tiles.HALO) -> DataFrame:
    """(image_id, pid, x, y, nx, ny, nz) from shading, smoothed by ``weight``.

    The system, l * l' + 2 * weight * Laplacian for a light l of unit length, falls
    apart: along the light it is (1 + 2 * weight * Laplacian) a = s for one number a
    a pixel; across the light the field is constant, and which constant, shading can't
    tell. Here it is that of the field (0, 0, 1), from which iterations start: the result is the solution nearest to it.

    ``solver``: "tiles" relaxes an image in many tasks (:func:`tiles.solve`; sides and halos of tiles by
    ``tile`` and ``halo``). "sweep" relaxes the three channels of an image, in one grouped task.
    "relax" makes the whole system as relations and relaxes that (:func:`linalg.relax`), with a shuffle or two a round.
    """
    if solver not in ("tiles", "sweep", "relax"):
        raise ValueError(f"solver {solver!r} is none of 'tiles', 'sweep', 'relax'")
    l = np.array(light, float) / np.linalg.norm(light)  # noqa: E741
    if solver == "tiles":
        along = tiles.solve(pixels, shading, 1.0, 2 * weight, tol, max_iter, tile=tile, halo=halo)
        return _directed(along, F.col("v"), l).select("image_id", "pid", "x", "y", "nx", "ny", "nz")
    if solver == "relax":
        return _relaxed_normals(pixels, l, weight, shading, tol, max_iter)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        s = pdf.s.to_numpy(float).reshape(h, w)
        n = np.zeros((3, h, w))
        n[2] = 1
        degree = neighbour_sums(np.ones((h, w)))
        red = np.add.outer(np.arange(h), np.arange(w)) % 2 == 0
        b = l[:, None, None] * s
        size = max(float(np.sqrt((b * b).sum())), 1e-300)
        for _ in range(max_iter):
            light_sum = np.tensordot(l, n, 1)
            a = l[:, None, None] * light_sum + 2 * weight * (degree * n - np.stack([neighbour_sums(v) for v in n]))
            if np.sqrt(((b - a) ** 2).sum()) <= tol * size:
                break
            for colour in (red, ~red):
                for c in range(3):
                    rest = np.tensordot(l, n, 1) - l[c] * n[c]
                    new = (b[c] - l[c] * rest + 2 * weight * neighbour_sums(n[c])) / np.maximum(l[c] ** 2 + 2 * weight * degree, 1e-300)
                    n[c][colour] = new[colour]
        return pd.DataFrame({"image_id": pdf.image_id, "pid": pdf.pid, "x": pdf.x, "y": pdf.y, "a": np.tensordot(l, n, 1).ravel()})

    df = pixels.select("image_id", "pid", "x", "y", F.col(shading).alias("s"))
    along = df.groupBy("image_id").applyInPandas(solve, "image_id string, pid long, x int, y int, a double")
    return _directed(along, F.col("a"), l).select("image_id", "pid", "x", "y", "nx", "ny", "nz")


def _directed(df: DataFrame, along: Column, light: np.ndarray) -> DataFrame:
    """Unit normals from what of them lies along the light; across it they are as (0, 0, 1) is. The third is made positive."""
    across = np.array([0.0, 0.0, 1.0]) - light * light[2]
    n = unit(*(along * float(k) + float(c) for k, c in zip(light, across, strict=True)))
    return df.withColumns({"nx": n[0], "ny": n[1], "nz": F.abs(n[2])})


def _relaxed_normals(pixels: DataFrame, light: np.ndarray, weight: float, shading: str, tol: float, max_iter: int) -> DataFrame:
    matrix = saved(linalg.sparse_add(linalg.lighting_matrix(pixels, tuple(light)), linalg.poisson_matrix(pixels, blocks=3), 2 * weight), "matrix")
    b = saved(linalg.lighting_vector(pixels, tuple(light), shading), "b")
    size = pixels.groupBy("image_id").agg((F.max("pid") + 1).alias("n"))
    start = join_small(b, size, "image_id").select("image_id", "i", F.when(F.col("i") >= 2 * F.col("n"), 1.0).otherwise(0.0).alias("v"))
    x = join_small(linalg.relax(matrix, b, start, 0.6, tol, max_iter), size, "image_id")
    channel = F.element_at(F.array(*(F.lit(float(k)) for k in light)), (F.floor(F.col("i") / F.col("n")) + 1).cast("int"))
    x = x.groupBy("image_id", (F.col("i") % F.col("n")).alias("pid")).agg(F.sum(F.col("v") * channel).alias("a"))
    out = pixels.select("image_id", "pid", "x", "y").join(x, ["image_id", "pid"])
    return _directed(out, F.col("a"), light).select("image_id", "pid", "x", "y", "nx", "ny", "nz")


def absolute_heights(relative: DataFrame, pixels: DataFrame, max_iter: int = 10_000, omega: float = 0.9, tol: float = 1e-4, solver: str = "tiles", tile: int = tiles.TILE, halo: int = tiles.HALO) -> DataFrame:
    """(image_id, pid, x, y, h) from relative heights: the first pixel pinned, solved by relaxation, scaled to 0..1.

    ``solver`` as in :func:`estimate_normals`; ``omega`` is for "sweep" and "relax".
    """
    if solver not in ("tiles", "sweep", "relax"):
        raise ValueError(f"solver {solver!r} is none of 'tiles', 'sweep', 'relax'")
    if solver == "relax":
        return _relaxed_heights(relative, pixels, max_iter, omega, tol)
    rhs = height_rhs(relative).select("image_id", F.col("i").alias("pid"), F.col("v").alias("b"))
    df = pixels.select("image_id", "pid", "x", "y").join(rhs, ["image_id", "pid"], "left").withColumn("b", F.coalesce("b", F.lit(0.0)))
    if solver == "tiles":
        return _scaled(saved(tiles.solve(df, "b", 0.0, 1.0, tol, max_iter, pinned=True, tile=tile, halo=halo), "heights"), "v")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y", "x"])
        rows, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        b = pdf.b.to_numpy(float).reshape(rows, w)
        h = np.full((rows, w), 0.5)
        degree = np.maximum(neighbour_sums(np.ones((rows, w))), 1)
        red = np.add.outer(np.arange(rows), np.arange(w)) % 2 == 0
        free = np.ones((rows, w), bool)
        free[0, 0] = False
        size = max(float(np.sqrt((b * b).sum())), 1e-300)
        for _ in range(max_iter):
            for colour in (red & free, ~red & free):
                new = (1 - omega) * h + omega * (b + neighbour_sums(h)) / degree
                h[colour] = new[colour]
            r = (b + neighbour_sums(h) - degree * h)[free]
            if np.sqrt((r * r).sum()) <= tol * size:
                break
        return pd.DataFrame({"image_id": pdf.image_id, "pid": pdf.pid, "x": pdf.x, "y": pdf.y, "h": h.ravel()})

    return _scaled(saved(df.groupBy("image_id").applyInPandas(solve, "image_id string, pid long, x int, y int, h double"), "heights"), "h")


def _scaled(df: DataFrame, value: str) -> DataFrame:
    """Heights from 0 to 1 in every image; flat ones are 0. ``df`` is read twice."""
    ends = df.groupBy("image_id").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    h = F.coalesce(F.try_divide(F.col(value) - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    return join_small(df, ends, "image_id").select("image_id", "pid", "x", "y", h.alias("h"))


def _relaxed_heights(relative: DataFrame, pixels: DataFrame, max_iter: int, omega: float, tol: float) -> DataFrame:
    first = F.col("i") == 0
    matrix = linalg.poisson_matrix(pixels).filter(~first)
    pinned = pixels.select("image_id").distinct().select("image_id", F.lit(0).cast("long").alias("i"))
    matrix = saved(matrix.unionByName(pinned.select("image_id", "i", F.col("i").alias("j"), F.lit(1.0).alias("v"))), "matrix")
    rhs = pixels.select("image_id", F.col("pid").alias("i")).join(height_rhs(relative), ["image_id", "i"], "left")
    b = saved(rhs.select("image_id", "i", F.when(first, 0.5).otherwise(F.coalesce("v", F.lit(0.0))).alias("v")), "b")
    start = b.select("image_id", "i", F.lit(0.5).alias("v"))
    x = linalg.relax(matrix, b, start, omega, tol, max_iter)
    return _scaled(pixels.select("image_id", "pid", "x", "y").join(x.select("image_id", F.col("i").alias("pid"), "v"), ["image_id", "pid"]), "v")
