"""Sparse matrices as rows (image_id, i, j, v), and solvers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.raster import dimensions
from ..sources.storage import Latest, join_small, saved


def n_grid_entries(height: int, width: int) -> int:
    return height * (4 * width - 2) - 2 * width


def n_poisson_entries(height: int, width: int) -> int:
    return height * (5 * width - 2) - 2 * width


#: Images whose entries are made by a range of their own, without a shuffle.
ALONE = 256
#: Pixels of a task of such a range, at most: what aggregates its entries holds them all.
PIXELS = 1 << 18


def _lines(sizes: DataFrame) -> DataFrame:
    """(image_id, n, width, height, pid, x, y) of all pixels of images of given sizes: arithmetic on ranges.

    ``sizes``: (image_id, width, height), or pixels, whose sizes are looked up. Up to
    ALONE images are ranges of their own, without scan, window or shuffle; more of them are dealt out by image line.
    """
    if "width" not in sizes.columns:
        sizes = dimensions(sizes)
    sizes = saved(sizes.select("image_id", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height")), "sizes")
    known = sizes.limit(ALONE + 1).collect()
    numbers = lambda df: df.select("image_id", (F.col("width") * F.col("height")).alias("n"), "width", "height", (F.col("y") * F.col("width") + F.col("x")).alias("pid"), "x", "y")
    if len(known) > ALONE:
        lines = sizes.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1)))
        return numbers(lines.repartition("image_id", "y").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1))))
    out = None
    for image, w, h in known:
        pid = F.col("id")
        y = F.expr(f"id div {w}")
        one = sizes.sparkSession.range(0, w * h, 1, max(sizes.sparkSession.sparkContext.defaultParallelism, -(-w * h // PIXELS))).select(F.lit(image).alias("image_id"), *(F.lit(v).cast("long").alias(k) for k, v in (("n", w * h), ("width", w), ("height", h))), pid.alias("pid"), (pid - y * w).alias("x"), y.alias("y"))
        out = one if out is None else out.unionAll(one)
    return numbers(sizes.withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})) if out is None else out


def _neighbours() -> tuple[Column, Column]:
    """Offsets of the 4-neighbours inside the image, and their number."""
    inside = (("y > 0", -F.col("width")), ("x > 0", F.lit(-1).cast("long")), ("x < width - 1", F.lit(1).cast("long")), ("y < height - 1", F.col("width")))
    return F.filter(F.array(*(F.when(F.expr(c), d) for c, d in inside)), lambda d: d.isNotNull()), sum((F.expr(f"cast({c} as int)") for c, _ in inside), F.lit(0))


def grid_matrix(sizes: DataFrame) -> DataFrame:
    """Adjacency of 4-neighbours, from (image_id, width, height) alone, or from pixels."""
    steps, _ = _neighbours()
    return _lines(sizes).select("image_id", F.col("pid").alias("i"), F.explode(steps).alias("d")).select("image_id", "i", (F.col("i") + F.col("d")).alias("j"), F.lit(1.0).alias("v"))


def poisson_matrix(sizes: DataFrame, neumann: bool = True, blocks: int = 1) -> DataFrame:
    """5-point Laplacian: the diagonal is the number of neighbours in the image, or 4 throughout; ``blocks`` copies down the diagonal.

    From (image_id, width, height) alone, or from pixels. An image of one pixel has the row (0, 0, 0).
    """
    steps, degree = _neighbours()
    entry = lambda d, v: F.struct(d.cast("long").alias("d"), v.cast("double").alias("v"))
    entries = F.concat(F.array(entry(F.lit(0), degree if neumann else F.lit(4.0))), F.transform(steps, lambda d: entry(d, F.lit(-1.0))))
    out = _lines(sizes).select("image_id", "n", F.col("pid").alias("i"), F.explode(entries).alias("e"))
    at = F.lit(0).cast("long")
    if blocks > 1:
        out = out.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        at = F.col("c") * F.col("n")
    return out.select("image_id", (F.col("i") + at).alias("i"), (F.col("i") + F.col("e.d") + at).alias("j"), F.col("e.v").alias("v"))


def lighting_matrix(sizes: DataFrame, light: tuple[float, float, float]) -> DataFrame:
    """Outer product of the light, for each pixel's three channels; from (image_id, width, height) alone, or from pixels."""
    cells = F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(light[r] * light[c]).alias("v")) for r in range(3) for c in range(3)))
    out = _lines(sizes).select("image_id", "pid", "n", F.explode(cells).alias("e"))
    return out.select("image_id", (F.col("pid") + F.col("e.r") * F.col("n")).alias("i"), (F.col("pid") + F.col("e.c") * F.col("n")).alias("j"), F.col("e.v").alias("v"))


def lighting_vector(pixels: DataFrame, light: tuple[float, float, float], shading: str = "s") -> DataFrame:
    n = pixels.groupBy("image_id").agg((F.max("pid") + 1).alias("n"))
    cells = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(light[c]).alias("v")) for c in range(3)))
    out = join_small(pixels.select("image_id", "pid", F.col(shading).alias("s")), n, "image_id").withColumn("e", F.explode(cells))
    return out.select("image_id", (F.col("pid") + F.col("e.c") * F.col("n")).alias("i"), (F.col("s") * F.col("e.v")).alias("v"))


def sparse_add(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """a + factor * b: one union and one aggregate with map-side combine."""
    both = a.select("image_id", "i", "j", "v").unionAll(b.select("image_id", "i", "j", (F.col("v") * factor).alias("v")))
    return both.groupBy("image_id", "i", "j").agg(F.sum("v").alias("v"))


def spmv(a: DataFrame, x: DataFrame) -> DataFrame:
    """(image_id, i, v) of a times x, x being (image_id, i, v)."""
    of = x.select("image_id", F.col("i").alias("j"), F.col("v").alias("__x"))
    return a.join(of, ["image_id", "j"]).groupBy("image_id", "i").agg(F.sum(F.col("v") * F.col("__x")).alias("v"))


def residual(a: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """(image_id, residual) relative to b, in the Euclidean norm."""
    ax = spmv(a, x).withColumnRenamed("v", "__ax")
    both = b.join(ax, ["image_id", "i"], "left").groupBy("image_id").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.coalesce("__ax", F.lit(0.0)), 2))).alias("r"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    return both.select("image_id", F.try_divide("r", "n").alias("residual"))


def relax(a: DataFrame, b: DataFrame, x: DataFrame, omega: float = 1.0, tol: float = 1e-5, max_iter: int = 1000, check: int = 10) -> DataFrame:
    """Weighted Jacobi on relations, for images too large for one task: (image_id, i, v).

    Tables are written out every round, and the one before is deleted; the residual is looked at every ``check`` rounds.
    """
    diagonal = a.filter("i = j").select("image_id", "i", F.col("v").alias("__d"))
    sides = saved(b.select("image_id", "i", F.col("v").alias("__b")).join(diagonal, ["image_id", "i"]), "sides")
    rounds = Latest(a.sparkSession, "x")
    for step in range(1, max_iter + 1):
        ax = spmv(a, x).withColumnRenamed("v", "__ax")
        new = x.join(sides, ["image_id", "i"]).join(ax, ["image_id", "i"], "left")
        x = rounds.put(new.select("image_id", "i", (F.col("v") + F.coalesce(F.try_divide(F.col("__b") - F.coalesce("__ax", F.lit(0.0)), F.col("__d")) * omega, F.lit(0.0))).alias("v")))
        if step % check == 0 and residual(a, x, b).filter(F.col("residual") > tol).isEmpty():
            break
    return x


def neighbour_sums(v: np.ndarray) -> np.ndarray:
    """Sum of the 4-neighbours inside the grid."""
    out = np.zeros_like(v)
    out[1:] += v[:-1]
    out[:-1] += v[1:]
    out[:, 1:] += v[:, :-1]
    out[:, :-1] += v[:, 1:]
    return out
