"""Window operators. All partition by image and row or column; scans over a
whole image go by its rows' totals, so that no window holds an image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = (("image_id", "y"), "x")
COLUMN = (("image_id", "x"), "y")


def _over(along: tuple[tuple[str, ...], str]) -> Window:
    return Window.partitionBy(*along[0]).orderBy(along[1])


def run_ids(df: DataFrame, value: str = "label", along: tuple = ROW, name: str = "run") -> DataFrame:
    """Number the runs of equal values along rows or columns, from 0."""
    w = _over(along)
    change = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(0))
    return df.withColumn("__change", change).withColumn(name, F.sum("__change").over(w).cast("long")).drop("__change")


def compress_segments(df: DataFrame, value: str = "label", name: str = "segment") -> DataFrame:
    """Number the runs of equal values of each image in pixel order, from 0.

    Runs are numbered within rows first; a row's number of runs, and whether
    its first continues the row before, then say where it starts (one row of
    summary for each row of pixels).
    """
    runs = run_ids(df, value, ROW, "__run")
    rows = runs.groupBy("image_id", "y").agg(F.min_by(value, "x").alias("first"), F.max_by(value, "x").alias("last"), F.max("__run").alias("runs"))
    order = Window.partitionBy("image_id").orderBy("y")
    rows = rows.withColumn("new", F.coalesce((F.col("first") != F.lag("last").over(order)).cast("int"), F.lit(0)))
    rows = rows.withColumn("step", F.col("new") + F.coalesce(F.lag("runs").over(order), F.lit(0)))
    rows = rows.select("image_id", "y", F.sum("step").over(order).alias("__base"))
    return runs.join(rows, ["image_id", "y"]).withColumn(name, (F.col("__base") + F.col("__run")).cast("long")).drop("__base", "__run")


def prefix_scan(df: DataFrame, value: str, inclusive: bool = True, name: str = "scan") -> DataFrame:
    """Running sum of each image in pixel order: within rows, plus the rows before."""
    w = _over(ROW).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    order = Window.partitionBy("image_id").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    rows = df.groupBy("image_id", "y").agg(F.sum(value).alias("__sum")).select("image_id", "y", F.coalesce(F.sum("__sum").over(order), F.lit(0)).alias("__base"))
    here = df.withColumn("__here", F.coalesce(F.sum(value).over(w), F.lit(0)))
    return here.join(rows, ["image_id", "y"]).withColumn(name, F.col("__base") + F.col("__here")).drop("__base", "__here")


def scan_by_key(df: DataFrame, value: str, along: tuple = ROW, name: str = "scan") -> DataFrame:
    """Running sum restarted for each row or column."""
    return df.withColumn(name, F.sum(value).over(_over(along).rowsBetween(Window.unboundedPreceding, 0)))


def adjacent_difference(df: DataFrame, value: str, along: tuple = ROW, name: str = "difference") -> DataFrame:
    """Each value less the one before; the first as it is."""
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(_over(along)), F.lit(0)))


def segment_length(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy("image_id", *keys).agg(F.count("*").alias("n"))


def average_by_key(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return df.groupBy("image_id", *keys).agg(*(F.avg(v).alias(v) for v in values), F.count("*").alias("n"))


def shrink_segments(df: DataFrame, key: str, most: int, order: str = "pid") -> DataFrame:
    """The first ``most`` rows of each segment (the limit works before the shuffle)."""
    at = F.row_number().over(Window.partitionBy("image_id", key).orderBy(order))
    return df.withColumn("rank", at.cast("int")).filter(F.col("rank") <= most)


def erode_sweep(df: DataFrame, n: int = 1, label: str = "label", along: tuple = ROW) -> DataFrame:
    """Take n pixels off both ends of every run: their label becomes -1. The image's border ends a run."""
    if n <= 0:
        return df
    runs = run_ids(df, label, along, "__run")
    keys = [*along[0], "__run"]
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(along[1])))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(along[1]).desc()))
    runs = runs.withColumn("__first", first).withColumn("__last", last)
    gone = (F.col("__first") <= n) | (F.col("__last") <= n)
    return runs.withColumn(label, F.when(gone, F.lit(-1)).otherwise(F.col(label))).drop("__run", "__first", "__last")


def erode(df: DataFrame, n: int = 1, label: str = "label") -> DataFrame:
    """Erode along columns, then along rows of the result."""
    return erode_sweep(erode_sweep(df, n, label, COLUMN), n, label, ROW)


def sobel_derivative(df: DataFrame, value: str = "v", name: str = "d", transposed: bool = False) -> DataFrame:
    """1-2-1 along rows (zero outside), then lower less upper row (clamped at the border)."""
    smooth, slope = (COLUMN, ROW) if transposed else (ROW, COLUMN)
    w, s = _over(smooth), _over(slope)
    zero = F.lit(0)
    df = df.withColumn("__s", F.coalesce(F.lag(value).over(w), zero) + 2 * F.col(value) + F.coalesce(F.lead(value).over(w), zero))
    d: Column = F.coalesce(F.lead("__s").over(s), F.col("__s")) - F.coalesce(F.lag("__s").over(s), F.col("__s"))
    return df.withColumn(name, d).drop("__s")
