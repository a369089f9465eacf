"""Albedo intensity from sliding windows, and achromatic features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import chroma_slot
from ..sources.storage import Latest, join_small, saved

SIDE = 16
#: Most slots of a tile whose windows are added up slot by slot.
FEW = 32


def _window_sums(v: np.ndarray) -> np.ndarray:
    """Sums over all SIDE x SIDE windows, by origin: sums of two, four, eight and sixteen, along either axis."""
    width = 1
    while width < SIDE:
        v = v[:-width] + v[width:]
        v = v[:, :-width] + v[:, width:]
        width *= 2
    return v


def _tile(x: np.ndarray, y: np.ndarray, light: np.ndarray, before: np.ndarray, slots: np.ndarray, width: int, height: int, n_iter: int) -> np.ndarray:
    """New albedo of a tile's pixels (those of its halo come out wrong)."""
    left, top = x.min(), y.min()
    at = y - top, x - left
    shape = int(at[0].max()) + 1, int(at[1].max()) + 1
    i, a, slot = np.zeros(shape), np.full(shape, np.nan), np.full(shape, -1)
    i[at], a[at], slot[at] = light, before, slots
    count = np.ones(shape)
    within = lambda at, most: np.minimum(np.minimum(at + 1, most - at), SIDE)  # noqa: E731  windows along one axis, as functions.scalar.contributions has them
    count[at] = within(x, width) * within(y, height)
    # Each slot's mean intensity by window, on the part of the tile that the slot's windows cover.
    # With many slots these are kept by pixel instead, for the SIDE x SIDE windows that have it: the rounds' work and memory don't grow with slots.
    parts, found = [], np.unique(slot[slot >= 0])
    told = np.zeros((*shape, SIDE, SIDE)) if len(found) > FEW else None
    for s in found:
        rows, columns = np.nonzero(slot == s)
        top, left = max(0, rows.min() - SIDE + 1), max(0, columns.min() - SIDE + 1)
        bottom, right = min(shape[0], rows.max() + SIDE), min(shape[1], columns.max() + SIDE)
        box = np.s_[top:bottom, left:right]
        own = slot[box] == s
        n = np.rint(_window_sums(own.astype(float)))
        mean = np.divide(_window_sums(np.where(own, i[box], 0)), n, out=np.zeros_like(n), where=n > 0)
        if told is None:
            parts.append((box, np.s_[top : bottom - SIDE + 1, left : right - SIDE + 1], own, mean))
        else:
            told[rows, columns] = sliding_window_view(np.pad(mean, SIDE - 1), (SIDE, SIDE))[rows - top, columns - left]
    for _ in range(n_iter):
        shading = _window_sums(np.divide(i, a, out=np.zeros(shape), where=np.isfinite(a) & (a != 0))) / (SIDE * SIDE)
        inverse = np.divide(1, shading, out=np.zeros_like(shading), where=shading != 0)
        new = np.full(shape, np.nan)
        if told is not None:
            every = np.einsum("yxij,yxij->yx", told, sliding_window_view(np.pad(inverse, SIDE - 1), (SIDE, SIDE)))
            new[slot >= 0] = every[slot >= 0]
        for box, windows, own, mean in parts:
            new[box][own] = _window_sums(np.pad(mean * inverse[windows], SIDE - 1))[own]
        a = new / count
    return a[at]


def _solver(rounds: int):
    def solve(table: pa.Table) -> pa.Table:
        x, y, i, a, slot = (table[c].to_numpy() for c in ("x", "y", "i", "a", "slot"))
        a = _tile(x, y, i, a, slot, table["width"][0].as_py(), table["height"][0].as_py(), rounds)
        table = table.drop_columns(["tx", "ty"]).set_column(table.column_names.index("a"), "a", pa.array(a, pa.float64()))
        return table.filter(table["carried"].is_valid())

    return solve


def tiled(pixels: DataFrame, carried: Column, halo: int, tile: int) -> DataFrame:
    """Pixels (image_id, x, y, width, height and more) once for each tile (tx, ty) that has them in itself or in its halo; ``carried`` is null in halos.

    A tile has tile * tile pixels: in images narrower (or lower) than that it is as much longer.
    """
    sides = pixels.withColumns({"__w": F.expr(f"cast(greatest({tile}, {tile * tile} div height) as int)"), "__h": F.expr(f"cast(greatest({tile}, {tile * tile} div width) as int)")})
    near = lambda c, side, most: F.sequence(F.expr(f"cast(greatest({c} - {halo}, 0) div {side} as int)"), F.expr(f"cast(least({c} + {halo}, {most} - 1) div {side} as int)"))
    copies = sides.withColumn("tx", F.explode(near("x", "__w", "width"))).withColumn("ty", F.explode(near("y", "__h", "height")))
    own = F.expr("x div __w = tx and y div __h = ty")
    return copies.withColumn("carried", F.when(own, carried)).drop("__w", "__h")


def estimate_albedo_intensity(pixels: DataFrame, intensity: str = "i", chroma: tuple[str, str] = ("cr", "cg"), slots: int = 20, n_iter: int = 5, name: str = "albedo", tile: int = 160, together: int = 5) -> DataFrame:
    """Pixels with their albedo intensity.

    A round gives each 16 x 16 window (stride 1) its mean intensity by chroma
    slot over its mean shading; a pixel's albedo is the sum of what its windows
    say, over their number. Images are cut into tiles of ``tile`` x ``tile`` pixels (or as many in a longer tile) with a halo
    of 15 pixels a round, and ``together`` rounds are made in one task by sums of sums, so that the
    pixels move once in that many rounds. Their other columns go along with them, so nothing is joined by pixel afterwards. A task holds one tile
    (with 5 rounds and 20 slots either way: about 320 MB). Images must be at least 16 pixels either way.
    """
    key = "image_id"
    size = pixels.groupBy(key).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.max(chroma[0]).alias("ma"), F.max(chroma[1]).alias("mb"))
    size = saved(size, "size")
    small = size.filter((F.col("width") < SIDE) | (F.col("height") < SIDE)).limit(1).collect()
    if small:
        raise ValueError(f"image {small[0][key]!r} is smaller than {SIDE} x {SIDE}")
    slot = chroma_slot(F.col(chroma[0]), F.col(chroma[1]), F.col("ma"), F.col("mb"), slots)
    light = F.col(intensity).cast("double")
    now = join_small(pixels, size, key).select(key, "x", "y", "width", "height", light.alias("i"), slot.alias("slot"), F.struct(*pixels.columns).alias("carried"), light.alias("a"))
    turns = Latest(pixels.sparkSession, "albedo")
    for done in range(0, n_iter, together):
        rounds = min(together, n_iter - done)
        copies = tiled(now, F.col("carried"), (SIDE - 1) * rounds, tile)
        new = copies.groupBy(key, "tx", "ty").applyInArrow(_solver(rounds), now.schema)
        new = new.withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
        now = turns.put(new) if done + together < n_iter else new
    return now.select("carried.*", F.col("a").alias(name))


def albedo_channels(df: DataFrame, albedo: str = "albedo", chroma: tuple[str, str] = ("cr", "cg")) -> DataFrame:
    """Three albedo channels: intensity times chroma, the third chroma being 3 less the others."""
    a, r, g = F.col(albedo), F.col(chroma[0]), F.col(chroma[1])
    return df.withColumns({"a0": a * r, "a1": a * g, "a2": a * (3 - r - g)})


def beta_feature(df: DataFrame, lab: tuple[str, str, str] = ("l", "a", "b"), mu: float = 1e5, name: str = "beta", of: DataFrame | None = None) -> DataFrame:
    """-mu for dark, mu for bright, 0 for other achromatic or chromatic pixels, by thresholds of the whole image.

    ``of``: the same pixels with the same colours, out of a shorter plan, to take the thresholds from.
    """
    light, a, b = map(F.col, lab)
    top = (df if of is None else of).groupBy("image_id").agg((F.max(F.abs(a)) * 0.2).alias("__wide"), F.max(light).alias("__top"))
    grey = (F.abs(a) < F.col("__wide")) & (F.abs(b) < F.col("__wide"))
    value = F.when(grey & (light < F.col("__top") * 0.2), -mu).when(grey & (light > F.col("__top") * 0.95), mu).otherwise(0.0)
    return join_small(df, top, "image_id").withColumn(name, value).drop("__wide", "__top")


def normalize_minmax(df: DataFrame, value: str, name: str | None = None) -> DataFrame:
    """Each image's values from 0 to 1; constant ones become 0."""
    ends = df.groupBy("image_id").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    scaled = F.coalesce(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    return join_small(df, ends, "image_id").withColumn(name or value, scaled).drop("__lo", "__hi")
