"""Region adjacency and merging."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.raster import OFFSETS, grid
from ..sources.storage import join_small
from .graph import fix_map_cycles, map_until_converged


def adjacency_edges(df: DataFrame, label: str = "label", *carried: str) -> DataFrame:
    """8-connected directed pixel pairs across label changes: (image_id, src, dst, dir, src_label, dst_label)."""
    pairs = grid(df, OFFSETS, label, *carried).filter(F.col(f"src_{label}") != F.col(f"dst_{label}"))
    return pairs.withColumnsRenamed({f"src_{label}": "src_label", f"dst_{label}": "dst_label"})


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct directed label pairs."""
    return edges.select("image_id", "src_label", "dst_label").distinct()


#: Pixels along a side of a tile of :func:`boundaries`.
TILE = 256


def _touching(pdf: pd.DataFrame, tile: int) -> pd.DataFrame:
    """Boundaries within a tile and to the row and column after it: (image_id, a, b, len, total), a < b."""
    x, y = (pdf[c].to_numpy() - int(pdf[t].iloc[0]) * tile for c, t in (("x", "tx"), ("y", "ty")))
    names, codes = np.unique(pdf["label"].to_numpy(), return_inverse=True)
    label = np.full((tile + 1, tile + 1), -1)
    label[y, x] = codes
    colour = np.zeros((tile + 1, tile + 1, 3))
    colour[y, x] = pdf[["c0", "c1", "c2"]].to_numpy()
    own, after = np.s_[:tile], np.s_[1:]
    keys, apart = [], []
    # A square of four pixels belongs to the tile of its upper left one, and so do its upper and left edge and its diagonals.
    for src, dst in (((own, own), (own, after)), ((own, own), (after, own)), ((own, own), (after, after)), ((own, after), (after, own))):
        a, b = label[src], label[dst]
        met = (a >= 0) & (b >= 0) & (a != b)
        keys.append(np.minimum(a, b)[met] * len(names) + np.maximum(a, b)[met])
        d = colour[src][met] - colour[dst][met]
        apart.append(np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]))
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(apart), len(found))
    return pd.DataFrame({"image_id": pdf["image_id"].iloc[0], "a": names[found // len(names)], "b": names[found % len(names)], "len": np.bincount(at, minlength=len(found)), "total": total})


def boundaries(df: DataFrame, label: str = "label", channels: tuple[str, ...] = (), tile: int = TILE) -> DataFrame:
    """(image_id, a, b, len, total) of labels a < b that touch (8 neighbours): undirected edges, and the sum of their colour distances.

    Images are cut into tiles that overlap by a row and a column. A pixel moves once (those on a tile's first row or
    column once more, a corner three times more); edges are counted inside the tile, and only its label pairs are shuffled.
    A task holds one tile. Without ``channels`` colours aren't read, and totals are 0. Pixels
    without a label, and places without a pixel, touch nothing.
    """
    if tile < 1:
        raise ValueError("a tile has a pixel or more")
    near = lambda c: F.when(F.col(c) % tile == 0, F.array(F.expr(f"{c} div {tile}"), F.expr(f"{c} div {tile} - 1"))).otherwise(F.array(F.expr(f"{c} div {tile}")))
    colours = [F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(channels)] or [F.lit(0.0).alias(f"c{k}") for k in range(3)]
    pixels = df.select("image_id", "x", "y", F.col(label).cast("long").alias("label"), *colours).filter("label is not null")
    copies = pixels.withColumn("tx", F.explode(near("x"))).withColumn("ty", F.explode(near("y"))).filter("tx >= 0 and ty >= 0")
    found = copies.groupBy("image_id", "tx", "ty").applyInPandas(lambda pdf: _touching(pdf, tile), "image_id string, a long, b long, len long, total double")
    return found.groupBy("image_id", "a", "b").agg(F.sum("len").alias("len"), F.sum("total").alias("total"))


def _both_ways(pairs: DataFrame, *values: str) -> DataFrame:
    ways = F.array(F.struct(F.col("a").alias("src_label"), F.col("b").alias("dst_label")), F.struct(F.col("b").alias("src_label"), F.col("a").alias("dst_label")))
    return pairs.select("image_id", *values, F.explode(ways).alias("w")).select("image_id", "w.src_label", "w.dst_label", *values)


def region_adjacency(df: DataFrame, label: str = "label", tile: int = TILE) -> DataFrame:
    """Distinct directed label pairs of a raster, as :func:`adjacency` of its edges."""
    return _both_ways(boundaries(df, label, (), tile))


def boundary_stats(df: DataFrame, label: str = "label", tile: int = TILE) -> DataFrame:
    """(image_id, src_label, dst_label, len, avg_diff): edges and mean colour distance of each directed boundary.

    A boundary's two directions have the same edges: one sum serves both, so they can't differ in the last bit.
    """
    pairs = boundaries(df, label, ("c0", "c1", "c2"), tile)
    return _both_ways(pairs.withColumn("avg_diff", F.col("total") / F.col("len")), "len", "avg_diff")


def small_segment_targets(df: DataFrame, label: str = "label", least: int = 10, chroma: tuple[str, str] = ("c0", "c1")) -> DataFrame:
    """(image_id, label, target): segments below ``least`` pixels go to the adjacent one of nearest mean chroma (ties to the lower label)."""
    a, b = chroma
    means = df.groupBy("image_id", F.col(label).alias("label")).agg(F.avg(a).alias("a"), F.avg(b).alias("b"), F.count("*").alias("n"))
    pairs = region_adjacency(df, label)
    src = means.filter(F.col("n") < least).select("image_id", F.col("label").alias("src_label"), F.col("a").alias("sa"), F.col("b").alias("sb"))
    dst = means.select("image_id", F.col("label").alias("dst_label"), F.col("a").alias("da"), F.col("b").alias("db"))
    near = pairs.join(src, ["image_id", "src_label"]).join(dst, ["image_id", "dst_label"])
    dist = (F.col("sa") - F.col("da")) * (F.col("sa") - F.col("da")) + (F.col("sb") - F.col("db")) * (F.col("sb") - F.col("db"))
    best = near.groupBy("image_id", F.col("src_label").alias("label")).agg(F.min(F.struct(dist.alias("d"), "dst_label"))["dst_label"].alias("to"))
    return means.join(best, ["image_id", "label"], "left").select("image_id", "label", F.coalesce("to", "label").alias("target"))


def merge_small_segments(df: DataFrame, label: str = "label", least: int = 10, chroma: tuple[str, str] = ("c0", "c1")) -> DataFrame:
    targets = fix_map_cycles(small_segment_targets(df, label, least, chroma))
    return map_until_converged(df, targets, label)


def smooth_boundary_targets(df: DataFrame, label: str = "label", threshold: float = 0.01, longer: int = 15) -> DataFrame:
    """(image_id, label, target): over the smoothest boundary that is longer than ``longer`` edges and below ``threshold`` of the greatest colour norm."""
    norm = F.sqrt(F.col("c0") * F.col("c0") + F.col("c1") * F.col("c1") + F.col("c2") * F.col("c2"))
    most = df.groupBy("image_id").agg((F.max(norm) * threshold).alias("limit"))
    weak = join_small(boundary_stats(df, label), most, "image_id").filter((F.col("avg_diff") < F.col("limit")) & (F.col("len") > longer))
    best = weak.groupBy("image_id", F.col("src_label").alias("label")).agg(F.min(F.struct("avg_diff", "dst_label"))["dst_label"].alias("to"))
    labels = df.select("image_id", F.col(label).alias("label")).distinct()
    return labels.join(best, ["image_id", "label"], "left").select("image_id", "label", F.coalesce("to", "label").alias("target"))


def merge_smooth_boundaries(df: DataFrame, label: str = "label", threshold: float = 0.01) -> DataFrame:
    return map_until_converged(df, fix_map_cycles(smooth_boundary_targets(df, label, threshold)), label)
