"""The whole segmentation: colour, albedo, clusters, regions, exemplars, memberships, and their pictures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, scalar
from ..operators import components, intrinsic, kmeans, probability
from ..sources.storage import saved

CHANNELS = ("c0", "c1", "c2")


def prepared(pixels: DataFrame, n_iter: int = 5) -> DataFrame:
    """Pixels with intensity, chroma, albedo, Lab and the achromatic feature."""
    df = pixels.withColumns({c: scalar.floored(F.col(c)) for c in CHANNELS})
    df = color.convert(df, color.rgb_to_ic, ("i", "cr", "cg"))
    lab = lambda df: color.convert(df, color.rgb_to_lab, ("l", "a", "b"))
    # The feature's thresholds come from the pixels as they were: out of the albedo they would make it twice.
    return intrinsic.beta_feature(lab(intrinsic.albedo_channels(intrinsic.estimate_albedo_intensity(df, n_iter=n_iter))), of=lab(df))


def labelled(pixels: DataFrame, k: int = 5, max_iter: int = 100, threshold: float = 1e-3, erosion: int = 10, n_iter: int = 5, start: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled pixels (cluster, component, label after erosion, -1 for background; with albedo a0, a1, a2), and exemplars of the labels.

    Pixels are never joined with pixels: what is found out of them is added to their rows.
    """
    df = saved(prepared(pixels, n_iter).drop("i", "cr", "cg", "albedo", "l"), "prepared")
    colours = {c: f"__{c}" for c in CHANNELS}
    features = df.withColumnsRenamed(colours).withColumnsRenamed({"beta": "c0", "a": "c1", "b": "c2"})
    found, _ = kmeans.cluster(features, start(features) if start else kmeans.seeds(features, k), max_iter, threshold)
    df = found.withColumnRenamed("label", "cluster").drop(*CHANNELS).withColumnsRenamed({n: c for c, n in colours.items()})
    df = components.eroded_components(df, "cluster", erosion)
    eroded = df.withColumn("label", F.when(F.col("kept"), F.col("component")).otherwise(F.lit(-1))).drop("kept")
    eroded = saved(components.compress_labels(eroded, "label", "label", background=False), "eroded")
    points = _albedo(eroded)
    means = kmeans.calculate_centroids(points.filter("label >= 0"))
    return eroded, saved(probability.set_selection(points, means, colours=True), "exemplars")


def segment(pixels: DataFrame, k: int = 5, max_iter: int = 100, threshold: float = 1e-3, erosion: int = 10, n_iter: int = 5, start: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Labelled pixels (cluster, component, label after erosion, -1 for background) and memberships (image_id, label, pid, p).

    Every image is segmented by itself, whatever other images are there. ``start`` makes the first
    centroids from the features (image_id, pid, c0, c1, c2), by default :func:`kmeans.seeds`.
    """
    found, ids = labelled(pixels, k, max_iter, threshold, erosion, n_iter, start)
    return found, probability.set_probability(_albedo(found), ids)


def with_best(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Labelled pixels (image_id, pid, cluster, component, label) with the set they most likely belong to (``best``), and how likely (``p``)."""
    return probability.most_likely(_albedo(found, "cluster", "component"), ids).drop(*CHANNELS)


def _albedo(df: DataFrame, *more: str) -> DataFrame:
    return df.select("image_id", "pid", "label", F.col("a0").alias("c0"), F.col("a1").alias("c1"), F.col("a2").alias("c2"), *more)


def pictures(labelled: DataFrame, memberships: DataFrame) -> DataFrame:
    """Pictures of a segmentation's results as one table of images (image_id, pid, x, y, c0, c1, c2).

    Of each image: ``-clusters`` and ``-components``, pixels in the mean colour of
    their label; ``-eroded``, in the mean albedo of what erosion left (one mean for all background);
    ``-prob<label>``, the membership of each set in grey. Ready for
    :func:`gridloom.sources.raster.write_images`.
    """
    names = {f"m{k}": c for k, c in enumerate(CHANNELS)}

    def means(points: DataFrame, what: str) -> DataFrame:
        out = kmeans.propagate_centroids(points, kmeans.calculate_centroids(points))
        return out.select(F.concat("image_id", F.lit(f"-{what}")).alias("image_id"), "pid", "x", "y", *(F.col(m).alias(c) for m, c in names.items()))

    colours = labelled.select("image_id", "pid", "x", "y", *CHANNELS, "cluster", "component")
    out = means(colours.withColumnRenamed("cluster", "label"), "clusters").unionAll(means(colours.withColumnRenamed("component", "label"), "components")).unionAll(means(_albedo(labelled, "x", "y"), "eroded"))
    grey = memberships.join(labelled.select("image_id", "pid", "x", "y"), ["image_id", "pid"])
    return out.unionAll(grey.select(F.concat("image_id", F.lit("-prob"), F.col("label").cast("string")), "pid", "x", "y", "p", "p", "p"))
