"""Exemplar pixels of label sets, and soft membership."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import SMALL, join_counted, join_small, saved

CHANNELS = ("c0", "c1", "c2")


def _squared(a: str, b: str, metric: str) -> Column:
    """Squared length of the difference, or, by default, of the sum of two colours (see the decision table of the survey)."""
    if metric not in ("sum", "l2"):
        raise ValueError(f"metric {metric!r} is neither 'sum' nor 'l2'")
    sign = 1 if metric == "sum" else -1
    terms = [F.col(f"{a}.{c}") + sign * F.col(f"{b}.{c}") for c in CHANNELS]
    return terms[0] * terms[0] + terms[1] * terms[1] + terms[2] * terms[2]


def foreground_ids(df: DataFrame, label: str = "label") -> DataFrame:
    """(image_id, pid, label) of pixels that aren't background (-1)."""
    return df.filter(F.col(label) != -1).select("image_id", "pid", F.col(label).alias("label"))


def set_selection(df: DataFrame, centroids: DataFrame, most: int = 10, label: str = "label", metric: str = "sum", colours: bool = False) -> DataFrame:
    """(image_id, label, pid, rank), and with ``colours`` the channels: the pixels of each label nearest its centroid. The limit works before the shuffle."""
    points = df.filter(F.col(label) != -1).select("image_id", "pid", F.col(label).alias("label"), F.struct(*CHANNELS).alias("p"))
    means = centroids.select("image_id", "label", F.struct(*CHANNELS).alias("m"))
    near = join_small(points, means, ["image_id", "label"]).withColumn("d", _squared("p", "m", metric))
    at = F.row_number().over(Window.partitionBy("image_id", "label").orderBy("d", "pid"))
    return near.withColumn("rank", at.cast("int")).filter(F.col("rank") <= most).select("image_id", "label", "pid", "rank", *(["p.*"] if colours else []))


def exemplars(df: DataFrame, ids: DataFrame) -> DataFrame:
    """The selected pixels with their colours; pixels aren't read for those that have them."""
    if set(CHANNELS) <= set(ids.columns):
        return ids.select("image_id", "pid", "label", *CHANNELS)
    return join_small(df.select("image_id", "pid", *CHANNELS), ids.select("image_id", "label", "pid"), ["image_id", "pid"]).select("image_id", "pid", "label", *CHANNELS)


def _halved(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Places of points, halved along their widest axis until ``leaf`` or fewer are together."""
    todo, leaves = [np.arange(len(points))], []
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            leaves.append(at)
            continue
        axis = int(np.argmax(np.ptp(points[at], axis=0)))
        at = at[np.argsort(points[at, axis], kind="stable")]
        todo += [at[: len(at) // 2], at[len(at) // 2 :]]
    return leaves


def among(queries: np.ndarray, names: np.ndarray, points: np.ndarray, ids: np.ndarray, k: int, leaf: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of each query's k nearest points of another id, ties to the lower id; infinite where there are fewer.

    Points and queries are halved into leaves; a leaf of queries looks into leaves of points
    by distance of their boxes, until no box is near enough.
    """
    k = min(k, len(points))
    out, far = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), np.inf)
    if k == 0 or not len(queries):
        return out, far
    leaves = _halved(points, leaf)
    low, high = (np.array([f(points[at], axis=0) for at in leaves]) for f in (np.min, np.max))
    for at in _halved(queries, leaf):
        lo, hi = queries[at].min(0), queries[at].max(0)
        gap = np.maximum(np.maximum(low - hi, lo - high), 0)
        away = (gap * gap).sum(1) * (1 - 1e-9)
        known, d = np.zeros((len(at), 0), np.int64), np.zeros((len(at), 0))
        for place in np.argsort(away, kind="stable"):
            if known.shape[1] >= k and away[place] > d[:, k - 1].max():
                break
            others = leaves[place]
            apart = queries[at][:, None, :] - points[others][None, :, :]
            new = apart[..., 0] * apart[..., 0] + apart[..., 1] * apart[..., 1] + apart[..., 2] * apart[..., 2]
            new = np.where(names[at][:, None] == ids[others][None, :], np.inf, new)
            known, d = np.concatenate([known, np.broadcast_to(others, new.shape)], 1), np.concatenate([d, new], 1)
            best = np.lexsort((ids[known], d), axis=1)[:, : k + 1]
            known, d = np.take_along_axis(known, best, 1), np.take_along_axis(d, best, 1)
        out[at], far[at] = known[:, :k], d[:, :k]
    return out, far


def nearest(points: np.ndarray, ids: np.ndarray, k: int, leaf: int = 32) -> np.ndarray:
    """Places of each point's k nearest others (fewer, if there are fewer), ties to the lower id."""
    return among(points, ids, points, ids, min(k, len(points) - 1), leaf)[0]


#: Colours of a box, and boxes at most: with more than BOXES * BOX colours, boxes have more of them.
BOX = 10_000
BOXES = 50_000
_COLOUR = "image_id string, c0 double, c1 double, c2 double"
_NEAR = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64()), ("label", pa.int64())]))
_FOUND = f"{_COLOUR}, near array<struct<d: double, id: long, label: long>>"


def _spread(level: Column) -> Column:
    """Bits of a number of 16 bits, two zeros between any two."""
    for shift, mask in ((16, 0x0000FF0000FF), (8, 0x00F00F00F00F), (4, 0x0C30C30C30C3), (2, 0x249249249249)):
        level = level.bitwiseOR(F.shiftleft(level, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return level


def _boxed(colours: DataFrame, per_box: int) -> DataFrame:
    """Colours with a ``box``: equal shares of them in the order of a curve through colour space (bits of the channels in turn)."""
    ends = colours.groupBy("image_id").agg(*(f(c).alias(f"{n}_{c}") for c in CHANNELS for n, f in (("low", F.min), ("high", F.max))))
    level = lambda c: F.floor(F.coalesce(F.try_divide(F.col(c) - F.col(f"low_{c}"), F.col(f"high_{c}") - F.col(f"low_{c}")), F.lit(0.0)) * 65535).cast("long")
    curve = F.lit(0).cast("long")
    for k, c in enumerate(CHANNELS):
        curve = curve.bitwiseOR(F.shiftleft(_spread(level(c)), k))
    coded = saved(join_small(colours, ends, "image_id").select(*colours.columns, curve.alias("curve")), "coded")
    n = max(1, min(BOXES, -(-coded.count() // per_box)))
    return saved(coded.repartitionByRange(n, "image_id", "curve", *CHANNELS).drop("curve").withColumn("box", F.spark_partition_id()), "boxes")


def _colours(table: pa.Table) -> np.ndarray:
    return np.stack([table[c].to_numpy() for c in CHANNELS], axis=1)


def _answers(table: pa.Table, queries: np.ndarray, k: int) -> tuple[np.ndarray, list[list[dict]]]:
    """Squared distances of the k nearest members of a box's colours, and these as lists."""
    members = table["members"].combine_chunks()
    counts = pa.compute.list_value_length(members).to_numpy()
    flat = members.flatten()
    ids, labels = (flat.field(n).to_numpy() for n in ("id", "label"))
    place, d = among(queries, np.full(len(queries), -1), np.repeat(_colours(table), counts, axis=0), ids, k)
    near = zip(d.tolist(), ids[place].tolist(), labels[place].tolist(), strict=True)
    return d, [[{"d": x, "id": i, "label": label} for x, i, label in zip(*r, strict=True) if x < np.inf] for r in near]


def nearest_in_image(points: DataFrame, k: int, per_box: int = BOX, visits: int = 50_000) -> DataFrame:
    """(image_id, pid, label, near): each point's k nearest others of its image as (d, id, label), d squared; ties to the lower id.

    ``points``: (image_id, pid, label, c0, c1, c2); pids, not negative, are unique in an image. Points of one colour have the same answers but for
    themselves, and only the k + 1 with the lowest ids can be one, so it is distinct colours that search. They are dealt into boxes of colour space, each answered for itself. A
    colour whose last neighbour is further than another box's nearest edge asks that box too; the boxes' edges
    (2 * BOXES of them at most, whatever the number of points) are known to all tasks, and a box that many ask is
    asked in parts of about ``visits``. So a task holds a box and what it is asked, never an image.
    """
    points = saved(points.select("image_id", "pid", F.col("label").cast("long").alias("label"), *(F.col(c).cast("double").alias(c) for c in CHANNELS)), "points")
    key = ["image_id", *CHANNELS]
    counts = points.groupBy(*key).agg(F.count("*").alias("points"))
    lowest = Window.partitionBy(*key).orderBy("pid")
    members = points.withColumn("at", F.row_number().over(lowest)).filter(F.col("at") <= k + 1)
    members = members.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("pid").alias("id"), "label"))).alias("members"))
    dealt = _boxed(members, per_box)
    near = _search(dealt, k + 1, visits)
    table = saved(near.join(counts, key), "answers")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("pid")), 1, k)
    return join_counted(points, table, key, "points").select("image_id", "pid", "label", others.alias("near"))


def _search(dealt: DataFrame, k: int, visits: int) -> DataFrame:
    """(image_id, c0, c1, c2, near): the k nearest members of any colour of the image."""
    edges = dealt.groupBy("image_id", "box").agg(*(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in CHANNELS), F.sum(F.size("members")).alias("n"))
    edges = saved(edges, "edges")
    several = edges.groupBy("image_id").agg(F.count("*").alias("parts")).filter("parts > 1").select("image_id")
    known: dict[str, tuple[np.ndarray, ...]] = {}
    for image, rows in edges.join(several, "image_id", "left_semi").orderBy("image_id", "box").toPandas().groupby("image_id"):
        known[image] = rows["box"].to_numpy(), rows[[f"low_{c}" for c in CHANNELS]].to_numpy(), rows[[f"high_{c}" for c in CHANNELS]].to_numpy(), rows["n"].to_numpy()

    def own(table: pa.Table) -> pa.Table:
        q = _colours(table)
        d, near = _answers(table, q, k)
        image, box = table["image_id"][0].as_py(), table["box"][0].as_py()
        asked: list[list[int]] = [[]] * len(near)
        reach = d[:, k - 1] if d.shape[1] >= k else np.full(len(near), np.inf)
        if image in known:
            boxes, low, high, n = known[image]
            at_once = max(1, 2_000_000 // len(boxes))
            for a in range(0, len(q), at_once):
                some, r = q[a : a + at_once, None, :], reach[a : a + at_once].copy()
                # A box of k members has k no further than its furthest corner.
                corner = np.maximum(np.abs(some - low), np.abs(some - high))[:, n >= k]
                if corner.shape[1]:
                    r = np.minimum(r, (corner * corner).sum(2).min(1) * (1 + 1e-9))
                gap = np.maximum(np.maximum(low - some, some - high), 0)
                hit = ((gap * gap).sum(2) * (1 - 1e-9) <= r[:, None]) & (boxes != box)
                asked[a : a + at_once] = [boxes[h].tolist() for h in hit]
        columns = [table[c] for c in ("image_id", *CHANNELS)]
        return pa.table([*columns, pa.array(near, _NEAR), pa.array(asked, pa.list_(pa.int32()))], ["image_id", *CHANNELS, "near", "asked"])

    def other(table: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(queries) or not len(table):
            return pa.table([pa.array([], t) for t in (pa.string(), *(pa.float64(),) * 3, _NEAR)], ["image_id", *CHANNELS, "near"])
        return pa.table([*(queries[c] for c in ("image_id", *CHANNELS)), pa.array(_answers(table, _colours(queries), k)[1], _NEAR)], ["image_id", *CHANNELS, "near"])

    answered = saved(dealt.groupBy("image_id", "box").applyInArrow(own, f"{_FOUND}, asked array<int>"), "answered")
    told = answered.drop("asked")
    if known:
        asks = answered.select("image_id", *CHANNELS, F.explode("asked").alias("box"))
        parts = saved(asks.groupBy("image_id", "box").agg(F.ceil(F.count("*") / visits).cast("int").alias("parts")), "parts")
        asks = asks.join(F.broadcast(parts), ["image_id", "box"]).withColumn("part", F.pmod(F.xxhash64(*CHANNELS), F.col("parts")).cast("int")).drop("parts")
        copies = dealt.join(F.broadcast(parts), ["image_id", "box"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        key = ["image_id", "box", "part"]
        told = told.unionAll(copies.groupBy(*key).cogroup(asks.groupBy(*key)).applyInArrow(other, _FOUND))
    # A colour has k answers a box that it asked, at most.
    return told.groupBy("image_id", *CHANNELS).agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))


def remove_outliers(df: DataFrame, ids: DataFrame, k: int = 10, votes: int = 5, per_box: int = BOX) -> DataFrame:
    """Exemplars of whose k nearest others in their image fewer than ``votes`` have their label go (:func:`nearest_in_image`)."""
    near = nearest_in_image(exemplars(df, ids), k, per_box)
    agree = F.size(F.filter("near", lambda x: x["label"] == F.col("label")))
    return ids.join(near.filter(agree >= votes).select("image_id", "pid"), ["image_id", "pid"], "left_semi")


def _met(df: DataFrame, ids: DataFrame, sets: int, how: str) -> tuple[DataFrame, int]:
    """Pixels with ``sets`` of their image by label (label, the exemplars' mean c0, c1, c2, and ``spread``, their mean squared distance to it), and the most sets of an image.

    With more than ``sets`` a pixel is several rows, by ``part``.
    """
    members = exemplars(df, ids).groupBy("image_id", "label").agg(F.sort_array(F.collect_list(F.struct(*CHANNELS))).alias("members"))
    # From the first on, so that the mean of equal colours is that colour.
    first, each = F.col("members")[0], lambda value: F.aggregate("members", F.lit(0.0), lambda t, e: t + value(e)) / F.size("members")
    every = members.select("image_id", "label", "members", *((first[c] + each(lambda e, c=c: e[c] - first[c])).alias(c) for c in CHANNELS))
    apart = lambda e: sum(((e[c] - F.col(c)) * (e[c] - F.col(c)) for c in CHANNELS[1:]), (e["c0"] - F.col("c0")) * (e["c0"] - F.col("c0")))
    every = saved(every.select("image_id", "label", *CHANNELS, each(apart).alias("spread")), "sets")
    many = every.groupBy("image_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    part = F.pmod(F.xxhash64("label"), F.lit(-(-many // sets))).cast("int") if many > sets else F.lit(0)
    parts = every.groupBy("image_id", part.alias("part")).agg(F.sort_array(F.collect_list(F.struct("label", *CHANNELS, "spread"))).alias("sets"))
    table, few = saved(parts, "sets"), every.count() <= SMALL
    return df.join(F.broadcast(table) if few else table.hint("merge"), "image_id", how), many


def _log(s: Column, metric: str, inverse: bool, power: float) -> Column:
    """Logarithm of a pixel's mean squared distance to a set's exemplars, to the ``power``: that to their mean, and their spread."""
    if metric not in ("sum", "l2"):
        raise ValueError(f"metric {metric!r} is neither 'sum' nor 'l2'")
    sign = 1.0 if metric == "sum" else -1.0
    terms = [F.col(c) + s[c] * sign for c in CHANNELS]
    mean = terms[0] * terms[0] + terms[1] * terms[1] + terms[2] * terms[2] + s["spread"]
    return F.ln(F.greatest(mean, F.lit(1e-300))) * (-power if inverse else power)


def _compared(met: DataFrame, metric: str, inverse: bool, power: float) -> DataFrame:
    """Pixels of :func:`_met` with ``logs`` (label, g) of their sets, the greatest g (``top``) and what exp(g - top) add up to (``total``)."""
    logs = F.transform("sets", lambda s: F.struct(s["label"].alias("label"), _log(s, metric, inverse, power).alias("g")))
    out = met.withColumn("logs", logs).drop("sets").withColumn("top", F.array_max(F.transform("logs", lambda x: x["g"])))
    return out.withColumn("total", F.aggregate("logs", F.lit(0.0), lambda t, x: t + F.exp(x["g"] - F.col("top"))))


def set_probability(df: DataFrame, ids: DataFrame, metric: str = "sum", inverse: bool = False, power: float = 20.0, sets: int = 256) -> DataFrame:
    """(image_id, label, pid, p): each pixel's share of its mean distances to the sets, each to the ``power``.

    A set is the mean of its exemplars and their spread about it, of which their mean distance to any pixel is the sum. Sets travel as arrays of at most ``sets``, so a pixel is a row
    for each such array until its probabilities are known, and nothing of size
    pixels x exemplars is made. Powers are taken as differences of logarithms;
    an image of more sets adds up its pixels' parts first.
    """
    met, most = _met(df.select("image_id", "pid", *CHANNELS), ids, sets, "inner")
    out = _compared(met, metric, inverse, power)
    if most > sets:
        pixel = Window.partitionBy("image_id", "pid")
        out = out.withColumn("whole", F.max("top").over(pixel)).withColumn("total", F.sum(F.col("total") * F.exp(F.col("top") - F.col("whole"))).over(pixel)).withColumn("top", F.col("whole"))
    out = out.select("image_id", "pid", "top", "total", F.explode("logs").alias("x"))
    return out.select("image_id", F.col("x.label").alias("label"), "pid", (F.exp(F.col("x.g") - F.col("top")) / F.col("total")).alias("p"))


def most_likely(df: DataFrame, ids: DataFrame, name: str = "best", metric: str = "sum", inverse: bool = False, power: float = 20.0, sets: int = 256) -> DataFrame:
    """Pixels with the set that :func:`set_probability` gives the greatest share (of equal ones the lowest) and that share, p; both null in images without sets.

    A pixel isn't moved, unless its image has more than ``sets`` sets.
    """
    met, most = _met(df, ids, sets, "left")
    out = _compared(met, metric, inverse, power)
    out = out.withColumn(name, F.array_min(F.transform(F.filter("logs", lambda x: x["g"] == F.col("top")), lambda x: x["label"])))
    if most > sets:
        pixel = Window.partitionBy("image_id", "pid")
        out = out.withColumn("whole", F.max("top").over(pixel)).withColumn("total", F.sum(F.col("total") * F.exp(F.col("top") - F.col("whole"))).over(pixel))
        out = out.withColumn(name, F.min(F.when(F.col("top") == F.col("whole"), F.col(name))).over(pixel))
        out = out.withColumn("at", F.row_number().over(pixel.orderBy("part"))).filter("at = 1")
    return out.select(*df.columns, name, (1 / F.col("total")).alias("p"))
