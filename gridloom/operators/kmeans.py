"""Lloyd k-means on three channels, each image by itself.

Centroids are a table (image_id, label, c0, c1, c2). For labelling they become
one array an image, so a point meets its image's centroids in one expression.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import SMALL, Latest, join_small, saved

CHANNELS = ("c0", "c1", "c2")


def seeds(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(image_id, label, c0, c1, c2): k points of each image by smallest MD5 of image, pixel id and seed, the same whatever the partitions.

    Fewer, if an image has fewer points. The limit works before the shuffle.
    """
    place = F.row_number().over(Window.partitionBy("image_id").orderBy(F.md5(F.concat_ws("/", "image_id", "pid", F.lit(seed))), "pid"))
    # The filter is on the window's own column: of a sum or a cast of it Spark makes no limit.
    first = points.select("image_id", "pid", *CHANNELS).withColumn("__place", place).filter(F.col("__place") <= k)
    return first.select("image_id", (F.col("__place") - 1).cast("int").alias("label"), *CHANNELS)


def distinct_seeds(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """As :func:`seeds`, of points of different colour (of equal ones the first stands for all)."""
    one = points.groupBy("image_id", *CHANNELS).agg(F.min("pid").alias("pid"))
    return seeds(one, k, seed)


#: Pixel ids of a range of :func:`drawn_seeds`.
RANGE = 1 << 16


def drawn_seeds(points: DataFrame, k: int, seed: int = 0, width: int = RANGE) -> DataFrame:
    """(image_id, label, c0, c1, c2): k points of each image drawn one by one, so that a point may come again.

    Draw j takes the point whose place in its image, by pixel id, is a number from the MD5 of image, j and seed
    modulo the image's points; the same whatever the partitions. Points are counted by ranges of ``width`` ids, and only those of a range
    that a draw falls into are put in order.
    """
    range_ = F.floor(F.col("pid") / width).cast("long")
    order = Window.partitionBy("image_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = saved(points.groupBy("image_id", range_.alias("__range")).agg(F.count("*").alias("n")), "counts")
    counts = counts.withColumn("__first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    number = lambda j: F.conv(F.substring(F.md5(F.concat_ws("/", "image_id", j.cast("string"), F.lit(seed))), 1, 15), 16, 10).cast("long")
    draws = counts.groupBy("image_id").agg(F.sum("n").alias("__n"))
    every = F.sequence(F.lit(0), F.lit(k - 1)) if k > 0 else F.array().cast("array<int>")
    draws = draws.select("image_id", F.transform(every, lambda j: F.struct(j.alias("label"), F.pmod(number(j), F.col("__n")).alias("place"))).alias("__draws"))
    own = F.filter("__draws", lambda d: (d["place"] >= F.col("__first")) & (d["place"] < F.col("__first") + F.col("n")))
    picks = join_small(counts, draws, "image_id").withColumn("__draws", own).filter(F.size("__draws") > 0).select("image_id", "__range", "__first", "__draws")
    met = join_small(points.select("image_id", "pid", *CHANNELS, range_.alias("__range")), picks, ["image_id", "__range"])
    at = F.row_number().over(Window.partitionBy("image_id", "__range").orderBy("pid")) - 1 + F.col("__first")
    here = met.withColumn("__at", at).withColumn("__d", F.explode("__draws")).filter(F.col("__d.place") == F.col("__at"))
    return here.select("image_id", F.col("__d.label").alias("label"), *CHANNELS)


def same_for_all(points: DataFrame, centroids: list[tuple[float, float, float]]) -> DataFrame:
    """The given centroids as a table, for every image."""
    rows = F.array(*(F.struct(F.lit(k).alias("label"), *(F.lit(float(v)).alias(c) for c, v in zip(CHANNELS, x, strict=True))) for k, x in enumerate(centroids)))
    return points.select("image_id").distinct().select("image_id", F.explode(rows).alias("c")).select("image_id", "c.*")


def distance(centroid: Column) -> Column:
    """Squared distance of a point to a centroid."""
    terms = [F.col(c) - centroid[c] for c in CHANNELS]
    return terms[0] * terms[0] + terms[1] * terms[1] + terms[2] * terms[2]


def _arrays(centroids: DataFrame, name: str) -> DataFrame:
    """One row an image, its centroids by label."""
    return centroids.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("label", *CHANNELS))).alias(name))


def _nearest(centroids: str) -> Column:
    """The nearest centroid's label, ties to the lowest."""
    return F.array_min(F.transform(centroids, lambda c: F.struct(distance(c).alias("d"), c["label"].alias("label"))))["label"]


#: Most centroids of an image whose distances are written out as expressions, which Spark compiles (functions of arrays it doesn't).
WRITTEN = 16


def _with_nearest(met: DataFrame, k: int, name: str) -> DataFrame:
    """Points with ``__c``, at most k centroids by label, and the label that :func:`_nearest` says."""
    if not 1 < k <= WRITTEN:
        return met.withColumn(name, _nearest("__c"))
    each = [f"__d{j}" for j in range(k)]
    met = met.withColumns({d: distance(F.get("__c", F.lit(j))) for j, d in enumerate(each)})
    label = [F.get("__c", F.lit(j))["label"] for j in range(k)]
    found = F.when(F.col(each[0]) == F.least(*each), label[0])
    for d, own in zip(each[1:], label[1:], strict=True):
        found = found.when(F.col(d) == F.least(*each), own)
    return met.withColumn(name, found.otherwise(label[0])).drop(*each)


def distances(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """(image_id, pid, label, dist) for every point and centroid of its image."""
    each = F.transform("__c", lambda c: F.struct(c["label"].alias("label"), distance(c).alias("dist")))
    met = join_small(points, _arrays(centroids, "__c"), "image_id")
    return met.select("image_id", "pid", F.explode(each).alias("d")).select("image_id", "pid", "d.label", "d.dist")


def label_points(points: DataFrame, centroids: DataFrame, name: str = "label") -> DataFrame:
    """Points with the label of the nearest centroid, ties to the lowest."""
    return join_small(points, _arrays(centroids, "__c"), "image_id").withColumn(name, _nearest("__c")).drop("__c")


def calculate_centroids(points: DataFrame, k: int | None = None, label: str = "label") -> DataFrame:
    """(image_id, label, c0, c1, c2, n): mean of each label; with k, labels 0..k-1 without points are zero."""
    means = points.groupBy("image_id", F.col(label).alias("label")).agg(*(F.avg(c).alias(c) for c in CHANNELS), F.count("*").alias("n"))
    if k is None:
        return means
    every = points.select("image_id").distinct().withColumn("label", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    out = every.join(means, ["image_id", "label"], "left")
    return out.select("image_id", "label", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in CHANNELS), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def propagate_centroids(points: DataFrame, centroids: DataFrame, label: str = "label", names: tuple[str, str, str] = ("m0", "m1", "m2")) -> DataFrame:
    """Each point with its label's centroid (null for labels without one)."""
    means = centroids.select("image_id", F.col("label").alias(label), *(F.col(c).alias(m) for c, m in zip(CHANNELS, names, strict=True)))
    return points.join(means, ["image_id", label], "left")


def step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """New centroids (image_id, label, c0, c1, c2): the mean of each label's points, zero where it has none."""
    means = label_points(points, centroids, "__label").groupBy("image_id", F.col("__label").alias("label")).agg(*(F.avg(c).alias(c) for c in CHANNELS))
    out = centroids.select("image_id", "label").join(means, ["image_id", "label"], "left")
    return out.select("image_id", "label", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in CHANNELS))


def shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(image_id, shift): root of the summed squared moves of an image's centroids."""
    both = old.alias("a").join(new.alias("b"), ["image_id", "label"])
    moved = sum(((F.col(f"a.{c}") - F.col(f"b.{c}")) * (F.col(f"a.{c}") - F.col(f"b.{c}")) for c in CHANNELS), F.lit(0.0))
    return both.groupBy("image_id").agg(F.sqrt(F.sum(moved)).alias("shift"))


#: Points of one colour go through the rounds as one where there are so many times fewer colours (of each image) than points.
FEWER = 4


def _weighed(points: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """(image_id, c0, c1, c2) that have the points' means, and the means: distinct colours with their number ``n``, if these are far fewer than points."""
    narrow = points.select("image_id", *CHANNELS)
    told = narrow.agg(F.count("*").alias("points"), F.approx_count_distinct(F.xxhash64("image_id", *CHANNELS)).alias("colours")).first()
    if told["colours"] * FEWER > told["points"]:
        return narrow, {c: F.avg(c) for c in CHANNELS}
    colours = saved(narrow.groupBy("image_id", *CHANNELS).agg(F.count("*").alias("n")), "colours")
    return colours, {c: F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum(F.when(F.col(c).isNotNull(), F.col("n")))) for c in CHANNELS}


#: Most centroids, of all images, that the driver holds.
FEW = 50_000


def _few(points: DataFrame, start: DataFrame, k: int, max_iter: int, threshold: float, n_iter: int | None) -> DataFrame:
    """(image_id, used, now): centroids at the end of :func:`cluster`, which the driver has meanwhile."""
    spark, kind = points.sparkSession, pa.list_(pa.struct([("label", pa.int64()), *((c, pa.float64()) for c in CHANNELS)]))
    now = {r["image_id"]: [(c["label"], *(math.nan if c[x] is None else float(c[x]) for x in CHANNELS)) for c in r["now"]] for r in start.collect()}
    of = start.schema["now"].dataType.elementType["label"].dataType

    def table(**states: dict[str, list[tuple]]) -> DataFrame:
        images = list(next(iter(states.values())))
        columns = [pa.array([[dict(zip(("label", *CHANNELS), c, strict=True)) for c in state[i]] for i in images], kind) for state in states.values()]
        out = spark.createDataFrame(pa.table([pa.array(images, None if images else pa.string()), *columns], ["image_id", *states]))
        return out.withColumns({n: F.transform(n, lambda c: F.struct(c["label"].cast(of).alias("label"), *(c[x].alias(x) for x in CHANNELS))) for n in states})

    used, before, going = dict(now), dict.fromkeys(now, math.inf), set(now)
    narrow, mean = _weighed(points)
    for _ in range(max_iter if n_iter is None else n_iter):
        if not going:
            break
        met = narrow.join(F.broadcast(table(__c={i: now[i] for i in going})), "image_id")
        told = _with_nearest(met, k, "__label").groupBy("image_id", "__label").agg(*(mean[c].alias(c) for c in CHANNELS)).collect()
        means = {(r["image_id"], r["__label"]): [0.0 if r[c] is None else r[c] for c in CHANNELS] for r in told}
        for image in list(going):
            new = [(c[0], *means.get((image, c[0]), (0.0, 0.0, 0.0))) for c in now[image]]
            shift = math.sqrt(sum(sum((x - y) * (x - y) for x, y in zip(a[1:], b[1:], strict=True)) for a, b in zip(now[image], new, strict=True)))
            used[image], now[image] = now[image], new
            # Not a number goes on.
            if n_iter is None and abs(shift - before[image]) <= threshold:
                going.remove(image)
            before[image] = shift
    return table(used=used, now=now)


def cluster(points: DataFrame, centroids: DataFrame, max_iter: int, threshold: float = 1.0, n_iter: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Lloyd's loop: labelled points (of the last assignment, made before the last update) and centroids.

    An image stops when its centroids' shift changes by no more than
    ``threshold`` from one round to the next; all stop after ``max_iter``;
    ``n_iter`` fixes the number of rounds. The state is one row an image. Up to FEW centroids in all
    it is on the driver, a round is one job, and the end is written. More are written
    out each round (so plans don't grow) and broadcast to the points of images
    that go on, up to SMALL images; a round moves only means, k rows a task and image.
    Where points have few colours, rounds go over these and their numbers.
    """
    centroids = saved(centroids.select("image_id", "label", *CHANNELS), "seeds")
    start, rounds = _arrays(centroids, "now"), Latest(points.sparkSession, "state")
    table = lambda name: state.select("image_id", F.explode(name).alias("c")).select("image_id", "c.*")
    k = start.agg(F.max(F.size("now"))).first()[0] or 0
    if centroids.count() <= FEW:
        state = rounds.put(_few(points, start, k, max_iter, threshold, n_iter))
        met = points.join(F.broadcast(state.select("image_id", F.col("used").alias("__c"))), "image_id")
        return _with_nearest(met, k, "label").drop("__c"), table("now")
    state = rounds.put(start.select("image_id", F.col("now").alias("used"), "now", F.lit(math.inf).alias("before"), F.lit(True).alias("going")))
    few = state.count() <= SMALL
    send = F.broadcast if few else lambda df: df
    narrow, weighed = _weighed(points)
    done = 0
    while done < (max_iter if n_iter is None else n_iter):
        turn = state.filter("going").select("image_id", F.col("now").alias("__c"))
        met = _with_nearest(narrow.join(send(turn), "image_id"), k, "__label")
        means = met.groupBy("image_id", "__label").agg(F.struct(*(weighed[c].alias(c) for c in CHANNELS)).alias("__mean"))
        means = means.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("__label", "__mean"))).alias("__means"))
        mean = lambda c: F.try_element_at("__means", c["label"])
        new = F.transform("now", lambda c: F.struct(c["label"].alias("label"), *(F.coalesce(mean(c)[x], F.lit(0.0)).alias(x) for x in CHANNELS)))
        apart = lambda a, b: sum(((a[x] - b[x]) * (a[x] - b[x]) for x in CHANNELS), F.lit(0.0))
        both = state.join(means, "image_id", "left").withColumn("new", new)
        both = both.withColumn("shift", F.sqrt(F.aggregate(F.zip_with("now", "new", apart), F.lit(0.0), lambda t, v: t + v)))
        goes = F.lit(True) if n_iter is not None else F.abs(F.col("shift") - F.col("before")) > threshold
        pick = lambda a, b: F.when(F.col("going"), F.col(a)).otherwise(F.col(b))
        state = rounds.put(both.select("image_id", pick("now", "used").alias("used"), pick("new", "now").alias("now"), pick("shift", "before").alias("before"), (F.col("going") & goes).alias("going")))
        done += 1
        if n_iter is None and state.filter("going").isEmpty():
            break
    met = points.join(send(state.select("image_id", F.col("used").alias("__c"))), "image_id")
    return _with_nearest(met, k, "label").drop("__c"), table("now")


def cluster_mllib(points: DataFrame, k: int, max_iter: int, threshold: float = 1e-4, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """As :func:`cluster`, by Spark's own estimator: labelled points and centroids of all points as one image.

    The estimator starts from its own seeds (k-means||) and stops once no centroid moves by more than ``threshold``, so its
    labels are other numbers. It finds one set of centroids, so a table of several images is an error.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    images = points.select("image_id").distinct().limit(2).collect()
    if len(images) != 1:
        raise ValueError("Spark's estimator takes the points of one image")
    vectors = points.withColumn("__v", array_to_vector(F.array(*(F.col(c).cast("double") for c in CHANNELS))))
    model = KMeans(featuresCol="__v", predictionCol="label", k=k, maxIter=max_iter, tol=threshold, seed=seed).fit(vectors)
    rows = [(images[0]["image_id"], label, *map(float, c)) for label, c in enumerate(model.clusterCenters())]
    centroids = points.sparkSession.createDataFrame(rows, "image_id string, label int, c0 double, c1 double, c2 double")
    return model.transform(vectors.drop("label")).drop("__v"), centroids


def cost(labelled: DataFrame, centroids: DataFrame) -> DataFrame:
    """(image_id, cost): summed squared distances of points to their label's centroid."""
    met = join_small(labelled, _arrays(centroids, "__c"), "image_id")
    own = F.element_at(F.filter("__c", lambda c: c["label"] == F.col("label")), 1)
    return met.withColumn("__own", own).groupBy("image_id").agg(F.sum(distance(F.col("__own"))).alias("cost"))
