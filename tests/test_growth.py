"""What tasks and the driver hold, whatever the tables' size."""

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from gridloom.operators import components, csr, graph, intrinsic, kmeans, linalg, probability, windows
from gridloom.plans import segmentation
from gridloom.sources import formats, raster, storage


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pixels_are_not_joined_with_pixels(spark):
    px = raster.events_raster(spark, DATA).select("image_id", "pid", "x", "y", "c0", "c1", "c2")
    steps = plan(segmentation.prepared(px))
    # One row an image is broadcast (sizes, and ends of the features); nothing else is joined.
    assert steps.count("Join") == steps.count("strategy=broadcast") == 2


def test_most_likely_set_is_that_of_the_greatest_share(spark):
    px = raster.events_raster(spark, DATA).filter("y < 10").withColumn("label", F.expr("cast(pid % 9 as int)"))
    ids = probability.set_selection(px, kmeans.calculate_centroids(px))
    alone = px.withColumn("image_id", F.lit("no sets"))
    every = probability.set_probability(px, ids).groupBy("image_id", "pid").agg(F.min_by(F.struct("label", "p"), F.struct(-F.col("p"), F.col("label"))).alias("m"))
    want = {(r["pid"], r["m"]["label"]): r["m"]["p"] for r in every.collect()}
    for sets in (256, 4):
        rows = probability.most_likely(px.unionAll(alone), ids, sets=sets).collect()
        got = {(r["pid"], r["best"]): r["p"] for r in rows if r["image_id"] == "events"}
        assert len(rows) == 800 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
        assert all(r["best"] is None and r["p"] is None for r in rows if r["image_id"] != "events")


def test_seeds_are_limited_before_the_shuffle(spark):
    px = raster.events_raster(spark, DATA)
    for df in (kmeans.seeds(px, 7), kmeans.distinct_seeds(px, 7)):
        assert "Limit" in plan(df)  # of all rows where there is one image, or of each image
    assert kmeans.seeds(px, 0).count() == 0


def test_links_repeat_themselves_at_short_distances(spark, tmp_path):
    m = spark.range(2500).select(F.lit("a").alias("image_id"), F.lit(1).alias("cluster"), F.col("id").alias("segment"))
    links = graph.cluster_links(m)
    links.write.parquet(str(tmp_path / "links"))
    found = spark.read.parquet(str(tmp_path / "links")).agg(F.count("*"), F.countDistinct("segment_a", "segment_b"), F.sum((F.col("segment_a") == F.col("segment_b")).cast("int"))).first()
    assert tuple(found) == (2500 * 2499, 2500 * 2499, 0)
    assert sum(f.stat().st_size for f in (tmp_path / "links").glob("part-*")) < 0.5 * 2500 * 2499


def test_links_are_made_in_nested_loops_of_short_arrays(spark):
    segments = [("a", 0, s) for s in range(600)] + [("a", 1, 5), ("b", 0, 5), ("b", 0, 6), ("b", 0, 6), ("b", None, 8), ("b", 0, None), (None, 0, 1), (None, 0, 2)]
    m = spark.createDataFrame(segments, "image_id string, cluster long, segment long")
    links = graph.cluster_links(m, at_once=20_000, run=64, together=4)
    want = sorted((i, c, s, t) for i, c, s in segments for j, d, t in segments if (i, c) == (j, d) and None not in (i, c, s, t) and s != t)
    assert sorted(tuple(r) for r in links.collect()) == want
    # A lookup is for a run of segments and a few others at once, not for one of them: what meets has two arrays.
    steps = plan(links)
    assert steps.count("Generate explode") >= 2 and steps.index("Generate explode") < steps.index("Join")


def test_a_task_makes_a_bounded_number_of_entries(spark, monkeypatch):
    monkeypatch.setattr(linalg, "PIXELS", 50)
    sizes = spark.createDataFrame([("a", 40, 25)], "image_id string, width int, height int")
    for df in (linalg.poisson_matrix(sizes), linalg.lighting_matrix(sizes, (0.6, 0.0, 0.8))):
        tasks = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 20 and max(r["count"] for r in tasks) <= 9 * 50


def test_blocks_go_to_python_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(csr, "BATCH", 1 << 16)
    blocks = csr.to_blocks(linalg.poisson_matrix(spark.createDataFrame([("a", 200, 100)], "image_id string, width int, height int")))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        rows = csr._in_small_batches(blocks.coalesce(1)).mapInArrow(lambda source: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in source), "n long").collect()
    finally:
        spark.conf.set(key, before)
    # Blocks of over 65,536 bytes come one by one.
    assert len(rows) > 5 and max(r["n"] for r in rows) <= 4


def test_png_files_are_made_of_bands(spark, tmp_path):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 256, (37, 20, 3), dtype=np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(raster.png(values))
    df = raster.read_images(spark, str(tmp_path / "in"), gamma=1.0, at_once=64)
    for band in (1, 100, 1 << 18):
        data = bytes(raster.encode_png(df, band=band).first()["png"])
        decoded, _ = formats.decode(data)
        assert (np.rint(decoded * 255) == values).all()
        # The image source reads them too.
        (tmp_path / f"out{band}").mkdir()
        (tmp_path / f"out{band}" / "b.png").write_bytes(data)
        back = raster.read_images(spark, str(tmp_path / f"out{band}"), gamma=1.0).orderBy("pid").toPandas()
        assert (np.rint(back[["c0", "c1", "c2"]].to_numpy().reshape(37, 20, 3) * 255) == values).all()
    steps = plan(raster.encode_png(df))
    assert "FlatMapGroupsInArrow [image_id" in steps and "band" in steps.split("FlatMapGroupsInArrow [")[1].split("]")[0]


def test_albedo_is_made_once(spark, monkeypatch):
    written, saved = [], storage.saved
    monkeypatch.setattr(storage, "saved", lambda df, name, *a: written.append(plan(df)) or saved(df, name, *a))
    px = raster.events_raster(spark, DATA).select("image_id", "pid", "x", "y", "c0", "c1", "c2")
    assert "FlatMapGroupsInArrow" in plan(segmentation.prepared(px))
    assert written and not any("FlatMapGroupsInArrow" in steps for steps in written)


@pytest.mark.parametrize("erosion, tile", [(0, 9), (2, 9)])
def test_regions_of_tiles_are_those_of_windows(spark, erosion, tile):
    rng = np.random.default_rng(erosion)
    rows = []
    # Noise, blocks, one colour, a spiral that leaves and enters tiles, and a last row that is short.
    spiral = np.zeros((30, 31), int)
    top, left, bottom, right = 0, 0, 29, 30
    while top <= bottom and left <= right:
        spiral[top, left : right + 1] = spiral[top : bottom + 1, right] = spiral[bottom, left + 2 : right + 1] = spiral[top + 2 : bottom + 1, left + 2 if left + 2 <= right else left] = 1
        top, left, bottom, right = top + 2, left + 2, bottom - 2, right - 2
    images = {"noise": rng.integers(0, 2, (33, 27)), "blocks": rng.integers(0, 3, (8, 9)).repeat(7, 0).repeat(6, 1), "one": np.zeros((40, 12), int), "spiral": spiral, "low": rng.integers(0, 2, (3, 60))}
    for name, labels in images.items():
        h, w = labels.shape
        most = h * w - 5 if name == "noise" else h * w
        rows += [(name, p, p % w, p // w, int(labels[p // w, p % w]), f"{name}{p}") for p in range(most)]
    df = spark.createDataFrame(rows, "image_id string, pid long, x int, y int, label int, more string")
    got = components.eroded_components(df, erosion=erosion, tile=tile)
    assert got.columns == [*df.columns, "component", "kept"]
    want = components.compress_labels(components.connected_components(df), "component", "component")
    want = windows.erode(want.withColumn("left", F.col("component")), erosion, "left").withColumn("kept", F.col("left") >= 0)
    assert sorted(got.collect()) == sorted(want.select(*got.columns).collect())


def test_few_centroids_stay_on_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(name, i, *map(float, rng.uniform(size=3))) for name, n in (("a", 400), ("b", 60), ("c", 2)) for i in range(n)]
    points = spark.createDataFrame([*rows, ("b", 60, float("nan"), 0.5, 0.5), ("a", 400, None, 0.5, 0.5)], "image_id string, pid long, c0 double, c1 double, c2 double")
    start, written, found = kmeans.seeds(points.filter("pid < 60"), 4), [], []
    put = kmeans.Latest.put
    monkeypatch.setattr(kmeans.Latest, "put", lambda self, df: written.append(self.name) or put(self, df))
    for few, n_iter in ((kmeans.FEW, None), (0, None), (kmeans.FEW, 2), (0, 2)):
        monkeypatch.setattr(kmeans, "FEW", few)
        labelled, centroids = kmeans.cluster(points, start, 6, 1e-2, n_iter)
        assert (len(written) == 1) == (few > 0)
        written.clear()
        found.append((labelled.schema, sorted(map(str, labelled.collect())), sorted((r["image_id"], r["label"]) for r in centroids.collect()), np.array([r[2:] for r in centroids.orderBy("image_id", "label").collect()])))
    for few, many in (found[:2], found[2:]):
        assert few[:3] == many[:3] and np.allclose(few[3], many[3], rtol=1e-12, equal_nan=True)


@pytest.mark.parametrize("few", [0, 400])
def test_windows_of_many_slots_are_those_of_few(monkeypatch, few):
    rng = np.random.default_rng(8)
    y, x = np.divmod(np.arange(60 * 50), 50)
    light, slots = rng.uniform(0.1, 1, 3000), np.where(rng.random(3000) < 0.01, -1, rng.integers(0, 60, 3000))
    want = intrinsic._tile(x, y, light, light.copy(), slots, 50, 60, 3)
    monkeypatch.setattr(intrinsic, "FEW", few)
    assert np.allclose(intrinsic._tile(x, y, light, light.copy(), slots, 50, 60, 3), want, rtol=1e-12, equal_nan=True)


def test_short_png_files_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    px = spark.range(12 * 256).selectExpr("concat('p', id div 256) AS image_id", "cast(id % 16 as int) AS x", "cast(id div 16 % 16 as int) AS y", "0.5D AS c0", "0.25D AS c1", "1D AS c2")
    made, encode = [], raster.encode_png
    monkeypatch.setattr(raster, "encode_png", lambda *a, **k: made.append(encode(*a, **k)) or made[-1])
    raster.write_images(px, str(tmp_path / "out"))
    assert sorted(f.name for f in (tmp_path / "out").glob("*.png")) == sorted(f"p{n}.png" for n in range(12))
    assert made[0].select(F.spark_partition_id()).distinct().count() > 1


def test_points_of_one_colour_go_through_rounds_as_one(spark, monkeypatch):
    rng = np.random.default_rng(11)
    colours = [*rng.uniform(size=(9, 3)).tolist(), [None, 0.5, 0.5]]
    rows = [(name, i, *colours[(i * i + len(name)) % 10]) for name, n in (("a", 400), ("bb", 90)) for i in range(n)]
    points = spark.createDataFrame(rows, "image_id string, pid long, c0 double, c1 double, c2 double")
    assert kmeans._weighed(points)[0].count() == points.select("image_id", "c0", "c1", "c2").distinct().count() <= 20
    start, found = kmeans.distinct_seeds(points.dropna(), 3), []
    for fewer, few in ((kmeans.FEWER, kmeans.FEW), (kmeans.FEWER, 0), (1000, kmeans.FEW)):
        monkeypatch.setattr(kmeans, "FEWER", fewer)
        monkeypatch.setattr(kmeans, "FEW", few)
        labelled, centroids = kmeans.cluster(points, start, 20, 1e-9)
        found.append((sorted(map(str, labelled.collect())), np.array([r[2:] for r in centroids.orderBy("image_id", "label").collect()])))
    assert all(f[0] == found[2][0] and np.allclose(f[1], found[2][1], rtol=1e-12) for f in found[:2])


@pytest.mark.parametrize("metric, inverse", [("sum", False), ("l2", False), ("l2", True)])
def test_sets_are_means_and_spreads(spark, metric, inverse):
    rng = np.random.default_rng(12)
    values = np.concatenate([rng.uniform(size=(80, 3)), np.full((10, 3), 0.1), np.full((10, 3), 0.1)])
    labels = np.array([*(np.arange(80) % 4), *[4] * 10, *[5] * 10])
    rows = [("a", i, int(label), *map(float, v)) for i, (label, v) in enumerate(zip(labels, values, strict=True))]
    df = spark.createDataFrame(rows, "image_id string, pid long, label long, c0 double, c1 double, c2 double")
    ids = probability.set_selection(df, kmeans.calculate_centroids(df), metric=metric, colours=True)
    # Exemplars bring their colours: no pixels are read or joined for them.
    assert "Join" not in plan(probability.exemplars(df, spark.createDataFrame(ids.collect(), ids.schema)))
    own = {s: values[[r["pid"] for r in ids.filter(f"label = {s}").collect()]] for s in range(6)}
    sign = 1 if metric == "sum" else -1
    far = np.array([((values[:, None] + sign * own[s]) ** 2).sum(2).mean(1) for s in range(6)])
    logs = np.log(np.maximum(far, 1e-300)) * (-20 if inverse else 20)
    want = np.exp(logs - logs.max(0))
    want /= want.sum(0)
    got = np.zeros(want.shape)
    for r in probability.set_probability(df, ids, metric, inverse).collect():
        got[r["label"], r["pid"]] = r["p"]
    # The last two sets are of one colour, that of their pixels: equally likely everywhere.
    assert np.allclose(got, want, atol=1e-9) and (got[4] == got[5]).all()


def test_names_of_files_are_cut_out_without_a_pattern(spark, monkeypatch):
    from gridloom.plans import registry

    class Stop(Exception):
        pass

    def stop(df, name, *more):
        steps.append(plan(df))
        raise Stop

    px, steps = raster.event_pictures(spark, DATA, 500, 1, 16), []
    monkeypatch.setattr(registry, "saved", stop)
    with pytest.raises(Stop):
        registry.segmentation_of_pictures(px)
    # A pattern that may begin anywhere in a path took 20 microseconds a pixel.
    assert "regexp_extract" not in steps[0].lower()
