"""Small inputs with results worked out by hand."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import color, scalar
from gridloom.operators import components, graph, intrinsic, kmeans, linalg, probability, regions, sfs, windows
from gridloom.sources import raster


def image(spark, grid, name="label", image_id="a"):
    grid = np.asarray(grid)
    h, w = grid.shape
    rows = [(image_id, y * w + x, x, y, grid[y, x].item()) for y in range(h) for x in range(w)]
    kind = "double" if grid.dtype.kind == "f" else "long"
    return spark.createDataFrame(rows, f"image_id string, pid long, x int, y int, {name} {kind}")


def column(df, name, order="pid"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_compress_segments(spark):
    df = image(spark, [[6, 6, 6, 5, 5, 13, 4, 4, 4]])
    assert column(windows.compress_segments(df), "segment") == [0, 0, 0, 1, 1, 2, 3, 3, 3]
    # A run goes on in the next row; a changed start is a new one.
    df = image(spark, [[1, 1, 2], [2, 2, 3], [4, 4, 4]])
    assert column(windows.compress_segments(df), "segment") == [0, 0, 1, 1, 1, 2, 3, 3, 3]


def test_shrink_segments(spark):
    labels = [0] * 6 + [1] * 3 + [2] * 2 + [3] * 4 + [4] + [5] * 4
    kept = windows.shrink_segments(image(spark, [labels]), "label", 3)
    counts = {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()}
    assert counts == {0: 3, 1: 3, 2: 2, 3: 3, 4: 1, 5: 3}


def test_compress_labels(spark):
    df = image(spark, [[7, -1, 7, 3]])
    assert column(components.compress_labels(df), "dense") == [2, 0, 2, 1]
    assert column(components.compress_labels(df, background=False), "dense") == [1, -1, 1, 0]


@pytest.mark.parametrize(
    "grid, want",
    [([[0, 0, 1], [1, 0, 1], [1, 1, 1]], [[4, 4, 8], [8, 4, 8], [8, 8, 8]]), ([[0, 1], [1, 0]], [[0, 1], [2, 3]]), ([[5]], [[0]])],
)
def test_connected_components(spark, grid, want):
    got = components.connected_components(image(spark, grid))
    assert column(got, "component") == [v for row in want for v in row]


def test_connected_components_spiral_and_two_images(spark):
    spiral = np.zeros((9, 9), int)
    spiral[0, :] = spiral[:, 8] = spiral[8, :] = 1
    spiral[2:, 0] = spiral[2, :7] = spiral[2:7, 6] = spiral[6, 2:7] = spiral[4:7, 2] = spiral[4, 2:5] = 1
    both = image(spark, spiral).unionAll(image(spark, 1 - spiral, image_id="b"))
    got = {(r["image_id"], r["pid"]): r["component"] for r in components.connected_components(both).collect()}
    for name, grid in (("a", spiral), ("b", 1 - spiral)):
        seen = {}
        for start in range(81):
            if start in seen:
                continue
            stack, members = [start], {start}
            while stack:
                p = stack.pop()
                for q, ok in ((p - 9, p >= 9), (p + 9, p < 72), (p - 1, p % 9), (p + 1, p % 9 < 8)):
                    if ok and q not in members and grid.flat[q] == grid.flat[p]:
                        members.add(q)
                        stack.append(q)
            seen |= dict.fromkeys(members, max(members))
        assert all(got[name, p] == seen[p] for p in range(81))


def test_segment_adjacency(spark):
    edges = regions.adjacency_edges(image(spark, [[0, 1], [2, 0]]), "label")
    assert {tuple(r) for r in regions.adjacency(edges).select("src_label", "dst_label").collect()} == {(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)}
    assert edges.count() == 10


def test_erode(spark):
    df = image(spark, [[1, 1, 1, 1, 2, 2, 2]] * 5)
    inner = [-1, 1, 1, -1, -1, 2, -1]
    assert column(windows.erode(df, 1), "label") == [-1] * 7 + inner * 3 + [-1] * 7
    assert column(windows.erode(df, 0), "label") == [1, 1, 1, 1, 2, 2, 2] * 5


def test_erosion_is_monotone(spark):
    df = image(spark, np.random.default_rng(3).integers(0, 2, (12, 14)))
    once, twice = (column(windows.erode(df, n), "label") for n in (1, 2))
    assert all(b == -1 for a, b in zip(once, twice, strict=True) if a == -1)


def test_sobel(spark):
    plane = (np.arange(12.0) ** 2).reshape(3, 4)
    got = column(windows.sobel_derivative(image(spark, plane, "v")), "d")
    assert got == [56, 96, 128, 112, 208, 320, 384, 320, 152, 224, 256, 208]


def test_maps(spark):
    t = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("a", 2, 1)], "image_id string, label long, target long")
    fixed = graph.fix_map_cycles(t)
    assert {r["label"]: r["target"] for r in fixed.collect()} == {0: 1, 1: 1, 2: 1}
    df = image(spark, [[0, 1, 2, 9]])
    chain = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("a", 2, 2)], "image_id string, label long, target long")
    assert column(graph.map_until_converged(df, chain), "label") == [2, 2, 2, 9]
    # Cycles end, at their least label, whatever leads into them.
    loop = {3: 7, 7: 5, 5: 3, 1: 2, 2: 7, 8: 8, 9: 8, 10: 11, 11: 12, 20: 21, 21: 20}
    ends = {r["label"]: r["target"] for r in graph.resolve_map(spark.createDataFrame([("a", k, v) for k, v in loop.items()], "image_id string, label long, target long")).collect()}
    assert ends == {3: 3, 7: 3, 5: 3, 1: 3, 2: 3, 8: 8, 9: 8, 10: 12, 11: 12, 20: 20, 21: 20}


def test_cluster_combinations(spark):
    m = spark.createDataFrame([("a", c, s) for c, s in ((0, 0), (1, 1), (1, 2), (2, 3), (2, 4), (2, 5))], "image_id string, cluster long, segment long")
    assert graph.cluster_combinations(m).first()["n"] == 8
    assert graph.cluster_links(m).count() == 8


def test_cluster_links_of_one_cluster_go_to_many_tasks(spark):
    segments = [("a", 0, s) for s in range(200)] + [("b", 0, s) for s in range(30)] + [("b", 1, 7), ("b", None, 8), ("b", 0, None)]
    m = spark.createDataFrame(segments, "image_id string, cluster long, segment long")
    want = sorted((i, c, s, t) for i, c, s in segments for j, d, t in segments if (i, c) == (j, d) and None not in (c, s, t) and s != t)
    for options in ({"at_once": 1000}, {"at_once": 1000, "small": 10, "block": 16}, {}):
        links = graph.cluster_links(m, **options)
        assert sorted(tuple(r) for r in links.collect()) == want
        if options:
            tasks = links.groupBy(F.spark_partition_id()).count().collect()
            assert max(r["count"] for r in tasks) < len(want) / 5


def test_entry_counts(spark):
    df = image(spark, np.zeros((3, 4), int))
    assert linalg.grid_matrix(df).count() == linalg.n_grid_entries(3, 4) == 34
    assert linalg.poisson_matrix(df).count() == linalg.n_poisson_entries(3, 4) == 46


def test_kmeans(spark):
    points = spark.createDataFrame([("a", 0, 0.5, 0.0, 0.0), ("a", 1, 0.9, 0.0, 0.0)], "image_id string, pid long, c0 double, c1 double, c2 double")
    given = lambda *c: kmeans.same_for_all(points, list(c))
    assert column(kmeans.label_points(points, given((0, 0, 0), (1, 0, 0))), "label") == [0, 1]
    means = kmeans.calculate_centroids(points.withColumn("label", (F.col("pid") * 2).cast("int")), 3)
    assert [tuple(r)[1:] for r in means.orderBy("label").collect()] == [(0, 0.5, 0.0, 0.0, 1), (1, 0.0, 0.0, 0.0, 0), (2, 0.9, 0.0, 0.0, 1)]
    found, centroids = kmeans.cluster(points, given((0.0, 0.0, 0.0), (1.0, 0.0, 0.0)), 10, 1e-3)
    assert [tuple(r)[1:] for r in centroids.orderBy("label").collect()] == [(0, 0.5, 0.0, 0.0), (1, 0.9, 0.0, 0.0)] and column(found, "label") == [0, 1]
    first = lambda p: sorted(map(tuple, kmeans.seeds(p, 2).collect()))
    assert first(points) == first(points.repartition(3))


def test_images_are_clustered_each_by_itself(spark):
    rng = np.random.default_rng(12)
    rows = [(name, i, *map(float, rng.normal(rng.integers(0, 3) * far, 0.3, 3))) for name, far, n in (("a", 1.0, 60), ("b", 4.0, 90), ("c", 0.1, 2)) for i in range(n)]
    points = spark.createDataFrame(rows, "image_id string, pid long, c0 double, c1 double, c2 double")

    def run(p):
        found, centroids = kmeans.cluster(p, kmeans.seeds(p, 3), 5, 0.02)
        return {tuple(r) for r in found.select("image_id", "pid", "label").collect()}, {(r["image_id"], r["label"], *(round(r[c], 9) for c in ("c0", "c1", "c2"))) for r in centroids.collect()}

    together = run(points)
    alone = [run(points.filter(F.col("image_id") == n)) for n in "abc"]
    assert together == tuple(set().union(*(x[k] for x in alone)) for k in (0, 1))
    # Against a plain loop with the same rule.
    for name in "ab":
        own = np.array([r[2:] for r in rows if r[0] == name])
        c = np.array([r[2:] for r in sorted(map(tuple, kmeans.seeds(points, 3).filter(F.col("image_id") == name).collect()))])
        before = np.inf
        for _ in range(5):
            label = ((own[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([own[label == k].mean(0) if (label == k).any() else np.zeros(3) for k in range(3)])
            delta = np.sqrt(((new - c) ** 2).sum())
            c, stop, before = new, abs(delta - before) <= 0.02, delta
            if stop:
                break
        assert {(name, i, k) for i, k in enumerate(label.tolist())} == {x for x in together[0] if x[0] == name}
    distinct = kmeans.distinct_seeds(points.withColumns({"c0": F.col("pid") % 4, "c1": F.lit(0.0), "c2": F.lit(0.0)}), 9)
    assert distinct.filter("image_id = 'a'").count() == 4 and distinct.filter("image_id = 'c'").count() == 2


def test_beta_feature(spark):
    df = spark.createDataFrame([("a", 0, 10.0, 0.0, 0.0), ("a", 1, 100.0, 0.0, 0.0), ("a", 2, 50.0, 10.0, 0.0)], "image_id string, pid long, l double, a double, b double")
    assert column(intrinsic.beta_feature(df), "beta") == [-1e5, 1e5, 0.0]


def test_scalars(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate((-0.1, 0.0, 0.5, 1.0, 2.0))], "pid long, v double")
    assert column(df.select("pid", scalar.quantize(F.col("v")).alias("q")), "q") == [0, 0, 128, 255, 255]
    one = spark.range(1).select(*(F.round(v, 9) for v in color.rgb_to_ic(F.lit(0.3), F.lit(0.6), F.lit(0.9))), *(F.round(v, 9) for v in scalar.unit(F.lit(3.0), F.lit(0.0), F.lit(-4.0)))).first()
    assert tuple(one) == (0.6, 0.5, 1.0, 0.6, 0.0, 0.8)
    at = lambda x, y: scalar.contributions(F.lit(x), F.lit(y), F.lit(40), F.lit(250))
    assert tuple(spark.range(1).select(at(0, 0), at(20, 20)).first()) == (1, 256)


def test_lab_round_trip(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(float, v)) for v in rng.uniform(0.05, 1, (50, 3))], "c0 double, c1 double, c2 double")
    back = color.convert(color.convert(df, color.rgb_to_lab, ("l", "a", "b")), color.lab_to_rgb, ("d0", "d1", "d2"), ("l", "a", "b"))
    worst = back.select(F.max(F.greatest(*(F.abs(F.col(f"c{k}") - F.col(f"d{k}")) for k in range(3))))).first()[0]
    assert worst < 1e-4


def test_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(2)
    rows = [("a", i, int(i % 3), *map(float, rng.uniform(0, 1, 3))) for i in range(60)]
    df = spark.createDataFrame(rows, "image_id string, pid long, label long, c0 double, c1 double, c2 double")
    ids = probability.set_selection(df, kmeans.calculate_centroids(df), metric="l2")
    for inverse in (False, True):
        total = probability.set_probability(df, ids, "l2", inverse).groupBy("pid").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
        assert total.filter("abs(s - 1) > 1e-9 or n <> 3").count() == 0
    whole = {(r["label"], r["pid"]): r["p"] for r in probability.set_probability(df, ids, "l2").collect()}
    parts = {(r["label"], r["pid"]): r["p"] for r in probability.set_probability(df, ids, "l2", sets=1).collect()}
    assert whole.keys() == parts.keys() and all(abs(whole[k] - parts[k]) < 1e-12 for k in whole)
    assert probability.remove_outliers(df, ids, votes=0).count() == ids.count()
    with pytest.raises(ValueError):
        probability.set_probability(df, ids, "cosine")


@pytest.mark.parametrize("n, kinds", [(1, 3), (5, 2), (200, 3), (700, 1000), (300, 1)])
def test_nearest_equals_all_pairs(n, kinds):
    rng = np.random.default_rng(n)
    points, ids = rng.integers(0, kinds, (n, 3)) / 7, rng.permutation(n)
    found = probability.nearest(points, ids, 10)
    for i in range(n):
        e = points[i] - points
        d = e[:, 0] * e[:, 0] + e[:, 1] * e[:, 1] + e[:, 2] * e[:, 2]
        want = [j for j in np.lexsort((ids, d)) if j != i][:10]
        assert found[i].tolist() == want


def direct_albedo(i, cr, cg, slots, n_iter):
    h, w = i.shape
    ma, mb = cr.max(), cg.max()
    slot = np.floor(cg / mb * (slots - 1)) * (slots - 1) + np.floor(cr / ma * (slots - 1))
    a = i.copy()
    for _ in range(n_iter):
        out = np.zeros_like(a)
        for y in range(h - 15):
            for x in range(w - 15):
                box = np.s_[y : y + 16, x : x + 16]
                shade = (i[box] / a[box]).sum() / 256
                for s in np.unique(slot[box]):
                    at = slot[box] == s
                    out[box][at] += i[box][at].mean() / shade
        yy, xx = np.mgrid[:h, :w]
        a = out / (np.minimum.reduce([xx + 1, np.full_like(xx, 16), w - xx]) * np.minimum.reduce([yy + 1, np.full_like(yy, 16), h - yy]))
    return a


def test_albedo_equals_direct_windows(spark):
    rng = np.random.default_rng(4)
    i, cr, cg = rng.uniform(0.1, 1, (18, 20)), rng.choice([0.3, 0.6, 0.9], (18, 20)), rng.choice([0.4, 1.2], (18, 20))
    rows = [("a", y * 20 + x, x, y, float(i[y, x]), float(cr[y, x]), float(cg[y, x])) for y in range(18) for x in range(20)]
    df = spark.createDataFrame(rows, "image_id string, pid long, x int, y int, i double, cr double, cg double")
    got = np.array(column(intrinsic.estimate_albedo_intensity(df, slots=5, n_iter=2), "albedo")).reshape(18, 20)
    assert np.allclose(got, direct_albedo(i, cr, cg, 5, 2))
    want = direct_albedo(i, cr, cg, 5, 5)
    for tile, together in ((4, 1), (7, 2), (100, 5)):
        got = np.array(column(intrinsic.estimate_albedo_intensity(df, slots=5, n_iter=5, tile=tile, together=together), "albedo")).reshape(18, 20)
        assert np.allclose(got, want)
    with pytest.raises(ValueError):
        intrinsic.estimate_albedo_intensity(df.filter("x < 10"))


@pytest.mark.parametrize("shape, weight, solver", [((5, 6), 0.7, "sweep"), ((9, 3), 0.3, "sweep"), ((3, 4), 0.7, "relax"), ((1, 4), 1.0, "tiles"), ((21, 35), 0.7, "tiles"), ((1, 1), 1.0, "tiles"), ((4, 4), 0.0, "tiles")])
def test_normals_solve_the_system(spark, shape, weight, solver):
    df = image(spark, np.random.default_rng(5).uniform(0.2, 1, shape), "s")
    light, n = np.array([0.6, 0.0, 0.8]), shape[0] * shape[1]
    a, b = np.zeros((3 * n, 3 * n)), np.zeros(3 * n)
    for r in linalg.sparse_add(linalg.lighting_matrix(df, tuple(light)), linalg.poisson_matrix(df, blocks=3), 2 * weight).collect():
        a[r["i"], r["j"]] = r["v"]
    for r in linalg.lighting_vector(df, tuple(light)).collect():
        b[r["i"]] = r["v"]
    options = {"tiles": (1e-10, 60, 8, 3), "sweep": (1e-9, 20_000, 8, 3), "relax": (1e-3, 100, 8, 3)}[solver]
    got = sfs.estimate_normals(df, tuple(light), weight, "s", options[0], options[1], solver, *options[2:]).orderBy("pid").collect()
    # The least solution and what of (0, 0, 1) the system leaves free: the solution nearest to that.
    start = np.repeat([0.0, 0.0, 1.0], n)
    want = (np.linalg.lstsq(a, b, rcond=None)[0] + start - np.linalg.pinv(a) @ (a @ start)).reshape(3, n).T
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    want[:, 2] = np.abs(want[:, 2])
    got = np.array([[r["nx"], r["ny"], r["nz"]] for r in got])
    assert np.allclose(got, want, atol=0.05 if solver == "relax" else 1e-6)


def test_relax_reaches_the_solution(spark):
    df = image(spark, np.random.default_rng(5).uniform(0.2, 1, (4, 4)), "s")
    light, weight = (0.6, 0.0, 0.8), 0.7
    matrix = linalg.sparse_add(linalg.lighting_matrix(df, light), linalg.poisson_matrix(df, blocks=3), 2 * weight)
    b = linalg.lighting_vector(df, light)
    start = b.select("image_id", "i", F.when(F.col("i") >= 32, 1.0).otherwise(0.0).alias("v"))
    x = linalg.relax(matrix, b, start, 0.7, 1e-3, 60, 20)
    assert linalg.residual(matrix, x, b).first()["residual"] < 0.05
    for solver in (sfs.estimate_normals, sfs.absolute_heights):
        with pytest.raises(ValueError, match="solver"):
            solver(df, df if solver is sfs.absolute_heights else light, solver="lu")


@pytest.mark.parametrize("shape, solver", [((4, 5), "sweep"), ((7, 3), "sweep"), ((3, 3), "relax"), ((1, 6), "tiles"), ((19, 34), "tiles")])
def test_heights_solve_the_pinned_system(spark, shape, solver):
    rng = np.random.default_rng(6)
    n = shape[0] * shape[1]
    df = image(spark, rng.uniform(0, 1, shape), "v")
    relative = sfs.relative_heights(sfs.sobel_normals(df, "v", 2.0))
    rounds, tol = {"sweep": (20_000, 1e-10), "relax": (150, 1e-4), "tiles": (60, 1e-10)}[solver]
    got = np.array(column(sfs.absolute_heights(relative, df, rounds, tol=tol, solver=solver, tile=8, halo=4), "h"))
    b = np.zeros(n)
    for r in sfs.height_rhs(relative).collect():
        b[r["i"]] = r["v"]
    a = np.zeros((n, n))
    for r in linalg.poisson_matrix(df).collect():
        a[r["i"], r["j"]] = r["v"]
    a[0] = 0
    a[0, 0], b[0] = 1, 0.5
    want = np.linalg.solve(a, b)
    assert np.allclose(got, (want - want.min()) / (want.max() - want.min()), atol=0.02 if solver == "relax" else 1e-6)


def test_images(spark, tmp_path):
    values = np.arange(4 * 3 * 3, dtype=np.uint8).reshape(3, 4, 3) * 7
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(raster.png(values))
    df = raster.read_images(spark, str(tmp_path / "in"), gamma=1.0, at_once=5)
    got = raster.encode_png(df).first()
    assert (got["width"], got["height"]) == (4, 3)
    assert bytes(got["png"]) == raster.png(values)
    lines = {r["y"]: r["values"] for r in raster.interleaved(df).collect()}
    assert np.allclose([lines[y] for y in range(3)], values.reshape(3, 12) / 255)
    assert column(df, "pid") == list(range(12))
    # Files, twice (a second job replaces the file).
    for _ in range(2):
        written = raster.write_images(df, str(tmp_path / "out")).collect()
        assert [r["path"] for r in written] == [f"{tmp_path}/out/a.png"]
        assert files_in(tmp_path / "out") == ["a.png"] and (tmp_path / "out" / "a.png").read_bytes() == raster.png(values) + b"\n"


def files_in(folder):
    """Names, without the checksums that Hadoop keeps beside files of the local file system."""
    return sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc"))


def test_images_of_any_channel_count(spark, tmp_path):
    """Grey, and colour with alpha; what is no image is an error unless it is to be skipped."""

    def file(values, kind):
        part = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
        h, w = values.shape[:2]
        raw = b"".join(b"\0" + row.tobytes() for row in values)
        return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")

    grey = np.array([[0, 50, 255], [7, 8, 9]], np.uint8)
    colour = np.dstack([grey, grey // 2, 255 - grey, np.full_like(grey, 255)])
    (tmp_path / "grey.png").write_bytes(file(grey, 0))
    (tmp_path / "colour.png").write_bytes(file(colour, 6))
    rows = raster.read_images(spark, str(tmp_path), gamma=1.0).collect()
    for name, want in (("grey", np.dstack([grey] * 3)), ("colour", colour[..., :3])):
        got = {r["pid"]: (r["c0"], r["c1"], r["c2"]) for r in rows if r["image_id"].endswith(f"/{name}.png")}
        assert len(got) == 6 and np.allclose([got[k] for k in range(6)], want.reshape(6, 3) / 255)
    (tmp_path / "text.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="can be decoded"):
        raster.read_images(spark, str(tmp_path)).count()
    assert raster.read_images(spark, str(tmp_path), skip_invalid=True).count() == 12


def test_pictures_of_a_segmentation(spark, tmp_path):
    from gridloom.plans import segmentation

    grid = np.repeat([0.2, 0.9], 12)[:, None] * np.ones((24, 20))
    df = image(spark, grid, "c0").withColumns({"c1": F.col("c0") / 2, "c2": F.lit(0.4)})
    labelled, memberships = segmentation.segment(df, k=2, erosion=2, n_iter=1)
    out = segmentation.pictures(labelled, memberships)
    names = {r[0] for r in raster.write_images(out, str(tmp_path)).select("image_id").collect()}
    sets = {r[0] for r in memberships.select("label").distinct().collect()}
    assert names == {"a-clusters", "a-components", "a-eroded", *(f"a-prob{k}" for k in sets)} and len(sets) == 2
    assert set(files_in(tmp_path)) == {f"{n}.png" for n in names} and out.groupBy("image_id").count().filter("count <> 480").count() == 0


def test_constant_normalizes_to_zero(spark):
    assert column(intrinsic.normalize_minmax(image(spark, [[3.0, 3.0]], "v"), "v"), "v") == [0.0, 0.0]


def test_stream(spark, tmp_path):
    from gridloom.streaming import each_batch

    source = image(spark, [[6, 6, 5]])
    source.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))
    q = each_batch(stream, lambda df: windows.run_ids(df), str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
