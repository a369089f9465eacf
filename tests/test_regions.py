"""Region graphs by overlapping tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import regions

SCHEMA = "image_id string, pid long, x int, y int, label long, c0 double, c1 double, c2 double"


def picture(rng, name, w, h, labels, holes=0.0):
    rows = []
    for y in range(h):
        for x in range(w):
            if rng.uniform() >= holes:
                rows.append((name, y * w + x, x, y, None if rng.uniform() < holes else int(rng.integers(labels)) - 1, *map(float, rng.uniform(size=3))))
    return rows


def brute(rows):
    """Every pixel looks at its eight neighbours."""
    at = {(r[0], r[2], r[3]): r for r in rows}
    found = {}
    for (name, x, y), r in at.items():
        for dx, dy in [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]:
            o = at.get((name, x + dx, y + dy))
            if o and r[4] is not None and o[4] is not None and r[4] != o[4]:
                found.setdefault((name, r[4], o[4]), []).append(float(np.linalg.norm(np.subtract(r[5:], o[5:]))))
    return {k: (len(v), sum(v) / len(v)) for k, v in found.items()}


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(11)
    return picture(rng, "a", 13, 9, 4) + picture(rng, "b", 7, 7, 40, 0.2) + picture(rng, "line", 17, 1, 2) + picture(rng, "dot", 1, 1, 1) + picture(rng, "flat", 6, 5, 1)


@pytest.mark.parametrize("tile", [1, 2, 3, 6, 256])
def test_tiles_of_any_size_equal_every_pixel(spark, images, tile):
    df, want = spark.createDataFrame(images, SCHEMA), brute(images)
    got = {(r["image_id"], r["src_label"], r["dst_label"]): (r["len"], r["avg_diff"]) for r in regions.boundary_stats(df, tile=tile).collect()}
    assert got.keys() == want.keys()
    for k, (n, mean) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(mean, abs=1e-12)
    pairs = regions.region_adjacency(df.drop("c0", "c1", "c2"), tile=tile).collect()
    assert len(pairs) == len(want) and {tuple(r) for r in pairs} == want.keys()


def test_no_pixels_and_no_tile(spark, images):
    df = spark.createDataFrame(images, SCHEMA)
    assert regions.boundary_stats(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="tile"):
        regions.boundaries(df, tile=0)


def test_edges_agree(spark, images):
    """The tiles' pairs are those of the edges, a row a pixel and direction."""
    df = spark.createDataFrame(images, SCHEMA).filter(F.col("image_id") == "a")
    edges = regions.adjacency_edges(df)
    assert {tuple(r) for r in regions.adjacency(edges).collect()} == {tuple(r) for r in regions.region_adjacency(df, tile=4).collect()}
    assert edges.count() == regions.boundary_stats(df, tile=4).agg(F.sum("len")).first()[0]
