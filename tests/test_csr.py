"""Matrices from sizes alone, and in compressed row blocks, against dense ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import csr, linalg


def dense(df, n, image="a"):
    out = np.zeros((n, n))
    for _, i, j, v in (r for r in df.select("image_id", "i", "j", "v").collect() if r[0] == image):
        assert out[i, j] == 0
        out[i, j] = v
    return out


def sizes(spark, *rows):
    return spark.createDataFrame(list(rows), "image_id string, width int, height int")


def laplacian(h, w):
    out = np.zeros((h * w, h * w))
    for y in range(h):
        for x in range(w):
            for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                if 0 <= y + dy < h and 0 <= x + dx < w:
                    out[y * w + x, y * w + x] += 1
                    out[y * w + x, (y + dy) * w + x + dx] -= 1
    return out


def test_generators_need_no_pixels(spark):
    shapes = {"a": (4, 3), "b": (1, 1), "c": (1, 5), "d": (6, 1)}
    table = sizes(spark, *((k, w, h) for k, (h, w) in shapes.items()))
    for image, (h, w) in shapes.items():
        want = laplacian(h, w)
        assert (dense(linalg.poisson_matrix(table), h * w, image) == want).all()
        assert (dense(linalg.grid_matrix(table), h * w, image) == np.diag(want.diagonal()) - want).all()
        assert (dense(linalg.poisson_matrix(table, blocks=3), 3 * h * w, image) == np.kron(np.eye(3), want)).all()
        assert (dense(linalg.poisson_matrix(table, neumann=False), h * w, image).diagonal() == 4).all()
        assert linalg.poisson_matrix(table).filter(F.col("image_id") == image).count() == linalg.n_poisson_entries(h, w)
    for df in (linalg.grid_matrix(table), linalg.poisson_matrix(table), linalg.poisson_matrix(table, blocks=3), linalg.lighting_matrix(table, (0.6, 0.0, 0.8))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan and "Scan" not in plan
    assert linalg.poisson_matrix(table.limit(0)).count() == linalg.grid_matrix(table.limit(0)).count() == 0


def test_many_images_are_dealt_by_line(spark, monkeypatch):
    table = sizes(spark, ("a", 3, 4), ("b", 1, 1), ("c", 2, 2))
    want = sorted(map(tuple, linalg.poisson_matrix(table).collect()))
    monkeypatch.setattr(linalg, "ALONE", 2)
    assert sorted(map(tuple, linalg.poisson_matrix(table).collect())) == want


def test_one_pixel_is_relaxed(spark):
    table = sizes(spark, ("a", 1, 1))
    one = spark.createDataFrame([("a", 0, 0.5)], "image_id string, i long, v double")
    assert [tuple(r) for r in linalg.relax(linalg.poisson_matrix(table), one, one, max_iter=2).collect()] == [("a", 0, 0.5)]


@pytest.mark.parametrize("size", [2, 4, 64])
def test_blocks(spark, size):
    rng = np.random.default_rng(7)
    a, b = (np.where(rng.uniform(size=(11, 11)) < 0.3, rng.normal(size=(11, 11)), 0) for _ in range(2))
    a[4] = rng.normal(size=11)  # a full row
    b[:, 3] = rng.normal(size=11)
    entries = lambda m: spark.createDataFrame([("a", i, j, float(m[i, j])) for i, j in np.argwhere(m).tolist()], "image_id string, i long, j long, v double")
    x = rng.normal(size=11)
    vector = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x) if i != 5], "image_id string, i long, v double")
    x[5] = 0
    blocks = csr.to_blocks(entries(a), size)
    assert (dense(csr.from_blocks(blocks, size, 3), 11) == a).all()
    assert blocks.count() == len({(i // size, j // size) for i, j in np.argwhere(a).tolist()})
    got = np.zeros(11)
    for r in csr.spmv(blocks, vector, size).collect():
        got[r["i"]] = r["v"]
    assert np.allclose(got, a @ x)
    assert np.allclose(dense(csr.from_blocks(csr.add(blocks, csr.to_blocks(entries(b), size), -2.0, size), size), 11), a - 2 * b)


def test_entries_of_one_place_are_added(spark):
    twice = spark.createDataFrame([("a", 1, 2, 0.5), ("a", 1, 2, 0.25), ("b", 0, 0, 1.0)], "image_id string, i long, j long, v double")
    assert sorted(map(tuple, csr.from_blocks(csr.to_blocks(twice)).collect())) == [("a", 1, 2, 0.75), ("b", 0, 0, 1.0)]
    assert csr.from_blocks(csr.to_blocks(twice.limit(0))).count() == 0
