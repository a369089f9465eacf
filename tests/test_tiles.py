"""Relaxation by tiles: parts of it, several images at once, and how few rounds a large image takes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import sfs, tiles
from gridloom.sources import storage


def noise(spark, height, width, name="a", seed=3):
    k = F.col("id")
    return spark.range(height * width).select(F.lit(name).alias("image_id"), k.alias("pid"), (k % width).cast("int").alias("x"), F.expr(f"cast(id div {width} as int)").alias("y"), (F.rand(seed) - 0.5).alias("s"))


@pytest.mark.parametrize("held", [(False,) * 4, (True,) * 4, (True, False, False, True)])
def test_cycles_converge_at_any_size(held):
    for h, w in ((70, 33), (1, 40), (129, 128)):
        grid = tiles.Grid(np.ones(h), np.ones(w), held, 0.0, 1.0)
        b = np.random.default_rng(1).normal(size=(h, w))
        b -= b.mean() if grid.free else 0
        v = np.zeros_like(b)
        for _ in range(12):
            grid.cycle(b, v)
        assert np.linalg.norm(grid.residual(b, v)) < 1e-6 * np.linalg.norm(b)


def test_dealing_out_is_the_transpose():
    rng = np.random.default_rng(2)
    for low, high in ((False, False), (True, False), (True, True)):
        up = tiles.Between(np.array([2.0, 2.0, 1.0]), np.arange(5) + 0.5, low, high)
        v, r = rng.normal(size=(3, 4)), rng.normal(size=(5, 4))
        assert np.isclose((up.there(v) * r).sum(), (v * up.back(r)).sum())


def test_coarse_grids_stay_bounded():
    assert tiles.cell_size(1000, 1000, 512) == 8
    assert tiles.cell_size(100_000, 100_000, 512) == 256
    with pytest.raises(ValueError, match="larger tiles"):
        tiles.cell_size(1_000_000, 1_000_000, 512)


def test_images_side_by_side(spark):
    """Images of other sizes, one of them flat, give what each gives alone; null counts as zero."""
    flat = noise(spark, 5, 4, "flat").withColumn("s", F.lit(0.0))
    one, two = noise(spark, 20, 11, "one"), noise(spark, 3, 30, "two", 4).withColumn("s", F.when(F.col("pid") == 7, None).otherwise(F.col("s")))
    one, two = storage.saved(one, "one"), storage.saved(two, "two")
    solve = lambda df: {(r["image_id"], r["pid"]): r["v"] for r in tiles.solve(df, "s", 1.0, 3.0, 1e-10, tile=8, halo=2).collect()}
    together = solve(one.unionAll(two).unionAll(flat))
    alone = solve(one) | solve(two.fillna(0.0, "s"))
    assert len(together) == 220 + 90 + 20
    assert all(abs(together[k] - v) < 1e-8 for k, v in alone.items())
    assert all(v == 0 for (i, _), v in together.items() if i == "flat")
    assert tiles.solve(one.limit(0), "s", 1.0, 1.0).count() == 0


def test_tiles_are_checked(spark):
    with pytest.raises(ValueError, match="power of two"):
        tiles.solve(noise(spark, 4, 4), "s", 1.0, 1.0, tile=12)
    with pytest.raises(ValueError, match="solver"):
        sfs.absolute_heights(noise(spark, 4, 4), noise(spark, 4, 4), solver="lu")


def test_rounds_of_a_large_image(spark, monkeypatch):
    """A quarter of a million pixels reach the tolerance in three rounds, at three shuffles each."""
    written = []

    def counted(df, name, compression=None):
        written.append(name)
        return storage.saved(df, name, compression)

    monkeypatch.setattr(tiles, "saved", counted)
    df = storage.saved(noise(spark, 500, 500), "noise")
    got = tiles.solve(df, "s", 0.0, 1.0, 1e-4, pinned=True, tile=128, halo=16)
    assert written.count("tiles") - 1 <= 3
    v, b = np.zeros(250_000), np.zeros(250_000)
    for pid, x in got.select("pid", "v").toPandas().to_numpy():
        v[int(pid)] = x
    for pid, x in df.select("pid", "s").toPandas().to_numpy():
        b[int(pid)] = x
    r = tiles.Grid(np.ones(500), np.ones(500), (False,) * 4, 0.0, 1.0).residual(b.reshape(500, 500), v.reshape(500, 500)).ravel()[1:]
    assert np.linalg.norm(r) <= 1e-4 * np.linalg.norm(b[1:])
