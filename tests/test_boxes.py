"""Nearest neighbours by boxes of colour space, and components after a given number of sweeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import components, probability


def brute(points, ids, k):
    out = {}
    for i, p in enumerate(points):
        e = p - points
        d = e[:, 0] * e[:, 0] + e[:, 1] * e[:, 1] + e[:, 2] * e[:, 2]
        out[int(ids[i])] = [(float(d[j]), int(ids[j])) for j in np.lexsort((ids, d)) if j != i][:k]
    return out


@pytest.mark.parametrize("per_box, visits", [(10_000, 50_000), (9, 4), (40, 1)])
def test_neighbours_in_other_boxes(spark, per_box, visits):
    rng = np.random.default_rng(3)
    images = {
        "even": rng.uniform(size=(150, 3)),
        "few colours": rng.integers(0, 3, (140, 3)) / 7,
        "one colour": np.full((60, 3), 0.5),
        "clumps": np.concatenate([rng.normal(c, 0.001, (50, 3)) for c in (0.1, 0.5, 0.9)] + [rng.uniform(size=(5, 3))]),
        "small": rng.uniform(size=(4, 3)),
        "single": rng.uniform(size=(1, 3)),
    }
    rows, want = [], {}
    for name, points in images.items():
        ids = rng.permutation(len(points)) * 3
        want |= {(name, i): near for i, near in brute(points, ids, 10).items()}
        rows += [(name, int(i), int(i) % 4, *map(float, p)) for i, p in zip(ids, points, strict=True)]
    df = spark.createDataFrame(rows, "image_id string, pid long, label int, c0 double, c1 double, c2 double")
    got = probability.nearest_in_image(df, 10, per_box, visits).collect()
    assert len(got) == len(rows)
    for r in got:
        assert [(n["d"], n["id"]) for n in r["near"]] == want[r["image_id"], r["pid"]]
        assert all(n["label"] == n["id"] % 4 for n in r["near"])
    assert probability.nearest_in_image(df.limit(0), 10).count() == 0


def test_outliers_by_boxes(spark):
    rng = np.random.default_rng(4)
    rows = [("a", i, int(i % 30), *map(float, np.clip(rng.normal((i % 30) / 30, 0.02, 3), 0, 1))) for i in range(300)]
    df = spark.createDataFrame(rows, "image_id string, pid long, label long, c0 double, c1 double, c2 double")
    ids = df.select("image_id", "label", "pid", F.lit(1).alias("rank"))
    one, many = (sorted(r["pid"] for r in probability.remove_outliers(df, ids, votes=3, per_box=n).collect()) for n in (10_000, 20))
    assert one == many and 0 < len(one) < 300


def test_sweeps(spark):
    rng = np.random.default_rng(5)
    labels = rng.integers(0, 2, (9, 12))
    labels[4] = 1
    rows = [("a", y * 12 + x, x, y, int(labels[y, x])) for y in range(9) for x in range(12)]
    df = spark.createDataFrame(rows, "image_id string, pid long, x int, y int, label int")

    def runs(line):
        return np.concatenate([[0], np.cumsum(line[1:] != line[:-1])])

    now = np.arange(108).reshape(9, 12)
    for n in range(5):
        got = np.array([r[0] for r in components.connected_components(df, max_iter=n).orderBy("pid").select("component").collect()]).reshape(9, 12)
        assert (got == now).all()
        for axis in (0, 1):
            ids, kinds = (now, labels) if axis == 0 else (now.T, labels.T)
            ids = np.array([[line[r == k].max() for k in r] for line, r in ((a, runs(b)) for a, b in zip(ids, kinds, strict=True))])
            now = ids if axis == 0 else ids.T
    whole = [r[0] for r in components.connected_components(df).orderBy("pid").select("component").collect()]
    assert [r[0] for r in components.connected_components(df, max_iter=100).orderBy("pid").select("component").collect()] == whole
    with pytest.raises(ValueError, match="sweeps"):
        components.connected_components(df, max_iter=-1)
