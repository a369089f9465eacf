"""Seeds drawn with replacement, and Spark's own estimator beside Lloyd's loop."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import kmeans

SCHEMA = "image_id string, pid long, c0 double, c1 double, c2 double"


def test_draws(spark):
    rng = np.random.default_rng(21)
    rows = [(name, int(i), *map(float, rng.uniform(size=3))) for name, n in (("a", 50), ("b", 3), ("c", 1)) for i in np.sort(rng.choice(500, n, False))]
    points, want = spark.createDataFrame(rows, SCHEMA), set()
    for name in "abc":
        own = [r for r in rows if r[0] == name]
        for j in range(12):
            at = int(hashlib.md5(f"{name}/{j}/5".encode()).hexdigest()[:15], 16) % len(own)
            want.add((name, j, *own[at][2:]))
    for width in (1, 7, 1 << 16):
        assert {tuple(r) for r in kmeans.drawn_seeds(points, 12, 5, width).collect()} == want
    assert {tuple(r) for r in kmeans.drawn_seeds(points.repartition(5), 12, 5).collect()} == want
    # A point comes again, as it must in the small images.
    assert len({r[2:] for r in want if r[0] == "b"}) <= 3 and len(want) == 36
    assert kmeans.drawn_seeds(points, 0).count() == 0 and kmeans.drawn_seeds(points.limit(0), 3).count() == 0


def test_both_implementations_end_at_one_cost(spark):
    rng = np.random.default_rng(22)
    middles = ((0.0, 0.0, 0.0), (5.0, 0.0, 1.0), (0.0, 6.0, 2.0), (7.0, 7.0, 7.0))
    rows = [("a", i, *map(float, rng.normal(middles[i % 4], 0.1))) for i in range(400)]
    points = spark.createDataFrame(rows, SCHEMA)
    start = spark.createDataFrame([("a", k, *map(float, c)) for k, c in enumerate(middles)], "image_id string, label int, c0 double, c1 double, c2 double")
    lloyd, spark_own = kmeans.cluster(points, start, 20, 1e-6), kmeans.cluster_mllib(points, 4, 20)
    a, b = (kmeans.cost(*found).first()["cost"] for found in (lloyd, spark_own))
    assert a == pytest.approx(b, rel=1e-9)
    same = lloyd[0].select("pid", F.col("label").alias("u")).join(spark_own[0].select("pid", F.col("label").alias("v")), "pid")
    assert same.select("u", "v").distinct().count() == 4
    with pytest.raises(ValueError, match="one image"):
        kmeans.cluster_mllib(points.unionAll(points.withColumn("image_id", F.lit("b"))), 4, 5)
