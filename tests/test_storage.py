"""What loops leave in the shared folder."""

import os

from pyspark.sql import functions as F

from gridloom.operators import components, kmeans, linalg
from gridloom.sources.storage import Latest, shared_dir


def left(spark, name):
    folder = shared_dir(spark).removeprefix("file:")
    return {f for f in os.listdir(folder) if f.endswith(f"-{name}")} if os.path.isdir(folder) else set()


def test_latest_keeps_one_table(spark):
    before, rounds = left(spark, "turn"), Latest(spark, "turn")
    now = rounds.put(spark.range(5))
    for _ in range(3):
        now = rounds.put(now.select((F.col("id") + 1).alias("id")))
    assert [r[0] for r in now.orderBy("id").collect()] == [3, 4, 5, 6, 7]
    assert len(left(spark, "turn") - before) == 1


def test_loops_leave_their_last_round(spark):
    rows = [("a", y * 8 + x, x, y, int((x * y) % 3 == 1), x / 8, y / 8, 0.5) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "image_id string, pid long, x int, y int, label int, c0 double, c1 double, c2 double")
    before = {n: left(spark, n) for n in ("state", "edges", "sweep", "x")}
    found, centroids = kmeans.cluster(df, kmeans.seeds(df, 3), 4, n_iter=4)
    regions = [components.connected_components(df), components.connected_components(df, max_iter=3)]
    at = df.select("image_id", F.col("pid").alias("i"), F.col("c0").alias("v"))
    solved = linalg.relax(linalg.poisson_matrix(df), at, at, omega=0.5, max_iter=3)
    assert {n: len(left(spark, n) - before[n]) for n in before} == {"state": 1, "edges": 1, "sweep": 1, "x": 1}
    # What they return is read from those.
    assert [d.count() for d in (found, centroids, *regions, solved)] == [64, 3, 64, 64, 64]
