"""Converters that are no column expressions."""

import numpy as np
import pytest

from gridloom.functions import color


def pixels(spark):
    rows = [("a", k, k / 10, 0.5 - k / 20, None if k == 3 else 0.25, f"t{k}") for k in range(8)]
    return spark.createDataFrame(rows, "image_id string, pid long, c0 double, c1 double, c2 double, tag string").repartition(3)


def test_arrays_in_and_out(spark):
    df = pixels(spark)
    out = color.convert_batches(df, lambda v: v[:, ::-1] * 2)
    assert out.columns == df.columns
    got = {r["pid"]: r for r in out.collect()}
    for k in range(8):
        assert got[k]["tag"] == f"t{k}" and got[k]["c2"] == k / 10 * 2 and got[k]["c1"] == (0.5 - k / 20) * 2
        assert got[k]["c0"] is None if k == 3 else got[k]["c0"] == 0.5
    table = np.arange(30).reshape(10, 3)
    looked = color.convert_batches(df, lambda v: table[(v[:, 0] * 10).round().astype(int)], ("r", "g", "b"))
    assert looked.columns == [*df.columns, "r", "g", "b"] and {(r["pid"], r["g"]) for r in looked.collect()} == {(k, 3.0 * k + 1) for k in range(8)}
    one = color.convert_batches(df, lambda v: v.sum(1, keepdims=True), ("total",), ("c0", "c1"))
    assert all(abs(r["total"] - (0.5 + r["pid"] / 20)) < 1e-12 for r in one.collect())
    assert color.convert_batches(df.limit(0), lambda v: v).count() == 0


@pytest.mark.parametrize("wrong", [lambda v: v[:, :2], lambda v: v[:-1], lambda v: v.astype(str), lambda v: v.ravel()])
def test_other_shapes_and_kinds_are_errors(spark, wrong):
    with pytest.raises(Exception, match="the converter gave"):
        color.convert_batches(pixels(spark), wrong).collect()
