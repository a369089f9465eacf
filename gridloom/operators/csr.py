"""Sparse matrices in compressed row blocks.

A block is one row (image_id, block, part, offsets, columns, values): the entries in
``size`` matrix rows and ``size`` columns, by row; the rows' offsets, the entries' columns (counted from the
block's first) and values are binaries. A block has size * size entries at most, however many a matrix
row has; blocks without entries aren't there. A vector is (image_id, part, values), ``size`` values a row.

Against one row an entry, a product moves each vector block once for each matrix block that needs it, and sums
are moved by matrix row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 2048
BLOCKS = "image_id string, block long, part long, offsets binary, columns binary, values binary"
_VECTOR = "image_id string, part long, vector binary"


def _compressed(i: np.ndarray, j: np.ndarray, v: np.ndarray, size: int) -> tuple[bytes, bytes, bytes]:
    """Entries by row and column, those of one place added up."""
    order = np.argsort(i * size + j, kind="stable")
    at, v = (i * size + j)[order], v[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    at, v = at[first], np.add.reduceat(v, first)
    offsets = np.searchsorted(at, np.arange(size + 1) * size)
    return offsets.astype("<i4").tobytes(), (at % size).astype("<i4").tobytes(), v.astype("<f8").tobytes()


def _entries(row: pa.Table | pa.RecordBatch, k: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and column inside the block, and value, of each entry."""
    offsets, columns, values = (np.frombuffer(row[n][k].as_py(), t) for n, t in (("offsets", "<i4"), ("columns", "<i4"), ("values", "<f8")))
    return np.repeat(np.arange(size), np.diff(offsets)), columns.astype(np.int64), values


def _table(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


#: Bytes of an Arrow batch of blocks. A batch of 10,000 blocks would have gigabytes.
BATCH = 1 << 25


def _in_small_batches(blocks: DataFrame) -> DataFrame:
    """Let tasks send blocks to Python by bytes, not by rows only; for the rest of the session."""
    key, spark = "spark.sql.execution.arrow.maxBytesPerBatch", blocks.sparkSession
    known = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if known > BATCH:
        spark.conf.set(key, str(BATCH))
    return blocks


def _block(column: str, size: int):
    return F.floor(F.col(column) / size).cast("long")


def to_blocks(entries: DataFrame, size: int = SIZE) -> DataFrame:
    """Entries (image_id, i, j, v) as blocks; entries of one place are added up."""

    def compress(table: pa.Table) -> pa.Table:
        i, j, v = (table[c].to_numpy() for c in ("i", "j", "v"))
        key = [[table[c][0].as_py()] for c in ("image_id", "block", "part")]
        return pa.Table.from_batches([_table(BLOCKS, [*key, *([b] for b in _compressed(i % size, j % size, v, size))])])

    df = entries.select("image_id", _block("i", size).alias("block"), _block("j", size).alias("part"), "i", "j", F.col("v").cast("double").alias("v"))
    return df.groupBy("image_id", "block", "part").applyInArrow(compress, BLOCKS)


def from_blocks(blocks: DataFrame, size: int = SIZE, at_once: int = 1 << 16) -> DataFrame:
    """Blocks as entries (image_id, i, j, v)."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for k in range(batch.num_rows):
                image, block, part = (batch[c][k].as_py() for c in ("image_id", "block", "part"))
                i, j, v = _entries(batch, k, size)
                for a in range(0, len(v), at_once):
                    some = slice(a, a + at_once)
                    yield _table("image_id string, i long, j long, v double", [[image] * len(v[some]), i[some] + block * size, j[some] + part * size, v[some]])

    return _in_small_batches(blocks).mapInArrow(run, "image_id string, i long, j long, v double")


def vector_blocks(x: DataFrame, size: int = SIZE) -> DataFrame:
    """A vector (image_id, i, v) in blocks; what is missing is 0."""

    def gather(table: pa.Table) -> pa.Table:
        out = np.zeros(size)
        np.add.at(out, table["i"].to_numpy() % size, table["v"].to_numpy())
        return pa.Table.from_batches([_table(_VECTOR, [[table["image_id"][0].as_py()], [table["part"][0].as_py()], [out.tobytes()]])])

    return x.select("image_id", _block("i", size).alias("part"), "i", F.col("v").cast("double").alias("v")).groupBy("image_id", "part").applyInArrow(gather, _VECTOR)


def spmv(blocks: DataFrame, x: DataFrame, size: int = SIZE) -> DataFrame:
    """(image_id, i, v) of a matrix in blocks times a vector (image_id, i, v), for matrix rows that have entries.

    Blocks meet the vector block of their columns; products are summed by matrix row, in tasks before they move.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for k in range(batch.num_rows):
                offsets, columns, values = (np.frombuffer(batch[n][k].as_py(), t) for n, t in (("offsets", "<i4"), ("columns", "<i4"), ("values", "<f8")))
                products = values * np.frombuffer(batch["vector"][k].as_py(), "<f8")[columns]
                used = np.flatnonzero(np.diff(offsets))
                sums = np.add.reduceat(products, offsets[used]) if len(used) else products
                yield _table("image_id string, i long, v double", [[batch["image_id"][k].as_py()] * len(used), used + batch["block"][k].as_py() * size, sums])

    out = _in_small_batches(blocks).join(vector_blocks(x, size), ["image_id", "part"]).mapInArrow(run, "image_id string, i long, v double")
    return out.groupBy("image_id", "i").agg(F.sum("v").alias("v"))


def add(a: DataFrame, b: DataFrame, factor: float = 1.0, size: int = SIZE) -> DataFrame:
    """a + factor * b, block by block; blocks that only one has are scaled where they lie."""
    key = ["image_id", "block", "part"]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for k in range(batch.num_rows):
                found = []
                for side, scale in (("a", 1.0), ("b", factor)):
                    if batch[f"{side}_offsets"][k].is_valid:
                        i, j, v = _entries({n: batch[f"{side}_{n}"] for n in ("offsets", "columns", "values")}, k, size)
                        found.append((i, j, v * scale))
                i, j, v = (np.concatenate(c) for c in zip(*found, strict=True))
                yield _table(BLOCKS, [*([batch[c][k].as_py()] for c in key), *([x] for x in _compressed(i, j, v, size))])

    named = lambda df, side: df.select(*key, *(F.col(n).alias(f"{side}_{n}") for n in ("offsets", "columns", "values")))
    return _in_small_batches(named(a, "a").join(named(b, "b"), key, "full")).mapInArrow(run, BLOCKS)
