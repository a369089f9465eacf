"""Texts in blocks of bounded size, written once, and messages between blocks and hash or key ranges.

A block is one row: the ids of its documents, their sizes in bytes, and their
texts one after the other, compressed. Its documents are in the order of their
ids (nulls last), so a place in the block tells which of two documents comes
first. Blocks are read from storage again, so that every pass sees the same ones
whichever executor makes it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .chunks import bound_batches, gathered, release_memory
from .pieces import restored, squeezed

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK = 8_000_000
#: In place of a null id: behind all others.
LAST = np.iinfo(np.int64).max


@dataclass
class Block:
    """Texts one after the other, with the ids, ends and further columns of their documents."""

    key: int
    doc_ids: pa.Array
    data: bytes
    ends: np.ndarray
    more: list[pa.Array]

    @classmethod
    def of(cls, table: pa.Table | pa.RecordBatch, row: int = 0) -> Block:
        columns = [table.column(k)[row] for k in range(table.num_columns)]
        sizes = np.frombuffer(restored(columns[2].as_py()), "<i8")
        return cls(columns[0].as_py(), columns[1].values, restored(columns[3].as_py()), np.cumsum(sizes), [c.values for c in columns[4:]])

    def order(self) -> np.ndarray:
        """The ids as numbers, nulls last."""
        return pc.fill_null(self.doc_ids.cast(pa.int64()), LAST).to_numpy()


def write_blocks(docs: DataFrame, *more: str, size: int = BLOCK) -> DataFrame:
    """All documents in blocks: block, doc_ids, sizes, data, and an array for each further column. Ids must be integers."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError(f"doc_id must be an integer, not {docs.schema['doc_id'].dataType.simpleString()}")
    bound_batches(docs.sparkSession)
    kinds = [to_arrow_type(docs.schema[c].dataType) for c in ("doc_id", *more)]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in gathered(source, 1, size):
            batch = batch.take(pc.sort_indices(batch, [(batch.schema.names[0], "ascending")], null_placement="at_end"))
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            sizes = pc.binary_length(texts).to_numpy().astype("<i8")
            arrays = [pa.array([batch.column(k)], pa.list_(t)) for k, t in zip((0, *range(2, 2 + len(more))), kinds, strict=True)]
            data = squeezed(b"".join(texts.to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([number]), arrays[0], pa.array([squeezed(sizes.tobytes())]), pa.array([data], pa.binary()), *arrays[1:]], ["block", "doc_ids", "sizes", "data", *more])
            number += 1
        release_memory()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("sizes", T.BinaryType()), T.StructField("data", T.BinaryType()), *(T.StructField(c, T.ArrayType(docs.schema[c].dataType)) for c in more)])
    return common.materialize(docs.select("doc_id", "text", *more).mapInArrow(run, schema), "blocks", compression="none")


def each_block(blocks: DataFrame, function: Callable[[Block], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """What ``function`` makes of each block."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in range(batch.num_rows):
                yield from function(Block.of(batch, row))
        release_memory()

    return blocks.mapInArrow(run, schema)


def with_replies(blocks: DataFrame, replies: DataFrame, function: Callable[[Block, pa.Table], pa.Table], schema: str | T.StructType) -> DataFrame:
    """What ``function`` makes of each block and the replies to it."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        if own.num_rows != 1:
            raise RuntimeError(f"{own.num_rows} blocks of one key")
        out = function(Block.of(own), told)
        release_memory()
        return out

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def each_range(messages: DataFrame, ranges: int, function: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``function`` makes of all messages of each range (column ``range``, from 0); a task has one range, however they are numbered."""
    names = messages.columns

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in source if b.num_rows]
        if held:
            yield from function(pa.Table.from_batches(held).rename_columns(names))
        del held
        release_memory()

    return messages.repartitionById(ranges, F.col("range")).mapInArrow(run, schema)


def batch_of(schema: str, *columns: list) -> pa.RecordBatch:
    """An Arrow batch by a schema of ints, longs and binaries."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def pack(array: np.ndarray) -> bytes:
    """An array's bytes, compressed, in planes of equal significance."""
    return squeezed(np.ascontiguousarray(array).view(np.uint8).reshape(len(array), array.itemsize).T.tobytes())


def unpack(data: bytes, kind: str) -> np.ndarray:
    raw, size = restored(data), np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, len(raw) // size).T).reshape(-1).view(kind)
