"""Row-wise Python over whole texts with all other columns passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import bound_batches, release_memory, slices


def add_columns(df: DataFrame, text: str, compute: Callable[[], Callable[[list[str | None]], list[list]]], added: list[tuple[str, T.DataType, pa.DataType]], keep: list[str] | None = None, most: int = 6_000_000) -> DataFrame:
    """Add columns computed from one text column, in Arrow batches of at most ``most`` bytes of text.

    ``compute()`` is called once a task; what it returns maps a list of texts
    to the lists of the added columns. Rows stay in their partitions and order.
    """
    names = df.columns if keep is None else keep
    source = df.select(*names) if text in names else df.select(*names, text)
    at = source.columns.index(text)
    schema = T.StructType([*df.select(*names).schema.fields, *(T.StructField(n, t, True) for n, t, _ in added)])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = compute()
        for batch in stream:
            for piece in slices(batch, at, most):
                results = function(piece.column(at).to_pylist())
                columns = [pa.array(c, t) for c, (_, _, t) in zip(results, added, strict=True)]
                yield pa.RecordBatch.from_arrays([*piece.columns[: len(names)], *columns], schema.names)
        del function
        release_memory()

    bound_batches(df.sparkSession)
    return source.mapInArrow(run, schema)
