"""Batch operators over streams of images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str) -> DataStreamWriter:
    """Apply a batch operator to every micro-batch of pixels and write its rows, one folder a batch, so that a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write)
