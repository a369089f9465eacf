"""Tables in storage that the driver and all executors see, to cut lineage of loops."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset, one of the warehouse, or a temporary one with a local master."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    key = spark.sparkContext.applicationId
    if key not in _own:
        _own[key] = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _own[key], ignore_errors=True)
    return _own[key]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has yet."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}-{name}"


def saved(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows survives lost executors and has a short plan."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Latest:
    """The table of a loop's last round: the one before is deleted once the next has been written whole.

    Only for tables that nothing but the next round reads.
    """

    def __init__(self, spark: SparkSession, name: str, compression: str | None = None):
        self.spark, self.name, self.compression, self.path = spark, name, compression, None

    def put(self, df: DataFrame) -> DataFrame:
        """Write a round's table and read it back."""
        before, self.path = self.path, new_path(self.spark, self.name)
        df.write.parquet(self.path, compression=self.compression)
        if before is not None:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(before)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        return self.spark.read.schema(df.schema).parquet(self.path)


#: Most rows of a table that is broadcast for its number of rows.
SMALL = 1_000_000


def join_small(df: DataFrame, table: DataFrame, keys: str | list[str], how: str = "inner", name: str = "small") -> DataFrame:
    """Join with a table of short rows (one an image, or a label), written first: broadcast up to SMALL rows, so that an image isn't one task.

    A longer one is merged by the hint: Spark judges a table by its files, and would send a very compressible one of any length to the driver.
    """
    table = saved(table, name)
    return df.join(F.broadcast(table) if table.count() <= SMALL else table.hint("merge"), keys, how)


#: A key with more than this share of all rows is hot; there are fewer than that many.
HOT = 1000


def join_counted(df: DataFrame, table: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """Join of a written ``df`` with a written table of one row a key, whose column ``rows`` says how many rows of ``df`` it has.

    Keys with over 1/HOT of all rows, fewer than HOT, are broadcast, so that no task has all rows of one; the others are shuffled.
    """
    total = table.agg(F.sum(rows)).first()[0] or 0
    hot = F.col(rows) * HOT > F.lit(total)
    near = df.join(F.broadcast(table.filter(hot)), keys, "inner")
    rest = df.join(F.broadcast(table.filter(hot).select(*keys)), keys, "left_anti")
    return near.unionByName(rest.join(table.filter(~hot), keys, how))
