"""Sharding by fixed virtual slots (DataFrame functions only).

A record's key is hashed into one of thousands of virtual slots, once and for
all. Bytes and rows are aggregated per slot, and a versioned map says which
shard holds which slot. Rebalancing edits the map: slots move, records are
never hashed anew.

The main path has no Python on the executors: the map has one entry a slot
(8,192 by default, whatever the input), so the driver edits it and the lookup
is an array literal in generated code.

Records are hashed by key and text together, so rows that share a key (or have
none) but not their text are spread over the slots.

Defined results: a null key is a key as any other; a
null text counts as no bytes plus the overhead; repeated rows are placed one by
one, in one slot; a version that a stored map already has is refused; an empty table gives no rows and a map that deals slots out evenly; other
columns aren't read.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

N_SLOTS = 8192
OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """Version ``version`` of the slot-to-shard map: ``shard[slot]``, with the bytes and rows of each slot."""

    version: int
    n_shards: int
    shard: tuple[int, ...]
    size: tuple[int, ...]
    rows: tuple[int, ...]

    @classmethod
    def build(cls, size: list[int], rows: list[int], n_shards: int) -> SlotMap:
        """Version 1: slots by descending bytes, each to the shard with the fewest bytes so far."""
        loads = [(0, 0, s) for s in range(n_shards)]
        shard = [0] * len(size)
        for slot in sorted(range(len(size)), key=lambda s: (-size[s], s)):
            load, n, s = heapq.heappop(loads)
            shard[slot] = s
            heapq.heappush(loads, (load + size[slot], n + 1, s))
        return cls(1, n_shards, tuple(shard), tuple(size), tuple(rows))

    def loads(self) -> list[int]:
        out = [0] * self.n_shards
        for slot, s in enumerate(self.shard):
            out[s] += self.size[slot]
        return out

    def rebalance(self, n_shards: int | None = None, size: list[int] | None = None, rows: list[int] | None = None) -> SlotMap:
        """The next version, for other shards or other bytes: slots leave shards
        that are gone or over the mean, largest first, for the emptiest shard;
        all others stay where they are."""
        n = n_shards or self.n_shards
        new = replace(self, version=self.version + 1, n_shards=n, size=tuple(size or self.size), rows=tuple(rows or self.rows))
        mean = sum(new.size) / n
        held: list[list[int]] = [[] for _ in range(n)]
        moving = []
        for slot, s in enumerate(self.shard):
            (held[s] if s < n else moving).append(slot)
        load = [sum(new.size[slot] for slot in x) for x in held]
        for s, slots in enumerate(held):
            for slot in sorted(slots, key=lambda x: (-new.size[x], x)):
                if load[s] - new.size[slot] >= mean:
                    moving.append(slot)
                    load[s] -= new.size[slot]
        shard = list(self.shard)
        heap = [(x, s) for s, x in enumerate(load)]
        heapq.heapify(heap)
        for slot in sorted(moving, key=lambda x: (-new.size[x], x)):
            x, s = heapq.heappop(heap)
            shard[slot] = s
            heapq.heappush(heap, (x + new.size[slot], s))
        return replace(new, shard=tuple(shard))

    def bases(self) -> list[int]:
        """Rows of the same shard's earlier slots: where each slot's rows begin in its shard."""
        seen, out = [0] * self.n_shards, []
        for slot, s in enumerate(self.shard):
            out.append(seen[s])
            seen[s] += self.rows[slot]
        return out

    def store(self, spark: SparkSession, path: str) -> None:
        """Add this version to a stored map; earlier versions stay, and one that is there already is an error."""
        if self.version in versions(spark, path):
            raise ValueError(f"the map has a version {self.version} already")
        base = spark.range(len(self.shard)).withColumnRenamed("id", "virtual_slot")
        row = [F.lit(self.version).alias("version"), F.lit(self.n_shards).alias("n_shards"), "virtual_slot"]
        row += [lookup(x, F.col("virtual_slot")).alias(c) for c, x in (("shard", self.shard), ("bytes", self.size), ("rows", self.rows))]
        base.select(*row).coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        df = spark.read.parquet(path)
        version = version or df.agg(F.max("version")).first()[0]
        rows = df.filter(F.col("version") == version).orderBy("virtual_slot").collect()
        return cls(version, rows[0]["n_shards"], tuple(r["shard"] for r in rows), tuple(r["bytes"] for r in rows), tuple(r["rows"] for r in rows))


def versions(spark: SparkSession, path: str) -> set[int]:
    """Versions of a stored map; none where there is no map yet."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return set()
        raise
    return {r["version"] for r in stored.select("version").distinct().collect()}


def lookup(values, at: Column) -> Column:
    """values[at], from a literal that is parsed once when the query is planned."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>"), (at + 1).cast("int"))


def record_size(text: Column, overhead: int = OVERHEAD) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long")


def slot_of(key: Column, text: Column, n_slots: int = N_SLOTS) -> Column:
    return F.pmod(F.xxhash64(key, text), F.lit(n_slots)).cast("int")


def slot_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: one aggregate with map-side combine, n_slots rows to the driver."""
    size, rows = [0] * n_slots, [0] * n_slots
    for r in docs.select(slot_of(F.col(key), F.col(text), n_slots).alias("s"), record_size(F.col(text)).alias("b")).groupBy("s").agg(F.sum("b").alias("b"), F.count("*").alias("n")).collect():
        size[r["s"]], rows[r["s"]] = r["b"], r["n"]
    return size, rows


def place(docs: DataFrame, slots: SlotMap, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's virtual slot, shard and place in the shard (gapless from 0).

    Rows are numbered within their virtual slot, so that the window's largest
    partition is a slot and not a shard; the map adds where the slot begins.
    """
    n = len(slots.shard)
    df = docs.select(
        F.col(key).alias("doc_id"),
        slot_of(F.col(key), F.col(text), n).alias("virtual_slot"),
        record_size(F.col(text)).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    at = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return df.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        lookup(slots.shard, F.col("virtual_slot")).cast("int").alias("shard"),
        (lookup(slots.bases(), F.col("virtual_slot")) + at).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(slots.version).alias("map_version"),
    )


def shard_documents(docs: DataFrame, n_shards: int = 24, n_slots: int = N_SLOTS, path: str | None = None) -> DataFrame:
    """Aggregate, build and store the map, place every row. Shards have nearly equal bytes (law ``bytes``)."""
    spark = docs.sparkSession
    path = path or common.new_path(spark, "slot-map")
    SlotMap.build(*slot_sizes(docs, n_slots=n_slots), n_shards).store(spark, path)
    return place(docs, SlotMap.load(spark, path))
