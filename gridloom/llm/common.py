"""What the operators of this subpackage share: tables written to storage that
driver and executors both see, bounded bitmaps, and column-safe helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.storage import new_path, saved as materialize  # noqa: F401  the operators take both from here

#: Bits of a prefilter bitmap: 2**23 bits are 256 rows of 4 KiB, 1 MiB in all,
#: whatever the size of the input.
BITMAP_BITS = 1 << 23


def temp(df: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of the table's own."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        fresh = f"__{name}"
        while fresh.lower() in taken:
            fresh += "_"
        taken.add(fresh.lower())
        out.append(fresh)
    return out


def bitmap_of(keys: DataFrame, key: Column) -> DataFrame:
    """A bitmap over hashes of the keys as rows (bucket, bits); 1 MiB at most."""
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    return keys.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__bits"))


def with_bit(df: DataFrame, key: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """Add a boolean column: whether the key's bit is set.

    True for every key of the bitmap and for a few others; the bitmap's bound
    (1 MiB) makes the broadcast safe at any input size. As it fills up, more
    rows pass and the exact join that follows does more work; results stay.
    """
    own_bucket, bits = temp(df, "bucket", "bits")
    place = F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))
    at = F.bitmap_bit_position(place)
    rows = F.broadcast(bitmap.select(F.col("__bucket").alias(own_bucket), F.col("__bits").alias(bits)))
    out = df.join(rows, F.bitmap_bucket_number(place) == F.col(own_bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2
    return out.withColumn(name, F.coalesce(bit == 1, F.lit(False))).drop(own_bucket, bits)


#: Most rows of a table that is broadcast because of its number of rows.
SMALL = 1_000_000


def join_small(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join with a written table of short rows, broadcast where it has at most SMALL."""
    return df.join(F.broadcast(table) if table.count() <= SMALL else table, key)


#: A key with more than this share of all rows is hot; there are fewer than that many.
HOT = 1000


def join_hot(df: DataFrame, table: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """``df`` joined to ``table`` (a written table, one row a key), without a task that has all rows of a hot key.

    ``table[rows]`` says how many rows of ``df`` a key has. Keys with over
    1/HOT of all rows are fewer than HOT, a bound that makes their broadcast
    safe; rows of all others are joined by key. ``how``: inner or left.
    """
    told = table.agg(F.sum(rows).alias("n"), F.max(rows).alias("most")).first()
    if not told["n"] or told["most"] * HOT <= told["n"]:
        return df.join(table, keys, how)
    (hot,) = temp(df.join(table.limit(0), keys), "hot")
    is_hot = F.col(rows) * HOT > F.lit(told["n"])
    near = df.join(F.broadcast(table.filter(is_hot).withColumn(hot, F.lit(True))), keys, "left")
    far = near.filter(F.col(hot).isNull()).select(df.columns).join(table.filter(~is_hot), keys, how)
    return near.filter(hot).drop(hot).unionByName(far)


def text_chars(docs: DataFrame) -> int:
    """Characters of all texts: one aggregate, used to size partitions."""
    return docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
