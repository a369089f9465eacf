"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups,
keep the row with the smallest stable id.

Texts are equal when identical after each run of ASCII white space is replaced
by one blank. The first pass reduces every text to its hash; only the texts of
groups with several rows move again, to be compared byte for byte (grouping by
the text itself does that, with map-side combine, so a group of any number of
copies is a few rows a task). Groups that hold much of the table are joined by
broadcast, so no task gets all rows of a group.

Defined results: null counts as empty; a null id is larger than every other; of
rows with the same smallest id one is kept, the first by the hash of its text
and then by its columns as JSON; an empty table gives no rows;
very long texts are hashed whole; columns of any other name pass through
:func:`keep_first` untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed value: what counts as white space.
WHITE = r"[\x20\x09-\x0D]+"


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def content_hash(text: Column) -> Column:
    """128 bits as binary."""
    return F.unhex(F.md5(text.cast("binary")))


def _ordered(*columns: str) -> Column:
    """A value whose minimum is the smallest id, nulls last."""
    return F.struct(F.col(columns[0]).isNull().alias("missing"), *columns)


def collisions(classes: DataFrame) -> DataFrame:
    """Hashes that more than one text has."""
    return classes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")


def _classes(docs: DataFrame, members: DataFrame, groups: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """The distinct texts of all groups with several rows: (hash, text). ``members``: ids of their rows, by which rows are found before they are hashed."""
    few = common.with_bit(docs.select("doc_id", "text"), F.col("doc_id"), common.bitmap_of(members, F.col("doc_id")), "maybe").filter("maybe")
    df = few.select(normalized(F.col("text")).alias("text")).withColumn("hash", hashed(F.col("text")))
    # Copies are combined before they move, and only then joined.
    return df.groupBy("hash", "text").agg(F.count("*").alias("n")).join(groups.select("hash"), "hash", "left_semi")


def group_copies(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256.

    ``hashed`` is there for tests with a hash that collides.
    """
    text = normalized(F.col("text"))
    prints = docs.select("doc_id", text.alias("text")).select("doc_id", hashed(F.col("text")).alias("hash"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"))
    prints = common.materialize(prints, "fingerprints")
    groups = common.materialize(prints.groupBy("hash").agg(F.min(_ordered("doc_id", "row")).alias("first"), F.count("*").alias("group_size")), "groups")
    out = common.join_hot(prints, groups, ["hash"], "group_size")
    clash = common.materialize(collisions(_classes(docs, out.filter("group_size > 1"), groups.filter("group_size > 1"), hashed)), "collisions")
    if not clash.isEmpty():
        # Texts differ inside a group: part it by a second hash of another kind, then compare again.
        return group_copies(docs, lambda t: F.concat(hashed(t), F.unhex(F.sha2(t.cast("binary"), 512))))
    return out.select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        F.col("group_size").cast("long"),
        (F.col("first.row") == F.col("row")).alias("kept"),
        "text_sha256",
    )


def keep_first(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of ``docs``, all columns, without copies.

    Rows to drop are found by (hash, id); only rows whose id may be one of
    those are hashed again and shuffled, all others pass in the scan's
    partitions.
    """
    h, maybe, drop, key, own, place = common.temp(docs, "hash", "maybe", "drop", "key", "own", "place")
    text = normalized(F.col("text"))
    prints = common.materialize(docs.select("doc_id", hashed(text).alias("hash")), "fingerprints")
    groups = prints.groupBy("hash").agg(F.min(_ordered("doc_id")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = common.materialize(groups, "groups")
    members = common.join_hot(prints, groups, ["hash"], "n").groupBy("hash", "doc_id").agg(F.count("*").alias("rows"), F.min("first.doc_id").alias("first"))
    members = common.materialize(members, "members")
    clash = common.materialize(collisions(_classes(docs, members, groups, hashed)), "collisions")
    if not clash.isEmpty():
        return keep_first(docs, lambda t: F.concat(hashed(t), F.unhex(F.sha2(t.cast("binary"), 512))))
    is_first = F.col("doc_id").eqNullSafe(F.col("first"))
    touched = common.materialize(members.filter(~is_first | (F.col("rows") > 1)).select(F.col("hash").alias(key), F.col("doc_id").alias(own), (~is_first).alias(drop)), "touched")
    flagged = common.with_bit(docs, F.col("doc_id"), common.bitmap_of(touched, F.col(own)), maybe)
    some = flagged.filter(F.col(maybe)).withColumn(h, hashed(text))
    some = some.join(touched, (F.col(h) == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own)), "left")
    # Rows that repeat a group's smallest id: one of them stays.
    row = F.struct(*docs.columns)
    again = some.filter(~F.col(drop)).groupBy(h).agg(F.min_by(row, F.struct(F.sha2(F.col("text").cast("binary"), 256), F.to_json(row))).alias(place))
    return flagged.filter(~F.col(maybe)).select(docs.columns).unionAll(some.filter(F.col(drop).isNull()).select(docs.columns)).unionAll(again.select(f"{place}.*"))
