"""Exact Jaccard join on word shingles, with set-relation skipping.

Sets are the distinct five-word shingles of whole texts, as 64-bit hashes; two
documents link when 100 * |intersection| >= 80 * |union|. Two shingles of one
hash count as one (n distinct shingles have about n * n / 2**65 such pairs); a link
changes only where a pair of them decides it.

1. *Sets that can match.* A set with a partner shares at least 80 % of its
   shingles with it. Tasks send shingle hashes, packed, to the task of their
   hash range, which sends back per set how many of its hashes occur in another
   set; sets below 80 % go. A block of texts answers for the hashes that several of its own sets
   have, and sends each of these once, so a shingle of every document costs its
   range one entry a block. This test leaves the near copies and little
   else. Equal sets are one from then on.
2. *Index.* Of each remaining set, the prefix (rarest shingles first) that any
   partner must meet.
3. *Pivots.* Each list has a pivot; all members are compared
   to it, and a list whose members are then in one component is skipped: its
   other pairs can't change the answer. Lists that aren't get further pivots
   from outside their largest component.
4. *Skipping and answers from similar sets.* The lists still open are cut into
   blocks by size and position. A pair of blocks is skipped whole when the sizes
   don't allow the overlap, when the sets stand so late in the list that
   what follows can't make it up, or when both are in one component. In the blocks
   left, the answer for two sets is derived from their computed differences to
   the list's pivot P: |x & y| = |P| - |P-x| - |P-y| + |(P-x) & (P-y)| + |(x-P) & (y-P)|.
   Only pairs of which one is too far from P for that are compared in full; where both are,
   unless signatures (hash counts by bucket) bound their overlap below the least one.

Joins and aggregates are keyed by shingle, set or pair. What is held in one
Python group is a block's answers, or a hash range's entries: the average, by the number of
ranges, plus one entry a block for shingles that are everywhere.

Defined results: texts that are null or have no word have an empty set and no
link, each its own component; texts of any length are read whole; rows that repeat an id, or are equal throughout, get a row each; texts of fewer than five words have one shingle,
all their words; equal texts are in one component; a null id counts as larger
than all others; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .blocks import each_range
from .chunks import bound_batches, process_wide, release_memory, slices
from .graph import components

WORDS = 5
PERCENT = 80
PIVOTS = 1  # rounds of further pivots before pairs
BUCKETS = 128  # counts in a set's signature
MEMBERS = 64  # sets in a block of a list, about
NEAR = 0.5  # distance to a pivot up to which differences are kept
SHARED = 0xFFFF  # in place of a set: a hash that its block has answered for
SHINGLES_A_RANGE = 1_500_000
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93], np.uint64)


class _Hashes(dict):
    """64-bit hashes of words; the table of known words is bounded by its user."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


class Shingler:
    """Sorted distinct shingle hashes of whole texts."""

    def __init__(self, words: int = WORDS, most: int = 150_000):
        self.words, self.most, self.table = words, most, _Hashes()

    def _mix(self, x: np.ndarray) -> np.ndarray:
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def set_of(self, text: str | None) -> np.ndarray:
        # bytes.lower and bytes.split know A-Z and ASCII white space only, which is what counts here.
        found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.table) > self.most:
            self.table.clear()
        ids = np.array(list(map(self.table.__getitem__, found)), np.uint64)
        k = min(self.words, len(ids))
        out = np.full(len(ids) - k + 1, k, np.uint64)
        for j in range(k):
            out = self._mix(out + ids[j : len(ids) - k + 1 + j] * _STEPS[j % len(_STEPS)])
        out.sort()
        return out[np.append(True, out[1:] != out[:-1])]


def _shingler(words: int) -> Shingler:
    return process_wide(("shingles", words), lambda: Shingler(words))


def _signature(hashes: np.ndarray) -> np.ndarray:
    """How many hashes fall into each bucket: the least of two sets' counts, summed, bounds their overlap."""
    return np.bincount((hashes >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS).astype(np.int32)


def set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


_MESSAGES = "range int, block long, place int, doc_id long, n int, known int, set_key binary, keys binary, places binary"
_REPLIES = "block long, place int, doc_id long, n int, known int, set_key binary, places binary, counts binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, columns: list[list]) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _send(ranges: int, words: int):
    """Per block of documents: a row a document, and a message to each hash range."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, number = _shingler(words), TaskContext.get().partitionId()
        block = number << 32
        for batch in source:
            for piece in slices(batch, 1, 5_000_000, 200):
                at: dict[bytes, int] = {}
                sets: list[np.ndarray] = []
                rows: list[tuple] = []
                for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    hashes = shingler.set_of(t)
                    key = set_key(hashes)
                    if len(hashes) and key not in at:
                        at[key] = len(sets)
                        sets.append(hashes)
                    rows.append((at.get(key, -1), d, len(hashes), key))
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                places = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(s) for s in sets])
                # Hashes that several sets of the block have: counted here, and sent once, for other blocks.
                order = np.argsort(flat)
                same = flat[order][1:] == flat[order][:-1]
                shared, again = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
                if len(flat):
                    shared[order] = np.append(same, False) | np.append(False, same)
                    again[order] = np.append(False, same)
                known = np.bincount(places[shared], minlength=len(sets) + 1).tolist()
                places[shared] = SHARED
                flat, places = flat[~again], places[~again]
                n, goal = len(rows), (number + block) % ranges
                yield _batch(_MESSAGES, [[goal] * n, [block] * n, [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [known[r[0]] for r in rows], [r[3] for r in rows], [None] * n, [None] * n])
                if len(flat):
                    goals = ((flat >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
                    order = np.argsort(goals, kind="stable")
                    low, places = flat[order].astype(np.uint32), places[order]
                    cuts = np.searchsorted(goals[order], np.arange(ranges + 1))
                    used = np.flatnonzero(np.diff(cuts))
                    part = [(low[cuts[r] : cuts[r + 1]].tobytes(), np.diff(places[cuts[r] : cuts[r + 1]], prepend=np.uint16(0)).tobytes()) for r in used]
                    none = [None] * len(used)
                    yield _batch(_MESSAGES, [used.tolist(), [block] * len(used), none, none, none, none, none, [k for k, _ in part], [p for _, p in part]])
                block += 1
        release_memory()

    return run


def _reply(table: pa.Table) -> pa.Table:
    """For one hash range: per block, how many hashes of each of its sets are in another set too."""
    own = table.filter(pa.compute.is_null(table["keys"]))
    asked = table.filter(pa.compute.is_valid(table["keys"]))
    out = [_batch(_REPLIES, [own[c].to_pylist() for c in ("block", "place", "doc_id", "n", "known", "set_key")] + [[None] * len(own)] * 2)]
    if len(asked):
        keys = [np.frombuffer(k.as_py(), np.uint32) for k in asked["keys"]]
        places = [np.cumsum(np.frombuffer(p.as_py(), np.uint16), dtype=np.uint16) for p in asked["places"]]
        row = np.repeat(np.arange(len(keys), dtype=np.int64), [len(k) for k in keys])
        flat, where = np.concatenate(keys), row << 16 | np.concatenate(places)
        order = np.argsort(flat)
        same = flat[order][1:] == flat[order][:-1]
        shared = np.append(same, False) | np.append(False, same)
        where = where[order[shared]]
        found, counts = np.unique(where[where & 0xFFFF != SHARED], return_counts=True)
        cuts = np.searchsorted(found >> 16, np.arange(len(keys) + 1))
        blocks = asked["block"].to_pylist()
        used = np.flatnonzero(np.diff(cuts))
        none = [None] * len(used)
        out.append(_batch(_REPLIES, [[blocks[r] for r in used], none, none, none, none, none, [(found[cuts[r] : cuts[r + 1]] & 0xFFFF).astype(np.uint16).tobytes() for r in used], [counts[cuts[r] : cuts[r + 1]].astype(np.uint32).tobytes() for r in used]]))
        del keys, places, row, flat, where, order, same, shared, found, counts
        release_memory()
    return pa.Table.from_batches(out)


def _sum_replies(block: int, places: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    total = np.bincount(np.concatenate(places), np.concatenate(counts))
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block)), pa.array(at.astype(np.int32)), pa.array(total[at].astype(np.int64))], ["block", "place", "shared"])


def _summed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replies of a block follow each other."""
    now, places, counts = None, [], []
    for batch in source:
        for block, p, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if block != now and places:
                yield _sum_replies(now, places, counts)
                places, counts = [], []
            now = block
            places.append(np.frombuffer(p.as_py(), np.uint16))
            counts.append(np.frombuffer(c.as_py(), np.uint32))
    if places:
        yield _sum_replies(now, places, counts)
    release_memory()


def fingerprints(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Per document (doc_id, n, known, set_key, block, place), and the replies (block, place, shared)."""
    bound_batches(docs.sparkSession)
    ranges = max(8, common.text_chars(docs) // 7 // SHINGLES_A_RANGE + 1)
    sent = docs.select("doc_id", "text").mapInArrow(_send(ranges, words), _MESSAGES)
    got = common.materialize(each_range(sent, ranges, lambda table: iter(_reply(table).to_batches()), _REPLIES), "shingles")
    prints = got.filter("set_key is not null").select("doc_id", "n", "known", "set_key", "block", "place")
    replies = got.filter("places is not null").select("block", "places", "counts")
    # Blocks are dealt out by number, each task's one after the other.
    turn = F.pmod(F.shiftright("block", 32) * 31 + F.col("block").bitwiseAND(0xFFFFFFFF), F.lit(ranges)).cast("int")
    replies = replies.repartitionById(ranges, turn).sortWithinPartitions("block").mapInArrow(_summed, "block long, place int, shared long")
    return prints, replies


def candidate_sets(docs: DataFrame, prints: DataFrame, replies: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Distinct sets that may have a partner: (set, set_key, n, hashes, signature)."""
    shared = F.col("known") + F.coalesce("shared", F.lit(0))
    maybe = prints.filter("n > 0").join(replies, ["block", "place"], "left").filter(shared * 100 >= F.col("n") * percent)
    wanted = common.materialize(maybe.groupBy("set_key").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct(), "wanted")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = _shingler(words)
        for batch in source:
            for piece in slices(batch, 0, 4_000_000):
                sets = [s for s in map(shingler.set_of, piece.column(0).to_pylist()) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([_signature(s) for s in sets], pa.list_(pa.int32()))], ["set_key", "n", "hashes", "signature"])
        release_memory()

    few = common.with_bit(docs.select("doc_id", "text"), F.col("doc_id"), common.bitmap_of(wanted, F.col("doc_id")), "maybe").filter("maybe").select("doc_id", "text")
    ids = wanted.withColumnRenamed("doc_id", "wanted_id")
    few = few.join(ids, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi").select("text")
    sets = few.mapInArrow(run, "set_key binary, n int, hashes array<bigint>, signature array<int>").dropDuplicates(["set_key"])
    return common.materialize(sets.select(F.monotonically_increasing_id().alias("set"), "set_key", "n", "hashes", "signature"), "sets")


def least_overlap(n: Column, percent: int = PERCENT) -> Column:
    """The least overlap of a set of n with any partner: ceil(n * percent / 100)."""
    return F.floor((n * percent + 99) / 100).cast("int")


def prefixes(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The index: (hash, set, n, at), the rarest shingles of each set that a partner must meet one of."""
    tokens = sets.select("set", "n", F.explode("hashes").alias("hash"))
    common_ones = tokens.groupBy("hash").agg(F.count("*").alias("df")).filter("df > 1")
    held = tokens.join(common_ones, "hash").groupBy("set", "n").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("held"))
    # Shingles that no other set has come first and are never met.
    alone = F.col("n") - F.size("held")
    length = F.col("n") - least_overlap(F.col("n"), percent) + 1 - alone
    rows = held.filter(length > 0).select("set", "n", alone.alias("alone"), F.posexplode(F.slice("held", F.lit(1), length)).alias("k", "token"))
    return common.materialize(rows.select(F.col("token.hash").alias("hash"), "set", "n", (F.col("alone") + F.col("k")).alias("at"), F.col("k")), "index")


def _may_link(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Sizes allow the overlap, and so do the places where the two sets meet first."""
    na, nb = x("n"), y("n")
    need = F.ceil((na + nb) * percent / (100 + percent) - 1e-9)
    rest = F.least(na - x("at"), nb - y("at"))
    return (F.least(na, nb) * 100 >= F.greatest(na, nb) * percent) & (rest >= need)


def _ordered(pairs: DataFrame, x: Column, y: Column) -> DataFrame:
    return pairs.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _linked(overlap: Column, na: Column, nb: Column, percent: int) -> Column:
    return overlap * 100 >= (na + nb - overlap) * percent


def _compare(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """Exact overlap of each pair: (a, b, linked, na, nb), and the differences a - b and b - a of near ones."""
    left = sets.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("o", F.size(F.array_intersect("ha", "hb")))
    near = F.lit(differences) & (F.col("o") >= (F.col("na") + F.col("nb") - F.col("o")) * (1 - NEAR))
    told = both.select("a", "b", _linked(F.col("o"), F.col("na"), F.col("nb"), percent).alias("linked"), "na", "nb", F.when(near, F.array_except("ha", "hb")).alias("a_only"), F.when(near, F.array_except("hb", "ha")).alias("b_only"))
    return common.materialize(told, "compared")


def _open_pairs(rows: DataFrame, lists: DataFrame, index: DataFrame, sets: DataFrame, first: DataFrame, percent: int) -> DataFrame:
    """Pairs of open lists that may link: (a, b, linked), linked null where the differences to the pivot don't tell."""
    near = first.filter("a_only is not null")
    near = near.select(F.col("a").alias("origin"), F.col("b").alias("set"), F.col("na").alias("size"), F.col("a_only").alias("gone"), F.col("b_only").alias("extra")).unionAll(
        near.select("b", "a", "nb", "b_only", "a_only")
    )
    origin = index.groupBy("hash").agg(F.min(F.struct((F.col("at") - F.col("k")).alias("alone"), "set", "n")).alias("o")).select("hash", F.col("o.set").alias("origin"), F.col("o.n").alias("own"))
    whole = index.groupBy("set").agg(F.sort_array(F.collect_list(F.struct("k", "hash"))).alias("p")).select("set", F.col("p.hash").alias("p"))
    held = rows.join(lists, "hash").join(origin, "hash").join(near, ["origin", "set"], "left").join(whole, "set").join(sets.select("set", "signature"), "set")
    mine, none = F.col("set") == F.col("origin"), F.array().cast("array<bigint>")
    member = F.struct(
        "set", "n", "at", "label", F.when(~mine & F.col("gone").isNull(), F.col("signature")).alias("signature"), F.slice("p", F.lit(1), F.col("k")).alias("before"), F.when(mine, F.col("own")).otherwise(F.col("size")).alias("size"), F.when(mine, none).otherwise(F.col("gone")).alias("gone"), F.when(mine, none).otherwise(F.col("extra")).alias("extra")
    )
    # Blocks: of like size and position; a long list has several of each kind, by hash of the set.
    kind = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent))), F.floor(F.col("at") * 20 / F.col("n")), F.pmod(F.xxhash64("set"), F.ceil(F.col("m") / MEMBERS))
    ends = [F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("at")).alias("rest"), F.min("label").alias("one"), F.max("label").alias("other")]
    blocks = held.select("hash", F.struct(*(k.cast("long").alias(c) for k, c in zip(kind, "npt"))).alias("kind"), "n", "at", "label", member.alias("member"))
    blocks = common.materialize(blocks.groupBy("hash", "kind").agg(F.collect_list("member").alias("members"), *ends), "blocks")
    met = blocks.alias("p").join(blocks.alias("q"), (F.col("p.hash") == F.col("q.hash")) & (F.col("p.kind") <= F.col("q.kind")))
    met = met.filter((F.col("p.high") * 100 >= F.col("q.low") * percent) & (F.col("q.high") * 100 >= F.col("p.low") * percent))
    met = met.filter(F.least("p.rest", "q.rest") >= F.ceil((F.col("p.low") + F.col("q.low")) * percent / (100 + percent) - 1e-9))
    met = met.filter((F.col("p.one") != F.col("q.one")) | (F.col("p.one") != F.col("p.other")) | (F.col("q.one") != F.col("q.other")))
    same = F.col("p.kind") == F.col("q.kind")

    def told(x: Column, y: Column) -> Column:
        overlap = x["size"] - F.size(x["gone"]) - F.size(y["gone"]) + F.size(F.array_intersect(x["gone"], y["gone"])) + F.size(F.array_intersect(x["extra"], y["extra"]))
        return F.when(x["gone"].isNotNull() & y["gone"].isNotNull(), _linked(overlap, x["n"], y["n"], percent))

    def wanted(x: Column, y: Column) -> Column:
        """Members of two components that link, or may: no row is made of any other pair."""
        apart = (x["label"] != y["label"]) & (~same | (x["set"] < y["set"])) & _may_link(x.getItem, y.getItem, percent)
        # A pair is told in one list only, that of the first shingle that both prefixes have.
        apart = apart & ~F.arrays_overlap(x["before"], y["before"]) & F.coalesce(told(x, y), F.lit(True))
        both = F.aggregate(F.zip_with(x["signature"], y["signature"], lambda a, b: F.least(a, b)), F.lit(0), lambda t, v: t + v)
        return apart & F.coalesce(both * (100 + percent) >= (x["n"] + y["n"]) * percent, F.lit(True))

    pair = lambda x, y: F.struct(F.least(x["set"], y["set"]).alias("a"), F.greatest(x["set"], y["set"]).alias("b"), told(x, y).alias("linked"))
    found = F.flatten(F.transform("p.members", lambda x: F.transform(F.filter("q.members", lambda y: wanted(x, y)), lambda y: pair(x, y))))
    return met.select(F.explode(found).alias("pair")).select("pair.*")


def links(sets: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Pairs told that decide the components (linked ones among them), and the components (set, component)."""
    index = prefixes(sets, percent)
    spark = sets.sparkSession
    labels = spark.createDataFrame([], "node long, component long")
    done: DataFrame | None = None
    first = None
    for step in range(PIVOTS + 2):
        new: DataFrame | None = None
        rows = index.join(labels, F.col("set") == F.col("node"), "left").select("hash", "set", "n", "at", "k", F.coalesce("component", "set").alias("label"))
        counts = rows.groupBy("hash", "label").agg(F.count("*").alias("m"), F.min(F.struct((F.col("at") - F.col("k")).alias("alone"), "set", "n", "at")).alias("low"))
        lists = counts.groupBy("hash").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.max(F.struct("m", "label")).alias("top")).filter("parts > 1")
        lists = lists.select("hash", "m", F.col("top.label").alias("most"))
        if step <= PIVOTS:
            # The pivot: first the set with the fewest shingles of its own, which is the most
            # likely to link; later one outside the largest component, by turns.
            outside = counts.drop("m").join(lists, "hash")
            outside = outside.filter("label <> most") if step else outside
            turn = F.xxhash64("low.set", F.lit(step)) if step else F.lit(0)
            pivots = outside.groupBy("hash").agg(F.min(F.struct(turn.alias("turn"), "low.alone", "low.set", "low.n", "low.at", "label")).alias("p")).select("hash", "p.set", "p.n", "p.at", "p.label")
            met = rows.alias("x").join(pivots.alias("y"), F.col("x.hash") == F.col("y.hash"))
            pairs = _ordered(met.filter((F.col("x.label") != F.col("y.label")) & _may_link(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}"), percent)), F.col("x.set"), F.col("y.set"))
        else:
            told = common.materialize(_open_pairs(rows, lists, index, sets, first, percent), "told")
            new = told.filter("linked").select("a", "b", "linked")
            pairs = told.filter("linked is null").select("a", "b").distinct()
        if step:
            pairs = pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
        pairs = common.materialize(pairs, "pairs")
        if not step or not pairs.isEmpty():
            now = _compare(pairs, sets, percent, differences=step == 0)
            first = now if first is None else first
            new = now.select("a", "b", "linked") if new is None else new.unionAll(now.select("a", "b", "linked"))
        if new is None:
            continue
        done = new if done is None else done.unionAll(new)
        found = new.filter("linked").select("a", "b")
        if not found.isEmpty():
            # Components so far are stars; new links join them.
            labels = components(found.unionAll(labels.select("node", "component")))
    return done, labels


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every document."""
    prints, replies = fingerprints(docs, words)
    sets = candidate_sets(docs, prints, replies, words, percent)
    _, labels = links(sets, percent)
    classes = common.materialize(prints.filter("n > 0").groupBy("set_key").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")), "least")
    joined = sets.select("set_key", F.col("set").alias("node")).join(labels, "node").join(classes, "set_key")
    merged = joined.join(joined.groupBy("component").agg(F.min("least").alias("merged")), "component").select("set_key", "merged", F.lit(True).alias("linked"))
    ids = classes.join(merged, "set_key", "left").filter("rows > 1 or linked").select("set_key", "rows", F.coalesce("merged", "least").alias("component_id"))
    ids = common.materialize(ids, "classes")
    # Sets without a link or an equal are their own component, and so are empty ones; only others are joined.
    flagged = common.with_bit(prints.select("doc_id", "n", "set_key"), F.col("set_key"), common.bitmap_of(ids, F.col("set_key")), "maybe")
    some = F.col("maybe") & (F.col("n") > 0)
    joined = common.join_hot(flagged.filter(some), ids, ["set_key"], "rows", "left")
    size = F.col("n").cast("long").alias("n_shingles")
    return flagged.filter(~some).select("doc_id", size, F.col("doc_id").alias("component_id")).unionAll(joined.select("doc_id", size, F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_representatives(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, less the near copies of a row that stays.

    The row with a component's smallest doc_id stays (rows without an id stay).
    Only rows whose id may be dropped are shuffled.
    """
    (maybe,) = common.temp(docs, "maybe")
    found = near_duplicates(docs, words, percent)
    dropped = common.materialize(found.filter("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    flagged = common.with_bit(docs, F.col("doc_id"), common.bitmap_of(dropped, F.col("doc_id")), maybe)
    kept = flagged.filter(F.col(maybe)).join(dropped, "doc_id", "left_anti").select(docs.columns)
    return flagged.filter(~F.col(maybe)).select(docs.columns).unionAll(kept)
