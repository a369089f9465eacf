"""Exact top-k search by an impact-ordered, score-at-a-time index.

Vectors are turned into integers floor(scale * x). Candidates are dealt into
blocks of bounded size; a block's index has, for each dimension, postings in
segments of equal quantised value. For a query, a segment's impact is the most
that its postings can add over the dimension's least; segments of all
dimensions are processed in groups by descending impact. A candidate's score lies between
what it has gathered and that plus, for each dimension not met yet, the greatest impact
still to come. After every group, candidates that can't reach the k-th best
lower bound are out for good. Processing stops when that leaves at most ``few``
(or there is nothing more to process); those are rescored exactly.

A block is a partition: its candidates come first, then all queries, as a stream.
So an index is built once a block, neither side is broadcast or collected, and a
task holds one block of candidates.

Defined results: vectors that are null or hold a null or a non-finite value take
no part; shorter vectors count as if zeros followed; components so large that a
score might exceed 64 bits (over 2**28 / scale with 64 of them) count as the
largest that can't; of equal scores the smaller
id is better; rows with the query's id are its own and no candidates; a query id
that occurs twice is answered once for each distinct vector, ranks running on
(vectors in order of their components); fewer candidates than k give fewer rows;
an empty table gives none; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 1024
BLOCK = 8192  # candidates in a block
LEVELS = 128  # quantised values a dimension
GROUPS = 12  # of segments, each followed by a test of the proof


class Index:
    """Impact-ordered postings of one block of integer vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS):
        self.ids, self.vectors, self.n_levels = ids, vectors.astype(np.int64), levels
        n, dims = self.vectors.shape
        self.low, self.high = self.vectors.min(0), self.vectors.max(0)
        width = np.maximum(1, -(-(self.high - self.low + 1) // levels))
        self.level = ((self.vectors - self.low) // width).astype(np.int16)
        self.level = np.ascontiguousarray(self.level.T)
        self.postings = np.argsort(self.level, axis=1, kind="stable")
        self.sizes = np.stack([np.bincount(x, minlength=levels) for x in self.level])
        self.starts = np.pad(np.cumsum(self.sizes, axis=1), ((0, 0), (1, 0)))
        # Least and greatest value that a segment can hold.
        edges = self.low[:, None] + width[:, None] * np.arange(levels + 1)
        self.least = np.minimum(edges[:, :-1], self.high[:, None])
        self.most = np.minimum(edges[:, 1:] - 1, self.high[:, None])

    def search(self, query: np.ndarray, k: int, own: int | None = None, few: int | None = None) -> tuple[np.ndarray, np.ndarray, int, int]:
        """Ids and exact scores of the k best, best first; how many postings were processed, and how many candidates rescored.

        ``few``: how many possible members end the processing, by default 4 * k.
        """
        q = query.astype(np.int64)
        n, dims = self.vectors.shape
        members = np.arange(n) if own is None else np.flatnonzero(self.ids != own)
        k = min(k, len(members))
        if k == 0:
            return self.ids[:0], np.zeros(0, np.int64), 0, 0
        few = 4 * k if few is None else few
        # What a posting adds over the dimension's least, by segment: at least `lower`, at most `upper` (its impact).
        # In double precision: exact below 2**53, `slack` is more than the rounding of larger ones.
        ends = np.stack([q[:, None] * self.least.astype(float), q[:, None] * self.most.astype(float)])
        worst = np.minimum(q * self.low.astype(float), q * self.high.astype(float))[:, None]
        lower, upper = ends.min(0) - worst, ends.max(0) - worst
        gap, top, slack = (upper - lower).max(1).sum(), upper.max(1), 1e-12 * dims * np.abs(ends).max()
        order = np.argsort(-upper, axis=None, kind="stable")
        reached = np.cumsum(self.sizes.ravel()[order])
        adds = np.repeat(lower.ravel(), self.sizes.ravel()).reshape(dims, n)
        sure, n_met = np.zeros(n), np.zeros(n)
        seen = np.zeros(dims, np.int64)  # segments processed, from the end where impact is greatest
        met = 0
        for group in range(1, GROUPS + 1):
            if len(members) <= few:
                break  # proved: the k best are among these
            upto = int(np.searchsorted(reached, group / GROUPS * n * dims)) + 1 if group < GROUPS else order.size
            now = np.bincount(order[:upto] // self.n_levels, minlength=dims)
            rows = []
            for d in np.flatnonzero(now > seen):
                a, b = (self.n_levels - now[d], self.n_levels - seen[d]) if q[d] >= 0 else (seen[d], now[d])
                rows.append((d, slice(self.starts[d, a], self.starts[d, b])))
            at = np.concatenate([self.postings[r] for r in rows]) if rows else self.postings[0, :0]
            if len(at):
                sure += np.bincount(at, np.concatenate([adds[r] for r in rows]), n)
                n_met += np.bincount(at, minlength=n)
                met += len(at)
            seen = now
            # No posting still to come adds more than the next segment's impact, nor than its dimension's greatest.
            left = upper.ravel()[order[upto]] if upto < order.size else 0.0
            most = sure[members] - left * n_met[members] + (gap + np.minimum(left, top).sum())
            members = members[most + slack >= np.partition(sure[members], -k)[-k]]
        exact = self.vectors[members] @ q
        ids = self.ids[members]
        best = np.lexsort((ids, -exact))[:k]
        return ids[best], exact[best], met, len(members)


def quantized(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, null unless all are finite numbers; cut where inner products might leave 64 bits."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < math.inf))
    most = F.floor(F.sqrt(F.lit(2.0**62) / F.greatest(F.size(vector), F.lit(1)))).cast("long")
    whole = F.transform(vector, lambda x: F.greatest(-most, F.least(most, F.floor(F.greatest(F.lit(-1e18), F.least(F.lit(1e18), x.cast("double") * scale))).cast("long"))))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def matrix(vectors: pa.ListArray) -> np.ndarray:
    """Rows of integers, shorter ones filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _wide(rows: np.ndarray, dims: int) -> np.ndarray:
    """Rows cut or filled up with zeros to ``dims`` columns."""
    return np.pad(rows[:, :dims], ((0, 0), (0, max(0, dims - rows.shape[1]))))


def answers(source: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, turn, vec_id, vector), by block, candidates (turn 0) first: the block's k best of each query."""
    block, index = None, None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in source:
        blocks, turns, ids = (batch.column(i).to_numpy() for i in range(3))
        asks = turns > 0
        cuts = [0, *(np.flatnonzero((blocks[1:] != blocks[:-1]) | (asks[1:] != asks[:-1])) + 1), len(blocks)]
        out: list[list] = [[], [], [], []]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if blocks[a] != block:
                block, index, held = blocks[a], None, []
            rows = matrix(batch.column(3).slice(a, b - a))
            if not asks[a]:
                held.append((ids[a:b], rows))
                continue
            if not held:
                continue
            if index is None:
                dims = max(x.shape[1] for _, x in held)
                index = Index(np.concatenate([x for x, _ in held]), np.concatenate([_wide(x, max(dims, 1)) for _, x in held]))
            for i, q in enumerate(_wide(rows, index.vectors.shape[1])):
                found, score, _, _ = index.search(q, k, ids[a + i])
                for column, value in zip(out, ([ids[a + i]] * len(found), [turns[a + i]] * len(found), found.tolist(), score.tolist()), strict=True):
                    column += value
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], ["query_id", "turn", "vec_id", "score"])


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query (ids divisible by ``every``)."""
    vectors = embeddings.select("vec_id", quantized(F.col("embedding"), scale).alias("vector")).filter("vector is not null and vec_id is not null")
    vectors = common.materialize(vectors, "vectors")
    n = max(1, -(-vectors.count() // block))
    # Rows are dealt by their place in the written table, so copies of a vector or an id are dealt out too.
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    candidates = vectors.select(place.alias("block"), F.lit(0).alias("turn"), "vec_id", "vector")
    turn = F.row_number().over(Window.partitionBy("vec_id").orderBy("vector"))
    queries = common.materialize(vectors.filter(F.col("vec_id") % every == 0).distinct().select(turn.alias("turn"), "vec_id", "vector"), "queries")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"), "turn", "vec_id", "vector")
    dealt = candidates.unionAll(asked).repartitionById(n, F.col("block")).sortWithinPartitions("block", "turn")
    found = dealt.mapInArrow(lambda source: answers(source, k), "query_id long, turn int, vec_id long, score long")
    # A query has at most k rows a block of candidates: the k best of those.
    best = Window.partitionBy("query_id", "turn").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("at", F.row_number().over(best)).filter(F.col("at") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("turn", "at"))
    return found.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score")
