"""Packing documents into windows by non-negative least squares.

Lengths are put into bins of ``grain`` tokens. Shallow combinations of at most
``depth`` bins that fill a window are enumerated once; how often to use each is
the non-negative least squares solution against the histogram of lengths,
rounded and cut to what is there. Pieces that no combination takes are packed
greedily and cut at the window's end. Slack that binning leaves is filled from
them too.

Each task packs the documents of its partition in groups of bounded size, so
nothing is shuffled, memory is bounded and a lost task is repeated alone. Only
the last window of a task can be far from full.

Defined results: null counts as empty, so that a document has its end id
alone; repeated rows are packed each; very long texts are cut into full
windows and a rest; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .chunks import bound_batches, encoder_of, gathered, release_memory

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache
def combinations(bins: int, depth: int) -> np.ndarray:
    """All multisets of at most ``depth`` bins 1..bins that sum to ``bins``, as counts: bins x combinations."""
    found: list[list[int]] = []

    def extend(chosen: list[int], rest: int, most: int) -> None:
        if rest == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for b in range(min(rest, most), 0, -1):
                if b * (depth - len(chosen)) < rest:
                    break
                extend([*chosen, b], rest - b, b)

    extend([], bins, bins)
    out = np.zeros((bins, len(found)))
    for k, chosen in enumerate(found):
        for b in chosen:
            out[b - 1, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, tol: float = 1e-6) -> np.ndarray:
    """min ||a x - b|| with x >= 0, by Lawson and Hanson's active sets."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[free] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tol * max(1.0, np.abs(b).max()):
            break
        free[best] = True
        while free.any():
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 1e-12
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            gone = at[low & (x[at] <= 1e-9)]
            if not len(gone):
                gone = at[low][:1]
            free[gone] = False
            x[gone] = 0
    return x


def repeats(histogram: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """How often to use each combination: solved, rounded, cut so that no bin is overdrawn."""
    if not histogram.any():
        return np.zeros(shapes.shape[1], np.int64)
    counts = np.rint(nnls(shapes, histogram.astype(float))).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    for k in np.argsort(-counts, kind="stable"):
        if counts[k] == 0:
            break
        used = shapes[:, k].astype(np.int64)
        need = used > 0
        counts[k] = min(counts[k], int((left[need] // used[need]).min()))
        left -= counts[k] * used
    return counts


def pack(lengths: np.ndarray, window: int = 2048, grain: int = 32, depth: int = 4, least: int = 8) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Windows of (item, start in the item, length): full ones, and at most one that isn't.

    Windows of combinations are dissolved, those with most slack first, until
    the pieces left over can fill the slack of the others. ``least`` is the
    shortest piece cut off to fill slack.
    """
    windows: list[list[tuple[int, int, int]]] = []
    rests: list[tuple[int, int]] = []
    for i, n in enumerate(map(int, lengths)):
        full = n // window
        windows += [[(i, k * window, window)] for k in range(full)]
        if n % window:
            rests.append((i, full * window))
    size = {i: int(lengths[i]) - s for i, s in rests}
    bins = window // grain
    held: list[list[tuple[int, int]]] = [[] for _ in range(bins)]
    for i, s in sorted(rests, key=lambda x: size[x[0]]):
        held[-(-size[i] // grain) - 1].append((i, s))
    shapes = combinations(bins, depth)
    open_windows: list[list[tuple[int, int, int]]] = []
    counts = repeats(np.array([len(h) for h in held]), shapes)
    for k in np.flatnonzero(counts):
        chosen = np.repeat(np.arange(bins), shapes[:, k].astype(int))[::-1]
        for _ in range(int(counts[k])):
            taken = [held[b].pop() for b in chosen]
            open_windows.append([(i, s, size[i]) for i, s in taken])
    # What is left, longest first, as a stream that is cut wherever a window ends.
    stream = [(i, s, size[i]) for h in held for i, s in h]
    open_windows.sort(key=lambda w: sum(n for _, _, n in w), reverse=True)
    slack, loose = sum(window - n for w in open_windows for n in [sum(x[2] for x in w)] if window - n >= least), sum(x[2] for x in stream)
    while open_windows and loose < slack:
        w = open_windows.pop()
        stream += w
        n = sum(x[2] for x in w)
        loose, slack = loose + n, slack - (window - n)
    stream.sort(key=lambda x: x[2])

    def fill(into: list[tuple[int, int, int]], room: int) -> int:
        while room and stream:
            i, s, n = stream.pop()
            take = min(n, room)
            into.append((i, s, take))
            room -= take
            if n > take:
                stream.append((i, s + take, n - take))
        return room

    for w in open_windows:
        room = window - sum(n for _, _, n in w)
        if room >= least:
            fill(w, room)
        windows.append(w)
    last: list[list[tuple[int, int, int]]] = []
    while stream:
        w: list[tuple[int, int, int]] = []
        (windows if fill(w, window) == 0 else last).append(w)
    return windows, last


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, window: int = 2048, group_tokens: int = 4_000_000, max_chunks: int = 400_000, at_once: int = 3_000_000) -> DataFrame:
    """One row a piece. ``max_chunks`` bounds the worker's table of chunks (about 0.2 KB each), ``at_once`` the bytes of text encoded together. sequence_id: the task's number times 2**32, plus the window's number in the task."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary, max_chunks)
        sequence = TaskContext.get().partitionId() << 32
        group: list[tuple[int | None, np.ndarray, int]] = []
        held = 0

        def packed(final: bool) -> pa.RecordBatch:
            """Rows of a group's windows. A window that isn't full waits for the next group, unless it is the last."""
            nonlocal group, sequence, held
            # An item is a document, or what of it earlier groups left: its ids and where they begin.
            windows, last = pack(np.array([len(x) - s for _, x, s in group]), window)
            if final:
                windows += last
            rows: list[list] = [[] for _ in range(7)]
            for w in windows:
                offset = 0
                for i, s, n in w:
                    doc, ids, base = group[i]
                    piece = ids[base + s : base + s + n]
                    for column, value in zip(rows, (doc, base + s, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids), sequence, offset), strict=True):
                        column.append(value)
                    offset += n
                sequence += 1
            left = [] if final else [(i, s, n) for w in last for i, s, n in w]
            # An item's open piece is its tail, since the stream is cut from the front.
            group = [(group[i][0], group[i][1], group[i][2] + s) for i, s, n in left]
            held = sum(n for _, _, n in left)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], [f.split()[0] for f in PIECES.split(", ")])

        for piece in gathered(source, 1, at_once):
            for d, x in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1), end_id), strict=True):
                group.append((d, x, 0))
                held += len(x)
                if held >= group_tokens:
                    yield packed(False)
        if group:
            yield packed(True)
        release_memory()

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
