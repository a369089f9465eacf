"""Token-id output as directly addressable codes.

Ids are split into 8-bit chunks, lowest first. Level k holds the k-th chunk of
every id that has one; a bitmap a level says which ids go on to the next, and
a rank directory (ones before every 512 bits) turns a position on one level
into the position on the next. So any id, or any range, is read by a few array
accesses; nothing is decoded before it.

A segment is one file image: header, document directory, levels. Segments are
written through Spark as rows of a Parquet table without compression (any store
that Spark writes to), in ascending order of document id, with part and place in the part, so
the global position of a token needs only the tokens a part holds.

Defined results: null counts as empty; null ids come first; rows with equal
ids are next to each other, in the order of the table's files (many of them may lie in several parts); a text of any length is one document of one
segment; an empty table gives an empty table of segments; other columns aren't
read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .chunks import bound_batches, encoder_of, gathered, release_memory

MAGIC = b"DAC1"
BLOCK = 512  # bits between entries of a rank directory
SEGMENTS = "part int, segment int, part_start long, n_docs int, n_tokens long, payload binary"


def _level(bits: np.ndarray) -> bytes:
    """Bitmap and rank directory of one level."""
    packed = np.packbits(bits, bitorder="little")
    packed = np.append(packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8))
    ones = np.bitwise_count(packed.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
    ranks = np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype("<u4")
    return packed.tobytes() + ranks.tobytes()


def encode_levels(ids: np.ndarray) -> bytes:
    """The levels of a sequence of ids, each preceded by its number of chunks and a flag for a next level."""
    rest, out = ids.astype("<u4"), []
    while True:
        more = rest > 0xFF
        out.append(struct.pack("<QB", len(rest), bool(more.any())) + (rest & 0xFF).astype(np.uint8).tobytes())
        if not more.any():
            return b"".join(out)
        out.append(_level(more))
        rest = rest[more] >> 8


class Dac:
    """Random access to a sequence that :func:`encode_levels` wrote."""

    def __init__(self, data: bytes, at: int = 0):
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        more = True
        while more:
            n, more = struct.unpack_from("<QB", data, at)
            at += 9
            chunks = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = ranks = None
            if more:
                blocks = -(-n // BLOCK)
                bits = np.frombuffer(data, np.uint8, blocks * BLOCK // 8, at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", blocks + 1, at)
                at += ranks.nbytes
            self.levels.append((chunks, bits, ranks))
        self.n = len(self.levels[0][0])

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before bit i."""
        block = i // BLOCK
        first = block * BLOCK // 8
        whole = bits[first : i // 8]
        rest = int(bits[i // 8]) & ((1 << i % 8) - 1) if i % 8 else 0
        return int(ranks[block]) + int(np.bitwise_count(whole).sum()) + rest.bit_count()

    def __getitem__(self, i: int) -> int:
        """The i-th id."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * k
            if bits is None or not bits[i // 8] >> i % 8 & 1:
                break
            i = self._rank(bits, ranks, i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop; reads nothing outside the range but one block of bits a level."""
        start, stop = max(0, start), min(stop, self.n)
        out = np.zeros(max(0, stop - start), "<u4")
        places = None
        for k, (chunks, bits, ranks) in enumerate(self.levels):
            got = chunks[start:stop].astype("<u4") << np.uint32(8 * k)
            if places is None:
                out |= got
            else:
                out[places] |= got
            if bits is None or stop <= start:
                break
            flags = np.unpackbits(bits[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start].astype(bool)
            places = np.flatnonzero(flags) if places is None else places[flags]
            start = self._rank(bits, ranks, start)
            stop = start + len(places)
        return out


def encode_segment(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    """A file image: magic, number of documents, their ids, null flags, starts (one more than documents), levels."""
    n = len(doc_ids)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    missing = np.array([d is None for d in doc_ids], np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<u8")
    flat = np.concatenate([x.astype("<u4") for x in ids]) if ids else np.zeros(0, "<u4")
    return MAGIC + struct.pack("<Q", n) + known.tobytes() + missing.tobytes() + starts.tobytes() + encode_levels(flat)


class Segment:
    """Reads a file image: documents by place, tokens by position."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        (n,) = struct.unpack_from("<Q", data, 4)
        at = 12
        known, missing = np.frombuffer(data, "<i8", n, at), np.frombuffer(data, np.uint8, n, at + 8 * n)
        at += 9 * n
        self.doc_ids = [None if m else int(d) for d, m in zip(known, missing, strict=True)]
        self.starts = np.frombuffer(data, "<u8", n + 1, at).astype(np.int64)
        self.tokens = Dac(data, at + 8 * (n + 1))

    def document(self, k: int) -> np.ndarray:
        return self.tokens.slice(int(self.starts[k]), int(self.starts[k + 1]))


def write_segments(docs: DataFrame, vocabulary: str, end_id: int = 2, segment_tokens: int = 1 << 18) -> DataFrame:
    """Encode every text and write segments in ascending order of doc_id.

    Texts are dealt out by range of doc_id and row (so that the rows of one id,
    or of none, can be dealt out too) before they are encoded (a range
    deals by sampling ids, so its extra pass must not encode), and each task
    streams its sorted rows into segments of about ``segment_tokens``.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = encoder_of(vocabulary), TaskContext.get().partitionId()
        number = total = held = 0
        doc_ids: list = []
        ids: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            nonlocal number, total, held, doc_ids, ids
            row = [part, number, total, len(doc_ids), held, encode_segment(doc_ids, ids)]
            number, total, held, doc_ids, ids = number + 1, total + held, 0, [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["part", "segment", "part_start", "n_docs", "n_tokens", "payload"])

        for piece in gathered(source, 1, 3_000_000):
            for d, x in zip(piece.column(0).to_pylist(), encoder.encode(piece.column(1), end_id), strict=True):
                doc_ids.append(d)
                ids.append(x)
                held += len(x)
                if held >= segment_tokens:
                    yield segment()
        if doc_ids:
            yield segment()
        release_memory()

    bound_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    dealt = rows.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row")
    return common.materialize(dealt.select("doc_id", "text").mapInArrow(run, SEGMENTS), "dac", compression="none")


def starts_of(segments: DataFrame) -> DataFrame:
    """Segments with the number of tokens in all earlier ones.

    Tokens before a part: a running sum over parts (one row a writing task, so
    their number is that of the table's partitions), not over segments or
    documents.
    """
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = common.materialize(totals.select("part", before.alias("base")), "bases")
    return common.join_small(segments, bases, "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def read_documents(segments: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32. Each is read by its position, through the rank directories."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for start, payload in zip(batch.column(0), batch.column(1), strict=True):
                segment = Segment(payload.as_py())
                sums = [zlib.crc32(segment.document(k)) for k in range(len(segment.doc_ids))]
                yield pa.RecordBatch.from_arrays([pa.array(segment.doc_ids, pa.int64()), pa.array(segment.starts[:-1] + start.as_py()), pa.array(np.diff(segment.starts)), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return starts_of(segments).select("start", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
