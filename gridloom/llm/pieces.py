"""SentencePiece encoding and decoding by a table of distinct words.

In the vocabulary no piece has a white space marker after any other character,
so no merge can cross from a word into the marker that follows. A text, its
blanks turned into markers, is cut before each run of markers; each distinct
marked word of the table is segmented once by the library and the ids are joined
back by position. A vocabulary for which this doesn't hold is used on whole texts.

1. *Words.* Tasks cut their texts in blocks of about BLOCK characters. A block
   keeps its distinct words, and each text is the places of its words among them.
2. *Table.* A block asks the task of each hash range for the ids of its words in
   that range, once each. That task meets all blocks that have a word, keeps the
   range's table of distinct words, and lets the library segment those that are new.
   It reads its questions as a stream, so a word of every block costs it one
   entry; the number of ranges follows the size of the texts.
3. *Join.* Answers meet their block's places again, and ids are put in order.

Words are cut twice, once for each side of the join, from the same rows; a block's
key depends on its words, so rows that came differently (a source that isn't
stable, read again) end in an error and not in wrong ids.

Defined results: null counts as empty and has the begin and end id; repeated
rows and rows without an id are encoded each; very long texts are a block of their own, and words without a blank
are one word; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .chunks import bound_batches, process_wide, release_memory, slices
from .rows import add_columns

MARK = "▁"
BLOCK = 16_000_000  # characters in a block
RANGE = 32_000_000  # characters of the table a hash range
_MARKED = re.compile("▁+[^▁]*")


_ZSTD = pa.Codec("zstd")


def squeezed(data: bytes) -> bytes:
    """Compressed, with the size before it: what is shuffled are mostly small numbers and words."""
    return struct.pack("<Q", len(data)) + _ZSTD.compress(data, asbytes=True)


def restored(data: bytes) -> bytes:
    (size,) = struct.unpack_from("<Q", data)
    return _ZSTD.decompress(memoryview(data)[8:], decompressed_size=size, asbytes=True) if size else b""


class Library:
    """The library's processor, and whether texts can be cut into marked words."""

    def __init__(self, file: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=file)
        self.begin, self.end = self.processor.bos_id(), self.processor.eos_id()
        size = self.processor.get_piece_size()
        names = [self.processor.id_to_piece(i) for i in range(size)]
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.blank = self.processor.piece_to_id(MARK)
        # Cutting needs: no piece with a marker after another character, a dummy marker in front, blanks kept, no other normalization.
        self.cuts = not any(MARK in p.lstrip(MARK) for p in names) and self.processor.normalize("  a\n b  ") == "▁▁▁a\n▁b▁▁"

    def segment(self, words: list[str]) -> list[bytes]:
        """Ids of marked words, each given without its first marker (the library puts that back)."""
        code = "HI"[self.width.itemsize // 4]
        found = self.processor.encode(words, num_threads=1)
        return [array(code, x if w else [self.blank]).tobytes() for w, x in zip(words, found, strict=True)]

    def whole(self, text: str | None) -> np.ndarray:
        return self.framed(np.array(self.processor.encode(text or ""), "<u4"))

    def framed(self, ids: np.ndarray) -> np.ndarray:
        """With begin and end id, as little-endian 32-bit integers."""
        return np.concatenate([[self.begin], ids, [self.end]]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        return self.processor.decode(ids.tolist())


def library_of(file: str) -> Library:
    return process_wide(("pieces", file), lambda: Library(file))


def words_of(text: str | None) -> list[str]:
    """Marked words, each without its first marker. None has a blank."""
    if not text:
        return []
    if MARK not in text:
        found = text.split(" ")
        if "" not in found:
            return found
    return [x[1:] for x in _MARKED.findall(MARK + text.replace(" ", MARK))]


class _Places(dict):
    """Places of distinct words, by first occurrence."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def blocks(source: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[str], list, list[np.ndarray]]]:
    """Blocks of rows (doc_id, text): key, distinct words, ids, and the places of each text's words."""
    part, number = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    places, doc_ids, texts, held = _Places(), [], [], 0

    def block():
        words = list(places)
        told = hashlib.blake2b(f"{part} {number} ".encode(), digest_size=8)
        told.update(" ".join(words).encode())
        return int.from_bytes(told.digest(), "little", signed=True), words, doc_ids, texts

    for batch in source:
        for piece in slices(batch, 1, size):
            for d, t in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                doc_ids.append(d)
                texts.append(np.array(list(map(places.__getitem__, words_of(t))), np.uint32))
                held += len(t or "")
                if held >= size:
                    yield block()
                    number += 1
                    places, doc_ids, texts, held = _Places(), [], [], 0
    if doc_ids:
        yield block()


def _ask(ranges: int, size: int):
    """A block's words, a row for each hash range that has some."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_wide(None, lambda: None)
        for key, words, _, _ in blocks(source, size):
            goal = np.fromiter((zlib.crc32(w.encode()) for w in words), np.uint64, len(words)) * np.uint64(ranges) >> np.uint64(32)
            order = np.argsort(goal, kind="stable")
            cuts = np.searchsorted(goal[order], np.arange(ranges + 1, dtype=np.uint64))
            for r in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[r] : cuts[r + 1]]
                row = [int(r)], [key], [squeezed(np.diff(at, prepend=0).astype("<u4").tobytes())], [squeezed(" ".join([words[k] for k in at]).encode())]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "block", "places", "words"])
        release_memory()

    return run


def answers(messages: Iterator[tuple[int, bytes, bytes]], segment: Callable[[list[str]], list[bytes]], width: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """For one hash range: (block, places, words) to (block, places, numbers of ids, ids). Each distinct word is segmented once."""
    table: dict[str, bytes] = {}
    for block, places, packed in messages:
        words = packed.decode().split(" ")
        new = list({w for w in words if w not in table})
        for k in range(0, len(new), 50_000):
            table.update(zip(new[k : k + 50_000], segment(new[k : k + 50_000]), strict=True))
        found = [table[w] for w in words]
        lengths = np.fromiter(map(len, found), "<u4", len(found)) // width
        yield block, places, lengths.astype("<u4").tobytes(), b"".join(found)


def _answer(file: str):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = library_of(file)
        messages = ((b.as_py(), p.as_py(), restored(w.as_py())) for batch in source for b, p, w in zip(batch.column(1), batch.column(2), batch.column(3), strict=True))
        for block, places, lengths, ids in answers(messages, library.segment, library.width.itemsize):
            row = block, places, squeezed(lengths), squeezed(ids)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["block", "places", "lengths", "ids"])
        release_memory()

    return run


def _place(size: int, kind: pa.DataType, rows: int = 1000):
    """A block's texts, ``rows`` a row: their ids, numbers of words, and the words' places, in two planes of 16 bits."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_wide(None, lambda: None)
        for key, _, doc_ids, texts in blocks(source, size):
            for k in range(0, len(texts), rows):
                some = texts[k : k + rows]
                flat = np.concatenate(some)
                planes = (squeezed(x.tobytes()) for x in (np.array([len(x) for x in some], "<u4"), flat.astype("<u2"), (flat >> 16).astype("<u2")))
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([doc_ids[k : k + rows]], pa.list_(kind)), *(pa.array([x], pa.binary()) for x in planes)], ["block", "doc_ids", "sizes", "low", "high"])
        release_memory()

    return run


def _joined(file: str, finish: Callable[[Library, np.ndarray], tuple], added: list[tuple[str, T.DataType, pa.DataType]]):
    """For one block: the ids of each text, put through ``finish``."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = library_of(file)
        docs: list[tuple] = []
        replies: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in source:
            for row in range(batch.num_rows):
                own, *planes = (batch.column(k)[row] for k in range(1, 8))
                planes = [restored(x.as_py()) for x in planes if x.is_valid]
                if own.is_valid:
                    docs.append((own.values, *(np.frombuffer(x, t) for x, t in zip(planes, ("<u4", "<u2", "<u2"), strict=True))))
                else:
                    p, n, x = (np.frombuffer(v, t) for v, t in zip(planes, ("<u4", "<u4", library.width), strict=True))
                    replies.append((np.cumsum(p, dtype=np.int64), n.astype(np.int64), x))
        size = max((int(p[-1]) + 1 for p, _, _ in replies), default=0)
        lengths, starts, base, told = np.zeros(size, np.int64), np.zeros(size, np.int64), 0, 0
        for p, n, x in replies:
            lengths[p], starts[p] = n, base + np.cumsum(n) - n
            base, told = base + len(x), told + len(p)
        flat = np.concatenate([x for _, _, x in replies]) if replies else np.zeros(0, library.width)
        if told != size:
            raise RuntimeError(f"{told} of {size} words of a block have ids")
        for doc_ids, sizes, low, high in docs:
            places = low.astype(np.int64) | high.astype(np.int64) << 16
            if len(places) and places.max() >= size:
                raise RuntimeError("words of a block have no ids: its rows came otherwise when they were read again")
            rows = []
            for at in np.split(places, np.cumsum(sizes, dtype=np.int64)[:-1]):
                n = lengths[at]
                ids = flat[np.repeat(starts[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                rows.append(finish(library, library.framed(ids)))
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(list(c), t) for c, (_, _, t) in zip(columns, added, strict=True))], ["doc_id", *(n for n, _, _ in added)])
        del docs, replies, flat
        release_memory()

    return run


def encoded(docs: DataFrame, file: str, finish: Callable[[Library, np.ndarray], tuple], added: list[tuple[str, T.DataType, pa.DataType]], block: int = BLOCK, per_range: int = RANGE) -> DataFrame:
    """doc_id and the columns that ``finish`` makes of each text's ids."""
    rows = docs.select("doc_id", "text")
    if not Library(file).cuts:

        def start():
            library = library_of(file)
            return lambda texts: [list(c) for c in zip(*(finish(library, library.whole(t)) for t in texts), strict=True)] or [[] for _ in added]

        return add_columns(rows, "text", start, added, ["doc_id"], 4_000_000)
    bound_batches(docs.sparkSession)
    chars = common.text_chars(docs)
    ranges = max(8, chars // per_range + 1)
    told = rows.mapInArrow(_ask(ranges, block), "range int, block long, places binary, words binary")
    # Ranges are dealt out by number: a task has one.
    replies = told.repartitionById(ranges, F.col("range")).mapInArrow(_answer(file), "block long, places binary, lengths binary, ids binary")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("sizes", "low", "high"))])
    placed = rows.mapInArrow(_place(block, to_arrow_type(kind)), schema)
    none = F.lit(None).cast("binary")
    both = placed.select("*", none.alias("places"), none.alias("lengths"), none.alias("ids")).unionAll(
        replies.select("block", F.lit(None).cast(T.ArrayType(kind)), none, none, none, "places", "lengths", "ids")
    )
    both = both.repartition(max(8, chars // block + 1), "block")
    out = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, t) for n, t, _ in added)])
    return both.groupBy("block").applyInArrow(_joined(file, finish, added), out)


def _pieces(library: Library, ids: np.ndarray) -> tuple:
    return len(ids), ids.tobytes(), library.decode(ids)


def _digests(library: Library, ids: np.ndarray) -> tuple:
    return len(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def encode_documents(docs: DataFrame, model: str, **sizes: int) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit), decoded (the text that the ids decode to) for every document."""
    return encoded(docs, model, _pieces, [("n_tokens", T.LongType(), pa.int64()), ("ids", T.BinaryType(), pa.binary()), ("decoded", T.StringType(), pa.string())], **sizes)


def round_trip(docs: DataFrame, model: str, **sizes: int) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return encoded(docs, model, _digests, [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())], **sizes)
