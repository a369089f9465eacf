"""Exact tokenization by distinct chunks.

A text is cut before white space and between a letter and a mark, where no token
of the vocabulary can reach across; each distinct chunk is encoded once by the library and its ids are
joined back by position. Texts in which a cut might matter go to the library
whole, so ids always equal the library's.
"""

from __future__ import annotations

import ctypes
import gc
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space other than blank and line feed (as either library sees it), and
#: the opening of special-token strings: such texts aren't cut.
_WHOLE = re.compile("[\0\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]|<\\|")
#: First bytes of what _WHOLE finds; only texts with one of them are searched.
_DOUBTFUL = b"\0\t\r\x0b\x0c\x1c\x1d\x1e\x1f<\xc2\xe1\xe2\xe3\xef"
#: Letters whose case may depend on what stands around them: such texts aren't folded.
_WIDE = re.compile("[^\\0-\xff]")
#: Letters that both vocabularies keep together as one word with a blank before it: A-Z, a-z and those from À to ÿ.
_PLAIN = re.compile(rb" (?:[A-Za-z]+|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Letters after which marks may be cut off, if the library ends a token there.
_LATIN = [c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)]) if c.isalpha()]
_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Kinds of bytes; a byte may be of several.
_BLANK, _LETTER, _MARK, _DOUBT, _TAIL = 1, 2, 4, 8, 32


class ChunkEncoder:
    """Ids of texts by a ``tokenizers`` file, as little-endian ``uint32``.

    The table of distinct chunks keeps the first ``max_chunks`` and no chunk
    longer than ``max_len`` bytes, which bounds its memory; others are encoded
    once a call.
    """

    def __init__(self, file: str, max_chunks: int = 500_000, max_len: int = 64):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.table: dict[bytes, bytes] = {}
        self.max_chunks, self.max_len = max_chunks, max_len
        size = self.library.get_vocab_size()
        self.width = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        told = json.loads(self.library.to_str())
        suffix = told["model"].get("end_of_word_suffix")
        names = [self.library.id_to_token(i) or "" for i in range(size)]
        #: Ids that end a word, or, without such a suffix, that start one.
        self.ends = bool(suffix)
        #: Whether case and the kind of white space make no difference.
        self.folds = self.ends and self._encode(["The\n Élan"]) == self._encode(["the élan"])
        #: Between a letter and an ASCII mark a token ends; checked for each letter that is cut from its marks.
        #: Other letters may be decomposed or joined with what follows; they stay with their marks.
        both, alone = self._encode([c + "." for c in _LATIN]), self._encode([*_LATIN, "."])
        whole = [c.encode() for c, x, y in zip(_LATIN, both, alone) if x == y + alone[-1]]
        kinds = np.zeros(256, np.uint8)
        for kind, found in ((_BLANK, b" \n"), (_LETTER, b"".join(c for c in whole if len(c) == 1)), (_MARK, _MARKS), (_DOUBT, _DOUBTFUL), (_TAIL, bytes(range(0x80, 0xC0)))):
            kinds[list(found)] |= kind
        self.kinds = kinds.tobytes()
        #: Second bytes, after C3, of letters that are cut from their marks.
        self.latin = np.zeros(256, bool)
        self.latin[[c[1] for c in whole if len(c) == 2]] = True
        self.edge = np.array([x.endswith(suffix) if suffix else x.startswith("Ġ") for x in names])

    def _encode(self, texts: list[str]) -> list[bytes]:
        code = "HI"[self.width.itemsize // 4]
        return [array(code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_plain(self, words: list[bytes]) -> list[bytes]:
        """As _encode, for plain words: many in one text, cut again at the ids that end or start a word."""
        out: list[bytes] = []
        for i in range(0, len(words), 500):
            part = words[i : i + 500]
            ids = np.frombuffer(self._encode([b"".join(part).decode()])[0], self.width)
            at = np.flatnonzero(self.edge[ids])
            if len(at) != len(part):
                out += self._encode([w.decode() for w in part])
                continue
            n = self.width.itemsize
            cuts, raw = (n * np.append(0, at + 1) if self.ends else n * np.append(at, len(ids))).tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def _encode_chunks(self, new: list[bytes]) -> list[bytes]:
        """Ids of chunks that the table lacks."""
        found = list(map(_PLAIN.fullmatch, new))
        plain = iter(self._encode_plain([c for c, is_plain in zip(new, found) if is_plain]))
        rest = [c.decode() for c, is_plain in zip(new, found) if not is_plain]
        others = iter([x for i in range(0, len(rest), 20_000) for x in self._encode(rest[i : i + 20_000])])
        return [next(plain if is_plain else others) for is_plain in found]

    def _arrow(self, texts: list[str | None] | pa.Array) -> pa.Array:
        """Texts as an array without nulls, folded if the library folds them."""
        if self.folds:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            texts = [((t.lower() if t.isascii() or not _WIDE.search(t) else t).replace("\n", " ")) if t else "" for t in texts]
        return pc.fill_null(texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()), "")

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The chunks of all texts, one after the other, as a view of their bytes, and how many each text has.

        A chunk begins where white space does and between a letter and a mark, so that a
        word is one chunk with or without marks after it; white space belongs to what follows.
        """
        _, places, content = texts.buffers()
        offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if offsets[0] == offsets[-1]:
            return pa.array([], pa.large_binary()), np.zeros(len(texts), np.int64)
        content = content.slice(offsets[0], offsets[-1] - offsets[0])
        offsets = offsets - offsets[0]
        data, kinds = np.frombuffer(content, np.uint8), np.frombuffer(content.to_pybytes().translate(self.kinds), np.uint8)
        starts = np.zeros(len(data) + 1, bool)
        blank = kinds & _BLANK
        starts[1:-1] = (blank[1:] > blank[:-1]) | ((kinds[1:] & _MARK) >> 1 & kinds[:-1] != 0)
        tails = np.flatnonzero((kinds[1:] & _MARK) << 3 & kinds[:-1]) + 1
        starts[tails[(data[tails - 2] == 0xC3) & self.latin[data[tails - 1]]]] = True
        starts[offsets] = True
        doubt = np.flatnonzero(kinds & _DOUBT)
        doubt = doubt[(data[doubt] != ord("<")) | (data[np.minimum(doubt + 1, len(data) - 1)] == ord("|"))]
        for i in np.unique(np.searchsorted(offsets, doubt, "right") - 1).tolist():
            if _WHOLE.search(texts[i].as_py()):
                starts[offsets[i] + 1 : offsets[i + 1]] = False
        begins = np.flatnonzero(starts)
        return pa.Array.from_buffers(pa.large_binary(), len(begins) - 1, [None, pa.py_buffer(begins), content]), np.diff(np.searchsorted(begins, offsets))

    def encode(self, texts: list[str | None] | pa.Array, end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each text, and then ``end_id`` if given; null counts as empty.

        Chunks are cut in the texts' bytes and numbered by Arrow, so that only distinct
        ones are looked up; ids are gathered by number. Whole texts and the end count as chunks.
        """
        if not len(texts):
            return []
        table = self.table
        full = len(table) > self.max_chunks
        chunks, counts = self._cut(self._arrow(texts))
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        values = list(map(table.get, names))
        at = [k for k, v in enumerate(values) if v is None]
        for k, ids in zip(at, self._encode_chunks([names[k] for k in at]), strict=True):
            values[k] = ids
        if not full:
            table.update((names[k], values[k]) for k in at if len(names[k]) <= self.max_len)
        numbers = coded.indices.to_numpy()
        if end_id is not None:
            numbers = np.insert(numbers, np.cumsum(counts), len(values))
            counts = counts + 1
            values.append(np.array([end_id], self.width).tobytes())
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.width.itemsize
        lengths = sizes[numbers]
        ids = np.frombuffer(b"".join(values), self.width)[_ranges((np.cumsum(sizes) - sizes)[numbers], lengths)]
        ends = np.append(0, np.cumsum(lengths))[np.cumsum(counts)].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each range, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


ARROW_ROWS = 1000


def bound_batches(spark) -> None:
    """Let Arrow batches of the session have at most ARROW_ROWS rows: texts are long, and a batch is held on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)


_held: list = [None, None]


def process_wide(key, make):
    """The process's one table under ``key``: a Python worker keeps it from task to task, until an operator asks for another."""
    if key is None or _held[0] != key:
        _held[:] = [None, None]
        release_memory()
        _held[:] = [key, make()]
    return _held[1]


def encoder_of(file: str, max_chunks: int = 600_000) -> ChunkEncoder:
    return process_wide((file, max_chunks), lambda: ChunkEncoder(file, max_chunks))


def slices(batch, column: int, most: int, extra: int = 0):
    """Cut an Arrow batch into slices of at most ``most`` bytes of a text column (one row at least); ``extra`` bytes a row count too."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        n += extra
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if sizes:
        yield batch.slice(start)


def gathered(source: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of Arrow batches, dealt anew into batches of at most ``most`` bytes of a text column (one row at least)."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in source:
        start = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if total and total + n > most:
                yield pa.concat_batches([*held, batch.slice(start, i - start)])
                held, start, total = [], i, 0
            total += n
        held.append(batch.slice(start))
    if sum(b.num_rows for b in held):
        yield pa.concat_batches(held)


def release_memory() -> None:
    """Give memory that a task has freed back to the system.

    Python workers live on from task to task, and from operator to operator;
    without this each keeps the most that any of them needed.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not a GNU C library
