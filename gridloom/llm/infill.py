"""Fill-in-middle transformation: a text's lines are cut into prefix, middle and
suffix, and put in another order behind sentinels.

One table-driven DFA reads the bytes of a batch of texts, one after the other with
an end byte (0xFF, which UTF-8 never has) behind each. Its states know how many
continuation bytes are due, whether a unit (a line with its line feed) is open,
and how much of a sentinel was read; each transition says whether a code point
starts, a unit ends or a sentinel is complete. These marks are counted a text;
a second pass finds the cuts, which are the ends of the k-th units.

The state behind any three bytes of valid UTF-8 is the same wherever the scan
began, so the bytes are laid out in rows of ``LANE`` that begin three bytes early,
and all rows step through the table together.

Nothing is shuffled: rows stay in the scan's partitions, a task holds one Arrow
batch, cut to a few MB of text (or one text).

Defined results: null texts count as empty; empty texts and those that contain a
sentinel are ``plain``, whose output is the text and whose counts are null; texts
of any length are read whole; a null id is hashed as the empty string; repeated
rows are transformed each, and alike; an empty table gives no rows; columns of
other names aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import bound_batches, release_memory, slices

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
CODE_POINT, UNIT, SENTINEL = 1, 2, 4
END = 0xFF
LANE = 128
_REACH = 3
_OUTSIDE, _INSIDE, _DUE, _OPEN, _NAMED = 0, 1, 1, 5, 6  # states; _DUE + k: k continuation bytes are due
_BATCH = 4_000_000


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """The DFA as two tables over (state, byte): next state, and marks of the transition."""
    goto, marks = np.full((7, 256), _INSIDE, np.uint8), np.zeros((7, 256), np.uint8)
    starts = np.r_[0:0x80, 0xC0:END]
    marks[:, starts] |= CODE_POINT
    for lead, due in ((range(0xC0, 0xE0), 1), (range(0xE0, 0xF0), 2), (range(0xF0, 0xF8), 3)):
        goto[:, list(lead)] = _DUE + due
    for due in (2, 3):
        goto[_DUE + due, 0x80:0xC0] = _DUE + due - 1
    goto[:, ord("<")] = _OPEN
    goto[_OPEN, [ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = _NAMED
    marks[_NAMED, ord(">")] |= SENTINEL
    goto[:, [ord("\n"), END]] = _OUTSIDE
    marks[:, ord("\n")] |= UNIT
    marks[1:, END] |= UNIT  # a last line without a line feed
    return goto, marks


_GOTO, _MARKS = (t.ravel() for t in automaton())


def scan(data: np.ndarray) -> np.ndarray:
    """Marks of the transition at each byte of texts that each end with END."""
    rows = -(-len(data) // LANE)
    padded = np.full(_REACH + rows * LANE, END, np.uint8)
    padded[_REACH : _REACH + len(data)] = data
    lanes = np.lib.stride_tricks.sliding_window_view(padded, LANE + _REACH)[::LANE].T.copy()
    marks, state = np.empty((LANE, rows), np.uint8), np.zeros(rows, np.uint16)
    for k, column in enumerate(lanes):
        at = (state << 8) | column
        state = _GOTO[at].astype(np.uint16)
        if k >= _REACH:
            marks[k - _REACH] = _MARKS[at]
    return marks.T.reshape(-1)[: len(data)]


def transform(texts: list[bytes], draws: np.ndarray, rate: int, spm: int) -> list[list]:
    """Columns n, form, prefix_chars, middle_chars, output of texts with four drawn numbers each."""
    data = np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.append(0, ends[:-1])
    marks = scan(data)
    units = np.flatnonzero(marks & UNIT)  # bytes at which a unit ends
    first = np.searchsorted(units, starts)
    n = np.searchsorted(units, ends) - first
    tagged = np.zeros(len(texts), bool)
    tagged[np.searchsorted(ends, np.flatnonzero(marks & SENTINEL), side="right")] = True
    plain = (n == 0) | tagged | (draws[:, 2] % 100 >= rate)
    form = np.where(plain, "plain", np.where(draws[:, 3] % 100 < spm, "spm", "psm"))
    points = np.append(0, np.cumsum(marks & CODE_POINT, dtype=np.int64))
    drawn = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    # The k-th unit ends behind its line feed, or at the text's end.
    cuts = np.minimum(units[np.minimum(first[:, None] + drawn - 1, len(units) - 1)] + 1, ends[:, None] - 1) if len(units) else np.repeat(starts[:, None], 2, 1)
    cuts = np.where(drawn > 0, cuts, starts[:, None])
    chars = points[cuts] - points[starts][:, None]
    output = []
    for text, kind, (a, b) in zip(texts, form.tolist(), (cuts - starts[:, None]).tolist(), strict=True):
        if kind == "plain":
            output.append(text)
        elif kind == "psm":
            output.append(b"".join((PREFIX.encode(), text[:a], SUFFIX.encode(), text[b:], MIDDLE.encode(), text[a:b])))
        else:
            output.append(b"".join((SUFFIX.encode(), text[b:], PREFIX.encode(), text[:a], MIDDLE.encode(), text[a:b])))
    none = plain.tolist()
    told = [[None if p else v for p, v in zip(none, c, strict=True)] for c in (chars[:, 0].tolist(), (chars[:, 1] - chars[:, 0]).tolist())]
    return [n.tolist(), form.tolist(), *told, output]


def drawn(doc_id: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the seed and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output for every document.

    ``rate``: texts of 100 that are transformed; ``spm``: of 100 transformed ones, those whose suffix comes first.
    """
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for piece in slices(batch, 1, _BATCH):
                texts = [t or b"" for t in piece.column(1).cast(pa.large_binary()).to_pylist()]
                draws = np.stack([piece.column(k).to_numpy() for k in range(2, 6)], axis=1)
                columns = transform(texts, draws, rate, spm)
                *told, output = (pa.array(c, pa.binary() if k == pa.string() and i == 4 else k) for i, (c, k) in enumerate(zip(columns, kinds, strict=True)))
                yield pa.RecordBatch.from_arrays([piece.column(0), *told, output.cast(pa.string())], ["doc_id", *names])
        release_memory()

    bound_batches(docs.sparkSession)
    source = docs.select("doc_id", "text", *(h.alias(f"h{k}") for k, h in enumerate(drawn(F.col("doc_id"), seed), 1)))
    types = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType()]
    return source.mapInArrow(run, T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in zip(names, types, strict=True))]))


def restored(output: Column, form: Column) -> Column:
    """The text, from an output and its form. Its parts have no sentinel, and none can arise where a part meets one."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)))
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame, **options: int) -> DataFrame:
    """As :func:`fill_in_middle`, with output_sha256 and restored_sha256 in place of the output."""
    out = fill_in_middle(docs, **options)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def digests_sql(seed: int = 7) -> str:
    """The query in DuckDB's SQL."""
    return rf"""
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || CAST(doc_id AS VARCHAR)) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
k AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle, coalesce(array_to_string(u[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(prefix) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
