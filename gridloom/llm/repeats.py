"""Suffix-array dedup: remove every byte covered by a string of ``length`` bytes
that also starts earlier (in a document with a smaller id, or earlier in the same one).

Suffixes are only compared to a depth of ``length``, and only those that may have
an equal are sorted at all:

1. *Owners.* A window of ``length`` bytes is owned by the q-gram in it (q = 50 of
   100) whose hash is least, the leftmost of equals. Equal windows have equal owners
   at equal offsets, and an owner's windows are neighbours, so texts fall into
   *records*: an owner with its windows, about one in 26 bytes.
2. *Owners that occur again.* Blocks of texts send their distinct owners (32 bits
   each) to the task of their hash range and learn which others have too. The
   records of all other owners are done with. A block answers for records that it
   holds several times, and sends each once.
3. *Bucket-pointer refinement.* Records go to the task of their owner's hash. There
   the suffixes of all records get initial buckets by their first eight bytes; buckets
   with several members are refined by sorting on the bucket identifiers at later
   offsets (8, 16, 32, ... bytes on), and each round sorts by the identifiers of the round
   before, to a depth of ``length``. Suffixes alone in their bucket keep their
   identifier and are not sorted again. Of a bucket's windows the earliest stays; the
   block is told of the others. Nothing rests on hashes here: bytes decide.
4. *Hot owners.* An owner with over ``HOT`` records (a line that a third of the
   documents have, each in surroundings of its own) isn't one task: its windows go out one by
   one, dealt by their own hash, each once a block.
5. *Cuts.* Blocks put the answers together: windows to byte ranges, ranges to spans.

Held in one task: a block, or a range's records (the average by the number of
ranges, HOT records at most from one owner, and one entry a block of a window that
is everywhere).

Defined results: null texts count as empty; texts shorter than ``length`` are left
alone; a null id is behind all others; rows that repeat an id are ordered by their
place in the input; texts of any length are read whole, a very long one as a block of its own;
the bytes kept may end inside a character, so they are binary; an empty table gives no rows;
columns of other names aren't read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, common
from .blocks import Block, batch_of, pack, unpack

LENGTH = 100
HOT = 4096
OWNERS_A_RANGE = 1_500_000
BYTES_A_RANGE = 2_000_000
_SEGMENT = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_MASKED = 64  # windows of a record at most: one bit each


def gram_size(length: int) -> int:
    """q: half a window, and so long that an owner has at most 64 windows."""
    if length < 16:
        raise ValueError(f"strings of {length} bytes: at least 16 are needed")
    return max(length // 2, length - _MASKED + 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash values of the 256 bytes, and powers of the base and of its inverse modulo 2**64."""
    base = 0x9E3779B97F4A7C15
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        powers = np.full(n, b, np.uint64)
        powers[0] = 1
        out.append(np.cumprod(powers, dtype=np.uint64))
    return _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1), *out


def records(data: bytes, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owners' hashes, first windows and numbers of windows of all records, by place, and hashes of the records' bytes. Windows don't cross ``ends``."""
    q = gram_size(length)
    k = length - q + 1
    values, powers, inverse = _powers(_SEGMENT + 2 * length)
    flat = np.frombuffer(data, np.uint8)
    found: list[tuple] = []
    for base in range(0, len(flat), _SEGMENT):
        part = flat[base : base + _SEGMENT + length - 1]
        if len(part) < length:
            break
        sums = np.append(np.uint64(0), np.cumsum(values[part] * powers[: len(part)], dtype=np.uint64))
        grams = _mixed((sums[q:] - sums[:-q]) * inverse[: len(part) - q + 1])
        least, width = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64), 1
        while 2 * width <= k:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < k:
            least = np.minimum(least[: len(least) - (k - width)], least[k - width :])
        owner = (least & _PLACE).astype(np.int64)
        # Windows that cross the end of a text are cut out.
        inside = np.ones(len(owner), bool)
        first = np.searchsorted(ends, base, side="right")
        last = np.searchsorted(ends, base + len(part), side="left")
        for end in (ends[first : last + 1] - base).tolist():
            inside[max(0, end - length + 1) : max(0, end)] = False
        cut = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(inside, prepend=False) != 0))
        size = np.diff(np.append(cut, len(owner)))
        cut, size = cut[inside[cut]], size[inside[cut]]
        whole = _mixed((sums[cut + size - 1 + length] - sums[cut]) * inverse[cut])
        # Owners are least hashes; mixed once more, they are even over all numbers.
        found.append((_mixed(grams[owner[cut]] * np.uint64(0xC2B2AE3D27D4EB4F)), cut + base, size, whole))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _distinct(owners: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct owners in order, how many records and how many different ones each has, and each record's owner among them."""
    order = np.lexsort((whole, owners))
    a, b = owners[order], whole[order]
    new = np.append(True, a[1:] != a[:-1])
    other = new | np.append(True, b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    at = np.empty(len(a), np.int64)
    at[order] = np.cumsum(new) - 1
    return a[starts], np.diff(np.append(starts, len(a))), np.add.reduceat(other.astype(np.int64), starts), at


_ASKED = "range int, block long, keys binary, counts binary"
_TOLD = "range int, block long, states binary"
_SENT = "range int, block long, places binary, meta binary, text binary"
_FOUND = "block long, starts binary, masks binary"


def _goals(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _ask(ranges: int, length: int):
    """A block's distinct owners, a message to each hash range that has some."""

    def run(block: Block) -> Iterator[pa.RecordBatch]:
        owners, _, _, whole = records(block.data, block.ends, length)
        if not len(owners):
            return
        owners, _, others, _ = _distinct(owners, whole)
        goals, others = _goals(owners, ranges), np.minimum(others, 0xFFFF).astype("<u2")
        cuts = np.searchsorted(goals, np.arange(ranges + 1))
        used = np.flatnonzero(np.diff(cuts))
        parts = [(pack(np.diff(owners[cuts[r] : cuts[r + 1]].astype("<u4"), prepend=np.uint32(0))), pack(others[cuts[r] : cuts[r + 1]])) for r in used]
        yield batch_of(_ASKED, used.tolist(), [block.key] * len(used), *(list(c) for c in zip(*parts, strict=True)))

    return run


def _tell(hot: int):
    """For one hash range: whether each owner asked for is in another block too (1), and is hot (2)."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = [np.cumsum(unpack(k.as_py(), "<u4"), dtype=np.uint32) for k in table["keys"]]
        counts = np.concatenate([unpack(c.as_py(), "<u2") for c in table["counts"]]).astype(np.int64)
        cuts = np.cumsum([len(k) for k in keys])[:-1]
        flat = np.concatenate(keys)
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
        sizes = np.diff(np.append(starts, len(flat)))
        told = (sizes > 1).astype(np.uint8) | (np.add.reduceat(counts[order], starts) > hot).astype(np.uint8) << 1
        states = np.empty(len(flat), np.uint8)
        states[order] = np.repeat(told, sizes)
        yield batch_of(_TOLD, table["range"].to_pylist(), table["block"].to_pylist(), [pack(s) for s in np.split(states, cuts)])

    return run


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges by start, overlapping and touching ones as one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return starts[at], ends[np.append(at[1:], len(starts)) - 1] if len(at) else ends[:0]


def _send(ranges: int, length: int):
    """A block's distinct records of owners that occur again, to hash ranges; and the windows that it knows to be repeated."""

    def run(block: Block, told: pa.Table) -> pa.Table:
        owners, starts, sizes, whole = records(block.data, block.ends, length)
        known: dict[bytes, None] = {}
        entries: list[tuple[int, int, int, bytes]] = []
        again: list[tuple[int, int]] = []
        if len(owners):
            distinct, times, _, at = _distinct(owners, whole)
            order = np.argsort(told["range"].to_numpy())
            states = [unpack(told["states"][int(k)].as_py(), "u1") for k in order]
            states = np.concatenate(states) if states else np.zeros(0, np.uint8)
            if len(states) != len(distinct):
                raise RuntimeError(f"{len(states)} answers for {len(distinct)} owners of a block")
            goals = _goals(distinct, ranges)
            few = np.flatnonzero((times[at] > 1) | (states[at] > 0))
            data = block.data
            for goal, is_hot, start, size in zip(goals[at[few]].tolist(), (states[at[few]] > 1).tolist(), starts[few].tolist(), sizes[few].tolist(), strict=True):
                if is_hot:
                    for s in range(start, start + size):
                        window = data[s : s + length]
                        if window in known:
                            again.append((s, 1))
                        else:
                            known[window] = None
                            entries.append((zlib.crc32(window) * ranges >> 32, s, 1, window))
                    continue
                record = data[start : start + size - 1 + length]
                if record in known:
                    again.append((start, size))
                else:
                    known[record] = None
                    entries.append((goal, start, size, record))
        out = []
        if again:
            s, n = np.array(again, np.int64).T
            a, b = _runs(s, s + n)
            out.append(batch_of(_SENT, [block.key % ranges], [block.key], [None], [pack(np.stack([a, b]).reshape(-1))], [None]))
        if entries:
            goal, s, n = (np.array(c, np.int64) for c in list(zip(*entries, strict=True))[:3])
            order = np.argsort(goal, kind="stable")
            cuts = np.searchsorted(goal[order], np.arange(ranges + 1))
            ids, offsets = block.order(), np.append(0, block.ends)
            doc = np.searchsorted(block.ends, s, side="right")
            rows = []
            for r in np.flatnonzero(np.diff(cuts)):
                take = order[cuts[r] : cuts[r + 1]]
                meta = pack(np.stack([ids[doc[take]], doc[take], s[take] - offsets[doc[take]], n[take]]).reshape(-1))
                rows.append((int(r), block.key, pack(s[take].astype("<i8")), meta, blocks.squeezed(b"".join([entries[k][3] for k in take]))))
            out.append(batch_of(_SENT, *(list(c) for c in zip(*rows, strict=True))))
        return pa.Table.from_batches(out or [batch_of(_SENT, [], [], [], [], [])])

    return run


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of equal keys get the place, in the order of keys, of the last of them: a bucket pointer. And whether a bucket has several members."""
    order = np.argsort(key)
    sorted_keys = key[order]
    last = np.append(sorted_keys[1:] != sorted_keys[:-1], True)
    ends = np.flatnonzero(last)
    sizes = np.diff(ends, prepend=-1)
    pointer, several = np.empty(len(key), np.int32), np.empty(len(key), bool)
    pointer[order], several[order] = np.repeat(ends, sizes), np.repeat(sizes > 1, sizes)
    return pointer, several


def refined(text: np.ndarray, wanted: np.ndarray, length: int) -> np.ndarray:
    """Bucket pointers, at depth ``length``, of the suffixes at ``wanted``: equal where their first ``length`` bytes are.

    Pointers of suffixes that no other equals to some depth are those of that depth.
    """
    if len(text) >= 1 << 31:
        raise OverflowError("a range's records are longer than 32-bit places")
    depths = [length]
    while depths[-1] > 8:
        depths.append(max(8, -(-depths[-1] // 2)))
    depths.reverse()  # 8, ..., length, each at most twice the one before
    padded = np.append(text, np.zeros(8, np.uint8))
    first = np.zeros(len(text), np.uint64)
    for k in range(8):
        first = first << np.uint64(8) | padded[k : k + len(text)]
    # Suffixes whose buckets some round reads: the wanted ones, and those that they are later compared by.
    needed, wants = [wanted], np.zeros(len(text), bool)
    for deep, depth in zip(depths[:0:-1], depths[-2::-1], strict=True):
        wants[:] = False
        wants[needed[-1]] = True
        wants[needed[-1] + deep - depth] = True
        needed.append(np.flatnonzero(wants).astype(np.int32))
    needed.reverse()
    pointer = np.zeros(len(text), np.int32)
    open_ = np.zeros(len(text), bool)
    at = needed[0]
    pointer[at], open_[at] = _ranked(first[at])
    del first, padded, wants
    for depth, deep, at in zip(depths, depths[1:], needed[1:], strict=False):
        at = at[open_[at]]
        # Members of a bucket lie at its end in the order, so a refined pointer never meets another bucket's.
        key = pointer[at].astype(np.int64) << 32 | pointer[at + deep - depth]
        order = np.argsort(key)
        key = key[order]
        bucket, later = key >> 32, key & 0xFFFFFFFF
        same_bucket = bucket[1:] == bucket[:-1]
        last = np.append(~(same_bucket & (later[1:] == later[:-1])), True)
        ends = np.flatnonzero(last)
        sizes = np.diff(ends, prepend=-1)
        bucket_ends = np.flatnonzero(np.append(~same_bucket, True))
        behind = bucket_ends[np.searchsorted(bucket_ends, ends)] - ends
        fresh, several = pointer.copy(), open_.copy()
        fresh[at[order]] = bucket - np.repeat(behind, sizes)
        several[at[order]] = np.repeat(sizes > 1, sizes)
        pointer, open_ = fresh, several
    return pointer[wanted]


def repeated(meta: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """Records (columns order of document, block, document in the block, start, windows): a mask of the windows that an earlier one equals."""
    order = np.lexsort(meta[::-1][1:])
    first: dict[bytes, int] = {}
    masks = np.zeros(len(texts), np.uint64)
    every = np.array([(1 << n) - 1 for n in range(_MASKED + 1)], np.uint64)
    kept = []
    for k in order.tolist():
        if first.setdefault(texts[k], k) == k:
            kept.append(k)
        else:
            masks[k] = every[meta[4, k]]
    sizes = np.array([len(texts[k]) for k in kept], np.int64)
    windows = meta[4, kept]
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(kept)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    classes = refined(np.frombuffer(b"".join([texts[k] for k in kept]), np.uint8), ((ends - sizes)[row] + offset).astype(np.int32), length)
    # Windows are in order of place, so the first of a class is the earliest.
    order = np.argsort(classes, kind="stable")
    again = order[1:][classes[order][1:] == classes[order][:-1]]
    np.bitwise_or.at(masks, np.array(kept, np.int64)[row[again]], np.uint64(1) << offset[again].astype(np.uint64))
    return masks


def _judge(length: int):
    """For one hash range: which windows of each block's records an earlier one equals."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        own = table.filter(pa.compute.is_null(table["places"]))
        if len(own):
            ranges = [unpack(m.as_py(), "<i8").reshape(2, -1) for m in own["meta"]]
            yield batch_of(_FOUND, own["block"].to_pylist(), [pack(r.reshape(-1)) for r in ranges], [None] * len(own))
        asked = table.filter(pa.compute.is_valid(table["places"]))
        if not len(asked):
            return
        keys = asked["block"].to_pylist()
        meta, texts = [], []
        for key, m, t in zip(keys, asked["meta"], asked["text"], strict=True):
            ids, doc, start, n = unpack(m.as_py(), "<i8").reshape(4, -1)
            meta.append(np.stack([ids, np.full(len(ids), key), doc, start, n]))
            text = blocks.restored(t.as_py())
            ends = np.cumsum(n - 1 + length).tolist()
            texts += [text[a:b] for a, b in zip([0, *ends], ends)]
        masks = np.split(repeated(np.concatenate(meta, axis=1), texts, length), np.cumsum([m.shape[1] for m in meta])[:-1])
        del meta, texts
        rows = []
        for key, places, mask in zip(keys, asked["places"], masks, strict=True):
            hit = np.flatnonzero(mask)
            if len(hit):
                rows.append((key, pack(unpack(places.as_py(), "<i8")[hit]), pack(mask[hit])))
        yield batch_of(_FOUND, *([list(c) for c in zip(*rows, strict=True)] or [[], [], []]))

    return run


def _cut(length: int, kind: pa.DataType):
    """A block's documents without what is repeated."""

    def run(block: Block, found: pa.Table) -> pa.Table:
        n = len(block.data)
        covered = np.zeros(n + 1, np.int32)
        for starts, masks in zip(found["starts"].to_pylist(), found["masks"].to_pylist(), strict=True):
            starts = unpack(starts, "<i8")
            if masks is None:
                a, b = starts.reshape(2, -1)
            else:
                row, bit = np.nonzero(np.unpackbits(unpack(masks, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                a = starts[row] + bit
                b = a + 1
            np.add.at(covered, a, 1)
            np.add.at(covered, b - 1 + length, -1)
        gone = np.cumsum(covered[:n], dtype=np.int32) > 0
        ends = block.ends
        starts = np.append(0, ends[:-1])
        # Spans end where texts do, even if the next text starts with one.
        edge = np.zeros(n + 1, bool)
        edge[starts] = edge[ends] = True
        turn = np.flatnonzero(edge | (np.append(gone, False) != np.append(False, gone)))
        a, b = turn[:-1], turn[1:]
        a, b = a[gone[a]], b[gone[a]]
        doc = np.searchsorted(ends, a, side="right")
        counts = np.bincount(doc, minlength=len(ends))
        spans = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(a - starts[doc]), pa.array(b - starts[doc])], ["start", "end"]))
        kept = np.frombuffer(block.data, np.uint8)[~gone].tobytes()
        cuts = np.append(0, np.cumsum(~gone))[np.append(0, ends)].tolist()
        return pa.table([block.doc_ids, pa.array(ends - starts), spans, pa.array([kept[x:y] for x, y in zip(cuts, cuts[1:])], pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, block: int = blocks.BLOCK) -> DataFrame:
    """doc_id, n_bytes, spans (what is removed: byte ranges from start, before end), kept (the bytes left) for every document."""
    gram_size(length)  # refuses lengths that are too short
    texts = blocks.write_blocks(docs, size=block)
    total = common.text_chars(docs)
    ranges = max(8, total // 25 // OWNERS_A_RANGE + 1)
    asked = blocks.each_block(texts, _ask(ranges, length), _ASKED)
    told = blocks.each_range(asked, ranges, _tell(hot), _TOLD)
    ranges = max(8, total // BYTES_A_RANGE + 1)
    sent = blocks.with_replies(texts, told, _send(ranges, length), _SENT)
    found = blocks.each_range(sent, ranges, _judge(length), _FOUND)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return blocks.with_replies(texts, found, _cut(length, kind), f"doc_id {kind}, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary")


def digests(docs: DataFrame, **options: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs, **options).select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def digests_sql(length: int = LENGTH) -> str:
    """The query in DuckDB's SQL, over the texts' bytes as hexadecimal digits."""
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, s, substr(h, CAST(2 * s + 1 AS BIGINT), {2 * length}) AS g FROM (SELECT doc_id, h, unnest(range(0, n - {length - 1})) AS s FROM d)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
isl AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM (SELECT doc_id, s, CASE WHEN s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {length} THEN 1 ELSE 0 END AS fresh FROM dup)),
runs AS (SELECT doc_id, min(s) AS a, max(s) + {length} AS b FROM isl GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, lag(b, 1, CAST(0 AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
kept AS (SELECT g.doc_id, string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(b) + 1 AS BIGINT)) AS h, sum(b - a) AS n_removed, count(*) AS n_spans FROM gaps g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
