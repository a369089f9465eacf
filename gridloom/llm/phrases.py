"""Phrase collocation mining, per language.

Texts are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and pieces into
words at blanks and tabs. Phrases of two and three words that occur at least ``LEAST``
times are scored by how often they would be met if their parts met by chance.

1. *Dictionary.* Blocks of texts send their distinct words with counts to the task of
   the word's hash range, which adds up, gives words that occur often enough a
   32-bit id (of one language each) and sends the ids back. A phrase can't be frequent with a
   word that isn't, so other words break pieces.
2. *Keys.* A phrase is a key of three ids, the last 0 with two words. Blocks radix-sort
   their keys by digits of 16 bits, count runs, and send the distinct ones on in order, cut
   at range bounds. The bounds are quantiles of a bounded sample: the keys of
   ``SAMPLED`` blocks, chosen by hash; they decide the sizes of tasks only.
3. *Counts.* A task radix-sorts the keys of its range and adds up runs. Every key is
   in one range; a phrase that is everywhere has one entry a block.
4. *Scores* of the frequent phrases, by joins with the dictionary and with the
   frequent pairs; words and pairs that many phrases have are joined apart. Products
   are decimals of 38 digits, divided as integers.

Held in one task: a block, or a range's words or keys (the average by the number of
ranges, plus one entry a block of what is everywhere).

Defined results: null texts count as empty; a null language is ``und``; ids aren't read,
so rows that repeat one are counted each; texts of any length are read whole; ties
are ordered by count and then by the phrase's bytes; an empty table gives no rows;
columns of other names aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks, common
from .blocks import Block, batch_of, pack, unpack

LEAST = 10
BEST = 2000
INSIDE = 50  # of 100: a longer phrase with this share of a phrase's occurrences takes its place
SAMPLED = 32
SAMPLE = 2048  # keys of a sampled block
WORDS_A_RANGE = 24_000_000  # characters of text a hash range of the dictionary
KEYS_A_RANGE = 6_000_000  # characters of text a range of keys
_SALTS = 64
_BREAK = b"\n"
#: What cuts texts into pieces, and, beside the blank, pieces into words.
_ENDS, _TAB = b".,;:!?\n\x0b\x0c\r", 9


def _folding() -> bytes:
    table = bytearray(range(256))
    table[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    table[_TAB] = ord(" ")
    for c in _ENDS:
        table[c] = ord("\n")
    return bytes(table)


_FOLDED = _folding()


def words_of(text: bytes) -> list[bytes]:
    """Words, with a line feed where pieces end."""
    return [w for w in text.translate(_FOLDED).replace(b"\n", b" \n ").split(b" ") if w]


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def spoken(block: Block) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """For each language of a block: its name, its distinct words (the first is the break), and the words' places, with a break behind each text."""
    langs = ["und" if x is None else x for x in block.more[0].to_pylist()]
    ends = block.ends.tolist()
    parts: dict[str, list[int]] = {}
    for k, lang in enumerate(langs):
        parts.setdefault(lang, []).append(k)
    for lang, docs in parts.items():
        known = _Places()
        known[_BREAK] = 0
        places = []
        for k in docs:
            found = words_of(block.data[ends[k - 1] if k else 0 : ends[k]])
            found.append(_BREAK)
            places.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
        yield lang, list(known), np.concatenate(places)


_KINDS = {"range": pa.int32(), "block": pa.int64(), "lang": pa.string(), "word": pa.string(), "places": pa.binary(), "ids": pa.binary(), "counts": pa.binary(), "words": pa.binary(), "id": pa.int64(), "n": pa.int64()}
_TYPES = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
_ASKED = ("range", "block", "lang", "places", "counts", "words")
_TOLD = ("block", "lang", "places", "ids", "word", "id", "n")
_KEYS = "range int, block long, high binary, low binary, counts binary"


def _schema(names: tuple[str, ...]) -> str:
    return ", ".join(f"{n} {_TYPES[_KINDS[n]]}" for n in names)


def _rows(names: tuple[str, ...], **columns: list) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(n, [None] * size), _KINDS[n]) for n in names], list(names))


def _ask(ranges: int):
    """A block's distinct words and their counts, a message for each language and hash range."""

    def run(block: Block) -> Iterator[pa.RecordBatch]:
        for lang, words, places in spoken(block):
            if len(words) < 2:
                continue
            counts = np.bincount(places, minlength=len(words))
            salt = zlib.crc32(lang.encode())
            goals = np.fromiter((zlib.crc32(w, salt) * ranges >> 32 for w in words), np.int64, len(words))
            goals[0] = ranges  # the break isn't a word
            order = np.argsort(goals, kind="stable")
            cuts = np.searchsorted(goals[order], np.arange(ranges + 1))
            out: dict[str, list] = {n: [] for n in _ASKED}
            for r in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[r] : cuts[r + 1]]
                told = int(r), block.key, lang, pack(np.diff(at, prepend=0).astype("<u4")), pack(counts[at].astype("<i8")), blocks.squeezed(b" ".join([words[k] for k in at]))
                for n, v in zip(_ASKED, told, strict=True):
                    out[n].append(v)
            yield _rows(_ASKED, **out)

    return run


def _tell(ranges: int, least: int):
    """For one hash range: ids of words that occur often enough (0: not), to each block; the dictionary; and all occurrences by language."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        number = table["range"][0].as_py()
        known: dict[str, _Places] = {}
        met: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = []
        for lang, words, counts in zip(table["lang"].to_pylist(), table["words"], table["counts"], strict=True):
            here = known.setdefault(lang, _Places())
            found = blocks.restored(words.as_py()).split(b" ")
            at = np.fromiter(map(here.__getitem__, found), np.int64, len(found))
            met.setdefault(lang, []).append((at, unpack(counts.as_py(), "<i8")))
            rows.append(at)
        ids, taken = {}, 0
        for lang, here in known.items():
            total = np.zeros(len(here), np.int64)
            for at, counts in met[lang]:
                total[at] += counts
            often = np.flatnonzero(total >= least)
            given = np.zeros(len(here), np.int64)
            given[often] = (taken + np.arange(len(often))) * ranges + number + 1
            taken += len(often)
            if taken * ranges >= 1 << 32:
                raise OverflowError("more frequent words than 32-bit ids")
            ids[lang] = given.astype("<u4")
            words = list(here)
            for k in range(0, len(often), 10_000):
                some = often[k : k + 10_000]
                yield _rows(_TOLD, lang=[lang] * len(some), word=[words[i].decode() for i in some], id=given[some].tolist(), n=total[some].tolist())
            yield _rows(_TOLD, lang=[lang], n=[int(total.sum())])
        langs = table["lang"].to_pylist()
        yield _rows(_TOLD, block=table["block"].to_pylist(), lang=langs, places=table["places"].to_pylist(), ids=[pack(ids[x][at]) for x, at in zip(langs, rows, strict=True)])

    return run


def radix_order(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The order of keys of 96 bits: stable sorts by digits of 16 bits, the last digit first. Digits that all keys share are left out."""
    order = np.arange(len(high))
    digits = [low, low >> np.uint32(16), *(high >> np.uint64(s) for s in (0, 16, 32, 48))]
    for digit in digits:
        digit = digit.astype(np.uint16)
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    order = radix_order(high, low)
    high, low = high[order], low[order]
    starts = np.flatnonzero(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))) if len(high) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(high))) if counts is None else np.add.reduceat(counts[order], starts) if len(starts) else counts
    return high[starts], low[starts], counts


def _keys_of(block: Block, told: pa.Table, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct keys in order, with counts."""
    answers: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for lang, places, ids in zip(told["lang"].to_pylist(), told["places"], told["ids"], strict=True):
        answers.setdefault(lang, []).append((np.cumsum(unpack(places.as_py(), "<u4"), dtype=np.int64), unpack(ids.as_py(), "<u4")))
    high, low = [], []
    for lang, words, places in spoken(block):
        table, number = np.zeros(len(words), np.uint32), 1
        for at, ids in answers.get(lang, []):
            table[at] = ids
            number += len(at)
        if number != len(words):
            raise RuntimeError(f"{number} of {len(words)} words of a block have answers")
        a = table[places].astype(np.uint64)
        pair = a[:-1] << np.uint64(32) | a[1:]
        both = (a[:-1] > 0) & (a[1:] > 0)
        high.append(pair[both])
        low.append(np.zeros(len(high[-1]), np.uint32))
        if longest > 2:
            three = both[:-1] & both[1:]
            high.append(pair[:-1][three])
            low.append(a[2:][three].astype(np.uint32))
    none = np.zeros(0, np.uint64)
    return run_lengths(np.concatenate([none, *high]), np.concatenate([none.astype(np.uint32), *low]))


def _sample(longest: int):
    def run(block: Block, told: pa.Table) -> pa.Table:
        high, low, _ = _keys_of(block, told, longest)
        at = np.linspace(0, len(high) - 1, min(SAMPLE, len(high))).astype(np.int64)
        return pa.Table.from_batches([batch_of("high long, low long", high[at].view(np.int64), low[at].astype(np.int64))])

    return run


def bounds(sample: pa.Table, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """First keys of the second, third, ... range."""
    high, low = sample["high"].to_numpy().view(np.uint64), sample["low"].to_numpy().astype(np.uint32)
    order = radix_order(high, low)
    at = order[np.linspace(0, len(high), ranges + 1).astype(np.int64)[1:-1]] if len(high) else order
    high, low, _ = run_lengths(high[at], low[at])
    return high, low


def cuts_at(high: np.ndarray, low: np.ndarray, edges: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places in ordered keys at which ranges start."""
    out = []
    for h, l in zip(*edges, strict=True):  # noqa: E741
        a, b = np.searchsorted(high, h, "left"), np.searchsorted(high, h, "right")
        out.append(a + np.searchsorted(low[a:b], l, "left"))
    return np.array([0, *out, len(high)], np.int64)


def _send(edges: tuple[np.ndarray, np.ndarray], longest: int):
    """A block's keys and counts, a message for each range that has some."""

    def run(block: Block, told: pa.Table) -> pa.Table:
        high, low, counts = _keys_of(block, told, longest)
        cuts = cuts_at(high, low, edges)
        rows = []
        for r in np.flatnonzero(np.diff(cuts)):
            part = slice(cuts[r], cuts[r + 1])
            rows.append((int(r), block.key, pack(np.diff(high[part], prepend=np.uint64(0))), pack(low[part]), pack(counts[part].astype("<u4"))))
        return pa.Table.from_batches([batch_of(_KEYS, *([list(c) for c in zip(*rows, strict=True)] or [[]] * 5))])

    return run


def _count(least: int):
    """For one range: the keys that occur often enough."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        high = np.concatenate([np.cumsum(unpack(k.as_py(), "<u8"), dtype=np.uint64) for k in table["high"]])
        low, counts = (np.concatenate([unpack(k.as_py(), "<u4") for k in table[c]]) for c in ("low", "counts"))
        high, low, counts = run_lengths(high, low, counts.astype(np.int64))
        often = counts >= least
        high, low, counts = high[often], low[often], counts[often]
        for k in range(0, len(high), 10_000):
            some = slice(k, k + 10_000)
            yield batch_of("w1 long, w2 long, w3 long, a long", *((c[some].astype(np.int64)) for c in (high >> np.uint64(32), high & np.uint64(0xFFFFFFFF), low, counts)))

    return run


def frequent(docs: DataFrame, least: int = LEAST, longest: int = 3, block: int = blocks.BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases (w1, w2, w3: word ids, w3 0 with two words; a: occurrences), the dictionary (id, lang, word, f), and (lang, n): all words."""
    if longest not in (2, 3):
        raise ValueError("phrases have two or three words at most: keys hold three ids")
    texts = blocks.write_blocks(docs, "lang", size=block)
    chars = common.text_chars(docs)
    ranges = max(8, chars // WORDS_A_RANGE + 1)
    asked = blocks.each_block(texts, _ask(ranges), _schema(_ASKED))
    told = common.materialize(blocks.each_range(asked, ranges, _tell(ranges, least), _schema(_TOLD)), "words")
    replies = told.filter("block is not null").select("block", "lang", "places", "ids")
    dictionary = told.filter("id is not null").select("id", "lang", "word", F.col("n").alias("f"))
    sizes = told.filter("block is null and id is null").groupBy("lang").agg(F.sum("n").alias("n"))
    ranges = max(8, chars // KEYS_A_RANGE + 1)
    chosen = [r[0] for r in texts.select("block").orderBy(F.xxhash64("block"), "block").limit(SAMPLED).collect()]
    sample = blocks.with_replies(texts.filter(F.col("block").isin(chosen)), replies.filter(F.col("block").isin(chosen)), _sample(longest), "high long, low long")
    edges = bounds(sample.toArrow(), ranges)
    sent = blocks.with_replies(texts, replies, _send(edges, longest), _KEYS)
    phrases = blocks.each_range(sent, ranges, _count(least), "w1 long, w2 long, w3 long, a long")
    return common.materialize(phrases, "phrases"), dictionary, sizes


def _with(phrases: DataFrame, table: DataFrame, keys: dict[str, str], added: dict[str, str]) -> DataFrame:
    """Columns of a table added to phrases, by columns that name its rows; rows that many phrases name are joined apart."""
    table = table.select(*(F.col(k).alias(c) for c, k in keys.items()), *(F.col(k).alias(c) for c, k in added.items()))
    named = phrases.groupBy(*keys).agg(F.count("*").alias("named"))
    # Written, since both branches of the join read what comes before.
    return common.materialize(common.join_hot(phrases, common.materialize(table.join(named, list(keys)), "named"), list(keys), "named").drop("named"), "with")


def _score(a: str, left: str, right: str) -> Column:
    """floor(10**6 * a * a / (left * right)), exact: a up to 10**15."""
    wide = "cast({} as decimal(15,0))".format
    return F.expr(f"cast({wide(a)} * {wide(a)} as decimal(31,0)) * cast(1000000 as decimal(7,0)) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST, inside: int = INSIDE, block: int = blocks.BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of each language, by score, count and phrase."""
    phrases, dictionary, sizes = frequent(docs, least, block=block)
    pairs = phrases.filter("w3 = 0").select("w1", "w2", "a")
    triples = phrases.filter("w3 > 0")
    # Pairs inside a triple that has enough of their occurrences go.
    held = triples.select("w1", "w2", "a").unionAll(triples.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    held = held.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    free = pairs.join(held, ["w1", "w2"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    two = _with(free.drop("longer"), dictionary, {"w1": "id"}, {"lang": "lang", "s1": "word", "l": "f"})
    two = _with(two, dictionary, {"w2": "id"}, {"s2": "word", "r": "f"})
    two = two.select("lang", F.concat_ws(" ", "s1", "s2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    three = _with(triples, pairs, {"w1": "w1", "w2": "w2"}, {"front": "a"})
    three = _with(three, pairs, {"w2": "w1", "w3": "w2"}, {"back": "a"})
    three = _with(three, dictionary, {"w1": "id"}, {"lang": "lang", "s1": "word", "f1": "f"})
    three = _with(three, dictionary, {"w2": "id"}, {"s2": "word"})
    three = _with(three, dictionary, {"w3": "id"}, {"s3": "word", "f3": "f"})
    cuts = [F.struct(_score("a", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r")) for k, left, right in ((1, "f1", "back"), (2, "front", "f3"))]
    three = three.withColumn("cut", F.least(*cuts)).select("lang", F.concat_ws(" ", "s1", "s2", "s3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    return ranked(two.unionAll(three), best).join(F.broadcast(sizes) if sizes.count() <= common.SMALL else sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def ranked(scored: DataFrame, best: int) -> DataFrame:
    """The best of each language: first those of parts of it, then of these, so that a task orders a part, or ``best`` rows a part."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS))).orderBy(*order)
    some = scored.withColumn("at", F.row_number().over(part)).filter(F.col("at") <= best).drop("at")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= best)


def collocations_sql(least: int = LEAST, best: int = BEST, inside: int = INSIDE) -> str:
    """The query in DuckDB's SQL."""
    return rf"""
WITH p AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM p
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM p
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM p) GROUP BY ALL HAVING count(*) >= {least}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE k = 3) GROUP BY ALL),
cuts AS (SELECT c.lang, c.phrase, c.a, j, array_to_string(w[1:j], ' ') AS front, array_to_string(w[j + 1:], ' ') AS back FROM c, unnest(range(1, 3)) AS t(j) WHERE j < k),
s AS (SELECT t.lang, t.phrase, t.a, j, x.a AS l, y.a AS r, CAST((CAST(1000000 AS HUGEINT) * t.a * t.a) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts t JOIN f x ON x.lang = t.lang AND x.phrase = t.front JOIN f y ON y.lang = t.lang AND y.phrase = t.back),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS low FROM s) WHERE low = 1),
k AS (SELECT b.* FROM b LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase WHERE i.longer IS NULL OR 100 * i.longer < {inside} * b.a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= {best}"""
