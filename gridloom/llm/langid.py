"""Language ID: script ranges narrow the candidates, then Viterbi over per-word
scores with a switching penalty labels spans of mixed-language text.

A word's score for a language is the log probability of its byte bigrams and
trigrams (hashed into a fixed table) under smoothed counts of that language.
The script of a word's first letter leaves only languages that are written in
it. Viterbi finds the best sequence of languages for the whole text, where
each change costs ``penalty``. The document's language is the one with the
most letters in its spans; its score is the share of letters there, times the
softmax of the word scores summed over those spans.

Models are fitted on all documents that may be learned from, whole texts (with
``per_lang``, on at most so many a language, the ones with the smallest hash of their
id). Counts are made on the executors and added up there; the driver receives
the table of counts, whose size is fixed: with more than CELLS / TABLE languages
the hashes are folded into fewer places.

:func:`keep_known` rejects texts by a threshold that is learned too: the score
that all but REFUSED reach of those labelled documents which the model, that didn't learn from them, gives their own
language. Texts of several languages in shares that labelled documents
don't have, and texts in scripts of no learned language, stay below it.

Defined results: texts without a letter (Unicode category L; so null and empty ones) are
``und`` with score 0;
equal totals go to the language first in order; words in a script of no
learned language count for all alike; an id that occurs with several texts is
learned from once; with nothing to learn from every text is
``und``; more than MOST_LANGS languages to learn are an error; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import bound_batches, process_wide, slices
from .common import bitmap_of, join_small, materialize, temp, with_bit
from .rows import add_columns

UNKNOWN = "und"
PER_LANG = 1000
TABLE = 1 << 16
CELLS = 1 << 23  # most entries of a model's table: 32 MiB
MOST_LANGS = CELLS >> 8  # with more languages, a table of 256 places each would pass CELLS
REFUSED = 0.0005
SORTED = 10_000  # scores that are collected and sorted
SCORE_BUCKETS = 1024
CALIBRATED = 50  # a language with fewer documents to learn from sets none aside for the threshold
TRAINING_TASKS = 24
MOST_WORDS = 200_000  # distinct words that a counting task holds
_WORD = re.compile(r"[^\W\d_]+")  # letters, and numbers that aren't digits
_LETTERS = regex.compile(r"\p{L}+")
#: First code points of script ranges, and their scripts.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0E00, "Thai"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"),
    (0x3100, "Han"), (0xAC00, "Hangul"), (0xD7B0, "Other"), (0xF900, "Han"), (0xFB00, "Other"), (0x20000, "Han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_SCRIPT_OF = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def words_of(text: str | None) -> list[str]:
    """The text's runs of letters, lower-cased."""
    if not text:
        return []
    low = text.lower()
    found = _WORD.findall(low)
    return found if all(map(str.isalpha, found)) else _LETTERS.findall(low)


def scripts_of(words: list[str]) -> np.ndarray:
    first = np.array([ord(w[0]) for w in words], np.int64)
    return _SCRIPT_OF[np.searchsorted(_STARTS, first, "right") - 1]


def table_size(n_langs: int) -> int:
    """Places of the gram table: TABLE, or fewer (a power of two, 256 at least) where the table would have more than CELLS entries."""
    size = TABLE
    while size > 256 and size * n_langs > CELLS:
        size //= 2
    return size


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Table places of the byte bigrams and trigrams of each word with a blank before it and two after, and where each word's begin.

    They start at the blank before the word and at each of its bytes, so they don't depend on its neighbours.
    """
    joined = np.frombuffer((" " + "  ".join(words) + "  ").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    pairs = joined[:-1] * 0x9E3779B1 + joined[1:] * 0x85EBCA77
    triples = pairs[:-1] * np.uint32(31) + joined[2:] * np.uint32(0xC2B2AE3D)
    both = np.stack([pairs[: len(triples)] >> 16, (triples ^ (triples >> 15)) * np.uint32(0x27D4EB2F) >> 16], 1)
    blank = joined == 32
    inside = ~(blank[:-2] & blank[1:-1])  # all but the first blank after a word
    starts = np.flatnonzero(blank[:-2] & inside)
    return both[inside].ravel(), (np.cumsum(inside) - 1)[starts] * 2


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # places x languages, log probabilities
    scripts: np.ndarray  # scripts x languages, whether the language is written so


class Counts:
    """Gram and script counts by language."""

    def __init__(self, langs: list[str]):
        self.langs, self.size = {name: k for k, name in enumerate(langs)}, table_size(len(langs))
        self.grams, self.scripts = np.zeros((len(langs), self.size), np.int64), np.zeros((len(langs), len(_NAMES)), np.int64)

    def add(self, lang: str, text: str | None) -> None:
        self.add_words(lang, Counter(words_of(text)))

    def add_words(self, lang: str, words: Counter[str]) -> None:
        """Count distinct words as often as they are there (sums are exact up to 2**53)."""
        if words:
            k, names, times = self.langs[lang], list(words), np.fromiter(words.values(), np.int64, len(words))
            places, starts = grams(names)
            often = np.repeat(times, np.diff(starts, append=len(places)))
            self.grams[k] += np.bincount(places & (self.size - 1), often, self.size).astype(np.int64)
            self.scripts[k] += np.bincount(scripts_of(names), times, len(_NAMES)).astype(np.int64)

    def model(self, smooth: float = 0.5) -> Model:
        n = self.grams.T.astype(np.float64)
        table = np.log(n + smooth) - np.log(n.sum(0) + smooth * self.size) if self.langs else n
        share = self.scripts.T / np.maximum(self.scripts.sum(1), 1)
        return Model(list(self.langs), table.astype(np.float32), share >= 0.01)


def fit(texts: list[str | None], langs: list[str]) -> Model:
    counts = Counts(sorted(set(langs)))
    for text, lang in zip(texts, langs, strict=True):
        counts.add(lang, text)
    return counts.model()


class Scorer:
    """Scores of distinct words, kept for the first ``most``; more start the table anew."""

    def __init__(self, model: Model, most: int = 300_000):
        self.model, self.most = model, most
        self._clear()

    def _clear(self) -> None:
        self.places: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.model.langs)), np.float32)
        self.letters = np.zeros(1 << 12, np.int32)

    def _add(self, words: list[str]) -> None:
        n, m = len(self.places), len(self.places) + len(words)
        while m > len(self.scores):
            self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        places, starts = grams(words)
        out = np.add.reduceat(self.model.table[places & (len(self.model.table) - 1)], starts, axis=0)
        allowed = self.model.scripts[scripts_of(words)]
        none = ~allowed.any(1)
        out = np.where(allowed, out, out.min(1, keepdims=True) - 20)
        out[none] = 0
        self.scores[n:m] = out
        self.letters[n:m] = [len(w) for w in words]
        self.places.update(zip(words, range(n, m), strict=True))

    def ids(self, texts: list[list[str]]) -> list[np.ndarray]:
        distinct = set().union(*texts)
        new = [w for w in distinct if w not in self.places]
        if len(self.places) + len(new) > self.most and self.places:
            self._clear()
            new = list(distinct)
        if new:
            self._add(new)
        get = self.places.__getitem__
        return [np.fromiter(map(get, t), np.int32, len(t)) for t in texts]


def viterbi(words: list[np.ndarray], scores: np.ndarray, penalty: float) -> list[np.ndarray]:
    """The best language of every word: all texts step by step side by side, longest first."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), "left")  # texts with a word at step t
    starts = np.concatenate([[0], np.cumsum(active)])
    flat = np.zeros(starts[-1], np.int32)
    for k, i in enumerate(order):
        flat[starts[: lengths[i]] + k] = words[i]
    n_langs = scores.shape[1]
    kind = np.min_scalar_type(max(n_langs - 1, 0))
    came = np.zeros((starts[-1], n_langs), kind)
    value = np.zeros((len(words), n_langs), np.float32)
    own = np.arange(n_langs, dtype=kind)
    for t, n in enumerate(active):
        step = scores[flat[starts[t] : starts[t] + n]]
        if t:
            before = value[:n]
            best = before.argmax(1)
            switch = before[np.arange(n), best] - penalty
            stay = before >= switch[:, None]
            came[starts[t] : starts[t] + n] = np.where(stay, own, best[:, None])
            step = step + np.where(stay, before, switch[:, None])
        value[:n] = step
    labels = np.zeros(starts[-1], kind)
    at = value.argmax(1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        labels[starts[t] : starts[t] + n] = at[:n]
        at[:n] = came[starts[t] + np.arange(n), at[:n]]
    out: list[np.ndarray] = [np.zeros(0, kind)] * len(words)
    for k, i in enumerate(order):
        out[i] = labels[starts[: lengths[i]] + k]
    return out


def spans(model: Model, text: str | None, penalty: float = 12.0) -> list[tuple[int, int, str]]:
    """The text's (start, end, language) spans, by character."""
    found = list(_LETTERS.finditer(text or ""))
    if not found or not model.langs:
        return []
    scorer = Scorer(model)
    (ids,) = scorer.ids([[m[0].lower() for m in found]])
    (labels,) = viterbi([ids], scorer.scores, penalty)
    out: list[tuple[int, int, str]] = []
    for m, k in zip(found, labels, strict=True):
        name = model.langs[k]
        start = out.pop()[0] if out and out[-1][2] == name else m.start()
        out.append((start, m.end(), name))
    return out


def predict(scorer: Scorer, texts: list[str | None], penalty: float = 12.0, most: int = 1_500_000) -> tuple[list[str], list[float]]:
    names, found = scorer.model.langs, []
    labels, values = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not names:
        return labels, values
    start = 0
    words = [words_of(t) for t in texts]
    while start < len(texts):
        stop, total = start, 0
        while stop < len(texts) and (stop == start or total + len(words[stop]) <= most):
            total += len(words[stop])
            stop += 1
        found = [i for i in range(start, stop) if words[i]]
        if found:
            ids = scorer.ids([words[i] for i in found])
            for i, at, path in zip(found, ids, viterbi(ids, scorer.scores, penalty), strict=True):
                letters = np.bincount(path, scorer.letters[at], len(names))
                k = int(letters.argmax())
                there = scorer.scores[at[path == k]].sum(0, dtype=np.float64)
                odds = np.exp(np.clip(there - there[k], -700, 50))
                labels[i], values[i] = names[k], float(letters[k] / letters.sum() * odds[k] / odds.sum())
        start = stop
    return labels, values


def held_out(doc_id: str = "doc_id"):
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """At most ``per_lang`` documents of each language (doc_id, lang, at, text), by smallest hash of the id, numbered ``at`` from 1.

    Hashes are uniform, so a share of four times what is wanted holds the
    smallest ones; only ids of that share reach the window, however many rows a language has. Texts
    are found by a bitmap of the chosen ids before they move.
    """
    ids = docs.select("doc_id", "lang").filter("lang is not null and doc_id is not null").filter(~held_out())
    rows = materialize(ids.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    place = F.xxhash64("doc_id")
    share = F.pmod(place, F.lit(1 << 30)) * F.col("n") < F.lit(4.0 * per_lang * (1 << 30))
    few = join_small(ids, rows, "lang").filter(share).select("doc_id", "lang").distinct()
    at = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod(place, F.lit(1 << 30)), "doc_id"))
    chosen = materialize(few.withColumn("at", at).filter(F.col("at") <= per_lang), "chosen")
    key = F.struct("doc_id", "lang")
    found = with_bit(docs.select("doc_id", "lang", "text"), key, bitmap_of(chosen, key), "maybe").filter("maybe").drop("maybe")
    text = F.coalesce("text", F.lit(""))
    one = found.join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang", "at").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    return materialize(one.repartition(TRAINING_TASKS, "doc_id"), "training")


def learnable() -> Column:
    """Rows that may be learned from."""
    return F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()


def all_training_rows(docs: DataFrame) -> DataFrame:
    """All documents that may be learned from (lang, text); of rows that repeat an id in a language, one.

    Texts stay where they are, but for rows whose id is repeated (found by a bitmap of such ids).
    """
    rows, key = docs.filter(learnable()).select("doc_id", "lang", "text"), F.struct("doc_id", "lang")
    repeated = materialize(rows.groupBy("doc_id", "lang").count().filter("count > 1").select("doc_id", "lang"), "repeated")
    if repeated.isEmpty():
        return rows.select("lang", "text")
    told, text = with_bit(rows, key, bitmap_of(repeated, key), "maybe"), F.coalesce("text", F.lit(""))
    one = told.filter("maybe").groupBy("doc_id", "lang").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    return told.filter("not maybe").select("lang", "text").unionAll(one.select("lang", "text"))


def train(docs: DataFrame, per_lang: int | None = None) -> Model:
    """A model of all documents that may be learned from, or of at most ``per_lang`` a language."""
    return train_on(all_training_rows(docs) if per_lang is None else training_rows(docs, per_lang))


def train_on(rows: DataFrame) -> Model:
    """Fit on the executors' counts; see the module's text for what reaches the driver."""
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"there are more than {MOST_LANGS} values of lang to learn: is it a language?")

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_wide(None, lambda: None)  # drop what another operator left
        counts, words = Counts(langs), {}

        def flush() -> None:
            for lang, held in words.items():
                counts.add_words(lang, held)
            words.clear()

        for batch in source:
            for piece in slices(batch, 1, 1_000_000):
                for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    words.setdefault(lang, Counter()).update(words_of(text))
                if sum(map(len, words.values())) > MOST_WORDS:
                    flush()
        flush()
        used = np.flatnonzero(counts.scripts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array([x[k].tobytes() for k in used], pa.binary()) for x in (counts.grams, counts.scripts))], ["lang", "grams", "scripts"])

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, at = [0, 0], None
        for batch in source:
            at = batch.column(0).slice(0, 1)
            for k in (0, 1):
                for x in batch.column(k + 1):
                    totals[k] = totals[k] + np.frombuffer(x.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([at, *(pa.array([x.tobytes()], pa.binary()) for x in totals)], ["lang", "grams", "scripts"])

    bound_batches(rows.sparkSession)
    schema = "lang int, grams binary, scripts binary"
    counts = Counts(langs)
    for r in rows.select("lang", "text").mapInArrow(count, schema).groupBy("lang").applyInArrow(add, schema).toArrow().to_pylist():
        counts.grams[r["lang"]], counts.scripts[r["lang"]] = np.frombuffer(r["grams"], np.int64), np.frombuffer(r["scripts"], np.int64)
    return counts.model()


def threshold(scores: DataFrame, score: str, refused: float = REFUSED) -> float:
    """The exact quantile ``refused`` of all scores (a written table).

    Counts by bucket of scores tell which bucket holds it; that one is cut into
    buckets again, until SORTED scores or fewer, or one value, are left. No task sorts more.
    """
    n, least, most = scores.agg(F.count(score), F.min(score), F.max(score)).first()
    if not n:
        return 0.0
    place = refused * (n - 1)

    def ranked(at: int) -> float:
        low, high, before, inside = least, most, 0, n
        while low < high:
            held = scores.filter(F.col(score).between(low, high)).select(score)
            if inside <= SORTED:
                return sorted(r[0] for r in held.collect())[at - before]
            bucket = F.least(F.floor((F.col(score) - low) / (high - low) * SCORE_BUCKETS), F.lit(SCORE_BUCKETS - 1))
            for r in sorted(held.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min(score).alias("low"), F.max(score).alias("high")).collect()):
                if at < before + r["n"]:
                    low, high, inside = r["low"], r["high"], r["n"]
                    break
                before += r["n"]
        return low

    first = math.floor(place)
    value = ranked(first)
    return value if place == first else value + (ranked(first + 1) - value) * (place - first)


def add_languages(docs: DataFrame, model: Model, names: tuple[str, str], keep: list[str] | None = None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # CELLS entries at most

    def start():
        process_wide(None, lambda: None)  # drop what another operator left
        scorer = Scorer(shared.value)
        return lambda texts: list(predict(scorer, texts))

    return add_columns(docs, "text", start, [(names[0], T.StringType(), pa.string()), (names[1], T.DoubleType(), pa.float64())], keep)


def identify(docs: DataFrame, per_lang: int | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    out = add_languages(docs.select("doc_id", "text"), train(docs, per_lang), ("lang_pred", "score"), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def set_aside(docs: DataFrame) -> Column:
    """Rows that the threshold is learned from: of the learnable ones of languages with CALIBRATED or more, a fifth by hash of the id. The model doesn't see them."""
    counts = docs.filter(learnable()).groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") < CALIBRATED)
    rare = [r["lang"] for r in counts.limit(MOST_LANGS + 1).collect()]
    return learnable() & (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(5)) == 0) & ~F.col("lang").isin(rare)


def keep_known(docs: DataFrame, refused: float = REFUSED) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with at least the learned score.

    Model and threshold come from all rows that may be learned from: the threshold from those that :func:`set_aside` names, the model from
    all others. Each text is scored once, and written with its score.
    """
    lang, score = temp(docs, "lang", "score")
    aside = set_aside(docs)
    scored = materialize(add_languages(docs, train(docs.filter(~aside)), (lang, score)), "scored")
    least = threshold(scored.filter(aside & (F.col(lang) == F.col("lang"))), score, refused)
    return scored.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= least)).drop(lang, score)
