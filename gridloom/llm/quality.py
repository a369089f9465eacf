"""Quality classifier: random-indexing word vectors, pooled per document, and a
two-layer network with temperature-calibrated probabilities, all in numpy.

Every token has a sparse random index vector, a function of its spelling. A
token's word vector is the sum of the index vectors of its neighbours in the
training texts (random indexing), scaled to length one; tokens too rare there
have none. Tokens are words, runs of marks, the shape of a word (case, digits),
and a mark for a word that repeats the one before, so that words of no
vocabulary still say how they are written. A document is the mean of its tokens'
vectors, as if it had a few words of the average training document besides (both
labels alike), since few words prove little.

The network is fitted on a bounded sample of labelled rows: at most
``per_label`` documents a label (fixed parameter), the ones with the smallest
hash of their id, whole texts. Counts, context sums and document features of
the sample are computed on the executors; the driver receives the vectors of the
MOST_TOKENS most frequent tokens (the others have none) and a row of features a
sampled document, so what it holds doesn't depend on the length of texts.
Probabilities count labels as often as all rows that may be learned from do (the
sample has both alike).

Defined results: texts without a word (null and empty ones) have score 0.5;
ties don't arise, each row is scored alone and equal texts equally;
labels that are null are ignored, several labels of one id count by majority
(equal numbers: as 0); an id that occurs with several texts is learned from
once; with no labelled row, or one label only, every score is
the share of label 1 (0.5 if there is none); an empty table gives no rows;
other columns pass through.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import bound_batches, process_wide, release_memory, slices
from .common import materialize, temp
from .rows import add_columns

THRESHOLD = 0.7
PER_LABEL = 2000
DIM = 48
MOST_TOKENS = 20_000
TRAINING_TASKS = 24
_TOKEN = re.compile(r"[^\W_]+|[\W_]+")


def _hash(token: str) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass"))


def index_vector(token: str, dim: int = DIM, ones: int = 4) -> np.ndarray:
    """The token's sparse random vector: ``ones`` entries of +1 or -1."""
    out = np.zeros(dim, np.float32)
    state = _hash(token)
    for _ in range(ones):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        out[(state >> 33) % dim] += 1 if state >> 62 & 1 else -1
    return out


def parts(word: str) -> tuple[str, ...]:
    """A blank-separated word's tokens: its shape, each run of marks, and each run of letters or digits."""
    if word.isalpha():  # as below, in short
        return ("<upper>" if len(word) > 1 and word.isupper() else "<title>" if word[0].isupper() else "<lower>"), word.lower()
    found = _TOKEN.findall(word)
    core = max((x for x in found if x[0].isalnum()), key=len, default="")
    shape = "<upper>" if len(core) > 1 and core.isupper() else "<title>" if core[:1].isupper() else "<digit>" if core[:1].isdigit() else "<lower>" if core else "<marks>"
    return (shape, *(x.lower() if x[0].isalnum() else "<" + x for x in found))


AGAIN = "<again>"


def tokens_of(words: list[str], known: dict[str, tuple[str, ...]]) -> list[str]:
    """All tokens of a text's words; ``known`` keeps the tokens of words met before."""
    out: list[str] = []
    before = None
    for w in words:
        found = known.get(w)
        if found is None:
            found = known[w] = parts(w)
        out += found
        if w == before:
            out.append(AGAIN)
        before = w
    return out


@dataclass
class Model:
    tokens: list[str]
    vectors: np.ndarray  # tokens x dim
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float
    offset: float  # log odds of label 1 among all rows that may be learned from
    centre: np.ndarray  # mean features, both labels alike
    constant: float | None = None


class Pooler:
    """Mean token vector of whole texts.

    Words with the same known tokens share a row of ``sums``; the table of
    words keeps at most ``most``, then starts anew.
    """

    def __init__(self, tokens: list[str], vectors: np.ndarray, most: int = 250_000):
        self.ids, self.vectors, self.most, self.dim = {t: k for k, t in enumerate(tokens)}, vectors, most, vectors.shape[1]
        self.rows: dict[tuple[int, tuple[int, ...]], int] = {}
        self.places: dict[str, int] = {}
        self.sums = np.zeros((1 << 10, self.dim + 1), np.float32)
        self.again = vectors[self.ids[AGAIN]] if AGAIN in self.ids else np.zeros(self.dim, np.float32)

    def _place(self, word: str) -> int:
        found = parts(word)
        key = (len(found), tuple(self.ids[t] for t in found if t in self.ids))
        row = self.rows.get(key)
        if row is None:
            row = self.rows[key] = len(self.rows)
            if row == len(self.sums):
                self.sums = np.vstack([self.sums, np.zeros_like(self.sums)])
            for t in key[1]:
                self.sums[row, :-1] += self.vectors[t]
            self.sums[row, -1] = key[0]
        return row

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Features and number of words of each text."""
        sizes = np.zeros(len(texts))
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            words = (text or "").split()
            total = np.zeros(self.dim + 1, np.float64)
            for start in range(0, len(words), 20_000):
                some = words[start : start + 20_000]
                new = [w for w in set(some) if w not in self.places]
                if len(self.places) + len(new) > self.most:
                    self.places, self.rows = {}, {}
                    self.sums[:] = 0
                    new = list(set(some))
                self.places.update((w, self._place(w)) for w in new)
                at = np.fromiter(map(self.places.__getitem__, some), np.int64, len(some))
                total += self.sums[at].sum(0, dtype=np.float64)
                again = sum(map(str.__eq__, words[start + 1 : start + 1 + len(some)], some))
                total[:-1] += again * self.again
                total[-1] += again
            sizes[i] = len(words)
            if words:
                out[i] = total[:-1] / total[-1]
        return out, sizes


def smoothed(features: np.ndarray, sizes: np.ndarray, centre: np.ndarray, words: float = 8.0) -> np.ndarray:
    """Features as if each text had some ``words`` of the average document besides its own."""
    return (features * sizes[:, None] + centre * words) / (sizes[:, None] + words)


class Contexts:
    """Random indexing: for each token of a vocabulary, the sum of its neighbours' index vectors.

    Tokens outside the vocabulary keep their place in the text and add nothing.
    """

    def __init__(self, tokens: list[str], dim: int = DIM, window: int = 2):
        self.ids, self.dim, self.window = {t: k for k, t in enumerate(tokens)}, dim, window
        self.index = np.array([*(index_vector(t, dim) for t in tokens), np.zeros(dim)], np.int32)
        self.sums = np.zeros((len(tokens) + 1, dim), np.int64)
        self.known: dict[str, tuple[str, ...]] = {}

    def add(self, text: str | None) -> None:
        found = tokens_of((text or "").split(), self.known)
        if len(self.known) > 100_000:
            self.known.clear()
        none = len(self.ids)
        x = np.fromiter((self.ids.get(t, none) for t in found), np.int64, len(found))
        for start in range(0, len(x), 50_000):
            stop = min(len(x), start + 50_000)
            around = np.zeros((stop - start, self.dim), np.int32)
            for d in range(1, self.window + 1):
                before, after = x[max(0, start - d) : stop - d], x[start + d : stop + d]
                around[len(around) - len(before) :] += self.index[before]
                around[: len(after)] += self.index[after]
            order = np.argsort(x[start:stop], kind="stable")
            own = x[start:stop][order]
            first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            self.sums[own[first]] += np.add.reduceat(around[order], first, axis=0)


def unit_rows(sums: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(sums.astype(np.float64), axis=1, keepdims=True)
    return np.divide(sums, norm, out=np.zeros(sums.shape), where=norm > 0).astype(np.float32)


def fit(tokens: list[str], vectors: np.ndarray, x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, odds: float, hidden: int = 16, epochs: int = 80, seed: int = 7) -> Model:
    """Network and temperature from features of labelled texts that have both labels; ``odds``: of label 1 among all labelled rows."""
    y = labels.astype(np.float64)
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    if held.all() or not held.any() or len(set(y[~held])) < 2:
        held[:] = False
    means = [x[~held & (y == v) & (sizes > 0)] for v in (0, 1)]
    centre = np.mean([m.mean(0) if len(m) else np.zeros(x.shape[1]) for m in means], axis=0)
    x = smoothed(x, sizes, centre)
    mean, scale = centre, x[~held].std(0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    w = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(np.flatnonzero(~held))
        for start in range(0, len(order), 256):
            at = order[start : start + 256]
            h = np.tanh(x[at] @ w[0] + w[1])
            p = 1 / (1 + np.exp(-(h @ w[2] + w[3][0])))
            e = (p - y[at]) * weight[at] / len(at)
            back = np.outer(e, w[2]) * (1 - h * h)
            step += 1
            for k, g in enumerate((x[at].T @ back + 1e-4 * w[0], back.sum(0), h.T @ e + 1e-4 * w[2], np.array([e.sum()]))):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = w[k] - 0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(tokens, vectors, mean, scale, w[0], w[1], w[2], float(w[3][0]), 1.0, float(np.log(odds)), centre)
    where = held if held.any() else ~held
    z, truth = logits(model, x[where], scaled=True), y[where]
    # Rows of the sample count as often as their label does among all rows.
    often = np.where(truth == 1, odds / max(truth.mean(), 1e-9), 1 / max(1 - truth.mean(), 1e-9))
    grid = np.geomspace(0.5, 20, 80)
    losses = [((np.logaddexp(0, z / t + model.offset) - truth * (z / t + model.offset)) * often).sum() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))])
    return model


def logits(model: Model, x: np.ndarray, scaled: bool = False) -> np.ndarray:
    x = x if scaled else np.clip((x - model.mean) / model.scale, -8, 8)
    return np.tanh(x @ model.w1 + model.b1) @ model.w2 + model.b2


def scores(model: Model, pooler: Pooler | None, texts: list[str | None]) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(texts), model.constant)
    x = smoothed(*pooler.features(texts), model.centre)
    z = np.clip(logits(model, x) / model.temperature + model.offset, -500, 500)
    return np.where([bool((t or "").strip()) for t in texts], 1 / (1 + np.exp(-z)), 0.5)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[DataFrame, int, int]:
    """At most ``per_label`` labelled documents of each label (doc_id, quality, text), by smallest hash of the id; numbers of all labels 0 and 1.

    Ids are chosen without texts: 2 * per_label rows, a proven bound for the
    broadcast to the texts. An id with several texts gives one of them.
    """
    ids = docs.select("doc_id").filter("doc_id is not null").distinct()
    labels = labels.select("doc_id", "quality").filter("quality in (0, 1) and doc_id is not null").filter(~held_out())
    labels = labels.groupBy("doc_id").agg((F.avg("quality") > 0.5).cast("int").alias("quality")).join(ids, "doc_id", "left_semi")
    labels = materialize(labels, "labels")
    counts = {r["quality"]: r["n"] for r in labels.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = [labels.filter(F.col("quality") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for v in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    text = F.coalesce("text", F.lit(""))
    one = rows.groupBy("doc_id", "quality").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    return materialize(one.repartition(TRAINING_TASKS, "doc_id"), "training"), counts.get(0, 0), counts.get(1, 0)


def vocabulary(rows: DataFrame, least: int = 5, most: int = MOST_TOKENS, held: int = 200_000) -> list[str]:
    """The ``most`` most frequent tokens that occur ``least`` times."""

    def run(source):
        counts: Counter[str] = Counter()
        known: dict[str, tuple[str, ...]] = {}
        for batch in source:
            for text in batch.column(0):
                counts.update(tokens_of((text.as_py() or "").split(), known))
                if len(counts) > held:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])
                    counts, known = Counter(), {}
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["token", "n"])

    counts = rows.select("text").mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), "token").limit(most).toArrow()["token"].to_pylist()


def word_vectors(rows: DataFrame, tokens: list[str], dim: int = DIM, chunk: int = 1000) -> np.ndarray:
    """Random indexing on the executors: a task's sums leave in chunks of tokens, and the chunks of all tasks are added up."""
    shared = rows.sparkSession.sparkContext.broadcast(tokens)  # MOST_TOKENS at most

    def run(source):
        contexts = Contexts(shared.value, dim)
        for batch in source:
            for text in batch.column(0):
                contexts.add(text.as_py())
        parts = [contexts.sums[k : min(k + chunk, len(shared.value))] for k in range(0, len(shared.value), chunk)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["chunk", "sums"])
        del contexts, parts
        release_memory()

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = at = None
        for batch in source:
            for x in batch.column(1):
                own = np.frombuffer(x.as_py(), np.int64)
                total = own if total is None else total + own
            at = batch.column(0).slice(0, 1)
        yield pa.RecordBatch.from_arrays([at, pa.array([total.tobytes()], pa.binary())], ["chunk", "sums"])

    bound_batches(rows.sparkSession)
    sums = rows.select("text").mapInArrow(run, "chunk int, sums binary").groupBy("chunk").applyInArrow(add, "chunk int, sums binary")
    got = sums.toArrow().sort_by("chunk")["sums"].to_pylist()
    shared.unpersist()
    return unit_rows(np.frombuffer(b"".join(got), np.int64).reshape(len(tokens), dim))


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fit on the executors' sums and features; see the module's text for what reaches the driver."""
    rows, bad, good = training_rows(docs, labels, per_label)
    if not bad or not good:
        none = np.zeros(0)
        return Model([], np.zeros((0, DIM), np.float32), none, none, none, none, none, 0.0, 1.0, 0.0, none, good / (good + bad) if good + bad else 0.5)
    tokens = vocabulary(rows)
    vectors = word_vectors(rows, tokens)
    shared = docs.sparkSession.sparkContext.broadcast((tokens, vectors))  # MOST_TOKENS rows at most

    def run(source):
        process_wide(None, lambda: None)  # drop what another operator left
        pooler = Pooler(*shared.value)
        for batch in source:
            for piece in slices(batch, 2, 6_000_000):
                x, sizes = pooler.features(piece.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(sizes), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "quality", "size", "x"])
        del pooler
        release_memory()

    schema = T.StructType([rows.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("size", T.DoubleType()), T.StructField("x", T.BinaryType())])
    got = rows.mapInArrow(run, schema).toArrow().sort_by("doc_id")
    shared.unpersist()
    x = np.frombuffer(b"".join(got["x"].to_pylist())).reshape(len(got), DIM)
    return fit(tokens, vectors, x, got["size"].to_numpy(), got["quality"].to_numpy(), good / bad)


def add_scores(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None, words: int = 250_000) -> DataFrame:
    """``words``: words that a task's table holds."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MOST_TOKENS vectors at most

    def start():
        process_wide(None, lambda: None)  # drop what another operator left
        pooler = Pooler(shared.value.tokens, shared.value.vectors, words)
        return lambda texts: [scores(shared.value, pooler, texts)]

    return add_columns(docs, "text", start, [(name, T.DoubleType(), pa.float64())], keep)


def score_quality(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, per_label)
    out = add_scores(docs.select("doc_id", "text"), model, "score", ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier takes for good."""
    (name,) = temp(docs, "score")
    model = train(docs, labels, per_label)
    return add_scores(docs, model, name, words=120_000).filter(F.col(name) >= THRESHOLD).drop(name)
