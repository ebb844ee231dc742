"""Quality classifier: random-indexing word vectors, pooled, and a two-layer network in numpy.

Tokens of a text, in order: its words (lower-cased), the runs of signs between them, and a mark after
each word in capitals.  Each token has a fixed sparse index vector of +1 and -1 by its hash; a
token's context vector is the sum of the index vectors of the tokens up to two places away over
the sample.  Tokens share BUCKETS vectors by hash, so the model is of one size whatever the
vocabulary.  A document is the mean of its words' vectors and the mean of its signs' and marks',
with their shares.  A network with one hidden layer gives the log-odds, divided by a temperature
that fits a part of the sample it did not learn from.  Vectors and network learn from one sample of at
most 2 * SAMPLE_EACH labelled documents, never held-out ones; every document is scored.

The model and every score depend on the rows alone, not on their order, partitions or batches; equal texts have
equal scores.  A null text is empty and scored as such; of very long texts all words count.  Repeated rows are scored
each.  Without labels all scores are one half.  An empty table gives no rows.  Columns named as the outputs are replaced; others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import _labels
from ._trees import sigmoid
from ._words import ALNUM, Alphabet, buffer, split
from .toxicity import _sums, scored

SAMPLE_EACH = 4000
THRESHOLD = 0.7
BUCKETS = 1 << 15
DIMENSIONS = 48
SPAN = 2
#: Tasks that sum context vectors of the sample: each sends BUCKETS * DIMENSIONS numbers (6 MB) to the driver.
TASKS = 8
HIDDEN = 24
#: Steps of a fit, however small the sample.
LEAST_STEPS = 600
_CAPITALS = 0


def _signs() -> Alphabet:
    word = ~ALNUM.word
    word[:33] = False
    return Alphabet(word, lower=False)


SIGNS = _signs()


def index_vectors(seed: int = 5) -> np.ndarray:
    """Sparse vectors: an eighth of the places are +1 or -1."""
    rng = np.random.default_rng(seed)
    return (rng.choice([-1, 1], (BUCKETS, DIMENSIONS)) * (rng.random((BUCKETS, DIMENSIONS)) < 0.125)).astype(np.float32)


@dataclass
class Tokens:
    bucket: np.ndarray
    sign: np.ndarray
    first: np.ndarray


def tokens(column) -> Tokens:
    """Words, signs and capital marks of each text in order."""
    words, _ = split(column, ALNUM)
    signs, _ = split(column, SIGNS)
    data, offsets = buffer(column)
    caps = np.zeros(0, np.int64)
    if len(words.start):
        upper = (data >= 65) & (data <= 90)
        second = np.minimum(words.start + 1, len(data) - 1)
        caps = words.start[upper[words.start] & upper[second] & (words.end - words.start > 1)]
    start = np.concatenate([words.start, signs.start, caps])
    bucket = np.concatenate([1 + (words.value % (BUCKETS - 1)).astype(np.int64), 1 + (signs.value % (BUCKETS - 1)).astype(np.int64), np.full(len(caps), _CAPITALS)])
    sign = np.concatenate([np.zeros(len(words.start), bool), np.ones(len(signs.start) + len(caps), bool)])
    order = np.argsort(start, kind="stable")
    start = start[order]
    return Tokens(bucket[order], sign[order], np.searchsorted(start, offsets))


def contexts(found: Tokens, index: np.ndarray, into: np.ndarray) -> None:
    """Add the index vectors of neighbours to the context vectors."""
    doc = np.repeat(np.arange(len(found.first) - 1), np.diff(found.first))
    b = found.bucket
    for gap in range(1, SPAN + 1):
        same = np.flatnonzero(doc[gap:] == doc[:-gap])
        for a, c in ((same, same + gap), (same + gap, same)):
            order = np.argsort(b[a], kind="stable")
            for i in range(0, len(order), 1 << 16):
                part = order[i : i + (1 << 16)]
                of, vectors = b[a[part]], index[b[c[part]]]
                edge = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                into[of[edge]] += np.add.reduceat(vectors, edge, axis=0)


def _pooled(vectors: np.ndarray, bucket: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean vector of each row's tokens; zeros where it has none."""
    rows = len(first) - 1
    out = np.zeros((rows, vectors.shape[1]), np.float64)
    at = 0
    while at < rows:  # about 65,000 tokens at once, a longer row in parts
        end = max(at + 1, int(np.searchsorted(first, first[at] + (1 << 16), side="right")) - 1)
        if first[at + 1] - first[at] > 1 << 16:
            for i in range(first[at], first[end], 1 << 16):
                out[at] += vectors[bucket[i : min(i + (1 << 16), first[end])]].sum(0)
        else:
            some = vectors[bucket[first[at] : first[end]]]
            full = np.flatnonzero(np.diff(first[at : end + 1]))
            if len(full):
                out[at + full] = np.add.reduceat(some, first[at + full] - first[at], axis=0)
        at = end
    return out / np.maximum(np.diff(first), 1)[:, None]


def pool(found: Tokens, vectors: np.ndarray) -> np.ndarray:
    """A document's inputs: mean of words, mean of signs and marks, shares and length."""
    total = np.maximum(np.diff(found.first), 1)
    kinds = []
    for sign in (False, True):
        chosen = found.sign == sign
        first = np.concatenate(([0], np.cumsum(chosen)))[found.first]
        kinds.append(_pooled(vectors, found.bucket[chosen], first))
    caps = _sums(found.sign & (found.bucket == _CAPITALS), found.first) / total
    signs = _sums(found.sign, found.first) / total
    return np.column_stack([*kinds, signs, caps, np.log1p(np.diff(found.first)) / 10])


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = 60, batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Network:
    """Adam on the weighted logistic loss."""
    rng = np.random.default_rng(seed)
    n, d = x.shape
    scale = x.std(0) + 1e-3
    net = Network(x.mean(0), scale, rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(()))
    z, weight = (x - net.mean) / scale, weight / weight.mean()
    names = ("w1", "b1", "w2", "b2")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    step = 0
    epochs = max(epochs, LEAST_STEPS * batch // max(n, 1))
    for epoch in range(epochs):
        order = rng.permutation(n)
        for i in range(0, n, batch):
            rows = order[i : i + batch]
            h = np.tanh(z[rows] @ net.w1 + net.b1)
            g = weight[rows] * (sigmoid(h @ net.w2 + net.b2) - y[rows]) / len(rows)
            back = g[:, None] * net.w2 * (1 - h * h)
            grad = {"w1": z[rows].T @ back + decay * net.w1, "b1": back.sum(0), "w2": h.T @ g + decay * net.w2, "b2": g.sum()}
            step += 1
            for k in names:
                m[k] = 0.9 * m[k] + 0.1 * grad[k]
                v[k] = 0.999 * v[k] + 0.001 * grad[k] ** 2
                now = rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
                setattr(net, k, getattr(net, k) - now)
    return net


def temperature(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature with the least loss on rows that were not learned from."""
    tried = np.exp(np.linspace(np.log(0.25), np.log(20), 80))
    loss = [np.average(np.logaddexp(0, np.where(y > 0, -logit, logit) / t), weights=weight) for t in tried]
    return float(tried[int(np.argmin(loss))])


@dataclass
class Model:
    vectors: np.ndarray
    network: Network | None

    def score(self, column) -> np.ndarray:
        if self.network is None:
            return np.full(len(column), 0.5)
        return sigmoid(self.network.logit(pool(tokens(column), self.vectors)) / self.network.temperature)


def _context_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, total = index_vectors(), None
    for batch in batches:
        total = np.zeros((BUCKETS, DIMENSIONS), np.float32) if total is None else total
        contexts(tokens(batch.column(0)), index, total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Context vectors of unit length; a bucket the sample lacks keeps its index vector."""
    parts = sample.select("text").repartition(TASKS).mapInArrow(_context_sums, "sums binary").toLocalIterator()
    total = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    for row in parts:
        total += np.frombuffer(row["sums"], np.float32).reshape(total.shape)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    bare = index_vectors()
    bare /= np.maximum(np.linalg.norm(bare, axis=1, keepdims=True), 1)
    mixed = np.where(norm > 0, total / np.maximum(norm, 1e-9), bare) + 0.5 * bare
    return (mixed / np.maximum(np.linalg.norm(mixed, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _inputs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pool(tokens(batch.column(0)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:5], pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "weight", "part", "tie", "x"])

    return run


def train(documents: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Model:
    """A model from a bounded sample; the driver holds 2 * each rows of 2 * DIMENSIONS + 3 numbers."""
    spark = documents.sparkSession
    C.small_batches(spark)
    sample = C.materialize(_labels.sample(documents, labels, "quality", each), "labelled")
    vectors = word_vectors(sample)
    shared = spark.sparkContext.broadcast(vectors)
    rows = sample.mapInArrow(_inputs(shared), "label int, weight double, part double, tie bigint, x array<double>").toPandas().sort_values(["part", "tie"])
    y, w, part = (rows[k].to_numpy(float) for k in ("label", "weight", "part"))
    if len(set(y)) < 2:
        return Model(vectors, None)
    x = np.array(rows["x"].tolist())
    fitting = part < 0.8
    if len(set(y[fitting])) < 2:
        fitting = np.ones(len(y), bool)
    network = fit(x[fitting], y[fitting], w[fitting])
    check = ~fitting if (~fitting).any() else fitting
    network.temperature = temperature(network.logit(x[check]), y[check], w[check])
    return Model(vectors, network)


def keep(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents of good quality."""
    score = C.fresh(documents, "__score")
    kept = scored(documents, train(documents, labels), score).filter(F.col(score) >= threshold)
    return kept.select(*C.quoted(documents.columns))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    df = scored(docs, train(docs, C.table(spark, sf_dir, "labels")))
    return df.select("doc_id", _labels.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
