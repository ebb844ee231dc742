"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon (given seed words, and words and word beginnings
learned from labels) plain and after undoing digit-for-letter writing, how close hits stand to
second-person words, capitals, punctuation, obfuscation.  The lexicon, the trees and the
calibration each learn from their own part of one sample of at most 2 * SAMPLE_EACH labelled
documents; held-out documents are never in it.  Every document is scored, in one narrow pass.

The model and every score depend on the rows alone, not on their order, partitions or batches; equal texts have
equal scores.  A null text is empty and scored as such; of very long texts all words count.  Repeated rows are scored
each.  Equal raw scores are calibrated as one.  Without labels all scores are one half.  An empty table gives no rows.  Columns named as the outputs are replaced; others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import _labels, _trees
from ._words import ALNUM, Alphabet, Words, buffer, split, value_of

SAMPLE_EACH = 4000
#: Most learned lexicon entries.
LEXICON = 20_000
THRESHOLD = 0.3
PREFIXES = (4, 5, 6)
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "hate", "kill", "ugly", "imbecile", "fool")
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "usted", "ustedes", "ti", "tus", "vosotros")
NEAR = 5
_SEED_WEIGHT = 4.0


def _leet() -> Alphabet:
    """Letters, with digits and signs that stand for letters read as those."""
    alphabet = Alphabet(ALNUM.word)
    codes = bytearray(alphabet.codes)
    for sign, letter in zip("01345$@", "oieassa"):
        codes[ord(sign)] = ord(letter)
    alphabet.codes = bytes(codes)
    return alphabet


LEET = _leet()


@dataclass
class Lexicon:
    """Sorted values of words and beginnings, with weights."""

    value: np.ndarray
    weight: np.ndarray
    persons: np.ndarray

    def weights(self, values: np.ndarray) -> np.ndarray:
        if not len(self.value):
            return np.zeros(len(values))
        at = np.minimum(np.searchsorted(self.value, values), len(self.value) - 1)
        return np.where(self.value[at] == values, self.weight[at], 0.0)

    def of(self, words: Words, heads: list[np.ndarray]) -> np.ndarray:
        """The greatest weight of each word or its beginnings."""
        out = self.weights(words.value)
        for h in heads:
            np.maximum(out, self.weights(h), out=out)
        return out


def lexicon(learned: dict[int, float], seeds: tuple[str, ...] = SEEDS) -> Lexicon:
    both = {value_of(w.encode(), ALNUM): _SEED_WEIGHT for w in seeds}
    for v, w in learned.items():
        both[v] = max(w, both.get(v, 0.0))
    value = np.array(sorted(both), np.uint64)
    weight = np.round(np.array([both[int(v)] for v in value]) * 1024) / 1024  # so that sums are exact in any order
    persons = np.sort(np.array([value_of(w.encode(), ALNUM) for w in SECOND_PERSON], np.uint64))
    return Lexicon(value, weight, persons)


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of x between neighbours in first."""
    total = np.concatenate(([0], np.cumsum(x, dtype=np.float64)))
    return total[first[1:]] - total[first[:-1]]


def _distance(mark: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each place's distance to the nearest marked one of its row; a million if there is none."""
    n = len(mark)
    at = np.arange(n)
    length = np.diff(first)
    before = np.maximum.accumulate(np.where(mark, at, -1))
    after = np.minimum.accumulate(np.where(mark, at, n)[::-1])[::-1]
    back = np.where(before >= np.repeat(first[:-1], length), at - before, 10**6)
    return np.minimum(back, np.where(after < np.repeat(first[1:], length), after - at, 10**6))


FEATURES = ("length", "hits", "density", "weight", "strongest", "distinct", "leet_hits", "persons", "near", "near_share", "capitals", "all_caps", "exclaims", "questions", "marks", "digits_in_words", "marks_in_words", "repeats")


def features(column, lex: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    words, heads = split(column, ALNUM, PREFIXES)
    n = np.diff(words.first).astype(np.float64)
    size = np.maximum(n, 1)
    weight = lex.of(words, heads)
    hit = weight > 0
    rows = len(n)
    hits = _sums(hit, words.first)
    strongest, distinct = np.zeros(rows), np.zeros(rows)
    at = np.flatnonzero(hit)
    if len(at):
        row = np.searchsorted(words.first, at, side="right") - 1
        np.maximum.at(strongest, row, weight[at])
        pairs = np.unique(np.stack([row.astype(np.uint64), words.value[at]], 1), axis=0)
        distinct = np.bincount(pairs[:, 0].astype(np.int64), minlength=rows).astype(np.float64)
    spelled, spelled_heads = split(column, LEET, PREFIXES)
    leet = _sums(lex.of(spelled, spelled_heads) > 0, spelled.first)
    person = np.isin(words.value, lex.persons)
    persons = _sums(person, words.first)
    near = _sums(hit & (_distance(person, words.first) <= NEAR), words.first) if len(person) else np.zeros(rows)
    data, offsets = buffer(column)
    chars = np.maximum(np.diff(offsets).astype(np.float64), 1)
    upper = (data >= 65) & (data <= 90)
    lower = ((data >= 97) & (data <= 122)) | (data >= 128)
    letter = upper | lower
    digit = (data >= 48) & (data <= 57)
    mark = (data > 32) & (data < 127) & ~letter & ~digit
    between = np.zeros((3, len(data)), bool)
    if len(data) > 2:
        inner = letter[:-2] & letter[2:]
        between[0, 1:-1] = digit[1:-1] & inner
        between[1, 1:-1] = mark[1:-1] & inner
        between[2, 2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    per = lambda x: _sums(x, offsets)
    uppers = per(upper)
    second = np.minimum(words.start + 1, max(len(data) - 1, 0))
    shouted = _sums(upper[words.start] & upper[second] & (words.end - words.start > 1), words.first) if len(words.start) else np.zeros(rows)
    table = [np.log1p(n), np.log1p(hits), hits / size, _sums(weight, words.first) / size, strongest, distinct, np.maximum(leet - hits, 0) / size, persons / size, near / size, near / np.maximum(hits, 1)]
    table += [uppers / np.maximum(per(letter), 1), shouted / size, per(data == 33) / chars, per(data == 63) / chars, per(mark) / chars]
    table += [per(between[0]) / size, per(between[1]) / size, per(between[2]) / size]
    return np.stack(table, 1)


@dataclass
class Model:
    lexicon: Lexicon
    trees: _trees.Trees
    calibration: _trees.Isotonic

    def score(self, column) -> np.ndarray:
        return np.clip(self.calibration(self.trees.raw(features(column, self.lexicon))), 0.0, 1.0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> for each word or beginning, in how many texts of either label it stands."""
    for batch in batches:
        label = batch.column(1).to_numpy()
        words, heads = split(batch.column(0), ALNUM, PREFIXES)
        doc = np.tile(words.doc, 1 + len(heads)).astype(np.uint64)
        pairs = np.unique(np.stack([np.concatenate([words.value, *heads]), doc], 1), axis=0)
        value, inverse = np.unique(pairs[:, 0], return_inverse=True)
        toxic = np.bincount(inverse, label[pairs[:, 1].astype(np.int64)], len(value)).astype(np.int64)
        whole = np.bincount(inverse, minlength=len(value))
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(toxic), pa.array(whole - toxic)], names=["value", "pos", "neg"])


def learn_lexicon(sample: DataFrame, most: int = LEXICON) -> dict[int, float]:
    """Log-odds of what stands in toxic texts far more often than in others."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}
    counts = sample.select("text", "label").mapInArrow(C.trimmed(_counted), "value bigint, pos bigint, neg bigint").groupBy("value").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    odds = F.log(((F.col("pos") + 0.1) / (sizes[1] + 1)) / ((F.col("neg") + 0.1) / (sizes[0] + 1)))
    least = 2 if sizes[1] < 200 else 3 if sizes[1] < 1000 else 5
    found = counts.withColumn("odds", odds).filter((F.col("pos") >= least) & (F.col("odds") >= 2.5)).orderBy(F.desc(F.col("odds") * F.log1p("pos")), "value").limit(most)
    return {r["value"] & (2**64 - 1): min(float(r["odds"]), 6.0) for r in found.collect()}


def _featured(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = features(batch.column(0), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:5], pa.array(list(rows), pa.list_(pa.float64()))], names=["label", "weight", "part", "tie", "x"])

    return run


def train(documents: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> Model:
    """A model from a bounded sample; the driver holds its features, 2 * each rows of len(FEATURES) numbers."""
    spark = documents.sparkSession
    C.small_batches(spark)
    sample = C.materialize(_labels.sample(documents, labels, "toxic", each), "labelled")
    lex = lexicon(learn_lexicon(sample.filter("part < 0.4")))
    shared = spark.sparkContext.broadcast(lex)
    rows = sample.filter("part >= 0.4").select("text", "label", "weight", "part", "tie").mapInArrow(C.trimmed(_featured(shared)), "label int, weight double, part double, tie bigint, x array<double>").toPandas().sort_values(["part", "tie"])
    x = np.array(rows["x"].tolist()).reshape(len(rows), len(FEATURES))
    y, w = rows["label"].to_numpy(float), rows["weight"].to_numpy(float)
    fitting = rows["part"].to_numpy() < 0.8
    trees = _trees.fit(x[fitting], y[fitting], w[fitting])
    check = ~fitting if len(set(y[~fitting])) == 2 else np.ones(len(y), bool)
    return Model(lex, trees, _trees.Isotonic(trees.raw(x[check]), y[check], w[check]))


def scored(documents: DataFrame, model, column: str = "score") -> DataFrame:
    """documents with each text's score."""
    C.small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(shared.value.score(batch.column(batch.schema.get_field_index("text"))), pa.float64())
            yield pa.RecordBatch.from_arrays([score if f.name == column else batch.column(i) for i, f in enumerate(batch.schema)], schema=batch.schema)

    df = documents.withColumn(column, F.lit(None).cast("double"))
    return df.mapInArrow(C.trimmed(run), df.schema)


def reject(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """documents without the toxic ones."""
    score = C.fresh(documents, "__score")
    kept = scored(documents, train(documents, labels), score).filter(F.col(score) < threshold)
    return kept.select(*C.quoted(documents.columns))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    df = scored(docs, train(docs, C.table(spark, sf_dir, "labels")))
    return df.select("doc_id", _labels.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
