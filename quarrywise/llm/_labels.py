"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels may never be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def sample(documents: DataFrame, labels: DataFrame, label: str, each: int) -> DataFrame:
    """(text, label, weight, part, tie): at most ``each`` documents of each label 0 and 1, taken by the hash of doc_id.

    weight restores the labels' shares; part is a number in [0, 1) by another hash, to split the sample; part and tie
    together order it, so that a fit doesn't depend on how the tables are laid out.
    A doc_id with several labels has the greatest; null labels and held-out documents are left out.  Of a doc_id with
    several rows the text that sorts first is taken, so there are 2 * each rows at most.
    Only the chosen ids are broadcast.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(11))
    chosen = [known.filter(F.col("label") == k).orderBy(order, "doc_id").limit(each).withColumn("weight", F.lit(max(1.0, n / each))) for k, n in sorted(totals.items())]
    if not chosen:
        return documents.limit(0).select(C.text_or_empty().alias("text"), F.lit(0).alias("label"), F.lit(1.0).alias("weight"), F.lit(0.0).alias("part"), F.lit(0).cast("long").alias("tie"))
    ids = C.materialize(reduce(DataFrame.unionByName, chosen), "sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = documents.select("doc_id", C.text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "label", "weight").agg(F.min("text").alias("text"))
    return rows.select("text", "label", "weight", part.alias("part"), F.xxhash64("doc_id", F.lit(31)).alias("tie"))
