"""Scoped lexical search: BM25 with the scope's own statistics, filters, diversity, refinements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrywise.functions import text as T
from quarrywise.sources.tables import materialize

K1, B = 1.5, 0.75
MOST_RESULTS = 50


def units(df: DataFrame, unit: str, doc: str, text: Column) -> DataFrame:
    """(unit, doc, words): the searchable units of an index; write it once, sorted by unit."""
    return df.select(F.col(unit).alias("unit"), F.col(doc).alias("doc"), T.tokens(text).alias("words"))


def query_terms(query: str) -> list[str]:
    """Distinct tokens of a query, in order."""
    words = (w.strip("'_-") for w in re.findall(T.WORD.replace(r"\p{Nd}", r"\d"), query.lower()))
    stop = set(T.STOPWORDS)
    return list(dict.fromkeys(w for w in words if 2 <= len(w) <= T.LONGEST_WORD and w not in stop))


def bm25(searchable: DataFrame, terms: list[str]) -> DataFrame:
    """(unit, doc, score) of the units that hold a term.

    searchable is already restricted to the scope.  Texts are looked at once: each unit's length and counts, a few
    numbers, are written, and N, df and mean length are a one-row aggregate of those.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return searchable.select("unit", "doc", F.lit(0.0).alias("score")).limit(0)
    found = searchable.select("unit", "doc", F.greatest(F.size("words"), F.lit(1)).alias("dl"), F.filter("words", lambda w: w.isin(terms)).alias("found"))
    equal = lambda t: lambda w: w == t
    counts = [F.size(F.filter("found", equal(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    counted = materialize(found.select("unit", "doc", "dl", *counts), "counted")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))])
    hits = counted.filter(" OR ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        weight = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score += F.when(tf > 0, weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))).otherwise(0.0)
    return hits.select("unit", "doc", score.alias("score"))


def postings(searchable: DataFrame) -> DataFrame:
    """(term, unit, doc, tf, dl), to be written in ranges of term: a query then reads the files of its terms alone."""
    terms = searchable.select("unit", "doc", F.greatest(F.size("words"), F.lit(1)).alias("dl"), F.explode("words").alias("term"))
    return terms.groupBy("term", "unit", "doc", "dl").agg(F.count("*").alias("tf"))


def lengths(searchable: DataFrame) -> DataFrame:
    """(unit, doc, dl) of all units."""
    return searchable.select("unit", "doc", F.greatest(F.size("words"), F.lit(1)).alias("dl"))


def bm25_postings(index: DataFrame, lengths: DataFrame, terms: list[str]) -> DataFrame:
    """bm25() from postings and the scope's (unit, dl): both already restricted to the scope."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return index.select("unit", "doc", F.lit(0.0).alias("score")).limit(0)
    found = index.filter(F.col("term").isin(terms))
    stats = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))  # one row for each term of the query
    rows = found.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("unit", "doc").agg(F.sum(part).alias("score"))


def top(scored: DataFrame, limit: int) -> DataFrame:
    """(rank, unit, doc, score) of the best by their whole scores, ties by unit; scores are given at 4 places."""
    best = scored.orderBy(F.desc("score"), "unit").limit(limit)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "unit")))
    return ranked.withColumn("score", F.round("score", 4))


def diversify(ranked: DataFrame, source: str, free: int = 3) -> DataFrame:
    """ranked (rank, doc, source) in a new order: a document's first result, and after ``free`` of them a source's first, come before the rest.

    ranked is a bounded result list, so one window over all of it is small.
    """
    first = F.row_number().over(Window.partitionBy("doc").orderBy("rank")) == 1
    df = ranked.withColumn("__first", first)
    k = F.sum(F.col("__first").cast("int")).over(Window.orderBy("rank"))
    of_source = F.sum(F.col("__first").cast("int")).over(Window.partitionBy(source).orderBy("rank"))
    chosen = F.col("__first") & ((k <= free) | F.col(source).isNull() | (F.col(source) == "") | (of_source == 1))
    df = df.withColumn("__chosen", F.coalesce(chosen, F.lit(False)))
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("__chosen"), "rank"))).drop("__first", "__chosen")


def top_diversified(scored: DataFrame, sources: DataFrame, source: str, limit: int, free: int = 3) -> DataFrame:
    """The first ``limit`` rows (rank, unit, doc, score, source) of what diversify() makes of all scored rows.

    A document's and a source's first results come from aggregates over all rows; only bounded lists are ranked.
    sources has one row (doc, source) for each document.
    """
    order = [F.desc("score"), F.asc("unit")]
    rows = scored
    best = F.min(F.struct((-F.col("score")).alias("low"), "unit", "doc")).alias("b")
    unpacked = [F.col("b.unit").alias("unit"), F.col("b.doc").alias("doc"), (-F.col("b.low")).alias("score")]
    firsts = rows.groupBy("doc").agg(best).select(*unpacked).join(sources.select("doc", source), "doc")
    named = F.coalesce(F.col(source) != "", F.lit(False))
    of_source = firsts.filter(named).groupBy(source).agg(best).select(*unpacked)
    chosen = firsts.select(*of_source.columns).orderBy(*order).limit(free).unionByName(firsts.filter(~named).select(*of_source.columns)).unionByName(of_source)
    chosen = chosen.distinct().orderBy(*order).limit(limit)
    rest = rows.select(*of_source.columns).join(chosen.select("unit"), "unit", "left_anti").orderBy(*order).limit(limit)
    both = chosen.withColumn("__k", F.lit(0)).unionByName(rest.withColumn("__k", F.lit(1)).select(*of_source.columns, "__k"))
    both = both.withColumn("rank", F.row_number().over(Window.orderBy("__k", *order))).drop("__k").filter(F.col("rank") <= limit)
    both = both.withColumn("score", F.round("score", 4))
    return both.join(sources.select("doc", source), "doc")


def filtered(documents: DataFrame, doc_types: list[str] = (), sources: list[str] = (), languages: list[str] = (), extraction_quality: list[str] = (), has_tables: bool | None = None) -> DataFrame:
    """documents that meet all given filters; pushed down to the scan where they are on plain columns."""
    for column, values in (("doc_type", doc_types), ("source_batch", sources), ("language", languages), ("extraction_method", extraction_quality)):
        if values:
            documents = documents.filter(F.lower(column).isin([v.lower() for v in values]))
    return documents if has_tables is None else documents.filter(F.col("has_tables") == has_tables)


def with_entities(documents: DataFrame, entities: DataFrame, names: list[str]) -> DataFrame:
    """documents that mention any of the names."""
    wanted = entities.filter(F.col("normalized_text").isin([n.lower() for n in names])).select("doc_id")
    return documents.join(wanted, "doc_id", "left_semi")


def refinements(results: DataFrame, scope: DataFrame, documents: DataFrame, entities: DataFrame) -> DataFrame:
    """(kind, value, label, observed, in_scope, mentions): document types and entities that would narrow the results.

    Counts are of distinct documents in the results and in the scope; at most 3 of a kind and 5 in all.
    """
    docs = results.select("doc_id").distinct()
    types = documents.join(scope, "doc_id", "left_semi").groupBy(F.col("doc_type").alias("value")).agg(F.count("*").alias("in_scope"))
    seen = documents.join(docs, "doc_id", "left_semi").groupBy(F.col("doc_type").alias("value")).agg(F.count("*").alias("observed"))
    by_type = seen.join(types, "value").select(F.lit("doc_type").alias("kind"), "value", F.col("value").alias("label"), "observed", "in_scope", F.col("observed").alias("mentions"))
    kinds = ["organization", "person", "location", "email", "case_number"]
    found = entities.filter(F.col("type").isin(kinds)).join(scope, "doc_id", "left_semi")
    found = found.join(docs.withColumn("hit", F.lit(True)), "doc_id", "left")
    value = F.col("normalized_text").alias("value")
    counts = found.groupBy(value).agg(F.countDistinct(F.when(F.col("hit"), F.col("doc_id"))).alias("observed"), F.countDistinct("doc_id").alias("in_scope"), F.count(F.when(F.col("hit"), 1)).alias("mentions"))
    forms = found.filter("hit").groupBy(value, "text").agg(F.count("*").alias("n")).groupBy("value").agg(F.max_by("text", F.struct("n", "text")).alias("label"))
    by_entity = counts.filter("observed > 0").join(forms, "value")
    both = by_type.unionByName(by_entity.select(F.lit("entity").alias("kind"), "value", "label", "observed", "in_scope", "mentions"))
    order = [F.desc("observed"), F.desc("in_scope"), F.desc("mentions"), F.asc("value")]
    both = both.withColumn("__k", F.row_number().over(Window.partitionBy("kind").orderBy(*order))).filter("__k <= 3")
    return both.drop("__k").orderBy(F.asc("kind"), *order).limit(5)
