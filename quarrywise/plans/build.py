"""Building an index: a folder of Parquet tables made from files or from a table of documents."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywise.functions import entities as E
from quarrywise.functions import split as S
from quarrywise.functions import text as T
from quarrywise.operators import corpus, hybrid, search, terms, topics
from quarrywise.sources import files, tables

import pandas as pd

FORMAT = "quarrywise-2"
#: Extraction warnings that a hybrid index's metadata lists; the table has all.
MOST_WARNINGS = 1000
Progress = Callable[[dict], None]


@dataclass(frozen=True)
class Stats:
    documents: int
    pages: int
    chunks: int
    entities: int
    topics: int
    seconds: float


def from_table(df: DataFrame) -> DataFrame:
    """Index documents of a table (doc_id, text, lang, source)."""
    text = T.strip(F.coalesce(F.col("text"), F.lit("")))
    kind = "array<struct<start:bigint,end:bigint>>"
    return df.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("source_uri"),
        F.coalesce("source", F.lit("default")).alias("source_batch"),
        F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")).alias("original_filename"),
        T.title(text, F.concat(F.lit("doc_"), F.col("doc_id"))).alias("title"),
        F.lit("text").alias("doc_type"),
        F.coalesce("lang", F.lit("unknown")).alias("language"),
        F.octet_length(text).cast("bigint").alias("size_bytes"),
        F.sha2(text, 256).alias("sha256"),
        text.alias("canonical_text"),
        text.alias("topic_text"),
        F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.length(text).cast("bigint").alias("end"))).cast(kind).alias("ranges"),
        F.lit("text").alias("extraction_method"),
        F.array().cast("array<string>").alias("warnings"),
        F.create_map().cast("map<string,string>").alias("metadata"),
        F.lit(None).cast("double").alias("ocr_confidence"),
        (text != "").alias("text_available"),
    )


def pages_of(documents: DataFrame) -> DataFrame:
    p = documents.select("doc_id", "canonical_text", F.posexplode("ranges").alias("k", "r"))
    text = T.substring(F.col("canonical_text"), F.col("r.start"), F.col("r.end"))
    return p.select("doc_id", (F.col("k") + 1).alias("page_number"), F.col("r.start").alias("char_start"), F.col("r.end").alias("char_end"), text.alias("text"), T.estimate_tokens(text).alias("token_estimate"), T.looks_tabular(text).alias("has_table"))


def chunks_of(pages: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [(d, p, o + s, o + e, t[s:e]) for d, p, o, t in zip(pdf["doc_id"], pdf["page_number"], pdf["char_start"], pdf["text"]) for s, e in S.chunks(t, 0, len(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "char_start", "char_end", "text"])

    df = pages.select("doc_id", "page_number", "char_start", "text").mapInPandas(run, "doc_id string, page_number int, char_start bigint, char_end bigint, text string")
    return df.withColumns({"chunk_id": T.stable_id("CH", 14, F.col("doc_id"), F.col("page_number"), F.col("char_start"), F.col("char_end")), "token_estimate": T.estimate_tokens(F.col("text"))})


def entities_of(pages: DataFrame, recogniser: E.Recogniser | None = None) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [(d, p, o + m[0], o + m[1], *m[2:]) for d, p, o, t in zip(pdf["doc_id"], pdf["page_number"], pdf["char_start"], pdf["text"]) for m in E.mentions(t, recogniser)]
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "char_start", "char_end", "text", "type", "confidence", "extractor"])

    df = pages.select("doc_id", "page_number", "char_start", "text").mapInPandas(run, "doc_id string, page_number int, char_start bigint, char_end bigint, text string, type string, confidence double, extractor string")
    return df.withColumns({"normalized_text": F.lower("text"), "entity_id": T.stable_id("E", 10, F.col("type"), F.lower("text"))})


LEVELS = ("document", "page", "passage")


def units_of(level: str, documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(unit, doc_id, page_number, char_start, char_end, text): what a level of search finds."""
    if level == "document":
        return documents.select(F.col("doc_id").alias("unit"), "doc_id", F.lit(None).cast("int").alias("page_number"), F.lit(0).cast("bigint").alias("char_start"), F.length("canonical_text").cast("bigint").alias("char_end"), F.col("canonical_text").alias("text"))
    unit = F.concat_ws(":", "doc_id", F.lpad(F.col("page_number").cast("string"), 6, "0")) if level == "page" else F.col("chunk_id")
    return (pages if level == "page" else chunks).select(unit.alias("unit"), "doc_id", "page_number", "char_start", "char_end", "text")


def signals_of(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, page_number, top_terms, signals) of pages."""
    page = F.struct("doc_id", "page_number").alias("page")
    best = terms.top_terms(terms.term_counts(pages.select(page, "text"), "page", F.col("text")), "page")
    best = best.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("top_terms")).select("page.*", "top_terms")
    types = entities.groupBy("doc_id", "page_number").agg(F.collect_set("type").alias("types"))
    rows = pages.join(best, ["doc_id", "page_number"], "left").join(types, ["doc_id", "page_number"], "left")
    rows = rows.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("top_terms", "types")})
    return rows.select("doc_id", "page_number", "top_terms", T.page_signals(F.col("text"), F.col("has_table"), F.col("types"), F.col("top_terms")).alias("signals"))


def build_index(spark: SparkSession, source: str | DataFrame, index_dir: str, corpus_id: str = "corpus", version: str = "v1", shape: topics.Shape = topics.Shape(), parsers=None, recogniser: E.Recogniser | None = None, progress: Progress | None = None) -> Stats:
    """Write all index tables; source is a folder of files or a table (doc_id, text, lang, source).

    Tables go to a folder of their own; the row that names it is written last, so an index that is built anew can be read meanwhile.
    """
    began, tell = time.time(), progress or (lambda event: None)
    tell({"event": "build_start", "index_dir": index_dir})
    folder = f"tables-{uuid.uuid4().hex}"

    def put(name: str, df: DataFrame, *order: str) -> DataFrame:
        out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        out.write.parquet(f"{index_dir}/{folder}/{name}")
        tell({"event": "table_done", "table": name, "seconds": round(time.time() - began, 3)})
        return spark.read.parquet(f"{index_dir}/{folder}/{name}")

    found = files.documents(files.scan(spark, source, index_dir), parsers) if isinstance(source, str) else from_table(source)
    documents = put("documents", found)
    put("warnings", documents.select("doc_id", "source_uri", F.explode("warnings").alias("warning")))
    pages = put("pages", pages_of(documents))
    chunks = put("chunks", chunks_of(pages))
    entities = put("entities", entities_of(pages, recogniser))
    put("page_signals", signals_of(pages, entities))
    for level in LEVELS:
        words = search.units(units_of(level, documents, pages, chunks), "unit", "doc_id", F.col("text"))
        put(f"postings_{level}", search.postings(words), "term")
        put(f"lengths_{level}", search.lengths(words))
    same_file = corpus.stars(documents, F.col("sha256"), "duplicate", (F.col("k") != F.sha2(F.lit(""), 256)))
    same_text = corpus.stars(documents.filter("text_available"), F.sha1(F.col("canonical_text").cast("binary")), "near_duplicate")
    copies = put("duplicates", same_file.unionByName(same_text))
    topic_text = F.concat_ws(" ", "title", "original_filename", F.coalesce(F.nullif("topic_text", F.lit("")), "canonical_text"))
    counts = put("term_counts", terms.term_counts(documents.select("doc_id", topic_text.alias("t")), "doc_id", F.col("t")))
    idf = put("idf", terms.idf(counts, documents))
    vectors = put("vectors", terms.vectors(counts, idf, "doc_id"))
    tell({"event": "topicing_start"})
    tree = put("topic_docs", topics.build(documents.select("doc_id"), vectors, version, shape))
    members = tree.select("topic_id", "doc_id")
    centres = put("centroids", terms.centroids(vectors, members, "doc_id", "topic_id"))
    nodes = tree.select("topic_id", "parent_topic_id", "depth", "ordinal").distinct().join(topics.rollups(members, pages.select("doc_id"), chunks.select("doc_id"), "topic_id"), "topic_id")
    labels = topics.labels(topics.label_scores(counts, idf, members, "topic_id"), "topic_id")
    graded = topics.quality(vectors, centres, members, documents, "topic_id", copies).drop("doc_count").withColumnRenamed("warnings", "topic_warnings")
    topic_rows = nodes.join(labels, "topic_id", "left").join(graded, "topic_id")
    topic_rows = topic_rows.withColumns({"label_terms": F.coalesce("label_terms", F.array(F.lit("low text signal"))), "label_phrases": F.coalesce("label_phrases", F.array().cast("array<string>"))})
    topic_rows = put("topics", topic_rows)
    put("topic_entities", corpus.entity_summary(entities, members, "topic_id"))
    put("neighbours", topics.neighbours(topic_rows.select("topic_id", "depth", "label_terms"), "topic_id"))
    put("contrast", topics.contrast(topic_rows.filter("parent_topic_id IS NOT NULL").select(F.col("parent_topic_id").alias("parent"), "topic_id", "label_terms"), "parent", "topic_id"))
    scores = put("topic_scores", terms.similarity(vectors, centres, "doc_id", "topic_id"))
    put("chunk_topics", topics.chunk_scores(chunks, members, scores, "topic_id"))
    leafy = members.join(topic_rows.filter("depth > 0").select("topic_id"), "topic_id", "left_semi") if topic_rows.filter("depth > 0").limit(1).count() else members
    put("memberships", topics.memberships(scores.join(leafy.select("topic_id").distinct(), "topic_id", "left_semi"), leafy))
    own = members.join(scores, ["topic_id", "doc_id"], "left").select("topic_id", "doc_id", F.round(F.coalesce("score", F.lit(0.0)), 9).alias("score"))
    put("representatives", topics.representative_docs(own.join(documents.select("doc_id", "doc_type", "source_batch"), "doc_id").select("topic_id", "doc_id", "doc_type", "source_batch", "score"), "topic_id"))
    inside = entities.select("doc_id", F.col("char_start").alias("at")).join(chunks.select("chunk_id", "doc_id", "char_start", "char_end"), "doc_id").filter("at >= char_start AND at < char_end")
    put("snippets", topics.snippets(topic_rows, own, chunks, documents, inside.groupBy("chunk_id").agg(F.count("*").alias("n")), "topic_id"))
    scope = F.when(F.col("depth") == 0, F.lit("S-root")).otherwise(T.stable_id("S", 8, F.col("topic_id"), F.lit("topic_subtree")))
    put("scopes", topic_rows.select(scope.alias("scope_id"), F.when(F.col("depth") == 0, "corpus").otherwise("topic_subtree").alias("kind"), F.array("topic_id").alias("topic_ids"), F.lit(True).alias("include_descendants"), F.col("doc_count").alias("estimated_doc_count"), F.col("page_count").alias("estimated_page_count")))
    tell({"event": "topicing_done"})
    meta = {"corpus_id": corpus_id, "corpus_version": version, "format": FORMAT, "tables": folder}
    spark.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").withColumn("generated_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{index_dir}/meta")
    tables.remove_others(spark, index_dir, "tables-", folder)
    stats = Stats(documents.count(), pages.count(), chunks.count(), entities.count(), topic_rows.count(), round(time.time() - began, 3))
    tell({"event": "build_done", "stats": stats.__dict__})
    return stats


def tables_dir(spark: SparkSession, index_dir: str) -> str:
    """The folder of an index's tables."""
    return f"{index_dir}/{json.loads(spark.read.parquet(f'{index_dir}/meta').first()['meta'])['tables']}"


def build_hybrid(spark: SparkSession, index_dir: str, hybrid_dir: str, embedder: hybrid.Embedder | None = None, ann_rows: int = hybrid.ANN_ROWS) -> dict:
    """Chunks with vectors, entity names and document columns, their postings, from an index; and metadata.

    From ann_rows chunks on they are dealt into cells by a bounded sample's centres and written by cell.
    """
    began, embedder, folder = time.time(), embedder or hybrid.HashEmbedder(), tables_dir(spark, index_dir)
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    documents, chunks = read("documents"), read("chunks")
    names = read("entities").select("doc_id", "char_start", "normalized_text").distinct().withColumnRenamed("char_start", "at")
    inside = chunks.select("chunk_id", "doc_id", "char_start", "char_end").join(names, "doc_id").filter("at >= char_start AND at < char_end")
    keys = inside.groupBy("chunk_id").agg(F.array_sort(F.collect_set("normalized_text")).alias("entity_keys"))
    rows = chunks.filter(F.trim("text") != "").join(documents.select("doc_id", "source_uri", "source_batch", "title", "doc_type", "extraction_method"), "doc_id").join(keys, "chunk_id", "left")
    rows = tables.materialize(hybrid.embedded(rows.withColumn("entity_keys", F.coalesce("entity_keys", F.array().cast("array<string>"))), embedder), "vectors")
    n = rows.count()
    centres = hybrid.train_cells(rows, "chunk_id", "vector") if n >= ann_rows else []
    celled = hybrid.with_cells(rows, "vector", centres)
    (celled.repartitionByRange("cell").sortWithinPartitions("cell") if centres else celled).write.mode("overwrite").parquet(f"{hybrid_dir}/chunks")
    words = search.units(rows, "chunk_id", "doc_id", F.col("text"))
    search.postings(words).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{hybrid_dir}/postings")
    search.lengths(words).write.mode("overwrite").parquet(f"{hybrid_dir}/lengths")
    pdfs = documents.filter((F.col("doc_type") == "pdf") & (F.coalesce(F.col("metadata")["pdf_backend"], F.lit("")) != "docling")).count()
    known = read("warnings")
    some = [r.asDict() for r in known.orderBy("doc_id", "warning").limit(MOST_WARNINGS).collect()]
    meta = {
        "format": FORMAT + "-hybrid",
        "doc_count": documents.count(),
        "chunk_count": n,
        "page_count": read("pages").count(),
        "source_batch_counts": [r.asDict() for r in corpus.value_counts(documents, F.col("source_batch")).collect()],
        "source_doc_type_counts": [r.asDict() for r in corpus.value_counts(documents, F.col("doc_type")).collect()],
        "embedding": {"model": embedder.model_name, "dimension": embedder.dimension},
        "vector_index": {"created": bool(centres), "min_rows": ann_rows, "cells": len(centres)},
        "warnings": [f"{pdfs} PDF documents were not read with layout analysis"] if pdfs else [],
        "extraction_warnings": some,
        "extraction_warning_count": known.count(),
        "build_seconds": round(time.time() - began, 3),
    }
    spark.createDataFrame([(json.dumps(meta), centres)], "meta string, centres array<array<double>>").write.mode("overwrite").parquet(f"{hybrid_dir}/meta")
    return meta
