"""Whole-corpus tables: duplicates, value counts, facets, summary, quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: Column, limit: int = 10) -> DataFrame:
    """(value, n) of the most frequent non-empty values, ties by value."""
    values = df.select(column.cast("string").alias("value")).filter("value <> ''")
    return values.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def duplicate_groups(documents: DataFrame, text: Column) -> DataFrame:
    """(text_hash, doc_id, first_doc, members): members of groups with the same non-blank text, as a star round the first."""
    hashed = documents.filter(F.trim(text) != "").select("doc_id", F.concat(F.lit("TXT-"), F.upper(F.substring(F.sha1(text.cast("binary")), 1, 16))).alias("text_hash"))
    groups = hashed.groupBy("text_hash").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("members")).filter("members > 1")
    return hashed.join(groups, "text_hash")


def stars(documents: DataFrame, key: Column, relation: str, of: Column | None = None) -> DataFrame:
    """(group_key, relation, doc_id, first_doc, members): documents with the same key, as a star round the first.

    A row for each document, however large its group; related() gives one document's partners.
    """
    keyed = documents.select("doc_id", key.alias("k")).filter((F.col("k").isNotNull()) & (of if of is not None else F.lit(True)))
    groups = keyed.groupBy("k").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("members")).filter("members > 1")
    return keyed.join(groups, "k").select(F.col("k").alias("group_key"), F.lit(relation).alias("relation"), "doc_id", "first_doc", "members")


def related(stars_: DataFrame, doc_id, most: int = 50) -> DataFrame:
    """(doc_id, relation, target_doc_id, confidence): the first partners of one document."""
    mine = stars_.filter(F.col("doc_id") == doc_id).select("group_key", "relation", F.col("doc_id").alias("own"))
    found = stars_.join(F.broadcast(mine), ["group_key", "relation"]).filter("doc_id <> own")
    return found.select(F.col("own").alias("doc_id"), "relation", F.col("doc_id").alias("target_doc_id"), F.lit(1.0).alias("confidence")).orderBy("target_doc_id", "relation").limit(most)


def facets(documents: DataFrame, entities: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(facet, value, n): the most frequent document types, sources, extraction methods, and names by type."""
    pairs = F.explode(F.create_map(F.lit("doc_type"), F.col("doc_type"), F.lit("source"), F.col("source_batch"), F.lit("extraction"), F.col("extraction_method"))).alias("facet", "value")
    rows = documents.select(pairs)
    if entities is not None:
        rows = rows.unionByName(entities.filter(F.col("type").isin("person", "organization", "location")).select(F.col("type").alias("facet"), F.col("text").alias("value")))
    counts = rows.filter("value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))
    order = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).drop("rank")


def entity_summary(entities: DataFrame, members: DataFrame, group: str, limit: int = 10) -> DataFrame:
    """(group, rank, text, type, n): the most frequent mentions of each group's documents."""
    counts = entities.select("doc_id", "text", "type").join(members.select(group, "doc_id"), "doc_id").groupBy(group, "text", "type").agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "text", "type")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(group, "rank", "text", "type", "n")


def quality(documents: DataFrame, duplicated: DataFrame) -> DataFrame:
    """One row: shares of documents with text, read by OCR, of low confidence, with a duplicate; mean confidence; languages."""
    df = documents.join(duplicated.select("doc_id").distinct().withColumn("dup", F.lit(1)), "doc_id", "left")
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("int")), F.lit(0.0)), 4)
    conf = F.col("ocr_confidence")
    return df.agg(
        share(F.col("text_available")).alias("text_available_pct"),
        share(F.col("extraction_method").contains("ocr")).alias("ocr_pct"),
        F.round(F.avg(conf), 4).alias("mean_ocr_confidence"),
        share(F.coalesce(conf < 0.75, F.lit(False))).alias("low_confidence_pct"),
        share(F.col("dup").isNotNull()).alias("duplicate_rate"),
        F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"),
    )
