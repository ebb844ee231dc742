"""The calls as plain functions for a tool server: the index is named by an environment variable and kept open while unchanged."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from .api import CorpusIndex, HybridIndex

INDEX, HYBRID = "QUARRYWISE_INDEX", "QUARRYWISE_HYBRID_INDEX"
_open: dict[tuple, object] = {}


def _named(variable: str) -> str:
    if not os.environ.get(variable):
        raise RuntimeError(f"set {variable} to the index folder")
    return os.environ[variable]


def _index(variable: str, kind):
    spark, path = SparkSession.builder.getOrCreate(), _named(variable)
    jvm = spark.sparkContext._jvm
    meta = jvm.org.apache.hadoop.fs.Path(f"{path}/meta")
    state = meta.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(meta).getModificationTime()
    if (variable, path, state) not in _open:
        for key in [k for k in _open if k[0] == variable]:
            del _open[key]
        _open[variable, path, state] = kind(spark, path)
    return _open[variable, path, state]


def orient(max_top_topics: int = 10, token_budget: int | None = None) -> dict:
    return _index(INDEX, CorpusIndex).orient_corpus(max_top_topics, token_budget=token_budget)


def expand_topic(topic_id: str, max_children: int = 8) -> dict:
    return _index(INDEX, CorpusIndex).expand_topic(topic_id, max_children)


def topic_card(topic_id: str, snippets: int = 5, representative_docs: int = 8) -> dict:
    return _index(INDEX, CorpusIndex).topic_card(topic_id, snippets, representative_docs)


def search(query: str, scope_id: str | None = None, topic_id: str | None = None, corpus: bool = False, include_descendants: bool = True, level: str = "passage", max_results: int = 15, doc_types=None, sources=None, entities=None) -> dict:
    """Exactly one of scope_id, topic_id and corpus says where to search."""
    if sum((scope_id is not None, topic_id is not None, bool(corpus))) != 1:
        raise ValueError("give exactly one of scope_id, topic_id and corpus")
    scope = {"scope_id": scope_id} if scope_id else {"topic_ids": [topic_id], "include_descendants": include_descendants} if topic_id else {"kind": "corpus"}
    filters = {k: v for k, v in (("doc_types", doc_types), ("sources", sources), ("entities", entities)) if v}
    return _index(INDEX, CorpusIndex).search_within(scope, query, level, max_results, filters)


def doc_card(doc_id: str) -> dict:
    return _index(INDEX, CorpusIndex).doc_card(doc_id)


def read_window(**place) -> dict:
    return _index(INDEX, CorpusIndex).read_window(**place)


def read_pages(doc_id: str, pages: list[int], max_chars: int | None = None) -> dict:
    return _index(INDEX, CorpusIndex).read_pages(doc_id, pages, max_chars)


def hybrid_search(query: str, **options) -> dict:
    return _index(HYBRID, HybridIndex).search(query, **options)
