"""Bounded calls over an index: each returns an envelope of limited size with where its parts come from.

The heavy part of a call is one or two DataFrame queries; only what fits the answer reaches the driver.
"""

from __future__ import annotations

import copy
import hashlib
import itertools
import json
import math
from collections.abc import Iterator
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrywise.functions import split as S
from quarrywise.functions import text as T
from quarrywise.operators import corpus, hybrid, search, topics
from quarrywise.plans import build
from quarrywise.sources.tables import materialize

# Answer sizes in estimated tokens, and reading limits in characters and pages.
BUDGETS = {"orient": 12000, "expand": 10000, "topic": 9000, "search": 10000, "doc": 7000}
WINDOW, WINDOW_MOST = 3000, 6000
PAGES, PAGES_CHARS, PAGES_MOST = 8, 6000, 10000
LEVELS = build.LEVELS
QUALITY = ("coherence", "assignment_confidence", "source_concentration", "duplicate_rate", "topic_warnings")
SNIPPET_WARNING = "The excerpt stands for a topic; read the text round it before relying on it."
#: What an answer gives up to fit its budget: the ends of these lists, then long texts, then what lies deeper, then results.
_SPARED_LAST = ("results", "children", "top_topics")
_GIVEN_UP = ("snippets", "representative_docs", "best_passages", "page_map", "suggested_refinements", "neighboring_topics", "top_entities", "contrast_terms", "related_docs", "actions")
_TEXTS, _LONG = ("text", "snippet"), 500


def estimate(value) -> int:
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True, default=str)
    return max(1, math.ceil(len(text) / 4))


def _removals(node) -> Iterator[int]:
    """Make a result smaller, one step each time it is asked, and say by how many characters at least."""
    size = lambda value: len(json.dumps(value, ensure_ascii=False, default=str))
    if isinstance(node, list):
        while node:
            yield from _removals(node[-1])
            yield size(node.pop())
    if isinstance(node, dict):
        if "facets" in node:
            yield size(node.pop("facets"))
        for part in (node[k] for k in _GIVEN_UP if isinstance(node.get(k), list)):
            while part:
                yield size(part.pop())
        for k in _TEXTS:
            if isinstance(node.get(k), str) and len(node[k]) > _LONG:
                node[k], cut = node[k][:_LONG], len(node[k]) - _LONG
                yield cut
        for k in [*(k for k in node if k not in _SPARED_LAST), *(k for k in _SPARED_LAST if k in node)]:
            yield from _removals(node[k])


class CorpusIndex:
    """An opened index."""

    def __init__(self, spark: SparkSession, index_dir: str):
        self.spark, self.dir = spark, index_dir
        self.meta = json.loads(spark.read.parquet(f"{index_dir}/meta").first()["meta"])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{self.meta['tables']}/{name}")

    # --- parts ---------------------------------------------------------------------------
    def _envelope(self, tool: str, result: dict, kind: str, budget: int | None = None, warnings=(), actions=(), coverage=None) -> dict:
        out = {"corpus_id": self.meta["corpus_id"], "corpus_version": self.meta["corpus_version"], "tool_name": tool, "result": copy.deepcopy(result), "token_estimate": 0, "truncated": False, "warnings": list(warnings), "actions": list(actions), "response_kind": kind}
        out["cost_ledger"] = {"result_token_estimate": 0, "coverage": coverage or {}, "cheaper_next_actions": list(actions)[:3]}
        steps, left = itertools.chain(_removals(out["result"]), _removals(out["actions"]), _removals(out["cost_ledger"]["cheaper_next_actions"])), 0
        while budget and left <= 0 and (over := 4 * (estimate(out) - budget)) > 0:
            left = over
            for freed in steps:  # measured anew only when what went may be enough
                out["truncated"] = True
                left -= freed
                if left <= 0:
                    break
        if out["truncated"]:
            out["warnings"].append("The answer was cut to its token budget.")
        out["token_estimate"] = estimate(out)
        out["cost_ledger"]["result_token_estimate"] = estimate(out["result"])
        return out

    @staticmethod
    def action(name: str, args: dict, cost: str, description: str) -> dict:
        return {"action": name, "args": args, "estimated_cost": cost, "description": description}

    @cached_property
    def _topics(self) -> dict[str, dict]:
        """Topic rows without their documents; at most some thousands."""
        rows = [r.asDict(recursive=True) for r in self.table("topics").collect()]
        rows.sort(key=lambda r: [int(p.removeprefix("v")) for p in r["topic_id"].split(".") if p.removeprefix("v").isdigit()])
        return {r["topic_id"]: r for r in rows}

    def _topic(self, topic_id: str) -> dict:
        if topic_id not in self._topics:
            raise KeyError(f"unknown topic_id: {topic_id}")
        return self._topics[topic_id]

    def _doc(self, doc_id: str) -> dict:
        row = self.table("documents").filter(F.col("doc_id") == doc_id).first()
        if row is None:
            raise KeyError(f"unknown doc_id: {doc_id}")
        return row.asDict(recursive=True)

    def _children(self, topic_id: str) -> list[dict]:
        return [t for t in self._topics.values() if t["parent_topic_id"] == topic_id]

    def _neighbours(self, topic_id: str) -> list[dict]:
        return [r.asDict() for r in self.table("neighbours").filter(F.col("topic_id") == topic_id).orderBy("rank").collect()]

    def _representatives(self, topic_ids: list[str], n: int) -> dict[str, list[dict]]:
        """Representative documents of some topics, by topic, in one query."""
        rows = self.table("representatives").filter(F.col("topic_id").isin(topic_ids) & (F.col("rank") <= n))
        rows = rows.join(self.table("documents").select("doc_id", "title", "doc_type", "source_batch"), "doc_id").orderBy("topic_id", "rank")
        return self._by_topic(rows, topic_ids)

    def _snippets(self, topic_ids: list[str], n: int) -> dict[str, list[dict]]:
        """Representative excerpts of some topics, by topic, in one query."""
        rows = self.table("snippets").filter(F.col("topic_id").isin(topic_ids) & (F.col("rank") <= n)).join(self.table("documents").select("doc_id", "title", "doc_type", "source_batch"), "doc_id")
        found = self._by_topic(rows.orderBy("topic_id", "rank"), topic_ids)
        return {t: [self._snippet(t, r) for r in rows] for t, rows in found.items()}

    @staticmethod
    def _snippet(topic_id: str, row: dict) -> dict:
        reason = ["contains_representative_terms", row.pop("reason")]
        return {"snippet_id": f"SNIP-{topic_id}-{row['doc_id']}-p{row['page_number']:04d}-{row['char_start']:07d}", **row, "selection_reason": reason, "snippet_warning": SNIPPET_WARNING}

    @staticmethod
    def _by_topic(rows: DataFrame, topic_ids: list[str]) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {t: [] for t in topic_ids}
        for r in rows.collect():
            out[r["topic_id"]].append(r.asDict(recursive=True))
        return out

    def _facets(self, docs: DataFrame | None = None) -> dict:
        documents, entities = self.table("documents"), self.table("entities")
        if docs is not None:
            documents, entities = documents.join(docs, "doc_id", "left_semi"), entities.join(docs, "doc_id", "left_semi")
        out: dict[str, list] = {}
        for r in corpus.facets(documents, entities).orderBy("facet", F.desc("n"), "value").collect():
            out.setdefault(r["facet"], []).append({"value": r["value"], "count": r["n"]})
        return out

    # --- scopes --------------------------------------------------------------------------
    def resolve_scope(self, scope: dict | None) -> dict:
        """A stored scope by id, with overrides, or the given one."""
        scope = dict(scope or {"kind": "corpus"})
        if "scope_id" in scope:
            row = self.table("scopes").filter(F.col("scope_id") == scope["scope_id"]).first()
            if row is None and len(scope) == 1:
                raise KeyError(f"unknown scope_id: {scope['scope_id']}")
            scope = (row.asDict() if row else {}) | scope
        name = hashlib.sha1(json.dumps(scope, sort_keys=True, default=str).encode()).hexdigest()[:8].upper()
        return {"kind": "document_set" if scope.get("doc_ids") else "compound", "scope_id": f"S-{name}"} | scope

    def scope_documents(self, scope: dict, filters: dict | None = None) -> DataFrame:
        """The documents of a scope: corpus, doc_ids, topic_ids (with all below), else all; then filters, the call's over the scope's."""
        documents = self.table("documents")
        if scope.get("kind") != "corpus":
            if scope.get("doc_ids"):
                chosen = self.spark.createDataFrame([(str(i),) for i in dict.fromkeys(scope["doc_ids"])], "doc_id string")
                documents = documents.join(chosen, "doc_id", "left_semi")
            elif scope.get("topic_ids"):
                ids = {t for t in self._topics for s in scope["topic_ids"] if t == s or scope.get("include_descendants", True) and t.startswith(s + ".")}
                members = self.table("topic_docs").filter(F.col("topic_id").isin(sorted(ids))).select("doc_id")
                documents = documents.join(members, "doc_id", "left_semi")
        f = dict(scope.get("filters") or {}) | dict(filters or {})
        documents = search.filtered(documents, f.get("doc_types") or (), f.get("sources") or (), f.get("languages") or (), f.get("extraction_quality") or ())
        if f.get("has_tables") is not None:
            tabular = self.table("pages").filter("has_table").select("doc_id")
            documents = documents.join(tabular, "doc_id", "left_semi" if f["has_tables"] else "left_anti")
        names = [n for k in ("entities", "organizations", "people", "locations") for n in f.get(k) or ()]
        return search.with_entities(documents, self.table("entities"), names) if names else documents

    # --- calls ---------------------------------------------------------------------------
    def orient_corpus(self, max_top_topics: int = 10, include_facets: bool = True, include_quality: bool = True, token_budget: int | None = None) -> dict:
        documents = self.table("documents")
        root = next(iter(self._topics), None)
        top = (self._children(root) or [self._topics[root]])[:max_top_topics] if root else []
        result = {"corpus_summary": {"doc_count": documents.count(), "page_count": self.table("pages").count(), "chunk_count": self.table("chunks").count()}, "top_topics": top, "root_scope": {"scope_id": "S-root", "kind": "corpus"}}
        if include_facets:
            result["facets"] = self._facets()
        if include_quality:
            result["quality"] = corpus.quality(documents, self.table("duplicates")).first().asDict()
        actions = [self.action("expand_topic", {"topic_id": t["topic_id"]}, "low", "See the topics below") for t in top]
        return self._envelope("orient_corpus", result, "orientation", token_budget or BUDGETS["orient"], actions=actions)

    def expand_topic(self, topic_id: str, max_children: int = 8, snippets_per_child: int = 2, docs_per_child: int = 3, include_neighbors: bool = True, token_budget: int | None = None) -> dict:
        topic = self._topic(topic_id)
        children = self._children(topic_id)[: max(0, max_children)]
        ids = [c["topic_id"] for c in children]
        docs, excerpts = self._representatives(ids, docs_per_child), self._snippets(ids, snippets_per_child)
        children = [c | {"representative_docs": docs[c["topic_id"]], "snippets": excerpts[c["topic_id"]]} for c in children]
        result = {"topic": topic, "children": children, "neighboring_topics": self._neighbours(topic_id) if include_neighbors else []}
        actions = [self.action("topic_card", {"topic_id": c["topic_id"]}, "medium", "Open the topic") for c in children]
        return self._envelope("expand_topic", result, "navigation", token_budget or BUDGETS["expand"], actions=actions)

    def topic_card(self, topic_id: str, snippets: int = 5, representative_docs: int = 8, include_facets: bool = True, include_neighbors: bool = True, include_quality: bool = True, token_budget: int | None = None) -> dict:
        topic = dict(self._topic(topic_id))
        if not include_quality:
            topic = {k: v for k, v in topic.items() if k not in QUALITY}
        members = self.table("topic_docs").filter(F.col("topic_id") == topic_id).select("doc_id")
        contrast = [r["term"] for r in self.table("contrast").filter(F.col("topic_id") == topic_id).orderBy("rank").collect()]
        named = [r.asDict() for r in self.table("topic_entities").filter(F.col("topic_id") == topic_id).orderBy("rank").collect()]
        result = topic | {"top_entities": named, "contrast_terms": contrast, "representative_docs": self._representatives([topic_id], representative_docs)[topic_id], "snippets": self._snippets([topic_id], snippets)[topic_id]}
        if include_neighbors:
            result["neighboring_topics"] = self._neighbours(topic_id)
        if include_facets:
            result["facets"] = self._facets(members)
        actions = [self.action("search_within", {"scope": {"topic_ids": [topic_id]}, "query": ""}, "medium", "Search the topic")]
        return self._envelope("topic_card", result, "navigation", token_budget or BUDGETS["topic"], ["Labels are drawn from word statistics; read the documents before relying on them."], actions)

    def search_within(self, scope: dict | None, query: str, result_level: str = "passage", max_results: int = 15, filters: dict | None = None, diversify: bool = True, include_snippets: bool = True, token_budget: int | None = None) -> dict:
        if result_level not in LEVELS:
            raise ValueError(f"result_level must be one of {LEVELS}")
        max_results = max(0, min(max_results, search.MOST_RESULTS))
        scope = self.resolve_scope(scope)
        in_scope = self.scope_documents(scope, filters)
        terms = search.query_terms(query)
        docs = in_scope.select(F.col("doc_id").alias("doc"))
        units = build.units_of(result_level, self.table("documents"), self.table("pages"), self.table("chunks"))
        mine = lambda name: self.table(f"{name}_{result_level}").join(docs, "doc", "left_semi")
        scored = materialize(search.bm25_postings(mine("postings"), mine("lengths"), terms), "scored")
        total = scored.count()
        info = self.table("documents").select(F.col("doc_id").alias("doc"), "title", "doc_type", "source_batch", "canonical_text")
        best = search.top_diversified(scored, info, "source_batch", max_results).drop("source_batch") if diversify else search.top(scored, max_results)
        placed = units.join(F.broadcast(best), "unit").drop("doc")  # at most MOST_RESULTS rows
        whole = F.col("canonical_text")
        hit = T.first_hit(whole, terms or [" "], F.col("char_start"), F.col("char_end"))
        span = T.excerpt_range(whole, F.col("h.start"), F.col("h.end"), 420, 650)
        rows = placed.join(info, placed["doc_id"] == info["doc"]).withColumns({"matched_terms": T.matched_terms(T.substring(whole, F.col("char_start"), F.col("char_end")), terms), "h": hit}).withColumn("s", span)
        rows = rows.select("rank", "doc_id", "title", "doc_type", "source_batch", "score", "page_number", "char_start", "char_end", "matched_terms", F.struct(F.col("s.start").alias("char_start"), F.col("s.end").alias("char_end"), T.substring(whole, F.col("s.start"), F.col("s.end")).alias("text")).alias("snippet"))
        results = [r.asDict(recursive=True) for r in rows.orderBy("rank").collect()]
        found = [r["doc_id"] for r in results]
        topics_of, named = self._rows_of("memberships", found, "rank"), self._rows_of("entities", found, "char_start", F.col("normalized_text").isin(terms or [""]))
        for r in results:
            if not include_snippets:
                r.pop("snippet")
            said = [e for e in named.get(r["doc_id"], ()) if e["normalized_text"] in {t.lower() for t in r["matched_terms"]}]
            r["matched_entities"] = list({(e["normalized_text"], e["type"], e["text"]): {"text": e["text"], "type": e["type"]} for e in said}.values())[:8]
            r["matched_entity_mention_count"], r["topic_memberships"] = len(said), topics_of.get(r["doc_id"], [])
            r["actions"] = [self.action("doc_card", {"doc_id": r["doc_id"]}, "low", "Open the document's card"), self.action("read_window", {"doc_id": r["doc_id"], "char_start": r["char_start"], "char_end": r["char_end"]}, "low", "Read round the hit")]
        hits = scored.select(F.col("doc").alias("doc_id")).distinct()
        refine = [r.asDict() for r in search.refinements(hits, self.scope_documents(scope).select("doc_id"), self.table("documents"), self.table("entities")).collect()]
        covered, size = len(set(found)), docs.count()
        result = {"scope": {k: v for k, v in scope.items() if k != "doc_ids"}, "query": query, "result_level": result_level, "total_estimated_matches": total, "results": results, "suggested_refinements": refine}
        warnings = ["The whole corpus was searched; a topic scope gives closer results."] if scope.get("kind") == "corpus" else []
        actions = [self.action("search_within", {"scope_id": scope["scope_id"], "query": query}, "low", "Search the scope again")]
        return self._envelope("search_within", result, "search_results", token_budget or BUDGETS["search"], warnings, actions, {"docs_referenced": covered, "docs_opened": 0, "scope_docs": size, "estimated_scope_doc_coverage": round(covered / size, 4) if size else 0.0})

    def _rows_of(self, name: str, doc_ids: list[str], order: str, of=None) -> dict[str, list[dict]]:
        """A table's rows of a few documents, by document."""
        out: dict[str, list[dict]] = {}
        rows = self.table(name).filter(F.col("doc_id").isin(doc_ids) & (of if of is not None else F.lit(True))) if doc_ids else self.table(name).limit(0)
        for r in rows.orderBy("doc_id", order).collect():
            out.setdefault(r["doc_id"], []).append(r.asDict())
        return out

    def doc_card(self, doc_id: str, include_page_map: bool = True, include_best_passages: bool = True, include_related_docs: bool = True, token_budget: int | None = None) -> dict:
        doc = self._doc(doc_id)
        mine = F.col("doc_id") == doc_id
        result = {k: doc[k] for k in ("doc_id", "title", "doc_type", "source_batch", "language", "source_uri", "original_filename", "extraction_method", "warnings", "ocr_confidence")}
        result["memberships"] = [r.asDict() for r in self.table("memberships").filter(mine).orderBy("rank").collect()]
        if include_page_map:
            mentions = self.table("entities").filter(mine).groupBy("page_number").agg(F.count("*").alias("mentions"))
            pages = self.table("pages").filter(mine).drop("text").join(mentions, "page_number", "left").join(self.table("page_signals").filter(mine).drop("doc_id"), "page_number", "left")
            result["page_map"] = [r.asDict() for r in pages.orderBy("page_number").collect()]
        if include_best_passages:
            result["best_passages"] = self._passages(doc)
        if include_related_docs:
            related = corpus.related(self.table("duplicates"), doc_id).join(self.table("documents").select(F.col("doc_id").alias("target_doc_id"), "title"), "target_doc_id")
            result["related_docs"] = [r.asDict() for r in related.orderBy("target_doc_id", "relation").collect()]
        actions = [self.action("read_pages", {"doc_id": doc_id, "pages": [1]}, "low", "Read the first page")]
        return self._envelope("doc_card", result, "triage", token_budget or BUDGETS["doc"], actions=actions, coverage={"docs_opened": 1})

    def _passages(self, doc: dict, n: int = 5) -> list[dict]:
        """Excerpts of a document that stand for its topics; if there are none, those of its first chunks."""
        mine = F.col("doc_id") == doc["doc_id"]
        rows = [r.asDict(recursive=True) for r in self.table("snippets").filter(mine).collect()]
        if rows:
            places = {t: i for i, t in enumerate(self._topics)}
            return [self._snippet(r["topic_id"], r) for r in sorted(rows, key=lambda r: (places[r["topic_id"]], r["rank"]))]
        text = F.lit(doc["canonical_text"])
        first = self.table("chunks").filter(mine).orderBy("char_start").limit(n).withColumn("r", T.excerpt_range(text, F.col("char_start"), F.col("char_end"), 420, 650))
        rows = first.select("doc_id", "page_number", F.col("r.start").alias("char_start"), F.col("r.end").alias("char_end"), T.stable_id("SNIP-DOC", 12, F.col("doc_id"), F.col("r.start"), F.col("r.end")).alias("snippet_id"))
        return [r.asDict() | {"text": doc["canonical_text"][r["char_start"] : r["char_end"]], "selection_reason": ["contains_representative_terms"], "snippet_warning": SNIPPET_WARNING} for r in rows.orderBy("char_start").collect()]

    def read_window(self, doc_id: str | None = None, page_number: int | None = None, char_start: int | None = None, char_end: int | None = None, snippet_id: str | None = None, context_chars_before: int = 700, context_chars_after: int = 700, max_chars: int | None = None) -> dict:
        """Text round a range, at most max_chars of it, the range in the middle where its context is cut."""
        most = min(max_chars or WINDOW, WINDOW_MOST)
        if snippet_id:
            head, page, start = snippet_id.rsplit("-", 2)
            known = [t for t in self._topics if head.startswith(f"SNIP-{t}-")]
            if not known or not start.isdigit():
                raise KeyError(f"unknown snippet_id: {snippet_id}")
            doc_id, page_number, char_start = head[len(f"SNIP-{max(known, key=len)}-") :], int(page[1:]), int(start)
            char_end = char_start + 450
        if doc_id is None or char_start is None:
            raise ValueError("read_window needs snippet_id, or doc_id and char_start")
        doc = self._doc(doc_id)
        text = doc["canonical_text"]
        low, high = max(0, min(char_start, len(text))), max(0, min(char_start if char_end is None else char_end, len(text)))
        high = max(low, high)
        start, end = max(0, low - max(0, context_chars_before)), min(len(text), high + max(0, context_chars_after))
        if end - start > most:
            start = max(0, low - max(0, most - (high - low)) // 2)
            end = min(len(text), start + most)
            if high > end:
                start, end = max(0, high - most), high
        start, end = S.trim(text, start, end)
        if page_number is None:
            page_number = next((i for i, r in enumerate(doc["ranges"], 1) if r["start"] <= low <= r["end"] or r["start"] <= high <= r["end"]), None)
        near = [self.action("read_window", {"doc_id": doc_id, "char_start": max(0, min(len(text), at))}, "low", what) for at, what in ((start - 1800, "Read before"), (end + 1800, "Read on")) if 0 < at < len(text) + 1800]
        result = {k: doc[k] for k in ("doc_id", "title", "doc_type", "source_batch")} | {"page_number": page_number, "char_start": start, "char_end": end, "text": text[start:end], "provenance": {"source_uri": doc["source_uri"], "pages": [page_number] if page_number else [], "char_start": start, "char_end": end}}
        return self._envelope("read_window", result, "evidence", actions=near, coverage={"docs_opened": 1, "pages_read": int(bool(page_number))})

    def read_pages(self, doc_id: str, pages: list[int], max_chars: int | None = None) -> dict:
        """Pages in the order asked for, at most 8 and max_chars characters."""
        if len(pages) > PAGES:
            raise ValueError(f"at most {PAGES} pages a call")
        left = min(max_chars or PAGES_CHARS, PAGES_MOST)
        doc = self._doc(doc_id)
        ranges, out, cut = doc["ranges"], [], False
        for n in pages:
            if not 1 <= n <= len(ranges):
                raise KeyError(f"{doc_id} has no page {n}")
            r = ranges[n - 1]
            if left <= 0:
                cut = True
                break
            text = doc["canonical_text"][r["start"] : r["end"]]
            cut |= len(text) > left
            text = text[:left]
            left -= len(text)
            out.append({"page_number": n, "char_start": r["start"], "char_end": r["start"] + len(text), "text": text})
        follow = [n for n in range(max(pages, default=0) + 1, len(ranges) + 1)][:4]
        actions = [self.action("read_pages", {"doc_id": doc_id, "pages": [n]}, "low", "Read a next page") for n in follow]
        result = {k: doc[k] for k in ("doc_id", "title", "doc_type", "source_batch")} | {"pages": out, "provenance": {"source_uri": doc["source_uri"], "pages": pages}}
        answer = self._envelope("read_pages", result, "evidence", warnings=["Cut to max_chars."] if cut else [], actions=actions, coverage={"docs_opened": 1, "pages_read": len(out)})
        answer["truncated"] |= cut
        return answer


class HybridIndex:
    """Chunks with vectors: keyword, vector and fused search."""

    def __init__(self, spark: SparkSession, hybrid_dir: str, embedder: hybrid.Embedder | None = None):
        read = lambda name: spark.read.parquet(f"{hybrid_dir}/{name}")
        self.chunks, self.postings, self.lengths = read("chunks"), read("postings"), read("lengths")
        row = read("meta").first()
        self.meta, self.centres = json.loads(row["meta"]), [list(c) for c in row["centres"]]
        self.embedder = embedder or hybrid.HashEmbedder(self.meta["embedding"]["dimension"])

    def search(self, query: str, mode: str = "hybrid", max_results: int = 10, doc_types=(), sources=(), entities=(), snippet_chars: int = 650, exact: bool = False) -> dict:
        """The best chunks.  Vectors in cells are sought in the nearest cells, or all if exact is asked for or filters are given."""
        if mode not in ("hybrid", "vector", "keyword"):
            raise ValueError("mode must be hybrid, vector or keyword")
        if not query.strip():
            raise ValueError("the query is empty")
        limit = max(0, min(max_results, search.MOST_RESULTS))
        snippet_chars = max(80, min(snippet_chars, 2000))
        rows = self.chunks
        for column, values in (("doc_type", doc_types), ("source_batch", sources)):
            if values:
                rows = rows.filter(F.col(column).isin(list(values)))
        names = [e.strip().lower() for e in entities if e.strip()]
        if names:
            rows = rows.filter(F.arrays_overlap("entity_keys", F.array(*map(F.lit, names))))
        wide, terms = max(limit + 1, 50), search.query_terms(query)
        narrowed = bool(doc_types or sources or names)
        scope = rows.select(F.col("chunk_id").alias("unit"))
        mine = lambda df: df.join(scope, "unit", "left_semi") if narrowed else df
        by_word = lambda: search.top(search.bm25_postings(mine(self.postings), mine(self.lengths), terms), wide).select("rank", F.col("unit").alias("chunk_id"), "score")

        def by_vector() -> DataFrame:
            vector = self.embedder.embed([query])[0]
            near = rows if exact or narrowed else hybrid.probed(rows, self.centres, vector)
            return hybrid.nearest(near, "chunk_id", "vector", vector, wide).withColumnRenamed("similarity", "score")

        ranked = by_word() if mode == "keyword" else by_vector() if mode == "vector" else hybrid.fuse(by_word(), by_vector(), "chunk_id", wide)
        text = F.col("text")
        hit = T.first_hit(text, terms or [query.lower()], F.lit(0), F.length("text"))
        s = T.excerpt_range(text, F.col("h.start"), F.col("h.end"), snippet_chars, snippet_chars)
        best = ranked.filter(F.col("rank") <= limit + 1).join(rows, "chunk_id").withColumn("h", hit).withColumn("s", s)
        best = best.select("rank", F.round("score", 6).alias("score"), "chunk_id", "doc_id", "title", "doc_type", "source_batch", "source_uri", "page_number", "entity_keys", (F.col("char_start") + F.col("s.start")).alias("char_start"), (F.col("char_start") + F.col("s.end")).alias("char_end"), T.substring(text, F.col("s.start"), F.col("s.end")).alias("snippet"), T.matched_terms(text, terms).alias("matched_terms"))
        found = [r.asDict() for r in best.orderBy("rank").collect()]
        for r in found:
            r["matched_entities"] = [e for e in r.pop("entity_keys") if e in names or e in query.lower()][:8]
        return {"query": query, "mode": mode, "filters": {"doc_types": list(doc_types), "sources": list(sources), "entities": list(entities)}, "results": found[:limit], "truncated": len(found) > limit, "index_summary": self.meta}


def descendants(index: CorpusIndex, topic_id: str) -> DataFrame:
    return topics.descendants(index.table("topics"), topic_id)
