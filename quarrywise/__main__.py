"""python -m quarrywise: build an index and ask it, from the command line."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


def _size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024 or unit == "GB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return ""


def _duration(seconds: float) -> str:
    m, s = divmod(int(seconds), 60)
    return f"{m // 60}h {m % 60}m" if m >= 60 else f"{m}m {s}s" if m else f"{s}s"


def _progress(event: dict) -> None:
    extra = f" after {_duration(event['seconds'])}" if "seconds" in event else ""
    print(f"{event['event']} {event.get('table', '')}{extra}", file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarrywise")
    top.add_argument("--json", action="store_true", help="print JSON instead of Markdown")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple) -> None:
        command = sub.add_parser(name)
        for flag, options in args:
            command.add_argument(flag, **options)

    index = ("--index", {"required": True})
    add("build", ("source", {}), index, ("--corpus-id", {"default": "corpus"}), ("--version", {"default": "v1"}))
    add("orient", index, ("--topics", {"type": int, "default": 10}), ("--budget", {"type": int}))
    add("expand-topic", index, ("topic_id", {}), ("--children", {"type": int, "default": 8}))
    add("topic-card", index, ("topic_id", {}), ("--snippets", {"type": int, "default": 5}))
    add("search", index, ("query", {}), ("--scope-id", {}), ("--topic-id", {}), ("--level", {"default": "passage"}), ("--results", {"type": int, "default": 15}), ("--source", {"action": "append"}), ("--doc-type", {"action": "append"}), ("--entity", {"action": "append"}))
    add("doc-card", index, ("doc_id", {}))
    add("read-window", index, ("--doc-id", {}), ("--snippet-id", {}), ("--start", {"type": int}), ("--end", {"type": int}), ("--max-chars", {"type": int}))
    add("read-pages", index, ("doc_id", {}), ("pages", {"type": int, "nargs": "+"}), ("--max-chars", {"type": int}))
    add("hybrid-build", index, ("--out", {"required": True}))
    add("hybrid-search", ("--hybrid", {"required": True}), ("query", {}), ("--mode", {"default": "hybrid"}), ("--results", {"type": int, "default": 10}), ("--source", {"action": "append"}), ("--doc-type", {"action": "append"}), ("--entity", {"action": "append"}))
    return top


def run(a: argparse.Namespace, spark: SparkSession) -> dict:
    from quarrywise.plans import build
    from quarrywise.plans.api import CorpusIndex, HybridIndex

    if a.command == "build":
        return {"tool_name": "build", "result": build.build_index(spark, a.source, a.index, a.corpus_id, a.version, progress=_progress).__dict__}
    if a.command == "hybrid-build":
        return {"tool_name": "hybrid_build", "result": build.build_hybrid(spark, a.index, a.out)}
    if a.command == "hybrid-search":
        return {"tool_name": "hybrid_search", "result": HybridIndex(spark, a.hybrid).search(a.query, a.mode, a.results, a.doc_type or (), a.source or (), a.entity or ())}
    index = CorpusIndex(spark, a.index)
    if a.command == "orient":
        return index.orient_corpus(a.topics, token_budget=a.budget)
    if a.command == "expand-topic":
        return index.expand_topic(a.topic_id, a.children)
    if a.command == "topic-card":
        return index.topic_card(a.topic_id, a.snippets)
    if a.command == "search":
        scope = {"scope_id": a.scope_id} if a.scope_id else {"topic_ids": [a.topic_id]} if a.topic_id else {"kind": "corpus"}
        filters = {k: v for k, v in (("sources", a.source), ("doc_types", a.doc_type), ("entities", a.entity)) if v}
        return index.search_within(scope, a.query, a.level, a.results, filters)
    if a.command == "doc-card":
        return index.doc_card(a.doc_id)
    if a.command == "read-window":
        return index.read_window(doc_id=a.doc_id, snippet_id=a.snippet_id, char_start=a.start, char_end=a.end, max_chars=a.max_chars)
    return index.read_pages(a.doc_id, a.pages, a.max_chars)


def main(argv: list[str] | None = None) -> int:
    from quarrywise.plans.render import markdown

    a = parser().parse_args(argv)
    try:
        answer = run(a, SparkSession.builder.appName("quarrywise").getOrCreate())
    except (KeyError, ValueError, RuntimeError) as e:
        print(json.dumps({"error": {"type": type(e).__name__, "message": str(e)}}), file=sys.stderr)
        return 1
    print(json.dumps(answer, ensure_ascii=False, default=str, indent=2) if a.json else markdown(answer))
    return 0


if __name__ == "__main__":
    sys.exit(main())
