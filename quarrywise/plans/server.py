"""A tool server over standard input and output: a JSON object {"tool", "args"} a line, an answer a line.

    python -m quarrywise.plans.server

The index is named by QUARRYWISE_INDEX, the hybrid one by QUARRYWISE_HYBRID_INDEX.
"""

from __future__ import annotations

import json
import sys
from typing import TextIO

from quarrywise.plans import tools

TOOLS = {f.__name__: f for f in (tools.orient, tools.expand_topic, tools.topic_card, tools.search, tools.doc_card, tools.read_window, tools.read_pages, tools.hybrid_search)}


def answer(line: str) -> dict:
    """The result of one request, or its error."""
    try:
        request = json.loads(line)
        return {"id": request.get("id"), "result": TOOLS[request["tool"]](**request.get("args") or {})}
    except Exception as e:  # a bad request must not end the server
        return {"error": {"type": type(e).__name__, "message": str(e)}}


def main(source: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    for line in filter(str.strip, source):
        print(json.dumps(answer(line), ensure_ascii=False, default=str), file=out, flush=True)


if __name__ == "__main__":
    main()
