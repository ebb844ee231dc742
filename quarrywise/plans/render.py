"""Answers as Markdown."""

from __future__ import annotations

_TITLES = {"orient_corpus": "Corpus", "expand_topic": "Topic", "topic_card": "Topic card", "search_within": "Search", "doc_card": "Document", "read_window": "Window", "read_pages": "Pages"}


def _value(v) -> str:
    if isinstance(v, dict):
        return ", ".join(f"{k}: {_value(x)}" for k, x in v.items() if x not in (None, [], {}))
    if isinstance(v, (list, tuple)):
        return ", ".join(map(_value, v))
    return f"{v:g}" if isinstance(v, float) else " ".join(str(v).split())


def _item(x) -> str:
    if not isinstance(x, dict):
        return f"- {_value(x)}"
    head = x.get("title") or x.get("topic_id") or x.get("neighbour") or x.get("doc_id") or x.get("value") or x.get("page_number") or ""
    rest = {k: v for k, v in x.items() if k not in ("title", "text", "snippet", "snippets", "actions") and v not in (None, [], {}, head)}
    lines = [f"- **{_value(head)}** {_value(rest)}".rstrip()]
    body = x.get("text") or (x.get("snippet") or {}).get("text") if not isinstance(x.get("snippet"), str) else x["snippet"]
    if body:
        lines += [f"  > {line}" for line in str(body).splitlines() if line.strip()]
    return "\n".join(lines + [f"  > {_value(s.get('text', ''))}" for s in x.get("snippets") or ()])


def markdown(answer: dict) -> str:
    """An envelope as headed sections: scalars in one list, each list and record under its name."""
    result = answer.get("result", answer)
    out = [f"# {_TITLES.get(answer.get('tool_name'), answer.get('tool_name', 'Result'))}", ""]
    flat = {k: v for k, v in result.items() if not isinstance(v, (list, dict)) and k != "text" and v is not None}
    out += [f"- {k}: {_value(v)}" for k, v in flat.items()]
    if isinstance(result.get("text"), str):
        out += ["", result["text"]]
    for k, v in result.items():
        if isinstance(v, dict) and v:
            out += ["", f"## {k.replace('_', ' ').capitalize()}", "", *(f"- {n}: {_value(x)}" for n, x in v.items())]
        elif isinstance(v, list) and v:
            out += ["", f"## {k.replace('_', ' ').capitalize()}", "", *map(_item, v)]
    for k in ("warnings", "actions"):
        if answer.get(k):
            out += ["", f"## {k.capitalize()}", "", *(f"- {_value(x)}" for x in answer[k])]
    return "\n".join(out) + "\n"
