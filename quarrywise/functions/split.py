"""Splitting texts into pages, and pages into chunks: loops whose next step depends on the last."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import pairwise

PAGE_CHARS = 7000
TARGET, LEAST, MOST = 1800, 500, 3500


def normalize(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    text = re.sub(r"[ \t\r\f\v]+", " ", text)
    return re.sub(r"\n{4,}", "\n\n\n", text).strip()


class Breaks:
    """Where a text may be cut: before any of some separators, the preferred one first."""

    def __init__(self, text: str, separators: tuple[str, ...]):
        self.places = [([m.start() for m in re.finditer(f"(?={re.escape(s)})", text)], len(s)) for s in separators]

    def last(self, low: int, high: int) -> int | None:
        """The last separator of the best kind that lies within [low, high)."""
        for places, size in self.places:
            i = bisect_right(places, high - size) - 1
            if i >= 0 and places[i] >= low:
                return places[i]
        return None


def pages(text: str, most: int = PAGE_CHARS) -> list[str]:
    """Pages at form feeds if there are any, else of at most ``most`` characters, cut at the last blank line or line end of a page's second half."""
    if "\f" in text:
        return list(filter(None, map(normalize, text.split("\f"))))
    if len(text) <= most:
        return [text]
    breaks, cuts = Breaks(text, ("\n\n", "\n")), [0]
    while len(text) - cuts[-1] > most:
        cut = breaks.last(cuts[-1] + most // 2, cuts[-1] + most)
        cuts.append(cuts[-1] + most if cut is None else cut)
    parts = (text[a:b].strip() for a, b in pairwise([*cuts, len(text)]))
    return [p for p in parts if p]


def canonical(raw: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """The text of stripped pages joined by a form feed on a line of its own, and each page's range."""
    parts = [p.strip() for p in raw] or [""]
    ranges, at = [], 0
    for p in parts:
        ranges.append((at, at + len(p)))
        at += len(p) + 3
    return "\n\f\n".join(parts), ranges


def trim(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    left = len(part) - len(part.lstrip())
    return (start + left, start + left + len(part.strip()))


def chunks(text: str, start: int, end: int, target: int = TARGET, least: int = LEAST, most: int = MOST) -> list[tuple[int, int]]:
    """Ranges of chunks of one page: each but the last ends at the last blank line, line end or blank between ``least`` and ``most``, else at ``target``."""
    breaks, cuts = Breaks(text, ("\n\n", "\n", " ")), [start]
    while end - cuts[-1] > target:
        cut = breaks.last(min(end, cuts[-1] + least), min(end, cuts[-1] + most))
        cuts.append(cuts[-1] + target if cut is None else cut)
    ranges = (trim(text, a, b) for a, b in pairwise([*cuts, end]))
    return [(a, b) for a, b in ranges if a < b]
