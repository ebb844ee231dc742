"""Text functions as Column expressions.  Offsets are code points from 0; ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic, and what counts as a word of lower-cased text.
STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each few for from further had has have having he her here hers herself him "
    "himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other "
    "our ours ourselves out over own same she should so some such than that the their theirs them themselves then there "
    "these they this those through to too under until up very was we were what when where which while who whom why will "
    "with would you your yours yourself yourselves"
).split()
WORD = r"[a-z][a-z0-9_'-]{1,}|\$?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"
LINE = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"
SPACE = r"[\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LONGEST_WORD = 40


#: WORD without the quotes, underscores and hyphens that would be dropped at its end.
_TRIMMED = r"[a-z][a-z0-9_'-]*[a-z0-9]|\$?\p{Nd}[\p{Nd},]*(?:\.\p{Nd}+)?"


def tokens(text: Column, keep_stopwords: bool = False) -> Column:
    """Lower-cased words of 2 to 40 characters, outer quotes, underscores and hyphens dropped, without stopwords."""
    words = F.regexp_extract_all(F.lower(text), F.lit(_TRIMMED), F.lit(0))

    def kept(x: Column) -> Column:
        fits = F.length(x).between(2, LONGEST_WORD)
        return fits if keep_stopwords else fits & ~x.isin(STOPWORDS)

    return F.coalesce(F.filter(words, kept), F.array().cast("array<string>"))


def lexical_terms(words: Column) -> Column:
    """The words, then the pairs of neighbours among them."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 1, F.concat(words, pairs)).otherwise(words)


def normalize(text: Column) -> Column:
    """Line ends to LF, NUL dropped, blanks to one space, four or more LF to three, outer white space dropped."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"\x00", "")
    t = F.regexp_replace(t, r"[ \t\r\f\x0B]+", " ")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    return strip(t)


def strip(text: Column) -> Column:
    """Unicode white space dropped at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def estimate_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded up, at least 1."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def stable_id(prefix: str, length: int, *parts: Column) -> Column:
    """prefix-HASH: the first hexadecimal digits of SHA-1 over the parts, joined by U+001F."""
    joined = F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.concat(F.lit(prefix + "-"), F.upper(F.substring(F.sha1(joined.cast("binary")), 1, length)))


def substring(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, (start + 1).cast("int"), (end - start).cast("int"))


def trim_range(text: Column, start: Column, end: Column) -> Column:
    """struct(start, end): a range within the text, shrunk over white space at both ends."""
    n = F.length(text)
    s = F.greatest(F.lit(0), F.least(start, n)).cast("long")
    e = F.greatest(s, F.least(end, n)).cast("long")
    part = substring(text, s, e)
    left = F.length(part) - F.length(F.regexp_replace(part, f"^{SPACE}+", ""))
    right = F.length(part) - F.length(F.regexp_replace(part, f"{SPACE}+$", ""))
    return F.struct((s + left).cast("long").alias("start"), F.greatest(s + left, e - right).cast("long").alias("end"))


def excerpt_range(text: Column, hit_start: Column, hit_end: Column, target: int, most: int) -> Column:
    """struct(start, end): about ``target`` characters round a hit, moved to near line ends, at most ``most``."""
    target = min(target, most)
    n = F.length(text)
    s = F.greatest(F.lit(0), F.floor((hit_start + hit_end) / 2) - target // 2)
    e = F.least(n, s + target)
    s = F.greatest(F.lit(0), e - target)
    back = F.instr(F.reverse(substring(text, F.greatest(F.lit(0), s - 119), s + 1)), "\n")
    ahead = F.instr(substring(text, e, F.least(n, e + 120)), "\n")
    s = F.when(back > 0, s + 2 - back).otherwise(s)
    e = F.when(ahead > 0, e + ahead - 1).otherwise(e)
    return trim_range(text, s, F.least(e, s + most))


def first_hit(text: Column, terms: list[str], start: Column, end: Column) -> Column:
    """struct(start, end): where the first of terms that occurs in [start, end) does; else the range's first character."""
    lowered = F.lower(substring(text, start, end))
    found = F.lit(None)
    for t in reversed(list(dict.fromkeys(terms))):
        at = F.instr(lowered, t)
        found = F.when(at > 0, F.struct((start + at - 1).cast("long").alias("start"), (start + at - 1 + len(t)).cast("long").alias("end"))).otherwise(found)
    return F.coalesce(found, F.struct(start.cast("long").alias("start"), F.least(end, start + 1).cast("long").alias("end")))


def matched_terms(text: Column, terms: list[str]) -> Column:
    """Those of terms that the text contains, as substrings, in the given order."""
    lowered = F.lower(text)
    return F.array_compact(F.array(*[F.when(F.contains(lowered, F.lit(t.lower())), F.lit(t)) for t in dict.fromkeys(terms)]).cast("array<string>"))


def title(text: Column, fallback: Column) -> Column:
    """The first line of 4 to 120 characters once stripped; else the fallback."""
    lines = F.transform(F.split(text, LINE, -1), strip)
    return F.coalesce(F.get(F.filter(lines, lambda x: F.length(x).between(4, 120)), F.lit(0)), fallback)


def looks_tabular(text: Column) -> Column:
    """Whether two lines have a tab, two bars or four commas."""
    many = lambda x, c, k: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit(""))) >= k
    lines = F.filter(F.split(text, LINE, -1), lambda x: (strip(x) != "") & (many(x, "\t", 1) | many(x, "|", 2) | many(x, ",", 4)))
    return F.size(lines) >= 2


def doc_type(path: Column) -> Column:
    """The kind of document a file name's suffix tells."""
    suffix = F.lower(F.regexp_extract(path, r"[^/.](\.[^./]+)$", 1))
    kinds = {
        "pdf": (".pdf",),
        "email": (".eml", ".msg"),
        "spreadsheet": (".csv", ".tsv", ".xlsx", ".xls"),
        "word_doc": (".doc", ".docx", ".rtf"),
        "presentation": (".ppt", ".pptx"),
        "image": (".png", ".jpg", ".jpeg", ".gif", ".tif", ".tiff", ".bmp", ".webp"),
        "html": (".html", ".htm"),
        "text": (".txt", ".md", ".markdown", ".rst", ".json", ".jsonl", ".xml", ".yaml", ".yml", ".log"),
    }
    out = F.lit("unknown")
    for kind, suffixes in kinds.items():
        out = F.when(suffix.isin(*suffixes), kind).otherwise(out)
    return out


def fingerprint(text: Column, words: int = 30) -> Column:
    """The first words of a text, by which excerpts that say the same are told."""
    return F.concat_ws(" ", F.slice(tokens(text), 1, words))


def window_range(text: Column, low: Column, high: Column, before: int, after: int, most: int) -> Column:
    """struct(start, end): a range with its context, at most ``most`` characters; where that is too much the range is put in the middle."""
    n = F.length(text)
    start, end = F.greatest(F.lit(0), low - before), F.least(n, high + after)
    middle = F.greatest(F.lit(0), low - F.floor(F.greatest(F.lit(0), most - (high - low)) / 2))
    wide = end - start > most
    s = F.when(wide, middle).otherwise(start)
    e = F.when(wide, F.least(n, middle + most)).otherwise(end)
    return trim_range(text, F.when(high > e, F.greatest(F.lit(0), high - most)).otherwise(s), F.greatest(e, high))


def page_signals(text: Column, has_table: Column, types: Column, top_terms: Column, most: int = 5) -> Column:
    """What a page seems to hold; types are those of its mentions."""
    low = F.lower(text)
    said = [
        F.when(has_table, F.lit("possible table")),
        F.when(F.array_contains(types, "money"), F.lit("money amounts")),
        F.when(F.array_contains(types, "email"), F.lit("email addresses")),
        F.when(F.contains(low, F.lit("subject:")) & F.contains(low, F.lit("from:")), F.lit("email header")),
        F.when(F.size(top_terms) > 0, F.concat(F.lit("top terms: "), F.array_join(F.slice(top_terms, 1, 3), " / "))),
    ]
    return F.slice(F.array_compact(F.array(*said)), 1, most)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def topic_path(topic_id: Column) -> Column:
    """A dotted topic id as numbers, for numeric order."""
    return F.transform(F.filter(F.split(topic_id, r"\."), lambda x: x.rlike(r"^v?[0-9]+$")), lambda x: F.regexp_replace(x, "^v", "").cast("int"))
