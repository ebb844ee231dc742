"""Licence recognition by sentences and rules, with DataFrame functions only.

A text is put in running form: ASCII lower case, comment marks at line starts dropped, single line ends joined.
Sentences end at blank lines and after . ! ? ; before white space (but not after "v."); in them everything but
a-z, 0-9, + and . becomes single spaces.  All known sentences (SENTENCES) that a sentence holds give their
identifiers in order, so one sentence may give several; an SPDX expression gives one for each of its licences.
A sentence with a licence word (WORDS) and no identifier is UNKNOWN.  The document's identifiers, in order, are
matched with the ordered RULES: each rule that finds its sequence in what is left (UNKNOWN and SUPPORT may lie
between) takes it out, every time it occurs, and names its licence.  LAST holds rules for documents where none did.
What is left, but for SUPPORT beside a licence, is ``UNMATCHED``; a denied grant names nothing.

A text or sentence is passed over only if it holds none of STEMS, and every known sentence and licence word holds one
(two-word stems, of names that need no word like "license" beside them, must stand on one line).
One narrow pass, no shuffle, nothing collected.

Nulls and texts without licence words have no sentences and no licence.  Very long texts are read whole.  Repeated rows
are judged alike; an empty table gives no rows.  Columns named as the outputs are replaced; others stay.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Licences with names: identifier, licence, how it is named in normalised text, and stems of which that holds one; the more special first.
_V = r"(?: v| version| v\.)? ?"
_GNU = r"(?:the )?(?:gnu )?"
_CC = r"(?:cc|creative commons)(?: licen[cs]e)? (?:by|attribution)"
_NC, _ND, _SA = r" (?:nc|non ?commercial)", r" (?:nd|no ?deriv(?:ative)?s)", r" (?:sa|share ?alike)"
NAMES = (
    ("mit-0", "MIT-0", r"mit 0\b|mit no attribution", ("mit",)),
    ("mit", "MIT", r"(?:mit|expat)(?: x11)? licen[cs]e", ("mit", "expat")),
    ("apache2", "Apache-2.0", r"apache(?: software)?(?: licen[cs]e)?" + _V + r"2(?:\.0)?\b", ("apache",)),
    ("agpl3", "AGPL-3.0", _GNU + r"(?:affero general public licen[cs]e|agpl)" + _V + r"3(?:\.0)?\b", ("affero", "agpl")),
    ("agpl", "AGPL", _GNU + r"affero general public licen[cs]e\b", ("affero", "agpl")),
    ("lgpl21", "LGPL-2.1", _GNU + r"(?:(?:lesser|library) general public licen[cs]e|lgpl)" + _V + r"2\.1\b", ("lesser", "library", "lgpl")),
    ("lgpl3", "LGPL-3.0", _GNU + r"(?:(?:lesser|library) general public licen[cs]e|lgpl)" + _V + r"3(?:\.0)?\b", ("lesser", "library", "lgpl")),
    ("lgpl", "LGPL", _GNU + r"(?:lesser|library) general public licen[cs]e\b", ("lesser", "library", "lgpl")),
    ("gpl3", "GPL-3.0", _GNU + r"(?:general public licen[cs]e|gpl)" + _V + r"3(?:\.0)?\b", ("general public", "gpl")),
    ("gpl2", "GPL-2.0", _GNU + r"(?:general public licen[cs]e|gpl)" + _V + r"2(?:\.0)?\b", ("general public", "gpl")),
    ("gpl", "GPL", _GNU + r"general public licen[cs]e\b", ("general public", "gpl")),
    ("bsd3", "BSD-3-Clause", r"(?:3 clause|three clause|new|modified|revised) bsd(?: licen[cs]e)?\b|bsd 3 clause(?: licen[cs]e)?", ("bsd",)),
    ("bsd2", "BSD-2-Clause", r"(?:2 clause|two clause|simplified) bsd(?: licen[cs]e)?\b|bsd 2 clause(?: licen[cs]e)?", ("bsd",)),
    ("bsd", "BSD", r"bsd(?: style)? licen[cs]e", ("bsd",)),
    ("mpl2", "MPL-2.0", r"(?:mozilla public licen[cs]e|mpl)" + _V + r"2(?:\.0)?\b", ("mozilla", "mpl")),
    ("epl2", "EPL-2.0", r"eclipse public licen[cs]e" + _V + r"2(?:\.0)?\b", ("eclipse",)),
    ("isc", "ISC", r"isc licen[cs]e", ("isc",)),
    ("zlib", "Zlib", r"zlib(?: libpng)? licen[cs]e", ("zlib",)),
    ("bsl", "BSL-1.0", r"boost software licen[cs]e", ("boost",)),
    ("cc-by-nc-sa", "CC-BY-NC-SA", _CC + _NC + _SA, ("cc by", "cc licen", "commons")),
    ("cc-by-nc-nd", "CC-BY-NC-ND", _CC + _NC + _ND, ("cc by", "cc licen", "commons")),
    ("cc-by-nc", "CC-BY-NC", _CC + _NC, ("cc by", "cc licen", "commons")),
    ("cc-by-nd", "CC-BY-ND", _CC + _ND, ("cc by", "cc licen", "commons")),
    ("cc-by-sa", "CC-BY-SA", _CC + _SA, ("cc by", "cc licen", "commons")),
    ("cc-by", "CC-BY", _CC, ("cc by", "cc licen", "commons")),
    ("cc0", "CC0-1.0", r"(?:cc ?0|creative commons zero)(?: 1\.0)?(?: universal)?\b", ("cc0", "cc 0", "commons zero")),
    ("unlicense", "Unlicense", r"(?:the )?unlicen[cs]e\b", ("unlicen",)),
)
#: What names a licence after a grant without more words: initials, and words that need "licensed".
_LICENSED = r"licen[cs]ed(?: [a-z]+)? under (?:the )?(?:terms (?:and conditions )?of )?(?:either )?(?:of )?(?:the |a |an )?"
_INITIALS = {x: rf"(?:gnu )?{x}\b" for x in ("agpl", "lgpl", "gpl")}
_SHORT = {"mit": r"(?:mit|expat)\b(?: licen[cs]e)?", "isc": r"isc\b(?: licen[cs]e)?", "bsd": r"bsd\b(?: licen[cs]e)?"}
_GIVEN = r"(?:licen[cs]ed|released|distributed|available|covered|published|provided|offered)"
_GRANT = _GIVEN + r"(?: [a-z]+)? (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:either )?(?:of )?(?:the |a |an )?"
_MORE = r"\b(?:and|or) (?:the )?"
#: SPDX identifiers as normalised text has them: licence and form, the longer first.
_LATER, _ONLY = r"(?:\+| or later\b)", r"(?: only)?\b"
SPDX = (
    *((f"{name}-{v}{'-or-later' if late == _LATER else ''}", f"{name.lower()} {v.replace('.', chr(92) + '.')}{late}") for name, versions in (("AGPL", ("3.0",)), ("LGPL", ("2.0", "2.1", "3.0")), ("GPL", ("2.0", "3.0"))) for v in versions for late in (_LATER, _ONLY)),
    *((f"CC-{kind.upper().replace(' ', '-')}", rf"cc {kind} [1-4]\.0") for kind in ("by nc sa", "by nc nd", "by nc", "by nd", "by sa", "by")),
    ("CC0-1.0", r"cc0 1\.0"),
    ("MIT-0", "mit 0"),
    ("MIT", "mit"),
    ("Apache-2.0", r"apache 2\.0"),
    ("BSD-3-Clause", "bsd 3 clause"),
    ("BSD-2-Clause", "bsd 2 clause"),
    ("0BSD", "0bsd"),
    ("ISC", "isc"),
    ("MPL-2.0", r"mpl 2\.0"),
    ("EPL-2.0", r"epl 2\.0"),
    ("BSL-1.0", r"bsl 1\.0"),
    ("Zlib", "zlib"),
    ("Unlicense", "unlicense"),
)
_SPDX_ANY = "(?:" + "|".join(p if p.endswith((r"\b", r"\b)")) else p + r"\b" for _, p in SPDX) + ")"
_TAG = "spdx license identifier "
_EXPRESSION = _TAG + rf"{_SPDX_ANY}(?: (?:and|or) {_SPDX_ANY})*(?: with [a-z]+ exception(?: [0-9.]+)?)?"
#: Known sentences: identifier, pattern over a normalised sentence, and stems of which a match holds one; of those that
#: begin at one place the first counts.
SENTENCES = (
    ("denied", r"\b(?:not|never|no longer|nor)(?: [a-z]+){0,2} (?:" + _GIVEN + r" (?:under|by) [a-z0-9+. ]{0,60}?(?:licen[cs]e|gpl)|licen[cs]ed under [a-z0-9+. ]{0,60}?(?:mit|isc|bsd|cc by))\b(?: version [0-9.]+| [0-9.]+)?", ("not ", "never ", "no longer ", "nor ")),
    ("spdx", _EXPRESSION, ("spdx license",)),
    ("apache2-grant", r"licensed under the apache license version 2(?:\.0)?\b", ("licensed under the apache license version 2",)),
    ("apache2-file", r"you may not use this file except in compliance with the license", ("you may not use this file except in compliance with the license",)),
    ("apache2-copy", r"you may obtain a copy of the license at", ("you may obtain a copy of the license at",)),
    ("apache2-url", r"apache\.org licenses license 2\.0", ("org licenses license 2",)),
    ("apache2-basis", r"distributed under the license is distributed on an as is basis", ("distributed under the license is distributed on an as is basis",)),
    ("apache2-see", r"see the license for the specific language governing permissions", ("see the license for the specific language governing permissions",)),
    ("agpl-modify", r"redistribute it and or modify it under the terms of (?:version [0-9.]+ of )?the gnu affero general public license", ("under the terms of",)),
    ("lgpl-modify", r"redistribute it and or modify it under the terms of (?:version [0-9.]+ of )?the gnu (?:lesser|library) general public license", ("under the terms of",)),
    ("gpl-modify", r"redistribute it and or modify it under the terms of (?:version [0-9.]+ of )?the gnu general public license", ("under the terms of",)),
    ("gnu-3-later", r"version 3(?:\.0)? of the license or at your option any later version", ("of the license or at your option any later version",)),
    ("gnu-21-later", r"version 2\.1 of the license or at your option any later version", ("1 of the license or at your option any later version",)),
    ("gnu-2-later", r"version 2(?:\.0)? of the license or at your option any later version", ("of the license or at your option any later version",)),
    ("gnu-3", r"version 3(?:\.0)? of the license", ("of the license",)),
    ("gnu-21", r"version 2\.1 of the license", ("1 of the license",)),
    ("gnu-2", r"version 2(?:\.0)? of the license", ("of the license",)),
    ("gnu-hope", r"distributed in the hope that it will be useful but without any warranty", ("distributed in the hope that it will be useful but without any warranty",)),
    ("gnu-merchant", r"without even the implied warranty of merchantability or fitness for a particular purpose", ("without even the implied warranty of merchantability or fitness for a particular purpose",)),
    ("gnu-details", r"see the gnu (?:[a-z]+ )?general public license for more details", ("general public license for more details",)),
    ("gnu-copy", r"you should have received a copy of the gnu (?:[a-z]+ )?general public license", ("you should have received a copy of the gnu",)),
    ("boost-permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy", ("permission is hereby granted free of charge to any person or organization obtaining a copy",)),
    ("mit-permission", r"permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted free of charge to any person obtaining a copy",)),
    ("mit-notice", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included", ("the above copyright notice and this permission notice",)),
    ("mit-warranty", r"the software is provided as is without warranty of any kind", ("the software is provided as is without warranty of any kind",)),
    ("mit-liability", r"in no event shall the (?:authors|copyright holders)(?: or copyright holders)? be liable", ("in no event shall the",)),
    ("isc-permission", r"permission to use copy modify and or distribute this software for any purpose", ("permission to use copy modify and or distribute this software for any purpose",)),
    ("isc-notice", r"provided that the above copyright notice and this permission notice appear in all copies", ("provided that the above copyright notice and this permission notice appear in all copies",)),
    ("isc-warranty", r"the software is provided as is and the author disclaims all warranties", ("the software is provided as is and the author disclaims all warranties",)),
    ("zlib-permission", r"permission is granted to anyone to use this software for any purpose", ("permission is granted to anyone to use this software for any purpose",)),
    ("zlib-warranty", r"this software is provided as is without any express or implied warranty", ("this software is provided as is without any express or implied warranty",)),
    ("bsd-grant", r"redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms with or without modification are permitted",)),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice", ("redistributions of source code must retain the above copyright notice",)),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice", ("redistributions in binary form must reproduce the above copyright notice",)),
    ("bsd-advertise", r"all advertising materials mentioning features or use of this software must display", ("all advertising materials mentioning features or use of this software must display",)),
    ("bsd-endorse", r"may be used to endorse or promote products derived from this software", ("may be used to endorse or promote products derived from this software",)),
    ("bsd-warranty", r"this software is provided by (?:the )?(?:[a-z]+ ){1,6}as is", ("this software is provided by",)),
    ("bsd-liability", r"in no event shall the copyright (?:holder|owner)s? or contributors be liable", ("in no event shall the copyright",)),
    ("mpl2-grant", r"subject to the terms of the mozilla public license v(?:ersion)?\.? ?2\.0", ("mozilla public license",)),
    ("cc0-waiver", r"waived all copyright and related or neighboring rights", ("waived all copyright and related or neighboring rights",)),
    ("unlicense-free", r"free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", ("the public domain",)),
    *((f"{i}-named", (rf"{_LICENSED}{_SHORT[i]}|" if i in _SHORT else rf"{_GRANT}{_INITIALS[i]}|{_INITIALS[i]} licen[cs]ed\b|" if i in _INITIALS else "") + rf"{_GRANT}(?:{p})|{_MORE}(?:{p})|^(?:{p})(?:(?: version)? [0-9.]+)?(?: international| universal)?$|(?:{p}) licen[cs]ed\b", stems) for i, _, p, stems in NAMES),
    ("confidential", r"proprietary and confidential|confidential and proprietary", ("confidential",)),
    ("reserved", r"all rights reserved", ("all rights reserved",)),
    ("copyright", r"\bcopyright(?: c)?(?: by)? (?:19|20)[0-9]{2}\b|^copyright\b", ("copyright",)),
)
UNKNOWN, UNMATCHED = "UNKNOWN", "UNMATCHED"
#: Identifiers that go with licences and name none.
SUPPORT = ("apache2-file", "apache2-copy", "apache2-url", "apache2-basis", "apache2-see", "gnu-3-later", "gnu-21-later", "gnu-2-later", "gnu-3", "gnu-21", "gnu-2", "gnu-hope", "gnu-merchant", "gnu-details", "gnu-copy", "mit-notice", "mit-warranty", "mit-liability", "isc-notice", "isc-warranty", "zlib-warranty", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability", "public-domain", "reserved", "copyright")
#: Ordered rules: the licence and the identifiers that must follow one another.
RULES = (
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertise")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD", ("bsd-grant",)),
    ("MIT", ("mit-permission", "mit-notice")),
    ("MIT-0", ("mit-permission", "mit-warranty")),
    ("MIT", ("mit-permission",)),
    ("BSL-1.0", ("boost-permission",)),
    ("ISC", ("isc-permission", "isc-notice")),
    ("0BSD", ("isc-permission",)),
    ("Zlib", ("zlib-permission",)),
    *((f"{name}-{v}{late}", (f"{name.lower()}-modify", f"gnu-{v[0] if v != '2.1' else '21'}{'-later' if late else ''}")) for name in ("AGPL", "LGPL", "GPL") for v in ("3.0", "2.1", "2.0") for late in ("-or-later", "")),
    *((name, (f"{name.lower()}-modify",)) for name in ("AGPL", "LGPL", "GPL")),
    ("Apache-2.0", ("apache2-grant",)),
    ("MPL-2.0", ("mpl2-grant",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("Unlicense", ("unlicense-free",)),
    *((name, (f"spdx-{name.lower()}",)) for name, _ in SPDX),
    *((name, (f"{i}-named",)) for i, name, _, _ in NAMES),
)
LAST = (("Apache-2.0", ("apache2-file",)), ("Public-Domain", ("public-domain",)), ("Proprietary", ("confidential",)), ("Proprietary", ("reserved",)))
#: Licence words of a normalised sentence, and what every known sentence or licence word holds one of.
WORDS = r"licen[cs]|copyright|spdx|permission is hereby|redistribut|warrant|public domain|all rights reserved"
STEMS = ("licen", "copyright", "spdx", "permission", "redistribut", "warrant", "domain", "reserved", "gnu", "gpl", "liable", "provided", "endorse", "advertis", "confidential", "cc by", "cc-by", "cc0", "cc 0", "commons", "apache", "mozilla", "mpl 2", "mpl-2", "mpl v", "bsd", "mit 0", "mit-0")
_ANY = "|".join(f"(?:{p})" for _, p, _ in SENTENCES)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Steps from lower-cased text to sentences: pattern and what takes its place.
_FLOW = (
    (r"\r\n?|\f", "\n"),
    (r"(?:^|\n)[ \t]*(?:[*#/;%!>|-]+|rem\b|dnl\b)[*#/;%!>| \t-]*", "\n"),
    (r"\bv\.[ \t\n]*", "v "),
    (r"[.!?;][ \t\n]+", " | "),
    (r"\n[ \t]*\n[ \t\n]*", " | "),
    (r"[^a-z0-9+.|]+", " "),
)


def sentences(text: Column) -> Column:
    """The normalised sentences of a text."""
    plain = F.translate(text, _UPPER, _LOWER)
    for pattern, to in _FLOW:
        plain = F.regexp_replace(plain, pattern, to)
    return F.transform(F.split(plain, r"\|"), lambda s: F.btrim(s, F.lit(" .")))


def _constant(rows: list[dict], kind: str) -> Column:
    """A constant array of structs, folded once, without an expression for each value."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def _identified(match: Column, able: Column) -> Column:
    """The identifiers of one match of one of the known sentences ``able``."""
    of = F.filter(able, lambda k: F.rlike(match, F.concat(F.lit("^"), k["pattern"], F.lit("$"))))
    listed = F.regexp_extract_all(F.substring(match, len(_TAG) + 1, 1 << 20), F.lit(_SPDX_ANY), F.lit(0))
    tags = _constant([{"name": f"spdx-{n.lower()}", "pattern": f"^(?:{p})$"} for n, p in SPDX], "name:string,pattern:string")
    tag = lambda x: F.get(F.filter(tags, lambda t: F.rlike(x, t["pattern"])), F.lit(0))["name"]
    return F.when(F.startswith(match, F.lit(_TAG)), F.transform(listed, tag)).otherwise(F.array(F.get(of, F.lit(0))["name"]))


def _held(text: Column) -> Column:
    out = F.lit(False)
    for stem in STEMS:
        out = out | F.contains(text, F.lit(stem))
    return out


def identifiers(text: Column) -> Column:
    """The identifiers of a text's licence sentences, in order."""
    none = F.array().cast("array<string>")
    table = _constant([{"name": n, "pattern": f"(?:{p})", "stems": stems} for n, p, stems in SENTENCES], "name:string,pattern:string,stems:array<string>")

    def of(s: Column) -> Column:
        able = F.filter(table, lambda p: F.exists(p["stems"], lambda x: F.contains(s, x)))
        one = lambda ks: F.array_join(F.transform(ks, lambda k: k["pattern"]), "|")
        matches = F.transform(F.array(able), lambda ks: F.struct(ks.alias("able"), F.when(F.size(ks) > 0, F.regexp_extract_all(s, one(ks), F.lit(0))).otherwise(none).alias("found")))
        other = F.when(F.rlike(s, F.lit(WORDS)), F.array(F.lit(UNKNOWN))).otherwise(none)
        found = F.transform(matches, lambda x: F.when(F.size(x["found"]) > 0, F.flatten(F.transform(x["found"], lambda m: _identified(m, x["able"])))).otherwise(other))
        return F.when(_held(s), F.get(found, F.lit(0))).otherwise(none)

    lowered = F.transform(F.array(F.lower(text)), _held)  # lower-cased once
    return F.when(F.get(lowered, F.lit(0)), F.flatten(F.transform(sentences(text), of))).otherwise(none)


def _code(names: tuple[str, ...]) -> str:
    return ("(?:<(?:" + "|".join((UNKNOWN, *SUPPORT)) + ")>)*?").join(f"<{n}>" for n in names)


def licences(ids: Column) -> Column:
    """Names of the licences whose rules match, in the order of rules, each once."""
    table = lambda rules: _constant([{"name": name, "code": _code(names)} for name, names in rules], "name:string,code:string")
    granted = F.filter(ids, lambda i: i != "denied")
    begin = F.struct(F.concat_ws("", F.transform(granted, lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias("left"), F.array().cast("array<string>").alias("names"))

    def step(done: Column, rule: Column) -> Column:
        hit = F.rlike(done["left"], rule["code"])
        return F.struct(F.when(hit, F.regexp_replace(done["left"], rule["code"], F.lit(""))).otherwise(done["left"]).alias("left"), F.when(hit, F.array_append(done["names"], rule["name"])).otherwise(done["names"]).alias("names"))

    def last(done: Column) -> Column:
        names = F.array_distinct(done["names"])
        rest = F.when(F.size(names) > 0, F.regexp_replace(done["left"], "<(?:" + "|".join(SUPPORT) + ")>", "")).otherwise(done["left"])
        return F.when(F.contains(rest, F.lit("<")), F.array_append(names, F.lit(UNMATCHED))).otherwise(names)

    first = F.aggregate(table(RULES), begin, step)
    second = F.transform(F.array(first), lambda done: F.when(F.size(done["names"]) > 0, done).otherwise(F.aggregate(table(LAST), done, step)))
    return F.when(F.size(ids) > 0, F.get(F.transform(second, last), F.lit(0))).otherwise(F.array().cast("array<string>"))


def recognise(documents: DataFrame) -> DataFrame:
    """documents with sentence_ids and licences: arrays of strings."""
    df = documents.withColumn("sentence_ids", identifiers(C.text_or_empty()))
    return df.withColumn("licences", licences(F.col("sentence_ids")))


def op1_license_scans(spark, sf_dir: str) -> DataFrame:
    df = recognise(C.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.concat_ws(",", "sentence_ids").alias("sentence_ids"), F.concat_ws(",", "licences").alias("licences"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    flow = f"translate(text, '{_UPPER}', '{_LOWER}')"
    for pattern, to in _FLOW:
        flow = f"regexp_replace({flow}, {quote(pattern)}, {quote(to) if to != chr(10) else 'chr(10)'}, 'g')"
    cases = " ".join(f"WHEN regexp_matches(m, {quote(f'^(?:{p})$')}) THEN {quote(n)}" for n, p, _ in SENTENCES)
    tags = " ".join(f"WHEN regexp_matches(x, {quote(f'^(?:{p})$')}) THEN {quote(f'spdx-{n.lower()}')}" for n, p in SPDX)
    steps = ""
    rules = [*RULES, *LAST]
    for k, (name, ids) in enumerate(rules):
        code = quote(_code(ids))
        hit = f"regexp_matches(l{k}, {code})" + (f" AND len(n{len(RULES)}) = 0" if k >= len(RULES) else "")
        carried = f", n{len(RULES)}" if k > len(RULES) else ""
        steps += f",\nx{k + 1} AS MATERIALIZED (SELECT r, doc_id, ids{carried}, CASE WHEN {hit} THEN regexp_replace(l{k}, {code}, '', 'g') ELSE l{k} END AS l{k + 1}, {f'n{k}, ' if k == len(RULES) else ''}CASE WHEN {hit} THEN list_append(n{k}, {quote(name)}) ELSE n{k} END AS n{k + 1} FROM x{k})"
    n = len(rules)
    support = quote("<(?:" + "|".join(SUPPORT) + ")>")
    return f"""
WITH s AS (
  SELECT r, doc_id, list_transform(string_split({flow}, '|'), lambda s: trim(s, ' .')) AS found
  FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)),
ids AS (SELECT r, doc_id, flatten(list_transform(found, lambda s:
    CASE WHEN regexp_matches(s, {quote(_ANY)}) THEN flatten(list_transform(regexp_extract_all(s, {quote(_ANY)}), lambda m:
           CASE WHEN starts_with(m, '{_TAG}') THEN list_transform(regexp_extract_all(substr(m, {len(_TAG) + 1}), {quote(_SPDX_ANY)}), lambda x: CASE {tags} END)
                ELSE [CASE {cases} END] END))
         WHEN regexp_matches(s, {quote(WORDS)}) THEN ['{UNKNOWN}'] ELSE [] :: VARCHAR[] END)) AS ids FROM s),
x0 AS (SELECT *, coalesce(array_to_string(list_transform(list_filter(ids, lambda i: i <> 'denied'), lambda i: '<' || i || '>'), ''), '') AS l0, [] :: VARCHAR[] AS n0 FROM ids){steps}
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       coalesce(array_to_string(list_append(list_filter(n{n}, lambda x, i: list_position(n{n}, x) = i),
         CASE WHEN contains(CASE WHEN len(n{n}) > 0 THEN regexp_replace(l{n}, {support}, '', 'g') ELSE l{n} END, '<') THEN '{UNMATCHED}' END), ','), '') AS licences
FROM x{n}
"""


OP1_SQL = _sql()
