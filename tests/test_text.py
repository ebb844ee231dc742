import random
import re

import pytest
from pyspark.sql import functions as F

from quarrywise.functions import entities as E
from quarrywise.functions import split as S
from quarrywise.functions import text as T

WORDS = ["The", "approval", "of", "payroll-run", "$1,200.50", "'quoted'", "x", "é", "7", "naïve", " ", "\n", "\t", "a_b", "PO 12", "don't"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    return [""] + [" ".join(r.choices(WORDS, k=r.randrange(1, 60))) for _ in range(80)]


def one(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def model_tokens(text):
    found = re.findall(r"[a-z][a-z0-9_'-]{1,}|\$?\d[\d,]*(?:\.\d+)?", text.lower())
    found = [w.strip("'_-") for w in found]
    return [w for w in found if 2 <= len(w) <= 40 and w not in T.STOPWORDS]


def test_tokens_match_a_plain_model(spark, texts):
    assert one(spark, texts, T.tokens(F.col("text"))) == [model_tokens(t) for t in texts]


def test_pairs_follow_words(spark):
    assert one(spark, ["alpha beta the gamma", "alpha", ""], T.lexical_terms(T.tokens(F.col("text")))) == [["alpha", "beta", "gamma", "alpha beta", "beta gamma"], ["alpha"], []]


def test_trim_and_excerpt_keep_offsets(spark, texts):
    got = one(spark, texts, F.struct(T.trim_range(F.col("text"), F.lit(2), F.lit(30)).alias("r")))
    for t, g in zip(texts, got):
        s, e = g["r"]["start"], g["r"]["end"]
        assert t[s:e] == t[2:30].strip()
    hit = T.first_hit(F.col("text"), ["payroll"], F.lit(0), F.length("text"))
    for t, g in zip(texts, one(spark, texts, T.excerpt_range(F.col("text"), hit["start"], hit["end"], 60, 90))):
        part = t[g["start"] : g["end"]]
        assert part == part.strip() and len(part) <= 90


def test_normalize(spark):
    assert one(spark, ["a\r\nb\0  \t c\n\n\n\n\nd  "], T.normalize(F.col("text"))) == ["a\nb c\n\n\nd"]


def test_titles_and_tables(spark):
    rows = ["ab\n  A title \nmore", "x|y|z\na|b|c", "one, two"]
    assert one(spark, rows, T.title(F.col("text"), F.lit("none"))) == ["A title", "x|y|z", "one, two"]
    assert one(spark, rows, T.looks_tabular(F.col("text"))) == [False, True, False]


def test_doc_types(spark):
    names = ["a/b.PDF", "c.eml", "d.tar.gz", ".hidden", "e.md", "f"]
    assert one(spark, names, T.doc_type(F.col("text"))) == ["pdf", "email", "unknown", "unknown", "text", "unknown"]


def test_chunks_cover_all_but_space():
    r = random.Random(9)
    for _ in range(60):
        text = "".join(r.choice(["word ", "w" * 40, "\n", "\n\n", " "]) for _ in range(r.randrange(0, 900)))
        ranges = S.chunks(text, 0, len(text))
        assert "".join("".join(text[s:e] for s, e in ranges).split()) == "".join(text.split())
        assert all(0 < e - s <= 3500 for s, e in ranges) and all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_pages():
    assert S.pages("") == [""] and S.pages("\f \f") == []
    assert S.pages("a \fb") == ["a", "b"]
    text = ("line of text\n" * 2000).strip()
    assert all(len(p) <= 7000 for p in S.pages(text)) and "".join(S.pages(text)).replace("\n", "") == text.replace("\n", "")
    canon, ranges = S.canonical(["one ", " two"])
    assert canon == "one\n\f\ntwo" and [canon[a:b] for a, b in ranges] == ["one", "two"]


def test_mentions():
    found = E.mentions("Mail ann@example.org or 555-123-4567; invoice #A-17 for $1,200.50 from Blue River Systems.")
    assert [(m[2], m[3]) for m in found] == [("ann@example.org", "email"), ("555-123-4567", "phone"), ("$1,200.50", "money"), ("invoice #A-17", "case_number"), ("Blue River Systems", "organization")]
    assert E.mentions("Case Report") == [(0, 11, "Case Report", "unknown", 0.55, "capitalized_phrase")]
    assert E.mentions("Ann went home", lambda t: [(0, 3, "person")])[0][3] == "person"


def test_mentions_equal_a_plain_model():
    """Rules in turn mark what they take; a match that meets a mark is dropped."""
    r = random.Random(4)
    bits = ["Ann Lee", "ann@example.org", "555-123-4567", "$1,200.50", "case #A-7", "P.O. B12", "Blue River Systems", "invoice 12", "the", ",", ".", "\n", "B.C.D@x.com", "+1 (555) 123-4567", "A" * 90 + " Bee"]
    for _ in range(200):
        text = " ".join(r.choices(bits, k=r.randrange(0, 25)))
        marked, want = set(), []
        for pattern, flags, kind in ((E.EMAIL, re.I, "email"), (E.PHONE, 0, "phone"), (E.MONEY, 0, "money"), (E.CASE, re.I, "case_number"), (E.PHRASE, 0, None)):
            for m in re.finditer(pattern, text, flags):
                if kind is None and len(m[0].strip()) > 80 or marked & set(range(*m.span())) or not re.search(r"\w", m[0]):
                    continue
                marked |= set(range(*m.span()))
                want.append((*m.span(), m[0].strip(), kind or ("organization" if {w.strip(",") for w in m[0].lower().split()} & E.ORGANISATION else "unknown")))
        assert [m[:4] for m in E.mentions(text)] == want


def test_pages_and_chunks_equal_a_plain_model():
    r = random.Random(6)
    for _ in range(60):
        text = "".join(r.choice(["word ", "w" * 40, "\n", "\n\n", " ", "\n\n\n"]) for _ in range(r.randrange(0, 900)))
        want, left = [], text
        while len(left) > 700:
            half = left[350:700]
            at = next((350 + half.rindex(s) for s in ("\n\n", "\n") if s in half), 700)
            want.append(left[:at].strip())
            left = left[at:]
        assert S.pages(text, 700) == ([p for p in [*want, left.strip()] if p] if len(text) > 700 else [text])
        want, at = [], 0
        while at < len(text):
            part = text[at + 50 : at + 350]
            to = len(text) if at + 180 >= len(text) else next((at + 50 + part.rindex(s) for s in ("\n\n", "\n", " ") if s in part), at + 180)
            if text[at:to].strip():
                want.append(text[at:to].strip())
            at = to
        assert [text[a:b] for a, b in S.chunks(text, 0, len(text), 180, 50, 350)] == want


def test_html_text_equals_its_sql_on_unfinished_references():
    import duckdb
    import pandas as pd

    from quarrywise.plans import catalog

    html = ["<p>a&amp</p><p>b &amp; c&lt;d</p>", "<title>x&amp;lt; &eacute; &copy</title>", '<p>\xa0</p><p>&nbsp;</p><style>p&gt;q{}</style>', "<p>AT&T", "tail &am", None, ""]
    pages = pd.DataFrame({"page_id": range(len(html)), "url": "u", "html": html})
    con = duckdb.connect()
    con.register("pages", pages)
    want = dict(con.sql(f"SELECT page_id, text FROM ({catalog.SQL['html_text']})").fetchall())
    assert catalog._html(pages["html"]).tolist() == [want[i] for i in range(len(html))]
