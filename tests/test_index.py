import json

import pytest

from pyspark.sql import functions as F

from quarrywise.operators import search, topics
from quarrywise.plans import build
from quarrywise.plans.api import CorpusIndex, HybridIndex, _removals, estimate
from quarrywise.plans.render import markdown
from quarrywise.sources import extract, files

THEMES = {"procurement": "purchase order approval vendor contract", "payroll": "salary payroll approval deduction overtime", "incidents": "outage incident server restart alert"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    n = 0
    for theme, words in THEMES.items():
        (root / theme).mkdir()
        for i in range(3):
            n += 1
            mail = "Write to ann@example.org." if n in (1, 2) else ""
            (root / theme / f"doc_{n:02d}.txt").write_text(f"Report {n} on {theme}\n{words} {words} case #AB-{n}7. {mail}")
    (root / "_note.txt").write_text("underscored vendor note")
    (root / "empty.txt").write_text("")
    (root / "payroll" / "copy.txt").write_text((root / "payroll" / "doc_04.txt").read_text())
    (root / ".hidden").write_text("no")
    (root / "node_modules").mkdir()
    (root / "node_modules" / "x.txt").write_text("no")
    return root


@pytest.fixture(scope="module")
def index(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("index"))
    events = []
    stats = build.build_index(spark, str(folder), out, progress=events.append)
    assert stats.documents == 12 and events[0]["event"] == "build_start" and events[-1]["event"] == "build_done"
    return CorpusIndex(spark, out)


def test_scan_skips_what_is_no_corpus(spark, folder):
    found = sorted(r["path"] for r in files.scan(spark, str(folder)).select("path").collect())
    assert len(found) == 12 and "_note.txt" in found and "procurement/doc_01.txt" in found


def test_orient_and_budget(index):
    answer = index.orient_corpus()
    assert answer["result"]["corpus_summary"]["doc_count"] == 12 and answer["result"]["top_topics"]
    small = index.orient_corpus(token_budget=300)
    assert small["truncated"] and small["token_estimate"] <= 320
    assert index.orient_corpus() == answer  # a cut answer leaves the index as it was
    assert "# Corpus" in markdown(answer)


def test_search_levels_scopes_and_filters(index):
    for level in ("document", "page", "passage"):
        answer = index.search_within({"kind": "corpus"}, "payroll overtime", level)
        assert answer["result"]["results"] and all("payroll" in r["source_batch"] for r in answer["result"]["results"])
    text = {r["doc_id"]: r["canonical_text"] for r in index.table("documents").collect()}
    for r in answer["result"]["results"]:
        s = r["snippet"]
        assert text[r["doc_id"]][s["char_start"] : s["char_end"]] == s["text"]
    only = index.search_within({"kind": "corpus"}, "approval", filters={"sources": ["procurement"]})
    assert {r["source_batch"] for r in only["result"]["results"]} == {"procurement"}
    mail = index.search_within({"kind": "corpus"}, "approval", "document", filters={"entities": ["ANN@example.org"]})
    assert len(mail["result"]["results"]) == 2
    with pytest.raises(ValueError):
        index.search_within(None, "x", "chapter")


def test_topics_hold_together(index):
    for topic_id, topic in index._topics.items():
        assert topic["doc_count"] >= 1 and topic["label_terms"]
        assert topic["parent_topic_id"] is None or topic["parent_topic_id"] in index._topics
    root = next(iter(index._topics))
    card = index.topic_card(root)
    assert card["result"]["snippets"] and index.expand_topic(root)["response_kind"] == "navigation"
    window = index.read_window(snippet_id=card["result"]["snippets"][0]["snippet_id"])
    assert window["result"]["text"]
    with pytest.raises(KeyError):
        index.topic_card("T.none")


def test_scope_of_a_topic_holds_results(index):
    root = next(iter(index._topics))
    for child in index._children(root)[:2]:
        inside = {r["doc_id"] for r in index.table("topic_docs").filter(f"topic_id = '{child['topic_id']}'").collect()}
        found = index.search_within({"topic_ids": [child["topic_id"]]}, "approval vendor payroll incident")
        assert {r["doc_id"] for r in found["result"]["results"]} <= inside


def test_reading_is_bounded(index):
    doc = index.table("documents").filter("original_filename = 'doc_01.txt'").first()["doc_id"]
    window = index.read_window(doc_id=doc, char_start=5, char_end=20, max_chars=40)
    assert len(window["result"]["text"]) <= 40
    pages = index.read_pages(doc, [1], max_chars=10)
    assert pages["truncated"] and len(pages["result"]["pages"][0]["text"]) == 10
    with pytest.raises(ValueError):
        index.read_pages(doc, list(range(1, 10)))
    with pytest.raises(KeyError):
        index.read_pages(doc, [99])
    json.dumps(index.doc_card(doc), default=str)


def test_copies_are_related_and_empty_ones_not(index):
    rows = index.table("duplicates").collect()
    assert {r["relation"] for r in rows} == {"duplicate", "near_duplicate"} and len(rows) == 4
    first, second = sorted({r["doc_id"] for r in rows})
    related = index.doc_card(second)["result"]["related_docs"]
    assert [(r["target_doc_id"], r["relation"]) for r in related] == [(first, "duplicate"), (first, "near_duplicate")]


def test_topic_rows_and_snippets(index):
    root = next(iter(index._topics))
    topic = index._topics[root]
    assert (topic["doc_count"], topic["page_count"], topic["chunk_count"]) == (12, index.table("pages").count(), index.table("chunks").count())
    assert topic["duplicate_rate"] == round(2 / 12, 4) and topic["assignment_confidence"] == topic["coherence"]
    card = index.topic_card(root)["result"]
    assert len({s["doc_id"] for s in card["snippets"]}) == len(card["snippets"]) and card["top_entities"]
    text = {r["doc_id"]: r["canonical_text"] for r in index.table("documents").collect()}
    assert all(text[s["doc_id"]][s["char_start"] : s["char_end"]] == s["text"] for s in card["snippets"])
    doc = index.doc_card(card["snippets"][0]["doc_id"])["result"]
    assert doc["best_passages"][0]["snippet_id"] == card["snippets"][0]["snippet_id"]
    assert any(x.startswith("top terms: ") for x in doc["page_map"][0]["signals"])
    assert index.table("chunk_topics").filter(F.col("topic_id") == root).count() == index.table("chunks").count()


def test_scope_ids_are_stable_and_coverage_is_of_results(index):
    scope = {"topic_ids": [next(iter(index._topics))]}
    assert index.resolve_scope(scope)["scope_id"] == index.resolve_scope(dict(scope))["scope_id"]
    ids = [r["doc_id"] for r in index.table("documents").orderBy("doc_id").limit(3).collect()]
    found = index.search_within({"doc_ids": ids}, "report purchase salary outage", max_results=1)
    coverage = found["cost_ledger"]["coverage"]
    assert coverage["scope_docs"] == 3 and coverage["docs_referenced"] == 1 and coverage["estimated_scope_doc_coverage"] == 0.3333
    assert found["result"]["total_estimated_matches"] >= 1 and found["result"]["results"][0]["doc_id"] in ids
    assert index.search_within({"kind": "corpus"}, "the of")["result"]["results"] == []


def test_search_from_postings_equals_search_of_texts(index):
    documents, pages, chunks = (index.table(x) for x in ("documents", "pages", "chunks"))
    for level in build.LEVELS:
        words = search.units(build.units_of(level, documents, pages, chunks), "unit", "doc_id", F.col("text"))
        want = {(r.unit, round(r.score, 9)) for r in search.bm25(words, ["approval", "payroll"]).collect()}
        got = {(r.unit, round(r.score, 9)) for r in search.bm25_postings(index.table(f"postings_{level}"), index.table(f"lengths_{level}"), ["approval", "payroll"]).collect()}
        assert got == want and want


def test_answers_give_up_parts_in_order():
    result = {"facets": {"a": 1}, "results": [{"text": "x" * 900, "actions": [1, 2]}, {"text": "y"}], "page_map": [1, 2]}
    seen = []
    for _ in _removals(result):
        seen.append(json.loads(json.dumps(result)))
    assert "facets" not in seen[0] and seen[2]["page_map"] == [] and len(seen[3]["results"]) == 1
    assert seen[4]["results"][0]["actions"] == [1] and len(seen[6]["results"][0]["text"]) == 500 and seen[-1]["results"] == []


def test_the_server_answers_lines(index, monkeypatch):
    import io

    from quarrywise.plans import server

    monkeypatch.setenv("QUARRYWISE_INDEX", index.dir)
    out = io.StringIO()
    server.main(io.StringIO('{"id": 1, "tool": "orient", "args": {"max_top_topics": 1}}\n\n{"tool": "none"}\nnot json\n'), out)
    first, *bad = map(json.loads, out.getvalue().splitlines())
    assert first["id"] == 1 and first["result"]["result"]["corpus_summary"]["doc_count"] == 12 and all("error" in x for x in bad) and len(bad) == 2


def test_an_index_is_replaced_whole(spark, tmp_path):
    rows = spark.createDataFrame([(1, "alpha beta gamma delta", "en", "s"), (2, None, None, None)], "doc_id long, text string, lang string, source string")
    (tmp_path / "tables-old").mkdir()
    build.build_index(spark, rows, str(tmp_path))
    assert len(list(tmp_path.glob("tables-*"))) == 1
    index = CorpusIndex(spark, str(tmp_path))
    assert index.search_within({"kind": "corpus"}, "gamma")["result"]["results"][0]["doc_id"] == "1"


def test_cells_find_the_nearest(spark):
    import numpy as np

    from quarrywise.operators import hybrid

    rng = np.random.default_rng(6)
    middle = rng.normal(size=(40, 16))
    rows = [(i, [float(x) for x in middle[i % 40] + 0.3 * rng.normal(size=16)]) for i in range(3000)] + [(9000, None)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    centres = hybrid.train_cells(vectors, "id", "v")
    celled = hybrid.with_cells(vectors, "v", centres).cache()
    assert celled.count() == 3001 and len(centres) > 40
    hits = whole = 0
    for q in range(0, 3000, 300):
        exact = {r.id for r in hybrid.nearest(vectors, "id", "v", rows[q][1], 10).collect()}
        near = {r.id for r in hybrid.nearest(hybrid.probed(celled, centres, rows[q][1]), "id", "v", rows[q][1], 10).collect()}
        hits, whole = hits + len(exact & near), whole + len(exact)
    assert hits / whole >= 0.9
    assert hybrid.train_cells(vectors.limit(0), "id", "v") == [] and hybrid.with_cells(vectors, "v", []).filter("cell = 0").count() == 3001


def test_hybrid(spark, index, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("hybrid"))
    meta = build.build_hybrid(spark, index.dir, out, ann_rows=5)
    assert meta["chunk_count"] == 11 and meta["vector_index"]["created"] and meta["page_count"] == index.table("pages").count()
    h = HybridIndex(spark, out)
    assert h.search("payroll overtime", "vector", exact=True)["results"][0]["source_batch"] == "payroll"
    for mode in ("keyword", "vector", "hybrid"):
        assert h.search("payroll overtime", mode)["results"][0]["source_batch"] == "payroll"
    assert h.search("approval", max_results=0)["results"] == []
    assert h.search("approval", "keyword", 1)["truncated"]
    assert {r["source_batch"] for r in h.search("approval", entities=["ann@example.org"])["results"]} == {"procurement"}
    with pytest.raises(ValueError):
        h.search(" ")


def test_large_topics_split_like_small_ones(spark):
    """The two ways of building a tree agree."""
    rows = [(i, f"t{i % 3}{j}", 1 / 2) for i in range(24) for j in range(4)]
    vectors = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    documents = spark.createDataFrame([(i,) for i in range(25)], "doc_id long")
    trees = [{(r.topic_id, r.doc_id) for r in topics.build(documents, vectors, shape=topics.Shape(most_branches=3, depth=2), local_docs=n).collect()} for n in (1000, 20)]
    assert trees[0] == trees[1] and len({t for t, _ in trees[0]}) > 1


def test_parsers_never_raise():
    for name in ("a.pdf", "b.docx", "c.xlsx", "d.pptx", "e.png", "f.eml", "g.csv", "h.html", "i.xls", "j.bin"):
        got = extract.extract(name, b"\x00\xff not really")
        assert got.pages is not None
    assert extract.extract("a.docx", b"x").method == "failed"
    assert extract.extract("t.csv", b"a, b\nc,d").pages == ["Row 1: a | b\nRow 2: c | d"]
    assert extract.html_text("<title>T</title><p>a &amp; b</p>") == "T\na & b"
    mail = extract.extract("m.eml", b"From: a@b.c\nSubject: Hi\n\nBody")
    assert "Subject: Hi" in mail.pages[0] and "Body" in mail.pages[0]


def test_xlsx_and_office_text():
    import io
    import zipfile

    def packed(parts):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
        return out.getvalue()

    rows = "".join(f"<row r='{i}'><c r='A{i}' t='s'><v>0</v></c><c r='B{i}'><v>{i}</v></c></row>" for i in range(1, 303))
    book = packed({"xl/sharedStrings.xml": "<sst><si><t>word</t></si></sst>", "xl/workbook.xml": "<w><sheets><sheet name='One'/></sheets></w>", "xl/worksheets/sheet1.xml": f"<s>{rows}</s>"})
    got = extract.extract("b.xlsx", book)
    assert got.pages[0].startswith("Sheet: One\nRow 1: A1: word | B1: 1") and "Row 301" not in got.pages[0] and got.warnings
    assert extract.extract("d.docx", packed({"word/document.xml": "<d><p><t>Hello</t></p><p><t>you</t></p></d>"})).pages == ["Hello \n you"]
    assert "Slide 1" in extract.extract("p.pptx", packed({"ppt/slides/slide1.xml": "<s><t>Hi</t></s>"})).pages[0]


def test_estimate():
    assert estimate("") == 1 and estimate("abcde") == 2


def test_stream_appends_each_file_once(spark, folder, tmp_path):
    from quarrywise.streaming import extraction

    for _ in range(2):
        q = extraction.append_to(extraction.arriving(spark, str(folder / "payroll")), str(tmp_path / "t"), str(tmp_path / "c"))
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_diversity_looks_past_a_long_document_and_a_hot_source(spark):
    rows = [(f"a{i:04}", "long", 9.0 - i / 1000) for i in range(300)] + [(f"h{i:04}", f"hot{i}", 8.0 - i / 1000) for i in range(300)]
    rows += [("x", "far", 1.0), ("y", "blank", 0.5), ("z", "far", 0.4)]
    scored = spark.createDataFrame(rows, "unit string, doc string, score double")
    sources = scored.select("doc").distinct().withColumn("source", F.when(F.col("doc") == "far", "cold").when(F.col("doc") == "blank", "").otherwise("hot"))
    got = [r.unit for r in search.top_diversified(scored, sources, "source", 8).orderBy("rank").collect()]
    assert got == ["a0000", "h0000", "h0001", "x", "y", "a0001", "a0002", "a0003"]
    ranked = search.top(scored, len(rows)).join(sources, "doc")
    whole = [r.unit for r in search.diversify(ranked, "source").orderBy("rank").collect()]
    assert got == whole[:8] and [r.unit for r in search.top_diversified(scored, sources, "source", 4).orderBy("rank").collect()] == whole[:4]
    assert search.top_diversified(scored, sources, "source", 0).count() == 0


def test_nested_vectors_in_rounds_equal_long_ones(spark, monkeypatch):
    from pyspark.sql import functions as F

    from quarrywise.operators import terms

    monkeypatch.setattr(terms, "ROUNDS_FROM", 0)
    rows = [(1, "red fish blue fish", "a"), (2, "blue fish swim red", "a"), (3, "", "b"), (4, "stone wall red stone", "b"), (1, "wall of blue", "b"), (5, "lonely", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, g string")
    counts = terms.term_counts(df, "doc_id", F.col("text"))
    want = terms.vectors(counts, terms.idf(counts, df), "doc_id")
    nested = terms.nested_vectors(df, "doc_id", F.col("text"))
    flat = lambda x: {tuple(r)[:-1]: round(r[-1], 9) for r in x.collect()}
    assert flat(terms.long_vectors(nested)) == flat(want)
    members = df.select("doc_id", "g")
    centres = terms.centroids(want, members, "doc_id", "g")
    grouped = nested.join(members, "doc_id")
    assert flat(terms.nested_centroids(grouped, "g").select("g", "term", "weight")) == flat(centres)
    every = flat(terms.similarity(want, centres, "doc_id", "g"))
    assert flat(terms.every_similarity(nested, grouped, "doc_id", "g").select("doc_id", "g", "score")) == every
    own = {(d, g) for d, _, g in rows}
    assert flat(terms.own_similarity(grouped, "doc_id", "g").select("doc_id", "g", "score")) == {k: v for k, v in every.items() if k in own}
