"""The Jaccard join and decontamination against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarrywise.llm import _words, decontaminate, jaccard


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", fold(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])] for i in range(len(rows))]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None), len(seen)))
    return sorted(out, key=repr)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(words, k=r.choice([1, 3, 4, 5, 6, 12, 40, 150]))) for _ in range(n // 6)]
    passage = " ".join(r.choices(words, k=60))
    rows = []
    for i in range(n):
        w = r.choice(base).split()
        for _ in range(r.choice([0, 0, 1, 2, 6])):
            w[r.randrange(len(w))] = r.choice(words).upper()
        text = " ".join(w) + (" " + passage if r.random() < 0.3 else "")
        rows.append((i, text))
    return rows + [(500, None), (501, ""), (502, " \n "), (7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (503, "\x00 a")]


@pytest.mark.parametrize("limits", [{}, {"LONG_RUN": 3, "HELD": 200}, {"FAMILY_MEMBERS": 6}, {"FAMILY_TOKENS": 300, "LONG_RUN": 3}])
def test_join_equals_brute_force(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(len(str(limits)))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int").repartition(3)
    got = [tuple(r) for r in jaccard.join(df).collect()]
    assert sorted(got, key=repr) == brute(rows)


def test_linked_sets_equal_brute_force():
    r = random.Random(12)
    for _ in range(60):
        base = [r.sample(range(1, 10**6), r.choice([1, 3, 8, 30])) for _ in range(4)]
        sets = [np.unique(np.array([x if r.random() > 0.12 else r.randrange(10**6) for x in r.choice(base)] + [7] * r.randrange(2), np.uint64)) for _ in range(r.choice([1, 2, 25]))]
        labels = np.array([r.randrange(3) if r.random() < 0.2 else 10 + i for i in range(len(sets))])
        near = lambda i, j: labels[i] == labels[j] or 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))  # noqa: E731, B023
        want = np.arange(len(sets))
        for _ in sets:
            for i in range(len(sets)):
                for j in range(len(sets)):
                    if near(i, j):
                        want[i] = want[j] = min(want[i], want[j])
        got = jaccard.linked(sets, 75, labels)
        assert [got.tolist().index(x) for x in got] == [want.tolist().index(x) for x in want]


def test_thinned_runs_connect_what_whole_runs_do():
    r = random.Random(5)
    for _ in range(30):
        n = r.choice([5, 200])
        sig = np.array([r.randrange(3) for _ in range(n)])
        size = np.array([r.choice([3, 4, 5, 7, 9, 40, 50, 51, 68, 90, 300]) for _ in range(n)], np.int32)
        node = np.arange(n)
        half = np.arange(n) % 2 == 0
        groups = lambda pairs: sorted(map(sorted, _merged(pairs, n)))  # noqa: E731, B023
        whole = _runs(sig, node, size)
        thin = []
        kept = []
        for some in (half, ~half):
            (s, k, z), (p, o) = jaccard._thinned(sig[some], node[some], size[some], 75)
            kept.append((s, k, z))
            thin += list(zip(p.tolist(), o.tolist()))
        assert groups(whole) == groups(thin + _runs(*(np.concatenate(x) for x in zip(*kept))))


def _runs(sig, node, size):
    rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (sig, node, size)] + [pa.nulls(len(sig), pa.int64())], names=["sig", "key", "n", "pivot"]).sort_by([("sig", "ascending"), ("n", "ascending"), ("key", "ascending")])
    return [(p, n) for b in jaccard._pivots(75)(iter([rows])) for p, n in zip(*(c.to_pylist() for c in b.columns))]


def _merged(pairs, n):
    of = {i: {i} for i in range(n)}
    for a, b in pairs:
        both = of[a] | of[b]
        for x in both:
            of[x] = both
    return {frozenset(x) for x in of.values()}


def test_words_of_like_structure_differ(spark):
    """Thue-Morse words and their complements agree in every polynomial modulo a power of two."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    for n in (8, 16, 64, 1024):
        a, b = word[:n], word[:n].translate(str.maketrans("ab", "ba"))
        assert _words.value_of(a.encode(), _words.UNSPACED) != _words.value_of(b.encode(), _words.UNSPACED)
    df = spark.createDataFrame([(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.join(df).collect()) == [(1, 1, 1, 2), (2, 1, 2, 1), (3, 1, 1, 2)]


def test_long_chains_settle(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    assert {tuple(r) for r in jaccard.components(df).collect()} == {(i, 0) for i in range(1, 301)} | {(1001, 1000)}


def test_prefixes_share_a_signature():
    """Any two sets of enough similarity share one, whatever the ranks."""
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 5, 8, 15, 16, 17, 31, 40, 100, 257):
        for _ in range(25):
            ranks = {}
            rank_of = lambda s: np.array([ranks.setdefault(int(x), int(rng.integers(0, 256))) for x in s], np.uint8)  # noqa: E731, B023
            a = np.unique(rng.integers(0, 2**63, n, np.uint64))
            keep = a[rng.permutation(len(a))[: max(1, -(-len(a) * 6 // 7))]]
            b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, max(0, len(a) // 7), np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 75 * (len(a) + len(b) - inter):
                x, y = (jaccard.signatures(s, rank_of(s)) for s in (a, b))
                assert len(np.intersect1d(x, y)), (n, len(a), len(b))


def test_empty_table(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d e f g h"), (1, "A b c d e f g h"), (1, "a b c d e f g h"), (5, "other words"), (8, ""), (9, None)]
    df = spark.createDataFrame([(i, t, i * 2) for i, t in rows], "doc_id long, text string, component_id int")
    kept = jaccard.deduplicate(df).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 5, 8, 9] and df.columns == kept[0].__fields__


def test_one_of_each_group_stays_where_ids_are_unique(spark):
    rows = [(3, "a b c d e f g h"), (1, "A b c d e f g h"), (5, "other words"), (8, ""), (9, None)]
    df = spark.createDataFrame([(t, i, i * 2) for i, t in rows], "text string, doc_id long, class_size int")
    kept = jaccard.deduplicate(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 5, 8, 9]


def test_words_match_regular_expressions():
    r = random.Random(3)
    texts = ["".join(r.choice("aB9é日 \n\t.,\x00\x7f-_Z") for _ in range(r.randrange(0, 80))) for _ in range(300)] + ["x" * 700_000 + " y", None]
    for alphabet, pattern in ((_words.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (_words.UNSPACED, r"[^\x20\x09-\x0D]+")):
        words, _ = _words.split(pa.array(texts), alphabet)
        seen = {}
        for i, t in enumerate(texts):
            want = [w.encode() for w in re.findall(pattern, fold(t))]
            assert [words.bytes_of(j, alphabet).replace(b" ", b"\0") if b"\0" in b"".join(want) else words.bytes_of(j, alphabet) for j in range(words.first[i], words.first[i + 1])] == want
            for w, v in zip(want, words.value[words.first[i] : words.first[i + 1]]):
                assert seen.setdefault(w, v) == v
        assert len(set(seen.values())) == len(seen)


# --- decontamination -----------------------------------------------------------------------


def judged(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    wins = {}
    for item, t in items:
        w = words(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + k]), set()).add(str(item) if item is not None else "")
    out = []
    for doc, t in rows:
        w, hit, names = words(t), set(), set()
        for k in {len(x) for x in wins}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in wins:
                    hit |= set(range(i, i + k))
                    names |= wins[tuple(w[i : i + k])]
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_bytes", [decontaminate.MOST_BYTES, 0])
def test_judged_like_brute_force(spark, most_bytes):
    r = random.Random(8)
    words = [f"v{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=k))) for i, k in enumerate([1, 5, 13, 14, 40, 40, 25])] + [(90, None), (91, " .. "), (None, "lone item words here"), (4, "again four")]
    rows = []
    for i in range(80):
        w = r.choices(words[5:], k=r.choice([0, 3, 30, 200]))
        if r.random() < 0.6:
            cut = r.choice(items)[1] or ""
            w[len(w) // 2 : len(w) // 2] = [x.upper() + "," for x in cut.split()][: r.choice([4, 13, 20, 99])]
        rows.append((i, " ".join(w)))
    rows += [(5, rows[5][1]), (None, rows[6][1]), (200, None), (201, "é" * 3 + " LONE item, words; here")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, N_words int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(df, bench, most_bytes=most_bytes).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    assert sorted((tuple(x) for x in got), key=repr) == judged(rows, items)
    clean = decontaminate.decontaminate(df, bench, most_bytes=most_bytes)
    assert clean.columns == df.columns and clean.count() == sum(not x[-1] for x in judged(rows, items))
    cut = decontaminate.decontaminate(df, bench, remove="spans", most_bytes=most_bytes)
    assert cut.count() == len(rows)
    left = {r.doc_id: r.text for r in cut.collect()}
    assert "LONE" not in left[201] and left[200] is None


def test_long_texts_and_common_windows(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    items = [(i, passage) for i in range(400)] + [(900, "a " * 5000)]
    text = "b c " * 60_000 + passage + " " + "a " * 40
    df = spark.createDataFrame([(1, text), (2, "a " * 3000)], "doc_id long, text string")
    got = [tuple(r)[:1] + tuple(r)[2:] for r in decontaminate.judge(df, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got) == judged([(1, text), (2, "a " * 3000)], items)


def test_nothing_to_judge(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert not decontaminate.judge(df, none).first()["contaminated"]
    assert decontaminate.judge(df.limit(0), none).count() == 0


@pytest.mark.parametrize("limits", [{}, {"FAMILY_MEMBERS": 6}, {"FAMILY_TOKENS": 300, "LONG_RUN": 3}])
def test_join_in_rounds_equals_brute_force(spark, monkeypatch, limits):
    for name, value in {"ROUNDS_FROM": 0, **limits}.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(7)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string"), partitions=3)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "class_size").collect()), key=repr) == brute(rows)


def shuffle_bytes(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).length() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_"))


def test_written_steps_leave_no_shuffle_files(spark):
    from quarrywise.llm import _common
    from quarrywise.sources import tables

    for write in (_common.materialize, tables.materialize):
        before = shuffle_bytes(spark)
        assert write(spark.range(200_000).repartition(2, "id"), "step").count() == 200_000
        assert shuffle_bytes(spark) - before < 100_000  # of the write nothing, of the count a few


@pytest.mark.parametrize("limits", [{"PAIRS": 2}, {"PAIRS": 3, "LONG_RUN": 4, "HELD": 200}, {"SENT": 7}, {"ROUNDS_FROM": 0, "SENT": 40}])
def test_join_by_shared_signatures_equals_brute_force(spark, monkeypatch, limits):
    """Ranks without any order, as noise makes them: shared passages are in many prefixes."""
    monkeypatch.setattr(jaccard, "_ranks", lambda surveyed, slots, partitions: np.zeros(slots, np.uint8))
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(40 + len(str(limits)))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_similar_sets_share_enough_signatures():
    rng = np.random.default_rng(9)
    met = 0
    for _ in range(3000):
        n = int(rng.integers(1, 90))
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        keep = a[rng.permutation(len(a))[: max(1, len(a) - int(rng.integers(0, 1 + len(a) // 5)))]]
        b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, 1 + n // 5)), np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < 75 * (len(a) + len(b) - inter):
            continue
        salt, low = np.uint64(rng.integers(1, 2**63)), int(rng.integers(1, 256))
        rank = [(_words.mix(s ^ salt) % np.uint64(low)).astype(np.uint8) for s in (a, b)]
        size, plain = [np.array([len(s)]) for s in (a, b)], [np.array([np.count_nonzero(r < jaccard.FREQUENT) >= jaccard._prefix(len(s), 75)]) for s, r in zip((a, b), rank)]
        shared = len(np.intersect1d(jaccard.signatures(a, rank[0]), jaccard.signatures(b, rank[1])))
        least = int(jaccard._least_shared(size[0], plain[0], size[1], plain[1], 75)[0])
        met += least > 1
        assert shared >= least
    assert met > 300


def test_a_common_passage_makes_no_family(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_ranks", lambda surveyed, slots, partitions: np.zeros(slots, np.uint8))
    r = random.Random(3)
    text = lambda k: " ".join(f"w{r.randrange(10**9)}" for _ in range(k))
    passage, copied = text(44), text(200)
    rows = [(i, text(200) + " " + passage) for i in range(12)] + [(20, copied), (21, copied + " " + text(9))]
    steps = jaccard._Join(spark.createDataFrame(rows, "doc_id bigint, text string"), 5, 75, 3)
    steps.survey()
    steps.candidates()
    assert {x.doc_id for x in steps.members.collect()} == {20, 21}
