import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quarrywise.llm import _labels, _trees, quality, toxicity


def rows(n=400, seed=1):
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("re", "ta", "mo", "li", "su") for b in ("nd", "st", "rk", "ve")]
    docs, labels = [], []
    for i in range(n):
        words = r.choices(plain, k=r.randrange(20, 80))
        toxic, good = int(r.random() < 0.3), int(r.random() < 0.7)
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(["you idiot", "vejune", "vejura", "moron"]))
        if not good:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, good, toxic))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = rows()
    docs += [(1000, None), (1001, ""), (0, docs[0][1]), (None, "x")]
    labels += [(0, None, None), (3, 1, 0), (None, 1, 1), (5000, 1, 1)]
    return spark.createDataFrame([(d, t, 0.5) for d, t in docs], "doc_id long, text string, SCORE double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, label, limit", [(toxicity, "toxic", 0.3), (quality, "quality", 0.7)])
def test_held_out_accuracy(tables, module, label, limit):
    docs, labels = tables
    model = module.train(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    truth = {d: (q, t) for d, q, t in rows()[1]}
    held = [(r.score >= limit) == bool(truth[r.doc_id][label == "toxic"]) for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(held) > 60 and np.mean(held) >= 0.9


@pytest.mark.parametrize("module", [toxicity, quality])
def test_without_labels_or_rows(tables, module):
    docs, labels = tables
    model = module.train(docs, labels.limit(0))
    assert toxicity.scored(docs.limit(0), model).count() == 0
    assert all(0 <= r.score <= 1 for r in toxicity.scored(docs.limit(5), model).collect())


def test_sample_leaves_held_out_rows_alone(spark, tables):
    docs, labels = tables
    chosen = _labels.sample(docs, labels, "toxic", 50)
    assert chosen.groupBy("label").count().filter("count > 51").count() == 0
    texts = {t for d, t in rows()[0] if zlib.crc32(str(d).encode()) % 4 == 2}
    assert not texts & {r.text for r in chosen.collect()}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_do_not_depend_on_the_layout(tables, module):
    docs, labels = tables
    docs = docs.unionByName(docs.limit(1).selectExpr("2000L AS doc_id", "repeat('you idiot and more words ', 20000) AS text", "SCORE"))
    docs = docs.withColumnRenamed("SCORE", "Label")
    found = []
    for d, x in ((docs, labels), (docs.repartition(7, "text").sortWithinPartitions("text"), labels.repartition(5))):
        found.append(sorted(((r.doc_id, r.text, r.score) for r in toxicity.scored(d, module.train(d, x)).collect()), key=repr))
    assert found[0] == found[1]
    by_text = {}
    assert all(by_text.setdefault(t, s) == s for _, t, s in found[0])


def test_a_hot_id_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(300)] + [(8, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (8, 0)] * 3, "doc_id long, toxic int")
    assert _labels.sample(docs, labels, "toxic", 100).select("text", "label").count() == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (7, 8))


def test_near_words_are_of_the_same_text():
    lex = toxicity.lexicon({})
    alone = toxicity.features(pa.array(["idiot here"]), lex)
    assert (toxicity.features(pa.array(["so you", "idiot here", "your"]), lex)[1] == alone[0]).all()


def test_isotonic_pools_ties_and_equals_brute_force():
    ties = [_trees.Isotonic(np.ones(2), np.array(y), np.ones(2)) for y in ([0.0, 1.0], [1.0, 0.0])]
    assert [t.value.tolist() for t in ties] == [[0.5], [0.5]]
    rng = np.random.default_rng(8)
    for _ in range(20):
        raw, y, w = rng.integers(0, 9, 30) / 4, rng.random(30), rng.random(30) + 0.1
        iso = _trees.Isotonic(raw, y, w)
        at = np.unique(raw)
        mean = lambda a, b: np.average(y[(raw >= a) & (raw <= b)], weights=w[(raw >= a) & (raw <= b)])  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in at[at >= v]) for a in at[at <= v]) for v in at]  # the greatest of the least means
        assert np.allclose(sorted(set(np.round(want, 9))), iso.value)


def test_one_tree_takes_the_best_split():
    rng = np.random.default_rng(4)
    for _ in range(10):
        x, y = rng.integers(0, 12, (60, 3)).astype(float), rng.integers(0, 2, 60).astype(float)
        if y.min() == y.max():
            continue
        trees = _trees.fit(x, y, np.ones(60), rounds=1, depth=1, bins=200)
        p = y.mean()
        g, h = p - y, np.full(60, p * (1 - p))
        half = lambda m: g[m].sum() ** 2 / (h[m].sum() + 2.0)  # noqa: E731, B023
        gain = lambda j, c: half(x[:, j] <= c) + half(x[:, j] > c)  # noqa: E731, B023
        best = max(gain(j, c) for j in range(3) for c in np.unique(x[:, j])[:-1])
        assert np.isclose(gain(trees.feature[0][0], trees.limit[0][0]), best)
        left = x[:, trees.feature[0][0]] <= trees.limit[0][0]
        for side, leaf in ((left, trees.leaf[0][0]), (~left, trees.leaf[0][1])):
            assert np.isclose(leaf, -0.15 * g[side].sum() / (h[side].sum() + 2.0))


def test_trees_and_isotonic():
    rng = np.random.default_rng(2)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    trees = _trees.fit(x, y, np.ones(800))
    assert ((trees.raw(x) > 0) == (y > 0)).mean() > 0.97
    iso = _trees.Isotonic(trees.raw(x), y, np.ones(800))
    score = iso(np.sort(trees.raw(x)))
    assert (np.diff(score) >= 0).all() and 0 <= score.min() and score.max() <= 1


def test_features_of_known_texts():
    lex = toxicity.lexicon({})
    f = dict(zip(toxicity.FEATURES, toxicity.features(pa.array(["You 1d10t! you IDIOT", "", None]), lex)[0]))
    assert f["hits"] == pytest.approx(np.log1p(1)) and f["leet_hits"] > 0 and f["near"] > 0 and f["all_caps"] == 0.25
    assert np.isfinite(toxicity.features(pa.array(["", None, "!"]), lex)).all()


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    net = quality.fit(x, y, np.ones(600))
    assert ((net.logit(x) > 0) == (y > 0)).mean() > 0.9
    logit = np.where(rng.random(2000) < 0.8, 1, -1) * 9.0
    assert quality.temperature(logit, np.ones(2000), np.ones(2000)) > 3
