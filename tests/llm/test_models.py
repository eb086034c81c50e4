import random

import numpy as np
import pandas as pd
from helpers import AWKWARD, documents

from lindero.llm import langid, quality
from lindero.llm.common import held_out
from lindero.llm.queries import op1_language_id, op6_quality_score

WORDS = {
    "en": "the and of that with from this have were which their about".split(),
    "de": "der und die nicht werden über schön müssen straße durch".split(),
    "ru": "это был она который когда только можно если время".split(),
}


def text(lang, n, seed):
    return " ".join(random.Random(seed).choices(WORDS[lang], k=n))


def corpus():
    rows = [(1000 + 10 * i + k, text(lang, 30 + i, i), lang) for i in range(40) for k, lang in enumerate(WORDS)]
    rows += [(5000, text("en", 40, 1) + ". " + text("ru", 10, 2) + "! " + text("de", 30, 3), "en"), (5001, text("de", 50, 4), None)]
    return rows + [(i, t, None) for i, t in AWKWARD]


def slow_labels(scores, switch):
    """All paths by the textbook recursion."""
    n, k = scores.shape
    best, came = [list(scores[0])], []
    for t in range(1, n):
        row, back = [], []
        for j in range(k):
            options = [best[-1][i] - (0 if i == j else switch) for i in range(k)]
            i = max(range(k), key=lambda i: options[i])
            row.append(options[i] + scores[t][j])
            back.append(i)
        best.append(row)
        came.append(back)
    total = max(best[-1])
    return total


def path_value(scores, path, switch):
    return sum(scores[t][j] for t, j in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


def test_viterbi_finds_the_best_path():
    r = np.random.default_rng(0)
    sizes = [0, 1, 5, 40, 0, 300, 7]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    scores = np.repeat(r.normal(0, 3, (sum(sizes) // 8 + 1, 3)), 8, 0)[: sum(sizes)] + r.normal(0, 2, (sum(sizes), 3))
    scores = scores.astype(np.float32)
    got = langid.viterbi(scores, starts, 5.0)
    for a, b in zip(starts, starts[1:]):
        if b > a:
            assert abs(path_value(scores[a:b].astype(float), got[a:b], 5.0) - slow_labels(scores[a:b].astype(float), 5.0)) < 1e-3
            assert b - a < 40 or len(set(got[a:b])) > 1


def test_language_id(spark, tmp_path):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(docs.where(~held_out()))
    assert model["langs"] == ["de", "en", "ru"]
    got = {r.doc_id: r for r in langid.predict(docs, model, ["doc_id"], with_spans=True).collect()}
    for i, t, lang in rows:
        if lang:
            assert got[i].lang_pred == lang
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score, got[i].span_lang) == ("und", 0.0, [])
        assert 0 <= got[i].score <= 1
    mixed = rows[120][1]
    spans = [(mixed[a:b], lang) for a, b, lang in zip(got[5000].span_start, got[5000].span_end, got[5000].span_lang)]
    assert [lang for _, lang in spans] == ["en", "ru", "de"]
    assert all(set(s.split()) <= {w for x in WORDS.values() for w in x} | {"."} for s, _ in spans[1:2])
    none = langid.predict(docs.limit(0), langid.train(docs.limit(0)), ["doc_id"])
    assert none.count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.limit(0)), ["doc_id"]).collect()} == {"und"}
    docs.withColumn("n_chars", held_out()).write.parquet(str(tmp_path / "documents.parquet"))
    out = op1_language_id(spark, str(tmp_path))
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == len(rows)


def test_fit_tells_unlearned_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    r = random.Random(3)
    odd = [(1, "".join(r.choice("bcdfghjklmnpqrstvwxz ") for _ in range(300))), (2, "Bugün hava çok güzel ve çocuklar bahçede oynuyor"), (3, text("en", 60, 77)), (4, "12 34"), (5, text("ru", 30, 9))]
    got = {x.doc_id: x.fit for x in langid.predict(spark.createDataFrame(odd, "doc_id long, text string"), langid.train(docs), ["doc_id"], with_fit=True).collect()}
    assert got[1] < -4 and got[2] < -4 and got[3] > -1 and got[5] > -1 and got[4] != got[4]


def test_trees_learn_and_flatten():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality.fit(x[:2000], y[:2000])
    p = trees.probability(x)
    assert ((p > 0.5) == y)[2000:].mean() > 0.97
    for row, want in zip(x[:50], p[:50]):  # one tree and one step at a time
        total = trees.base
        for f, c, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            j = 0
            while j < len(f):
                j = 2 * j + 1 + (row[f[j]] > c[j])
            total += leaf[j - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - want) < 1e-12


def slow_tree(x, y, margin, depth, rate, bins, least, ridge):
    """One tree by trying every edge of every feature on the rows themselves."""
    p = 1 / (1 + np.exp(-margin))
    g, h = y - p, p * (1 - p) + 1e-9
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    out = np.zeros(len(x))

    def grow(rows, level):
        if level == depth:
            out[rows] = rate * g[rows].sum() / (h[rows].sum() + ridge)
            return
        best = (1e-6, None)
        for f, cuts in enumerate(edges):
            for c in cuts:
                left, right = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                if h[left].sum() < least or h[right].sum() < least:
                    continue
                part = lambda r: g[r].sum() ** 2 / (h[r].sum() + ridge)
                gain = part(left) + part(right) - part(rows)
                if gain > best[0] + 1e-12:
                    best = (gain, (left, right))
        for r in best[1] or (rows, rows[:0]):
            grow(r, level + 1)

    grow(np.arange(len(x)), 0)
    return out


def test_histogram_splits_equal_brute_force():
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(300, 4)), 1)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0) | (r.random(300) < 0.1)).astype(float)
    trees = quality.fit(x, y, rounds=3, depth=3, bins=8)
    margin = np.full(300, trees.base)
    for k in range(3):
        part = quality.Trees(0.0, trees.feature[k : k + 1], trees.threshold[k : k + 1], trees.leaf[k : k + 1])
        grown = slow_tree(x, y, margin, 3, 0.1, 8, 4.0, 1.0)
        got = np.log(part.probability(x) / (1 - part.probability(x)))
        assert np.abs(got - grown).max() < 1e-9
        margin += grown


def test_most_languages(spark):
    rows = [(i, text(lang, 30 + 10 * k, i), lang) for i in range(12) for k, lang in enumerate(WORDS)] + [(100 + i, "x" * (i + 1), f"dirty{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.train(docs, most_languages=3)["langs"] == ["de", "en", "ru"]
    assert len(langid.train(docs)["langs"]) == 43


def test_quality_of_repeated_ids(spark):
    docs = spark.createDataFrame([(i % 40, text("en", 20 + i, i)) for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    a, b = quality.train(docs, labels), quality.train(docs.orderBy("text"), labels)
    assert (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()


def test_quality(spark, tmp_path):
    good = [(100 + i, text("en", 60, i) + ".\n" + text("de", 20, i)) for i in range(150)]
    bad = [(400 + i, " ".join(["spam"] * (30 + i)) if i % 2 else "\n".join(["a | b | c !!"] * (9 + i))) for i in range(150)]
    docs = documents(spark, good + bad + AWKWARD)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(1, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = op6_quality_score(spark, str(tmp_path)).toPandas()
    assert len(out) == 300 + len(AWKWARD) and out.score.between(0, 1).all()
    assert ((out.score >= 0.3) == out.predicted).all()
    held = out[out.held_out & out.doc_id.between(100, 549)]
    assert len(held) > 30 and ((held.doc_id < 400) == (held.predicted == 1)).mean() > 0.95
    assert pd.Series(out[out.doc_id == 7].score).nunique() == 1
    empty = quality.score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0)), ["doc_id"])
    assert empty.count() == 0
