"""Learned operators: held-out accuracy on planted rules, gradients, odd texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixmill.llm import language_id, quality_model, toxicity

LABEL = "doc_id long, quality int, toxic int"
SYL = {"en": "the and ing tion er st ou".split(), "de": "der und ung lich sch ein".split(), "fr": "le est aux ment que ou é".split()}


def prose(rng, n, lang="en"):
    return ". ".join(" ".join("".join(rng.choices(SYL[lang], k=rng.randint(1, 3))) for _ in range(8)).capitalize() for _ in range(n)) + "."


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(8)
    out = []
    for i in range(400):
        bad, low = i % 4 == 0, i % 5 == 0
        text = prose(rng, rng.randint(2, 9))
        if bad:
            text += " You " + rng.choice(["grumpf", "snorkmug", "grumpfen"]) + " of the ing."
        if low:
            text = text.upper().replace(" ", "!! ")
        out.append((i, text, int(not low), int(bad)))
    return out


def frames(spark, labelled):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _, _ in labelled], "doc_id long, text string, lang string, source string, n_chars long")
    return docs, spark.createDataFrame([(i, q, x) for i, _, q, x in labelled], LABEL)


def test_toxicity_learns_and_locates(spark, labelled):
    docs, labels = frames(spark, labelled)
    got = {r.doc_id: r for r in toxicity.noisy_or(docs, toxicity.fit(docs, labels)).collect()}
    texts = {i: t for i, t, _, _ in labelled}
    hit = [got[i].predicted == x for i, _, _, x in labelled]
    assert np.mean(hit) > 0.98
    for i, _, _, x in labelled:
        if x and got[i].predicted:
            spans = got[i].toxic_sentences
            assert any("grumpf" in texts[i][s["start"] : s["end"]].lower() or "snorkmug" in texts[i][s["start"] : s["end"]].lower() for s in spans)


def test_noisy_or_is_what_it_says():
    w = {"bad": 16.0, "awful": 14.0}
    s, n, found = toxicity.score_text("A bad one. Fine here. Awful, bad.", {}, w)
    z = np.log(toxicity.PRIOR / (1 - toxicity.PRIOR)) + np.array([16, 0, 30])
    assert n == 3 and s == pytest.approx(1 - np.prod(1 - 1 / (1 + np.exp(-z)))) and [f["sentence"] for f in found] == [0, 2]


def test_long_clean_text_stays_clean(spark, labelled):
    docs, labels = frames(spark, labelled)
    long = docs.limit(1).withColumn("text", F.expr("repeat('The ing and ou tion. ', 20000)"))
    assert toxicity.noisy_or(long, toxicity.fit(docs, labels)).collect()[0].score < 0.1


def test_quality_learns(spark, labelled):
    docs, labels = frames(spark, labelled)
    got = {r.doc_id: r.predicted for r in quality_model.score(docs, quality_model.fit(docs, labels)).collect()}
    assert np.mean([got[i] == q for i, _, q, _ in labelled]) > 0.98


def test_pair_sum_identity():
    m = quality_model.Machine()
    m.v[:] = np.random.default_rng(0).normal(0, 1, m.v.shape)
    index, value = quality_model.features("some words # here", 17)
    slow = sum(float(m.v[i] @ m.v[j]) * x * y for a, (i, x) in enumerate(zip(index, value)) for j, y in list(zip(index, value))[a + 1 :])
    assert m.raw(index, value, np.array([0]))[0][0] == pytest.approx(slow + float(m.w[index] @ value), rel=1e-3, abs=1e-3)


def test_network_gradients():
    net, y = language_id.Network(["a", "b", "c"]), np.array([0, 1, 2])
    x, length = language_id.table([b"hello", b"a", b"worlds"])

    def loss():
        logp = net.forward(x, length)[0]
        live = np.arange(len(x))[:, None] < length
        return -(logp[:, y, np.arange(3)] * live).sum() / live.sum()

    params = [net.embed, net.out, net.bias, *(p for la in net.layers for p in (la.wx, la.wh, la.b))]
    for p, g in zip(params, net.gradients(x, length, y), strict=True):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        old = p[at]
        p[at] = old + 1e-2
        up = loss()
        p[at] = old - 1e-2
        down = loss()
        p[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.05, abs=2e-4)


def test_scoring_in_place_equals_forward(monkeypatch):
    """Every position is labelled once, from its span with context; with wide context that is the whole text."""
    net, texts = language_id.Network(["a", "b"]), [b"one two", b"", b"three", b"running text " * 60, b"x"]

    def whole(t):
        logp = net.forward(*language_id.table([t]))[0]
        return logp[:, :, 0].sum(axis=0)

    pieces, owner, first, end = language_id.spans(texts)
    assert np.bincount(owner, end - first, len(texts)).tolist() == [len(t) for t in texts]
    want = np.zeros((len(texts), 2))
    for p, o, a, b in zip(pieces, owner, first, end):
        want[o] += net.forward(*language_id.table([p]))[0][a:b, :, 0].sum(axis=0)
    assert np.allclose(net.text_scores(texts), want, rtol=1e-3, atol=1e-3)
    assert np.allclose(net.text_scores([texts[3]])[0], whole(texts[3]), rtol=1e-2)
    monkeypatch.setattr(language_id, "CONTEXT", 1000)
    assert np.allclose(net.text_scores(texts), [whole(t) if t else [0, 0] for t in texts], rtol=1e-3, atol=1e-3)


def test_positions_see_their_neighbours():
    """The states cross word bounds: the same word is labelled otherwise after another one."""
    net = language_id.Network(["a", "b"])
    alone, after = (net.forward(*language_id.table([t]))[0][-3:, :, 0] for t in (b"one", b"qqq one"))
    assert not np.allclose(alone, after, atol=1e-3)


def test_language_is_learned(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 4, lang), lang) for i, lang in enumerate(["en", "de", "fr"] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, language_id.fit(docs)).collect()}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows]) > 0.97 and all(0 <= r.score <= 1 for r in got.values())


def test_odd_texts(spark, docs, odd, labelled):
    d, labels = frames(spark, labelled)
    o = docs(*odd)
    tox = {r.doc_id: r for r in toxicity.noisy_or(o, toxicity.fit(d, labels)).collect()}
    assert len(tox) == len(odd) and tox[0].score == 0 and all(0 <= r.score <= 1 for r in tox.values())
    q = {r.doc_id: r for r in quality_model.score(o, quality_model.fit(d, labels)).collect()}
    assert len(q) == len(odd) and all(0 <= r.score <= 1 for r in q.values())
    la = {r.doc_id: r for r in language_id.identify(o, language_id.fit(d)).collect()}
    assert [la[i].lang_pred == "und" for i in range(len(odd))] == [i in (0, 1, 2, 7) for i in range(len(odd))]


def test_nothing_to_learn_from(spark, docs):
    d, none = docs("a b", None), spark.createDataFrame([], LABEL)
    assert [r.score for r in toxicity.noisy_or(d, toxicity.fit(d, none)).collect()] == [pytest.approx(toxicity.PRIOR), 0]
    assert [r.score for r in quality_model.score(d, quality_model.fit(d, none)).collect()] == [0.5, 0.5]
    assert [r.lang_pred for r in language_id.identify(d, language_id.fit(d.filter("false"))).collect()] == ["und", "und"]
