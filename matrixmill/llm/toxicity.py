"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability, a logistic function of its words; the document's
is their noisy-or, 1 - prod(1 - p). Only document labels are needed to learn: the noisy-or's gradient hands each
document's label down to the sentences that explain it. Scoring then also tells which sentences those are.

Features are words and word beginnings. One counts only if more evidence speaks for it than single documents can give (an L1 penalty in units of
documents), so chance words of toxic texts stay at zero, and a sentence without known features has the fixed prior:
even a text of many thousand such sentences stays far below one half.

Defined cases: a null or empty text has score 0 and no sentences; repeated rows are scored each alone; texts are
read whole; with no rows of both classes to learn from, no word counts; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import held_out, id_mod, keep_texts, map_texts, read, training_sample, worker_memo

#: bound of the training sample: documents of each class, characters of a document
PER_CLASS, MAX_CHARS = 1500, 20_000
PRIOR = 1e-6
PENALTY = 0.3
#: toxic documents of the sample that must hold a feature
LEAST_DOCS = 3
STEPS = 300
#: what a toxic document weighs against another one
POSITIVE = 2.0
LIFT = 4
CELL_BITS = 20
PREFIXES = range(3, 11)
SENTENCE = re.compile(r"[.!?\n]+\s*")
WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, score double, predicted int, n_sentences long, toxic_sentences array<struct<sentence: int, start: int, end: int, score: double>>"


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans, without their closing marks; spans without a word are left out."""
    out, start = [], 0
    for m in SENTENCE.finditer(text):
        if m.start() > start:
            out.append((start, m.start()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def word_features(word: str) -> tuple[str, ...]:
    """The word, and its beginnings: inflected forms of a term share them."""
    return (word, *(word[:n] + "*" for n in PREFIXES if n < len(word) + 1))


def learn(sample: list[tuple[str, int]], prior: float = PRIOR, penalty: float = PENALTY, steps: int = STEPS) -> dict[str, float]:
    """Feature weights, by proximal gradient steps on the noisy-or's log-likelihood, scaled by document counts.

    Only features that are LIFT times as common in toxic documents as in others take part.
    """
    y = np.array([label for _, label in sample], float)
    if len(set(y)) < 2:
        return {}
    n = [len(y) - y.sum(), y.sum()]
    # counts by hash first, so that memory stays fixed; then exact counts of the few features whose cells pass
    cells = np.zeros((2, 1 << CELL_BITS), np.int32)
    words = [set(WORD.findall(text.lower())) for text, _ in sample]
    for label, known in zip(y, words, strict=True):
        cells[int(label), list({zlib.crc32(f.encode()) >> 32 - CELL_BITS for w in known for f in word_features(w)})] += 1
    passing = (cells[1] >= LEAST_DOCS) & (cells[1] / n[1] >= LIFT / 2 * cells[0] / n[0])
    df = [Counter(), Counter()]
    for label, known in zip(y, words, strict=True):
        df[int(label)].update({f for w in known for f in word_features(w) if passing[zlib.crc32(f.encode()) >> 32 - CELL_BITS]})
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, k in df[1].items() if k >= LEAST_DOCS and k / n[1] >= LIFT * df[0][f] / n[0]))}
    doc, sent, feature = [], [], []
    for d, (text, _) in enumerate(sample):
        for a, b in sentences(text):
            ids = sorted({vocabulary[f] for w in WORD.findall(text[a:b].lower()) for f in word_features(w) if f in vocabulary})
            sent += [len(doc)] * len(ids)
            feature += ids
            doc.append(d)
    doc, sent, feature = np.array(doc, int), np.array(sent, int), np.array(feature, int)
    weight, base = np.zeros(len(vocabulary)), np.log(prior / (1 - prior))
    rate = 2.0 / np.array([df[0][f] + df[1][f] for f in vocabulary], float)
    for _ in range(steps):
        z = base + np.bincount(sent, weight[feature], len(doc))
        p = 1 / (1 + np.exp(-z))
        none = np.exp(np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)))  # no sentence is toxic
        any_ = np.maximum(1 - none, 1e-300)
        pull = p * np.where(y[doc] == 1, -POSITIVE * (none / any_)[doc], 1.0)
        grad = np.bincount(feature, pull[sent], len(weight))
        step = np.clip(weight - rate * grad, -20, 25)
        weight = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
    return {f: float(weight[i]) for f, i in vocabulary.items() if weight[i]}


def score_text(text: str, known: dict[str, frozenset], weights: dict[str, float], prior: float = PRIOR) -> tuple[float, int, list[dict]]:
    """Document score, number of sentences, and the sentences with a score of one half or more. known: features with a weight, by word."""
    base = float(np.log(prior / (1 - prior)))
    spans = sentences(text)
    log_none, found = len(spans) * float(np.log1p(-prior)), []
    lowered = text.lower()
    if len(lowered) != len(text) or any(known.get(w, True) for w in set(WORD.findall(lowered))):
        for i, (a, b) in enumerate(spans):
            words = WORD.findall(text[a:b].lower())
            active = set().union(*(known[w] if w in known else weights.keys() & set(word_features(w)) for w in words))
            if active:
                p = 1 / (1 + np.exp(-(base + sum(weights[f] for f in sorted(active)))))
                log_none += float(np.log1p(-min(p, 1 - 1e-12)) - np.log1p(-prior))
                if p >= 0.5:
                    found.append({"sentence": i, "start": a, "end": b, "score": float(p)})
    return -float(np.expm1(log_none)), len(spans), found


def scorer(weights: dict[str, float], prior: float = PRIOR):
    """What make() of map_texts and keep_texts needs: texts to (score, number of sentences, toxic sentences)."""
    name, nothing = zlib.crc32(repr(sorted(weights.items())).encode()), frozenset()
    known = worker_memo(f"toxicity:{name}")

    def each(texts: list[str | None]) -> list[tuple[float, int, list[dict]]]:
        for w in known.missing(set(WORD.findall(" ".join(t or "" for t in texts).lower()))):
            known[w] = weights.keys() & word_features(w) or nothing
        return [score_text(t or "", known, weights, prior) for t in texts]

    return each


def noisy_or(docs: DataFrame, weights: dict[str, float], prior: float = PRIOR) -> DataFrame:
    """Score, prediction and offending sentences (character spans) of each document."""

    def make():
        score = scorer(weights, prior)

        def each(rows: dict) -> dict:
            got = score(rows["text"])
            return {
                "doc_id": rows["doc_id"],
                "score": [min(1.0, max(0.0, s)) for s, _, _ in got],
                "predicted": [int(s >= 0.5) for s, _, _ in got],
                "n_sentences": [n for _, n, _ in got],
                "toxic_sentences": [f for _, _, f in got],
            }

        return each

    return map_texts(docs, make, SCHEMA)


def without_toxic(docs: DataFrame, weights: dict[str, float], prior: float = PRIOR) -> DataFrame:
    """The documents that are not predicted toxic, all their columns."""

    def make():
        score = scorer(weights, prior)
        return lambda rows: [s < 0.5 for s, _, _ in score(rows["text"])]

    return keep_texts(docs, make, ("text",))


def fit(docs: DataFrame, labels: DataFrame, trainable: Column | None = None) -> dict[str, float]:
    trainable = id_mod(F.col("doc_id"), 5) != 0 if trainable is None else trainable
    return learn(training_sample(docs, labels, "toxic", trainable, PER_CLASS, MAX_CHARS))


def op6_noisy_or_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = noisy_or(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "n_sentences", F.col("toxic_sentences.sentence").alias("toxic_sentences"))
