"""Spelling variants and centroid clustering against plain Python."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from matrixmill.llm import centroids as C
from matrixmill.llm import spelling as S

DOC = "doc_id long, text string"


def plain_words(docs):
    fold = str.maketrans(S.UPPER, S.LOWER)
    n = collections.Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(fold)
            if i is not None and (h := zlib.crc32(f"{i}:{run}".encode())) % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(docs):
    n = plain_words(docs)
    around = collections.defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if near(a, b):
            around[a].append(b)
            around[b].append(a)
    form = {}
    for w in n:
        best = min(around[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(around[w]), None if form[w] is None else n[form[w]]))
    return out


def rows(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_by_brute_force(spark, odd):
    rng = random.Random(5)
    base = ["mountain", "naïvetés", "aaaaaaa", "reproduce", "listens", "silents", "tinsels", "enlists"]
    texts = [*odd, " ".join(["Mountain"] * 2000), " ".join(["mountian", "mountin"] * 20), "mountn mountn mounten mounten", "x" * 3000 + " " + "x" * 3000, "x" * 3001 + " " + "x" * 3001]
    for _ in range(60):
        words = []
        for _ in range(30):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                p = rng.randrange(len(w))
                w[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "é", "e", "×"])
            words.append("".join(w))
        texts.append(" ".join(words))
    docs = [*enumerate(texts), (None, "without ids without letters"), (3, "word"), (3, "word")]
    df = spark.createDataFrame(docs, DOC)
    got = S.variants(df)
    assert got.columns == ["word", "n", "form", "root", "n_near", "form_n"]
    assert got.count() == len(rows(got))
    want = plain_variants(docs)
    assert rows(got) == want and any(r[1] and r[2] != r[1] for r in want)


def test_variants_of_many_anagrams(spark):
    """A group of anagrams as of one key: pairs meet by halves; ties of the largest count go to the smaller word."""
    rng = random.Random(1)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(400)}
    words |= {w[:3] + w[4:] for w in list(words)[:100]}
    docs = [(i, f"{w} {w}") for i, w in enumerate(sorted(words))]
    assert rows(S.variants(spark.createDataFrame(docs, DOC))) == plain_variants(docs)
    entries = S.keyed(spark.createDataFrame([(w, 2) for w in words if len(w) == 8], "word string, n long"))
    assert entries.groupBy("sig").count().agg({"count": "max"}).first()[0] < 40


def test_differences_of_powers_tell_letters_apart():
    codes = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
    differences = [a**S.POWER - b**S.POWER for a in codes for b in codes if a != b]
    assert len(set(differences)) == len(differences)


def plain_clusters(vectors, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"3:{x[0]}".encode()).hexdigest(), x[1]))
    centres = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in centres]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            own = [v for (_, v), (x, _) in zip(kept, found) if x == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own)]
    found = assign()
    share = collections.Counter()
    for c, d in found:
        share[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((str(i), c, d, share[c], sum(share.values()), sha[c]) for (i, _), (c, d) in zip(kept, found)))


@pytest.mark.parametrize("grain", [1, 256])
def test_clusters_by_brute_force(spark, grain):
    """grain 256: components of few values, so that distances tie again and again."""
    rng = np.random.default_rng(grain)
    vectors = [(i, (rng.integers(-2, 3, 64) * grain / 1024 if grain > 1 else rng.normal(size=64)).tolist()) for i in range(150)]
    vectors += [vectors[3], vectors[3], (700, vectors[5][1]), (None, vectors[6][1]), (701, None), (702, []), (703, [1.0] * 63), (704, [float("nan")] * 64), (705, [float("inf")] + [0.0] * 63), (706, [None] + [0.5] * 63), (707, [0.0] * 64)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in vectors], "vec_id long, embedding array<double>, cluster string, x int")
    got = C.clustered(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == plain_clusters(vectors)


def test_few_vectors_and_large_ones(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (2, [0.25] * 64), (3, [1e300] * 64), (4, [-1e5] * 64)], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.distance) for r in C.clustered(df).orderBy("vec_id").collect()] == [(1, 0), (2, 0)]
    assert C.clustered(df.limit(0)).count() == 0


def test_nearest_is_exact_for_many_centroids():
    rng = np.random.default_rng(0)
    for scale in (3, 1000, 1 << 25):
        x, c = rng.integers(-scale, scale, (500, 64)), rng.integers(-scale, scale, (40, 64))
        c[7] = c[3]
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        best, distance = C.nearest(x, c)
        assert (best == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
