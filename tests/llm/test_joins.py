"""Near duplicates, vectors, revisits and the pipeline against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixmill.llm import ngram_join, revisits, vector_graph


def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset([tuple(w)] if 0 < len(w) < 5 else zip(w, w[1:], w[2:], w[3:], w[4:])))
    top = list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_copies(rng, n_base, copies, words=60):
    out = []
    for _ in range(n_base):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, words))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = f"z{rng.randrange(5000)}"
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


def check(spark, docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(*texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)


def test_components_of_near_copies(spark, docs, odd):
    check(spark, docs, near_copies(random.Random(1), 25, 9) + [t for t in odd if t is None or len(t) < 1000])


def test_frequent_shingles_are_joined_by_pairs(spark, docs, monkeypatch):
    monkeypatch.setattr(ngram_join, "CLASSES", (-100, 4, 9))  # every shingle is frequent, in one of three classes
    check(spark, docs, near_copies(random.Random(2), 12, 12, 200))


def links_by_hand(x, y):
    both = len(np.intersect1d(x, y))
    return 100 * both >= 80 * (len(x) + len(y) - both)


def prefix_allows(x, y, counts, most):
    """Whether the first shared signature leaves a link possible, by position and by sketch."""
    (sx, rx), (sy, ry) = (ngram_join.prefix_of(s, counts, most) for s in (x, y))
    first = next(k for k in sx.tolist() if k in set(sy.tolist()))  # the bound must hold there
    assert first == next(k for k in sy.tolist() if k in set(sx.tolist()))
    i, j = np.flatnonzero(sx == first), np.flatnonzero(sy == first)
    differ = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(ngram_join.sketch(x), ngram_join.sketch(y)))
    return bool(((4 * len(y) <= rx[i]) & (4 * len(x) <= ry[j])).any()) and 9 * differ <= len(x) + len(y)


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 1.0])
@pytest.mark.parametrize("sizes", [(4, 13), (13, 400)])
def test_no_bound_rules_out_a_link(share, sizes):
    rng = np.random.default_rng(3)
    frequent = rng.choice([60, 2000, 50_000], ngram_join.CELLS)
    counts = np.where(rng.random(ngram_join.CELLS) < share, frequent, rng.integers(1, 9, ngram_join.CELLS)).astype(np.int32)
    most, seen = (0, 50, 1000, 30_000), 0
    for _ in range(600):
        n = int(rng.integers(*sizes))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        keep = np.sort(rng.permutation(x)[: len(x) - int(rng.integers(0, len(x) // 5 + 1))])
        y = np.unique(np.concatenate([keep, rng.integers(0, 2**63, int(rng.integers(0, len(keep) // 5 + 1))).astype(np.uint64)]))
        if links_by_hand(x, y) and not np.array_equal(x, y) and min(len(x), len(y)) > 3:
            seen += 1
            assert prefix_allows(x, y, counts, most)
    assert seen > 100


@pytest.mark.parametrize("frequent", [(32, 4096, 1 << 19), (-100, 2, 4)])
def test_all_small_sizes(spark, docs, monkeypatch, frequent):
    """Texts of 1 to 18 words and the same with a word put before or behind, or changed: 4 shingles link with 5."""
    monkeypatch.setattr(ngram_join, "CLASSES", frequent)
    texts = []
    for n in range(1, 19):
        words = [f"v{n}x{i}" for i in range(n)]
        texts += [" ".join(w) for w in (words, words + ["z"], ["y", *words], [*words[:-1], "q"], words * 3, words[::-1])]
    check(spark, docs, texts)


def test_hot_table(spark, docs):
    """Exact copies, a large group of near copies, one passage that is most of many texts yet does not link them."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = ["copied text of more than five words here"] * 60
    texts += [f"{passage} {' '.join(f'u{rng.randrange(10**6)}' for _ in range(rng.randint(4, 16)))}" for _ in range(120)]
    texts += near_copies(rng, 1, 120, 90) + near_copies(rng, 20, 2)
    rng.shuffle(texts)
    check(spark, docs, texts)


def test_rows_without_an_id(spark):
    text = "a b c d e f g"
    table = spark.createDataFrame([(None, text, 1), (None, "other words of this row here", 1), (4, text, 2)], "doc_id long, text string, sig int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.jaccard_components(table).collect())
    assert got == [(0, 2, 0), (0, 3, 4), (4, 3, 4)]


def test_clashing_columns(spark, docs):
    texts = near_copies(random.Random(11), 4, 4)
    d = docs(*texts)
    for name in ("n", "sig", "d1", "c", "component", "component_id", "h", "block", "u"):
        d = d.withColumn(name, F.lit(1))
    out = ngram_join.one_of_each(d)
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in brute_components(texts)})


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    data = b" ".join([b"a", b"bc" * 40_000, b"d", b"ee", *[b"%d" % i for i in range(300)]])
    whole = [int(ngram_join.word_hashes(w)[0]) for w in data.split()]
    for piece in (1 << 19, 1000, 10):
        monkeypatch.setattr(ngram_join, "PIECE", piece)
        assert ngram_join.word_hashes(b"\n " + data + b" ").tolist() == whole
    assert len(set(whole)) == len(whole)


def test_one_of_each(spark, docs):
    texts = near_copies(random.Random(4), 10, 6) + [None, ""]
    d = docs(*texts)
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(d.unionByName(d.limit(1))).collect())
    assert kept == sorted({c for _, c in brute_components(texts)})


def test_no_documents(spark, docs):
    assert ngram_join.jaccard_components(docs("x").limit(0)).count() == 0


def vectors(spark, x, ids=None):
    return spark.createDataFrame([(int(i), None if v is None else [float(a) if a is not None else None for a in v]) for i, v in zip(ids if ids is not None else range(len(x)), x)], "vec_id long, embedding array<float>")


def test_recall_with_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (12, 16))[rng.integers(0, 12, 1500)] + rng.normal(0, 0.4, (1500, 16))
    x = np.concatenate([x, np.repeat(x[:1], 400, axis=0)]).astype(np.float32)
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 3, [1.1, 1.0, 1.0]]
    table = vectors(spark, [*x, *odd])
    ask = table.filter(F.col("vec_id") % 20 == 0)
    got = {}
    for r in vector_graph.search_index(vector_graph.build_index(table, 600), ask).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d = x.astype(np.float64)
    hits = total = 0
    for q in range(0, len(d), 20):
        dist = np.sqrt(((d - d[q]) ** 2).sum(axis=1))
        want = [i for i in np.lexsort((np.arange(len(d)), dist)).tolist() if i != q][:10]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(s == pytest.approx(dist[v], abs=1e-12) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(want))
        total += 10
    assert hits / total >= 0.95
    short = 1900 + 5  # the two vectors of length 3 find each other only
    assert all(short not in [v for _, v, _ in a] for a in got.values())


def test_repeated_queries_and_ids(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (40, 8)).astype(np.float32)
    x[7] = x[0]
    rows = [(i, x[i]) for i in range(40)] + [(0, x[0])] * 14 + [(5, x[5])] * 2 + [(1, x[i]) for i in range(20, 30)]
    table = vectors(spark, [v for _, v in rows], [i for i, _ in rows])
    found = vector_graph.search_index(vector_graph.build_index(table, 20), table.filter("vec_id in (0, 1)")).collect()
    d = np.stack([v for _, v in rows]).astype(np.float64)

    def want(q, v):
        dist = np.sqrt(((d - v) ** 2).sum(axis=1))
        return sorted((dist[p], i) for p, (i, _) in enumerate(rows) if i != q)[:10]

    # row 0 stands there 15 times and asks once; id 1 has 11 vectors, each a query of its own
    asked = [(0, x[0]), (1, x[1])] + [(1, x[i]) for i in range(20, 30)]
    expected = sorted((q, rank, i, s) for q, v in asked for rank, (s, i) in enumerate(want(q, v.astype(np.float64)), 1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found)
    assert [g[:3] for g in got] == [e[:3] for e in expected] and [g[3] for g in got] == pytest.approx([e[3] for e in expected], abs=1e-12)


def test_no_vectors(spark):
    table = vectors(spark, [None, [0.0, 0.0]])
    assert vector_graph.search_index(vector_graph.build_index(table), table).count() == 0


REC = "record_id long, url string, at long, kind string, headers map<string,string>"


def test_revisits(spark):
    rows = [
        (1, "http://Www.A.com:80/x/?utm_s=1#f", 1, "response", {"etag": '"1"', "content-type": "t", "date": "d1"}),
        (2, "https://a.com/x", 5, "revisit", {"etag": 'W/"1"', "date": "d2", "content-type": "no"}),
        (3, "https://a.com/x", 5000, "response", {"etag": '"2"', "last-modified": "m"}),
        (4, "https://a.com/x", 9000, "revisit", {"etag": '"1"'}),
        (5, "https://a.com/x", 9001, "revisit", {"last-modified": "m"}),
        (6, "https://a.com/x", 9002, "revisit", {}),
        (7, "https://a.com/y", 9, "revisit", {"etag": '"1"'}),
        (8, None, 9, "revisit", {"etag": '"1"'}),
        (9, "", 9, "response", None),
        (10, "https://a.com/x", 0, "revisit", None),
        (11, "https://a.com/x", None, None, None),
    ]
    table = spark.createDataFrame(rows, REC).withColumn("status", F.lit("clash"))
    got = {r.record_id: r for r in revisits.resolve_revisits(table.unionByName(table.limit(1))).collect()}
    assert {i: (r.target_id, r.status) for i, r in got.items()} == {
        1: (None, "response"), 2: (1, "resolved"), 3: (None, "response"), 4: (3, "mismatch"), 5: (3, "resolved"), 6: (3, "no validator"),
        7: (None, "no target"), 8: (None, "no target"), 9: (None, "response"), 10: (None, "no target"), 11: (None, "other"),
    }
    assert got[2].merged_headers == {"etag": 'W/"1"', "content-type": "t", "date": "d2"}
    bodies = spark.createDataFrame([(1, "page")], "record_id long, body string")
    assert {r.record_id: r.body for r in revisits.attach(revisits.resolve_revisits(table), bodies).collect()}[2] == "page"


def test_revisits_with_any_column_names(spark):
    rows = [(1, "http://a.com/x", 1, "response", {"etag": '"1"'}), (2, "https://www.a.com/x/", 2, "revisit", {"etag": '"1"'}), (3, "https://m.a.com/x", 3, "revisit", {"etag": '"1"'}), (4, "http://a.com/x?ref=1", 3, "revisit", None)]
    table, names = spark.createDataFrame(rows, REC), ("_span", "_near", "_full", "_stored", "_newer", "span", "near", "full", "stored", "newer", "row", "canon", "target", "before", "latest", "a.b", "body")
    for n in names:
        table = table.withColumn(n, F.lit(7))
    out = revisits.resolve_revisits(table)
    assert out.columns == [*table.columns, *revisits.ADDED]
    got = {r.record_id: r for r in out.collect()}
    assert {i: (r.target_id, r.status) for i, r in got.items()} == {1: (None, "response"), 2: (1, "resolved"), 3: (None, "no target"), 4: (None, "no target")}
    assert all(r[n] == 7 for r in got.values() for n in names)
    bodies = spark.createDataFrame([(1, "page")], "record_id long, body string")
    assert {r.record_id: r.body for r in revisits.attach(out, bodies).collect()} == {1: None, 2: "page", 3: None, 4: None}
    assert revisits.resolve_revisits(table.limit(0)).count() == 0


def test_many_captures_of_one_url(spark):
    rng = random.Random(6)
    rows = [(i, "http://h/x", rng.randrange(6000), rng.choice(["response", "revisit"]), {"etag": '"1"'}) for i in range(800)]
    got = {r.record_id: r.target_id for r in revisits.resolve_revisits(spark.createDataFrame(rows, REC)).collect()}
    last = None
    for i, _, at, kind, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        assert got[i] == (last if kind == "revisit" else None)
        last = i if kind == "response" else last


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
        docs = out
    packed = corpus_pipeline.run(spark, d)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
