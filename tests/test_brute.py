"""Queries that SQL can't say against plain Python over the same small tables."""

import itertools
import math
import random
import re

import numpy as np
import pytest

from matrixmill.jobs import queries as Q
from matrixmill.jobs.model import event_cube
from matrixmill.operators import closed as CL
from matrixmill.operators import mining as M
from matrixmill.operators import tricluster as TC

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cube(spark):
    return [tuple(r) for r in event_cube(spark, DIR).select("context", "subject", "feature", "value").collect()]


def plain_runs(r, w, least):
    """Every widest run, found by trying all pairs of ends."""
    if not r:
        return []
    size, first = max(((b - a + 1, -a) for a in range(len(r)) for b in range(a, len(r)) if r[b] <= r[a] * (1 + w)))
    a, b = -first, -first + size - 1
    if size < least:
        return []
    start = a
    while b + 1 < len(r) and r[b + 1] <= r[b + 1 - least] * (1 + w):
        b += 1
    while start > 0 and r[start - 1 + least] <= r[start - 1] * (1 + w):
        start -= 1
    return plain_runs(r[:start], w, least) + [(start, b)] + [(b + 1 + p, b + 1 + q) for p, q in plain_runs(r[b + 1 :], w, least)]


def plain_edges(cube, w, least):
    value = {(c, s, f): v for c, s, f, v in cube if v}
    out = []
    for c in sorted({k[0] for k in value}):
        for i, j in itertools.combinations(range(5), 2):
            ratios = sorted((value[c, i, f] / value[c, j, f], f) for f in {k[2] for k in value} if (c, i, f) in value and (c, j, f) in value)
            out += [(c, i, j, tuple(sorted(f for _, f in ratios[p : q + 1]))) for p, q in plain_runs([x for x, _ in ratios], w, least)]
    return out


def plain_rectangles(edges, least):
    found = set()

    def grow(c, subjects, features):
        found.add((c, subjects, features))
        for c2, i, j, more in edges:
            both = tuple(sorted(set(features) & set(more)))
            if c2 == c and i == subjects[-1] and len(both) >= least:
                grow(c, (*subjects, j), both)

    for c, i, j, f in edges:
        grow(c, (i, j), f)
    return {x for x in found if not any(y != x and y[0] == x[0] and set(x[1]) <= set(y[1]) and set(x[2]) <= set(y[2]) for y in found)}


def plain_cubes(rectangles, contexts, subjects, features):
    found = set()

    def grow(cs, ss, fs):
        if len(cs) >= contexts:
            found.add((cs, ss, fs))
        for c, s, f in rectangles:
            s2, f2 = tuple(sorted(set(ss) & set(s))), tuple(sorted(set(fs) & set(f)))
            if c > cs[-1] and len(s2) >= subjects and len(f2) >= features:
                grow((*cs, c), s2, f2)

    for c, s, f in rectangles:
        grow((c,), s, f)
    return {x for x in found if not any(y != x and all(set(p) <= set(q) for p, q in zip(x, y)) for y in found)}


def test_edges_rectangles_and_cubes(spark, cube):
    edges = plain_edges(cube, 0.05, 3)
    got = [(r.context, r.i, r.j, tuple(r.features)) for r in Q.QUERIES["pm17_edges"](spark, DIR).collect()]
    assert sorted(got) == sorted(edges) and got
    rectangles = plain_rectangles(edges, 3)
    assert {(r.context, tuple(r.subjects), tuple(r.features)) for r in Q.QUERIES["pm18_rectangles"](spark, DIR).collect()} == rectangles
    cubes = plain_cubes(rectangles, 2, 2, 3)
    assert {(tuple(r.contexts), tuple(r.subjects), tuple(r.features)) for r in Q.QUERIES["pm19_pm22_triclusters"](spark, DIR).collect()} == cubes


def test_runs_by_all_pairs():
    """Random ratios of every density, ties among them, against trying all ends."""
    rng = random.Random(7)
    for _ in range(300):
        n, spread = rng.randint(0, 40), rng.choice([0.01, 0.3, 2, 8])
        r = sorted(round(1 + spread * rng.random(), rng.choice([2, 6])) for _ in range(n))
        for w, least in ((0.05, 1), (0.05, 3), (0.2, 4)):
            assert TC.runs(r, w, least) == sorted(plain_runs(r, w, least))


def test_runs_of_many_ratios():
    """A dense and a sparse million."""
    for spread in (100, 1e9):
        r = np.sort(np.random.default_rng(1).uniform(1, spread, 1_000_000) if spread == 100 else np.exp(np.random.default_rng(1).uniform(0, 3e5 / 6e2, 20_000)))
        found = TC.runs(r, 0.001, 3)
        assert found and all(b - a + 1 >= 3 for a, b in found) and all(x[1] < y[0] for x, y in zip(found, found[1:]))


def boxes(spark):
    return {r.id: (set(r.contexts), set(r.subjects), set(r.features)) for r in Q._small_boxes(spark, DIR).collect()}


def cells(box):
    return set(itertools.product(*box))


def test_covered_boxes_go_in_order(spark):
    left = boxes(spark)
    for i in sorted(left):
        others = set().union(*(cells(b) for j, b in left.items() if j != i))
        if len(cells(left[i]) & others) >= 0.8 * len(cells(left[i])):
            del left[i]
    assert sorted(r.id for r in Q.QUERIES["pm20_delete_covered"](spark, DIR).collect()) == sorted(left)


def test_chain_of_covered_boxes(spark, monkeypatch):
    """500 boxes, each half in the next and half in the one before: every second one goes. A few rounds, not one a box."""
    rows = [(i, [0], [0], [i, i + 1]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, contexts array<int>, subjects array<int>, features array<int>")
    left, there = [], {}
    for i, *_, f in rows:
        present = [x for j, *_, x in rows if j > i] + [there[j] for j in left]
        if len({c for x in present for c in x} & set(f)) < 0.9 * len(f):
            left.append(i)
            there[i] = f
    rounds = []
    plain = TC._cut
    monkeypatch.setattr(TC, "_cut", lambda df: (rounds.append(1), plain(df))[1])
    assert sorted(r.id for r in TC.without_covered(df, 0.9).collect()) == left
    assert len(rounds) < 40
    # blocks of a few cells settle the same
    few = df.filter("id < 12")
    assert sorted(r.id for r in TC.without_covered(few, 0.9, block_cells=8).collect()) == [i for i in left if i < 11] + [11]


def test_boxes_merge_to_a_fixpoint(spark):
    left = boxes(spark)
    while True:
        fit = {}
        for a, b in itertools.combinations(sorted(left), 2):
            union = tuple(p | q for p, q in zip(left[a], left[b]))
            if len(cells(left[a]) | cells(left[b])) >= 0.9 * len(cells(union)):
                fit.setdefault(a, (b, union))
        first = {}
        for a, (b, union) in fit.items():
            if b not in {x for x, _ in first.values()}:
                first[a] = (b, union)
        first = {a: x for a, x in first.items() if a not in {b for b, _ in first.values()}}
        if not first:
            break
        for a, (b, union) in first.items():
            left[a] = union
            del left[b]
    got = {r.id: (set(r.contexts), set(r.subjects), set(r.features)) for r in Q.QUERIES["pm21_merge_cubes"](spark, DIR).collect()}
    assert got == left


def test_content_words(spark):
    from pyspark.ml.feature import StopWordsRemover

    stop = set(StopWordsRemover.loadDefaultStopWords("english"))

    def singular(w):
        w = re.sub(r"^(\w{2,})ies$", r"\1y", w)
        w = re.sub(r"^(\w+ss)es$", r"\1", w)
        return re.sub(r"^(\w{2,}[^sui])s$", r"\1", w)

    want = {}
    for doc_id, text in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect():
        if doc_id is not None and text is not None:
            words = [singular(w) for w in re.split("[^a-z]+", text.lower()) if len(w) > 1 and w not in stop]
            want[doc_id] = (len(words), len(set(words)))
    assert {r.doc_id: (r.n_words, r.n_distinct) for r in Q.QUERIES["str1_content_words"](spark, DIR).collect()} == want


def plain_closed_sets(rows, least, min_size):
    """Every intersection of transactions is closed, and every closed set is one."""
    found = {frozenset(r) for r in rows}
    todo = set(found)
    while todo:
        todo = {a & b for a in todo for b in map(frozenset, rows)} - found
        found |= todo
    held = {s: [i for i, r in enumerate(rows) if s <= set(r)] for s in found}
    return {(tuple(sorted(s)), tuple(r)) for s, r in held.items() if len(s) >= min_size and len(r) >= least}


def test_closed_itemsets_of_random_rows(spark):
    rng = random.Random(2)
    rows = [sorted(rng.sample(range(100, 112), rng.randint(0, 9))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "row int, items array<int>")
    for share, size in ((0.1, 1), (0.3, 2), (1.0, 1)):
        got = {(tuple(r["items"]), tuple(r.rows)) for r in M.closed_itemsets(df, share, size).collect()}
        assert got == plain_closed_sets(rows, max(1, math.ceil(share * len(rows))), size)
    assert M.closed_itemsets(df.limit(0), 0.5).count() == 0


def plain_closed_sequences(rows, least, min_size):
    """All weak orders of all column sets that so many rows agree on, without those that one column more leaves with as many rows."""
    rank = [{c: g for g, group in enumerate(r) for c in group} for r in rows]
    columns = sorted({c for r in rank for c in r})
    held = {}
    for k in range(1, len(columns) + 1):
        for cols in itertools.combinations(columns, k):
            by_order = {}
            for i, r in enumerate(rank):
                if all(c in r for c in cols):
                    levels = sorted({r[c] for c in cols})
                    by_order.setdefault(tuple(tuple(c for c in cols if r[c] == x) for x in levels), []).append(i)
            held |= {p: tuple(v) for p, v in by_order.items() if len(v) >= least}
    less = {(tuple(g for g in (tuple(c for c in g if c != x) for g in p) if g), len(v)) for p, v in held.items() for x in itertools.chain(*p)}
    return {(p, v) for p, v in held.items() if sum(map(len, p)) >= min_size and (p, len(v)) not in less}


def test_closed_sequences_of_random_rows(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(30):
        cols = rng.sample(range(6), rng.randint(0, 6))
        rows.append([sorted(c for c in cols if c % 3 == g or (c + 1) % 3 == g and c > 3) for g in range(3)])
    rows = [[g for g in r if g] for r in rows]
    rows = [[[c for c in g if not any(c in h for h in r[:i])] for i, g in enumerate(r)] for r in rows]
    rows = [[g for g in r if g] for r in rows] + [[[5], [0, 1], [2]], [[0], [1], [5]]] * 3
    df = spark.createDataFrame(list(enumerate(rows)), "row int, sequence array<array<int>>")
    for share, size in ((0.1, 1), (0.2, 2)):
        got = {(tuple(map(tuple, r.sequence)), tuple(r.rows)) for r in M.closed_sequences(df, share, size).collect()}
        assert got == plain_closed_sequences(rows, math.ceil(share * len(rows)), size)


def test_search_goes_on_where_it_waited(spark, monkeypatch):
    """Falling bounds find what each bound alone finds, also when little is weighed and held at once; no candidate is weighed twice."""
    monkeypatch.setattr(CL, "CHUNK", 7)
    monkeypatch.setattr(CL, "HELD", 5)
    rng = random.Random(4)
    rows = [sorted(rng.sample(range(10), rng.randint(2, 8))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(rows)), "row int, items array<int>")
    kind = CL.Itemsets(df, 3)
    weighed = []
    plain = kind.weigh
    kind.weigh = lambda c: (weighed.extend((b, i) for b, i, _ in c), plain(c))[1]
    search = CL.Search(kind, 2, 3)
    for least in (20, 12, 6, 3):
        search.lower(least)
        assert search.n == len(plain_closed_sets(rows, least, 2))
    assert len(weighed) == len(set(weighed))
    assert {(tuple(r["items"]), tuple(r.rows)) for r in search.patterns().collect()} == plain_closed_sets(rows, 3, 2)


def test_alike_columns_are_one_pattern(spark):
    """30 columns that are the same, and 25 columns in one order: one pattern each, in a few passes."""
    same = spark.createDataFrame([(r, list(range(30))) for r in range(20)] + [(20 + r, [100 + r]) for r in range(10)], "row int, items array<int>")
    assert [(r["items"], r.support) for r in M.closed_itemsets(same, 0.5).collect()] == [(list(range(30)), 20)]
    order = spark.createDataFrame([(r, [[c] for c in range(25)]) for r in range(20)], "row int, sequence array<array<int>>")
    assert [(r.sequence, r.support) for r in M.closed_sequences(order, 0.5).collect()] == [([[c] for c in range(25)], 20)]


def test_block_of_many_subjects_is_one_rectangle(spark):
    """30 subjects that run together over 6 features, in two contexts: one rectangle each and one cube, not 2 ** 30; beyond the bound of a task, joins give the same."""
    edges = [(c, i, j, [1, 2, 3, 4, 5, 6]) for c in range(2) for i, j in itertools.combinations(range(30), 2)]
    df = spark.createDataFrame(edges, "context int, i int, j int, features array<int>")
    found = TC.rectangles(df, 2, 3)
    assert [(r.context, r.subjects, r.features) for r in found.orderBy("context").collect()] == [(c, list(range(30)), [1, 2, 3, 4, 5, 6]) for c in range(2)]
    assert [(r.contexts, len(r.subjects), len(r.features)) for r in TC.cubes(found, 2, 2, 3).collect()] == [([0, 1], 30, 6)]
    few = df.filter("j < 5")
    rows = lambda x: sorted(map(str, x.collect()))
    assert rows(TC.rectangles(few, 2, 3, context_bytes=1)) == rows(TC.rectangles(few, 2, 3))


@pytest.mark.parametrize("seed", range(3))
def test_rectangles_and_cubes_of_random_edges(spark, seed):
    """Overlapping runs of every size, so that much is contained in part only."""
    rng = random.Random(seed)
    edges = {(c, i, j, tuple(sorted(rng.sample(range(9), rng.randint(3, 8))))) for c in range(4) for i, j in itertools.combinations(range(5), 2) for _ in range(rng.randint(0, 2))}
    df = spark.createDataFrame(sorted(edges), "context int, i int, j int, features array<int>")
    want = plain_rectangles(sorted(edges), 2)
    found = TC.rectangles(df, 2, 2)
    assert {(r.context, tuple(r.subjects), tuple(r.features)) for r in found.collect()} == want
    for contexts in (1, 2, 3):
        got = [(tuple(r.contexts), tuple(r.subjects), tuple(r.features)) for r in TC.cubes(found, contexts, 2, 2).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_cubes(sorted(want), contexts, 2, 2)
