"""The n-gram trie against a plain model in dictionaries, and Elias-Fano sequences against sorted lists."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixmill.llm import ngram_trie as N
from matrixmill.llm.elias_fano import EliasFano


@pytest.mark.parametrize(("n", "universe"), [(0, 10), (1, 1), (1, 1 << 40), (5, 5), (1000, 1000), (1000, 1 << 33), (70000, 90000), (3000, 1 << 20)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    x = np.sort(rng.integers(0, universe, n))
    ef = EliasFano(**{k: np.frombuffer(v.tobytes(), v.dtype) for k, v in EliasFano.of(x, universe).parts().items()})
    assert (ef[np.arange(n)] == x).all()
    y = np.concatenate([x[:500], rng.integers(0, universe, 500), [0, universe - 1]])
    at, there = ef.find(y)
    assert (at == np.searchsorted(x, y)).all() and (there == np.isin(y, x)).all()
    if n > 1000:  # about 2 + log2(universe / n) bits each, and a directory
        bits = 64 * (len(ef.low) + len(ef.high) + len(ef.ones))
        assert bits < n * (6 + max(0, math.log2(universe / n)))


def test_packed_numbers():
    for x in (np.zeros(0, np.uint64), np.array([0, 0, 3, 2**64 - 1], np.uint64), np.arange(300, dtype=np.uint64)):
        assert (N.unpack(N.pack(x)) == x).all() and (N.unpack_sorted(N.pack_sorted(x)) == x).all()


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain(docs, n_words):
    """Rows as the operator's; ties of the most frequent words are broken by it, so texts must not tie there."""
    learned = [tokens(t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in learned for w in t)
    end = len(learned)
    total, kinds = sum(c.values()) + end, len(c) + (end > 0)
    h = {w: int(np.int64(np.uint64(N.hashed([w])[0][0]).view(np.int64))) for w in c}
    top = set(sorted(c, key=lambda w: (-c[w], h[w]))[:n_words])
    rare = sum(k for w, k in c.items() if w not in top)
    name = lambda w: w if w in top else None
    p1 = {w: c[w] / (total + 1) for w in top} | {None: (rare + 1) / (total + 1), "\n": end / (total + 1)}
    two, three = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for t in learned:
        x = [" ", " ", *map(name, t), "\n"]
        for u, v, w in zip(x, x[1:], x[2:]):
            two[v][w] += 1
            three[u, v][w] += 1
    q = lambda p: min(round(-math.log10(p) * N.STEP), 65535)

    def code(u, v, w):
        if not total:
            return 0
        out, p = q(p1[w]), p1[w]
        if v in two:
            n = sum(two[v].values())
            g = N.DISCOUNT * len(two[v]) / n
            p = max(two[v][w] - N.DISCOUNT, 0) / n + g * p
            out = q(p) if w in two[v] else out + q(g)
        if (u, v) in three:
            n = sum(three[u, v].values())
            g = N.DISCOUNT * len(three[u, v]) / n
            out = q((three[u, v][w] - N.DISCOUNT) / n + g * p) if w in three[u, v] else out + q(g)
        return out

    out = []
    for i, text in docs:
        t = tokens(text)
        x = [" ", " ", *map(name, t), "\n"]
        score = -sum(code(*z) for z in zip(x, x[1:], x[2:])) / N.STEP
        for w in t:
            if w not in top:
                score += math.log10((c[w] - N.DISCOUNT if c[w] else N.DISCOUNT * (len(c) - len(top)) + 1) / (rare + 1))
        n = [*(c[w] for w in t), end]
        base = sum(math.log10((k + 0.1) / (total + 0.1 * (kinds + 1))) for k in n)
        out.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(n), sum(k > 0 for k in n), total, base, score))
    return sorted(out)


def same(got, want):
    got = sorted((str(r[0]), *r[1:]) for r in got)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(got, want) for a, b in zip(x[5:], y[5:]))


def run(spark, docs, n_words, shard_bytes):
    df = spark.createDataFrame(docs, "doc_id long, text string").select(F.lit("x").alias("score"), F.lit(1).alias("flush"), F.lit(2).alias("kind"), "doc_id", "text")
    return N.scored(df, N.id_mod(F.col("doc_id"), 10) != 0, N.held_out(F.col("doc_id"), 10, 0), n_words, shard_bytes).collect()


@pytest.mark.parametrize(("n_words", "shard_bytes"), [(N.WORDS, 1 << 24), (40, 1 << 24), (40, 1500), (3, 400)])
def test_scores_by_brute_force(spark, odd, n_words, shard_bytes):
    """Few words of their own put much into the rare class; small shards deal frequent middle words over many."""
    rng = np.random.default_rng(4)
    words = [f"{chr(97 + i % 26)}{i}" for i in range(80)]
    texts = [" ".join(rng.choice(words, 40, p=(w := 1 / np.arange(1, 81)) / w.sum())) for _ in range(120)]
    docs = [*enumerate([*odd[:8], *texts, "B1 b1 B1\tb1 c2"]), (None, "a0 b1 a0 b1"), (7, "word"), (7, "word")]
    same(run(spark, docs, n_words, shard_bytes), plain(docs, n_words))


def test_nothing_learned_and_no_rows(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    docs = [(held[0], "some text"), (None, None)]
    same(run(spark, docs, 10, 1 << 20), plain(docs, 10))
    assert run(spark, [(1, None)], 10, 1 << 20)[0].n_known == 1
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.scored(df, F.lit(True), F.lit(False)).count() == 0


def test_probabilities_sum_to_one():
    """Over the words, the end and the rare class, after any two tokens, up to quantisation; within the class likewise."""
    rng = np.random.default_rng(0)
    text = " ".join(f"w{int(i)}" for i in rng.zipf(1.5, 3000) % 50)
    h, sizes = N.hashed([text[a : a + 90] for a in range(0, len(text), 90)])
    kinds, n = np.unique(h, return_counts=True)
    top = np.argsort(-n, kind="stable")[:12]
    words = N.Words(kinds[top], n[top], len(h), len(kinds), len(sizes), 1)
    x, at = N.sequences(words, h, sizes)
    key = (x[at - 1] << 32 | x[at - 2] << 16 | x[at]).astype(np.uint64)
    three, n3 = np.unique(key, return_counts=True)
    two, n2 = np.unique((x[at - 1] << 16 | x[at]).astype(np.uint64), return_counts=True)
    trie = N.Trie(N.mapped(N.Trie.levels(three, n3, two, n2, words.p)), words.code)
    ids = np.array([*range(12), N.END, N.RARE], np.uint64)
    for u in (0, 5, 11, N.START, N.RARE):
        for v in (0, 3, N.START, N.RARE):
            codes = trie.codes(np.uint64(v << 32 | u << 16) | ids)
            assert abs((10 ** (-codes / N.STEP)).sum() - 1) < 1e-3
    rare = np.setdiff1d(np.arange(len(kinds)), top)
    assert abs((10 ** words.within_rare(np.append(n[rare], 0))).sum() - 1) < 1e-9


def test_levels_answer_as_the_scores_do(spark):
    docs = spark.createDataFrame([(i, f"the cat sat on the {w}") for i, w in enumerate(["mat", "hat", "mat", "dog", "cat"] * 5)], "doc_id long, text string")
    rows = N.levels(docs, F.lit(True), shard_bytes=60).collect()
    assert len(rows) > 1 and all(r.levels and r.head for r in rows)


def plain_of_all(docs):
    """Rows as the operator's, every word told apart."""
    learned = [tokens(t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    c = collections.Counter(w for t in learned for w in t)
    if learned:
        c["\n"] = len(learned)
    total, kinds = sum(c.values()), len(c)
    one = lambda w: (c[w] - N.DISCOUNT if w in c else N.DISCOUNT * kinds + 1) / (total + 1)
    two, three = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for t in learned:
        x = [" ", " ", *t, "\n"]
        for u, v, w in zip(x, x[1:], x[2:]):
            two[v][w] += 1
            three[u, v][w] += 1
    sums = {k: sum(n.values()) for d in (two, three) for k, n in d.items()}
    q = lambda p: min(round(-math.log10(p) * N.STEP), 65535)

    def code(u, v, w):
        p = one(w)
        out = q(p)
        for follow, key in ((two, v), (three, (u, v))):
            if key in follow:
                g = N.DISCOUNT * len(follow[key]) / sums[key]
                p = max(follow[key].get(w, 0) - N.DISCOUNT, 0) / sums[key] + g * p
                out = q(p) if w in follow[key] else out + q(g)
        return out

    out = []
    for i, text in docs:
        t = tokens(text)
        x = [" ", " ", *t, "\n"]
        base = sum(math.log10((c.get(w, 0) + 0.1) / (total + 0.1 * (kinds + 1))) for w in x[2:])
        score = -sum(code(*z) for z in zip(x, x[1:], x[2:])) / N.STEP
        out.append((str(i), i is not None and zlib.crc32(str(i).encode()) % 10 == 0, len(t) + 1, sum(w in c for w in x[2:]), total, base, score))
    return sorted(out)


@pytest.mark.parametrize(("short", "shard_bytes"), [(N.WORDS, 1 << 24), (40, 1 << 24), (40, 1500), (3, 400), (0, 3000)])
def test_every_word_is_told_apart(spark, odd, short, shard_bytes):
    """Few short ids leave most words to go by hash; the result is the same."""
    rng = np.random.default_rng(5)
    words = [f"{chr(97 + i % 26)}{i}" for i in range(80)]
    texts = [" ".join(rng.choice(words, 40, p=(w := 1 / np.arange(1, 81)) / w.sum())) for _ in range(120)]
    docs = [*enumerate([*odd[:8], *texts, "B1 b1 B1\tb1 c2", "new words new words a0 new"]), (None, "a0 b1 a0 b1"), (7, "word"), (7, "word")]
    docs += [(i, "never seen a0 b1 never seen") for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = N.scored(df, N.id_mod(F.col("doc_id"), 10) != 0, N.held_out(F.col("doc_id"), 10, 0), None, shard_bytes, short).collect()
    same(got, plain_of_all(docs))


def test_more_words_than_short_ids(spark):
    """70,000 words, so some must go by hash; before, all beyond the 65,533 most frequent were one word to the model."""
    texts = [" ".join(f"w{700 * i + k}" for k in range(700)) for i in range(100)]
    docs = [*enumerate(texts + [" ".join(t.split()[::-1]) for t in texts] + texts[::-1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = N.scored(df, N.id_mod(F.col("doc_id"), 10) != 0, N.held_out(F.col("doc_id"), 10, 0)).collect()
    same(got, plain_of_all(docs))


def test_nothing_learned_of_words_by_hash(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0]
    df = spark.createDataFrame([(held[0], "some text"), (None, None)], "doc_id long, text string")
    rows = N.scored(df, N.id_mod(F.col("doc_id"), 10) != 0, N.held_out(F.col("doc_id"), 10, 0)).collect()
    assert [r.score for r in rows] == [0, 0]


def test_nodes_of_wide_ids():
    """Keys of three ids that fit 64 bits and such that do not give the same nodes."""
    rng = np.random.default_rng(1)
    ids, counts = [rng.integers(0, 9, 500).astype(np.uint64) for _ in range(3)], rng.integers(1, 5, 500)
    a, b = N.Trie.nodes(ids, counts, 20), N.Trie.nodes(ids, counts, 30)
    assert (N.joint(30, *N.apart(a[0], 20, 2)) == b[0]).all() and all((x == y).all() for x, y in zip(a[1:], b[1:]))


def test_wide_keys():
    rng = np.random.default_rng(2)
    x = rng.choice(np.array([3, 9, N.START, N.END, 1 << 20, (1 << 64) - 5, 1 << 63], np.uint64), (3, 400))
    names, i = N.numbered(x.ravel())
    order = np.lexsort(i.reshape(3, -1)[::-1])
    given, ids = N.unpack_wide(N.pack_wide(names, *i.reshape(3, -1)[:, order]), 3)
    assert (np.stack([N.by_name(given, k) for k in ids]) == x[:, order]).all()


@pytest.mark.parametrize("n", [1, 2, 900, 70_000, 150_000])
def test_many_look_ups_in_order(n):
    """Ascending look-ups answer as single ones do, gaps, repeats and runs' ends included."""
    rng = np.random.default_rng(n)
    x = np.sort(np.concatenate([rng.integers(0, 40 * n, n - n // 2), rng.integers(7 * n, 7 * n + n // 8 + 1, n // 2)]))
    ef = EliasFano.of(x, 50 * n)
    y = np.sort(np.concatenate([x[::3], rng.integers(0, 50 * n, n // 2), x[-1:], x[65_535:65_537], [0, 50 * n - 1]]))
    at, there = ef.find(y)
    assert (at == np.searchsorted(x, y)).all() and (there == np.isin(y, x)).all()
    i = np.sort(np.concatenate([rng.integers(0, n, n // 2), [0, n - 1, n - 1]]))
    assert (ef[i] == x[i]).all()


def test_many_look_ups_read_each_number_once(monkeypatch):
    """Numbers close together took a binary search each: some 17 reads a look-up here."""
    ef, read = EliasFano.of(np.arange(100_000) + (1 << 20), 1 << 36), []
    low = EliasFano._low
    monkeypatch.setattr(EliasFano, "_low", lambda self, i: read.append(len(i)) or low(self, i))
    at, there = ef.find(np.arange(100_000) + (1 << 20))
    assert (at == np.arange(100_000)).all() and there.all() and sum(read) < 110_000


def small_trie(ids, counts, bits):
    v, u, w = ids
    two, place = np.unique(N.joint(bits, v, w), return_inverse=True)
    n2 = np.bincount(place, counts).astype(np.int64)
    p1 = np.full(1 << N.ID_BITS, 1 / 9)
    return N.Trie(N.Trie.laid(*N.Trie.nodes(ids, counts, bits), two, n2, p1[: len(two)], np.zeros(0, np.uint64)), N.code(p1))


def test_each_pair_is_searched_once(monkeypatch):
    """However often texts ask a trigram, and however many trigrams share a pair; before, every trigram asked was searched."""
    rng = np.random.default_rng(3)
    ids, counts = [rng.integers(0, 9, 5000).astype(np.uint64) for _ in range(3)], rng.integers(1, 5, 5000)
    trie, find, sizes = small_trie(ids, counts, N.ID_BITS), EliasFano.find, []
    asked = N.joint(N.ID_BITS, *(np.concatenate([x, rng.integers(0, 12, 500).astype(np.uint64)]) for x in ids))
    one_by_one = np.concatenate([trie.codes(k) for k in asked[-700:].reshape(-1, 1)])
    monkeypatch.setattr(EliasFano, "find", lambda self, y: sizes.append(len(y)) or find(self, y))
    assert (trie.codes(asked)[-700:] == one_by_one).all()
    assert len(sizes) == 3 and sizes[0] <= 12**2 and sizes[1] <= 12**2 and sizes[2] <= 9**3


def test_look_ups_of_wide_ids(monkeypatch):
    """Keys of three ids that don't fit 64 bits give the same answers."""
    rng = np.random.default_rng(6)
    ids, counts = [rng.integers(0, 9, 400).astype(np.uint64) for _ in range(3)], rng.integers(1, 5, 400)
    other = np.stack([np.concatenate([x, rng.integers(0, 12, 300).astype(np.uint64)]) for x in ids])
    other = np.unique(other, axis=1)  # in order by column
    found = []
    for bits in (20, 22, 30):
        monkeypatch.setattr(N, "bits_of", lambda names, bits=bits: bits)
        found.append(small_trie(ids, counts, bits).found(*N.trigram_keys(list(other), bits)))
    assert all((a == b).all() for f in found[1:] for a, b in zip(found[0], f))


def test_blocks_of_wide_ids(monkeypatch):
    """A block of so many words that three ids don't fit 64 bits asks the same."""
    texts = [" ".join(f"w{i * k % 50}" for k in range(60)) for i in range(40)]
    h, sizes = N.hashed(texts)
    kinds, n = np.unique(h, return_counts=True)
    words = N.Words(kinds[:20], n[:20], len(h), len(kinds), len(sizes), 3, True)
    monkeypatch.setattr(N, "map_blocks", lambda docs, send: send)
    rows = []
    for bits in (17, 22):
        monkeypatch.setattr(N, "bits_of", lambda names, bits=bits: bits)
        sent = list(N.asked(None, words)(0, h, sizes, np.arange(40) % 5 > 0, np.arange(40) % 5 == 0, list(range(40))))
        rows.append([])
        for s, kind, flush, a, b, c in sent:
            if kind in (N.TRAIN_WIDE, N.ASKED_WIDE):
                names, ids = N.unpack_wide(a, 3)
                a = [N.by_name(names, x).tolist() for x in ids]
            rows[-1].append((s, kind, flush, a, b, c))
    assert rows[0] == rows[1] and {r[1] for r in rows[0]} == {N.TRAIN, N.ASKED, N.TRAIN_WIDE, N.ASKED_WIDE, N.RARE_ASKED, N.DOCS}


def test_short_ids_by_leading_bits():
    """Words that share their leading bits, the first and last hash, and hashes of no word."""
    rng = np.random.default_rng(8)
    known = np.unique(np.concatenate([rng.integers(1 << 17, 1 << 63, 3000), (5 << 50) + np.arange(40)]).astype(np.uint64))
    known = np.append(known, np.uint64((1 << 64) - 1))
    top = rng.permutation(known)
    words = N.Words(top, np.ones(len(top), np.int64), len(top), len(top), 1, 1, True)
    asked = np.concatenate([top, known + np.uint64(1), known - np.uint64(1)])
    ids = {h: i for i, h in enumerate(top.tolist())}
    assert words.of(asked).tolist() == [ids.get(h, N.RARE) for h in asked.tolist()]
    assert (N.Words(top[:0], np.zeros(0, np.int64), 5, 5, 1, 1, True).of(asked) == N.RARE).all()
