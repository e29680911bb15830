"""Counts, rules, tokens and segmentations against brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tokenizers
import zstandard

from matrixmill.llm import nbest, packing, quality_rules, wordpiece

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def greedy(word, pieces):
    s, i, n = tuple(word) + (wordpiece.END,), 0, 0
    while i < len(s):
        j = next((j for j in range(len(s), i, -1) if s[i:j] in pieces), None)
        if j is None:
            return n if s[i:] == (wordpiece.END,) else -1
        i, n = j, n + 1
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(0)
    pieces = {tuple(rng.choices(b"abc", k=rng.randint(1, 5))) + rng.choice([(), (wordpiece.END,)]) for _ in range(40)} - {(97,)}
    words = [bytes(rng.choices(b"abc", k=rng.randint(1, 12))) for _ in range(3000)]
    assert wordpiece.Automaton(sorted(pieces)).lengths(words).tolist() == [greedy(w, pieces) for w in words]


def test_token_counts(spark, docs, odd):
    pieces = set(wordpiece.vocabulary(WORDS))
    got = rows(wordpiece.token_counts(docs(*odd), WORDS))
    for i, t in enumerate(odd):
        words = [w.encode() for w in regex.findall(wordpiece.WORD, (t or "").lower())]
        if sum(map(len, words)) < 10_000:
            assert (got[i].n_words, got[i].n_tokens, got[i].n_unknown) == (len(words), sum(greedy(w, pieces) for w in words), 0)
    assert got[5].n_words == 60_000 and got[5].n_tokens == 30_000 * (greedy(b"tail", pieces) + greedy(b".", pieces))
    assert wordpiece.token_counts(docs("x").limit(0), WORDS).count() == 0


def slow_counts(text):
    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(regex.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts(spark, docs, odd):
    rng = random.Random(1)
    texts = [t for t in odd if t is None or len(t) < 1000] + ["".join(rng.choices(["a ", "b ", "c\n", "é#", " ", "d\x0b"], k=rng.randint(0, 120))) for _ in range(60)]
    got = rows(quality_rules.compression_bands(docs(*texts)))
    for i, t in enumerate(texts):
        want = slow_counts(t or "")
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)


def test_compression_verdicts(spark, docs):
    rng = random.Random(2)
    plain = " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 9))) for _ in range(900))
    noise = " ".join("".join(chr(rng.randint(33, 0x2FF)) for _ in range(rng.randint(2, 9))) for _ in range(900))
    again = " ".join(["one long and tiring sentence that differs only in its number", *map(str, range(12))] * 60)
    half = plain + "\n" + "lorem ipsum dolor " * 500
    got = [r.verdict for r in sorted(quality_rules.compression_bands(docs(plain, noise, again, half)).collect(), key=lambda r: r.doc_id)]
    assert got[0] == "ok" and got[1] == "incompressible" and got[2] == "repetitive" and got[3] in ("chunks", "repetitive")
    ratio, n, bad, _ = quality_rules.compression(half.encode(), zstandard.ZstdCompressor(level=3))
    assert ratio == len(zstandard.ZstdCompressor(level=3).compress(half.encode())) / len(half.encode()) and bad >= n / 3


def test_packing_round_trip(spark, docs, odd):
    rng = random.Random(3)
    texts = odd + [" ".join(rng.choices(["tree", "House,", "été", "x1"], k=rng.randint(0, 400))) for _ in range(60)]
    texts += ["hi <|endoftext|> there", "<|startoftext|>", "a<|endoftext|><|endoftext|>B", "no <|ENDOFTEXT|> nor <|endoftext|", "<|Endoftext|>x <|endoftext|>"]
    own = tokenizers.Tokenizer.from_file(WORDS)  # at its defaults
    out = packing.best_two_fit(docs(*texts), WORDS, capacity=512, with_ids=True).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length <= 4 * 512
    for i, t in enumerate(texts):
        want = own.encode(t or "", add_special_tokens=False).ids + [1]
        ordered = [pieces[i][k] for k in range(len(pieces[i]))]
        assert np.frombuffer(b"".join(p.ids for p in ordered), "<u4").tolist() == want
        assert [p.start for p in ordered] == list(range(0, len(want), 512)) and all(p.length == 512 for p in ordered[:-1])
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r.length for r in out) // 512) + 1


def test_plan_covers_every_count():
    rng = np.random.default_rng(5)
    for _ in range(20):
        counts = np.zeros(101, np.int64)
        some = rng.integers(1, 101, 30)
        counts[some] = rng.integers(1, 50, 30)
        lines = packing.plan(counts, 100)
        fill = {}
        for x in lines.itertuples():
            for r in range(x.rank_from, x.rank_to):
                k = r - x.rank_from
                fill.setdefault(x.first_bin + k // x.per_bin, []).append((x.offset + k % x.per_bin * x.length, x.length))
        assert sum(len(v) for v in fill.values()) == counts.sum()
        for v in fill.values():
            v.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and v[0][0] == 0 and sum(v[-1]) <= 100


def plain_best_two_fit(lengths, capacity):
    """One document at a time: fill greedily with the longest that fits, then trade the smallest for the tightest two."""
    left, bins = sorted(lengths, reverse=True), 0
    while left:
        bin_, gap = [], capacity
        for x in list(left):
            if x <= gap:
                left.remove(x)
                bin_.append(x)
                gap -= x
        room = gap + bin_[-1]
        pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if bin_[-1] < a + b <= room]
        if gap and pairs:
            _, a, b = max(pairs)
            left.remove(a)
            left.remove(b)
            left = sorted([*left, bin_[-1]], reverse=True)
        bins += 1
    return bins


def test_as_few_bins_as_one_at_a_time():
    rng = np.random.default_rng(12)
    for low, high in ((1, 101), (20, 70), (30, 45), (51, 101)):
        for _ in range(4):
            lengths = rng.integers(low, high, 120)
            lines = packing.plan(np.bincount(lengths, minlength=101), 100)
            used = {x.first_bin + (r - x.rank_from) // x.per_bin for x in lines.itertuples() for r in range(x.rank_from, x.rank_to)}
            assert len(used) <= plain_best_two_fit(lengths.tolist(), 100)


def test_pack_of_nothing(spark, docs):
    assert packing.best_two_fit(docs("x").limit(0), WORDS).count() == 0


def test_smallest_piece_gives_way_to_two():
    counts = np.zeros(11, np.int64)
    counts[[7, 2, 1, 3]] = [1, 0, 2, 0]
    counts[2] = 1
    assert packing.improve([(7, 1), (1, 1)], counts, 10) == [(7, 1), (2, 1), (1, 1)]


def brute_paths(p, s):
    out = []

    def go(i, score):
        if i == len(s):
            out.append(score)
        for j in range(i + 1, min(len(s), i + p.longest) + 1):
            found = p.score.get(s[i:j])
            if found:
                go(j, score + found[0])
            elif j == i + 1:
                go(j, score + p.lowest * len(s[i].encode()))

    go(0, 0)
    return sorted(out, reverse=True)


def test_nbest_equals_enumeration(spark, docs):
    p = nbest.Pieces(open(PIECES, "rb").read())
    rng = random.Random(6)
    texts = ["the, cat.", "A b\nc é.", "hello  you", " lead", "日本 a", "", "x", "a.b,c!d"] + ["".join(rng.choices("abther .,\n", k=9)) for _ in range(30)]
    got = rows(nbest.segmentations(docs(*texts), PIECES, n=5, with_ids=True))
    for i, t in enumerate(texts):
        want = brute_paths(p, p.marked(t))[:5]
        assert [round(s * nbest.SCALE) for s in got[i].scores] == want, t
        assert [p.decode(x) for x in got[i].ids] == [t] * len(want) and len(set(map(bytes, got[i].ids))) == len(want)
        assert got[i].n_pieces == [len(x) // 4 for x in got[i].ids] and got[i].ids_crc32 == zlib.crc32(got[i].ids[0]) and got[i].round_trip
    back = rows(nbest.decoded(nbest.segmentations(docs(*texts), PIECES, n=1, with_ids=True), PIECES))
    assert [back[i].text for i in range(len(texts))] == texts


def test_nbest_of_odd_texts(spark, docs, odd):
    got = rows(nbest.segmentations(docs(*odd), PIECES))
    assert len(got) == len(odd) and got[0].n_segmentations == got[1].n_segmentations == 1 and got[0].n_pieces == [0]
    assert [got[i].round_trip for i in range(len(odd))] == ["▁" not in (t or "") for t in odd]
    assert all(list(r.scores) == sorted(r.scores, reverse=True) for r in got.values())


@pytest.mark.parametrize("f", [lambda d: wordpiece.token_counts(d, WORDS), quality_rules.compression_bands, lambda d: nbest.segmentations(d, PIECES)])
def test_extra_columns_do_not_matter(spark, docs, f):
    from pyspark.sql import functions as F

    d = docs("one two three", None)
    more = d.withColumn("score", F.lit(3)).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(None))
    assert sorted(map(str, f(d).collect())) == sorted(map(str, f(more).collect()))


def test_scores_from_both_ends_equal_the_search():
    p = nbest.Pieces(open(PIECES, "rb").read())
    rng = random.Random(7)
    parts = ["the", "▁hello", "日本", "a" * 80, "x", "\n", ""] + ["".join(rng.choices("abtherinég▁日", k=rng.randint(1, 14))) for _ in range(800)]
    for part, (score, n, lost, exact, ids) in zip(parts, p.best_and_second(parts), strict=True):
        want = p.choices(part, 2)
        assert score == want[0][0] and n == len(ids) // 4 and exact == p.exact(part, ids)
        assert lost == (want[0][0] - want[1][0] if len(want) > 1 else nbest.FAR)
