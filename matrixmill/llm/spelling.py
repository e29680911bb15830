"""Spelling variants by anagram hashing.

A word's key is the sum of the fifth powers of its letters, so anagrams share it whatever their order, and one letter
added, removed or exchanged moves it by that letter's value, or by the difference of two. Keys that differ by such a
value meet in an equi-join: each word gives its key, and its key less each of its letters. A key equal to another's less
a letter is an addition or removal; two keys equal once each lacks a letter are an exchange. No two pairs of letters of
the alphabet have the same difference of fifth powers, so a pair meets under one key only. Letter order is then verified.

Anagrams of one key may be many, and most are not near. One edit leaves what lies before the middle or what lies after
it as it was, so the join's key also names one of those halves, and words meet only if they share it; a pair that shares
both is taken from the first.

A word's form is its most frequent near word, if that is at least TIMES as frequent. Forms grow TIMES at each step, so
chains are no longer than the number of digits of the largest count, and roots are found by doubling steps.

Defined cases: null texts and texts without a letter have no words; a row without an id is counted with no letter
deleted; repeated rows count each; texts are read whole, and words of any length take part (keys are kept modulo
2^61 - 1); of near words with equal n the smaller in code-point order is the form; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import Tables, read

LEAST_LETTERS, LEAST_COUNT, TIMES, MARK = 7, 2, 10, 31
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
POWER, MODULUS = 5, (1 << 61) - 1


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every run of letters, A-Z lower-cased."""
    found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[{LETTERS}]+"), F.lit(0))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.explode(found).alias("run"))


def marked(doc_id: Column, run: Column) -> Column:
    """The run, without one letter where MARK divides the crc32 of doc_id:run."""
    h = F.crc32(F.concat(doc_id, F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % MARK == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that are long and frequent enough. Counts are added up in each task before they move."""
    words = runs(docs).select(marked(F.col("doc_id"), F.col("run")).alias("word")).filter(F.char_length("word") >= LEAST_LETTERS)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_COUNT)


def keyed(words: DataFrame) -> DataFrame:
    """(sig, key, size, side, whole, word, n): a word's key and its key less each letter, each with either half. size: letters in the key."""
    power = lambda c: F.pow(F.ascii(c).cast("double"), F.lit(float(POWER))).cast("long")  # noqa: E731 (exact: below 2^41)
    letters = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), power)
    size = F.char_length("word")
    key = F.aggregate("letters", F.lit(0).cast("long"), lambda s, p: (s + p) % MODULUS)
    less = F.transform(F.array_distinct("letters"), lambda p: F.struct(F.pmod(F.col("key") - p, F.lit(MODULUS)).alias("key"), (size - 1).alias("size"), F.lit(False).alias("whole")))
    whole = F.struct("key", size.alias("size"), F.lit(True).alias("whole"))
    each = words.withColumn("letters", letters).withColumn("key", key).select("word", "n", F.explode(F.concat(F.array(whole), less)).alias("k"))
    sided = each.select("word", "n", "k.*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    before = F.floor(F.col("size") / 2).cast("int")
    half = F.when(F.col("side") == 0, F.left("word", before)).otherwise(F.right("word", F.col("size") - before))
    return sided.select(F.xxhash64("key", "size", "side", half).alias("sig"), "key", "size", "side", "whole", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), a before b: words that differ by exactly one letter inserted, deleted or replaced, each pair once."""
    entries = keyed(words)
    a, b = entries.alias("a"), entries.alias("b")
    same = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.size") == F.col("b.size")) & (F.col("a.side") == F.col("b.side"))
    once = (F.col("a.word") < F.col("b.word")) & ~(F.col("a.whole") & F.col("b.whole"))
    before = F.floor(F.col("a.size") / 2).cast("int")
    first = (F.col("a.side") == 0) | (F.left("a.word", before) != F.left("b.word", before))
    met = a.join(b, same & once).filter(first & (F.levenshtein("a.word", "b.word", 1) == 1))
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))


def forms(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have a near word."""
    way = lambda word, n, near, m: F.struct(F.col(word).alias("word"), F.col(n).alias("n"), F.col(near).alias("near"), F.col(m).alias("m"))
    both = near_pairs(words).select(F.explode(F.array(way("a", "n_a", "b", "n_b"), way("b", "n_b", "a", "n_a"))).alias("x")).select("x.*")
    # of the largest count the smallest word: strings compare by code point
    best = both.groupBy("word").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = -F.col("best.m") >= TIMES * F.col("n")
    return best.select("word", "n_near", F.when(found, F.col("best.near")).alias("form"), F.when(found, -F.col("best.m")).alias("form_n"))


def roots(links: DataFrame, largest: int, tables: Tables) -> DataFrame:
    """(word, root): the last form of each word that has one. links: (word, form); largest: the largest count there is."""
    steps = max(1, int(math.log(max(largest, 1), TIMES)) + 1)
    out = tables.keep(links.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(steps))):
        then = out.select(F.col("word").alias("root"), F.col("root").alias("later"))
        further = tables.keep(out.join(then, "root", "left").select("word", F.coalesce("later", "root").alias("root")))
        tables.drop(out)
        out = further
    return out


def variants(docs: DataFrame) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of every word."""
    tables = Tables(docs.sparkSession)
    words = tables.keep(vocabulary(docs))
    near = tables.keep(forms(words))
    largest = words.agg(F.max("n").alias("n")).first().n or 0
    ends = roots(near.filter("form is not null"), largest, tables)
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "n", "form", F.coalesce("root", "word").alias("root"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op11_anagram_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read(spark, sf_dir, "documents"))


#: crc32 by its table, the near words by strings that lack one letter (DuckDB's levenshtein counts bytes)
ORACLE = f"""WITH ct AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda s, k: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END) AS c FROM (SELECT unnest(range(256)) AS b))),
rn AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[{LETTERS}]+')) AS run FROM documents),
rc AS (SELECT doc_id, run, count(*) AS k FROM rn GROUP BY 1, 2),
hs AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([CASE WHEN ord(c) < 128 THEN [CAST(ord(c) AS BIGINT)] ELSE [CAST(192 + (ord(c) >> 6) AS BIGINT), CAST(128 + (ord(c) & 63) AS BIGINT)] END FOR c IN string_split(doc_id || ':' || run, '')])), lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8))) AS h FROM rc CROSS JOIN ct),
ws AS (SELECT CASE WHEN h % {MARK} = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, k FROM hs),
vc AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM ws WHERE length(word) >= {LEAST_LETTERS} GROUP BY 1 HAVING sum(k) >= {LEAST_COUNT}),
dl AS (SELECT DISTINCT word, n, d, g FROM (SELECT word, n, substring(word, 1, i - 1) || substring(word, i + 1) AS d, true AS g FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vc) UNION ALL SELECT word, n, word, false FROM vc)),
nr AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS m FROM dl a JOIN dl b ON a.d = b.d AND a.word <> b.word AND (a.g OR b.g) WHERE length(a.word) <> length(b.word) OR len(list_filter(list_zip(string_split(a.word, ''), string_split(b.word, '')), lambda p: p[1] <> p[2])) = 1),
bt AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(m) AS top FROM nr GROUP BY 1),
fm AS (SELECT bt.word, n_near, CASE WHEN top >= {TIMES} * bt.n THEN min(near) END AS form, CASE WHEN top >= {TIMES} * bt.n THEN top END AS form_n FROM bt JOIN nr ON nr.word = bt.word AND nr.m = top GROUP BY bt.word, n_near, top, bt.n),
f2 AS (SELECT vc.word, vc.n, fm.form, coalesce(n_near, 0) AS n_near, form_n FROM vc LEFT JOIN fm USING (word)),
{', '.join(f"r{i} AS (SELECT x.word, coalesce(f2.form, x.root) AS root FROM {'(SELECT word, word AS root FROM f2)' if i == 0 else f'r{i - 1}'} x JOIN f2 ON f2.word = x.root)" for i in range(12))}
SELECT f2.word, n, form, root, n_near, form_n FROM f2 JOIN r11 USING (word)"""
