"""Exact TF-IDF keyword scores, tokens and name lists."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import keep

#: fixed values: the five key terms of the feature list
KEYWORDS = ("receptor", "brain", "neuro", "gaba", "dopamine")


def singular(word: Column) -> Column:
    """Plural endings by rule: -ies to -y, -sses to -ss, -s off, but not -ss, -us or -is."""
    word = F.regexp_replace(word, "^(\\w{2,})ies$", "$1y")
    word = F.regexp_replace(word, "^(\\w+ss)es$", "$1")
    return F.regexp_replace(word, "^(\\w{2,}[^sui])s$", "$1")


def tokens(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term): lower-cased runs of two or more word characters, one row each; narrow."""
    return docs.select(key, F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("(\\w\\w+)"), 1)).alias("term"))


def content_words(docs: DataFrame, key: str, text: str) -> DataFrame:
    stop = F.array(*map(F.lit, StopWordsRemover.loadDefaultStopWords("english")))
    words = F.split(F.lower(F.col(text)), "[^a-z]+")
    return docs.select(key, F.transform(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)), singular).alias("words"))


def names(col: Column) -> Column:
    return F.explode(F.filter(F.split(F.upper(F.trim(col)), "\\s+"), lambda x: x != ""))


#: terms whose idf every task may hold: those with more than one in so many of all (document, term) rows, so never more of them
FREQUENT = 10_000


def weighted(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, w): raw counts times idf ln((1+n)/(1+df))+1.

    The few terms that most documents hold would each be one key of the join with idf: theirs is sent to all tasks, of
    which there are at most FREQUENT by the threshold; only the rest is joined by term.
    """
    tf = keep(tokens(docs, key, text).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")))  # read again below: texts are cut once
    n = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    df = keep(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")))
    most = (df.agg(F.sum("df").alias("n")).first().n or 0) / FREQUENT
    common, rest = df.filter(F.col("df") > most).select("term", "idf"), df.filter(F.col("df") <= most).select("term", "idf")
    known = tf.join(F.broadcast(common), "term", "left")
    w = (F.col("tf") * F.col("idf")).alias("w")
    return known.filter("idf is not null").select(key, "term", w).unionByName(known.filter("idf is null").drop("idf").join(rest, "term").select(key, "term", w))


def tf_idf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): rows of length 1."""
    raw = weighted(docs, key, text)
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"))
    return raw.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def keyword_scores(docs: DataFrame, key: str, text: str, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """(key, score): summed weights of the key terms. Norms need all terms, but only a sum a document."""
    hit = F.when(F.col("term").isin(*keywords), F.col("w")).otherwise(0.0)
    return weighted(docs, key, text).groupBy(key).agg((F.sum(hit) / F.sqrt(F.sum(F.col("w") ** 2))).alias("score"))


def selected_names(scored: DataFrame, annotations: DataFrame, key: str, name_col: str, threshold: float = 0.3) -> DataFrame:
    """Upper-case names, one row each, of the documents with a score of at least the threshold."""
    kept = scored.filter(F.col("score") >= threshold)
    return annotations.join(kept, key).select(key, names(F.col(name_col)).alias("feature"), "score")


def in_catalogue(found: DataFrame, catalogue: DataFrame, order: str) -> DataFrame:
    """Distinct features that the catalogue has, in order of first sight."""
    return found.join(catalogue.select("feature").distinct(), "feature", "left_semi").groupBy("feature").agg(F.min(order).alias("first_seen")).orderBy("first_seen", "feature")
