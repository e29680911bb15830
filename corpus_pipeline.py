"""A corpus from documents to packed sequences: toxicity, quality, near duplicates, packing.

Each stage reads all that the one before kept, as a table in the shared folder, which goes once the next is written.

Defined cases: a null or empty text is scored like any other (its features are all zero), is no near duplicate of anything,
and packs as its end token; a row without an id is scored, keeps its place unless rejected, and packs under a null id;
rows that are repeated stay together through the filters, and one of them stays after the near duplicates; of a group of
near duplicates the smallest id stays; without any label of a kind no document is rejected by it; texts of any length are
read whole; columns beside those of documents go along unchanged, whatever their names, to the last stage, which returns
its own; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from matrixmill.llm import ngram_join, packing, quality_model, toxicity
from matrixmill.llm.base import Tables, read


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.only_good(docs, quality_model.fit(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.best_two_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_low_quality), ("n-gram Jaccard join", drop_near_duplicates), ("best-fit packing", pack_sequences)]

#: models, token ids and bin packing are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, docs = Tables(spark), read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept = tables.keep(stage(spark, docs, sf_dir))
        tables.drop_all_but(kept)
        docs = kept
    out = STAGES[-1][1](spark, docs, sf_dir)
    tables.drop_all_but()  # packing reads a table of its own
    return out
