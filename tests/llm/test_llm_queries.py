"""Every registered query on its whole small table: names, types, rows and splits of the contract; empty tables."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from matrixmill.llm import registry

DIR = "/root/testdata/sf0.001"
#: columns and types that a contract names; a document or piece has one row of doc_id where it is among them
NAMED = {
    "op2": "doc_id bigint n_words bigint word_chars bigint n_symbols bigint n_dup_lines bigint n_repeat_words bigint base_failed boolean kept boolean",
    "op3": "query_id bigint rank int vec_id bigint score double",
    "op4": "doc_id bigint held_out boolean score double predicted int",
    "op5": "doc_id bigint held_out boolean lang_pred string score double",
    "op6": "doc_id bigint held_out boolean score double predicted int",
    "op7": "doc_id bigint piece int start bigint length bigint ids_crc32 bigint sequence_id bigint offset bigint",
    "op8": "doc_id bigint n_shingles bigint component_id bigint",
    "op11": "word string form string root string n bigint n_near bigint form_n bigint",
    "op12": "vec_id bigint cluster int distance bigint cluster_inertia bigint inertia bigint centroid_sha256 string",
    "op13": "doc_id bigint held_out boolean n_tokens bigint n_known bigint train_tokens bigint base_score double score double",
}
SPLIT = {"op4": (3, 1), "op5": (3, 1), "op6": (5, 0)}


@pytest.fixture(scope="module")
def results(spark):
    """Rows of each query, collected once."""
    held = {}

    def get(name):
        if name not in held:
            df = registry.queries()[name](spark, DIR)
            held[name] = dict(df.dtypes), df.collect()
        return held[name]

    return get


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_contract(spark, results, name):
    types, rows = results(name)
    op = name.split("_")[0]
    named = NAMED.get(op, "").split()
    for column, kind in zip(named[::2], named[1::2]):
        assert types[column] == kind
    if op == "op8":
        assert list(types) == ["doc_id", "n_shingles", "component_id"]
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id").collect())
    if "doc_id" in types and op != "op7":
        assert sorted(r.doc_id for r in rows) == ids
    if op == "op7":
        assert sorted({r.doc_id for r in rows}) == sorted(set(ids))
    if op in SPLIT:
        n, k = SPLIT[op]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == k) and 0 <= r.score <= 1 for r in rows)
        assert 0 < sum(r.held_out for r in rows) < len(rows)
    if op in ("op4", "op6"):
        assert all(r.predicted == int(r.score >= 0.5) for r in rows)
    if op == "op3":
        vectors = {r.vec_id for r in spark.read.parquet(f"{DIR}/embeddings.parquet").filter("embedding is not null").collect()}
        assert {r.query_id for r in rows} == {v for v in vectors if v % 100 == 0}
        assert len(rows) == 10 * len({r.query_id for r in rows}) and all(r.query_id != r.vec_id for r in rows)


@pytest.mark.parametrize("name", ["op4_factorisation_machine", "op5_bidirectional_gru", "op6_noisy_or_sentences"])
def test_held_out_labels_are_not_learned(spark, results, tmp_path, name):
    """Labels and languages of the held-out rows turned round change no score."""
    n, k = SPLIT[name[:3]]
    out = F.crc32(F.col("doc_id").cast("string")) % n == k
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("lang", F.when(out, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("elsewhere"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    for c in ("quality", "toxic"):
        labels = labels.withColumn(c, F.when(out, 1 - F.col(c)).otherwise(F.col(c)))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    got = registry.queries()[name](spark, str(tmp_path)).collect()
    assert {r.doc_id: r.score for r in got} == {r.doc_id: r.score for r in results(name)[1]}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, tmp_path_factory, name):
    d = tmp_path_factory.mktemp("empty")
    for table in ("documents", "labels", "embeddings", "pages"):
        spark.read.parquet(f"{DIR}/{table}.parquet").limit(0).write.parquet(f"{d}/{table}.parquet")
    assert registry.queries()[name](spark, str(d)).count() == 0


def test_clashing_columns_and_nulls(spark, tmp_path):
    """Extra columns with the names that operators work with, a null in every column, repeated rows: the same rows come back for the rest."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet").filter("doc_id < 60")
    odd = docs.limit(1).select(*(F.lit(None).cast(t).alias(c) for c, t in docs.dtypes))
    docs = docs.unionByName(docs.filter("doc_id = 7")).unionByName(odd)
    for c in ("score", "length", "n", "label", "piece", "rank", "h", "beside", "sequence_id", "count"):
        docs = docs.withColumn(c, F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DIR}/labels.parquet").withColumn("score", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    n = docs.count()
    for name in sorted(registry.queries()):
        if name.split("_")[0] in ("op1", "op2", "op4", "op5", "op6", "op8", "op10"):
            assert registry.queries()[name](spark, str(tmp_path)).count() == n, name


def test_oracle_sql(spark, results):
    db = duckdb.connect()
    for table in ("pages", "documents", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    for name, sql in registry.oracle_sql().items():
        if name in registry.queries():
            found = db.execute(sql)
            names = [d[0] for d in found.description]
            assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in results(name)[1])
