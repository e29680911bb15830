"""The range finder against exact vectors, and planted blocks in matrices of many columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixmill.operators import rangefinder as RF
from matrixmill.operators import spectral as SP


def random_cells(spark, m, n, holes=0.0):
    rng = np.random.default_rng(5)
    a = rng.random((m, n)) + np.where((np.arange(m)[:, None] % 3) == (np.arange(n) % 3), np.array([6.0, 4.0, 3.0])[np.arange(n) % 3], 0)
    a[rng.random((m, n)) < holes] = 0
    cells = [(int(r), int(c), float(a[r, c])) for r, c in zip(*np.nonzero(a), strict=True)]
    return a, spark.createDataFrame(cells, "row int, col int, value double").repartition(5)


@pytest.mark.parametrize("holes", [0.0, 0.7])
def test_vectors_are_the_exact_ones_up_to_sign(spark, holes):
    a, cells = random_cells(spark, 150, 64, holes)
    assert RF.columns_of(cells) == list(range(64))
    rows = RF.sparse_rows(cells, range(64))
    assert np.allclose(RF.column_sums(rows, 64), a.sum(axis=0))
    size, right = RF.right_vectors(rows, 64, 3)
    _, exact, vectors = np.linalg.svd(a)
    assert np.allclose(size, exact[:3], rtol=1e-9)
    assert np.allclose(np.abs((right * vectors[:3].T).sum(axis=0)), 1, atol=1e-8)
    q = np.linalg.qr(np.random.default_rng(1).standard_normal((64, 5)))[0]
    assert np.allclose(np.abs(RF.triangular(rows, q)), np.abs(np.linalg.qr(a @ q, mode="r")))
    got = {r.row: r.v for r in RF.projected(rows, q).collect()}
    assert len(got) == 150 and all(np.allclose(v, a[i] @ q) for i, v in got.items())


def test_scaled_matrices_are_those_of_few_columns(spark):
    a, cells = random_cells(spark, 60, 20)
    rows = RF.sparse_rows(cells, range(20))
    dense = lambda df: np.array([v for _, v in sorted((r.row, r.x) for r in df.collect())])
    assert np.allclose(dense(RF.bistochastic(rows, 20)), dense(SP.bistochastic(SP.packed(cells, list(range(20))), 20)))
    assert np.allclose(dense(RF.root_scaled(rows, a.sum(axis=0))), a / np.sqrt(np.outer(a.sum(axis=1), a.sum(axis=0))))


def test_blocks_of_rows_hold_every_row(spark, monkeypatch):
    a, cells = random_cells(spark, 40, 30, 0.5)
    rows = RF.sparse_rows(cells, range(30))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pandas(rows.toPandas(), schema=pa.schema([("row", pa.int32()), ("i", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))]))
    for block in (1, 17, 100, 1 << 18):
        monkeypatch.setattr(RF, "BLOCK", block)
        for part in (batch, batch.slice(7, 20)):
            got = {}
            for own, i, x, bounds in RF.row_blocks(iter([part])):
                for k, r in enumerate(own.column("row").to_pylist()):
                    line = np.zeros(30)
                    line[i[bounds[k] : bounds[k + 1]]] = x[bounds[k] : bounds[k + 1]]
                    got[r] = line
            assert sorted(got) == sorted(part.column("row").to_pylist()) and all(np.allclose(v, a[r]) for r, v in got.items())


@pytest.mark.parametrize("f", [SP.co_clusters, SP.checkerboard])
def test_many_columns(spark, f):
    """30 rows by 50,000 columns in three blocks: no matrix of columns by columns."""
    n = 50_000
    cell = spark.range(30 * n).select((F.col("id") % 30).cast("int").alias("row"), (F.col("id") / 30).cast("int").alias("col"))
    cells = cell.withColumn("value", F.when(F.col("row") % 3 == F.col("col") % 3, 9.0).otherwise(1.0) + F.pmod(F.xxhash64("row", "col"), F.lit(1000)) / 1000)
    labels = f(cells, 3).withColumn("block", F.col("name").cast("int") % 3)
    got = labels.groupBy("axis", "block").agg(F.count("*").alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).collect()
    assert sum(r.n for r in got) == n + 30 and all(r.lo == r.hi for r in got)
    assert all(len({r.lo for r in got if r.axis == axis}) == 3 for axis in ("row", "col"))
    if f is SP.co_clusters:
        assert len({(r.block, r.lo) for r in got}) == 3
