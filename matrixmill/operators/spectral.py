"""Spectral biclusters of long matrices.

Cells are brought together once, a matrix row each, and kept; every pass over them is then narrow. Up to GRAM_COLUMNS
columns the column-by-column matrix reaches the driver and its vectors are exact; with more, a randomised range finder
takes its place (rangefinder), up to its bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rangefinder as RF
from .expression import near_zero
from .scratch import keep

#: most columns whose square reaches the driver
GRAM_COLUMNS = 1024


def packed(cells: DataFrame, cols: list) -> DataFrame:
    """(row, x) with x: a value for each column, 0 where there is none. Near-zero values first become 1e-10."""
    names = F.array(*map(F.lit, cols))
    held = cells.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", near_zero(F.col("value")).alias("v")))).alias("m"))
    return keep(held.select("row", F.transform(names, lambda c: F.coalesce(F.element_at("m", c), F.lit(0.0))).alias("x")))


def weights(w: np.ndarray) -> Column:
    return F.array(*(F.lit(float(x)) for x in w))


def dot(x: str, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def total(x: str) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def column_sums(rows: DataFrame, x: Column, n: int) -> np.ndarray:
    """Sums over all rows of an array column: added up in each task, and a row a column and task then."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(n)
        for f in frames:
            for k in range(0, len(f), 1024):
                out += np.stack(f["x"].iloc[k : k + 1024].to_numpy()).sum(axis=0)
        yield pd.DataFrame({"i": np.arange(n), "s": out})

    out = np.zeros(n)
    for r in rows.select(x.alias("x")).mapInPandas(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r.i] = r.s
    return out


def gram(rows: DataFrame, n: int) -> np.ndarray:
    """The matrix of column products of (row, x): one product a task, added by column pair."""

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((n, n))
        for f in frames:
            for k in range(0, len(f), 1024):
                x = np.stack(f["x"].iloc[k : k + 1024].to_numpy())
                out += x.T @ x
        a, b = np.triu_indices(n)
        yield pd.DataFrame({"a": a, "b": b, "s": out[a, b]})

    out = np.zeros((n, n))
    for r in rows.select("x").mapInPandas(add, "a int, b int, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect():
        out[r.a, r.b] = out[r.b, r.a] = r.s
    return out


def projected(rows: DataFrame, vectors: np.ndarray) -> Column:
    """Rows times column vectors."""
    return F.array(*(dot("x", weights(vectors[:, i])) for i in range(vectors.shape[1])))


def one_sign(vectors: np.ndarray) -> np.ndarray:
    """Vectors turned so that none has a negative sum."""
    return vectors * np.where(vectors.sum(axis=0) < 0, -1, 1)


def labelled(points: DataFrame, k: int, seed: int = 0) -> DataFrame:
    data = keep(points).withColumn("features", array_to_vector("v"))
    return KMeans(k=k, seed=seed, initMode="k-means||").fit(data).transform(data).drop("features", "v").withColumnRenamed("prediction", "label")


def co_clusters(cells: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(axis, name, label): rows and columns clustered together on 1 + ceil(log2 k) singular vectors, the first left out.

    The matrix is scaled by the roots of row and column sums.
    """
    n = 1 + math.ceil(math.log2(max(2, k)))
    cols = RF.columns_of(cells)
    if len(cols) > GRAM_COLUMNS:
        rows = RF.sparse_rows(cells, cols)
        sums = RF.column_sums(rows, len(cols))
        scaled = keep(RF.root_scaled(rows, sums))
        size, right = RF.right_vectors(scaled, len(cols), n, seed)
        size, right = np.maximum(size[1:], 1e-6), one_sign(right[:, 1:])
        totals = rows.select("row", total("x").alias("r"))
        left = RF.projected(scaled, right / size).join(totals, "row")
        row_points = left.select(F.lit("row").alias("axis"), F.col("row").cast("string").alias("name"), F.transform("v", lambda x: x / F.sqrt("r")).alias("v"))
    else:
        rows = packed(cells, cols)
        sums = column_sums(rows, F.col("x"), len(cols))
        root = weights(1 / np.sqrt(sums))
        scaled = keep(rows.withColumn("r", total("x")).select("row", "r", F.zip_with("x", root, lambda v, c: v * c / F.sqrt("r")).alias("x")))
        values, vectors = np.linalg.eigh(gram(scaled, len(cols)))
        top = np.argsort(values)[::-1][1:n]
        right = one_sign(vectors[:, top])
        left = projected(scaled, right / np.sqrt(np.maximum(values[top], 1e-12)))
        row_points = scaled.select(F.lit("row").alias("axis"), F.col("row").cast("string").alias("name"), F.transform(left, lambda x: x / F.sqrt("r")).alias("v"))
    col_points = cells.sparkSession.createDataFrame([("col", str(c), [float(x) / math.sqrt(sums[i]) for x in right[i]]) for i, c in enumerate(cols)], "axis string, name string, v array<double>")
    return labelled(row_points.unionByName(col_points), k, seed)


def bistochastic(rows: DataFrame, n: int, rounds: int = 4) -> DataFrame:
    """Rows and columns brought to a mean of 1 in turn. A round needs the column factors only: a row's factor follows from them."""
    factor = np.ones(n)
    for _ in range(rounds):
        mean = dot("x", weights(factor)) / n
        size = rows.agg(F.count(F.lit(1)).alias("n")).first().n
        factor = size / column_sums(rows, F.transform("x", lambda v: v / mean), n)
        last = mean
    return rows.select("row", F.zip_with("x", weights(factor), lambda v, c: v * c / last).alias("x"))


def checkerboard(cells: DataFrame, k: int, seed: int = 0, vectors: int = 6, best: int = 3) -> DataFrame:
    """(axis, name, label): rows and columns clustered apart; of the first vectors those that are closest to piecewise constant."""
    cols = RF.columns_of(cells)
    large = len(cols) > GRAM_COLUMNS
    if large:
        rows = RF.sparse_rows(cells, cols)
        b = keep(RF.bistochastic(rows, len(cols)))
        size, right = (v[..., 1:] for v in RF.right_vectors(b, len(cols), 1 + vectors, seed))
    else:
        rows = packed(cells, cols)
        b = keep(bistochastic(rows, len(cols)))
        values, right = np.linalg.eigh(gram(b, len(cols)))
        order = np.argsort(values)[::-1][1 : 1 + vectors]
        size, right = np.sqrt(np.maximum(values[order], 0)), right[:, order]

    def spread(v: np.ndarray) -> float:
        cuts = np.array_split(np.sort(v), k)
        return sum(float(((c - c.mean()) ** 2).sum()) for c in cuts if len(c))

    first = np.argsort([spread(right[:, i]) for i in range(right.shape[1])])[:best]
    chosen, size = right[:, first], size[first]
    points = RF.projected(b, chosen) if large else b.select("row", projected(b, chosen).alias("v"))
    found = labelled(points.select(F.col("row").cast("string").alias("name"), "v"), k, seed).select(F.lit("row").alias("axis"), "name", "label")
    # columns by rows: the transposed matrix times the left vectors
    own = labelled(cells.sparkSession.createDataFrame([(str(c), [float(x) for x in chosen[i] * size]) for i, c in enumerate(cols)], "name string, v array<double>"), min(k, len(cols)), seed)
    return found.unionByName(own.select(F.lit("col").alias("axis"), "name", "label"))


def blocks(labels: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, row) and (id, col): cluster c is the rows labelled c by the columns labelled c, named as in cells, ready for significance."""
    types = dict(cells.dtypes)
    side = lambda axis: labels.filter(F.col("axis") == axis).select(F.col("label").cast("long").alias("id"), F.col("name").cast(types[axis]).alias(axis))
    return side("row"), side("col")
