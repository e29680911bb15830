"""Leading singular vectors of matrices with many columns: a randomised range finder with power rounds over sparse rows.

Rows lie as (row, i, x): places and values of their cells. A pass is narrow: each task adds up its share of A'(AQ), of as
many rows as A has columns and some 20 columns, and shares are added by place. Only matrices of that form, and small
triangular ones, reach the driver; no matrix of columns by columns is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .expression import near_zero
from .scratch import keep

#: bound of the columns: the driver and each task hold this many rows of some 20 numbers
MOST_COLUMNS = 1 << 18
#: cells of a block of rows in a task; a row is never cut
BLOCK = 1 << 18
#: groups that triangular factors meet in before the driver sees them
FACTORS = 64


def columns_of(cells: DataFrame) -> list:
    """The columns, sorted; more than MOST_COLUMNS are an error."""
    cols = [r.col for r in cells.select("col").distinct().limit(MOST_COLUMNS + 1).collect()]
    if len(cols) > MOST_COLUMNS:
        raise ValueError(f"spectral clusters take at most {MOST_COLUMNS} columns")
    return sorted(cols)


def sparse_rows(cells: DataFrame, cols: list) -> DataFrame:
    """(row, i, x) of (row, col, value), i: the column's place in cols. No cell: 0. Near-zero values become 1e-10."""
    schema = StructType([StructField("col", cells.schema["col"].dataType), StructField("i", IntegerType())])
    places = cells.sparkSession.createDataFrame(list(zip(cols, range(len(cols)), strict=True)), schema)
    held = cells.join(places, "col").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("i", near_zero(F.col("value")).alias("x")))).alias("m"))
    return keep(held.select("row", F.col("m.i").alias("i"), F.col("m.x").alias("x")))


def row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, i, x, bounds): rows of some BLOCK cells with their cells one after the other, and where each row's begin and end."""
    for b in batches:
        offsets = b.column("i").offsets.to_numpy()
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, "right")) - 1)
            part = slice(offsets[start], offsets[end])
            yield b.slice(start, end - start), b.column("i").values.to_numpy()[part], b.column("x").values.to_numpy()[part], offsets[start : end + 1] - offsets[start]
            start = end


def times(i: np.ndarray, x: np.ndarray, bounds: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A block of rows times a matrix of a row for each column."""
    out = np.zeros((len(bounds) - 1, q.shape[1]))
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(x[:, None] * q[i], bounds[some], axis=0)
    return out


def summed(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n: int, width: int) -> np.ndarray:
    """Sum over all blocks of an n x width matrix: added up in each task, then by row of the matrix."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for _, i, x, bounds in row_blocks(batches):
            own = part(i, x, bounds)
            out = own if out is None else out + own
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), *(pa.array(out[:, k]) for k in range(width))], names=["at", *(f"v{k}" for k in range(width))])

    schema = "at int, " + ", ".join(f"v{k} double" for k in range(width))
    sums = rows.select("i", "x").mapInArrow(add, schema).groupBy("at").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(width))).toPandas()
    out = np.zeros((n, width))
    out[sums["at"].to_numpy()] = sums.drop(columns="at").to_numpy()
    return out


def scatter(i: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """Rows of w added up at their places."""
    return np.stack([np.bincount(i, w[:, k], n) for k in range(w.shape[1])], axis=1)


def gram_times(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'(Aq) in one pass."""
    n = len(q)

    def part(i, x, bounds):
        y = np.repeat(times(i, x, bounds, q), np.diff(bounds), axis=0)
        return scatter(i, y * x[:, None], n)

    return summed(rows, part, n, q.shape[1])


def triangular(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """The R of a QR of Aq: one of each task, which meet in FACTORS groups, and those on the driver."""
    width = q.shape[1]
    schema = ", ".join(f"v{k} double" for k in range(width))

    def frame(r: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame(r, columns=[f"v{k}" for k in range(width)])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, width))
        for _, i, x, bounds in row_blocks(batches):
            r = np.linalg.qr(np.vstack([r, times(i, x, bounds, q)]), mode="r")
        yield pa.RecordBatch.from_pandas(frame(r), preserve_index=False)

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, width))
        for f in frames:
            r = np.linalg.qr(np.vstack([r, f.to_numpy()]), mode="r")
        yield frame(r)

    factors = rows.select("i", "x").mapInArrow(own, schema).repartition(FACTORS).mapInPandas(meet, schema).toPandas()
    return np.linalg.qr(factors.to_numpy().reshape(-1, width), mode="r")


def projected(rows: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(row, v): each row times column vectors."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, i, x, bounds in row_blocks(batches):
            y = times(i, x, bounds, vectors)
            lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * y.shape[1], y.ravel())
            yield pa.RecordBatch.from_arrays([own.column("row"), lists], names=["row", "v"])

    return rows.mapInArrow(part, f"row {rows.schema['row'].dataType.simpleString()}, v array<double>")


def right_vectors(rows: DataFrame, n: int, want: int, seed: int = 0, more: int = 10, rounds: int = 30, close: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, vectors as columns), the `want` largest first.

    Rounds of A'A on `want + more` columns, made orthogonal each time, until no wanted value moves by more than a share of `close`.
    The last values come from the triangular factor, so small ones are not lost in squares.
    """
    width = min(n, want + more)
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    last = np.zeros(want)
    for _ in range(rounds):
        z = gram_times(rows, q)
        values = np.linalg.eigvalsh(q.T @ z)[::-1][:want]
        q = np.linalg.qr(z)[0]
        settled = len(values) == len(last) and np.all(np.abs(values - last) <= close * np.maximum(values[0], 1e-300))
        last = values
        if settled:
            break
    _, size, turn = np.linalg.svd(triangular(rows, q))
    return size[:want], (q @ turn.T)[:, :want]


def cells_again(own: pa.RecordBatch, i: np.ndarray, x: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """A block of rows with other values."""
    at = pa.array(bounds.astype(np.int32))
    return pa.RecordBatch.from_arrays([own.column("row"), pa.ListArray.from_arrays(at, pa.array(i)), pa.ListArray.from_arrays(at, pa.array(x))], names=["row", "i", "x"])


def root_scaled(rows: DataFrame, sums: np.ndarray) -> DataFrame:
    """Cells over the roots of their row's and their column's sum."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, i, x, bounds in row_blocks(batches):
            total = times(i, x, bounds, np.ones((len(sums), 1)))[:, 0]
            yield cells_again(own, i, x / np.sqrt(sums[i] * np.repeat(total, np.diff(bounds))), bounds)

    return rows.mapInArrow(part, rows.schema)


def column_sums(rows: DataFrame, n: int) -> np.ndarray:
    return summed(rows, lambda i, x, bounds: np.bincount(i, x, n)[:, None], n, 1)[:, 0]


def bistochastic(rows: DataFrame, n: int, rounds: int = 4) -> DataFrame:
    """Rows and columns brought to a mean of 1 in turn; a pass a round, as a row's factor follows from the columns'."""
    size = rows.count()
    factor = np.ones(n)
    for _ in range(rounds):
        last = factor

        def part(i, x, bounds, f=factor):
            mean = times(i, x, bounds, f[:, None])[:, 0] / n
            return np.bincount(i, x / np.repeat(mean, np.diff(bounds)), n)[:, None]

        factor = size / summed(rows, part, n, 1)[:, 0]

    def last_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a row's mean is that under the factors before the last
        for own, i, x, bounds in row_blocks(batches):
            mean = times(i, x, bounds, last[:, None])[:, 0] / n
            yield cells_again(own, i, x * factor[i] / np.repeat(mean, np.diff(bounds)), bounds)

    return rows.mapInArrow(last_pass, rows.schema)
