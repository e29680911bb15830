"""Shared helpers: reading, cutting lineage, walking texts in Arrow batches, bounded training samples."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import filterfalse

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

SLICE_BYTES = 2 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: later jobs restart from there, not from the inputs."""
    return kept_at(df, f"{shared_dir(df.sparkSession)}/matrixmill-{uuid.uuid4().hex}")


def kept_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """The tables that one job keeps in the shared folder; those that nothing will read again are deleted."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{shared_dir(self.spark)}/matrixmill-{uuid.uuid4().hex}"
        out = kept_at(df, path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            _, path = self.paths.pop(id(df))
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        self.drop(*[df for k, (df, _) in self.paths.items() if k not in map(id, tables)])


def id_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % F.lit(n)


def held_out(doc_id: Column, n: int, r: int) -> Column:
    return F.coalesce(id_mod(doc_id, n) == F.lit(r), F.lit(False))


def slices(batch: pa.RecordBatch, text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut an Arrow batch into runs of rows of about SLICE_BYTES of text, so that Python strings never exist for all of it."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += int(n) + 64
        if held >= SLICE_BYTES:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def give_back() -> None:
    """What this Python worker no longer uses goes back to the system: freed Arrow buffers and freed heap pages stay with it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def sliced(batches: Iterable[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    """The slices of all batches; after each batch what it took is given back."""
    for batch in batches:
        yield from slices(batch, text_col)
        del batch
        give_back()


def map_texts(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], schema: str | StructType, columns: tuple[str, ...] = ("doc_id", "text"), flush: bool = False) -> DataFrame:
    """Run make() once per task; its function maps column lists to column lists, slice by slice.

    With flush=True the function is also called with None after the last slice, to emit what the task gathered.
    """
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for part in sliced(batches, columns[-1]):
            out = each(part.to_pydict())
            if out is not None and len(out[arrow.names[0]]):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)
        if flush:
            out = each(None)
            if out is not None and len(out[arrow.names[0]]):
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.select(*columns).mapInArrow(run, schema)


class Memo(dict):
    """A dict with a bound: once it is full, further keys stay for one slice of texts only, as long keys always do.

    The words met first are the frequent ones, so a full memo goes on answering most look-ups.
    """

    LONG = 256

    def __init__(self, most: int) -> None:
        super().__init__()
        self.most, self.passing = most, []

    def missing(self, keys: Iterable) -> list:
        """The keys that are not held and must be added now; lets the passing keys of the last slice go."""
        for k in self.passing:
            self.pop(k, None)
        new = sorted(set(filterfalse(self.__contains__, keys)), key=len)
        stay = min(max(0, self.most - len(self)), bisect_right(new, self.LONG, key=len))
        self.passing = new[stay:]
        return new


_MEMOS: dict[str, Memo] = {}


def release_memos(but: tuple[str, ...] = ()) -> None:
    """Let go the memos that earlier jobs left in this Python worker, and give what those jobs held back to the system, with memos or without."""
    gone = [k for k in _MEMOS if k not in but]
    for k in gone:
        del _MEMOS[k]
    if gone:
        gc.collect()
    give_back()


def worker_memo(key: str, most: int = 300_000, beside: tuple[str, ...] = ()) -> Memo:
    """The memo that the tasks of one Python worker share under this key; only the latest key of a kind is held, and no other kind but those beside it."""
    kind = key.split(":")[0]
    release_memos((kind, *beside))
    if kind not in _MEMOS or getattr(_MEMOS[kind], "key", None) != key:
        _MEMOS[kind] = Memo(most)
        _MEMOS[kind].key = key
    return _MEMOS[kind]


def training_sample(docs: DataFrame, labels: DataFrame, label: str, trainable: Column, per_class: int, max_chars: int, beside: Column | None = None) -> list[tuple]:
    """(text, label), with beside (text, label, beside), of at most per_class documents of each class, chosen by hash of doc_id.

    The bound on what reaches the driver is 2 * per_class * max_chars characters: longer texts are not chosen for
    learning (scoring always reads whole texts). A doc_id labelled more than once takes its largest label; rows
    with a null id, text or label are not learned from.
    """
    marks = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("label")).filter(trainable).groupBy("doc_id").agg(F.max("label").alias("label"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    ids = [marks.filter(F.col("label") == c).orderBy(order, "doc_id").limit(per_class) for c in (0, 1)]
    # at most 2 * per_class rows: the broadcast is bounded by the parameter
    chosen = F.broadcast(ids[0].unionByName(ids[1]))
    rows = docs.select("doc_id", "text", (F.lit(None).cast("long") if beside is None else beside).alias("beside")).filter(F.length("text").between(1, max_chars)).join(chosen, "doc_id")
    rows = rows.orderBy(order, "doc_id", F.xxhash64("text")).limit(2 * per_class).select("doc_id", "text", "label", "beside").collect()
    rows = sorted(rows, key=lambda r: (r.doc_id, r.text))
    return [(r.text, r.label) if beside is None else (r.text, r.label, r.beside) for r in rows]


def keep_texts(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], list[bool]]], columns: tuple[str, ...]) -> DataFrame:
    """The rows of df, all columns as they are, for which make()'s function says so; columns: what it reads, the text last."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for part in sliced(batches, columns[-1]):
            yield part.filter(pa.array(each(part.select(list(columns)).to_pydict()), pa.bool_()))

    return df.mapInArrow(run, schema)
