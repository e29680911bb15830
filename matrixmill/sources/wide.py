"""Spark data sources of matrices in text files: `wide_matrix` (tab-separated, preamble, header, a column a sample) and `arff`.

    spark.dataSource.register(WideMatrix)
    spark.read.format("wide_matrix").option("layout", "long").load("hdfs://...")

The schema comes from the first file's header; files are cut into splits of `splitBytes`, each read by a task of its own
as Arrow batches of bounded size. A line belongs to the split that its first byte lies in. Paths are those of Arrow's file
systems: local, `file:`, `hdfs:`, `s3:`, `gs:`. Files whose names begin with `_` or `.` are no data.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.csv as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: bytes of text that a task parses at a time
CHUNK = 4 << 20
#: cells of a batch of long rows
CELLS = 1 << 16
#: texts that stand for no value
MISSING = ["", "NA", "null", "?"]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
    return fs.LocalFileSystem(), path


def files_of(path: str) -> list[tuple[str, int]]:
    """Data files at a path, or of a folder, with their sizes, by name."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in system.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name[0] not in "_."]
    return sorted((f.path, f.size) for f in found)


def blocks_of_lines(stream, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes): whole lines whose first byte lies from start to before end, some CHUNK bytes at a time."""
    place = start
    if start:
        stream.seek(start - 1)
        place = start - 1 + len(stream.readline())
    else:
        stream.seek(0)
    while place < end:
        block = stream.read(min(CHUNK, end - place))
        if not block:
            return
        if not block.endswith(b"\n"):
            block += stream.readline()
        yield place, block
        place += len(block)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class Lines(DataSourceReader):
    """Splits of files; subclasses tell a file's header and parse blocks of lines."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("splitBytes", 32 << 20))
        if self.split < 1:
            raise ValueError("splitBytes is at least 1")

    def partitions(self) -> list[Split]:
        return [Split(p, s, min(s + self.split, n)) for p, n in files_of(self.path) for s in range(0, n, self.split)] or [Split("", 0, 0)]

    def read(self, part: Split) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, _ = opened(self.path)
        with system.open_input_file(part.path) as raw:
            stream = io.BufferedReader(raw, 1 << 20)
            begins = self.begin(stream)
            if part.end > begins:
                for place, block in blocks_of_lines(stream, max(part.start, begins), part.end):
                    yield from self.parse(place, block)


class WideReader(Lines):
    def __init__(self, options: dict, names: list[str], samples: list[str]):
        super().__init__(options)
        self.names, self.samples = names, samples
        self.preamble, self.long = int(options.get("preamble", 2)), options.get("layout", "wide") == "long"
        self.drop, self.sep = options.get("ragged", "fail") == "drop", options.get("sep", "\t")

    def begin(self, stream) -> int:
        stream.seek(0)
        lines = [stream.readline() for _ in range(self.preamble + 1)]
        header = lines[-1].decode().rstrip("\r\n").split(self.sep)
        if header != self.names + self.samples and lines[-1]:
            raise ValueError("files of a matrix need the same header")
        return sum(map(len, lines))

    def parse(self, place: int, block: bytes) -> Iterator[pa.RecordBatch]:
        width = len(self.names) + len(self.samples)
        own = [f"c{i}" for i in range(width)]  # samples may share a name
        types = {c: pa.string() if i < len(self.names) else pa.float64() for i, c in enumerate(own)}
        if not block.strip():
            return
        handler = (lambda row: "skip") if self.drop else None
        table = pc.read_csv(
            io.BytesIO(block), pc.ReadOptions(column_names=own, block_size=len(block) + 1, use_threads=False),
            pc.ParseOptions(delimiter=self.sep, quote_char=False, invalid_row_handler=handler),
            pc.ConvertOptions(column_types=types, null_values=MISSING, strings_can_be_null=False),
        ).combine_chunks()
        row = pa.array(np.arange(place, place + table.num_rows), pa.int64())
        if not self.long:
            yield pa.RecordBatch.from_arrays([row, *(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns)], names=["row_pos", *self.names, *self.samples])
            return
        n, step = len(self.samples), max(1, CELLS // max(1, len(self.samples)))
        if not n:
            return
        for k in range(0, table.num_rows, step):
            part = table.slice(k, step)
            m = part.num_rows
            cells = np.column_stack([part.column(c).to_numpy() for c in own[len(self.names) :]]).ravel()
            absent = np.concatenate([part.column(c).is_null().to_numpy()[:, None] for c in own[len(self.names) :]], axis=1).ravel()
            at, pos = np.repeat(np.arange(m), n), np.tile(np.arange(n, dtype=np.int32), m)
            texts = [part.column(c).combine_chunks().take(pa.array(at)) for c in own[: len(self.names)]]
            yield pa.RecordBatch.from_arrays(
                [row.slice(k, m).take(pa.array(at)), *texts, pa.array(self.samples, pa.string()).take(pa.array(pos)), pa.array(pos), pa.array(cells, pa.float64(), mask=absent)],
                names=["row_pos", *self.names, "sample", "pos", "value"],
            )


@dataclass
class Staged(WriterCommitMessage):
    path: str | None


class WideWriter(DataSourceArrowWriter):
    """A file a task, each with preamble and header. Tasks write to a staging folder; the driver moves their files when all have ended.

    With option `batch`, files carry that name, and appending a batch again replaces its files: no row is written twice.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.preamble, self.sep = options["path"], int(options.get("preamble", 2)), options.get("sep", "\t")
        self.batch, self.columns, self.overwrite = options.get("batch"), schema.names, overwrite
        if self.batch is not None and not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9-]*", self.batch):
            raise ValueError("a batch's name is of letters, digits and hyphens")
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterable[pa.RecordBatch]) -> Staged:
        system, at = opened(self.path)
        out, name = None, f"{at}/{self.staging}/{uuid.uuid4().hex}"
        try:
            for batch in iterator:
                if out is None:
                    system.create_dir(f"{at}/{self.staging}", recursive=True)
                    out = system.open_output_stream(name)
                    out.write(("#\n" * self.preamble + self.sep.join(self.columns) + "\n").encode())
                if any(re.search(f"[\r\n{re.escape(self.sep)}]", v) for c, t in zip(batch.columns, batch.schema.types, strict=True) if pa.types.is_string(t) for v in c.to_pylist() if v):
                    raise ValueError("a text with a separator or line break has no place in a wide matrix")
                rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
                out.write("".join(self.sep.join("" if v is None else str(v) for v in r) + "\n" for r in rows).encode())
        finally:
            if out is not None:
                out.close()
        return Staged(None if out is None else name)

    def commit(self, messages: list[Staged | None]) -> None:
        system, at = opened(self.path)
        system.create_dir(at, recursive=True)
        batch = self.batch or uuid.uuid4().hex
        for path, _ in files_of(self.path):
            if self.overwrite or path.rsplit("/", 1)[1].startswith(f"{batch}."):
                system.delete_file(path)
        staged = sorted(m.path for m in messages if m and m.path)
        for i, path in enumerate(staged):
            system.move(path, f"{at}/{batch}.{i:05d}.gct")
        self._clear(system, at)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, system: fs.FileSystem, at: str) -> None:
        if system.get_file_info(f"{at}/{self.staging}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/{self.staging}")


class WideMatrix(DataSource):
    """`wide_matrix`. Options: preamble (2 lines), names (leading text columns, 3), sep, ragged (fail, drop), splitBytes, layout, batch (writing).

    Layout `wide`: (row_pos, names..., a double a sample). Layout `long`: (row_pos, names..., sample, pos, value). row_pos
    rises along each file. Missing values are null, or empty text when written. A table without files is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "wide_matrix"

    def header(self) -> tuple[list[str], list[str]]:
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no matrix in {self.options['path']}")
        system, _ = opened(self.options["path"])
        with system.open_input_file(files[0][0]) as raw:
            stream = io.BufferedReader(raw)
            line = [stream.readline() for _ in range(int(self.options.get("preamble", 2)) + 1)][-1]
        columns, n = line.decode().rstrip("\r\n").split(self.options.get("sep", "\t")), int(self.options.get("names", 3))
        if len(columns) < n:
            raise ValueError(f"the header has {len(columns)} columns, {n} of them names")
        return columns[:n], columns[n:]

    def schema(self) -> StructType:
        for option, known in (("ragged", ("fail", "drop")), ("layout", ("wide", "long"))):
            if self.options.get(option, known[0]) not in known:
                raise ValueError(f"{option} is one of {known}")
        names, samples = self.header()
        own = [StructField("row_pos", LongType()), *(StructField(c, StringType()) for c in names)]
        if self.options.get("layout", "wide") == "long":
            return StructType([*own, StructField("sample", StringType()), StructField("pos", IntegerType()), StructField("value", DoubleType())])
        return StructType([*own, *(StructField(c, DoubleType()) for c in samples)])

    def reader(self, schema: StructType) -> WideReader:
        return WideReader(dict(self.options), *self.header())

    def writer(self, schema: StructType, overwrite: bool) -> WideWriter:
        return WideWriter(dict(self.options), schema, overwrite)


def attributes(stream) -> tuple[list[tuple[str, bool]], int]:
    """((name, is it a number) of each attribute, where data begin) of an ARFF file."""
    stream.seek(0)
    found: list[tuple[str, bool]] = []
    while line := stream.readline():
        text = line.decode().strip()
        if re.match(r"@data\b", text, re.I):
            return found, stream.tell()
        if m := re.match(r"@attribute\s+('(?:[^'\\]|\\.)*'|\"[^\"]*\"|\S+)\s+(.+)", text, re.I):
            found.append((m[1].strip("'\""), bool(re.match(r"(numeric|real|integer)\b", m[2], re.I))))
    raise ValueError("an ARFF file without @data")


class ArffReader(Lines):
    def __init__(self, options: dict, columns: list[tuple[str, bool]]):
        super().__init__(options)
        self.columns = columns

    def begin(self, stream) -> int:
        columns, begins = attributes(stream)
        if columns != self.columns:
            raise ValueError("files of a table need the same attributes")
        return begins

    def parse(self, place: int, block: bytes) -> Iterator[pa.RecordBatch]:
        lines = [s for s in block.decode().splitlines() if s.strip() and not s.lstrip().startswith("%")]
        if any(s.lstrip().startswith("{") for s in lines):
            raise ValueError("rows of sparse ARFF are not read")
        rows = list(csv.reader(lines, quotechar="'", escapechar="\\", doublequote=False, skipinitialspace=True))
        for r in rows:
            if len(r) != len(self.columns):
                raise ValueError(f"a row of {len(r)} values, not {len(self.columns)}, in the block at {place}")
        values = [[None if (v := r[i].strip()) == "?" else float(v) if number else v for r in rows] for i, (_, number) in enumerate(self.columns)]
        arrays = [pa.array(np.arange(place, place + len(rows)), pa.int64()), *(pa.array(v, pa.float64() if number else pa.string()) for v, (_, number) in zip(values, self.columns, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["row_pos", *(c for c, _ in self.columns)])


class Arff(DataSource):
    """`arff`: (row_pos, attributes...); numeric, real and integer are double, the rest string; `?` is null. Option: splitBytes."""

    @classmethod
    def name(cls) -> str:
        return "arff"

    def columns(self) -> list[tuple[str, bool]]:
        files = files_of(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no table in {self.options['path']}")
        system, _ = opened(self.options["path"])
        with system.open_input_file(files[0][0]) as raw:
            return attributes(io.BufferedReader(raw))[0]

    def schema(self) -> StructType:
        return StructType([StructField("row_pos", LongType()), *(StructField(c, DoubleType() if number else StringType()) for c, number in self.columns())])

    def reader(self, schema: StructType) -> ArffReader:
        return ArffReader(dict(self.options), self.columns())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WideMatrix)
    spark.dataSource.register(Arff)
