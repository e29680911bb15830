"""Readers and writers: wide matrices, phenotype tables, annotations, feature lists. Paths and JDBC options come from the caller."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scratch import keep
from .wide import register


def placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, value): text lines with a number that rises along each file: where the line's block begins, plus its place in the block."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("place"), "value")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = None, 0
        for b in batches:
            files, starts = b.column(0).to_pylist(), b.column(1).to_pylist()
            place = []
            for own in zip(files, starts, strict=True):
                if own != block:
                    block, seen = own, 0
                place.append(own[1] + seen)
                seen += 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(place, pa.int64()), b.column(2)], names=["file", "place", "value"])

    return lines.mapInArrow(number, "file string, place long, value string")


def read_wide_matrix(spark: SparkSession, path: str, preamble: int = 2, names: int = 2, context: str | None = None, ragged: str = "fail") -> DataFrame:
    """A tab-separated matrix with preamble lines, an index column, `names` name columns, then one column a sample, as long rows.

    (context, name, feature, sample, pos, value, row_pos). Only the header, one line, visits the driver; rows are split
    on the executors, so any number of columns is one array and the plan stays small. Each file begins with preamble and
    header, told by their place in it; blank lines are skipped. A row of another width is an error, or left out with
    ragged='drop'. row_pos rises along each file.
    """
    if ragged not in ("fail", "drop"):
        raise ValueError(f"ragged is 'fail' or 'drop', not {ragged!r}")
    header = spark.read.text(path).limit(preamble + 1).collect()[-1][0].split("\t")
    skip = {*range(1 + names)}
    samples = [c for i, c in enumerate(header) if i not in skip]
    # a file's first block begins at 0, so its first lines have the places 0, 1, ...
    parts = placed_lines(spark, path).filter((F.col("place") > preamble) & (F.trim("value") != "")).select(F.col("place").alias("row_pos"), F.split("value", "\t").alias("p"))
    if ragged == "drop":
        parts = parts.filter(F.size("p") == len(header))
    else:
        wrong = F.raise_error(F.concat(F.lit(f"a row of another width than the header's {len(header)}: "), F.size("p").cast("string"), F.lit(" at place "), F.col("row_pos").cast("string")))
        parts = parts.withColumn("p", F.when(F.size("p") == len(header), F.col("p")).otherwise(wrong.cast("array<string>")))
    long = parts.select("row_pos", F.col("p")[1].alias("name"), F.col("p")[names].alias("feature"), F.posexplode(F.slice("p", 2 + names, len(samples))).alias("pos", "text"))
    keys = F.array(*map(F.lit, samples))
    return long.select(F.lit(context).alias("context"), "name", "feature", keys[F.col("pos")].alias("sample"), "pos", F.col("text").cast("double").alias("value"), "row_pos")


def read_features(table: DataFrame, features: DataFrame) -> DataFrame:
    """Rows of the listed features."""
    return table.join(features.select("feature").distinct(), "feature", "left_semi")


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("sep", sep)
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True) if path.rstrip("/").endswith("json") else spark.read.csv(path, header=True)


def read_feature_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("feature")).filter("feature <> ''").orderBy("feature")


def with_row_ids(table: DataFrame) -> DataFrame:
    """Adds row_id: the first column where all its values differ, else a running number."""
    first = table.columns[0]
    unique = table.agg((F.count_distinct(first) == F.count(F.lit(1))).alias("u")).collect()[0].u
    return table.withColumnRenamed(first, "row_id") if unique else table.withColumn("row_id", F.monotonically_increasing_id())


def append_table(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Append typed rows to a Parquet table, made where there is none; other columns or types than the table's are an error.

    With a batch's name the rows are its partition (`batch=...`), and appending it again replaces them: a job that broke off
    and runs again writes no row twice.
    """
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        there = {c: t for c, t in spark.read.parquet(path).dtypes if c != "batch" or batch is None}
        if there != dict(df.dtypes):
            raise ValueError(f"the table holds {there}, not {dict(df.dtypes)}")
    if batch is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, by: str, parts: int, properties: dict | None = None, quote: str = '"') -> DataFrame:
    """A database table read by `parts` tasks, each a range of the integer column `by`; filters and columns are pushed to the database.

    The column is named in the database as it is here, between the database's quotes.
    """
    options = {**(properties or {}), "url": url}
    ends = spark.read.format("jdbc").options(**options, query=f"SELECT min({quote}{by}{quote}) AS lo, max({quote}{by}{quote}) AS hi FROM {table}").load().toDF("lo", "hi").first()
    reader = spark.read.format("jdbc").options(**options, dbtable=table)
    if ends.lo is not None and ends.hi > ends.lo:
        reader = reader.options(partitionColumn=by, lowerBound=str(ends.lo), upperBound=str(ends.hi + 1), numPartitions=str(parts))
    return reader.load()


def append_jdbc(df: DataFrame, url: str, table: str, keys: list[str], properties: dict | None = None, chunk: int = 1000) -> None:
    """Append rows to a database table, made where there is none, `chunk` at a time. Rows whose keys the table holds are left out,
    so an append that broke off is completed when it runs again. A unique index on the keys guards against two appends at once."""
    spark, options = df.sparkSession, {**(properties or {}), "url": url, "dbtable": table}
    df.limit(0).write.format("jdbc").options(**options).mode("ignore").save()  # makes the table where there is none
    held = spark.read.format("jdbc").options(**options).load().select(*keys)
    df = keep(df.join(held, keys, "left_anti"))  # the table is read before rows go to it
    df.dropDuplicates(keys).write.format("jdbc").options(**options, batchsize=str(chunk)).mode("append").save()


def read_dataset(spark: SparkSession, path: str, classes: tuple[str, ...] = ("class", "output", "target")) -> tuple[DataFrame, DataFrame | None]:
    """A table of attributes with row ids, and (row_id, class) of its class column, if one of the known names is there.

    `.arff` by its attributes; other text by the separator that its header holds most often of tab, semicolon, comma and bar.
    """
    if path.rstrip("/").endswith("arff"):
        register(spark)
        table = spark.read.format("arff").load(path).drop("row_pos")
    else:
        first = spark.read.text(path).first()
        if first is None:
            raise ValueError(f"no header in {path}")
        header = first[0]
        table = spark.read.csv(path, header=True, inferSchema=True, sep=max("\t;,|", key=header.count))
    table = keep(with_row_ids(table))  # numbers given once
    found = next((c for c in classes if c in table.columns), None)
    return table, None if found is None else table.select("row_id", F.col(found).alias("class"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_feature_list(df: DataFrame, path: str) -> None:
    df.select("feature").write.mode("overwrite").text(path)


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
