"""Tables kept between jobs in the cluster's shared folder, and ranks and counts over sorted rows that no single task holds."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only where none is set and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: tables kept since the operators that now run began, innermost last
_SCOPES: list[list[str]] = []


def keep(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: what follows is planned, and after a lost executor restarted, from there."""
    path = f"{shared_dir(df.sparkSession)}/matrixmill-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tables_read(df: DataFrame) -> set[str]:
    """Names of the kept tables that a DataFrame reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    out: set[str] = set()
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation":
            relation = leaves.apply(i).relation()
            if relation.getClass().getSimpleName() == "HadoopFsRelation":
                paths = relation.location().rootPaths()
                out |= {paths.apply(k).getName() for k in range(paths.size())}
    return out


def tidy(f: Callable) -> Callable:
    """An operator that, once it returns, leaves of the tables kept on its way only those that its result reads; the others are deleted."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        _SCOPES.append([])
        try:
            out = f(*args, **kwargs)
        finally:
            kept = _SCOPES.pop()
        read: set[str] = set()
        for df in out if isinstance(out, tuple) else (out,):
            if isinstance(df, DataFrame):
                read |= _tables_read(df)
        for path in kept:
            if path.rsplit("/", 1)[1] in read:
                if _SCOPES:  # whoever called may be done with it
                    _SCOPES[-1].append(path)
            else:
                spark = SparkSession.active()
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        return out

    return run


def set_id(*arrays: str) -> Column:
    """A hash of arrays that tells where one ends: a hash of several arrays alone is that of their elements in a row."""
    return F.xxhash64(*(x for a in arrays for x in (F.size(a), F.col(a))))


def _dealt(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Rows cut by sampled ranges of (keys, by), with the range's number, ascending. Rows alike in keys and by stay together."""
    return keep(df.repartitionByRange(*keys, *by).withColumn("_part", F.spark_partition_id()))


def ranked(df: DataFrame, keys: list[str], by: list[str], rank: str = "i", total: str = "n") -> DataFrame:
    """Adds the rank from 1 within the keys in the order of `by`, and the key's number of rows.

    A key with any share of the rows is dealt over many tasks: ranks within a range of it, plus the sizes of the ranges
    before. `by` should tell rows apart, else equal ones stay in one range.
    """
    dealt = _dealt(df, keys, by)
    sizes = dealt.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_k"))  # a row for each range and key
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    marks = sizes.select(*keys, "_part", (F.sum("_k").over(own.orderBy("_part")) - F.col("_k")).alias("_before"), F.sum("_k").over(own).alias(total))
    within = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*by))
    out = dealt.withColumn("_within", within).join(marks, [*keys, "_part"])
    return out.select(*df.columns, (F.col("_before") + F.col("_within")).alias(rank), total)


def running(df: DataFrame, keys: list[str], by: list[str], value: str, out: str) -> DataFrame:
    """Adds the running sum of a column within the keys in the order of `by`, which tells rows apart; dealt as in ranked."""
    dealt = _dealt(df, keys, by)
    sizes = dealt.groupBy(*keys, "_part").agg(F.sum(value).alias("_s"))
    before = sizes.select(*keys, "_part", (F.sum("_s").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_s")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy(*keys, "_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_within", within).join(before, [*keys, "_part"]).select(*df.columns, (F.col("_before") + F.col("_within")).alias(out))


def counts_at(values: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """bounds with column `upto`: how many values of the key are at most the bound. values: (key, value); bounds: (key, bound, more columns).

    One sort of values and bounds together, cut by ranges; each bound then knows the running count. Nothing is joined on the key.
    """
    rest = [c for c in bounds.columns if c not in (key, "bound")]
    v = values.groupBy(key, F.col("value").alias("_x")).agg(F.count(F.lit(1)).alias("_k")).withColumn("_kind", F.lit(0))
    both = v.unionByName(bounds.select(key, F.col("bound").alias("_x"), F.lit(0).cast("long").alias("_k"), F.lit(1).alias("_kind"), *rest), allowMissingColumns=True)
    dealt = _dealt(both, [key], ["_x", "_kind"])
    sizes = dealt.groupBy(key, "_part").agg(F.sum("_k").alias("_s"))
    before = sizes.select(key, "_part", (F.sum("_s").over(Window.partitionBy(key).orderBy("_part")) - F.col("_s")).alias("_before"))
    running = F.sum("_k").over(Window.partitionBy(key, "_part").orderBy("_x", "_kind"))
    out = dealt.withColumn("_run", running).filter("_kind = 1").join(before, [key, "_part"])
    return out.select(key, F.col("_x").alias("bound"), *rest, (F.col("_before") + F.col("_run")).alias("upto"))
