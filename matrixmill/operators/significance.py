"""Significance of biclusters and triclusters against null models of columns. Members: (id, row) and (id, col); cells: (row, col, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pvalues as P
from .scratch import counts_at


def patterns(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(id, col, value): column means over the cluster's rows."""
    return cells.join(rows, "row").join(cols, ["id", "col"]).groupBy("id", "col").agg(F.avg("value").alias("value"))


def shares_within(values: DataFrame, bounds: DataFrame, key: str) -> DataFrame:
    """bounds (key, lower, upper, more columns) with column share: part of the key's values in (lower, upper]. Counted at the bounds in one sort, not joined."""
    rest = [c for c in bounds.columns if c not in (key, "lower", "upper")]
    ends = bounds.select(key, *rest, F.explode(F.array(F.struct(F.col("lower").alias("bound"), F.lit(False).alias("top")), F.struct(F.col("upper").alias("bound"), F.lit(True).alias("top")))).alias("e")).select(key, *rest, "e.bound", "e.top")
    at = counts_at(values, ends, key)
    n = values.groupBy(key).agg(F.count("value").alias("_n"))
    inside = F.sum(F.when(F.col("top"), F.col("upto")).otherwise(-F.col("upto")))
    return at.groupBy(key, *rest).agg(F.greatest(F.lit(0), inside).alias("_k")).join(n, key).select(key, *rest, (F.col("_k") / F.col("_n")).alias("share"))


def around(pattern: DataFrame, spread: DataFrame, key: str, coherence: float) -> DataFrame:
    """Bounds of each pattern value: half of coherence times the key's range to either side, within the range."""
    delta = (F.col("hi") - F.col("lo")) * coherence / 2
    rest = [c for c in pattern.columns if c not in (key, "value")]
    return pattern.join(spread, key).select(key, *rest, F.greatest(F.col("value") - delta, F.col("lo")).alias("lower"), F.least(F.col("value") + delta, F.col("hi")).alias("upper"))


def column_shares(cells: DataFrame, pattern: DataFrame, coherence: float = 0.3) -> DataFrame:
    """(id, col, share): part of the column within half of coherence times its range of the pattern, (low, high]."""
    values = cells.filter("value is not null").select("col", "value")
    spread = values.groupBy("col").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return shares_within(values, around(pattern.select("col", "id", "value"), spread, "col", coherence), "col").select("id", "col", "share")


def product(col: Column) -> Column:
    return F.when(F.min(col) <= 0, 0.0).otherwise(F.exp(F.sum(F.log(F.when(col > 0, col)))))


def bicluster_significance(cells: DataFrame, rows: DataFrame, cols: DataFrame, coherence: float = 0.3, uniform: bool = False) -> DataFrame:
    """(id, n, p, significance): chance that n or more of all rows follow the pattern; within 1e-10 of 1 it is 1."""
    if uniform:
        chance = cols.groupBy("id").agg(F.pow(F.lit(coherence), F.count(F.lit(1))).alias("p"))
    else:
        chance = column_shares(cells, patterns(cells, rows, cols), coherence).groupBy("id").agg(product(F.col("share")).alias("p"))
    size = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.count_distinct("row").alias("total"))
    out = chance.join(size, "id").join(F.broadcast(total)).withColumn("significance", P.binomial_udf(F.col("n"), F.col("total"), F.col("p")))
    return out.withColumn("significance", F.when(F.abs(F.col("significance") - 1) <= 1e-10, 1.0).otherwise(F.col("significance"))).select("id", "n", "p", "significance")


def tricluster_significance(cube: DataFrame, contexts: DataFrame, subjects: DataFrame, features: DataFrame, coherence: float = 0.3) -> DataFrame:
    """(id, n, p, significance) with the null model of each subject over all contexts and features; n counts the cluster's contexts, not snapped to 1."""
    inside = cube.join(contexts, "context").join(subjects, ["id", "subject"]).join(features, ["id", "feature"])
    pattern = inside.groupBy("id", "subject", "feature").agg(F.avg("value").alias("value"))
    values = cube.filter("value is not null").select("subject", "value")
    spread = values.groupBy("subject").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    share = shares_within(values, around(pattern, spread, "subject", coherence), "subject").select("id", "share")
    chance = share.groupBy("id").agg(product(F.col("share")).alias("p"))
    size = contexts.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    total = cube.agg(F.count_distinct("context").alias("total"))
    return chance.join(size, "id").join(F.broadcast(total)).withColumn("significance", P.binomial_udf(F.col("n"), F.col("total"), F.col("p"))).select("id", "n", "p", "significance")


def symbol_frequencies(items: DataFrame) -> DataFrame:
    """(col, bin, frequency): share of all rows."""
    n = items.agg(F.count_distinct("row").alias("n_rows"))
    return items.filter("bin is not null").groupBy("col", "bin").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n)).select("col", "bin", (F.col("k") / F.col("n_rows")).alias("frequency"), "n_rows")


def symbolic_significance(items: DataFrame, rows: DataFrame, pattern: DataFrame, kind: str = "constant", bins: int = 5, max_p: float | None = None) -> DataFrame:
    """(id, n, p, significance): chance that MORE than n rows show the pattern (id, col, bin); those above max_p go.

    constant: product of the symbols' frequencies, 0.01 for one never seen; order: 1 / (columns)!; additive: the sum over the
    pattern and its shifts upward that keep the symbols in range; multiplicative: the sum over the pattern and its multiples
    by 2, 3, ... below floor(bins / its largest symbol).
    """
    if kind not in ("constant", "order", "additive", "multiplicative"):
        raise ValueError(f"no significance for patterns of kind {kind!r}")
    n_rows = items.agg(F.count_distinct("row").alias("total"))
    size = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    if kind == "order":
        # by the logarithm: beyond 20 columns the factorial is no long
        width = pattern.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("k"))
        chance = width.select("id", F.exp(-F.aggregate(F.sequence(F.lit(1), "k"), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))).alias("p"))
    else:
        top = pattern.groupBy("id").agg(F.max("bin").alias("top"))
        if kind == "additive":
            moves = F.sequence(F.lit(0), F.greatest(F.lit(0), bins - 1 - F.col("top")).cast("int"))
        elif kind == "multiplicative":
            moves = F.when(F.col("top") > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(F.lit(bins) / F.col("top")) - 1).cast("int"))).otherwise(F.array(F.lit(1)))
        else:
            moves = F.array(F.lit(0))
        moved = pattern.join(top, "id").withColumn("move", F.explode(moves))
        moved = moved.withColumn("bin", F.col("bin") * F.col("move") if kind == "multiplicative" else F.col("bin") + F.col("move"))
        kept = moved.join(symbol_frequencies(items).select("col", "bin", "frequency"), ["col", "bin"], "left").withColumn("f", F.coalesce("frequency", F.lit(0.01)))
        chance = kept.groupBy("id", "move").agg(product(F.col("f")).alias("p")).groupBy("id").agg(F.least(F.lit(1.0), F.sum("p")).alias("p"))
    out = chance.join(size, "id").join(F.broadcast(n_rows))
    out = out.withColumn("significance", P.binomial_udf(F.col("n") + 1, F.col("total"), F.col("p"))).select("id", "n", "p", "significance")
    return out if max_p is None else out.filter(F.col("significance") <= max_p)
