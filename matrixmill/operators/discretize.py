"""Discretising long matrices (row, col, value) into bins, noise items, transactions and order sequences."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import ranked


def standardized(cells: DataFrame, by: str = "col") -> DataFrame:
    """z: by column or row (sample deviation), or over all (population deviation, from a one-row aggregate); 'width' scales a column to 0..1."""
    if by == "all":
        one = cells.agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
        return cells.join(F.broadcast(one)).withColumn("z", (F.col("value") - F.col("_m")) / F.col("_s")).drop("_m", "_s")
    key = "row" if by == "row" else "col"
    low, span = (F.min, lambda c: F.max(c) - F.min(c)) if by == "width" else (F.avg, F.stddev_samp)
    stats = cells.groupBy(key).agg(low("value").alias("_m"), span("value").alias("_s"))
    return cells.join(stats, key).withColumn("z", (F.col("value") - F.col("_m")) / F.col("_s")).drop("_m", "_s")


def cut_points(bins: int, by: str) -> tuple[list[float], list[float], list[float]]:
    """Cuts between bins, and where the noise item of the bin above, or below, begins: 0.2 / bins of probability to either side."""
    at = [i / bins for i in range(1, bins)]
    if by == "width":
        return at, [a - 0.2 / bins for a in at], [a + 0.2 / bins for a in at]
    q = NormalDist().inv_cdf
    return [q(a) for a in at], [q(a - 0.2 / bins) for a in at], [q(a + 0.2 / bins) for a in at]


def discretized(cells: DataFrame, bins: int = 5, by: str = "col") -> DataFrame:
    """(row, col, value, bin, noise_bin). A bin is (low, high]; a missing or undefined value has none; the least value of a column is in bin 0."""
    cuts, below, above = cut_points(bins, by)
    z = F.col("z")
    bin_ = sum(((z > c).cast("int") for c in cuts), F.lit(0))
    noise = F.lit(None).cast("int")
    for i in range(len(cuts)):  # the neighbour above wins where both apply
        noise = F.when((z > cuts[i]) & (z <= above[i]), F.lit(i)).otherwise(noise)
    for i in range(len(cuts)):
        noise = F.when((z <= cuts[i]) & (z > below[i]), F.lit(i + 1)).otherwise(noise)
    known = z.isNotNull() & ~F.isnan(z)
    return standardized(cells, by).select("row", "col", "value", F.when(known, bin_).alias("bin"), F.when(known, noise).alias("noise_bin"))


def quantiles(cells: DataFrame, by: str, bins: int) -> DataFrame:
    """(by, edges): linearly interpolated quantiles 1/bins .. of each column or row, from ranks dealt over many tasks."""
    r = ranked(cells.filter("value is not null").select("row", "col", "value"), [by], ["value", "row" if by == "col" else "col"])
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("q"), (F.lit(i / bins) * (F.col("n") - 1)).alias("h")) for i in range(1, bins))))
    # only the one or two rows next to a quantile go on
    near = r.select(by, "value", "i", at.alias("e")).filter((F.col("i") - 1 >= F.floor("e.h")) & (F.col("i") - 1 <= F.ceil("e.h")))
    # from the lower row on: between equal values the quantile is that value, to the last bit
    low, high, part = F.min("value"), F.max("value"), F.max(F.col("e.h") - F.floor("e.h"))
    edge = near.groupBy(by, F.col("e.q").alias("q")).agg(F.when(low == high, low).otherwise(low + (high - low) * part).alias("x"))
    return edge.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("q", "x"))), lambda e: e["x"]).alias("edges"))


def quantile_bins(cells: DataFrame, bins: int = 5, by: str = "col") -> DataFrame:
    """(row, col, value, bin) by linearly interpolated quantiles of each column or row, right-closed, the lowest included. Repeated edges are an error."""
    edges = quantiles(cells, by, bins)
    checked = F.when(F.size(F.array_distinct("edges")) < F.size("edges"), F.raise_error(F.concat(F.lit(f"repeated quantile edges in {by} "), F.col(by).cast("string"))).cast("array<double>")).otherwise(F.col("edges"))
    bin_ = F.aggregate("edges", F.lit(0), lambda n, e: n + (F.col("value") > e).cast("int"))
    return cells.join(edges.select(by, checked.alias("edges")), by).select("row", "col", "value", bin_.alias("bin"))


def symbol_columns(cells: DataFrame, most: int = 10) -> DataFrame:
    """(col, n_distinct, real): integer columns with more than `most` values count as real."""
    return cells.groupBy("col").agg(F.count_distinct("value").alias("n_distinct")).withColumn("real", F.col("n_distinct") > most)


def codes(table: DataFrame, col: str) -> DataFrame:
    """(category, code), from 0 in order."""
    found = table.select(F.col(col).alias("category")).filter("category is not null").distinct()
    return ranked(found, [], ["category"], "code", "_all").select("category", (F.col("code") - 1).cast("int").alias("code"))


def without_dominant(cells: DataFrame, share: float = 0.8) -> DataFrame:
    """Cells whose value does not fill `share` or more of its column."""
    counts = cells.groupBy("col", "value").agg(F.count(F.lit(1)).alias("k"))
    total = counts.groupBy("col").agg(F.sum("k").alias("n"))
    dominant = counts.join(total, "col").filter(F.col("k") >= share * F.col("n")).select("col", "value")
    return cells.join(dominant, ["col", "value"], "left_anti")


def without_bins(items: DataFrame, drop: list[int]) -> DataFrame:
    return items.withColumn("bin", F.when(~F.col("bin").isin(drop), F.col("bin")))


def sparse_bins(cells: DataFrame, bins: int = 5, most: int = 10) -> DataFrame:
    """Bins over present cells only, by the overall z-score; with at most `most` different values those stay as they are."""
    few = cells.agg((F.count_distinct("value") <= most).alias("few"))
    return discretized(cells, bins, "all").join(F.broadcast(few)).select("row", "col", "value", F.when(F.col("few"), F.col("value")).otherwise(F.col("bin")).alias("item"))


def item(col: Column, bin_: Column, bins: int) -> Column:
    return bin_ + col * bins


def transactions(items: DataFrame, bins: int) -> DataFrame:
    """(row, items): sorted distinct items of bins and noise bins."""
    both = F.filter(F.array("bin", "noise_bin"), lambda b: b.isNotNull())
    return items.select("row", "col", F.explode(both).alias("b")).groupBy("row").agg(F.sort_array(F.collect_set(item(F.col("col"), F.col("b"), bins))).alias("items"))


def sequences(items: DataFrame) -> DataFrame:
    """(row, sequence): columns of equal bin together, by ascending bin; missing ones left out."""
    groups = items.filter("bin is not null").groupBy("row", "bin").agg(F.sort_array(F.collect_list("col")).alias("cols"))
    return groups.groupBy("row").agg(F.transform(F.sort_array(F.collect_list(F.struct("bin", "cols"))), lambda x: x["cols"]).alias("sequence"))
