"""Reshaping, slicing and first aggregates of long expression rows (context, feature, sample, subject, pos, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .discretize import codes


def unpivot(wide: DataFrame, ids: list[str], samples: list[str]) -> DataFrame:
    """One row a sample, with its ordinal: the columns become one array, so wide plans stay small."""
    names = F.array(*map(F.lit, samples))
    return wide.select(*ids, F.posexplode(F.array(*(F.col(c).cast("double") for c in samples))).alias("pos", "value")).select(*ids, names[F.col("pos")].alias("sample"), "pos", "value")


def subject_of(sample: Column) -> Column:
    return F.substring_index(sample, "-", 2)


def split_targets(table: DataFrame, key: str, names: tuple[str, ...] = ("class", "output", "target")) -> tuple[DataFrame, DataFrame | None]:
    """The matrix without its class column, and the targets (key, class, code): codes from 0 in the order of the classes, none for a missing one."""
    found = next((c for c in table.columns if c.lower() in names), None)
    if not found:
        return table, None
    targets = table.select(key, F.col(found).alias("class"))
    return table.drop(found), targets.join(codes(targets, "class").withColumnRenamed("category", "class"), "class", "left").select(key, "class", "code")


def drop_incomplete(table: DataFrame) -> DataFrame:
    return table.dropna("any")


def without_prefix(col: Column, prefix: str) -> Column:
    return ~col.startswith(prefix)


def profile_slice(expression: DataFrame, samples: DataFrame, picks: dict[str, list]) -> DataFrame:
    """Rows of subjects that match the picks: any value within a category, all categories together.

    A category whose picks match no sample of a context is ignored there; a context where none matches has no rows.
    samples: (subject, context, categories...). One small flag row a context is joined back.
    """
    own = samples.select("subject", "context", *(F.coalesce(F.col(c).isin(v), F.lit(False)).alias(c) for c, v in picks.items()))
    any_ = own.groupBy("context").agg(*(F.max(c).alias(f"any_{c}") for c in picks))
    ok, some = F.lit(True), F.lit(False)
    for c in picks:
        ok, some = ok & (F.col(c) | ~F.col(f"any_{c}")), some | F.col(f"any_{c}")
    kept = own.join(any_, "context").filter(ok & some).select("subject", "context")
    return expression.join(kept, ["subject", "context"], "left_semi")


def moments(expression: DataFrame) -> DataFrame:
    """One shuffle by (feature, context) serves eligibility, means, deviations and the t statistics."""
    v = F.col("value")
    return expression.groupBy("feature", "context").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.max((v != 0).cast("int")).alias("non_zero"),
    )


def eligible_features(m: DataFrame, inputs: list, outputs: list, least: int = 3) -> DataFrame:
    """Features with some value in an input and in an output context and more than `least` samples in every selected one."""
    side = lambda s: F.max(F.when(F.col("context").isin(s), F.col("non_zero")).otherwise(0))
    rows = m.filter(F.col("context").isin(inputs + outputs))
    out = rows.groupBy("feature").agg(side(inputs).alias("i"), side(outputs).alias("o"), F.min("n").alias("n"), F.count(F.lit(1)).alias("contexts"))
    return out.filter((F.col("i") == 1) & (F.col("o") == 1) & (F.col("n") > least) & (F.col("contexts") == len(set(inputs + outputs)))).select("feature")


def usable_contexts(m: DataFrame, least: int = 3) -> DataFrame:
    """(feature, context, kept): contexts with more than `least` samples and some value."""
    return m.select("feature", "context", ((F.col("n") > least) & (F.col("non_zero") == 1)).alias("kept"))


def means(expression: DataFrame) -> DataFrame:
    return expression.groupBy("feature", "context").agg(F.avg("value").alias("value"))


def pivot(cells: DataFrame, row: str, col: str, cols: list, agg: Column) -> DataFrame:
    return cells.groupBy(row).pivot(col, cols).agg(agg)


def top_features(expression: DataFrame, context, k: int | None = None) -> DataFrame:
    out = means(expression.filter(F.col("context") == context)).select("feature", F.col("value").alias("mean")).orderBy(F.desc("mean"), "feature")
    return out.limit(k) if k else out


def in_all_contexts(expression: DataFrame, contexts: list) -> DataFrame:
    """Subjects with a sample in every context; a single context has none."""
    out = expression.filter(F.col("context").isin(contexts)).groupBy("subject").agg(F.count_distinct("context").alias("n"))
    return out.filter((F.col("n") == len(contexts)) & F.lit(len(contexts) > 1)).select("subject")


def cube(expression: DataFrame, contexts: list, subjects: DataFrame) -> DataFrame:
    """(context, subject, feature, value): the last sample by pos wins; a missing cell of the grid is 0."""
    rows = expression.filter(F.col("context").isin(contexts)).join(subjects, "subject", "left_semi")
    found = rows.groupBy("context", "subject", "feature").agg(F.max_by("value", "pos").alias("value"))
    axes = rows.select("subject").distinct().withColumn("context", F.explode(F.array(*map(F.lit, contexts))))
    names = rows.select("feature").distinct().groupBy().agg(F.collect_list("feature").alias("fs"))  # the feature list, bounded by the catalogue
    grid = axes.join(F.broadcast(names)).select("context", "subject", F.explode("fs").alias("feature"))
    return grid.join(found, ["context", "subject", "feature"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def near_zero(v: Column) -> Column:
    return F.when(F.abs(v) <= 1e-10, 1e-10).otherwise(v)


def matrix_statistics(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count_distinct("row").alias("n_rows"), F.count_distinct("col").alias("n_cols"), F.count(F.when(F.col("value") != 0, 1)).alias("n_non_zero"))


def histogram(expression: DataFrame, m: DataFrame, bins: int = 50) -> DataFrame:
    """Density of `bins` equal bins between minimum and maximum of each (feature, context)."""
    rows = expression.join(m.select("feature", "context", "lo", "hi", "n"), ["feature", "context"]).filter("hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    bin_ = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    return rows.groupBy("feature", "context", bin_.alias("bin")).agg((F.count(F.lit(1)) / F.max(F.col("n") * width)).alias("density"))


def density_curve(expression: DataFrame, m: DataFrame, points: int = 25) -> DataFrame:
    """Gaussian kernel density on an even grid from minimum to maximum; bandwidth std * n^(-1/5). A narrow explode, then one grouped sum."""
    rows = expression.join(m.filter("hi > lo and n > 1").select("feature", "context", "lo", "hi", "n", F.sqrt("var").alias("s")), ["feature", "context"])
    h = F.col("s") * F.pow("n", F.lit(-0.2))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    each = rows.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("z", (at - F.col("value")) / h)
    return each.groupBy("feature", "context", "point").agg((F.sum(F.exp(-F.col("z") * F.col("z") / 2)) / F.max(F.col("n") * h * F.sqrt(F.lit(2 * 3.141592653589793)))).alias("density"))


def page(table: DataFrame, order: list[str], number: int, size: int = 10) -> DataFrame:
    """One page of a table in the given order; pages count from 0."""
    return table.orderBy(*order).offset(number * size).limit(size)


def least_columns(stats: DataFrame) -> DataFrame:
    """The default smallest number of columns of a pattern: the root of their number, two at least."""
    return stats.select(F.greatest(F.lit(2), F.floor(F.sqrt("n_cols"))).cast("int").alias("min_cols"))
