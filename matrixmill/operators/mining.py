"""Symbolic biclusters: closed itemsets and order sequences with their rows, merging, filtering, masking, metrics.

A bicluster table has id, rows array, cols array; overlaps meet on rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .closed import Itemsets, Sequences, closed, first_enough
from .scratch import keep as _cut
from .scratch import ranked, set_id, tidy
from .setjoin import contained


def closed_itemsets(transactions: DataFrame, min_support: float, min_items: int = 2) -> DataFrame:
    """(id, items, support, rows): frequent itemsets without a superset of the same support."""
    return closed(transactions, Itemsets, min_support, min_items)


def closed_sequences(sequences: DataFrame, min_support: float, min_cols: int = 2) -> DataFrame:
    """(id, sequence, support, rows): frequent order patterns without one of a column more and the same support; rows by true containment."""
    return closed(sequences, Sequences, min_support, min_cols)


def gcd_of(numbers):
    """Greatest common divisor of an array of positive longs; null if it is empty."""
    pair = lambda a, b: F.aggregate(F.sequence(F.lit(1).cast("long"), F.least(a, b)), F.lit(1).cast("long"), lambda g, i: F.when((a % i == 0) & (b % i == 0), i).otherwise(g))
    return F.aggregate(numbers, F.get(numbers, F.lit(0)), lambda g, b: pair(g, b))


def to_biclusters(sets: DataFrame, bins: int, kind: str = "constant") -> DataFrame:
    """(id, rows, cols, pattern): distinct columns of the items; of a column's items the first gives the symbol.

    An additive pattern is counted from its least symbol; a multiplicative one is divided by the greatest common divisor of its symbols above 0.
    """
    item = F.explode("items").alias("item")
    cells = sets.select("id", item).groupBy("id", F.floor(F.col("item") / bins).cast("int").alias("col")).agg(F.min(F.col("item") % bins).alias("bin"))
    shape = cells.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("col", "bin"))).alias("c"))
    out = sets.select("id", "rows").join(shape, "id").select("id", "rows", F.col("c.col").alias("cols"), F.col("c.bin").alias("pattern"))
    if kind == "additive":
        return out.withColumn("pattern", F.transform("pattern", lambda b: b - F.array_min("pattern")))
    if kind == "multiplicative":
        above_zero = F.filter(F.transform("pattern", lambda b: b.cast("long")), lambda b: b > 0)
        divisor = F.coalesce(gcd_of(above_zero), F.lit(1))
        return out.withColumn("pattern", F.transform("pattern", lambda b: (b / divisor).cast("int")))
    return out


def sequence_biclusters(found: DataFrame) -> DataFrame:
    """(id, rows, cols, sequence): an order pattern's columns, ascending."""
    return found.select("id", "rows", F.sort_array(F.flatten("sequence")).alias("cols"), "sequence")


@tidy
def support_search(transactions: DataFrame, min_clusters: int, min_rows: int, min_items: int = 2, start: float = 0.95, factor: float = 0.9, kind: str = "constant", min_area: int | None = None, least_support: float = 0.0) -> DataFrame:
    """Closed itemsets (kind 'order': closed sequences) at the highest support that gives more than min_clusters, or more than twice min_area of rows x columns in all.

    The support falls by a factor as long as it is min_rows of all rows, and least_support, at least; the patterns of the last
    support tried are returned. It is one search, whose bound falls: what was found stays, and growth goes on where it waited.
    """
    transactions = _cut(transactions)
    floor = max(min_rows / max(1, transactions.count()), least_support)
    shares = [start]
    while shares[-1] * factor >= floor:
        shares.append(shares[-1] * factor)
    enough = lambda n, area: n > min_clusters or (min_area is not None and area > 2 * min_area)
    return first_enough(transactions, Sequences if kind == "order" else Itemsets, [max(s, floor) for s in shares], min_items, enough)


def overlaps(b: DataFrame) -> DataFrame:
    """(a, b, common_cols, common_rows) of pairs a < b with a common column and row, with both sides' sizes.

    Pairs meet on rows, which are many, and are counted there; of the members only columns, which are few, come to the pairs.
    """
    r = b.select("id", F.explode("rows").alias("x"))
    by_row = r.toDF("a", "x").join(r.toDF("b", "x"), "x").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).cast("int").alias("common_rows"))
    side = lambda k: b.select(F.col("id").alias(k), F.size("rows").alias(f"rows_{k}"), F.size("cols").alias(f"cols_{k}"), F.col("cols").alias(f"_c{k}"))
    out = by_row.join(side("a"), "a").join(side("b"), "b").withColumn("common_cols", F.size(F.array_intersect("_ca", "_cb")).cast("long"))
    return out.filter("common_cols > 0").select("a", "b", "common_cols", "rows_a", "cols_a", "rows_b", "cols_b", "common_rows")


def overlap_ratio(b: DataFrame) -> DataFrame:
    o = overlaps(b)
    small = F.least(F.col("rows_a") * F.col("cols_a"), F.col("rows_b") * F.col("cols_b"))
    return o.select("a", "b", (F.col("common_rows") * F.col("common_cols") / small).alias("ratio"))


@tidy
def close_pairs(b: DataFrame, tau: float) -> DataFrame:
    """(a, b) with tau of the larger number of columns in common, and tau of the smaller area.

    Then tau of the smaller row set is shared, so a set join on rare rows finds the pairs; sizes and columns rule most out before rows are compared.
    """
    if tau <= 0:  # any overlap will do
        return overlaps(b).select("a", "b")
    found = contained(b.select("id", F.col("rows").alias("members")), tau)
    side = lambda k: b.select(F.col("id").alias(k), F.size("rows").alias(f"rows_{k}"), F.size("cols").alias(f"cols_{k}"), F.col("cols").alias(f"_c{k}"))
    near = found.join(side("a"), "a").join(side("b"), "b").filter(F.least("cols_a", "cols_b") >= tau * F.greatest("cols_a", "cols_b"))
    near = near.withColumn("common_cols", F.size(F.array_intersect("_ca", "_cb"))).filter((F.col("common_cols") > 0) & (F.col("common_cols") >= tau * F.greatest("cols_a", "cols_b"))).drop("_ca", "_cb")
    area = F.least(F.col("rows_a") * F.col("cols_a"), F.col("rows_b") * F.col("cols_b"))
    # with all rows of the smaller in common the area must do
    near = _cut(near.withColumn("area", area).filter(F.least("rows_a", "rows_b") * F.col("common_cols") >= tau * F.col("area")).select("a", "b", "common_cols", "area"))
    rows = lambda k: b.select(F.col("id").alias(k), F.col("rows").alias(f"_r{k}"))
    common = F.size(F.array_intersect("_ra", "_rb"))
    return near.join(rows("a"), "a").join(rows("b"), "b").filter((common > 0) & (common * F.col("common_cols") >= tau * F.col("area"))).select("a", "b")


@tidy
def merge(b: DataFrame, tau: float, rounds: int = 2) -> DataFrame:
    """Unions of overlapping biclusters, in at most two rounds. In a round each one takes part in one merge: with its smallest partner that has no smaller one.

    Other columns stay with what is not merged; a merged bicluster has none yet (null).
    """
    out = b.select("id", "rows", "cols", *[c for c in b.columns if c not in ("id", "rows", "cols")])
    for _ in range(rounds):
        pairs = _cut(close_pairs(out, tau))
        first = pairs.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy("b"))).filter("n = 1").select("a", "b")
        first = first.withColumn("n", F.row_number().over(Window.partitionBy("b").orderBy("a"))).filter("n = 1").select("a", "b")
        first = first.join(first.select(F.col("b").alias("a")), "a", "left_anti")
        left, right = out.select("id", "rows", "cols").toDF("a", "ra", "ca"), out.select("id", "rows", "cols").toDF("b", "rb", "cb")
        made = first.join(left, "a").join(right, "b").select(F.col("a").alias("id"), F.sort_array(F.array_union("ra", "rb")).alias("rows"), F.sort_array(F.array_union("ca", "cb")).alias("cols"))
        gone = first.select(F.explode(F.array("a", "b")).alias("id"))
        out = _cut(out.join(gone, "id", "left_anti").unionByName(made, allowMissingColumns=True))
    return out


def filter_overlapping(b: DataFrame, tau: float, relevance: str | None = None) -> DataFrame:
    """Without those that overlap a more relevant one; equally relevant, the later goes. A removed one still removes others."""
    score = b.select("id", (F.col(relevance) if relevance else F.lit(0)).alias("s"))
    p = close_pairs(b, tau).join(score.toDF("a", "sa"), "a").join(score.toDF("b", "sb"), "b")
    gone = p.select(F.when(F.col("sa") < F.col("sb"), F.col("a")).otherwise(F.col("b")).alias("id")).distinct()
    return b.join(gone, "id", "left_anti")


@tidy
def masked(cells: DataFrame, b: DataFrame, share: float = 0.6) -> DataFrame:
    """Cells without the most covered ones: int(share * covered cells) + 1 of them, ties by (row, col). Counts rank first; cells only at the boundary."""
    cover = _cut(b.select(F.explode("rows").alias("row"), "cols").select("row", F.explode("cols").alias("col")).groupBy("row", "col").agg(F.count(F.lit(1)).alias("k")))
    levels = cover.groupBy("k").agg(F.count(F.lit(1)).alias("n"))  # one row a count
    above = levels.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)))
    total = cover.agg((F.floor(F.count(F.lit(1)) * share) + 1).alias("take"))
    marks = above.join(F.broadcast(total)).select("k", (F.col("upto") - F.col("n")).alias("before"), "upto", "take")
    ranked = cover.join(F.broadcast(marks), "k")
    whole = ranked.filter("upto <= take").select("row", "col")
    edge = ranked.filter("upto > take and before < take").withColumn("i", F.row_number().over(Window.partitionBy("k").orderBy("row", "col"))).filter("before + i <= take").select("row", "col")
    return cells.join(whole.unionByName(edge), ["row", "col"], "left_anti")


def symbol_pattern(items: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(id, col, bin): each column's most frequent symbol in the cluster, the smallest of equal ones."""
    return items.join(rows, "row").join(cols, ["id", "col"]).groupBy("id", "col").agg(F.mode("bin", True).alias("bin"))


def mixed_pattern(cells: DataFrame, rows: DataFrame, cols: DataFrame) -> DataFrame:
    """(id, col, category, middle): mode of text columns, median of numeric ones. cells: (row, col, text, value)."""
    return cells.join(rows, "row").join(cols, ["id", "col"]).groupBy("id", "col").agg(F.mode("text", True).alias("category"), F.median("value").alias("middle"))


def class_lift(rows: DataFrame, targets: DataFrame, least: float = 1.05) -> DataFrame:
    """(id, class, lift, kept): share of the class in the cluster over its share of all rows; kept if the best lift reaches `least`."""
    n = targets.agg(F.count(F.lit(1)).alias("n"))
    share = targets.groupBy("class").agg(F.count(F.lit(1)).alias("k")).join(F.broadcast(n)).select("class", (F.col("k") / F.col("n")).alias("share"))
    own = rows.join(targets, "row").groupBy("id", "class").agg(F.count(F.lit(1)).alias("k"))
    size = own.groupBy("id").agg(F.sum("k").alias("size"))
    out = own.join(size, "id").join(share, "class").withColumn("lift", F.col("k") / F.col("size") / F.col("share"))
    return out.select("id", "class", "lift", (F.max("lift").over(Window.partitionBy("id")) >= least).alias("kept"))


def ordered(b: DataFrame, by: str = "area") -> DataFrame:
    key = {"area": F.desc(F.size("rows") * F.size("cols")), "rows": F.desc(F.size("rows")), "pvalue": F.asc("significance"), "lift": F.desc("lift")}[by]
    return b.orderBy(key, "id")


def above(b: DataFrame, metric: str, threshold: float) -> DataFrame:
    return b.filter(F.col(metric) >= threshold)


def numbered(b: DataFrame) -> DataFrame:
    """Without clusters that are empty or whose significance is undefined; numbered from 1 by id."""
    kept = b.filter((F.size("rows") > 0) & (F.size("cols") > 0) & F.col("significance").isNotNull() & ~F.isnan("significance"))
    return ranked(kept, [], ["id"], "cluster", "_all").drop("_all")


def cluster_table(b: DataFrame, prefix: str = "") -> DataFrame:
    """(name, significance): clusters numbered by id and named prefix + 'cluster' + number, by significance, then by name as a string."""
    return numbered(b).select(F.concat(F.lit(f"{prefix}cluster"), F.col("cluster").cast("string")).alias("name"), "significance").orderBy("significance", "name")


def aligned(items: DataFrame, kind: str = "additive") -> DataFrame:
    """Adds the factor that aligns a column: max - bin (additive), lcm / bin (multiplicative, none at 0), the sign (symmetric)."""
    if kind == "symmetric":
        return items.withColumn("factor", F.signum("bin"))
    if kind == "additive":
        return items.join(items.groupBy("row").agg(F.max("bin").alias("_top")), "row").withColumn("factor", F.col("_top") - F.col("bin")).drop("_top")
    bins = items.filter("bin > 0").groupBy("row").agg(F.collect_set(F.col("bin").cast("long")).alias("s"))
    lcm = F.aggregate("s", F.lit(1).cast("long"), lambda m, b: (m * b / gcd_of(F.array(m, b))).cast("long"))
    return items.join(bins.select("row", lcm.alias("_m")), "row", "left").withColumn("factor", F.when(F.col("bin") > 0, (F.col("_m") / F.col("bin")).cast("long"))).drop("_m")


def transposed(cells: DataFrame) -> DataFrame:
    return cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value")


#: bins of the two kinds of pattern
KIND_BINS = {"constant": 5, "order": 20}


@tidy
def symbolic_biclusters(cells: DataFrame, kind: str = "constant", bins: int | None = None, by: str = "col", by_columns: bool = False, min_clusters: int = 5, min_rows: int = 2, min_cols: int = 2, rounds: int = 2, tau_merge: float = 0.7, tau_filter: float = 0.5, max_p: float = 1.0) -> DataFrame:
    """(key, rows, cols, pattern, sequence, significance) of a numeric matrix (row, col, value), largest area first.

    Discretise; mine, mask the most covered cells, and again; merge, filter, sort by area; patterns, significance, keys from 0.
    kind: 'constant' symbols in each column, or 'order' of the columns (sequence). by_columns: patterns over the rows of a column.
    A merged cluster's pattern is each column's most frequent symbol. Clusters with a significance above max_p go.
    """
    from .discretize import discretized, sequences, transactions
    from .significance import symbolic_significance

    if kind not in KIND_BINS:
        raise ValueError(f"no patterns of kind {kind!r}")
    bins = bins or KIND_BINS[kind]
    items = _cut(discretized(transposed(cells) if by_columns else cells, bins, by))
    left, found = items, None
    for _ in range(rounds):
        if kind == "order":
            new = sequence_biclusters(support_search(sequences(left), min_clusters, min_rows, min_cols, kind=kind)).withColumn("pattern", F.lit(None).cast("array<int>"))
        else:
            new = to_biclusters(support_search(transactions(left, bins), min_clusters, min_rows, min_cols), bins).withColumn("sequence", F.lit(None).cast("array<array<int>>"))
        new = new.select("rows", "cols", F.col("pattern").cast("array<int>").alias("pattern"), F.col("sequence").cast("array<array<int>>").alias("sequence"))
        found = _cut(new if found is None else found.unionByName(new))
        left = _cut(masked(left, new.withColumn("id", set_id("rows", "cols"))))
    found = found.dropDuplicates(["rows", "cols"]).withColumn("id", set_id("rows", "cols"))
    out = merge(_cut(found), tau_merge).withColumn("area", F.size("rows") * F.size("cols"))
    out = _cut(filter_overlapping(out, tau_filter, "area").drop("area"))
    rows, cols = out.select("id", F.explode("rows").alias("row")), out.select("id", F.explode("cols").alias("col"))
    modes = symbol_pattern(items.filter("bin is not null"), rows, cols).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("col", "bin"))), lambda x: x["bin"]).alias("mode"))
    out = _cut(out.join(modes, "id", "left").withColumn("pattern", F.coalesce("pattern", "mode")).drop("mode"))
    symbols = out.select("id", F.explode(F.arrays_zip("cols", "pattern")).alias("x")).select("id", F.col("x.cols").alias("col"), F.col("x.pattern").alias("bin"))
    out = out.join(symbolic_significance(items, rows, symbols, kind, bins, max_p).select("id", "significance"), "id")
    out = ranked(out.withColumn("_area", -F.size("rows") * F.size("cols")), [], ["_area", "id"], "key", "_all").withColumn("key", F.col("key") - 1)
    shown = [F.col("cols").alias("rows"), F.col("rows").alias("cols")] if by_columns else ["rows", "cols"]
    return out.select("key", *shown, "pattern", "sequence", "significance").orderBy("key")


def set_algebra(b: DataFrame) -> DataFrame:
    """(a, b, n_union, n_common, inside) of the row sets of biclusters that overlap: sizes of union and intersection, and whether a lies in b. Counts tell them all."""
    o = overlaps(b)
    return o.select("a", "b", (F.col("rows_a") + F.col("rows_b") - F.col("common_rows")).alias("n_union"), F.col("common_rows").alias("n_common"), (F.col("common_rows") == F.col("rows_a")).alias("inside"))
