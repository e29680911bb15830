"""The library's model tables, drawn from the tables at hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAYS = [0, 1, 2, 3, 4, 5, 6]
KINDS = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def steady_sum(c: str) -> Column:
    """The sum of a column of doubles in whatever order they come: in decimals, where all values of a group have up to ten places, else as doubles."""
    places = F.col(c).try_cast("decimal(28,10)")
    exact = F.count(F.when(places.cast("double") == F.col(c), 1)) == F.count(c)
    return F.when(exact, F.sum(places).cast("double")).otherwise(F.sum(c))


def expression(spark: SparkSession, d: str) -> DataFrame:
    """Feature = event type, context = day of the week (0: Monday), subject = user, value = log1p of the sum."""
    ev = table(spark, d, "events").filter("user_id is not null and event_type is not null and ts is not null")
    rows = ev.groupBy(F.col("event_type").alias("feature"), F.weekday("ts").alias("context"), F.col("user_id").alias("subject")).agg(F.log1p(steady_sum("value")).alias("value"))
    return rows.withColumn("pos", F.col("subject"))


def samples(spark: SparkSession, d: str) -> DataFrame:
    """(subject, sex, age, agonal_state)"""
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("subject"), (F.col("c_custkey") % 2 + 1).cast("int").alias("sex"), F.col("c_mktsegment").alias("age"), (F.col("c_nationkey") % 5).cast("int").alias("agonal_state"))


def sample_contexts(spark: SparkSession, d: str) -> DataFrame:
    """(subject, context, sex, age, agonal_state) of the subjects with a sample there."""
    return expression(spark, d).select("subject", "context").distinct().join(samples(spark, d), "subject")


def vectors_long(spark: SparkSession, d: str) -> DataFrame:
    """(feature, context, sample, pos, value): position in the vector, label, vector."""
    e = table(spark, d, "embeddings").filter("vec_id is not null and embedding is not null and label is not null")
    return e.select(F.col("label").alias("context"), F.col("vec_id").alias("sample"), F.col("vec_id").alias("pos"), F.posexplode("embedding").alias("feature", "value")).withColumn("value", F.col("value").cast("double"))


def brand_priority(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, value): brand by order priority, mean price."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    p = table(spark, d, "part").select("p_partkey", "p_brand")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    j = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    return j.groupBy(F.col("p_brand").alias("row"), F.col("o_orderpriority").alias("col")).agg(F.avg("l_extendedprice").alias("value"))


def user_day(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, value): user by event type and day, 5 x 7 columns: col = 7 * type + day, types in order of name."""
    e = expression(spark, d)
    code = F.array_position(F.array(*map(F.lit, KINDS)), F.col("feature")) - 1
    return e.select(F.col("subject").alias("row"), (code * 7 + F.col("context")).cast("int").alias("col"), "value").filter("col >= 0")


def vector_cells(spark: SparkSession, d: str) -> DataFrame:
    """(row, col, value): vector by position, shifted to be positive."""
    return vectors_long(spark, d).select(F.col("sample").alias("row"), F.col("feature").alias("col"), (F.col("value") + 1).alias("value"))


def event_cube(spark: SparkSession, d: str) -> DataFrame:
    """(context, subject, feature, value): day, event type, user: users are the many features, event types the subjects."""
    e = expression(spark, d)
    code = F.array_position(F.array(*map(F.lit, KINDS)), F.col("feature")) - 1
    return e.select("context", code.cast("int").alias("subject"), F.col("subject").alias("feature"), "value").filter("subject >= 0")


def label_clusters(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Known biclusters to weigh: a label's vectors by the positions with the same remainder of ten. (id, row) and (id, col)."""
    e = table(spark, d, "embeddings").filter("vec_id is not null and label is not null")
    rows = e.select(F.col("label").cast("long").alias("id"), F.col("vec_id").alias("row"))
    ids = rows.select("id").distinct().withColumn("r", F.col("id") % 10)
    cols = vectors_long(spark, d).select(F.col("feature").alias("col")).distinct().withColumn("r", (F.col("col") % 10).cast("long"))
    return rows, ids.join(cols, "r").select("id", "col")


def price_clusters(spark: SparkSession, d: str) -> DataFrame:
    """(id, rows, cols): for each part size the brands, and the order months, that are dearer than the mean."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    brand = F.regexp_extract("p_brand", "(\\d+)", 1).cast("int")
    mean = p.agg(F.avg("p_retailprice").alias("m"))
    rows = p.groupBy(F.col("p_size").cast("long").alias("id"), brand.alias("r")).agg(F.avg("p_retailprice").alias("v")).join(F.broadcast(mean)).filter("v > m")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    o = table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("c"))
    priced = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)
    by_month = priced.groupBy(F.col("p_size").cast("long").alias("id"), "c").agg(F.sum("l_extendedprice").alias("s"), F.count(F.lit(1)).alias("n"))
    whole = by_month.agg((F.sum("s") / F.sum("n")).alias("m"))
    cols = by_month.join(F.broadcast(whole)).filter("s / n > m")
    r = rows.groupBy("id").agg(F.sort_array(F.collect_set("r")).alias("rows"))
    return r.join(cols.groupBy("id").agg(F.sort_array(F.collect_set("c")).alias("cols")), "id")


def members(clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    return clusters.select("id", F.explode("rows").alias("row")), clusters.select("id", F.explode("cols").alias("col"))
