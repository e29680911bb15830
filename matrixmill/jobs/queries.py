"""Queries of the library's operators over the tables at hand, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discretize as D
from ..operators import expression as X
from ..operators import mining as M
from ..operators import significance as S
from ..operators import spectral as SP
from ..operators import stats as ST
from ..operators import text as T
from ..operators import tricluster as TC
from ..operators.scratch import keep as _kept
from ..operators.scratch import shared_dir, tidy
from ..sources import matrix as SRC
from ..sources import wide as WIDE
from . import sql as Q
from .model import DAYS, PRIORITIES, brand_priority, event_cube, expression, label_clusters, members, price_clusters, sample_contexts, samples, table, user_day, vector_cells, vectors_long

QUERIES: dict = {}
SQL: dict[str, str] = {}
INPUTS, OUTPUTS = [0, 1, 2], [4, 5, 6]
PICKS = {"sex": [1], "age": ["BUILDING", "MACHINERY"], "agonal_state": [0, 1, 9]}

#: common parts of the SQL
E1 = "e AS (SELECT event_type AS feature, CAST(isodow(ts) - 1 AS INTEGER) AS context, user_id AS subject, user_id AS pos, ln(1 + sum(value)) AS value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2, 3)"
E2 = "x AS (SELECT label AS context, vec_id AS sample, CAST(unnest(range(len(embedding))) AS INTEGER) AS feature, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND label IS NOT NULL)"
SAMPLES = "s AS (SELECT c_custkey AS subject, CAST(c_custkey % 2 + 1 AS INTEGER) AS sex, c_mktsegment AS age, CAST(c_nationkey % 5 AS INTEGER) AS agonal_state FROM customer)"
MOM = "m AS (SELECT feature, context, count(value) AS n, avg(value) AS mean, var_samp(value) AS var, stddev_pop(value) AS std, min(value) AS lo, max(value) AS hi, max(CASE WHEN value <> 0 THEN 1 ELSE 0 END) AS non_zero FROM e GROUP BY 1, 2)"
FC = "f AS (SELECT p_brand AS \"row\", o_orderpriority AS col, avg(l_extendedprice) AS value FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"
UD = "u AS (SELECT subject AS \"row\", CAST(7 * (list_position(['click','error','purchase','signup','view'], feature) - 1) + context AS INTEGER) AS col, value FROM e WHERE feature IN ('click','error','purchase','signup','view'))"
VC = "v AS (SELECT sample AS \"row\", feature AS col, value + 1 AS value FROM x)"
PC = """p0 AS (SELECT p_partkey, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS r, CAST(p_size AS BIGINT) AS id, p_retailprice FROM part),
bm AS (SELECT id, month(o_orderdate) AS c, sum(l_extendedprice) AS s, count(*) AS n FROM lineitem JOIN p0 ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
cr AS (SELECT id, r AS "row" FROM p0 GROUP BY 1, 2 HAVING avg(p_retailprice) > (SELECT avg(p_retailprice) FROM p0)),
cc AS (SELECT id, CAST(c AS INTEGER) AS col FROM bm WHERE s / n > (SELECT sum(s) / sum(n) FROM bm)),
ids AS (SELECT id FROM cr INTERSECT SELECT id FROM cc), sz AS (SELECT id, (SELECT count(*) FROM cr WHERE cr.id = ids.id) AS nr, (SELECT count(*) FROM cc WHERE cc.id = ids.id) AS nc FROM ids),
ov AS (SELECT a, b, common_cols, common_rows, x.nr AS rows_a, x.nc AS cols_a, y.nr AS rows_b, y.nc AS cols_b FROM (SELECT p.id AS a, q.id AS b, count(*) AS common_cols FROM cc p JOIN cc q ON p.col = q.col AND p.id < q.id GROUP BY 1, 2)
  JOIN (SELECT p.id AS a, q.id AS b, count(*) AS common_rows FROM cr p JOIN cr q ON p."row" = q."row" AND p.id < q.id GROUP BY 1, 2) USING (a, b) JOIN sz x ON a = x.id JOIN sz y ON b = y.id)"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = tidy(f)
        if sql:
            SQL[name] = sql
        return f

    return add


def r6(c: str):
    return F.round(c, 6).alias(c)


# sources and reshaping
@query("src2_feature_rows", f"WITH {E1} SELECT feature, context, subject, round(value, 6) AS value FROM e WHERE feature IN ('click', 'view')")
def _(spark, d):
    want = spark.createDataFrame([("click",), ("view",), ("absent",)], "feature string")
    return SRC.read_features(expression(spark, d), want).select("feature", "context", "subject", r6("value"))


@query("src1_wide_matrix", f"WITH {E2} SELECT CAST(sample AS VARCHAR) AS feature, CAST(feature AS VARCHAR) AS sample, feature AS pos, round(value, 6) AS value FROM x WHERE value IS NOT NULL")
def _(spark, d):
    """Vectors written as a wide matrix in two batches, one of them twice, and read back in splits."""
    e = table(spark, d, "embeddings").filter("vec_id is not null and embedding is not null and label is not null")
    n = e.agg(F.max(F.size("embedding")).alias("n")).first().n or 0
    name = F.col("vec_id").cast("string")
    wide = e.select(name.alias("id"), F.lit("vector").alias("name"), name.alias("feature"), *(F.get("embedding", F.lit(i)).cast("double").alias(str(i)) for i in range(n)))
    WIDE.register(spark)
    path = f"{shared_dir(spark)}/wide-{uuid.uuid4().hex}"
    for batch in (0, 1, 1):
        wide.filter(F.pmod(F.col("id").cast("long"), F.lit(2)) == batch).write.format("wide_matrix").option("batch", f"part{batch}").mode("append").save(path)
    return spark.read.format("wide_matrix").option("layout", "long").load(path).filter("value is not null").select("feature", "sample", "pos", r6("value"))


@query("snk1_append_batches", "SELECT CASE WHEN c_nationkey % 2 = 0 THEN 'even' ELSE 'odd' END AS batch, c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_nationkey IS NOT NULL")
def _(spark, d):
    """A table appended in two batches, one of them twice."""
    c, path = table(spark, d, "customer"), f"{shared_dir(spark)}/appended-{uuid.uuid4().hex}"
    for batch, rest in (("even", 0), ("odd", 1), ("even", 0)):
        SRC.append_table(c.filter(F.col("c_nationkey") % 2 == rest).select("c_custkey", "c_mktsegment", "c_acctbal"), path, batch)
    return spark.read.parquet(path).select("batch", "c_custkey", "c_mktsegment", "c_acctbal")


@query("src6_row_ids", "SELECT CAST(c_custkey AS BIGINT) AS row_id, c_mktsegment FROM customer")
def _(spark, d):
    return SRC.with_row_ids(table(spark, d, "customer").select("c_custkey", "c_mktsegment"))


@query("unp1_unpivot", f"WITH {E2} SELECT sample, feature, round(value, 6) AS value FROM x")
def _(spark, d):
    e = table(spark, d, "embeddings").filter("vec_id is not null and embedding is not null and label is not null")
    n = e.agg(F.max(F.size("embedding")).alias("n")).first().n or 0
    wide = e.select("vec_id", *(F.get("embedding", F.lit(i)).alias(str(i)) for i in range(n)))
    return X.unpivot(wide, ["vec_id"], [str(i) for i in range(n)]).select(F.col("vec_id").alias("sample"), F.col("pos").alias("feature"), r6("value")).filter("value is not null")


@query("unp2_first_row", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def _(spark, d):
    return SRC.first_rows(table(spark, d, "part"), ["p_name"], ["p_partkey"]).select("p_name", "p_partkey")


@query("prj1_log1p", "SELECT event_id, round(ln(1 + value), 6) AS v FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.log1p("value"), 6).alias("v"))


@query("prj2_subject", "SELECT c_custkey, array_to_string(string_split(c_name || '-' || c_mktsegment || '-x', '-')[1:2], '-') AS subject FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.subject_of(F.concat_ws("-", "c_name", "c_mktsegment", F.lit("x"))).alias("subject"))


@query("prj4_split_targets", "SELECT doc_id, toxic, quality AS class, CAST(CASE WHEN quality IS NOT NULL THEN (SELECT count(DISTINCT b.quality) FROM labels b WHERE b.quality < a.quality) END AS INTEGER) AS code FROM labels a")
def _(spark, d):
    rest, targets = X.split_targets(table(spark, d, "labels").withColumnRenamed("quality", "class"), "doc_id")
    return rest.join(targets, "doc_id")


@query("flt1_class_filter", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def _(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderpriority").isin(PRIORITIES[:2])).select("o_orderkey")


@query("flt2_complete_distinct", "SELECT p_name, min(p_partkey) AS p_partkey FROM part WHERE p_partkey IS NOT NULL AND p_name IS NOT NULL AND p_brand IS NOT NULL AND p_type IS NOT NULL AND p_size IS NOT NULL AND p_retailprice IS NOT NULL GROUP BY 1")
def _(spark, d):
    return SRC.first_rows(X.drop_incomplete(table(spark, d, "part")), ["p_name"], ["p_partkey"]).select("p_name", "p_partkey")


@query("flt3_prefix_filter", "SELECT p_partkey FROM part WHERE NOT starts_with(p_name, 'red')")
def _(spark, d):
    return table(spark, d, "part").filter(X.without_prefix(F.col("p_name"), "red")).select("p_partkey")


_PROFILE = f"""{E1}, {SAMPLES}, sc AS (SELECT DISTINCT e.subject, context, coalesce(sex IN (1), false) AS c1, coalesce(age IN ('BUILDING', 'MACHINERY'), false) AS c2, coalesce(agonal_state IN (0, 1, 9), false) AS c3 FROM e JOIN s USING (subject)),
fl AS (SELECT context, bool_or(c1) AS a1, bool_or(c2) AS a2, bool_or(c3) AS a3 FROM sc GROUP BY 1),
sl AS (SELECT e.* FROM e SEMI JOIN (SELECT subject, context FROM sc JOIN fl USING (context) WHERE (c1 OR NOT a1) AND (c2 OR NOT a2) AND (c3 OR NOT a3) AND (a1 OR a2 OR a3)) k USING (subject, context))"""


@query("flt4_profile_slice", f"WITH {_PROFILE} SELECT feature, context, subject, round(value, 6) AS value FROM sl")
def _(spark, d):
    return X.profile_slice(expression(spark, d), sample_contexts(spark, d), PICKS).select("feature", "context", "subject", r6("value"))


@query("flt5_eligible_features", f"WITH {E1}, {MOM} SELECT feature FROM m WHERE context IN (0,1,2,4,5,6) GROUP BY 1 HAVING max(CASE WHEN context IN (0,1,2) THEN non_zero ELSE 0 END) = 1 AND max(CASE WHEN context IN (4,5,6) THEN non_zero ELSE 0 END) = 1 AND min(n) > 3 AND count(*) = 6")
def _(spark, d):
    return X.eligible_features(X.moments(expression(spark, d)), INPUTS, OUTPUTS)


@query("flt6_usable_contexts", f"WITH {E1}, {MOM} SELECT feature, context, n > 3 AND non_zero = 1 AS kept FROM m")
def _(spark, d):
    return X.usable_contexts(X.moments(expression(spark, d)))


@query("flt7_submatrix", f"WITH {E2}, {VC}, r AS (SELECT CAST(label AS BIGINT) AS id, vec_id AS \"row\" FROM embeddings WHERE label IS NOT NULL) SELECT id, \"row\", col, round(value, 6) AS value FROM v JOIN r USING (\"row\") WHERE col % 10 = id % 10")
def _(spark, d):
    rows, cols = label_clusters(spark, d)
    return vector_cells(spark, d).join(rows, "row").join(cols, ["id", "col"]).select("id", "row", "col", r6("value"))


@query("pvt1_matrix", f"WITH {FC} SELECT \"row\", " + ", ".join(f"round(max(CASE WHEN col = '{p}' THEN value END), 6) AS \"{p[0]}\"" for p in PRIORITIES) + " FROM f GROUP BY 1")
def _(spark, d):
    out = X.pivot(brand_priority(spark, d), "row", "col", PRIORITIES, F.max("value"))
    return out.select("row", *(F.round(F.col(f"`{p}`"), 6).alias(p[0]) for p in PRIORITIES))


@query("pvt2_transpose", f"WITH {FC} SELECT col AS \"row\", \"row\" AS col, round(value, 6) AS value FROM f")
def _(spark, d):
    return brand_priority(spark, d).select(F.col("col").alias("row"), F.col("row").alias("col"), r6("value"))


# joins
@query("jn1_samples_dimension", "SELECT o_orderkey AS sample, c_custkey AS subject, CAST(c_custkey % 2 + 1 AS INTEGER) AS sex, c_mktsegment AS age FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample"), F.col("o_custkey").alias("subject"))
    return a.join(samples(spark, d), "subject").select("sample", "subject", "sex", "age")


@query("jn2_sample_profile", f"WITH {E1}, {SAMPLES} SELECT feature, context, subject, sex, age, agonal_state FROM e LEFT JOIN s USING (subject)")
def _(spark, d):
    return expression(spark, d).join(samples(spark, d), "subject", "left").select("feature", "context", "subject", "sex", "age", "agonal_state")


@query("jn3_catalogue", "WITH w AS (SELECT p_partkey, p_size, upper(unnest(string_split(p_name, ' '))) AS w FROM part), c AS (SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS w FROM part) SELECT w AS feature, min(p_partkey) AS first_seen FROM w WHERE w IN (SELECT w FROM c) GROUP BY 1")
def _(spark, d):
    part = table(spark, d, "part")
    first_words = part.select(F.upper(F.substring_index("p_name", " ", 1)).alias("feature"))
    return T.in_catalogue(part.select("p_partkey", T.names(F.col("p_name")).alias("feature")), first_words, "p_partkey")


@query("jn5_context_pairs", f"WITH {E1}, {MOM} SELECT p.feature, p.context AS a, q.context AS b, p.n AS n_a, q.n AS n_b FROM m p JOIN m q ON p.feature = q.feature AND p.context < q.context")
def _(spark, d):
    return ST.pairs_of(X.moments(expression(spark, d))).select("feature", "a", "b", "n_a", "n_b")


_PAIRED = f"""{E1}, rk AS (SELECT feature, context, value, row_number() OVER (PARTITION BY feature, context ORDER BY pos) AS i FROM e),
pr AS (SELECT p.feature, p.context AS a, q.context AS b, p.i, p.value AS x, q.value AS y FROM rk p JOIN rk q ON p.feature = q.feature AND p.i = q.i AND p.context IN (0,1,2) AND q.context IN (4,5,6))"""


def _pairs(spark, d):
    e = expression(spark, d)
    m = X.moments(e)
    return e, m, ST.pairs_of(m, INPUTS, OUTPUTS)


@query("jn6_paired_positions", f"WITH {_PAIRED} SELECT feature, a, b, i, round(x, 6) AS x, round(y, 6) AS y FROM pr")
def _(spark, d):
    e, _, p = _pairs(spark, d)
    return ST.paired_rows(e, p).select("feature", "a", "b", "i", r6("x"), r6("y"))


@query("jn9_subject_ratios", f"WITH {E1} SELECT p.context, p.subject AS feature, p.feature AS i, q.feature AS j, round(p.value / q.value, 6) AS ratio FROM e p JOIN e q ON p.context = q.context AND p.subject = q.subject AND p.feature < q.feature WHERE p.value <> 0 AND q.value <> 0")
def _(spark, d):
    x = expression(spark, d).filter("value <> 0")
    a = x.select("context", F.col("subject").alias("feature"), F.col("feature").alias("i"), F.col("value").alias("u"))
    b = x.select("context", F.col("subject").alias("feature"), F.col("feature").alias("j"), F.col("value").alias("v"))
    return a.join(b, ["context", "feature"]).filter("i < j").select("context", "feature", "i", "j", F.round(F.col("u") / F.col("v"), 6).alias("ratio"))


# aggregates
@query("agg1_means", f"WITH {E1} SELECT feature, context, round(avg(value), 6) AS value FROM e GROUP BY 1, 2")
def _(spark, d):
    return X.means(expression(spark, d)).select("feature", "context", r6("value"))


@query("agg2_moments", f"WITH {E1}, {MOM} SELECT feature, context, n, round(mean, 6) AS mean, round(std, 6) AS std, round(var, 6) AS var, round(lo, 6) AS lo, round(hi, 6) AS hi FROM m")
def _(spark, d):
    return X.moments(expression(spark, d)).select("feature", "context", "n", *map(r6, ("mean", "std", "var", "lo", "hi")))


@query("agg7_cluster_medians", f"WITH {E1} SELECT subject % 10 AS id, subject AS feature, context, round(median(value), 6) AS value FROM e WHERE feature IN ('click','error','purchase','signup','view') GROUP BY 1, 2, 3")
def _(spark, d):
    return TC.medians(event_cube(spark, d), _clusters(spark, d)).select("id", "feature", "context", r6("value"))


@query("agg8_common_subjects", f"WITH {E1} SELECT subject FROM e WHERE context IN (0,1,2,3,4,5,6) GROUP BY 1 HAVING count(DISTINCT context) = 7")
def _(spark, d):
    return X.in_all_contexts(expression(spark, d), DAYS)


@query("jn4_cube", f"WITH {E1}, k AS (SELECT subject FROM e GROUP BY 1 HAVING count(DISTINCT context) = 7), fs AS (SELECT DISTINCT feature FROM e SEMI JOIN k USING (subject)), ct AS (SELECT CAST(unnest(range(7)) AS INTEGER) AS context) SELECT context, subject, feature, round(coalesce(value, 0), 6) AS value FROM k CROSS JOIN fs CROSS JOIN ct LEFT JOIN e USING (context, subject, feature)")
def _(spark, d):
    e = expression(spark, d)
    return X.cube(e, DAYS, X.in_all_contexts(e, DAYS)).select("context", "subject", "feature", r6("value"))


@query("agg9_bicluster_pattern", f"WITH {E2}, {VC}, r AS (SELECT CAST(label AS BIGINT) AS id, vec_id AS \"row\" FROM embeddings WHERE label IS NOT NULL) SELECT id, col, round(avg(value), 6) AS value FROM v JOIN r USING (\"row\") WHERE col % 10 = id % 10 GROUP BY 1, 2")
def _(spark, d):
    return S.patterns(vector_cells(spark, d), *label_clusters(spark, d)).select("id", "col", r6("value"))


@query("agg16_histogram", f"WITH {E1}, {MOM}, h AS (SELECT e.feature, e.context, least(CAST(floor((value - lo) / ((hi - lo) / 50)) AS INTEGER), 49) AS bin, n * ((hi - lo) / 50) AS w FROM e JOIN m USING (feature, context) WHERE hi > lo) SELECT feature, context, bin, round(count(*) / max(w), 6) AS density FROM h GROUP BY 1, 2, 3")
def _(spark, d):
    e = expression(spark, d)
    return X.histogram(e, X.moments(e)).select("feature", "context", "bin", r6("density"))


@query("agg17_density_curve", f"WITH {E1}, {MOM}, g AS (SELECT e.feature, e.context, p.point, (lo + (hi - lo) * p.point / 24 - value) / (sqrt(var) * pow(n, -0.2)) AS z, n * sqrt(var) * pow(n, -0.2) * sqrt(2 * pi()) AS w FROM e JOIN m USING (feature, context) CROSS JOIN (SELECT CAST(unnest(range(25)) AS INTEGER) AS point) p WHERE hi > lo AND n > 1) SELECT feature, context, point, round(sum(exp(-z * z / 2)) / max(w), 6) AS density FROM g GROUP BY 1, 2, 3")
def _(spark, d):
    e = expression(spark, d)
    return X.density_curve(e, X.moments(e)).select("feature", "context", "point", r6("density"))


@query("agg18_matrix_statistics", f"WITH {E2}, {VC} SELECT count(DISTINCT \"row\") AS n_rows, count(DISTINCT col) AS n_cols, count(*) FILTER (value <> 0) AS n_non_zero FROM v")
def _(spark, d):
    return X.matrix_statistics(vector_cells(spark, d))


@query("srt1_top_features", f"WITH {E1} SELECT feature, round(avg(value), 6) AS mean FROM e WHERE context = 2 GROUP BY 1")
def _(spark, d):
    return X.top_features(expression(spark, d), 2).select("feature", r6("mean"))


@query("mth2_near_zero", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount) <= 1e-10 THEN 1e-10 ELSE l_discount END AS v FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.near_zero(F.col("l_discount")).alias("v"))


@query("set1_union", "SELECT p_brand AS f FROM part WHERE p_size < 10 UNION SELECT p_brand FROM part WHERE p_size > 45")
def _(spark, d):
    p = table(spark, d, "part")
    return p.filter("p_size < 10").select(F.col("p_brand").alias("f")).unionByName(p.filter("p_size > 45").select(F.col("p_brand").alias("f"))).distinct()


@query("set2_intersect", f"WITH {E1} SELECT subject FROM e WHERE context = 0 INTERSECT SELECT subject FROM e WHERE context = 6")
def _(spark, d):
    e = expression(spark, d)
    return e.filter("context = 0").select("subject").intersect(e.filter("context = 6").select("subject"))


@query("set3_difference", f"WITH {E1} SELECT subject FROM e WHERE context = 0 AND feature = 'purchase' EXCEPT SELECT subject FROM e WHERE context = 6 AND feature = 'purchase'")
def _(spark, d):
    e = expression(spark, d).filter("feature = 'purchase'")
    return e.filter("context = 0").select("subject").distinct().join(e.filter("context = 6").select("subject").distinct(), "subject", "left_anti")


# tests
@query("st1_shapiro", f"WITH {E1}, {Q.shapiro()} SELECT feature, context, n, round(w, 6) AS w, round(p, 6) AS p FROM sw")
def _(spark, d):
    return ST.shapiro(expression(spark, d)).select("feature", "context", "n", r6("w"), r6("p"))


_T = f"""{E1}, {MOM}, t AS (SELECT p.feature, p.context AS a, q.context AS b, p.n AS n_a, q.n AS n_b, p.n + q.n - 2 AS df, (p.mean - q.mean) / sqrt(((p.n - 1) * p.var + (q.n - 1) * q.var) / (p.n + q.n - 2) * (1 / p.n + 1 / q.n)) AS t FROM m p JOIN m q ON p.feature = q.feature AND p.context IN (0,1,2) AND q.context IN (4,5,6))"""


@query("st2_t_statistics", f"WITH {_T} SELECT feature, a, b, df, round(t, 6) AS t FROM t")
def _(spark, d):
    return ST.t_statistics(_pairs(spark, d)[2]).select("feature", "a", "b", "df", r6("t"))


@query("st2_t_test", f"WITH {_T} SELECT feature, a, b, df, round(t, 6) AS t, round({Q.t_two_sided('t', 'df')}, 6) AS p FROM t")
def _(spark, d):
    return ST.t_test(_pairs(spark, d)[2]).select("feature", "a", "b", "df", r6("t"), r6("p"))


@query("st3_signed_ranks", f"""WITH {_PAIRED}, dd AS (SELECT feature, a, b, x - y AS d, abs(x - y) <= 1e-8 + 1e-5 * abs(y) AS c FROM pr),
rr AS (SELECT feature, a, b, d, rank() OVER w + (count(*) OVER (PARTITION BY feature, a, b, abs(d)) - 1) / 2 AS r FROM dd WHERE d <> 0 WINDOW w AS (PARTITION BY feature, a, b ORDER BY abs(d)))
SELECT feature, a, b, n, w_plus, w_minus, zeros FROM (SELECT feature, a, b, count(*) FILTER (d = 0) AS zeros FROM dd GROUP BY 1, 2, 3) JOIN (SELECT feature, a, b, count(*) AS n, CAST(coalesce(sum(r) FILTER (d > 0), 0) AS DOUBLE) AS w_plus, CAST(coalesce(sum(r) FILTER (d < 0), 0) AS DOUBLE) AS w_minus FROM rr GROUP BY 1, 2, 3) USING (feature, a, b)""")
def _(spark, d):
    e, _, p = _pairs(spark, d)
    return ST.signed_ranks(ST.paired_rows(e, p)).select("feature", "a", "b", "n", F.col("w_plus").cast("double").alias("w_plus"), F.col("w_minus").cast("double").alias("w_minus"), "zeros")


@query("st3_wilcoxon", f"WITH RECURSIVE {_PAIRED}, {Q.ranks()} SELECT feature, a, b, n, round(p, 6) AS p FROM wx")
def _(spark, d):
    e, _, p = _pairs(spark, d)
    return ST.wilcoxon(ST.paired_rows(e, p)).select("feature", "a", "b", "n", r6("p"))


@query("st4_anova_f", f"WITH {E1}, {MOM}, g AS (SELECT feature, count(*) AS k, sum(n) AS n, sum(n * mean) AS sx, sum(n * mean * mean) AS sxx, sum((n - 1) * var) AS w FROM m GROUP BY 1) SELECT feature, round(((sxx - sx * sx / n) / (k - 1)) / (w / (n - k)), 6) AS f FROM g")
def _(spark, d):
    return ST.anova(X.moments(expression(spark, d))).select("feature", r6("f"))


@query("st4_anova", f"WITH {E1}, {MOM}, g AS (SELECT feature, CAST(count(*) AS DOUBLE) AS k, CAST(sum(n) AS DOUBLE) AS n, sum(n * mean) AS sx, sum(n * mean * mean) AS sxx, sum((n - 1) * var) AS w FROM m GROUP BY 1), h AS (SELECT feature, k - 1 AS d1, n - k AS d2, ((sxx - sx * sx / n) / (k - 1)) / (w / (n - k)) AS f FROM g) SELECT feature, round(f, 6) AS f, round({Q.incomplete_beta('(d2 / 2)', '(d1 / 2)', '(d2 / (d2 + d1 * f))')}, 6) AS p FROM h")
def _(spark, d):
    return ST.anova(X.moments(expression(spark, d))).select("feature", r6("f"), r6("p"))


_IN_OUT, _ALL = "p.context IN (0,1,2) AND q.context IN (4,5,6)", "p.context < q.context"


@query("st5_gated_study", f"WITH RECURSIVE {E1}, {MOM}, {Q.gated(_IN_OUT)} SELECT feature, a, b, branch, round(p, 6) AS p FROM st")
def _(spark, d):
    e, m, p = _pairs(spark, d)
    return ST.gated_study(e, m, p).select("feature", "a", "b", "branch", r6("p"))


@query("st6_p_matrix", f"WITH RECURSIVE {E1}, {MOM}, {Q.gated(_ALL)}, h AS (SELECT feature, a, b, CASE WHEN n_a >= 3 AND n_b >= 3 THEN round(p, 10) ELSE 1.0 END AS p FROM st) SELECT feature, a, b, round(p, 6) AS p FROM h UNION ALL SELECT feature, b, a, round(p, 6) FROM h UNION ALL SELECT feature, context, context, 1.0 FROM m")
def _(spark, d):
    e = expression(spark, d)
    m = X.moments(e)
    return ST.p_matrix(ST.gated_study(e, m, ST.pairs_of(m)), m).select("feature", "a", "b", r6("p"))


_FIT = "fit AS (SELECT feature FROM m WHERE context IN (0,1,2,4,5,6) GROUP BY 1 HAVING max(CASE WHEN context IN (0,1,2) THEN non_zero ELSE 0 END) = 1 AND max(CASE WHEN context IN (4,5,6) THEN non_zero ELSE 0 END) = 1 AND min(n) > 3 AND count(*) = 6)"


@query("st7_differential_table", f"""WITH RECURSIVE {E1}, {MOM}, {Q.gated(_IN_OUT)}, {_FIT}, wo AS (SELECT feature, a, max(CASE WHEN n_a >= 3 AND n_b >= 3 THEN round(p, 10) ELSE 1.0 END) AS p FROM st GROUP BY 1, 2),
sc AS (SELECT feature, min(p) AS score FROM wo GROUP BY 1), oc AS (SELECT feature, CAST(sum(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS occurrences FROM st GROUP BY 1)
SELECT feature, occurrences, round(score, 6) AS score, CASE WHEN score < 0.05 THEN 'different' ELSE 'not different' END AS verdict, CASE WHEN score < 0.001 THEN '<0.001' WHEN score < 0.01 THEN '<0.01' WHEN score < 0.05 THEN '<0.05' WHEN score < 0.10 THEN '<0.10' ELSE '>=0.10' END AS band FROM oc JOIN sc USING (feature) SEMI JOIN fit USING (feature)""")
def _(spark, d):
    return ST.differential_table(expression(spark, d), INPUTS, OUTPUTS).withColumn("score", F.round("score", 6))


def _shares(spark, d):
    """Pairs with the p of the t test."""
    return ST.t_test(_pairs(spark, d)[2])


_P = _T + f", q AS (SELECT feature, a, b, n_a, n_b, {Q.t_two_sided('t', 'df')} AS p FROM t)"


@query("agg3_occurrences", f"WITH {_P} SELECT feature, CAST(sum(CASE WHEN p < 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS occurrences FROM q GROUP BY 1")
def _(spark, d):
    return ST.occurrences(_shares(spark, d))


@query("agg4_occurrence_matrix", f"WITH {_P} SELECT a, " + ", ".join(f"CAST(sum(CASE WHEN b = {b} THEN CASE WHEN p < 0.05 THEN 1 ELSE 0 END END) AS BIGINT) AS b{b}" for b in OUTPUTS) + " FROM q GROUP BY 1")
def _(spark, d):
    out = ST.occurrence_matrix(_shares(spark, d), OUTPUTS)
    return out.select("a", *(F.col(str(b)).alias(f"b{b}") for b in OUTPUTS))


@query("agg5_maxmin_score", f"WITH {_P}, w AS (SELECT feature, a, max(p) AS p FROM q GROUP BY 1, 2), s AS (SELECT feature, min(p) AS score FROM w GROUP BY 1) SELECT feature, round(score, 6) AS score, CASE WHEN score < 0.05 THEN 'different' ELSE 'not different' END AS verdict FROM s")
def _(spark, d):
    return ST.max_min_score(_shares(spark, d)).select("feature", r6("score"), "verdict")


@query("agg6_p_summary", f"WITH {_P} SELECT feature, count(*) AS n, " + ", ".join(f"round(quantile_cont(p, {q / 100}), 6) AS q{q}" for q in (0, 25, 50, 75, 100)) + " FROM q GROUP BY 1 HAVING count(*) >= 3")
def _(spark, d):
    return ST.p_summary(_shares(spark, d)).select("feature", "n", *map(r6, ("q0", "q25", "q50", "q75", "q100")))


@query("st8_score_band", f"WITH {_P} SELECT feature, a, b, CASE WHEN p < 0.001 THEN '<0.001' WHEN p < 0.01 THEN '<0.01' WHEN p < 0.05 THEN '<0.05' WHEN p < 0.10 THEN '<0.10' ELSE '>=0.10' END AS band FROM q")
def _(spark, d):
    return _shares(spark, d).select("feature", "a", "b", ST.score_band(F.col("p")).alias("band"))


# text
_DOCS = "d AS (SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"
_TF = _DOCS + ", tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\w\\w+')) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf FROM tk GROUP BY 1, 2), df AS (SELECT term, ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1), w AS (SELECT doc_id, term, tf * idf AS w FROM tf JOIN df USING (term))"
KEYS = ("the", "and", "are", "for", "with")


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").filter("doc_id is not null and text is not null")


@query("txt1_tf_idf", f"WITH {_TF}, nm AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1) SELECT doc_id, term, round(w / norm, 6) AS weight FROM w JOIN nm USING (doc_id)")
def _(spark, d):
    return T.tf_idf(_docs(spark, d), "doc_id", "text").select("doc_id", "term", r6("weight"))


@query("txt2_keyword_scores", f"WITH {_TF} SELECT doc_id, round(sum(CASE WHEN term IN ('the','and','are','for','with') THEN w ELSE 0 END) / sqrt(sum(w * w)), 6) AS score FROM w GROUP BY 1")
def _(spark, d):
    return T.keyword_scores(_docs(spark, d), "doc_id", "text", KEYS).select("doc_id", r6("score"))


@query("txt3_selected_names", f"WITH {_TF}, sc AS (SELECT doc_id, sum(CASE WHEN term IN ('the','and','are','for','with') THEN w ELSE 0 END) / sqrt(sum(w * w)) AS score FROM w GROUP BY 1) SELECT doc_id, unnest([upper(source), upper(lang)]) AS feature, round(score, 6) AS score FROM sc JOIN documents USING (doc_id) WHERE score >= 0.3")
def _(spark, d):
    docs = _docs(spark, d)
    named = docs.select("doc_id", F.concat_ws(" ", "source", "lang").alias("names"))
    return T.selected_names(T.keyword_scores(docs, "doc_id", "text", KEYS), named, "doc_id", "names").select("doc_id", "feature", r6("score"))


@query("str1_content_words")
def _(spark, d):
    return T.content_words(_docs(spark, d), "doc_id", "text").select("doc_id", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct"))


@query("str2_names", "SELECT p_partkey, unnest(string_split(upper(p_name), ' ')) AS feature FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", T.names(F.col("p_name")).alias("feature"))


# discretising
_EU = f"{E1}, {UD}"


@query("win3_z_by_column", f"WITH {_EU} SELECT \"row\", col, round((value - avg(value) OVER (PARTITION BY col)) / stddev_samp(value) OVER (PARTITION BY col), 6) AS z FROM u")
def _(spark, d):
    return D.standardized(user_day(spark, d), "col").select("row", "col", r6("z"))


@query("win3_z_by_row", f"WITH {_EU} SELECT \"row\", col, round((value - avg(value) OVER (PARTITION BY \"row\")) / stddev_samp(value) OVER (PARTITION BY \"row\"), 6) AS z FROM u")
def _(spark, d):
    return D.standardized(user_day(spark, d), "row").select("row", "col", r6("z"))


@query("win3_z_overall", f"WITH {_EU} SELECT \"row\", col, round((value - (SELECT avg(value) FROM u)) / (SELECT stddev_pop(value) FROM u), 6) AS z FROM u")
def _(spark, d):
    return D.standardized(user_day(spark, d), "all").select("row", "col", r6("z"))


@query("win4_min_max", f"WITH {_EU} SELECT \"row\", col, round((value - min(value) OVER (PARTITION BY col)) / (max(value) OVER (PARTITION BY col) - min(value) OVER (PARTITION BY col)), 6) AS z FROM u")
def _(spark, d):
    return D.standardized(user_day(spark, d), "width").select("row", "col", r6("z"))


def _bin_sql(bins: int, by: str) -> str:
    cuts, below, above = D.cut_points(bins, by)
    b = " + ".join(f"CAST(z > {c!r} AS INTEGER)" for c in cuts)
    up = " ".join(f"WHEN z <= {c!r} AND z > {lo!r} THEN {i + 1}" for i, (c, lo) in reversed(list(enumerate(zip(cuts, below, strict=True)))))
    down = " ".join(f"WHEN z > {c!r} AND z <= {hi!r} THEN {i}" for i, (c, hi) in reversed(list(enumerate(zip(cuts, above, strict=True)))))
    return f"CASE WHEN z IS NOT NULL THEN {b} END AS bin, CASE {up} {down} END AS noise_bin"


_Z = "z AS (SELECT \"row\", col, value, (value - avg(value) OVER (PARTITION BY col)) / stddev_samp(value) OVER (PARTITION BY col) AS z FROM u)"
_ZW = "z AS (SELECT \"row\", col, value, (value - min(value) OVER (PARTITION BY col)) / (max(value) OVER (PARTITION BY col) - min(value) OVER (PARTITION BY col)) AS z FROM u)"
_BINS = f"{_EU}, {_Z}, i AS (SELECT \"row\", col, value, {_bin_sql(5, 'col')} FROM z)"


@query("pm1_pm2_discretize", f"WITH {_BINS} SELECT \"row\", col, bin, noise_bin FROM i")
def _(spark, d):
    return D.discretized(user_day(spark, d)).select("row", "col", "bin", "noise_bin")


@query("pm1_width_bins", f"WITH {_EU}, {_ZW} SELECT \"row\", col, {_bin_sql(5, 'width')} FROM z")
def _(spark, d):
    return D.discretized(user_day(spark, d), 5, "width").select("row", "col", "bin", "noise_bin")


@query("pm3_quantile_bins", f"WITH {_EU}, q AS (SELECT col, quantile_cont(value, 0.2) AS a, quantile_cont(value, 0.4) AS b, quantile_cont(value, 0.6) AS c, quantile_cont(value, 0.8) AS d FROM u GROUP BY 1) SELECT \"row\", col, CAST(value > a AS INTEGER) + CAST(value > b AS INTEGER) + CAST(value > c AS INTEGER) + CAST(value > d AS INTEGER) AS bin FROM u JOIN q USING (col)")
def _(spark, d):
    return D.quantile_bins(user_day(spark, d)).select("row", "col", "bin")


@query("pm4_codes", "SELECT c_mktsegment AS category, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)")
def _(spark, d):
    return D.codes(table(spark, d, "customer"), "c_mktsegment")


@query("pm4_symbol_columns", f"WITH {_EU} SELECT col, count(DISTINCT value) AS n_distinct, count(DISTINCT value) > 10 AS real FROM u GROUP BY 1")
def _(spark, d):
    return D.symbol_columns(user_day(spark, d))


@query("pm5_sparse_bins", f"WITH {_EU}, z AS (SELECT \"row\", col, (value - (SELECT avg(value) FROM u)) / (SELECT stddev_pop(value) FROM u) AS z FROM u) SELECT \"row\", col, CAST(bin AS DOUBLE) AS item FROM (SELECT \"row\", col, {_bin_sql(5, 'all')} FROM z)")
def _(spark, d):
    return D.sparse_bins(user_day(spark, d)).select("row", "col", F.col("item").cast("double").alias("item"))


@query("pm6_transactions", f"WITH {_BINS} SELECT \"row\", list_sort(list(DISTINCT it)) AS items FROM (SELECT \"row\", col * 5 + bin AS it FROM i WHERE bin IS NOT NULL UNION ALL SELECT \"row\", col * 5 + noise_bin FROM i WHERE noise_bin IS NOT NULL) GROUP BY 1")
def _(spark, d):
    return D.transactions(D.discretized(user_day(spark, d)), 5)


@query("pm7_sequences", f"WITH {_BINS}, g AS (SELECT \"row\", bin, list(col ORDER BY col) AS cols FROM i WHERE bin IS NOT NULL GROUP BY 1, 2) SELECT \"row\", list(cols ORDER BY bin) AS sequence FROM g GROUP BY 1")
def _(spark, d):
    return D.sequences(D.discretized(user_day(spark, d)))


@query("flt8_drop_bins", f"WITH {_BINS} SELECT \"row\", col, CASE WHEN bin NOT IN (0, 4) THEN bin END AS bin FROM i")
def _(spark, d):
    return D.without_bins(D.discretized(user_day(spark, d)), [0, 4]).select("row", "col", "bin")


@query("agg11_symbol_frequencies", f"WITH {_BINS} SELECT col, bin, round(count(*) / (SELECT count(DISTINCT \"row\") FROM i), 6) AS frequency FROM i WHERE bin IS NOT NULL GROUP BY 1, 2")
def _(spark, d):
    return S.symbol_frequencies(D.discretized(user_day(spark, d))).select("col", "bin", r6("frequency"))


@query("agg14_drop_dominant", "WITH q AS (SELECT doc_id AS \"row\", unnest([0, 1]) AS col, unnest([quality, toxic]) AS value FROM labels), k AS (SELECT col, value, count(*) AS k FROM q GROUP BY 1, 2), dom AS (SELECT col, value FROM k JOIN (SELECT col, sum(k) AS n FROM k GROUP BY 1) USING (col) WHERE k >= 0.8 * n) SELECT \"row\", col, value FROM q ANTI JOIN dom USING (col, value)")
def _(spark, d):
    cells = table(spark, d, "labels").select(F.col("doc_id").alias("row"), F.posexplode(F.array("quality", "toxic")).alias("col", "value"))
    return D.without_dominant(cells).select("row", "col", "value")


# clusters
@query("agg10_symbol_pattern", f"WITH {_BINS}, r AS (SELECT DISTINCT \"row\", \"row\" % 3 AS id FROM i), k AS (SELECT id, col, bin, count(*) AS n FROM i JOIN r USING (\"row\") WHERE bin IS NOT NULL GROUP BY 1, 2, 3) SELECT id, col, bin FROM k QUALIFY row_number() OVER (PARTITION BY id, col ORDER BY n DESC, bin) = 1")
def _(spark, d):
    items, rows, cols = _thirds(spark, d)
    return M.symbol_pattern(items.filter("bin is not null"), rows, cols).select("id", "col", "bin")


def _thirds(spark, d):
    """Three row groups over all columns."""
    items = D.discretized(user_day(spark, d))
    rows = items.select("row").distinct().select((F.col("row") % 3).alias("id"), "row")
    cols = items.select("col").distinct().withColumn("id", F.explode(F.array(*(F.lit(i).cast("long") for i in range(3))))).select("id", "col")
    return items, rows, cols


@query("agg12_class_lift", "WITH t AS (SELECT doc_id AS \"row\", quality AS class FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL), o AS (SELECT source AS id, class, count(*) AS k FROM documents JOIN t ON doc_id = \"row\" WHERE source IS NOT NULL GROUP BY 1, 2), l AS (SELECT id, class, k / (sum(k) OVER (PARTITION BY id)) / ((SELECT count(*) FROM t x WHERE x.class = o.class) / (SELECT count(*) FROM t)) AS lift FROM o) SELECT id, class, round(lift, 6) AS lift, max(lift) OVER (PARTITION BY id) >= 1.05 AS kept FROM l")
def _(spark, d):
    targets = table(spark, d, "labels").filter("doc_id is not null and quality is not null").select(F.col("doc_id").alias("row"), F.col("quality").alias("class"))
    rows = table(spark, d, "documents").filter("source is not null").select(F.col("source").alias("id"), F.col("doc_id").alias("row"))
    return M.class_lift(rows, targets).select("id", "class", r6("lift"), "kept")


@query("agg13_mixed_pattern", "SELECT CAST(c_nationkey AS BIGINT) AS id, min(seg) AS category, round(any_value(med), 6) AS middle FROM (SELECT c_nationkey, c_mktsegment AS seg, count(*) AS n, max(count(*)) OVER (PARTITION BY c_nationkey) AS top FROM customer GROUP BY 1, 2) k JOIN (SELECT c_nationkey AS nk, median(c_acctbal) AS med FROM customer GROUP BY 1) ON nk = c_nationkey WHERE n = top GROUP BY 1")
def _(spark, d):
    c = table(spark, d, "customer")
    cells = c.select(F.col("c_custkey").alias("row"), F.lit(0).alias("col"), F.col("c_mktsegment").alias("text"), F.col("c_acctbal").alias("value"))
    rows = c.select(F.col("c_nationkey").cast("long").alias("id"), F.col("c_custkey").alias("row"))
    cols = rows.select("id").distinct().withColumn("col", F.lit(0))
    return M.mixed_pattern(cells, rows, cols).select("id", "category", r6("middle"))


@query("jn8_overlaps", f"WITH {PC} SELECT a, b, common_cols, common_rows FROM ov")
def _(spark, d):
    return M.overlaps(price_clusters(spark, d)).select("a", "b", "common_cols", "common_rows")


@query("pm23_overlap_ratio", f"WITH {PC} SELECT a, b, round(common_rows * common_cols / least(rows_a * cols_a, rows_b * cols_b), 6) AS ratio FROM ov")
def _(spark, d):
    return M.overlap_ratio(price_clusters(spark, d)).select("a", "b", r6("ratio"))


@query("pm13_filter", f"WITH {PC} SELECT id FROM ids WHERE id NOT IN (SELECT b FROM ov WHERE common_cols >= 0.4 * greatest(cols_a, cols_b) AND common_rows * common_cols >= 0.4 * least(rows_a * cols_a, rows_b * cols_b))")
def _(spark, d):
    return M.filter_overlapping(price_clusters(spark, d), 0.4).select("id")


@query("pm12_merge", f"WITH {PC}, b0 AS (SELECT id, (SELECT list_sort(list(\"row\")) FROM cr WHERE cr.id = ids.id) AS \"rows\", (SELECT list_sort(list(col)) FROM cc WHERE cc.id = ids.id) AS cols FROM ids), {Q.merge_round(0, 0.5)}, {Q.merge_round(1, 0.5)} SELECT id, \"rows\", cols FROM b2")
def _(spark, d):
    return M.merge(price_clusters(spark, d), 0.5)


@query("srt4_order", f"WITH {PC} SELECT id, nr * nc AS area FROM sz")
def _(spark, d):
    return M.ordered(price_clusters(spark, d)).select("id", (F.size("rows") * F.size("cols")).cast("long").alias("area"))


@query("flt10_above", f"WITH {PC} SELECT id FROM sz WHERE nr >= 12")
def _(spark, d):
    return M.above(price_clusters(spark, d).withColumn("n_rows", F.size("rows")), "n_rows", 12).select("id")


def _weighed(spark, d) -> DataFrame:
    """A bicluster for each label and for each part size, the latter with no significance; those of odd labels have no columns."""
    rows, cols = label_clusters(spark, d)
    p = S.bicluster_significance(vector_cells(spark, d), rows, cols).select("id", "significance")
    b = rows.groupBy("id").agg(F.collect_list("row").alias("rows")).join(cols.filter("id % 4 <> 1").groupBy("id").agg(F.collect_list("col").alias("cols")), "id", "left")
    b = b.join(p, "id", "left").select("id", "rows", F.coalesce("cols", F.array().cast("array<int>")).alias("cols"), "significance")
    sizes = price_clusters(spark, d).select((F.col("id") + 1000).alias("id"), F.col("rows").cast("array<long>").alias("rows"), "cols", F.lit(None).cast("double").alias("significance"))
    return b.unionByName(sizes)


_SHARE = f"{E2}, {VC}, r AS (SELECT CAST(label AS BIGINT) AS id, vec_id AS \"row\" FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL), pt AS (SELECT id, col, avg(value) AS value FROM v JOIN r USING (\"row\") WHERE col % 10 = id % 10 GROUP BY 1, 2), sp AS (SELECT col, min(value) AS lo, max(value) AS hi, count(*) AS n FROM v GROUP BY 1), sh AS (SELECT id, pt.col, count(*) FILTER (v.value > greatest(pt.value - (hi - lo) * 0.3 / 2, lo) AND v.value <= least(pt.value + (hi - lo) * 0.3 / 2, hi)) / max(n) AS share FROM pt JOIN sp USING (col) JOIN v ON v.col = pt.col GROUP BY 1, 2)"
_SIG = _SHARE + f""", pv AS (SELECT id, CASE WHEN min(share) <= 0 THEN 0.0 ELSE exp(sum(ln(CASE WHEN share > 0 THEN share END))) END AS p FROM sh GROUP BY 1), sg AS (SELECT id, n, p, {Q.binomial_at_least('n', 'total', 'p')} AS s0 FROM pv JOIN (SELECT id, count(*) AS n FROM r GROUP BY 1) USING (id) CROSS JOIN (SELECT count(DISTINCT "row") AS total FROM v)), sn AS (SELECT id, n, p, CASE WHEN abs(s0 - 1) <= 1e-10 THEN 1.0 ELSE s0 END AS significance FROM sg)"""


@query("flt9_srt2_numbered", f"WITH {_SIG} SELECT 'k-cluster' || CAST(row_number() OVER (ORDER BY id) AS VARCHAR) AS name, round(significance, 9) AS significance FROM sn WHERE id % 4 <> 1")
def _(spark, d):
    return M.cluster_table(_weighed(spark, d), "k-").select("name", F.round("significance", 9).alias("significance"))


@query("srt5_mask", f"WITH {PC}, kv AS (SELECT \"row\", col, count(*) AS k FROM cr JOIN cc USING (id) GROUP BY 1, 2), rk AS (SELECT \"row\", col, row_number() OVER (ORDER BY k DESC, \"row\", col) AS i FROM kv), ce AS (SELECT unnest(range(1, 26)) AS \"row\"), cl AS (SELECT unnest(range(1, 13)) AS col) SELECT CAST(\"row\" AS INTEGER) AS \"row\", CAST(col AS INTEGER) AS col FROM ce CROSS JOIN cl ANTI JOIN (SELECT * FROM rk WHERE i <= (SELECT CAST(floor(0.6 * count(*)) AS BIGINT) + 1 FROM kv)) USING (\"row\", col)")
def _(spark, d):
    cells = spark.range(1, 26).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(1), F.lit(12))).alias("col"))
    return M.masked(cells, price_clusters(spark, d))


@query("st9_share", f"WITH {_SHARE} SELECT id, col, round(share, 6) AS share FROM sh")
def _(spark, d):
    cells = vector_cells(spark, d)
    return S.column_shares(cells, S.patterns(cells, *label_clusters(spark, d))).select("id", "col", r6("share"))


@query("st9_bicluster_significance", f"WITH {_SIG} SELECT id, n, round(log10(p), 6) AS log_p, round(significance, 9) AS significance FROM sn")
def _(spark, d):
    return S.bicluster_significance(vector_cells(spark, d), *label_clusters(spark, d)).select("id", "n", F.round(F.log10("p"), 6).alias("log_p"), F.round("significance", 9).alias("significance"))


@query("st11_uniform_null", f"WITH {E2} SELECT CAST(label AS BIGINT) AS id, count(*) AS n, round(pow(0.3, (SELECT count(DISTINCT feature) FROM x WHERE feature % 10 = label % 10)), 9) AS p FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL GROUP BY label")
def _(spark, d):
    return S.bicluster_significance(vector_cells(spark, d), *label_clusters(spark, d), uniform=True).select("id", "n", F.round("p", 9).alias("p"))


def _symbolic_sql() -> str:
    """Every kind of null model: shifts upward, or multiples, of each group's most frequent symbols."""
    moved = """mv AS (SELECT id, 'constant' AS kind, 0 AS mv FROM tp UNION ALL SELECT id, 'additive', unnest(range(0, greatest(0, 4 - top) + 1)) FROM tp UNION ALL SELECT id, 'multiplicative', unnest(CASE WHEN top > 0 THEN range(1, greatest(1, CAST(floor(5 / top) AS BIGINT) - 1) + 1) ELSE [1] END) FROM tp),
fq AS (SELECT col, bin, count(*) / (SELECT count(DISTINCT "row") FROM i) AS f FROM i WHERE bin IS NOT NULL GROUP BY 1, 2),
ch AS (SELECT id, kind, mv, exp(sum(ln(coalesce(f, 0.01)))) AS p FROM (SELECT id, kind, mv, pt.col, CASE WHEN kind = 'multiplicative' THEN bin * mv ELSE bin + mv END AS nb FROM pt JOIN mv USING (id)) z LEFT JOIN fq ON fq.col = z.col AND fq.bin = nb GROUP BY 1, 2, 3),
pk AS (SELECT id, kind, least(1.0, sum(p)) AS p FROM ch GROUP BY 1, 2 UNION ALL SELECT id, 'order', exp(-lgamma(count(*) + 1)) FROM pt GROUP BY 1)"""
    return f"""WITH {_BINS}, r AS (SELECT DISTINCT "row", "row" % 3 AS id FROM i), k AS (SELECT id, col, bin, count(*) AS n FROM i JOIN r USING ("row") WHERE bin IS NOT NULL GROUP BY 1, 2, 3),
pt AS (SELECT id, col, bin FROM k QUALIFY row_number() OVER (PARTITION BY id, col ORDER BY n DESC, bin) = 1), tp AS (SELECT id, max(bin) AS top FROM pt GROUP BY 1), {moved}
SELECT pk.id, kind, n, round(log10(p), 6) AS log_p, round({Q.binomial_at_least('(n + 1)', 'total', 'p')}, 9) AS significance FROM pk JOIN (SELECT id, count(*) AS n FROM r GROUP BY 1) g ON g.id = pk.id CROSS JOIN (SELECT count(DISTINCT "row") AS total FROM i)"""


@query("st12_symbolic_significance", _symbolic_sql())
def _(spark, d):
    items, rows, cols = _thirds(spark, d)
    pattern = M.symbol_pattern(items.filter("bin is not null"), rows, cols)
    out = [S.symbolic_significance(items, rows, pattern, kind).withColumn("kind", F.lit(kind)) for kind in ("constant", "order", "additive", "multiplicative")]
    return reduce(DataFrame.unionByName, out).select("id", "kind", "n", F.round(F.log10("p"), 6).alias("log_p"), F.round("significance", 9).alias("significance"))


@query("mth3_alignment", f"WITH {_BINS}, g AS (SELECT \"row\", list_reduce(list_prepend(CAST(1 AS BIGINT), list(DISTINCT CAST(bin AS BIGINT))), lambda x, y: CAST(x * y / gcd(x, y) AS BIGINT)) AS m FROM i WHERE bin > 0 GROUP BY 1) SELECT \"row\", col, 'additive' AS kind, CAST(max(bin) OVER (PARTITION BY \"row\") - bin AS BIGINT) AS factor FROM i UNION ALL SELECT \"row\", col, 'multiplicative', CASE WHEN bin > 0 THEN CAST(m / bin AS BIGINT) END FROM i LEFT JOIN g USING (\"row\") UNION ALL SELECT \"row\", col, 'symmetric', CAST(sign(bin) AS BIGINT) FROM i")
def _(spark, d):
    items = D.discretized(user_day(spark, d))
    return reduce(DataFrame.unionByName, [M.aligned(items, kind).select("row", "col", F.lit(kind).alias("kind"), F.col("factor").cast("long").alias("factor")) for kind in ("additive", "multiplicative", "symmetric")])


_TR = f"{_BINS}, tr AS (SELECT \"row\", list_sort(list(DISTINCT it)) AS items FROM (SELECT \"row\", col * 5 + bin AS it FROM i WHERE bin IS NOT NULL UNION ALL SELECT \"row\", col * 5 + noise_bin FROM i WHERE noise_bin IS NOT NULL) GROUP BY 1), {Q.closed_itemsets('(SELECT ceil(0.12 * count(*)) FROM tr)')}"


@query("pm8_closed_itemsets", f"WITH RECURSIVE {_TR} SELECT items, support, \"rows\" FROM cs")
def _(spark, d):
    return M.closed_itemsets(D.transactions(D.discretized(user_day(spark, d)), 5), 0.12).select("items", "support", "rows")


_ZD = f"WITH RECURSIVE {E1}, u AS (SELECT subject AS \"row\", context AS col, avg(value) AS value FROM e GROUP BY 1, 2), {_Z}, i AS (SELECT \"row\", col, value, {_bin_sql(5, 'col')} FROM z)"


@query("pm9_closed_sequences", f"{_ZD}, {Q.closed_sequences('(SELECT ceil(0.2 * count(DISTINCT &row&)) FROM i WHERE bin IS NOT NULL)'.replace('&', chr(34)))} SELECT sequence, support, \"rows\" FROM cq")
def _(spark, d):
    e = expression(spark, d)
    cells = X.means(e.withColumn("feature", F.col("subject"))).select(F.col("feature").alias("row"), F.col("context").alias("col"), "value")
    return M.closed_sequences(D.sequences(D.discretized(cells)), 0.2).select("sequence", "support", "rows")


_PATTERN = """, xx AS (SELECT items, "rows", unnest(items) AS it FROM cs), cb AS (SELECT items, any_value("rows") AS "rows", CAST(it // 5 AS INTEGER) AS col, CAST(min(it % 5) AS INTEGER) AS bin FROM xx GROUP BY items, 3), bc AS (SELECT any_value("rows") AS "rows", list(col ORDER BY col) AS cols, list(bin ORDER BY col) AS pattern, items FROM cb GROUP BY items)"""


@query("pm10_to_biclusters", f"WITH RECURSIVE {_TR}{_PATTERN}, gd AS (SELECT *, list_reduce([CAST(p AS BIGINT) FOR p IN pattern IF p > 0], lambda x, y: gcd(x, y)) AS g FROM (SELECT * FROM bc WHERE list_max(pattern) > 0) UNION ALL SELECT *, NULL FROM bc WHERE list_max(pattern) = 0) SELECT 'constant' AS kind, \"rows\", cols, pattern FROM gd UNION ALL SELECT 'additive', \"rows\", cols, [p - list_min(pattern) FOR p IN pattern] FROM gd UNION ALL SELECT 'multiplicative', \"rows\", cols, [CAST(p / coalesce(g, 1) AS INTEGER) FOR p IN pattern] FROM gd")
def _(spark, d):
    found = _kept(M.closed_itemsets(D.transactions(D.discretized(user_day(spark, d)), 5), 0.12))
    out = [M.to_biclusters(found, 5, kind).select(F.lit(kind).alias("kind"), "rows", "cols", F.col("pattern").cast("array<int>").alias("pattern")) for kind in ("constant", "additive", "multiplicative")]
    return reduce(DataFrame.unionByName, out)


#: supports 0.95, 0.95 * 0.9, ...; the first that more than five closed sets reach
_LEVELS = """, nn AS (SELECT count(*) AS n FROM tr), lv AS (SELECT 0.95 * pow(0.9, s) AS share FROM (SELECT unnest(range(0, 19)) AS s)), ok AS (SELECT max(share) AS share FROM lv WHERE (SELECT count(*) FROM cs WHERE support >= (SELECT ceil(share * n) FROM nn)) > 5)"""


@query("pm11_support_search", f"WITH RECURSIVE {_TR}{_LEVELS} SELECT items, support, \"rows\" FROM cs WHERE support >= (SELECT ceil(share * n) FROM ok, nn)")
def _(spark, d):
    return M.support_search(D.transactions(D.discretized(user_day(spark, d)), 5), 5, 2).select("items", "support", "rows")


@query("pm14_symbolic_biclusters")
def _(spark, d):
    return M.symbolic_biclusters(user_day(spark, d))


@query("pm14_order_biclusters")
def _(spark, d):
    e = expression(spark, d)
    cells = X.means(e.withColumn("feature", F.col("subject"))).select(F.col("feature").alias("row"), F.col("context").alias("col"), "value")
    return M.symbolic_biclusters(cells, "order", tau_merge=0.8)


@query("pm14_column_biclusters")
def _(spark, d):
    brand = F.regexp_extract("row", "(\\d+)", 1).cast("int")
    cells = brand_priority(spark, d).select(brand.alias("row"), F.substring("col", 1, 1).cast("int").alias("col"), "value")
    return M.symbolic_biclusters(cells, by_columns=True, min_cols=3)


@query("pm15_co_clusters")
def _(spark, d):
    return SP.co_clusters(vector_cells(spark, d), 4)


@query("pm16_checkerboard")
def _(spark, d):
    return SP.checkerboard(vector_cells(spark, d), 4)


@query("pm15_pm16_significance")
def _(spark, d):
    cells = vector_cells(spark, d)
    found = ((kind, SP.blocks(f(cells, 4), cells)) for kind, f in (("co-clusters", SP.co_clusters), ("checkerboard", SP.checkerboard)))
    return reduce(DataFrame.unionByName, [S.bicluster_significance(cells, *members).withColumn("kind", F.lit(kind)) for kind, members in found])


_C = f"{E1}, c AS (SELECT context, CAST(list_position(['click','error','purchase','signup','view'], feature) - 1 AS INTEGER) AS s, subject AS f, value FROM e WHERE feature IN ('click','error','purchase','signup','view'))"


@query("pm17_edges", f"WITH RECURSIVE {_C}, {Q.ratio_edges(0.05, 3)} SELECT context, i, j, features FROM ed")
def _(spark, d):
    return TC.edges(event_cube(spark, d), 0.05, 3)


@query("pm18_rectangles", f"WITH RECURSIVE {_C}, {Q.ratio_edges(0.05, 3)}, {Q.edge_rectangles(2, 3)} SELECT context, subjects, features FROM rc")
def _(spark, d):
    return TC.rectangles(TC.edges(event_cube(spark, d), 0.05, 3), 2, 3)


def _clusters(spark, d):
    """Ratio clusters of pairs of days and event types over a tenth of the users each: those who rank alike there."""
    e = event_cube(spark, d)
    return e.groupBy((F.col("feature") % 10).alias("id")).agg(F.sort_array(F.collect_set("context")).alias("contexts"), F.sort_array(F.collect_set("subject")).alias("subjects"), F.sort_array(F.collect_set("feature")).alias("features"))


@query("pm19_pm22_triclusters", f"WITH RECURSIVE {_C}, {Q.ratio_edges(0.05, 3)}, {Q.edge_rectangles(2, 3)}, {Q.rectangle_cubes(2, 2, 3)} SELECT contexts, subjects, features FROM cb")
def _(spark, d):
    return TC.triclusters(event_cube(spark, d), 0.05, 2, 2, 3).drop("id")


_CUBE = f"""{E1}, c AS (SELECT context, CAST(list_position(['click','error','purchase','signup','view'], feature) - 1 AS INTEGER) AS s, subject AS f, subject % 10 AS id, value FROM e WHERE feature IN ('click','error','purchase','signup','view')),
pt AS (SELECT id, s, f, avg(value) AS value FROM c GROUP BY 1, 2, 3), sp AS (SELECT s, min(value) AS lo, max(value) AS hi, count(*) AS m FROM c GROUP BY 1),
sh AS (SELECT pt.id, pt.s, pt.f, count(*) FILTER (c.value > greatest(pt.value - (hi - lo) * 0.3 / 2, lo) AND c.value <= least(pt.value + (hi - lo) * 0.3 / 2, hi)) / max(m) AS share FROM pt JOIN sp USING (s) JOIN c ON c.s = pt.s GROUP BY 1, 2, 3),
pv AS (SELECT id, CASE WHEN min(share) <= 0 THEN 0.0 ELSE exp(sum(ln(CASE WHEN share > 0 THEN share END))) END AS p FROM sh GROUP BY 1)"""


@query("st10_tricluster_significance", f"WITH {_CUBE} SELECT id, n, round(log10(CASE WHEN p > 0 THEN p END), 5) AS log_p, round({Q.binomial_at_least('n', 'total', 'p')}, 9) AS significance FROM pv JOIN (SELECT id, count(DISTINCT context) AS n FROM c GROUP BY 1) USING (id) CROSS JOIN (SELECT count(DISTINCT context) AS total FROM c)")
def _(spark, d):
    e = event_cube(spark, d)
    part = lambda c: e.select((F.col("feature") % 10).alias("id"), c).distinct()
    out = S.tricluster_significance(e, part("context"), part("subject"), part("feature"))
    return out.select("id", "n", F.round(F.log10(F.when(F.col("p") > 0, F.col("p"))), 5).alias("log_p"), F.round("significance", 9).alias("significance"))


@query("agg15_quality", f"WITH {E1}, c AS (SELECT context, list_position(['click','error','purchase','signup','view'], feature) AS s, subject AS f, subject % 10 AS id, value FROM e WHERE feature IN ('click','error','purchase','signup','view')) SELECT count(DISTINCT id) AS n_clusters, count(*) AS elements, count(DISTINCT (context, s, f)) AS covered, round(avg(abs(value - mc)), 6) AS deviation_context, round(avg(abs(value - ms)), 6) AS deviation_subject, round(avg(abs(value - mf)), 6) AS deviation_feature FROM (SELECT *, avg(value) OVER (PARTITION BY id, s, f) AS mc, avg(value) OVER (PARTITION BY id, context, f) AS ms, avg(value) OVER (PARTITION BY id, context, s) AS mf FROM c)")
def _(spark, d):
    return TC.quality(event_cube(spark, d), _clusters(spark, d)).select("n_clusters", "elements", "covered", *map(r6, ("deviation_context", "deviation_subject", "deviation_feature")))


_BX = """lj AS (SELECT CAST(month(o_orderdate) AS BIGINT) AS id, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS pr, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS brand FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey),
bx AS (SELECT id, contexts, subjects, features FROM """ + " JOIN ".join(f"(SELECT id, list_sort(list(x)) AS {out} FROM (SELECT id, {c} AS x, count(*) AS n, avg(count(*)) OVER (PARTITION BY id) AS m FROM lj GROUP BY 1, 2) WHERE n > m GROUP BY 1)" + ("" if out == "contexts" else " USING (id)") for c, out in (("day", "contexts"), ("pr", "subjects"), ("brand", "features"))) + ")"


@query("pm20_delete_covered", f"WITH RECURSIVE {_BX}, {Q.boxes_in_order(0.8)} SELECT bx.id, contexts, subjects, features FROM bx JOIN kp USING (id)")
def _(spark, d):
    return TC.without_covered(_small_boxes(spark, d), 0.8).select("id", "contexts", "subjects", "features")


@query("pm21_merge_cubes")
def _(spark, d):
    return TC.merge(_small_boxes(spark, d), 0.9)


def _small_boxes(spark, d):
    """One box for each order month: days of the week, priorities and brands above the mean count of that month."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    p = table(spark, d, "part").select("p_partkey", F.regexp_extract("p_brand", "(\\d+)", 1).cast("int").alias("brand"))
    o = table(spark, d, "orders").select("o_orderkey", F.month("o_orderdate").alias("id"), F.weekday("o_orderdate").alias("day"), F.substring("o_orderpriority", 1, 1).cast("int").alias("pr"))
    j = li.join(p, li.l_partkey == p.p_partkey).join(o, li.l_orderkey == o.o_orderkey)

    def above(c: str, out: str) -> DataFrame:
        n = j.groupBy("id", F.col(c).alias("x")).agg(F.count(F.lit(1)).alias("n"))
        mean = n.groupBy("id").agg(F.avg("n").alias("m"))
        return n.join(mean, "id").filter("n > m").groupBy("id").agg(F.sort_array(F.collect_set("x")).alias(out))

    return above("day", "contexts").join(above("pr", "subjects"), "id").join(above("brand", "features"), "id").withColumn("id", F.col("id").cast("long"))




@query("srt3_score_page", f"WITH {_P} SELECT feature, a, b, round(p, 6) AS p FROM q ORDER BY q.p, feature, a, b LIMIT 10 OFFSET 10")
def _(spark, d):
    return X.page(_shares(spark, d), ["p", "feature", "a", "b"], 1).select("feature", "a", "b", r6("p"))


@query("mth1_least_columns", f"WITH {E2}, {VC} SELECT CAST(greatest(2, floor(sqrt(count(DISTINCT col)))) AS INTEGER) AS min_cols FROM v")
def _(spark, d):
    return X.least_columns(X.matrix_statistics(vector_cells(spark, d)))


@query("set4_set_algebra", f"WITH {PC} SELECT a, b, rows_a + rows_b - common_rows AS n_union, common_rows AS n_common, common_rows = rows_a AS inside FROM ov")
def _(spark, d):
    return M.set_algebra(price_clusters(spark, d))
