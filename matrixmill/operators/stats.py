"""Tests between contexts: normality, t, signed rank, ANOVA, the gated study, and the tables built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pvalues as P
from .expression import eligible_features, moments
from .scratch import keep, ranked, running

ALPHA = 0.05


def normal_score(p: Column) -> Column:
    """Inverse normal distribution by a rational approximation, relative error 1.2e-9."""
    # fixed values: Acklam's published coefficients
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)

    def poly(cs: tuple, x: Column) -> Column:
        out = F.lit(cs[0])
        for k in cs[1:]:
            out = out * x + k
        return out

    tail = F.least(p, 1 - p)
    q, r = F.sqrt(-2 * F.log(tail)), (p - 0.5) * (p - 0.5)
    far = poly(c, q) / poly(d, q) * F.when(p < 0.5, 1).otherwise(-1)
    return F.when(tail < 0.02425, far).otherwise((p - 0.5) * poly(a, r) / poly(b, r))


def shapiro(expression: DataFrame) -> DataFrame:
    """(feature, context, n, w, p): ranks dealt over many tasks, then one grouped sum. A group without spread has p = 1; n < 3 has none.

    The approximation is stated for n up to 5000 only.
    """
    keys = ["feature", "context"]
    order = ranked(expression.filter("value is not null").select(*keys, "value", "pos"), keys, ["value", "pos"])
    # the score depends on rank and n alone
    score = normal_score((F.col("i") - 0.375) / (F.col("n") + 0.25))
    rows = order.filter("n >= 3").withColumn("m", score)
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c)))
    n = F.col("n")
    g = rows.groupBy(*keys).agg(
        F.max("n").alias("n"), F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * F.col("value")).alias("mx"), (F.var_pop("value") * F.count(F.lit(1))).alias("ss"),
        F.min("value").alias("x1"), F.max("value").alias("xn"), at("value", 2).alias("x2"), at("value", n - 1).alias("xm"), F.max("m").alias("m_n"), at("m", n - 1).alias("m_m"),
    )
    u, root = 1 / F.sqrt(n), F.sqrt("mm")
    poly = lambda cs: sum((F.lit(c) * F.pow(u, F.lit(k)) for k, c in enumerate(cs)), F.lit(0.0))
    # fixed values of the published approximation
    last = F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(F.col("m_n") / root + poly((0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)))
    next_ = F.col("m_m") / root + poly((0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
    g = g.withColumn("a_n", last).withColumn("a_m", next_)
    pair = F.col("m_n") * (F.col("xn") - F.col("x1"))
    pair2 = F.col("m_m") * (F.col("xm") - F.col("x2"))
    phi5 = (F.col("mm") - 2 * F.col("m_n") ** 2) / (1 - 2 * F.col("a_n") ** 2)
    phi = (F.col("mm") - 2 * F.col("m_n") ** 2 - 2 * F.col("m_m") ** 2) / (1 - 2 * F.col("a_n") ** 2 - 2 * F.col("a_m") ** 2)
    outer = F.col("a_n") * (F.col("xn") - F.col("x1"))
    b = (
        F.when(n == 3, outer)
        .when(n <= 5, (F.col("mx") - pair) / F.sqrt(phi5) + outer)
        .otherwise((F.col("mx") - pair - pair2) / F.sqrt(phi) + outer + F.col("a_m") * (F.col("xm") - F.col("x2")))
    )
    flat = F.col("xn") == F.col("x1")
    w = F.when(flat, 1.0).otherwise(F.least(F.lit(1.0), b * b / F.col("ss")))
    return g.withColumn("w", w).select(*keys, "n", "w", F.when(flat, 1.0).otherwise(P.shapiro_udf(F.col("w"), F.col("n"))).alias("p"))


def pairs_of(m: DataFrame, inputs: list | None = None, outputs: list | None = None) -> DataFrame:
    """Moments of two contexts of a feature side by side: all pairs a < b, or inputs against outputs. Moments only, no raw rows."""
    a = m.select("feature", F.col("context").alias("a"), F.col("n").alias("n_a"), F.col("mean").alias("mean_a"), F.col("var").alias("var_a"))
    b = m.select("feature", F.col("context").alias("b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"), F.col("var").alias("var_b"))
    if inputs is None:
        return a.join(b, "feature").filter("a < b")
    return a.filter(F.col("a").isin(inputs)).join(b.filter(F.col("b").isin(outputs)), "feature")


def t_statistics(pairs: DataFrame) -> DataFrame:
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / df
    return pairs.withColumn("df", df).withColumn("t", (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled * (1 / F.col("n_a") + 1 / F.col("n_b"))))


def t_test(pairs: DataFrame) -> DataFrame:
    return t_statistics(pairs).withColumn("p", P.t_udf(F.col("t"), F.col("df")))


def paired_rows(expression: DataFrame, pairs: DataFrame) -> DataFrame:
    """(feature, a, b, i, x, y): the samples of two contexts paired by their place among the slice's samples, cut to the shorter side."""
    placed = keep(ranked(expression.select("feature", "context", "value", "pos"), ["feature", "context"], ["pos", "value"]))
    x = placed.select("feature", F.col("context").alias("a"), "i", F.col("value").alias("x"))
    y = placed.select("feature", F.col("context").alias("b"), "i", F.col("value").alias("y"))
    return pairs.select("feature", "a", "b").join(x, ["feature", "a"]).join(y, ["feature", "b", "i"])


def signed_ranks(paired: DataFrame) -> DataFrame:
    """(feature, a, b, n, w_plus, w_minus, tie_sum, zeros, all_close) over the differences of each pair. Equal sizes share a mean rank: counts of sizes, added up over dealt ranges."""
    keys = ["feature", "a", "b"]
    d = paired.withColumn("d", F.col("x") - F.col("y")).withColumn("close", F.abs(F.col("d")) <= 1e-8 + 1e-5 * F.abs("y"))
    whole = d.groupBy(*keys).agg(F.min(F.col("close").cast("int")).alias("all_close"), F.count(F.when(F.col("d") == 0, 1)).alias("zeros"))
    sizes = d.filter("d <> 0").groupBy(*keys, F.abs("d").alias("abs")).agg(F.count(F.lit(1)).alias("k"), F.count(F.when(F.col("d") > 0, 1)).alias("up"))
    last = running(sizes, keys, ["abs"], "k", "upto")
    ranks = last.withColumn("r", F.col("upto") - (F.col("k") - 1) / 2)
    sums = ranks.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col("r") * F.col("up")).alias("w_plus"), F.sum(F.col("r") * (F.col("k") - F.col("up"))).alias("w_minus"), F.sum(F.col("k") ** 3 - F.col("k")).alias("tie_sum"))
    return whole.join(sums, keys, "left").na.fill(0)


def wilcoxon(paired: DataFrame) -> DataFrame:
    return signed_ranks(paired).withColumn("p", P.signed_rank_udf(F.least("w_plus", "w_minus"), F.col("n"), F.col("tie_sum"), F.col("zeros")))


def anova(m: DataFrame) -> DataFrame:
    """(feature, f, df1, df2, p) from the moments of a feature's contexts."""
    g = m.groupBy("feature").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("sx"),
        F.sum(F.col("n") * F.col("mean") ** 2).alias("sxx"), F.sum((F.col("n") - 1) * F.col("var")).alias("within"),
    )
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    f = ((F.col("sxx") - F.col("sx") ** 2 / F.col("n")) / df1) / (F.col("within") / df2)
    return g.select("feature", f.alias("f"), df1.alias("df1"), df2.alias("df2")).withColumn("p", P.f_udf(F.col("f"), F.col("df1"), F.col("df2")))


def gated_study(expression: DataFrame, m: DataFrame, pairs: DataFrame) -> DataFrame:
    """(feature, a, b, n_a, n_b, branch, p). Both sides normal: t test from moments; otherwise pairs cut to the shorter side: 1 if all close, else signed rank.

    Normality is judged once a (feature, context); only pairs that need it join raw rows. An undefined p is 1.
    """
    expression = keep(expression)
    normal = keep(shapiro(expression).select("feature", "context", (F.col("p") >= ALPHA).alias("normal")))
    side = lambda c: normal.select("feature", F.col("context").alias(c), F.col("normal").alias(f"normal_{c}"))
    routed = pairs.join(side("a"), ["feature", "a"], "left").join(side("b"), ["feature", "b"], "left")
    both = F.coalesce(F.col("normal_a") & F.col("normal_b"), F.lit(True))
    cols = ["feature", "a", "b", "n_a", "n_b"]
    t = t_test(routed.filter(both)).select(*cols, F.lit("t").alias("branch"), "p")
    raw = routed.filter(~both).select(*cols)
    w = raw.join(wilcoxon(paired_rows(expression, raw)), ["feature", "a", "b"], "left")
    w = w.select(*cols, F.lit("rank").alias("branch"), F.when(F.coalesce("all_close", F.lit(1)) == 1, 1.0).otherwise(F.col("p")).alias("p"))
    return t.unionByName(w).withColumn("p", F.when(F.col("p").isNull() | F.isnan("p"), 1.0).otherwise(F.col("p")))


def p_matrix(study: DataFrame, m: DataFrame, least: int = 3) -> DataFrame:
    """Symmetric p-values of all pairs, ten digits; 1 on the diagonal and where a side has fewer than `least` samples."""
    half = study.select("feature", "a", "b", F.when((F.col("n_a") >= least) & (F.col("n_b") >= least), F.round("p", 10)).otherwise(1.0).alias("p"))
    own = m.select("feature", F.col("context").alias("a"), F.col("context").alias("b"), F.lit(1.0).alias("p"))
    return half.unionByName(half.select("feature", F.col("b").alias("a"), F.col("a").alias("b"), "p")).unionByName(own)


def occurrences(study: DataFrame) -> DataFrame:
    return study.groupBy("feature").agg(F.sum((F.col("p") < ALPHA).cast("int")).alias("occurrences"))


def occurrence_matrix(study: DataFrame, outputs: list) -> DataFrame:
    return study.groupBy("a").pivot("b", outputs).agg(F.sum((F.col("p") < ALPHA).cast("int")))


def max_min_score(study: DataFrame) -> DataFrame:
    """For each input the worst p over the outputs, of these the best: below 0.05 some input differs from every output."""
    worst = study.groupBy("feature", "a").agg(F.max("p").alias("p"))
    out = worst.groupBy("feature").agg(F.min("p").alias("score"))
    return out.withColumn("verdict", F.when(F.col("score") < ALPHA, "different").otherwise("not different"))


def p_summary(study: DataFrame, least: int = 3) -> DataFrame:
    q = F.percentile("p", F.array(*(F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0))))
    out = study.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), q.alias("q")).filter(F.col("n") >= least)
    return out.select("feature", "n", *(F.col("q")[i].alias(f"q{25 * i}") for i in range(5)))


def score_band(p):
    return F.when(p < 0.001, "<0.001").when(p < 0.01, "<0.01").when(p < 0.05, "<0.05").when(p < 0.10, "<0.10").otherwise(">=0.10")


def differential_table(expression: DataFrame, inputs: list, outputs: list) -> DataFrame:
    """feature, occurrences, score and band of the eligible features, by score and name."""
    if set(inputs) & set(outputs):
        raise ValueError("input and output contexts overlap")
    expression = keep(expression.filter(F.col("context").isin(inputs + outputs)))
    m = keep(moments(expression))
    fit = keep(eligible_features(m, inputs, outputs))
    m = m.join(fit, "feature", "left_semi")
    study = keep(gated_study(expression.join(fit, "feature", "left_semi"), m, pairs_of(m, inputs, outputs)))
    gated = study.withColumn("p", F.when((F.col("n_a") >= 3) & (F.col("n_b") >= 3), F.round("p", 10)).otherwise(1.0))
    out = occurrences(study).join(max_min_score(gated), "feature")
    return out.withColumn("band", score_band(F.col("score"))).orderBy("score", "feature")
