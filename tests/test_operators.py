"""Hand fixtures with expected values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from matrixmill.jobs import model as MODEL
from matrixmill.operators import discretize as D
from matrixmill.operators import expression as X
from matrixmill.operators import mining as M
from matrixmill.operators import scratch as SCR
from matrixmill.operators import significance as S
from matrixmill.operators import spectral as SP
from matrixmill.operators import stats as ST
from matrixmill.operators import text as T
from matrixmill.operators import tricluster as TC
from matrixmill.sources import matrix as SRC

BIC = "id long, rows array<int>, cols array<int>"
EXPR = "feature string, context int, subject int, pos int, value double"


def bics(spark, *rows):
    return spark.createDataFrame([(i, sorted(r), sorted(c)) for i, (r, c) in enumerate(rows, 1)], BIC)


def sets(df):
    return sorted((tuple(r.rows), tuple(r.cols)) for r in df.collect())


def test_merge(spark):
    b = bics(spark, ({1, 2, 3, 4}, {1, 2, 3, 4}), ({2, 3, 4}, {2, 3, 4}))
    assert sets(M.merge(b, 0.7)) == [((1, 2, 3, 4), (1, 2, 3, 4))]
    assert len(sets(M.merge(b, 0.8))) == 2
    b = bics(spark, ({1, 2, 4}, {2, 4, 5}), ({1, 2, 3}, {3, 4, 5}))
    assert sets(M.merge(b, 0.3)) == [((1, 2, 3, 4), (2, 3, 4, 5))]
    assert len(sets(M.merge(b, 0.6))) == 2


def test_filter(spark):
    b = bics(spark, ({1, 2, 3}, {1, 2, 3}), ({2, 3, 4}, {2, 3, 4}))
    assert [r.id for r in M.filter_overlapping(b, 0.3).collect()] == [1]
    assert M.filter_overlapping(b, 0.5).count() == 2


def closed(spark, rows, support):
    t = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "row int, items array<int>")
    return {tuple(r["items"]): tuple(r.rows) for r in M.closed_itemsets(t, support).collect()}


def test_closed_itemsets(spark):
    assert closed(spark, [[1, 2, 3, 4, 5], [1, 2, 3, 4, 5], [1, 2, 3, 4]], 0.5) == {(1, 2, 3, 4): (0, 1, 2), (1, 2, 3, 4, 5): (0, 1)}
    assert closed(spark, [[5, 2, 4, 1], [2, 4, 5, 6], [0, 9], [1, 2, 4]], 0.5) == {(2, 4): (0, 1, 3), (1, 2, 4): (0, 3), (2, 4, 5): (0, 1)}


def test_closed_sequences(spark):
    s = spark.createDataFrame([(0, [[1], [2]]), (1, [[0, 1], [2]]), (2, [[0, 1], [2]])], "row int, sequence array<array<int>>")
    get = lambda x: {tuple(map(tuple, r.sequence)): tuple(r.rows) for r in M.closed_sequences(s, x, 1).collect()}
    assert get(1.0) == {((1,), (2,)): (0, 1, 2)}
    assert get(0.6) == {((1,), (2,)): (0, 1, 2), ((0, 1), (2,)): (1, 2)}


def test_max_min_score(spark):
    rows = [("f", 0, 9, 1.0), ("f", 0, 8, 2.0), ("f", 1, 9, 3.0), ("f", 1, 8, 4.0)]
    assert ST.max_min_score(spark.createDataFrame(rows, "feature string, a int, b int, p double")).collect()[0].score == 2


def test_profile_slice(spark):
    dim = spark.createDataFrame([(1, 0, "m", "20-29"), (2, 0, "f", "20-29"), (3, 0, "m", "60-69")], "subject int, context int, sex string, age string")
    e = spark.createDataFrame([("g", 0, s, s, 1.0) for s in (1, 2, 3)], EXPR)
    get = lambda **p: sorted(r.subject for r in X.profile_slice(e, dim, p).collect())
    assert get(sex=["m", "f"], age=["20-29"]) == [1, 2]
    assert get(sex=["m"], age=["70-79"]) == [1, 3]
    assert get(sex=["x"], age=["70-79"]) == []


def expr(spark, **contexts):
    return spark.createDataFrame([("g", int(c[1:]), i, i, float(v)) for c, vs in contexts.items() for i, v in enumerate(vs)], EXPR)


def test_t_and_anova(spark):
    m = X.moments(expr(spark, c0=[1, 2], c1=[3, 4]))
    t = ST.t_test(ST.pairs_of(m)).collect()[0]
    assert (t.t, t.df, t.p) == (pytest.approx(-2.828427, abs=1e-6), 2, pytest.approx(0.105573, abs=1e-6))
    a = ST.anova(m).collect()[0]
    assert (a.f, a.p) == (pytest.approx(8), pytest.approx(0.105573, abs=1e-6))


def test_wilcoxon_exact(spark):
    e = expr(spark, c0=[1, 2, 3, 4, 5], c1=[0, 0, 0, 0, 0])
    r = ST.wilcoxon(ST.paired_rows(e, ST.pairs_of(X.moments(e)))).collect()[0]
    assert (r.w_minus, r.p) == (0, pytest.approx(0.0625))


def test_gated_study_of_equal_skewed_lists(spark):
    v = [0.0] * 10 + [1.0, 50.0]
    e = expr(spark, c0=v, c1=v, c2=[7.0] * 5)
    assert {(r.a, r.b): (r.branch, r.p) for r in ST.gated_study(e, X.moments(e), ST.pairs_of(X.moments(e))).collect()}[(0, 1)] == ("rank", 1.0)
    assert [r.p for r in ST.shapiro(e).filter("context = 2").collect()] == [1.0]


def test_shapiro_published_example(spark):
    # the worked example of the 1965 paper: weights of eleven men
    e = expr(spark, c0=[148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    r = ST.shapiro(e).collect()[0]
    assert r.w == pytest.approx(0.79, abs=0.005) and r.p < 0.01


def test_p_matrix_is_symmetric(spark):
    random.seed(4)
    e = expr(spark, c0=[random.random() for _ in range(9)], c1=[random.random() for _ in range(7)], c2=[1, 2])
    m = X.moments(e)
    got = {(r.a, r.b): r.p for r in ST.p_matrix(ST.gated_study(e, m, ST.pairs_of(m)), m).collect()}
    assert len(got) == 9 and all(got[a, b] == got[b, a] and 0 <= got[a, b] <= 1 for a, b in got)
    assert got[0, 2] == got[1, 1] == 1


def test_overlapping_inputs_are_refused(spark):
    with pytest.raises(ValueError):
        ST.differential_table(expr(spark, c0=[1]), [0, 1], [1])


def test_tf_idf(spark):
    d = spark.createDataFrame([(1, "aa bb"), (2, "aa")], "k int, t string")
    got = {(r.k, r.term): round(r.weight, 6) for r in T.tf_idf(d, "k", "t").collect()}
    assert got == {(1, "aa"): 0.579739, (1, "bb"): 0.814802, (2, "aa"): 1.0}


def test_content_words(spark):
    d = spark.createDataFrame([(1, "The bodies and glasses of the viruses bus")], "k int, t string")
    assert T.content_words(d, "k", "t").collect()[0].words == ["body", "glass", "viruse", "bus"]


def test_discretize(spark):
    cuts, below, above = D.cut_points(5, "col")
    assert [round(c, 6) for c in cuts] == [-0.841621, -0.253347, 0.253347, 0.841621]
    assert round(below[2], 6) == 0.150969
    rows = [(i, 0, float(v)) for i, v in enumerate([-1, 0, 1])]  # z = value
    got = {r.row: (r.bin, r.noise_bin) for r in D.discretized(spark.createDataFrame(rows, "row int, col int, value double")).collect()}
    assert got[1] == (2, None) and got[0][0] == 0 and got[2][0] == 4


def test_ratio_runs():
    assert TC.runs([2.0, 2.05, 2.08, 5.0], 0.05, 3) == [(0, 2)]
    assert TC.runs([1, 1.01, 2, 2.01, 2.02, 9], 0.05, 2) == [(0, 1), (2, 4)]


def test_symbolic_significance_rejects_unknown_kinds():
    with pytest.raises(ValueError, match="diagonal"):
        S.symbolic_significance(None, None, None, "diagonal")


def test_symbolic_null_models(spark):
    """Frequencies of column 0: 0.5, 0.25, 0.25 for symbols 0, 1, 2; of column 1: 0.25, 0.75 for 1, 2; symbol 3 is never seen."""
    items = spark.createDataFrame([(r, 0, b) for r, b in enumerate([0, 0, 1, 2])] + [(r, 1, b) for r, b in enumerate([1, 2, 2, 2])], "row int, col int, bin int")
    rows = spark.createDataFrame([(1, 0), (1, 3)], "id long, row int")
    chance = lambda bins, kind, n: S.symbolic_significance(items, rows, spark.createDataFrame([(1, c, b) for c, b in enumerate(bins)], "id long, col int, bin int"), kind, n).collect()[0].p
    assert chance([0, 1], "constant", 4) == pytest.approx(0.5 * 0.25)
    assert chance([0, 1], "order", 4) == pytest.approx(0.5)
    assert chance([0, 1], "additive", 4) == pytest.approx(0.5 * 0.25 + 0.25 * 0.75 + 0.25 * 0.01)  # 01, 12, 23
    assert chance([1, 2], "multiplicative", 4) == pytest.approx(0.25 * 0.75)  # twice is not below 4 / 2
    assert chance([1, 1], "multiplicative", 4) == pytest.approx(0.25 * 0.25 + 0.25 * 0.75 + 0.01 * 0.01)  # 11, 22, 33
    assert chance([0, 0], "multiplicative", 4) == pytest.approx(0.5 * 0.01)
    dropped = S.symbolic_significance(items, rows, spark.createDataFrame([(1, 0, 0)], "id long, col int, bin int"), max_p=0.01)
    assert dropped.count() == 0


def test_ratio_runs_extend_both_ways():
    chain = [1.0, 1.03, 1.06, 1.061, 1.062, 1.063, 1.1, 1.13]
    # the widest run is 1.03 to 1.063; pairs and one more slide on from there to 1.1, but 1.063 to 1.13 is too wide
    assert TC.runs(chain, 0.04, 2) == [(1, 6)]
    # the widest run is 1.02 to 1.06: 1.0 joins on the left, 1.07 on the right
    assert TC.runs([1.0, 1.02, 1.035, 1.05, 1.055, 1.06, 1.07], 0.04, 2) == [(0, 6)]
    # with least = 5 a sixth ratio must keep within the window
    assert TC.runs([1.0, 1.01, 1.02, 1.03, 1.04, 1.06], 0.04, 5) == [(0, 4)]
    assert TC.runs([1.0, 1.01, 1.02, 1.03, 1.04, 1.05, 1.06], 0.04, 3) == [(0, 6)]


BOX = "id long, contexts array<int>, subjects array<int>, features array<int>"


def test_cube_merge_and_delete(spark):
    two = spark.createDataFrame([(1, [0], [0, 1], [0, 1]), (2, [0], [0, 1], [1, 2])], BOX)
    assert [(r.contexts, r.subjects, r.features) for r in TC.merge(two, 1.0).collect()] == [([0], [0, 1], [0, 1, 2])]
    inner = spark.createDataFrame([(1, [0], [0, 1], [0, 1, 2]), (2, [0], [0, 1], [0, 1]), (3, [5], [0], [0])], BOX)
    assert sorted(r.id for r in TC.without_covered(inner, 0.9).collect()) == [1, 3]


@pytest.mark.parametrize("axis", [0, 1, 2])
def test_neighbouring_cubes_merge_along_each_axis(spark, axis):
    one, two, both = [[0, 1], [3, 4], [6, 7]], [[0, 1], [3, 4], [6, 7]], [[0, 1], [3, 4], [6, 7]]
    one[axis], two[axis], both[axis] = [10], [11, 12], [10, 11, 12]
    got = TC.merge(spark.createDataFrame([(1, *one), (2, *two)], BOX), 1.0).collect()
    assert [(r.contexts, r.subjects, r.features) for r in got] == [tuple(both)]


def test_edges_part_signs_and_skip_listed_values(spark):
    # ratios of size 2 with every combination of signs; feature 8 holds a zero, feature 9 a listed value
    pairs = [(2, 1), (4, 2), (-2, -1), (2, -1), (4, -2), (-2, 1), (-4, 2), (-6, 3), (0, 1), (99, 49.5)]
    cells = [(0, s, f, float(v)) for f, p in enumerate(pairs) for s, v in enumerate(p)]
    table = spark.createDataFrame(cells, "context int, subject int, feature int, value double")
    got = sorted(tuple(r.features) for r in TC.edges(table, 0.01, 2, (99.0,)).collect())
    assert got == [(0, 1, 2), (3, 4), (5, 6, 7)]


def cube_cells(n):
    """Ratios of n subjects are equal over 4 features in 3 contexts."""
    return [(c, s, f, (s + 1.0) * (f + 1.0)) for c in range(3) for s in range(n) for f in range(4)]


def test_as_many_subjects_as_there_are(spark):
    """70 subjects of one rectangle: levels go on until none is left."""
    chain = [(0, i, i + 1, [1, 2]) for i in range(69)]
    found = TC.rectangles(spark.createDataFrame(chain, "context int, i int, j int, features array<int>"), 2, 2).collect()
    assert [len(r.subjects) for r in found] == [70]


def test_large_sets_are_not_copied_for_each_member(spark):
    """400 sets of 1500 members, in a file that the planner takes for small: as many copies of each would be 3.6 GB."""
    sets = [(0, [k % 7], list(range(5 * k, 5 * k + 1500))) for k in range(400)] + [(0, [k % 7], list(range(5 * k + 9, 5 * k + 99))) for k in range(20)]
    found = TC.maximal(spark.createDataFrame(sets, "context int, subjects array<int>, features array<int>"), ["context"], ["subjects", "features"])
    assert found.columns == ["context", "subjects", "features"]
    assert sorted((r.subjects[0], r.features[0], len(r.features)) for r in found.collect()) == sorted((k % 7, 5 * k, 1500) for k in range(400))


def test_cubes_of_large_rectangles(spark):
    """Windows of 1500 features in a row, alike in two contexts: as cubes only whole windows are maximal."""
    found = [(c, 0, 1, list(range(5 * k, 5 * k + 1500))) for c in range(2) for k in range(250)]
    rects = TC.rectangles(spark.createDataFrame(found, "context int, i int, j int, features array<int>"), 2, 3)
    got = TC.cubes(rects, 2, 2, 1490).collect()
    assert sorted((r.contexts, r.subjects, r.features[0], len(r.features)) for r in got) == [([0, 1], [0, 1], 5 * k, 1500) for k in range(250)]


def test_cubes_keep_to_limits_of_deviation(spark):
    cells = spark.createDataFrame(cube_cells(3), "context int, subject int, feature int, value double")
    whole = TC.triclusters(cells, 0.01, 2, 2, 3).collect()
    assert [(r.contexts, r.subjects, r.features) for r in whole] == [([0, 1, 2], [0, 1, 2], [0, 1, 2, 3])]
    d = TC.deviations(cells, TC.triclusters(cells, 0.01, 2, 2, 3)).collect()[0]
    by_hand = [abs(s - 2) * (f + 1) for s in (1, 2, 3) for f in range(4)]
    assert (d.deviation_context, d.deviation_subject) == (0, pytest.approx(sum(by_hand) / 12))
    assert TC.triclusters(cells, 0.01, 2, 2, 3, limits={"context": 0.0}).count() == 1
    # rectangles are maximal, so no smaller cube stands in
    assert TC.triclusters(cells, 0.01, 2, 2, 3, limits={"subject": d.deviation_subject - 0.01}).count() == 0
    with pytest.raises(ValueError):
        TC.cubes(cells.limit(0).select("context", F.array("subject").alias("subjects"), F.array("feature").alias("features")), limits={"context": 1.0})


def test_long_order_patterns(spark):
    """13 columns in one order: nothing is cut at a length."""
    rows = spark.createDataFrame([(r, [[c] for c in range(13)]) for r in range(3)] + [(3, [[c] for c in range(12, -1, -1)])], "row int, sequence array<array<int>>")
    got = M.closed_sequences(rows, 0.75).collect()
    assert [(r.sequence, r.rows) for r in got] == [([[c] for c in range(13)], [0, 1, 2])]


def test_alike_patterns_keep_their_own_rows(spark):
    """(0, 2) at once and 0 before 2 are two patterns, whose elements in a row are the same."""
    rows = [(r, [[0, 2]]) for r in range(3)] + [(r, [[0], [2]]) for r in range(3, 6)]
    got = M.closed_sequences(spark.createDataFrame(rows, "row int, sequence array<array<int>>"), 0.5).collect()
    assert {str(r.sequence): r.rows for r in got} == {"[[0, 2]]": [0, 1, 2], "[[0], [2]]": [3, 4, 5]}
    ids = spark.createDataFrame([([1, 2], [3]), ([1], [2, 3])], "rows array<int>, cols array<int>").select(SCR.set_id("rows", "cols").alias("id"))
    assert ids.distinct().count() == 2


def test_patterns_are_rebased(spark):
    sets = spark.createDataFrame([(1, [0 * 9 + 4, 1 * 9 + 6, 2 * 9 + 2], [0, 1]), (2, [0 * 9 + 0, 1 * 9 + 6], [2, 3])], "id long, items array<int>, rows array<int>")
    get = lambda kind: {r.id: r.pattern for r in M.to_biclusters(sets, 9, kind).collect()}
    assert get("constant") == {1: [4, 6, 2], 2: [0, 6]}
    assert get("additive") == {1: [2, 4, 0], 2: [0, 6]}
    assert get("multiplicative") == {1: [2, 3, 1], 2: [0, 1]}


def test_cluster_table_orders_names_as_strings(spark):
    rows = [(i, [1], [1], 0.5) for i in range(1, 12)] + [(12, [], [1], 0.1), (13, [1], [1], None), (14, [1], [1], float("nan")), (15, [1], [1], 0.25)]
    got = [r.name for r in M.cluster_table(spark.createDataFrame(rows, "id long, rows array<int>, cols array<int>, significance double"), "a").collect()]
    assert got == ["acluster12", "acluster1", "acluster10", "acluster11", *(f"acluster{i}" for i in range(2, 10))]


@pytest.mark.parametrize("by_columns", [False, True])
def test_symbolic_biclusters_end_to_end(spark, by_columns):
    random.seed(5)
    cells = [(r, c, 3.0 if r < 40 and c in (1, 3, 4) else random.gauss(0, 1)) for r in range(120) for c in range(6)]
    table = spark.createDataFrame([(c, r, v) if by_columns else (r, c, v) for r, c, v in cells], "row int, col int, value double")
    out = M.symbolic_biclusters(table, by_columns=by_columns, min_cols=3)
    got = out.collect()
    assert [r.key for r in got] == list(range(len(got))) and all(0 <= r.significance <= 1 for r in got)
    sides = [(r.cols, r.rows) if by_columns else (r.rows, r.cols) for r in got]
    best = next(i for i, (rows, cols) in enumerate(sides) if {1, 3, 4} <= set(cols) and len(set(rows) & set(range(40))) > 35)
    assert got[best].significance < 1e-6 and got[best].pattern is not None


def test_order_biclusters_end_to_end(spark):
    random.seed(6)
    cells = []
    for r in range(60):
        values = sorted(random.random() for _ in range(4)) if r < 40 else [random.random() for _ in range(4)]
        cells += [(r, c, v * 9) for c, v in enumerate(values)]
    got = M.symbolic_biclusters(spark.createDataFrame(cells, "row int, col int, value double"), "order", by="row", min_cols=3, tau_merge=2.0).collect()
    assert any(r.sequence and set(r.cols) >= {0, 1, 2} for r in got)


def test_support_search_by_area_and_floor(spark):
    t = spark.createDataFrame([(i, [1, 2, 3]) for i in range(6)] + [(i, [4, 5]) for i in range(6, 10)], "row int, items array<int>")
    get = lambda **k: sorted(tuple(r["items"]) for r in M.support_search(t, 9, 2, **k).collect())
    assert get(min_area=8) == [(1, 2, 3)]  # 18 cells are more than twice 8
    assert get(min_area=9) == [(1, 2, 3), (4, 5)]
    assert get(least_support=0.5) == [(1, 2, 3)]


AMOUNTS = (46.73, 85.77, 52.42)  # as doubles another sum from the end than from the start


@pytest.fixture(scope="module")
def shuffled_events(spark, tmp_path_factory):
    """Users 1 to 3 on Monday (context 0) and Friday (4): the same amounts in another order, or one amount."""
    def on(user, day, *values):
        return [(user, f"2024-01-0{day + 1} 10:00:00", "view", v) for v in values]

    rows = [*on(1, 0, *AMOUNTS), *on(1, 4, *AMOUNTS[::-1]), *on(2, 0, *AMOUNTS), *on(2, 4, 1.0), *on(3, 0, 1.0), *on(3, 4, *AMOUNTS[::-1])]
    d = str(tmp_path_factory.mktemp("events"))
    spark.createDataFrame(rows, "user_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"{d}/events.parquet")
    return d


def test_values_do_not_hang_on_the_order_of_events(spark, shuffled_events):
    cells = MODEL.expression(spark, shuffled_events).filter("subject <> 3").select("subject", F.lit(0).alias("col"), "value").filter("value > 2")
    assert [(r.n_distinct, r.real) for r in D.symbol_columns(cells).collect()] == [(1, False)]


@pytest.fixture(scope="module")
def shuffled_pairs(spark, shuffled_events):
    """User 1 keeps the same value, users 2 and 3 differ by as much, one up and one down."""
    e = MODEL.expression(spark, shuffled_events)
    return ST.paired_rows(e, ST.pairs_of(X.moments(e), [0], [4]))


def test_equal_differences_of_shuffled_events_tie(shuffled_pairs):
    got = ST.signed_ranks(shuffled_pairs).collect()
    assert [(r.a, r.b, r.n, r.w_plus, r.w_minus, r.tie_sum, r.zeros) for r in got] == [(0, 4, 2, 1.5, 1.5, 6, 1)]


def test_wilcoxon_of_shuffled_events(shuffled_pairs):
    assert [(r.n, r.p) for r in ST.wilcoxon(shuffled_pairs).collect()] == [(2, 1.0)]


def test_sums_of_odd_doubles(spark):
    odd = {0: [None], 1: [1e300, 1.0], 2: [float("inf"), 1.0], 3: [float("nan"), 1.0], 4: [None, 0.25], 5: [1 / 3, 0.5], 6: [0.1] * 10, 7: [float("inf"), float("-inf")]}
    table = spark.createDataFrame([(k, v) for k, vs in odd.items() for v in vs], "k int, v double")
    got = {r.k: r.s for r in table.groupBy("k").agg(MODEL.steady_sum("v").alias("s")).collect()}
    assert math.isnan(got.pop(3)) and math.isnan(got.pop(7))
    assert got == {0: None, 1: 1e300, 2: math.inf, 4: 0.25, 5: 1 / 3 + 0.5, 6: 1.0}


def test_quantiles_between_equal_values(spark):
    """Every quantile lies between two copies of a value: the bin of that value ends there, with all of its copies."""
    values = [0.1] * 2 + [0.21] * 3 + [2.81] * 2 + [2.85] * 3 + [6.69] * 3 + [9.0]
    got = D.quantile_bins(spark.createDataFrame([(i, 0, v) for i, v in enumerate(values)], "row int, col int, value double"))
    assert {(r.value, r.bin) for r in got.collect()} == {(0.1, 0), (0.21, 0), (2.81, 1), (2.85, 2), (6.69, 3), (9.0, 4)}


def test_quantile_bins(spark):
    table = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate([1, 2, 3, 4, 10])] + [(i, 1, float(i)) for i in range(5)], "row int, col int, value double")
    got = {(r.row, r.col): r.bin for r in D.quantile_bins(table, 2).collect()}
    assert [got[i, 0] for i in range(5)] == [0, 0, 0, 1, 1] == [got[i, 1] for i in range(5)]
    assert D.quantile_bins(table, 2, "row").count() == 10
    with pytest.raises(Exception, match="repeated quantile edges in col 0"):
        D.quantile_bins(spark.createDataFrame([(i, 0, 1.0) for i in range(9)], "row int, col int, value double"), 3).collect()


def test_spectral_blocks_are_found_and_weighed(spark):
    random.seed(7)
    cells = [(r, c, (9.0 if r % 3 == c % 3 else 1.0) + random.random()) for r in range(60) for c in range(12)]
    table = spark.createDataFrame(cells, "row int, col int, value double")
    for f in (SP.co_clusters, SP.checkerboard):
        labels = f(table, 3)
        by = {(r.axis, int(r.name)): r.label for r in labels.collect()}
        assert len(by) == 72
        for axis, n in (("row", 60), ("col", 12)):
            groups = [{by[axis, i] for i in range(k, n, 3)} for k in range(3)]
            assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
        rows, cols = SP.blocks(labels, table)
        assert S.bicluster_significance(table, rows, cols).count() == 3


def test_ranks_and_counts_over_ranges(spark):
    random.seed(8)
    data = [(k, round(random.random(), 2), i) for i, k in enumerate(random.choices("ab", [9, 1], k=3000))]
    df = spark.createDataFrame(data, "k string, v double, i int").repartition(7)
    got = {r.i: (r.place, r.n) for r in SCR.ranked(df, ["k"], ["v", "i"], "place").collect()}
    for k in "ab":
        own = sorted((v, i) for key, v, i in data if key == k)
        assert all(got[i] == (place, len(own)) for place, (_, i) in enumerate(own, 1))
    bounds = [(k, b) for k in "ab" for b in (-1.0, 0.0, 0.25, 0.5, 0.51, 2.0)]
    found = SCR.counts_at(df.select("k", F.col("v").alias("value")), spark.createDataFrame(bounds, "k string, bound double"), "k").collect()
    assert sorted((r.k, r.bound, r.upto) for r in found) == sorted((k, b, sum(key == k and v <= b for key, v, _ in data)) for k, b in bounds)


def test_cubes_that_share_nothing_merge_by_size(spark):
    # 1001 of 11 x 11 x 11 cells are covered, 0.752
    boxes = spark.createDataFrame([(1, list(range(10)), list(range(10)), list(range(10))), (2, [50], [50], [50])], BOX)
    assert [(len(r.contexts), len(r.subjects), len(r.features)) for r in TC.merge(boxes, 0.75).collect()] == [(11, 11, 11)]
    assert TC.merge(boxes, 0.76).count() == 2


def test_planted_cube_is_found(spark):
    random.seed(1)
    cells = []
    for c in range(3):
        for s in range(4):
            for f in range(8):
                planted = c < 2 and s in (1, 3) and f in (2, 4, 5, 7)
                cells.append((c, s, f, (s + 1.0) * (f + 1.0) if planted else random.uniform(1, 100)))
    got = TC.triclusters(spark.createDataFrame(cells, "context int, subject int, feature int, value double"), 0.01, 2, 2, 4).collect()
    assert any({0, 1} <= set(r.contexts) and {1, 3} <= set(r.subjects) and {2, 4, 5, 7} <= set(r.features) for r in got)


def test_planted_bicluster_is_found_and_significant(spark):
    random.seed(2)
    rows = [(r, c, 3 if r < 25 and c < 4 else random.randrange(5), None) for r in range(100) for c in range(10)]
    items = spark.createDataFrame(rows, "row int, col int, bin int, noise_bin int")
    found = M.to_biclusters(M.closed_itemsets(D.transactions(items, 5), 0.2, 4), 5)
    hit = [r for r in found.collect() if r.cols == [0, 1, 2, 3] and r.pattern == [3] * 4]
    assert hit and set(range(25)) <= set(hit[0].rows)
    members = spark.createDataFrame([(1, r) for r in range(25)], "id long, row int")
    pattern = spark.createDataFrame([(1, c, 3) for c in range(4)], "id long, col int, bin int")
    assert S.symbolic_significance(items, members, pattern).collect()[0].significance < 1e-6


def test_mask_takes_share_plus_one(spark):
    cells = spark.createDataFrame([(r, c) for r in range(3) for c in range(3)], "row int, col int")
    left = M.masked(cells, bics(spark, ({0, 1}, {0, 1}), ({0}, {0})))
    assert left.count() == 9 - (math.floor(0.6 * 4) + 1) and (0, 0) not in {tuple(r) for r in left.collect()}


def test_wide_matrix_reader(spark, tmp_path):
    p = tmp_path / "m.gct"
    p.write_text("#1.2\n2\t2\nid\tName\tDescription\tGTEX-A-1\tGTEX-B-2\n0\tn1\tgeneA\t0\t1.5\n1\tn2\tgeneB\t2\t3\n")
    got = SRC.read_wide_matrix(spark, str(p), context="c").orderBy("feature", "pos").collect()
    assert [(r.feature, r["sample"], r.pos, r.value) for r in got] == [("geneA", "GTEX-A-1", 0, 0.0), ("geneA", "GTEX-B-2", 1, 1.5), ("geneB", "GTEX-A-1", 0, 2.0), ("geneB", "GTEX-B-2", 1, 3.0)]
    assert spark.createDataFrame([("GTEX-A-1",)], "s string").select(X.subject_of(F.col("s"))).collect()[0][0] == "GTEX-A"


def test_wide_matrix_rows_are_never_lost(spark, tmp_path):
    head = "#1.2\n2\t2\nid\tName\tDescription\tA-1\tB-2\n"
    (tmp_path / "a").mkdir()
    # a row like the header's start, a blank line, two files each with its own preamble
    (tmp_path / "a" / "1.gct").write_text(head + "id\tn1\tgeneA\t0\t1.5\n\n1\tn2\tgeneB\t2\t3\n")
    (tmp_path / "a" / "2.gct").write_text(head + "7\tn7\tgeneC\t4\t5\n")
    got = SRC.read_wide_matrix(spark, str(tmp_path / "a")).collect()
    assert sorted((r.feature, r.pos, r.value) for r in got) == [("geneA", 0, 0.0), ("geneA", 1, 1.5), ("geneB", 0, 2.0), ("geneB", 1, 3.0), ("geneC", 0, 4.0), ("geneC", 1, 5.0)]
    assert {r.feature: r.row_pos for r in got if r.feature != "geneC"} == {"geneA": 3, "geneB": 5}
    (tmp_path / "r.gct").write_text(head + "0\tn1\tgeneA\t0\t1.5\n1\tn2\tgeneB\t2\n")
    with pytest.raises(Exception, match="another width"):
        SRC.read_wide_matrix(spark, str(tmp_path / "r.gct")).collect()
    assert {r.feature for r in SRC.read_wide_matrix(spark, str(tmp_path / "r.gct"), ragged="drop").collect()} == {"geneA"}


def test_annotations(spark, tmp_path):
    (tmp_path / "x.json").write_text('[{"id": 1, "text": "aa"}, {"id": 2, "text": "bb"}]')
    (tmp_path / "x.csv").write_text("id,text\n1,aa\n2,bb\n")
    for name in ("x.json", "x.csv"):
        assert sorted((int(r.id), r.text) for r in SRC.read_annotations(spark, str(tmp_path / name)).collect()) == [(1, "aa"), (2, "bb")]


def test_sinks(spark, tmp_path):
    f = spark.createDataFrame([("b",), ("a",)], "feature string")
    SRC.write_feature_list(f, str(tmp_path / "l"))
    assert [r.feature for r in SRC.read_feature_list(spark, str(tmp_path / "l")).collect()] == ["a", "b"]
    SRC.append_table(f, str(tmp_path / "t"))
    SRC.append_table(f, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    SRC.write_csv(f, str(tmp_path / "c"))
    assert SRC.read_delimited(spark, str(tmp_path / "c"), ",").count() == 2


def test_tidy_leaves_what_results_read(spark):
    """Of the tables kept on the way only those that a result reads stay; an outer operator deletes what inner ones left for it."""
    import glob

    def there():
        return set(glob.glob(SCR.shared_dir(spark).removeprefix("file:") + "/matrixmill-*"))

    @SCR.tidy
    def inner():
        SCR.keep(spark.range(3))
        return SCR.keep(spark.range(5)).join(SCR.keep(spark.range(4)), "id")

    @SCR.tidy
    def outer():
        return SCR.keep(inner().filter("id > 0")), 1

    before = there()
    df = inner()
    assert len(there() - before) == 2 and df.count() == 4
    before = there()
    df, one = outer()
    assert len(there() - before) == 1 and df.count() == 3 and one == 1
