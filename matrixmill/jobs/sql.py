"""Pieces of SQL for distributions that DuckDB lacks: series summed over a list, apart from the numpy forms of the library."""

from __future__ import annotations


def horner(coefficients: tuple, x: str) -> str:
    """A polynomial, highest power first."""
    out = repr(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * ({x}) + {c!r})"
    return out


def normal_cdf(z: str) -> str:
    """erf(x) = sum of exp((2k + 1) ln x - lgamma(k + 3/2) - x^2), all terms positive."""
    x = f"(abs({z}) / sqrt(2.0))"
    erf = f"list_sum([exp((2 * k + 1) * ln({x}) - lgamma(k + 1.5) - {x} * {x}) FOR k IN range(0, 220)])"
    return f"(CASE WHEN ({z}) = 0 THEN 0.5 WHEN abs({z}) > 9 THEN CASE WHEN ({z}) > 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 + 0.5 * sign({z}) * {erf} END)"


def incomplete_beta(a: str, b: str, x: str, terms: int = 3000) -> str:
    """Regularised, by its power series in x, or in 1 - x where that converges faster."""
    series = lambda a, b, x: f"list_sum([exp(({a} + k) * ln({x}) + ({b}) * ln(1 - {x}) + lgamma({a} + {b} + k) - lgamma({a} + k + 1) - lgamma({b})) FOR k IN range(0, {terms})])"
    return f"(CASE WHEN {x} <= 0 THEN 0.0 WHEN {x} >= 1 THEN 1.0 WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {series(b, a, f'(1 - {x})')} ELSE {series(a, b, x)} END)"


def binomial_at_least(n: str, trials: str, p: str) -> str:
    """P[Binomial(trials, p) >= n], term by term."""
    term = f"exp(lgamma({trials} + 1) - lgamma(k + 1) - lgamma({trials} - k + 1) + k * ln({p}) + ({trials} - k) * ln(1 - {p}))"
    return f"(CASE WHEN {n} <= 0 OR {p} >= 1 THEN 1.0 WHEN {n} > {trials} OR {p} <= 0 THEN 0.0 ELSE list_sum([{term} FOR k IN range({n}, {trials} + 1)]) END)"


def normal_score(p: str) -> str:
    """The rational approximation that Shapiro-Wilk's scores are stated with."""
    # fixed values: Acklam's published coefficients
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
    q, r = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"(({p} - 0.5) * ({p} - 0.5))"
    return f"(CASE WHEN least({p}, 1 - {p}) < 0.02425 THEN {horner(c, q)} / {horner(d, q)} * CASE WHEN {p} < 0.5 THEN 1 ELSE -1 END ELSE ({p} - 0.5) * {horner(a, r)} / {horner(b, r)} END)"


def shapiro(source: str = "e") -> str:
    """CTEs up to sw (feature, context, n, w, p)."""
    # fixed values of the published approximation, lowest power first there
    last = horner((-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0), "u")
    next_ = horner((-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0), "u")
    small = "n <= 11"
    mu = f"CASE WHEN {small} THEN {horner((-0.0006714, 0.025054, -0.39978, 0.5440), 'n')} ELSE {horner((0.0038915, -0.083751, -0.31082, -1.5861), 'ln(n)')} END"
    sd = f"exp(CASE WHEN {small} THEN {horner((-0.0020322, 0.062767, -0.77857, 1.3822), 'n')} ELSE {horner((0.0030302, -0.082676, -0.4803), 'ln(n)')} END)"
    return f"""sw0 AS (SELECT feature, context, value, row_number() OVER (PARTITION BY feature, context ORDER BY value, pos) AS i, count(*) OVER (PARTITION BY feature, context) AS n FROM {source}),
sw1 AS (SELECT *, (i - 0.375) / (n + 0.25) AS pr FROM sw0 WHERE n >= 3), sw2 AS (SELECT *, {normal_score('pr')} AS m FROM sw1),
sw3 AS (SELECT feature, context, any_value(n) AS n, sum(m * m) AS mm, sum(m * value) AS mx, var_pop(value) * count(*) AS ss, min(value) AS x1, max(value) AS xn, max(CASE WHEN i = 2 THEN value END) AS x2, max(CASE WHEN i = n - 1 THEN value END) AS xm, max(m) AS m_n, max(CASE WHEN i = n - 1 THEN m END) AS m_m FROM sw2 GROUP BY 1, 2),
sw4 AS (SELECT *, 1 / sqrt(n) AS u FROM sw3), sw5 AS (SELECT *, CASE WHEN n = 3 THEN sqrt(0.5) ELSE m_n / sqrt(mm) + {last} END AS a_n, m_m / sqrt(mm) + {next_} AS a_m FROM sw4),
sw6 AS (SELECT *, CASE WHEN n = 3 THEN a_n * (xn - x1) WHEN n <= 5 THEN (mx - m_n * (xn - x1)) / sqrt((mm - 2 * m_n * m_n) / (1 - 2 * a_n * a_n)) + a_n * (xn - x1)
  ELSE (mx - m_n * (xn - x1) - m_m * (xm - x2)) / sqrt((mm - 2 * m_n * m_n - 2 * m_m * m_m) / (1 - 2 * a_n * a_n - 2 * a_m * a_m)) + a_n * (xn - x1) + a_m * (xm - x2) END AS b FROM sw5),
sw7 AS (SELECT feature, context, n, CASE WHEN xn = x1 THEN 1.0 ELSE least(1.0, b * b / ss) END AS w FROM sw6), sw8 AS (SELECT *, CASE WHEN w < 1 THEN ln(1 - w) END AS y FROM sw7),
sw9 AS (SELECT *, (CASE WHEN {small} THEN -ln(greatest(1e-300, -2.273 + 0.459 * n - y)) ELSE y END - {mu}) / {sd} AS z FROM sw8),
sw AS (SELECT feature, context, n, w, CASE WHEN w >= 1 THEN 1.0 WHEN n = 3 THEN least(1.0, greatest(0.0, 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75))))) WHEN {small} AND y >= -2.273 + 0.459 * n THEN 0.0 ELSE 1 - {normal_cdf('z')} END AS p FROM sw9)"""


def ranks() -> str:
    """CTEs from pr (feature, a, b, i, x, y) to sg (feature, a, b, n, w_plus, w_minus, tie_sum, zeros, all_close); sr: counts of rank sums of up to 50 ranks."""
    return """sr AS (SELECT 0 AS n, [CAST(1.0 AS DOUBLE)] AS l UNION ALL SELECT n + 1, [(CASE WHEN i < len(l) THEN l[i + 1] ELSE 0 END) + (CASE WHEN i > n THEN l[i - n] ELSE 0 END) FOR i IN range(0, len(l) + n + 1)] FROM sr WHERE n < 50),
dd AS (SELECT feature, a, b, x - y AS d, abs(x - y) <= 1e-8 + 1e-5 * abs(y) AS c FROM pr),
rr AS (SELECT feature, a, b, d, count(*) OVER (PARTITION BY feature, a, b, abs(d)) AS t, rank() OVER (PARTITION BY feature, a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY feature, a, b, abs(d)) - 1) / 2 AS r FROM dd WHERE d <> 0),
sg AS (SELECT feature, a, b, coalesce(n, 0) AS n, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus, coalesce(tie_sum, 0) AS tie_sum, zeros, all_close
  FROM (SELECT feature, a, b, count(*) FILTER (d = 0) AS zeros, bool_and(c) AS all_close FROM dd GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT feature, a, b, count(*) AS n, CAST(coalesce(sum(r) FILTER (d > 0), 0) AS DOUBLE) AS w_plus, CAST(coalesce(sum(r) FILTER (d < 0), 0) AS DOUBLE) AS w_minus, sum(t * t - 1) AS tie_sum FROM rr GROUP BY 1, 2, 3) USING (feature, a, b)),
wx0 AS (SELECT *, n * (n + 1) * (2 * n + 1) / 24 - tie_sum / 48 AS v, abs(least(w_plus, w_minus) - n * (n + 1) / 4) AS far FROM sg),
wx AS (SELECT s.*, CASE WHEN s.n = 0 THEN 1.0 WHEN s.n <= 50 AND tie_sum = 0 AND zeros = 0 THEN least(1.0, 2 * list_sum(sr.l[1:CAST(least(w_plus, w_minus) AS INTEGER) + 1]) / pow(2, s.n))
  WHEN v > 0 THEN 2 * (1 - """ + normal_cdf("(far / sqrt(v))") + """) ELSE 1.0 END AS p FROM wx0 s LEFT JOIN sr ON sr.n = s.n)"""


def t_two_sided(t: str, df: str) -> str:
    return incomplete_beta(f"({df} / 2.0)", "0.5", f"({df} / ({df} + {t} * {t}))")


def gated(pairs: str) -> str:
    """CTEs from e and m to st (feature, a, b, n_a, n_b, branch, p) for the pairs p, q of contexts that the condition names."""
    return f"""{shapiro()}, t AS (SELECT p.feature, p.context AS a, q.context AS b, p.n AS n_a, q.n AS n_b, p.n + q.n - 2 AS df, (p.mean - q.mean) / sqrt(((p.n - 1) * p.var + (q.n - 1) * q.var) / (p.n + q.n - 2) * (1 / p.n + 1 / q.n)) AS t FROM m p JOIN m q ON p.feature = q.feature AND {pairs}),
rt AS (SELECT t.*, coalesce(x.p >= 0.05 AND y.p >= 0.05, NOT coalesce(x.p < 0.05 OR y.p < 0.05, false)) AS both_ FROM t LEFT JOIN sw x ON x.feature = t.feature AND x.context = a LEFT JOIN sw y ON y.feature = t.feature AND y.context = b),
rk AS (SELECT feature, context, value, row_number() OVER (PARTITION BY feature, context ORDER BY pos) AS i FROM e),
pr AS (SELECT rt.feature, a, b, p.i, p.value AS x, q.value AS y FROM rt JOIN rk p ON p.feature = rt.feature AND p.context = a JOIN rk q ON q.feature = rt.feature AND q.context = b AND p.i = q.i WHERE NOT both_),
{ranks()},
st AS (SELECT feature, a, b, n_a, n_b, CASE WHEN both_ THEN 't' ELSE 'rank' END AS branch, coalesce(CASE WHEN isnan(p0) THEN 1.0 ELSE p0 END, 1.0) AS p FROM (
  SELECT rt.*, CASE WHEN both_ THEN {t_two_sided('t', 'df')} WHEN coalesce(all_close, true) THEN 1.0 ELSE wx.p END AS p0 FROM rt LEFT JOIN wx USING (feature, a, b)))"""


def closed_itemsets(least: str) -> str:
    """CTEs from transactions tr (row, items) to cs (items, support, rows): sets grown item by item with their rows; closed if no other item is in all of them."""
    return f"""one AS (SELECT it, list_sort(list("row")) AS rs FROM (SELECT "row", unnest(items) AS it FROM tr) GROUP BY 1 HAVING count(*) >= {least}),
grown AS (SELECT [it] AS items, it AS last, rs FROM one UNION ALL SELECT list_append(items, it), it, list_sort(list_intersect(g.rs, one.rs)) FROM grown g JOIN one ON it > last WHERE len(list_intersect(g.rs, one.rs)) >= {least}),
cs AS (SELECT items, CAST(len(rs) AS BIGINT) AS support, rs AS "rows" FROM grown g WHERE len(items) >= 2 AND NOT EXISTS (SELECT 1 FROM one WHERE NOT list_contains(g.items, it) AND list_has_all(one.rs, g.rs)))"""


def closed_sequences(least: str) -> str:
    """CTEs from bins i (row, col, bin) to cq (sequence, support, rows). A column has one bin in a row, so a pattern's rows follow from relations of neighbouring columns."""
    return f"""rel AS (SELECT p.col AS c, q.col AS nx, p.bin < q.bin AS later, list_sort(list(p."row")) AS rs FROM i p JOIN i q ON p."row" = q."row" AND p.col <> q.col AND (p.bin < q.bin OR (p.bin = q.bin AND p.col < q.col)) GROUP BY 1, 2, 3 HAVING count(*) >= {least}),
alone AS (SELECT col AS c, list_sort(list("row")) AS rs FROM i WHERE bin IS NOT NULL GROUP BY 1 HAVING count(*) >= {least}),
sq AS (SELECT [[c]] AS sequence, c AS last, 1 AS width, rs FROM alone UNION ALL
  SELECT CASE WHEN later THEN list_append(sequence, [nx]) ELSE list_append(sequence[1:len(sequence) - 1], list_append(sequence[len(sequence)], nx)) END, nx, width + 1, list_sort(list_intersect(sq.rs, rel.rs))
  FROM sq JOIN rel ON rel.c = last WHERE len(list_intersect(sq.rs, rel.rs)) >= {least}),
less AS (SELECT DISTINCT len(rs) AS k, [g FOR g IN [[c FOR c IN h IF c <> x] FOR h IN sequence] IF len(g) > 0] AS part FROM (SELECT sequence, rs, unnest(flatten(sequence)) AS x FROM sq WHERE width > 1)),
cq AS (SELECT sequence, CAST(len(rs) AS BIGINT) AS support, rs AS "rows" FROM sq WHERE width >= 2 AND NOT EXISTS (SELECT 1 FROM less WHERE k = len(sq.rs) AND part = sq.sequence))"""


def merge_round(k: int, tau: float) -> str:
    """CTEs from b{k} (id, rows, cols) to b{k+1}: each bicluster takes part in one merge."""
    return f"""pr{k} AS (SELECT x.id AS a, y.id AS b FROM b{k} x JOIN b{k} y ON x.id < y.id WHERE len(list_intersect(x."rows", y."rows")) > 0 AND len(list_intersect(x.cols, y.cols)) > 0 AND len(list_intersect(x.cols, y.cols)) >= {tau} * greatest(len(x.cols), len(y.cols))
  AND len(list_intersect(x.cols, y.cols)) * len(list_intersect(x."rows", y."rows")) >= {tau} * least(len(x."rows") * len(x.cols), len(y."rows") * len(y.cols))),
fa{k} AS (SELECT a, min(b) AS b FROM pr{k} GROUP BY 1), fb{k} AS (SELECT min(a) AS a, b FROM fa{k} GROUP BY 2), fc{k} AS (SELECT * FROM fb{k} WHERE a NOT IN (SELECT b FROM fb{k})),
b{k + 1} AS (SELECT * FROM b{k} WHERE id NOT IN (SELECT a FROM fc{k} UNION ALL SELECT b FROM fc{k}) UNION ALL
  SELECT f.a, list_sort(list_distinct(list_concat(x."rows", y."rows"))), list_sort(list_distinct(list_concat(x.cols, y.cols))) FROM fc{k} f JOIN b{k} x ON x.id = f.a JOIN b{k} y ON y.id = f.b)"""


def ratio_edges(window: float, least: int) -> str:
    """CTEs (recursive) from cells c (context, s, f, value) to ed (context, i, j, features): the widest run of a segment, extended, then the segments on either side."""
    return f"""q AS (SELECT x.context, x.s AS i, y.s AS j, x.f, abs(x.value / y.value) AS r, CASE WHEN x.value * y.value > 0 THEN 0 WHEN x.value > 0 THEN 1 ELSE 2 END AS sgn FROM c x JOIN c y ON x.context = y.context AND x.f = y.f AND x.s < y.s WHERE x.value <> 0 AND y.value <> 0),
gr AS MATERIALIZED (SELECT row_number() OVER () AS g, *, list_transform(r, lambda v: len(list_filter(r, lambda z: z <= v * (1 + {window}))) - 1) AS e FROM (SELECT context, i, j, list(r ORDER BY r, f) AS r, list(f ORDER BY r, f) AS f FROM q GROUP BY context, i, j, sgn)),
sg AS (SELECT g, CAST(0 AS BIGINT) AS a, CAST(len(r) AS BIGINT) AS b, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS q FROM gr UNION ALL
  SELECT g, t.a, t.b, t.p, t.q FROM (
    SELECT g, a, b, coalesce(list_max([k FOR k IN range(a, f0) IF e[k + 1] - k < {least}]) + 1, a) AS p, coalesce(list_min([k FOR k IN range(l0 + 1 - {least}, b - {least}) IF e[k + 1] - k < {least}]) - 1 + {least}, greatest(l0, b - 1)) AS q FROM (
      SELECT *, f0 + m - 1 AS l0 FROM (SELECT *, a + list_position(z, m) - 1 AS f0 FROM (SELECT *, list_max(z) AS m FROM (
        SELECT g, a, b, e, [least(e[k + 1], b - 1) - k + 1 FOR k IN range(a, b)] AS z FROM sg JOIN gr USING (g) WHERE p IS NULL AND b - a >= {least}))) WHERE m >= {least})) u,
    LATERAL (SELECT unnest([u.a, u.q + 1, u.p]) AS a, unnest([u.p, u.b, u.q]) AS b, unnest([NULL, NULL, u.p]) AS p, unnest([NULL, NULL, u.q]) AS q) t),
ed AS MATERIALIZED (SELECT context, i, j, list_sort(f[p + 1:q + 1]) AS features FROM sg JOIN gr USING (g) WHERE p IS NOT NULL)"""


def edge_rectangles(subjects: int, features: int) -> str:
    """CTEs (recursive) from ed to rc (context, subjects, features): every path of edges, then those that no other holds."""
    return f"""pa AS (SELECT context, [i, j] AS subjects, features FROM ed UNION SELECT p.context, list_append(p.subjects, d.j), list_sort(list_intersect(p.features, d.features)) FROM pa p JOIN ed d ON d.context = p.context AND d.i = p.subjects[-1] WHERE len(list_intersect(p.features, d.features)) >= {features}),
pf AS MATERIALIZED (SELECT DISTINCT * FROM pa WHERE len(subjects) >= {subjects} AND len(features) >= {features}),
rc AS (SELECT * FROM pf x WHERE NOT EXISTS (SELECT 1 FROM pf y WHERE y.context = x.context AND (y.subjects <> x.subjects OR y.features <> x.features) AND list_has_all(y.subjects, x.subjects) AND list_has_all(y.features, x.features)))"""


def rectangle_cubes(contexts: int, subjects: int, features: int) -> str:
    """CTEs (recursive) from rc to cb (contexts, subjects, features): every chain of rectangles over rising contexts, then those that no other holds."""
    mask = lambda c: f"list_sum([CAST(1 AS BIGINT) << x FOR x IN {c}])"
    return f"""cs AS (SELECT [context] AS contexts, subjects, features FROM rc UNION SELECT list_append(s.contexts, r.context), list_sort(list_intersect(s.subjects, r.subjects)), list_sort(list_intersect(s.features, r.features)) FROM cs s JOIN rc r ON r.context > s.contexts[-1]
  WHERE len(list_intersect(s.subjects, r.subjects)) >= {subjects} AND len(list_intersect(s.features, r.features)) >= {features}),
cf AS MATERIALIZED (SELECT *, CAST({mask('contexts')} AS BIGINT) AS t, CAST({mask('subjects')} AS BIGINT) AS u, len(features) AS n FROM cs WHERE len(contexts) >= {contexts}),
cb AS (SELECT contexts, subjects, features FROM cf x WHERE NOT EXISTS (SELECT 1 FROM cf y WHERE y.t & x.t = x.t AND y.u & x.u = x.u AND y.n >= x.n AND (y.t <> x.t OR y.u <> x.u OR y.n > x.n) AND list_has_all(y.features, x.features)))"""


def boxes_in_order(share: float) -> str:
    """CTEs (recursive) from boxes bx (id, contexts, subjects, features) to kp (id): one box after the other goes if the others that are left cover it."""
    return f"""cl AS MATERIALIZED (SELECT id, (x, y, z) AS cell FROM (SELECT id, unnest(contexts) AS x, subjects, features FROM bx), unnest(subjects) AS u(y), unnest(features) AS v(z)),
ov AS (SELECT a.id, b.id AS other, list(a.cell) AS cells FROM cl a JOIN cl b ON a.cell = b.cell AND a.id <> b.id GROUP BY 1, 2),
ob AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS nth, (SELECT count(*) FROM cl WHERE cl.id = bx.id) AS n, coalesce((SELECT list({{'o': other, 'c': cells}}) FROM ov WHERE ov.id = bx.id), []) AS others FROM bx),
gn AS (SELECT CAST(0 AS BIGINT) AS nth, CAST([] AS BIGINT[]) AS gone UNION ALL SELECT ob.nth, CASE WHEN len(list_distinct(flatten([x.c FOR x IN others IF NOT list_contains(gone, x.o)]))) >= {share} * n THEN list_append(gone, ob.id) ELSE gone END FROM gn JOIN ob ON ob.nth = gn.nth + 1),
kp AS (SELECT id FROM bx WHERE NOT list_contains((SELECT arg_max(gone, nth) FROM gn), id))"""
