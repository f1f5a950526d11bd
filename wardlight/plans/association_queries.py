"""Queries: correlation, hypothesis tests, cohort comparison."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from wardlight.operators import association, cohorts
from wardlight.plans.registry import query
from wardlight.plans.tables import rounded
from wardlight.plans.views import e1, e2, table, with_views

COLS = ["quantity", "price", "discount", "tax"]
RANKS = ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in COLS
)
RANKED = f", k AS (SELECT {RANKS} FROM e2)"


def _corr_rows(source: str, cols, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, count(*) AS n, round(corr({a}, {b}), 6) AS correlation{extra} FROM {source}"
        for a, b in combinations(cols, 2)
    )


@query("corr_pearson", with_views("e2", _corr_rows("e2", COLS)))
def corr_pearson(spark, folder):
    return rounded(association.corr_pearson(e2(spark, folder), COLS))


@query("corr_spearman", with_views("e2", RANKED + _corr_rows("k", COLS)))
def corr_spearman(spark, folder):
    return rounded(association.corr_spearman(e2(spark, folder), COLS))


KCOLS = ["quantity", "discount", "tax"]


def _kendall_sql(a: str, b: str, extra: str = "") -> str:
    """Pairs of distinct cells; only usable where the number of cells is small."""
    return f"""
SELECT '{a}' AS feature_a, '{b}' AS feature_b, (SELECT count(*) FROM e2) AS n, round((
  SELECT sum(CAST(p.w AS DOUBLE) * q.w * sign(p.x - q.x) * sign(p.y - q.y)) / 2
  FROM (SELECT {a} AS x, {b} AS y, count(*) AS w FROM e2 GROUP BY 1, 2) p,
       (SELECT {a} AS x, {b} AS y, count(*) AS w FROM e2 GROUP BY 1, 2) q)
  / sqrt((n0 - (SELECT sum(w * (w - 1) / 2) FROM (SELECT CAST(count(*) AS DOUBLE) AS w FROM e2 GROUP BY {a})))
       * (n0 - (SELECT sum(w * (w - 1) / 2) FROM (SELECT CAST(count(*) AS DOUBLE) AS w FROM e2 GROUP BY {b})))), 6) AS correlation{extra}
FROM (SELECT CAST(count(*) AS DOUBLE) * (count(*) - 1) / 2 AS n0 FROM e2)"""


@query("corr_kendall", with_views("e2", " UNION ALL ".join(_kendall_sql(a, b) for a, b in combinations(KCOLS, 2))))
def corr_kendall(spark, folder):
    return rounded(association.corr_kendall(e2(spark, folder), KCOLS))


@query("corr_compare", with_views("e2", RANKED + " UNION ALL ".join(
    [_corr_rows("e2", KCOLS, ", 'pearson' AS method"), _corr_rows("k", KCOLS, ", 'spearman' AS method")]
    + [_kendall_sql(a, b, ", 'kendall' AS method") for a, b in combinations(KCOLS, 2)])))
def corr_compare(spark, folder):
    return rounded(association.correlation_compare(e2(spark, folder), KCOLS))


@query("export_correlation", with_views("e2", " UNION ALL ".join(
    f"SELECT '{a}' AS feature, " + ", ".join("1.0::DOUBLE AS " + b if a == b else f"round(corr({a}, {b}), 6) AS {b}" for b in COLS) + " FROM e2"
    for a in COLS)))
def export_correlation(spark, folder):
    pairs = association.corr_pearson(e2(spark, folder), COLS)
    return rounded(association.correlation_matrix(pairs, COLS))


@query("strong_pairs", with_views("e2", f"""
SELECT * FROM ({_corr_rows("e2", COLS)}) WHERE abs(correlation) > 0.001 ORDER BY abs(correlation) DESC LIMIT 3"""))
def strong_pairs(spark, folder):
    return rounded(association.strong_pairs(association.corr_pearson(e2(spark, folder), COLS), 0.001, first=3))


# The p-value is checked through the t density integrated on an even grid (Simpson's rule).
@query("corr_pairs_test", with_views("e1", """
, c AS (SELECT 'amount' AS feature_a, 'balance' AS feature_b, count(*) AS n, corr(amount, balance) AS r FROM e1),
t AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c),
g AS (SELECT unnest(range(2001)) AS i),
s AS (SELECT feature_a, feature_b, n, r, sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi())
        * (1 + (t * i / 2000.0) ** 2 / (n - 2)) ** (-(n - 1) / 2.0)) * t / 6000.0 AS half FROM t, g GROUP BY feature_a, feature_b, n, r, t)
SELECT feature_a, feature_b, n, round(r, 6) AS correlation, round(1 - 2 * half, 6) AS p, 1 - 2 * half < 0.05 AS significant FROM s"""))
def corr_pairs_test(spark, folder):
    pairs = association.corr_pearson(e1(spark, folder), ["amount", "balance"])
    return rounded(association.correlation_test(pairs))


# The normal tail is integrated on an even grid (Simpson's rule).
NORMAL_TAIL = ("1 - 2 * abs(z) / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(2001), lambda i: "
               "(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * (z * i / 2000) ** 2)))")


def _tie_sums(c: str) -> str:
    return f"SELECT sum(w * (w - 1) / 2) AS one, sum(w * (w - 1) * (w - 2)) AS three, sum(w * (w - 1) * (2 * w + 5)) AS five FROM (SELECT CAST(count(*) AS DOUBLE) AS w FROM e2 GROUP BY {c})"


def _kendall_test_sql(a: str, b: str) -> str:
    return f"""
SELECT k.feature_a, k.feature_b, k.n, k.correlation, round({NORMAL_TAIL}, 6) AS p, {NORMAL_TAIL} < 0.05 AS significant
FROM (SELECT k.*, raw * sqrt((n0 - x.one) * (n0 - y.one))
        / sqrt((2 * n0 * (2 * n + 5) - x.five - y.five) / 18 + x.one * y.one / n0 + x.three * y.three / (18 * n0 * (n - 2))) AS z
      FROM (SELECT *, round(raw, 6) AS correlation, n::DOUBLE * (n - 1) / 2 AS n0 FROM ({_kendall_sql(a, b).replace(', 6) AS correlation', ', 15) AS raw')})) k,
        ({_tie_sums(a)}) x, ({_tie_sums(b)}) y) k"""


@query("corr_kendall_test", with_views("e2", " UNION ALL ".join(_kendall_test_sql(a, b) for a, b in combinations(KCOLS, 2))))
def corr_kendall_test(spark, folder):
    return rounded(association.kendall_test(e2(spark, folder), KCOLS))


# Mean balances by nation: 25 rows without ties. The orders with few inversions are counted value by value.
@query("kendall_exact", """
WITH RECURSIVE means AS (
  SELECT n_nationkey, avg(c_acctbal) AS customers, (SELECT avg(s_acctbal) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers
  FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey
), kept AS (SELECT * FROM means WHERE customers IS NOT NULL AND suppliers IS NOT NULL
), pairs AS (
  SELECT count(*) FILTER ((p.customers - q.customers) * (p.suppliers - q.suppliers) < 0) // 2 AS swaps, count(DISTINCT p.n_nationkey) AS n FROM kept p, kept q
), few AS (SELECT n, swaps, least(swaps, n * (n - 1) // 2 - swaps) AS few FROM pairs
), orders AS (
  SELECT n, swaps, few, 1 AS m, list_transform(range(0, few + 1), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS share FROM few
  UNION ALL
  SELECT n, swaps, few, m + 1, list_transform(range(0, few + 1), lambda j: list_sum(share[greatest(j - m, 0) + 1 : j + 1]) / (m + 1)) FROM orders WHERE m < n
)
SELECT 'customers' AS feature_a, 'suppliers' AS feature_b, n, round(1 - 4.0 * swaps / (n * (n - 1)), 6) AS correlation,
       round(least(1.0, 2 * list_sum(share)), 6) AS p, least(1.0, 2 * list_sum(share)) < 0.05 AS significant FROM orders WHERE m = n""")
def kendall_exact(spark, folder):
    """Mean balances of customers and suppliers by nation: exact p."""
    means = [
        table(spark, folder, t).groupBy(F.col(f"{t[0]}_nationkey").alias("nation")).agg(F.avg(f"{t[0]}_acctbal").alias(f"{t}s")) for t in ("customer", "supplier")
    ]
    return rounded(association.kendall_test(means[0].join(means[1], "nation"), ["customers", "suppliers"]))


@query("corr_spearman_test", with_views("e1", """
, k AS (SELECT rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0 AS a, rank() OVER (ORDER BY balance) + (count(*) OVER (PARTITION BY balance) - 1) / 2.0 AS b
        FROM e1 WHERE amount IS NOT NULL AND balance IS NOT NULL),
c AS (SELECT 'amount' AS feature_a, 'balance' AS feature_b, count(*) AS n, corr(a, b) AS r FROM k),
t AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c),
g AS (SELECT unnest(range(2001)) AS i),
s AS (SELECT feature_a, feature_b, n, r, sum((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
        * exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi())
        * (1 + (t * i / 2000.0) ** 2 / (n - 2)) ** (-(n - 1) / 2.0)) * t / 6000.0 AS half FROM t, g GROUP BY feature_a, feature_b, n, r, t)
SELECT feature_a, feature_b, n, round(r, 6) AS correlation, round(1 - 2 * half, 6) AS p, 1 - 2 * half < 0.05 AS significant FROM s"""))
def corr_spearman_test(spark, folder):
    return rounded(association.correlation_test(association.corr_spearman(e1(spark, folder), ["amount", "balance"])))


@query("linear_fit", with_views("e2", " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, 0.0 + round(regr_slope({b}, {a}), 6) AS slope, 0.0 + round(regr_intercept({b}, {a}), 6) AS intercept, "
    f"min({a}) AS from_x, max({a}) AS to_x FROM e2" for a, b in combinations(COLS, 2))))
def linear_fit(spark, folder):
    return rounded(association.linear_fit(e2(spark, folder), list(combinations(COLS, 2))))


@query("line_points", with_views("e2", """
, f AS (SELECT regr_slope(price, quantity) AS s, regr_intercept(price, quantity) AS i, min(quantity) AS a, max(quantity) AS b FROM e2)
SELECT 'quantity' AS feature_a, 'price' AS feature_b, CAST(p AS INTEGER) AS point, round(a + p * (b - a) / 99, 6) AS x,
       round(i + s * (a + p * (b - a) / 99), 6) AS y FROM f, (SELECT unnest(range(100)) AS p)"""))
def line_points(spark, folder):
    fit = association.linear_fit(e2(spark, folder), [("quantity", "price")])
    return rounded(association.line_points(fit))


def _moments(c: str) -> str:
    return f"SELECT '{c}' AS feature, readmitted, count({c}) AS n, avg({c}) AS mean, var_pop({c}) AS vp, var_samp({c}) AS vs FROM e2 GROUP BY 2"


MOMENTS = f", m AS ({' UNION ALL '.join(_moments(c) for c in COLS)})"


# Three groups: the tail of F(2, d) is (1 + 2 F / d) ** (-d / 2).
@query("anova", with_views("e2", MOMENTS + """
, a AS (SELECT *, sum(n * mean) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS grand FROM m),
s AS (SELECT feature, sum(n) - 3 AS d, (sum(n * (mean - grand) ** 2) / 2) / (sum(n * vp) / (sum(n) - 3)) AS f FROM a GROUP BY 1)
SELECT feature, round(f, 6) AS f_statistic, 2.0::DOUBLE AS dof_between, CAST(d AS DOUBLE) AS dof_within,
       round((1 + 2 * f / d) ** (-d / 2), 6) AS p, (1 + 2 * f / d) ** (-d / 2) < 0.05 AS significant FROM s"""))
def anova(spark, folder):
    return rounded(association.anova(e2(spark, folder), COLS))


def _chi_sql(col: str, by: str, source: str) -> str:
    return f"""
SELECT '{col}' AS feature, sum((coalesce(o, 0) - r * c / t) ** 2 / (r * c / t)) AS chi2, (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) AS dof,
       CAST(any_value(t) AS BIGINT) AS n, count(DISTINCT x) AS rows, count(DISTINCT y) AS cols
FROM (SELECT {col} AS x, count(*) * 1.0 AS r FROM {source} GROUP BY 1) a
CROSS JOIN (SELECT {by} AS y, count(*) * 1.0 AS c FROM {source} GROUP BY 1) b
CROSS JOIN (SELECT count(*) * 1.0 AS t FROM {source})
LEFT JOIN (SELECT {col} AS x, {by} AS y, count(*) AS o FROM {source} GROUP BY 1, 2) f USING (x, y)"""


# Even degrees of freedom: the chi-square tail is exp(-x/2) * sum (x/2)^k / k! for k < dof/2.
CHI_TAIL = "list_sum(list_transform(range(CAST(dof / 2 AS BIGINT)), lambda k: exp(-chi2 / 2 + k * ln(chi2 / 2) - lgamma(k + 1.0))))"


@query("chi_square", with_views("rep2", f"""
, s AS ({' UNION ALL '.join(_chi_sql(c, 'readmitted', 'e2') for c in ('med_a', 'med_b', 'med_c'))})
SELECT feature, round(chi2, 6) AS chi2, dof, round({CHI_TAIL}, 6) AS p, {CHI_TAIL} < 0.05 AS significant FROM s"""))
def chi_square(spark, folder):
    return rounded(association.chi_square(e2(spark, folder), ["med_a", "med_b", "med_c"]))


@query("cramers_v", with_views("e1", f"""
, s AS ({' UNION ALL '.join(_chi_sql(c, 'readmitted', 'e1') for c in ('grp', 'segment', 'nation'))}),
v AS (SELECT *, sqrt(chi2 / (n * (least(rows, cols) - 1))) AS v FROM s)
SELECT feature, round(chi2, 6) AS chi2, n, round(v, 6) AS v, CASE WHEN v > 0.5 THEN 'strong' WHEN v >= 0.3 THEN 'moderate'
       WHEN v >= 0.1 THEN 'weak' ELSE 'negligible' END AS strength FROM v"""))
def cramers_v(spark, folder):
    return rounded(association.cramers_v(e1(spark, folder), ["grp", "segment", "nation"]))


def _phi(x: str) -> str:
    """Normal distribution function by its series of odd powers."""
    return (f"CASE WHEN {x} > 8 THEN 1.0 WHEN {x} < -8 THEN 0.0 ELSE 0.5 + exp(-0.5 * ({x}) ** 2) / sqrt(2 * pi()) * sign({x}) * list_sum(list_transform(range(120), "
            f"lambda n: exp((2 * n + 1) * ln(abs({x}) + 1e-300) - lgamma(2 * n + 2.0) + n * ln(2.0) + lgamma(n + 1.0)))) END")


def _range_tail(q: str) -> str:
    """Tail of the studentized range of three groups with ``d`` degrees of freedom, by even sums over the spread u and the place z."""
    scale = "(1 + u / 4.0 / sqrt(2.0 * d))"
    density = f"exp(d / 2.0 * ln(d) - lgamma(d / 2.0) - (d / 2.0 - 1) * ln(2.0) + (d - 1) * ln({scale}) - d * {scale} ** 2 / 2) / 4.0 / sqrt(2.0 * d)"
    inner = f"exp(-z * z / 32.0) / sqrt(2 * pi()) * ({_phi('(z / 4.0)')} - {_phi(f'(z / 4.0 - {q} * {scale})')}) ** 2"
    return f"(1 - list_sum(list_transform(range(-32, 33), lambda u: {density} * 0.75 * list_sum(list_transform(range(-32, 33), lambda z: {inner})))))"


# The tail is summed for each pair; the 95 % point is halved out of 0 to 20.
@query("tukey_hsd", "WITH RECURSIVE" + with_views("e2", MOMENTS + f"""
, w AS (SELECT sum(n * vp) / (sum(n) - 3) AS mse, (sum(n) - 3)::DOUBLE AS d FROM m WHERE feature = 'quantity'
), pairs AS (
  SELECT a.readmitted AS group_a, b.readmitted AS group_b, b.mean - a.mean AS mean_diff, sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)) AS error, d
  FROM m a JOIN m b ON a.feature = b.feature AND a.readmitted < b.readmitted, w WHERE a.feature = 'quantity'
), tails AS (SELECT *, {_range_tail('(abs(mean_diff) / error)')} AS p FROM pairs
), point AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 20.0::DOUBLE AS high, d FROM w
  UNION ALL SELECT step + 1, CASE WHEN tail > 0.05 THEN (low + high) / 2 ELSE low END, CASE WHEN tail > 0.05 THEN high ELSE (low + high) / 2 END, d
  FROM (SELECT *, {_range_tail('((low + high) / 2)')} AS tail FROM point WHERE step < 40)
)
SELECT 'quantity' AS feature, group_a, group_b, round(mean_diff, 6) AS mean_diff, round(abs(mean_diff) / error, 6) AS q, round(p, 6) AS p,
       round(mean_diff - low * error, 6) AS lower, round(mean_diff + low * error, 6) AS upper, p < 0.05 AS reject
FROM tails, point WHERE step = 40""").removeprefix("WITH"))
def tukey_hsd(spark, folder):
    return rounded(association.tukey_hsd(e2(spark, folder), "quantity"))


@query("tukey_differences", with_views("e2", MOMENTS + """
, w AS (SELECT sum(n * vp) / (sum(n) - 3) AS mse FROM m WHERE feature = 'quantity')
SELECT a.readmitted AS group_a, b.readmitted AS group_b, round(b.mean - a.mean, 6) AS mean_diff,
       round(abs(b.mean - a.mean) / sqrt(mse / 2 * (1.0 / a.n + 1.0 / b.n)), 6) AS q
FROM m a JOIN m b ON a.feature = b.feature AND a.readmitted < b.readmitted, w WHERE a.feature = 'quantity'"""))
def tukey_differences(spark, folder):
    return rounded(association.tukey_hsd(e2(spark, folder), "quantity").select("group_a", "group_b", "mean_diff", "q"))


@query("mean_ci", with_views("e2", MOMENTS + """
SELECT feature, readmitted, n, round(mean, 6) AS mean, round(1.96 * sqrt(vs / n), 6) AS half_width,
       round(mean - 1.96 * sqrt(vs / n), 6) AS lower, round(mean + 1.96 * sqrt(vs / n), 6) AS upper FROM m"""))
def mean_ci(spark, folder):
    return rounded(association.mean_ci(e2(spark, folder), COLS))


# ---- cohorts ----


def tagged(spark, folder):
    return cohorts.cohort_union(e1(spark, folder), "patient_nbr", "encounter_id")


def flagged(spark, folder):
    """One row per encounter with its cohort flags."""
    return cohorts.cohort_flags(e1(spark, folder), "patient_nbr", "encounter_id")


@query("compare_numeric", with_views("cohorts", " UNION ALL ".join(f"""
SELECT cohort, '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
       round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3
FROM cohorts GROUP BY 1""" for c in ("amount", "balance"))))
def compare_numeric(spark, folder):
    return rounded(association.compare_numeric(flagged(spark, folder), ["amount", "balance"]))


@query("compare_categories", with_views("cohorts", " UNION ALL ".join(f"""
SELECT * FROM (SELECT cohort, '{c}' AS feature, {c} AS category, count(*) AS n,
       CAST(row_number() OVER (PARTITION BY cohort ORDER BY count(*) DESC, {c}) AS INTEGER) AS rank FROM cohorts GROUP BY 1, 3) WHERE rank <= 10"""
    for c in ("segment", "nation"))))
def compare_categories(spark, folder):
    return association.compare_categories(tagged(spark, folder), ["segment", "nation"])


KS_TAIL = ("CASE WHEN z < 1 THEN 1 - sqrt(2 * pi()) / z * list_sum(list_transform(range(1, 12), lambda k: exp(-((2 * k - 1) ** 2) * pi() ** 2 / (8 * z * z)))) "
           "ELSE 2 * list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0 * k * k * z * z))) END")


def _ks(c: str, a: str, b: str) -> str:
    return f"""
SELECT '{c}' AS feature, '{a}' AS cohort_a, '{b}' AS cohort_b, max(abs(fa - fb)) AS d, sqrt(any_value(na * nb / (na + nb))) AS scale
FROM (SELECT sum(ka) OVER (ORDER BY v) / sum(ka) OVER () AS fa, sum(kb) OVER (ORDER BY v) / sum(kb) OVER () AS fb,
             sum(ka) OVER () * 1.0 AS na, sum(kb) OVER () * 1.0 AS nb
      FROM (SELECT {c} AS v, count(*) FILTER (cohort = '{a}') * 1.0 AS ka, count(*) FILTER (cohort = '{b}') * 1.0 AS kb FROM cohorts GROUP BY 1))"""


@query("ks_two_sample", with_views("cohorts", f"""
, d AS ({' UNION ALL '.join(_ks(c, a, b) for c in ('amount', 'balance') for a, b in association.COHORT_PAIRS)}),
z AS (SELECT *, d * scale AS z FROM d)
SELECT feature, cohort_a, cohort_b, round(d, 6) AS statistic, CASE WHEN z <= 0.1 THEN 1.0 ELSE round({KS_TAIL}, 6) END AS p,
       CASE WHEN z <= 0.1 THEN false ELSE {KS_TAIL} < 0.05 END AS significant FROM z"""))
def ks_two_sample(spark, folder):
    return rounded(association.ks_two_sample(flagged(spark, folder), ["amount", "balance"], exact_up_to=0))


REGION_PAIRS = list(combinations(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"], 2))


# The exact p: shares of the lattice paths that have been far out, one diagonal after the other.
@query("ks_exact", f"""
WITH RECURSIVE v AS (
  SELECT r_name AS cohort, s_acctbal AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), pairs(cohort_a, cohort_b) AS (VALUES {', '.join(f"('{a}', '{b}')" for a, b in REGION_PAIRS)}
), steps AS (
  SELECT cohort_a, cohort_b, v, sum(a) OVER w AS fa, sum(b) OVER w AS fb, sum(a) OVER (PARTITION BY cohort_a, cohort_b) AS na, sum(b) OVER (PARTITION BY cohort_a, cohort_b) AS nb
  FROM (SELECT cohort_a, cohort_b, v, count(*) FILTER (cohort = cohort_a) AS a, count(*) FILTER (cohort = cohort_b) AS b FROM v, pairs WHERE cohort IN (cohort_a, cohort_b) GROUP BY 1, 2, 3)
  WINDOW w AS (PARTITION BY cohort_a, cohort_b ORDER BY v)
), d AS (
  SELECT cohort_a, cohort_b, max(na)::INT AS na, max(nb)::INT AS nb, max(abs(fa * nb - fb * na))::BIGINT AS far FROM steps GROUP BY 1, 2
), walk AS (
  SELECT cohort_a, cohort_b, na, nb, far, 0 AS s, [0.0::DOUBLE] AS share FROM d
  UNION ALL
  SELECT cohort_a, cohort_b, na, nb, far, s + 1, list_transform(range(0, na + 1), lambda i:
    CASE WHEN i > s + 1 OR s + 1 - i > nb THEN 0.0
         WHEN abs(i * nb - (s + 1 - i) * na) >= far THEN 1.0
         ELSE i::DOUBLE / (s + 1) * coalesce(CASE WHEN i > 0 THEN share[i] END, 0.0) + (s + 1 - i)::DOUBLE / (s + 1) * coalesce(share[i + 1], 0.0) END)
  FROM walk WHERE s < na + nb
)
SELECT 'balance' AS feature, cohort_a, cohort_b, round(far / (na * nb), 6) AS statistic, round(share[na + 1], 6) AS p, share[na + 1] < 0.05 AS significant
FROM walk WHERE s = na + nb""")
def ks_exact(spark, folder):
    """Supplier balances of every two regions: small samples, exact p."""
    supplier, nation, region = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    rows = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return rounded(association.ks_two_sample(rows.selectExpr("r_name AS cohort", "s_acctbal AS balance"), ["balance"], REGION_PAIRS))


# Three cohorts: two degrees of freedom, so the tail is exp(-H / 2).
@query("kruskal", with_views("cohorts", ", h AS (" + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, (12 / (any_value(t) * (any_value(t) + 1)) * sum(r * r / n) - 3 * (any_value(t) + 1)) / (1 - any_value(ties) / (any_value(t) ** 3 - any_value(t))) AS h
FROM (SELECT cohort, count(*) * 1.0 AS n, sum(rk) AS r, any_value(t) AS t, any_value(ties) AS ties
      FROM (SELECT cohort, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS rk, count(*) OVER () * 1.0 AS t,
                   (SELECT sum(k * k * k - k) FROM (SELECT count(*)::DOUBLE AS k FROM cohorts GROUP BY {c})) AS ties FROM cohorts) GROUP BY 1)"""
    for c in ("amount", "balance")) + ") SELECT feature, round(h, 6) AS statistic, round(exp(-h / 2), 6) AS p, exp(-h / 2) < 0.05 AS significant FROM h"))
def kruskal(spark, folder):
    return rounded(association.kruskal(flagged(spark, folder), ["amount", "balance"]))


@query("cohort_chi_square", with_views("cohorts", f"""
, s AS ({' UNION ALL '.join(_chi_sql(c, 'cohort', 'cohorts') for c in ('segment', 'nation', 'grp'))})
SELECT feature, round(chi2, 6) AS chi2, dof, round({CHI_TAIL}, 6) AS p, {CHI_TAIL} < 0.05 AS significant FROM s"""))
def cohort_chi_square(spark, folder):
    return rounded(association.cohort_chi_square(flagged(spark, folder), ["segment", "nation", "grp"]))


@query("cohens_d", with_views("cohorts", ", d AS (" + " UNION ALL ".join(f"""
SELECT '{c}' AS feature, '{a}' AS cohort_a, '{b}' AS cohort_b,
       (avg({c}) FILTER (cohort = '{a}') - avg({c}) FILTER (cohort = '{b}'))
       / sqrt((var_samp({c}) FILTER (cohort = '{a}') + var_samp({c}) FILTER (cohort = '{b}')) / 2) AS d FROM cohorts"""
    for c in ("amount", "balance") for a, b in association.COHORT_PAIRS) + """)
SELECT feature, cohort_a, cohort_b, round(d, 6) AS d, CASE WHEN abs(d) < 0.5 THEN 'Small' WHEN abs(d) < 0.8 THEN 'Medium' ELSE 'Large' END AS effect FROM d"""))
def cohens_d(spark, folder):
    return rounded(association.cohens_d(flagged(spark, folder), ["amount", "balance"]))
