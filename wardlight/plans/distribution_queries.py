"""Queries: distributions and normality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from wardlight.functions import scalars
from wardlight.operators import distributions
from wardlight.plans.outcome_queries import rep2
from wardlight.plans.registry import query
from wardlight.plans.tables import rounded
from wardlight.plans.views import e1, e2, e4, table, with_views

NUMERIC = ("price", "discount", "tax")


def _describe(c: str) -> str:
    d = f"({c} - m)"
    return f"""
SELECT '{c}' AS feature, count({c}) AS count, count(*) - count({c}) AS missing, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
       round(avg({d} ** 3) / (avg({d} ** 2) ** 1.5), 6) AS skewness, round(kurtosis_pop({c}), 6) AS kurtosis,
       round(quantile_cont({c}, 0.25), 6) AS q1, round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3
FROM e4, (SELECT avg({c}) AS m FROM e4)"""


@query("describe_numeric", with_views("e4", " UNION ALL ".join(_describe(c) for c in ("tax", "discount"))))
def describe_numeric(spark, folder):
    return rounded(distributions.describe_numeric(e4(spark, folder), ["tax", "discount"]))


def _entropy(c: str) -> str:
    return f"""
SELECT '{c}' AS feature, count(*) AS "unique", min(v) FILTER (n = top) AS mode, max(n) AS mode_count,
       CAST((SELECT count(*) - count({c}) FROM e4) AS BIGINT) AS missing,
       0.0 + round(-sum((n / tot) * log2(n / tot + 1e-10)), 6) AS entropy
FROM (SELECT {c} AS v, count(*) AS n, sum(count(*)) OVER () * 1.0 AS tot, max(count(*)) OVER () AS top
      FROM e4 WHERE {c} IS NOT NULL GROUP BY 1)"""


@query("describe_categorical", with_views("e4", " UNION ALL ".join(
    _entropy(c) for c in ("test_a", "test_b", "const_col", "rare_col"))))
def describe_categorical(spark, folder):
    return rounded(distributions.describe_categorical(e4(spark, folder), ["test_a", "test_b", "const_col", "rare_col"]))


@query("histogram", with_views("e2", """
, r AS (SELECT min(price) AS a, (max(price) - min(price)) / 30 AS w FROM e2),
h AS (SELECT readmitted, CAST(least(floor((price - a) / w), 29) AS INTEGER) AS bin, a, w, count(*) AS n FROM e2, r GROUP BY ALL)
SELECT readmitted, 'price' AS feature, bin, round(a + bin * w, 6) AS low, round(a + (bin + 1) * w, 6) AS high, n,
       round(n / (sum(n) OVER (PARTITION BY readmitted) * w), 12) AS density FROM h"""))
def histogram(spark, folder):
    df = distributions.histogram(e2(spark, folder), ["price"], 30, by=["readmitted"])
    return rounded(rounded(df, 6, "low", "high"), 12, "density")


def _choose(c: str) -> str:
    return f"""
SELECT '{c}' AS feature, (SELECT count({c}) FROM rep2) AS rows,
  (SELECT round(abs(avg(({c} - m) ** 3) / (avg(({c} - m) ** 2) ** 1.5)), 6) FROM rep2, (SELECT avg({c}) AS m FROM rep2)) AS skew,
  CAST(sum(CASE WHEN n > l AND n > r AND bin BETWEEN 1 AND 18 THEN 1 ELSE 0 END) AS BIGINT) AS peaks
FROM (SELECT bin, n, coalesce(lag(n) OVER (ORDER BY bin), 0) AS l, coalesce(lead(n) OVER (ORDER BY bin), 0) AS r
  FROM (SELECT g.bin, count({c}) AS n FROM (SELECT unnest(range(20)) AS bin) g
    LEFT JOIN (SELECT {c}, least(floor(({c} - a) / w), 19) AS bin
               FROM rep2, (SELECT min({c}) AS a, (max({c}) - min({c})) / 20 AS w FROM rep2)) h ON h.bin = g.bin GROUP BY 1))"""


@query("choose_view", with_views("rep2", f"""
, c AS ({" UNION ALL ".join(_choose(c) for c in NUMERIC)})
SELECT *, CASE WHEN rows < 100 THEN 'boxplot' WHEN skew > 1.0 THEN 'distribution' WHEN peaks > 1 THEN 'distribution' ELSE 'boxplot' END AS view
FROM c"""))
def choose_view(spark, folder):
    return rounded(distributions.choose_view(rep2(spark, folder), list(NUMERIC)))


@query("box_stats", with_views("e1", """
, q AS (SELECT readmitted, quantile_cont(amount, 0.25) AS q1, quantile_cont(amount, 0.5) AS median, quantile_cont(amount, 0.75) AS q3
        FROM e1 GROUP BY 1),
f AS (SELECT e1.readmitted, amount, q1, median, q3, amount BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
      FROM e1 JOIN q ON e1.readmitted = q.readmitted)
SELECT readmitted, 'amount' AS feature, count(*) AS n, round(min(amount), 6) AS min,
       round(min(amount) FILTER (inside), 6) AS whisker_low, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
       round(any_value(q3), 6) AS q3, round(max(amount) FILTER (inside), 6) AS whisker_high, round(max(amount), 6) AS max,
       count(*) FILTER (NOT inside) AS outliers
FROM f GROUP BY 1"""))
def box_stats(spark, folder):
    return rounded(distributions.box_stats(e1(spark, folder), ["amount"], by=["readmitted"]))


@query("kde", with_views("e2", """
, r AS (SELECT min(quantity) AS a, (max(quantity) - min(quantity)) / 199 AS w FROM e2),
s AS (SELECT readmitted, count(*) AS rows, stddev_samp(quantity) * count(*) ** (-0.2) AS h FROM e2 GROUP BY 1),
v AS (SELECT readmitted, quantity, count(*) AS n FROM e2 GROUP BY 1, 2)
SELECT v.readmitted, CAST(p AS INTEGER) AS point, round(a + p * w, 6) AS x,
       round(sum(n * exp(-0.5 * ((a + p * w - quantity) / h) ** 2) / (rows * h * sqrt(2 * pi()))), 9) AS density
FROM v JOIN s ON s.readmitted = v.readmitted, r, (SELECT unnest(range(200)) AS p) GROUP BY v.readmitted, p, a, w"""))
def kde(spark, folder):
    df = distributions.kde(e2(spark, folder), "quantity", 200, by=["readmitted"])
    return rounded(rounded(df, 6, "x"), 9, "density")


def _horner(x: str, coefficients) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + ({c!r})::DOUBLE)"
    return text


def _quantile_sql(p: str) -> str:
    """The inverse normal distribution by the same published approximation."""
    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    a, b, c, d = scalars._ACKLAM_A, scalars._ACKLAM_B, scalars._ACKLAM_C, scalars._ACKLAM_D
    return (
        f"CASE WHEN {p} < 0.02425 THEN {_horner(low, c)} / {_horner(low, d)} "
        f"WHEN {p} > 0.97575 THEN -{_horner(high, c)} / {_horner(high, d)} "
        f"ELSE {_horner(f'({mid} * {mid})', a)} * {mid} / {_horner(f'({mid} * {mid})', b)} END"
    )


@query("qq_points", with_views("e1", f"""
, r AS (SELECT row_number() OVER (ORDER BY amount) AS position, amount AS sample, (row_number() OVER (ORDER BY amount) - 0.5::DOUBLE) / count(*) OVER () AS p FROM e1)
SELECT position, round({_quantile_sql('p')}, 6) AS theoretical, sample FROM r"""))
def qq_points(spark, folder):
    return rounded(distributions.qq_points(e1(spark, folder), "amount"), 6, "theoretical")


@query("qq_line", with_views("e1", f"""
, s AS (SELECT 0.5::DOUBLE / count(amount) AS p, avg(amount) AS m, stddev_samp(amount) AS d FROM e1), q AS (SELECT m, d, {_quantile_sql('p')} AS z FROM s)
SELECT round(z, 6) AS from_x, round(m + d * z, 4) AS from_y, round(-z, 6) AS to_x, round(m - d * z, 4) AS to_y FROM q"""))
def qq_line(spark, folder):
    return rounded(rounded(distributions.qq_line(e1(spark, folder), "amount"), 6, "from_x", "to_x"), 4, "from_y", "to_y")


def balances(spark, folder):
    """Account balances of customers and suppliers and part prices as features of one long table."""
    parts = [("customer", "c_acctbal"), ("supplier", "s_acctbal"), ("part", "p_retailprice")]
    frames = [table(spark, folder, t).select(F.col(c).alias(c)) for t, c in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), [c for _, c in parts]


def _shapiro(c: str, source: str = "e1") -> str:
    last = _horner("u", distributions._ROYSTON_LAST) + " * u"
    second = _horner("u", distributions._ROYSTON_NEXT) + " * u"
    return f"""
SELECT '{c}' AS feature, n AS rows, pow((mx - m1 * o1 - m2 * o2) / sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) + a1 * o1 + a2 * o2, 2) / ss AS w
FROM (SELECT *, {last} + m1 / sqrt(mm) AS a1, {second} + m2 / sqrt(mm) AS a2 FROM (
  SELECT max(n) AS n, 1 / sqrt(max(n)) AS u, sum(m * m) AS mm, sum(m * x) AS mx, var_pop(x) * max(n) AS ss,
         max(m) FILTER (i = n) AS m1, max(m) FILTER (i = n - 1) AS m2,
         max(x) FILTER (i = n) - max(x) FILTER (i = 1) AS o1, max(x) FILTER (i = n - 1) - max(x) FILTER (i = 2) AS o2
  FROM (SELECT i, n, x, {_quantile_sql('p')} AS m FROM (
    SELECT row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n, {c} AS x,
           (row_number() OVER (ORDER BY {c}) - 0.375::DOUBLE) / (count(*) OVER () + 0.25::DOUBLE) AS p FROM {source}))))"""


@query("shapiro_statistic", with_views("e1", f"""
SELECT feature, rows, round(w, 7) AS w, rows < 5000 AS p_valid FROM ({' UNION ALL '.join(_shapiro(c) for c in ('amount', 'balance'))})"""))
def shapiro_statistic(spark, folder):
    """W of 15,000 values at the smallest bench scale; p has no closed form in SQL."""
    tested = distributions.shapiro_wilk(e1(spark, folder), ["amount", "balance"])
    return rounded(tested.select("feature", "rows", "w", "p_valid"), 7, "w")


# Royston's normalising transformation; the tail is that of the normal by its series of odd powers.
@query("shapiro_wilk", f"""
WITH w AS ({' UNION ALL '.join(_shapiro(c, t) for t, c in (("customer", "c_acctbal"), ("supplier", "s_acctbal"), ("part", "p_retailprice")))}
), y AS (
  SELECT *, ln(1 - w) AS v, ln(rows) AS s, -2.273 + 0.459 * rows AS g FROM w
), z AS (
  SELECT *, CASE WHEN rows > 11 THEN (v - (-1.5861 - 0.31082 * s - 0.083751 * s ** 2 + 0.0038915 * s ** 3)) / exp(-0.4803 - 0.082676 * s + 0.0030302 * s ** 2)
                 WHEN g <= v THEN 99.0
                 ELSE (-ln(g - v) - (0.5440 - 0.39978 * rows + 0.025054 * rows ** 2 - 6.714e-4 * rows ** 3))
                      / exp(1.3822 - 0.77857 * rows + 0.062767 * rows ** 2 - 0.0020322 * rows ** 3) END AS z
  FROM y
), t AS (
  SELECT *, CASE WHEN z > 7 THEN 0.0 ELSE 0.5 - sign(z) * exp(-z * z / 2) / sqrt(2 * pi())
    * list_sum(list_transform(range(120), lambda k: exp((2 * k + 1) * ln(abs(z)) - lgamma(2.0 * k + 2) + k * ln(2.0) + lgamma(k + 1.0)))) END AS p
  FROM z
)
SELECT feature, rows, round(w, 6) AS w, round(p, 6) AS p, p > 0.05 AS normal, rows < 5000 AS p_valid FROM t""")
def shapiro_wilk(spark, folder):
    df, cols = balances(spark, folder)
    return rounded(distributions.shapiro_wilk(df, cols))


def _anderson(c: str) -> str:
    """The normal distribution function by its power series in odd powers over double factorials."""
    series = ("list_sum(list_transform(range(120), lambda k: exp((2 * k + 1) * ln(abs(z)) - lgamma(2.0 * k + 2) + k * ln(2.0) + lgamma(k + 1.0))))")
    return f"""
SELECT '{c}' AS feature, max(i) AS rows, -max(i) - sum((2 * i - 1) * ln(f) + (2 * (n - i) + 1) * ln(1 - f)) / max(i) AS statistic
FROM (SELECT i, n, 0.5 + sign(z) * exp(-z * z / 2) / sqrt(2 * pi()) * {series} AS f
      FROM (SELECT row_number() OVER (ORDER BY {c}) AS i, count(*) OVER () AS n, ({c} - m) / s AS z
            FROM e1, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM e1)))"""


@query("anderson_darling", with_views("e1", f"""
, a AS ({' UNION ALL '.join(_anderson(c) for c in ('amount', 'balance'))}),
c AS (SELECT *, round_even(0.787 / (1 + 4.0 / rows - 25.0 / (rows * rows)), 3)::DOUBLE AS critical_5pct FROM a)
SELECT feature, rows, round(statistic, 4) AS statistic, critical_5pct, statistic < critical_5pct AS normal FROM c"""))
def anderson_darling(spark, folder):
    return rounded(distributions.anderson_darling(e1(spark, folder), ["amount", "balance"]), 4, "statistic")
