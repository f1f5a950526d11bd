"""Queries: outcome aggregates, rankings, windows and report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.operators import cohorts, outcomes
from wardlight.plans.registry import query
from wardlight.plans.tables import rounded
from wardlight.plans.views import e1, e2, table, with_views
from wardlight.session import stage

RATE = "100.0 * sum(CASE WHEN readmitted <> 'NO' THEN 1 ELSE 0 END) / count(*)"
URGENT = "100.0 * sum(CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END) / count(*)"


def rep1(spark, folder):
    return cohorts.repeated_keys(e1(spark, folder), "patient_nbr")


def rep2(spark, folder):
    return cohorts.repeated_keys(e2(spark, folder), "patient_nbr")


@query("outcome_counts", with_views("rep1", "SELECT nation, readmitted, count(*) AS n FROM rep1 GROUP BY 1, 2"))
def outcome_counts(spark, folder):
    return outcomes.outcome_counts(rep1(spark, folder), "nation")


@query("outcome_distribution", with_views("rep1", """
SELECT segment, readmitted, n, round(n * 1.0 / sum(n) OVER (PARTITION BY segment), 6) AS probability
FROM (SELECT segment, readmitted, count(*) AS n FROM rep1 GROUP BY 1, 2)"""))
def outcome_distribution(spark, folder):
    return rounded(outcomes.outcome_distribution(rep1(spark, folder), "segment"))


@query("outcome_pivot", with_views("rep1", """
, c AS (SELECT nation, count(*) AS n, count(*) FILTER (readmitted = '<30') AS a,
               count(*) FILTER (readmitted = '>30') AS b, count(*) FILTER (readmitted = 'NO') AS c
        FROM rep1 GROUP BY 1)
SELECT nation, a AS "n_<30", round_even(100.0 * a / n, 1) AS "pct_<30", b AS "n_>30",
       round_even(100.0 * b / n, 1) AS "pct_>30", c AS "n_NO", round_even(100.0 * c / n, 1) AS "pct_NO" FROM c"""))
def outcome_pivot(spark, folder):
    return outcomes.outcome_pivot(rep1(spark, folder), "nation")


@query("highest_rate", with_views("rep1", f"""
SELECT nation, round_even({RATE}, 1) AS outcome_rate FROM rep1 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"""))
def highest_rate(spark, folder):
    return outcomes.highest_rate(rep1(spark, folder), "nation")


@query("summary_by_outcome", with_views("rep2", """
SELECT readmitted, count(price) AS count, round_even(avg(price), 2) AS mean,
       round_even(quantile_cont(price, 0.5), 2) AS median, round_even(stddev_samp(price), 2) AS std,
       round_even(min(price), 2) AS min, round_even(max(price), 2) AS max
FROM rep2 GROUP BY 1"""))
def summary_by_outcome(spark, folder):
    # several passes follow, so the two columns are written once after the cohort join
    return outcomes.summary_by_outcome(stage(rep2(spark, folder).select("readmitted", "price")), "price")


@query("mean_by_outcome", with_views("rep2", """
SELECT readmitted, round_even(avg(quantity), 1) AS mean FROM rep2 GROUP BY 1"""))
def mean_by_outcome(spark, folder):
    return outcomes.mean_by_outcome(rep2(spark, folder), "quantity")


@query("outcome_shares", with_views("rep2", """
SELECT readmitted, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM rep2 GROUP BY 1"""))
def outcome_shares(spark, folder):
    return rounded(outcomes.outcome_shares(rep2(spark, folder)))


@query("key_insights", with_views("rep2", """
SELECT round(corr(quantity, price), 6) AS stay_procedures_corr, round(avg(discount), 6) AS mean_diagnoses,
       round(100.0 * (avg(tax) FILTER (readmitted = '<30') - avg(tax) FILTER (readmitted = 'NO'))
             / avg(tax) FILTER (readmitted = 'NO'), 6) AS lab_difference_pct
FROM rep2"""))
def key_insights(spark, folder):
    return rounded(outcomes.key_insights(rep2(spark, folder), "quantity", "price", "discount", "tax"))


@query("group_overview", with_views("rep1", f"""
, g AS (SELECT nation, count(*) AS n, {RATE} AS rate FROM rep1 GROUP BY 1)
SELECT (SELECT nation FROM g ORDER BY n DESC, nation LIMIT 1) AS top_group, max(n) AS top_count,
       round(100.0 * max(n) / (SELECT count(*) FROM rep1), 6) AS top_pct, count(*) AS groups,
       (SELECT round({RATE}, 6) FROM rep1) AS overall_rate,
       (SELECT nation FROM g WHERE n >= 50 ORDER BY rate DESC, nation LIMIT 1) AS riskiest_group,
       (SELECT round(max(rate), 6) FROM g WHERE n >= 50) AS riskiest_rate
FROM g"""))
def group_overview(spark, folder):
    return rounded(outcomes.group_overview(rep1(spark, folder), "nation"))


@query("group_drilldown", with_views("rep1", f"""
SELECT nation, count(*) AS cases, round({RATE}, 6) AS rate, round({URGENT}, 6) AS urgent_rate,
       round(avg(amount), 6) AS mean_stay, round(avg(balance), 6) AS mean_procedures,
       CASE WHEN {RATE} > 80 THEN 'High' WHEN {RATE} > 60 THEN 'Moderate' ELSE 'Lower' END AS level
FROM rep1 GROUP BY 1"""))
def group_drilldown(spark, folder):
    return rounded(outcomes.group_drilldown(rep1(spark, folder), "nation", "amount", "balance"))


RISK = f"""
, g AS (SELECT grp, count(*) AS cases, round_even({RATE}, 1) AS rate, round_even({URGENT}, 1) AS urgent_rate,
               round_even(avg(amount), 1) AS mean_stay, round_even(avg(balance), 1) AS mean_procedures
        FROM rep1 GROUP BY 1 HAVING count(*) >= 50),
s AS (SELECT *, round_even(rate * 0.4 + urgent_rate * 0.6, 1) AS risk_score FROM g)"""


@query("risk_ranking", with_views("rep1", RISK + """
SELECT *, (SELECT quantile_cont(rate, 0.5) FROM s) AS median_rate,
       (SELECT quantile_cont(urgent_rate, 0.5) FROM s) AS median_urgent_rate
FROM s ORDER BY risk_score DESC, grp LIMIT 10"""))
def risk_ranking(spark, folder):
    return outcomes.risk_ranking(rep1(spark, folder), "grp", "amount", "balance")


@query("risk_flags", with_views("rep1", RISK + """
SELECT flag, CAST(row_number() OVER (PARTITION BY flag ORDER BY risk_score DESC, grp) AS INTEGER) AS position, grp, value
FROM (SELECT 'high_rate' AS flag, grp, risk_score, rate AS value FROM s WHERE rate > 40
      UNION ALL SELECT 'urgent', grp, risk_score, urgent_rate FROM s WHERE urgent_rate > 20)
QUALIFY row_number() OVER (PARTITION BY flag ORDER BY risk_score DESC, grp) <= 5"""))
def risk_flags(spark, folder):
    return outcomes.risk_flags(rep1(spark, folder), "grp", "amount", "balance")


@query("status_usage", with_views("rep2", """
, u AS (SELECT 'Med A - ' || s AS medication, readmitted, 100.0 * count(*) FILTER (med_a = s) / count(med_a) AS r
        FROM rep2, (VALUES ('Up'), ('Down'), ('Steady')) v(s) GROUP BY s, readmitted
  UNION ALL SELECT 'Med B', readmitted, 100.0 * count(*) FILTER (med_b = 'Yes') / count(med_b) FROM rep2 GROUP BY readmitted
  UNION ALL SELECT 'Med C - Steady', readmitted, 100.0 * count(*) FILTER (med_c = 'Steady') / count(med_c) FROM rep2 GROUP BY readmitted)
SELECT medication, readmitted, round(r, 6) AS usage_rate FROM u WHERE r > 0"""))
def status_usage(spark, folder):
    return rounded(outcomes.status_usage(rep2(spark, folder), ["med_a", "med_b", "med_c"]))


@query("status_combinations", with_views("rep2", f"""
, b AS (SELECT med_a <> 'No' AS a, med_b = 'Yes' AS b, med_c <> 'No' AS c, readmitted FROM rep2),
t AS (SELECT a, b, c, count(*) AS n, {RATE} AS r FROM b GROUP BY 1, 2, 3 ORDER BY n DESC, a DESC, b DESC, c DESC LIMIT 10)
SELECT concat_ws(', ', CASE WHEN a THEN 'Med A' END, CASE WHEN b THEN 'Med B' END, CASE WHEN c THEN 'Med C' END) AS medications,
       n, round(100.0 * n / (SELECT count(*) FROM rep2), 6) AS pct, round(r, 6) AS outcome_rate
FROM t WHERE a OR b OR c"""))
def status_combinations(spark, folder):
    return rounded(outcomes.status_combinations(rep2(spark, folder), ["med_a", "med_b", "med_c"]))


@query("age_bins", with_views("rep2", """
SELECT CASE WHEN age <= 0 THEN NULL WHEN age <= 30 THEN '<30' WHEN age <= 40 THEN '30-39' WHEN age <= 50 THEN '40-49'
            WHEN age <= 60 THEN '50-59' WHEN age <= 70 THEN '60-69' WHEN age <= 80 THEN '70-79' WHEN age <= 100 THEN '80+' END AS age_group,
       readmitted, count(*) AS n
FROM rep2 WHERE age > 0 AND age <= 100 GROUP BY 1, 2"""))
def age_bins(spark, folder):
    return outcomes.age_groups(rep2(spark, folder))


@query("mean_score_by_value", """
WITH s AS (SELECT l_quantity AS quantity, l_discount AS discount,
       (l_quantity + CASE WHEN l_returnflag = 'R' THEN 10 ELSE 0 END) / 60.0 AS score FROM lineitem)
SELECT feature, value, count(*) AS n, round(avg(score), 6) AS mean_score
FROM (SELECT 'quantity' AS feature, quantity AS value, score FROM s UNION ALL SELECT 'discount', discount, score FROM s)
GROUP BY 1, 2""")
def mean_score_by_value(spark, folder):
    score = (F.col("l_quantity") + F.when(F.col("l_returnflag") == "R", 10).otherwise(0)) / 60.0
    scored = table(spark, folder, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), score.alias("score")
    )
    return rounded(outcomes.mean_score_by_value(scored, ["quantity", "discount"]))


@query("average_rank", with_views("e1", """
, s AS (SELECT nation AS feature, count(*) AS cases, count(DISTINCT patient_nbr) AS patients FROM e1 GROUP BY 1)
SELECT feature, cases, patients,
       ((rank() OVER (ORDER BY cases DESC) + (count(*) OVER (PARTITION BY cases) - 1) / 2.0)
        + (rank() OVER (ORDER BY patients DESC) + (count(*) OVER (PARTITION BY patients) - 1) / 2.0)) / 2 AS average_rank
FROM s"""))
def average_rank(spark, folder):
    scores = e1(spark, folder).groupBy(F.col("nation").alias("feature")).agg(
        F.count(F.lit(1)).alias("cases"), F.count_distinct("patient_nbr").alias("patients")
    )
    return outcomes.average_rank(scores, ["cases", "patients"], "feature")


@query("scale_by_max", with_views("e1", """
, s AS (SELECT nation AS feature, count(*) AS cases, avg(amount) AS amount FROM e1 GROUP BY 1)
SELECT feature, cases, round(amount, 6) AS amount, round(cases * 1.0 / max(cases) OVER (), 6) AS cases_norm,
       round(amount / max(amount) OVER (), 6) AS amount_norm FROM s"""))
def scale_by_max(spark, folder):
    scores = e1(spark, folder).groupBy(F.col("nation").alias("feature")).agg(
        F.count(F.lit(1)).alias("cases"), F.avg("amount").alias("amount")
    )
    return rounded(outcomes.scale_by_max(scores, ["cases", "amount"]))


@query("top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def top_k(spark, folder):
    return outcomes.top_k(table(spark, folder, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 20, "c_custkey", True)


@query("top_with_other", with_views("e1", """
, c AS (SELECT nation AS category, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, nation) AS r FROM e1 GROUP BY 1)
SELECT CASE WHEN r <= 9 THEN category ELSE 'Other' END AS category, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1"""))
def top_with_other(spark, folder):
    return outcomes.top_with_other(e1(spark, folder), "nation")


@query("cohort_contingency", with_views("cohorts", """
SELECT segment AS category, count(*) FILTER (cohort = 'all') AS "all", count(*) FILTER (cohort = 'first') AS first,
       count(*) FILTER (cohort = 'repeated') AS repeated FROM cohorts GROUP BY 1"""))
def cohort_contingency(spark, folder):
    tagged = cohorts.cohort_union(e1(spark, folder), "patient_nbr", "encounter_id")
    return outcomes.cohort_contingency(tagged, "segment")


CODE = "CASE readmitted WHEN 'NO' THEN 0.0 WHEN '>30' THEN 1.0 ELSE 2.0 END"


@query("outcome_correlation", with_views("rep2", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(corr({c}, {CODE})), 6) AS correlation FROM rep2"
    for c in ("age", "quantity", "price", "discount", "tax"))))
def outcome_correlation(spark, folder):
    return rounded(outcomes.outcome_correlation(rep2(spark, folder), ["age", "quantity", "price", "discount", "tax"]))


# ---- report tables ----

@query("export_summary", with_views("rep2", f"""
, s AS (SELECT count(DISTINCT patient_nbr) AS p, count(*) AS e, {RATE} AS r FROM rep2)
SELECT 'Total Repeated Patients' AS metric, CAST(p AS DOUBLE) AS value FROM s
UNION ALL SELECT 'Total Encounters', e FROM s UNION ALL SELECT 'Readmission Rate', round(r, 6) FROM s
UNION ALL SELECT 'Avg Encounters per Patient', round(e * 1.0 / p, 6) FROM s"""))
def export_summary(spark, folder):
    return rounded(outcomes.summary_long(cohorts.repeat_summary(e2(spark, folder), "patient_nbr")))


def _numeric_row(c: str) -> str:
    return (f"SELECT '{c}' AS feature, 'Numeric' AS type, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
            f"round(min({c}), 6) AS min, round(max({c}), 6) AS max, count(*) - count({c}) AS missing, "
            "CAST(NULL AS BIGINT) AS unique, CAST(NULL AS VARCHAR) AS mode FROM e1")


def _text_row(c: str) -> str:
    return (f"SELECT '{c}', 'Categorical', NULL, NULL, NULL, NULL, count(*) - count({c}), count(DISTINCT {c}), "
            f"(SELECT {c} FROM e1 GROUP BY 1 ORDER BY count(*) DESC, {c} LIMIT 1) FROM e1")


@query("feature_statistics", with_views("e1", " UNION ALL ".join(
    [_numeric_row(c) for c in ("amount", "balance")] + [_text_row(c) for c in ("grp", "segment", "nation")]
).replace("AS unique", 'AS "unique"')))
def feature_statistics(spark, folder):
    return rounded(outcomes.feature_statistics(e1(spark, folder), ["amount", "balance"], ["grp", "segment", "nation"]))


@query("cohort_report", with_views("cohorts", f"""
, c AS (SELECT cohort, count(*) AS n, {RATE} AS r, {URGENT} AS u,
        100.0 * sum(CASE WHEN readmitted = '>30' THEN 1 ELSE 0 END) / count(*) AS l FROM cohorts GROUP BY 1),
a AS (SELECT * FROM c WHERE cohort = 'all'), f AS (SELECT * FROM c WHERE cohort = 'first'),
p AS (SELECT * FROM c WHERE cohort = 'repeated')
SELECT 'total_encounters' AS metric, CAST(n AS DOUBLE) AS value FROM a
UNION ALL SELECT 'first_encounters', n FROM f UNION ALL SELECT 'repeated_encounters', n FROM p
UNION ALL SELECT 'numeric_features', 2 UNION ALL SELECT 'categorical_features', 3
UNION ALL SELECT 'overall_rate', round(r, 6) FROM a UNION ALL SELECT 'positive_rate', round(u, 6) FROM a
UNION ALL SELECT 'later_rate', round(l, 6) FROM a UNION ALL SELECT 'first_rate', round(r, 6) FROM f
UNION ALL SELECT 'repeated_rate', round(r, 6) FROM p
UNION ALL SELECT 'repeated_lift_pct', round(100.0 * (p.r - f.r) / f.r, 6) FROM p, f"""))
def cohort_report(spark, folder):
    return rounded(outcomes.cohort_report(e1(spark, folder), "patient_nbr", "encounter_id", 2, 3))
