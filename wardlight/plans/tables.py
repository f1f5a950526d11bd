"""Queries: scans, cleaning, lookups, cohorts and data quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wardlight.operators import clean, cohorts, lookup, quality
from wardlight.functions import scalars
from wardlight.plans.registry import query
from wardlight.plans.views import e1, e2, e3, e4, e5, e6, table, with_views
from wardlight.session import scratch_path
from wardlight.sources.readers import read_code_dictionary, read_model_table
from wardlight.sources.sinks import write_csv


def rounded(df, digits=6, *cols):
    """Round the double columns (or the named ones) so that two engines print the same."""
    names = cols or [f.name for f in df.schema if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


# ---- sources ----

@query("scan_encounters", with_views("e1", "SELECT * FROM e1"))
def scan_encounters(spark, folder):
    return e1(spark, folder)


@query("scan_model_table", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders")
def scan_model_table(spark, folder):
    return read_model_table(spark, f"{folder}/orders.parquet", drop=["Unnamed: 0", "o_orderpriority"])


# ---- cleaning ----

@query("drop_sparse", with_views("e4", """
SELECT patient_nbr, tax, discount, test_b, const_col, rare_col FROM e4"""))
def drop_sparse(spark, folder):
    return clean.drop_sparse(e4(spark, folder), 0.6)


@query("drop_low_variance", with_views("e4", """
SELECT patient_nbr, tax, discount, test_a, test_b FROM e4"""))
def drop_low_variance(spark, folder):
    return clean.drop_low_variance(e4(spark, folder), ["patient_nbr"])


@query("fill_category", with_views("e4", """
SELECT patient_nbr, coalesce(test_a, 'Not Measured') AS test_a, coalesce(test_b, 'missing') AS test_b FROM e4"""))
def fill_category(spark, folder):
    df = e4(spark, folder).select("patient_nbr", "test_a", "test_b")
    return clean.fill_category(df, {"test_a": "Not Measured", "test_b": "missing"})


@query("impute", with_views("e4", """
, m AS (SELECT quantile_cont(tax, 0.5) AS tax, quantile_cont(discount, 0.5) AS discount FROM e4),
a AS (SELECT test_a FROM e4 WHERE test_a IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, test_a LIMIT 1),
b AS (SELECT test_b FROM e4 WHERE test_b IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, test_b LIMIT 1)
SELECT patient_nbr, coalesce(e4.tax, m.tax) AS tax, coalesce(e4.discount, m.discount) AS discount,
       coalesce(e4.test_a, a.test_a) AS test_a, coalesce(e4.test_b, b.test_b) AS test_b, const_col, rare_col
FROM e4, m, a, b"""))
def impute(spark, folder):
    return clean.impute(e4(spark, folder))


@query("drop_null_rows", with_views("e4", """
SELECT * FROM e4 WHERE tax IS NOT NULL AND discount IS NOT NULL AND test_a IS NOT NULL AND test_b IS NOT NULL"""))
def drop_null_rows(spark, folder):
    return clean.drop_null_rows(e4(spark, folder))


@query("filter_outcome", with_views("e1", "SELECT * FROM e1 WHERE readmitted IN ('<30', '>30')"))
def filter_outcome(spark, folder):
    return clean.filter_in(e1(spark, folder), "readmitted", ["<30", ">30"])


def _status_sql(view: str, columns: tuple[str, ...]) -> str:
    """Text columns by name, or by few distinct values with a status word among them."""
    words = ", ".join(f"'{w}'" for w in clean.STATUS_VALUES)
    named = " OR ".join(f"contains('{{0}}', '{k}')" for k in clean.STATUS_KEYWORDS)
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\" FROM {view} HAVING {named.format(c)} OR (count(DISTINCT {c}) <= 5 AND count(*) FILTER ({c} IN ({words})) > 0)" for c in columns
    )


@query("detect_status_columns", with_views("e2 e4", f"""
{_status_sql("e2", ("med_a", "med_b", "med_c"))}
UNION ALL {_status_sql("e4", ("test_a", "test_b", "const_col", "rare_col"))}"""))
def detect_status_columns(spark, folder):
    found = clean.detect_status_columns(e2(spark, folder)) + clean.detect_status_columns(e4(spark, folder))
    return spark.createDataFrame([(c,) for c in found], "column string")


@query("sample_rows", with_views("e1", """
SELECT * FROM e1 ORDER BY md5(concat(CAST(encounter_id AS VARCHAR), '42')), encounter_id LIMIT 500"""))
def sample_rows(spark, folder):
    return clean.sample_rows(e1(spark, folder), 500, 42, "encounter_id")


@query("most_missing", with_views("e4", """
SELECT unnest(['tax', 'discount', 'test_a', 'test_b', 'const_col', 'rare_col']) AS "column",
       unnest([count(*) - count(tax), count(*) - count(discount), count(*) - count(test_a), count(*) - count(test_b),
               count(*) - count(const_col), count(*) - count(rare_col)]) AS missing
FROM e4 ORDER BY 2 DESC LIMIT 3"""))
def most_missing(spark, folder):
    df = e4(spark, folder)
    keep = clean.drop_if_present(df, ["patient_nbr"])
    names = quality.most_missing_columns(keep, 3)
    return quality.completeness(keep.select(names)).select("column", "missing")


@query("outcome_flag", with_views("e1", """
SELECT encounter_id, CASE WHEN readmitted = '<30' THEN 1 ELSE 0 END AS label FROM e1"""))
def outcome_flag(spark, folder):
    return e1(spark, folder).select("encounter_id", scalars.outcome_flag(F.col("readmitted")).alias("label"))


@query("labels_format", with_views("e1", """
SELECT encounter_id, CASE WHEN length(nation || ' ' || grp) > 20 THEN substr(nation || ' ' || grp, 1, 20) || '...'
         ELSE nation || ' ' || grp END AS short_label,
       concat_ws(', ', nation, segment) AS joined,
       array_to_string(list_transform(string_split('order_' || lower(segment), '_'),
             lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title
FROM e1"""))
def labels_format(spark, folder):
    nation, grp, segment = F.col("nation"), F.col("grp"), F.col("segment")
    return e1(spark, folder).select(
        "encounter_id",
        scalars.truncate_label(F.concat(nation, F.lit(" "), grp)).alias("short_label"),
        scalars.join_labels([nation, segment]).alias("joined"),
        scalars.label_text(F.concat(F.lit("order_"), F.lower(segment))).alias("title"),
    )


# ---- lookups ----

@query("lookup_decode", with_views("e6", """
SELECT s_suppkey, n_regionkey AS region_id, s_nationkey AS nation_id, r.description AS region_name, n.description AS nation_name
FROM supplier JOIN nation ON s_nationkey = n_nationkey
LEFT JOIN e6 r ON r.Type = 'region' AND r.ID = n_regionkey
LEFT JOIN e6 n ON n.Type = 'nation' AND n.ID = s_nationkey"""))
def lookup_decode(spark, folder):
    supplier, nation = table(spark, folder, "supplier"), table(spark, folder, "nation")
    rows = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        "s_suppkey", F.col("n_regionkey").alias("region_id"), F.col("s_nationkey").alias("nation_id")
    )
    codes = e6(spark, folder)
    named = lookup.decode(lookup.decode(rows, "region_id", codes, "region"), "nation_id", codes, "nation")
    return named.select("s_suppkey", "region_id", "nation_id", "region_name", "nation_name")


def _chapter_case() -> str:
    arms = " ".join(
        f"WHEN TRY_CAST(code AS DOUBLE) BETWEEN {r.low} AND {r.high} THEN '{r.label}'" for r in lookup.ICD9_RANGES
    )
    letters = " ".join(f"WHEN starts_with(code, '{p}') THEN '{t}'" for p, t in lookup.ICD9_PREFIXES.items())
    return f"CASE {letters} {arms} ELSE 'Unknown' END"


@query("code_chapters", with_views("e5", f"SELECT id, code, {_chapter_case()} AS code_category FROM e5"))
def code_chapters(spark, folder):
    return lookup.map_code_ranges(e5(spark, folder), "code")


@query("top_patient_rows", with_views("e1", """
SELECT * FROM e1 WHERE patient_nbr IN
  (SELECT patient_nbr FROM e1 GROUP BY 1 ORDER BY count(*) DESC, patient_nbr LIMIT 50)"""))
def top_patient_rows(spark, folder):
    df = e1(spark, folder)
    return lookup.rows_for_keys(df, cohorts.top_keys(df, "patient_nbr", 50), "patient_nbr").select(df.columns)


# ---- cohorts ----

@query("first_encounter", with_views("e1", """
SELECT * FROM e1 QUALIFY row_number() OVER (PARTITION BY patient_nbr ORDER BY encounter_id) = 1"""))
def first_encounter(spark, folder):
    return cohorts.first_per_key(e1(spark, folder), "patient_nbr", "encounter_id")


@query("repeated_patients", with_views("rep2", "SELECT * FROM rep2"))
def repeated_patients(spark, folder):
    return cohorts.repeated_keys(e2(spark, folder), "patient_nbr")


@query("top_patients", with_views("e1", """
SELECT patient_nbr, count(*) AS n FROM e1 GROUP BY 1 ORDER BY n DESC, patient_nbr LIMIT 50"""))
def top_patients(spark, folder):
    return cohorts.top_keys(e1(spark, folder), "patient_nbr", 50)


@query("timeline", with_views("e3", """
SELECT patient_nbr, encounter_id, status, row_number() OVER (PARTITION BY patient_nbr ORDER BY encounter_id) AS ordinal
FROM e3"""))
def timeline(spark, folder):
    df = e3(spark, folder).select("patient_nbr", "encounter_id", "status")
    return cohorts.timeline(df, "patient_nbr", "encounter_id")


@query("patient_outcome_rate", with_views("e1", """
SELECT patient_nbr, count(*) AS encounters,
       round(100.0 * sum(CASE WHEN readmitted <> 'NO' THEN 1 ELSE 0 END) / count(*), 6) AS outcome_rate
FROM e1 GROUP BY 1"""))
def patient_outcome_rate(spark, folder):
    return rounded(cohorts.key_outcome_rate(e1(spark, folder), "patient_nbr"))


@query("repeat_summary", with_views("rep2", """
SELECT count(DISTINCT patient_nbr) AS patients, count(*) AS encounters,
       round(count(*) * 1.0 / count(DISTINCT patient_nbr), 6) AS mean_encounters,
       round(100.0 * sum(CASE WHEN readmitted <> 'NO' THEN 1 ELSE 0 END) / count(*), 6) AS outcome_rate,
       CAST(10 AS BIGINT) AS features
FROM rep2"""))
def repeat_summary(spark, folder):
    return rounded(cohorts.repeat_summary(e2(spark, folder), "patient_nbr"))


@query("cohort_union", with_views("cohorts", "SELECT * FROM cohorts"))
def cohort_union(spark, folder):
    return cohorts.cohort_union(e1(spark, folder), "patient_nbr", "encounter_id")


# ---- data quality ----

_E4_COLS = ["patient_nbr", "tax", "discount", "test_a", "test_b", "const_col", "rare_col"]
_E4_COUNTS = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS present, count(*) AS n FROM e4" for c in _E4_COLS)


@query("completeness", with_views("e4", f"""
SELECT "column", present AS records_present, n - present AS missing, round(present * 1.0 / n, 6) AS completeness
FROM ({_E4_COUNTS})"""))
def completeness(spark, folder):
    return rounded(quality.completeness(e4(spark, folder)))


@query("table_quality", with_views("e4", f"""
SELECT CAST(max(n) AS BIGINT) AS rows, count(*) AS columns, CAST(sum(n - present) AS BIGINT) AS missing_cells,
       round(100.0 * sum(n - present) / (max(n) * 7), 6) AS missing_pct,
       CAST(sum(CASE WHEN n > present THEN 1 ELSE 0 END) AS BIGINT) AS columns_with_missing
FROM ({_E4_COUNTS})"""))
def table_quality(spark, folder):
    return rounded(quality.table_quality(e4(spark, folder)))


@query("top_missing", with_views("e4", f"""
SELECT "column", round(100.0 * (n - present) / n, 6) AS missing_pct, n - present AS missing_count
FROM ({_E4_COUNTS}) ORDER BY 2 DESC, 1 LIMIT 5"""))
def top_missing(spark, folder):
    return rounded(quality.top_missing(e4(spark, folder), 5))


_GAPS = ["tax", "discount", "test_a", "test_b"]
_NULL_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
    f"corr(CASE WHEN {a} IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN {b} IS NULL THEN 1.0 ELSE 0.0 END) AS r FROM e4"
    for j, a in enumerate(_GAPS)
    for b in _GAPS[:j]
)


@query("missing_correlation", with_views("e4", f"""
SELECT column_a, column_b, round(r, 6) AS correlation FROM ({_NULL_PAIRS})"""))
def missing_correlation(spark, folder):
    return rounded(quality.missing_correlation(e4(spark, folder), ["patient_nbr"]))


@query("presence_matrix", with_views("e4", """
SELECT patient_nbr, CAST(tax IS NOT NULL AS INTEGER) AS has_tax, CAST(discount IS NOT NULL AS INTEGER) AS has_discount,
       CAST(test_a IS NOT NULL AS INTEGER) AS has_test_a, CAST(test_b IS NOT NULL AS INTEGER) AS has_test_b,
       CAST(tax IS NOT NULL AS INTEGER) + CAST(discount IS NOT NULL AS INTEGER)
       + CAST(test_a IS NOT NULL AS INTEGER) + CAST(test_b IS NOT NULL AS INTEGER) AS present
FROM e4"""))
def presence_matrix(spark, folder):
    return quality.presence_matrix(e4(spark, folder), _GAPS, key="patient_nbr")


# The pair with the smallest mean distance merges, the first one on ties; merged groups go to the end.
@query("missing_linkage", "WITH RECURSIVE" + with_views("e4", f"""
, gaps AS ({' UNION ALL '.join(f"SELECT '{a}|{b}' AS pair, 1 - abs(coalesce(corr(({a} IS NULL)::INT, ({b} IS NULL)::INT), 0)) AS gap FROM e4" for a in _GAPS for b in _GAPS if a != b)}
), known AS (SELECT map(list(pair), list(gap)) AS gap FROM gaps
), merges AS (
  SELECT 0 AS step, [{', '.join(f"['{c}']" for c in _GAPS)}] AS groups, NULL::STRUCT(distance DOUBLE, i BIGINT, j BIGINT) AS best, NULL::VARCHAR[][] AS before FROM known
  UNION ALL
  SELECT step + 1, list_append(list_filter(groups, lambda g, i: i <> best.i AND i <> best.j), list_concat(groups[best.i], groups[best.j])), best, groups
  FROM (SELECT step, groups, list_sort(flatten(list_transform(range(1, len(groups)), lambda i: list_transform(range(i + 1, len(groups) + 1), lambda j:
          {{'distance': list_avg(flatten(list_transform(groups[i], lambda a: list_transform(groups[j], lambda b: gap[concat(a, '|', b)])))), 'i': i, 'j': j}}))))[1] AS best
        FROM merges, known WHERE len(groups) > 1)
)
SELECT step, array_to_string(before[best.i], '+') AS left, array_to_string(before[best.j], '+') AS right, round(best.distance, 6) AS distance,
       (len(before[best.i]) + len(before[best.j]))::INTEGER AS size
FROM merges WHERE step > 0""").removeprefix("WITH"))
def missing_linkage(spark, folder):
    return rounded(quality.missing_linkage(e4(spark, folder), ["patient_nbr"]))


# Every way to part the columns in two, by its inertia from the joint null counts.
@query("missing_clusters", with_views("e4", f"""
, joint AS ({' UNION ALL '.join(f"SELECT {i} AS a, {j} AS b, count(*) FILTER ({a} IS NULL AND {b} IS NULL) AS n FROM e4" for i, a in enumerate(sorted(_GAPS)) for j, b in enumerate(sorted(_GAPS)))}
), parts AS (SELECT unnest(range(1, {2 ** (len(_GAPS) - 1)})) * 2 AS part
), sides AS (SELECT part, (part >> a) & 1 AS side, sum(n) AS n, count(DISTINCT a) AS size FROM parts, joint WHERE (part >> a) & 1 = (part >> b) & 1 GROUP BY ALL
), best AS (SELECT arg_min(part, inertia) AS part FROM (SELECT part, -sum(n / size) AS inertia FROM sides GROUP BY part))
SELECT [{', '.join(f"'{c}'" for c in sorted(_GAPS))}][a + 1] AS column, ((part >> a) & 1)::INTEGER AS cluster, round(100.0 * n / (SELECT count(*) FROM e4), 6) AS missing_pct
FROM joint, best WHERE a = b"""))
def missing_clusters(spark, folder):
    return rounded(quality.missing_clusters(e4(spark, folder), 2, ["patient_nbr"]))


_E4_VALUES = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM e4 GROUP BY 2" for c in _E4_COLS[1:]
)


@query("low_variance", with_views("e4", f"""
, v AS ({_E4_VALUES}), t AS (SELECT feature, max(n) AS top, sum(n) AS n, count(*) AS k FROM v GROUP BY 1)
SELECT t.feature, CASE WHEN k = 1 THEN 'Zero Variance' ELSE 'Near-Zero Variance' END AS type,
       v.value AS dominant_value, round(100.0 * top / t.n, 6) AS dominant_pct, k AS unique_values
FROM t JOIN v ON v.feature = t.feature AND v.n = t.top WHERE k = 1 OR top > 0.99 * t.n"""))
def low_variance(spark, folder):
    return rounded(quality.low_variance(e4(spark, folder), ["patient_nbr"]))


@query("distinct_counts", with_views("e4", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(DISTINCT {c}) AS distinct_count, {str(c == 'patient_nbr').lower()} AS is_id, "
    f"count(DISTINCT {c}) <= 1 AS low_uniqueness FROM e4" for c in _E4_COLS)))
def distinct_counts(spark, folder):
    return quality.distinct_counts(e4(spark, folder), ["patient_nbr"])


@query("constant_values", with_views("e4", "SELECT 'const_col' AS feature, min(const_col) AS value FROM e4"))
def constant_values(spark, folder):
    return quality.constant_values(e4(spark, folder))


@query("test_status", with_views("e4", """
, s AS (SELECT count(*) AS n, count(test_a) AS a, count(test_b) AS b,
               sum(CASE WHEN test_a IS NOT NULL AND test_b IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS both_n
        FROM e4 WHERE test_a IS NOT NULL OR test_b IS NOT NULL)
SELECT test, status, k AS n, round(100.0 * k / n, 6) AS pct FROM (
  SELECT 'test_a' AS test, 'Measured' AS status, a AS k, n FROM s UNION ALL SELECT 'test_a', 'Not Measured', n - a, n FROM s
  UNION ALL SELECT 'test_b', 'Measured', b, n FROM s UNION ALL SELECT 'test_b', 'Not Measured', n - b, n FROM s
  UNION ALL SELECT 'both', 'Measured', both_n, n FROM s UNION ALL SELECT 'only_one', 'Measured', n - both_n, n FROM s)"""))
def test_status(spark, folder):
    return rounded(quality.test_status(e4(spark, folder), "test_a", "test_b"))


test_status.__test__ = False


@query("status_crosstab", with_views("e4", """
SELECT CASE WHEN test_a IS NULL THEN 'Not Measured' ELSE 'Measured' END AS test_a,
       CASE WHEN test_b IS NULL THEN 'Not Measured' ELSE 'Measured' END AS test_b, count(*) AS n
FROM e4 WHERE test_a IS NOT NULL OR test_b IS NOT NULL GROUP BY 1, 2"""))
def status_crosstab(spark, folder):
    return quality.status_crosstab(e4(spark, folder), "test_a", "test_b")


@query("top_values", with_views("e4", f"""
, v AS ({_E4_VALUES})
SELECT feature, value, n, CAST(row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) AS INTEGER) AS rank
FROM v WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY feature ORDER BY n DESC, value) <= 3"""))
def top_values(spark, folder):
    return quality.top_values(e4(spark, folder), _E4_COLS[1:], 3)


# ---- files and schemas ----


def csv_copy(df, name: str) -> str:
    """Path of a CSV copy in the shared folder."""
    path = f"{scratch_path(df.sparkSession)}/{name}-{uuid.uuid4().hex}.csv"
    write_csv(df, path)
    return path


@query("model_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def model_csv(spark, folder):
    """The orders written as CSV with a saved index column, and read back as a modelling table."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    saved = orders.select(F.monotonically_increasing_id().alias("Unnamed: 0"), "*")
    return read_model_table(spark, csv_copy(saved, "orders"), saved.schema)


@query("code_dictionary", """
SELECT CAST(n_nationkey AS INTEGER) AS ID, CASE WHEN r_name = 'ASIA' THEN NULL ELSE concat(' ', n_name, ', ', r_name) END AS description, 'nation' AS Type
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT CAST(c_custkey AS INTEGER), concat(c_mktsegment, ', ', c_custkey), 'customer' FROM customer""")
def code_dictionary(spark, folder):
    """A stacked dictionary with the text NULL, commas and leading blanks, through its file."""
    nation, region, customer = (table(spark, folder, t) for t in ("nation", "region", "customer"))
    joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
    known = F.concat(F.lit(" "), F.col("n_name"), F.lit(", "), F.col("r_name"))
    rows = joined.select("n_nationkey", F.when(F.col("r_name") == "ASIA", "NULL").otherwise(known), F.lit("nation")).union(
        customer.select("c_custkey", F.concat("c_mktsegment", F.lit(", "), F.col("c_custkey").cast("string")), F.lit("customer"))
    )
    return read_code_dictionary(spark, csv_copy(rows.toDF("ID", "description", "Type"), "codes"))


@query("typed_features", with_views("e2", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, '{kind}' AS kind, count(DISTINCT {c}) AS values FROM e2"
    for c, kind in [(c, "numeric") for c in ("quantity", "price", "discount", "tax", "age")] + [(c, "other") for c in ("readmitted", "med_a", "med_b", "med_c")])))
def typed_features(spark, folder):
    """Feature columns by type, with their distinct values."""
    rows = e2(spark, folder)
    features = rows.select(clean.feature_columns(rows, [c for c in rows.columns if c.endswith(("_id", "_nbr"))]))
    numeric, other = clean.split_by_type(features)
    kinds = F.create_map(*[F.lit(v) for c in numeric for v in (c, "numeric")], *[F.lit(v) for c in other for v in (c, "other")])
    counts = quality.distinct_counts(features)
    return counts.select("feature", kinds[F.col("feature")].alias("kind"), F.col("distinct_count").alias("values"))
