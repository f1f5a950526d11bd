"""Queries: feature scores, splits, scaling and classifier metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.models import evaluate, prep
from wardlight.operators import importance, lookup
from wardlight.plans.registry import query
from wardlight.plans.tables import rounded
from wardlight.plans.views import e1, e2, e4, e7, table, with_views

TEXT = ("grp", "segment", "nation")


@query("label_encode", with_views("e4", """
SELECT patient_nbr, test_a, test_b, CAST(dense_rank() OVER (ORDER BY coalesce(test_a, 'missing')) - 1 AS INTEGER) AS test_a_code,
       CAST(dense_rank() OVER (ORDER BY coalesce(test_b, 'missing')) - 1 AS INTEGER) AS test_b_code FROM e4"""))
def label_encode(spark, folder):
    return importance.label_encode(e4(spark, folder).select("patient_nbr", "test_a", "test_b"), ["test_a", "test_b"])


def _gain(c: str) -> str:
    return f"""
SELECT '{c}' AS feature, (SELECT sum(-p * log2(p + 1e-10)) FROM (SELECT count(*) * 1.0 / (SELECT count(*) FROM e1) AS p FROM e1 GROUP BY readmitted))
  - (SELECT sum(v / t * (-(n / v) * log2(n / v + 1e-10))) FROM
      (SELECT count(*) * 1.0 AS n, sum(count(*)) OVER (PARTITION BY {c}) * 1.0 AS v, sum(count(*)) OVER () * 1.0 AS t FROM e1 GROUP BY {c}, readmitted)) AS g"""


@query("information_gain", with_views("e1", f"SELECT feature, round(g, 6) AS information_gain FROM ({' UNION ALL '.join(_gain(c) for c in TEXT)})"))
def information_gain(spark, folder):
    return rounded(importance.information_gain(e1(spark, folder), TEXT))


def _mutual(c: str) -> str:
    return f"""
SELECT '{c}' AS feature, sum(n / t * ln(n * t / (v * o))) AS m FROM
  (SELECT count(*) * 1.0 AS n, sum(count(*)) OVER (PARTITION BY {c}) * 1.0 AS v, sum(count(*)) OVER (PARTITION BY readmitted) * 1.0 AS o,
          sum(count(*)) OVER () * 1.0 AS t FROM e1 GROUP BY {c}, readmitted)"""


@query("mutual_info", with_views("e1", f"SELECT feature, round(m, 6) AS mutual_information FROM ({' UNION ALL '.join(_mutual(c) for c in TEXT)})"))
def mutual_info(spark, folder):
    return rounded(importance.mutual_information(e1(spark, folder), TEXT))


@query("merge_scores", with_views("e1", f"""
, gain AS ({' UNION ALL '.join(_gain(c) for c in TEXT)}), mutual AS ({' UNION ALL '.join(_mutual(c) for c in TEXT)})
SELECT feature, round(g, 6) AS information_gain, round(m, 6) AS mutual_information FROM gain JOIN mutual USING (feature)"""))
def merge_scores(spark, folder):
    rows = e1(spark, folder)
    return rounded(lookup.merge_scores(importance.information_gain(rows, TEXT), importance.mutual_information(rows, TEXT)))


def _digamma(x: str) -> str:
    """Recurrence up to x + 6, then the asymptotic series."""
    y = f"(({x})::DOUBLE + 6)"
    steps = " - ".join(f"1 / (({x})::DOUBLE + {i})" for i in range(6))
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) - {steps})"


NEIGHBOURS = ", ".join(f"abs({side}(v, {i}) OVER w - v)" for side in ("lag", "lead") for i in (1, 2, 3))


# Every point against all others by value; the third neighbour is among three values on each side.
@query("mutual_info_knn", with_views("e1", f"""
, cells AS (SELECT 'amount' AS feature, readmitted AS y, amount::DOUBLE AS v FROM e1 UNION ALL SELECT 'balance', readmitted, balance::DOUBLE FROM e1
), kept AS (SELECT *, count(*) OVER (PARTITION BY feature, y) AS class_n FROM cells WHERE y IS NOT NULL AND v IS NOT NULL QUALIFY class_n > 1
), near AS (
  SELECT feature, y, v, class_n, least(3, class_n - 1) AS wanted, list_sort(list_filter([{NEIGHBOURS}], lambda g: g IS NOT NULL))[least(3, class_n - 1)] AS d
  FROM kept WINDOW w AS (PARTITION BY feature, y ORDER BY v)
), spans AS (SELECT DISTINCT feature, v, d, v - d AS low, v + d AS high FROM near
), within AS (
  SELECT s.feature, s.v, s.d, count(*) FILTER (s.d > 0 AND k.v > s.low AND k.v < s.high OR s.d = 0 AND k.v = s.v) AS m
  FROM spans s JOIN kept k ON k.feature = s.feature AND k.v >= s.low AND k.v <= s.high GROUP BY ALL
)
SELECT feature, round(greatest(0, {_digamma('count(*)')} + sum({_digamma('wanted')} - {_digamma('class_n')} - {_digamma('greatest(m, 1)')}) / count(*)), 6) AS mutual_information
FROM near JOIN within USING (feature, v, d) GROUP BY feature"""))
def mutual_info_knn(spark, folder):
    return rounded(importance.mutual_information(e1(spark, folder), ["amount", "balance"], method="knn"))


def coded(spark, folder):
    """Numeric features with a 0/1 label on the lineitem rows."""
    return e2(spark, folder).select(
        (F.col("readmitted") == "<30").cast("int").alias("label"), "quantity", "price", "discount", "tax"
    )


@query("forest_importance")
def forest_importance(spark, folder):
    return importance.forest_importance(coded(spark, folder), ["quantity", "price", "discount", "tax"], "label", trees=100)


@query("importance_compare")
def importance_compare(spark, folder):
    return importance.importance_compare(coded(spark, folder), ["quantity", "discount", "tax"], "label", trees=100)


@query("top_features", with_views("e1", f"""
SELECT feature FROM ({' UNION ALL '.join(_gain(c) for c in TEXT)}) ORDER BY g DESC, feature LIMIT 2"""))
def top_features(spark, folder):
    return importance.top_features(importance.information_gain(e1(spark, folder), TEXT), "information_gain", 2)


# ---- preparation ----

LABELED = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label FROM orders"


def labeled(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"))


SHUFFLED = f"""
WITH l AS ({LABELED}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(CAST(o_orderkey AS VARCHAR), '42')), o_orderkey) AS r,
       count(*) OVER (PARTITION BY label) AS n FROM l)"""


@query("stratified_split", SHUFFLED + """
SELECT o_orderkey, label, CASE WHEN r <= n * 0.2::DOUBLE THEN 'test' WHEN r <= n * (0.2::DOUBLE + 0.16::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM r""")
def stratified_split(spark, folder):
    return prep.stratified_split(labeled(spark, folder), "label", "o_orderkey", {"test": 0.2, "validation": 0.16, "train": 0.64})


@query("stratified_folds", SHUFFLED + "SELECT o_orderkey, label, CAST((r - 1) % 5 AS INTEGER) AS fold FROM r")
def stratified_folds(spark, folder):
    return prep.stratified_folds(labeled(spark, folder), "label", "o_orderkey", 5)


@query("standardize", """
WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT c_custkey, round((c_acctbal - m) / s, 6) AS balance, CAST(0 AS DOUBLE) AS fixed FROM customer, s WHERE c_mktsegment <> 'BUILDING'""")
def standardize(spark, folder):
    rows = table(spark, folder, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("balance"), F.lit(3.0).alias("fixed"), (F.col("c_mktsegment") == "BUILDING").alias("known")
    )
    parts = [rows.filter(F.col("known")).drop("known"), rows.filter(~F.col("known")).drop("known")]
    return rounded(prep.standardize(parts[0], parts[1:], ["balance", "fixed"])[1])


@query("min_max", """
SELECT o_orderkey, round((o_totalprice - min(o_totalprice) OVER ()) / (max(o_totalprice) OVER () - min(o_totalprice) OVER ()), 6) AS o_totalprice FROM orders""")
def min_max(spark, folder):
    return rounded(prep.min_max(table(spark, folder, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("class_weight", f"""
WITH l AS ({LABELED})
SELECT o_orderkey, label, round(count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)), 6) AS weight FROM l""")
def class_weight(spark, folder):
    return rounded(prep.with_class_weight(labeled(spark, folder), "label"))


# ---- metrics on scored rows ----

COUNTS = """
, c AS (SELECT sum(CASE WHEN label = 0 AND score < 0.5 THEN 1 ELSE 0 END)::DOUBLE AS tn, sum(CASE WHEN label = 0 AND score >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fp,
               sum(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END)::DOUBLE AS fn, sum(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END)::DOUBLE AS tp FROM e7)"""


@query("confusion", with_views("e7", COUNTS + " SELECT tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp FROM c"))
def confusion(spark, folder):
    return evaluate.confusion(e7(spark, folder))


@query("classification_report", with_views("e7", COUNTS + """
, k AS (SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, tn + fp AS s FROM c UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), tp + fn FROM c),
f AS (SELECT class, p, r, 2 * p * r / (p + r) AS f1, 5 * p * r / (4 * p + r) AS f2, s FROM k),
a AS (SELECT (tp + tn) / (tp + tn + fp + fn) AS a, tp + tn + fp + fn AS s FROM c),
u AS (SELECT * FROM f UNION ALL SELECT 'accuracy', a, a, a, a, s FROM a
  UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), avg(f2), sum(s) FROM f
  UNION ALL SELECT 'weighted avg', sum(p * s) / sum(s), sum(r * s) / sum(s), sum(f1 * s) / sum(s), sum(f2 * s) / sum(s), sum(s) FROM f)
SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS f2, s::BIGINT AS support FROM u"""))
def classification_report(spark, folder):
    return rounded(evaluate.classification_report(e7(spark, folder)))


STEPS = """
, d AS (SELECT score, sum(label)::BIGINT AS pos, count(*) - sum(label)::BIGINT AS neg FROM e7 GROUP BY 1),
s AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM d)"""


@query("roc_auc", with_views("e7", STEPS + "SELECT round(sum(pos * (n - fp + neg / 2.0)) / (any_value(p) * any_value(n) * 1.0), 6) AS roc_auc FROM s"))
def roc_auc(spark, folder):
    return rounded(evaluate.roc_auc(e7(spark, folder)))


@query("roc_curve", with_views("e7", STEPS + """
SELECT round(score, 6) AS threshold, round(fp * 1.0 / n, 6) AS fpr, round(tp * 1.0 / p, 6) AS tpr FROM s
UNION ALL SELECT NULL, 0.0, 0.0"""))
def roc_curve(spark, folder):
    return rounded(evaluate.roc_curve(e7(spark, folder)))


@query("pr_curve", with_views("e7", STEPS + """
SELECT round(score, 6) AS threshold, round(tp * 1.0 / (tp + fp), 6) AS precision, round(tp * 1.0 / p, 6) AS recall FROM s
UNION ALL SELECT NULL, 1.0, 0.0"""))
def pr_curve(spark, folder):
    return rounded(evaluate.pr_curve(e7(spark, folder)))


@query("average_precision", with_views("e7", STEPS + "SELECT round(sum(pos * 1.0 / p * tp / (tp + fp)), 6) AS average_precision FROM s"))
def average_precision(spark, folder):
    return rounded(evaluate.average_precision(e7(spark, folder)))


def _sweep(source: str, tag: str = "") -> str:
    """Scores at each threshold, as tables whose names end in ``tag``."""
    return f"""
, g{tag} AS (SELECT 0.3::DOUBLE + 0.01::DOUBLE * i AS threshold FROM (SELECT unnest(range(51)) AS i)),
k{tag} AS (SELECT threshold, sum(CASE WHEN score >= threshold THEN label ELSE 0 END)::DOUBLE AS tp,
             sum(CASE WHEN score >= threshold THEN 1 - label ELSE 0 END)::DOUBLE AS fp, sum(label)::DOUBLE AS p FROM g{tag}, {source} GROUP BY 1),
r{tag} AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, tp / p AS recall FROM k{tag}),
w{tag} AS (SELECT threshold, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1,
             CASE WHEN precision + recall = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END AS f2,
             (fp + p - tp)::BIGINT AS errors, fp::BIGINT AS false_positives FROM r{tag})"""


SWEEP = _sweep("e7")
ROUNDED = "round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, round(f2, 6) AS f2, errors, false_positives"


@query("threshold_sweep", with_views("e7", SWEEP + f"SELECT {ROUNDED} FROM w"))
def threshold_sweep(spark, folder):
    return rounded(evaluate.threshold_sweep(e7(spark, folder)))


@query("sweep_both", with_views("e7", SWEEP + """
, t7 AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, (l_quantity + CASE WHEN l_returnflag = 'R' THEN 20 ELSE 0 END) / 70.0 AS score FROM lineitem)"""
    + _sweep("t7", "_tr") + """
SELECT round(w.threshold, 6) AS threshold, round(w.precision, 6) AS precision, round(w.recall, 6) AS recall, round(w.f1, 6) AS f1, round(w.f2, 6) AS f2,
       w.errors, w.false_positives, round(w_tr.precision, 6) AS precision_tr, round(w_tr.recall, 6) AS recall_tr, round(w_tr.f1, 6) AS f1_tr, round(w_tr.f2, 6) AS f2_tr
FROM w JOIN w_tr ON w.threshold = w_tr.threshold"""))
def sweep_both(spark, folder):
    """The test sweep beside that of rows scored in another way."""
    hit = F.col("l_returnflag") == "R"
    other = table(spark, folder, "lineitem").select(hit.cast("int").alias("label"), ((F.col("l_quantity") + F.when(hit, 20).otherwise(0)) / 70.0).alias("score"))
    return rounded(evaluate.sweep_both(e7(spark, folder), other))


@query("pick_threshold", with_views("e7", SWEEP + f"""
, z AS (SELECT *, 0.7 * (f2 - min(f2) OVER ()) / (max(f2) OVER () - min(f2) OVER ())
               + 0.3 * (max(errors) OVER () - errors) / (max(errors) OVER () - min(errors) OVER ()) AS combined FROM w),
a AS (SELECT * FROM w ORDER BY f1 DESC, threshold LIMIT 1), b AS (SELECT * FROM w WHERE precision >= 0.55 ORDER BY threshold LIMIT 1),
c AS (SELECT * EXCLUDE combined FROM z ORDER BY f1 >= 0.5 DESC, combined DESC, threshold LIMIT 1)
SELECT 'f1' AS rule, {ROUNDED} FROM a UNION ALL SELECT 'precision', {ROUNDED} FROM b UNION ALL SELECT 'combined', {ROUNDED} FROM c"""))
def pick_threshold(spark, folder):
    sweep = evaluate.threshold_sweep(e7(spark, folder))
    picks = {
        "f1": evaluate.pick_threshold(sweep),
        "precision": evaluate.pick_threshold(sweep, "precision", target_precision=0.55),
        "combined": evaluate.pick_threshold(sweep, "combined", min_f1=0.5, weights=(0.7, 0.3)),
    }
    rows = [df.select(F.lit(rule).alias("rule"), *sweep.columns) for rule, df in picks.items()]
    return rounded(evaluate.union_rows(*rows))


def _model_row(name: str, t: float) -> str:
    return f"""
SELECT '{name}' AS model, {t}::DOUBLE AS threshold, sum(CASE WHEN (score >= {t}) = (label = 1) THEN 1 ELSE 0 END) * 1.0 / count(*) AS accuracy,
       sum(CASE WHEN score >= {t} THEN label ELSE 0 END) * 1.0 / sum(CASE WHEN score >= {t} THEN 1 ELSE 0 END) AS p,
       sum(CASE WHEN score >= {t} THEN label ELSE 0 END) * 1.0 / sum(label) AS r FROM e7"""


@query("compare_models", with_views("e7", STEPS + f"""
, m AS ({_model_row('before', 0.5)} UNION ALL {_model_row('after', 0.6)}),
q AS (SELECT sum(pos * (n - fp + neg / 2.0)) / (any_value(p) * any_value(n) * 1.0) AS auc FROM s)
SELECT model, threshold, round(accuracy, 6) AS accuracy, round(m.p, 6) AS precision, round(m.r, 6) AS recall, round(2 * m.p * m.r / (m.p + m.r), 6) AS f1,
       round(5 * m.p * m.r / (4 * m.p + m.r), 6) AS f2, round(auc, 6) AS roc_auc FROM m, q"""))
def compare_models(spark, folder):
    scored = e7(spark, folder)
    return rounded(evaluate.compare_models({"before": (scored, 0.5), "after": (scored, 0.6)}))
