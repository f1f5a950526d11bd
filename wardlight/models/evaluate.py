"""Scores of probabilistic classifiers. Input is always ``(label 0/1, score)`` rows."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.operators.ordered import long_values, running_totals
from wardlight.operators.outcomes import union_rows


def ratio(a: Column, b: Column) -> Column:
    """``a / b``, zero where ``b`` is zero."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    square = beta * beta
    return ratio((1 + square) * precision * recall, square * precision + recall)


def probability(df: DataFrame, label: str = "label", vector: str = "probability") -> DataFrame:
    """``(label, score)`` of a transformed frame, score being the positive class probability."""
    return df.select(F.col(label).cast("int").alias("label"), vector_to_array(vector)[1].alias("score"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row with tn, fp, fn, tp."""
    hit, positive = F.col("score") >= threshold, F.col("label") == 1
    return scored.agg(
        F.count_if(~positive & ~hit).alias("tn"), F.count_if(~positive & hit).alias("fp"),
        F.count_if(positive & ~hit).alias("fn"), F.count_if(positive & hit).alias("tp"),
    )


def classification_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1, F2 and support per class and averaged, with the accuracy.

    ``accuracy`` sits in every measure column of its own row, as in a printed report.
    """
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp

    def row(precision: Column, recall: Column, f1: Column, f2: Column, support: Column) -> Column:
        return F.struct(
            precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), f2.alias("f2"),
            support.cast("long").alias("support"),
        )

    def class_row(hits: Column, false_hits: Column, misses: Column) -> Column:
        precision, recall = ratio(hits, hits + false_hits), ratio(hits, hits + misses)
        return row(precision, recall, f_beta(precision, recall, 1), f_beta(precision, recall, 2), hits + misses)

    base = confusion(scored, threshold)
    both = base.select(n.alias("n"), ratio(tp + tn, n).alias("accuracy"), class_row(tn, fn, fp).alias("neg"), class_row(tp, fp, fn).alias("pos"))
    measures = ("precision", "recall", "f1", "f2")
    macro = row(*[(F.col("neg")[m] + F.col("pos")[m]) / 2 for m in measures], F.col("n"))
    weighted = row(
        *[ratio(F.col("neg")[m] * F.col("neg.support") + F.col("pos")[m] * F.col("pos.support"), F.col("n")) for m in measures], F.col("n")
    )
    accuracy = row(*[F.col("accuracy")] * 4, F.col("n"))
    rows = [("0", F.col("neg")), ("1", F.col("pos")), ("accuracy", accuracy), ("macro avg", macro), ("weighted avg", weighted)]
    return both.select(F.inline(F.array(*[F.struct(F.lit(name).alias("class"), r.alias("r")) for name, r in rows]))).select("class", "r.*")


def score_steps(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct scores with label counts at, below and over all: the base of ROC and PR."""
    long = long_values(scored, ["score"], by, extra=["label"])
    counts = long.groupBy(*by, "feature", "range", "value").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    return running_totals(counts, [*by, "feature"], ["pos", "neg"]).drop("feature", "range")


def roc_auc(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Area under the ROC curve, ties counted half."""
    wins = F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2)
    sums = score_steps(scored, by).groupBy(*by).agg(F.sum(wins).alias("w"), F.max("total_pos").alias("p"), F.max("total_neg").alias("n"))
    return sums.select(*by, F.try_divide(F.col("w"), F.col("p").cast("double") * F.col("n")).alias("roc_auc"))


def _at_or_above(scored: DataFrame) -> DataFrame:
    return score_steps(scored).select(
        F.col("value").alias("threshold"), "pos", "total_pos", "total_neg",
        (F.col("total_pos") - F.col("before_pos")).alias("tp"), (F.col("total_neg") - F.col("before_neg")).alias("fp"),
    )


def roc_curve(scored: DataFrame) -> DataFrame:
    """One point per distinct score, plus the origin with a null threshold."""
    steps = _at_or_above(scored).select(
        "threshold", ratio(F.col("fp"), F.col("total_neg")).alias("fpr"), ratio(F.col("tp"), F.col("total_pos")).alias("tpr")
    )
    origin = scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(steps)


def pr_curve(scored: DataFrame) -> DataFrame:
    """Precision and recall at each distinct score, plus the end point (1, 0)."""
    steps = _at_or_above(scored).select(
        "threshold", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("total_pos")).alias("recall")
    )
    end = scored.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return end.unionByName(steps)


def average_precision(scored: DataFrame) -> DataFrame:
    """Precision at each distinct score weighted by the recall it adds."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return _at_or_above(scored).agg(F.sum(F.try_divide(F.col("pos"), F.col("total_pos")) * precision).alias("average_precision"))


def grid(low: float, high: float, step: float) -> list[float]:
    """``low, low + step, ...`` up to ``high`` inclusive."""
    return [low + step * i for i in range(int(round((high - low) / step)) + 1)]


def threshold_sweep(scored: DataFrame, low: float = 0.30, high: float = 0.80, step: float = 0.01) -> DataFrame:
    """Scores of every threshold on an even grid, from one pass over the rows.

    Each row falls between two thresholds; only the counts per gap are kept and added up
    from the top.
    """
    marks = grid(low, high, step)
    gaps = Bucketizer(splits=[-math.inf, *marks, math.inf], inputCol="score", outputCol="gap", handleInvalid="keep").transform(scored)
    counts = gaps.groupBy(F.col("gap").cast("int").alias("gap")).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg")
    )
    frame = scored.sparkSession.createDataFrame(
        [(0, None), *[(i + 1, t) for i, t in enumerate(marks)]], "gap int, threshold double"
    )
    above = W.orderBy(F.desc("gap")).rowsBetween(W.unboundedPreceding, 0)
    every = W.partitionBy()

    def known(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    swept = frame.join(counts, "gap", "left").select(
        "threshold",
        F.sum(known("pos")).over(above).alias("tp"), F.sum(known("neg")).over(above).alias("fp"),
        F.sum(known("pos")).over(every).alias("p"),
    ).filter(F.col("threshold").isNotNull())
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("p"))
    return swept.select(
        "threshold", precision.alias("precision"), recall.alias("recall"),
        f_beta(precision, recall, 1).alias("f1"), f_beta(precision, recall, 2).alias("f2"),
        (F.col("fp") + F.col("p") - F.col("tp")).alias("errors"), F.col("fp").alias("false_positives"),
    )


def sweep_both(test: DataFrame, train: DataFrame, **options: float) -> DataFrame:
    """Sweep of the test rows with the same measures on the training rows beside it."""
    other = threshold_sweep(train, **options).select("threshold", *[F.col(c).alias(f"{c}_tr") for c in ("precision", "recall", "f1", "f2")])
    return threshold_sweep(test, **options).join(other, "threshold")


def combined_scores(sweep: DataFrame, f2_weight: float = 0.6, error_weight: float = 0.4) -> DataFrame:
    """Add the min-max scaled F2 and error counts and their weighted sum."""
    every = W.partitionBy()

    def scaled(c: str, falling: bool) -> Column:
        low, high = F.min(c).over(every), F.max(c).over(every)
        return F.try_divide(high - F.col(c) if falling else F.col(c) - low, high - low)

    scores = sweep.withColumns(
        {"f2_norm": scaled("f2", False), "error_norm": scaled("errors", True), "fp_norm": scaled("false_positives", True)}
    )
    return scores.withColumn("combined", f2_weight * F.col("f2_norm") + error_weight * F.col("error_norm"))


def pick_threshold(
    sweep: DataFrame, rule: str = "f1", target_precision: float | None = None, min_f1: float | None = None, weights: tuple[float, float] = (0.6, 0.4)
) -> DataFrame:
    """The chosen threshold row; the smallest threshold wins ties.

    ``f1``: largest F1. ``precision``: smallest threshold that reaches the target, else the
    largest precision. ``combined``: largest weighted score among rows with at least
    ``min_f1``, or among all rows if none has it.
    """
    if rule == "f1":
        order = [F.desc("f1")]
    elif rule == "precision":
        meets = F.col("precision") >= F.lit(target_precision)
        order = [F.desc(meets), F.when(meets, F.lit(0.0)).otherwise(-F.col("precision"))]
    elif rule == "combined":
        sweep = combined_scores(sweep, *weights)
        order = [F.desc(F.col("f1") >= F.lit(min_f1))] if min_f1 is not None else []
        order.append(F.desc("combined"))
    else:
        raise ValueError(f"unknown rule {rule}")
    # doubles that differ only by summation order count as ties
    return sweep.orderBy(*order, "threshold").limit(1)


def compare_models(scored: Mapping[str, tuple[DataFrame, float]]) -> DataFrame:
    """Accuracy, AUC and positive-class scores of several models at their thresholds."""
    rows = []
    for name, (df, threshold) in scored.items():
        report = classification_report(df, threshold)
        one = report.groupBy().agg(
            F.max(F.when(F.col("class") == "accuracy", F.col("f1"))).alias("accuracy"),
            *[F.max(F.when(F.col("class") == "1", F.col(m))).alias(m) for m in ("precision", "recall", "f1", "f2")],
        )
        tagged = one.select(F.lit(name).alias("model"), F.lit(float(threshold)).alias("threshold"), "*")
        rows.append(tagged.join(roc_auc(df).withColumn("model", F.lit(name)), "model"))
    return union_rows(*rows)


def f2_by(scored: DataFrame, by: tuple[str, ...], threshold: float = 0.5) -> DataFrame:
    """F2 of the positive class per group at a threshold."""
    hit, positive = F.col("score") >= threshold, F.col("label") == 1
    counts = scored.groupBy(*by).agg(
        F.count_if(positive & hit).alias("tp"), F.count_if(~positive & hit).alias("fp"), F.count_if(positive & ~hit).alias("fn")
    )
    return counts.select(*by, ratio(5 * F.col("tp"), 5 * F.col("tp") + 4 * F.col("fn") + F.col("fp")).alias("f2"))


class F2Evaluator(Evaluator):
    """F2 of the positive class at a fixed threshold, for ``pyspark.ml`` tuning."""

    def __init__(self, label: str = "label", threshold: float = 0.5):
        super().__init__()
        self.label, self.threshold = label, threshold

    def _evaluate(self, dataset: DataFrame) -> float:
        c = confusion(probability(dataset, self.label), self.threshold).first()
        precision = c["tp"] / (c["tp"] + c["fp"]) if c["tp"] + c["fp"] else 0.0
        recall = c["tp"] / (c["tp"] + c["fn"]) if c["tp"] + c["fn"] else 0.0
        return 5 * precision * recall / (4 * precision + recall) if precision + recall else 0.0

    def isLargerBetter(self) -> bool:
        return True
