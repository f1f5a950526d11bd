"""Outcome rates, risk rankings, status usage and report tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.functions.scalars import bin_right_closed, half_even, join_labels, label_text, map_values, rate, share
from wardlight.operators.cohorts import cohort_flags
from wardlight.operators.ordered import average_ranks, quantiles
from wardlight.session import stage
from wardlight.sources.sinks import metric_rows

OUTCOMES = ("<30", ">30", "NO")
# Age band edges, closed on the right, and their labels.
AGE_EDGES = (0, 30, 40, 50, 60, 70, 80, 100)
AGE_LABELS = ("<30", "30-39", "40-49", "50-59", "60-69", "70-79", "80+")
# Outcome classes as ordinal numbers.
OUTCOME_CODES = {"NO": 0, ">30": 1, "<30": 2}


def outcome_counts(df: DataFrame, feature: str, outcome: str = "readmitted") -> DataFrame:
    """``(feature, outcome, n)``, null categories and outcomes dropped."""
    return (
        df.filter(F.col(feature).isNotNull() & F.col(outcome).isNotNull())
        .groupBy(feature, outcome)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def group_total(df: DataFrame, col: str, by: Sequence[str]) -> Column:
    """Sum of ``col`` over the group of each row; meant for already grouped tables."""
    return F.sum(col).over(W.partitionBy(*by))


def outcome_distribution(
    df: DataFrame, feature: str, outcome: str = "readmitted"
) -> DataFrame:
    """Share of each outcome within each category, however many categories there are."""
    counts = outcome_counts(df, feature, outcome)
    return counts.withColumn("probability", F.col("n") / group_total(counts, "n", [feature]))


def outcome_pivot(
    df: DataFrame, feature: str, outcome: str = "readmitted", outcomes: Sequence[str] = OUTCOMES
) -> DataFrame:
    """One row per category: count and percentage of every outcome, zero-filled."""
    counts = {o: F.count_if(F.col(outcome) == o) for o in outcomes}
    wide = (
        df.filter(F.col(feature).isNotNull() & F.col(outcome).isin(list(outcomes)))
        .groupBy(feature)
        .agg(F.count(F.lit(1)).alias("__n"), *[n.alias(f"n_{o}") for o, n in counts.items()])
    )
    return wide.select(
        feature,
        *[c for o in outcomes for c in (F.col(f"n_{o}"), half_even(share(F.col(f"n_{o}"), F.col("__n")), 1).alias(f"pct_{o}"))],
    )


def highest_rate(df: DataFrame, feature: str, outcome: str = "readmitted", negative: str = "NO") -> DataFrame:
    """Category with the highest rounded outcome rate, smallest label on ties."""
    rates = (
        df.filter(F.col(feature).isNotNull())
        .groupBy(feature)
        .agg(half_even(rate(F.col(outcome) != negative), 1).alias("outcome_rate"))
    )
    return rates.orderBy(F.desc("outcome_rate"), feature).limit(1)


def summary_by_outcome(df: DataFrame, feature: str, outcome: str = "readmitted") -> DataFrame:
    """Count, mean, median, std, min and max per outcome, rounded to two digits."""
    x = F.col(feature)
    known = df.filter(F.col(outcome).isNotNull())
    basic = known.groupBy(outcome).agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.min(x).alias("min"), F.max(x).alias("max"),
    )
    middle = quantiles(known, [feature], {"median": 0.5}, by=[outcome]).drop("feature")
    joined = basic.join(middle, outcome, "left")
    return joined.select(outcome, "count", *[half_even(F.col(c), 2).alias(c) for c in ("mean", "median", "std", "min", "max")])


def mean_by_outcome(df: DataFrame, measure: str, outcome: str = "readmitted") -> DataFrame:
    """Mean of a measure per outcome, one digit."""
    return (
        df.filter(F.col(outcome).isNotNull())
        .groupBy(outcome)
        .agg(half_even(F.avg(measure), 1).alias("mean"))
    )


def outcome_shares(df: DataFrame, outcome: str = "readmitted") -> DataFrame:
    """Rows per outcome and their percentage."""
    counts = df.filter(F.col(outcome).isNotNull()).groupBy(outcome).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", share(F.col("n"), F.sum("n").over(W.partitionBy())))


def key_insights(
    df: DataFrame, stay: str, procedures: str, diagnoses: str, labs: str,
    outcome: str = "readmitted", positive: str = "<30", negative: str = "NO",
) -> DataFrame:
    """Correlation of stay and procedures, mean diagnoses, relative lab difference; one pass."""
    high = F.avg(F.when(F.col(outcome) == positive, F.col(labs)))
    low = F.avg(F.when(F.col(outcome) == negative, F.col(labs)))
    return df.agg(
        F.corr(stay, procedures).alias("stay_procedures_corr"),
        F.avg(diagnoses).alias("mean_diagnoses"),
        share(high - low, low).alias("lab_difference_pct"),
    )


def group_rates(df: DataFrame, group: str, measures: Mapping[str, str], outcome: str, negative: str, urgent: str) -> DataFrame:
    """Cases, outcome rate, urgent rate and measure means per non-null group, unrounded."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(outcome).alias("cases"),
            rate(F.col(outcome) != negative).alias("rate"),
            rate(F.col(outcome) == urgent).alias("urgent_rate"),
            *[F.avg(c).alias(name) for name, c in measures.items()],
        )
    )


def group_overview(
    df: DataFrame, group: str, min_rows: int = 50, outcome: str = "readmitted", negative: str = "NO"
) -> DataFrame:
    """Most common group, its share, number of groups, overall rate, riskiest well-supported group."""
    rows = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(outcome) != negative).alias("hits"))
    named = F.col(group).isNotNull()
    rate_of = F.when(named & (F.col("n") >= min_rows), F.col("hits") * 100.0 / F.col("n"))
    return rows.agg(
        F.min_by(group, F.when(named, F.struct(-F.col("n"), F.col(group)))).alias("top_group"),
        F.max(F.when(named, F.col("n"))).alias("top_count"),
        F.sum("n").alias("all_n"), F.sum("hits").alias("all_hits"),
        F.count_if(named).alias("groups"),
        F.min_by(group, F.when(rate_of.isNotNull(), F.struct(-rate_of, F.col(group)))).alias("riskiest_group"),
        F.max(rate_of).alias("riskiest_rate"),
    ).select(
        "top_group", "top_count", share(F.col("top_count"), F.col("all_n")).alias("top_pct"), "groups",
        share(F.col("all_hits"), F.col("all_n")).alias("overall_rate"), "riskiest_group", "riskiest_rate",
    )


def group_drilldown(
    df: DataFrame, group: str, stay: str, procedures: str,
    outcome: str = "readmitted", negative: str = "NO", urgent: str = "<30",
) -> DataFrame:
    """Figures of every group with its risk level."""
    base = group_rates(df, group, {"mean_stay": stay, "mean_procedures": procedures}, outcome, negative, urgent)
    level = F.when(F.col("rate") > 80, "High").when(F.col("rate") > 60, "Moderate").otherwise("Lower")
    return base.withColumn("level", level)


def risk_scores(
    df: DataFrame, group: str, stay: str, procedures: str, min_rows: int = 50, weights: tuple[float, float] = (0.4, 0.6),
    outcome: str = "readmitted", negative: str = "NO", urgent: str = "<30",
) -> DataFrame:
    """Supported groups with their score; figures are rounded before they are combined."""
    base = group_rates(df, group, {"mean_stay": stay, "mean_procedures": procedures}, outcome, negative, urgent)
    one_digit = base.withColumns(
        {c: half_even(F.col(c), 1) for c in ("rate", "urgent_rate", "mean_stay", "mean_procedures")}
    ).filter(F.col("cases") >= min_rows)
    score = F.col("rate") * weights[0] + F.col("urgent_rate") * weights[1]
    return one_digit.withColumn("risk_score", half_even(score, 1))


def risk_ranking(df: DataFrame, group: str, stay: str, procedures: str, top: int = 10, **options) -> DataFrame:
    """Groups by falling risk score with the medians that split the risk quadrants."""
    scored = risk_scores(df, group, stay, procedures, **options)
    # Rates have one digit, so their medians come from at most 1001 counted values.
    middle = scored.agg(F.struct(F.median("rate").alias("rate"), F.median("urgent_rate").alias("urgent_rate"))).scalar()
    first = scored.orderBy(F.desc("risk_score"), group).limit(top)
    return first.withColumns({"median_rate": middle["rate"], "median_urgent_rate": middle["urgent_rate"]})


def risk_flags(
    df: DataFrame, group: str, stay: str, procedures: str,
    high_rate: float = 40, high_urgent: float = 20, first: int = 5, **options,
) -> DataFrame:
    """First groups over each threshold, in order of risk score: ``(flag, position, group, value)``."""
    scored = risk_scores(df, group, stay, procedures, **options)
    lists = F.array(
        F.struct(F.lit("high_rate").alias("flag"), F.col("rate").alias("value"), F.lit(float(high_rate)).alias("over")),
        F.struct(F.lit("urgent").alias("flag"), F.col("urgent_rate").alias("value"), F.lit(float(high_urgent)).alias("over")),
    )
    long = scored.select(group, "risk_score", F.inline(lists)).filter(F.col("value") > F.col("over"))
    # Each list keeps its first rows in every task, so only those meet in one.
    picked = union_rows(
        *[long.filter(F.col("flag") == flag).orderBy(F.desc("risk_score"), group).limit(first) for flag in ("high_rate", "urgent")]
    )
    order = W.partitionBy("flag").orderBy(F.desc("risk_score"), group)
    return picked.withColumn("position", F.row_number().over(order)).select("flag", "position", group, "value")


def status_usage(df: DataFrame, cols: Sequence[str], outcome: str = "readmitted") -> DataFrame:
    """Usage rate of every status column per outcome: ``(medication, outcome, usage_rate)``.

    A Yes/No column gives one row; a dosage column one row per change that occurs.
    """
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).alias("status")) for c in cols]
    long = df.filter(F.col(outcome).isNotNull()).select(outcome, F.inline(F.array(*cells)))
    counts = long.groupBy("column", outcome).agg(
        F.count("status").alias("known"),
        F.count_if(F.col("status").isin("Yes", "yes")).alias("Yes"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("Up", "Down", "Steady")],
    )
    title = label_text(F.col("column"))
    yes = F.array(F.struct(title.alias("medication"), F.col("Yes").alias("hits")))
    changes = F.array(
        *[
            F.struct(F.concat(title, F.lit(f" - {s}")).alias("medication"), F.col(s).alias("hits"))
            for s in ("Up", "Down", "Steady")
        ]
    )
    rows = counts.select(outcome, "known", F.inline(F.when(F.col("Yes") > 0, yes).otherwise(changes)))
    return rows.filter(F.col("hits") > 0).select(
        "medication", outcome, share(F.col("hits"), F.col("known")).alias("usage_rate")
    )


def status_combinations(
    df: DataFrame, cols: Sequence[str], n: int = 10, outcome: str = "readmitted", negative: str = "NO"
) -> DataFrame:
    """Most common sets of used status columns: label, count, share of all rows, outcome rate.

    The empty set takes part in the top ``n`` and is dropped afterwards. Whether a column
    is read as Yes/No is decided by whether any Yes occurs in it.
    """
    statuses = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(outcome) != negative).alias("hits"))
    # One row of totals: which columns hold a Yes, and the number of rows.
    said = {c: F.coalesce(F.col(c).isin("Yes", "yes"), F.lit(False)) for c in cols}
    whole = df.agg(F.struct(F.count(F.lit(1)).alias("__rows"), *[F.max(y).alias(c) for c, y in said.items()])).scalar()

    def used(c: str) -> Column:
        other = F.coalesce(~F.col(c).isin("No", "no"), F.lit(False))
        return F.when(whole[c], said[c]).otherwise(other)

    marked = statuses.select("n", "hits", whole["__rows"].alias("rows"), *[used(c).alias(c) for c in cols])
    sets = marked.groupBy(*cols).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.first("rows").alias("rows"))
    label = join_labels([F.when(F.col(c), label_text(F.lit(c))) for c in cols])
    top = sets.orderBy(F.desc("n"), *[F.desc(c) for c in cols]).limit(n)
    return top.filter(" or ".join(f"`{c}`" for c in cols)).select(
        label.alias("medications"), "n",
        share(F.col("n"), F.col("rows")).alias("pct"),
        share(F.col("hits"), F.col("n")).alias("outcome_rate"),
    )


def age_groups(df: DataFrame, age: str = "age", outcome: str = "readmitted") -> DataFrame:
    """Age band x outcome counts; text bands pass through, numbers are binned."""
    if dict(df.dtypes)[age] == "string":
        band = F.col(age)
    else:
        band = bin_right_closed(F.col(age), AGE_EDGES, AGE_LABELS)
    return outcome_counts(df.select(band.alias("age_group"), outcome), "age_group", outcome)


def mean_score_by_value(scored: DataFrame, features: Sequence[str], score: str = "score") -> DataFrame:
    """Mean predicted score per value of every listed feature, one shuffle."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    long = scored.select(score, F.inline(F.array(*cells))).filter(F.col("value").isNotNull())
    return long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"))


def average_rank(df: DataFrame, cols: Sequence[str], key: str) -> DataFrame:
    """Mean of the descending ranks (ties averaged) of several numeric score columns; nulls come last.

    Ranks are those of the distinct values, ordered range by range, so a table of any length is ranked.
    """
    ranks = stage(average_ranks(df, cols))
    sizes = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(c).alias(c) for c in cols]).first()
    out = df.select(key, *cols)
    for i, c in enumerate(cols):
        of_value = ranks.filter(F.col("feature") == c).select(F.col("value").alias("__value"), (F.col("total_n") + 1 - F.col("rank")).alias(f"__rank{i}"))
        last = (sizes[c] + sizes["all"] + 1) / 2
        out = out.join(of_value, F.col(c).cast("double") == F.col("__value"), "left").drop("__value").withColumn(f"__rank{i}", F.coalesce(f"__rank{i}", F.lit(last)))
    mean = sum((F.col(f"__rank{i}") for i in range(len(cols))), F.lit(0.0)) / len(cols)
    return out.select(key, *cols, mean.alias("average_rank"))


def scale_by_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<col>_norm``, the column divided by its maximum."""
    top = df.agg(F.struct(*[F.max(c).alias(c) for c in cols])).scalar()
    return df.withColumns({f"{c}_norm": F.try_divide(F.col(c), top[c]) for c in cols})


def top_k(df: DataFrame, by: str, k: int, tie: str, absolute: bool = False) -> DataFrame:
    """First ``k`` rows by falling (absolute) value, ``tie`` ascending."""
    order = F.abs(F.col(by)) if absolute else F.col(by)
    return df.orderBy(order.desc(), tie).limit(k)


def top_with_other(df: DataFrame, col: str, n: int = 9, limit: int = 10, other: str = "Other") -> DataFrame:
    """Category counts; with more than ``limit`` categories all but the first ``n`` are summed."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    categories = counts.agg(F.count_if(F.col("n") > 0).alias("k")).scalar()
    leading = counts.orderBy(F.desc("n"), "category").limit(n).select("category", F.lit(True).alias("__top"))
    marked = counts.join(leading, "category", "left")
    label = F.when(F.col("__top") | (categories <= limit), F.col("category")).otherwise(F.lit(other))
    return marked.groupBy(label.alias("category")).agg(F.sum("n").alias("n"))


def cohort_contingency(tagged: DataFrame, col: str, cohorts: Sequence[str] = ("all", "first", "repeated")) -> DataFrame:
    """Counts per category and cohort, zero where a cohort lacks the category."""
    return (
        tagged.filter(F.col(col).isNotNull())
        .groupBy(F.col(col).alias("category"))
        .agg(*[F.count_if(F.col("cohort") == c).alias(c) for c in cohorts])
    )


def union_rows(*frames: DataFrame) -> DataFrame:
    """Append frames with different columns; absent columns are null."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def outcome_correlation(
    df: DataFrame, features: Sequence[str], n: int = 5, outcome: str = "readmitted",
    mapping: Mapping[str, float] = OUTCOME_CODES,
) -> DataFrame:
    """Absolute correlation of every numeric feature with the ordinal outcome, strongest first."""
    code = map_values(F.col(outcome), mapping)
    one = df.agg(*[F.abs(F.corr(F.col(c), code)).alias(c) for c in features])
    long = one.unpivot([], list(features), "feature", "correlation")
    return top_k(long, "correlation", n, "feature")


# ---- report tables ----


def summary_long(summary: DataFrame) -> DataFrame:
    """Headline metrics of the repeated cohort as ``(metric, value)`` rows."""
    return metric_rows(
        summary,
        {
            "Total Repeated Patients": F.col("patients"),
            "Total Encounters": F.col("encounters"),
            "Readmission Rate": F.col("outcome_rate"),
            "Avg Encounters per Patient": F.col("mean_encounters"),
        },
    )


def feature_statistics(df: DataFrame, numeric: Sequence[str], text: Sequence[str]) -> DataFrame:
    """Numeric rows (mean, std, min, max) and categorical rows (unique, mode) of one report."""
    frames = []
    if numeric:
        stats = df.agg(
            *[
                F.struct(
                    F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                    F.max(c).cast("double").alias("max"), (F.count(F.lit(1)) - F.count(c)).alias("missing"),
                ).alias(c)
                for c in numeric
            ]
        ).unpivot([], list(numeric), "feature", "s")
        frames.append(stats.select("feature", F.lit("Numeric").alias("type"), "s.*"))
    if text:
        cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in text]
        counts = df.select(F.inline(F.array(*cells))).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        value = F.col("value")
        frames.append(
            counts.groupBy("feature").agg(
                F.lit("Categorical").alias("type"),
                F.count(value).alias("unique"),
                F.min_by(value, F.when(value.isNotNull(), F.struct(-F.col("n"), value))).alias("mode"),
                F.coalesce(F.sum(F.when(value.isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            )
        )
    return union_rows(*frames)


def cohort_report(
    df: DataFrame, key: str, order: str, n_numeric: int, n_text: int,
    outcome: str = "readmitted", negative: str = "NO", positive: str = "<30", later: str = ">30",
) -> DataFrame:
    """Report figures of the three cohorts as ``(metric, value)`` rows, one aggregate."""
    flagged = cohort_flags(df.select(key, order, outcome), key, order)
    hit = F.col(outcome) != negative
    first, repeated = F.col("is_first"), F.col("is_repeated")
    one = flagged.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(first).alias("n1"), F.count_if(repeated).alias("n2"),
        F.count_if(hit).alias("h"), F.count_if(hit & first).alias("h1"), F.count_if(hit & repeated).alias("h2"),
        F.count_if(F.col(outcome) == positive).alias("p"), F.count_if(F.col(outcome) == later).alias("l"),
    )
    rate_first, rate_repeated = share(F.col("h1"), F.col("n1")), share(F.col("h2"), F.col("n2"))
    return metric_rows(
        one,
        {
            "total_encounters": F.col("n"), "first_encounters": F.col("n1"), "repeated_encounters": F.col("n2"),
            "numeric_features": F.lit(n_numeric), "categorical_features": F.lit(n_text),
            "overall_rate": share(F.col("h"), F.col("n")),
            "positive_rate": share(F.col("p"), F.col("n")), "later_rate": share(F.col("l"), F.col("n")),
            "first_rate": rate_first, "repeated_rate": rate_repeated,
            "repeated_lift_pct": share(rate_repeated - rate_first, rate_first),
        },
    )
