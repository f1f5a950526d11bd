"""Keyed row selection: first, repeated and top keys, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.scalars import rate
from wardlight.operators.ordered import row_ordinals, text_ranges, value_cuts, with_ranges


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """First row of each key by ``order``.

    ``min_by`` keeps one row per key and task before the shuffle, so a key that holds a
    large part of the table costs no more than any other. Null keys form one group; a null
    order comes last, so a key with nothing else keeps its row.
    """
    rest = [c for c in df.columns if c != key]
    place = F.struct(F.col(order).isNull(), F.col(order))
    picked = df.groupBy(key).agg(F.min_by(F.struct(*rest), place).alias("row"))
    return picked.select(key, "row.*").select(df.columns)


def key_counts(df: DataFrame, key: str) -> DataFrame:
    """``(key, n)`` for non-null keys."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def repeated_keys(df: DataFrame, key: str, min_rows: int = 2) -> DataFrame:
    """Rows of keys that occur at least ``min_rows`` times; null keys are dropped."""
    keep = key_counts(df, key).filter(F.col("n") >= min_rows).select(key)
    return df.join(keep, key, "left_semi")


def top_keys(df: DataFrame, key: str, n: int) -> DataFrame:
    """Keys with the most rows, key as tie-break."""
    return key_counts(df, key).orderBy(F.desc("n"), key).limit(n)


def timeline(df: DataFrame, key: str, order: str) -> DataFrame:
    """Every row with its 1-based position within its key.

    Rows are spread over ranges of ``order``, so one very active key is numbered by many
    tasks. Numbers, dates, timestamps and text order alike; null orders come last, and null
    keys are numbered as one key.
    """
    kind = df.schema[order].dataType
    if isinstance(kind, T.NumericType):
        axis = F.col(order).cast("double")
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        axis = F.col(order).cast("timestamp").cast("double")
    else:
        return row_ordinals(text_ranges(df, [order], "__slot"), [key], [F.col(order).asc_nulls_last()], "__slot").drop("__slot")
    marked = df.withColumn("__axis", axis)
    ranged = with_ranges(marked, value_cuts(marked, ["__axis"]))
    slot = F.coalesce(F.col("__axis__range"), F.lit(float("inf")))
    placed = ranged.withColumn("__slot", slot).drop("__axis", "__axis__range")
    return row_ordinals(placed, [key], [F.col(order).asc_nulls_last()], "__slot").drop("__slot")


def key_outcome_rate(df: DataFrame, key: str, outcome: str = "readmitted", negative: str = "NO") -> DataFrame:
    """Encounters and percentage of non-negative outcomes per key."""
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("encounters"), rate(F.col(outcome) != negative).alias("outcome_rate")
    )


def repeat_summary(df: DataFrame, key: str, outcome: str = "readmitted", negative: str = "NO") -> DataFrame:
    """One row of headline metrics of the repeated cohort, from per-key partial counts."""
    per_key = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(outcome) != negative).alias("hits"))
        .filter(F.col("n") > 1)
    )
    return per_key.agg(
        F.count(F.lit(1)).alias("patients"),
        F.sum("n").alias("encounters"),
        F.avg("n").alias("mean_encounters"),
        (F.sum("hits") * 100.0 / F.sum("n")).alias("outcome_rate"),
        F.lit(len(df.columns)).cast("long").alias("features"),
    )


def cohort_flags(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each row with ``is_first`` and ``is_repeated``, from one per-key aggregate.

    The aggregate (first order value and row count per key) is joined back, so neither
    flag needs a window over a key's rows. Rows with a null key belong to the first
    cohort once and never to the repeated one.
    """
    per_key = df.groupBy(F.col(key).alias("__key")).agg(
        F.min(order).alias("__first"), F.count(F.lit(1)).alias("__n")
    )
    return (
        df.join(per_key, F.col(key).eqNullSafe(F.col("__key")))
        .withColumn("is_first", F.col(order).eqNullSafe(F.col("__first")))
        .withColumn("is_repeated", (F.col("__n") > 1) & F.col(key).isNotNull())
        .drop("__key", "__first", "__n")
    )


def cohort_union(df: DataFrame, key: str, order: str) -> DataFrame:
    """All, first and repeated cohorts stacked under a ``cohort`` tag.

    ``order`` must be unique within a key.
    """
    tags = F.array_compact(
        F.array(
            F.lit("all"),
            F.when(F.col("is_first"), F.lit("first")),
            F.when(F.col("is_repeated"), F.lit("repeated")),
        )
    )
    flagged = cohort_flags(df, key, order)
    return flagged.select(F.explode(tags).alias("cohort"), *df.columns)
