"""Splits, folds, scaling and class weights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.operators.ordered import row_ordinals

HASH_DIGITS = 4


def _shuffled(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """Number the rows of each label in the order of a seeded hash of the key.

    The leading hash digits cut the order into evenly filled slots, so a label that holds
    most of the table is numbered by many tasks. Null labels are a label of their own and
    null keys hash as empty text, so every row gets a place.
    """
    digest = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))))
    marked = df.withColumn("__hash", digest).withColumn("__slot", F.conv(F.substring("__hash", 1, HASH_DIGITS), 16, 10).cast("int"))
    numbered = row_ordinals(marked, [label], ["__hash", key], "__slot", "__ordinal", "__total")
    return numbered.drop("__hash", "__slot")


def _part(fractions: Mapping[str, float]) -> Column:
    names = list(fractions)
    bounds = list(accumulate(fractions.values()))
    part: Column = F.lit(names[-1])
    for name, bound in reversed(list(zip(names[:-1], bounds[:-1]))):
        part = F.when(F.col("__ordinal") <= F.col("__total") * F.lit(bound), F.lit(name)).otherwise(part)
    return part


def _fold(k: int) -> Column:
    return ((F.col("__ordinal") - 1) % k).cast("int")


def stratified_split(df: DataFrame, label: str, key: str, fractions: Mapping[str, float], seed: int = 42, split: str = "split") -> DataFrame:
    """Exact split per label; the last name takes what the cumulated fractions leave.

    Repeatable for a given key and seed, however the table is partitioned.
    """
    return _shuffled(df, label, key, seed).withColumn(split, _part(fractions)).drop("__ordinal", "__total")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, fold: str = "fold") -> DataFrame:
    """Fold number 0..k-1, evenly filled within each label."""
    return _shuffled(df, label, key, seed).withColumn(fold, _fold(k)).drop("__ordinal", "__total")


def split_and_fold(
    df: DataFrame, label: str, key: str, fractions: Mapping[str, float], k: int = 5, seed: int = 42, split: str = "split", fold: str = "fold"
) -> DataFrame:
    """Split and folds from one numbering of the rows (one shuffle instead of two)."""
    return _shuffled(df, label, key, seed).withColumns({split: _part(fractions), fold: _fold(k)}).drop("__ordinal", "__total")


def standardize(train: DataFrame, others: Sequence[DataFrame], cols: Sequence[str]) -> list[DataFrame]:
    """Centre and scale by the training mean and population std; zero std counts as 1."""
    stats = train.agg(
        F.struct(
            *[F.avg(c).alias(f"m_{c}") for c in cols],
            *[F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias(f"s_{c}") for c in cols],
        )
    ).scalar()
    return [df.withColumns({c: (F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"] for c in cols}) for df in (train, *others)]


def min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale each column to 0..1; a constant column becomes 0."""
    ends = df.agg(
        F.struct(*[F.min(c).alias(f"a_{c}") for c in cols], *[F.max(c).alias(f"b_{c}") for c in cols])
    ).scalar()
    return df.withColumns(
        {c: F.coalesce(F.try_divide(F.col(c) - ends[f"a_{c}"], ends[f"b_{c}"] - ends[f"a_{c}"]), F.lit(0.0)) for c in cols}
    )


def class_weights(df: DataFrame, label: str, spec: str | Mapping[int, float] = "balanced") -> dict[int, float]:
    """Weight per class: ``balanced`` is n / (classes * n_class), or an explicit mapping."""
    if spec != "balanced":
        return dict(spec)
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    return {c: sum(counts.values()) / (len(counts) * n) for c, n in counts.items()}


def with_class_weight(df: DataFrame, label: str, spec: str | Mapping[int, float] = "balanced", weight: str = "weight") -> DataFrame:
    """Add the weight column of :func:`class_weights`; other classes weigh 1."""
    chain = F.lit(1.0)
    for value, w in class_weights(df, label, spec).items():
        chain = F.when(F.col(label) == value, F.lit(float(w))).otherwise(chain)
    return df.withColumn(weight, chain)


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    """Feature vector of numeric columns."""
    return VectorAssembler(inputCols=list(features), outputCol=output).transform(df)
