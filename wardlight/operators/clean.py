"""Column dropping, filling, imputing and row filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.operators.ordered import quantiles
from wardlight.operators.quality import dominant_shares, null_counts

STATUS_VALUES = ("Yes", "No", "Steady", "Up", "Down")
STATUS_KEYWORDS = (
    "insulin", "metformin", "glipizide", "glyburide", "pioglitazone", "rosiglitazone", "medication", "drug", "med",
)


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop the named columns that exist."""
    return df.drop(*[c for c in cols if c in df.columns])


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns that must exist."""
    absent = [c for c in cols if c not in df.columns]
    if absent:
        raise ValueError(f"no such columns: {absent}")
    return df.drop(*cols)


def drop_sparse(df: DataFrame, max_missing: float) -> DataFrame:
    """Drop columns whose share of nulls exceeds ``max_missing``."""
    total, nulls = null_counts(df)
    return df.drop(*[c for c, n in nulls.items() if total and n / total > max_missing])


def drop_low_variance(df: DataFrame, ids: Sequence[str], threshold: float = 0.01) -> DataFrame:
    """Drop columns where one value (null included) covers more than ``1 - threshold`` of the rows."""
    if not 0 <= threshold < 0.5:
        raise ValueError("threshold must be below one half")
    flagged = [
        p.column for p in dominant_shares(df, ids) if p.count == p.total or p.count > (1 - threshold) * p.total
    ]
    return df.drop(*flagged)


def fill_category(df: DataFrame, fills: Mapping[str, str]) -> DataFrame:
    """Replace nulls by a category label."""
    return df.fillna(dict(fills))


def impute(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Median for numeric columns, most frequent value (smallest on ties) for strings.

    Only columns that have nulls are profiled.
    """
    _, nulls = null_counts(df.drop(*exclude))
    numeric, text = split_by_type(df)
    gaps = [c for c, n in nulls.items() if n]
    fills: dict[str, object] = {}
    num_gaps = [c for c in gaps if c in numeric]
    if num_gaps:
        for row in quantiles(df, num_gaps, {"median": 0.5}).collect():
            fills[row["feature"]] = row["median"]
    text_gaps = [c for c in gaps if c in text]
    if text_gaps:
        counts = (
            df.select(text_gaps)
            .unpivot([], text_gaps, "feature", "value")
            .filter(F.col("value").isNotNull())
            .groupBy("feature", "value")
            .count()
        )
        modes = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("count"), "value")).alias("mode"))
        fills.update({r["feature"]: r["mode"] for r in modes.collect()})
    whole = {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in fills.items() if c in numeric}
    words = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items() if c in text}
    return df.withColumns({**whole, **words}) if fills else df


def drop_null_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with no null in ``cols`` (all columns by default)."""
    return df.na.drop(subset=list(cols) if cols else None)


def filter_in(df: DataFrame, col: str, values: Sequence[object]) -> DataFrame:
    """Keep rows whose value is in a short fixed list."""
    return df.filter(F.col(col).isin(list(values)))


def both_measured(a: Column, b: Column) -> Column:
    """Both results are present."""
    return a.isNotNull() & b.isNotNull()


def exactly_one(a: Column, b: Column) -> Column:
    """One result is present, the other is not."""
    return a.isNull() != b.isNull()


def feature_columns(df: DataFrame, exclude: Sequence[str], first: int | None = None) -> list[str]:
    """All columns but the excluded ones, optionally only the first few."""
    names = [c for c in df.columns if c not in set(exclude)]
    return names[:first]


def split_by_type(df: DataFrame) -> tuple[list[str], list[str]]:
    """Numeric columns and the others, in schema order."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    return numeric, [c for c in df.columns if c not in numeric]


def detect_status_columns(
    df: DataFrame,
    keywords: Sequence[str] = STATUS_KEYWORDS,
    values: Sequence[str] = STATUS_VALUES,
    max_distinct: int = 5,
    outcome: str = "readmitted",
) -> list[str]:
    """Names of medication-like columns, by keyword first and then by their values.

    A string column qualifies by value when it has few distinct values, one of them a
    status word. Columns that are clearly too varied are ruled out by a sketch first, so
    the exact count only ever sees short value sets.
    """
    named = [c for c in df.columns if any(k in c.lower() for k in keywords)]
    text = [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.StringType) and f.name not in named and f.name != outcome
    ]
    if not text:
        return named
    profile = df.agg(
        *[F.approx_count_distinct(c, 0.05).alias(f"d{i}") for i, c in enumerate(text)],
        *[F.max(F.col(c).isin(list(values)).cast("int")).alias(f"s{i}") for i, c in enumerate(text)],
    ).first()
    likely = [c for i, c in enumerate(text) if profile[f"s{i}"] == 1 and profile[f"d{i}"] <= 2 * max_distinct]
    if not likely:
        return named
    exact = df.agg(*[F.count_distinct(c).alias(c) for c in likely]).first()
    return named + [c for c in likely if exact[c] <= max_distinct]


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key; the same rows every time."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    return df.orderBy(order, key).limit(n)
