"""Ordered computations without a single-task sort.

Ranks, cumulative counts and exact quantiles all need a total order. A window with no
(or one hot) partition key would sort every row in one task, so the value axis is cut
into ranges first: equal values are collapsed to counts before anything is shuffled,
each range is ordered on its own, and the totals of the ranges before it are added.
The cut points only steer balance, any cut points give the same result, so an
approximate percentile sketch from one pass is enough to find them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.session import stage

ROWS_PER_RANGE = 100_000
MAX_RANGES = 16_384
SKETCH_MARKS = 256
QUANTILE_RANGE = 5_000


def value_cuts(
    df: DataFrame,
    columns: Sequence[str],
    rows_per_range: int | None = None,
    max_ranges: int = MAX_RANGES,
) -> dict[str, list[float]]:
    """Cut points per column, about ``max_ranges`` numbers each at most (one action, or two).

    A coarse sketch gives evenly filled ranges; where the table needs more of them, a second
    sketch of the values inside each range, the outer ones too, splits it evenly again.
    """
    rows_per_range = rows_per_range or ROWS_PER_RANGE
    probs = [i / SKETCH_MARKS for i in range(1, SKETCH_MARKS)]
    sketch = df.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[
            F.percentile_approx(F.col(c).cast("double"), probs, 4 * SKETCH_MARKS).alias(f"q{i}")
            for i, c in enumerate(columns)
        ],
    ).first()
    cuts, parts = {}, {}
    for i, c in enumerate(columns):
        wanted = min(max_ranges, max(1, math.ceil(sketch[f"n{i}"] / rows_per_range)))
        marks = [v for v in sketch[f"q{i}"] or [] if math.isfinite(v)]
        coarse = min(wanted, SKETCH_MARKS)
        cuts[c] = sorted(_own_ranges([marks[len(marks) * j // coarse] for j in range(1, coarse)] if marks else []))
        if wanted >= 2 * coarse and cuts[c]:
            parts[c] = wanted // coarse
    for c, inner in _inner_cuts(df, {c: cuts[c] for c in parts}, parts).items():
        cuts[c] = sorted({*cuts[c], *inner})
    return cuts


def _inner_cuts(df: DataFrame, cuts: dict[str, list[float]], parts: dict[str, int]) -> dict[str, set[float]]:
    """Percentiles inside each range of ``cuts``: at most ``SKETCH_MARKS`` rows per column come back."""
    found: dict[str, set[float]] = {c: set() for c in cuts}
    if not cuts:
        return found
    names = list(cuts)
    ranged = with_ranges(df.select(*names), cuts)
    cells = [
        F.struct(F.lit(i).alias("column"), F.col(f"{c}__range").alias("range"), F.col(c).cast("double").alias("value"))
        for i, c in enumerate(names)
    ]
    pieces = max(parts.values())
    probs = [k / pieces for k in range(1, pieces)]
    inside = (
        ranged.select(F.inline(F.array(*cells)))
        .filter(F.col("value").isNotNull() & F.col("range").isNotNull())
        .groupBy("column", "range")
        .agg(F.percentile_approx("value", probs, 8 * pieces).alias("marks"))
    )
    for row in inside.collect():
        found[names[row["column"]]].update(_own_ranges([v for v in row["marks"] if math.isfinite(v)]))
    return found


def _own_ranges(marks: Sequence[float]) -> set[float]:
    """The marks, and a cut right after each value that holds several: it gets a range of its own.

    Marks that are all one value cut nothing off but what lies below it.
    """
    again = {a for a, b in zip(marks, marks[1:]) if a == b}
    return {*marks, *(math.nextafter(v, math.inf) for v in again)} if len(set(marks)) > 1 else set(marks)


def with_ranges(df: DataFrame, cuts: dict[str, list[float]], suffix: str = "__range") -> DataFrame:
    """Add ``<column>__range``, a number that grows with the column's value."""
    columns = list(cuts)
    as_double = df.withColumns({f"{c}__d": F.col(c).cast("double") for c in columns})
    bucketizer = Bucketizer(
        splitsArray=[[-math.inf, *(cuts[c] or [0.0]), math.inf] for c in columns],
        inputCols=[f"{c}__d" for c in columns],
        outputCols=[f"{c}{suffix}" for c in columns],
        handleInvalid="keep",
    )
    return bucketizer.transform(as_double).drop(*[f"{c}__d" for c in columns])


def long_values(
    df: DataFrame,
    columns: Sequence[str],
    by: Sequence[str] = (),
    extra: Sequence[str] = (),
    rows_per_range: int | None = None,
) -> DataFrame:
    """``(by, extra, feature, range, value)`` rows, nulls dropped, one row per cell."""
    narrow = df.select(*by, *extra, *[c for c in columns if c not in by])
    ranged = with_ranges(narrow, value_cuts(narrow, columns, rows_per_range))
    cells = [
        F.struct(
            F.lit(c).alias("feature"),
            F.col(f"{c}__range").cast("int").alias("range"),
            F.col(c).cast("double").alias("value"),
        )
        for c in columns
    ]
    return (
        ranged.select(*by, *extra, F.explode(F.array(*cells)).alias("cell"))
        .select(*by, *extra, "cell.feature", "cell.range", "cell.value")
        .filter(F.col("value").isNotNull() & F.col("range").isNotNull())
    )


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with their counts: ``(by, feature, range, value, n)``."""
    return long_values(df, columns, by).groupBy(*by, "feature", "range", "value").agg(F.count("*").alias("n"))


#: Ranges that one window of offsets adds up, as a power of two.
OFFSET_BITS = 12


def range_offsets(
    counts: DataFrame, keys: Sequence[str], measures: Sequence[str], range_col: str = "range", depth: int = 1
) -> DataFrame:
    """Per key and range: the sum of each measure in earlier ranges, here, and over all.

    With a ``depth`` above 1 the ranges, whole numbers from 0, are added up in that many digits of
    ``OFFSET_BITS`` bits, so that no window holds more rows than a digit has values.
    """
    totals = counts.groupBy(*keys, range_col).agg(*[F.sum(m).alias(m) for m in measures])
    if depth > 1:
        group = f"{range_col}__group"
        grouped = totals.withColumn(group, F.floor(F.col(range_col) / (1 << OFFSET_BITS)).cast("long"))
        upper = range_offsets(grouped, keys, measures, group, depth - 1).drop(*[f"inside_{m}" for m in measures])
        before = W.partitionBy(*keys, group).orderBy(range_col).rowsBetween(W.unboundedPreceding, -1)
        inside = grouped.withColumns({f"__before_{m}": F.coalesce(F.sum(m).over(before), F.lit(0)) for m in measures})
        joined = null_safe_join(inside, upper, [*keys, group])
        return joined.select(
            *keys, range_col, *[(F.col(f"offset_{m}") + F.col(f"__before_{m}")).alias(f"offset_{m}") for m in measures],
            *[F.col(m).alias(f"inside_{m}") for m in measures], *[f"total_{m}" for m in measures],
        )
    ordered = W.partitionBy(*keys).orderBy(range_col)
    earlier = ordered.rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    return totals.select(
        *keys,
        range_col,
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"offset_{m}") for m in measures],
        *[F.col(m).alias(f"inside_{m}") for m in measures],
        *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures],
    )


def running_totals(
    counts: DataFrame,
    keys: Sequence[str],
    measures: Sequence[str] = ("n",),
    value: str = "value",
    range_col: str = "range",
    offsets: DataFrame | None = None,
) -> DataFrame:
    """Add ``before_<m>`` (sum over smaller values of the same key) and ``total_<m>``.

    ``counts`` holds one row per key and value. A filtered ``offsets`` limits the work to
    the ranges it still lists.
    """
    offsets = range_offsets(counts, keys, measures, range_col) if offsets is None else offsets
    inside = W.partitionBy(*keys, range_col).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    joined = counts.join(offsets, [*keys, range_col])
    before = {
        f"before_{m}": F.col(f"offset_{m}") + F.coalesce(F.sum(m).over(inside), F.lit(0)) for m in measures
    }
    return joined.withColumns(before).drop(
        *[f"offset_{m}" for m in measures], *[f"inside_{m}" for m in measures]
    )


def quantiles(
    df: DataFrame, columns: Sequence[str], probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation: ``(by, feature, <name>...)``.

    Row counts per range (a shuffle of a few numbers) show which ranges hold a wanted
    position; only the rows of those ranges are counted by value and ordered. Null keys
    in ``by`` are dropped.
    """
    rows = long_values(df.na.drop(subset=list(by)) if by else df, columns, by, rows_per_range=QUANTILE_RANGE)
    keys = [*by, "feature"]

    def position(p: float) -> Column:
        return (F.col("total_n") - 1) * F.lit(float(p))

    def holds(index: Column, start: str, size: str) -> Column:
        return (F.col(start) <= index) & (index < F.col(start) + F.col(size))

    wanted = [end(position(p)) for p in probs.values() for end in (F.floor, F.ceil)]
    needed = reduce(Column.__or__, [holds(i, "offset_n", "inside_n") for i in wanted])
    offsets = range_offsets(rows.withColumn("n", F.lit(1)), keys, ["n"]).filter(needed)
    counts = (
        rows.join(offsets, [*keys, "range"])
        .groupBy(*keys, "range", "value", "offset_n", "total_n")
        .agg(F.count("*").alias("n"))
    )
    inside = W.partitionBy(*keys, "range").orderBy("value").rowsBetween(W.unboundedPreceding, -1)
    placed = counts.withColumn("before_n", F.col("offset_n") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    picks = [
        F.max(F.when(holds(end(position(p)), "before_n", "n"), F.col("value"))).alias(f"{name}__{label}")
        for name, p in probs.items()
        for end, label in ((F.floor, "lo"), (F.ceil, "hi"))
    ]
    picked = placed.groupBy(*keys).agg(F.max("total_n").alias("total_n"), *picks)
    out = []
    for name, p in probs.items():
        low, high, pos = F.col(f"{name}__lo"), F.col(f"{name}__hi"), position(p)
        out.append((low + (high - low) * (pos - F.floor(pos))).alias(name))
    return picked.select(*keys, *out)


def average_ranks(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rank of every distinct value, ties averaged: ``(by, feature, value, n, total_n, rank)``."""
    placed = running_totals(value_counts(df, columns, by), [*by, "feature"])
    return placed.select(
        *by, "feature", "value", "n", "total_n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank")
    )


def row_ordinals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str | Column],
    range_col: str,
    ordinal: str = "ordinal",
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row within its key, however many rows the key has.

    ``range_col`` must not decrease along ``order``; rows of one key are spread over it. Null
    keys and ranges are values like others, so no row is lost.
    """
    offsets = range_offsets(df.select(*by, range_col, F.lit(1).alias("n")), by, ["n"], range_col)
    inside = W.partitionBy(*by, range_col).orderBy(*order)
    out = null_safe_join(df, offsets, [*by, range_col]).withColumn(
        ordinal, (F.col("offset_n") + F.row_number().over(inside)).cast("long")
    )
    if total:
        out = out.withColumnRenamed("total_n", total)
    return out.drop("offset_n", "inside_n", "total_n")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which nulls meet each other; the keys appear once."""
    other = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"__right_{k}" for k in keys])


def text_ranges(df: DataFrame, columns: Sequence[str], range_col: str = "range") -> DataFrame:
    """Rows with a range number that grows along ``columns``, of any type, nulls last.

    Spark's range partitioner finds the cuts. The rows are written once, so the numbers stay
    the same however often they are read.
    """
    order = [F.col(c).asc_nulls_last() for c in columns]
    spread = df.repartitionByRange(*order).withColumn(range_col, F.spark_partition_id().cast("double"))
    return stage(spread)
