"""Distribution summaries, histograms, density estimates and normality statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions.scalars import horner, normal_quantile, plogp
from wardlight.functions.tails import log_normal_cdf, royston_p
from wardlight.operators.ordered import quantiles, running_totals, value_counts

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def numeric_cells(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, feature, value)`` rows of numeric columns as doubles, nulls kept."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols]
    return df.select(*by, F.inline(F.array(*cells)))


def describe_numeric(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Count, missing, mean, std, min, quartiles, max, biased skew and excess kurtosis."""
    x = F.col("value")
    moments = (
        numeric_cells(df, cols, by)
        .groupBy(*by, "feature")
        .agg(
            F.count(x).alias("count"), F.count_if(x.isNull()).alias("missing"), F.avg(x).alias("mean"),
            F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.skewness(x).alias("skewness"), F.kurtosis(x).alias("kurtosis"),
        )
    )
    return moments.join(quantiles(df, cols, QUARTILES, by), [*by, "feature"], "left")


def describe_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct values, mode (smallest on ties), mode count, missing and entropy per column."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols]
    counts = df.select(F.inline(F.array(*cells))).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("value").isNotNull(), F.col("n"))
    totals = counts.groupBy("feature").agg(
        F.sum(known).alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing")
    )
    joined = counts.filter(F.col("value").isNotNull()).join(totals, "feature")
    return joined.groupBy("feature").agg(
        F.count(F.lit(1)).alias("unique"),
        F.min_by("value", F.struct(-F.col("n"), "value")).alias("mode"),
        F.max("n").alias("mode_count"),
        F.max("missing").alias("missing"),
        F.sum(plogp(F.col("n") / F.col("rows"))).alias("entropy"),
    )


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over each column's whole range, last bin closed.

    ``(by, feature, bin, low, high, n, density)``; empty bins are left out. The range is
    found first (two numbers per column) so that the counting pass shuffles at most
    ``bins`` rows per group and task.
    """
    ends = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"a{i}") for i, c in enumerate(cols)],
        *[F.max(F.col(c).cast("double")).alias(f"b{i}") for i, c in enumerate(cols)],
    ).first()
    cells = []
    for i, c in enumerate(cols):
        low, high = ends[f"a{i}"], ends[f"b{i}"]
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        width = (high - low) / bins
        slot = F.least(F.floor((F.col(c).cast("double") - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        cells.append(
            F.struct(F.lit(c).alias("feature"), slot.alias("bin"), F.lit(low).alias("start"), F.lit(width).alias("width"))
        )
    counts = (
        df.select(*by, F.inline(F.array(*cells)))
        .filter(F.col("bin").isNotNull())
        .groupBy(*by, "feature", "bin", "start", "width")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rows = F.sum("n").over(W.partitionBy(*by, "feature"))
    return counts.select(
        *by, "feature", "bin",
        (F.col("start") + F.col("bin") * F.col("width")).alias("low"),
        (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("high"),
        "n", (F.col("n") / (rows * F.col("width"))).alias("density"),
    )


def choose_view(
    df: DataFrame, cols: Sequence[str], outcome: str = "readmitted", skew_threshold: float = 1.0,
    min_rows: int = 100, bins: int = 20,
) -> DataFrame:
    """Box plot or distribution plot per feature: by size, skew, then number of histogram peaks."""
    known = df.filter(F.col(outcome).isNotNull())
    moments = (
        numeric_cells(known, cols).groupBy("feature").agg(F.count("value").alias("rows"), F.abs(F.skewness("value")).alias("skew"))
    )
    by_bin = W.partitionBy("feature").orderBy("bin")
    # a missing neighbour bin is an empty one
    left = F.when(F.lag("bin").over(by_bin) == F.col("bin") - 1, F.lag("n").over(by_bin)).otherwise(0)
    right = F.when(F.lead("bin").over(by_bin) == F.col("bin") + 1, F.lead("n").over(by_bin)).otherwise(0)
    peaks = (
        histogram(known, cols, bins)
        .select("feature", ((F.col("n") > left) & (F.col("n") > right) & F.col("bin").between(1, bins - 2)).alias("peak"))
        .groupBy("feature")
        .agg(F.count_if("peak").alias("peaks"))
    )
    view = (
        F.when(F.col("rows") < min_rows, "boxplot")
        .when(F.col("skew") > skew_threshold, "distribution")
        .when(F.col("peaks") > 1, "distribution")
        .otherwise("boxplot")
    )
    return moments.join(peaks, "feature", "left").select("feature", "rows", "skew", "peaks", view.alias("view"))


def box_stats(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whisker ends and outlier counts (1.5 times the quartile distance)."""
    box = quantiles(df, cols, QUARTILES, by)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    fences = box.withColumns({"__low": F.col("q1") - reach, "__high": F.col("q3") + reach})
    rows = numeric_cells(df.na.drop(subset=list(by)) if by else df, cols, by).filter(F.col("value").isNotNull())
    placed = rows.join(fences, [*by, "feature"])
    x = F.col("value")
    inside = x.between(F.col("__low"), F.col("__high"))
    return placed.groupBy(*by, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min(x).alias("min"),
        F.min(F.when(inside, x)).alias("whisker_low"),
        F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.max(F.when(inside, x)).alias("whisker_high"), F.max(x).alias("max"),
        F.count_if(~inside).alias("outliers"),
    )


def kde(df: DataFrame, col: str, points: int = 200, by: Sequence[str] = ()) -> DataFrame:
    """Gaussian density on an even grid over the whole range, Scott bandwidth per group.

    Equal values are collapsed first; every task then adds the kernels of its values into
    one number per grid point, so only ``points`` rows per group and task are shuffled.
    """
    x = F.col(col).cast("double")
    rows = df.filter(x.isNotNull()).select(*by, x.alias("value"))
    if by:
        rows = rows.na.drop(subset=list(by))
    ends = rows.agg(F.min("value").alias("low"), F.max("value").alias("high")).first()
    low, high = ends["low"], ends["high"]
    fields = [f for f in rows.schema if f.name in by]
    out = T.StructType([*fields, T.StructField("point", T.IntegerType()), T.StructField("density", T.DoubleType())])
    if low is None:
        return df.sparkSession.createDataFrame([], out).withColumn("x", F.lit(0.0))
    grid = np.linspace(low, high, points)
    counts = rows.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"))
    spread = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.stddev_samp("value").alias("std"))
    width = spread.select(*by, "rows", (F.col("std") * F.pow("rows", F.lit(-0.2))).alias("h")).filter(F.col("h") > 0)
    if by:
        joined = counts.join(width, list(by))
    else:
        one = width.select(F.struct("rows", "h").alias("w")).scalar()
        joined = counts.withColumns({"rows": one["rows"], "h": one["h"]})
    keys = list(by)

    def add_kernels(batches):
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            parts = batch.groupby(keys, sort=False) if keys else [((), batch)]
            for key, part in parts:
                h = part["h"].to_numpy()[:, None]
                z = (grid[None, :] - part["value"].to_numpy()[:, None]) / h
                kernel = np.exp(-0.5 * z * z) / (h * part["rows"].to_numpy()[:, None] * math.sqrt(2 * math.pi))
                total = part["n"].to_numpy() @ kernel
                sums[key] = sums[key] + total if key in sums else total
        for key, total in sums.items():
            yield pd.DataFrame({**dict(zip(keys, key)), "point": np.arange(points, dtype="int32"), "density": total})

    partial = joined.mapInPandas(add_kernels, out)
    place = F.lit(low) + F.col("point") * F.lit((high - low) / (points - 1))
    return partial.groupBy(*by, "point").agg(F.sum("density").alias("density")).select(*by, "point", place.alias("x"), "density")


def sorted_positions(df: DataFrame, cols: Sequence[str], chunk: int = 100_000) -> DataFrame:
    """``(feature, total_n, position, value)``: every value of each column at its 1-based place in order.

    Places come from running counts over distinct values; a value that fills many places is
    unrolled in chunks spread over tasks.
    """
    placed = running_totals(value_counts(df, cols), ["feature"])
    first = F.col("before_n") + 1
    last = F.col("before_n") + F.col("n")
    chunks = placed.select("feature", "value", "total_n", last.alias("last"), F.explode(F.sequence(first, last, F.lit(chunk))).alias("from"))
    upto = F.least(F.col("last"), F.col("from") + (chunk - 1))
    spread = chunks.repartition("feature", "from")
    return spread.select("feature", "total_n", F.explode(F.sequence(F.col("from"), upto)).alias("position"), "value")


def qq_points(df: DataFrame, col: str, chunk: int = 100_000) -> DataFrame:
    """Every sorted sample point against the normal quantile of ``(i - 0.5) / n``."""
    rows = sorted_positions(df, [col], chunk)
    p = (F.col("position") - 0.5) / F.col("total_n")
    return rows.select("position", normal_quantile(p).alias("theoretical"), F.col("value").alias("sample"))


def qq_line(df: DataFrame, col: str) -> DataFrame:
    """Ends of the reference line: normal quantile range scaled by mean and std."""
    x = F.col(col).cast("double")
    one = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))
    low = normal_quantile(0.5 / F.col("n"))
    return one.select(
        low.alias("from_x"), (F.col("mean") + F.col("std") * low).alias("from_y"),
        (-low).alias("to_x"), (F.col("mean") - F.col("std") * low).alias("to_y"),
    )


# Royston (1995) polynomials for the two outermost weights, highest power first.
_ROYSTON_LAST = (-2.706056, 4.434685, -2.071190, -0.147981, 0.221157)
_ROYSTON_NEXT = (-3.582633, 5.682633, -1.752461, -0.293762, 0.042981)


ROYSTON_ROWS = 5000


def shapiro_wilk(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Shapiro-Wilk W and p of features with three or more values, however many; null below.

    The weight of the i-th smallest value is its normal score ``q((i - 0.375) / (n + 0.25))``,
    scaled, but for the two outermost at each end, which have polynomials in ``n``. So W needs
    two sums over all places and the values at four of them. Royston's p is stated for fewer
    than 5000 values; beyond, it is given all the same and ``p_valid`` is false.
    """
    n, i, x = F.col("n"), F.col("position"), F.col("value")
    score = normal_quantile((i - 0.375) / (F.col("total_n") + 0.25))
    rows = sorted_positions(df, cols).withColumn("m", score)
    at = lambda place: F.max(F.when(i == place, x))
    score_at = lambda place: F.max(F.when(i == place, F.col("m")))
    last = F.col("total_n")
    sums = rows.groupBy("feature").agg(
        F.max(last).cast("double").alias("n"), (F.var_pop(x) * F.count(x)).alias("spread"),
        F.sum(F.col("m") * F.col("m")).alias("mm"), F.sum(F.col("m") * x).alias("mx"),
        (at(last) - at(F.lit(1))).alias("outer"), (at(last - 1) - at(F.lit(2))).alias("next"),
        score_at(last).alias("m1"), score_at(last - 1).alias("m2"),
    )
    u = 1 / F.sqrt(n)
    end = horner(u, [*_ROYSTON_LAST, 0.0]) + F.col("m1") / F.sqrt("mm")
    second = horner(u, [*_ROYSTON_NEXT, 0.0]) + F.col("m2") / F.sqrt("mm")
    a1 = F.when(n == 3, F.lit(math.sqrt(0.5))).otherwise(end)
    a2 = F.when(n > 5, second)
    both = sums.withColumns({"a1": a1, "a2": a2})
    inner = F.when(
        F.col("a2").isNull(), (F.col("mm") - 2 * F.col("m1") ** 2) / (1 - 2 * F.col("a1") ** 2)
    ).otherwise(
        (F.col("mm") - 2 * F.col("m1") ** 2 - 2 * F.col("m2") ** 2) / (1 - 2 * F.col("a1") ** 2 - 2 * F.col("a2") ** 2)
    )
    middle = F.col("mx") - F.col("m1") * F.col("outer") - F.when(F.col("a2").isNull(), 0.0).otherwise(F.col("m2") * F.col("next"))
    ends = F.col("a1") * F.col("outer") + F.when(F.col("a2").isNull(), 0.0).otherwise(F.col("a2") * F.col("next"))
    total = F.when(n == 3, ends).otherwise(middle / F.sqrt(inner) + ends)
    w = F.when((n >= 3) & (F.col("spread") > 0), total * total / F.col("spread"))
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    stat = names.join(both.select("feature", n.cast("long").alias("rows"), w.alias("w")), "feature", "left")
    tested = stat.withColumns({"rows": F.coalesce("rows", F.lit(0)), "p": royston_p("w", F.col("rows").cast("double"))})
    return tested.withColumns({"normal": F.col("p") > 0.05, "p_valid": F.col("rows") < ROYSTON_ROWS})


def anderson_darling(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Anderson-Darling statistic against the normal, with the 5 % critical value.

    With ``F_i`` the distribution function at the i-th smallest value, the statistic is
    a sum of ``(2i-1) ln F_i + (2(n-i)+1) ln(1-F_i)``. Tied values share one term, so the sum
    runs over distinct values with running counts.
    """
    cells = numeric_cells(df, cols).filter(F.col("value").isNotNull())
    moments = cells.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    placed = running_totals(value_counts(df, cols), ["feature"]).join(moments, "feature")
    z = (F.col("value") - F.col("mean")) / F.col("std")
    k, n, total = F.col("before_n"), F.col("n"), F.col("total_n")
    # sums of 2i-1 and of 2(total-i)+1 over the positions k+1 .. k+n
    up = n * (2 * k + n)
    down = n * (2 * total - 2 * k - n)
    term = up * log_normal_cdf(z) + down * log_normal_cdf(-z)
    stat = placed.groupBy("feature").agg(F.max("total_n").alias("rows"), F.sum(term).alias("s"))
    size = F.col("rows").cast("double")
    critical = F.bround(0.787 / (1 + 4 / size - 25 / (size * size)), 3)
    statistic = -size - F.col("s") / size
    return stat.select("feature", "rows", statistic.alias("statistic"), critical.alias("critical_5pct"), (statistic < critical).alias("normal"))
