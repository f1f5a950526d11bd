"""Column-to-column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def code_number(col: Column) -> Column:
    """Numeric reading of a code, null when it is not a number.

    A cast alone would also read a trailing type letter, as in ``250d``.
    """
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def half_even(col: Column, digits: int) -> Column:
    """Round halves to the even neighbour."""
    return F.bround(col, digits)


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``scale * part / whole``, null when ``whole`` is zero."""
    return F.try_divide(part * F.lit(float(scale)), whole)


def rate(condition: Column) -> Column:
    """Percentage of rows that satisfy ``condition``; a null condition counts as no."""
    hit = F.sum(F.when(condition, 1).otherwise(0))
    return share(hit, F.count(F.lit(1)))


def label_text(col: Column) -> Column:
    """Column-style name to title case with blanks."""
    return F.initcap(F.replace(col, F.lit("_"), F.lit(" ")))


def truncate_label(col: Column, n: int = 20) -> Column:
    """Cut text longer than ``n`` and mark the cut with three dots."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def join_labels(cols: Sequence[Column]) -> Column:
    """Join the non-null labels with a comma and a blank."""
    return F.concat_ws(", ", *cols)


def map_values(col: Column, mapping: Mapping[str, float]) -> Column:
    """Replace values through a small fixed mapping, null for anything else."""
    first, *rest = mapping.items()
    chain = F.when(col == first[0], F.lit(first[1]))
    for key, value in rest:
        chain = chain.when(col == key, F.lit(value))
    return chain


def bin_right_closed(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edge, next edge]`` that holds the value, null outside."""
    chain = F.when(col <= edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        chain = chain.when(col <= upper, F.lit(label))
    return chain


def measured_flag(col: Column, missing: str = "Not Measured", present: str = "Measured") -> Column:
    """Two-way status of a test result."""
    return F.when(col.isNull(), F.lit(missing)).otherwise(F.lit(present))


def outcome_flag(col: Column, positive: str = "<30") -> Column:
    """1 for the positive outcome class, 0 for the others, null stays null."""
    return (col == positive).cast("int")


def plogp(p: Column) -> Column:
    """``-p log2 p`` with the small constant that keeps ``p = 0`` finite."""
    return -p * F.log2(p + F.lit(1e-10))


def horner(x: Column, coefficients: Sequence[float]) -> Column:
    """Polynomial of ``x``, highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


# Acklam's rational approximation of the inverse normal distribution.
_ACKLAM_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
             1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_ACKLAM_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
             6.680131188771972e01, -1.328068155288572e01, 1.0]
_ACKLAM_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
             -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_ACKLAM_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
             3.754408661907416e00, 1.0]
_ACKLAM_LOW = 0.02425


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function (relative error 1.2e-9)."""
    low = F.sqrt(-2 * F.log(p))
    high = F.sqrt(-2 * F.log(1 - p))
    centre = p - 0.5
    square = centre * centre
    return (
        F.when(p < _ACKLAM_LOW, horner(low, _ACKLAM_C) / horner(low, _ACKLAM_D))
        .when(p > 1 - _ACKLAM_LOW, -horner(high, _ACKLAM_C) / horner(high, _ACKLAM_D))
        .otherwise(horner(square, _ACKLAM_A) * centre / horner(square, _ACKLAM_B))
    )
