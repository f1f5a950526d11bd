"""Sums over all pairs of columns in one pass, as matrix products of Arrow batches.

Each task keeps one matrix per sum and emits a row per pair at its end, so the plan and the
shuffle hold no aggregate per pair of columns, however wide the table is.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_ROWS = 4096
SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")


def _pair_sums(df: DataFrame, width: int, products) -> DataFrame:
    """Sums ``(a, b, *SUMS)`` for column numbers ``a < b`` from ``products(values, known)`` of each batch."""
    a, b = np.triu_indices(width, 1)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(SUMS), len(a)))
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                known = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
                values = np.column_stack([c.fill_null(0).to_numpy(zero_copy_only=False) for c in part.columns]).astype(float)
                total += products(values, known)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *map(pa.array, total)], names=["a", "b", *SUMS])

    sums = df.mapInArrow(add_up, "a long, b long, " + ", ".join(f"{s} double" for s in SUMS))
    return sums.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])


def pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(a, b, n, sa, sb, saa, sbb, sab)`` over the rows where both columns are known.

    Values are taken from their column's mean, found in a pass before, so the sums stay small.
    """
    middle = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    shifted = df.select(*[(F.col(c).cast("double") - F.lit(middle[f"m{i}"] or 0.0)).alias(f"x{i}") for i, c in enumerate(cols)])
    a, b = np.triu_indices(len(cols), 1)

    def products(x: np.ndarray, known: np.ndarray) -> np.ndarray:
        first, second = x.T @ known, (x * x).T @ known
        return np.stack([(known.T @ known)[a, b], first[a, b], first[b, a], second[a, b], second[b, a], (x.T @ x)[a, b]])

    return _pair_sums(shifted, len(cols), products)


def joint_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The same columns for null indicators: ``n`` rows, ``sa`` and ``sb`` nulls, ``sab`` joint nulls."""
    marks = df.select(*[F.col(c).isNull().cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    a, b = np.triu_indices(len(cols), 1)

    def products(x: np.ndarray, known: np.ndarray) -> np.ndarray:
        alone = x.sum(axis=0)
        rows = np.full(len(a), float(len(x)))
        return np.stack([rows, alone[a], alone[b], alone[a], alone[b], (x.T @ x)[a, b]])

    return _pair_sums(marks, len(cols), products)
