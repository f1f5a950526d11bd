"""Writers and the small report frames that feed them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header; one file per partition. Blanks around values are kept."""
    df.write.mode(mode).option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``metric: value`` lines of a two-column report."""
    name, value = df.columns
    line = F.concat_ws(": ", F.col(name), F.col(value).cast("string"))
    df.select(line.alias("value")).write.mode(mode).text(path)


def metric_rows(one_row: DataFrame, metrics: Mapping[str, Column], name: str = "metric", value: str = "value") -> DataFrame:
    """Turn computed columns of a one-row frame into ``(metric, value)`` rows."""
    pairs = [F.struct(F.lit(k).alias(name), v.cast("double").alias(value)) for k, v in metrics.items()]
    return one_row.select(F.inline(F.array(*pairs)))
