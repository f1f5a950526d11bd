"""Readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CODE_DICTIONARY = T.StructType(
    [
        T.StructField("ID", T.IntegerType()),
        T.StructField("description", T.StringType()),
        T.StructField("Type", T.StringType()),
    ]
)


def read_encounters(
    spark: SparkSession, path: str, schema: T.StructType | None = None, required: Sequence[str] = ()
) -> DataFrame:
    """Encounter table from parquet, or from CSV with a header when ``path`` ends in .csv."""
    if path.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV source needs an explicit schema")
        df = spark.read.csv(path, header=True, schema=schema)
    else:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing in {path}: {missing}")
    return df


def combine_parts(ids: DataFrame | None, features: DataFrame, targets: DataFrame, key: Sequence[str]) -> DataFrame:
    """One encounter table from separately stored ids, features and targets, joined on the key."""
    df = features.join(targets, list(key))
    return ids.join(df, list(key)) if ids is not None else df


def read_code_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Stacked id dictionary; the text ``NULL`` is a missing description, blanks are kept."""
    return spark.read.csv(
        path,
        header=True,
        schema=CODE_DICTIONARY,
        nullValue="NULL",
        quote='"',
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )


def read_model_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, drop: Sequence[str] = ("Unnamed: 0",)
) -> DataFrame:
    """Modelling table (CSV or parquet) without the saved index column."""
    return read_encounters(spark, path, schema).drop(*drop)
