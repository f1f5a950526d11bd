"""Queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardlight.llm import bpe, collocations, contamination, imatch, langid, merkle, mixing, oracles, secrets, simhash, substrings, surrogates, token_files, toxicity
from wardlight.llm.common import read_table

LLM_QUERIES = {}
LLM_ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.json"
END_ID = 2
SURROGATE_KEY = "corpus release 1"


def llm_query(fn, sql: str | None = None):
    """Register ``(spark, folder) -> DataFrame`` under the function's name, with the SQL that checks it."""
    LLM_QUERIES[fn.__name__] = fn
    if sql:
        LLM_ORACLES[fn.__name__] = sql
    return fn


def checked_by(sql: str):
    return lambda fn: llm_query(fn, sql)


@llm_query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(read_table(spark, folder, "documents"))


@llm_query
def op2_imatch(spark: SparkSession, folder: str) -> DataFrame:
    return imatch.fingerprints(read_table(spark, folder, "documents"))


@llm_query
def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_findings(read_table(spark, folder, "documents"))


@llm_query
def op4_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE))


@llm_query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_table(read_table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), END_ID)


@checked_by(oracles.DECONTAMINATION)
def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination.contamination(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@llm_query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scores(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"))


@llm_query
def op8_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, SURROGATE_KEY)


@checked_by(oracles.SUFFIX_DEDUP)
def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeated_passages(read_table(spark, folder, "documents"))


@llm_query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, folder, "documents"))


@checked_by(oracles.merkle())
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.tampering(read_table(spark, folder, "documents"))


@checked_by(oracles.COLLOCATIONS)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read_table(spark, folder, "documents"))


@checked_by(oracles.MIXING)
def op13_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(read_table(spark, folder, "documents"))
