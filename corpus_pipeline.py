"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage works on all that its predecessor kept. All but the last return the columns of
``documents``, under their own names; the last returns each document's token ids. Texts of
any length are read whole, and an empty table passes through as an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardlight.llm import bpe, contamination, langid, secrets, simhash
from wardlight.llm.common import read_table, written

#: A document whose mean position probability stays below this has no language of its own.
MIN_LANGUAGE_SCORE = 0.4
SHINGLE_WORDS, MAX_BITS = 3, 3
TOKENIZER = "byte_bpe_50k.json"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network finds; those without letters or without a likely language go.

    So do null and empty texts. Repeated rows are judged each; null ids and languages teach nothing.
    """
    return langid.with_known_language(docs, MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group, that with the smallest id.

    Null, empty and wordless texts are one group. Of rows with equal ids one stays; rows without an id all stay.
    """
    return simhash.one_per_component(docs, words=SHINGLE_WORDS, max_bits=MAX_BITS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by passages of ``benchmark``.

    Null and empty texts stay; repeated rows are judged each; an empty ``benchmark`` leaves all.
    """
    return contamination.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def masked_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with confirmed secrets masked in their texts.

    Null texts stay null; ``n_chars`` follows a changed text; repeated rows are masked alike.
    """
    return secrets.masked(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, round_trip)``: token ids, and whether they decode to the text.

    Null and empty texts have no ids; repeated rows each keep a row.
    """
    path = public_tokenizers.path(TOKENIZER)
    return bpe.encoded(docs, path)


STAGES = [
    ("language ID", known_language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", masked_secrets),
    ("BPE encoding and decoding", tokens),
]

#: Models, fingerprints and tokenizers are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
