"""The pipeline stage by stage, each against a brute-force version of its operator on its own input."""

import re

import numpy as np
import public_tokenizers
import pytest
import test_contamination
import test_simhash
from tokenizers import Tokenizer

import __spark_entry__ as driver
import corpus_pipeline
from wardlight.llm.common import written

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, as ``run`` passes them on."""
    docs, seen = spark.read.parquet(f"{MEDIUM}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, MEDIUM), "stage")
        seen.append((name, docs, after))
        docs = after
    return seen


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_stages_are_the_agreed_ones_and_keep_the_columns(stages):
    assert [name for name, _, _ in stages] == [name for name, _ in corpus_pipeline.STAGES]
    first = stages[0][1]
    for _, _, after in stages[:-1]:
        assert after.dtypes == first.dtypes


def test_language_stage_keeps_prose(stages):
    _, before, after = stages[0]
    kept = dict(texts(after))
    lost = [t for i, t in texts(before) if i not in kept]
    assert all(kept[i] == t for i, t in texts(before) if i in kept)
    assert len(lost) <= 0.02 * before.count()


def test_near_duplicate_stage(stages):
    _, before, after = stages[1]
    want = {component for _, _, component in test_simhash.plain(texts(before))}
    assert sorted(i for i, _ in texts(after)) == sorted(want)


def test_contamination_stage(spark, stages):
    _, before, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {row[0] for row in test_contamination.brute(texts(before), items) if not row[5]}
    assert {i for i, _ in texts(after)} == clean and len(clean) < before.count()


def test_secret_stage(stages):
    _, before, after = stages[3]
    old, new = dict(texts(before)), dict(texts(after))
    assert set(old) == set(new)
    for i, t in old.items():
        assert new[i] == re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")', "[SECRET]", t)


def test_token_stage(stages):
    _, before, after = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = {r.doc_id: r for r in after.collect()}
    docs = texts(before)
    assert len(rows) == len(docs)
    for i, t in docs:
        want = tokenizer.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == want
        assert rows[i].n_tokens == len(want) and rows[i].round_trip


def test_run_gives_the_last_stage(spark, stages):
    got = driver.queries()["pipeline"](spark, MEDIUM)
    assert sorted((r.doc_id, bytes(r.ids)) for r in got.collect()) == sorted((r.doc_id, bytes(r.ids)) for r in stages[-1][2].collect())


def test_stages_with_edge_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "some words here", "en", "s", 15), (3, "some words here", "en", "s", 15), (None, "null id words", None, "s", 13), (4, "w " * 70000, "en", None, None)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, MEDIUM), "edge")
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, MEDIUM).count() == docs.count()


def test_entry_lists_every_operator():
    names = set(driver.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
