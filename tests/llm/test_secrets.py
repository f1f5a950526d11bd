"""Candidates, forest and masking."""

import re

import numpy as np
import pytest

from wardlight.llm import secrets
from wardlight.llm.queries import LLM_QUERIES

MEDIUM = "/root/testdata/sf0.01"
HEX = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(spark.read.parquet(f"{MEDIUM}/documents.parquet"))


def test_forest_on_unseen_findings(model):
    findings = secrets.labelled_findings(1500, seed=77)
    x = np.array([secrets.features(t, c, model.logs) for t, c, _ in findings])
    y = np.array([label for _, _, label in findings])
    assert ((model.forest.predict(x) >= secrets.CUT) == y).mean() > 0.97


def test_forest_split_equals_search_over_all_cuts():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, (60, 3)).astype(float), rng.integers(0, 2, 60)
    forest = secrets.Forest(tried=3, cuts=100)
    feature, cut = forest.split(x, y, rng)

    def gini(f, c):
        parts = [y[x[:, f] <= c], y[x[:, f] > c]]
        return sum(len(p) * p.mean() * (1 - p.mean()) for p in parts if len(p))

    assert np.isclose(gini(feature, cut), min(gini(f, v + 0.5) for f in range(3) for v in range(8) if 0 < (x[:, f] <= v).sum() < 60))


def test_same_string_in_different_company(model):
    judge = lambda text: [s >= secrets.CUT for _, _, _, s in model.judge(text)]
    assert judge(f'so token = "{HEX}" here') == [True]
    assert judge(f"fixed in commit {HEX} today") == [False]
    assert judge("write to hein.19@mail5.example.com now") == [False]
    assert judge("key AKIA" + "Q3ZT7WPM2LXK9VRB" + " in use") == [True]
    assert judge("plain words only") == [] and judge("") == [] and judge(None) == []


def test_statistics_cover_the_whole_token():
    """Both halves of 12,000 characters count alike, and twice the text has the same shares."""
    logs = secrets.transition_logs(np.ones((secrets.CLASSES, secrets.CLASSES)))
    judged = lambda token: secrets.features(token, secrets.Candidate(0, len(token), "long string"), logs)
    row = judged("ab" * 3000 + "1/" * 2995 + "your_key-Z")
    want = {4: 2995 / 12000, 5: 1 / 12000, 6: 6007 / 12000, 11: 2995 / 12000, 18: 1.0, 22: 2 / 12000}
    assert all(np.isclose(row[i], x) for i, x in want.items())
    assert judged("0" * 5000 + "z")[9] == 0.0 and judged("0" * 5000 + "f")[9] == 1.0
    assert np.allclose(judged("the1/x-" * 400)[4:7], judged("the1/x-" * 4000)[4:7]) and np.isclose(judged("1/x-" * 4000)[11], 0.25)


def test_documents_tokens_are_found(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()}
    rows = LLM_QUERIES["op3_secrets"](spark, MEDIUM).collect()
    found = {(r.doc_id, r.start, r.end) for r in rows if r.is_secret}
    planted = {(i, *m.span(1)) for i, t in docs.items() for m in re.finditer(r'token = "([0-9a-f]{40})"', t)}
    assert planted and planted <= found
    assert all(0 <= r.start < r.end <= len(docs[r.doc_id]) for r in rows)


def test_masking(make):
    docs = make([(1, f'a token = "{HEX}" b', 60, "x"), (2, None, 0, "y"), (3, "", 0, "y"), (4, "calm", 99, "z"), (4, "calm", 99, "z"), (None, "w" * 90000, 1, "z")], "doc_id long, text string, n_chars long, masked_text string")
    out = secrets.masked(docs)
    rows = {r.doc_id: r for r in out.collect()}
    assert out.columns == docs.columns and out.count() == 6
    assert rows[1].text == 'a token = "[SECRET]" b' and rows[1].n_chars == len(rows[1].text) and rows[1].masked_text == "x"
    assert rows[2].text is None and rows[4].n_chars == 99
    assert secrets.secret_findings(make([])).count() == 0
