"""Gradients, block reading and held-out accuracy of the language network."""

import zlib

import numpy as np

from wardlight.llm import langid
from wardlight.llm.queries import LLM_QUERIES

MEDIUM = "/root/testdata/sf0.01"


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    table, recur = rng.normal(0, 0.5, (257, 24)), rng.normal(0, 0.5, (24, 8))
    x = rng.integers(97, 103, (6, 3))
    pull = rng.normal(size=(6, 8, 3))

    def loss(table, recur):
        h, total = np.zeros((8, 3)), 0.0
        for t in range(6):
            a, u = table[x[t]].T, recur @ h
            z, r = langid.sigmoid(a[:8] + u[:8]), langid.sigmoid(a[8:16] + u[8:16])
            h = (1 - z) * np.tanh(a[16:] + r * u[16:]) + z * h
            total += (h * pull[t]).sum()
        return total

    kept = langid.forward(table.astype(np.float32), recur.astype(np.float32), x)
    dtable, drecur = langid.backward(recur.astype(np.float32), x, kept, pull.astype(np.float32))
    for array, grad, spots in ((table, dtable, [(97, 0), (99, 9), (101, 20)]), (recur, drecur, [(0, 0), (10, 3), (20, 7)])):
        for spot in spots:
            moved = array.copy()
            moved[spot] += 1e-5
            other = array.copy()
            other[spot] -= 1e-5
            pair = [(m, recur) if array is table else (table, m) for m in (moved, other)]
            slope = (loss(*pair[0]) - loss(*pair[1])) / 2e-5
            assert abs(slope - grad[spot]) < 1e-3 * max(1, abs(slope))


def plain_probability(model, text):
    """Position by position, block by block."""
    data, total, size = text, np.zeros(len(model.labels)), langid.HIDDEN

    def states(k, codes):
        h, out = np.zeros(size), []
        for c in codes:
            a, u = model.table[k, c], model.recur[k] @ h
            z, r = langid.sigmoid(a[:size] + u[:size]), langid.sigmoid(a[size : 2 * size] + u[size : 2 * size])
            h = (1 - z) * np.tanh(a[2 * size :] + r * u[2 * size :]) + z * h
            out.append(h)
        return out

    for at in range(0, len(data), langid.BLOCK):
        lo, hi = max(0, at - langid.LEAD), min(len(data), at + langid.BLOCK + langid.LEAD)
        codes = list(data[lo:hi])
        ahead, back = states(0, codes), states(1, codes[::-1])[::-1]
        for t in range(at - lo, min(at + langid.BLOCK, len(data)) - lo):
            logits = model.out @ np.concatenate([ahead[t], back[t]]) + model.bias
            p = np.exp(logits - logits.max())
            total += p / p.sum()
    return total / max(len(data), 1)


def test_reader_equals_plain_network():
    rng = np.random.default_rng(3)
    table = rng.normal(0, 0.5, (2, 257, 24)).astype(np.float32)
    table[:, langid.PAD], table[:, langid.PAD, :8] = 0, 60
    model = langid.Model(["a", "b", "c"], table, rng.normal(0, 0.5, (2, 24, 8)).astype(np.float32), rng.normal(0, 1, (3, 16)).astype(np.float32), np.zeros(3, np.float32))
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5, 191, 192, 193, 700)]
    got = langid.Reader(model).probabilities(texts)
    for text, p in zip(texts, got):
        assert np.allclose(p, plain_probability(model, text), atol=1e-4)


def test_held_out_accuracy(spark):
    rows = LLM_QUERIES["op1_language_id"](spark, MEDIUM).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edge_rows(make):
    schema = "doc_id long, text string, lang string, id int"
    docs = make([(1, "aaaa bbb aab " * 9, "x", 1), (2, "zz yy zy " * 9, "y", 1), (2, "zz yy zy " * 9, "y", 1), (3, None, "x", 1), (4, "12 ??", "y", 1), (5, "", None, 1), (None, "aaa " * 30000, "x", 1)], schema)
    found = {(r.doc_id, r.lang_pred) for r in langid.languages(docs).collect()}
    assert {(3, "und"), (4, "und"), (5, "und")} <= found and langid.languages(docs).count() == 7
    assert langid.languages(make([], schema)).count() == 0
    unlabelled = langid.languages(make([(1, "abc", None, 1)], schema)).collect()
    assert (unlabelled[0].lang_pred, unlabelled[0].score) == ("und", 0.0)
    kept = langid.with_known_language(docs, 0.0)
    assert kept.columns == docs.columns and kept.filter("doc_id in (3, 4, 5)").count() == 0
