"""Window savings, word selection and held-out discrimination."""

import zlib

import numpy as np

from wardlight.llm import toxicity
from wardlight.llm.queries import LLM_QUERIES

FOLDER = "/root/testdata/sf0.1"


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    _, group, count = np.unique(np.array(scores)[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[group]
    y = np.array(labels)[order]
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_windows_hold_every_word_once():
    words = toxicity.words_of("A bb  ccc\n" + "d" * 90 + " e" * 40)
    cut = toxicity.windows(words)
    assert b" ".join(w.strip() for w in cut).split() == words
    assert toxicity.windows([]) == [] and toxicity.words_of(None) == []


def test_savings_are_differences_of_compressed_lengths():
    scorer = toxicity.Scorer(b"plain words stand here for all to see", b"plain words stand here for all to see dreadful nonsense")
    dull, bad = scorer.features("words stand here"), scorer.features("what dreadful nonsense this is")
    plain, toxic = scorer.ordinary.compress(b" what dreadful nonsense this "), scorer.toxic.compress(b" what dreadful nonsense this ")
    assert bad[0] == max(len(plain) - len(toxic), bad[0]) and bad[0] > 4 > dull[0]
    assert len(dull) == len(bad) == len(scorer.features(None)) == len(scorer.features(""))


def test_words_of_copies_count_once():
    toxic = [toxicity.words_of(f"you{i} fool x{i} here") for i in range(30)] + [toxicity.words_of("copied rarity text")] * 30
    ordinary = [toxicity.words_of(f"nice number {i} here") for i in range(100)]
    found = toxicity.toxic_words(toxic, ordinary)
    assert b"fool" in found and b"rarity" not in found and b"here" not in found


def test_both_dictionaries_are_trained():
    toxic = [f"you are x{i} {w} y{i} and more" for i in range(300) for w in ("scoundrel", "nitwit", "blockhead")]
    ordinary = [f"you are x{i} friend y{i} of number {i}" for i in range(900)]
    model = toxicity.train(toxic + ordinary, [1] * len(toxic) + [0] * len(ordinary))
    added = model.toxic[len(model.ordinary) :]
    assert model.toxic.startswith(model.ordinary) and model.ordinary[:4] == added[:4] == b"\x37\xa4\x30\xec"  # zstandard's mark
    assert b"scoundrel" in added and b"nitwit" in added and b"friend" not in added


def test_held_out_documents(spark):
    rows = LLM_QUERIES["op7_toxicity"](spark, FOLDER).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert auc([r.score for r in held], [labels[r.doc_id] for r in held]) > 0.85
    said = [labels[r.doc_id] for r in held if r.predicted]
    assert len(said) > 20 and sum(said) > 0.85 * len(said)
    # much of what is labelled toxic are junk documents without a telling word
    assert sum(said) > 0.35 * sum(labels[r.doc_id] for r in held)
    missed = [r.doc_id for r in held if labels[r.doc_id] and not r.predicted]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    assert len(missed) == sum(labels[r.doc_id] for r in held) - sum(said) and all(texts[i] is not None for i in missed)


def test_edge_rows(make):
    docs = make([(1, None), (2, ""), (3, "x" * 70000), (3, "x" * 70000), (None, "some text")])
    none = make([], "doc_id long, quality int, toxic int")
    rows = toxicity.scores(docs, none).collect()
    assert len(rows) == 5 and all((r.score, r.predicted) == (0.0, 0) for r in rows)
    labels = make([(0, 1, 1), (3, 1, 0), (3, 1, 1), (2, 1, 0), (None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    more = make([(i, f"text {i} stupid" if i % 2 else f"text {i} nice") for i in range(12)])
    assert toxicity.scores(more, labels).count() == 12
    assert toxicity.scores(make([]), labels).count() == 0
