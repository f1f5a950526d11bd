"""Next documents, edited texts and fingerprints against plain versions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from wardlight.llm import imatch
from wardlight.llm.queries import LLM_QUERIES

MEDIUM = "/root/testdata/sf0.01"


def plain_edits(docs):
    """``(id, n_chars, sha of the edited text, text, next text)`` in descending id order, null ids last."""
    known = sorted((d for d in docs if d[0] is not None), key=lambda d: (d[0], d[1] or ""), reverse=True)
    rows = known + sorted((d for d in docs if d[0] is None), key=lambda d: d[1] or "", reverse=True)
    out = []
    for i, (doc, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
    return out


def test_query_on_whole_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    rows = {r.doc_id: r for r in LLM_QUERIES["op2_imatch"](spark, MEDIUM).collect()}
    want = plain_edits(docs)
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in (rows[w[0]] for w in want)] == [w[:3] for w in want]
    by_text = {}
    for w in want:
        by_text.setdefault(w[3], set()).add(rows[w[0]].fingerprint)
    assert all(len(p) == 1 for p in by_text.values()) and len(set(map(min, by_text.values()))) > 0.95 * len(by_text)
    assert sum(r.near_edited > r.near_next for r in rows.values()) > 0.95 * len(rows)
    assert all(0 <= x <= 1 for r in rows.values() for x in (r.near_edited, r.near_next))


@pytest.fixture(params=[1000, 2])
def per_range(request, monkeypatch):
    monkeypatch.setattr(imatch, "DOCS_PER_RANGE", request.param)


def test_ties_nulls_and_ranges(make, per_range):
    docs = [(i * 7 % 23, f"w{i} é日本 word{i % 3} " * (i % 4)) for i in range(20)]
    docs += [(7, "w9 tie"), (7, "w9 tie"), (50, None), (51, ""), (None, "null id"), (None, None), (-4, "😀" * 5)]
    rows = imatch.fingerprints(make(docs)).collect()
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in rows), key=key) == sorted((w[:3] for w in plain_edits(docs)), key=key)


def test_likeness_of_fingerprints(make):
    same = "alpha beta gamma delta " * 3
    docs = [(4, same), (3, same), (2, "one two three four"), (1, "...")]
    rows = {r.doc_id: r for r in imatch.fingerprints(make(docs)).collect()}
    assert rows[4].near_next == 1 and rows[4].fingerprint == rows[3].fingerprint
    assert rows[3].near_next == 0 and rows[2].near_next == 0


def test_one_document_and_none(make):
    rows = imatch.fingerprints(make([(1, "abcd")])).collect()
    assert rows[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest() and rows[0].near_next == 1
    assert imatch.fingerprints(make([])).count() == 0


def test_fingerprint_is_the_plain_one(spark, make):
    """Subset hashes of sorted distinct lexicon words, worked out by hand."""
    docs = make([(i, " ".join(f"t{k}" for k in range(40) if (i * 31 + k * k) % 11 == 0)) for i in range(60)])
    lexicon = imatch.lexicon(docs, "text", (0.0, 9.0))
    marks = {r.word: r.mark for r in lexicon.withColumn("mark", imatch.subset_mark(lexicon.word)).collect()}
    texts, seen = {r.doc_id: r.text for r in docs.collect()}, 0
    for r in imatch.fingerprints(docs, band=(0.0, 9.0)).filter("doc_id < 20").collect():
        runs = {}
        for w in sorted(set(texts[r.doc_id].split()) & set(marks)):
            runs[marks[w]] = runs.get(marks[w], "") + marks[w] + w
        hashes = spark.createDataFrame([(m, t) for m, t in sorted(runs.items())], "m string, t string").selectExpr("m", "xxhash64(t) & 72057594037927935 AS h").collect()
        seen += bool(runs)
        assert not runs or r.fingerprint == "".join(f"{((ord(x.m) - imatch.FIRST_MARK) << 56) + x.h:016x}" for x in hashes)
    assert seen >= 3


def test_subsets_part_the_lexicon_by_their_sizes(spark):
    words = spark.range(40000).selectExpr("concat('w', id) AS word")
    counts = {r.mark: r["count"] for r in words.groupBy(imatch.subset_mark(words.word).alias("mark")).count().collect()}
    assert len(counts) == len(imatch.SUBSETS)
    assert abs(counts[chr(imatch.FIRST_MARK)] - 40000 * imatch.SUBSETS[0] / imatch.HASH_RANGE) < 300


def test_lexicon_keeps_the_whole_band(spark):
    """90,000 words of two documents each, and one of half of them: only the latter is outside the band."""
    docs = spark.range(300).selectExpr(
        "id AS doc_id", "array_join(transform(sequence(0, 599), k -> concat('w', id div 2 * 600 + k)), ' ') || if(id < 150, ' often', '') AS text"
    )
    words = imatch.lexicon(docs, "text")
    assert words.count() == 90_000 and words.filter("word = 'often'").isEmpty()
    table = imatch.lexicon_table(words)
    asked = words.limit(1000).union(spark.range(1000).selectExpr("concat('other', id)"))
    found = {r.word: r.held for r in asked.select("word", imatch.in_lexicon(table, F.xxhash64("word")).alias("held")).collect()}
    assert all(held == w.startswith("w") for w, held in found.items()) and len(found) == 2000
