"""Phrase counts and scores against plain counting, with colliding and cut inputs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardlight.llm import collocations
from wardlight.llm.queries import LLM_QUERIES

MEDIUM = "/root/testdata/sf0.01"


def plain_counts(docs):
    """``(counts of (lang, phrase), words of each lang)`` of ``(text, lang)`` pairs."""
    counts, totals = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, " ".join(words[i : i + k])] += 1
    return counts, totals


def plain(docs, top=2000, least=10):
    counts, totals = plain_counts(docs)
    inside, rows = defaultdict(int), defaultdict(list)
    candidates = {k: a for k, a in counts.items() if a >= least and " " in k[1]}
    for (lang, phrase), a in candidates.items():
        words = phrase.split(" ")
        if len(words) == 3:
            for part in (words[:2], words[1:]):
                inside[lang, " ".join(part)] = max(inside[lang, " ".join(part)], a)
    for (lang, phrase), a in candidates.items():
        if inside[lang, phrase] and 100 * inside[lang, phrase] >= 50 * a:
            continue
        words = phrase.split(" ")
        cuts = []
        for k in range(1, len(words)):
            left, right = counts[lang, " ".join(words[:k])], counts[lang, " ".join(words[k:])]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        rows[lang].append((-score, -a, phrase.encode(), phrase, a, left, right))
    return sorted(
        (lang, i, phrase, a, left, right, totals[lang], -s)
        for lang, found in rows.items() for i, (s, _, _, phrase, a, left, right) in enumerate(sorted(found)[:top], 1)
    )


def test_query_equals_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("text", "lang").collect()]
    found = LLM_QUERIES["op12_collocations"](spark, MEDIUM)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, found.collect())) == plain(docs)


def random_docs(n, seed=3):
    rng = random.Random(seed)
    words = ["A", "b", "ab", "é", "ÀB", "x" * 30, "new", "york", "the", "\x00", "z"]
    return [("".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ". ", "\n", ","]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None])) for _ in range(n)]


def test_blocks_ranges_and_shuffles(spark, monkeypatch):
    """Small blocks, many ranges of fingerprints and several shuffles change nothing."""
    docs = random_docs(400)
    frame = spark.createDataFrame(docs, "text string, lang string").repartition(3)
    staged = collocations.written(collocations.blocks(frame, "text", "lang", 500), "small").repartition(2, "block").sortWithinPartitions("block", "at")
    assert staged.select("block").distinct().count() > 20
    monkeypatch.setattr(collocations, "SHUFFLE_BITS", 2)
    found = [collocations.written(collocations.frequent(staged, [1, 2], 5, 3, 10), "p")]
    found.append(collocations.frequent(staged, [3], 5, 3, 10, collocations.frequent_filter(found[0], 2)))
    rows = collocations.phrases(staged, found[0].unionByName(found[1]), 3, 10).collect()
    assert {(r.lang, r.phrase): r["count"] for r in rows} == {k: n for k, n in plain_counts(docs)[0].items() if n >= 10}


def test_filter_reaches_the_driver_in_pages(spark, monkeypatch):
    """One row for each page of the bit table, not one for each of its cells, and all bits of every fingerprint."""
    from pyspark.sql.classic.dataframe import DataFrame

    rows, kept = [], {}
    for name in ("toPandas", "collect", "toLocalIterator"):
        def counted(self, *args, whole=getattr(DataFrame, name), **options):
            found = whole(self, *args, **options)
            found = found if hasattr(found, "__len__") else list(found)
            rows.append(len(found))
            return found
        monkeypatch.setattr(DataFrame, name, counted)
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, 40_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    parts = [(2, len(p), len(p), bytearray(collocations.planes(p, collocations.FIELDS[0]))) for p in np.array_split(prints, 7)]
    found = spark.createDataFrame(parts + [(1, 1, 1, parts[0][3][:8])], "words int, n int, new int, prints binary")
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda table, whole=spark.sparkContext.broadcast: kept.setdefault("table", whole(table)))
    passes = collocations.frequent_filter(found, 2)
    bits = 20  # 16 for each of 40,000, rounded up
    at = np.concatenate(collocations.filter_places(prints, bits)).astype(np.int64)
    want = np.zeros(1 << bits, bool)
    want[at] = True
    assert np.array_equal(np.unpackbits(kept["table"].value.view(np.uint8), bitorder="little"), want)
    assert passes(prints).all() and passes(rng.integers(0, 1 << 63, 40_000, dtype=np.uint64)).mean() < 0.02
    assert max(rows) <= 8


def test_colliding_fingerprints_are_told_apart():
    block = collocations.Block([0, 12], ["en", "fr"], [b"a b a c a b", b"a b"])
    block.hashes[:] = 7  # all words collide
    entries = dict(collocations.gram_entries(block, [1, 2]))
    starts = {int(s): i for i, s in enumerate(block.starts)}
    text = block.data.tobytes()
    word = lambda i: text[block.starts[i] : block.ends[i]].decode()
    for n, want in ((1, {("a", 0): 3, ("b", 0): 2, ("c", 0): 1, ("a", 1): 1, ("b", 1): 1}), (2, {("a b", 0): 2, ("b a", 0): 1, ("a c", 0): 1, ("c a", 0): 1, ("a b", 1): 1})):
        _, counts, places = entries[n]
        got = {(" ".join(word(starts[int(p)] + k) for k in range(n)), int(block.lang[starts[int(p)]])): int(c) for p, c in zip(places, counts)}
        assert got == want


def test_prefix_hash_is_that_of_the_stretch():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
    up, _ = collocations.powers(501)
    for a, b in [(0, 3), (17, 20), (490, 500), (5, 5)]:
        assert collocations.stretches(values, np.array([a]), np.array([b]))[0] == np.sum(values[a:b] * up[: b - a], dtype=np.uint64)


def test_packing_round_trip():
    rng = np.random.default_rng(2)
    fields = [rng.integers(0, 1 << 63, 100, dtype=np.uint64) * np.uint64(2), rng.integers(1, 9, 100), rng.integers(0, 1 << 31, 100), np.full(100, 5 << 33)]
    rows = list(collocations.packed(2, fields, 3))
    assert [r[0] for r in rows] == sorted({int(p) >> 61 for p in fields[0]})
    back = [np.concatenate(f) for f in zip(*(collocations.unpacked(n, data) for _, _, n, data in rows))]
    order = np.argsort(fields[0])
    assert all((b == f[order]).all() for b, f in zip(back, fields))


@pytest.mark.parametrize("size", [4, 9, 1000])
def test_long_texts_are_cut_at_ends_of_pieces(size):
    for text, _ in random_docs(30, 5):
        parts = collocations.cut_text(text, size)
        assert "".join(parts) == text
        assert all(p[-1] in collocations.PIECE_END for p in parts[:-1])


def test_edge_rows(make):
    schema = "doc_id long, text string, lang string, COUNT int, block string, n int"
    base = [("New York. new\tyork new  york\nNEW YORK", "en")] * 4 + [("new york", "en")] * 2 + [(None, "en"), ("", "fr"), (" \t.", None), ("one two three " * 9, None)]
    base += [("de la ville. " * 40000, "fr"), ("de la " * 30000, "")]
    docs = [(None if i % 3 else i, t, lang, 1, "b", 2) for i, (t, lang) in enumerate(base)]
    frame = make(docs, schema)
    assert sorted(map(tuple, collocations.collocations(frame).collect())) == plain(base)
    assert collocations.collocations(make([], schema)).count() == 0
    assert collocations.collocations(make([(1, None, None, 1, "b", 2)], schema)).count() == 0
    top = collocations.collocations(frame, top=1)
    assert sorted(map(tuple, top.collect())) == plain(base, 1)
