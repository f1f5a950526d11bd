"""Benchmark windows in documents against a plain scan of all windows."""

import hashlib
import random
import re

import pytest

from wardlight.llm import contamination
from wardlight.llm.queries import LLM_QUERIES

MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=13):
    known = {}
    for item, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            known.setdefault(tuple(words[k : k + size]), set()).add("" if item is None else str(item))
    lengths = sorted({len(k) for k in known})
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for size in lengths:
            for k in range(len(words) - size + 1):
                owners = known.get(tuple(words[k : k + size]))
                if owners:
                    hit.update(range(k, k + size))
                    found |= owners
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out


def key(rows):
    return sorted(((-1 if r[0] is None else r[0]), *r[1:]) for r in map(tuple, rows))


def test_query_equals_plain_scan(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").select("item_id", "text").collect()]
    want = brute(docs, items)
    assert key(LLM_QUERIES["op6_decontamination"](spark, MEDIUM).collect()) == key(want)
    assert any(r[5] for r in want)


def edge_tables(rng):
    vocabulary = ["a", "b", "cc", "é", "1", "日本", "longwordover8bytes", "longwordover8bytez"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 2, 3, 12, 13, 14, 20]))) for i in range(12)] + [(3, "A-b!"), (None, "1 1 1"), (77, None), (78, "...")]
    docs = [(i, line(rng.randint(0, 400))) for i in range(15)] + [(7, "A b CC"), (8, None), (9, ""), (9, ""), (None, "a " * 3000)]
    return docs, items


@pytest.mark.parametrize("seed", range(4))
def test_small_alphabet_and_edges(make, monkeypatch, seed):
    docs, items = edge_tables(random.Random(seed))
    if seed % 2:
        monkeypatch.setattr(contamination, "BLOCK_BYTES", 60)  # several passes
    got = contamination.contamination(make(docs), make(items, "item_id long, text string"))
    assert key(got.collect()) == key(brute(docs, items))


def test_empty_tables_and_kept_columns(make):
    none = make([], "item_id long, text string")
    docs = make([(1, "a b", 5, ["x"]), (2, None, 6, None)], "doc_id long, text string, n_words int, items array<string>")
    assert key(contamination.contamination(docs, none).collect()) == key(brute([(1, "a b"), (2, None)], []))
    assert contamination.contamination(make([]), none).count() == 0
    kept = contamination.without_contaminated(docs.drop("n_words", "items"), make([(1, "a b")], "item_id long, text string"))
    assert [r.doc_id for r in kept.collect()] == [2]
    assert contamination.without_contaminated(docs, none).columns == docs.columns


def test_columns_named_like_results_are_kept(spark, make):
    docs = make(
        [(1, "a b c", "mine", ["q"], 7, [1.5]), (2, "x y", None, None, None, None), (3, None, "m", [], 0, [])],
        "doc_id long, text string, N_words string, items array<string>, n_hit int, Hit_Spans array<double>",
    )
    kept = contamination.without_contaminated(docs, make([(1, "x y")], "item_id long, text string"))
    assert kept.schema == docs.schema
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id != 2)
