"""Passage removal against a table of all windows; suffix sort against Python's sort."""

import hashlib
import random

import numpy as np
import pytest

from wardlight.llm import substrings, suffix_sort
from wardlight.llm.queries import LLM_QUERIES

SIZE = 50


def brute(docs):
    least = {}
    for doc, text in docs:
        data = (text or "").encode()
        if doc is not None:
            for k in range(len(data) - SIZE + 1):
                w = data[k : k + SIZE]
                least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        if doc is not None:
            for k in range(len(data) - SIZE + 1):
                if least[data[k : k + SIZE]] < doc:
                    gone[k : k + SIZE] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_equals_table_of_windows(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, LLM_QUERIES["op9_suffix_dedup"](spark, folder).collect()), key=str)
    want = brute(docs)
    assert got == want and any(r[2] for r in want)


def tangle(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abcdefgh é"
    line = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [line(rng.choice([49, 50, 51, 80, 300])) for _ in range(6)]
    docs = [(i, line(rng.randint(0, 60)).join(rng.choice(shared) for _ in range(rng.randint(0, 5)))) for i in range(30)]
    docs += [(3, docs[5][1]), (40, docs[2][1]), (40, docs[2][1]), (41, None), (42, ""), (43, "a" * 500), (44, "a" * 49), (45, "a" * 50), (None, "a" * 200), (None, None), (46, "a" * 120 + "b")]
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_shared_passages_and_edges(make, seed):
    docs = tangle(seed)
    # Blocks, pieces and batches of a few units: nothing may be lost at their edges.
    limits = substrings.Limits(300, 120, 20, hot=[10_000, 3][seed % 2]) if seed >= 2 else substrings.Limits(hot=[10_000, 0][seed % 2])
    got = sorted(map(tuple, substrings.repeated_passages(make(docs), limits=limits).collect()), key=str)
    assert got == brute(docs)


def test_one_phrase_in_ever_new_surroundings_is_dealt_out(make):
    """No task gathers the units of a hot anchor, and the result is that of all windows."""
    rng = random.Random(7)
    line = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    phrase = line(20)
    docs = [(i, line(rng.randint(40, 90)) + phrase + line(rng.randint(40, 90))) for i in range(300)]
    docs += [(300 + i, docs[i][1][20:130]) for i in range(0, 300, 9)]
    for hot in (20, 10_000):
        limits = substrings.Limits(block_bytes=4000, hot=hot)
        got = substrings.repeated_passages(make(docs), limits=limits)
        assert sorted(map(tuple, got.collect()), key=str) == brute(docs)
    base = make([(i, i, t) for i, t in docs], "row long, id long, text string")
    entries = base.coalesce(1).mapInArrow(substrings.anchor_entries(1, limits), substrings.ENTRIES).coalesce(1)
    sizes = []
    for hot in (20, 10_000):
        limits = substrings.Limits(block_bytes=4000, hot=hot)
        answers = entries.mapInArrow(substrings.shared_anchors(limits), "block long, count long, body binary")
        codes = substrings.by_block(answers).mapInArrow(substrings.codes_by_row, "row long, codes binary").groupBy("row").agg(substrings.F.collect_list("codes").alias("codes"))
        units = base.join(codes, "row").coalesce(1).mapInArrow(substrings.unit_entries(1, limits), f"{substrings.ENTRIES}, text binary")
        codes = [substrings.unpacked(r.body, r["count"], "<i8", "<i8", "<i8", "<u8", "u1")[3] for r in units.filter("not known").collect()]
        sizes.append(int(np.unique(np.concatenate(codes), return_counts=True)[1].max()))
    assert sizes[0] <= 30 < 100 < sizes[1]


def test_a_long_text(make):
    rng = random.Random(3)
    long = "".join(rng.choice("abcd ") for _ in range(60_000))
    docs = [(1, long), (2, "x" + long[1000:50_000] + "y"), (3, None)]
    limits = substrings.Limits(block_bytes=20_000, piece_bytes=9_000)
    assert sorted(map(tuple, substrings.repeated_passages(make(docs), limits=limits).collect()), key=str) == brute(docs)


def test_empty_table(make):
    assert substrings.repeated_passages(make([])).count() == 0


def test_suffix_sort_is_pythons_order():
    rng = np.random.default_rng(1)
    for _ in range(60):
        size = int(rng.integers(1, 300))
        data = rng.integers(97, 97 + int(rng.integers(1, 4)), size).astype(np.uint8)
        start = rng.integers(0, size, int(rng.integers(1, 200)))
        length = np.minimum(rng.integers(0, 70, len(start)), size - start)
        made = suffix_sort.SuffixSort(data, start, length)
        strings = [data[a : a + n].tobytes() for a, n in zip(start, length)]
        assert [strings[i] for i in made.order] == sorted(strings)
        assert len(set(zip(strings, made.group))) == len(set(strings)) == made.group.max() + 1


def test_suffix_sort_survives_collisions(monkeypatch):
    # An even multiplier has no inverse and a multiplier of 1 makes anagrams collide; the next one is taken.
    monkeypatch.setattr(suffix_sort, "MULTIPLIERS", [1, suffix_sort.MULTIPLIERS[0]])
    data = np.frombuffer(b"the same ab or ba|the same ba or ab|", np.uint8)
    made = suffix_sort.SuffixSort(data, np.array([0, 18]), np.array([17, 17]))
    assert made.group.tolist() == [0, 1]
