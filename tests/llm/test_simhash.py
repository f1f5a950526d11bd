"""Fingerprints, links and components against plain versions."""

import random
import re

import numpy as np
import pandas as pd
import pytest
import xxhash

from wardlight.llm import simhash
from wardlight.llm.queries import LLM_QUERIES

MEDIUM = "/root/testdata/sf0.01"


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Root of each position by linking all pairs within three bits."""
    a, parent = np.array(prints, np.uint64), list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            x, y = root(i), root(int(j))
            parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(a))]


def plain(docs):
    docs = sorted(docs, key=lambda d: (d[0] is None, d[0] or 0))
    prints = [plain_print(t) for _, t in docs]
    return [(d[0], f"{p:016x}", docs[r][0]) for d, p, r in zip(docs, prints, plain_components(prints))]


def order(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_equals_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    assert order(LLM_QUERIES["op10_simhash"](spark, MEDIUM).collect()) == order(plain(docs))


@pytest.mark.parametrize("tile", [8192, 20])
def test_dense_clusters_and_tiles(spark, tile):
    rng, points = random.Random(1), set()
    for _ in range(6):
        base = rng.getrandbits(64)
        for _ in range(120):
            x = base
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    points = sorted(points)
    frame = spark.createDataFrame(pd.DataFrame({"print": np.array(points, np.uint64).view(np.int64)}))
    found = simhash.components(frame, simhash.linked_prints(frame, 3, tile)).collect()
    label = {r["print"] % (1 << 64): r.root for r in found}
    mine, want = {}, {}
    for p, r in zip(points, plain_components(points)):
        mine.setdefault(label.get(p, ("alone", p)), []).append(p)
        want.setdefault(r, []).append(p)
    assert sorted(mine.values()) == sorted(want.values())


def test_edge_rows(make):
    docs = [(5, None), (3, ""), (9, " \t"), (8, "one"), (8, "one"), (2, "One"), (None, "one"), (None, "x y z w " * 3), (1, "ab " * 60000)]
    assert order(simhash.near_duplicates(make(docs)).collect()) == order(plain(docs))
    assert simhash.near_duplicates(make([])).count() == 0


def test_one_document_of_each_component_stays(make):
    docs = make([(5, None, 1), (3, "", 1), (8, "one", 1), (8, "one", 2), (2, "One", 1), (None, "one", 1)], "doc_id long, text string, component_id int")
    kept = simhash.one_per_component(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, None]


def test_segment_counts_never_exceed_hamming_distance():
    rng = np.random.default_rng(2)
    a, b = (rng.integers(0, 1 << 63, 4000, dtype=np.uint64) for _ in range(2))
    near = a ^ (np.uint64(1) << rng.integers(0, 63, 4000, dtype=np.uint64))
    for other in (b, near):
        bound = np.bitwise_count(simhash.thermometer(simhash.segment_counts(a)) ^ simhash.thermometer(simhash.segment_counts(other)))
        assert (bound <= np.bitwise_count(a ^ other)).all()
