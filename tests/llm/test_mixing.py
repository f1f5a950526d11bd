"""The mix against a plain version, and the laws of the splitting tree."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlight.llm import mixing
from wardlight.llm.queries import LLM_QUERIES

MEDIUM = "/root/testdata/sf0.01"


def plain(docs):
    """Rows of ``(doc_id, size, source_size, target, taken)`` by iterated sharing and a walk along each source."""
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))) for i, t, s in docs]
    sums = Counter()
    for _, s, n in sized:
        sums[s] += n
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sums.values()), {}
    while True:
        rest, weights = total - sum(stopped.values()), sum(weight[s] for s in names if s not in stopped)
        share = {s: rest * weight[s] / weights for s in names if s not in stopped}
        over = {s: 3 * sums[s] for s, x in share.items() if x > 3 * sums[s]}
        stopped |= over
        if not over:
            break
    target = {**share, **stopped}
    out = []
    for s in names:
        quota = min(int(target[s] + 0.5), 3 * sums[s])
        rows = sorted(((hashlib.md5(f"42:{'-' if i is None else i}".encode()).hexdigest(), n, i) for i, t, n in sized if t == s), key=lambda r: r[:2])
        start = 0
        for _, n, i in rows:
            taken = sum(max(0, min(p * sums[s] + start + n, quota) - p * sums[s] - start) for p in range(3))
            out.append((i, n, sums[s], target[s], taken))
            start += n
    return out


def order(rows):
    return sorted(((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in map(tuple, rows)), key=str)


def test_query_equals_plain_version(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text", "source").collect()]
    found = LLM_QUERIES["op13_mixing"](spark, MEDIUM).collect()
    assert order(found) == order(plain(docs))
    assert all(r.taken <= 3 * r.size for r in found)


def test_edge_rows(spark, make):
    schema = "doc_id long, text string, source string, size string, START int"
    docs = [
        (1, "a b c", "x", "s", 1), (2, None, "x", "s", 1), (3, "", None, None, None), (None, "d e", None, "s", 1), (None, "d e", None, "s", 1),
        (4, "w " * 40000, "big", "s", 1), (5, "a\tb\nc", "x", "s", 1), (5, "a", "x", "s", 1), (6, " \t", "zero", "s", 1), (7, "é é", "é", "s", 1),
    ]
    found = mixing.taken_words(make(docs, schema), block_words=100, shards=5)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]
    assert order(found.collect()) == order(plain([d[:3] for d in docs]))
    assert mixing.taken_words(make([], schema)).count() == 0
    assert order(mixing.taken_words(make([(1, None, None, None, None)], schema)).collect()) == [(1, 0, 0, 0.0, 0)]


def test_shards_hold_disjoint_words_of_the_quotas(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    stream, parts = mixing.mix(docs, block_words=64, shards=7)
    spans, sizes = defaultdict(list), Counter()
    for r in parts.collect():
        spans[r.number, r.slot, r.ordinal, r["pass"]].append((r.first_word, r.n_words))
        sizes[r.shard] += r.n_words
    for found in spans.values():
        ends = 0
        for first, n in sorted(found):
            assert first >= ends
            ends = first + n
    assert len(sizes) == 7 and max(sizes.values()) - min(sizes.values()) <= 64 * 21  # whole blocks, and a short one of each source
    again = mixing.mix(docs, block_words=64, shards=7)[1]
    assert again.exceptAll(parts).count() == 0 and again.count() == parts.count()


@pytest.mark.parametrize("fan", [3, 256])
def test_tree_splits_exactly_and_as_a_shuffle_would(spark, fan):
    quotas = [0, 5, 40, 1, 12, 300, 7, 0, 90, 33, 2]
    frame = spark.createDataFrame(list(enumerate(quotas)), "number long, blocks long")
    total, squares = sum(quotas), []
    for seed in range(4 if fan == 256 else 1):
        rows = mixing.split_quotas(frame, 6, fan, seed).collect()
        table = np.zeros((len(quotas), 6), int)
        for r in rows:
            assert r.first_block == table[r.number, : r.shard].sum()
            table[r.number, r.shard] = r.n_blocks
        assert table.sum(axis=1).tolist() == quotas
        assert sorted(table.sum(axis=0)) == sorted(total // 6 + (j < total % 6) for j in range(6))
        # each cell against the spread of a hypergeometric number: n K/N (1 - K/N) (N - n)/(N - 1)
        for number in (2, 5, 8):
            share = quotas[number] / total
            spread = total / 6 * share * (1 - share) * (total - total / 6) / (total - 1)
            squares.append(np.square(table[number] - quotas[number] / 6) / spread)
    if fan == 256:
        assert 0.5 < np.mean(squares) < 1.7


def test_hypergeometric_law(spark):
    cases = [(30, 70, 40), (700, 70, 400), (5, 4, 7), (2, 1000, 500)]
    x = spark.range(8000).select(*[mixing.hypergeometric(*map(F.lit, c), F.col("id")).alias(f"c{i}") for i, c in enumerate(cases)]).toPandas()
    for i, (a, b, n) in enumerate(cases):
        share = a / (a + b)
        deviation = np.sqrt(n * share * (1 - share) * (a + b - n) / (a + b - 1))
        assert abs(x[f"c{i}"].mean() - n * share) < 4 * deviation / np.sqrt(len(x))
        assert abs(x[f"c{i}"].std() / deviation - 1) < 0.06
        assert x[f"c{i}"].between(max(0, n - b), min(a, n)).all()


def test_log_factorial(spark):
    import math

    found = spark.range(0, 300).select(mixing.log_factorial(F.col("id").cast("double")).alias("v")).collect()
    assert all(abs(r.v - math.lgamma(n + 1)) < 1e-9 * max(1, math.lgamma(n + 1)) for n, r in enumerate(found))
