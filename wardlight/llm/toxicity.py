"""Toxic text by compression distance between two trained zstandard dictionaries.

Windows of a few words are compressed with a dictionary trained on ordinary text and with that
dictionary extended by one trained on toxic text; a window that the second makes shorter looks
toxic. Most words of a toxic document are ordinary, so the toxic samples are weighted: they are the
occurrences, in toxic documents, of words whose log-likelihood ratio tells them from ordinary ones
(counted once for each new pair of neighbours, so copied documents do not count again).
Window savings of held-back training documents calibrate a logistic score.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wardlight.llm.common import written

#: Bounds of the training sample, in documents.
TOXIC_DOCS, ORDINARY_DOCS = 1500, 3000
WINDOW = 28
DICTIONARY_BYTES = 16_384
#: Ordinary windows that train a dictionary, drawn from those of the sample.
TRAINING_WINDOWS = 30_000
MIN_RATIO, MIN_LIKELIHOOD = 3.0, 16.0
#: Segment and match lengths with which zstandard picks dictionary content, for ordinary and for toxic samples.
ORDINARY_COVER, TOXIC_COVER = (24, 6), (64, 8)
THRESHOLDS = (4, 6, 8)
CUT = 0.7
EDGES = b".,;:!?*&%$#|\"'()"


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def windows(words: list[bytes]) -> list[bytes]:
    """Consecutive whole words, at least ``WINDOW`` bytes each but for the last; a longer word is one window."""
    out, held, size = [], [], 0
    for w in words:
        held.append(w)
        size += len(w) + 1
        if size >= WINDOW:
            out.append(b" " + b" ".join(held) + b" ")
            held, size = [], 0
    if held:
        out.append(b" " + b" ".join(held) + b" ")
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor over a raw dictionary, without frame extras whose length could differ."""
    params = zstandard.ZstdCompressionParameters(
        min_match=5, strategy=zstandard.STRATEGY_BTLAZY2, window_log=16, hash_log=12, chain_log=12, search_log=4,
        target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params)


def new_contexts(docs: list[list[bytes]], only: set[bytes] | None = None) -> Counter:
    """Documents in which a word stands between neighbours not seen with it before."""
    seen: set[int] = set()
    counts: Counter = Counter()
    for words in docs:
        bare = [b"", *[w.strip(EDGES) for w in words], b""]
        found = set()
        for before, word, after in zip(bare, bare[1:], bare[2:]):
            if word and (only is None or word in only):
                context = xxh64_intdigest(b" ".join((before, word, after)))
                if context not in seen:
                    seen.add(context)
                    found.add(word)
        counts.update(found)
    return counts


def likelihood_ratio(a: int, b: int, n: int, m: int) -> float:
    """Twice the log-likelihood ratio of counts ``a`` in ``n`` and ``b`` in ``m`` against one common rate."""
    rate = (a + b) / (n + m)
    return 2 * sum(k * math.log(k / (size * rate)) for k, size in ((a, n), (b, m)) if k)


def toxic_words(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> set[bytes]:
    """Words that toxic documents repeat and ordinary ones do not."""
    n, m = len(toxic), len(ordinary)
    inside = new_contexts(toxic)
    outside = new_contexts(ordinary, set(inside))
    return {
        word for word, a in inside.items()
        if a * m > MIN_RATIO * outside[word] * n and likelihood_ratio(a, outside[word], n, m) >= MIN_LIKELIHOOD
    }


def toxic_samples(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> list[bytes]:
    """Every occurrence of a telling word in the toxic documents, in their order."""
    words = toxic_words(toxic, ordinary)
    return [b" " + bare + b" " for doc in toxic for bare in (w.strip(EDGES) for w in doc) if bare in words]


def trained_content(samples: list[bytes], cover: tuple[int, int]) -> bytes:
    """Dictionary content trained on samples; with too few of them, the samples themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=cover[0], d=cover[1]).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-DICTIONARY_BYTES:].rjust(16, b" ")


class Scorer:
    """Savings of the toxic dictionary over the ordinary one, as features of a document."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = compressor(ordinary), compressor(toxic)

    def features(self, text: str | None) -> list[float]:
        cut = windows(words_of(text))
        if not cut:
            return [0.0] * (6 + len(THRESHOLDS) - 1)
        plain, toxic = self.ordinary.compress, self.toxic.compress
        saved = np.array([len(plain(w)) - len(toxic(w)) for w in cut])
        top = np.sort(saved)[::-1]
        over = [math.log1p(int((saved >= t).sum())) for t in THRESHOLDS]
        return [float(top[0]), float(top[:3].mean()), *over, float(saved.mean()), float(np.maximum(saved, 0).sum() / math.sqrt(len(saved))), math.log1p(len(saved))]


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, spread and weights by Newton steps with a small ridge."""
    center, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - center) / spread])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w))
        w -= np.linalg.solve(curve, z.T @ (p - y) + w)
    return center, spread, w


def train(texts: list[str], toxic: list[int], seed: int = 5) -> Model | None:
    """Dictionaries from two thirds of the documents, calibration from the rest; None without both classes."""
    rows = list(zip(texts, toxic))
    if len({t for _, t in rows}) < 2:
        return None
    rng = random.Random(seed)
    rng.shuffle(rows)
    back, learn = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    ordinary = [words_of(t) for t, y in learn if not y]
    samples = [w for words in ordinary for w in windows(words)]
    rng.shuffle(samples)
    base = trained_content(samples[:TRAINING_WINDOWS], ORDINARY_COVER)
    more = trained_content(toxic_samples([words_of(t) for t, y in learn if y], ordinary), TOXIC_COVER)
    scorer = Scorer(base, base + more)
    x = np.array([scorer.features(t) for t, _ in back])
    y = np.array([t for _, t in back], float)
    return Model(base, base + more, *fit_logistic(x, y))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, usable: Column) -> tuple[list[str], list[int]]:
    """Texts and labels of about as many labelled documents of each class as the bounds say, picked by a hash of their ids.

    Each class has a threshold of the hash from its count, so no task orders a class.
    """
    known = labels.filter(usable & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").alias("toxic"))
    known = written(known, "toxic-labels")
    counts = {bool(r["is_toxic"]): r["count"] for r in known.groupBy((F.col("toxic") == 1).alias("is_toxic")).count().collect()}
    share = F.when(F.col("toxic") == 1, TOXIC_DOCS / max(counts.get(True, 0), 1)).otherwise(ORDINARY_DOCS / max(counts.get(False, 0), 1))
    picked = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 32)) < share * float(1 << 32))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    found = sorted(rows.collect(), key=lambda r: r.id)
    return [r.text for r in found], [r.toxic for r in found]


def score_column(text: Column, model: Model | None) -> Column:
    """Probability of toxicity, 0 to 1. Null counts as empty; without a model all scores are 0."""

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = None if model is None else Scorer(model.ordinary, model.toxic)
        for texts in batches:
            if scorer is None or not len(texts):
                yield pd.Series(np.zeros(len(texts)))
                continue
            x = np.array([scorer.features(t) for t in texts])
            z = np.column_stack([np.ones(len(x)), (x - model.center) / model.spread]) @ model.weights
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return toxicity(text)


def held_out(id_col: str, parts: int = 3, part: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the held-out part; null ids do not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Learns from labels of ids that are not held out.

    Null texts count as empty. Of repeated labels the larger counts. Repeated rows each keep a
    row; null ids teach nothing. Without labels of both classes all scores are 0. A text of any
    length is scored by all its windows; an empty table gives an empty table. Other columns are not read.
    """
    model = train(*training_sample(docs, labels, id_col, text_col, F.col(id_col).isNotNull() & ~held_out(id_col)))
    found = docs.select(id_col, held_out(id_col).alias("held_out"), score_column(F.col(text_col), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
