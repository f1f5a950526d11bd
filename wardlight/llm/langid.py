"""Language of a text from a bidirectional gated recurrent network over its bytes.

Each direction is a gated recurrent unit that reads one byte at a time; from both states a
linear layer labels every position, and a document's probabilities are the mean of its
positions'. Training is backpropagation through time in numpy on short windows of a bounded
sample of labelled documents. To label a text it is read whole, in blocks of ``BLOCK`` bytes
that each direction enters ``LEAD`` bytes early, so many blocks run side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import fresh

UNKNOWN = "und"
HIDDEN = 8
BLOCK, LEAD, LANES = 192, 12, 2048
#: Bounds of the training sample: documents for each language, windows for each document, bytes of a window.
SAMPLE_DOCS, SAMPLE_WINDOWS, WINDOW = 400, 4, 64
STEPS, BATCH, RATE = 300, 128, 0.02
PAD = 256
#: Texts whose bytes are laid out together.
TEXTS_AT_ONCE = 500
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """``table``: gate inputs for each byte (and the pad); ``recur``: gate weights of the state; by direction."""

    labels: list[str]
    table: np.ndarray  # (2, 257, 3 * HIDDEN)
    recur: np.ndarray  # (2, 3 * HIDDEN, HIDDEN)
    out: np.ndarray  # (labels, 2 * HIDDEN)
    bias: np.ndarray  # (labels,)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def forward(table: np.ndarray, recur: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
    """States and gates of one direction over bytes ``x`` (time, batch)."""
    size, (steps, batch) = HIDDEN, x.shape
    kept = {k: np.zeros((steps, size, batch), np.float32) for k in ("before", "z", "r", "inner", "c", "h")}
    h = np.zeros((size, batch), np.float32)
    for t in range(steps):
        a, u = table[x[t]].T, recur @ h
        z, r = sigmoid(a[:size] + u[:size]), sigmoid(a[size : 2 * size] + u[size : 2 * size])
        c = np.tanh(a[2 * size :] + r * u[2 * size :])
        for k, v in (("before", h), ("z", z), ("r", r), ("inner", u[2 * size :]), ("c", c)):
            kept[k][t] = v
        h = c + z * (h - c)
        kept["h"][t] = h
    return kept


def backward(recur: np.ndarray, x: np.ndarray, kept: dict[str, np.ndarray], dout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``table`` and ``recur`` from the gradient ``dout`` of each step's state."""
    size, (steps, batch) = HIDDEN, x.shape
    drecur = np.zeros_like(recur)
    dgates = np.zeros((steps, 3 * size, batch), np.float32)
    dh = np.zeros((size, batch), np.float32)
    for t in range(steps - 1, -1, -1):
        before, z, r, inner, c = (kept[k][t] for k in ("before", "z", "r", "inner", "c"))
        dh = dh + dout[t]
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (before - c) * z * (1 - z)
        dr = dc * inner * r * (1 - r)
        dgates[t] = np.concatenate([dz, dr, dc])
        du = np.concatenate([dz, dr, dc * r])
        drecur += du @ before.T
        dh = dh * z + recur.T @ du
    flat, rows = x.ravel(), dgates.transpose(1, 0, 2).reshape(3 * size, -1)
    dtable = np.stack([np.bincount(flat, row, 257) for row in rows], axis=1).astype(np.float32)
    return dtable, drecur


def train(windows: list[bytes], targets: list[str], seed: int = 7) -> Model | None:
    """Fit by Adam on cross-entropy of every position; None without windows."""
    labels = sorted(set(targets))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    x = np.full((len(windows), WINDOW), PAD, np.int64)
    for i, w in enumerate(windows):
        x[i, : min(len(w), WINDOW)] = np.frombuffer(w[:WINDOW], np.uint8)
    y = np.array([labels.index(t) for t in targets])
    by_label = [np.flatnonzero(y == k) for k in range(len(labels))]
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    params = [draw(257, 3 * HIDDEN), draw(257, 3 * HIDDEN), draw(3 * HIDDEN, HIDDEN), draw(3 * HIDDEN, HIDDEN), draw(len(labels), 2 * HIDDEN), np.zeros(len(labels), np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        # Every language has the same share of a batch.
        own = rng.integers(0, len(labels), BATCH)
        pick = np.array([by_label[k][rng.integers(len(by_label[k]))] for k in own])
        xb = x[pick].T
        ahead, back = forward(params[0], params[2], xb), forward(params[1], params[3], xb[::-1])
        states = np.concatenate([ahead["h"], back["h"][::-1]], axis=1)  # (time, 2 * HIDDEN, batch)
        logits = np.einsum("kh,thb->tkb", params[4], states) + params[5][:, None]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        p[:, own, np.arange(BATCH)] -= 1
        weight = (xb != PAD).astype(np.float32)
        p *= (weight / max(weight.sum(), 1))[:, None, :]
        dstates = np.einsum("kh,tkb->thb", params[4], p)
        dt0, dr0 = backward(params[2], xb, ahead, dstates[:, :HIDDEN])
        dt1, dr1 = backward(params[3], xb[::-1], back, dstates[::-1, HIDDEN:])
        grads = [dt0, dt1, dr0, dr1, np.einsum("tkb,thb->kh", p, states), p.sum(axis=(0, 2))]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
            params[i] -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    table, recur = np.stack(params[:2]), np.stack(params[2:4])
    # The pad leaves the state as it is: its update gate is shut.
    table[:, PAD] = 0
    table[:, PAD, :HIDDEN] = 60
    return Model(labels, table, recur, params[4], params[5])


class Reader:
    """Runs a model over blocks of bytes, both directions at once."""

    def __init__(self, model: Model):
        self.model = model
        # Gates are read as 1 / (1 + exp(.)), so their inputs change sign once, here.
        sign = np.ones(3 * HIDDEN, np.float32)
        sign[: 2 * HIDDEN] = -1
        self.table = model.table * sign
        self.recur = model.recur * sign[:, None]

    def states(self, table: np.ndarray, recur: np.ndarray, x: np.ndarray, keep: range) -> np.ndarray:
        """States (time in ``keep``, HIDDEN, lanes) of one direction over bytes ``x`` (time, lanes)."""
        size, lanes = HIDDEN, x.shape[1]
        h = np.zeros((size, lanes), np.float32)
        kept = np.empty((len(keep), size, lanes), np.float32)
        u = np.empty((3 * size, lanes), np.float32)
        a = np.empty((3 * size, lanes), np.float32)
        gates, inner, c = a[: 2 * size], u[2 * size :], a[2 * size :]
        for t in range(keep.stop):
            np.copyto(a, table[x[t]].T)
            np.matmul(recur, h, out=u)
            gates += u[: 2 * size]
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            inner *= gates[size:]
            c += inner
            np.tanh(c, out=c)
            h -= c
            h *= gates[:size]
            h += c
            if t >= keep.start:
                kept[t - keep.start] = h
        return kept

    def block_sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of position probabilities (lanes, labels) over the middle ``BLOCK`` bytes of each lane."""
        keep = range(LEAD, LEAD + BLOCK)
        ahead = self.states(self.table[0], self.recur[0], x, keep)
        back = self.states(self.table[1], self.recur[1], x[::-1], keep)[::-1]
        inside = x[LEAD : LEAD + BLOCK] != PAD
        total = np.zeros((len(self.model.labels), x.shape[1]), np.float32)
        out, half = self.model.out, HIDDEN
        for t in range(BLOCK):
            p = out[:, :half] @ ahead[t] + out[:, half:] @ back[t] + self.model.bias[:, None]
            np.exp(p, out=p)
            p *= inside[t] / p.sum(axis=0)
            total += p
        return total.T

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean position probabilities (texts, labels); zero for empty texts."""
        sums = np.zeros((len(texts), len(self.model.labels)))
        owners, starts = [], []
        for i, t in enumerate(texts):
            at = np.arange(0, len(t), BLOCK)
            owners.append(np.full(len(at), i))
            starts.append(at)
        owner, start = np.concatenate(owners or [[]]).astype(int), np.concatenate(starts or [[]]).astype(int)
        sizes = np.array([len(t) for t in texts], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        data = np.concatenate([np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16), np.zeros(1, np.uint16)])
        offset = np.arange(-LEAD, BLOCK + LEAD)[:, None]
        for lo in range(0, len(owner), LANES):
            own, at = owner[lo : lo + LANES], start[lo : lo + LANES] + offset
            within = (at >= 0) & (at < sizes[own])
            x = np.where(within, data[np.where(within, base[own] + at, 0)], PAD)
            np.add.at(sums, own, self.block_sums(x))
        return sums / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column) -> tuple[list[bytes], list[str]]:
    """Windows of at most ``SAMPLE_DOCS`` documents for each language, picked by a hash of their ids."""
    known = docs.filter(usable).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    known = known.filter("id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    # The first hashes of each language. A bound on the hash, from the language's count, leaves some three
    # times as many as wanted, so a language of any size is a small group when it is ordered. The counts, one row for
    # each language, are smaller than the model, which has a weight vector for each.
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    low = known.select("id", "lang").join(F.broadcast(counts), "lang").filter(F.xxhash64("id") < -float(1 << 63) + 3.0 * SAMPLE_DOCS / F.col("n") * float(1 << 64))
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    best = low.select("id", "lang").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_DOCS)
    rows = known.join(F.broadcast(best.select("id").distinct()), "id", "left_semi")
    room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    spots = F.transform(F.sequence(F.lit(1), F.lit(SAMPLE_WINDOWS)), lambda k: F.pmod(F.xxhash64("id", k), room).cast("int") + 1)
    cut = lambda spot: F.substring(F.col("text"), spot, F.lit(WINDOW))
    windows = rows.select("lang", F.explode(F.transform(spots, cut)).alias("window"))
    # Bounded: documents x windows for each language.
    found = sorted(windows.distinct().collect())
    return [r.window.encode() for r in found], [r.lang for r in found]


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model from the labelled rows that ``usable`` allows; None if there are none."""
    return train(*training_sample(docs, id_col, text_col, lang_col, usable))


def predict_column(text: Column, model: Model | None) -> Column:
    """Struct ``(lang_pred, score)`` of a text column; ``und`` and 0 for null or no letter."""

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        reader = None if model is None else Reader(model)
        for series in batches:
            names, scores = [UNKNOWN] * len(series), np.zeros(len(series))
            if reader is not None:
                rows = [i for i, t in enumerate(series) if t is not None and LETTER.search(t)]
                for at in range(0, len(rows), TEXTS_AT_ONCE):
                    some = rows[at : at + TEXTS_AT_ONCE]
                    found = reader.probabilities([series.iloc[i].encode() for i in some])
                    for i, p in zip(some, found):
                        names[i], scores[i] = model.labels[int(p.argmax())], min(float(p.max()), 1.0)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return language.asNondeterministic()(text)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """Whether crc32 of the id as text falls into the held-out part; null ids do not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score. Learns from rows that are not held out.

    Null texts and texts without a letter are ``und`` with score 0. Repeated rows each keep a
    row; rows with a null id or language teach nothing. Without labelled rows all is ``und``.
    """
    model = fit(docs, F.col(id_col).isNotNull() & ~held_out(id_col), id_col, text_col, lang_col)
    found = docs.select(id_col, held_out(id_col).alias("held_out"), predict_column(F.col(text_col), model).alias("found"))
    return found.select(id_col, "held_out", "found.lang_pred", "found.score")


def with_known_language(docs: DataFrame, min_score: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Rows of ``docs``, all columns, whose language is found with at least ``min_score``.

    Null texts, empty ones and those without a letter go; a text of any length is read whole.
    Repeated rows are judged each; null ids and languages teach nothing. Without labelled
    rows no language is known and no row stays; an empty table stays empty.
    """
    model = fit(docs, F.col(id_col).isNotNull() & ~held_out(id_col), id_col, text_col, lang_col)
    name = fresh(docs, "found_language")
    found = docs.withColumn(name, predict_column(F.col(text_col), model))
    return found.filter((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= min_score)).select(*docs.columns)
