"""Byte-level BPE: merges from a priority queue over a linked list of symbols, and decoding.

A word's bytes are the symbols of a doubly linked list. Every neighbouring pair that has a
merge rank waits in a heap ordered by rank, then by position; the lowest is merged and the
pairs it makes with its neighbours are added. Entries whose symbols have changed since are
stale and skipped when they come up. A word of n bytes takes O(n log n).

The vocabulary file is a parameter; it is read by Spark's tasks from that path, which must
exist on every node (as an installed package does).
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.parts import PartTable, cut_at_spaces


ROWS_AT_ONCE = 256


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BytePairs:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        symbol = byte_symbols()
        to_bytes = lambda token: bytes(symbol[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        by_bytes = {to_bytes(t): i for t, i in vocab.items()}
        self.text_of = {i: b for b, i in by_bytes.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [by_bytes[bytes([b])] for b in range(256)]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        #: Left and right symbol of each merge rank, and what they make; ranks by right symbol for each left one.
        self.steps = [(vocab[left], vocab[right], vocab[left + right]) for left, right in pairs]
        none: dict[int, int] = {}
        self.ranks = [none] * (1 + max(vocab.values()))
        for rank, (left, right, _) in enumerate(self.steps):
            if self.ranks[left] is none:
                self.ranks[left] = {}
            self.ranks[left][right] = rank
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: Parts between spaces and the pieces they are cut into share one table: many are both.
        self.parts = PartTable()

    def forget(self) -> None:
        """Empty the table: a worker that lives on should not hold it for other work."""
        self.parts = PartTable()

    def merge_word(self, word: bytes) -> list[int]:
        """Ids of one word by merging the lowest-ranked neighbours first."""
        ids = list(map(self.byte_id.__getitem__, word))
        size = len(ids)
        ranks, steps, heap = self.ranks, self.steps, []
        for i in range(size - 1):
            rank = ranks[ids[i]].get(ids[i + 1])
            if rank is not None:
                heap.append(rank * size + i)  # rank and position in one number, in that order
        if not heap:
            return ids
        before, after = list(range(-1, size - 1)), list(range(1, size + 1))
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), size)
            left, right, made = steps[rank]
            j = after[i]
            if ids[i] != left or j >= size or ids[j] != right:
                continue
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                rank = ranks[made].get(ids[k])
                if rank is not None:
                    heappush(heap, rank * size + i)
            h = before[i]
            if h >= 0:
                rank = ranks[ids[h]].get(made)
                if rank is not None:
                    heappush(heap, rank * size + h)
        return [i for i in ids if i >= 0]

    def word_ids(self, word: str) -> bytes:
        """Ids of a piece as little-endian 32-bit numbers."""
        ids = self.merge_word(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def words_ids(self, words: list[str]) -> list[bytes]:
        return list(map(self.word_ids, words))

    def piecewise(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that are cut into pieces first. A text that is one piece is not looked up as one again."""
        out = []
        for text in texts:
            pieces = self.pieces.findall(text)
            out.append(self.word_ids(text) if len(pieces) == 1 else b"".join(self.parts.look_up(pieces, self.words_ids)))
        return out

    def run_ids(self, run: str) -> bytes:
        """Ids of text between special tokens."""
        parts = cut_at_spaces(run)
        return self.piecewise([run])[0] if parts is None else b"".join(self.parts.look_up(parts, self.piecewise))

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers; null is the empty text."""
        text = text or ""
        if self.cut_special is None or not any(s in text for s in self.special):
            return self.run_ids(text) if text else b""
        out = []
        for i, run in enumerate(self.cut_special.split(text)):
            if i % 2:
                out.append(np.array([self.special[run]], "<u4").tobytes())
            elif run:
                out.append(self.run_ids(run))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids, joined; bytes that are no UTF-8 become U+FFFD."""
        found = map(self.text_of.__getitem__, np.frombuffer(ids, "<u4").tolist())
        return b"".join(found).decode("utf-8", "replace")


_loaded: dict[str, BytePairs] = {}


def loaded(path: str) -> BytePairs:
    """The vocabulary of ``path``, read once for each Python worker."""
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]


def encode_column(text: Column, path: str) -> Column:
    """Token ids of a text column as binary, four bytes each, little-endian. Null gives no ids."""

    @F.pandas_udf("binary")
    def bpe_encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = loaded(path)
        for texts in batches:
            yield pd.Series([pairs.encode(t) for t in texts], dtype=object)

    return bpe_encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """Text of token ids (binary as :func:`encode_column` gives); null stays null."""

    @F.pandas_udf("string")
    def bpe_decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pairs = loaded(path)
        for rows in batches:
            yield pd.Series([None if r is None else pairs.decode(r) for r in rows], dtype=object)

    return bpe_decode(ids)


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids (binary, little-endian 32-bit), and whether the ids decode to the text.

    Null counts as the empty text, which has no ids. Repeated rows each keep a row; a text of any length
    is encoded whole; an empty table gives an empty table; other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = loaded(path)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                texts = batch.column(1).to_pylist()
                ids = [pairs.encode(t) for t in texts]
                same = [pairs.decode(i) == (t or "") for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())],
                    names=[id_col, "n_tokens", "ids", "round_trip"],
                )
        pairs.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(encode, f"`{id_col}` {kind}, n_tokens long, ids binary, round_trip boolean")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, sha256 of the ids and of the decoded text.

    Encoding and decoding run in one pass, so the ids never leave the task. Null counts as the
    empty text. Repeated rows each keep a row; a text of any length is encoded whole; an empty table
    gives an empty table; other columns are not read.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pairs = loaded(path)
        for texts in batches:
            rows = []
            for text in texts:
                ids = pairs.encode(text)
                decoded = pairs.decode(ids).encode()
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, digest(F.col(text_col)).alias("d")).select(id_col, "d.*")
