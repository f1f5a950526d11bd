"""Benchmark passages in documents, found by Wu-Manber search over word sequences.

The symbols of the search are words. Texts become arrays of 64-bit word codes; a window of
an item (``window`` consecutive words, or all words of a shorter item) is a pattern. For
each pattern length a searcher holds

* a shift table: by the code of a block of words, how far the search may move on without
  passing the end of an occurrence,
* suffix buckets: where the shift is zero, the patterns that end with that block,
* the pattern words, compared directly: codes first, then the bytes of the words.

A batch of documents is searched in many lanes at once, each with its own position and
its own jumps. Benchmark texts are held in blocks of bounded size; a table of several blocks
makes one narrow pass for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import written

WINDOW = 13
BLOCK = 2
TABLE_BITS = 16
LANE_WORDS = 256
#: Bytes of benchmark text sent to the tasks at once.
BLOCK_BYTES = 4 << 20

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of many texts: bytes, bounds and 64-bit codes, in one array for all texts."""

    def __init__(self, texts: list[str | None]):
        parts = [(t or "").encode() for t in texts]
        self.bytes = LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
        inside = IS_WORD[self.bytes]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        text_end = np.cumsum([len(p) + 1 for p in parts])
        #: Words of text i are ``first[i]`` to ``first[i + 1]``.
        self.first = np.concatenate([[0], np.searchsorted(self.start, text_end)])
        self.code = self._codes()

    def _codes(self) -> np.ndarray:
        """Polynomial code of each word, the same for equal words; collisions are checked later."""
        count = len(self.start)
        code = np.zeros(count, np.uint64)
        length = self.end - self.start
        # Eight bytes at a time; long words take more rounds than others.
        padded = np.concatenate([self.bytes, np.zeros(8, np.uint8)])
        rows, at = np.arange(count), self.start.copy()
        with np.errstate(over="ignore"):
            while len(rows):
                left = np.minimum(self.end[rows] - at, 8)
                piece = np.zeros(len(rows), np.uint64)
                for k in range(8):
                    piece |= np.where(left > k, padded[at + np.minimum(k, left - 1)], 0).astype(np.uint64) << np.uint64(8 * k)
                mixed = (code[rows] ^ piece) * MULTIPLIER
                code[rows] = (mixed ^ (mixed >> np.uint64(29))) * MULTIPLIER
                more = self.end[rows] - at > 8
                rows, at = rows[more], at[more] + 8
            code ^= length.astype(np.uint64) << np.uint64(48)
        return code

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def block_codes(code: np.ndarray, size: int) -> np.ndarray:
    """Table slot of the block of ``size`` words that ends at each position (the first ones are unused)."""
    mixed = code.copy()
    with np.errstate(over="ignore"):
        for back in range(1, size):
            mixed[back:] ^= (code[:-back] * np.uint64(2 * back + 1)) << np.uint64(back)
        mixed *= MULTIPLIER
    return (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Searcher:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, length: int, codes: np.ndarray, words: list[tuple[bytes, ...]], items: list[list[int]]):
        self.length, self.codes, self.words, self.items = length, codes, words, items
        self.block = min(BLOCK, length)
        reach = length - self.block + 1
        slots = np.stack([block_codes(row, self.block) for row in codes])
        self.shift = np.full(1 << TABLE_BITS, reach, np.uint8)
        for column in range(self.block - 1, length):
            np.minimum.at(self.shift, slots[:, column], length - 1 - column)
        order = np.argsort(slots[:, -1], kind="stable")
        self.members = order
        self.bucket = np.searchsorted(slots[order, -1], np.arange((1 << TABLE_BITS) + 1))

    def occurrences(self, text: Words) -> tuple[np.ndarray, np.ndarray]:
        """``(first word, pattern)`` of every occurrence inside one text."""
        slot = block_codes(text.code, self.block)
        stops = self._stops(text, slot)
        if not len(stops):
            return stops, stops
        held = self.bucket[slot[stops] + 1] - self.bucket[slot[stops]]
        ends = np.repeat(stops, held)
        offset = np.arange(len(ends)) - np.repeat(np.cumsum(held) - held, held)
        pattern = self.members[np.repeat(self.bucket[slot[stops]], held) + offset]
        for back in range(self.length):
            same = text.code[ends - back] == self.codes[pattern, self.length - 1 - back]
            ends, pattern = ends[same], pattern[same]
        first = ends - self.length + 1
        true = [
            all(text.word(f + k) == w for k, w in enumerate(self.words[p])) for f, p in zip(first.tolist(), pattern.tolist())
        ]
        true = np.array(true, bool)
        return first[true], pattern[true]

    def _stops(self, text: Words, slot: np.ndarray) -> np.ndarray:
        """End positions with shift zero, reached by jumping along lanes of positions."""
        lows, highs = [], []
        begin, end = text.first[:-1] + self.length - 1, text.first[1:]
        for lo, hi in zip(begin[begin < end].tolist(), end[begin < end].tolist()):
            cuts = np.arange(lo, hi, LANE_WORDS)
            lows.append(cuts)
            highs.append(np.minimum(cuts + LANE_WORDS, hi))
        if not lows:
            return np.zeros(0, np.int64)
        at, high = np.concatenate(lows), np.concatenate(highs)
        found = []
        while len(at):
            step = self.shift[slot[at]]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < high
            at, high = at[on], high[on]
        return np.sort(np.concatenate(found))


def build_searchers(items: list[tuple[object, str | None]], window: int = WINDOW) -> list[Searcher]:
    """Searchers, one for each pattern length, over the windows of ``items`` (positions in the list are kept)."""
    text = Words([t for _, t in items])
    owners: dict[tuple[bytes, ...], list[int]] = {}
    rows: dict[tuple[bytes, ...], np.ndarray] = {}
    for i in range(len(items)):
        a, b = int(text.first[i]), int(text.first[i + 1])
        words = [text.word(k) for k in range(a, b)]
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            key = tuple(words[k : k + size])
            mine = owners.setdefault(key, [])
            if not mine or mine[-1] != i:
                mine.append(i)
            rows[key] = text.code[a + k : a + k + size]
    made = []
    for length in sorted({len(k) for k in owners}):
        keys = [k for k in owners if len(k) == length]
        made.append(Searcher(length, np.stack([rows[k] for k in keys]), keys, [owners[k] for k in keys]))
    return made


def search(texts: list[str | None], searchers: list[Searcher]) -> list[tuple[int, list[int], set[int]]]:
    """For each text: number of words, flat list of merged hit intervals ``[a, b, ...)``, items found."""
    text = Words(texts)
    found: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in texts]
    for searcher in searchers:
        first, pattern = searcher.occurrences(text)
        doc = np.searchsorted(text.first, first, side="right") - 1
        for d, f, p in zip(doc.tolist(), first.tolist(), pattern.tolist()):
            found[d][0].append((f - int(text.first[d]), f - int(text.first[d]) + searcher.length))
            found[d][1].update(searcher.items[p])
    counts = np.diff(text.first).tolist()
    return [(n, merge(spans), items) for n, (spans, items) in zip(counts, found)]


def merge(spans: list[tuple[int, int]]) -> list[int]:
    flat: list[int] = []
    for a, b in sorted(spans):
        if flat and a <= flat[-1]:
            flat[-1] = max(flat[-1], b)
        else:
            flat += [a, b]
    return flat


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str | None]]]:
    """Items in blocks of bounded text size; an item above the bound is a block of its own."""
    block, size = [], 0
    for row in items.select(id_col, text_col).toLocalIterator():
        length = len(row[1] or "")
        if block and size + length > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += length
    if block:
        yield block


def benchmark_hits(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (word intervals, flat) and ``items`` (ids as strings, sorted, distinct).

    Null texts have no words. Items without words match nothing; a null item id counts as
    an item named ``""``. Repeated rows each keep a row; items with equal ids are one item.
    Empty tables give an empty table, or no hits. A text of any length is searched whole. Columns
    of ``docs`` named like a result are replaced. Items beyond one block are searched in further
    passes, each written before the next, so a task holds the searchers of one block.
    """
    context = docs.sparkSession.sparkContext
    names = {"n_words", "hit_spans", "items"}
    out = docs.drop(*[c for c in docs.columns if c.lower() in names])
    out = out.withColumns({"n_words": F.lit(0).cast("long"), "hit_spans": F.lit(None).cast("array<long>"), "items": F.lit(None).cast("array<string>")})
    blocks = list(item_blocks_broadcast(context, items, item_id, item_text)) or [context.broadcast([])]
    for i, block in enumerate(blocks):
        out = written(out, "contamination-pass") if i else out
        out = out.mapInArrow(block_pass(block, text_col, window), out.schema)
    return out


def item_blocks_broadcast(context, items: DataFrame, item_id: str, item_text: str):
    for block in item_blocks(items, item_id, item_text):
        yield context.broadcast([("" if i is None else str(i), t) for i, t in block])


def block_pass(block, text_col: str, window: int):
    """A pass over the documents with one block of items, adding to what earlier passes found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [i for i, _ in block.value]
        searchers = build_searchers(block.value, window)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                columns = {n: batch.column(n) for n in batch.schema.names}
                before = list(zip(columns["hit_spans"].to_pylist(), columns["items"].to_pylist()))
                got = search(columns[text_col].to_pylist(), searchers)
                spans = [merge([*zip(flat[::2], flat[1::2]), *zip((old or [])[::2], (old or [])[1::2])]) for (_, flat, _), (old, _) in zip(got, before)]
                named = [sorted({*(old or ()), *(ids[i] for i in found)}) for (_, _, found), (_, old) in zip(got, before)]
                columns["n_words"] = pa.array([n for n, _, _ in got], pa.int64())
                columns["hit_spans"] = pa.array(spans, pa.list_(pa.int64()))
                columns["items"] = pa.array(named, pa.list_(pa.string()))
                yield pa.RecordBatch.from_pydict(columns)

    return run


def n_hit():
    """Words inside the flat intervals of ``hit_spans``."""
    return F.aggregate(
        F.transform("hit_spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x
    )


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256 and whether it counts as contaminated."""
    hits = benchmark_hits(docs.select(id_col, text_col), items, text_col)
    return hits.withColumn("n_hit", n_hit()).select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, all columns as they are whatever their names, whose text is not contaminated.

    Null and empty texts have no words and stay; repeated rows are judged each; an empty table or
    empty ``items`` leave all rows; a text of any length is judged whole.
    """
    numbered = docs.toDF(*[f"column_{i}" for i in range(len(docs.columns))])
    hits = benchmark_hits(numbered, items, f"column_{docs.columns.index(text_col)}").withColumn("n_hit", n_hit())
    return hits.filter(~is_contaminated()).select(*numbered.columns).toDF(*docs.columns)
