"""Phrase collocations by Rabin-Karp fingerprints.

Texts are written in blocks of some megabytes. In each block numpy prefix polynomials hash every
word from its bytes and every n-gram from its words; equal n-grams of a block, compared word by
word down to the bytes, become one entry: fingerprint, count and the place of one occurrence.
Entries are packed column by column into rows, one for each range of fingerprints, and shuffled;
a range keeps the entries of fingerprints that are frequent altogether. Their places go back to the
blocks, where the phrase is read from the text, so only frequent phrases become text, and counts
are summed by that text: two phrases of one fingerprint part there, and the result is exact.

Longer phrases are hashed only where both n-grams one word shorter pass a filter of the frequent
fingerprints: a bit table of bounded size that lets through all that is frequent.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import written

PIECE_END = ".,;:!?\n\x0b\x0c\r"
WORD = r"[^\x20\x09.,;:!?\x0A-\x0D]+"
UNKNOWN = "und"
MIN_COUNT = 10
MAX_WORDS = 3
#: Least share (in percent) of a phrase's occurrences inside one longer phrase that drops it.
INSIDE_PERCENT = 50
TOP = 2000
#: Text of one block; a text longer than this is cut at ends of pieces.
BLOCK_BYTES = 8 << 20
#: Text whose entries one range of fingerprints holds about.
RANGE_BYTES = 8 << 20
#: Text whose entries, or places, one task gathers about.
TASK_BYTES = 16 << 20
#: Bits of a range number that one shuffle adds.
SHUFFLE_BITS = 12
ENTRIES_AT_ONCE = 2_000_000
ROWS_AT_ONCE = 512
HASH_WORDS, CHECK_WORDS = 100_000, 100_000
#: The filter has 16 bits for each fingerprint, within these numbers of bits (as powers of two).
FILTER_BITS = (16, 28)
#: Cells of 64 bits of the filter that reach the driver as one value, as a power of two.
PAGE_BITS = 13

BASE = 0x9E3779B97F4A7C15  # any odd number
_bytes = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32
_kind = np.zeros(256, np.uint8)
_kind[[ord(" "), ord("\t")]] = 1
_kind[[ord(c) for c in PIECE_END]] = 2


# ---- blocks of text ----


def cut_text(text: str, size: int) -> list[str]:
    """Parts of about ``size`` characters, cut after ends of pieces only; a longer piece stays whole."""
    parts, start = [], 0
    while len(text) - start > size:
        cut = max(text.rfind(c, start, start + size) for c in PIECE_END)
        if cut < 0:
            cut = min((at for at in (text.find(c, start + size) for c in PIECE_END) if at >= 0), default=-1)
        if cut < 0:
            break
        parts.append(text[start : cut + 1])
        start = cut + 1
    return [*parts, text[start:]]


def blocks(docs: DataFrame, text_col: str, lang_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(block, at, lang, text)``: all texts, numbered blocks, and the byte of the block at which each row begins."""
    kept = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text_col).alias("text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in (whole.slice(at, ROWS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, ROWS_AT_ONCE)):
            found = []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for part in cut_text(text, block_bytes):
                    length = len(part.encode())
                    if size and size + length > block_bytes:
                        block, size = block + 1, 0
                    found.append((block, size, lang, part))
                    size += length + 1
            columns = list(zip(*found)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
                names=["block", "at", "lang", "text"],
            )

    return kept.filter("length(text) > 0").mapInArrow(number, "block long, at long, lang string, text string")


# ---- hashes of one block ----


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base below ``n`` and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1 << 20), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def stretches(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each stretch from prefix sums: equal stretches have equal hashes wherever they stand."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def stirred(x: np.ndarray) -> np.ndarray:
    """All bits of a hash spread over all bits (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Words of a block: places, hashes, and which follow each other in a piece."""

    def __init__(self, at: Sequence[int], langs: Sequence[str], texts: Sequence[bytes]):
        self.at = np.array(at, np.int64)
        first = int(self.at[0])
        self.data = _lower[np.frombuffer(b"\n".join(texts), np.uint8)]
        # numbers of 32 bits throughout: a block has some bytes for each of its words, times a few arrays
        kind = _kind[self.data]
        edge = np.zeros(len(kind) + 1, bool)  # from or to a word
        edge[1:-1] = (kind[1:] == 0) != (kind[:-1] == 0)
        edge[0], edge[-1] = kind[:1].tolist() == [0], kind[-1:].tolist() == [0]
        edges = np.flatnonzero(edge).astype(np.int32)
        del edge
        self.starts, self.ends = edges[::2].copy(), edges[1::2].copy()
        piece = np.searchsorted(np.flatnonzero(kind == 2).astype(np.int32), self.starts).astype(np.int32)
        del kind, edges
        self.follows = piece[1:] == piece[:-1]  # word i + 1 is in the piece of word i
        names, codes = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        self.lang = codes.astype(np.int16 if len(names) < 1 << 15 else np.int32)[np.searchsorted((self.at - first).astype(np.int32), self.starts, "right") - 1]
        self.seed = np.array([xxhash.xxh64_intdigest(n) for n in names.tolist()], np.uint64)
        self.first_place = first
        self.hashes = np.zeros(len(self.starts), np.uint64)
        for a in range(0, len(self.starts), HASH_WORDS):
            s, e = self.starts[a : a + HASH_WORDS], self.ends[a : a + HASH_WORDS]
            values = _bytes[self.data[s[0] : e[-1]]]
            self.hashes[a : a + HASH_WORDS] = stirred(stretches(values, s - s[0], e - s[0]))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and fingerprints of the ``n``-grams inside pieces."""
        inside = np.ones(max(len(self.starts) - n + 1, 0), bool)
        for k in range(n - 1):
            inside &= self.follows[k : k + len(inside)]
        first = np.flatnonzero(inside).astype(np.int32)
        return first, stirred(stretches(self.hashes, first, first + n) + self.seed[self.lang[first]] + np.uint64(n))

    def same_words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` are equal: language, length and every byte."""
        same = (self.lang[a] == self.lang[b]) & (self.ends[a] - self.starts[a] == self.ends[b] - self.starts[b])
        for k in range(0, len(a), CHECK_WORDS):
            near = np.flatnonzero(same[k : k + CHECK_WORDS] & (a[k : k + CHECK_WORDS] != b[k : k + CHECK_WORDS])) + k
            size = self.ends[a[near]] - self.starts[a[near]]
            before = np.cumsum(size) - size
            step = np.arange(int(size.sum())) - np.repeat(before, size)
            wrong = self.data[np.repeat(self.starts[a[near]], size) + step] != self.data[np.repeat(self.starts[b[near]], size) + step]
            if wrong.any():
                same[near[np.unique(np.repeat(np.arange(len(near)), size)[wrong])]] = False
        return same


def by_key(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, member)``: one place of each key, and the number of each place's key."""
    order = np.argsort(keys).astype(np.int32)
    new = np.ones(len(keys), bool)
    np.not_equal(keys[order[1:]], keys[order[:-1]], out=new[1:])
    member = np.empty(len(keys), np.int32)
    member[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], member


def classes(keys: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(first, member)``: one place of each class, and the class of each place. Equal keys that are not the ``same`` part."""
    first, member = by_key(keys)
    places = np.arange(len(keys), dtype=np.int32)
    left = places[~same(places, first[member])]
    while len(left):  # collisions: what differs from the first of its key is classed anew
        again, inside = by_key(keys[left])
        member[left] = len(first) + inside
        first = np.concatenate([first, left[again]])
        left = left[~same(left, left[again][inside])]
    return first, member


Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  # fingerprints, counts, places


def gram_entries(block: Block, sizes: Sequence[int], passes: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, Entries]]:
    """Entries of the n-grams of each size; with ``passes`` only those whose two shorter n-grams pass."""
    if not len(block.starts):
        return
    first_word, word = classes(block.grams(1)[1], block.same_words)
    for n in sizes:
        first, prints = block.grams(n)
        if passes is not None:
            shorter, short_prints = block.grams(n - 1)
            good = np.zeros(len(block.starts) + 1, bool)
            good[shorter] = passes(short_prints)
            kept = good[first] & good[first + 1]
            first, prints = first[kept], prints[kept]
        if not len(first):
            continue

        def same(a: np.ndarray, b: np.ndarray, first: np.ndarray = first, n: int = n) -> np.ndarray:
            return reduce(np.logical_and, [word[first[a] + k] == word[first[b] + k] for k in range(n)])

        one, member = (first_word, word) if n == 1 else classes(prints, same)
        yield n, (prints[one], np.bincount(member, minlength=len(one)).astype(np.int32), block.starts[first[one]] + block.first_place)


# ---- packed entries ----


def planes(values: np.ndarray, kind: str) -> bytes:
    """Numbers as one plane for each byte, so that equal high bytes stand together for the shuffle's compression."""
    return np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), -1).T).tobytes()


def unplaned(data: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    width = np.dtype(kind).itemsize
    part = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n)
    return np.ascontiguousarray(part.T).view(kind).ravel(), at + n * width


FIELDS = (">u8", ">u4", ">u4", ">i8")  # fingerprint, count, place, block
PACKED = "bucket long, words int, n int, data binary"


def packed(words: int, fields: Sequence[np.ndarray], bits: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Rows of entries in order, one for each range of fingerprints (their first ``bits`` bits)."""
    order = np.argsort(fields[0])
    fields = [f[order] for f in fields]
    bucket = (fields[0] >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(order), np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
        if b > a:
            yield int(bucket[a]), words, b - a, b"".join(planes(f[a:b], kind) for f, kind in zip(fields, FIELDS))


def unpacked(n: int, data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for kind in FIELDS:
        values, at = unplaned(data, at, n, kind)
        out.append(values.astype(kind[1:]))
    return out


def _rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in found:
        rows.append(row)
        size += len(row[3])
        if size > 4 << 20:
            yield _batch(rows)
            rows, size = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["bucket", "words", "n", "data"])


def entries(staged: DataFrame, sizes: Sequence[int], bits: int, passes: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Packed entries of all blocks. A block that two tasks read in parts has entries of each part."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for number, at, langs, texts in whole_blocks(batches):
            for n, (prints, counts, places) in gram_entries(Block(at, langs, texts), sizes, passes):
                yield from packed(n, [prints, counts, places, np.full(len(prints), number)], bits)

    return staged.mapInArrow(lambda batches: _rows(found(batches)), PACKED)


def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list, list]]:
    """``(block, at, langs, texts as bytes)`` of rows that follow each other in one block."""
    number, held = None, ([], [], [])
    for batch in batches:
        # row by row: a batch may hold many blocks
        columns = [batch.column(c) for c in ("block", "at", "lang")] + [batch.column("text").cast(pa.binary())]
        for i in range(batch.num_rows):
            block, at, lang, text = (c[i].as_py() for c in columns)
            # rows of a block that do not join on begin a part of their own
            if held[0] and (block != number or at != held[0][-1] + len(held[2][-1]) + 1):
                yield number, *held
                held = ([], [], [])
            number = block
            for column, value in zip(held, (at, lang, text)):
                column.append(value)
    if held[0]:
        yield number, *held


def narrowed(rows: DataFrame, bits: int) -> DataFrame:
    """Packed rows dealt out again to ranges of ``bits`` bits."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held: dict[int, list] = {}
        for batch in batches:
            for words, n, data in zip(*(batch.column(c).to_pylist() for c in ("words", "n", "data"))):
                held.setdefault(words, []).append(unpacked(n, data))
                if sum(len(h[0]) for h in held[words]) > ENTRIES_AT_ONCE:
                    yield from packed(words, [np.concatenate(f) for f in zip(*held.pop(words))], bits)
        for words, parts in held.items():
            yield from packed(words, [np.concatenate(f) for f in zip(*parts)], bits)

    return rows.repartition("bucket").mapInArrow(lambda batches: _rows(deal(batches)), PACKED)


PLACES = "block long, words int, n int, new int, prints binary, data binary"


def frequent(
    staged: DataFrame, sizes: Sequence[int], bits: int, tasks: int, least: int, passes: Callable[[np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """The entries of all fingerprints that occur ``least`` times altogether, packed for each block they came from.

    ``new`` of a row's fingerprints are in no other row before it, so their sum counts distinct ones.
    Ranges of fingerprints are as many as the text asks for; each shuffle tells apart
    ``SHUFFLE_BITS`` bits more, so rows stay large however many ranges there are.
    """
    steps = [*range(SHUFFLE_BITS, bits, SHUFFLE_BITS), bits]
    rows = entries(staged, sizes, steps[0], passes)
    for more in steps[1:]:
        rows = narrowed(rows, more)

    def kept(group: pa.Table) -> pa.Table:
        out = []
        for words in pc.unique(group["words"]).to_pylist():
            part = group.filter(pc.equal(group["words"], words))
            prints, counts, places, numbers = (np.concatenate(f) for f in zip(*map(unpacked, part["n"].to_pylist(), part["data"].to_pylist())))
            order = np.argsort(prints)
            first = np.flatnonzero(np.diff(prints[order], prepend=~prints[order[:1]]))
            sums = np.add.reduceat(counts[order].astype(np.int64), first)
            size = np.diff(first, append=len(order))
            chosen = np.repeat(sums >= least, size)
            once = np.zeros(len(order), bool)
            once[first] = True
            order, once = order[chosen], once[chosen]
            by_block = np.argsort(numbers[order], kind="stable")
            order, once = order[by_block], once[by_block]
            cuts = np.flatnonzero(np.diff(numbers[order])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(order)]):
                if b > a:
                    at = order[a:b]
                    data = planes(counts[at], FIELDS[1]) + planes(places[at], FIELDS[2])
                    out.append((int(numbers[at[0]]), words, b - a, int(once[a:b].sum()), planes(prints[at], FIELDS[0]), data))
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        columns = list(zip(*out)) or [()] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "words", "n", "new", "prints", "data"])

    return rows.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(kept, PLACES)


# ---- the filter of frequent fingerprints ----


def filter_places(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    return prints & mask, (prints >> np.uint64(32)) & mask


def frequent_filter(found: DataFrame, words: int) -> Callable[[np.ndarray], np.ndarray]:
    """A test that every frequent fingerprint of ``words`` words passes, and few others.

    The bit table goes through the driver, in pages of 64 KB, and to all tasks: 16 bits for each fingerprint, 32 MB
    at most; a fuller table lets more through, which costs shuffled rows and changes no result.
    """
    rows = found.filter(F.col("words") == words).select("n", "new", "prints")
    count = max(rows.agg(F.sum("new")).first()[0] or 0, 1)
    bits = min(max(math.ceil(math.log2(16 * count)), FILTER_BITS[0]), FILTER_BITS[1])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits that the rows set, as cells of 64."""
        for batch in batches:
            prints = [unplaned(p, 0, n, FIELDS[0])[0].astype("u8") for n, p in zip(batch.column("n").to_pylist(), batch.column("prints").to_pylist())]
            at = np.unique(np.concatenate(filter_places(np.concatenate(prints), bits))) if prints else np.zeros(0, np.uint64)
            cell, run = np.unique(at >> np.uint64(6), return_index=True)
            marks = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), run) if len(run) else at
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(marks.view(np.int64))], names=["cell", "mark"])

    def page(group: pa.Table) -> pa.Table:
        at = group["cell"].to_numpy()
        table = np.zeros(min(1 << PAGE_BITS, 1 << (bits - 6)), np.int64)
        table[at & ((1 << PAGE_BITS) - 1)] = group["mark"].to_numpy()
        return pa.table([pa.array([at[0] >> PAGE_BITS], pa.int64()), pa.array([table.tobytes()], pa.binary())], names=["page", "bits"])

    cells = rows.mapInArrow(mark, "cell long, mark long").groupBy("cell").agg(F.bit_or("mark").alias("mark"))
    pages = written(cells.groupBy(F.shiftright("cell", PAGE_BITS)).applyInArrow(page, "page long, bits binary"), "phrase-filter")
    table = np.zeros(1 << (bits - 6), np.uint64)
    for r in pages.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint64)
        table[r["page"] << PAGE_BITS :][: len(part)] = part
    shared = found.sparkSession.sparkContext.broadcast(table)

    def passes(prints: np.ndarray) -> np.ndarray:
        both = np.ones(len(prints), bool)
        for at in filter_places(prints, bits):
            both &= (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return both

    return passes


# ---- phrases from places ----


def phrases(staged: DataFrame, found: DataFrame, tasks: int, least: int) -> DataFrame:
    """``(lang, words, phrase, count)``: the texts at the places, with their counts summed by text."""
    word = rb"[^ \t.,;:!?\n-\r]+"
    names = ["lang", "words", "phrase", "count"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]

    def read(texts: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if len(texts) and len(rows):
            texts = texts.sort_by("at")
            at = texts["at"].to_numpy()
            data = b"\n".join(texts["text"].cast(pa.binary()).to_pylist()).lower()
            langs = texts["lang"].combine_chunks().dictionary_encode()
            for words, n, packed_places in zip(*(rows[c].to_pylist() for c in ("words", "n", "data"))):
                counts, after = unplaned(packed_places, 0, n, FIELDS[1])
                places, _ = unplaned(packed_places, after, n, FIELDS[2])
                match = re.compile(word + rb"(?:[ \t]+%b){%d}" % (word, words - 1)).match
                spans = [match(data, p).group() for p in places.tolist()]
                if words > 1:
                    spans = [b" ".join(s.split()) for s in spans]
                lang = langs.take(pa.array(np.searchsorted(at, places, "right") - 1)).cast(pa.string())
                columns = [lang, pa.repeat(pa.scalar(words, pa.int32()), n), pa.array(spans, pa.binary()).cast(pa.string()), pa.array(counts.astype(np.int64))]
                out.append(pa.table(columns, names=names))
        return pa.concat_tables(out) if out else pa.table([pa.array([], k) for k in kinds], names=names)

    places = found.select("block", "words", "n", "data").repartition(tasks, "block")
    pairs = staged.repartition(tasks, "block").groupBy("block").cogroup(places.groupBy("block"))
    rows = pairs.applyInArrow(read, "lang string, words int, phrase string, count long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("count").alias("count")).filter(F.col("count") >= least)


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(phrases, totals)``: ``(lang, words, phrase, count)`` of all phrases of 1 to ``max_words`` words that
    occur ``least`` times in a language, and ``(lang, n)``, all word occurrences. Both exact.

    Null texts are empty; null languages are one, ``und``; repeated rows count each; a text of any
    length is read whole, cut into rows at ends of pieces. Other columns are not read. An empty
    table gives empty frames.
    """
    staged = written(blocks(docs, text_col, lang_col), "phrase-text")
    totals = staged.groupBy("lang").agg(F.sum(F.regexp_count("text", F.lit(WORD))).cast("long").alias("n"))
    size = staged.groupBy("block").agg(F.max("at").alias("at")).agg(F.sum("at")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(size, 1) / RANGE_BYTES)))
    tasks = math.ceil(max(size, 1) / TASK_BYTES)
    found = [written(frequent(staged, range(1, min(2, max_words) + 1), bits, tasks, least), "phrase-places")]
    for n in range(3, max_words + 1):
        found.append(written(frequent(staged, [n], bits, tasks, least, frequent_filter(found[-1], n - 1)), "phrase-places"))
    places = reduce(DataFrame.unionByName, found)
    return written(phrases(staged, places, tasks, least), "phrases"), totals


# ---- scores ----


def scored(found: DataFrame, max_words: int = MAX_WORDS) -> DataFrame:
    """``(lang, words, phrase, a, l, r, score)`` of the phrases of two words or more, at the cut with the lowest score."""
    counts = found.select("lang", "phrase", "count")
    cuts = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    rows = found.filter("words > 1").select("lang", "words", "phrase", F.col("count").alias("a"), cuts)
    pieces = F.split("phrase", " ")
    rows = rows.withColumns(
        {"head": F.array_join(F.slice(pieces, 1, F.col("k")), " "), "tail": F.array_join(F.slice(pieces, F.col("k") + 1, F.col("words")), " ")}
    )
    for name, side in (("l", "head"), ("r", "tail")):
        rows = rows.join(counts.select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    score = F.expr("(cast(1000000 as decimal(38,0)) * a * a) div (cast(l as decimal(38,0)) * r)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return rows.groupBy("lang", "words", "phrase", "a").agg(best).select("lang", "words", "phrase", "a", "best.l", "best.r", "best.score")


def without_parts(rows: DataFrame, found: DataFrame, percent: int = INSIDE_PERCENT) -> DataFrame:
    """Rows of phrases that no longer frequent phrase holds in ``percent`` of their occurrences or more."""
    spans = F.explode(F.filter(
        F.flatten(F.transform(F.sequence(F.lit(1), F.col("words")), lambda i: F.transform(
            F.sequence(F.lit(2), F.greatest(F.col("words") - 1, F.lit(2))), lambda m: F.struct(i.alias("i"), m.alias("m"))))),
        lambda s: s["i"] + s["m"] - 1 <= F.col("words"),
    )).alias("span")
    longer = found.filter("words > 2").select("lang", "words", "phrase", "count", spans)
    inner = F.array_join(F.slice(F.split("phrase", " "), F.col("span.i"), F.col("span.m")), " ")
    most = longer.select("lang", inner.alias("phrase"), "count").groupBy("lang", "phrase").agg(F.max("count").alias("inside"))
    kept = rows.join(most, ["lang", "phrase"], "left")
    return kept.filter(F.col("inside").isNull() | (100 * F.col("inside") < percent * F.col("a"))).drop("inside")


def collocations(
    docs: DataFrame, top: int = TOP, max_words: int = MAX_WORDS, least: int = MIN_COUNT, percent: int = INSIDE_PERCENT, lang_col: str = "lang", text_col: str = "text",
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` phrases of 2 to ``max_words`` words.

    Ties in the score go to the larger count, then to the smaller phrase by its bytes. Edge cases
    as in :func:`frequent_phrases`.
    """
    found, totals = frequent_phrases(docs, max_words, least, lang_col, text_col)
    rows = without_parts(scored(found, max_words), found, percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # thinned inside 64 slices first: at most 64 * top phrases of a language meet in one task
    sliced = rows.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    thin = sliced.withColumn("rank", F.row_number().over(W.partitionBy("lang", "slice").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = thin.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
