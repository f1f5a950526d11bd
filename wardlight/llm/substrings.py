"""Repeated passages: bytes covered by a string that also starts in a document with a smaller id.

Equal texts are worked on once. Of the rest, every window of ``SIZE`` bytes belongs to its
anchor, the stretch of ``ANCHOR`` bytes inside it with the smallest hash. Equal windows
have equal anchors, so only windows of anchors that occur in two texts can repeat:

1. Anchor hashes go to tasks by hash; those in two texts come back to their texts.
2. For these, the units (an anchor's consecutive windows, overlapping bytes and all) go to tasks by
   anchor. A task sorts the units, and then the windows of units that differ, as suffixes
   with hash-compared mergesort (:mod:`wardlight.llm.suffix_sort`); equal suffixes stand side by
   side and the smallest document of each class keeps its bytes.

Anchors that many texts of a block share are settled within the block: one entry stands for all in
step 1, and in step 2 units that equal a unit of a smaller document of the block are decided there.
So what a task gets for one passage grows with the number of blocks, not of documents.

An anchor that more texts share than ``Limits.hot`` may stand in ever different surroundings, and
its units are then as many as the texts. Its windows go out one by one instead, each to the task of
its own hash, after those that a smaller document of the block holds too are decided there: equal
windows still meet, and the rest of the anchor's windows is spread over all tasks.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import shared_folder, written
from wardlight.llm.suffix_sort import PrefixHashes, equal_groups, mixed

SIZE, ANCHOR = 50, 16
PLACE_BITS = 24
NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Limits:
    """How much a task works on at once; results do not depend on it."""

    block_bytes: int = 2 << 20  # text of a block
    piece_bytes: int = 4 << 20  # the longest piece of one text; with a block below 2 ** PLACE_BITS
    units: int = 30_000  # units resolved together
    hot: int = 10_000  # texts that share an anchor, from which its windows are dealt out one by one
    part_bytes: int = 16 << 20  # text whose anchors and units one task gathers
    most_parts: int = 4096  # a block's entries are cut into so many at most


CHUNK = 1 << 18
LOW = np.uint64((1 << PLACE_BITS) - 1)


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``data``: the place of its anchor, and 48 bits of the anchor's hash."""
    code = mixed(PrefixHashes(data).grams(ANCHOR))
    # The place in the low bits breaks ties: the leftmost of equal anchors in a window.
    least = (code & ~LOW) | np.arange(len(code), dtype=np.uint64)
    span, wanted = 1, SIZE - ANCHOR + 1
    while 2 * span <= wanted:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < wanted:
        least = np.minimum(least[: span - wanted], least[wanted - span :])
    place = (least & LOW).astype(np.int64)
    return place, code[place] >> np.uint64(16)


class Block:
    """Units of many pieces of text. A unit is a run of windows with one anchor."""

    def __init__(self, pieces: list[bytes]):
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.begin = np.cumsum(sizes) - sizes
        self.data = np.frombuffer(b"".join(pieces), np.uint8)
        windows = np.maximum(sizes - SIZE + 1, 0)
        found = [np.zeros((4, 0), np.int64)]
        # Chunks that fit the processor's caches; a unit cut by a chunk's end is two units.
        for at in range(0, len(self.data) - SIZE + 1, CHUNK):
            place, code = window_anchors(self.data[at : at + CHUNK + SIZE - 1])
            owner = np.repeat(np.arange(len(sizes)), np.clip(self.begin + sizes, at, at + len(place)) - np.clip(self.begin, at, at + len(place)))
            window = np.arange(at, at + len(place))
            inside = window < self.begin[owner] + windows[owner]
            window, place, owner, code = window[inside], place[inside], owner[inside], code[inside]
            if len(window):
                new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
                last = np.concatenate([new[1:], [len(window)]]) - 1
                found.append(np.stack([window[new], window[last], owner[new], code[new].view(np.int64)]))
        self.first, self.last, self.owner, code = np.concatenate(found, axis=1)
        self.code = np.ascontiguousarray(code).view(np.uint64)


def pieces_of(text: bytes, size: int) -> list[tuple[int, bytes]]:
    """``(offset, bytes)``: a text in pieces that overlap, so each window is whole in exactly one."""
    return [(a, text[a : a + size + SIZE - 1]) for a in range(0, max(len(text) - SIZE + 1, 1), size)]


def blocks(batches: Iterator[pa.RecordBatch], limits: Limits, extra: tuple[str, ...] = ()) -> Iterator[tuple[list[tuple], Block]]:
    """``([(row, id, offset, *extra), ...], units)`` of about ``block_bytes`` of text each."""
    held, pieces, size = [], [], 0
    for batch in batches:
        columns = [batch.column(c) for c in ("row", "id", "text", *extra)]
        for i in range(batch.num_rows):
            row, number, text, *more = (c[i].as_py() for c in columns)
            for offset, piece in pieces_of(text.encode(), limits.piece_bytes):
                if size and size + len(piece) > limits.block_bytes:
                    yield held, Block(pieces)
                    held, pieces, size = [], [], 0
                held.append((row, number, offset, *more))
                pieces.append(piece)
                size += len(piece)
    if held:
        yield held, Block(pieces)


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as a compressed byte string, byte planes apart (zeros cost little)."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(blob: bytes, count: int, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        size = np.dtype(kind).itemsize
        plane = np.frombuffer(data, np.uint8, count * size, at).reshape(size, count)
        out.append(np.ascontiguousarray(plane.T).view(kind).reshape(count))
        at += count * size
    return out


def steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def batch_of(**columns: list) -> pa.RecordBatch:
    kinds = {"key": pa.int32(), "row": pa.int64(), "block": pa.int64(), "count": pa.int64(), "known": pa.bool_()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.binary())) for k, v in columns.items()], names=list(columns))


def by_value(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct value with its positions."""
    order = np.argsort(values, kind="stable")
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield values[part[0]], part


MANY = -1
#: Marks the code of a hot anchor; codes have 48 bits.
HOT = np.uint64(1 << 63)
ENTRIES = "key int, block long, count long, known boolean, body binary"


def anchor_entries(parts: int, limits: Limits):
    """Step 1, map: anchor codes by part; codes that several texts of the block share are known at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, block in blocks(batches, limits):
            rows = np.array([h[0] for h in held], np.int64)[block.owner]
            order = np.lexsort((rows, block.code))
            code, rows = block.code[order], rows[order]
            new = np.concatenate([[True], (code[1:] != code[:-1]) | (rows[1:] != rows[:-1])])[: len(code)]
            code, rows = code[new], rows[new]
            _, start, times = np.unique(code, return_index=True, return_counts=True)
            shared = np.repeat(times > 1, times)
            name = held[0][0]
            keys, bodies, counts, known = [], [], [], []
            if shared.any():
                keys.append(name % parts), counts.append(int(shared.sum())), known.append(True)
                bodies.append(packed(rows[shared], code[shared]))
            sent_code, sent_row = code[start], np.where(times > 1, MANY, rows[start])
            for part, at in by_value(sent_code % np.uint64(parts)):
                at = at[np.argsort(sent_row[at], kind="stable")]
                keys.append(int(part)), counts.append(len(at)), known.append(False)
                bodies.append(packed(steps(sent_row[at]), sent_code[at], times[at].astype("<i4")))
            yield batch_of(key=keys, block=[name] * len(keys), count=counts, known=known, body=bodies)

    return run


def shared_anchors(limits: Limits):
    """Step 1, reduce: for each block the ``(row, code)`` of anchors that occur in two texts.

    A hot anchor's code is marked; to texts that share it with others of their block, which know it
    as shared already, the mark is sent with the row ``MANY``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, all_rows, all_codes, all_times = [], [], [], []
        for batch in batches:
            for name, count, known, body in zip(*(batch.column(c).to_pylist() for c in ("block", "count", "known", "body"))):
                if known:
                    yield batch_of(block=[name], count=[count], body=[body])
                    continue
                rows, codes, times = unpacked(body, count, "<i8", "<u8", "<i4")
                names.append(np.full(count, name, np.int64))
                all_rows.append(np.cumsum(rows))
                all_codes.append(codes)
                all_times.append(times.astype(np.int64))
        if not names:
            return
        names, rows, codes, times = (np.concatenate(x) for x in (names, all_rows, all_codes, all_times))
        order = np.argsort(codes, kind="stable")
        names, rows, codes, times = names[order], rows[order], codes[order], times[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        size = np.diff(np.concatenate([first, [len(codes)]]))
        # A code is sent once for each block and row, so two entries, or one for many, are two texts
        # (or two blocks that hold pieces of one long text: a harmless candidate).
        many = np.minimum.reduceat(rows, first) == MANY
        hot = np.repeat(np.add.reduceat(times, first) > limits.hot, size)
        keep = np.repeat(many | (size > 1), size) & ((rows != MANY) | hot)
        codes = np.where(hot, codes | HOT, codes)
        for name, at in by_value(names[keep]):
            at = np.flatnonzero(keep)[at]
            yield batch_of(block=[int(name)], count=[len(at)], body=[packed(rows[at], codes[at])])

    return run


def codes_by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(row, codes)`` of each text from its block's answers."""
    for batch in batches:
        for answers in batch.column("answers").to_pylist():
            found = [unpacked(a["body"], a["count"], "<i8", "<u8") for a in answers]
            rows, codes = (np.concatenate(x) for x in zip(*found))
            # marks for many texts of the block: each of them that has the code gets the marked one too
            marked = np.unique(codes[rows == MANY])
            mine = rows != MANY
            rows, codes = rows[mine], codes[mine]
            codes = np.where(np.isin(codes, marked ^ HOT), codes | HOT, codes)
            out = [(int(row), codes[at].tobytes()) for row, at in by_value(rows)]
            yield batch_of(row=[r for r, _ in out], codes=[c for _, c in out])


def merged_spans(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals, in order; touching ones join."""
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], first[1:] > reach[:-1]])[: len(first)]
    return first[new], reach[np.concatenate([np.flatnonzero(new)[1:], [len(first)]]) - 1]


def spans_by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(row, spans)``: removed intervals of each text of a block, merged, as pairs of 64-bit numbers."""
    for batch in batches:
        for answers in batch.column("answers").to_pylist():
            found = [unpacked(a["body"], a["count"], "<i8", "<i8", "<i8") for a in answers]
            rows, first, end = (np.concatenate(x) for x in zip(*found))
            out = [(int(row), np.column_stack(merged_spans(first[at], end[at])).astype("<i8").tobytes()) for row, at in by_value(rows)]
            yield batch_of(row=[r for r, _ in out], spans=[s for _, s in out])


def unit_entries(parts: int, limits: Limits):
    """Step 2, map: units of shared anchors by part. A unit that equals one of a smaller document goes at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, block in blocks(batches, limits, ("codes",)):
            wanted, hot = np.zeros(len(block.code), bool), np.zeros(len(block.code), bool)
            bounds = np.searchsorted(block.owner, np.arange(len(held) + 1))
            for i, h in enumerate(held):
                a, b = bounds[i], bounds[i + 1]
                mine = np.concatenate([np.frombuffer(c, "<u8") for c in h[3]])
                wanted[a:b] = np.isin(block.code[a:b], mine & ~HOT)
                hot[a:b] = np.isin(block.code[a:b], mine[mine >= HOT] ^ HOT)
            unit = np.flatnonzero(wanted)
            if not len(unit):
                continue
            owner, first, length = block.owner[unit], block.first[unit], block.last[unit] - block.first[unit] + SIZE
            row_of, id_of, offset_of = (np.array([h[k] for h in held], np.int64) for k in range(3))
            gone = taken_in_block(block.data, first, length, id_of[owner])
            removed = [(owner[gone], first[gone], length[gone])]
            # what is left of hot anchors goes on as windows, whose codes are their own
            on, apart = np.flatnonzero(~gone & ~hot[unit]), np.flatnonzero(~gone & hot[unit])
            sent = [(owner[on], first[on], length[on], block.code[unit[on]])]
            if len(apart):
                runs = length[apart] - SIZE + 1
                window, holder = stretches(first[apart], runs), np.repeat(owner[apart], runs)
                whole = np.full(len(window), SIZE)
                gone = taken_in_block(block.data, window, whole, id_of[holder])
                removed.append((holder[gone], window[gone], whole[gone]))
                window, holder = window[~gone], holder[~gone]
                sent.append((holder, window, whole[~gone], mixed(PrefixHashes(block.data).of(window, SIZE)) >> np.uint64(16)))
            name = held[0][0]
            keys, bodies, counts, known, texts = [], [], [], [], []
            owner, first, length = (np.concatenate(x) for x in zip(*removed))
            if len(owner):
                place = first - block.begin[owner] + offset_of[owner]
                keys.append(name % parts), counts.append(len(owner)), known.append(True), texts.append(b"")
                bodies.append(packed(row_of[owner], place, place + length))
            owner, first, length, code = (np.concatenate(x) for x in zip(*sent))
            rows, ids, place = row_of[owner], id_of[owner], first - block.begin[owner] + offset_of[owner]
            for part, at in by_value(code % np.uint64(parts)):
                meta = (steps(rows[at]), steps(ids[at]), place[at], code[at], length[at].astype(np.uint8))
                keys.append(int(part)), counts.append(len(at)), known.append(False), bodies.append(packed(*meta))
                texts.append(zstandard.ZstdCompressor(level=1).compress(block.data[stretches(first[at], length[at])].tobytes()))
            yield batch_of(key=keys, block=[name] * len(keys), count=counts, known=known, body=bodies, text=texts)

    return run


def taken_in_block(data: np.ndarray, first: np.ndarray, length: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which stretches equal one of a smaller document of the block."""
    group = equal_groups(data, first, length)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    return ids > least[group]


def stretches(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All places of the stretches, one after the other."""
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(int(length.sum()))


def resolved(data: np.ndarray, start: np.ndarray, length: np.ndarray, code: np.ndarray, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(unit, first, end)`` of removed bytes, relative to the units, among units of whole anchor groups."""
    group = equal_groups(data, start, length)
    least = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, ids)
    gone = np.flatnonzero(ids > least[group])
    out = [(gone, np.zeros(len(gone), np.int64), length[gone])]
    # One unit of each class goes on, with the class's smallest document, if its anchor has other classes.
    _, chosen = np.unique(group, return_index=True)
    _, where, classes = np.unique(code[chosen], return_inverse=True, return_counts=True)
    chosen = chosen[classes[where] > 1]
    if not len(chosen):
        return out
    runs = length[chosen] - SIZE + 1
    unit = np.repeat(chosen, runs)
    offset = np.arange(len(unit)) - np.repeat(np.cumsum(runs) - runs, runs)
    at = start[unit] + offset
    window = equal_groups(data, at, np.full(len(at), SIZE))
    owner = least[group[unit]]
    first_doc = np.full(window.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(first_doc, window, owner)
    repeat = owner > first_doc[window]
    # What holds for a class holds for each of its units of the smallest document.
    spans = np.column_stack([group[unit[repeat]], offset[repeat]])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    members = np.flatnonzero(ids == least[group])
    low = np.searchsorted(spans[:, 0], group[members])
    high = np.searchsorted(spans[:, 0], group[members], side="right")
    count = high - low
    which = np.repeat(members, count)
    span = np.repeat(low, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    out.append((which, spans[span, 1], spans[span, 1] + SIZE))
    return out


def removed_spans(limits: Limits):
    """Step 2, reduce: for each block the ``(row, first, end)`` of bytes that a smaller document holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for batch in batches:
            for name, count, known, body, text in zip(*(batch.column(c).to_pylist() for c in ("block", "count", "known", "body", "text"))):
                if known:
                    yield batch_of(block=[name], count=[count], body=[body])
                else:
                    kept.append((name, count, body, text))
        if not kept:
            return
        metas = [unpacked(body, count, "<i8", "<i8", "<i8", "<u8", "u1") for _, count, body, _ in kept]
        rows, ids = (np.concatenate([np.cumsum(m[k]) for m in metas]) for k in (0, 1))
        place, code, length = (np.concatenate([m[k] for m in metas]) for k in (2, 3, 4))
        names = np.repeat([name for name, _, _, _ in kept], [count for _, count, _, _ in kept])
        length = length.astype(np.int64)
        data = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(t) for _, _, _, t in kept), np.uint8)
        del kept, metas
        start = np.cumsum(length) - length
        order = np.argsort(code, kind="stable")
        _, size = np.unique(code[order], return_counts=True)
        open_ = size > 1
        order = order[np.repeat(open_, size)]
        ends = np.cumsum(size[open_])
        at, found = 0, []
        while at < len(order):
            # Whole anchor groups, about ``limits.units`` units together.
            stop = int(ends[min(np.searchsorted(ends, at + limits.units), len(ends) - 1)])
            some = order[at:stop]
            own = np.cumsum(length[some]) - length[some]
            text = data[stretches(start[some], length[some])]
            for unit, a, b in resolved(text, own, length[some], code[some], ids[some]):
                found.append((some[unit], place[some][unit] + a, place[some][unit] + b))
            at = stop
        if found:
            unit, first, end = (np.concatenate(x) for x in zip(*found))
            for name, at in by_value(names[unit]):
                yield batch_of(block=[int(name)], count=[len(at)], body=[packed(rows[unit[at]], first[at], end[at])])

    return run


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(text_key, n_removed, n_spans, kept_sha256)`` of texts with removed spans."""
    for batch in batches:
        out = []
        for key, text, lists in zip(*(batch.column(c).to_pylist() for c in ("text_key", "text", "spans"))):
            pairs = np.concatenate([np.frombuffer(s, "<i8").reshape(-1, 2) for s in lists])
            first, end = merged_spans(pairs[:, 0], pairs[:, 1])
            data, kept, at = text.encode(), hashlib.sha256(), 0
            for a, b in zip(first.tolist(), end.tolist()):
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((key, int((end - first).sum()), len(first), kept.hexdigest()))
        columns = list(zip(*out)) or [[], [], [], []]
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["text_key", "n_removed", "n_spans", "kept_sha256"])


def by_block(answers: DataFrame) -> DataFrame:
    """Answers of all parts gathered for each block, whose text bounds their size."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("count", "body")).alias("answers"))


def repeated_passages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits()
) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts are empty. Repeated rows have the same result each (an id is not smaller than
    itself). Rows with a null id lose nothing and take nothing from others. Ids are whole numbers, or
    text that reads as one. A very long text is worked on in overlapping pieces. Other columns are not
    read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("text_key", F.unhex(F.sha2("text", 256)))
    keys = written(base.select("id", "text_key", F.octet_length("text").cast("long").alias("n_bytes")), "keys")
    total = keys.agg(F.sum("n_bytes")).first()[0] or 0
    parts = min(max(buckets, -(-total // limits.part_bytes)), max(buckets, limits.most_parts))
    # Each text once, in files by its key: joins on the key read them without a shuffle.
    texts = base.filter(F.col("id").isNotNull() & (F.octet_length("text") >= SIZE)).groupBy("text_key")
    texts = texts.agg(F.min("id").cast("long").alias("id"), F.first("text").alias("text")).withColumn("row", F.monotonically_increasing_id())
    table, folder = f"passages_{uuid.uuid4().hex}", shared_folder(spark, "passages")
    texts.write.bucketBy(buckets, "text_key").option("path", folder).option("compression", "zstd").saveAsTable(table)
    texts = spark.table(table)

    entries = texts.select("row", "id", "text").mapInArrow(anchor_entries(parts, limits), ENTRIES)
    answers = entries.repartition(parts, "key").mapInArrow(shared_anchors(limits), "block long, count long, body binary")
    shared = by_block(answers).mapInArrow(codes_by_row, "row long, codes binary")
    shared = shared.groupBy("row").agg(F.collect_list("codes").alias("codes"))
    numbers = written(texts.select("row", "text_key"), "numbers")
    shared = written(shared.join(numbers, "row").select("text_key", "codes"), "anchors")

    units = texts.join(shared, "text_key").select("row", "id", "text", "codes")
    entries = units.mapInArrow(unit_entries(parts, limits), f"{ENTRIES}, text binary")
    answers = entries.repartition(parts, "key").mapInArrow(removed_spans(limits), "block long, count long, body binary")
    spans = by_block(answers).mapInArrow(spans_by_row, "row long, spans binary")
    spans = spans.groupBy("row").agg(F.collect_list("spans").alias("spans"))
    spans = written(spans.join(numbers, "row").select("text_key", "spans"), "spans")

    kind = "text_key binary, n_removed long, n_spans long, kept_sha256 string"
    own = texts.join(spans, "text_key").select("text_key", "text", "spans").mapInArrow(digests, kind)
    least = keys.groupBy("text_key").agg(F.min("id").alias("least"))
    result = written(least.join(own, "text_key", "left"), "removed")
    spark.sql(f"DROP TABLE {table}")
    copy = (F.col("id") > F.col("least")) & (F.col("n_bytes") >= SIZE)
    mine = F.col("id").isNotNull() & F.col("n_removed").isNotNull()
    return keys.join(result, "text_key").select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(mine, F.col("n_removed")).otherwise(0).alias("n_removed"),
        F.when(copy, 1).when(mine, F.col("n_spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, NOTHING).when(mine, F.col("kept_sha256")).otherwise(F.lower(F.hex("text_key"))).alias("kept_sha256"),
    )
