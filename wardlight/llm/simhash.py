"""SimHash near-duplicates, linked by a range join over per-segment bit counts.

A fingerprint of 64 bits is cut into 32 segments of two bits and mapped to the number of
one bits in each, a point with coordinates 0 to 2. One flipped bit moves one coordinate by
one, so the Manhattan distance of two points never exceeds the Hamming distance of their
fingerprints. The join has three steps:

1. Grid: a point's halves (16 coordinates each) are its two grid cells. Points within
   distance 3 are within distance 1 in at least one half, so a point is stored in its own
   cell and looked up in the cells one step up in one coordinate (a step down is the
   partner's step up).
2. Lower bound: Manhattan distance of the whole points at most ``max_bits``.
3. Exact check: Hamming distance at most ``max_bits``.

Equal fingerprints are one point, so copies never make pairs, and a cell gives a spanning
forest of its links rather than all of them. Cells above ``tile`` points are cut into tiles
that meet pairwise in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from wardlight.llm.common import fresh, written

SEED = 42
LOW_BITS = 0x5555555555555555
HALVES, HALF_SEGMENTS = 2, 16
TILE = 8192
DENSE = 48


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of the word shingles of ``text``, unsigned; 0 without words."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(parts))
    spans = zip(starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, len(parts) - size + 1)
    ones = np.zeros(64, np.int64)
    for block in np.split(hashes, range(1 << 14, len(hashes), 1 << 14)):
        ones += np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """SimHash of a text column as a signed long (the bits of the unsigned number)."""

    @F.pandas_udf("long")
    def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((fingerprint(t, words) for t in texts), np.uint64, len(texts)).view(np.int64))

    return simhash(text)


def segment_counts(prints: np.ndarray) -> np.ndarray:
    """One-bit counts (0 to 2) of the 32 two-bit segments, each left in its own two bits."""
    return prints - ((prints >> np.uint64(1)) & np.uint64(LOW_BITS))


def thermometer(counts: np.ndarray) -> np.ndarray:
    """Counts 0, 1, 2 as bits 00, 01, 11: differing bits are then the Manhattan distance."""
    high = (counts >> np.uint64(1)) & np.uint64(LOW_BITS)
    low = counts & np.uint64(LOW_BITS)
    return (high << np.uint64(1)) | high | low


def grid_entries(prints: pd.Series) -> pd.DataFrame:
    """Rows ``(cell, print, stored)``: two own cells and the cells one step up in a coordinate."""
    points = prints.to_numpy().view(np.uint64)
    counts = segment_counts(points)
    frames = []
    for half in range(HALVES):
        own = (counts >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        base = np.uint64(half << 32)
        frames.append((own | base, points, np.ones(len(points), bool)))
        for segment in range(HALF_SEGMENTS):
            rises = ((own >> np.uint64(2 * segment)) & np.uint64(3)) < 2
            step = own[rises] + np.uint64(1 << (2 * segment))
            frames.append((step | base, points[rises], np.zeros(int(rises.sum()), bool)))
    cell, point, stored = (np.concatenate(x) for x in zip(*frames))
    return pd.DataFrame({"cell": cell.view(np.int64), "print": point.view(np.int64), "stored": stored})


def close_pairs(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Mask of pairs that pass the Manhattan lower bound and then the exact distance."""
    bound = np.bitwise_count(thermometer(segment_counts(left)) ^ thermometer(segment_counts(right))) <= max_bits
    bound[bound] = np.bitwise_count(left[bound] ^ right[bound]) <= max_bits
    return bound


def spanning_links(stored: np.ndarray, others: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest with the same connected parts as all links of ``stored`` x (``stored`` + ``others``)."""
    points = np.concatenate([stored, others])
    parent = list(range(len(points)))
    above = thermometer(segment_counts(points))
    keep_a, keep_b = [], []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(stored)):
        near = np.flatnonzero(np.bitwise_count(above[i + 1 :] ^ above[i]) <= max_bits) + i + 1
        near = near[np.bitwise_count(points[near] ^ points[i]) <= max_bits]
        for j in near.tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                keep_a.append(i)
                keep_b.append(j)
    return points[keep_a], points[keep_b]


def links_of_sorted(cells: np.ndarray, tiles: np.ndarray, prints: np.ndarray, stored: np.ndarray, max_bits: int):
    """Links of complete cells; rows come sorted by cell and tile pair, stored points first."""
    new = np.concatenate([[True], (cells[1:] != cells[:-1]) | (tiles[1:] != tiles[:-1])])
    first = np.flatnonzero(new)
    sizes = np.diff(np.concatenate([first, [len(cells)]]))
    group = np.cumsum(new) - 1
    found = []
    small = sizes <= DENSE
    for lag in range(1, int(sizes[small].max(initial=1))):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & small[group[:-lag]] & stored[:-lag])
        if len(i):
            i = i[close_pairs(prints[i], prints[i + lag], max_bits)]
            found.append((prints[i], prints[i + lag]))
    for g in np.flatnonzero(~small):
        a, b = first[g], first[g] + sizes[g]
        cut = a + int(stored[a:b].sum())
        found.append(spanning_links(prints[a:cut], prints[cut:b], max_bits))
    return found


def linked_prints(prints: DataFrame, max_bits: int = 3, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints (column ``print``) with the connectivity of all links.

    ``max_bits`` is at most 3: beyond, a distance of one in one half no longer has to occur.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 4096):
                yield grid_entries(batch["print"].iloc[start : start + 4096])

    entries = prints.mapInPandas(explode, "cell long, print long, stored boolean")
    sizes = entries.groupBy("cell").agg(F.count_if("stored").alias("n_stored"), F.count("*").alias("n"))
    crowded = sizes.filter((F.col("n") > tile) & (F.col("n_stored") > 0)).select(
        "cell", F.ceil(F.col("n") / tile).cast("int").alias("parts")
    )
    # A crowded cell is cut into parts by print; row tile x column tile meet once, in a task of their own.
    part = F.pmod(F.xxhash64("print"), F.coalesce("parts", F.lit(1))).cast("int")
    every = F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)
    tagged = entries.join(crowded, "cell", "left").withColumn("part", part)
    as_row = tagged.filter("stored").select(
        "cell", "print", F.explode(every).alias("col"), F.col("part").alias("row"), F.lit(True).alias("stored")
    )
    as_column = tagged.select(
        "cell", "print", F.explode(every).alias("row"), F.col("part").alias("col"), F.lit(False).alias("stored")
    )
    single = tagged.filter("parts IS NULL").select("cell", "print", F.lit(0).alias("row"), F.lit(0).alias("col"), "stored")
    several = as_row.filter("parts IS NOT NULL").unionByName(as_column.filter("parts IS NOT NULL"))
    rows = single.unionByName(several).withColumn("tiles", F.col("row").cast("long") * (1 << 31) + F.col("col"))
    ordered = rows.repartition("cell", "tiles").sortWithinPartitions("cell", "tiles", F.desc("stored"), "print")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def emit(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cells, tiles, points, stored = columns
            found = links_of_sorted(cells, tiles, points.view(np.uint64), stored, max_bits)
            for a, b in found:
                differ = a != b
                if differ.any():
                    a, b = a[differ].view(np.int64), b[differ].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "tiles", "print", "stored")]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            cells, tiles = now[0], now[1]
            # The last cell may go on in the next batch; it holds at most two tiles of points.
            same = (cells == cells[-1]) & (tiles == tiles[-1])
            cut = len(cells) - int(same.sum())
            if cut:
                yield from emit([x[:cut] for x in now])
            held = [x[cut:] for x in now]
        if held is not None:
            yield from emit(held)

    return ordered.select("cell", "tiles", "print", "stored").mapInArrow(links, "a long, b long").distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(print, root)`` for every print of ``nodes`` that has an edge: one root per connected part.

    Rounds of minimum-label spreading with label jumping; each round's labels are written to
    the shared folder. The driver only learns whether a round changed anything.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    star = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = written(star.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "labels")
    while True:
        spread = star.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = labels.join(spread, "u").select("u", "label", F.least("label", "near").alias("next"))
        # Hang the old root under the lower label too, then jump to the label of the label.
        hung = lower.filter("next < label").groupBy(F.col("label").alias("u")).agg(F.min("next").alias("hung"))
        merged = lower.join(hung, "u", "left").select("u", F.least("next", F.coalesce("hung", "next")).alias("next"), "label")
        jump = merged.select(F.col("u").alias("next"), F.col("next").alias("further"))
        after = merged.join(jump, "next", "left").select(
            "u", F.least("next", F.coalesce("further", "next")).alias("label"), F.col("label").alias("before")
        )
        after = written(after, "labels")
        labels = after.select("u", "label")
        if after.filter("label < before").isEmpty():
            return labels.select(F.col("u").alias("print"), F.col("label").alias("root"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3, tile: int = TILE
) -> DataFrame:
    """One row ``(id, fingerprint, component_id)`` for each row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest id reachable
    over links of ``max_bits`` or fewer differing bits. Null or empty texts have fingerprint
    zero and link like any other. Repeated rows each keep a row. Null ids keep their row and
    are no candidates for the smallest id (null if a component has no other). Other columns
    of ``docs`` are not read. An empty table gives an empty table.
    """
    marked = written(
        docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), words).alias("print")), "simhash"
    )
    smallest = written(marked.groupBy("print").agg(F.min("id").alias("smallest")), "prints")
    roots = components(smallest, linked_prints(smallest.select("print"), max_bits, tile))
    rooted = smallest.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = rooted.groupBy("root").agg(F.min("smallest").alias("component_id"))
    table = rooted.join(least, "root").select("print", "component_id")
    return marked.join(table, "print").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """Rows of ``docs``, all columns: of each component the document with the smallest id.

    Of rows that share that id one stays. Rows with a null id stay, as they cannot be told apart.
    """
    linked = near_duplicates(docs.select(id_col, text_col), id_col, text_col, words, max_bits)
    kept = linked.filter(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("n_rows"))
    kept = written(kept, "kept")
    # Both sides grow with the corpus, so the join is a shuffle at every size; the ids are hashed, the texts streamed.
    stay = lambda rows: docs.join(rows.select(id_col).hint("shuffle_hash"), id_col, "left_semi")
    out = stay(kept.filter("n_rows = 1")).unionByName(docs.filter(docs[id_col].isNull()))
    if not kept.filter("n_rows > 1").isEmpty():
        out = out.unionByName(stay(kept.filter("n_rows > 1")).dropDuplicates([id_col]))
    return out
