"""Token ids as ORC files, in ascending id order, with indexes for pruned and parallel reads.

Documents are range-partitioned and sorted by id, so each file holds one range of ids. The
ORC writer stores the ids with integer run-length encoding, cuts files into stripes that
separate tasks can read, and writes row indexes (smallest and largest id for each
``row_index_stride`` rows) and a Bloom filter on the document id; a filter on the id
then skips stripes and row groups by metadata alone.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import shared_folder

ROWS_AT_ONCE = 2048
PARTS_AT_ONCE = 20_000


#: Parts that a task's table holds before it keeps only those of the last batch.
TABLE_PARTS = 1_000_000
# Texts with these are not cut at spaces, or not at line ends (RE2 syntax): pieces could span the cut.
LOOSE_SPACE = r" (?:[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\z)|\x00"
LOOSE_LINE = r"\n[\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}]\n|\A\n|\n\z"
#: A letter before an ASCII mark always ends a piece.
WORD_END = r"(\p{L})([!-/:-@\[-`{-~])"


class KnownParts:
    """Ids of parts as arrays; Arrow finds the parts of a batch among the known ones."""

    def __init__(self, limit: int = TABLE_PARTS):
        self.limit = limit
        self.parts = pa.array([], pa.string())
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def look_up(self, parts: pa.Array, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(start, size, ids)``: part i has ``ids[start[i] : start[i] + size[i]]``. ``encode`` gets the unknown ones."""
        place = pc.index_in(parts, value_set=self.parts)
        missing = place.is_null()
        unknown = parts.filter(missing)
        place = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(unknown):
            place[missing.to_numpy(zero_copy_only=False)] = len(self.parts) + np.arange(len(unknown))
            ids, size = encode(unknown.to_pylist())
            self.parts = pa.concat_arrays([self.parts, unknown])
            self.size, self.ids = np.concatenate([self.size, size]), np.concatenate([self.ids, ids])
        start = np.cumsum(self.size) - self.size
        found = start[place], self.size[place], self.ids
        if len(self.parts) > self.limit:
            self.parts, self.size = parts, found[1]
            self.ids = self.ids[gathered(found[0], found[1])]
        return found


def gathered(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the stretches, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class LibraryEncoder:
    """The tokenizers library behind a table of parts already encoded.

    Texts are cut where a piece of the tokenizer always starts: at spaces between other
    characters, after a letter before a mark, after a single line end. Arrow finds the distinct
    parts of a batch, the library encodes the unknown ones, and numpy puts the ids together.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.known = KnownParts()

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text by the library."""
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts without special tokens, and how many each has: many in one call, a special token between them."""
        if not self.special:
            found = self.plain(parts)
            return np.concatenate(found), np.array([len(f) for f in found], np.int64)
        mark, number = next(iter(self.special.items()))
        all_ids, sizes = [], []
        for at in range(0, len(parts), PARTS_AT_ONCE):
            ids = self.plain([mark.join(parts[at : at + PARTS_AT_ONCE])])[0]
            cuts = ids == number
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(cuts), [len(ids)]])) - 1)
            all_ids.append(ids[~cuts])
        return np.concatenate(all_ids), np.concatenate(sizes)

    def encode_column(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each followed by ``end``; and how many each has."""
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, LOOSE_SPACE)
        for mark in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, mark))
        cut = pc.replace_substring(pc.if_else(whole, "", texts), " ", "\0 ")
        cut = pc.replace_substring_regex(cut, WORD_END, r"\1" + "\0" + r"\2")
        cut = pc.if_else(pc.match_substring_regex(texts, LOOSE_LINE), cut, pc.replace_substring(cut, "\n", "\n\0"))
        lists = pc.split_pattern(cut, "\0")
        distinct = lists.flatten().dictionary_encode()
        start, size, ids = self.known.look_up(distinct.dictionary, self.encode_parts)
        # Further entries: the end, and texts that were not cut.
        others = [np.array(end, "<u4"), *self.plain(texts.filter(whole).to_pylist())]
        start = np.concatenate([start, len(ids) + np.cumsum([0, *map(len, others[:-1])])])
        size = np.concatenate([size, [len(o) for o in others]]).astype(np.int64)
        ids = np.concatenate([ids, *others])
        # Each text is the numbers of its parts (or of itself) and of the end.
        bounds, last = lists.offsets.to_numpy().astype(np.int64), len(distinct.dictionary)
        number = distinct.indices.to_numpy().astype(np.int64)
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        number[bounds[alone]] = last + 1 + np.arange(len(alone))
        number = np.insert(number, bounds[1:], last)
        edge = np.concatenate([[0], np.cumsum(size[number])])
        counts = np.diff(edge[bounds + np.arange(len(bounds))])
        return ids[gathered(start[number], size[number])], counts


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """The tokenizer of ``path``, read once for each Python worker."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_token_files(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    row_index_stride: int = 1000,
    stripe_mb: int = 16,
) -> None:
    """Write ``(doc_id, part, part_start, n_tokens, ids)`` as ORC below ``folder``.

    ``part`` numbers the id ranges in order; ``part_start`` counts the ids before the document
    in its part. Null texts are empty; null ids come first; rows with equal ids are ordered by
    text and each keep a row. Other columns are not read.
    """
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    )
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer_path)
        part, start = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                ids, counts = tokens.encode_column(batch.column("text"), [] if end_id is None else [end_id])
                bounds = np.concatenate([[0], np.cumsum(counts)])
                lists = pa.ListArray.from_arrays(bounds.astype(np.int32), ids.view("<i4"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([part] * batch.num_rows, pa.int32()), pa.array(start + bounds[:-1]), pa.array(counts), lists],
                    names=["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                start += int(bounds[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    encoded = ordered.mapInArrow(encode, f"doc_id {kind}, part int, part_start long, n_tokens long, ids array<int>")
    (
        encoded.write.option("compression", "snappy")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_mb << 20))
        .orc(folder)
    )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of token files: ``doc_id``, ``part``, ``part_start``, ``n_tokens``, ``ids``.

    Filters on ``doc_id`` reach the files' indexes and Bloom filters.
    """
    return spark.read.orc(folder)


def with_starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` of token ``files`` with ``start``, the ids of all documents before, instead of the part's."""
    # One row for each file's range, however many documents there are.
    sizes = files.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    keep = [c for c in rows.columns if c not in ("part", "part_start")]
    return rows.join(bases, "part").select(*keep, (F.col("base") + F.col("part_start")).alias("start"))


def checked_ids(tokens: DataFrame) -> DataFrame:
    """``tokens`` with ``ids`` replaced by ``ids_crc32``, over the ids as little-endian 32-bit numbers."""
    keep = [c for c in tokens.columns if c != "ids"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("ids")
            data = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), "<i4")
            bounds = column.offsets.to_numpy().tolist()
            crc = [zlib.crc32(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(crc, pa.int64())], names=[*keep, "ids_crc32"]
            )

    kinds = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in keep)
    return tokens.select(*keep, "ids").mapInArrow(sums, f"{kinds}, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read ``(doc_id, start, n_tokens, ids_crc32)`` back.

    Null and empty texts hold the end id alone; null ids come first; rows with equal ids are ordered
    by text and each keep a row; a text of any length is one row; an empty table gives an empty
    table. Other columns are not read.
    """
    folder = shared_folder(docs.sparkSession, "tokens")
    write_token_files(docs, folder, tokenizer_path, end_id, id_col, text_col)
    files = read_token_files(docs.sparkSession, folder)
    # The ids are summed up before the join, so they are never shuffled.
    found = with_starts(checked_ids(files), files)
    return found.select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32")
