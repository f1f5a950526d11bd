"""I-Match document fingerprints over randomised lexicon subsets, with DataFrame functions only.

1. Document frequencies of all words of all documents; the lexicon keeps words inside a band
   of inverse document frequency.
2. Randomised subsets: a word's hash puts it into one of many subsets. Large ones tell that
   documents are nearly equal, small ones that they share a part.
3. A document's distinct lexicon words are sorted and hashed for each subset. The
   fingerprint is the row of these hashes; two fingerprints are alike by the share of equal
   hashes among the subsets that hold a word of either document.

The lexicon goes to the tasks as one value, sized to hold all words of the band. The band bounds it: a word in a
share of at least ``s`` of the documents takes that share of the sum of document frequencies, so there are
at most ``mean distinct words of a document / s`` of them, however many documents there are.
"""

from __future__ import annotations

import random
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import written
from wardlight.operators.ordered import value_cuts, with_ranges

#: Inverse document frequencies ln(N / df) of the band: from 10 % down to 0.1 % of documents.
IDF_BAND = (2.3, 6.91)
#: Sizes of the subsets in 1024ths of the lexicon; together they cover it and do not overlap.
SUBSETS = (64,) * 2 + (16,) * 16 + (8,) * 32 + (4,) * 64 + (1,) * 128
HASH_RANGE = sum(SUBSETS)
DOCS_PER_RANGE = 1000
#: The lowest bits of a hash that name its cells in the lexicon's table, and the first subset's mark.
CELL_SHIFTS = (0, 21, 42)
FIRST_MARK = 0xE000
#: Bits of a subset's hash; the subset's number has the others.
HASH_BITS = 56


def distinct_words(text: Column) -> Column:
    """Distinct words of a text: letters and digits, lower case. Null has none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+")
    return F.array_remove(F.array_distinct(parts), "")


def subset_mark(word: Column) -> Column:
    """The subset that holds a word, as one character of the private use area, which no word contains."""
    marks = F.array(*[F.lit(chr(FIRST_MARK + n)) for n, size in enumerate(SUBSETS) for _ in range(size)])
    return F.element_at(marks, F.pmod(F.xxhash64(F.lit("lexicon subset"), word), F.lit(HASH_RANGE)).cast("int") + 1)


def lexicon(texts: DataFrame, text_col: str, band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """All words of the band that two documents hold (column ``word``). Frequencies cover all documents."""
    counts = texts.select(F.explode(distinct_words(F.col(text_col))).alias("word")).groupBy("word").count().filter("count > 1")
    counts = written(counts, "frequencies")
    documents = texts.count()
    idf = F.log(F.lit(float(max(documents, 1))) / F.col("count"))
    return counts.filter((idf >= band[0]) & (idf <= band[1])).select("word")


def cells_of(number: int, cells: int) -> list[int]:
    """The cells of a table in which a hash may stand."""
    return [(number >> shift) & (cells - 1) for shift in CELL_SHIFTS]


def lexicon_table(words: DataFrame) -> tuple[Column, int]:
    """The words' hashes as a constant array in which each stands in one of its three cells, and its size.

    All hashes come to the driver; at least half of the cells stay empty. A new hash pushes out whatever
    stands in its cell, which then moves on to another of its own cells.
    """
    hashes = [row.hash & (2**64 - 1) for row in words.select(F.xxhash64("word").alias("hash")).collect()]
    size = 1 << max(2 * len(hashes) - 1, 1023).bit_length()
    table, order = [0] * size, random.Random(0)
    for held in hashes:
        for _ in range(500):
            cells = cells_of(held, size)
            cell = next((c for c in cells if not table[c]), None)
            if cell is None:
                cell = order.choice(cells)
            held, table[cell] = table[cell], held
            if not held:
                break
        else:
            raise RuntimeError("the lexicon's table is too full")
    signed = ",".join(str(h - 2**64 if h >> 63 else h) for h in table)
    return F.split(F.lit(signed), ",").cast("array<long>"), size


def in_lexicon(table: tuple[Column, int], number: Column) -> Column:
    """Whether a word with this hash is in the lexicon."""
    held, size = table
    cells = [F.shiftrightunsigned(number, shift).bitwiseAND(size - 1).cast("int") + 1 for shift in CELL_SHIFTS]
    return F.exists(F.array(*cells), lambda cell: F.element_at(held, cell) == number)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(range, place, doc_id, text, next_text)`` in descending id order; after the last comes the first.

    Ids are cut into ranges; each range also gets the first document of the range after it as a
    guard row (``guard`` true), so no window crosses ranges. Equal ids are ordered by text,
    null ids come last.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cuts = value_cuts(base.select("doc_id"), ["doc_id"], DOCS_PER_RANGE)
    ranged = with_ranges(base, cuts).withColumn("range", F.coalesce(F.col("doc_id__range"), F.lit(-1.0)).cast("long"))
    # NaN or null ids get the lowest range: they come last.
    ranged = ranged.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("range"))).select("range", "doc_id", "text")
    tops = ranged.groupBy("range").agg(F.max("doc_id").alias("top"), F.lit(True).alias("any"))
    # One row for each range: the range that comes before it, which for the first is the last.
    line = W.orderBy(F.desc("range"))
    follows = tops.select("range", "top", F.lag("range").over(line).alias("earlier"), F.min("range").over(W.partitionBy()).alias("last"))
    follows = follows.select("range", "top", F.coalesce("earlier", "last").alias("guarded"))
    heads = ranged.join(F.broadcast(follows), "range").filter(F.col("doc_id").eqNullSafe(F.col("top")))
    guards = heads.groupBy("guarded", "doc_id").agg(F.max("text").alias("text")).select(
        F.col("guarded").alias("range"), "doc_id", "text", F.lit(True).alias("guard")
    )
    rows = ranged.withColumn("guard", F.lit(False)).unionByName(guards)
    order = W.partitionBy("range").orderBy("guard", F.desc_nulls_last("doc_id"), F.desc("text"))
    return rows.withColumns({"place": F.row_number().over(order), "next_text": F.lead("text").over(order)})


def half_replaced(text: Column, other: Column) -> Column:
    """``text`` whose last half is replaced by as many first characters (or all) of ``other``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(F.coalesce(other, F.lit("")), F.lit(1), half))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also inside lambdas, where Spark shares nothing."""
    return F.transform(F.array(value), body)[0]


def prints_of(text: Column, table: tuple[Column, int]) -> Column:
    """Subset number and hash of its sorted words, in one long for each subset with words, in order.

    The sorted lexicon words, each behind its subset's mark, are sorted again by mark and joined;
    a run of one mark is then a subset's sorted words, and is hashed. A text without lexicon words has
    the hash of all its words under a subset of its own.
    """
    low, high = chr(FIRST_MARK), chr(FIRST_MARK + len(SUBSETS))
    run = f"([{low}-{high}])[^{low}-{high}]++(?:\\1[^{low}-{high}]++)*+"

    def runs(words: Column) -> Column:
        hashed = F.transform(words, lambda w: F.struct(w.alias("word"), F.xxhash64(w).alias("hash")))
        known = F.filter(hashed, lambda w: in_lexicon(table, w["hash"]))
        marked = F.array_join(F.array_sort(F.transform(known, lambda w: F.concat(subset_mark(w["word"]), w["word"]))), "")
        whole = F.array(F.concat(F.lit(high), F.array_join(words, " ")))
        return let(marked, lambda m: F.when(F.length(m) > 0, F.regexp_extract_all(m, F.lit(run), 0)).otherwise(whole))

    number = lambda r: F.shiftleft((F.ascii(r) - FIRST_MARK).cast("long"), HASH_BITS).bitwiseOR(F.xxhash64(r).bitwiseAND((1 << HASH_BITS) - 1))
    return F.transform(let(F.array_sort(distinct_words(text)), runs), number)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that hold words of either text."""
    subsets = lambda x: F.transform(x, lambda h: F.shiftrightunsigned(h, HASH_BITS))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(subsets(a), subsets(b)))


def hex_print(hashes: Column) -> Column:
    """16 hex digits for each subset with words: its number in two, its hash in the others."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = IDF_BAND) -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half replaced by text of the next document in descending id
    order. Null texts are empty; a text without words has the fingerprint of no words. Repeated
    rows each keep a row; of equal ids the larger text comes first; null ids come last. One
    document alone follows itself. Other columns are not read. An empty table gives an empty table.
    """
    table = lexicon_table(lexicon(docs.select(text_col), text_col, band))
    rows = with_next(docs, id_col, text_col)
    edited = half_replaced(F.col("text"), F.col("next_text"))
    # One shuffle: the documents' ranges hold what each needs of the next.
    both = rows.withColumn("edited_text", edited)
    printed = both.select(
        "range", "place", "guard", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited_text", 256).alias("edited_sha256"),
        F.transform(F.array("text", "edited_text"), lambda t: prints_of(t, table)).alias("prints"),
    ).select("*", F.col("prints")[0].alias("own"), F.col("prints")[1].alias("edited"))
    following = printed.withColumn("next", F.lead("own").over(W.partitionBy("range").orderBy("place")))
    return following.filter(~F.col("guard")).select(
        F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", hex_print(F.col("own")).alias("fingerprint"),
        hex_print(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
