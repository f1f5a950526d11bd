"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source's documents stand in a seeded order and form a stream of words that repeats up to
``max_passes`` times. The source's quota, its target rounded to a whole word, is the head of
that stream, counted in blocks of ``block_words`` words (the last one shorter). A binary tree
over the output shards then deals the blocks out: at each node the quotas of all sources are
split exactly between the two halves by one multivariate-hypergeometric draw, so a leaf holds
the number of blocks of each source in its shard, as if all blocks had been shuffled and dealt.
Each shard takes its number of blocks from the sources' streams, no block twice, and is
shuffled for itself.

All of it is DataFrame functions: a hypergeometric number is drawn by the ratio of uniforms from
hashed uniforms, so a draw costs the same for ten blocks and for ten billion. Sources are
drawn in rows of ``FAN`` that share a parent, itself drawn first; no row holds all sources.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.llm.common import fresh, written
from wardlight.operators.ordered import null_safe_join, range_offsets, row_ordinals, running_totals, text_ranges

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
MAX_PASSES = 3
BLOCK_WORDS = 256
#: Words that a shard holds about.
SHARD_WORDS = 4_000_000
#: Sources, or groups of sources, in one multivariate draw.
FAN = 256
#: Candidates of one draw; each is taken with more than even chance.
ATTEMPTS = 120
#: Tree levels after which the nodes are dealt out to more tasks.
SPREAD_LEVELS = 6
HASH_DIGITS = 4
# Constants of the ratio-of-uniforms box for hypergeometric numbers (Stadlober 1989).
BOX_SLOPE, BOX_SHIFT = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)


# ---- sizes, sources and targets ----


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``(doc_id, source, size)``: words of each text, null texts none."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)).cast("long"), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))


def source_targets(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """``(source, number, source_size, weight, target)`` from ``(source, size)`` rows.

    ``number`` counts the sources in code point order from 0, null last. Targets share the sum of
    all sizes by weight and stop at ``max_passes`` sizes; what is above goes to the others by
    weight. In the order of size / weight the stopped sources come first, so one running total
    of sizes and weights shows where stopping ends and what a unit of weight gets beyond.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = text_ranges(sums.withColumn("all", F.lit(0)), ["source"])
    numbered = row_ordinals(ranged, ["all"], [F.col("source").asc_nulls_last()], "range", "number").drop("range")
    cycle = F.array(*[F.lit(w) for w in weights])
    weighed = numbered.withColumn("number", F.col("number") - 1).withColumn("weight", F.get(cycle, F.pmod("number", F.lit(len(weights))).cast("int")).cast("long"))
    # Sources of one ratio stop together: they are one row of the running total.
    ratio = F.col("source_size") * F.lit(float(max_passes)) / F.col("weight")
    weighed = written(weighed.withColumn("ratio", ratio), "mix-sources")
    steps = weighed.groupBy("all", "ratio").agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight"))
    steps = text_ranges(steps, ["ratio"])
    placed = running_totals(steps, ["all"], ["size", "weight"], value="ratio")
    unit = (F.col("total_size") - F.lit(max_passes) * F.col("before_size")) / (F.col("total_weight") - F.col("before_weight"))
    # the first ratio that the unit of its rest does not reach ends the stopped sources
    free = placed.withColumn("unit", unit).filter(F.col("ratio") >= F.col("unit"))
    level = free.groupBy("all").agg(F.min_by("unit", "ratio").alias("unit"))
    target = F.least(F.col("unit") * F.col("weight"), F.col("source_size") * F.lit(float(max_passes)))
    return weighed.join(level, "all", "left").select("source", "number", "source_size", "weight", F.coalesce(target, F.lit(0.0)).alias("target"))


# ---- hypergeometric numbers ----


def log_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series at n + 8, whose error is far below a double's digits there."""
    z = n + F.lit(9.0)
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    rising = (n + 1.0) * (n + 2.0) * (n + 3.0) * (n + 4.0) * (n + 5.0) * (n + 6.0) * (n + 7.0) * (n + 8.0)
    return series - F.log(rising)


def uniform(*parts: Column) -> Column:
    """A number inside (0, 1) that the parts fix."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(marked: Column, others: Column, drawn: Column, *seed: Column) -> Column:
    """How many of ``marked`` are among ``drawn`` taken at random from ``marked + others``.

    Ratio of uniforms: a candidate is accepted with the probability that makes the result follow
    the hypergeometric law; the uniforms are hashes of ``seed`` and the attempt, so reruns agree.
    Mirrored cases are drawn by their smaller side, as the box of candidates asks for.
    """
    good, bad, taken = (c.cast("double") for c in (marked, others, drawn))
    asked = F.struct(good.alias("good"), bad.alias("bad"), taken.alias("taken"), F.xxhash64(*seed).alias("seed"))

    def sides(c: Column) -> Column:
        return F.struct(
            F.least(c["good"], c["bad"]).alias("few"), F.greatest(c["good"], c["bad"]).alias("many"),
            F.least(c["taken"], c["good"] + c["bad"] - c["taken"]).alias("n"), c.alias("asked"),
        )

    def weight(s: Column, k: Column) -> Column:
        return -(log_factorial(k) + log_factorial(s["few"] - k) + log_factorial(s["n"] - k) + log_factorial(s["many"] - s["n"] + k))

    def box(s: Column) -> Column:
        total = s["few"] + s["many"]
        share = s["few"] / total
        spread = F.sqrt((total - s["n"]) * s["n"] * share * (1 - share) / F.greatest(total - 1, F.lit(1.0)) + 0.5)
        mode = F.floor((s["n"] + 1) * (s["few"] + 1) / (total + 2)).cast("double")
        return F.struct(
            (s["n"] * share + 0.5).alias("centre"), (BOX_SLOPE * spread + BOX_SHIFT).alias("width"), F.least(s["n"], s["few"]).alias("top"),
            mode.alias("mode"), weight(s, mode).alias("peak"), s.alias("sides"),
        )

    def attempt(b: Column, i: Column) -> Column:
        """The candidate of attempt ``i``, or null."""
        seeded = b["sides"]["asked"]["seed"]
        pair = F.struct(uniform(seeded, i, F.lit("u")).alias("u"), uniform(seeded, i, F.lit("v")).alias("v"))
        guess = lambda p: F.struct(F.floor(b["centre"] + b["width"] * (p["v"] - 0.5) / p["u"]).cast("double").alias("k"), (2 * F.log(p["u"])).alias("bar"))
        taken = lambda g: F.when((g["k"] >= 0) & (g["k"] <= b["top"]), F.when(g["bar"] <= weight(b["sides"], g["k"]) - b["peak"], g["k"]))
        return named(named(pair, guess), taken)

    def found(b: Column) -> Column:
        k = F.aggregate(F.sequence(F.lit(1), F.lit(ATTEMPTS)), F.lit(None).cast("double"), lambda done, i: F.coalesce(done, attempt(b, i)))
        return F.struct(F.coalesce(k, b["mode"]).alias("k"), b["sides"]["n"].alias("n"), b["sides"]["asked"].alias("asked"))

    def mirrored(r: Column) -> Column:
        c = r["asked"]
        k = F.when(c["good"] <= c["bad"], r["k"]).otherwise(r["n"] - r["k"])
        return F.when(c["taken"] <= c["good"] + c["bad"] - c["taken"], k).otherwise(c["good"] - k).cast("long")

    draw = named(named(named(named(asked, sides), box), found), mirrored)
    certain = F.when((drawn <= 0) | (marked <= 0), F.lit(0).cast("long")).when(others <= 0, F.least(drawn, marked).cast("long"))
    return F.coalesce(certain.when(drawn >= marked + others, marked.cast("long")), draw)


def multivariate(quotas: Column, drawn: Column, *seed: Column) -> Column:
    """How many of each quota are among ``drawn`` taken at random from all of them, as an array of the same length."""
    start = F.struct(
        F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q).alias("left"), drawn.cast("long").alias("drawn"),
        F.array().cast("array<bigint>").alias("taken"),
    )

    def step(state: Column, quota: Column) -> Column:
        taken = hypergeometric(quota, state["left"] - quota, state["drawn"], *seed, F.size(state["taken"]))
        return named(taken, lambda k: F.struct(
            (state["left"] - quota).alias("left"), (state["drawn"] - k).alias("drawn"), F.concat(state["taken"], F.array(k)).alias("taken")
        ))

    return F.aggregate(quotas, start, step)["taken"]


# ---- the splitting tree ----


def split_quotas(quotas: DataFrame, shards: int, fan: int = FAN, seed: int = 42) -> DataFrame:
    """``(number, shard, first_block, n_blocks)``: blocks of each source in each shard, empty ones left out.

    ``quotas`` holds ``(number, blocks)``, numbers from 0 without gaps. Sources are grouped by
    ``fan``, groups again, until one row is left: the tree of groups is drawn from the top, each
    group's number of blocks in a shard first and that of its members from it, which is the
    same law as one draw over all sources.
    """
    layers = [quotas.select(F.col("number").alias("node"), F.col("blocks").cast("long").alias("blocks"))]
    last, total = quotas.agg(F.max("number"), F.sum("blocks")).first()
    size = 0 if last is None else int(last) + 1
    while size > 1:
        parent = layers[-1].groupBy(F.floor(F.col("node") / fan).cast("long").alias("node")).agg(F.sum("blocks").alias("blocks"))
        layers.append(parent)
        size = math.ceil(size / fan)
    # Shares of the shards in all blocks: as even as whole blocks can be.
    each, extra = divmod(int(total or 0), shards)
    per = F.lit(each) + (F.col("id") < extra).cast("long")
    held = quotas.sparkSession.range(shards if size else 0).select(F.lit(0).cast("long").alias("node"), F.col("id").alias("shard"), per.alias("n_blocks"))
    for layer in reversed(layers[:-1]):
        held = _split_layer(layer, held, shards, fan, seed)
    order = W.partitionBy("node").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = held.withColumn("first_block", F.coalesce(F.sum("n_blocks").over(order), F.lit(0)))
    return placed.filter("n_blocks > 0").select(F.col("node").alias("number"), "shard", "first_block", "n_blocks")


def _split_layer(layer: DataFrame, held: DataFrame, shards: int, fan: int, seed: int) -> DataFrame:
    """Blocks of the members of each group in each shard, ``held`` being those of the groups.

    One row for each group goes down the binary tree over the shards: at each level its members'
    quotas are split between the halves by a multivariate draw of as many blocks as ``held``
    gives the group in the left half.
    """
    sums = W.partitionBy("node").orderBy("shard").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = held.select("node", F.col("shard").alias("mid_shard"), F.sum("n_blocks").over(sums).alias("upto"))
    upto = written(upto, "mix-upto")
    group = F.floor(F.col("node") / fan).cast("long")
    rows = layer.groupBy(group.alias("group")).agg(F.sort_array(F.collect_list(F.struct("node", "blocks"))).alias("members"))
    rows = rows.select(
        "group", F.transform("members", lambda m: m["node"]).alias("names"), F.transform("members", lambda m: m["blocks"]).alias("quotas"),
        F.lit(0).cast("long").alias("low"), F.lit(shards).cast("long").alias("high"), F.lit(0).cast("long").alias("before"),
    )
    for level in range(max(1, math.ceil(math.log2(shards))) if shards > 1 else 0):
        mid = F.floor((F.col("low") + F.col("high")) / 2).cast("long")
        # both halves of a node of one shard: only the left one is kept
        known = rows.withColumn("mid", F.when(F.col("high") - F.col("low") > 1, mid).otherwise(F.col("high")))
        known = known.join(
            upto.select(F.col("node").alias("group"), (F.col("mid_shard") + 1).alias("mid"), "upto"), ["group", "mid"]
        )
        left = multivariate(F.col("quotas"), F.col("upto") - F.col("before"), F.lit(seed), F.col("group"), F.col("low"), F.col("high"))
        known = known.withColumn("left", left)
        rest = F.zip_with("quotas", "left", lambda q, k: q - k)
        halves = F.array(
            F.struct(F.col("low").alias("low"), F.col("mid").alias("high"), F.col("before").alias("before"), F.col("left").alias("quotas")),
            F.struct(F.col("mid").alias("low"), F.col("high").alias("high"), F.col("upto").alias("before"), rest.alias("quotas")),
        )
        rows = known.select("group", "names", F.inline(halves)).filter("low < high")
        # each level is written: a plan of all of them would grow with the number of shards
        rows = written(rows.repartition("group", "low") if level == SPREAD_LEVELS else rows, "mix-level")
    cells = F.arrays_zip(F.col("names").alias("node"), F.col("quotas").alias("n_blocks"))
    return rows.select(F.col("low").alias("shard"), F.inline(cells)).select("node", "shard", "n_blocks")


# ---- drawing blocks ----


def in_stream(rows: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """Rows with ``number``, ``source_size``, ``target``, and ``start``: the words of the source before them.

    The order within a source is that of a seeded digest of the id; its leading digits cut a
    source of any size into slots that are summed on their own, and the slots' sums are added up in
    two digits, 4,096 in a window. Rows of equal ids are ordered by size.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    known = null_safe_join(rows, targets.drop("weight"), ["source"]).withColumn("digest", digest)
    slotted = known.withColumn("slot", F.conv(F.substring("digest", 1, HASH_DIGITS), 16, 10).cast("int"))
    slotted = written(slotted, "mix-slots")
    offsets = range_offsets(slotted, ["number"], ["size"], "slot", depth=2).select("number", "slot", "offset_size")
    inside = W.partitionBy("number", "slot").orderBy("digest", "size").rowsBetween(W.unboundedPreceding, -1)
    ordinal = F.row_number().over(W.partitionBy("number", "slot").orderBy("digest", "size"))
    placed = slotted.join(offsets, ["number", "slot"]).withColumns(
        {"start": F.col("offset_size") + F.coalesce(F.sum("size").over(inside), F.lit(0)), "ordinal": ordinal.cast("long")}
    )
    return written(placed.drop("offset_size", "digest"), "mix-stream")


def drawn_parts(stream: DataFrame, split: DataFrame, quotas: DataFrame, shards: int, block_words: int, max_passes: int) -> DataFrame:
    """``(number, slot, ordinal, pass, shard, first_word, n_words)``: the words of each document in each shard.

    A source's stream is cut into cells of as many blocks as a shard holds of it on average. A
    stretch of blocks of one shard lies in a few cells and so does a document, so they meet
    by equality of the cell; a source with a third of all words is spread over as many cells
    as there are shards.
    """
    cell_words = (F.greatest(F.floor(F.col("blocks") / shards), F.lit(1)) * block_words).cast("long")
    sizes = quotas.select("number", "quota", cell_words.alias("cell_words"))
    last_word = F.least((F.col("first_block") + F.col("n_blocks")) * block_words, F.col("quota"))
    stretches = split.join(sizes, "number").select(
        "number", "shard", "cell_words", (F.col("first_block") * block_words).alias("from_word"), last_word.alias("to_word")
    )
    cells = F.sequence(F.floor(F.col("from_word") / F.col("cell_words")), F.floor((F.col("to_word") - 1) / F.col("cell_words")))
    stretches = stretches.select("number", "shard", "from_word", "to_word", F.explode(cells).alias("cell"))
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1))).alias("pass")
    rows = stream.filter("size > 0").select("number", "slot", "ordinal", "size", "start", "source_size", passes).join(sizes, "number")
    begin = F.col("pass") * F.col("source_size") + F.col("start")
    rows = rows.withColumn("begin", begin).withColumn("end", F.least(begin + F.col("size"), F.col("quota"))).filter("begin < end")
    cells = F.sequence(F.floor(F.col("begin") / F.col("cell_words")), F.floor((F.col("end") - 1) / F.col("cell_words")))
    rows = rows.withColumn("cell", F.explode(cells))
    low = F.greatest("begin", "from_word", F.col("cell") * F.col("cell_words"))
    high = F.least("end", "to_word", (F.col("cell") + 1) * F.col("cell_words"))
    met = rows.join(stretches, ["number", "cell"]).withColumns({"low": low, "high": high}).filter("low < high")
    return met.select(
        "number", "slot", "ordinal", "pass", "shard", (F.col("low") - F.col("begin")).alias("first_word"), (F.col("high") - F.col("low")).alias("n_words")
    )


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_passes: int = MAX_PASSES, block_words: int = BLOCK_WORDS,
    shards: int | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The mix as ``(stream, parts)``, both written to the shared folder.

    ``stream`` has one row for each row of ``docs``: ``number`` of its source, ``slot`` and
    ``ordinal`` that tell it from the source's other rows, ``doc_id``, ``source``, ``size``,
    ``source_size``, ``target`` and ``start``. ``parts`` has one row for each stretch of words in
    a shard: the three keys, ``pass``, ``shard``, ``first_word``, ``n_words``, in files of one
    shard each or several, shuffled within it. Without ``shards`` their number follows the sum of sizes.

    Null texts have no words and are in no shard; null sources are one source, the last; null and
    repeated ids are rows like others; a text longer than a block is cut between blocks; equal
    rows may stand for each other. Other columns are not read. An empty table gives two empty frames.
    """
    rows = written(sized(docs, id_col, text_col, source_col), "mix-sizes")
    targets = written(source_targets(rows, weights, max_passes), "mix-targets")
    quota = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_passes).cast("long")
    quotas = targets.select("number", quota.alias("quota")).withColumn("blocks", F.ceil(F.col("quota") / block_words).cast("long"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    shards = shards or max(1, math.ceil(total / SHARD_WORDS))
    split = written(split_quotas(quotas, shards, seed=seed), "mix-split")
    stream = in_stream(rows, targets, seed)
    parts = drawn_parts(stream, split, quotas, shards, block_words, max_passes)
    place = F.xxhash64(F.lit(seed), "number", "slot", "ordinal", "pass", "first_word")
    shuffled = parts.withColumn("place", place).repartition("shard").sortWithinPartitions("shard", "place", "number", "slot", "ordinal", "pass", "first_word")
    return stream, written(shuffled.drop("place"), "mix-parts")


def mixed_shards(docs: DataFrame, stream: DataFrame, parts: DataFrame) -> DataFrame:
    """``parts`` with ``doc_id`` and ``source``: what a loader reads shard by shard."""
    keys = ["number", "slot", "ordinal"]
    return parts.join(stream.select(*keys, "doc_id", "source"), keys)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: one row for each row of ``docs``, ``taken`` summed over all shards.

    Rows that the mix leaves out have 0. Edge cases as in :func:`mix`.
    """
    id_col = options.get("id_col", "doc_id")
    stream, parts = mix(docs, **options)
    keys = ["number", "slot", "ordinal"]
    sums = parts.groupBy(*keys).agg(F.sum("n_words").alias("taken"))
    found = stream.join(sums, keys, "left")
    return found.select(F.col("doc_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
