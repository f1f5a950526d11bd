"""Merkle manifest of a table by time-forward processing.

Rows are leaves, ordered by id within a group; every ``FAN`` consecutive nodes have one parent,
up to one node for each group (its subroot); the subroots, ordered by group, have the
root above them. Digests are SHA-256 in lowercase hex, of inputs joined as text.

The tree is worked through in the order of node labels. A label is the last leaf below a node
and then its level, so children come before their parent and a node is due as soon as its last
leaf has passed. A priority queue holds the messages in transit: a node's digest is sent to the
label of its parent, and the queue hands a node all that was sent to it when its turn comes.
The queue is external: one task sweeps over a block of ``FAN ** HEIGHT`` leaves, in which the heap
never holds more than ``FAN`` messages of each level; messages to nodes beyond the block are
rows of a table in the shared folder, sorted by receiver into the blocks of the next sweep.
The sweep back goes through the same labels in reverse: each node sends its children what it
has received from its parent behind the digests of their siblings, so a leaf receives its whole
proof. No task holds more than a block, however large the group.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.llm.common import written
from wardlight.operators.ordered import row_ordinals, text_ranges

FAN = 8
#: Levels that one task works through.
HEIGHT = 4
HEX = 64
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ---- sweeps over one block ----


class LabelQueue:
    """Messages to nodes, handed out by label; ``(last leaf, level, number)`` is a node's label."""

    def __init__(self, sign: int = 1):
        self.heap: list[tuple] = []
        self.sign = sign  # -1: the latest label first
        self.sent = 0

    def send(self, label: tuple[int, int, int], message: object) -> None:
        heapq.heappush(self.heap, (*(self.sign * part for part in label[:2]), label[2], self.sent, message))
        self.sent += 1  # messages to one node stay in the order sent

    def due(self, time: int | None = None) -> Iterator[tuple[tuple[int, int, int], list]]:
        """Nodes whose last leaf is ``time`` or earlier, each with its messages; without a time all nodes."""
        while self.heap and (time is None or self.heap[0][0] <= time):
            last, level, number = self.heap[0][:3]
            messages = []
            while self.heap and self.heap[0][:3] == (last, level, number):
                messages.append(heapq.heappop(self.heap)[-1])
            yield (self.sign * last, self.sign * level, number), messages


def height_of(total: int, most: int = HEIGHT) -> int:
    """Levels above ``total`` nodes until one is left, ``most`` at most."""
    levels = 0
    while total > 1 and levels < most:
        total, levels = -(-total // FAN), levels + 1
    return levels


def label_of(number: int, level: int, leaves: int) -> tuple[int, int, int]:
    return min((number + 1) * FAN**level, leaves) - 1, level, number


def sweep_up(leaves: Sequence[str], height: int) -> tuple[str, dict[tuple[int, int], list[str]]]:
    """Digest of the block's top, and for each inner node ``(level, number)`` the digests of its children."""
    received: dict[tuple[int, int], list[str]] = {}
    if not height:
        return leaves[0], received
    queue, top = LabelQueue(), ""
    for time, leaf in enumerate(leaves):
        queue.send(label_of(time // FAN, 1, len(leaves)), leaf)
        for (_, level, number), children in queue.due(time):
            received[level, number] = children
            top = digest("".join(children))
            if level < height:
                queue.send(label_of(number // FAN, level + 1, len(leaves)), top)
    return top, received


Proof = tuple[list[int], list[str]]


def sweep_down(leaves: Sequence[str], height: int, above: Proof) -> Iterator[tuple[int, Proof]]:
    """``(leaf, proof)`` of all leaves, the last one first.

    A proof is, for each level from the leaf up, the place among the siblings and their joined
    digests; ``above`` is that of the block's top.
    """
    received = sweep_up(leaves, height)[1]
    queue = LabelQueue(-1)
    queue.send(label_of(0, height, len(leaves)), above)
    for (_, level, number), (proof,) in queue.due():
        if not level:
            yield number, proof
            continue
        children = received[level, number]
        for place in range(len(children)):
            beside = "".join(children[:place] + children[place + 1 :])
            queue.send(label_of(number * FAN + place, level - 1, len(leaves)), ([place, *proof[0]], [beside, *proof[1]]))


def fold(start: str, proof: Proof) -> str:
    """Digest at the top when ``start`` stands at the leaf."""
    for place, beside in zip(*proof):
        start = digest(beside[: place * HEX] + start + beside[place * HEX :])
    return start


# ---- leaves ----


def field(column: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in fields]), 256)


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered_leaves(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows with ``position`` from 0 and ``total`` within their ``tree``, in the order of the columns."""
    ranged = text_ranges(rows, ["tree", *order])
    placed = row_ordinals(ranged, ["tree"], [F.col(c).asc_nulls_last() for c in order], "range", "position", "total")
    return placed.withColumn("position", F.col("position") - 1).drop("range")


# ---- sweeps over a forest ----


@dataclass(frozen=True)
class Forest:
    """Trees worked through: the rows of each sweep, and the top of each tree."""

    rounds: list[DataFrame]  # tree, position, total, digest; the leaves first, with their other columns
    tops: DataFrame  # tree, digest
    height: int  # levels of one sweep


def in_blocks(rows: DataFrame, height: int) -> DataFrame:
    return rows.withColumn("block", F.floor(F.col("position") / FAN**height).cast("long"))


def climbed(leaves: DataFrame, height: int = HEIGHT) -> Forest:
    """Sweep up from written ``leaves`` until each tree has one node."""
    width = FAN**height

    def top(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        total = int(group["total"].iloc[0])
        value, _ = sweep_up(group["digest"].tolist(), height_of(total, height))
        return pd.DataFrame({"tree": group["tree"].iloc[:1].tolist(), "position": group["block"].iloc[:1].tolist(), "total": [-(-total // width)], "digest": [value]})

    rounds, size = [leaves], leaves.agg(F.max("total")).first()[0] or 0
    while True:
        blocks = in_blocks(rounds[-1].select("tree", "position", "total", "digest"), height)
        tops = written(blocks.groupBy("tree", "block").applyInPandas(top, "tree string, position long, total long, digest string"), "merkle-sweep")
        size = -(-size // width)
        if size <= 1:
            return Forest(rounds, tops.select("tree", "digest"), height)
        rounds.append(tops)


AtLeaves = Callable[[pd.DataFrame, list[Proof]], pd.DataFrame]


def descended(forest: Forest, above: DataFrame, at_leaves: AtLeaves, schema: T.StructType | str) -> DataFrame:
    """Sweep back: ``at_leaves`` gets a block of leaves, with the columns of ``above`` beside them, and their proofs.

    ``above`` has one row for each tree: ``tree``, ``places`` and ``beside`` (the proof of its
    top), and any other columns.
    """
    height = forest.height
    extra = [c for c in above.columns if c not in ("tree", "places", "beside")]
    inner = T.StructType([*above.select("tree").schema, T.StructField("block", T.LongType()), *above.drop("tree").schema])

    def proofs_of(group: pd.DataFrame, message: pd.DataFrame) -> tuple[pd.DataFrame, list[Proof], dict]:
        group = group.sort_values("position")
        proof = (list(message["places"].iloc[0]), list(message["beside"].iloc[0]))
        found = sorted(sweep_down(group["digest"].tolist(), height_of(int(group["total"].iloc[0]), height), proof), key=lambda f: f[0])
        return group, [p for _, p in found], {c: message[c].iloc[0] for c in extra}

    def down(group: pd.DataFrame, message: pd.DataFrame) -> pd.DataFrame:
        group, proofs, known = proofs_of(group, message)
        sent = {"tree": group["tree"], "block": group["position"], "places": [p[0] for p in proofs], "beside": [p[1] for p in proofs], **known}
        return pd.DataFrame(sent)[inner.names]

    def last(group: pd.DataFrame, message: pd.DataFrame) -> pd.DataFrame:
        group, proofs, known = proofs_of(group, message)
        return at_leaves(group.assign(**known), proofs)

    sent = above.withColumn("block", F.lit(0).cast("long"))
    pairs = lambda rows: in_blocks(rows, height).groupBy("tree", "block").cogroup(sent.groupBy("tree", "block"))
    for rows in reversed(forest.rounds[1:]):
        sent = written(pairs(rows).applyInPandas(down, inner), "merkle-proofs")
    return pairs(forest.rounds[0]).applyInPandas(last, schema)


# ---- the manifest ----


@dataclass(frozen=True)
class Manifest:
    """Leaves below subroots below the root."""

    groups: Forest  # one tree for each group
    whole: Forest  # the tree over the subroots; its leaves carry the name of their group

    @property
    def root(self) -> DataFrame:
        """``(root)``, without a row for an empty table."""
        return self.whole.tops.select(F.col("digest").alias("root"))


PROOF = "places array<int>, beside array<string>"


def manifest(
    docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", changed: dict[str, Column] | None = None,
    where: Column | None = None, height: int = HEIGHT,
) -> Manifest:
    """Manifest of ``docs``; leaves have ``id`` (as text), ``digest`` and ``other``, the digest of the
    row with the ``changed`` columns ``where`` that holds, else null.

    Null ids come last in their group, rows with equal ids are ordered by their digests and each
    is a leaf, equal rows may stand for each other; null groups are one group, the first. Null
    values, empty and long texts are digested as they are, each row for itself. Columns not
    named are not read. An empty table has no leaf and no root.
    """
    changed = changed or {}
    leaf = row_digest([F.col(c) for c in columns])
    other = row_digest([changed.get(c, F.col(c)) for c in columns])
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = docs.select(
        tree.alias("tree"), F.col(id_col).alias("id"), leaf.alias("digest"),
        F.when(where if where is not None else F.lit(False), other).alias("other"),
    )
    # the texts are read once; from here on a leaf is its digests
    placed = ordered_leaves(written(rows, "merkle-rows"), ["id", "digest"]).withColumn("id", F.col("id").cast("string"))
    groups = climbed(written(placed, "merkle-leaves"), height)
    subroots = groups.tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest")
    return Manifest(groups, climbed(written(ordered_leaves(subroots, ["group"]), "merkle-subroots"), height))


def _at_leaves(made: Manifest, at_leaves: AtLeaves, schema: str) -> DataFrame:
    """``at_leaves`` over all leaves; the blocks have ``subroot`` and ``root`` beside their columns."""
    root = made.whole.tops.select("tree", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("beside"), F.col("digest").alias("root"))

    def at_subroots(group: pd.DataFrame, proofs: list[Proof]) -> pd.DataFrame:
        return pd.DataFrame(
            {"tree": group["group"], "places": [p[0] for p in proofs], "beside": [p[1] for p in proofs], "subroot": group["digest"], "root": group["root"]}
        )

    above = descended(made.whole, root, at_subroots, f"tree string, {PROOF}, subroot string, root string")
    return descended(made.groups, written(above, "merkle-groups"), at_leaves, schema)


def proofs(made: Manifest) -> DataFrame:
    """``(tree, id, leaf, subroot, root, places, beside)``: the proof of every leaf, level by level from the leaf to the root.

    ``tree`` is the empty text for the null group, else ``=`` and its name.
    """
    def at_leaves(group: pd.DataFrame, found: list[Proof]) -> pd.DataFrame:
        rows = group[["tree", "id", "digest", "subroot", "root"]].rename(columns={"digest": "leaf"})
        return rows.assign(places=[p[0] for p in found], beside=[p[1] for p in found])

    return _at_leaves(made, at_leaves, f"tree string, id string, leaf string, subroot string, root string, {PROOF}")


def checked(made: Manifest) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)``: each leaf's proof tried on its ``other`` digest, else its own.

    The proofs are used where they arrive, so only their digests leave the task.
    """
    def at_leaves(group: pd.DataFrame, found: list[Proof]) -> pd.DataFrame:
        tried = group["other"].where(group["other"].notna(), group["digest"])
        folded = [fold(start, proof) for start, proof in zip(tried, found)]
        rows = group[["id", "digest", "subroot", "root"]].rename(columns={"digest": "leaf"})
        rows = rows.assign(proof_sha256=[digest("".join(p[1])) for p in found], folded_root=folded)
        return rows.assign(verified=rows["folded_root"] == rows["root"])

    return _at_leaves(made, at_leaves, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tampering(docs: DataFrame, columns: Sequence[str] = COLUMNS, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", height: int = HEIGHT) -> DataFrame:
    """The manifest of ``docs`` and what tampering does to it: the columns of :func:`checked`, with the id in its own type.

    Rows whose id has an unsigned CRC-32 that 3 divides are tried with A-Z of the text in lower
    case; null ids and null texts stay. Edge cases as in :func:`manifest`.
    """
    where = F.crc32(F.col(id_col).cast("string")) % 3 == 0
    made = manifest(docs, columns, id_col, group_col, {text_col: lower_ascii(F.col(text_col))}, where, height)
    return checked(made).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType)).withColumnRenamed("id", id_col)
