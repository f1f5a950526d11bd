"""Tree models as tables, and passes of rows through blocks of their trees.

A model is a table with one row of node arrays for each tree. Rows meet a model block by block:
a block holds whole trees of ``BLOCK_NODES`` nodes at most (or one larger tree), so a task keeps a
bounded part of the model however many trees there are, and what the blocks give is added up by Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.models.grow import NODE_FIELDS
from wardlight.session import stage

#: Nodes of one block: some 60 bytes each.
BLOCK_NODES = 1_000_000


@dataclass(frozen=True)
class Tree:
    """Arrays of one tree, indexed by node; ``left < 0`` marks a leaf. Children come after their parents."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray  # probability of the positive class at the node
    cover: np.ndarray  # weighted training rows that reached the node
    impurity: np.ndarray
    rows: np.ndarray  # training rows that reached the node, unweighted

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf index of each row."""
        at = np.zeros(len(x), dtype=np.int64)
        open_rows = np.arange(len(x)) if self.left[0] >= 0 else np.zeros(0, np.int64)
        while len(open_rows):
            node = at[open_rows]
            goes_left = x[open_rows, self.feature[node]] <= self.threshold[node]
            node = np.where(goes_left, self.left[node], self.right[node])
            at[open_rows] = node
            open_rows = open_rows[self.left[node] >= 0]
        return at

    @cached_property
    def depth(self) -> np.ndarray:
        """Levels above each node."""
        out, nodes, level = np.zeros(len(self.left), np.int64), np.zeros(1, np.int64), 0
        while len(nodes):
            out[nodes] = level
            inner = nodes[self.left[nodes] >= 0]
            nodes, level = np.concatenate([self.left[inner], self.right[inner]]), level + 1
        return out

    @property
    def importance(self) -> dict[int, float]:
        """Share of each feature in the impurity that the splits take away."""
        inner = np.flatnonzero(self.left >= 0)
        risk = self.impurity * self.cover
        gain = risk[inner] - risk[self.left[inner]] - risk[self.right[inner]]
        sums = np.bincount(self.feature[inner], gain) if len(inner) else np.zeros(0)
        total = sums.sum()
        return {f: float(v / total) for f, v in enumerate(sums)} if total > 0 else {}


def tree_of(row: object) -> Tree:
    """A tree from its row of arrays."""
    kinds = {"double": float, "int": np.int64, "long": np.int64}
    return Tree(**{name: np.asarray(getattr(row, name), kinds[kind]) for name, kind in NODE_FIELDS.items()})


class TreeModel:
    """A fitted tree or forest: the mean of its trees' probabilities."""

    def __init__(self, table: DataFrame, n_features: int):
        self.table, self.n_features = table, n_features

    @cached_property
    def sizes(self) -> list[tuple[int, int]]:
        """``(tree, nodes)`` of all trees."""
        return [tuple(r) for r in self.table.select("tree", F.size("left")).orderBy("tree").collect()]

    def blocks(self) -> Iterator[list[tuple[int, Tree]]]:
        """``(tree, arrays)`` of each block, one block at a time."""
        held: list[int] = []
        sums = 0
        for tree, nodes in [*self.sizes, (None, BLOCK_NODES + 1)]:
            if held and sums + nodes > BLOCK_NODES:
                rows = self.table.filter(F.col("tree").between(held[0], held[-1])).toPandas().sort_values("tree")
                yield [(int(r.tree), tree_of(r)) for r in rows.itertuples()]
                held, sums = [], 0
            held.append(tree)
            sums += nodes

    @property
    def numNodes(self) -> int:  # noqa: N802  as pyspark.ml names it
        return sum(n for _, n in self.sizes)

    @cached_property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Mean of the trees' shares; trees without a split add nothing."""
        def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(f, v) for r in batch.itertuples() for f, v in tree_of(r).importance.items()]
                yield pd.DataFrame(found, columns=["feature", "share"])

        sums = self.table.mapInPandas(shares, "feature int, share double").groupBy("feature").agg(F.sum("share").alias("share")).collect()
        out = np.zeros(self.n_features)
        for r in sums:
            out[r["feature"]] = r["share"]
        return DenseVector(out / out.sum() if out.sum() else out)

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        """``df`` with ``probability`` (a vector of both classes) and ``prediction``."""
        n = len(self.sizes)
        blocks = self.blocks()
        first = next(blocks)
        x = vector_to_array(features)
        if len(first) == n:
            score = _value_sum(df, first)(x) / n
            out = df.withColumn("__score", score)
        else:  # each block is a pass of its own over the written rows
            rows = stage(df.withColumn("__row", F.monotonically_increasing_id()))
            passes = [rows.select("__row", _value_sum(df, b)(x).alias("part")) for b in (first, *blocks)]
            sums = reduce(DataFrame.unionByName, passes).groupBy("__row").agg((F.sum("part") / n).alias("__score"))
            out = rows.join(sums, "__row").drop("__row")
        both = array_to_vector(F.array(1 - F.col("__score"), F.col("__score")))
        return out.withColumns({"probability": both, "prediction": (F.col("__score") > 0.5).cast("double")}).drop("__score")


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def _value_sum(df: DataFrame, block: list[tuple[int, Tree]]) -> Callable:
    """Column function: sum of the block's trees' probabilities."""
    shared = df.sparkSession.sparkContext.broadcast([t for _, t in block])

    @F.pandas_udf("double")
    def total(x: pd.Series) -> pd.Series:
        cells = matrix(x)
        out = np.zeros(len(x))
        for t in shared.value:
            out += t.value[t.leaves_of(cells)]
        return pd.Series(out)

    return total


def through_blocks(rows: DataFrame, model: TreeModel, each: Callable[[pd.DataFrame, list[tuple[int, Tree]]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``each`` gives for every batch of rows and every block, as one frame."""
    passes = []
    for block in model.blocks():
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def one(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    yield from each(batch, shared.value)

        passes.append(rows.mapInPandas(lambda b, one=one: one(b), schema))
    return reduce(DataFrame.unionByName, passes)


# ---- forests of several sizes ----


def prefix_scores(rows: DataFrame, model: TreeModel, place: dict[int, tuple[int, int, int]], sizes: dict[int, Sequence[int]]) -> DataFrame:
    """``(candidate, size, fold, label, score)``: held-out rows scored by the first ``size`` trees of each candidate.

    ``place`` gives each tree's candidate, the fold it has not seen and its number in the
    forest. One pass adds up the trees in order and notes the sum at each of the candidate's sizes.
    """
    def each(batch: pd.DataFrame, block: list[tuple[int, Tree]]) -> Iterator[pd.DataFrame]:
        forests: dict[tuple[int, int], list[tuple[int, Tree]]] = {}
        for number, tree in block:
            candidate, fold, index = place[number]
            forests.setdefault((candidate, fold), []).append((index, tree))
        for fold, part in batch.groupby("fold"):
            x = matrix(part["x"])
            for (candidate, held), trees in forests.items():
                if held != fold:
                    continue
                trees.sort(key=lambda t: t[0])
                votes, done = np.zeros(len(part)), 0
                for size in sorted(sizes[candidate]):
                    while done < len(trees) and trees[done][0] < size:
                        votes = votes + trees[done][1].value[trees[done][1].leaves_of(x)]
                        done += 1
                    if done:
                        yield pd.DataFrame({"candidate": candidate, "size": size, "fold": fold, "row": part["row"], "label": part["label"], "votes": votes})

    found = through_blocks(rows, model, each, "candidate int, size int, fold int, row long, label int, votes double")
    sums = found.groupBy("candidate", "size", "fold", "row", "label").agg(F.sum("votes").alias("votes"))
    return sums.select("candidate", "size", "fold", "label", (F.col("votes") / F.col("size")).alias("score"))


# ---- trees cut at several levels ----


def leaf_counts(rows: DataFrame, model: TreeModel, fold_of: dict[int, int | None] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(tree, *by, leaf, pos, neg)``: rows dropped into the leaves of all trees, or of those that have not seen their fold."""
    by = list(by)

    def each(batch: pd.DataFrame, block: list[tuple[int, Tree]]) -> Iterator[pd.DataFrame]:
        for keys, part in batch.groupby([*(["fold"] if fold_of else []), *by] or np.zeros(len(batch)), dropna=False):
            x, label = matrix(part["x"]), part["label"].to_numpy() == 1
            keys = keys if isinstance(keys, tuple) else (keys,)
            for number, tree in block:
                if fold_of and fold_of[number] != keys[0]:
                    continue
                leaf = tree.leaves_of(x)
                both = np.bincount(leaf, minlength=len(tree.left))
                pos = np.bincount(leaf, label, len(tree.left)).astype(np.int64)
                at = np.flatnonzero(both)
                yield pd.DataFrame({"tree": number, **dict(zip(by, keys[1 if fold_of else 0 :])), "leaf": at, "pos": pos[at], "neg": both[at] - pos[at]})

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    found = through_blocks(rows, model, each, f"tree int, {kinds + ', ' if by else ''}leaf long, pos long, neg long")
    return found.groupBy("tree", *by, "leaf").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def cut_tree(tree: Tree, stop: np.ndarray) -> Tree:
    """The tree with leaves at the ``stop`` nodes; what lies below them stays in the arrays, unreached and unsplit."""
    left = np.where(stop, -1, tree.left)
    reached, nodes = np.zeros(len(left), bool), np.zeros(1, np.int64)
    while len(nodes):
        reached[nodes] = True
        inner = nodes[left[nodes] >= 0]
        nodes = np.concatenate([left[inner], tree.right[inner]])
    return Tree(**{**{f: getattr(tree, f) for f in NODE_FIELDS}, "left": np.where(reached, left, -1)})


def stands_for(tree: Tree, cut: Tree) -> np.ndarray:
    """For each leaf of ``tree``, the leaf of ``cut`` above it (or itself); -1 elsewhere."""
    owner, nodes = np.full(len(tree.left), -1), np.zeros(1, np.int64)
    while len(nodes):
        ends = cut.left[nodes] < 0
        owner[nodes] = np.where((owner[nodes] < 0) & ends, nodes, owner[nodes])
        inner = nodes[tree.left[nodes] >= 0]
        owner[tree.left[inner]] = owner[tree.right[inner]] = owner[inner]
        nodes = np.concatenate([tree.left[inner], tree.right[inner]])
    return np.where(tree.left < 0, owner, -1)
