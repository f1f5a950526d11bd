"""Growing exact classification trees, one or thousands at a time.

A split may stand between any two neighbouring values of a feature in its node, at their
midpoint; there are no bins and no limit of depth. Nodes that hold more than ``NODE_CELLS`` values
are split by Spark, all of a level and of all trees at once, without moving a row: counts by
range bound what each range can give, and only the ranges that can hold the best cut are
counted value by value. Smaller nodes get their rows packed, and are finished one in each call by
numpy, level by level over all their nodes (the subtree of such a node is bounded by its rows). A
table that is small as a whole, which is checked, goes to the tasks once, and the tasks share
the trees among themselves.

Both ways take the same splits: counts are whole numbers, costs come from them by the same
formula, ties go to the first feature and the smallest value, and the draws (of rows for a
sampled tree, of features for a node) are hashes of the row, the tree's seed and the path
to the node. Since a node's draw depends on nothing but its path, a tree cut at a depth or at a
minimum node size is the tree grown with that limit, and the first k trees of a forest are
the forest of k trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.operators.ordered import value_cuts
from wardlight.session import stage

#: Values (rows times features) of a node that one task finishes: some 10 bytes each while it does.
NODE_CELLS = 36_000_000
#: Ranges of a feature in the search for a cut, and how many of them, as a power of two, are first taken as one.
FINE, FINE_BITS = 4096, 4
#: Rows in ranges that may hold a cut, below which they are looked at value by value at once.
EXACT_ROWS = 5_000_000
#: Rows that a pass over the table holds at a time.
CHUNK_ROWS = 500_000
#: Rows that travel together to a task that holds a copy of the table.
COPY_ROWS = 250_000
#: Rows of small nodes that are looked at together, few enough for a core's own memory.
SLICE_ROWS = 1 << 18
#: Tasks that finish small nodes.
MAX_TASKS = 4096
#: Parts of a staged model that was grown by few tasks.
MODEL_PARTS = 200
#: Bytes of a whole table that may go to every task.
TABLE_BYTES = 64 << 20
NO_LIMIT = 1 << 30

# Poisson counts with mean 1: a row's number of draws in a sample with replacement of many rows.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(19)])
#: Draws that are told by comparing; more are rare.
FEW_DRAWS = 4


@dataclass(frozen=True)
class TreeSpec:
    """How one tree is grown. ``tries`` features are drawn for a node (None: all); rows of ``without`` fold stay out."""

    tree: int
    criterion: str = "gini"
    max_depth: int | None = None
    min_leaf: int = 1
    min_split: int = 2
    tries: int | None = None
    weights: tuple[float, float] = (1.0, 1.0)
    sampled: bool = False
    without: int | None = None
    seed: int = 42


# ---- draws ----


def stirred(x: np.ndarray) -> np.ndarray:
    """All bits of a number spread over 64 bits (the finaliser of splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def root_key(seed: int) -> np.ndarray:
    return stirred(np.array([seed], np.int64).view(np.uint64))


def child_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the left and the right children: a node's key depends on its path only."""
    return stirred(keys ^ np.uint64(1)), stirred(keys ^ np.uint64(2))


def draws(rows: np.ndarray, spec: TreeSpec) -> np.ndarray:
    """How often each row is in the tree's sample."""
    if not spec.sampled:
        return np.ones(len(rows), np.int64)
    mixed = stirred(rows.astype(np.int64).view(np.uint64) ^ stirred(root_key(spec.seed))[0])
    share = (mixed >> np.uint64(11)).astype(float) / (1 << 53)
    count = np.zeros(len(rows), np.uint8)
    for below in POISSON[:FEW_DRAWS]:
        count += share >= below
    many = np.flatnonzero(count == FEW_DRAWS)
    count[many] = np.searchsorted(POISSON, share[many], "right")
    return count.astype(np.int64)


def draws_of(rows: np.ndarray, fold: np.ndarray, spec: TreeSpec) -> np.ndarray:
    """:func:`draws` of rows, none for those of the fold left out."""
    count = np.empty(len(rows), np.uint8)  # at most 19
    for i in range(0, len(rows), SLICE_ROWS):
        count[i : i + SLICE_ROWS] = draws(rows[i : i + SLICE_ROWS], spec)
    if spec.without is not None:
        count[fold == spec.without] = 0
    return count


def drawn_features(keys: np.ndarray, varied: np.ndarray, tries: int | None) -> np.ndarray:
    """``(node, feature)`` marks: the first ``tries`` features that vary in the node, in the node's own order."""
    if tries is None or tries >= varied.shape[1]:
        return varied
    order = np.argsort(stirred(keys[:, None] ^ stirred(np.arange(varied.shape[1]))[None, :]), axis=1)
    usable = np.take_along_axis(varied, order, axis=1)
    chosen = usable & (np.cumsum(usable, axis=1) <= tries)
    out = np.zeros_like(varied)
    np.put_along_axis(out, order, chosen, axis=1)
    return out


# ---- one node and all below it ----


def side_cost(criterion: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Impurity of a side times its weight, from the weights of its two classes."""
    total = a + b
    if criterion == "gini":
        return 2 * a * b / total
    with np.errstate(divide="ignore", invalid="ignore"):
        return -(np.where(a > 0, a * np.log(a / total), 0.0) + np.where(b > 0, b * np.log(b / total), 0.0)) / math.log(2)


NODE_FIELDS = {"left": "int", "right": "int", "feature": "int", "threshold": "double", "value": "double", "cover": "double", "impurity": "double", "rows": "long"}


def node_stats(criterion: str, weights: tuple[float, float], n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Share of the positive class, weight and impurity of nodes."""
    a, b = weights[0] * n0, weights[1] * n1
    cover = a + b
    return b / cover, cover, side_cost(criterion, a, b) / cover


def narrow(n: int) -> type:
    """The smallest type of numbers below ``n``."""
    return np.uint8 if n <= 1 << 8 else np.uint16 if n <= 1 << 16 else np.int32


@dataclass(frozen=True)
class Coded:
    """Columns as whole numbers: the distinct values of each, rising, and the place of every row's value among them."""

    values: list[np.ndarray]
    codes: list[np.ndarray]

    @staticmethod
    def of(columns: Sequence[np.ndarray]) -> Coded:
        found = [np.unique(c, return_inverse=True) for c in columns]
        return Coded([v for v, _ in found], [c.astype(narrow(len(v))) for v, c in found])


def grow_node(x: np.ndarray, y: np.ndarray, count: np.ndarray, spec: TreeSpec, key: np.ndarray | None = None, depth: int = 0) -> dict[str, np.ndarray]:
    """Arrays of the tree below a node that holds the given rows; children come after their parents."""
    return grow_coded(Coded.of(x.T), y, count, spec, key, depth)


def grow_coded(table: Coded, y: np.ndarray, count: np.ndarray, spec: TreeSpec, key: np.ndarray | None = None, depth: int = 0) -> dict[str, np.ndarray]:
    """:func:`grow_node` of coded columns."""
    return grow_variants(table, y, count, [spec], key, depth)[0]


def grow_variants(
    table: Coded, y: np.ndarray, count: np.ndarray, specs: Sequence[TreeSpec], key: np.ndarray | None = None, depth: int = 0
) -> list[dict[str, np.ndarray]]:
    """Arrays of trees whose specifications differ in ``max_depth``, ``min_split`` and ``min_leaf`` only; each has all nodes, but reaches its own.

    Trees share a node as long as they take the same splits above it: a best cut that leaves enough
    rows for a larger ``min_leaf`` is the best one there too. Rows of a node stand together, all left children before the
    right ones; those of finished nodes are dropped.
    """
    spec, n_trees = specs[0], len(specs)
    least = np.array([max(s.min_leaf, 1) for s in specs])
    needed = np.array([max(s.min_split, 2 * s.min_leaf) for s in specs])
    limits = np.array([NO_LIMIT if s.max_depth is None else s.max_depth for s in specs])
    by_least = np.argsort(least, kind="stable")
    kept = np.flatnonzero(count)
    mark = 2 * count[kept].astype(np.int64) + y[kept]  # draws and label of a row in one number
    drawn, ones = int((mark >> 1).sum()), int(np.dot(mark >> 1, mark & 1))
    counts = Counts.of(mark.astype(np.uint8) if len(mark) and mark.max() < 1 << 8 else mark, drawn)
    layout, words = Layout.of(table, kept, mark)
    del mark, kept
    keys = root_key(spec.seed) if key is None else key
    rows, n0, n1 = np.array([len(words[0])]), np.array([drawn - ones]), np.array([ones])
    within = np.ones((1, n_trees), bool)  # the trees that have a node
    stats: dict[str, list[np.ndarray]] = {f: [] for f in ("value", "cover", "impurity", "rows")}
    splits: list[dict[str, list[np.ndarray]]] = [{f: [] for f in ("left", "right", "feature", "threshold")} for _ in specs]
    n_nodes, total = 0, 1
    active = np.flatnonzero(_open(within, rows, n0, n1, needed, depth < limits).any(axis=1))  # whose rows are at hand, in the order of these
    while total:
        value, cover, impurity = node_stats(spec.criterion, spec.weights, n0, n1)
        for name, values in (("value", value), ("cover", cover), ("impurity", impurity), ("rows", rows)):
            stats[name].append(values)
        size, todo = rows[active], _open(within[active], rows[active], n0[active], n1[active], needed, depth < limits)
        left = np.full((n_trees, total), -1, np.int32)
        feature, threshold = np.full((n_trees, total), -1, np.int32), np.zeros((n_trees, total))
        made: list[tuple[np.ndarray, ...]] = []
        moved: list[tuple] = []
        first, n_made = n_nodes + total, 0
        while todo.any():
            nodes = np.flatnonzero(todo.any(axis=1))
            smallest = least[by_least[np.argmax(todo[nodes][:, by_least], axis=1)]]
            part, at, sizes = words, active[nodes], size[nodes]
            if len(nodes) < len(active):
                chosen = np.zeros(len(active), bool)
                chosen[nodes] = True
                chosen = np.repeat(chosen, size)
                part = [w[chosen] for w in words]
            best = best_splits(table.values, layout, part, counts, sizes, n0[at], n1[at], keys[at], smallest, spec, n_trees > 1)
            found = best.feature
            cut = np.flatnonzero(found >= 0)
            todo[nodes[found < 0]] = False
            takes = todo[nodes[cut]]
            if n_trees > 1:
                takes &= least <= np.minimum(best.rows[cut], sizes[cut] - best.rows[cut])[:, None]
                todo[nodes[cut]] &= ~takes
            else:
                todo[:] = False
            if not len(cut):
                continue
            at = at[cut]
            edge = np.zeros(len(cut))
            for f in np.unique(found[cut]):
                mine = found[cut] == f
                edge[mine] = between(table.values[f][best.low[cut][mine]], table.values[f][best.high[cut][mine]])
            order = np.argsort(at)  # children are numbered in the order of their parents
            child = np.empty(len(cut), np.int64)
            child[order] = 2 * (n_made + np.arange(len(cut)))
            n_made += len(cut)
            for t in range(n_trees):
                on = np.flatnonzero(takes[:, t])
                left[t, at[on]], feature[t, at[on]], threshold[t, at[on]] = first + child[on], found[cut[on]], edge[on]
            if len(cut) < len(nodes):
                chosen = np.repeat(found >= 0, sizes)
                part = [w[chosen] for w in part]
            sizes, found = sizes[cut], found[cut]
            right = layout.beyond(part, found, best.low[cut], sizes)
            left_rows = sizes - np.add.reduceat(right, np.cumsum(sizes) - sizes, dtype=np.int64)
            made.append(tuple(v[order] for v in (at, takes, best.n0[cut], best.n1[cut], left_rows)))
            moved.append((part, right, sizes, child))
        for t, tree in enumerate(splits):
            for name, values in (("left", left[t]), ("right", np.where(left[t] >= 0, left[t] + 1, -1)), ("feature", feature[t]), ("threshold", threshold[t])):
                tree[name].append(values)
        n_nodes += total
        depth += 1
        total = 2 * n_made
        if not total:
            break
        parents, takes, *lefts = (np.concatenate(v) for v in zip(*made))
        n0, n1, rows = (np.stack([v, all_[parents] - v], axis=1).ravel() for v, all_ in zip(lefts, (n0, n1, rows)))
        within = np.repeat(takes, 2, axis=0)
        keys = np.stack(child_keys(keys[parents]), axis=1).ravel()
        # rows move to the children of their node, but for those whose children are leaves
        is_open = _open(within, rows, n0, n1, needed, depth < limits).any(axis=1)
        out, end, active = [np.empty(int(rows[is_open].sum()), np.uint64) for _ in words], 0, []
        while moved:
            part, right, sizes, child = moved.pop(0)
            for side, goes in ((child, ~right), (child + 1, right)):
                stays = is_open[side]
                begin, end = end, end + int(rows[side[stays]].sum())
                if not stays.all():
                    goes &= np.repeat(stays, sizes)
                for new, w in zip(out, part):
                    np.compress(goes, w, out=new[begin:end])
                active.append(side[stays])
        words, active = out, np.concatenate(active)
    whole = {name: np.concatenate(stats.pop(name)) for name in list(stats)}  # what is joined is let go
    return [{name: np.concatenate(tree.pop(name)) if name in tree else whole[name] for name in NODE_FIELDS} for tree in splits]


@dataclass(frozen=True)
class Layout:
    """Where a row's mark and the places of its values stand in its numbers of 64 bits: the mark lowest in the first one."""

    word: np.ndarray
    shift: np.ndarray
    bits: np.ndarray
    mark_bits: int

    @staticmethod
    def of(table: Coded, kept: np.ndarray, mark: np.ndarray) -> tuple[Layout, list[np.ndarray]]:
        """The layout and the numbers of the rows kept."""
        bits = [max(1, int(len(v) - 1).bit_length()) for v in table.values]
        mark_bits = int(mark.max()).bit_length() if len(mark) else 1
        word, shift, words, used = [], [], [mark.astype(np.uint64)], mark_bits
        for c, width in zip(table.codes, bits):
            if used + width > 64:
                words.append(np.zeros(len(kept), np.uint64))
                used = 0
            words[-1] |= c[kept].astype(np.uint64) << np.uint64(used)
            word.append(len(words) - 1), shift.append(used)
            used += width
        return Layout(np.array(word), np.array(shift), np.array(bits), mark_bits), words

    @property
    def masks(self) -> np.ndarray:
        """The bits of each feature, in its word."""
        return ((np.uint64(1) << self.bits.astype(np.uint64)) - np.uint64(1)) << self.shift.astype(np.uint64)

    def beyond(self, words: list[np.ndarray], feature: np.ndarray, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether each row lies right of the cut of its node."""
        edge, masks, out = low.astype(np.uint64) << self.shift[feature].astype(np.uint64), self.masks[feature], None
        for i, w in enumerate(words):
            here = self.word[feature] == i
            side = (w & np.repeat(np.where(here, masks, np.uint64(0)), size)) > np.repeat(np.where(here, edge, np.uint64(0)), size)
            out = side if out is None else out | side
        return out

    def varied(self, words: list[np.ndarray], begin: np.ndarray) -> np.ndarray:
        """``(node, feature)`` marks: the rows of a node differ in the feature."""
        differ = np.stack([np.bitwise_or.reduceat(w, begin) ^ np.bitwise_and.reduceat(w, begin) for w in words], axis=1)
        return (differ[:, self.word] & self.masks) != 0


def _open(within: np.ndarray, rows: np.ndarray, n0: np.ndarray, n1: np.ndarray, needed: np.ndarray, deeper: np.ndarray) -> np.ndarray:
    """``(node, tree)`` marks of what may be split."""
    return within & ((n0 > 0) & (n1 > 0))[:, None] & (rows[:, None] >= needed) & deeper


@dataclass(frozen=True)
class Counts:
    """Draws of rows and those of label 1 as one number, by the row's mark: sums of up to ``2**bits`` draws do not run into each other."""

    bits: int
    known: np.ndarray | None = None  # of every mark of a byte
    doubles: np.ndarray | None = None  # the same

    @staticmethod
    def of(mark: np.ndarray, drawn: int) -> Counts:
        if mark.dtype != np.uint8 or drawn >= 1 << 26:  # sums of doubles are exact below 2**53
            return Counts(31)
        every = np.arange(256)
        packed = (every >> 1) + ((every >> 1) * (every & 1) << 26)
        return Counts(26, packed, packed.astype(float))

    def packed(self, mark: np.ndarray) -> np.ndarray:
        if self.known is not None:
            return self.known.take(mark)
        mark = mark.astype(np.int64)
        drawn = mark >> 1
        return drawn + (drawn * (mark & 1) << self.bits)

    def sums(self, key: np.ndarray, mark: np.ndarray, n: int) -> np.ndarray:
        """Packed counts of each key below ``n``."""
        if self.doubles is not None:
            return np.bincount(key, self.doubles.take(mark), n).astype(np.int64)
        drawn, ones = (np.bincount(key, c, n).astype(np.int64) for c in (mark >> 1, (mark >> 1) * (mark & 1)))
        return drawn + (ones << self.bits)

    def both(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Zeros and ones."""
        ones = packed >> self.bits
        return (packed & ((1 << self.bits) - 1)) - ones, ones


@dataclass(frozen=True)
class Best:
    """The best cut of each node: feature (-1 for none), codes left and right of it, zeros, ones and (if asked for) rows left of it."""

    feature: np.ndarray
    low: np.ndarray
    high: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    rows: np.ndarray

    @staticmethod
    def none(n: int) -> Best:
        return Best(np.full(n, -1), *(np.zeros(n, np.int64) for _ in range(5)))


def best_splits(
    values: list[np.ndarray], layout: Layout, words: list[np.ndarray], counts: Counts, size: np.ndarray, n0: np.ndarray, n1: np.ndarray,
    keys: np.ndarray, least: np.ndarray, spec: TreeSpec, with_rows: bool,
) -> Best:
    """The best cut of each node; rows come ordered by node, and are looked at some nodes at a time."""
    ends = np.cumsum(size)
    begin = ends - size
    allowed = drawn_features(keys, layout.varied(words, begin), spec.tries)
    out, least_cost = Best.none(len(size)), np.full(len(size), np.inf)
    limited = with_rows or least.max() > 1
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, begin[a] + SLICE_ROWS, "right")))
        for f in np.flatnonzero(allowed[a:b].any(axis=0)):
            nodes, part = np.arange(a, b), [w[begin[a] : ends[b - 1]] for w in words]
            if not allowed[a:b, f].all():
                nodes = a + np.flatnonzero(allowed[a:b, f])
                on = np.repeat(allowed[a:b, f], size[a:b])
                part = [w[on] if i in (0, layout.word[f]) else w for i, w in enumerate(part)]
            _best_of_feature(f, len(values[f]), layout, part, counts, nodes, size[nodes], n0[nodes], n1[nodes], least[nodes], spec, limited, out, least_cost)
        a = b
    return out


def _best_of_feature(
    f: int, n_codes: int, layout: Layout, words: list[np.ndarray], counts: Counts, nodes: np.ndarray, size: np.ndarray, n0: np.ndarray, n1: np.ndarray,
    least: np.ndarray, spec: TreeSpec, limited: bool, out: Best, least_cost: np.ndarray,
) -> None:
    """Notes the nodes whose best cut by a feature is better than the one they have."""
    key, stride, sums, until = _cells(f, n_codes, layout, words, counts, size, limited)
    # a cut stands after each value of a node but the last one, and after those that leave enough rows on both sides
    start = np.searchsorted(key, (np.arange(len(nodes)) * stride).astype(key.dtype))
    stop = np.append(start[1:], len(key)) - 1
    before = np.concatenate([[0], sums])[start]  # what lies in nodes to the left
    if limited:
        begin = np.cumsum(size) - size
        start = np.maximum(start, np.searchsorted(until, begin + least))
        stop = np.minimum(stop, np.searchsorted(until, begin + size - least, "right"))
    n_cuts = np.maximum(stop - start, 0)
    some = np.flatnonzero(n_cuts)
    if not len(some):
        return
    shift = start[some] - (np.cumsum(n_cuts[some]) - n_cuts[some])
    own = np.repeat(some, n_cuts[some])
    cut = np.arange(len(own)) + (shift if len(some) == 1 else np.repeat(shift, n_cuts[some]))
    if spec.criterion == "gini" and len(cut) > 4 * len(nodes):
        near = [i + _near_best(sums[cut[i : i + SLICE_ROWS]], own[i : i + SLICE_ROWS], before, counts, spec.weights, n0, n1) for i in range(0, len(cut), SLICE_ROWS)]
        near = np.concatenate(near)
        cut, own = cut[near], own[near]
    l0, l1 = counts.both(sums[cut] - before[own])
    w0, w1 = spec.weights
    cost = side_cost(spec.criterion, w0 * l0, w1 * l1) + side_cost(spec.criterion, w0 * (n0[own] - l0), w1 * (n1[own] - l1))
    run = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    lowest = np.minimum.reduceat(cost, run)
    equal = np.flatnonzero(cost == np.repeat(lowest, np.diff(run, append=len(own))))
    place = equal[np.searchsorted(equal, run)]  # the first of equal costs
    mine = nodes[own[run]]
    better = lowest < least_cost[mine]
    mine, place = mine[better], place[better]
    least_cost[mine], out.feature[mine] = lowest[better], f
    low, base = cut[place], own[place] * stride
    out.low[mine], out.high[mine] = key[low].astype(np.int64) - base, key[low + 1].astype(np.int64) - base
    out.n0[mine], out.n1[mine] = l0[place], l1[place]
    if limited:
        out.rows[mine] = until[low] - begin[own[place]]


def _near_best(
    packed: np.ndarray, own: np.ndarray, before: np.ndarray, counts: Counts, weights: tuple[float, float], n0: np.ndarray, n1: np.ndarray
) -> np.ndarray:
    """The cuts whose gain by a short formula is the best of their node here, but for rounding: only these need the exact one.

    With the weights ``a`` of zeros and ``t`` of all rows left of the cut and ``A`` and ``T`` of the node, the costs of the
    sides add up to that of the node less ``2 (a T - A t)^2 / (T t (T - t))``.
    """
    w0, w1 = weights
    single = own[0] == own[-1]
    at = own[:1] if single else own
    packed = packed - before[at]
    ones = packed >> counts.bits
    packed &= (1 << counts.bits) - 1
    packed -= ones
    a = w0 * packed
    t = w1 * ones
    t += a
    all_a, all_t = (w0 * n0)[at], (w0 * n0 + w1 * n1)[at]
    gain = all_a * t
    a *= all_t
    gain -= a
    gain *= gain
    rest = all_t - t
    rest *= t
    gain /= rest
    if single:
        return np.flatnonzero(gain >= gain.max() - 1e-11 * all_t * all_t)
    run = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    highest = np.maximum.reduceat(gain, run) - 1e-11 * np.square(all_t[run])
    return np.flatnonzero(gain >= np.repeat(highest, np.diff(run, append=len(own))))


def _cells(
    f: int, n_codes: int, layout: Layout, words: list[np.ndarray], counts: Counts, size: np.ndarray, with_rows: bool
) -> tuple[np.ndarray, int, np.ndarray, np.ndarray | None]:
    """``(key, stride, counts, rows)`` of every value that occurs in a node, in that order, counts (packed) and rows added up so far.

    The key is the node times the stride plus the value's code.
    """
    total, n = len(size), len(words[0])
    wide, bits = int(layout.bits[f]), layout.mark_bits
    code = words[layout.word[f]] >> np.uint64(layout.shift[f])
    code &= np.uint64((1 << wide) - 1)
    mark = words[0] & np.uint64((1 << bits) - 1)
    if total * n_codes <= 2 * n:  # few values: counted in place
        key = code.view(np.int64)
        if total > 1:
            key += np.repeat(np.arange(total) * n_codes, size)
        sums = counts.sums(key, mark.view(np.int64), total * n_codes)
        place = np.flatnonzero(sums)
        rows = np.cumsum(np.bincount(key, minlength=1)[place]) if with_rows else None
        return place, n_codes, np.cumsum(sums[place]), rows
    code <<= np.uint64(bits)
    code |= mark
    kind = np.uint32 if int(total - 1).bit_length() + wide + bits <= 32 else np.uint64
    packed = code.astype(kind, copy=False)
    if total > 1:
        packed |= np.repeat(np.arange(total).astype(kind) << kind(wide + bits), size)
    packed.sort()
    key = packed >> kind(bits)
    end = np.empty(n, bool)
    np.not_equal(key[1:], key[:-1], out=end[:-1])
    end[-1] = True
    end = np.flatnonzero(end)
    packed &= kind((1 << bits) - 1)
    sums = np.cumsum(counts.packed(packed))[end]
    return key[end], 1 << wide, sums, end + 1


def between(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    middle = low / 2 + high / 2
    return np.where(middle < high, middle, low)


# ---- many trees ----

MODEL = "tree int, " + ", ".join(f"{n} array<{t}>" for n, t in NODE_FIELDS.items())


def prepared(df: DataFrame) -> DataFrame:
    """``(row, label, fold, x)`` of training rows, written once, so a row keeps its number however often it is read."""
    fold = F.coalesce(F.col("fold").cast("int"), F.lit(-1)) if "fold" in df.columns else F.lit(-1)
    return stage(df.select(
        F.monotonically_increasing_id().alias("row"), F.col("label").cast("int").alias("label"), fold.alias("fold"), vector_to_array("features").alias("x")
    ))


def grown(base: DataFrame, specs: Sequence[TreeSpec], node_rows: int | None = None, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row for each tree: its number and the arrays of its nodes, written once."""
    n, width = table_size(base)
    if n * (8 * width + 24) <= table_bytes:
        return stage(_by_tree(base, specs))
    node_rows = max(1, NODE_CELLS // width) if node_rows is None else node_rows
    if n <= node_rows and len(specs) > 1:
        return stage(_by_copy(base, specs, width))
    return stage(_by_level(base, specs, width, node_rows))


def table_size(base: DataFrame) -> tuple[int, int]:
    """Rows and columns of a table that is not empty."""
    n, width = base.agg(F.count("*"), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("a tree needs rows")
    return n, width


def is_small(base: DataFrame) -> bool:
    """Whether the whole table may go to every task."""
    n, width = table_size(base)
    return n * (8 * width + 24) <= TABLE_BYTES


def whole_table(base: DataFrame) -> tuple[Coded, np.ndarray, np.ndarray, np.ndarray]:
    """Columns, labels, folds and numbers of the rows of a small table."""
    table = base.orderBy("row").toPandas()
    return Coded.of(np.stack(table["x"].to_numpy()).astype(float).T), *(table[c].to_numpy() for c in ("label", "fold", "row"))


def spec_rows(base: DataFrame, specs: Sequence[TreeSpec]) -> DataFrame:
    """The specifications as rows, spread over the tasks."""
    spark = base.sparkSession
    rows = spark.createDataFrame([(i, i) for i in range(len(specs))], "place int, tree int")
    return rows.repartition(min(len(specs), 8 * spark.sparkContext.defaultParallelism), "place")


def arrays_of(tree: int, nodes: dict[str, np.ndarray]) -> dict:
    return {"tree": tree, **{name: values.astype(dict(double="f8", int="i4", long="i8")[NODE_FIELDS[name]], copy=False) for name, values in nodes.items()}}


def _by_tree(base: DataFrame, specs: Sequence[TreeSpec]) -> DataFrame:
    """Trees shared among the tasks, each of which has the whole (small) table."""
    shared = base.sparkSession.sparkContext.broadcast((whole_table(base), list(specs)))

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (x, y, fold, row), chosen = shared.value
        for batch in batches:
            for place in batch["place"]:
                spec = chosen[place]
                yield pd.DataFrame([arrays_of(spec.tree, grow_coded(x, y, draws_of(row, fold, spec), spec))])

    return spec_rows(base, specs).mapInPandas(grow, MODEL)


# ---- copies of a table that a task can hold ----


def fits_task(base: DataFrame) -> bool:
    """Whether a task can hold the whole table."""
    n, width = table_size(base)
    return n * (8 * width + 24) <= TABLE_BYTES or n <= NODE_CELLS // width


PACKED_ROWS = "task int, marks binary, numbers binary, folds binary, cells array<binary>, places array<boolean>, values array<binary>"


def with_copies(base: DataFrame, width: int, tasks: int, each: Callable[[int, tuple], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """What ``each`` gives for the number of every task and the whole table, of which each task gets a copy.

    Rows travel packed, once for each task, however many trees it grows from them.
    """
    names = [f"x{i}" for i in range(width)]
    flat = base.select("row", "label", "fold", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in _chunks(batches, width, [], COPY_ROWS):
            cells, places, values = [], [], []
            for x in chunk.x:
                found, codes = np.unique(x, return_inverse=True)
                few = len(found) <= 1 << 16
                cells.append(planes(codes.astype(narrow(len(found))) if few else x)), places.append(few)
                values.append(found.tobytes() if few else b"")
            yield pd.DataFrame([{
                "marks": chunk.label.astype(np.uint8).tobytes(), "numbers": planes(chunk.row.astype(np.int64)), "folds": planes(chunk.fold.astype(np.int32)),
                "cells": cells, "places": places, "values": values,
            }])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, task = [], None
        for batch in batches:
            for r in batch.itertuples():
                task = r.task
                columns = [_column(c, few, v) for c, few, v in zip(r.cells, r.places, r.values)]
                parts.append((from_planes(r.numbers, np.int64), np.frombuffer(r.marks, np.uint8), from_planes(r.folds, np.int32), columns))
        if parts:
            parts.sort(key=lambda p: p[0][0])  # chunks hold rising numbers, so all are in order
            yield from each(task, _coded_table(parts, width))

    rows = flat.mapInPandas(pack, PACKED_ROWS.split(", ", 1)[1])
    dealt = rows.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "*").repartitionById(tasks, "task")
    return dealt.mapInPandas(run, schema)


def _column(cells: bytes, few: bool, values: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a chunk's column and the rows' places among them."""
    if few:
        found = np.frombuffer(values, float)
        return found, from_planes(cells, narrow(len(found)))
    found, codes = np.unique(from_planes(cells, float), return_inverse=True)
    return found, codes.astype(np.int32)


def _coded_table(parts: list[tuple], width: int) -> tuple[Coded, np.ndarray, np.ndarray, np.ndarray]:
    """Columns, labels, folds and numbers of the rows of all chunks."""
    row, y, fold = (np.concatenate([p[i] for p in parts]) for i in range(3))
    columns = [p[3] for p in parts]
    parts.clear()
    values, codes = [], []
    for f in range(width):
        found = np.unique(np.concatenate([c[f][0] for c in columns]))
        out, end = np.empty(len(row), narrow(len(found))), 0
        for c in columns:
            own, places = c[f]
            out[end : end + len(places)] = np.searchsorted(found, own).astype(out.dtype)[places]
            end += len(places)
            c[f] = None
        values.append(found), codes.append(out)
    return Coded(values, codes), y, fold, row


def _by_copy(base: DataFrame, specs: Sequence[TreeSpec], width: int) -> DataFrame:
    """Trees shared among tasks that each hold a copy of the table."""
    context = base.sparkSession.sparkContext
    tasks = min(len(specs), 2 * context.defaultParallelism)
    shared = context.broadcast(list(specs))

    def grow(task: int, table: tuple) -> Iterator[pd.DataFrame]:
        columns, y, fold, row = table
        for place in range(task, len(shared.value), tasks):
            spec = shared.value[place]
            yield pd.DataFrame([{"place": place, **arrays_of(spec.tree, grow_coded(columns, y, draws_of(row, fold, spec), spec))}])

    # a task that writes or reads staged rows holds all of its part, so large trees must not meet in one
    apart = min(len(specs), MODEL_PARTS)
    return with_copies(base, width, tasks, grow, "place int, " + MODEL).repartitionById(apart, F.col("place") % apart).drop("place")


# ---- levels of large nodes ----


class Top:
    """The part of a tree above its small nodes, held by the driver: few nodes, however many rows."""

    def __init__(self, spec: TreeSpec):
        self.spec = spec
        self.left, self.right, self.feature, self.threshold, self.depth = [-1], [-1], [-1], [0.0], [0]
        self.keys = [root_key(spec.seed)[0]]
        self.counts = [(0, 0, 0)]  # zeros and ones drawn, and rows

    def split(self, node: int, feature: int, threshold: float, counts: Sequence[tuple[int, int, int]]) -> list[int]:
        """Numbers of the new children."""
        made = [len(self.left), len(self.left) + 1]
        self.left[node], self.right[node], self.feature[node], self.threshold[node] = *made, feature, threshold
        for key, c in zip(child_keys(np.array([self.keys[node]])), counts):
            self.left.append(-1), self.right.append(-1), self.feature.append(-1), self.threshold.append(0.0)
            self.depth.append(self.depth[node] + 1), self.keys.append(key[0]), self.counts.append(c)
        return made

    def is_open(self, node: int) -> bool:
        (n0, n1, rows), s = self.counts[node], self.spec
        limit = NO_LIMIT if s.max_depth is None else s.max_depth
        return n0 > 0 and n1 > 0 and rows >= max(s.min_split, 2 * s.min_leaf) and self.depth[node] < limit

    def places(self, x: list[np.ndarray]) -> np.ndarray:
        """The node each row is in."""
        at = np.zeros(len(x[0]), np.int32)
        for node, left in enumerate(self.left):  # parents come before their children
            if left >= 0:
                here = np.flatnonzero(at == node)
                at[here] = np.where(x[self.feature[node]][here] <= self.threshold[node], left, self.right[node])
        return at


@dataclass(frozen=True)
class Chunk:
    """Some rows: columns, the range of each value, label, fold and number."""

    x: list[np.ndarray]
    ranges: list[np.ndarray]
    label: np.ndarray
    fold: np.ndarray
    row: np.ndarray


def _chunks(batches: Iterator[pd.DataFrame], width: int, cuts: list[np.ndarray], chunk_rows: int | None = None) -> Iterator[Chunk]:
    held, size = [], 0
    chunk_rows = CHUNK_ROWS if chunk_rows is None else chunk_rows

    def chunk() -> Chunk:
        table = pd.concat(held)
        x = [table[f"x{i}"].to_numpy(float) for i in range(width)]
        ranges = [np.searchsorted(c, v, side="right").astype(np.int32) for c, v in zip(cuts, x)]
        return Chunk(x, ranges, *(table[c].to_numpy() for c in ("label", "fold", "row")))

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size >= chunk_rows:
            yield chunk()
            held, size = [], 0
    if size:
        yield chunk()


def _by_level(base: DataFrame, specs: Sequence[TreeSpec], width: int, node_rows: int) -> DataFrame:
    """Trees whose large nodes are split by Spark, a level of all trees at once.

    No row moves while large nodes are split: each pass reads the table and finds the rows'
    nodes from the draws and the tops of the trees. What is shuffled are counts by range, and of
    the few ranges that can hold the best cut the values. Rows are dealt out once, to the small nodes.
    """
    spark = base.sparkSession
    names = [f"x{i}" for i in range(width)]
    flat = base.select("row", "label", "fold", *[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    tops = [Top(s) for s in specs]
    cuts, small, frontier = None, {}, {i: [0] for i in range(len(specs))}
    for i, counts in _root_counts(flat, specs).items():
        tops[i].counts[0] = counts
    while True:
        large = {}
        for i, nodes in frontier.items():
            opened = [v for v in nodes if tops[i].is_open(v)]
            small.setdefault(i, []).extend(v for v in opened if tops[i].counts[v][2] <= node_rows)
            if big := [v for v in opened if tops[i].counts[v][2] > node_rows]:
                large[i] = big
        if not large:
            break
        if cuts is None:
            found = value_cuts(flat, names, max(1, -(-flat.count() // FINE)), FINE)
            cuts = [np.array(found[c], float) for c in names]
        frontier = {}
        for r in _level_splits(flat, cuts, tops, large).collect():
            top, left = tops[r["tree"]], (r["n0"], r["n1"], r["rows"])
            right = tuple(t - v for t, v in zip(top.counts[r["node"]], left))
            threshold = float(between(np.array([r["below"]]), np.array([r["above"]]))[0])
            frontier.setdefault(r["tree"], []).extend(top.split(r["node"], r["feature"], threshold, (left, right)))
    small = {i: v for i, v in small.items() if v}
    shared = spark.sparkContext.broadcast((tops, small))
    # several tasks for each node, so that few of them meet in one
    tasks = min(MAX_TASKS, 4 * max(1, sum(map(len, small.values()))))
    dealt = flat.mapInPandas(_deal(shared, width), DEALT).repartition(tasks, "tree", "node")
    finish = dealt.groupBy("tree", "node").applyInPandas(_finish(shared, width), SUBTREE)
    if all(len(t.left) == 1 and small.get(i) for i, t in enumerate(tops)):  # every tree is one small node
        numbers = spark.sparkContext.broadcast([s.tree for s in specs])
        return finish.drop("node").withColumn("tree", F.udf(lambda i: numbers.value[i], "int")("tree"))
    marks = spark.createDataFrame([(i, -1) for i in range(len(specs))], "tree int, node int")
    return finish.unionByName(marks, allowMissingColumns=True).groupBy("tree").applyInPandas(_joined(shared), MODEL)


def _root_counts(flat: DataFrame, specs: Sequence[TreeSpec]) -> dict[int, tuple[int, int, int]]:
    """Zeros and ones drawn by each tree, and its rows."""
    chosen = flat.sparkSession.sparkContext.broadcast(list(specs))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(chosen.value), 3), np.int64)
        for batch in batches:
            label, fold, row = (batch[c].to_numpy() for c in ("label", "fold", "row"))
            for i, spec in enumerate(chosen.value):
                drawn = draws_of(row, fold, spec)
                ones = int(drawn[label == 1].sum(dtype=np.int64))
                sums[i] += int(drawn.sum(dtype=np.int64)) - ones, ones, np.count_nonzero(drawn)
        yield pd.DataFrame(sums, columns=["n0", "n1", "rows"]).assign(tree=np.arange(len(sums)))

    parts = flat.select("row", "label", "fold").mapInPandas(count, "n0 long, n1 long, rows long, tree int")
    sums = parts.groupBy("tree").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "rows")])
    return {r["tree"]: (r["n0"], r["n1"], r["rows"]) for r in sums.collect()}


def _rows_of(chunk: Chunk, tops: list[Top], wanted: dict[int, list[int]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(tree, node, rows, draws)`` of the wanted nodes in a chunk."""
    for i, nodes in wanted.items():
        count = draws_of(chunk.row, chunk.fold, tops[i].spec)
        slot = np.full(len(tops[i].left), len(nodes), np.int32)
        slot[nodes] = np.arange(len(nodes))
        slot = np.where(count > 0, slot[tops[i].places(chunk.x)], len(nodes))
        if len(nodes) == 1:
            order = np.flatnonzero(slot == 0)
        else:
            order = np.argsort(slot.astype(np.uint16) if len(nodes) < 1 << 16 else slot, kind="stable")
        ends = np.cumsum(np.bincount(slot, minlength=len(nodes) + 1))
        for k, node in enumerate(nodes):
            rows = order[ends[k - 1] if k else 0 : ends[k]]
            if len(rows):
                yield i, node, rows, count[rows]


COUNTS = "tree int, node int, feature int, range int, n0 long, n1 long, rows long"


def _level_splits(flat: DataFrame, cuts: list[np.ndarray], tops: list[Top], large: dict[int, list[int]]) -> DataFrame:
    """``(tree, node, feature, below, above, n0, n1, rows)``: the best cut of each node that has one, and what lies left of it.

    Counts by range come first. Impurity is concave in the counts of both classes, so in a range
    it is least at a corner of what the counts may be there, and only ranges whose least
    corner reaches the best of the known edges between ranges can hold the best cut. These
    are looked at in finer ranges, and what then stays value by value.
    """
    context, width = flat.sparkSession.sparkContext, len(cuts)
    known, most = context.broadcast((tops, large, cuts)), 1 + max(map(len, cuts))

    def coarse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops, large, cuts = known.value
        for chunk in _chunks(batches, width, cuts):
            places = [(r >> FINE_BITS).astype(np.int64) for r in chunk.ranges]
            for i, node, rows, count in _rows_of(chunk, tops, large):
                found, packed = [], _packed(chunk.label[rows], count)
                for f in range(width):
                    counts = _range_counts(i, node, f, places[f][rows], packed)
                    # values of several ranges vary, whatever they are
                    x = chunk.x[f][rows] if len(counts) == 1 else np.array([-np.inf, np.inf])
                    found.append(counts.assign(low=x.min(), high=x.max()))
                yield pd.concat(found)

    keys = ["tree", "node", "feature", "range"]
    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "rows")]
    counts = flat.mapInPandas(coarse, COUNTS + ", low double, high double").groupBy(*keys).agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"))

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        top, node = known.value[0][int(group["tree"].iloc[0])], int(group["node"].iloc[0])
        ends = group.groupby("feature").agg({"low": "min", "high": "max"}).sort_index()
        varied = (ends["low"] < ends["high"]).to_numpy()[None, :]
        tried = np.flatnonzero(drawn_features(np.array([top.keys[node]]), varied, top.spec.tries)[0])
        group = group[group["feature"].isin(tried)].sort_values(["feature", "range"]).assign(before0=0, before1=0, before=0)
        return _possible(group, ["feature"], top, node)

    kept = counts.groupBy("tree", "node").applyInPandas(choose, KEPT).toPandas()
    bits = FINE_BITS
    if kept["rows"].sum() > EXACT_ROWS:
        parents = context.broadcast(_by_feature(kept, most))

        def fine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            tops, large, cuts = known.value
            for chunk in _chunks(batches, width, cuts):
                for i, node, rows, count in _rows_of(chunk, tops, large):
                    for f, wanted in parents.value.get((i, node), {}).items():
                        ranges = chunk.ranges[f][rows]
                        on = np.flatnonzero(wanted[ranges >> FINE_BITS])
                        if len(on):
                            yield _range_counts(i, node, f, ranges[on], _packed(chunk.label[rows[on]], count[on]))

        starts = flat.sparkSession.createDataFrame(kept[["tree", "node", "feature", "range", "before0", "before1", "before"]].rename(columns={"range": "parent"}))
        starts = starts.select(*[F.col(c).cast("int") for c in ("tree", "node", "feature", "parent")], "before0", "before1", "before")
        finer = flat.mapInPandas(fine, COUNTS).groupBy(*keys).agg(*sums).withColumn("parent", F.shiftright("range", FINE_BITS))
        finer = finer.join(F.broadcast(starts), ["tree", "node", "feature", "parent"])

        def narrow(group: pd.DataFrame) -> pd.DataFrame:
            top, node = known.value[0][int(group["tree"].iloc[0])], int(group["node"].iloc[0])
            return _possible(group.sort_values(["feature", "range"]), ["feature", "parent"], top, node)

        kept, bits = finer.groupBy("tree", "node").applyInPandas(narrow, KEPT).toPandas(), 0
    last = context.broadcast((_by_feature(kept, most), bits))

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops, large, cuts = known.value
        by_feature, bits = last.value
        for chunk in _chunks(batches, width, cuts):
            for i, node, rows, count in _rows_of(chunk, tops, large):
                for f, wanted in by_feature.get((i, node), {}).items():
                    yield _value_counts(i, node, f, chunk.x[f][rows], chunk.ranges[f][rows] >> bits, chunk.label[rows], count, wanted)

    cells = flat.mapInPandas(exact, COUNTS + ", value double").groupBy(*keys, "value").agg(*sums)
    before = flat.sparkSession.createDataFrame(kept[["tree", "node", "feature", "range", "before0", "before1", "before"]], "tree int, node int, feature int, range int, before0 long, before1 long, before long")
    totals = flat.sparkSession.createDataFrame(
        [(i, v, *map(int, tops[i].counts[v]), s.criterion == "gini", *map(float, s.weights), max(s.min_leaf, 1)) for i, nodes in large.items() for s in (tops[i].spec,) for v in nodes],
        "tree int, node int, all0 long, all1 long, total long, gini boolean, w0 double, w1 double, least long",
    )
    order = W.partitionBy(*keys).orderBy("value")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    left = {c: F.col(b) + F.coalesce(F.sum(c).over(earlier), F.lit(0)) for c, b in (("n0", "before0"), ("n1", "before1"), ("rows", "before"))}
    placed = cells.join(F.broadcast(before), keys).select(
        "tree", "node", "feature", F.col("value").alias("above"), F.lag("value").over(order).alias("below"), F.col("rows").alias("here"), *[v.alias(c) for c, v in left.items()]
    )

    def cost(a: Column, b: Column) -> Column:
        part = lambda c: F.when(c > 0, c * F.log(c / (a + b))).otherwise(0.0)
        return F.when(F.col("gini"), 2 * a * b / (a + b)).otherwise(-(part(a) + part(b)) / math.log(2))

    w0, w1 = F.col("w0"), F.col("w1")
    cut = placed.filter("here > 0").join(F.broadcast(totals), ["tree", "node"]).filter((F.col("rows") >= F.col("least")) & (F.col("total") - F.col("rows") >= F.col("least")))
    both = cost(w0 * F.col("n0"), w1 * F.col("n1")) + cost(w0 * (F.col("all0") - F.col("n0")), w1 * (F.col("all1") - F.col("n1")))
    best = cut.groupBy("tree", "node").agg(F.min(F.struct(both.alias("cost"), "feature", "above", "below", "n0", "n1", "rows")).alias("best"))
    return best.select("tree", "node", "best.feature", "best.above", "best.below", "best.n0", "best.n1", "best.rows")


def _packed(label: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Draws of a chunk's rows and those of label 1 as one number each, whose sums are exact."""
    return count * np.where(label == 1, float((1 << 26) + 1), 1.0)


def _unpacked(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones."""
    sums = sums.astype(np.int64)
    ones = sums >> 26
    return (sums & ((1 << 26) - 1)) - ones, ones


def _range_counts(tree: int, node: int, feature: int, ranges: np.ndarray, packed: np.ndarray) -> pd.DataFrame:
    rows = np.bincount(ranges)
    at = np.flatnonzero(rows)
    zeros, ones = _unpacked(np.bincount(ranges, packed)[at])
    return pd.DataFrame({"tree": tree, "node": node, "feature": feature, "range": at, "n0": zeros, "n1": ones, "rows": rows[at]})


def _value_counts(
    tree: int, node: int, feature: int, x: np.ndarray, ranges: np.ndarray, label: np.ndarray, count: np.ndarray, wanted: np.ndarray
) -> pd.DataFrame:
    """Counts of each value in the wanted ranges, and, with no rows, the largest value that lies before each of these."""
    held = np.flatnonzero(np.bincount(ranges, minlength=len(wanted)))
    edge = np.flatnonzero(wanted)
    below = np.searchsorted(held, edge) - 1  # the last range before that holds rows
    edge, below = edge[below >= 0], held[below[below >= 0]]
    highest, last = np.full(len(wanted), -np.inf), np.zeros(len(wanted), bool)
    last[below] = True
    near = np.flatnonzero(last[ranges])
    np.maximum.at(highest, ranges[near], x[near])
    on = np.flatnonzero(wanted[ranges])
    value, code = np.unique(x[on], return_inverse=True)
    place = np.zeros(len(value), np.int64)
    place[code] = ranges[on]  # a value lies in one range
    rows = np.bincount(code, minlength=len(value))
    zeros, ones = _unpacked(np.bincount(code, _packed(label[on], count[on]), len(value)))
    none = np.zeros(len(edge))
    return pd.DataFrame({
        "tree": tree, "node": node, "feature": feature, "range": np.concatenate([place, edge]),
        **{c: np.concatenate([v, none]).astype(np.int64) for c, v in (("n0", zeros), ("n1", ones), ("rows", rows))}, "value": np.concatenate([value, highest[below]]),
    })


KEPT = "tree int, node int, feature int, range int, rows long, before0 long, before1 long, before long"


def _possible(group: pd.DataFrame, parent: list[str], top: Top, node: int) -> pd.DataFrame:
    """The ranges that can hold a node's best cut, and what lies before them; ``before`` columns hold what lies before their parents."""
    group = group.copy()
    own = {c: group[c].to_numpy() for c in ("n0", "n1", "rows")}
    for c, b in (("n0", "before0"), ("n1", "before1"), ("rows", "before")):
        group[b] = group[b] + group.groupby(parent)[c].cumsum() - group[c]
    l0, l1, left = (group[b].to_numpy() for b in ("before0", "before1", "before"))
    (all0, all1, total), (w0, w1), least = top.counts[node], top.spec.weights, max(top.spec.min_leaf, 1)

    def cost(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sides = (a, b), (all0 - a, all1 - b)
        with np.errstate(divide="ignore", invalid="ignore"):
            return sum(np.where(p + q > 0, side_cost(top.spec.criterion, w0 * p, w1 * q), 0.0) for p, q in sides)

    edge = np.where((left >= least) & (total - left >= least), cost(l0, l1), np.inf)
    corner = np.min([cost(l0 + i * own["n0"], l1 + j * own["n1"]) for i in (0, 1) for j in (0, 1)], axis=0)
    near = corner <= edge.min(initial=np.inf) + 1e-9 * (1 + cost(np.zeros(1), np.zeros(1))[0])
    kept = near & (left + own["rows"] > least) & (total - left >= least)
    return group.loc[kept, [c.split()[0] for c in KEPT.split(", ")]]


def _by_feature(kept: pd.DataFrame, ranges: int) -> dict[tuple[int, int], dict[int, np.ndarray]]:
    """Marks of the kept ones among the ``ranges`` of each node and feature."""
    out: dict[tuple[int, int], dict[int, np.ndarray]] = {}
    for (i, node, f), part in kept.groupby(["tree", "node", "feature"]):
        marks = np.zeros(ranges, bool)
        marks[part["range"].to_numpy()] = True
        out.setdefault((int(i), int(node)), {})[int(f)] = marks
    return out


DEALT = "tree int, node int, marks binary, cells array<binary>, values array<array<double>>"


def planes(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones: those of ordered numbers are runs, which the shuffle's compression shrinks."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(packed: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(packed, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _ordered(chunk: Chunk) -> tuple[Chunk, list[tuple[np.ndarray, np.ndarray]]]:
    """The chunk ordered by its most varied column, and the distinct values of each column with the rows' places among them."""
    found = [np.unique(x, return_inverse=True) for x in chunk.x]
    order = np.argsort(max(found, key=lambda pair: len(pair[0]))[1])
    moved = Chunk([x[order] for x in chunk.x], [], chunk.label[order], chunk.fold[order], chunk.row[order])
    return moved, [(v, c[order].astype(narrow(len(v)))) for v, c in found]


def _deal(shared, width: int):
    """Rows of small nodes, packed column by column: draws and label, and each value or, where that is shorter, its place among few."""

    def cells(x: np.ndarray, values: np.ndarray, places: np.ndarray, rows: np.ndarray) -> tuple[bytes, np.ndarray]:
        few = len(values) <= 1 << 8 or (len(values) <= 1 << 16 and 4 * len(values) < 3 * len(rows))
        return (planes(places[rows]), values) if few else (planes(x[rows]), values[:0])

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tops, small = shared.value
        for whole in _chunks(batches, width, []):
            chunk, coded = _ordered(whole)
            for i, node, rows, count in _rows_of(chunk, tops, small):
                marks = 2 * count + chunk.label[rows].astype(np.uint8)
                columns = [cells(x, *c, rows) for x, c in zip(chunk.x, coded)]
                yield pd.DataFrame([{"tree": i, "node": node, "marks": marks.tobytes(), "cells": [c for c, _ in columns], "values": [v for _, v in columns]}])

    return deal


SUBTREE = "tree int, node int, " + ", ".join(f"{n} array<{t}>" for n, t in NODE_FIELDS.items())


def _finish(shared, width: int):
    """The subtree of a node that one task holds."""

    def column(parts: list[tuple[bytes, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if all(len(v) for _, v in parts):
            values = np.unique(np.concatenate([v for _, v in parts]))
            kind = narrow(len(values))
            return values, np.concatenate([np.searchsorted(values, v).astype(kind)[from_planes(c, narrow(len(v)))] for c, v in parts])
        x = np.concatenate([np.asarray(v)[from_planes(c, narrow(len(v)))] if len(v) else from_planes(c, float) for c, v in parts])
        values, codes = np.unique(x, return_inverse=True)
        return values, codes.astype(narrow(len(values)))

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        place, node = int(group["tree"].iloc[0]), int(group["node"].iloc[0])
        top = shared.value[0][place]
        marks = np.concatenate([np.frombuffer(m, np.uint8) for m in group["marks"]])
        columns = [column([(c[f], v[f]) for c, v in zip(group["cells"], group["values"])]) for f in range(width)]
        table = Coded([v for v, _ in columns], [c for _, c in columns])
        nodes = grow_coded(table, marks & 1, marks >> 1, top.spec, np.array([top.keys[node]]), top.depth[node])
        return pd.DataFrame([{"node": node, **arrays_of(place, nodes)}])

    return finish


def _joined(shared):
    """One tree from its top and its finished subtrees."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        top = shared.value[0][int(group["tree"].iloc[0])]
        finished = {int(r["node"]): r for r in group.to_dict("records") if r["node"] >= 0}
        spec, parts = top.spec, {name: [] for name in NODE_FIELDS}
        size, todo = 0, [(0, None, "")]
        # a parent is always placed before its children
        while todo:
            node, parent, side = todo.pop()
            if parent is not None:
                parts[side][parent][0] = size
            if node in finished:
                whole = {name: np.array(finished[node][name]) for name in NODE_FIELDS}
                for name in ("left", "right"):
                    whole[name] = np.where(whole[name] >= 0, whole[name] + size, -1)
            else:
                n0, n1, rows = (np.array([c]) for c in top.counts[node])
                value, cover, impurity = node_stats(spec.criterion, spec.weights, n0, n1)
                whole = {
                    "left": np.array([-1]), "right": np.array([-1]), "feature": np.array([top.feature[node]]), "threshold": np.array([top.threshold[node]]),
                    "value": value, "cover": cover, "impurity": impurity, "rows": rows,
                }
            for name in NODE_FIELDS:
                parts[name].append(whole[name])
            if top.left[node] >= 0:
                at = len(parts["left"]) - 1
                todo += [(top.right[node], at, "right"), (top.left[node], at, "left")]
            size += len(whole["value"])
        return pd.DataFrame([arrays_of(spec.tree, {name: np.concatenate(values) for name, values in parts.items()})])

    return join
