"""Grown trees against exhaustive search, on both ways of growing them, and cut against grown ones."""

import math
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardlight.models import explain, grow, train, trees
from wardlight.operators import importance


def labelled(spark, x, y, fold=None):
    rows = [(float(b), Vectors.dense([float(v) for v in np.atleast_1d(a)]), int(f)) for a, b, f in zip(x, y, np.zeros(len(y)) if fold is None else fold)]
    return spark.createDataFrame(rows, ["label", "features", "fold"])


def impurity(criterion, a, b):
    total = a + b
    shares = [v / total for v in (a, b) if v > 0]
    return 1 - sum(s * s for s in shares) if criterion == "gini" else -sum(s * math.log2(s) for s in shares)


def exhaustive(x, y, criterion="gini", depth=None, min_leaf=1, min_split=2, weights=(1.0, 1.0)):
    """Nested ``(feature, threshold, left, right)`` or a probability, trying every midpoint of every feature."""
    a, b = weights[0] * (y == 0).sum(), weights[1] * (y == 1).sum()
    if not a or not b or len(y) < min_split or depth == 0:
        return b / (a + b)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for low, high in zip(values, values[1:]):
            left = x[:, f] <= (low / 2 + high / 2)
            if min(left.sum(), (~left).sum()) < min_leaf:
                continue
            cost = 0.0
            for side in (left, ~left):
                p, q = weights[0] * (y[side] == 0).sum(), weights[1] * (y[side] == 1).sum()
                cost += (p + q) * impurity(criterion, p, q)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, f, low / 2 + high / 2, left)
    if best is None:
        return b / (a + b)
    _, f, threshold, left = best
    below = None if depth is None else depth - 1
    return f, threshold, *(exhaustive(x[s], y[s], criterion, below, min_leaf, min_split, weights) for s in (left, ~left))


def nested(tree, node=0):
    if tree.left[node] < 0:
        return float(tree.value[node])
    return int(tree.feature[node]), float(tree.threshold[node]), nested(tree, tree.left[node]), nested(tree, tree.right[node])


def same(a, b):
    if isinstance(a, tuple) != isinstance(b, tuple):
        return False
    if not isinstance(a, tuple):
        return a == pytest.approx(b)
    return a[0] == b[0] and a[1] == pytest.approx(b[1]) and same(a[2], b[2]) and same(a[3], b[3])


def some_rows(n=150, seed=2):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), np.zeros(n), rng.normal(size=n).round(1)])
    return x, (x[:, 0] + x[:, 1] / 3 + rng.normal(size=n) > 0.5).astype(int)


LIMITS = [
    {}, {"criterion": "entropy"}, {"depth": 3}, {"min_leaf": 7}, {"min_split": 20, "criterion": "entropy"},
    {"weights": (1.0, 3.5), "depth": 4, "min_leaf": 3}, {"weights": (2.0, 0.5), "min_split": 11},
]


@pytest.mark.parametrize("limits", LIMITS, ids=str)
def test_numpy_trees_are_exhaustive(limits):
    x, y = some_rows()
    options = {("max_depth" if k == "depth" else k): v for k, v in limits.items()}
    nodes = grow.grow_node(x, y, np.ones(len(y), int), grow.TreeSpec(0, **options))
    assert same(nested(trees.Tree(**nodes)), exhaustive(x, y, **limits))


@pytest.fixture(scope="module")
def noisy(spark):
    x, y = some_rows(500, 4)
    return labelled(spark, x, y, np.arange(500) % 3)


def tables(spark, noisy, specs):
    """The same trees by the numpy way, by levels of Spark down to small nodes, and by levels only."""
    base = grow.prepared(noisy)
    ways = [{}, {"table_bytes": 0, "node_rows": 60}, {"table_bytes": 0, "node_rows": 0}, {"table_bytes": 0}]
    return [{r.tree: trees.tree_of(r) for r in grow.grown(base, specs, **w).collect()} for w in ways]


def test_levels_of_spark_grow_the_same_trees(spark, noisy, tiny_ranges):
    specs = [
        grow.TreeSpec(0, max_depth=4), grow.TreeSpec(3, "entropy", min_leaf=4, max_depth=5, weights=(1.0, 2.0)), grow.TreeSpec(5, min_split=90, without=1, max_depth=6),
        *[grow.TreeSpec(10 + i, tries=2, sampled=True, seed=i, max_depth=4, min_leaf=2) for i in range(3)],
    ]
    whole, *others = tables(spark, noisy, specs)
    assert sorted(whole) == [s.tree for s in specs]
    for other in others:
        for number, tree in whole.items():
            assert same(nested(tree), nested(other[number]))
            again = other[number]
            assert (again.left[again.left >= 0] > np.flatnonzero(again.left >= 0)).all()
            assert sorted(zip(tree.rows, tree.cover, tree.impurity.round(9))) == sorted(zip(again.rows, again.cover, again.impurity.round(9)))
    assert whole[5].rows[0] == 500 - 167 and len({str(nested(whole[10 + i])) for i in range(3)}) == 3


def test_unlimited_trees_separate_all_rows(spark):
    rng = np.random.default_rng(3)
    x = np.arange(3000.0)
    y = rng.integers(0, 2, 3000)
    df = labelled(spark, x, y)
    model = train.fit_tree(df, class_weight=None)
    assert train.tree_shape(spark, model).first()["depth"] > 10
    assert model.transform(df).filter("prediction <> label").count() == 0
    chain = np.tile([0, 1], 100)  # one row splits off at every level
    deep = train.fit_tree(labelled(spark, 1.5 ** np.arange(200), chain), class_weight=None, min_leaf=1)
    assert deep.numNodes == 399


def test_samples_hold_each_row_once_on_average():
    spec = grow.TreeSpec(0, sampled=True, seed=5)
    counts = grow.draws(np.arange(100_000), spec)
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.05 and abs((counts == 0).mean() - math.exp(-1)) < 0.01
    assert not np.array_equal(counts, grow.draws(np.arange(100_000), grow.TreeSpec(0, sampled=True, seed=6)))


def test_drawn_features_vary_and_number_as_asked():
    varied = np.array([[True, True, False, True], [False, False, True, False], [False] * 4])
    marks = grow.drawn_features(np.array([1, 2, 3], np.uint64), varied, 2)
    assert marks.sum(axis=1).tolist() == [2, 1, 0] and not (marks & ~varied).any()


@pytest.mark.parametrize("size", [19, 20])
def test_lone_row_is_split_off_only_from_twenty(spark, size):
    df = labelled(spark, range(size), [1.0] + [0.0] * (size - 1))
    model = train.fit_tree(df, class_weight=None, min_split=20)
    assert model.numNodes == (3 if size == 20 else 1)
    scores = {r["features"][0]: r["prediction"] for r in model.transform(df).collect()}
    assert scores[0.0] == (1.0 if size == 20 else 0.0) and scores[1.0] == 0.0


def test_cut_trees_are_the_grown_ones(spark, noisy):
    space = {"max_depth": [2, 4, None], "min_split": [2, 40, 400], "class_weight": ["balanced", None], "criterion": ["gini", "entropy"], "alpha": [0.0, 0.01]}
    for metric in ("roc_auc", "f2"):
        found = train.grid_search(noisy, "tree", space, metric)
        assert len(found.scores) == 72
        for s in found.scores[:: 23 if metric == "f2" else 13]:
            params = dict(s["params"])
            alpha = params.pop("alpha")
            if not alpha:
                assert s["score"] == pytest.approx(np.mean(train.fold_scores(noisy, "tree", params, metric)), abs=1e-9)
                continue
            direct = []
            for fold in range(3):
                model = train.fit_params(noisy.filter(F.col("fold") != fold), "tree", {k: v for k, v in params.items()})
                held = explain.pruned_scores(model, noisy.filter(F.col("fold") == fold), [alpha])
                direct.append((train.roc_auc(held) if metric == "roc_auc" else train.f2_by(held, ("alpha",))).first()[metric])
            if params["class_weight"] is None:  # balanced weights are those of all folds in a search
                assert s["score"] == pytest.approx(np.mean(direct), abs=1e-9)


def test_first_trees_are_the_smaller_forest(spark, noisy):
    params = [{"trees": k, "max_depth": 4, "feature_share": 0.5, "class_weight": "balanced"} for k in (3, 8, 20)]
    together = train.search(noisy, "forest", params, "roc_auc")
    for p, s in zip(params, together.scores):
        assert s["score"] == pytest.approx(np.mean(train.fold_scores(noisy, "forest", p)), abs=1e-12)
    small, large = (explain.load_trees(train.fit_forest(noisy, trees=k, max_depth=3)) for k in (2, 5))
    assert [nested(t) for t in small] == [nested(t) for t in large[:2]]


def test_blocks_of_trees_add_up(spark, noisy, monkeypatch):
    model = train.fit_forest(noisy, trees=7, max_depth=4)
    x = np.array([r["features"].toArray() for r in noisy.collect()])
    mean = np.mean([t.value[t.leaves_of(x)] for t in explain.load_trees(model)], axis=0)
    keyed = noisy.withColumn("id", F.monotonically_increasing_id())
    whole = [explain.tree_contributions(model, keyed, "id"), explain.tree_disagreement(model, noisy), model.transform(keyed).select("id", "probability")]
    want = [sorted(map(str, df.collect())) for df in whole[1:2]]
    parts = {r["id"]: r for r in whole[0].collect()}
    monkeypatch.setattr(trees, "BLOCK_NODES", 40)
    assert len(list(model.blocks())) > 2
    assert sorted(float(r["probability"][1]) for r in model.transform(noisy).collect()) == pytest.approx(sorted(mean))
    assert [sorted(map(str, explain.tree_disagreement(model, noisy).collect()))] == want
    for r in explain.tree_contributions(model, keyed, "id").collect():
        assert r["probability"] == pytest.approx(parts[r["id"]]["probability"]) and r["contributions"] == pytest.approx(parts[r["id"]]["contributions"])


def test_pruning_intervals_are_the_levels(spark, noisy):
    model = train.fit_tree(noisy, max_depth=6)
    tree = explain.load_trees(model)[0]
    alphas, closed = explain.pruning_order(tree)
    intervals = explain.leaf_intervals(tree, alphas, closed)
    assert len(intervals) <= (tree.left < 0).sum() * (tree.depth.max() + 1)
    for level, alpha in enumerate(alphas):
        cut = trees.cut_tree(tree, closed <= alpha)
        owner = trees.stands_for(tree, cut)
        now = {leaf: (score, depth) for leaf, low, high, score, depth, _ in intervals if low <= level < high}
        assert now == {int(n): (float(tree.value[owner[n]]), int(tree.depth[owner[n]])) for n in np.flatnonzero(tree.left < 0)}
        assert sum(counts for _, low, high, _, _, counts in intervals if low <= level < high) == ((cut.left < 0) & np.isin(np.arange(len(cut.left)), owner)).sum()


def test_importance_finds_the_feature(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=2000), rng.normal(size=2000)
    df = spark.createDataFrame([(float(p), float(q), int(p > 0.3)) for p, q in zip(a, b)], "a double, b double, y int")
    found = {r["feature"]: r["importance"] for r in importance.forest_importance(df, ["a", "b"], "y", trees=10).collect()}
    assert found["a"] > 0.7 and sum(found.values()) == pytest.approx(1)


def test_no_row_is_written_while_large_nodes_are_split(spark, noisy, monkeypatch):
    base, written, write = grow.prepared(noisy), [], grow.stage
    monkeypatch.setattr(grow, "stage", lambda df: written.append(write(df)) or written[-1])
    specs = [grow.TreeSpec(i, max_depth=3, sampled=True, seed=i) for i in range(4)]
    found = grow.grown(base, specs, table_bytes=0, node_rows=60)
    assert found.count() == 4 and sum(df.count() for df in written) == 4


def test_ranges_are_narrowed_in_two_steps(spark, monkeypatch):
    x, y = some_rows(400, 7)
    base = grow.prepared(labelled(spark, x, y, np.arange(400) % 3))
    specs = [grow.TreeSpec(0, max_depth=3), grow.TreeSpec(1, "entropy", min_leaf=9, max_depth=3, without=2), grow.TreeSpec(2, sampled=True, tries=2, max_depth=3)]
    whole = {r.tree: nested(trees.tree_of(r)) for r in grow.grown(base, specs).collect()}
    monkeypatch.setattr(grow, "EXACT_ROWS", 0)
    monkeypatch.setattr(grow, "CHUNK_ROWS", 64)
    for r in grow.grown(base, specs, table_bytes=0, node_rows=20).collect():
        assert same(nested(trees.tree_of(r)), whole[r.tree])


def test_dealt_rows_take_fewer_bytes_than_their_values():
    rng = np.random.default_rng(5)
    n = 20_000
    columns = [rng.integers(0, 10**7, n) / 100, rng.integers(0, 5, n).astype(float), rng.choice(rng.normal(size=3000), n)]
    rows = pd.DataFrame({f"x{i}": c for i, c in enumerate(columns)}).assign(label=rng.integers(0, 2, n), fold=-1, row=np.arange(n))
    tops = [grow.Top(grow.TreeSpec(0, sampled=True, seed=3))]
    shared = SimpleNamespace(value=(tops, {0: [0]}))
    dealt = pd.concat(grow._deal(shared, 3)(iter([rows])))
    size = sum(len(pa.compress(c, "lz4", asbytes=True)) for cells in dealt["cells"] for c in cells)
    kept = len(dealt["marks"].iloc[0])
    assert 0.62 * n < kept < 0.65 * n and size + 8 * sum(len(v) for vs in dealt["values"] for v in vs) < 11 * kept  # 17 as values
    grown = grow._finish(shared, 3)(dealt).iloc[0]
    want = grow.grow_node(np.stack(columns, axis=1), rows["label"].to_numpy(), grow.draws(np.arange(n), tops[0].spec), tops[0].spec)
    for name in grow.NODE_FIELDS:
        assert np.array_equal(grown[name], want[name]), name


def test_trees_grown_together_are_those_grown_alone():
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(size=500), rng.integers(0, 5, 500).astype(float), rng.integers(0, 70, 500).astype(float)], axis=1)
    y, table = (rng.random(500) < 0.4).astype(np.int32), grow.Coded.of(x.T)
    limits = [(9, 2, 2), (4, 2, 2), (None, 1, 30), (9, 8, 2), (6, 5, 12)]
    for seed, scale in ((1, 1), (2, 300)):  # many draws of a row take another way of counting
        specs = [grow.TreeSpec(0, max_depth=d, min_leaf=m, min_split=s, tries=2, sampled=True, seed=seed, weights=(1.0, 1.7)) for d, m, s in limits]
        count = scale * grow.draws(np.arange(500), specs[0])
        together = grow.grow_variants(table, y, count, specs)
        alone = [grow.grow_coded(table, y, count, s) for s in specs]
        for a, b in zip(together, alone):
            assert nested(trees.Tree(**a)) == nested(trees.Tree(**b))
        assert len(together[0]["left"]) < sum(len(b["left"]) for b in alone)


def test_counts_of_many_draws_stay_exact():
    mark, key = np.array([3, 2, 255, 7], np.uint8), np.array([0, 1, 1, 0])
    for counts in (grow.Counts.of(mark, 132), grow.Counts.of(mark, 1 << 26)):
        zeros, ones = counts.both(counts.sums(key, mark, 3))
        assert zeros.tolist() == [0, 1, 0] and ones.tolist() == [4, 127, 0]
        assert counts.packed(mark).tolist() == counts.sums(np.arange(4), mark, 4).tolist()


def test_values_that_need_several_numbers_for_a_row():
    """More bits than one number of 64 holds: every feature's cuts are still found."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 300, (400, 9)).astype(float)
    y = (x[:, 8] + x[:, 1] / 2 + rng.normal(0, 60, 400) > 220).astype(int)
    table = grow.Coded.of(x.T)
    assert len(grow.Layout.of(table, np.arange(400), np.ones(400, np.int64))[1]) == 2
    for limits in ({"max_depth": 3}, {"max_depth": 3, "min_leaf": 20, "criterion": "entropy"}):
        nodes = grow.grow_coded(table, y, np.ones(400, int), grow.TreeSpec(0, **limits))
        want = exhaustive(x, y, limits.get("criterion", "gini"), 3, limits.get("min_leaf", 1))
        assert same(nested(trees.Tree(**nodes)), want)


def test_growing_takes_few_bytes_for_each_row(monkeypatch):
    """Rows of a node are looked at in parts: what a tree takes beside its table stays below 80 bytes a row."""
    monkeypatch.setattr(grow, "SLICE_ROWS", 1 << 14)
    rng = np.random.default_rng(7)
    n = 300_000
    values = [np.arange(k, dtype=float) for k in (n, 5, 12, n)]
    table = grow.Coded(values, [rng.integers(0, len(v), n).astype(grow.narrow(len(v))) for v in values])
    y = rng.integers(0, 2, n).astype(np.uint8)
    tracemalloc.start()
    grow.grow_coded(table, y, np.ones(n, np.uint8), grow.TreeSpec(0, max_depth=4))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 80 * n


def test_rows_are_not_dealt_to_each_tree_of_a_table_that_fits_a_task(spark, noisy, monkeypatch):
    """Each task gets a copy of the table, whatever the number of trees, and no two trees are staged by one task."""
    base = grow.prepared(noisy)
    specs = [grow.TreeSpec(i, "entropy" if i % 3 else "gini", sampled=i % 2 > 0, tries=2, seed=i, max_depth=4, without=i % 4) for i in range(40)]
    whole = {r.tree: nested(trees.tree_of(r)) for r in grow.grown(base, specs).collect()}
    monkeypatch.setattr(grow, "_deal", lambda *a: pytest.fail("rows were dealt to trees"))
    monkeypatch.setattr(grow, "COPY_ROWS", 90)
    model = grow.grown(base, specs, table_bytes=0)
    assert max(model.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) == 1
    found = {r.tree: nested(trees.tree_of(r)) for r in model.collect()}
    assert sorted(found) == sorted(whole) and all(same(found[t], whole[t]) for t in whole)
