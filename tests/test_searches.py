"""Searches fitted together against single fits, and exact small-sample p-values against enumeration."""

import math
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from wardlight.functions import tails
from wardlight.models import evaluate, forests, grow, lasso, train, trees
from wardlight.operators import association, ordered


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.logistic(size=600) > 0.3).astype(float)
    data = [(float(b), Vectors.dense(a.tolist()), i % 3) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, ["label", "features", "fold"])


@pytest.mark.parametrize("cells", [10, 4_000_000])
def test_models_fitted_together_are_those_fitted_alone(spark, rows, monkeypatch, cells):
    monkeypatch.setattr(lasso, "CELLS", cells * 5)
    base = grow.prepared(rows)
    weights = {None: (1.0, 1.0), "balanced": train.both_weights(rows, "balanced")}
    cases = [(c, w) for c in (0.003, 0.02, 0.1, 1.0) for w in weights]
    found = lasso.fit_many(base, [lasso.LassoSpec(c, weights[w]) for c, w in cases], 4)
    for (c, w), got in zip(cases, found):
        model = train.fit_l1_logistic(rows, c, w)
        assert got == pytest.approx([*model.coefficients.toArray(), model.intercept], abs=1e-3)


def test_logistic_grid_scores_are_those_of_single_folds(spark, rows):
    space = {"c": [0.01, 0.2], "class_weight": ["balanced", {0: 1.0, 1: 5.0}]}
    for metric in ("roc_auc", "f2"):
        found = train.grid_search(rows, "logistic", space, metric)
        assert len(found.scores) == 4 and found.best["params"]["c"] == 0.2 or metric == "f2"
        for s in found.scores[:2]:
            assert s["score"] == pytest.approx(np.mean(train.fold_scores(rows, "logistic", s["params"], metric)), abs=1e-6)


def test_logistic_search_writes_no_scored_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(train, "stage", lambda df: pytest.fail("scores of every model were written"))
    for metric in ("roc_auc", "f2"):
        train.grid_search(rows, "logistic", {"c": [0.2]}, metric)


@pytest.mark.parametrize("range_rows", [9, 1000])
def test_area_from_packed_scores(spark, monkeypatch, range_rows):
    for name, value in (("RANGE_ROWS", range_rows), ("POINT_ROWS", 4), ("CHUNK_ROWS", 20)):
        monkeypatch.setattr(lasso, name, value)
    rng = np.random.default_rng(4)
    data = [(None if i % 11 == 0 else float(rng.integers(0, 2)), Vectors.dense([float(rng.integers(0, 9)), 1.0]), i % 2) for i in range(150)]
    base = grow.prepared(spark.createDataFrame(data, ["label", "features", "fold"]).repartition(3))
    specs = [lasso.LassoSpec(1.0, without=f) for f in (0, 1, 0)]
    at = np.array([[0.3, 0.1, -1.0], [-0.2, 0.0, 0.5], [0.0, 0.0, 0.0]])
    want = {r["model"]: r["roc_auc"] for r in evaluate.roc_auc(lasso.held_out_scores(base, specs, at), ("model",)).collect()}
    got = {r["model"]: r["roc_auc"] for r in lasso.held_out_auc(base, specs, at).collect()}
    assert got == pytest.approx(want, abs=1e-12) and got[2] == 0.5


FORESTS = {"trees": (3, 9), "max_depth": (2, 7), "feature_share": (0.1, 0.9), "min_leaf": (1, 9), "min_split": (2, 12), "class_weight": ["balanced", {0: 1.0, 1: 3.0}]}


@pytest.mark.parametrize("metric", ["f2", "roc_auc"])
def test_forests_are_scored_where_they_grow(rows, monkeypatch, metric):
    drawn = train.draw(FORESTS, 7, 3)
    with monkeypatch.context() as m:
        m.setattr(grow, "TABLE_BYTES", 0)
        want = train.search(rows, "forest", drawn, metric)
    monkeypatch.setattr(train, "grown", lambda *a: pytest.fail("the trees of all candidates were kept"))
    monkeypatch.setattr(forests, "PIECE_ROWS", 70)
    for jobs in (1, 40):
        monkeypatch.setattr(forests, "CORE_JOBS", jobs)
        found = train.search(rows, "forest", drawn, metric)
        assert [s["score"] for s in found.scores] == pytest.approx([s["score"] for s in want.scores], abs=1e-4)
    with pytest.raises(ValueError, match="alpha"):
        train.search(rows, "forest", [{"alpha": 0.1}], metric)


@pytest.mark.parametrize("metric", ["f2", "roc_auc"])
def test_forests_of_a_table_that_fits_a_task_are_scored_where_they_grow(rows, monkeypatch, metric):
    """Also where the table is too large for every task: trees are neither kept nor shuffled, and halving goes on."""
    drawn = train.draw(FORESTS, 7, 3)
    want = train.search(rows, "forest", drawn, metric)
    space = {k: v for k, v in FORESTS.items() if k != "trees"}
    halved = train.halving_search(rows, space, 5, low=2, high=8, metric=metric)
    monkeypatch.setattr(grow, "TABLE_BYTES", 0)
    monkeypatch.setattr(train, "grown", lambda *a: pytest.fail("the trees of all candidates were kept"))
    monkeypatch.setattr(forests, "PIECE_ROWS", 70)
    monkeypatch.setattr(grow, "COPY_ROWS", 55)
    found = train.search(rows, "forest", drawn, metric)
    assert [s["score"] for s in found.scores] == pytest.approx([s["score"] for s in want.scores], abs=1e-9 if metric == "f2" else 1e-4)
    again = train.halving_search(rows, space, 5, low=2, high=8, metric=metric)
    assert [s["params"] for s in again.scores] == [s["params"] for s in halved.scores]


def test_rows_go_once_down_what_trees_share():
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(size=600), rng.integers(0, 5, 600).astype(float), rng.integers(0, 70, 600).astype(float)], axis=1)
    y, table = (rng.random(600) < 0.4).astype(np.int32), grow.Coded.of(x.T)
    limits = [(9, 2, 2), (4, 2, 2), (None, 1, 30), (9, 8, 2), (6, 5, 12), (0, 1, 2), (9, 40, 2)]
    specs = [grow.TreeSpec(i, max_depth=d, min_leaf=m, min_split=s, tries=2, sampled=True, seed=4) for i, (d, m, s) in enumerate(limits)]
    grown = [trees.Tree(**g) for g in grow.grow_variants(table, y, grow.draws(np.arange(600), specs[0]), specs)]
    assert any((a.left >= 0).sum() and (a.left[b.left >= 0] != b.left[b.left >= 0]).any() for a in grown for b in grown)
    other = np.concatenate([x + rng.normal(0, 0.3, x.shape), x])
    for values, tree in zip(forests.leaf_values(other, grown), grown):
        assert np.array_equal(values, tree.value[tree.leaves_of(other)])


def test_halving_goes_on_from_the_trees_it_has(rows, monkeypatch):
    grown, votes = [], forests.held_out_votes
    space = {k: v for k, v in FORESTS.items() if k != "trees"}
    with monkeypatch.context() as m:
        m.setattr(grow, "TABLE_BYTES", 0)
        want = train.halving_search(rows, space, 5, low=2, high=8)

    def watched(base, more, folds):
        grown.append([(f.first, f.size) for f in more])
        return votes(base, more, folds)

    monkeypatch.setattr(forests, "held_out_votes", watched)
    found = train.halving_search(rows, space, 5, low=2, high=8)
    assert grown == [[(0, 2)] * 5, [(2, 4)] * 3, [(4, 8)] * 2]
    assert [s["params"] for s in found.scores] == [s["params"] for s in want.scores]
    assert [s["score"] for s in found.scores] == pytest.approx([s["score"] for s in want.scores], abs=1e-9)


def test_separable_rows_stay_finite(spark):
    data = [(float(i > 5), Vectors.dense([float(i), 1.0]), 0) for i in range(12)]
    base = grow.prepared(spark.createDataFrame(data, ["label", "features", "fold"]))
    found = lasso.fit_many(base, [lasso.LassoSpec(100.0), lasso.LassoSpec(0.001)], 2)
    assert np.isfinite(found).all() and found[0, 0] > 0 and found[1, 0] == 0


def test_distance_p_by_enumeration():
    for n1, n2 in [(1, 1), (2, 5), (4, 4), (3, 6)]:
        seen = []
        for first in combinations(range(n1 + n2), n1):
            marks = np.zeros(n1 + n2)
            marks[list(first)] = 1
            seen.append(np.abs(np.cumsum(marks) / n1 - np.cumsum(1 - marks) / n2).max())
        for d in set(np.round(seen, 12)):
            assert tails.smirnov_sf(d, n1, n2) == pytest.approx(np.mean(np.array(seen) >= d - 1e-9))
    assert tails.smirnov_sf(0.0, 3, 4) == 1.0
    assert tails.smirnov_sf(1.0, 200, 300) == pytest.approx(2 / math.comb(500, 200), rel=1e-6)
    assert tails.smirnov_sf(0.05, 3000, 2000) == pytest.approx(tails.kolmogorov_sf(0.05 * math.sqrt(1200)), rel=0.1)


def test_inversion_counts_by_enumeration():
    for n in range(1, 7):
        found = [sum(p[i] > p[j] for i, j in combinations(range(n), 2)) for p in permutations(range(n))]
        for k in range(n * (n - 1) // 2 + 1):
            assert tails.inversions_at_most(n, k) == pytest.approx(np.mean(np.array(found) <= k))
    assert tails.inversions_at_most(10**6, 1) == 0.0


def test_kendall_p(spark):
    values = [3.0, 1.0, 4.0, 1.5, 9.0, 2.6]
    df = spark.createDataFrame([(float(i), v, float(i // 2)) for i, v in enumerate(values)], "a double, b double, c double")
    got = {(r.feature_a, r.feature_b): r for r in association.kendall_test(df, ["a", "b", "c"]).collect()}
    swaps = sum(p > q for p, q in combinations(values, 2))
    orders = [sum(p > q for p, q in combinations(o, 2)) for o in permutations(range(6))]
    few = min(swaps, 15 - swaps)
    assert got["a", "b"].p == pytest.approx(min(1.0, 2 * np.mean(np.array(orders) <= few)))
    # with ties: the variance of net under all orders of one side, as the normal approximation takes it
    net = [sum(np.sign((o[i] - o[j]) * (i // 2 - j // 2)) for i, j in combinations(range(6), 2)) for o in permutations(range(6))]
    seen = sum(np.sign((values[i] - values[j]) * (i // 2 - j // 2)) for i, j in combinations(range(6), 2))
    assert got["b", "c"].p == pytest.approx(2 * tails.normal_sf(abs(seen) / np.std(net)))


def test_offsets_in_several_digits(spark, monkeypatch):
    monkeypatch.setattr(ordered, "OFFSET_BITS", 2)
    data = [(k, r, float(n)) for k in "ab" for r, n in zip([0, 1, 3, 4, 9, 17, 40, 63], range(1, 9))]
    df = spark.createDataFrame(data, "k string, range long, n double")
    want = sorted(map(tuple, ordered.range_offsets(df, ["k"], ["n"]).collect()))
    for depth in (2, 3):
        assert sorted(map(tuple, ordered.range_offsets(df, ["k"], ["n"], depth=depth).collect())) == want


def test_kendall_with_many_ranks(spark, monkeypatch):
    monkeypatch.setattr(association, "RANGE_VALUES", 2)
    monkeypatch.setattr(association, "OFFSET_BITS", 2)
    monkeypatch.setattr(ordered, "OFFSET_BITS", 2)
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=300).round(2), rng.normal(size=300)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "a double, b double")
    n0 = 300 * 299 / 2
    ties = sum(c * (c - 1) / 2 for c in np.unique(x, return_counts=True)[1])
    net = sum(np.sign((x[i] - x[j]) * (y[i] - y[j])) for i, j in combinations(range(300), 2))
    assert association.corr_kendall(df, ["a", "b"]).first()["correlation"] == pytest.approx(net / math.sqrt((n0 - ties) * n0))
