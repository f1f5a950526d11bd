"""Splits, metrics, searches and explanations."""

import math
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.models import evaluate, explain, prep, select, train
from wardlight.session import stage

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3)).round(2)
    y = ((x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) * 0.5) > 0).astype(int)
    data = pd.DataFrame(x, columns=FEATURES).assign(id=np.arange(400), label=y)
    df = prep.stratified_folds(spark.createDataFrame(data), "label", "id", 2)
    df = prep.stratified_split(df, "label", "id", {"validation": 0.3, "train": 0.7}, split="part")
    return stage(prep.assemble(df, FEATURES))


def test_split_is_exact_disjoint_and_independent_of_partitioning(spark):
    df = spark.range(1000).select("id", (F.col("id") % 4 == 0).cast("int").alias("label"))
    parts = {"test": 0.2, "validation": 0.16, "train": 0.64}
    one = {r["id"]: r["split"] for r in prep.stratified_split(df, "label", "id", parts).collect()}
    two = {r["id"]: r["split"] for r in prep.stratified_split(df.repartition(7), "label", "id", parts).collect()}
    assert one == two and len(one) == 1000
    counts = pd.Series(one).groupby([lambda i: i % 4 == 0, one]).size()
    assert counts[True].to_dict() == {"test": 50, "validation": 40, "train": 160}
    assert counts[False].to_dict() == {"test": 150, "validation": 120, "train": 480}


def test_folds_are_even(spark):
    df = spark.range(103).select("id", F.lit(1).alias("label"))
    sizes = prep.stratified_folds(df, "label", "id", 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in sizes) == [20, 20, 21, 21, 21]


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, 2.0)], "k double, x double")
    scaled = prep.standardize(df, [], ["k", "x"])[0].collect()
    assert [(r["k"], r["x"]) for r in scaled] == [(0.0, -1.0), (0.0, 1.0)]
    assert sorted((r["k"], r["x"]) for r in prep.min_max(df, ["k", "x"]).collect()) == [(0.0, 0.0), (0.0, 1.0)]


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 3 + [(1,)], "label int")
    assert prep.class_weights(df, "label") == {0: pytest.approx(4 / 6), 1: pytest.approx(2.0)}
    explicit = prep.with_class_weight(df, "label", {0: 1.0, 1: 5.0}).agg(F.sum("weight")).first()[0]
    assert explicit == 8.0


def test_report_without_predicted_positives(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.2)], "label int, score double")
    got = {r["class"]: r for r in evaluate.classification_report(df).collect()}
    assert got["1"]["precision"] == got["1"]["f1"] == got["1"]["f2"] == 0.0
    assert got["accuracy"]["f1"] == 0.5


def test_auc_matches_pairs(spark, tiny_ranges):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 60), rng.integers(0, 8, 60) / 8
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    wins = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(np.mean(wins))
    curve = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_curve(df).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(curve, curve[1:]))
    assert area == pytest.approx(np.mean(wins)) and curve[0] == (0.0, 0.0) and curve[-1] == (1.0, 1.0)


def test_sweep_and_pick(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.55), (1, 0.5), (0, 0.2)], "label int, score double")
    sweep = evaluate.threshold_sweep(df, 0.3, 0.8, 0.1)
    assert [r["errors"] for r in sweep.orderBy("threshold").collect()] == [1, 1, 1, 1, 1, 1]
    assert evaluate.pick_threshold(sweep).first()["threshold"] == pytest.approx(0.3)
    assert evaluate.pick_threshold(sweep, "precision", target_precision=0.99).first()["threshold"] == pytest.approx(0.6)
    assert evaluate.pick_threshold(sweep, "precision", target_precision=2.0).first()["threshold"] == pytest.approx(0.6)
    assert evaluate.pick_threshold(sweep, "combined", min_f1=0.99).first()["threshold"] == pytest.approx(0.3)
    both = evaluate.sweep_both(df, df, low=0.3, high=0.8, step=0.1)
    assert both.filter("abs(f1 - f1_tr) > 0").count() == 0


def test_logistic_and_coefficients(spark, rows):
    model = train.fit_l1_logistic(rows, 1.0)
    table = {r["feature"]: r["coefficient"] for r in select.coefficient_table(spark, model, FEATURES).collect()}
    assert table["a"] > table["b"] > 0
    summary = select.coefficient_summary(select.coefficient_table(spark, model, FEATURES), 3).first()
    assert summary["positive"] + summary["negative"] == summary["non_zero"]
    assert summary["equation"].startswith("log(p / (1 - p)) = ") and " * a" in summary["equation"]
    reduced, kept = select.drop_weakest(rows, model, FEATURES, 1)
    assert kept == ["a", "b"] and len(reduced.coefficients) == 2
    # a penalty this strong leaves nothing but the intercept
    assert not train.fit_l1_logistic(rows, 1e-4).coefficients.toArray().any()


def test_searches_are_repeatable(spark, rows):
    space = {"max_depth": [1, 3], "class_weight": ["balanced", {0: 1.0, 1: 2.0}]}
    found = train.grid_search(rows, "tree", space, "f2")
    assert len(found.scores) == 4
    direct = np.mean(train.fold_scores(rows, "tree", found.scores[0]["params"], "f2"))
    assert found.scores[0]["score"] == pytest.approx(direct)
    assert train.draw({"n": (1, 9), "x": (0.1, 0.9), "c": ["u", "v"]}, 4, 7) == train.draw({"n": (1, 9), "x": (0.1, 0.9), "c": ["u", "v"]}, 4, 7)
    halved = train.halving_search(rows, {"max_depth": (1, 4)}, 4, low=1, high=4)
    assert halved.best["params"]["trees"] == 4
    keep, history = select.rfe_cv(rows, "tree", {"max_depth": 2}, FEATURES, step=0.34, metric="roc_auc")
    assert "a" in keep and [len(h["features"]) for h in history] == [3, 2, 1]


def shapley(tree, x):
    """Direct Shapley values of the game that averages over unknown features by cover."""

    def value(node, known):
        if tree.left[node] < 0:
            return tree.value[node]
        f = tree.feature[node]
        kids = tree.left[node], tree.right[node]
        if f in known:
            return value(kids[0] if x[f] <= tree.threshold[node] else kids[1], known)
        return sum(tree.cover[k] * value(k, known) for k in kids) / tree.cover[node]

    d = len(x)
    out = np.zeros(d)
    for j in range(d):
        others = [i for i in range(d) if i != j]
        for size in range(d):
            weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
            for group in combinations(others, size):
                out[j] += weight * (value(0, {*group, j}) - value(0, set(group)))
    return out


def test_contributions_are_shapley_values(spark, rows):
    model = train.fit_forest(rows, trees=3, max_depth=4, feature_share="all")
    explained = explain.tree_contributions(model, rows, "id").collect()
    truth = {r["id"]: r["probability"][1] for r in model.transform(rows).select("id", "probability").collect()}
    assert all(r["probability"] == pytest.approx(truth[r["id"]], abs=1e-9) for r in explained)
    assert all(r["base"] + sum(r["contributions"]) == pytest.approx(r["probability"]) for r in explained)
    trees = explain.load_trees(model)
    features = {r["id"]: r["features"].toArray() for r in rows.select("id", "features").collect()}
    for r in explained[:5]:
        want = np.mean([shapley(t, features[r["id"]]) for t in trees], axis=0)
        assert r["contributions"] == pytest.approx(list(want), abs=1e-9)
    frame = explain.tree_contributions(model, rows, "id")
    assert explain.mean_contributions(frame, FEATURES).first()["feature"] == "a"
    top = explain.top_contributions(frame, FEATURES, "id", 2)
    assert top.count() == 800 and explain.long_contributions(frame, FEATURES, "id").count() == 1200


def test_pruning_path(spark, rows):
    model = train.fit_tree(rows, max_depth=5)
    tree = explain.load_trees(model)[0]
    alphas, closed = explain.pruning_order(tree)
    assert (np.diff(alphas) > 0).all()
    risk = tree.impurity * tree.cover / tree.cover[0]

    def cost(node, alpha):
        """Smallest penalised risk of any pruning of the subtree."""
        if tree.left[node] < 0:
            return risk[node] + alpha
        return min(risk[node] + alpha, cost(tree.left[node], alpha) + cost(tree.right[node], alpha))

    def pruned(node, alpha):
        if tree.left[node] < 0 or closed[node] <= alpha:
            return risk[node] + alpha
        return pruned(tree.left[node], alpha) + pruned(tree.right[node], alpha)

    for alpha in [*alphas, *(alphas[:-1] + alphas[1:]) / 2]:
        assert pruned(0, alpha) == pytest.approx(cost(0, alpha))
    path = explain.prune_path(model, rows)
    full = path.filter("level = 0 and part = 'validation'").first()
    held = rows.filter("part = 'validation'")
    scored = evaluate.probability(model.transform(held))
    assert full["roc_auc"] == pytest.approx(evaluate.roc_auc(scored).first()[0])
    report = {r["class"]: r for r in evaluate.classification_report(scored).collect()}
    assert full["accuracy"] == pytest.approx(report["accuracy"]["f1"], abs=0.02)
    assert explain.best_level(path).count() == 1


def test_representative_tree(spark, rows):
    model = train.fit_forest(rows, trees=5, max_depth=3)
    trees = explain.load_trees(model)
    x = np.stack([r["features"].toArray() for r in rows.select("features").collect()])
    said = np.stack([(t.value[t.leaves_of(x)] > 0.5).astype(float) for t in trees])
    want = (said != np.round(said.mean(axis=0))).mean(axis=1)
    got = explain.representative_tree(model, rows).first()
    assert got["tree"] == int(np.argmin(want)) and got["disagreement"] == pytest.approx(want.min())


def plain_lowess(x: np.ndarray, y: np.ndarray, fraction: float = 0.3, rounds: int = 3) -> np.ndarray:
    """Locally weighted linear smoothing with robustness rounds; ``x`` must be sorted."""
    n = len(x)
    k = min(n, max(2, int(fraction * n + 1e-10)))
    robust = np.ones(n)
    fitted = y.astype(float).copy()
    for step in range(rounds + 1):
        start = 0
        for i in range(n):
            while start + k < n and x[i] - x[start] > x[start + k] - x[i]:
                start += 1
            window = slice(start, start + k)
            reach = max(x[i] - x[start], x[start + k - 1] - x[i])
            gap = np.abs(x[window] - x[i])
            w = np.where(gap <= 0.999 * reach, (1 - (gap / reach) ** 3) ** 3, 0.0) if reach > 0 else np.ones(k)
            w = w * robust[window]
            total = w.sum()
            if total <= 0:
                fitted[i] = y[i]
                continue
            w = w / total
            centre = w @ x[window]
            spread = w @ (x[window] - centre) ** 2
            tilt = (x[i] - centre) * (w * (x[window] - centre)) / spread if spread > 1e-12 * (1 + np.ptp(x)) ** 2 else 0.0
            fitted[i] = (w + tilt) @ y[window]
        if step < rounds:
            residual = np.abs(y - fitted)
            residual[residual <= 1e-12 * np.abs(y).max()] = 0.0  # rounding noise of an exact fit
            scale = 6 * np.median(residual)
            if scale > 0:
                robust = np.where(residual < scale, (1 - (residual / scale) ** 2) ** 2, 0.0)
            else:
                robust = (residual == 0).astype(float)
    return fitted


def test_lowess_equals_the_plain_one(spark, tiny_ranges):
    rng, frames, want = np.random.default_rng(8), [], {}
    curves = {
        "line": (np.arange(30.0), lambda x: 2 * x + 1), "wave": (np.unique(rng.normal(0, 4, 90)), lambda x: np.sin(x) + rng.normal(0, 0.2, len(x))),
        "spike": (np.arange(40.0) ** 2, lambda x: np.where(x == 225, 100.0, x / 9)), "two": (np.array([1.0, 5.0]), lambda x: x), "one": (np.array([3.0]), lambda x: x),
    }
    for name, (x, curve) in curves.items():
        y = curve(x)
        frames += [(name, float(a), float(b)) for a, b in zip(x, y)]
        want[name] = dict(zip(x, plain_lowess(x, y, 0.4)))
    means = spark.createDataFrame(frames, "feature string, value double, mean_score double")
    rows = explain.lowess_by_feature(means, 0.4).collect()
    assert len(rows) == len(frames)
    assert all(r["smoothed"] == pytest.approx(want[r["feature"]][r["value"]], abs=1e-6) for r in rows)


def test_lowess_between_points_is_close(spark):
    x = np.linspace(0, 10, 3000)
    y = np.sin(x) + np.random.default_rng(1).normal(0, 0.1, len(x))
    means = spark.createDataFrame([("f", float(a), float(b)) for a, b in zip(x, y)], "feature string, value double, mean_score double")
    rows = sorted(explain.lowess_by_feature(means, 0.2).collect(), key=lambda r: r["value"])
    assert np.abs(np.array([r["smoothed"] for r in rows]) - plain_lowess(x, y, 0.2)).max() < 0.01
    assert explain.lowess_by_feature(means.limit(0)).count() == 0


def test_pruning_alpha_is_searched_without_refitting(spark, rows):
    space = train.with_alphas({"max_depth": [4]}, 0.01)
    found = train.grid_search(rows, "tree", space)
    assert [s["params"]["alpha"] for s in found.scores] == [0.0, 0.005, 0.01, 0.02]
    assert found.scores[0]["score"] == pytest.approx(np.mean(train.fold_scores(rows, "tree", {"max_depth": 4})))
    model = train.best_fit(rows, "tree", found)
    alphas = [0.0, 0.01, 10.0]
    scored = explain.pruned_scores(model, rows, alphas)
    sizes = {r["alpha"]: r["k"] for r in scored.groupBy("alpha").agg(F.count_distinct("score").alias("k")).collect()}
    assert sizes[0.0] >= sizes[0.01] >= sizes[10.0] == 1
    f2 = {r["alpha"]: r["f2"] for r in evaluate.f2_by(scored, ("alpha",)).collect()}
    assert f2[0.0] == pytest.approx(evaluate.F2Evaluator().evaluate(model.transform(rows)))
    assert len(train.expand(train.with_alphas(train.TREE_SPACE, 0.1))) == 288
    drawn = train.draw(train.FOREST_TIGHT_SPACE, 20, 1)
    assert all(d["feature_share"] == "sqrt" or 0.15 <= d["feature_share"] <= 0.65 for d in drawn)
