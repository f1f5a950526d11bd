"""Fitting and searching classifiers.

Frames are ``label`` (0/1), ``features`` (vector) and, where folds are used, ``fold``. Logistic
models are those of ``pyspark.ml``; trees and forests are grown by :mod:`wardlight.models.grow`.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import partial
from itertools import product
from statistics import fmean

import numpy as np
import pandas as pd
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.models.evaluate import f2_by, roc_auc
from wardlight.models.explain import level_metrics, pruning_order
from wardlight.models.forests import GrowingForests
from wardlight.models.grow import TreeSpec, fits_task, grown, prepared
from wardlight.models.lasso import LassoSpec, fit_many, held_out_auc, held_out_scores
from wardlight.models.prep import class_weights, with_class_weight
from wardlight.models.trees import TreeModel, cut_tree, leaf_counts, prefix_scores, stands_for, tree_of
from wardlight.session import stage

# The searched spaces. Lists are choices; (low, high) of integers excludes high.
CLASS_WEIGHTS = ["balanced", {0: 1.0, 1: 1.5}, {0: 1.0, 1: 2.0}, {0: 1.0, 1: 5.0}, {0: 1.0, 1: 6.0}, {0: 1.5, 1: 1.0}, {0: 2.0, 1: 1.0}]
LOGISTIC_SPACE = {"c": [0.01, 0.02, 0.05, 0.1, 0.2], "class_weight": CLASS_WEIGHTS}
TREE_SPACE = {"max_depth": [3, 5, 7, 10], "min_split": [5, 10, 20], "min_leaf": [2, 4, 8], "criterion": ["gini", "entropy"]}
FOREST_SPACE = {"trees": (100, 500), "max_depth": (5, 20), "feature_share": (0.1, 0.8), "min_leaf": (2, 10), "min_split": (2, 10)}
FOREST_HALVING_SPACE = {"max_depth": (5, 12), "feature_share": (0.1, 0.9), "min_leaf": (2, 10), "min_split": (2, 10)}
FOREST_TIGHT_SPACE = {
    "max_depth": (6, 12), "feature_share": [(0.15, 0.65), "sqrt"], "min_leaf": (5, 12), "min_split": (4, 12),
    "class_weight": ["balanced", {0: 1, 1: 4}, {0: 1, 1: 5}, {0: 1, 1: 6}],
}


def with_alphas(space: Mapping[str, object], best: float) -> dict:
    """Search space with no pruning and half, once and twice a known good alpha."""
    return {**space, "alpha": [0.0, best / 2, best, best * 2]}


ClassWeight = str | Mapping[int, float]


#: Scores of groups of ``(label, score)`` rows.
METRICS: dict[str, Callable] = {"roc_auc": roc_auc, "f2": f2_by}


def l1_strength(c: float, weight_sum: float) -> float:
    """Penalty per unit of mean loss that equals an inverse strength ``c`` on the summed loss."""
    return 1.0 / (c * weight_sum)


def l1_logistic(c: float, weight_sum: float, weight: str = "weight", max_iter: int = 1000) -> LogisticRegression:
    """L1 logistic regression estimator; the intercept is not penalised."""
    return LogisticRegression(
        labelCol="label", weightCol=weight, elasticNetParam=1.0, regParam=l1_strength(c, weight_sum), standardization=False, maxIter=max_iter
    )


def weighted(df: DataFrame, spec: ClassWeight | None) -> DataFrame:
    """Frame with a ``weight`` column for the class weight specification."""
    return with_class_weight(df, "label", spec) if spec is not None else df.withColumn("weight", F.lit(1.0))


def weight_sum(df: DataFrame) -> float:
    return float(df.agg(F.sum("weight")).first()[0])


def fit_l1_logistic(df: DataFrame, c: float = 0.1, class_weight: ClassWeight | None = "balanced") -> Model:
    """Weighted L1 logistic regression."""
    rows = weighted(df, class_weight)
    return l1_logistic(c, weight_sum(rows)).fit(rows)


def tried_features(share: float | str | None, n: int) -> int | None:
    """Features drawn for a node: ``sqrt`` or a share of all ``n``, at least one; ``all`` or None for no draw."""
    if share in (None, "all"):
        return None
    return max(1, int(math.sqrt(n) if share == "sqrt" else share * n))


# What a tree or forest is grown with, and the values where none are given.
TREE_OPTIONS = {"criterion": "gini", "max_depth": None, "min_leaf": 1, "min_split": 2, "seed": 42}
FOREST_OPTIONS = {**TREE_OPTIONS, "trees": 100, "feature_share": "sqrt"}


def specs_of(kind: str, params: Mapping[str, object], weights: tuple[float, float], n_features: int, first: int = 0, fold: int | None = None) -> list[TreeSpec]:
    """Specifications of the trees of one model, numbered from ``first``."""
    known = TREE_OPTIONS if kind == "tree" else FOREST_OPTIONS
    if unknown := set(params) - set(known):
        raise ValueError(f"unknown options of a {kind}: {sorted(unknown)}")
    o = {**known, **params}
    common = {"criterion": o["criterion"], "max_depth": o["max_depth"], "min_leaf": o["min_leaf"], "min_split": o["min_split"], "weights": weights, "without": fold}
    if kind == "tree":
        return [TreeSpec(first, seed=o["seed"], **common)]
    tries = tried_features(o["feature_share"], n_features)
    return [TreeSpec(first + i, seed=o["seed"] * 1_000_003 + i, tries=tries, sampled=True, **common) for i in range(o["trees"])]


def both_weights(df: DataFrame, spec: ClassWeight | None) -> tuple[float, float]:
    weights = class_weights(df, "label", spec) if spec is not None else {}
    return float(weights.get(0, 1.0)), float(weights.get(1, 1.0))


def width_of(df: DataFrame) -> int:
    return len(df.select("features").first()["features"])


def _fit(kind: str, df: DataFrame, class_weight: ClassWeight | None, options: Mapping[str, object]) -> TreeModel:
    n = width_of(df)
    return TreeModel(grown(prepared(df), specs_of(kind, options, both_weights(df, class_weight), n)), n)


def fit_tree(df: DataFrame, class_weight: ClassWeight | None = "balanced", **options) -> TreeModel:
    """Decision tree with splits at exact midpoints; without ``max_depth`` it grows until its leaves are pure or too small.

    ``min_split`` and ``min_leaf`` count rows, whatever their weights.
    """
    return _fit("tree", df, class_weight, options)


def fit_forest(df: DataFrame, class_weight: ClassWeight | None = "balanced", **options) -> TreeModel:
    """Random forest: each tree on a sample with replacement, ``feature_share`` of the features tried at a node."""
    return _fit("forest", df, class_weight, options)


def tree_shape(spark: SparkSession, model: TreeModel) -> DataFrame:
    """Depth, nodes and leaves of every tree of a fitted tree or forest."""
    def shape(batches):
        for batch in batches:
            trees = [(r.tree, tree_of(r)) for r in batch.itertuples()]
            yield pd.DataFrame([(n, int(t.depth.max()), len(t.left), int((t.left < 0).sum())) for n, t in trees], columns=["tree", "depth", "nodes", "leaves"])

    return model.table.mapInPandas(shape, "tree int, depth int, nodes int, leaves int")


# ---- searches ----


@dataclass
class Search:
    """Scores of all candidates in the order tried, and the first best one."""

    scores: list[dict] = field(default_factory=list)

    def add(self, params: Mapping[str, object], score: float, **extra) -> None:
        self.scores.append({"params": dict(params), "score": score, **extra})

    @property
    def best(self) -> dict:
        return max(self.scores, key=lambda s: s["score"])

    def table(self, spark: SparkSession) -> DataFrame:
        """``(candidate, params, score, best)`` rows."""
        best = self.best
        rows = [
            (i, ", ".join(f"{k}={v}" for k, v in s["params"].items()), float(s["score"]), s is best) for i, s in enumerate(self.scores)
        ]
        return spark.createDataFrame(rows, "candidate int, params string, score double, best boolean")


def expand(space: Mapping[str, Sequence]) -> list[dict]:
    """All combinations of the listed values, last name varying fastest."""
    return [dict(zip(space, values)) for values in product(*space.values())]


def fold_scores(df: DataFrame, kind: str, params: Mapping[str, object], metric: str = "roc_auc") -> list[float]:
    """Metric on each held-out fold, in the order of the folds. ``params`` may hold ``class_weight``."""
    return SEARCHES[kind](df, [params], metric)[0]


def cv_score(df: DataFrame, kind: str, params: Mapping[str, object], metric: str = "roc_auc") -> tuple[float, float]:
    """Mean and twice the (population) deviation of the metric over the folds."""
    scores = fold_scores(df, kind, params, metric)
    mean = fmean(scores)
    return mean, 2 * math.sqrt(fmean([(s - mean) ** 2 for s in scores]))


def search(df: DataFrame, kind: str, candidates: Sequence[Mapping[str, object]], metric: str = "roc_auc") -> Search:
    """Cross-validated score of every candidate; candidates may differ in ``class_weight``.

    The models of all candidates and folds are fitted together and share what they can
    (:func:`tree_search`, :func:`logistic_search`).
    """
    found = Search()
    for params, folds in zip(candidates, SEARCHES[kind](df, candidates, metric)):
        found.add(params, fmean(folds))
    return found


def logistic_search(df: DataFrame, candidates: Sequence[Mapping[str, object]], metric: str) -> list[list[float]]:
    """Score of each candidate on each fold: one set of passes fits all models, one pass scores them."""
    base = prepared(df)
    folds = folds_of(base)
    by_weight = weights_of(df, candidates)
    specs = [LassoSpec(p["c"], by_weight[repr(p.get("class_weight"))], fold) for p in candidates for fold in folds]
    fitted = fit_many(base, specs, width_of(df))
    scored = held_out_auc(base, specs, fitted) if metric == "roc_auc" else METRICS[metric](held_out_scores(base, specs, fitted), ("model",))
    values = {r["model"]: r[metric] for r in scored.collect()}
    return [[values[i * len(folds) + j] for j in range(len(folds))] for i in range(len(candidates))]


def folds_of(base: DataFrame) -> list[int]:
    return sorted(r["fold"] for r in base.select("fold").distinct().collect())


def no_alpha(params: Mapping[str, object]) -> None:
    if "alpha" in params:
        raise ValueError("alpha prunes single trees")


def weights_of(df: DataFrame, candidates: Sequence[Mapping[str, object]]) -> dict[str, tuple[float, float]]:
    """Weights of both classes by the text of each class weight among the candidates."""
    specs = {repr(p.get("class_weight")): p.get("class_weight") for p in candidates}
    return {name: both_weights(df, spec) for name, spec in specs.items()}


#: Parameters of a tree that cut a larger one: candidates that differ in nothing else share their trees.
CUTS = ("max_depth", "min_split", "alpha")


def tree_search(df: DataFrame, candidates: Sequence[Mapping[str, object]], metric: str, kind: str = "tree") -> list[list[float]]:
    """Score of each candidate on each fold.

    A split depends on its node alone. So of trees that differ in depth, minimum split or pruning
    ``alpha``, one is grown, to the largest depth and smallest split asked for, and cut; and
    of forests that differ in the number of trees, the largest one is grown, and its first trees
    are the others. All trees of all folds are grown by one set of jobs, and rows pass through them once.
    Forests on a table that fits a task are scored where they grow (:class:`ForestSearch`).
    """
    base = prepared(df)
    if kind != "tree" and fits_task(base):
        return ForestSearch(df, base).scores(dict(enumerate(candidates)), metric)
    folds = folds_of(base)
    n = width_of(df)
    by_weight = weights_of(df, candidates)
    shared = CUTS if kind == "tree" else ("trees",)
    groups: dict[str, list[int]] = {}
    for i, params in enumerate(candidates):
        if kind != "tree":
            no_alpha(params)
        groups.setdefault(repr(sorted((k, repr(v)) for k, v in params.items() if k not in shared)), []).append(i)
    specs, places = [], {}
    for g, members in enumerate(groups.values()):
        first = dict(candidates[members[0]])
        weights = by_weight[repr(first.pop("class_weight", None))]
        if kind == "tree":
            depths = [candidates[i].get("max_depth") for i in members]
            first["max_depth"] = None if None in depths else max(depths)
            first["min_split"] = min(candidates[i].get("min_split", 2) for i in members)
            first.pop("alpha", None)
        else:
            first["trees"] = max(candidates[i].get("trees", FOREST_OPTIONS["trees"]) for i in members)
        for fold in folds:
            made = specs_of(kind, first, weights, n, len(specs), fold)
            places |= {s.tree: (g, fold, j) for j, s in enumerate(made)}
            specs += made
    model = TreeModel(grown(base, specs), n)
    score = _cut_scores if kind == "tree" else _forest_scores
    values = score(base, model, list(groups.values()), candidates, places, metric)
    return [[values[i, fold] for fold in folds] for i in range(len(candidates))]


class ForestSearch:
    """Scores of forests on the folds of a table that fits a task; a forest asked for again with more trees keeps those it has."""

    def __init__(self, df: DataFrame, base: DataFrame):
        self.df, self.n, self.weights = df, width_of(df), {}
        self.folds = folds_of(base)
        self.forests = GrowingForests(base, self.folds)

    def scores(self, candidates: Mapping[int, Mapping[str, object]], metric: str) -> list[list[float]]:
        """Score of each candidate on each fold; a candidate keeps its number."""
        made = {}
        for c, params in candidates.items():
            no_alpha(params)
            params = dict(params)
            weight, size = params.pop("class_weight", None), int(params.pop("trees", FOREST_OPTIONS["trees"]))
            if repr(weight) not in self.weights:
                self.weights[repr(weight)] = both_weights(self.df, weight)
            made[c] = specs_of("forest", {**params, "trees": 1}, self.weights[repr(weight)], self.n)[0], size
        scored = self.forests.scored(made)
        if metric != "f2":  # read more than once
            scored = stage(scored)
        found = {(r["candidate"], r["fold"]): r[metric] for r in METRICS[metric](scored, ("candidate", "fold")).collect()}
        return [[found[c, fold] for fold in self.folds] for c in candidates]


def _forest_scores(
    base: DataFrame, model: TreeModel, groups: list[list[int]], candidates: Sequence[Mapping], places: dict[int, tuple[int, int, int]], metric: str
) -> dict[tuple[int, int], float]:
    size = lambda i: int(candidates[i].get("trees", FOREST_OPTIONS["trees"]))
    scored = stage(prefix_scores(base, model, places, {g: sorted({size(i) for i in members}) for g, members in enumerate(groups)}))
    keys = ("candidate", "size", "fold")
    rows = METRICS[metric](scored, keys).collect()
    found = {(r["candidate"], r["size"], r["fold"]): r[metric] for r in rows}
    return {(i, fold): found[g, size(i), fold] for g, members in enumerate(groups) for i in members for fold in {f for _, f, _ in places.values()}}


def _cut_scores(
    base: DataFrame, model: TreeModel, groups: list[list[int]], candidates: Sequence[Mapping], places: dict[int, tuple[int, int, int]], metric: str
) -> dict[tuple[int, int], float]:
    """Scores of trees cut at every level asked for, from the counts of rows in the leaves of the whole trees."""
    levels = {
        g: [(i, candidates[i].get("max_depth"), candidates[i].get("min_split", 2), float(candidates[i].get("alpha", 0.0))) for i in members]
        for g, members in enumerate(groups)
    }
    group_of = {t: g for t, (g, _, _) in places.items()}
    shared = base.sparkSession.sparkContext.broadcast((levels, group_of))

    def standing(batches):
        """The score that each leaf's rows have at each level."""
        levels, group_of = shared.value
        for batch in batches:
            for row in batch.itertuples():
                tree, known = tree_of(row), {}
                for candidate, depth, split, alpha in levels[group_of[row.tree]]:
                    if (depth, split) not in known:
                        deep = np.zeros(len(tree.left), bool) if depth is None else tree.depth >= depth
                        cut = cut_tree(tree, deep | (tree.rows < split))
                        known[depth, split] = cut, pruning_order(cut)[1]
                    cut, closed = known[depth, split]
                    owner = stands_for(tree, cut_tree(cut, closed <= alpha) if alpha > 0 else cut)
                    leaf = np.flatnonzero(owner >= 0)
                    yield pd.DataFrame({"tree": row.tree, "candidate": candidate, "leaf": leaf, "score": tree.value[owner[leaf]]})

    fold_of = {t: fold for t, (_, fold, _) in places.items()}
    counts = leaf_counts(base, model, fold_of)
    rows = counts.join(model.table.mapInPandas(standing, "tree int, candidate int, leaf long, score double"), ["tree", "leaf"])
    scored = rows.groupBy("candidate", "tree", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return {(r["candidate"], fold_of[r["tree"]]): r[metric] for r in level_metrics(scored, ["candidate", "tree"]).collect()}


SEARCHES: dict[str, Callable] = {"logistic": logistic_search, "tree": tree_search, "forest": partial(tree_search, kind="forest")}


def grid_search(df: DataFrame, kind: str, space: Mapping[str, Sequence], metric: str = "roc_auc") -> Search:
    """Every combination of the listed values."""
    return search(df, kind, expand(space), metric)


def draw(space: Mapping[str, object], n: int, seed: int) -> list[dict]:
    """``n`` seeded draws: a list is chosen from, ``(low, high)`` of ints is an integer range
    without its end, of floats an interval."""
    source = random.Random(seed)

    def one(values):
        if isinstance(values, list):
            values = source.choice(values)  # a choice may itself be a range
        if isinstance(values, tuple):
            low, high = values
            return source.randrange(low, high) if isinstance(low, int) and isinstance(high, int) else round(source.uniform(low, high), 4)
        return values

    return [{name: one(values) for name, values in space.items()} for _ in range(n)]


def random_search(df: DataFrame, kind: str, space: Mapping[str, object], n: int = 20, metric: str = "roc_auc", seed: int = 42) -> Search:
    """Cross-validated scores of random draws from the space."""
    return search(df, kind, draw(space, n, seed), metric)


def halving_search(
    df: DataFrame, space: Mapping[str, object], n: int | None = None, low: int = 50, high: int = 500, factor: int = 2,
    metric: str = "f2", seed: int = 42,
) -> Search:
    """Forests with a growing number of trees; each round keeps the best ``1/factor``.

    By default as many candidates start as let the last round use ``high`` trees at most.
    """
    rounds = int(math.log(high / low, factor) + 1e-9) + 1
    candidates = dict(enumerate(draw(space, n or high // low, seed)))
    base = prepared(df)
    known = ForestSearch(df, base) if fits_task(base) else None  # each round goes on from the trees of the one before
    found = Search()
    trees = low
    for step in range(rounds):
        now = {i: {**c, "trees": trees} for i, c in candidates.items()}
        scores = known.scores(now, metric) if known else SEARCHES["forest"](df, list(now.values()), metric)
        # the winner must come from the last round, the one with the most trees
        found = Search()
        for params, folds in zip(now.values(), scores):
            found.add(params, fmean(folds))
        order = sorted(range(len(now)), key=lambda i: -found.scores[i]["score"])
        keep = max(1, math.ceil(len(candidates) / factor))
        if len(candidates) == 1 or step == rounds - 1:
            break
        names = list(candidates)
        candidates = {names[i]: candidates[names[i]] for i in order[:keep]}
        trees = min(high, trees * factor)
    return found


def fit_params(df: DataFrame, kind: str, params: Mapping[str, object]) -> Model | TreeModel:
    """A model of the kind with the parameters of a candidate, ``class_weight`` among them."""
    params = dict(params)
    spec = params.pop("class_weight", None)
    if kind == "logistic":
        return fit_l1_logistic(df, class_weight=spec, **params)
    return _fit(kind, df, spec, params)


def best_fit(df: DataFrame, kind: str, found: Search) -> Model | TreeModel:
    """Refit the best candidate on all rows, unpruned; score it with ``pruned_scores`` at its alpha."""
    return fit_params(df, kind, {k: v for k, v in found.best["params"].items() if k != "alpha"})
