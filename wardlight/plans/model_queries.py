"""Queries: fitted models, and searches of the whole spaces of ``train``, over five folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardlight.models import evaluate, explain, prep, select, train
from wardlight.operators.outcomes import mean_score_by_value
from wardlight.plans.registry import query
from wardlight.plans.views import table
from wardlight.session import stage

FEATURES = ["amount", "priority", "month", "weekday", "nation", "balance"]


def model_rows(spark, folder):
    """One row per order: 0/1 label, numeric features, a train / validation / test part."""
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey",
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        F.col("o_totalprice").alias("amount"),
        F.substring("o_orderpriority", 1, 1).try_cast("double").alias("priority"),
        F.month("o_orderdate").cast("double").alias("month"),
        F.dayofweek("o_orderdate").cast("double").alias("weekday"),
        F.col("c_nationkey").cast("double").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )


def parts(spark, folder):
    """Split rows with their feature vector, standardised on the training part.

    The numbered rows are written once; vectors are assembled from that file in each pass.
    """
    shares = {"test": 0.2, "validation": 0.16, "train": 0.64}
    rows = prep.split_and_fold(model_rows(spark, folder).fillna(0.0), "label", "o_orderkey", shares, 5, split="part")
    rows = stage(rows)
    stats = rows.filter(F.col("part") == "train")
    scaled = prep.standardize(stats, [rows], FEATURES)[1]
    return prep.assemble(scaled, FEATURES).select("o_orderkey", "label", "part", "fold", "features")


def training(rows):
    return rows.filter(F.col("part") == "train")


def holdout(rows, part="test"):
    return rows.filter(F.col("part") == part)


def scored(model, rows):
    return evaluate.probability(model.transform(rows))


@query("logistic_l1")
def logistic_l1(spark, folder):
    rows = parts(spark, folder)
    return evaluate.classification_report(scored(train.fit_l1_logistic(training(rows), 0.1), holdout(rows)))


@query("logistic_grid")
def logistic_grid(spark, folder):
    return train.grid_search(training(parts(spark, folder)), "logistic", train.LOGISTIC_SPACE, "roc_auc").table(spark)


@query("logistic_grid_f2")
def logistic_grid_f2(spark, folder):
    return train.grid_search(training(parts(spark, folder)), "logistic", train.LOGISTIC_SPACE, "f2").table(spark)


@query("tree_fit")
def tree_fit(spark, folder):
    rows = parts(spark, folder)
    return evaluate.classification_report(scored(train.fit_tree(training(rows)), holdout(rows)))


@query("prune_path")
def prune_path(spark, folder):
    rows = parts(spark, folder)
    model = train.fit_tree(training(rows), max_depth=8)
    return explain.prune_path(model, rows.filter(F.col("part") != "test"))


@query("tree_grid")
def tree_grid(spark, folder):
    """Every tree of the space at every class weight and pruning level."""
    space = train.with_alphas({**train.TREE_SPACE, "class_weight": train.CLASS_WEIGHTS}, 0.001)
    return train.grid_search(training(parts(spark, folder)), "tree", space, "f2").table(spark)


@query("tree_alpha_grid")
def tree_alpha_grid(spark, folder):
    space = {**train.with_alphas(train.TREE_SPACE, 0.001), "class_weight": ["balanced"]}
    return train.grid_search(training(parts(spark, folder)), "tree", space, "roc_auc").table(spark)


@query("forest_fit")
def forest_fit(spark, folder):
    model = train.fit_forest(training(parts(spark, folder)), trees=100)
    return train.tree_shape(spark, model)


@query("random_search")
def random_search(spark, folder):
    space = {**train.FOREST_SPACE, "class_weight": ["balanced"]}
    return train.random_search(training(parts(spark, folder)), "forest", space, 20, "f2").table(spark)


@query("random_search_tight")
def random_search_tight(spark, folder):
    space = {**train.FOREST_TIGHT_SPACE, "trees": (100, 500)}
    return train.random_search(training(parts(spark, folder)), "forest", space, 30, "f2").table(spark)


@query("halving_search")
def halving_search(spark, folder):
    space = {**train.FOREST_HALVING_SPACE, "class_weight": ["balanced"]}
    return train.halving_search(training(parts(spark, folder)), space, low=50, high=500).table(spark)


@query("cv_score")
def cv_score(spark, folder):
    mean, spread = train.cv_score(training(parts(spark, folder)), "tree", {"max_depth": 4, "class_weight": "balanced"})
    return spark.createDataFrame([("roc_auc", mean, spread)], "metric string, mean double, two_std double")


@query("drop_weakest")
def drop_weakest(spark, folder):
    rows = training(parts(spark, folder))
    model = train.fit_l1_logistic(rows, 0.1)
    reduced, kept = select.drop_weakest(rows, model, FEATURES, 3)
    return select.coefficient_table(spark, reduced, kept)


@query("rfe_cv")
def rfe_cv(spark, folder):
    rows = training(parts(spark, folder))
    params = {"max_depth": 3, "class_weight": "balanced"}
    _, history = select.rfe_cv(rows, "tree", params, FEATURES, step=0.05)
    return select.rfe_table(spark, history)


@query("coefficient_table")
def coefficient_table(spark, folder):
    model = train.fit_l1_logistic(training(parts(spark, folder)), 0.1)
    return select.coefficient_table(spark, model, FEATURES)


@query("coefficient_summary")
def coefficient_summary(spark, folder):
    model = train.fit_l1_logistic(training(parts(spark, folder)), 0.1)
    return select.coefficient_summary(select.coefficient_table(spark, model, FEATURES), len(FEATURES))


@query("importance_table")
def importance_table(spark, folder):
    model = train.fit_forest(training(parts(spark, folder)), trees=100, max_depth=10)
    return select.importance_table(spark, model, FEATURES)


@query("model_threshold")
def model_threshold(spark, folder):
    """Threshold chosen on validation rows, reported on test rows."""
    rows = parts(spark, folder)
    model = train.fit_forest(training(rows), trees=100, max_depth=10)
    sweep = evaluate.threshold_sweep(scored(model, holdout(rows, "validation")))
    chosen = evaluate.pick_threshold(sweep, "combined", weights=(0.7, 0.3)).first()["threshold"]
    return evaluate.compare_models({"default": (scored(model, holdout(rows)), 0.5), "chosen": (scored(model, holdout(rows)), chosen)})


@query("tree_contributions")
def tree_contributions(spark, folder):
    rows = parts(spark, folder)
    model = train.fit_forest(training(rows), trees=5, max_depth=4)
    explained = explain.tree_contributions(model, holdout(rows), "o_orderkey")
    return explain.top_contributions(explained, FEATURES, "o_orderkey", 3)


@query("mean_contributions")
def mean_contributions(spark, folder):
    rows = parts(spark, folder)
    model = train.fit_forest(training(rows), trees=100, max_depth=8)
    return explain.mean_contributions(explain.tree_contributions(model, holdout(rows), "o_orderkey"), FEATURES)


@query("lowess_trend")
def lowess_trend(spark, folder):
    rows = model_rows(spark, folder).fillna(0.0)
    model = train.fit_forest(prep.assemble(rows, FEATURES), trees=100, max_depth=10)
    names = FEATURES
    scaled = prep.min_max(prep.assemble(rows, FEATURES), names)
    with_score = model.transform(scaled).select(*names, evaluate.vector_to_array("probability")[1].alias("score"))
    return explain.lowess_by_feature(mean_score_by_value(with_score, names))


@query("representative_tree")
def representative_tree(spark, folder):
    rows = parts(spark, folder)
    model = train.fit_forest(training(rows), trees=100, max_depth=10)
    return explain.representative_tree(model, training(rows))
