"""No row is lost or renumbered for a null key, order or label; text and big numbers keep their order."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from wardlight.functions.scalars import code_number
from wardlight.models import prep, train
from wardlight.operators import cohorts, importance, ordered


def test_first_row_of_a_key_with_null_order(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, 5, "a"), (2, None, "b"), (None, 3, "c")], "k int, o int, v string")
    assert {tuple(r) for r in cohorts.first_per_key(df, "k", "o").collect()} == {(1, None, "x"), (2, 5, "a"), (None, 3, "c")}


def test_timeline_keeps_null_orders_and_keys(spark, tiny_ranges):
    df = spark.createDataFrame([(1, None), (1, 5), (None, 3), (1, 4), (1, 9), (1, 7), (None, None)], "k int, o int")
    got = {(r.k, r.o): r.ordinal for r in cohorts.timeline(df, "k", "o").collect()}
    assert got == {(1, 4): 1, (1, 5): 2, (1, 7): 3, (1, 9): 4, (1, None): 5, (None, 3): 1, (None, None): 2}


@pytest.mark.parametrize("kind", ["string", "timestamp", "date", "timestamp_ntz"])
def test_timeline_of_other_orders(spark, tiny_ranges, kind):
    days = [f"2020-01-{d:02}" for d in random.Random(1).sample(range(1, 29), 20)]
    df = spark.createDataFrame([(d,) for d in days] + [(None,)], "o string").select(F.lit(1).alias("k"), F.col("o").cast(kind).alias("o"))
    rows = cohorts.timeline(df, "k", "o").select("ordinal", F.col("o").cast("string").alias("o")).collect()
    ordinal = {(r.o or "z")[:10]: r.ordinal for r in rows}
    assert [ordinal[d] for d in [*sorted(days), "z"]] == list(range(1, 22))


def test_splits_place_every_row(spark):
    rows = [(i, i % 2) for i in range(40)] + [(None, 1), (None, 0), (50, None), (51, None)]
    df = spark.createDataFrame(rows, "k int, label int")
    split = prep.stratified_split(df, "label", "k", {"a": 0.5, "b": 0.5})
    folds = prep.stratified_folds(df, "label", "k", 5)
    assert split.count() == folds.count() == 44
    assert Counter(r.split for r in split.filter("label IS NULL").collect()) == {"a": 1, "b": 1}


def test_labels_of_any_script_are_coded_in_order(spark):
    words = ["a😀x", "b", "a", "ab", "한글", "한", "日本", "￿z", "", "zz", "prefix-1", "prefix-10", "prefix-2", None]
    df = spark.createDataFrame([(w, w) for w in words], "s string, t string")
    rows = importance.label_encode(df, ["s", "t"], missing="missing").collect()
    order = sorted(("missing" if w is None else w for w in words), key=lambda w: w.encode())
    assert all(r.s_code == r.t_code == order.index("missing" if r.s is None else r.s) for r in rows) and len(rows) == len(words)


def test_code_with_type_letter_is_no_number(spark):
    df = spark.createDataFrame([("250d",), ("250f",), ("250.83",), (" 7 ",), ("1e2",), (".5",), ("NaN",), ("Infinity",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(code_number(F.col("c"))).collect()] == [None, None, 250.83, 7.0, 100.0, 0.5, None, None, None, None]


@pytest.mark.parametrize("shape", ["lognormal", "half constant"])
def test_no_range_is_overfull(spark, shape):
    rng = np.random.default_rng(3)
    values = rng.lognormal(0, 3, 200_000)
    if shape == "half constant":
        values[:100_000] = 1.0
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    cuts = ordered.value_cuts(df, ["v"], rows_per_range=200)
    ranges = ordered.with_ranges(df, cuts).groupBy("v__range").agg(F.count("*").alias("n"), F.countDistinct("v").alias("d")).collect()
    assert max(r.n for r in ranges if r.d > 1) <= 500


def test_depths_have_no_limit(spark):
    """Labels that switch at ever closer values: each split peels off the outermost run."""
    x = [1 - 2.0**-i for i in range(48)]
    rows = [(float(i % 2), Vectors.dense([v])) for i, v in enumerate(x) for _ in range(2 ** (47 - i) if i > 40 else 1)]
    df = spark.createDataFrame(rows, ["label", "features"])
    for limit in (31, 40, None):
        model = train.fit_tree(df, class_weight=None, max_depth=limit)
        assert train.tree_shape(spark, model).first()["depth"] <= (limit or 48)
    assert model.transform(df).filter("prediction <> label").count() == 0
