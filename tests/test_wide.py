"""Wide tables: one pass for all pairs of columns gives what the aggregates per pair give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wardlight.operators import association, quality


@pytest.fixture(scope="module")
def plain():
    rng = np.random.default_rng(5)
    data = rng.normal(50, 3, (300, 30)) + rng.normal(0, 2, (300, 1))
    data[:, 7] = 4.0  # no spread
    frame = pd.DataFrame(data, columns=[f"c{i}" for i in range(30)])
    for i in range(0, 30, 3):
        frame.loc[rng.random(300) < 0.2, f"c{i}"] = None
    frame["c9"] = np.nan
    return frame


@pytest.fixture(scope="module")
def wide(spark, plain):
    return spark.createDataFrame(plain).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in plain.columns])


def keyed(df, value):
    return {(r[0], r[1]): tuple(r[c] for c in value) for r in df.collect()}


def same_correlations(got, plain):
    for (a, b), (n, r) in got.items():
        pair = plain[[a, b]].dropna()
        assert n == len(pair)
        if len(pair) and pair[a].std() > 0 and pair[b].std() > 0:
            assert r == pytest.approx(np.corrcoef(pair[a], pair[b])[0, 1], abs=1e-9)
        else:
            assert r is None


def test_pearson_of_many_columns(wide, plain):
    got = keyed(association.corr_pearson(wide, wide.columns), ("n", "correlation"))
    assert len(got) == 435
    same_correlations(got, plain)


def test_pearson_of_few_columns_with_constant_and_empty_ones(wide, plain):
    got = keyed(association.corr_pearson(wide.select("c0", "c1", "c7", "c9"), ["c0", "c1", "c7", "c9"]), ("n", "correlation"))
    assert len(got) == 6
    same_correlations(got, plain)


def test_joint_nulls_of_many_columns(wide, plain):
    for (a, b), counts in keyed(quality.co_missing(wide, wide.columns), ("n", "n_a", "n_b", "n_ab")).items():
        x, y = plain[a].isna(), plain[b].isna()
        assert counts == (300, x.sum(), y.sum(), (x & y).sum())


def test_spearman_of_pairs_with_nulls(spark):
    rng = np.random.default_rng(6)
    data = pd.DataFrame(rng.integers(0, 9, (200, 4)).astype(float), columns=list("abcd"))
    data.loc[rng.random(200) < 0.3, "a"] = None
    data.loc[rng.random(200) < 0.3, "c"] = None
    df = spark.createDataFrame(data).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in data.columns])
    got = keyed(association.corr_spearman(df, list("abcd")), ("n", "correlation"))
    for (a, b), (n, r) in got.items():
        pair = data[[a, b]].dropna()
        assert n == len(pair) and r == pytest.approx(pair[a].rank().corr(pair[b].rank()), abs=1e-9)
    assert len(got) == 6
