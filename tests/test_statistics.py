"""Ordered operators, distributions and tests against direct computation."""

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardlight.functions import scalars, tails
from wardlight.operators import association, distributions, importance, ordered, quality

QUICK = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


@QUICK
@given(st.lists(st.integers(-5, 5) | st.integers(0, 0), min_size=1, max_size=60))
def test_quantiles_and_ranks(spark, tiny_ranges, values):
    df = frame(spark, v=[float(v) for v in values])
    got = ordered.quantiles(df, ["v"], {"a": 0.25, "b": 0.5, "c": 1.0}).first()
    assert [got[c] for c in "abc"] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 1.0])))
    ranks = {r["value"]: r["rank"] for r in ordered.average_ranks(df, ["v"]).collect()}
    want = pd.Series(values).rank()
    assert all(ranks[v] == pytest.approx(w) for v, w in zip(values, want))


def test_quantiles_by_group_with_a_hot_value(spark, tiny_ranges):
    rng = np.random.default_rng(1)
    values = np.where(rng.random(300) < 0.4, 7.0, rng.normal(size=300).round(3))
    groups = rng.choice(list("ab"), 300)
    got = ordered.quantiles(frame(spark, v=values, g=groups), ["v"], {"m": 0.5, "q": 0.9}, by=["g"])
    for r in got.collect():
        assert [r["m"], r["q"]] == pytest.approx(list(np.quantile(values[groups == r["g"]], [0.5, 0.9])))


def test_cuts_are_bounded_and_rising(spark):
    df = spark.range(10_000).select(F.col("id").alias("v"), F.lit(1).alias("one"))
    cuts = ordered.value_cuts(df, ["v", "one"], rows_per_range=10, max_ranges=600)
    assert 400 < len(cuts["v"]) < 600 and cuts["v"] == sorted(set(cuts["v"]))
    assert len(cuts["one"]) <= 1


def kendall(x, y):
    pairs = list(combinations(range(len(x)), 2))
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i, j in pairs)
    tx, ty = (sum(v[i] == v[j] for i, j in pairs) for v in (x, y))
    return s / math.sqrt((len(pairs) - tx) * (len(pairs) - ty))


def test_rank_correlations_with_ties_and_nulls(spark, tiny_ranges):
    rng = np.random.default_rng(5)
    data = pd.DataFrame({"a": rng.integers(0, 6, 80), "b": rng.integers(0, 9, 80), "c": rng.normal(size=80)}).astype(float)
    data["b"] += data["a"]
    data.loc[::7, "c"] = None
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), "a double, b double, c double")
    tau = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in association.corr_kendall(df, list("abc")).collect()}
    rho = {(r["feature_a"], r["feature_b"]): r["correlation"] for r in association.corr_spearman(df, list("abc")).collect()}
    for a, b in combinations("abc", 2):
        both = data[[a, b]].dropna()
        assert tau[a, b] == pytest.approx(kendall(both[a].to_numpy(), both[b].to_numpy()))
        assert rho[a, b] == pytest.approx(both[a].rank().corr(both[b].rank()))


def test_wide_correlation_by_matrix_products(spark, monkeypatch):
    data = pd.DataFrame(np.random.default_rng(4).normal(size=(50, 4)), columns=list("abcd"))
    monkeypatch.setattr(association, "NATIVE_PAIRS", 2)
    got = {(r["feature_a"], r["feature_b"]): (r["n"], r["correlation"]) for r in association.corr_pearson(spark.createDataFrame(data), list("abcd")).collect()}
    assert got == {(a, b): (50, pytest.approx(data[a].corr(data[b]))) for a, b in combinations("abcd", 2)}


def test_tails_match_published_values():
    assert tails.chi2_sf(5.991, 2) == pytest.approx(0.05, abs=1e-4)
    assert tails.chi2_sf(18.307, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.f_sf(4.103, 2, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.kolmogorov_sf(1.358) == pytest.approx(0.05, abs=1e-4)
    assert tails.studentized_range_sf(3.877, 3, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.studentized_range_sf(3.314, 3, 1e6) == pytest.approx(0.05, abs=1e-4)
    assert tails.studentized_range_quantile(0.95, 3, 20) == pytest.approx(3.578, abs=1e-3)
    assert tails.gamma_sf(3.0, 0.0) == 1.0 and tails.f_sf(0.0, 2, 5) == 1.0


def test_normal_expressions(spark):
    p = [1e-6, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.999999]
    got = [r[0] for r in frame(spark, p=p).select(scalars.normal_quantile(F.col("p"))).collect()]
    assert got == pytest.approx([NormalDist().inv_cdf(v) for v in p], rel=1e-8, abs=1e-8)
    z = [-30.0, -8.0, -5.0, -1.5, -0.3, 0.0, 0.4, 2.0, 6.0, 9.0]
    logs = [r[0] for r in frame(spark, z=z).select(tails.log_normal_cdf(F.col("z"))).collect()]
    # log1p keeps the small tail that log would round away
    want = [math.log1p(-0.5 * math.erfc(v / math.sqrt(2))) if v > 1 else math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in z]
    assert logs == pytest.approx(want, rel=1e-12)


def test_normality(spark, tiny_ranges):
    x = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = frame(spark, x=x)
    sw = distributions.shapiro_wilk(df, ["x"]).first()
    assert sw["w"] == pytest.approx(0.7888, abs=2e-4) and sw["p"] == pytest.approx(0.0067, abs=2e-4)
    assert not sw["normal"]
    z = (np.sort(x) - np.mean(x)) / np.std(x, ddof=1)
    cdf = np.array([NormalDist().cdf(v) for v in z])
    i = np.arange(1, 12)
    want = -11 - np.mean((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1])))
    assert distributions.anderson_darling(df, ["x"]).first()["statistic"] == pytest.approx(want)


def plain_shapiro(x):
    """W by the published weights, value by value."""
    x, n = np.sort(np.array(x, float)), len(x)
    if n == 3:
        weights = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        scores = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        norm, u = float(scores @ scores), n**-0.5
        ends = [np.polyval([*distributions._ROYSTON_LAST, scores[-1] / math.sqrt(norm)], u)]
        if n > 5:
            ends.append(np.polyval([*distributions._ROYSTON_NEXT, scores[-2] / math.sqrt(norm)], u))
        outer = scores[-len(ends) :][::-1]
        weights = scores / math.sqrt((norm - 2 * float(outer @ outer)) / (1 - 2 * sum(e * e for e in ends)))
        for i, e in enumerate(ends):
            weights[i], weights[-1 - i] = -e, e
    return float(weights @ x) ** 2 / float(np.sum((x - x.mean()) ** 2))


@pytest.mark.parametrize("n", [3, 4, 5, 6, 40, 6000])
def test_shapiro_statistic_at_every_size(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.exponential(3, n), 1 if n < 1000 else 3)
    x[0] = 7.5
    got = distributions.shapiro_wilk(frame(spark, x=x.tolist()), ["x"]).first()
    assert got["w"] == pytest.approx(plain_shapiro(x), rel=1e-6) and got["rows"] == n and got["p_valid"] == (n < 5000)


def test_shapiro_without_spread_or_values(spark):
    df = frame(spark, x=[2.0, 2.0, 2.0, 2.0]).withColumn("y", F.lit(None).cast("double"))
    rows = {r["feature"]: (r["rows"], r["w"], r["p"], r["normal"]) for r in distributions.shapiro_wilk(df, ["x", "y"]).collect()}
    assert rows == {"x": (4, None, None, None), "y": (0, None, None, None)}


def test_qq_points_cover_every_row(spark, tiny_ranges):
    df = frame(spark, v=[1.0] * 25 + [0.0, 2.0])
    got = sorted((r["position"], r["sample"]) for r in distributions.qq_points(df, "v", chunk=4).collect())
    assert got == [(i + 1, v) for i, v in enumerate(sorted([1.0] * 25 + [0.0, 2.0]))]


def test_kde_matches_direct_sum(spark):
    x = np.array([0.0, 1.0, 1.0, 4.0])
    h = x.std(ddof=1) * 4 ** -0.2
    got = sorted((r["point"], r["x"], r["density"]) for r in distributions.kde(frame(spark, v=x), "v", 9).collect())
    for _, at, density in got:
        want = np.mean(np.exp(-0.5 * ((at - x) / h) ** 2)) / (h * math.sqrt(2 * math.pi))
        assert density == pytest.approx(want)


def test_chi_square_corrects_two_by_two(spark):
    cells = {("a", "x"): 10, ("a", "y"): 20, ("b", "x"): 30, ("b", "y"): 5}
    data = [k for k, n in cells.items() for _ in range(n)]
    df = spark.createDataFrame(data, "f string, o string")
    row = association.chi_square(df, ["f"], "o").first()
    n = sum(cells.values())
    expected = {(a, b): sum(v for k, v in cells.items() if k[0] == a) * sum(v for k, v in cells.items() if k[1] == b) / n for a, b in cells}
    want = sum((abs(cells[k] - expected[k]) - 0.5) ** 2 / expected[k] for k in cells)
    assert row["chi2"] == pytest.approx(want) and row["dof"] == 1


def test_chi_square_with_an_empty_cell(spark):
    data = [("a", "x")] * 6 + [("b", "y")] * 4 + [("c", "x")] * 3 + [("c", "y")] * 2
    table = pd.crosstab(pd.Series([d[0] for d in data]), pd.Series([d[1] for d in data])).to_numpy()
    e = table.sum(1, keepdims=True) * table.sum(0, keepdims=True) / table.sum()
    row = association.chi_square(spark.createDataFrame(data, "f string, o string"), ["f"], "o").first()
    assert row["chi2"] == pytest.approx(((table - e) ** 2 / e).sum()) and row["dof"] == 2


def test_anova_skips_one_class(spark):
    df = frame(spark, x=[1.0, 2.0, 3.0], readmitted=["NO"] * 3)
    assert association.anova(df, ["x"]).count() == 0


def test_missing_correlation_is_plain_correlation(spark):
    data = pd.DataFrame({"a": [1, None, None, 4, None], "b": [None, None, 3, 4, None], "c": [1, 2, 3, 4, 5]}, dtype=float)
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), "a double, b double, c double")
    row = quality.missing_correlation(df).collect()
    want = data[["a", "b"]].isna().astype(float).corr().iloc[1, 0]
    assert [(r["column_a"], r["column_b"]) for r in row] == [("b", "a")] and row[0]["correlation"] == pytest.approx(want)


def test_histogram_and_view(spark):
    df = frame(spark, v=[0.0] * 60 + [1.0] * 5 + [5.0] * 60 + [10.0] * 5 + [3.0] * 20, readmitted=["NO"] * 150)
    bins = {r["bin"]: r["n"] for r in distributions.histogram(df, ["v"], 10).collect()}
    assert bins == {0: 60, 1: 5, 3: 20, 5: 60, 9: 5}
    assert distributions.choose_view(df, ["v"]).first()["view"] == "distribution"
    assert distributions.choose_view(df.limit(50), ["v"]).first()["view"] == "boxplot"


def brute_mi(x, y, k=3):
    def psi(n):
        return -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))

    counts = {c: (y == c).sum() for c in set(y)}
    keep = np.array([counts[c] > 1 for c in y])
    x, y = x[keep], y[keep]
    total = 0.0
    for i in range(len(x)):
        kk = min(k, counts[y[i]] - 1)
        same = np.sort(np.abs(np.delete(x[y == y[i]], np.flatnonzero(np.flatnonzero(y == y[i]) == i)) - x[i]))
        d = same[kk - 1]
        m = (np.abs(x - x[i]) < d).sum() if d > 0 else (x == x[i]).sum()
        total += psi(kk) - psi(counts[y[i]]) - psi(m)
    return max(0.0, psi(len(x)) + total / len(x))


def test_neighbour_information(spark, tiny_ranges, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK", 8)
    rng = np.random.default_rng(3)
    y = rng.choice(list("abc"), 150, p=[0.5, 0.3, 0.2])
    # eighths are exact in binary, so both sides see the same distances
    x = np.round(8 * (rng.normal(size=150) + np.where(y == "a", 2.0, 0.0))) / 8
    y[0] = "lonely"
    got = importance.mutual_information(frame(spark, x=x, y=y), ["x"], "y", method="knn").first()
    assert got["mutual_information"] == pytest.approx(brute_mi(x, y), abs=1e-6)


def test_label_codes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("B",), ("b",)], "s string")
    got = {r["s"]: r["s_code"] for r in importance.label_encode(df, ["s"]).collect()}
    assert got == {"B": 0, "a": 1, "b": 2, None: 3}
