"""Correlation, hypothesis tests and effect sizes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.functions.tails import EXACT_DISTANCE, chi2_p, distance_p, f_p, kendall_p, t_p, tukey_critical, tukey_p
from wardlight.operators.distributions import QUARTILES, numeric_cells
from wardlight.operators.gram import pair_moments
from wardlight.operators.ordered import OFFSET_BITS, average_ranks, long_values, quantiles, range_offsets, running_totals, value_counts
from wardlight.operators.outcomes import union_rows
from wardlight.operators.quality import null_counts, top_per_group
from wardlight.session import stage

DIGIT_BITS = 3
#: Dense ranks in one range of Kendall's running totals.
RANGE_VALUES = 4096
#: Pairs that one aggregate still holds well.
NATIVE_PAIRS = 300
COHORT_PAIRS = (("all", "first"), ("all", "repeated"), ("first", "repeated"))


def _pair_rows(one: DataFrame, pairs: Sequence[tuple[str, str]], cell) -> DataFrame:
    structs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), *cell(a, b)) for a, b in pairs]
    return one.select(F.inline(F.array(*structs)))


def corr_pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature_a, feature_b, n, correlation)`` for a < b in column order, pairwise complete.

    A few dozen columns share one aggregate; wider tables take one pass of matrix products.
    """
    pairs = list(combinations(cols, 2))
    if len(pairs) <= NATIVE_PAIRS:
        return _pearson_pass(df, pairs)
    names = F.array(*[F.lit(c) for c in cols])
    n = F.col("n")
    mixed = F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), n)
    spread = (F.col("saa") - F.try_divide(F.col("sa") * F.col("sa"), n)) * (F.col("sbb") - F.try_divide(F.col("sb") * F.col("sb"), n))
    return pair_moments(df, cols).select(
        names[F.col("a").cast("int")].alias("feature_a"), names[F.col("b").cast("int")].alias("feature_b"), n.cast("long").alias("n"),
        F.when(spread > 0, F.try_divide(mixed, F.sqrt(spread))).alias("correlation"),
    )


def _pearson_pass(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    def correlation(a: str, b: str) -> Column:
        """Null where one of the columns does not vary; ``corr`` would divide by zero there."""
        x, y = F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    one = df.agg(
        *[correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)],
        *[F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias(f"n{i}") for i, (a, b) in enumerate(pairs)],
    )
    where = {p: i for i, p in enumerate(pairs)}
    return _pair_rows(
        one, pairs, lambda a, b: (F.col(f"n{where[a, b]}").alias("n"), F.col(f"r{where[a, b]}").alias("correlation"))
    )


def with_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each column by its average rank, joined back by value."""
    ranks = stage(average_ranks(df, cols))
    for c in cols:
        one = ranks.filter(F.col("feature") == c).select(F.col("value").alias(f"__{c}"), F.col("rank").alias(f"{c}__rank"))
        df = df.join(one, F.col(c).cast("double") == F.col(f"__{c}"), "left").drop(f"__{c}")
    return df.select([F.col(f"{c}__rank").alias(c) if c in cols else F.col(c) for c in df.columns if not c.endswith("__rank")])


def corr_spearman(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rank correlation of every pair; ranks are taken among the rows complete for the pair.

    Columns without nulls share one set of ranks. Pairs with nulls are ranked together in one
    long table of their complete rows, collapsed to distinct cells before the ranks are joined.
    """
    narrow = df.select(*cols)
    _, nulls = null_counts(narrow)
    full = [c for c in cols if not nulls[c]]
    frames = []
    if len(full) > 1:
        frames.append(corr_pearson(with_ranks(narrow, full), full))
    gaps = [(a, b) for a, b in combinations(cols, 2) if nulls[a] or nulls[b]]
    if gaps:
        frames.append(_spearman_of_pairs(narrow, gaps))
    return union_rows(*frames)


def _spearman_of_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Spearman of each pair over its own complete rows, from one table keyed by pair."""
    cells = [F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)]
    rows = df.select(F.inline(F.array(*cells))).na.drop(subset=["x", "y"])
    counts = rows.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    ranks = stage(average_ranks(rows, ["x", "y"], by=["pair"]))
    for side in ("x", "y"):
        own = ranks.filter(F.col("feature") == side).select(
            "pair", F.col("value").alias(side), (F.col("rank") - (F.col("total_n") + 1) / 2).alias(f"d{side}")
        )
        counts = counts.join(own, ["pair", side])
    w, dx, dy = F.col("w").cast("double"), F.col("dx"), F.col("dy")
    sums = counts.groupBy("pair").agg(F.sum("w").alias("n"), F.sum(w * dx * dy).alias("xy"), F.sum(w * dx * dx).alias("xx"), F.sum(w * dy * dy).alias("yy"))
    names = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b")) for a, b in pairs])
    return sums.select(names[F.col("pair")].alias("name"), "n", F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("correlation")).select("name.*", "n", "correlation")


def with_dense_ranks(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace each column by the number of smaller distinct values."""
    counts = value_counts(df, cols).withColumn("one", F.lit(1))
    dense = stage(running_totals(counts, ["feature"], ["one"]))
    for c in cols:
        one = dense.filter(F.col("feature") == c).select(
            F.col("value").alias(f"__{c}"), F.col("before_one").alias(f"{c}__dense")
        )
        df = df.join(one, F.col(c).cast("double") == F.col(f"__{c}"), "left").drop(f"__{c}")
    return df.select([F.col(f"{c}__dense").alias(c) for c in cols])


def corr_kendall(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Kendall's tau-b of every pair, exact and pairwise complete."""
    return _kendall_counts(df, cols).select("feature_a", "feature_b", "n", "correlation")


def kendall_test(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Kendall's tau-b with its two-sided p: exact from the inversions of small samples without
    ties, else normal with the variance that the ties leave."""
    counts = _kendall_counts(df, cols)
    n, m = F.col("n").cast("double"), F.col("n").cast("double") * (F.col("n") - 1)
    variance = (
        (m * (2 * n + 5) - F.col("tx_five") - F.col("ty_five")) / 18 + F.try_divide(2 * F.col("tx") * F.col("ty"), m)
        + F.coalesce(F.try_divide(F.col("tx_three") * F.col("ty_three"), 9 * m * (n - 2)), F.lit(0.0))
    )
    swaps = (m / 2 - F.col("tx") - F.col("ty") + F.col("txy") - F.col("net")) / 2
    p = F.when(F.col("correlation").isNotNull(), kendall_p(n, swaps, "net", variance, F.col("tx") + F.col("ty")))
    return counts.select("feature_a", "feature_b", "n", "correlation", p.alias("p")).withColumn("significant", F.col("p") < 0.05)


def _kendall_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Kendall's tau-b of every pair with ``net`` (concordant less discordant pairs) and sums over its ties.

    Rows are collapsed to counts of distinct (x, y) cells. Concordant pairs are counted
    level by level over the octal digits of x's dense rank: two cells belong to the level
    of the highest digit in which their ranks differ, and there the cell with the smaller
    digit has the smaller x. Within a level and prefix it remains to add, for every cell,
    the weight of the cells with a smaller digit and a smaller y, which are running
    totals in y order. So no pair of rows is ever formed; the work is n log(distinct x).
    """
    narrow = df.select(*cols)
    dense = stage(with_dense_ranks(narrow, cols))
    largest = dense.agg(*[F.max(c).alias(c) for c in cols]).first()
    levels = {c: max(1, ceil(int(largest[c] or 0).bit_length() / DIGIT_BITS)) for c in cols}
    pairs = []
    for i, (a, b) in enumerate(combinations(cols, 2)):
        x, y = (a, b) if levels[a] <= levels[b] else (b, a)
        pairs.append((i, a, b, x, y, levels[x]))
    cells = [
        F.struct(F.lit(i).alias("pair"), F.col(x).alias("x"), F.col(y).alias("y"), F.lit(n).alias("levels"))
        for i, _, _, x, y, n in pairs
    ]
    counts = (
        dense.select(F.inline(F.array(*cells)))
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
        .groupBy("pair", "x", "y", "levels")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    # read by five aggregates below, so written once
    counts = stage(counts)
    leveled = counts.select("pair", "x", "y", "w", F.explode(F.sequence(F.lit(0), F.col("levels") - 1)).alias("level"))
    sides = leveled.select(
        "pair", "level", F.expr(f"shiftright(x, {DIGIT_BITS} * (level + 1))").alias("prefix"),
        F.floor(F.col("y") / RANGE_VALUES).cast("long").alias("range"), F.col("y").alias("value"), "w",
        F.expr(f"shiftright(x, {DIGIT_BITS} * level) & {2**DIGIT_BITS - 1}").alias("digit"),
    )
    weights = [f"w{d}" for d in range(2**DIGIT_BITS)]
    merged = sides.groupBy("pair", "level", "prefix", "range", "value").agg(
        *[F.coalesce(F.sum(F.when(F.col("digit") == d, F.col("w"))), F.lit(0)).alias(name) for d, name in enumerate(weights)]
    )
    keys = ["pair", "level", "prefix"]
    # the ranges of the largest rank, in digits: no window of offsets has more rows than one digit has values
    ranges = max(int(largest[c] or 0) for c in cols) // RANGE_VALUES + 1
    depth = max(1, ceil(ranges.bit_length() / OFFSET_BITS))
    running = running_totals(merged, keys, weights[:-1], offsets=range_offsets(merged, keys, weights[:-1], depth=depth))
    smaller = F.lit(0)
    product = F.lit(0.0)
    for low, high in zip(weights, weights[1:]):
        smaller = smaller + F.col(f"before_{low}")
        product = product + F.col(high).cast("double") * smaller
    concordant = running.groupBy("pair").agg(F.sum(product).alias("c"))

    def ties(grouped: DataFrame, name: str) -> DataFrame:
        w = F.col("w").cast("double")
        sums = {name: w * (w - 1) / 2, f"{name}_three": w * (w - 1) * (w - 2), f"{name}_five": w * (w - 1) * (2 * w + 5)}
        return grouped.groupBy("pair").agg(*[F.sum(v).alias(k) for k, v in sums.items()])

    totals = counts.groupBy("pair").agg(F.sum("w").alias("n"))
    tx = ties(counts.groupBy("pair", "x").agg(F.sum("w").alias("w")), "tx")
    ty = ties(counts.groupBy("pair", "y").agg(F.sum("w").alias("w")), "ty")
    joined = reduce(lambda l, r: l.join(r, "pair"), [totals, concordant, tx, ty, ties(counts, "txy")])
    n0 = F.col("n").cast("double") * (F.col("n") - 1) / 2
    # pairs untied in both = n0 - tx - ty + txy = concordant + discordant
    net = 2 * F.col("c") - (n0 - F.col("tx") - F.col("ty") + F.col("txy"))
    tau = F.try_divide(net, F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty"))))
    names = F.array(*[F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b")) for _, a, b, *_ in pairs])
    kept = [f"{t}{s}" for t in ("tx", "ty") for s in ("", "_three", "_five")]
    return joined.select(names[F.col("pair")].alias("name"), "n", tau.alias("correlation"), net.alias("net"), "txy", *kept).select("name.*", "*").drop("name")


METHODS = {"pearson": corr_pearson, "spearman": corr_spearman, "kendall": corr_kendall}


def correlation_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Upper triangle of the correlation matrix as rows."""
    return METHODS[method](df, cols)


def correlation_compare(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The three methods side by side under a ``method`` tag."""
    return union_rows(*[fn(df, cols).withColumn("method", F.lit(name)) for name, fn in METHODS.items()])


def correlation_matrix(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Square matrix (one row per feature) from the pair rows."""
    both = pairs.select("feature_a", "feature_b", "correlation").union(pairs.select("feature_b", "feature_a", "correlation"))
    wide = both.groupBy("feature_a").pivot("feature_b", list(cols)).agg(F.first("correlation"))
    return wide.select(
        F.col("feature_a").alias("feature"),
        *[F.when(F.col("feature_a") == c, 1.0).otherwise(F.col(c)).alias(c) for c in cols],
    )


def strong_pairs(pairs: DataFrame, threshold: float = 0.3, first: int | None = None) -> DataFrame:
    """Pairs with ``|r| > threshold``, strongest first; with ``first``, among the first few only."""
    ordered = pairs.orderBy(F.abs("correlation").desc(), "feature_a", "feature_b")
    if first is not None:
        ordered = ordered.limit(first)
    return ordered.filter(F.abs("correlation") > threshold)


def correlation_test(pairs: DataFrame) -> DataFrame:
    """p-value and significance of each pair of Pearson or Spearman, from its own number of complete
    rows; :func:`kendall_test` is that of Kendall."""
    r, n = F.col("correlation"), F.col("n").cast("double")
    p = t_p(F.try_divide(r * F.sqrt(n - 2), F.sqrt(1 - r * r)), n - 2)
    return pairs.withColumn("p", p).withColumn("significant", F.col("p") < 0.05)


def linear_fit(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Least squares line of ``feature_b`` on ``feature_a`` with the ends of its x range, one pass."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [
            F.regr_slope(F.col(b), F.col(a)).alias(f"slope{i}"), F.regr_intercept(F.col(b), F.col(a)).alias(f"intercept{i}"),
            F.min(F.when(both, F.col(a))).cast("double").alias(f"from{i}"), F.max(F.when(both, F.col(a))).cast("double").alias(f"to{i}"),
        ]
    where = {p: i for i, p in enumerate(pairs)}
    return _pair_rows(
        df.agg(*aggs), pairs,
        lambda a, b: [F.col(f"{k}{where[a, b]}").alias(name) for k, name in
                      (("slope", "slope"), ("intercept", "intercept"), ("from", "from_x"), ("to", "to_x"))],
    )


def line_points(fit: DataFrame, points: int = 100) -> DataFrame:
    """Evenly spaced points on each fitted line."""
    x = F.col("from_x") + F.col("point") * (F.col("to_x") - F.col("from_x")) / (points - 1)
    rows = fit.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    return rows.select("feature_a", "feature_b", "point", x.alias("x"), (F.col("intercept") + F.col("slope") * x).alias("y"))


# ---- tests over outcome groups ----


def group_moments(df: DataFrame, features: Sequence[str], group: str, groups: Sequence[str] | None = None) -> DataFrame:
    """Non-null count, mean and sample variance per feature and group."""
    known = df.filter(F.col(group).isin(list(groups)) if groups else F.col(group).isNotNull())
    x = F.col("value")
    return (
        numeric_cells(known, features, [group])
        .filter(x.isNotNull())
        .groupBy("feature", group)
        .agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"), F.var_pop(x).alias("var_pop"))
    )


def _anova_parts(moments: DataFrame) -> DataFrame:
    n, mean = F.col("n"), F.col("mean")
    grand = F.sum(n * mean).over(W.partitionBy("feature")) / F.sum("n").over(W.partitionBy("feature"))
    return (
        moments.withColumn("between", n * (mean - grand) * (mean - grand))
        .groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("groups"), F.sum("n").alias("n"),
            F.sum("between").alias("ss_between"), F.sum(n * F.col("var_pop")).alias("ss_within"),
        )
        .filter(F.col("groups") >= 2)
    )


def anova(df: DataFrame, features: Sequence[str], outcome: str = "readmitted", groups: Sequence[str] | None = None) -> DataFrame:
    """One-way analysis of variance per feature; groups without values are skipped."""
    parts = _anova_parts(group_moments(df, features, outcome, groups))
    d1 = (F.col("groups") - 1).cast("double")
    d2 = (F.col("n") - F.col("groups")).cast("double")
    f = F.try_divide(F.col("ss_between") / d1, F.col("ss_within") / d2)
    stat = parts.select("feature", f.alias("f_statistic"), d1.alias("dof_between"), d2.alias("dof_within"))
    tested = stat.withColumn("p", f_p("f_statistic", "dof_between", "dof_within"))
    return tested.withColumn("significant", F.col("p") < 0.05)


def contingency(df: DataFrame, features: Sequence[str], outcome: str) -> DataFrame:
    """``(feature, category, outcome, n)`` of all features in one shuffle; nulls dropped."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in features]
    long = df.select(F.col(outcome).alias("outcome"), F.inline(F.array(*cells)))
    return (
        long.filter(F.col("category").isNotNull() & F.col("outcome").isNotNull())
        .groupBy("feature", "category", "outcome")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def chi_square_stats(cells: DataFrame) -> DataFrame:
    """Chi-square statistic, degrees of freedom, n and table size per feature.

    Works from the non-empty cells only: the sum of (o-e)^2/e over all cells equals
    n (sum o^2 / (row * column) - 1). A 2x2 table gets the continuity correction. Row and
    column totals are aggregates joined back, so a feature with very many categories is
    never held by one task.
    """
    n = F.col("n")
    by_row = cells.groupBy("feature", "category").agg(F.sum("n").alias("row_n"))
    by_col = cells.groupBy("feature", "outcome").agg(F.sum("n").alias("col_n"))
    sizes = by_row.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.sum("row_n").alias("total"))
    sizes = sizes.join(by_col.groupBy("feature").agg(F.count(F.lit(1)).alias("cols")), "feature")
    full = cells.join(by_row, ["feature", "category"]).join(by_col, ["feature", "outcome"])
    expected = F.col("row_n") * F.col("col_n")
    sums = full.groupBy("feature").agg(
        F.sum(n.cast("double") * n / expected).alias("s"),
        F.max(F.struct(expected.cast("double").alias("e"), n.alias("o"))).alias("cell"),
    )
    total = F.col("total").cast("double")
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    plain = total * (F.col("s") - 1)
    stats = sums.join(sizes, "feature").withColumns({"dof": dof, "plain": plain})
    # 2x2: all four |o-e| are equal, so the corrected statistic follows from one of them
    small = sizes.filter((F.col("rows") == 2) & (F.col("cols") == 2)).select("feature")
    corners = small.join(by_row, "feature").join(by_col, "feature").groupBy("feature").agg(
        F.sum(1.0 / (F.col("row_n").cast("double") * F.col("col_n"))).alias("corner_inverse")
    )
    stats = stats.join(corners, "feature", "left")
    gap = F.abs(F.col("cell.o") - F.col("cell.e") / total)
    shrunk = F.greatest(gap - F.least(F.lit(0.5), gap), F.lit(0.0))
    statistic = F.when(F.col("dof") == 1, shrunk * shrunk * total * F.col("corner_inverse")).otherwise(
        F.when(F.col("dof") == 0, F.lit(0.0)).otherwise(F.greatest(F.col("plain"), F.lit(0.0)))
    )
    return stats.select("feature", statistic.alias("chi2"), "dof", F.col("total").alias("n"), "rows", "cols")


def chi_square(df: DataFrame, features: Sequence[str], outcome: str = "readmitted") -> DataFrame:
    """Chi-square test of independence of each categorical feature from the outcome."""
    return chi_square_test(contingency(df, features, outcome))


def chi_square_test(cells: DataFrame) -> DataFrame:
    """Statistic, degrees of freedom and p per feature of ``(feature, category, outcome, n)`` cells."""
    stats = chi_square_stats(cells).select("feature", "chi2", "dof")
    tested = stats.withColumn("p", chi2_p("chi2", F.col("dof").cast("double")))
    return tested.withColumn("significant", F.col("p") < 0.05)


def cramers_v(df: DataFrame, features: Sequence[str], outcome: str = "readmitted") -> DataFrame:
    """Association strength of each categorical feature with the outcome."""
    stats = chi_square_stats(contingency(df, features, outcome))
    v = F.sqrt(F.try_divide(F.col("chi2"), F.col("n") * (F.least("rows", "cols") - 1)))
    strength = (
        F.when(F.col("v") > 0.5, "strong").when(F.col("v") >= 0.3, "moderate").when(F.col("v") >= 0.1, "weak").otherwise("negligible")
    )
    return stats.select("feature", "chi2", "n", v.alias("v")).withColumn("strength", strength)


def tukey_hsd(df: DataFrame, feature: str, outcome: str = "readmitted", groups: Sequence[str] | None = None) -> DataFrame:
    """All group pairs: mean difference, adjusted p, 95 % interval, rejection."""
    moments = group_moments(df, [feature], outcome, groups)
    parts = _anova_parts(moments)
    pooled = parts.select(
        "feature", F.col("groups").cast("double").alias("k"), (F.col("n") - F.col("groups")).cast("double").alias("dof"),
        (F.col("ss_within") / (F.col("n") - F.col("groups"))).alias("mse"),
    )
    left = moments.select("feature", F.col(outcome).alias("group_a"), F.col("n").alias("n_a"), F.col("mean").alias("mean_a"))
    right = moments.select("feature", F.col(outcome).alias("group_b"), F.col("n").alias("n_b"), F.col("mean").alias("mean_b"))
    # one row per outcome group on both sides
    pairs = left.join(right, "feature").filter(F.col("group_a") < F.col("group_b")).join(pooled, "feature")
    error = F.sqrt(F.col("mse") / 2 * (1.0 / F.col("n_a") + 1.0 / F.col("n_b")))
    rows = pairs.select(
        "feature", "group_a", "group_b", (F.col("mean_b") - F.col("mean_a")).alias("mean_diff"), error.alias("error"), "k", "dof"
    ).withColumn("q", F.abs("mean_diff") / F.col("error"))
    rows = rows.withColumns({"p": tukey_p("q", "k", "dof"), "reach": tukey_critical(F.lit(0.95), "k", "dof") * F.col("error")})
    return rows.select(
        "feature", "group_a", "group_b", "mean_diff", "q", "p",
        (F.col("mean_diff") - F.col("reach")).alias("lower"), (F.col("mean_diff") + F.col("reach")).alias("upper"),
        (F.col("p") < 0.05).alias("reject"),
    )


def mean_ci(df: DataFrame, features: Sequence[str], by: str = "readmitted") -> DataFrame:
    """Group means with 1.96 standard errors either way."""
    half = 1.96 * F.sqrt(F.col("var")) / F.sqrt("n")
    return group_moments(df, features, by).select(
        "feature", by, "n", "mean", half.alias("half_width"), (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper")
    )


# ---- cohort comparison; the cohorts overlap, so tests are descriptive ----
#
# Rows carry a ``cohort`` tag (stacked cohorts) or the flags of ``cohort_flags``; with flags each
# encounter is one row, counted for every cohort it belongs to.

COHORTS = ("all", "first", "repeated")
FLAGS = ("is_first", "is_repeated")


def in_cohort(df: DataFrame, cohort: str) -> Column:
    """Whether a row belongs to the cohort."""
    if "cohort" in df.columns:
        return F.col("cohort") == cohort
    return {"all": F.lit(True), "first": F.col("is_first"), "repeated": F.col("is_repeated")}[cohort]


def _marks(df: DataFrame) -> list[str]:
    return ["cohort"] if "cohort" in df.columns else list(FLAGS)


def compare_numeric(rows: DataFrame, features: Sequence[str], cohorts: Sequence[str] = COHORTS) -> DataFrame:
    """Count, mean, std, median and quartiles per cohort and feature.

    Quartiles come from running counts of the distinct values, one per cohort, so all cohorts
    share one ordering.
    """
    x = F.col("value")
    cells = numeric_cells(rows, features, _marks(rows))
    moments = cells.groupBy("feature").agg(
        *[F.struct(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")).alias(f"m_{c}")
          for c, v in ((c, F.when(in_cohort(rows, c), x)) for c in cohorts)]
    )
    placed = running_totals(cohort_value_counts(rows, features, cohorts), ["feature"], cohorts)

    def quartile(c: str, p: float) -> Column:
        position = (F.col(f"total_{c}") - 1) * F.lit(p)

        def value_at(index: Column) -> Column:
            held = (F.col(f"before_{c}") <= index) & (index < F.col(f"before_{c}") + F.col(c))
            return F.max(F.when(held, x))

        low, high = value_at(F.floor(position)), value_at(F.ceil(position))
        return low + (high - low) * F.max(position - F.floor(position))

    quartiles = placed.groupBy("feature").agg(
        *[F.struct(*[quartile(c, p).alias(name) for name, p in QUARTILES.items()]).alias(f"q_{c}") for c in cohorts]
    )
    one = moments.join(quartiles, "feature", "left")
    names = ["count", "mean", "std", *QUARTILES]
    both = [F.struct(F.lit(c).alias("cohort"), *[F.col(f"{'q' if n in QUARTILES else 'm'}_{c}.{n}").alias(n) for n in names]) for c in cohorts]
    return one.select("feature", F.inline(F.array(*both))).filter(F.col("count") > 0).select("cohort", "feature", *names)


def compare_categories(tagged: DataFrame, features: Sequence[str], n: int = 10) -> DataFrame:
    """Most frequent categories per cohort and feature with their rank."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in features]
    counts = (
        tagged.select("cohort", F.inline(F.array(*cells)))
        .filter(F.col("category").isNotNull())
        .groupBy("cohort", "feature", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_group(counts, ["cohort", "feature"], ["category"], n)


def cohort_value_counts(rows: DataFrame, features: Sequence[str], cohorts: Sequence[str]) -> DataFrame:
    """One row per feature and distinct value with one count column per cohort."""
    long = long_values(rows, features, extra=_marks(rows))
    return long.groupBy("feature", "range", "value").agg(*[F.count_if(in_cohort(rows, c)).alias(c) for c in cohorts])


def ks_two_sample(
    rows: DataFrame, features: Sequence[str], pairs: Sequence[tuple[str, str]] = COHORT_PAIRS, exact_up_to: int = EXACT_DISTANCE
) -> DataFrame:
    """Largest distance of two cohorts' distribution functions; p is exact where neither has more than ``exact_up_to`` rows, else asymptotic."""
    cohorts = sorted({c for p in pairs for c in p})
    running = running_totals(cohort_value_counts(rows, features, cohorts), ["feature"], cohorts)

    def ecdf(c: str) -> Column:
        return F.try_divide(F.col(f"before_{c}") + F.col(c), F.col(f"total_{c}"))

    one = running.groupBy("feature").agg(
        *[F.max(F.abs(ecdf(a) - ecdf(b))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)],
        *[F.max(f"total_{c}").cast("double").alias(c) for c in cohorts],
    )
    cells = [
        F.struct(
            F.lit(a).alias("cohort_a"), F.lit(b).alias("cohort_b"), F.col(f"d{i}").alias("statistic"),
            F.col(a).alias("n_a"), F.col(b).alias("n_b"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    tests = one.select("feature", F.inline(F.array(*cells)))
    tested = tests.withColumn("p", distance_p("statistic", "n_a", "n_b", F.lit(float(exact_up_to)))).drop("n_a", "n_b")
    return tested.withColumn("significant", F.col("p") < 0.05)


def kruskal(rows: DataFrame, features: Sequence[str], cohorts: Sequence[str] = COHORTS) -> DataFrame:
    """Kruskal-Wallis H over the stacked cohorts with tie correction."""
    counts = cohort_value_counts(rows, features, cohorts)
    counts = counts.withColumn("n", sum((F.col(c) for c in cohorts), F.lit(0)))
    placed = running_totals(counts, ["feature"])
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    sums = placed.groupBy("feature").agg(
        F.max("total_n").cast("double").alias("total"), F.sum(n * n * n - n).alias("ties"),
        *[F.sum(F.col(c)).cast("double").alias(f"n_{c}") for c in cohorts],
        *[F.sum(F.col(c) * rank).alias(f"r_{c}") for c in cohorts],
    )
    total = F.col("total")
    spread = sum((F.try_divide(F.col(f"r_{c}") * F.col(f"r_{c}"), F.col(f"n_{c}")) for c in cohorts), F.lit(0.0))
    h = 12 / (total * (total + 1)) * spread - 3 * (total + 1)
    corrected = F.try_divide(h, 1 - F.col("ties") / (total * total * total - total))
    tested = sums.select("feature", corrected.alias("statistic")).withColumn(
        "p", chi2_p("statistic", F.lit(float(len(cohorts) - 1)))
    )
    return tested.withColumn("significant", F.col("p") < 0.05)


def cohort_chi_square(rows: DataFrame, features: Sequence[str], cohorts: Sequence[str] = COHORTS) -> DataFrame:
    """Chi-square of category against cohort."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("category")) for c in features]
    long = rows.select(*_marks(rows), F.inline(F.array(*cells))).filter(F.col("category").isNotNull())
    counts = long.groupBy("feature", "category").agg(*[F.count_if(in_cohort(rows, c)).alias(c) for c in cohorts])
    tall = [F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in cohorts]
    return chi_square_test(counts.select("feature", "category", F.inline(F.array(*tall))).filter(F.col("n") > 0))


def cohens_d(rows: DataFrame, features: Sequence[str], pairs: Sequence[tuple[str, str]] = COHORT_PAIRS) -> DataFrame:
    """Standardised mean difference of cohort pairs with its size label."""
    cohorts = sorted({c for p in pairs for c in p})
    x = F.col("value")
    one = numeric_cells(rows, features, _marks(rows)).groupBy("feature").agg(
        *[F.avg(F.when(in_cohort(rows, c), x)).alias(f"mean_{c}") for c in cohorts],
        *[F.var_samp(F.when(in_cohort(rows, c), x)).alias(f"var_{c}") for c in cohorts],
    )
    cells = [
        F.struct(
            F.lit(a).alias("cohort_a"), F.lit(b).alias("cohort_b"),
            F.try_divide(
                F.col(f"mean_{a}") - F.col(f"mean_{b}"), F.sqrt((F.col(f"var_{a}") + F.col(f"var_{b}")) / 2)
            ).alias("d"),
        )
        for a, b in pairs
    ]
    label = F.when(F.abs("d") < 0.5, "Small").when(F.abs("d") < 0.8, "Medium").otherwise("Large")
    return one.select("feature", F.inline(F.array(*cells))).withColumn("effect", label)
