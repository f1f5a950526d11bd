"""Column profiles: missing values, uniqueness, low variance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardlight.operators.gram import joint_nulls

from wardlight.functions.scalars import measured_flag, share


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Row count and nulls per column (one action, one number per column)."""
    row = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    ).first()
    return row["rows"], {c: row["rows"] - row[f"c{i}"] for i, c in enumerate(df.columns)}


def completeness(df: DataFrame) -> DataFrame:
    """``(column, records_present, missing, completeness)`` for every column, one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in df.columns])
    return counts.unpivot(["rows"], list(df.columns), "column", "records_present").select(
        "column",
        "records_present",
        (F.col("rows") - F.col("records_present")).alias("missing"),
        F.try_divide(F.col("records_present"), F.col("rows")).alias("completeness"),
    )


def table_quality(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells, missing percentage, columns with gaps."""
    width = len(df.columns)
    profile = completeness(df)
    return profile.agg(
        F.max(F.col("records_present") + F.col("missing")).alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.sum("missing").alias("missing_cells"),
        share(F.sum("missing"), F.max(F.col("records_present") + F.col("missing")) * width).alias("missing_pct"),
        F.count_if(F.col("missing") > 0).alias("columns_with_missing"),
    )


def top_missing(df: DataFrame, n: int = 15) -> DataFrame:
    """Columns with the largest share of nulls."""
    return (
        completeness(df)
        .select(
            "column",
            share(F.col("missing"), F.col("missing") + F.col("records_present")).alias("missing_pct"),
            F.col("missing").alias("missing_count"),
        )
        .orderBy(F.desc("missing_pct"), "column")
        .limit(n)
    )


def most_missing_columns(df: DataFrame, k: int) -> list[str]:
    """The ``k`` columns with the most nulls; schema order breaks ties."""
    _, nulls = null_counts(df)
    return sorted(df.columns, key=lambda c: -nulls[c])[:k]


def gap_columns(df: DataFrame, ids: Sequence[str] = (), max_features: int | None = None) -> list[str]:
    """Non-id columns with nulls, most missing first when there are too many."""
    _, nulls = null_counts(df.drop(*ids))
    gaps = [c for c, n in nulls.items() if n]
    if max_features is not None and len(gaps) > max_features:
        gaps = sorted(gaps, key=lambda c: -nulls[c])[:max_features]
    return gaps


#: Columns whose pairs one aggregate still holds well.
NATIVE_COLUMNS = 25


def co_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column_a, column_b, n, n_a, n_b, n_ab)``: joint null counts of every pair, one pass."""
    if len(cols) > NATIVE_COLUMNS:
        names = F.array(*[F.lit(c) for c in cols])
        # the later column of a pair comes first, as below
        return joint_nulls(df, cols).select(
            names[F.col("b").cast("int")].alias("column_a"), names[F.col("a").cast("int")].alias("column_b"),
            *[F.col(s).cast("long").alias(t) for s, t in (("n", "n"), ("sb", "n_a"), ("sa", "n_b"), ("sab", "n_ab"))],
        )
    nulls = {c: F.sum(F.col(c).isNull().cast("long")) for c in cols}
    pairs = [
        F.struct(
            F.lit(a).alias("column_a"),
            F.lit(b).alias("column_b"),
            F.count(F.lit(1)).alias("n"),
            nulls[a].alias("n_a"),
            nulls[b].alias("n_b"),
            F.sum((F.col(a).isNull() & F.col(b).isNull()).cast("long")).alias("n_ab"),
        )
        for b, a in combinations(cols, 2)
    ]
    return df.select(*cols).agg(F.array(*pairs).alias("pairs")).select(F.inline("pairs"))


def missing_correlation(df: DataFrame, ids: Sequence[str] = (), cols: Sequence[str] | None = None) -> DataFrame:
    """Correlation of null indicators, strict lower triangle, from joint counts."""
    cols = gap_columns(df, ids) if cols is None else cols
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    n, a, b, ab = (F.col(c).cast("double") for c in ("n", "n_a", "n_b", "n_ab"))
    phi = F.try_divide(n * ab - a * b, F.sqrt(a * (n - a) * b * (n - b)))
    return co_missing(df, cols).select("column_a", "column_b", phi.alias("correlation"))


def presence_matrix(df: DataFrame, cols: Sequence[str], key: str | None = None) -> DataFrame:
    """0/1 presence per cell plus the number of present cells of the row."""
    bits = {c: F.col(c).isNotNull().cast("int") for c in cols}
    lead = [key] if key else []
    return df.select(
        *lead,
        *[bit.alias(f"has_{c}") for c, bit in bits.items()],
        sum(bits.values(), F.lit(0)).alias("present"),
    )


def missing_linkage(df: DataFrame, ids: Sequence[str] = (), max_features: int | None = None) -> DataFrame:
    """Average-linkage merges of columns by ``1 - |null correlation|``.

    All pair distances come from one Spark aggregate; the merge order is then worked out
    on that k x k result, k being the number of columns with gaps (at most ``max_features`` if given).
    """
    cols = gap_columns(df, ids, max_features)
    schema = "step int, left string, right string, distance double, size int"
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], schema)
    distance = {}
    for r in missing_correlation(df, ids, cols).collect():
        gap = 1.0 - abs(r["correlation"] or 0.0)
        distance[r["column_a"], r["column_b"]] = distance[r["column_b"], r["column_a"]] = gap
    groups = {c: (c,) for c in cols}
    steps = []
    while len(groups) > 1:
        def gap_between(pair):
            return float(np.mean([distance[a, b] for a in groups[pair[0]] for b in groups[pair[1]]]))

        left, right = min(combinations(groups, 2), key=gap_between)
        merged = groups[left] + groups[right]
        steps.append((len(steps) + 1, left, right, gap_between((left, right)), len(merged)))
        groups = {g: m for g, m in groups.items() if g not in (left, right)}
        groups["+".join(merged)] = merged
    return df.sparkSession.createDataFrame(steps, schema)


def missing_clusters(df: DataFrame, k: int = 5, ids: Sequence[str] = (), seed: int = 42, starts: int = 10) -> DataFrame:
    """k-means of columns by their null pattern: ``(column, cluster, missing_pct)``.

    Each column is a point with one coordinate per row. Only inner products matter for
    k-means, so the joint null counts (k x k) are factored into an equivalent embedding
    of at most as many dimensions as there are columns. Of ``starts`` runs the first with the
    smallest inertia counts; clusters are numbered by their first column in the order of names.
    """
    cols = gap_columns(df, ids)
    spark = df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "column string, cluster int, missing_pct double")
    k = k if len(cols) >= k else max(2, len(cols) - 1)
    where = {c: i for i, c in enumerate(cols)}
    gram = np.zeros((len(cols), len(cols)))
    rows = 0
    for r in co_missing(df, cols).collect():
        i, j = where[r["column_a"]], where[r["column_b"]]
        gram[i, j] = gram[j, i] = r["n_ab"]
        gram[i, i], gram[j, j], rows = r["n_a"], r["n_b"], r["n"]
    scale, axes = np.linalg.eigh(gram)
    points = axes * np.sqrt(np.clip(scale, 0.0, None))
    table = spark.createDataFrame(
        [(c, points[i].tolist(), float(100.0 * gram[i, i] / rows)) for c, i in where.items()],
        "column string, point array<double>, missing_pct double",
    ).withColumn("features", array_to_vector("point"))
    table = table.cache()
    models = [KMeans(k=k, seed=seed + i, maxIter=50).fit(table) for i in range(starts)]
    best = min(models, key=lambda m: round(m.summary.trainingCost, 6))
    names = {int(r["prediction"]): r["first"] for r in best.transform(table).groupBy("prediction").agg(F.min("column").alias("first")).collect()}
    number = F.create_map(*[F.lit(v) for i, c in enumerate(sorted(names, key=names.get)) for v in (c, i)])
    return best.transform(table).select("column", number[F.col("prediction")].alias("cluster"), "missing_pct")


@dataclass(frozen=True)
class Dominant:
    """Most frequent value of a column and how often it occurs."""

    column: str
    value: str | None
    count: int
    total: int


def dominant_shares(df: DataFrame, ids: Sequence[str] = ()) -> list[Dominant]:
    """Most frequent value per column, exact wherever one value fills over half the rows.

    A frequent-items sketch names the candidates and a second pass counts them, so the
    distinct values of wide columns are never shuffled. Null counts as a value. The sketch
    is off by less than a hundredth of the rows, so it cannot miss a majority value.
    """
    cols = [c for c in df.columns if c not in set(ids)]
    if not cols:
        return []
    text = df.select([F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    top = text.agg(*[F.expr(f"approx_top_k(c{i}, 2, 256)").alias(f"c{i}") for i in range(len(cols))]).first()
    candidates = [[item["item"] for item in top[f"c{i}"]] + [None] for i in range(len(cols))]
    counted = text.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            F.count_if(F.col(f"c{i}").eqNullSafe(F.lit(v).cast("string"))).alias(f"n{i}_{j}")
            for i, values in enumerate(candidates)
            for j, v in enumerate(values)
        ],
    ).first()
    best = []
    for i, c in enumerate(cols):
        counts = [(counted[f"n{i}_{j}"], v) for j, v in enumerate(candidates[i])]
        n, value = max(counts, key=lambda p: p[0])
        best.append(Dominant(c, value, n, counted["rows"]))
    return best


def string_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, value)`` rows with every value as text, nulls kept."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(F.inline(F.array(*cells)))


def low_variance(df: DataFrame, ids: Sequence[str] = (), threshold: float = 0.01) -> DataFrame:
    """Zero and near-zero variance columns with dominant value, share and distinct count."""
    if not 0 <= threshold < 0.5:
        raise ValueError("threshold must be below one half")
    schema = "feature string, type string, dominant_value string, dominant_pct double"
    found = []
    for p in dominant_shares(df, ids):
        if p.count == p.total:
            found.append((p.column, "Zero Variance", p.value, 100.0))
        elif p.count > (1 - threshold) * p.total:
            found.append((p.column, "Near-Zero Variance", p.value, 100.0 * p.count / p.total))
    flagged = df.sparkSession.createDataFrame(found, schema)
    if not found:
        return flagged.withColumn("unique_values", F.lit(0).cast("long"))
    values = string_cells(df, [f[0] for f in found]).distinct().groupBy("feature").count()
    return flagged.join(values.withColumnRenamed("count", "unique_values"), "feature")


def distinct_counts(df: DataFrame, ids: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column, flagged when it is an id or nearly constant."""
    if approximate:
        one = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns])
        counts = one.unpivot([], list(df.columns), "feature", "distinct_count")
    else:
        cells = string_cells(df, df.columns).distinct()
        counts = cells.groupBy("feature").agg(F.count("value").alias("distinct_count"))
    return counts.select(
        "feature",
        "distinct_count",
        F.col("feature").isin(list(ids)).alias("is_id"),
        (F.col("distinct_count") <= 1).alias("low_uniqueness"),
    )


def constant_values(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct non-null value, and that value."""
    ends = df.agg(
        *[F.struct(F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high")).alias(c) for c in df.columns]
    )
    return (
        ends.unpivot([], list(df.columns), "feature", "ends")
        .filter(F.col("ends.low").eqNullSafe(F.col("ends.high")))
        .select("feature", F.col("ends.low").alias("value"))
    )


def test_status(df: DataFrame, a: str, b: str) -> DataFrame:
    """Measured / not measured counts and shares of two tests among rows with at least one.

    ``(test, status, n, pct)`` rows; the pseudo tests ``both`` and ``only_one`` carry the
    joint counts.
    """
    has_a, has_b = F.col(a).isNotNull(), F.col(b).isNotNull()
    counts = df.filter(has_a | has_b).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(a).alias("a"),
        F.count(b).alias("b"),
        F.count_if(has_a & has_b).alias("both"),
    )
    n, n_a, n_b, both = (F.col(c) for c in ("n", "a", "b", "both"))
    cells = [
        (a, "Measured", n_a), (a, "Not Measured", n - n_a),
        (b, "Measured", n_b), (b, "Not Measured", n - n_b),
        ("both", "Measured", both), ("only_one", "Measured", n - both),
    ]
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(test).alias("test"),
                        F.lit(status).alias("status"),
                        count.alias("n"),
                        share(count, n).alias("pct"),
                    )
                    for test, status, count in cells
                ]
            )
        )
    )


test_status.__test__ = False  # an operator, not a test case


def status_crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of the two measured flags among rows with at least one result."""
    return (
        df.filter(F.col(a).isNotNull() | F.col(b).isNotNull())
        .groupBy(measured_flag(F.col(a)).alias(a), measured_flag(F.col(b)).alias(b))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """Most frequent non-null values of each column with their rank."""
    counts = (
        string_cells(df, cols)
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_group(counts, ["feature"], ["value"], n)


def top_per_group(counts: DataFrame, by: Sequence[str], label: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of each group by falling ``n``, label as tie-break.

    Candidates are thinned inside hash slices first, so a group with very many labels is
    not ordered in one task.
    """
    order = [F.desc("n"), *label]
    slices = counts.withColumn("slice", F.pmod(F.xxhash64(*label), F.lit(64)))
    first = W.partitionBy(*by, "slice").orderBy(*order)
    kept = slices.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= n)
    final = W.partitionBy(*by).orderBy(*order)
    return kept.drop("slice", "rank").withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n)
