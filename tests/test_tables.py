"""Sources, cleaning, lookups, cohorts and quality on hand-made rows."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlight.functions import scalars
from wardlight.operators import clean, cohorts, lookup, outcomes, quality
from wardlight.sources import readers, sinks


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


DICTIONARY = """ID,description,Type
1,Emergency,admission_type_id
6,NULL,admission_type_id
2,"Transfer, short term",discharge_disposition_id
4, Court order,admission_source_id
"""


@pytest.fixture
def codes(spark, tmp_path):
    path = tmp_path / "ids.csv"
    path.write_text(DICTIONARY)
    return readers.read_code_dictionary(spark, str(path))


def test_code_dictionary(codes):
    assert rows(codes, "ID", "description")[0] == (1, "Emergency")
    found = {r["ID"]: r["description"] for r in codes.collect()}
    assert found == {1: "Emergency", 6: None, 2: "Transfer, short term", 4: " Court order"}


def test_decode(spark, codes):
    df = spark.createDataFrame([(1,), (6,), (9,), (None,)], "admission_type_id int")
    named = lookup.decode(df.filter("admission_type_id < 9"), "admission_type_id", codes, "admission_type_id")
    assert rows(named, "admission_type_id", "admission_type_name") == [(1, "Emergency"), (6, None)]
    loose = lookup.decode(df, "admission_type_id", codes, "admission_type_id", on_missing="null")
    assert loose.count() == 4
    with pytest.raises(PySparkException):
        lookup.decode(df, "admission_type_id", codes, "admission_type_id").collect()


def test_code_ranges(spark):
    want = {
        "139.5": "Unknown", "0.5": "Unknown", "1000": "Unknown", "": "Unknown", None: "Unknown", "V": lookup.ICD9_PREFIXES["V"],
        "e12": "Unknown", "250.83": "Endocrine, Nutritional, Metabolic", "E909": lookup.ICD9_PREFIXES["E"], "?": "Unknown",
    }
    df = lookup.map_code_ranges(spark.createDataFrame([(c,) for c in want], "diag_1 string"), "diag_1")
    assert {r["diag_1"]: r["diag_1_category"] for r in df.collect()} == want


def test_model_table_and_sinks(spark, tmp_path):
    path = tmp_path / "model.csv"
    path.write_text("Unnamed: 0,readmitted_flag,age\n0,1,70\n1,0,\n")
    schema = T.StructType([T.StructField("Unnamed: 0", T.LongType()), T.StructField("readmitted_flag", T.IntegerType()), T.StructField("age", T.DoubleType())])
    df = readers.read_model_table(spark, str(path), schema)
    assert df.columns == ["readmitted_flag", "age"]
    sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, schema="readmitted_flag int, age double")
    assert rows(back.fillna(-1.0)) == [(0, -1.0), (1, 70.0)]
    sinks.write_text(spark.createDataFrame([("a", 1.5)], "metric string, value double"), str(tmp_path / "txt"))
    assert spark.read.text(str(tmp_path / "txt")).first()[0] == "a: 1.5"
    with pytest.raises(ValueError):
        readers.read_encounters(spark, str(path), schema, required=["encounter_id"])


def test_combine_parts_joins_on_the_key(spark):
    ids = spark.createDataFrame([(2, 20), (1, 10)], "encounter_id int, patient_nbr int")
    x = spark.createDataFrame([(1, "a"), (2, "b")], "encounter_id int, f string")
    y = spark.createDataFrame([(2, "NO"), (1, "<30")], "encounter_id int, readmitted string")
    df = readers.combine_parts(ids, x, y, ["encounter_id"])
    assert rows(df, "patient_nbr", "f", "readmitted") == [(10, "a", "<30"), (20, "b", "NO")]


def test_low_variance_is_strict_and_counts_nulls(spark):
    df = spark.range(100).select(
        F.col("id"),
        F.when(F.col("id") > 0, "x").otherwise("y").alias("exactly"),
        F.when(F.col("id") >= 0, "x").alias("constant"),
        F.lit(None).cast("string").alias("empty"),
        (F.col("id") % 2).alias("even"),
    )
    assert clean.drop_low_variance(df, ["id"]).columns == ["id", "exactly", "even"]
    near = df.unionByName(df.filter("id > 0"))
    report = quality.low_variance(near, ["id"]).collect()
    assert {r["feature"]: (r["type"], r["unique_values"]) for r in report} == {
        "constant": ("Zero Variance", 1), "empty": ("Zero Variance", 1), "exactly": ("Near-Zero Variance", 2),
    }


def test_impute_and_fill(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, None), (9.0, "a"), (None, "b")], "x double, s string")
    got = rows(clean.impute(df))
    assert got == sorted([(1.0, "b"), (2.0, "a"), (4.0, "a"), (9.0, "a"), (3.0, "b")])
    assert clean.impute(df, exclude=["x"]).filter("x is null").count() == 1
    assert clean.drop_null_rows(df).count() == 3
    assert clean.drop_sparse(df, 0.1).columns == [] and clean.drop_sparse(df, 0.2).columns == ["x", "s"]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "No", "a", 2.0, "NO")], "encounter_id int, insulin string, other string, n double, readmitted string")
    assert clean.feature_columns(df, ["encounter_id"], first=2) == ["insulin", "other"]
    assert clean.split_by_type(df) == (["encounter_id", "n"], ["insulin", "other", "readmitted"])
    assert clean.drop_if_present(df, ["n", "examide"]).columns == ["encounter_id", "insulin", "other", "readmitted"]
    with pytest.raises(ValueError):
        clean.drop_columns(df, ["weight"])


def test_status_columns_by_name_and_value(spark):
    data = [("No", "Up", "a", "NO", "1"), ("Steady", None, "b", "<30", "2"), ("No", "No", "c", "NO", "3")]
    df = spark.createDataFrame(data, "insulin string, plain string, letters string, readmitted string, drugcode string")
    assert clean.detect_status_columns(df) == ["insulin", "drugcode", "plain"]


def test_first_and_repeated(spark):
    data = [(5, 1, "a"), (3, 1, "b"), (7, 2, "c"), (1, None, "d"), (2, None, "e")]
    df = spark.createDataFrame(data, "encounter_id int, patient_nbr int, v string")
    first = cohorts.first_per_key(df, "patient_nbr", "encounter_id")
    assert sorted(r["v"] for r in first.collect()) == ["b", "c", "d"]
    assert sorted(r["v"] for r in cohorts.repeated_keys(df, "patient_nbr").collect()) == ["a", "b"]
    tagged = cohorts.cohort_union(df, "patient_nbr", "encounter_id").groupBy("cohort").count()
    assert rows(tagged) == [("all", 5), ("first", 3), ("repeated", 2)]


def test_timeline_with_one_hot_key(spark, tiny_ranges):
    df = spark.range(40).select(F.col("id").alias("e"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(-1).alias("p"))
    got = {r["e"]: r["ordinal"] for r in cohorts.timeline(df, "p", "e").collect()}
    hot = [e for e in range(40) if e % 4]
    assert all(got[e] == i + 1 for i, e in enumerate(hot))
    assert all(got[e] == 1 for e in range(0, 40, 4))


def test_quality_tables(spark):
    df = spark.createDataFrame([("x", None), (None, None), ("y", "z")], "a string, b string")
    assert rows(quality.test_status(df, "a", "b"), "test", "status", "n") == sorted(
        [("a", "Measured", 2), ("a", "Not Measured", 0), ("b", "Measured", 1), ("b", "Not Measured", 1), ("both", "Measured", 1), ("only_one", "Measured", 1)]
    )
    assert quality.most_missing_columns(df, 1) == ["b"]
    one = quality.table_quality(df).first()
    assert (one["rows"], one["columns"], one["missing_cells"], one["columns_with_missing"]) == (3, 2, 3, 2)
    assert rows(quality.constant_values(df)) == [("b", "z")]


def test_top_per_group_is_exact_with_many_labels(spark):
    df = spark.range(5000).select(F.lit("g").alias("f"), F.col("id").cast("string").alias("v"), (F.col("id") % 1000).alias("n"))
    top = quality.top_per_group(df, ["f"], ["v"], 3)
    assert rows(top, "rank", "v", "n") == [(1, "1999", 999), (2, "2999", 999), (3, "3999", 999)]


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(float(a), "NO") for a in (0, 30, 31, 100, 101)], "age double, readmitted string")
    band = scalars.bin_right_closed(F.col("age"), outcomes.AGE_EDGES, outcomes.AGE_LABELS)
    assert [r[0] for r in df.select(band).collect()] == [None, "<30", "30-39", "80+", None]
    text = spark.createDataFrame([("[0-10)", "NO")], "age string, readmitted string")
    assert rows(outcomes.age_groups(text)) == [("[0-10)", "NO", 1)]


def test_top_with_other(spark):
    long = spark.range(66).select(F.explode(F.sequence(F.lit(0), F.col("id") % 11)).alias("c"))
    df = long.select(F.col("c").cast("string"))
    got = dict(rows(outcomes.top_with_other(df, "c")))
    assert len(got) == 10 and got["Other"] == 12 + 6
    assert len(rows(outcomes.top_with_other(df.filter("c < '5' or c = '10'"), "c"))) == 6


def test_risk_needs_fifty_rows(spark):
    df = spark.range(99).select(
        F.when(F.col("id") < 50, "big").otherwise("small").alias("g"), F.lit("<30").alias("readmitted"), F.lit(1.0).alias("s"), F.lit(2.0).alias("p")
    )
    got = outcomes.risk_ranking(df, "g", "s", "p").collect()
    assert [(r["g"], r["risk_score"]) for r in got] == [("big", 100.0)]


def test_status_usage_and_combinations(spark):
    data = [("No", "Yes", "NO"), ("Up", "No", "<30"), ("No", "No", "<30"), (None, "No", "NO")]
    df = spark.createDataFrame(data, "med_x string, med_y string, readmitted string")
    usage = rows(outcomes.status_usage(df, ["med_x", "med_y"]))
    assert usage == [("Med X - Up", "<30", 50.0), ("Med Y", "NO", 50.0)]
    combos = rows(outcomes.status_combinations(df, ["med_x", "med_y"]))
    assert combos == [("Med X", 1, 25.0, 100.0), ("Med Y", 1, 25.0, 0.0)]


def test_labels(spark):
    df = spark.createDataFrame([("max_glu_serum", "x" * 21)], "a string, b string")
    got = df.select(scalars.label_text(F.col("a")), scalars.truncate_label(F.col("b")), scalars.truncate_label(F.col("a"))).first()
    assert list(got) == ["Max Glu Serum", "x" * 20 + "...", "max_glu_serum"]


def test_distribution_of_many_categories(spark):
    df = spark.range(21).select(F.col("id").cast("string").alias("f"), F.lit("NO").alias("readmitted"))
    rows = outcomes.outcome_distribution(df, "f").collect()
    assert len(rows) == 21 and all(r["probability"] == 1.0 for r in rows)