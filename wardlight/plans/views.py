"""Encounter-shaped views over the test tables, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

E1_SQL = """
SELECT o_orderkey AS encounter_id, o_custkey AS patient_nbr,
       CASE o_orderstatus WHEN 'F' THEN '<30' WHEN 'P' THEN '>30' ELSE 'NO' END AS readmitted,
       o_orderpriority AS grp, c_mktsegment AS segment, n_name AS nation,
       o_totalprice AS amount, c_acctbal AS balance
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

E2_SQL = """
SELECT l_orderkey AS patient_nbr,
       CASE l_returnflag WHEN 'R' THEN '<30' WHEN 'A' THEN '>30' ELSE 'NO' END AS readmitted,
       CASE WHEN l_linenumber IN (1, 2) THEN 'Steady' WHEN l_linenumber = 3 THEN 'Up'
            WHEN l_linenumber = 4 THEN 'Down' ELSE 'No' END AS med_a,
       CASE WHEN l_linestatus = 'O' THEN 'Yes' ELSE 'No' END AS med_b,
       CASE WHEN l_tax >= 0.05 THEN 'Steady' ELSE 'No' END AS med_c,
       l_quantity * 2 AS age, l_quantity AS quantity, l_extendedprice AS price,
       l_discount AS discount, l_tax AS tax
FROM lineitem"""

E3_SQL = """
SELECT event_id AS encounter_id, user_id AS patient_nbr, ts, event_type AS status, value FROM events"""

E4_SQL = """
SELECT l_orderkey AS patient_nbr, CASE WHEN l_tax = 0.0 THEN NULL ELSE l_tax END AS tax,
       CASE WHEN l_discount >= 0.08 THEN NULL ELSE l_discount END AS discount,
       CASE WHEN l_linenumber > 2 THEN NULL ELSE l_returnflag END AS test_a,
       CASE WHEN l_linenumber > 3 THEN NULL ELSE l_linestatus END AS test_b,
       'No' AS const_col,
       CASE WHEN l_linenumber = 1 AND l_quantity = 1.0 THEN 'Yes' ELSE 'No' END AS rare_col
FROM lineitem"""

E5_SQL = """
SELECT p_partkey AS id,
       CASE p_type WHEN 'PROMO' THEN concat('V', CAST(p_size AS VARCHAR(10)))
                   WHEN 'LARGE' THEN concat('E', CAST(800 + p_size AS VARCHAR(10)))
                   WHEN 'SMALL' THEN NULL WHEN 'ECONOMY' THEN '?'
                   WHEN 'MEDIUM' THEN concat(CAST(p_size * 20 - 1 AS VARCHAR(10)), '.5')
                   ELSE CAST(p_size * 20 - 1 AS VARCHAR(10)) END AS code
FROM part"""

E6_SQL = """
SELECT r_regionkey AS ID, CASE WHEN r_name = 'ASIA' THEN NULL ELSE r_name END AS description, 'region' AS Type FROM region
UNION ALL SELECT n_nationkey, n_name, 'nation' FROM nation"""

E7_SQL = """
SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       (l_quantity + CASE WHEN l_returnflag = 'R' THEN 10 ELSE 0 END) / 60.0 AS score
FROM lineitem"""

REP_SQL = "SELECT * FROM {0} WHERE patient_nbr IN (SELECT patient_nbr FROM {0} GROUP BY 1 HAVING count(*) > 1)"

COHORTS_SQL = """
SELECT 'all' AS cohort, * FROM e1
UNION ALL SELECT 'first', * FROM e1 WHERE encounter_id IN (SELECT min(encounter_id) FROM e1 GROUP BY patient_nbr)
UNION ALL SELECT 'repeated', * FROM e1 WHERE patient_nbr IN (SELECT patient_nbr FROM e1 GROUP BY 1 HAVING count(*) > 1)"""

SQL_VIEWS = {
    "e1": E1_SQL, "e2": E2_SQL, "e3": E3_SQL, "e4": E4_SQL, "e5": E5_SQL, "e6": E6_SQL, "e7": E7_SQL,
    "rep1": REP_SQL.format("e1"), "rep2": REP_SQL.format("e2"), "cohorts": COHORTS_SQL,
}
NEEDS = {"rep1": ["e1"], "rep2": ["e2"], "cohorts": ["e1"]}


def with_views(names: str, body: str) -> str:
    """SQL text with the named views (and what they need) in front of ``body``.

    ``body`` starts with further comma-led CTEs or with SELECT.
    """
    ordered: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in ordered:
                ordered.append(n)
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in ordered)
    return f"WITH {ctes}\n{body}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def e1(spark: SparkSession, folder: str) -> DataFrame:
    """Encounters from orders: unique encounter key, three outcome classes."""
    orders = table(spark, folder, "orders")
    customer = table(spark, folder, "customer")
    nation = table(spark, folder, "nation")
    status = F.col("o_orderstatus")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("o_orderkey").alias("encounter_id"),
            F.col("o_custkey").alias("patient_nbr"),
            F.when(status == "F", "<30").when(status == "P", ">30").otherwise("NO").alias("readmitted"),
            F.col("o_orderpriority").alias("grp"),
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("nation"),
            F.col("o_totalprice").alias("amount"),
            F.col("c_acctbal").alias("balance"),
        )
    )


def e2(spark: SparkSession, folder: str) -> DataFrame:
    """Encounters from lineitem: some single-row patients, status columns, numeric age."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("patient_nbr"),
        F.when(flag == "R", "<30").when(flag == "A", ">30").otherwise("NO").alias("readmitted"),
        F.when(line.isin(1, 2), "Steady").when(line == 3, "Up").when(line == 4, "Down").otherwise("No").alias("med_a"),
        F.when(F.col("l_linestatus") == "O", "Yes").otherwise("No").alias("med_b"),
        F.when(F.col("l_tax") >= 0.05, "Steady").otherwise("No").alias("med_c"),
        (F.col("l_quantity") * 2).alias("age"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def e3(spark: SparkSession, folder: str) -> DataFrame:
    """Ordered event sequence per patient."""
    return table(spark, folder, "events").select(
        F.col("event_id").alias("encounter_id"),
        F.col("user_id").alias("patient_nbr"),
        "ts",
        F.col("event_type").alias("status"),
        "value",
    )


def e4(spark: SparkSession, folder: str) -> DataFrame:
    """Manufactured nulls, a constant and a rarely changing column."""
    line = F.col("l_linenumber")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("patient_nbr"),
        F.when(F.col("l_tax") != 0.0, F.col("l_tax")).alias("tax"),
        F.when(F.col("l_discount") < 0.08, F.col("l_discount")).alias("discount"),
        F.when(line <= 2, F.col("l_returnflag")).alias("test_a"),
        F.when(line <= 3, F.col("l_linestatus")).alias("test_b"),
        F.lit("No").alias("const_col"),
        F.when((line == 1) & (F.col("l_quantity") == 1.0), "Yes").otherwise("No").alias("rare_col"),
    )


def e5(spark: SparkSession, folder: str) -> DataFrame:
    """Chapter-style codes with prefixes, gap values, junk and nulls."""
    kind, size = F.col("p_type"), F.col("p_size")
    plain = (size * 20 - 1).cast("string")
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(kind == "PROMO", F.concat(F.lit("V"), size.cast("string")))
        .when(kind == "LARGE", F.concat(F.lit("E"), (size + 800).cast("string")))
        .when(kind == "SMALL", F.lit(None).cast("string"))
        .when(kind == "ECONOMY", "?")
        .when(kind == "MEDIUM", F.concat(plain, F.lit(".5")))
        .otherwise(plain)
        .alias("code"),
    )


def e6(spark: SparkSession, folder: str) -> DataFrame:
    """Stacked dictionary with one missing description."""
    region = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("ID"),
        F.when(F.col("r_name") != "ASIA", F.col("r_name")).alias("description"),
        F.lit("region").alias("Type"),
    )
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("ID"), F.col("n_name").alias("description"), F.lit("nation").alias("Type")
    )
    return region.unionByName(nation)


def e7(spark: SparkSession, folder: str) -> DataFrame:
    """Scored rows with heavy score ties."""
    hit = F.col("l_returnflag") == "R"
    return table(spark, folder, "lineitem").select(
        hit.cast("int").alias("label"),
        ((F.col("l_quantity") + F.when(hit, 10).otherwise(0)) / 60.0).alias("score"),
    )
