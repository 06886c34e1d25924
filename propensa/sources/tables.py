"""Readers: the customer file, the raw relational tables, and the profile built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensa.functions.columns import propensity
from propensa.functions.hashing import uniforms
from propensa.sources.schemas import CUSTOMER, TABLES


def read_customers(spark: SparkSession, path: str, schema=CUSTOMER) -> DataFrame:
    """Customer CSV with a header line, typed by a declared schema; empty cells and NaN are null.

    Columns are found by their name in the header, in any order; others are left out, and a missing
    one is an error. So is a cell that does not fit its type, and a file whose header differs from
    that of the first.
    """
    reader = spark.read.option("header", True)
    header = reader.csv(path).columns
    missing = [f.name for f in schema if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    declared = {f.name: f for f in schema}
    found = T.StructType([declared.get(c, T.StructField(c, T.StringType())) for c in header])
    strict = reader.option("enforceSchema", False).option("mode", "FAILFAST")
    rows = strict.schema(found).csv(path).select(*schema.fieldNames())
    numbers = [f.name for f in schema if f.dataType.typeName() == "double"]
    return rows.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})


def customers_from_records(
    spark: SparkSession, records: Sequence[Mapping], schema=CUSTOMER
) -> DataFrame:
    """A few customers given as dictionaries; fields they lack are null."""
    rows = [
        tuple(
            float(r[f.name])
            if f.dataType.typeName() == "double" and r.get(f.name) is not None
            else r.get(f.name)
            for f in schema
        )
        for r in records
    ]
    return spark.createDataFrame(rows, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw table under its declared schema, so that no job runs to look into file footers."""
    reader = spark.read.schema(TABLES[name]) if name in TABLES else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def customers_or_profile(spark: SparkSession, path: str, sf_dir: str) -> DataFrame:
    """The customer file if it is there, otherwise the profile with the same schema."""
    try:
        return read_customers(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return customer_profile(spark, sf_dir)


def _pick(draw: Column, steps: list[tuple[float, str | None]], last: str) -> Column:
    out = F
    for limit, value in steps:
        out = out.when(draw < limit, F.lit(value))
    return out.otherwise(F.lit(last))


def customer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, from customer, nation, orders, lineitem and part.

    Line items, read with three columns, are shuffled for the joins with parts and orders unless
    Spark finds those small enough to broadcast; then they are added up to one row per (customer,
    part type). Orders shrink to one row per customer before they leave their map tasks.
    """
    orders = table(spark, sf_dir, "orders")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("trips"),
        F.count_if(F.col("o_orderpriority") == "2-HIGH").alias("followups"),
    )
    per_type = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("l_custkey"), "p_type")
        .agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))
    )
    pitched = per_type.groupBy("l_custkey").agg(
        F.round(F.sum("qty") / F.sum("n")).alias("duration"),
        F.min(F.when(F.col("p_type").isNotNull(), F.struct(-F.col("n"), "p_type")))["p_type"].alias(
            "product"
        ),
    )
    # Customer and nation are joined on the nation key; the rest on the customer key.
    base = (
        table(spark, sf_dir, "customer")
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"), "left")
        .join(pitched, F.col("c_custkey") == F.col("l_custkey"), "left")
    )

    # One hash per purpose, computed once in a projection of its own.
    salts = (
        "age agenull toc gender persons star starnull mar pass score car child chnull desig label"
    ).split()
    drawn = base.select("*", *uniforms("c_custkey", {f"u_{s}": s for s in salts}))

    def u(salt: str) -> Column:
        return F.col(f"u_{salt}")

    def unless(salt: str, rate: float, value: Column) -> Column:
        return F.when(u(salt) >= rate, value.cast("double"))

    profile = drawn.select(
        F.col("c_custkey").alias("CustomerID"),
        unless("agenull", 0.03, 18 + F.floor(47 * u("age"))).alias("Age"),
        _pick(u("toc"), [(0.02, None), (0.70, "Self Enquiry")], "Company Invited").alias(
            "TypeofContact"
        ),
        F.expr("CAST(n_regionkey % 3 + 1 AS INT) AS CityTier"),
        F.col("duration").alias("DurationOfPitch"),
        F.col("c_mktsegment").alias("Occupation"),
        _pick(u("gender"), [(0.60, "Male"), (0.95, "Female")], "Fe Male").alias("Gender"),
        F.expr("CAST(1 + floor(5 * u_persons) AS INT) AS NumberOfPersonVisiting"),
        F.expr("CAST(nullif(followups, 0) AS DOUBLE) AS NumberOfFollowups"),
        F.col("product").alias("ProductPitched"),
        unless("starnull", 0.04, 3 + F.floor(3 * u("star"))).alias("PreferredPropertyStar"),
        _pick(
            u("mar"), [(0.25, "Single"), (0.75, "Married"), (0.85, "Divorced")], "Unmarried"
        ).alias("MaritalStatus"),
        F.col("trips").cast("double").alias("NumberOfTrips"),
        F.expr("CAST(u_pass < 0.29D AS INT) AS Passport"),
        F.expr("CAST(1 + floor(5 * u_score) AS INT) AS PitchSatisfactionScore"),
        F.expr("CAST(u_car < 0.6D AS INT) AS OwnCar"),
        unless("chnull", 0.03, F.floor(4 * u("child"))).alias("NumberOfChildrenVisiting"),
        _pick(
            u("desig"),
            [(0.3, "Executive"), (0.6, "Manager"), (0.8, "Senior Manager"), (0.92, "AVP")],
            "VP",
        ).alias("Designation"),
        F.expr("CASE WHEN c_acctbal >= 0 THEN 15000 + 6 * c_acctbal END AS MonthlyIncome"),
        "u_label",
    )
    labelled = profile.withColumn("ProdTaken", (F.col("u_label") < propensity()).cast("int"))
    return labelled.select(*CUSTOMER.fieldNames())
