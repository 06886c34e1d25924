"""Declared schemas of the customer table and its derived variant."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "CustomerID"
LABEL = "ProdTaken"

CUSTOMER = T.StructType(
    [
        T.StructField("CustomerID", T.LongType()),
        T.StructField("ProdTaken", T.IntegerType()),
        T.StructField("Age", T.DoubleType()),
        T.StructField("TypeofContact", T.StringType()),
        T.StructField("CityTier", T.IntegerType()),
        T.StructField("DurationOfPitch", T.DoubleType()),
        T.StructField("Occupation", T.StringType()),
        T.StructField("Gender", T.StringType()),
        T.StructField("NumberOfPersonVisiting", T.IntegerType()),
        T.StructField("NumberOfFollowups", T.DoubleType()),
        T.StructField("ProductPitched", T.StringType()),
        T.StructField("PreferredPropertyStar", T.DoubleType()),
        T.StructField("MaritalStatus", T.StringType()),
        T.StructField("NumberOfTrips", T.DoubleType()),
        T.StructField("Passport", T.IntegerType()),
        T.StructField("PitchSatisfactionScore", T.IntegerType()),
        T.StructField("OwnCar", T.IntegerType()),
        T.StructField("NumberOfChildrenVisiting", T.DoubleType()),
        T.StructField("Designation", T.StringType()),
        T.StructField("MonthlyIncome", T.DoubleType()),
    ]
)

# Columns of the derived variant, in order, without a key.
VARIANT_COLUMNS = [
    "Age", "MonthlyIncome", "NumberOfTrips", "DurationOfPitch", "PitchSatisfactionScore",
    "NumberOfFollowups", "TotalVisiting", "Passport", "Occupation", "Gender", "MaritalStatus",
    "Designation", "ProductPitched", "CityTier", "ProdTaken", "IncomePerTrip", "AgeGroup",
]

# The raw relational tables, as far as the library reads them.
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}
