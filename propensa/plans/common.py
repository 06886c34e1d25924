"""Inputs shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensa.functions.columns import propensity
from propensa.operators.clean import derive
from propensa.operators.features import Preprocessor, split, with_class_weights
from propensa.session import cached
from propensa.sources.schemas import KEY, LABEL
from propensa.sources.tables import customer_profile

DIGITS = 6


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_profile(spark, sf_dir)


def kept_profile(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The profile, or some of its columns, for queries that learn something and then apply it."""
    rows = customer_profile(spark, sf_dir)
    return cached(rows.select(*columns) if columns else rows)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(CustomerID, ProdTaken, score): the deterministic baseline score."""
    return profile(spark, sf_dir).select(KEY, LABEL, F.round(propensity(), DIGITS).alias("score"))


def parted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived rows with their train/test mark."""
    return split(derive(kept_profile(spark, sf_dir)))


def trained_matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, Preprocessor]:
    """Train rows (with balanced class weights) and test rows as feature vectors."""
    rows = parted(spark, sf_dir)
    train = rows.where(F.col("split") == "train")
    pre = Preprocessor.fit(train, [KEY, LABEL, "split"])
    keep = [KEY, LABEL]
    weighted = with_class_weights(pre.matrix(train, keep), LABEL)
    return weighted, pre.matrix(rows.where(F.col("split") == "test"), keep), pre


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """All double columns rounded, so that engines agree on the last digits."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes]
    )
