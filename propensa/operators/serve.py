"""Saving a trained bundle and scoring new customers with it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import Model, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from propensa.functions.columns import apply_threshold, key_factors, risk_band
from propensa.operators.clean import align_columns, derive
from propensa.operators.features import Preprocessor
from propensa.sources.schemas import CUSTOMER, LABEL

# Raw columns a new customer is described by.
TEMPLATE = T.StructType([f for f in CUSTOMER if f.name != LABEL])


@dataclass
class Bundle:
    """Preprocessing and classifier as one pipeline, the tuned threshold, and the classifier's name."""

    pipeline: PipelineModel
    threshold: float
    model: str = ""


def bundle(preprocessor: Preprocessor, model: Model, threshold: float, name: str = "") -> Bundle:
    return Bundle(PipelineModel([*preprocessor.stages(), model]), threshold, name)


def save(b: Bundle, spark: SparkSession, path: str) -> None:
    b.pipeline.write().overwrite().save(f"{path}/pipeline")
    row = spark.createDataFrame([(b.threshold, b.model)], "threshold double, model string")
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Bundle:
    pipeline = PipelineModel.load(f"{path}/pipeline")
    about = spark.read.parquet(f"{path}/about").first()
    return Bundle(pipeline, about["threshold"], about["model"])


def publish(b: Bundle, spark: SparkSession, root: str) -> int:
    """Save the bundle as the next version below ``root``; its number.

    The version is listed only after all of it is written, so a reader never meets half a bundle.
    """
    number = max(versions(spark, root), default=0) + 1
    save(b, spark, f"{root}/v{number}")
    listed = spark.createDataFrame([(number, b.model, b.threshold)], "version int, model string, threshold double")
    listed.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return number


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions below ``root``."""
    try:
        listed = spark.read.schema("version int, model string, threshold double").parquet(f"{root}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["version"] for r in listed.select("version").collect())


def current(spark: SparkSession, root: str, version: int | None = None) -> Bundle:
    """The bundle of a version below ``root``, by default the latest."""
    there = versions(spark, root)
    if not there or (version is not None and version not in there):
        raise ValueError(f"no such version below {root}")
    return load(spark, f"{root}/v{there[-1] if version is None else version}")


def score(
    df: DataFrame, b: Bundle, keep: Sequence[str] = ("CustomerID",), explain: bool = False
) -> DataFrame:
    """Kept columns, probability, decision, verdict and band of every customer in ``df``.

    Columns the customer table lacks are filled with 0, texts with an unknown category. Works on
    streams as on tables.
    """
    extra = [df.schema[c] for c in keep if c not in TEMPLATE.fieldNames()]
    complete = align_columns(df, T.StructType([*TEMPLATE, *extra]))
    out = b.pipeline.transform(derive(complete))
    if "score" not in out.columns:
        out = out.withColumn("score", vector_to_array("probability")[1])
    decision = apply_threshold("score", b.threshold)
    columns = [
        F.col("score").alias("probability"),
        decision.alias("decision"),
        F.when(decision == 1, "Likely to Purchase").otherwise("Unlikely to Purchase").alias("verdict"),
        risk_band("score").alias("band"),
    ]
    if explain:
        columns.append(key_factors().alias("factors"))
    return out.select(*keep, *columns)
