"""A corpus pipeline: toxicity, near duplicates, benchmark passages, secrets, tokens.

Each stage works on everything its predecessor kept. Stages but the last return the columns of the
documents they were given; the last returns the encoded corpus.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensa.llm import bpe, decontaminate, jaccard, secrets, toxicity
from propensa.session import cut_lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _apart(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The documents with all columns but id and text under names that no stage uses, and their own columns back from these."""
    names = {c: c if c in ("doc_id", "text") else f"given_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), [F.col(inner).alias(c) for c, inner in names.items()]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    given, own = _apart(docs)
    model = toxicity.fit(given, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(given).where("predicted = 0").select(*own)


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, the one with the smallest id."""
    return jaccard.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    given, own = _apart(docs)
    found = decontaminate.decontaminate(given, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where("n_hit = 0").select(*own)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced in the text; no document goes."""
    clean = secrets.redacted(docs, secrets.scan(docs)).withColumn(
        "n_chars", F.when(F.col("n_secrets") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    )
    return clean.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded bytes."""
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe.default_ranks())
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", one_per_group),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE", encode),
]

#: SQL cannot state the fitted models, the forest or the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
