"""Continuous scoring of arriving customer rows."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from propensa.operators.serve import Bundle, score
from propensa.sources.schemas import CUSTOMER


def score_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint_dir: str,
    bundle: Bundle,
    schema: T.StructType = CUSTOMER,
    available_now: bool = True,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Score every parquet file that arrives in ``in_dir`` and append the result to ``out_dir``.

    Scoring looks at one row at a time, so the stream keeps no state and needs no watermark; the
    file sink and its checkpoint make every row appear exactly once.
    """
    arriving = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(in_dir)
    )
    writer = (
        score(arriving, bundle)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint_dir)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start(out_dir)
