"""Label redaction of units that arrive as files; the same narrow steps as the batch job, no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.detect import detect
from ..operators.redact import analyze_units, redact_labels

SCHEMA = "doc_id bigint, unit_ord int, unit_id string, text string"


def redacted_units(units: DataFrame) -> DataFrame:
    return redact_labels(analyze_units(detect(units)))


def redact_stream(spark: SparkSession, in_path: str, out_path: str, checkpoint: str):
    """Start the query over Parquet files in in_path; it ends when what is there has been read. Returns the query."""
    arriving = spark.readStream.schema(SCHEMA).parquet(in_path)
    return redacted_units(arriving).select("doc_id", "unit_ord", "unit_id", "redacted").writeStream.format("parquet").option(
        "path", out_path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
