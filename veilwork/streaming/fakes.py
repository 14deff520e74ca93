"""T1 with X2: consistent fake values for units that arrive in a stream, a document's units over any number of micro-batches.

Each micro-batch writes two folders named by its id, the redacted units and the values that are new (document, type, original, index), and reads only what batches before it
wrote. A batch that runs again after a failure or restart overwrites its own folders with the same rows, so nothing is doubled. The index of a value is its place among those
of its type in its document, in order of arrival. Every `compact` batches what is known so far is written as one table, so a batch reads at most that and `compact` - 1 folders,
and of these the documents that it holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.matching import strip_chars
from ..functions.stored import stored
from ..operators.detect import detect
from ..operators.fakes import fake_value
from ..operators.redact import analyze_units, one_per_span, redact_fakes
from .redact import SCHEMA

KNOWN = "doc_id bigint, entity_type string, original string, idx bigint"
KEY = ["doc_id", "entity_type", "original"]


def known_before(spark: SparkSession, registry: str, batch: int, compact: int) -> DataFrame:
    """Values that batches before this one gave an index."""
    upto = batch - batch % compact
    paths = [f"{registry}/upto={upto}"] * (upto > 0) + [f"{registry}/batch={i}" for i in range(upto, batch)]
    return spark.read.schema(KNOWN).parquet(*paths) if paths else spark.createDataFrame([], KNOWN)


def redact_batch(units: DataFrame, batch: int, out: str, registry: str, compact: int = 16) -> None:
    """One micro-batch: doc_id, unit_ord, unit_id, text in; {out}/batch={batch} and {registry}/batch={batch} written anew."""
    spark = units.sparkSession
    units = stored(analyze_units(detect(units)))  # read for the values and for the texts
    found = one_per_span(units, ["doc_id", "unit_ord"], "text").select(
        "doc_id", "unit_ord", F.col("s.start").alias("start"), F.col("s.entity_type").alias("entity_type"), strip_chars(F.col("said")).alias("original"))
    first = found.groupBy(*KEY).agg(F.min(F.struct("unit_ord", "start")).alias("first"))
    before = known_before(spark, registry, batch, compact)
    here = stored(before.join(units.select("doc_id").distinct(), "doc_id", "left_semi"))
    taken = here.groupBy("doc_id", "entity_type").agg(F.count("*").alias("taken"))
    order = Window.partitionBy("doc_id", "entity_type").orderBy("first", "original")
    new = first.join(here, KEY, "left_anti").withColumn("rank", F.row_number().over(order) - 1).join(taken, ["doc_id", "entity_type"], "left")
    new = new.select(*KEY, (F.col("rank") + F.coalesce("taken", F.lit(0))).cast("bigint").alias("idx"))
    new.write.mode("overwrite").parquet(f"{registry}/batch={batch}")
    new = spark.read.schema(KNOWN).parquet(f"{registry}/batch={batch}")
    mapping = here.unionByName(new).withColumn("replacement", fake_value(F.col("entity_type"), F.col("original"), F.col("idx")))
    redact_fakes(units, mapping).select("doc_id", "unit_ord", "unit_id", "redacted").write.mode("overwrite").parquet(f"{out}/batch={batch}")
    if (batch + 1) % compact == 0:
        before.unionByName(new).write.mode("overwrite").parquet(f"{registry}/upto={batch + 1}")


def redact_stream_fakes(spark: SparkSession, in_path: str, out: str, registry: str, checkpoint: str, files: int = 1000, compact: int = 16):
    """Start the query over Parquet files in in_path, at most `files` a micro-batch; it ends when what is there has been read. Returns the query."""
    arriving = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(in_path)
    step = lambda units, batch: redact_batch(units, batch, out, registry, compact)
    return arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def redacted_so_far(spark: SparkSession, out: str, columns: Sequence[str] = ("doc_id", "unit_ord", "unit_id", "redacted")) -> DataFrame:
    return spark.read.parquet(out).select(*columns)
