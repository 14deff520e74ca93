"""Counts, coverage and reports over detections and units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .. import schema as S

CARDS = ("EMAIL_ADDRESS", "PHONE_NUMBER", "PERSON", "ORGANIZATION", "ADDRESS")


def counts_by_type(detections: DataFrame) -> DataFrame:
    """A1."""
    return detections.groupBy("entity_type").agg(F.count("*").alias("n")).orderBy("entity_type")


def counts_with_total(detections: DataFrame) -> DataFrame:
    """A2: A1 and a row TOTAL, also when there is nothing (a rollup of no rows has none). The total is added up from the counts."""
    counts = detections.groupBy("entity_type").agg(F.count("*").alias("n"))
    return counts.unionByName(counts.agg(F.lit("TOTAL").alias("entity_type"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def coverage(units: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A3: units, units with spans, spans; per key or overall."""
    n = F.size("spans")
    return units.groupBy(*by).agg(F.count("*").alias("total_units"), F.count_if(n > 0).alias("units_with_pii"), F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("total_pii_count"))


def document_report(units: DataFrame, detections: DataFrame, by: Sequence[str] = ("doc_id",), nested: bool = False, mapping: DataFrame | None = None) -> DataFrame:
    """A4: A3 per document with the counts of its types as a map. Counts are aggregated by (document, type) first.

    nested adds detections (array, in document order), a mapping (K12) replacement_map (array); both hold what one document has."""
    by = list(by)
    counts = detections.groupBy(*by, "entity_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("counts_by_type"))
    out = coverage(units, by).join(maps, by, "left").withColumn("counts_by_type", F.coalesce("counts_by_type", F.create_map().cast("map<string,bigint>")))
    parts = {"detections": (detections, ("unit_ord", "start", "unit_id", "entity_type", "end", "score", "text", "replacement"))} if nested else {}
    if mapping is not None:
        parts["replacement_map"] = (mapping, ("entity_type", "idx", "original", "replacement"))
    for name, (rows, fields) in parts.items():
        per = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(per, by, "left").withColumn(name, F.coalesce(name, F.array().cast(per.schema[name].dataType)))
    return out


def observed(units: DataFrame, types: dict | None = None) -> tuple[DataFrame, Observation]:
    """A1 to A3 counted while units with resolved spans pass by: units, and what holds the counts once they have been written (see sources.files.write_counted).

    Three counts and one for each entity type reach the driver. The step is narrow, so the writing stage is the one that counts, and a task that runs again counts once."""
    n, seen = F.size("spans"), Observation()
    of = lambda kind: F.sum(F.size(F.filter("spans", lambda s: s["entity_type"] == kind)))
    kinds = [of(kind).alias(kind) for kind in (*S.TYPES, *(types or ()))]
    return units.observe(seen, F.count("*").alias("total_units"), F.count_if(n > 0).alias("units_with_pii"), F.sum(n).alias("total_pii_count"), *kinds), seen


def counts_of(units: DataFrame, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """A4 from written units that have kinds (the types of their spans): no text is read and nothing is detected again."""
    by = list(by)
    per = units.select(*by, F.size("kinds").alias("n")).groupBy(*by).agg(F.count("*").alias("total_units"), F.count_if(F.col("n") > 0).alias("units_with_pii"), F.sum("n").cast("bigint").alias("total_pii_count"))
    counts = units.select(*by, F.explode("kinds").alias("entity_type")).groupBy(*by, "entity_type").agg(F.count("*").alias("n"))
    maps = counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("counts_by_type"))  # at most one entry a type
    return per.join(maps, by, "left").withColumn("counts_by_type", F.coalesce("counts_by_type", F.create_map().cast("map<string,bigint>")))


def distinct_types(detections: DataFrame) -> DataFrame:
    """A5."""
    return detections.select("entity_type").distinct()


def first_detections(detections: DataFrame, n: int = 50) -> DataFrame:
    """The first n of each document, in document order."""
    order = Window.partitionBy("doc_id").orderBy("unit_ord", "start", "entity_type")
    return detections.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def dashboard(detections: DataFrame) -> DataFrame:
    """The total and five types in one row, zero where there are none."""
    return detections.agg(F.count("*").alias("total"), *[F.count_if(F.col("entity_type") == t).alias(t.lower()) for t in CARDS])


def leaks(redacted: DataFrame, detections: DataFrame, keys: Sequence[str] = ("doc_id", "unit_ord")) -> DataFrame:
    """Q1: detections whose text is still in their redacted unit."""
    return detections.join(redacted.select(*keys, "redacted"), list(keys)).where(F.col("redacted").contains(F.col("text"))).select(*keys, "entity_type", "start", "end", "text")


def changed_outside(units: DataFrame, text_col: str = "text", with_label: bool = True) -> DataFrame:
    """Q2: units whose text outside the spans differs after redaction: putting the originals back does not give the text."""
    from .redact import label, replaced

    text, spans = F.col(text_col), F.col("spans")
    shift = F.aggregate(spans, F.struct(F.lit(0).alias("d"), F.array().cast("array<struct<start:int,end:int>>").alias("o")), lambda acc, s: F.struct(
        (acc["d"] + F.length(label(s)) - (s["end"] - s["start"])).alias("d"),
        F.concat(acc["o"], F.array(F.struct((s["start"] + acc["d"]).alias("start"), (s["start"] + acc["d"] + F.length(label(s))).alias("end")))).alias("o")), lambda acc: acc["o"])
    gone = lambda t, s: replaced(t, s, lambda _: F.lit("\x00"))
    return units.where(gone(text, spans) != gone(F.col("redacted"), shift))
