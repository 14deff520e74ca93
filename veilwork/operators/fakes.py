"""Consistent fake values: an index per distinct value of a type within a scope, and the value for an index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.matching import strip_chars
from ..functions.stored import stored


def assign_fake_ids(detections: DataFrame, scope: Sequence[str] = ("doc_id",), position: Sequence[str] = ("unit_ord", "start")) -> DataFrame:
    """K1: scope, entity_type, original (stripped), idx: order of first occurrence, from 0. Distinct values are aggregated before they are ranked."""
    keys = [*scope, "entity_type"]
    first = detections.withColumn("original", strip_chars(F.col("text"))).groupBy(*keys, "original").agg(F.min(F.struct(*position)).alias("first"))
    order = Window.partitionBy(*keys).orderBy("first", "original")
    return first.select(*keys, "original", (F.row_number().over(order) - 1).cast("bigint").alias("idx"))


def assign_fake_ids_corpus(detections: DataFrame, position: Sequence[str] = ("doc_id", "unit_ord", "start"), chunks: int | None = None) -> DataFrame:
    """K1 over a whole corpus without a window per type, for ids of any type that can be ordered (a null id comes first).

    Distinct values are dealt to `chunks` ranges (spark.sql.shuffle.partitions by default) of (type, first place, value), sorted inside and numbered as they are written, so a
    document with very many values is cut as well. The index is the number inside the chunk, less the chunk's first of that type, plus the values of the type in chunks before."""
    spark = detections.sparkSession
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = detections.withColumn("original", strip_chars(F.col("text"))).groupBy("entity_type", "original").agg(F.min(F.struct(*position)).alias("first"))
    ranges = first.repartitionByRange(chunks, "entity_type", "first", "original").sortWithinPartitions("entity_type", "first", "original")
    dealt = stored(ranges.select("entity_type", "original", F.spark_partition_id().alias("chunk"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    sizes = dealt.groupBy("entity_type", "chunk").agg(F.count("*").alias("n"), F.min("place").alias("low"))
    before = Window.partitionBy("entity_type").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # at most a row a chunk
    offsets = sizes.select(F.col("entity_type").alias("t"), F.col("chunk").alias("c"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("offset"))
    joined = dealt.join(offsets, dealt["entity_type"].eqNullSafe(F.col("t")) & (F.col("chunk") == F.col("c")))
    return joined.select("entity_type", "original", (F.col("place") + F.col("offset")).cast("bigint").alias("idx"))


def _pick(pool, idx: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in pool]), (F.pmod(idx, F.lit(len(pool))) + 1).cast("int"))


def _digits(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _cut(text: Column, *sizes: int) -> list[Column]:
    at = [1 + sum(sizes[:i]) for i in range(len(sizes))]
    return [F.substring(text, a, n) for a, n in zip(at, sizes)]


def fake_person(idx: Column) -> Column:
    turn = F.floor(idx / len(S.FAKE_PERSONS))
    return F.concat(_pick(S.FAKE_PERSONS, idx), F.when(turn > 0, F.concat(F.lit(" "), (turn + 1).cast("string"))).otherwise(""))


def fake_email(idx: Column) -> Column:
    return F.concat(F.replace(F.lower(_pick(S.FAKE_PERSONS, idx)), F.lit(" "), F.lit(".")), F.lit("@"), _pick(S.FAKE_DOMAINS, idx))


def fake_phone(idx: Column) -> Column:
    digits = _digits(F.pmod(F.lit(9_000_000_000) + idx * 13_337_777, F.lit(10_000_000_000)), 10)
    return F.concat(F.lit("+91 9"), F.substring(digits, 2, 4), F.lit(" "), F.substring(digits, 6, 5))


def fake_company(idx: Column, original: Column) -> Column:
    low = F.lower(original)
    suffix = (F.when(low.rlike(r"\bllp\b"), "LLP").when(low.rlike(r"\b(pvt\.?\s*ltd\.?|private\s+limited)\b"), "Private Limited")
              .when(low.rlike(r"\blimited\b"), "Limited").when(low.rlike(r"\binc\.?\b"), "Inc.").when(low.rlike(r"\bcorp\.?\b"), "Corp.").otherwise("Private Limited"))
    return F.concat_ws(" ", _pick(S.FAKE_WORDS, idx), _pick(S.FAKE_CATEGORIES, idx), suffix)


def fake_address(idx: Column) -> Column:
    return F.concat(_pick(S.FAKE_STREETS, idx), F.lit(", "), _pick(S.FAKE_CITIES, idx), F.lit(" – "), _pick(S.FAKE_PINS, idx).cast("string"), F.lit(", Maharashtra, India"))


def fake_ip(idx: Column) -> Column:
    return F.concat(F.lit("203.0.113."), (F.pmod(idx, F.lit(99)) + 1).cast("string"))


def fake_ssn(idx: Column) -> Column:
    return F.concat_ws("-", *_cut(_digits(F.pmod(F.lit(100_000_000) + idx * 123_456_789, F.lit(1_000_000_000)), 9), 3, 2, 4))


def fake_card(idx: Column) -> Column:
    """4, fourteen digits from the index, and the Luhn check digit, in groups of four."""
    digits = [F.lit(4).cast("bigint")] + [F.pmod(idx * (k + 3) + 7, F.lit(10)) for k in range(1, 15)]
    # The check digit is place 15 of 16: places of even number are doubled.
    total = F.lit(0).cast("bigint")
    for place, d in enumerate(digits):
        total = total + (F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2) if place % 2 == 0 else d)
    number = F.concat(*[d.cast("string") for d in digits], F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))
    return F.concat_ws(" ", *_cut(number, 4, 4, 4, 4))


def fake_dob(original: Column) -> Column:
    """Years 1900 to 2099 that stand alone, ten earlier; a fixed date where there is none."""
    year = r"\b(?:19|20)\d{2}\b"
    gaps, years = F.split(original, year, -1), F.regexp_extract_all(original, F.lit(year), F.lit(0))
    moved = F.transform(F.arrays_zip(gaps.alias("g"), years.alias("y")), lambda x: F.concat(x["g"], F.coalesce((x["y"].cast("int") - 10).cast("string"), F.lit(""))))
    return F.when(F.size(years) > 0, F.array_join(moved, "")).otherwise("01/01/1980")


def fake_value(kind: Column, original: Column, idx: Column) -> Column:
    """The fake value of the idx-th distinct value of a type."""
    made = {"PERSON": fake_person(idx), "EMAIL_ADDRESS": fake_email(idx), "PHONE_NUMBER": fake_phone(idx), "ORGANIZATION": fake_company(idx, original), "ADDRESS": fake_address(idx),
            "IP_ADDRESS": fake_ip(idx), "US_SSN": fake_ssn(idx), "CREDIT_CARD": fake_card(idx), "DATE_OF_BIRTH": fake_dob(original)}
    out = F
    for name, value in made.items():
        out = out.when(kind == name, value)
    return out.otherwise(F.concat(F.lit("["), kind, F.lit("_"), (idx + 1).cast("string"), F.lit("]")))


def replacement_map(detections: DataFrame, scope: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Scope, entity_type, original, idx, replacement; the scope () is the whole corpus."""
    ids = assign_fake_ids(detections, scope) if scope else assign_fake_ids_corpus(detections)
    return ids.withColumn("replacement", fake_value(F.col("entity_type"), F.col("original"), F.col("idx")))
