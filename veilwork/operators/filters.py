"""Filters of units and spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.matching import chunks, let, piece_in, strip_chars
from .detect import STRIP, has_cue


def prefilter_units(units: DataFrame, text_col: str = "text") -> DataFrame:
    """F1 as a filter of rows (detect() has it as a switch that keeps them); where units have spans found elsewhere, those with a span stay without a cue as well."""
    keep = has_cue(F.col(text_col))
    if "spans" in units.columns:
        keep |= (F.length(strip_chars(F.col(text_col))) >= 3) & (F.coalesce(F.size("spans"), F.lit(0)) > 0)
    return units.where(keep)


def keep_supported(spans: Column, types: dict | None = None) -> Column:
    """the nine types, and the caller's own (see detect.Custom)."""
    return F.filter(spans, lambda s: s["entity_type"].isin(*S.TYPES, *(types or ())))


def filter_by_threshold(spans: Column, thresholds: dict[str, float] | None = None, types: dict | None = None) -> Column:
    """a score of at least the type's threshold; thresholds given by type take the place of the tables'."""

    def least(kind: Column) -> Column:
        told = S.of_type(kind, 1, S.DEFAULT_THRESHOLD, types)
        for name, value in (thresholds or {}).items():
            told = F.when(kind == name, F.lit(float(value))).otherwise(told)
        return told

    return F.filter(spans, lambda s: s["score"] >= least(s["entity_type"]))


def is_org_fp(candidate: Column) -> Column:
    """a generic reference, acronym, stock phrase or piece of a sentence instead of a company's name."""
    bare = strip_chars(candidate, STRIP)
    ends = bare.rlike(S.ORG_SUFFIX_END)
    words = F.regexp_extract_all(bare, F.lit(r"\b[a-z]+\b"), F.lit(0))
    return ((bare.rlike(S.ORG_GENERIC_START) & ~bare.rlike(S.ORG_GENUINE))
            | (bare.rlike(S.ORG_ACRONYM) & F.regexp_replace(bare, r"\.$", "").isin(*S.ORG_ACRONYMS))
            | bare.rlike(S.ORG_EXACT) | bare.rlike(S.ORG_PHRASE)
            | (ends & bare.rlike("^[a-z]"))
            | (~ends & F.arrays_overlap(words, F.array(*map(F.lit, S.ORG_VERBS)))))


def is_person_fp(candidate: Column) -> Column:
    """a form word, place or acronym instead of a person's name."""
    bare = strip_chars(candidate)
    tokens = F.filter(F.split(F.lower(bare), r"[\s\-]+"), lambda t: t != "")
    capitals = bare.rlike(r"^[A-Z]{2,8}(\s+[A-Z]{2,8})*$")
    return (F.lower(bare).isin(*S.PERSON_WORDS)
            | ((F.size(tokens) > 0) & F.forall(tokens, lambda t: t.isin(*S.PERSON_PLACES, *S.PERSON_WORDS)))
            | (capitals & (bare.isin(*S.PERSON_ACRONYMS) | F.forall(F.split(bare, r"\s+"), lambda w: F.length(w) <= 4))))


def filter_spans(spans: Column, text: Column | None, thresholds: dict[str, float] | None = None, types: dict | None = None) -> Column:
    """F8: supported types, then no false organisations and persons (when the text is given), then thresholds."""
    kept = keep_supported(spans, types)
    if text is not None:
        false = lambda said, kind: F.when(kind == "ORGANIZATION", is_org_fp(said)).otherwise(is_person_fp(said))
        asked = lambda s: s["entity_type"].isin("ORGANIZATION", "PERSON")
        kept = let(chunks(text), lambda cut: F.filter(kept, lambda s: ~asked(s) | ~let(piece_in(cut, s["start"], s["end"]), lambda said: false(said, s["entity_type"]))))
    return filter_by_threshold(kept, thresholds, types)


def search_detections(detections: DataFrame, entity_type: str | None = None, query: str | None = None) -> DataFrame:
    """by type, and by a piece of the text or unit id whatever its case."""
    if entity_type and entity_type != "ALL":
        detections = detections.where(F.col("entity_type") == entity_type)
    if query:
        detections = detections.where(F.lower("text").contains(query.lower()) | F.lower("unit_id").contains(query.lower()))
    return detections
