"""Overlap resolution, redaction of texts and runs, and the table of detections. All but the join with fake values is narrow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.matching import chunks, greedily, let, piece, piece_in, strip_chars
from .filters import filter_spans


def resolve_overlaps(spans: Column, types: dict | None = None) -> Column:
    """Greedy by priority, length, score, then start and type; touching spans do not overlap; result by start."""
    order = lambda s: F.struct(S.of_type(s["entity_type"], 2, S.DEFAULT_PRIORITY, types).alias("p"), (s["start"] - s["end"]).alias("l"), (-s["score"]).alias("q"),
                               s["start"].alias("a"), s["entity_type"].alias("t"), s.alias("s"))
    ranked = F.array_sort(F.transform(spans, order))

    kept = greedily(F.transform(ranked, lambda x: x["s"]), "k.s.start < x.s.end AND x.s.start < k.s.end")
    return F.transform(F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("a"), s.alias("s")))), lambda x: x["s"])


def analyze_units(units: DataFrame, order: str = "filter_first", text_col: str = "text", thresholds: dict[str, float] | None = None, types: dict | None = None) -> DataFrame:
    """R2: spans filtered and resolved in either order; resolve_first filters without looking at the text. types: the caller's own (see detect.Custom)."""
    text, spans = F.col(text_col), F.col("spans")
    if order == "filter_first":
        return units.withColumn("spans", filter_spans(spans, text, thresholds, types)).withColumn("spans", resolve_overlaps(F.col("spans"), types))
    return units.withColumn("spans", resolve_overlaps(spans, types)).withColumn("spans", filter_spans(F.col("spans"), None, thresholds, types))


def replaced(text: Column, spans: Column, value) -> Column:
    """text with value(span), or value(span, number), in the place of every span of a resolved array. Pieces are joined once, so that a long text is not copied for each span."""
    told = value if value.__code__.co_argcount == 2 else lambda s, i: value(s)

    def parts(known: Column) -> Column:
        cut, those = known["cut"], known["spans"]
        before = lambda i: F.when(i > 0, F.get(those, i - 1)["end"]).otherwise(0)
        head = F.transform(those, lambda s, i: F.concat(piece_in(cut, before(i), s["start"]), told(s, i)))
        return F.concat(F.array_join(head, ""), piece_in(cut, F.element_at(those, -1)["end"], known["size"]))

    return F.when(F.size(spans) > 0, let(F.struct(chunks(text).alias("cut"), spans.alias("spans"), F.length(text).alias("size")), parts)).otherwise(text)


def label(s: Column, types: dict | None = None) -> Column:
    return S.of_type(s["entity_type"], 0, F.concat(F.lit("[REDACTED: "), s["entity_type"], F.lit("]")), types)


def with_said(text: Column, spans: Column) -> Column:
    """array of structs s (the span) and said (its own text)."""
    return F.when(F.size(spans) > 0, let(chunks(text), lambda cut: F.transform(spans, lambda s: F.struct(s.alias("s"), piece_in(cut, s["start"], s["end"]).alias("said")))))


def one_per_span(units: DataFrame, columns, text_col: str | None = None) -> DataFrame:
    """columns and s, one row per span; with text_col also `said`, the span's own text, so that the unit's text need not go into every row.

    A plain explode() would have the optimizer test the array's size below it and so detect twice."""
    if text_col:
        rows = units.select(*columns, F.explode_outer(with_said(F.col(text_col), F.col("spans"))).alias("x"))
        return rows.where("x IS NOT NULL").select(*columns, "x.s", "x.said")
    return units.select(*columns, F.explode_outer("spans").alias("s")).where("s IS NOT NULL")


def redact_labels(units: DataFrame, text_col: str = "text", types: dict | None = None) -> DataFrame:
    """A column redacted."""
    return units.withColumn("redacted", replaced(F.col(text_col), F.col("spans"), lambda s: label(s, types)))


def with_fakes(units: DataFrame, scope: Sequence[str] = ("doc_id",), position: Sequence[str] = ("unit_ord",), text_col: str = "text") -> DataFrame:
    """K1 to K12 and X2 in one shuffle: units with a column fakes, the fake value of each span in the order of spans.

    Units are dealt by scope once; the first place of a value and its rank among those of its type are windows inside that, and the spans come back to their unit by a
    grouping inside it, so there is no join and no stored table. A unit's columns go with its first span only. A scope (a document) is one task's rows, which may spill but are
    not split; for a scope that holds a large part of the corpus use redact_fakes() with a mapping, whose joins adaptive execution splits. Repeated units stay."""
    from .fakes import fake_value

    scope, position = list(scope), list(position)
    unit = F.struct(*[F.col(c) for c in units.columns])
    said = with_said(F.col(text_col), F.col("spans"))
    first = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.lit(None).cast(f"struct<s:{S.SPAN},said:string>").alias("x"), unit.alias("unit")))
    each = F.transform(said, lambda x, i: F.struct(i.alias("i"), x.alias("x"), F.when(i == 0, unit).alias("unit")))
    rows = units.withColumn("__row", F.monotonically_increasing_id())
    rows = rows.select("__row", *dict.fromkeys([*scope, *position]), F.explode_outer(F.when(F.size("spans") > 0, each).otherwise(first)).alias("__e"))
    rows = rows.select("__row", *dict.fromkeys([*scope, *position]), F.col("__e.unit").alias("__unit"), F.col("__e.i").alias("__i"), F.col("__e.x").alias("__x"))
    rows = rows.withColumns({"__type": F.col("__x.s.entity_type"), "__original": strip_chars(F.col("__x.said"))})
    rows = rows.repartition(*scope)
    first = F.min(F.struct(*position, F.col("__x.s.start"))).over(Window.partitionBy(*scope, "__type", "__original"))
    idx = (F.dense_rank().over(Window.partitionBy(*scope, "__type").orderBy("__first", "__original")) - 1).cast("bigint")
    rows = rows.withColumn("__first", first).withColumn("__idx", idx)
    value = F.when(F.col("__i").isNotNull(), F.struct(F.col("__i").alias("i"), fake_value(F.col("__type"), F.col("__original"), F.col("__idx")).alias("value")))
    # collect_list() copies the one unit that is not null; first() would copy it for each of its spans
    whole = rows.groupBy(*scope, "__row").agg(F.collect_list("__unit").alias("__unit"), F.array_sort(F.collect_list(value)).alias("__values"))
    return whole.select(F.get("__unit", F.lit(0)).alias("__unit"), "__values").select("__unit.*", F.transform("__values", lambda v: v["value"]).alias("fakes"))


def redact_with(units: DataFrame, values_col: str = "fakes", text_col: str = "text") -> DataFrame:
    """A column redacted; the i-th span is replaced by the i-th of the values."""
    return units.withColumn("redacted", replaced(F.col(text_col), F.col("spans"), lambda s, i: F.get(F.col(values_col), i)))


def redact_fakes(units: DataFrame, mapping: DataFrame, scope: Sequence[str] = ("doc_id",), keys: Sequence[str] = ("doc_id", "unit_ord"), text_col: str = "text") -> DataFrame:
    """X2 by a given mapping (scope, entity_type, original, replacement), of any scope: a column redacted; spans that it lacks keep their text."""
    keys = list(dict.fromkeys([*keys, *scope]))
    found = one_per_span(units, keys, text_col).select(*keys, F.col("s.start").alias("start"), F.col("s.entity_type").alias("entity_type"), strip_chars(F.col("said")).alias("original"))
    values = found.join(mapping.select(*scope, "entity_type", "original", "replacement"), [*scope, "entity_type", "original"])
    per = values.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("start", "replacement"))).alias("__by"))  # a unit's own spans
    text = F.col(text_col)
    value = lambda s: F.coalesce(F.element_at(F.col("__by"), s["start"]), piece(text, s["start"], s["end"]))
    return units.join(per, keys, "left").withColumn("redacted", replaced(text, F.col("spans"), value)).drop("__by")


def redact_runs(units: DataFrame, value=label) -> DataFrame:
    """The runs of a unit with each span's replacement in the first run that it touches; the texts of the runs joined are the redacted text.

    runs: array<struct<run_index, run_start, run_end, text>>; run_start and run_end stay those of the original."""

    def run(spans: Column, r: Column) -> Column:
        inside = F.filter(spans, lambda s: (s["start"] < r["run_end"]) & (s["end"] > r["run_start"]) & (s["start"] < s["end"]))

        def step(acc: Column, s: Column) -> Column:
            begin, end = F.greatest(s["start"], r["run_start"]), F.least(s["end"], r["run_end"])
            new = F.when(s["start"] >= r["run_start"], value(s)).otherwise("")
            return F.struct(F.concat(acc["out"], piece(r["text"], acc["at"] - r["run_start"], begin - r["run_start"]), new).alias("out"), end.alias("at"))

        text = F.aggregate(inside, F.struct(F.lit("").alias("out"), r["run_start"].alias("at")), step,
                           lambda acc: F.concat(acc["out"], piece(r["text"], acc["at"] - r["run_start"], r["run_end"] - r["run_start"])))
        return r.withField("text", text)

    # a column named inside the lambda would be computed, with all recognizers, for each run
    return units.withColumn("runs", let(F.col("spans"), lambda spans: F.transform("runs", lambda r: run(spans, r))))


def explode_detections(units: DataFrame, keys: Sequence[str] = ("doc_id", "unit_ord", "unit_id"), text_col: str = "text", mapping: DataFrame | None = None, scope: Sequence[str] = ("doc_id",),
                       types: dict | None = None, values_col: str | None = None) -> DataFrame:
    """One row per span: keys, entity_type, start, end, score (3 places), text, replacement (label, the mapping's value, or that of a column of values such as fakes)."""
    said = with_said(F.col(text_col), F.col("spans"))
    rows = units.select(*keys, F.explode_outer(said if values_col is None else F.arrays_zip(said.alias("x"), F.col(values_col).alias("v"))).alias("x")).where("x IS NOT NULL")
    x, s = ("x", "x.s") if values_col is None else ("x.x", "x.x.s")
    rows = rows.select(*keys, f"{s}.entity_type", f"{s}.start", f"{s}.end", F.round(f"{s}.score", 3).alias("score"), F.col(f"{x}.said").alias("text"),
                       (label(F.col(s), types) if values_col is None else F.col("x.v")).alias("replacement"))
    if mapping is None:
        return rows
    values = mapping.select(*scope, "entity_type", F.col("original").alias("__original"), F.col("replacement").alias("__value"))
    return rows.withColumn("__original", strip_chars(F.col("text"))).join(values, [*scope, "entity_type", "__original"], "left").withColumn(
        "replacement", F.coalesce("__value", "replacement")).drop("__value", "__original").select(*keys, "entity_type", "start", "end", "score", "text", "replacement")
