"""Scores of detections against a ground truth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = ("doc_id", "unit_id")


def _overlaps(ds: Column, de: Column, gs: Column, ge: Column, least: float) -> Column:
    overlap = F.least(de, ge) - F.greatest(ds, gs)
    return (overlap > 0) & (ge > gs) & (overlap / (ge - gs) >= least)


def match_candidates(det: DataFrame, truth: DataFrame, least: float = 0.5, unit: Sequence[str] = UNIT, width: int = 128) -> DataFrame:
    """Pairs of one unit and type whose overlap is at least `least` of the true span. det has det_id, truth gt_id; both start and end.

    Spans are joined by the stretches of `width` code points that they touch, a pair in the first one that both do, so a unit with very many spans is many keys and pairs that
    are far apart never meet."""
    keys = [*unit, "entity_type"]
    bins = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(high) - 1) / width)))
    d = det.where("start < end").select(*keys, "det_id", F.col("start").alias("ds"), F.col("end").alias("de"), bins("start", "end").alias("bin"))
    g = truth.where("start < end").select(*keys, "gt_id", F.col("start").alias("gs"), F.col("end").alias("ge"), bins("start", "end").alias("bin"))
    pairs = d.join(g, [*keys, "bin"]).where(F.col("bin") == F.floor(F.greatest("ds", "gs") / width))
    return pairs.where(_overlaps(F.col("ds"), F.col("de"), F.col("gs"), F.col("ge"), least)).select(*keys, "det_id", "gt_id", "ds", "de", "gs", "ge")


def matched_units(det: DataFrame, truth: DataFrame, least: float = 0.5, unit: Sequence[str] = UNIT) -> DataFrame:
    """E2 to E4 in one shuffle by unit: per group of spans of a unit and type that overlap one another, directly or by others, n_det, n_gt, matched (array of det_id, gt_id), and
    whether the unit has any ground truth.

    In order of det_id each detection takes its first candidate, by gt_id, that is still free. Groups cannot compete, so they are folded apart: a unit with very many spans is
    many short arrays. Ids need be unique within a unit only."""
    kinds = dict(det.select("det_id").dtypes + truth.select("gt_id").dtypes)
    span = lambda name: F.struct(F.col(name).alias("id"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))
    d = det.select(*unit, "entity_type", span("det_id").alias("d"), F.lit(None).cast(f"struct<id:{kinds['gt_id']},start:int,end:int>").alias("g"))
    g = truth.select(*unit, "entity_type", F.lit(None).cast(d.schema["d"].dataType).alias("d"), span("gt_id").alias("g"))
    start, end = (F.coalesce(f"d.{x}", f"g.{x}") for x in ("start", "end"))
    order = Window.partitionBy(*unit, "entity_type").orderBy(start, end)
    begins = start >= F.coalesce(F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), start)
    both = d.unionByName(g).repartition(*unit).withColumn("__begins", begins.cast("int"))
    both = both.withColumn("__group", F.sum("__begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    both = both.groupBy(*unit, "entity_type", "__group").agg(F.array_sort(F.collect_list("d")).alias("d"), F.array_sort(F.collect_list("g")).alias("g"))

    def step(acc: Column, x: Column) -> Column:
        free = F.filter("g", lambda y: _overlaps(x["start"], x["end"], y["start"], y["end"], least) & ~F.exists(acc, lambda m: m["gt_id"] == y["id"]))
        return F.when(F.size(free) > 0, F.concat(acc, F.array(F.struct(x["id"].alias("det_id"), F.get(free, F.lit(0))["id"].alias("gt_id"))))).otherwise(acc)

    none = F.array().cast(f"array<struct<det_id:{kinds['det_id']},gt_id:{kinds['gt_id']}>>")
    matched = F.when((F.size("d") > 0) & (F.size("g") > 0), F.aggregate("d", none, step)).otherwise(none)
    told = F.max(F.size("g") > 0).over(Window.partitionBy(*unit))
    return both.select(*unit, "entity_type", F.size("d").alias("n_det"), F.size("g").alias("n_gt"), matched.alias("matched"), told.alias("unit_in_gt"))


def match_spans(det: DataFrame, truth: DataFrame, least: float = 0.5, unit: Sequence[str] = UNIT) -> DataFrame:
    """One-to-one matches."""
    return matched_units(det, truth, least, unit).select(*unit, "entity_type", F.explode("matched").alias("m")).select(*unit, "entity_type", "m.det_id", "m.gt_id")


def _counts(det: DataFrame, truth: DataFrame, least: float, unit: Sequence[str]) -> DataFrame:
    """entity_type, tp, fp, fn, n_gt per unit and type. A detection without a match counts only in units that have any ground truth."""
    tp = F.size("matched")
    return matched_units(det, truth, least, unit).select(
        "entity_type", tp.alias("tp"), F.when(F.col("unit_in_gt"), F.col("n_det") - tp).otherwise(0).alias("fp"), (F.col("n_gt") - tp).alias("fn"), "n_gt")


def outcomes(det: DataFrame, truth: DataFrame, least: float = 0.5, unit: Sequence[str] = UNIT) -> DataFrame:
    """entity_type, outcome (tp, fp, fn) and n, the number of such spans, where there are any."""
    counts = _counts(det, truth, least, unit).groupBy("entity_type").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("outcome"), F.col(x).alias("n")) for x in ("tp", "fp", "fn")]))
    return counts.select("entity_type", each.alias("o")).select("entity_type", "o.outcome", "o.n").where("n > 0")


def evaluate(det: DataFrame, truth: DataFrame, least: float = 0.5, unit: Sequence[str] = UNIT) -> DataFrame:
    """Per type of either side and OVERALL: tp, fp, fn, precision, recall, f1 (0 on a zero denominator), in_gt."""
    n = _counts(det, truth, least, unit).rollup("entity_type").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fp", "fn", "n_gt")], F.grouping("entity_type").alias("g"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = n.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    n = n.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return n.select(F.when(F.col("g") == 1, "OVERALL").otherwise(F.col("entity_type")).alias("entity_type"), "tp", "fp", "fn", "precision", "recall", "f1", ((F.col("n_gt") > 0) | (F.col("g") == 1)).alias("in_gt"))


def evaluate_file(det: DataFrame, path: str, least: float = 0.5) -> DataFrame:
    """E5, E6 against ground-truth files, one a document (see read_ground_truth); det has doc_id (a string like the files' names), unit_id, det_id, entity_type, start, end."""
    from ..sources.files import read_ground_truth

    return evaluate(det, read_ground_truth(det.sparkSession, path)[0], least)


def absent_types(absent: DataFrame) -> DataFrame:
    """The other columns (doc_id), entity_type and reason from a column absent_types (map), sorted by type."""
    others = [c for c in absent.columns if c != "absent_types"]
    return absent.select(*others, F.explode("absent_types").alias("entity_type", "reason")).orderBy("entity_type", *others)
