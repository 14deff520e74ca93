"""Mixing sources to target weights by weighted fair queueing. Native columns only.

Sources are ordered by code point, null last, and weigh 5, 2, 1, repeating (a null source is a source). Null text
has size 0. Rows that repeat a doc_id, or a whole row, are documents of their own: each gives one row of taken_words(). Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, row_key, table, unused

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """One row per source of sizes(source, size): source, weight, source_size, target, level, budget.

    Resharing the excess of capped sources until none is above its cap ends at one level L with
    target = min(repeats * size, L * weight); L is the largest of (budget - caps of the first j) / (weights of the
    rest) over sources in order of cap / weight. The windows here run over one row per source only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    everything = Window.partitionBy()
    before = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({
        "budget": F.floor(F.lit(share) * F.sum("source_size").over(everything)),
        "capped": repeats * F.coalesce(F.sum("source_size").over(before), F.lit(0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    })
    per = per.withColumn("level", F.max((F.lit(share) * F.sum("source_size").over(everything) - F.col("capped")) / F.col("open")).over(everything))
    target = F.least(F.lit(float(repeats)) * F.col("source_size"), F.col("level") * F.col("weight"))
    return per.select("source", "weight", "source_size", target.alias("target"), "level", "budget")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(5, 2, 1),
        share: float = 1.5, repeats: int = 2, seed: str = "mix-1", bins: int = 4096) -> DataFrame:
    """Every copy of every document with its place in the mixture.

    Columns: doc_id, source, size, source_size, target, copy (0-based), finish (virtual finish time: words of the
    source up to and with this copy, in shuffled order, divided by the weight), taken (boolean: within the budget), key and nth (the row: its
    row_key(), and its number among rows of that key).
    Copies in order of (finish, source, rank, doc_id, copy) are the mixture. The shuffle rank is a keyed MD5, so reruns
    agree. Running sums are taken in two levels: sums per (source, bucket of rank), offsets over at most 4096 buckets
    of a source, then sums inside a bucket; likewise finish times are cut into ranges, whole ranges under the budget are
    taken, and only the range that the budget falls into is sorted row by row. So no task gets a whole hot source.
    """
    size = F.size(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    rank = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), rank.alias("rank"), row_key(id_col, text_col).alias("key"))
                       .withColumn("bucket", F.substring("rank", 1, 3)))
    targets = materialise(source_targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, share, repeats))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    offset = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = materialise(sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), offset.alias("offset"))
                          .join(targets, F.col("s").eqNullSafe(F.col("source"))).drop("source"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("rank", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(Window.partitionBy("source", "bucket", "key").orderBy("rank"))
    placed = rows.withColumn("inside", inside).withColumn("nth", nth).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    finish = (F.col("copy") * F.col("source_size") + F.col("offset") + F.col("inside")).cast("double") / F.col("weight")
    # Ranges hold about 1 / bins of the budget each; the last takes what finishes after the level twice over.
    span = F.when(F.col("level") > 0, F.least(F.floor(F.col("finish") / F.col("level") * bins), F.lit(2 * bins))).otherwise(0)
    copies = materialise(copies.withColumn("finish", finish).withColumn("range", span.cast("long")).select(
        "doc_id", "source", "size", "rank", "key", "nth", "source_size", "target", "copy", "finish", "range", "budget"))
    cut = copies.groupBy("range", "budget").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    cut = materialise(cut.select(F.col("range").alias("r"), upto.alias("upto"), (upto - F.col("n")).alias("start"), "budget").select(
        "r", "start", (F.col("upto") <= F.col("budget")).alias("under"), (F.col("start") >= F.col("budget")).alias("over")))
    copies = copies.join(F.broadcast(cut), F.col("range") == F.col("r"))  # at most 2 * bins + 1 rows
    whole = copies.where("under OR over").withColumn("taken", F.col("under"))
    running = F.sum("size").over(Window.partitionBy("range").orderBy("finish", F.col("source").asc_nulls_last(), "rank", "doc_id", "key", "nth", "copy").rowsBetween(Window.unboundedPreceding, 0))
    edge = copies.where("NOT under AND NOT over").withColumn("taken", F.col("start") + running <= F.col("budget"))
    return whole.unionByName(edge).select("doc_id", "source", "rank", "key", "nth", "size", "source_size", "target", "copy", "finish", "taken")


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, source, size, source_size, target, taken (words, repeats counted)."""
    return mix(docs, **options).groupBy("doc_id", "source", "rank", "key", "nth", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, each as often as the mixture takes it: not at all, once or twice."""
    key, counts, row, nth, copy = unused(docs, "__key", "__times", "__row", "__nth", "__copy")
    times = mix(docs, id_col, text_col, **options).where("taken").groupBy("key", "nth").agg(F.count("*").alias("times"))
    times = materialise(times.groupBy(F.col("key").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("nth", "times"))).alias(counts)))  # a key's repeated rows
    keyed = docs.withColumn(row, row_key(id_col, text_col))
    keyed = keyed.withColumn(nth, F.row_number().over(Window.partitionBy(row).orderBy(row)))
    taken = keyed.join(times.hint("merge"), F.col(row) == F.col(key))
    copies = F.explode(F.array_repeat(F.lit(0), F.coalesce(F.element_at(counts, F.col(nth)), F.lit(0)).cast("int")))
    return taken.withColumn(copy, copies).select(*[taken[c] for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix-1:' || CAST(doc_id AS VARCHAR)) AS rank FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s0),
s2 AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS whole,
  2 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
  sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open FROM s1),
s3 AS (SELECT *, max((whole - capped) / open) OVER () AS level FROM s2),
s AS (SELECT source, weight, source_size, floor(whole) AS budget, least(2.0::DOUBLE * source_size, level * weight) AS target FROM s3),
c AS (SELECT d.*, s.weight, s.source_size, s.target, s.budget,
  row_number() OVER (PARTITION BY d.source ORDER BY rank, doc_id, size) AS nth,
  sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
e AS (SELECT c.*, k.copy, CAST(k.copy * source_size + upto AS DOUBLE) / weight AS finish FROM c CROSS JOIN (VALUES (0), (1)) k(copy)),
f AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, rank, doc_id, nth, copy ROWS UNBOUNDED PRECEDING) <= budget AS ok FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN ok THEN size ELSE 0 END) AS BIGINT) AS taken
FROM f GROUP BY doc_id, source, rank, nth, size, source_size, target
"""


def op3_mixing(spark, sf_dir):
    return taken_words(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
