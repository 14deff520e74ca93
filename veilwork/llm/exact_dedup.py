"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. Native columns only.

Null text counts as empty. Texts are equal when identical. Of equal texts exactly one row stays: one of the largest doc_id (of rows that repeat
both id and text, any one); rows with another text under the same doc_id are other documents. A null doc_id never beats another. Empty tables give empty results. Only the id and text
columns are read, so other columns, whatever their names, do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_key, table, without_rows


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256,
                     slots: int = 1 << 18, digest_all: bool = False, with_key: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    1. Lengths are counted; a length held by one row ends there. 2. Rows of shared lengths are counted by
    (length, prefix hash). 3. Only rows of shared (length, prefix hash) get a full digest and are grouped by it.
    What survives the first two steps is known to the second reading of the texts as at most `slots` slot
    numbers, so that broadcast is bounded at 8 * slots bytes whatever the corpus; a slot shared by chance only costs a digest.
    with_key adds the row_key() of every row. digest_all gives the digest of every row (callers that must report it), grouping stays the same. No
    text is ever shuffled. Hot groups are pre-aggregated and joined back from written tables (skew-split).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slot = F.pmod(F.xxhash64("len", "prefix"), F.lit(slots))
    measured = docs.select(F.octet_length(text).alias("len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"))
    seen = materialise(measured.groupBy("len", "prefix").agg(F.count("*").alias("n")))
    shared_len = seen.groupBy("len").agg(F.sum("n").alias("n_len")).where("n_len > 1").select("len")
    shared = seen.where("n > 1").join(shared_len, "len", "left_semi")
    shared_slots = materialise(shared.select(slot.alias("slot")).distinct())
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"), F.octet_length(text).alias("len"),
                       F.xxhash64(F.substring(text, 1, prefix_chars)).alias("prefix"))
    rows = rows.withColumn("slot", slot).join(F.broadcast(shared_slots.withColumn("survives", F.lit(True))), "slot", "left")
    survives = F.coalesce("survives", F.lit(False))
    digest = F.sha2(F.col("t"), 256)
    key = row_key("doc_id", "t") if with_key else F.lit(None).cast("string")
    rows = materialise(rows.select("doc_id", "len", survives.alias("survives"), F.when(survives, F.monotonically_increasing_id()).alias("row"),
                                   (digest if digest_all else F.when(survives, digest)).alias("digest"), key.alias("key")))
    groups = rows.where("survives").groupBy("len", "digest").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n")).where("n > 1")
    groups = materialise(groups.select(F.col("digest").alias("d"), F.col("len").alias("l"), F.col("best.doc_id").alias("keep"), F.col("best.row").alias("keep_row"), "n"))
    out = rows.join(groups, (F.col("digest") == F.col("d")) & (F.col("len") == F.col("l")), "left").select(
        "doc_id", F.coalesce("keep", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.col("digest").alias("text_sha256"), "key")
    return out if with_key else out.drop("key")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the rows that another row's equal text replaces."""
    rows = duplicate_groups(docs, id_col, text_col, with_key=True)
    gone = rows.where(~F.col("kept") & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return without_rows(docs, gone, id_col, text_col, once=True)


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def op2_exact_dedup(spark, sf_dir):
    return duplicate_groups(table(spark, sf_dir, "documents"), digest_all=True)
