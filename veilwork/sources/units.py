"""Text units from tables, and the template units that carry every entity type."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def units_from_table(df: DataFrame, id_cols: Sequence[str] = ("doc_id",), text_col: str = "text", sep: str = "\n") -> DataFrame:
    """One row per paragraph that is not blank: id columns, unit_ord (counted before blanks are dropped), unit_id, text. sep is taken as it stands, not as a pattern."""
    parts = F.split(F.col(text_col), "\\Q" + sep.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)
    rows = df.select(*id_cols, F.posexplode(parts).alias("unit_ord", "text"))
    return rows.where(F.col("text").rlike(r"\S")).select(*id_cols, "unit_ord", F.concat(F.lit("body-para-"), F.col("unit_ord").cast("string")).alias("unit_id"), "text")


def spread(df: DataFrame, *by: Column | str, rows: int = 8192) -> DataFrame:
    """df dealt by hash to partitions of about `rows` rows, and to every core where there are fewer.

    Readers cut a table by bytes and at row groups, so a narrow table whose rows are cheap to read and dear to analyse is one task's, however many rows it has. To be called
    on a table as read, before anything is computed: its rows are counted first (of Parquet only the footers are read). The number is given, so adaptive execution does not
    merge the small partitions again."""
    n = df.count()
    parts = max(math.ceil(n / rows), min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n * 16 / rows)), 1)
    return df.repartition(parts, *by)


# Names of the template units.
FIRST = ("Rajesh", "Priya", "Arjun", "Sneha", "Kavita", "Amit")
LAST = ("Kumar", "Singh", "Mehta", "Joshi", "Rao")


def template_rows(customers: DataFrame, key: str = "c_custkey") -> DataFrame:
    """doc_id, unit_ord, unit_id, text, gt (array<struct<entity_type, start, end>>): units with known spans from a key column.

    A document is ten customers in order of their key; unit_ord is the place in it. Twelve templates take turns."""
    k = F.col(key).cast("bigint")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.pmod(k, F.lit(len(words))) + 1).cast("int"))
    first, last = pick(FIRST), pick(LAST)
    num = lambda n, width: F.lpad(F.pmod(k, F.lit(n)).cast("string"), width, "0")
    bits = [
        [("Contact Person: Mr. ", None), (F.concat_ws(" ", first, last), "PERSON"), (", Company Secretary", None)],
        [("DOB: ", None), (F.concat(F.lpad((F.pmod(k, F.lit(28)) + 1).cast("string"), 2, "0"), F.lit("/"), F.lpad((F.pmod(k, F.lit(12)) + 1).cast("string"), 2, "0"), F.lit("/"), (F.pmod(k, F.lit(60)) + 1940).cast("string")), "DATE_OF_BIRTH")],
        [("SSN: ", None), (F.concat(num(900, 3), F.lit("-"), num(90, 2), F.lit("-"), num(9973, 4)), "US_SSN")],
        [("", None), (F.concat(F.lit("Registered Office: Plot No. "), (F.pmod(k, F.lit(300)) + 1).cast("string"), F.lit(", MG Road, Pune "), (F.pmod(k, F.lit(50)) + 411001).cast("string")), "ADDRESS")],
        [("Audited by ", None), (F.concat(last, F.lit(" & Associates LLP")), "ORGANIZATION"), (".", None)],
        [("Tel: ", None), (F.concat(F.lit("+91 20 "), num(9967, 4), F.lit(" "), num(9949, 4)), "PHONE_NUMBER")],
        [("the Company has filed the prospectus.", None)],
        [("FY 2024-25 revenue grew 18%. See Page ", None), ((F.pmod(k, F.lit(300)) + 1).cast("string"), None), (" for details.", None)],
        [("Reference number: ", None), (F.concat(F.lit("1"), F.lpad(F.pmod(k, F.lit(99999989)).cast("string"), 8, "0")), None)],
        [("Card: ", None), ("4111 1111 1111 1111", "CREDIT_CARD")],
        [("Director: ", None), (F.concat_ws(" ", first, last), "PERSON"), (", email: ", None), (F.concat(first, F.lit("."), last, F.lit("@example.com")), "EMAIL_ADDRESS"), (", phone ", None), ("020 4509 4400", "PHONE_NUMBER")],
        [("Server IP: ", None), (F.concat(F.lit("192.168.1."), F.pmod(k, F.lit(256)).cast("string")), "IP_ADDRESS")],
    ]
    turn = F.pmod(k, F.lit(12))
    none = F.array().cast("array<struct<entity_type:string,start:int,end:int>>")

    def row(parts) -> F.Column:
        at, texts, marks = F.lit(0), [], []
        for text, kind in parts:
            text = F.lit(text) if isinstance(text, str) else text
            if kind:
                marks.append(F.struct(F.lit(kind).alias("entity_type"), at.cast("int").alias("start"), (at + F.length(text)).cast("int").alias("end")))
            texts.append(text)
            at = at + F.length(text)
        return F.struct(F.concat(*texts).alias("text"), (F.array(*marks) if marks else none).alias("gt"))

    false_card = F.struct(F.lit("Card: 4111 1111 1111 1112").alias("text"), none.alias("gt"))
    chosen = F.when((turn == 9) & (F.pmod(F.floor(k / 12), F.lit(2)) == 1), false_card)
    for i, parts in enumerate(bits):
        chosen = chosen.when(turn == i, row(parts))
    return customers.select(F.floor(k / 10).cast("bigint").alias("doc_id"), F.pmod(k, F.lit(10)).cast("int").alias("unit_ord"), chosen.alias("r")).select(
        "doc_id", "unit_ord", F.concat(F.lit("body-para-"), F.col("unit_ord").cast("string")).alias("unit_id"), "r.text", "r.gt")
