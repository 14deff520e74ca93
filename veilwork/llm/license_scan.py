"""License scan by diagonal voting. Native columns only.

Every rolling word pair of every whole text is joined by hash to the word pairs of the templates (a fixed list of a
few hundred rows, so its broadcast is bounded); the pair's words are compared too, so hash collisions never count. Hits are
added up by (document, template, diagonal), diagonal = word place in the text minus place in the template. A phrase
stands exactly where a diagonal has all its pairs. For notices, diagonals at most `gap` apart are merged (words left out
or put in), and the merged span counts when it covers `cover` of the notice's pairs.

Null and empty texts give zero counts, null places, empty labels and score 0. Rows repeating a doc_id are told apart by
an internal row number. Other columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose exact places are counted.
PHRASES = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Notices found with gaps: label and text (usual headers and passages of the licenses). Their words are taken as those of the documents are.
NOTICES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a
        copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", """Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
        must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the GNU General Public License version 3"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software
        Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
        in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
        and to permit persons to whom the Software is furnished to do so"""),
    ("mpl", "subject to the terms of the Mozilla Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one"),
    ("public-domain", "released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"),
)
GAP, COVER = 2, 0.7


def lower_ascii(col):
    """A-Z to a-z and no other change; lower() is the same, and faster, where all characters are ASCII."""
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate({c: c + 32 for c in range(65, 91)}))


def template_pairs(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """template id, label, exact, pairs in the template, place, and the pair's two words."""
    rows = []  # a few hundred
    for k, (label, text, exact) in enumerate([(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in notices]):
        words = template_words(text)
        rows += [(k, label, exact, len(words) - 1, i, a, b) for i, (a, b) in enumerate(zip(words, words[1:]))]
    schema = "template int, label string, exact boolean, n_pairs int, place int, first string, second string"
    return spark.createDataFrame(rows, schema).withColumn("pair", F.xxhash64("first", "second"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, notices=NOTICES,
                  gap: int = GAP, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): (row, doc_id, n_words) for every row of docs, and one row per verified span:
    row, label, exact, start and stop (word places, stop not included), coverage (share of the template's pairs)."""
    words = F.regexp_extract_all(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), words.alias("words"))
    # Only the exploded pair and scalars go on: the words array must not be copied along with each pair. The outer explode keeps documents without any pair
    pairs = F.arrays_zip(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))).alias("first"), F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))).alias("second"))
    rolling = base.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), F.posexplode_outer(pairs).alias("at", "p"))
    rolling = rolling.withColumn("pair", F.xxhash64("p.first", "p.second"))
    found = template_pairs(docs.sparkSession, phrases, notices).select("template", "label", "exact", "n_pairs", "place", F.col("pair").alias("hash"), F.col("first").alias("f"), F.col("second").alias("s"))
    same = (F.col("pair") == F.col("hash")) & (F.col("p.first") == F.col("f")) & (F.col("p.second") == F.col("s"))
    joined = rolling.join(F.broadcast(found), same, "left")
    kept = joined.where("template IS NOT NULL OR coalesce(at, 0) = 0").select("row", "doc_id", "n_words", "at", "template", "label", "exact", "n_pairs", "place")
    kept = materialise(kept)
    documents = kept.select("row", "doc_id", "n_words").distinct()
    hits = kept.where("template IS NOT NULL").withColumn("diagonal", F.col("at") - F.col("place"))
    exact = hits.where("exact").groupBy("row", "label", "template", "n_pairs", "diagonal").agg(F.count("*").alias("votes"))
    exact = exact.where("votes = n_pairs").select("row", "label", F.lit(True).alias("exact"), F.col("diagonal").cast("long").alias("start"),
                                                  (F.col("diagonal") + F.col("n_pairs") + 1).cast("long").alias("stop"), F.lit(1.0).alias("coverage"))
    voted = hits.where("NOT exact").groupBy("row", "label", "template", "n_pairs", "diagonal").agg(
        F.collect_set("place").alias("places"), F.min("at").alias("low"), F.max("at").alias("high"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int"), F.lit(1))
    voted = voted.withColumn("new", new).withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bands = voted.groupBy("row", "label", "template", "n_pairs", "band").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    near = bands.withColumn("coverage", F.col("n") / F.col("n_pairs")).where(F.col("coverage") >= cover).select(
        "row", "label", F.lit(False).alias("exact"), F.col("low").cast("long").alias("start"), (F.col("high") + 2).cast("long").alias("stop"), "coverage")
    return documents, reduce(DataFrame.unionByName, [exact, near])


def scan_licenses(docs: DataFrame, **options) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (best coverage)."""
    documents, spans = license_spans(docs, **options)
    per = spans.groupBy("row").agg(
        F.count_if("exact").alias("n_base"), F.min(F.when(F.col("exact"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.max("coverage").alias("score"))
    return documents.join(per, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def _sql() -> str:
    texts = [(k, label, " ".join(template_words(text)), k < len(PHRASES)) for k, (label, text) in enumerate(PHRASES + NOTICES)]
    values = ", ".join(f"({k}, '{label}', '{text}', {exact})" for k, label, text, exact in texts)
    return rf"""
WITH t0(template, label, body, exact) AS (VALUES {values}),
t1 AS (SELECT template, label, exact, string_split(body, ' ') AS w FROM t0),
t AS (SELECT template, label, exact, len(w) - 1 AS n_pairs, i AS place, w[i + 1] AS first, w[i + 2] AS second
  FROM (SELECT *, unnest(range(len(w) - 1)) AS i FROM t1)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, i AS spot, w[i + 1] AS first, w[i + 2] AS second
  FROM (SELECT *, unnest(range(greatest(len(w) - 1, 0))) AS i FROM d)),
h AS (SELECT p.doc_id, spot, t.template, label, exact, n_pairs, place, spot - place AS diagonal FROM p JOIN t USING (first, second)),
e AS (SELECT doc_id, label, true AS exact, diagonal AS start, 1.0::DOUBLE AS coverage FROM h WHERE exact
  GROUP BY doc_id, label, template, n_pairs, diagonal HAVING count(*) = n_pairs),
g AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal, place) <= {GAP} THEN 0 ELSE 1 END AS new FROM h WHERE NOT exact),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal, place ROWS UNBOUNDED PRECEDING) AS band FROM g),
n AS (SELECT doc_id, label, false AS exact, min(spot) AS start, count(DISTINCT place) / n_pairs::DOUBLE AS coverage FROM b
  GROUP BY doc_id, label, template, n_pairs, band HAVING count(DISTINCT place) / n_pairs::DOUBLE >= {COVER}),
s AS (SELECT * FROM e UNION ALL SELECT * FROM n),
a AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(start) FILTER (exact) AS first_word, max(start) FILTER (exact) AS last_word,
  array_to_string(list_sort(list(DISTINCT label) FILTER (exact)), ',') AS base_labels,
  array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(coverage) AS score FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN a USING (doc_id)
"""


SQL = _sql()


def op4_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))
