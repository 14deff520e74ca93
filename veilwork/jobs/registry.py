"""Queries of the redaction library and the SQL that checks them, by name. Each reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.stored import new_path, stored
from ..operators import detect as D
from ..operators import evaluate as E
from ..operators import fakes as K
from ..operators import filters as FI
from ..operators import redact as X
from ..operators import reports as A
from ..sources import files as W
from ..sources.units import spread, template_rows, units_from_table
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
UNIT = ("doc_id", "unit_ord", "unit_id")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_units(spark, sf_dir) -> DataFrame:
    return units_from_table(table(spark, sf_dir, "documents"))


def templates(spark, sf_dir) -> DataFrame:
    """Dealt by document: the table of keys is small and each key is a unit to analyse."""
    return template_rows(spread(table(spark, sf_dir, "customer").select("c_custkey"), F.floor(F.col("c_custkey") / 10)))


def spans(units: DataFrame) -> DataFrame:
    return X.one_per_span(units, UNIT).select(*UNIT, "s.*")


def doc_analysis(spark, sf_dir) -> DataFrame:
    return X.analyze_units(D.detect(doc_units(spark, sf_dir)))


def template_analysis(spark, sf_dir) -> DataFrame:
    return X.analyze_units(D.detect(templates(spark, sf_dir)))


def _doc(rest: str) -> str:
    return f"WITH {Q.analysed(Q.DOC_UNITS)} {rest}"


def _tpl(rest: str) -> str:
    return f"WITH {Q.analysed(Q.TEMPLATE_UNITS)} {rest}"


SPANS = f"SELECT {Q.SPAN_COLUMNS} FROM "


@query("s1_units", f"WITH {Q.DOC_UNITS} SELECT * FROM units")
def s1(spark, sf_dir):
    return doc_units(spark, sf_dir)


@query("s1_template_units", f"WITH {Q.TEMPLATE_UNITS} SELECT * FROM units")
def s1_template(spark, sf_dir):
    return templates(spark, sf_dir).select(*UNIT, "text")


CUE = f"regexp_matches(text, '[@0-9]') OR regexp_matches(lower(text), {Q.q('|'.join(S.CUES))})"


@query("f1_prefilter", rf"WITH {Q.DOC_UNITS} SELECT * FROM units WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 3 AND ({CUE})")
def f1(spark, sf_dir):
    return FI.prefilter_units(doc_units(spark, sf_dir))


for _name, _recognizer, _from_docs in (
    ("d1_email", "email", True), ("d2_indian_phone", "indian_phone", True), ("d3_intl_phone", "intl_phone", True), ("d4_ssn", "ssn", False), ("d5_company", "company", False),
    ("d6_person", "person", False), ("d7_date_of_birth", "dob", False), ("d8_address", "address", False), ("d11_card", "card", True), ("d12_ipv4", "ipv4", True),
    ("d5_company_documents", "company", True), ("d8_address_documents", "address", True),
):
    @query(_name, f"WITH {Q.found(Q.DOC_UNITS if _from_docs else Q.TEMPLATE_UNITS, [_recognizer])} {SPANS} found")
    def _one(spark, sf_dir, recognizer=_recognizer, from_docs=_from_docs):
        return spans(D.detect((doc_units if from_docs else templates)(spark, sf_dir), [recognizer]))


# Whole documents as units: the address rules that look at line breaks.
WHOLE = "units AS (SELECT k // 10 AS doc_id, 0 AS unit_ord, 'whole' AS unit_id, string_agg(text, chr(10) ORDER BY k) AS text FROM (SELECT *, doc_id * 10 + unit_ord AS k FROM parts) GROUP BY ALL)"


@query("d9_d10_address_lines", f"WITH {Q.found(Q.TEMPLATE_UNITS.replace('units AS', 'parts AS', 1) + ', ' + WHOLE, ['address'])} {SPANS} found")
def d9(spark, sf_dir):
    lines = templates(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_ord", "text"))).alias("l"))  # ten lines a document
    whole = lines.select("doc_id", F.lit(0).alias("unit_ord"), F.lit("whole").alias("unit_id"), F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("text"))
    return spans(D.detect(whole, ["address"]))


@query("d14_detect_all", f"WITH {Q.found(Q.TEMPLATE_UNITS)} {SPANS} found")
def d14(spark, sf_dir):
    return spans(D.detect(templates(spark, sf_dir)))


@query("d14_detect_documents", f"WITH {Q.found(Q.DOC_UNITS)} {SPANS} found")
def d14_documents(spark, sf_dir):
    return spans(D.detect(doc_units(spark, sf_dir)))


_terms = " OR ".join(f"(entity_type = {Q.q(t)} AND contains(near, {Q.q(w)}))" for t, words in S.CONTEXT.items() for w in words)


@query("d13_context_boost", rf"""WITH {Q.found(Q.TEMPLATE_UNITS, ['email', 'indian_phone', 'ssn'])},
w AS (SELECT *, string_split_regex(regexp_replace(lower(substring(text, 1, st)), '^\s+|\s+$', '', 'g'), '\s+') AS w FROM found),
n AS (SELECT * EXCLUDE (w), array_to_string(w[greatest(len(w) - 4, 1):], ' ') AS near FROM w),
b AS (SELECT * REPLACE (CASE WHEN {_terms} THEN least(score + 0.35::DOUBLE, 1.0::DOUBLE) ELSE score END AS score) FROM n) {SPANS} b""")
def d13(spark, sf_dir):
    units = D.detect(templates(spark, sf_dir), ["email", "indian_phone", "ssn"])
    return spans(units.withColumn("spans", D.boost_by_context(F.col("spans"), F.col("text"))))


EXTERNAL = " UNION ALL SELECT t.doc_id, t.unit_ord, t.unit_id, text, entity_type, t.st, t.en, 0.85::DOUBLE, 'model' FROM truth t JOIN units u USING (doc_id, unit_ord) WHERE entity_type IN ('PERSON', 'ORGANIZATION')"


@query("d15_external_spans", f"WITH {Q.found(Q.TEMPLATE_UNITS, extra=EXTERNAL)}, {Q.FILTERED}, {Q.resolved('filtered')} {SPANS} kept")
def d15(spark, sf_dir):
    units = templates(spark, sf_dir)
    model = units.select("doc_id", "unit_ord", F.explode("gt").alias("g")).select("doc_id", "unit_ord", "g.*", F.lit(0.85).alias("score"), F.lit("model").alias("recognizer"))
    model = model.where("entity_type IN ('PERSON', 'ORGANIZATION')")
    return spans(X.analyze_units(D.detect(D.add_external_spans(units, model))))


@query("u1_custom_recognizer", f"WITH {Q.DOC_UNITS}, {Q._places('cu', '[A-Z]{4,}!!')}, found AS ({Q._rows('cu', 'SHOUT', 0.8, 'custom')}) {SPANS} found")
def u1(spark, sf_dir):
    return spans(D.detect(doc_units(spark, sf_dir), ["shout"], extra={"shout": D.regex_recognizer("SHOUT", "[A-Z]{4,}!!", 0.8)}))


CUSTOM = D.Custom().register("shout", "SHOUT", regex="[A-Z]{4,}!!", score=0.8, label="[SHOUTED]", threshold=0.75, priority=2)
_shout = f"found AS ({Q._rows('cu', 'SHOUT', 0.8, 'shout')})"


@query("u1_custom_type", f"WITH {Q.DOC_UNITS}, {Q._places('cu', '[A-Z]{4,}!!')}, {_shout}, {Q.redacted(repr('[SHOUTED]'), 'found')} SELECT doc_id, unit_ord, unit_id, redacted FROM red")
def u1_type(spark, sf_dir):
    """A type of the caller's own, from detection to redaction."""
    units = X.analyze_units(D.detect(doc_units(spark, sf_dir), ["shout"], extra=CUSTOM.recognizers), types=CUSTOM.types)
    return X.redact_labels(units, types=CUSTOM.types).select(*UNIT, "redacted")


# Candidates that the false-positive rules decide, dealt over the customers.
CANDIDATES = ("the Company", "our Bank", "Our Company ABC Limited", "SEBI", "RBI.", "ABC", "Weighted Average Price of shares", "we require funds", "prepared by Care Analytics Private Limited",
              "Alpha Technologies", "registered under the Act", "Reserve Bank", "“Zen Corp.”", "Limited", "XYZ & Associates LLP", "Mumbai", "Taluka Khed", "Rajesh Kumar", "FEMA", "ABCD EFG", "ABCDE FGHIJ",
              "email", "Navi Mumbai", "Priya Singh", "an Institution ", "Goods & Services", "such trust deed")
CANDIDATE_SQL = f"c AS (SELECT c_custkey, {Q.pick(CANDIDATES, 'c_custkey')} AS candidate FROM customer)"


def candidates(spark, sf_dir) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, CANDIDATES)), (F.pmod(F.col("c_custkey"), F.lit(len(CANDIDATES))) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.alias("candidate"))


_bare = f"regexp_replace(candidate, {Q.q(Q.EDGE)}, '', 'g')"


@query("f4_org_false_positive", f"WITH {CANDIDATE_SQL} SELECT c_custkey, candidate, {Q.org_fp(_bare)} AS is_fp FROM c")
def f4(spark, sf_dir):
    return candidates(spark, sf_dir).withColumn("is_fp", FI.is_org_fp(F.col("candidate")))


@query("f5_person_false_positive", rf"WITH {CANDIDATE_SQL}, t AS (SELECT *, regexp_replace(candidate, '^\s+|\s+$', '', 'g') AS b FROM c) SELECT c_custkey, candidate, {Q.person_fp('b')} AS is_fp FROM t")
def f5(spark, sf_dir):
    return candidates(spark, sf_dir).withColumn("is_fp", FI.is_person_fp(F.col("candidate")))


@query("f6_generic_company", f"WITH {CANDIDATE_SQL} SELECT c_custkey, candidate, {Q.generic_company(_bare)} AS is_generic FROM c")
def f6(spark, sf_dir):
    return candidates(spark, sf_dir).withColumn("is_generic", D.is_generic_company(F.col("candidate")))


@query("f2_supported_types", f"WITH {Q.found(Q.TEMPLATE_UNITS, extra=EXTERNAL.replace('entity_type, t.st', chr(39) + 'NRP' + chr(39) + ', t.st'))} {SPANS} found WHERE entity_type IN {Q.one_of(S.TYPES)}")
def f2(spark, sf_dir):
    units = templates(spark, sf_dir)
    other = units.select("doc_id", "unit_ord", F.explode("gt").alias("g")).where("g.entity_type IN ('PERSON', 'ORGANIZATION')").select(
        "doc_id", "unit_ord", F.lit("NRP").alias("entity_type"), "g.start", "g.end", F.lit(0.85).alias("score"), F.lit("model").alias("recognizer"))
    units = D.detect(D.add_external_spans(units, other))
    return spans(units.withColumn("spans", FI.keep_supported(F.col("spans"))))


@query("f3_threshold", f"WITH {Q.found(Q.TEMPLATE_UNITS)} {SPANS} found WHERE score >= {Q.by_type('entity_type', 1, S.DEFAULT_THRESHOLD)}")
def f3(spark, sf_dir):
    units = D.detect(templates(spark, sf_dir))
    return spans(units.withColumn("spans", FI.filter_by_threshold(F.col("spans"))))


LOWER = {"PHONE_NUMBER": 0.8, "PERSON": 0.95, "US_SSN": 0.5}


@query("f3_threshold_argument", f"WITH {Q.found(Q.TEMPLATE_UNITS)} {SPANS} found WHERE score >= CASE entity_type " + " ".join(f"WHEN '{t}' THEN {v}" for t, v in LOWER.items()) + f" ELSE {Q.by_type('entity_type', 1, S.DEFAULT_THRESHOLD)} END")
def f3_argument(spark, sf_dir):
    units = D.detect(templates(spark, sf_dir))
    return spans(units.withColumn("spans", FI.filter_by_threshold(F.col("spans"), LOWER)))


@query("f8_combined_filter", f"WITH {Q.found(Q.TEMPLATE_UNITS)}, {Q.FILTERED} {SPANS} filtered")
def f8(spark, sf_dir):
    units = D.detect(templates(spark, sf_dir))
    return spans(units.withColumn("spans", FI.filter_spans(F.col("spans"), F.col("text"))))


@query("r1_resolve_overlaps", f"WITH {Q.found(Q.DOC_UNITS)}, {Q.resolved('found')} {SPANS} kept")
def r1(spark, sf_dir):
    units = D.detect(doc_units(spark, sf_dir))
    return spans(units.withColumn("spans", X.resolve_overlaps(F.col("spans"))))


@query("r2_resolve_first", f"WITH {Q.found(Q.TEMPLATE_UNITS)}, {Q.resolved('found')} {SPANS} kept WHERE entity_type IN {Q.one_of(S.TYPES)} AND score >= {Q.by_type('entity_type', 1, S.DEFAULT_THRESHOLD)}")
def r2(spark, sf_dir):
    return spans(X.analyze_units(D.detect(templates(spark, sf_dir)), "resolve_first"))


@query("r2_filter_first", _tpl(SPANS + "kept"))
def r2_filter(spark, sf_dir):
    return spans(template_analysis(spark, sf_dir))


@query("x1_redact_labels", _doc(f", {Q.redacted(Q.LABEL)} SELECT doc_id, unit_ord, unit_id, redacted FROM red"))
def x1(spark, sf_dir):
    return X.redact_labels(doc_analysis(spark, sf_dir)).select(*UNIT, "redacted")


@query("x1_redact_templates", _tpl(f", {Q.redacted(Q.LABEL)} SELECT doc_id, unit_ord, unit_id, redacted FROM red"))
def x1_templates(spark, sf_dir):
    return X.redact_labels(template_analysis(spark, sf_dir)).select(*UNIT, "redacted")


@query("x2_redact_fakes", _tpl(f", {Q.MAPPED}, valued AS (SELECT k.*, m.replacement FROM (SELECT *, {Q.STRIPPED} AS original FROM kept) k JOIN mapped m USING (doc_id, entity_type, original)), {Q.redacted('replacement', 'valued')} SELECT doc_id, unit_ord, unit_id, redacted FROM red"))
def x2(spark, sf_dir):
    return X.redact_with(X.with_fakes(template_analysis(spark, sf_dir))).select(*UNIT, "redacted")


@query("x2_redact_fakes_mapping", SQL["x2_redact_fakes"])
def x2_mapping(spark, sf_dir):
    """The same by a mapping that is joined."""
    units = stored(template_analysis(spark, sf_dir))  # read three times
    return X.redact_fakes(units, K.replacement_map(X.explode_detections(units))).select(*UNIT, "redacted")


@query("x2_redact_fakes_documents", _doc(f", {Q.MAPPED}, valued AS (SELECT k.*, m.replacement FROM (SELECT *, {Q.STRIPPED} AS original FROM kept) k JOIN mapped m USING (doc_id, entity_type, original)), {Q.redacted('replacement', 'valued')} SELECT doc_id, unit_ord, unit_id, redacted FROM red"))
def x2_documents(spark, sf_dir):
    return X.redact_with(X.with_fakes(doc_analysis(spark, sf_dir))).select(*UNIT, "redacted")


@query("x3_redact_runs", _tpl(f""", {Q.redacted(Q.LABEL)} SELECT doc_id, unit_ord, redacted AS joined, CAST(3 AS INT) AS n_runs FROM red"""))
def x3(spark, sf_dir):
    """The runs are three pieces of each text; joined after redaction they must be the redacted text."""
    units, n = template_analysis(spark, sf_dir), F.length("text")
    cuts = [F.lit(0), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"), n]
    runs = F.array(*[F.struct(F.lit(i).alias("run_index"), a.alias("run_start"), b.alias("run_end"), F.substring("text", a + 1, b - a).alias("text")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    out = X.redact_runs(units.withColumn("runs", runs))
    return out.select("doc_id", "unit_ord", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("joined"), F.size("runs").alias("n_runs"))


DETECTION = f'SELECT doc_id, unit_ord, unit_id, entity_type, st AS "start", en AS "end", round(score, 3) AS score, {Q.SAID} AS text, {Q.LABEL} AS replacement FROM kept'


@query("x4_detections", _doc(DETECTION))
def x4(spark, sf_dir):
    return X.explode_detections(doc_analysis(spark, sf_dir))


def template_detections(spark, sf_dir) -> DataFrame:
    return X.explode_detections(template_analysis(spark, sf_dir))


@query("x4_detections_with_fakes", _tpl(f""", {Q.MAPPED} SELECT k.doc_id, unit_ord, unit_id, k.entity_type, st AS "start", en AS "end", round(score, 3) AS score, {Q.SAID} AS text, m.replacement
FROM (SELECT *, {Q.STRIPPED} AS original FROM kept) k JOIN mapped m ON k.doc_id = m.doc_id AND k.entity_type = m.entity_type AND k.original = m.original"""))
def x4_fakes(spark, sf_dir):
    return X.explode_detections(X.with_fakes(template_analysis(spark, sf_dir)), values_col="fakes")


@query("k1_fake_index", _tpl(f", {Q.MAPPED} SELECT * FROM ids"))
def k1(spark, sf_dir):
    return K.assign_fake_ids(template_detections(spark, sf_dir))


@query("k1_fake_index_corpus", _tpl(f""", f AS (SELECT entity_type, {Q.STRIPPED} AS original, min({{'d': doc_id, 'u': unit_ord, 's': st}}) AS f FROM kept GROUP BY ALL)
SELECT entity_type, original, row_number() OVER (PARTITION BY entity_type ORDER BY f, original) - 1 AS idx FROM f"""))
def k1_corpus(spark, sf_dir):
    return K.assign_fake_ids_corpus(template_detections(spark, sf_dir))


@query("k1_fake_index_corpus_strings", _tpl(f""", f AS (SELECT entity_type, {Q.STRIPPED} AS original, min({{'d': 'doc-' || doc_id, 'u': unit_ord, 's': st}}) AS f FROM kept GROUP BY ALL)
SELECT entity_type, original, row_number() OVER (PARTITION BY entity_type ORDER BY f, original) - 1 AS idx FROM f"""))
def k1_strings(spark, sf_dir):
    named = template_detections(spark, sf_dir).withColumn("doc_id", F.concat(F.lit("doc-"), F.col("doc_id").cast("string")))
    return K.assign_fake_ids_corpus(named, chunks=16)


FAKE_KINDS = (*S.TYPES, "NRP")


@query("k2_k11_fake_values", f"""WITH t AS (SELECT c_custkey, unnest([{', '.join(map(Q.q, FAKE_KINDS))}]) AS entity_type FROM customer),
o AS (SELECT *, c_name || ' Corp. born 1985' AS original FROM t JOIN customer USING (c_custkey)) SELECT c_custkey, entity_type, {Q.fake('entity_type', 'c_custkey', 'original')} AS value FROM o""")
def k2(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat("c_name", F.lit(" Corp. born 1985")).alias("original"), F.explode(F.array(*map(F.lit, FAKE_KINDS))).alias("entity_type"))
    return rows.select("c_custkey", "entity_type", K.fake_value(F.col("entity_type"), F.col("original"), F.col("c_custkey")).alias("value"))


@query("k12_replacement_map", _tpl(f", {Q.MAPPED} SELECT * FROM mapped"))
def k12(spark, sf_dir):
    return K.replacement_map(template_detections(spark, sf_dir))


@query("a1_counts_by_type", _doc("SELECT entity_type, count(*) AS n FROM kept GROUP BY ALL"))
def a1(spark, sf_dir):
    return A.counts_by_type(X.explode_detections(doc_analysis(spark, sf_dir)))


@query("a2_counts_with_total", _doc("SELECT coalesce(entity_type, 'TOTAL') AS entity_type, count(*) AS n FROM kept GROUP BY ROLLUP (entity_type)"))
def a2(spark, sf_dir):
    return A.counts_with_total(X.explode_detections(doc_analysis(spark, sf_dir)))


COVERED = ", per AS (SELECT u.doc_id, u.unit_ord, count(k.st) AS n FROM units u LEFT JOIN kept k USING (doc_id, unit_ord) GROUP BY ALL)"
COVER = "count(*) AS total_units, count(*) FILTER (n > 0) AS units_with_pii, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_pii_count"


@query("a3_coverage", _doc(f"{COVERED} SELECT {COVER} FROM per"))
def a3(spark, sf_dir):
    return A.coverage(doc_analysis(spark, sf_dir))


@query("a3_coverage_conversations", f"""WITH units AS (SELECT conv_id AS doc_id, CAST(turn AS INT) AS unit_ord, CAST(turn AS VARCHAR) AS unit_id, text FROM conversations WHERE text IS NOT NULL),
{Q.found('z AS (SELECT 1)')}, {Q.FILTERED}, {Q.resolved('filtered')}{COVERED} SELECT doc_id, {COVER} FROM per GROUP BY doc_id""")
def a3_conversations(spark, sf_dir):
    units = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("unit_ord"), F.col("turn").cast("string").alias("unit_id"), "text")
    return A.coverage(X.analyze_units(D.detect(units)), ["doc_id"])


@query("a4_document_report", _doc(f"{COVERED}, c AS (SELECT doc_id, entity_type, count(*) AS n FROM kept GROUP BY ALL), j AS (SELECT doc_id, string_agg(entity_type || '=' || n, ',' ORDER BY entity_type) AS counts FROM c GROUP BY ALL) "
                                  f"SELECT doc_id, {COVER}, coalesce(any_value(counts), '') AS counts FROM per LEFT JOIN j USING (doc_id) GROUP BY doc_id"))
def a4(spark, sf_dir):
    units = doc_analysis(spark, sf_dir)
    report = A.document_report(units, X.explode_detections(units))
    told = F.array_join(F.transform(F.map_entries("counts_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return report.withColumn("counts", told).drop("counts_by_type")


NESTED = f""", {Q.MAPPED}, n AS (SELECT k.doc_id, string_agg(unit_ord || ':' || st || '-' || en || ' ' || {Q.SAID} || ' > ' || m.replacement, '; ' ORDER BY unit_ord, st) AS told
  FROM (SELECT *, {Q.STRIPPED} AS original FROM kept) k JOIN mapped m ON k.doc_id = m.doc_id AND k.entity_type = m.entity_type AND k.original = m.original GROUP BY k.doc_id),
r AS (SELECT doc_id, string_agg(entity_type || ' ' || idx || ' ' || original || ' > ' || replacement, '; ' ORDER BY entity_type, idx) AS mapped FROM mapped GROUP BY doc_id)"""


@query("a4_nested_report", _tpl(f"{COVERED}{NESTED} SELECT doc_id, {COVER}, coalesce(any_value(told), '') AS detections, coalesce(any_value(mapped), '') AS replacement_map FROM per LEFT JOIN n USING (doc_id) LEFT JOIN r USING (doc_id) GROUP BY doc_id"))
def a4_nested(spark, sf_dir):
    units = stored(template_analysis(spark, sf_dir))
    mapping = stored(K.replacement_map(X.explode_detections(units)))
    report = A.document_report(units, X.explode_detections(units, mapping=mapping), nested=True, mapping=mapping)
    one = lambda x: F.concat(x["unit_ord"].cast("string"), F.lit(":"), x["start"].cast("string"), F.lit("-"), x["end"].cast("string"), F.lit(" "), x["text"], F.lit(" > "), x["replacement"])
    two = lambda x: F.concat_ws(" ", x["entity_type"], x["idx"].cast("string"), x["original"], F.lit(">"), x["replacement"])
    return report.select("doc_id", "total_units", "units_with_pii", "total_pii_count", F.array_join(F.transform("detections", one), "; ").alias("detections"),
                         F.array_join(F.transform("replacement_map", two), "; ").alias("replacement_map"))


@query("a5_distinct_types", _doc("SELECT DISTINCT entity_type FROM kept"))
def a5(spark, sf_dir):
    return A.distinct_types(X.explode_detections(doc_analysis(spark, sf_dir)))


@query("a6_first_detections", _doc(f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord, \"start\", entity_type) AS INT) AS rank FROM ({DETECTION})) WHERE rank <= 50"))
def a6(spark, sf_dir):
    return A.first_detections(X.explode_detections(doc_analysis(spark, sf_dir)))


@query("a7_dashboard", _doc("SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (entity_type = '{t}') AS {t.lower()}" for t in A.CARDS) + " FROM kept"))
def a7(spark, sf_dir):
    return A.dashboard(X.explode_detections(doc_analysis(spark, sf_dir)))


@query("f7_search", _doc(f"SELECT * FROM ({DETECTION}) WHERE entity_type = 'IP_ADDRESS' AND (contains(lower(text), '19') OR contains(lower(unit_id), '19'))"))
def f7(spark, sf_dir):
    return FI.search_detections(X.explode_detections(doc_analysis(spark, sf_dir)), "IP_ADDRESS", "19")


LEFT = f"{Q.redacted(Q.LABEL)}, leaky AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 0 THEN text ELSE redacted END AS redacted) FROM red)"


@query("q1_leaks", _tpl(f", {LEFT} SELECT k.doc_id, k.unit_ord, entity_type, st AS \"start\", en AS \"end\", {Q.SAID.replace('text', 'k.text')} AS text FROM kept k JOIN leaky r USING (doc_id, unit_ord) WHERE contains(redacted, {Q.SAID.replace('text', 'k.text')})"))
def q1(spark, sf_dir):
    """Every seventh document is left as it was, so that there are leaks to be found."""
    units = stored(X.redact_labels(template_analysis(spark, sf_dir)))
    return A.leaks(units.withColumn("redacted", F.when(F.col("doc_id") % 7 == 0, F.col("text")).otherwise(F.col("redacted"))), X.explode_detections(units))


@query("q2_preserved", f"WITH {Q.DOC_UNITS} SELECT count(*) AS units, count(*) FILTER (doc_id % 5 = 0) AS changed FROM units")
def q2(spark, sf_dir):
    """Redaction changes nothing outside the spans; a word put behind every fifth document's units is found."""
    units = X.redact_labels(doc_analysis(spark, sf_dir))
    units = stored(units.withColumn("redacted", F.when(F.col("doc_id") % 5 == 0, F.concat("redacted", F.lit(" more"))).otherwise(F.col("redacted"))))
    return units.select(F.lit(0).alias("c")).unionByName(A.changed_outside(units).select(F.lit(1).alias("c"))).agg(F.count_if(F.col("c") == 0).alias("units"), F.count_if(F.col("c") == 1).alias("changed"))


# Evaluation: the templates' own spans are the truth; the detections are those of all recognizers.
DET = f"det AS (SELECT doc_id, unit_id, entity_type, st, en, (doc_id * 10 + unit_ord) * 100000 + st AS det_id FROM kept), gt AS (SELECT doc_id, unit_id, entity_type, st, en, (doc_id * 10 + unit_ord) * 100000 + st AS gt_id FROM truth)"
CAND = """cand AS (SELECT d.doc_id, d.unit_id, d.entity_type, det_id, gt_id, d.st AS ds, d.en AS de, g.st AS gs, g.en AS ge FROM det d JOIN gt g ON d.doc_id = g.doc_id AND d.unit_id = g.unit_id AND d.entity_type = g.entity_type
  WHERE least(d.en, g.en) - greatest(d.st, g.st) > 0 AND (least(d.en, g.en) - greatest(d.st, g.st)) / (g.en - g.st) >= 0.5)"""


def sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    number = lambda start: ((F.col("doc_id") * 10 + F.col("unit_ord")) * 100000 + start).cast("bigint")
    det = template_detections(spark, sf_dir).select("doc_id", "unit_id", "entity_type", "start", "end", number(F.col("start")).alias("det_id"))
    truth = templates(spark, sf_dir).select(*UNIT, F.explode("gt").alias("g")).select("doc_id", "unit_id", "g.entity_type", "g.start", "g.end", number(F.col("g.start")).alias("gt_id"))
    return det, truth


@query("e1_match_candidates", _tpl(f", {DET}, {CAND} SELECT * FROM cand"))
def e1(spark, sf_dir):
    return E.match_candidates(*sides(spark, sf_dir))


@query("e2_match_spans", _tpl(f", {DET}, {CAND} SELECT doc_id, unit_id, entity_type, det_id, min(gt_id) AS gt_id FROM cand GROUP BY ALL"))
def e2(spark, sf_dir):
    return E.match_spans(*sides(spark, sf_dir))


OUT = f"""{DET}, {CAND}, o AS (SELECT entity_type, 'tp' AS outcome FROM cand UNION ALL SELECT entity_type, 'fn' FROM gt WHERE gt_id NOT IN (SELECT gt_id FROM cand)
  UNION ALL SELECT entity_type, 'fp' FROM det WHERE det_id NOT IN (SELECT det_id FROM cand) AND (doc_id, unit_id) IN (SELECT (doc_id, unit_id) FROM gt))"""


@query("e3_e4_outcomes", _tpl(f", {OUT} SELECT entity_type, outcome, count(*) AS n FROM o GROUP BY ALL"))
def e3(spark, sf_dir):
    return E.outcomes(*sides(spark, sf_dir))


METRICS = _tpl(f""", {OUT}, t AS (SELECT entity_type, outcome FROM o UNION ALL SELECT entity_type, NULL FROM gt UNION ALL SELECT entity_type, NULL FROM det),
c AS (SELECT entity_type, count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome = 'fp') AS fp, count(*) FILTER (outcome = 'fn') AS fn FROM t GROUP BY ROLLUP (entity_type)),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT coalesce(entity_type, 'OVERALL') AS entity_type, tp, fp, fn, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
  entity_type IS NULL OR entity_type IN (SELECT entity_type FROM gt) AS in_gt FROM p""")


@query("e5_e6_metrics", METRICS)
def e5(spark, sf_dir):
    return E.evaluate(*sides(spark, sf_dir))


# Files: written from a table into the shared folder and read back.
def truth_files(spark, sf_dir) -> str:
    """A ground-truth file a document of the templates: its entries in order, and the types that it lacks. Returns the folder."""
    path = new_path(spark, "truth")
    entry = F.struct("unit_ord", "g.start", "unit_id", "g.entity_type", "g.end", F.expr("substring(text, g.start + 1, g.end - g.start)").alias("text"))
    rows = templates(spark, sf_dir).select("doc_id", "unit_ord", "unit_id", "text", F.explode("gt").alias("g")).groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))  # ten units
    lacking = F.array_except(F.array(*map(F.lit, S.TYPES)), F.transform("entries", lambda e: e["entity_type"]))
    absent = F.map_from_arrays(lacking, F.transform(lacking, lambda _: F.lit("none in this document")))
    W.write_ground_truth(rows.select(F.col("doc_id").cast("string").alias("name"), F.to_json(F.struct("entries", absent.alias("absent_types"))).alias("value")), path)
    return path


@query("s4_ground_truth", _tpl("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord, st) - 1 AS INT) AS gt_id, unit_id, entity_type, st AS \"start\", en AS \"end\", "
                                f"{Q.SAID} AS text FROM truth JOIN (SELECT doc_id, unit_ord, text FROM units) USING (doc_id, unit_ord)"))
def s4(spark, sf_dir):
    return W.read_ground_truth(spark, truth_files(spark, sf_dir))[0]


_kinds = ", ".join(map(Q.q, S.TYPES))


@query("e7_absent_types", f"WITH {Q.TEMPLATE_UNITS}, d AS (SELECT DISTINCT doc_id FROM truth), t AS (SELECT doc_id, unnest([{_kinds}]) AS entity_type FROM d) "
                          "SELECT CAST(doc_id AS VARCHAR) AS doc_id, entity_type, 'none in this document' AS reason FROM t WHERE (doc_id, entity_type) NOT IN (SELECT (doc_id, entity_type) FROM truth)")
def e7(spark, sf_dir):
    return E.absent_types(stored(W.read_ground_truth(spark, truth_files(spark, sf_dir))[1]))  # sorting would read the files twice


@query("e_metrics_from_files", METRICS)
def e_files(spark, sf_dir):
    """E5, E6 with the truth read from files whose entries are numbered from 0 in each."""
    det = sides(spark, sf_dir)[0].withColumn("doc_id", F.col("doc_id").cast("string"))
    return E.evaluate(det, W.read_ground_truth(spark, truth_files(spark, sf_dir))[0])


@query("s2_docx_units", f"""WITH {Q.TEMPLATE_UNITS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord) - 1 AS i FROM units),
f AS (SELECT *, max(i) OVER (PARTITION BY doc_id) + 1 AS n FROM o)
SELECT doc_id || CASE WHEN doc_id % 3 = 0 THEN '.DOCX' ELSE '.docx' END AS doc_id, CAST(i AS INT) AS unit_ord, CASE WHEN i < 7 THEN 'body-para-' || i ELSE 'table-0-r0-c' || (i - 7) || '-para-0' END AS unit_id, text,
  CAST(2 AS INT) AS n_runs FROM f WHERE doc_id % 3 < 2""")
def s2(spark, sf_dir):
    """.docx files made of the templates' documents (seven paragraphs, then a table, every line in two runs; every third one named otherwise) through the gate and the walker."""
    import pandas as pd

    lines = templates(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_ord", "text"))).alias("l"))  # ten lines a document
    ending = F.element_at(F.array(F.lit(".DOCX"), F.lit(".docx"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    named = lines.select(F.concat(F.col("doc_id").cast("string"), ending).alias("path"), F.transform("l", lambda x: x["text"]).alias("lines"))

    def make(batches):
        for b in batches:
            halves = [[[t[: len(t) // 2], t[len(t) // 2 :]] for t in x] for x in b["lines"]]
            content = [W.docx_bytes(h[:7], h[7:]) for h in halves]
            yield pd.DataFrame({"path": b["path"], "length": [len(c) for c in content], "content": content})

    files = named.mapInPandas(make, "path string, length long, content binary")
    return W.units_of_docx(files).select(*UNIT, "text", F.size("runs").alias("n_runs"))


DOCX_PARTS = [*(f"body-para-{k}" for k in range(3)), "table-0-r0-c0-para-0", *(f"table-0-nested-0-r0-c{k}-para-0" for k in range(2)),
              "section-0-header-para-0", "section-0-header-table-0-r0-c0-para-0", *(f"section-0-footer-para-{k}" for k in range(2))]


@query("s2_docx_source", f"""WITH {Q.TEMPLATE_UNITS}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit_ord) AS i FROM units)
SELECT doc_id || CASE WHEN doc_id % 3 = 0 THEN '.DOCX' ELSE '.docx' END AS doc_id, CAST(i - 1 AS INT) AS unit_ord, [{", ".join(map(Q.q, DOCX_PARTS))}][i] AS unit_id, text,
  concat('0:', length(text) // 2, ',', length(text) // 2, ':', length(text)) AS runs FROM o WHERE doc_id % 3 < 2""")
def s2_source(spark, sf_dir):
    """.docx files made of the templates' documents (paragraphs, a table with one inside, header with a table, footer), written to the shared folder and read through the data source."""
    import pandas as pd

    from ..sources import docx_source

    lines = templates(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("unit_ord", "text"))).alias("l"))  # ten lines a document
    ending = F.element_at(F.array(F.lit(".DOCX"), F.lit(".docx"), F.lit(".txt")), (F.col("doc_id") % 3 + 1).cast("int"))
    named = lines.select(F.concat(F.col("doc_id").cast("string"), ending).alias("name"), F.transform("l", lambda x: x["text"]).alias("lines"))
    path = new_path(spark, "docx")

    def write(batches):
        store, root = docx_source.file_system(path)
        store.create_dir(root, recursive=True)
        for b in batches:
            for name, said in zip(b["name"], b["lines"]):
                h = [[t[: len(t) // 2], t[len(t) // 2 :]] for t in said]
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(W.docx_bytes(h[:3], h[3:4], h[4:6], W.docx_part(h[6:7], h[7:8]), W.docx_part(h[8:])))
            yield pd.DataFrame({"name": b["name"]})

    named.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()
    docx_source.register(spark)
    units = spark.read.format("docx_units").option("partitionBytes", 1 << 20).load(path)
    places = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["run_start"], r["run_end"])), ",")
    return units.select(F.element_at(F.split("doc_id", "/"), -1).alias("doc_id"), "unit_ord", "unit_id", "text", places.alias("runs"))


@query("s3_gate", "SELECT doc_id, octet_length(encode(text)) AS length FROM documents WHERE doc_id % 3 < 2 AND octet_length(encode(text)) <= 2000")
def s3(spark, sf_dir):
    ending = F.element_at(F.array(F.lit(".DOCX"), F.lit(".docx"), F.lit(".doc")), (F.col("doc_id") % 3 + 1).cast("int"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), ending).alias("path"), F.octet_length("text").cast("bigint").alias("length"))
    return W.docx_gate(files, 2000).select("doc_id", "length")


@query("s5_report", _tpl(f"{COVERED}, c AS (SELECT doc_id, entity_type, count(*) AS n FROM kept GROUP BY ALL), j AS (SELECT doc_id, string_agg(entity_type || '=' || n, ',' ORDER BY entity_type) AS counts FROM c GROUP BY ALL) "
                         f"SELECT doc_id, {COVER}, coalesce(any_value(counts), '') AS counts FROM per LEFT JOIN j USING (doc_id) GROUP BY doc_id"))
def s5(spark, sf_dir):
    units, path = template_analysis(spark, sf_dir), new_path(spark, "report")
    W.write_report(A.document_report(units, X.explode_detections(units)), path)
    back = spark.read.schema("doc_id bigint, total_units bigint, units_with_pii bigint, total_pii_count bigint, counts_by_type map<string,bigint>").json(path)
    told = F.array_join(F.array_sort(F.transform(F.map_entries("counts_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ",")
    return back.withColumn("counts", told).drop("counts_by_type")


@query("s5_detections", _tpl(DETECTION))
def s5_detections(spark, sf_dir):
    path = new_path(spark, "detections")
    W.write_detections(template_detections(spark, sf_dir), path)
    return spark.read.parquet(path).select(*UNIT, "entity_type", "start", "end", "score", "text", "replacement")


@query("s6_redacted", _tpl(f", {Q.redacted(Q.LABEL)} SELECT doc_id, unit_ord, unit_id, redacted FROM red"))
def s6(spark, sf_dir):
    path = new_path(spark, "redacted")
    W.write_redacted(X.redact_labels(template_analysis(spark, sf_dir)).select(*UNIT, "redacted"), f"{sf_dir}/customer.parquet", path)
    return spark.read.parquet(path)


@query("t1_stream_redaction", _tpl(f", {Q.redacted(Q.LABEL)} SELECT doc_id, unit_ord, unit_id, redacted FROM red"))
def t1(spark, sf_dir):
    """The templates' units written as arriving files, redacted by the stream, and what it wrote."""
    from ..streaming.redact import redact_stream

    base = new_path(spark, "stream")
    templates(spark, sf_dir).select(*UNIT, "text").write.parquet(f"{base}/in")
    redact_stream(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("t1_stream_fakes", SQL["x2_redact_fakes"])
def t1_fakes(spark, sf_dir):
    """Documents of the templates arrive in three parts, two files a micro-batch; the last part comes after a restart from the checkpoint."""
    from ..streaming.fakes import redact_stream_fakes, redacted_so_far

    base, units = new_path(spark, "stream"), templates(spark, sf_dir).select(*UNIT, "text")
    run = lambda: redact_stream_fakes(spark, f"{base}/in", f"{base}/out", f"{base}/known", f"{base}/state", files=2, compact=2).awaitTermination()
    for low, high in ((0, 2), (3, 6), (7, 9)):
        units.where(F.col("unit_ord").between(low, high)).repartition(2, "doc_id").write.mode("append").parquet(f"{base}/in")
        if low:
            run()
    return redacted_so_far(spark, f"{base}/out")


def counted_output(spark, sf_dir) -> tuple[str, dict[str, int]]:
    """Redacted units of the documents, written and counted in one pass."""
    path = new_path(spark, "counted")
    return path, W.write_counted(X.redact_labels(doc_analysis(spark, sf_dir)), f"{sf_dir}/documents.parquet", path)


COUNTED = "SELECT unnest(['total_units', 'units_with_pii', 'total_pii_count']) AS name, unnest([count(*), count(*) FILTER (n > 0), CAST(coalesce(sum(n), 0) AS BIGINT)]) AS n FROM per UNION ALL SELECT entity_type, count(*) FROM kept GROUP BY ALL"


@query("a1_a3_counts_while_writing", _doc(f"{COVERED} {COUNTED}"))
def a1_observed(spark, sf_dir):
    counts = counted_output(spark, sf_dir)[1]
    return spark.createDataFrame([(name, n) for name, n in counts.items() if n or name not in S.TYPES], "name string, n bigint")  # a row a type


@query("s6_redacted_while_counting", SQL["x1_redact_labels"])
def s6_counted(spark, sf_dir):
    return spark.read.parquet(counted_output(spark, sf_dir)[0]).select(*UNIT, "redacted")


@query("a4_report_from_output", SQL["a4_document_report"])
def a4_output(spark, sf_dir):
    report = A.counts_of(spark.read.parquet(counted_output(spark, sf_dir)[0]))
    told = F.array_join(F.transform(F.map_entries("counts_by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return report.withColumn("counts", told).drop("counts_by_type")


# F1 as a switch: every unit comes back, those without a cue with no spans.
SWITCHED = f"WITH {Q.TEMPLATE_UNITS.replace('units AS', 'every AS', 1)}, units AS (SELECT * FROM every WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 3 AND ({CUE})), {Q.found('z AS (SELECT 1)')}, n AS (SELECT doc_id, unit_ord, count(*) AS n FROM found GROUP BY ALL) SELECT e.doc_id, e.unit_ord, CAST(coalesce(n, 0) AS INT) AS n FROM every e LEFT JOIN n USING (doc_id, unit_ord)"


@query("f1_switch_on", SWITCHED)
def f1_on(spark, sf_dir):
    return D.detect(templates(spark, sf_dir), prefilter=True).select("doc_id", "unit_ord", F.size("spans").alias("n"))


@query("f1_switch_off", SWITCHED.replace(f"({CUE})", "true").replace(">= 3", ">= 0"))
def f1_off(spark, sf_dir):
    return D.detect(templates(spark, sf_dir)).select("doc_id", "unit_ord", F.size("spans").alias("n"))


@query("f1_switch_on_documents", SWITCHED.replace(Q.TEMPLATE_UNITS.replace('units AS', 'every AS', 1), Q.DOC_UNITS.replace('units AS', 'every AS', 1)))
def f1_on_documents(spark, sf_dir):
    return D.detect(doc_units(spark, sf_dir), prefilter=True).select("doc_id", "unit_ord", F.size("spans").alias("n"))


@query("d13_boost_in_analysis", rf"""WITH {Q.found(Q.TEMPLATE_UNITS).replace('found AS (', 'plain AS (')}, w AS (SELECT *, string_split_regex(regexp_replace(lower(substring(text, 1, st)), '^\s+|\s+$', '', 'g'), '\s+') AS w FROM plain),
k AS (SELECT * EXCLUDE (w), array_to_string(w[greatest(len(w) - 4, 1):], ' ') AS near FROM w),
found AS (SELECT * EXCLUDE (near) REPLACE (CASE WHEN {_terms} THEN least(score + 0.35::DOUBLE, 1.0::DOUBLE) ELSE score END AS score) FROM k), {Q.FILTERED}, {Q.resolved('filtered')} {SPANS} kept""")
def d13_analysis(spark, sf_dir):
    """All recognizers with scores raised before the thresholds; differs from r2_filter_first where a phone stands behind its word."""
    return spans(X.analyze_units(D.detect(templates(spark, sf_dir), boost=True)))


@query("d14_distinct_texts", SQL["d14_detect_documents"])
def d14_distinct(spark, sf_dir):
    return spans(D.detect_distinct(doc_units(spark, sf_dir)))


# Planted competitors: up to three detections and two true spans on one place, decided by their order.
RIVALS = """dets AS (SELECT doc_id, unit_id, entity_type, det_id * 4 + i AS det_id, CASE i WHEN 2 THEN st + 1 ELSE st END AS st, CASE i WHEN 0 THEN st + (en - st) // 2 + 1 ELSE en END AS en FROM
    (SELECT *, (doc_id * 10 + CAST(substr(unit_id, 11) AS BIGINT)) * 100000 + st AS det_id, unnest(range(3)) AS i FROM truth)),
  trues AS (SELECT doc_id, unit_id, entity_type, gt_id * 4 + i AS gt_id, st, en FROM (SELECT *, (doc_id * 10 + CAST(substr(unit_id, 11) AS BIGINT)) * 100000 + st AS gt_id, unnest(range(1 + st % 2)) AS i FROM truth)),
  dl AS (SELECT doc_id, unit_id, entity_type, list({'i': det_id, 'a': st, 'e': en, 'g': CAST(NULL AS BIGINT)} ORDER BY det_id) AS d FROM dets GROUP BY ALL),
  gl AS (SELECT doc_id, unit_id, entity_type, list({'i': gt_id, 'a': st, 'e': en} ORDER BY gt_id) AS g FROM trues GROUP BY ALL),
  free AS (SELECT *, list_reduce(d, lambda acc, x: CASE WHEN len(list_filter(g, lambda y: least(y.e, x.e) - greatest(y.a, x.a) > 0 AND (least(y.e, x.e) - greatest(y.a, x.a)) / (y.e - y.a) >= 0.5 AND NOT list_contains(list_transform(acc, lambda m: m.g), y.i))) = 0 THEN acc
    ELSE list_append(acc, {'i': x.i, 'a': x.a, 'e': x.e, 'g': list_filter(g, lambda y: least(y.e, x.e) - greatest(y.a, x.a) > 0 AND (least(y.e, x.e) - greatest(y.a, x.a)) / (y.e - y.a) >= 0.5 AND NOT list_contains(list_transform(acc, lambda m: m.g), y.i))[1].i}) END, d[1:0]) AS m FROM dl JOIN gl USING (doc_id, unit_id, entity_type))"""


@query("e2_match_rivals", f"WITH {Q.TEMPLATE_UNITS}, {RIVALS} SELECT doc_id, unit_id, entity_type, x.i AS det_id, x.g AS gt_id FROM (SELECT *, unnest(m) AS x FROM free)")
def e2_rivals(spark, sf_dir):
    """Greedy matching where several detections and true spans want one another."""
    truth = sides(spark, sf_dir)[1]
    n = F.col("i")
    det = truth.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(3)]))).select(
        "doc_id", "unit_id", "entity_type", (F.col("gt_id") * 4 + n).alias("det_id"), F.when(n == 2, F.col("start") + 1).otherwise(F.col("start")).alias("start"),
        F.when(n == 0, F.col("start") + F.floor((F.col("end") - F.col("start")) / 2).cast("int") + 1).otherwise(F.col("end")).alias("end"))
    twice = truth.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("start") % 2))).withColumn("gt_id", F.col("gt_id") * 4 + F.col("i")).drop("i")
    return E.match_spans(det, twice)


# A weak span of high priority over every email and phone: resolved first it hides them and then falls to its threshold, filtered first it goes and they stay.
WEAK = " UNION ALL SELECT t.doc_id, t.unit_ord, t.unit_id, text, 'ADDRESS', t.st, t.en, 0.5::DOUBLE, 'model' FROM truth t JOIN units u USING (doc_id, unit_ord) WHERE entity_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER')"
_told = f"entity_type IN {Q.one_of(S.TYPES)} AND score >= {Q.by_type('entity_type', 1, S.DEFAULT_THRESHOLD)}"


def weakened(spark, sf_dir) -> DataFrame:
    units = templates(spark, sf_dir)
    weak = units.select("doc_id", "unit_ord", F.explode("gt").alias("g")).where("g.entity_type IN ('EMAIL_ADDRESS', 'PHONE_NUMBER')").select(
        "doc_id", "unit_ord", F.lit("ADDRESS").alias("entity_type"), "g.start", "g.end", F.lit(0.5).alias("score"), F.lit("model").alias("recognizer"))
    return D.detect(D.add_external_spans(units, weak))


@query("r2_weak_resolve_first", f"WITH {Q.found(Q.TEMPLATE_UNITS, extra=WEAK)}, {Q.resolved('found')} {SPANS} kept WHERE {_told}")
def r2_weak(spark, sf_dir):
    return spans(X.analyze_units(weakened(spark, sf_dir), "resolve_first"))


@query("r2_weak_filter_first", f"WITH {Q.found(Q.TEMPLATE_UNITS, extra=WEAK)}, {Q.FILTERED}, {Q.resolved('filtered')} {SPANS} kept")
def r2_weak_filter(spark, sf_dir):
    return spans(X.analyze_units(weakened(spark, sf_dir)))


# Spans that no recognizer finds: the first seven characters of units without any true span.
UNSEEN = " UNION ALL SELECT u.doc_id, u.unit_ord, u.unit_id, text, 'PERSON', CAST(0 AS INT), CAST(7 AS INT), 0.85::DOUBLE, 'model' FROM units u WHERE (doc_id, unit_ord) NOT IN (SELECT (doc_id, unit_ord) FROM truth)"


@query("d15_unseen_spans", f"WITH {Q.found(Q.TEMPLATE_UNITS, extra=UNSEEN)}, {Q.FILTERED}, {Q.resolved('filtered')} {SPANS} kept")
def d15_unseen(spark, sf_dir):
    units = templates(spark, sf_dir)
    model = units.where(F.size("gt") == 0).select("doc_id", "unit_ord", F.lit("PERSON").alias("entity_type"), F.lit(0).alias("start"), F.lit(7).alias("end"), F.lit(0.85).alias("score"), F.lit("model").alias("recognizer"))
    return spans(X.analyze_units(D.detect(D.add_external_spans(units, model))))
