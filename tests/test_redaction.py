"""Goldens with offsets, invariants of redaction, fakes, evaluation, files and the stream."""

import io
import json
import re
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilwork import schema as S
from veilwork.functions.matching import matches
from veilwork.operators import detect as D
from veilwork.operators import evaluate as E
from veilwork.operators import fakes as K
from veilwork.operators import filters as FI
from veilwork.operators import redact as X
from veilwork.operators import reports as A
from veilwork.sources import files
from veilwork.sources.units import units_from_table

HITS = [
    ("EMAIL_ADDRESS", "Contact us at support@example.com for help.", "support@example.com"),
    ("EMAIL_ADDRESS", "Registered email:admin@prospectus.org", "admin@prospectus.org"),
    ("PHONE_NUMBER", "Tel: +91 20 4509 4400", "+91 20 4509 4400"),
    ("PHONE_NUMBER", "Mobile: +91 81081 14949", "+91 81081 14949"),
    ("PHONE_NUMBER", "Call us on 020 4509 4400", "020 4509 4400"),
    ("PERSON", "Contact Person: Mr. Rajesh Kumar", "Rajesh Kumar"),
    ("PERSON", "Director: Ms. Priya Singh", "Priya Singh"),
    ("US_SSN", "SSN: 123-45-6789", "123-45-6789"),
    ("CREDIT_CARD", "Payment: 5500 0000 0000 0004", "5500 0000 0000 0004"),
    ("DATE_OF_BIRTH", "Date of Birth: 15/08/1985", "15/08/1985"),
    ("DATE_OF_BIRTH", "Born on 22 March 1978", "22 March 1978"),
    ("IP_ADDRESS", "Remote host: 10.0.0.1", "10.0.0.1"),
    ("ADDRESS", "Registered Office: Plot No. 123, MG Road, Pune 411001", "Registered Office: Plot No. 123, MG Road, Pune 411001"),
    ("ORGANIZATION", "Audited by XYZ & Associates LLP.", "Audited by XYZ & Associates LLP"),
]
MISSES = [
    ("DATE_OF_BIRTH", "The fiscal year ending March 2025."), ("DATE_OF_BIRTH", "The IPO opens on March 15, 2025."), ("CREDIT_CARD", "Number: 4111 1111 1111 1112"),
    ("CREDIT_CARD", "Total shares: 1,23,45,678 equity shares of ₹10 each."), ("PHONE_NUMBER", "See Page 250 for details."), ("US_SSN", "Reference number: 123456789"),
    ("ORGANIZATION", "the Company has filed the prospectus."), ("ORGANIZATION", "our Bank reserves the right to withdraw."), ("ADDRESS", "The Company is headquartered in Mumbai."),
    ("PERSON", "As per SCRR regulations, the issuer must comply."),
]


def units(spark, texts):
    return spark.createDataFrame([(1, i, f"body-para-{i}", t) for i, t in enumerate(texts)], "doc_id long, unit_ord int, unit_id string, text string")


@pytest.fixture(scope="module")
def analysed(spark):
    texts = [h[1] for h in HITS] + [m[1] for m in MISSES] + [None, "", "  ", "😀 é a@x.com"]
    return [r.spans for r in X.analyze_units(D.detect(units(spark, texts))).orderBy("unit_ord").collect()], texts


def test_hits_with_offsets(analysed):
    found, texts = analysed
    for (kind, text, said), spans in zip(HITS, found):
        assert (kind, text.index(said), text.index(said) + len(said)) in [(s.entity_type, s.start, s.end) for s in spans], text


def test_misses_blanks_and_wide_characters(analysed):
    found, texts = analysed
    for (kind, text), spans in zip(MISSES, found[len(HITS):]):
        assert kind not in [s.entity_type for s in spans], text
    assert not any(found[-4:-1])
    assert [(s.start, s.end) for s in found[-1]] == [(4, 11)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1 .@😀é-+90", max_size=60), min_size=1, max_size=20))
def test_offsets_equal_python(spark, texts):
    pattern = r"[a9]+@|0\d|\+1"
    got = [[(m.start, m.end) for m in r[0]] for r in units(spark, texts).select(matches(F.col("text"), pattern), "unit_ord").orderBy("unit_ord").collect()]
    assert got == [[m.span() for m in re.finditer(pattern, t, re.A)] for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 10), st.sampled_from(["PERSON", "ADDRESS", "EMAIL_ADDRESS"]), st.sampled_from([0.7, 0.9])), max_size=12), st.lists(st.integers(0, 40), max_size=3))
def test_resolved_spans_and_runs(spark, raw, cuts):
    text = "abcdefghij" * 4
    cuts = sorted({0, *cuts, 40})
    rows = [(1, 0, text, [(k, a, min(40, a + n), s, "t") for a, n, k, s in raw], [(i, a, b, text[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])]
    df = spark.createDataFrame(rows, f"doc_id long, unit_ord int, text string, spans {S.SPANS}, runs array<struct<run_index:int,run_start:int,run_end:int,text:string>>")
    df = X.redact_labels(df.withColumn("spans", X.resolve_overlaps(F.col("spans"))))
    row = X.redact_runs(df).collect()[0]
    spans = [(s.start, s.end) for s in row.spans]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert "".join(r.text for r in row.runs) == row.redacted
    for a, n, _, _ in raw:  # every dropped span overlaps a kept one
        assert any(s < min(40, a + n) and a < e for s, e in spans)
    assert not A.changed_outside(df).collect()


def test_false_positive_rules(spark):
    org = {"the Company": True, "SEBI": True, "Our Company ABC Limited": False, "prepared by Care Private Limited": True, "Alpha Technologies": False, "we require funds": True}
    got = dict(spark.createDataFrame([(t,) for t in org], "t string").select("t", FI.is_org_fp(F.col("t"))).collect())
    assert got == org
    person = {"Mumbai": True, "Taluka Khed": True, "Rajesh Kumar": False, "FEMA": True, "ABCDE FGHIJ": False, "email": True}
    assert dict(spark.createDataFrame([(t,) for t in person], "t string").select("t", FI.is_person_fp(F.col("t"))).collect()) == person


def test_fakes(spark):
    rows = [(1, 0, 0, "PERSON", " Rajesh Kumar "), (1, 1, 5, "PERSON", "Priya Singh"), (1, 2, 0, "PERSON", "Rajesh Kumar"), (2, 0, 0, "PERSON", "Priya Singh")]
    det = spark.createDataFrame(rows, "doc_id long, unit_ord int, start int, entity_type string, text string")
    got = {(r.doc_id, r.original): r.replacement for r in K.replacement_map(det).collect()}
    assert got == {(1, "Rajesh Kumar"): "Ananya Sharma", (1, "Priya Singh"): "Vikram Mehta", (2, "Priya Singh"): "Ananya Sharma"}
    whole = {r.original: r.idx for r in K.replacement_map(det, ()).collect()}
    assert whole == {"Rajesh Kumar": 0, "Priya Singh": 1}
    card = spark.range(10).select(K.fake_card(F.col("id")).alias("c")).where(F.call_function("luhn_check", F.replace("c", F.lit(" "), F.lit(""))))
    assert card.count() == 10 and card.first()[0] == "4777 7777 7777 7778"


def test_evaluation(spark):
    truth = spark.createDataFrame([(1, "u1", "PERSON", 16, 33, 0), (1, "u1", "PERSON", 40, 50, 1)], "doc_id long, unit_id string, entity_type string, start int, end int, gt_id long")
    det = spark.createDataFrame([(1, "u1", "PERSON", 16, 33, 0), (1, "u1", "PERSON", 40, 44, 1), (1, "u9", "PERSON", 0, 5, 2), (1, "u1", "PERSON", 17, 33, 3)],
                                "doc_id long, unit_id string, entity_type string, start int, end int, det_id long")
    got = {r.entity_type: (r.tp, r.fp, r.fn) for r in E.evaluate(det, truth).collect()}
    assert got == {"PERSON": (1, 2, 1), "OVERALL": (1, 2, 1)}  # the unit without ground truth does not count


def test_evaluation_of_two_files(spark, tmp_path):
    """Entries are numbered from 0 in each file: a match in one must not hide a miss in the other."""
    entry = {"unit_id": "u", "entity_type": "PERSON", "start": 0, "end": 10, "text": "ab"}
    (tmp_path / "t").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"t/{name}.json").write_text(json.dumps({"entries": [entry], "absent_types": {"US_SSN": f"none in {name}"}}))
    det = spark.createDataFrame([("a", "u", "PERSON", 0, 10, 0), ("a", "v", "PERSON", 0, 10, 1)], "doc_id string, unit_id string, entity_type string, start int, end int, det_id long")
    got = {r.entity_type: (r.tp, r.fp, r.fn, r.recall) for r in E.evaluate_file(det, str(tmp_path / "t")).collect()}
    assert got == {"PERSON": (1, 0, 1, 0.5), "OVERALL": (1, 0, 1, 0.5)}
    absent = E.absent_types(files.read_ground_truth(spark, str(tmp_path / "t"))[1]).collect()
    assert sorted(tuple(r) for r in absent) == [("a", "US_SSN", "none in a"), ("b", "US_SSN", "none in b")]
    none = E.evaluate(det.limit(0), det.limit(0).withColumnRenamed("det_id", "gt_id")).collect()
    assert [tuple(r)[:4] for r in none] in ([], [("OVERALL", 0, 0, 0)])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.integers(1, 9), st.booleans()), max_size=14))
def test_greedy_matches_equal_a_plain_loop(spark, raw):
    rows = [(1, f"u{u}", "X", a, a + n, i) for i, (u, a, n, is_det) in enumerate(raw) if is_det]
    true = [(1, f"u{u}", "X", a, a + n, i) for i, (u, a, n, is_det) in enumerate(raw) if not is_det]
    columns = "doc_id long, unit_id string, entity_type string, start int, end int, "
    used, want = set(), []
    for d in rows:
        for g in true:
            over = min(d[4], g[4]) - max(d[3], g[3])
            if g[5] not in used and d[1] == g[1] and over > 0 and over / (g[4] - g[3]) >= 0.5:
                used.add(g[5])
                want.append((d[5], g[5]))
                break
    got = E.match_spans(spark.createDataFrame(rows, columns + "det_id long"), spark.createDataFrame(true, columns + "gt_id long")).collect()
    assert sorted((r.det_id, r.gt_id) for r in got) == sorted(want)


def test_custom_types_and_thresholds(spark):
    own = D.Custom().register("badge", "BADGE", regex=r"B-\d{4}", score=0.6, label="[BADGE]", threshold=0.5, priority=0)
    own.register("caller", "CALLER", fn=lambda t: [("CALLER", 0, 2, 0.9)] if t.startswith("me") else [], threshold=0.8)
    df = D.detect(units(spark, ["see B-1234 or a@x.com", "me B-12"]), extra=own.recognizers)
    out = X.redact_labels(X.analyze_units(df, types=own.types), types=own.types).orderBy("unit_ord").collect()
    assert [r.redacted for r in out] == ["see [BADGE] or [REDACTED: EMAIL]", "[REDACTED: CALLER] B-12"]
    strict = X.analyze_units(df, thresholds={"BADGE": 0.7}, types=own.types).orderBy("unit_ord").first()
    assert [s.entity_type for s in strict.spans] == ["EMAIL_ADDRESS"]
    kept = X.explode_detections(X.analyze_units(df, types=own.types), types=own.types).where("entity_type = 'BADGE'").first()
    assert (kept.text, kept.replacement) == ("B-1234", "[BADGE]")
    with pytest.raises(ValueError):
        own.register("x", "X")


def test_nested_report_and_corpus_ids(spark):
    rows = [("b", 0, "u0", 0, 3, "PERSON", " Al B ", "[P]", 0.9), ("a", 1, "u1", 4, 6, "PERSON", "Cy D", "[P]", 0.9), (None, 0, "u0", 0, 2, "PERSON", "Ed F", "[P]", 0.9), ("b", 0, "u0", 5, 9, "PERSON", "Cy D", "[P]", 0.9)]
    det = spark.createDataFrame(rows, "doc_id string, unit_ord int, unit_id string, start int, end int, entity_type string, text string, replacement string, score double")
    for chunks in (2, 1024):
        assert {r.original: r.idx for r in K.assign_fake_ids_corpus(det, chunks=chunks).collect()} == {"Ed F": 0, "Cy D": 1, "Al B": 2}
    assert K.assign_fake_ids_corpus(det.limit(0)).count() == 0
    analysed = spark.createDataFrame([("a", 1, [1]), ("b", 0, [1, 2]), ("c", 0, [])], "doc_id string, unit_ord int, spans array<int>")
    report = {r.doc_id: r for r in A.document_report(analysed, det, nested=True, mapping=K.replacement_map(det)).collect()}
    assert [(d.start, d.text) for d in report["b"].detections] == [(0, " Al B "), (5, "Cy D")] and [m.original for m in report["b"].replacement_map] == ["Al B", "Cy D"]
    assert report["c"].detections == [] and report["c"].replacement_map == [] and report["c"].total_pii_count == 0


def test_leaks_and_changes_are_found(spark):
    df = X.redact_labels(X.analyze_units(D.detect(units(spark, ["mail a@x.com now", "mail b@x.com now"]))))
    df = df.withColumn("redacted", F.when(F.col("unit_ord") == 0, F.col("text")).otherwise(F.col("redacted")))
    assert [r.text for r in A.leaks(df, X.explode_detections(df)).collect()] == ["a@x.com"]
    assert [r.unit_ord for r in A.changed_outside(df.withColumn("redacted", F.when(F.col("unit_ord") == 1, F.concat("redacted", F.lit("!"))).otherwise(F.col("redacted")))).collect()] == [0, 1]


def docx(paragraphs, footer):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    p = lambda runs: "<w:p>" + "".join(f"<w:r><w:t xml:space='preserve'>{t}</w:t></w:r>" for t in runs) + "</w:p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        table = f"<w:tbl><w:tr><w:tc>{p(['Email'])}</w:tc><w:tc>{p(['admin@prospectus.org'])}</w:tc></w:tr></w:tbl>"
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{''.join(map(p, paragraphs))}{table}<w:sectPr><w:footerReference w:type='default' r:id='r1'/></w:sectPr></w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="footer1.xml"/></Relationships>')
        z.writestr("word/footer1.xml", f"<w:ftr {w}>{p([footer])}</w:ftr>")
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.DOCX").write_bytes(docx([["Contact: ", "John", " Doe", ", email: john.doe@example.com"], [" "]], "Page 1"))
    (tmp_path / "in/b.docx").write_bytes(b"not a zip")
    (tmp_path / "in/c.txt").write_bytes(b"no")
    whole = files.docx_bytes([["a"]])
    (tmp_path / "in/d.docx").write_bytes(whole[:40] + b"\x00" * 30 + whole[70:])  # damaged inside
    with zipfile.ZipFile(tmp_path / "in/e.docx", "w") as z:
        z.writestr("word/document.xml", "<x/>")  # no body
    got = files.units_from_docx(spark, str(tmp_path / "in"))
    rows = {r.unit_id: r for r in got.collect()}
    assert set(rows) == {"body-para-0", "table-0-r0-c0-para-0", "table-0-r0-c1-para-0", "section-0-footer-para-0"}
    raw = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    assert sorted(r.doc_id[-6:] for r in files.units_of_docx(raw, errors=True).collect()) == ["b.docx", "d.docx", "e.docx"]
    assert files.units_of_docx(raw, max_bytes=10).count() == 0
    out = {r.unit_id: r for r in X.redact_runs(X.analyze_units(D.detect(got))).collect()}
    assert [r.text for r in out["body-para-0"].runs] == ["Contact: ", "John", " Doe", ", email: [REDACTED: EMAIL]"]
    with pytest.raises(ValueError):
        files.write_redacted(got, str(tmp_path / "in"), str(tmp_path / "in/sub"))


def test_ground_truth_report_and_stream(spark, tmp_path):
    entry = {"unit_id": "u", "entity_type": "PERSON", "start": 1, "end": 3, "text": "ab"}
    (tmp_path / "a.json").write_text(json.dumps({"entries": [entry, entry], "absent_types": {"US_SSN": "none"}}))
    (tmp_path / "b.json").write_text(json.dumps([entry]))
    entries, absent = files.read_ground_truth(spark, str(tmp_path / "a.json"))
    assert [r.gt_id for r in entries.orderBy("gt_id").collect()] == [0, 1]
    assert [tuple(r) for r in E.absent_types(absent).collect()] == [("a", "US_SSN", "none")]
    assert files.read_ground_truth(spark, str(tmp_path / "b.json"))[0].count() == 1

    det = spark.createDataFrame([("d", "PERSON", 0, "ab"), ("d", "US_SSN", 1, "cd")], "doc_id string, entity_type string, start int, text string")
    files.write_detections(det, str(tmp_path / "det"))
    files.write_report(det.groupBy("doc_id").count(), str(tmp_path / "rep"))
    assert spark.read.parquet(str(tmp_path / "det")).where("entity_type = 'US_SSN'").first().text == "cd"
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "rep")).select("doc_id", "count").collect()] == [("d", 2)]

    from veilwork.streaming.redact import redact_stream, redacted_units

    src = units(spark, [h[1] for h in HITS])
    src.write.parquet(str(tmp_path / "in"))
    redact_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = {r.unit_ord: r.redacted for r in redacted_units(src).collect()}
    assert {r.unit_ord: r.redacted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


def test_units_number_blanks(spark):
    df = spark.createDataFrame([(1, "a\n\n b"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in units_from_table(df).collect()] == [(1, 0, "body-para-0", "a"), (1, 2, "body-para-2", " b")]


def test_function_recognizer_and_empty_tables(spark):
    own = D.function_recognizer(lambda t: [("X", 0, 1, 0.9)] if t.startswith("q") else [])
    got = D.detect(units(spark, ["q1", "z"]), ["own"], extra={"own": own}).orderBy("unit_ord").collect()
    assert [len(r.spans) for r in got] == [1, 0]
    none = X.analyze_units(D.detect(units(spark, ["a"]).limit(0)))
    assert A.coverage(none).collect()[0].asDict() == {"total_units": 0, "units_with_pii": 0, "total_pii_count": 0}
    assert [tuple(r) for r in A.counts_with_total(X.explode_detections(none)).collect()] == [("TOTAL", 0)]


def test_prefilter_keeps_units_with_spans(spark):
    from veilwork.operators.filters import prefilter_units

    rows = [(1, "Rajesh Kumar signed.", [0]), (2, "Nothing was signed.", []), (3, "Nothing was signed.", None), (4, "ab", [0]), (5, "Call 5", None)]
    units = spark.createDataFrame(rows, "doc_id long, text string, spans array<int>")
    assert sorted(r.doc_id for r in prefilter_units(units).collect()) == [1, 5]
    assert [r.doc_id for r in prefilter_units(units.drop("spans")).collect()] == [5]
