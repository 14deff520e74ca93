"""Long units, counts while writing, the cue switch, fakes in one shuffle and in a stream, and matching of very many spans."""

import os
import random
import re
import time

from pyspark.sql import functions as F

from veilwork.functions.matching import chunks, greedily, matches, piece_in
from veilwork.operators import detect as D
from veilwork.operators import evaluate as E
from veilwork.operators import fakes as K
from veilwork.operators import redact as X
from veilwork.operators import reports as A
from veilwork.schema import SPANS
from veilwork.sources import files as W
from veilwork.sources.units import units_from_table
from veilwork.streaming.fakes import redact_batch, redact_stream_fakes, redacted_so_far

UNITS = "doc_id long, unit_ord int, unit_id string, text string"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_matches_and_pieces(spark):
    random.seed(1)
    texts = ["", "b", "é😀" * 700 + "b1", "x" * 1024 + "b12", " ".join(random.choice(["a", "b1", "é", "😀b22"]) for _ in range(5_000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "i int, text string")
    got = {r.i: r for r in df.select("i", matches(F.col("text"), "b[0-9]+").alias("m"), F.transform(matches(F.col("text"), "b[0-9]+"), lambda p: piece_in(chunks(F.col("text")), p["start"], p["end"])).alias("said")).collect()}
    for i, t in enumerate(texts):
        want = [m.span() for m in re.finditer("b[0-9]+", t)]
        assert [tuple(x) for x in got[i].m] == want and got[i].said == [t[a:b] for a, b in want]
    assert got[9].m == []
    cut = df.where("i = 2").select(*[piece_in(chunks(F.col("text")), F.lit(a), F.lit(b)) for a, b in ((0, 5), (1020, 1030), (0, 1402), (1400, 1402), (7, 7))]).first()
    assert list(cut) == [texts[2][:5], texts[2][1020:1030], texts[2], "b1", ""]


def test_greedy_by_blocks(spark):
    """The same spans as by comparing each with all kept before it, whatever their lengths, ties and nesting."""
    random.seed(2)
    for n, reach, most in ((2, 5, 3), (60, 40, 10), (400, 300, 60), (900, 20_000, 40), (300, 50, 50)):
        spans = []
        for _ in range(n):
            a = random.randrange(reach)
            spans.append(("T", a, a + random.randint(1, most), 0.5, "r"))
        df = spark.createDataFrame([(spans,)], f"s {SPANS}")
        for clash, sql in ((lambda k, x: k[1] < x[2] and x[1] < k[2], "k.s.start < x.s.end AND x.s.start < k.s.end"), (lambda k, x: k[1] <= x[1] and k[2] >= x[2], "k.s.start <= x.s.start AND k.s.end >= x.s.end")):
            kept = []
            for x in spans:
                if not any(clash(k, x) for k in kept):
                    kept.append(x)
            assert sorted(tuple(x) for x in df.select(greedily(F.col("s"), sql)).first()[0]) == sorted(kept)


PART = ("Mr. Rajesh Kumar, email rajesh.kumar@example.com or ", "tel +91 20 4509 4400, SSN 123-45-6789 then ", "server 192.168.1.7 é😀 and ", "card 4111 1111 1111 1111. ")


def test_long_unit(spark):
    """20,000 spans in one unit: each step once, and what it gives is the short unit's result repeated."""
    short, n = "".join(PART), 3_400
    df = spark.createDataFrame([(1, 0, "u", short), (2, 0, "u", short * n)], UNITS)
    X.redact_labels(X.analyze_units(D.detect(df.where("doc_id = 1")))).collect()  # compiled
    start = time.time()
    got = {r.doc_id: r for r in X.redact_labels(X.analyze_units(D.detect(df))).select("doc_id", F.size("spans").alias("n"), "redacted").collect()}
    assert got[1].n == 6 and got[2].n == 6 * n and got[2].redacted == got[1].redacted * n
    assert time.time() - start < 180


def test_fakes_in_one_shuffle(spark):
    rows = [(1, 0, "a", "Mr. Rajesh Kumar and Ms. Priya Singh"), (1, 1, "b", "nothing here"), (1, 2, "c", "Mr. Rajesh Kumar wrote to a@b.com"), (1, 2, "c", "Mr. Rajesh Kumar wrote to a@b.com"),
            (2, 0, "a", None), (2, 1, "b", ""), (None, 0, "a", "Shri Amit Rao wrote"), (3, 0, "a", "Ms. Priya Singh")]
    units = X.analyze_units(D.detect(spark.createDataFrame(rows, UNITS)))
    done = X.redact_with(X.with_fakes(units))
    assert exchanges(done) == 1
    got = sorted(((r.doc_id or 0, r.unit_ord, r.redacted) for r in done.collect()), key=str)
    assert [x for x in got if x[0] == 1] == [(1, 0, "Mr. Ananya Sharma and Ms. Vikram Mehta"), (1, 1, "nothing here"), *[(1, 2, "Mr. Ananya Sharma wrote to ananya.sharma@example.com")] * 2]
    assert [x for x in got if x[0] != 1] == [(0, 0, "Shri Ananya Sharma wrote"), (2, 0, None), (2, 1, ""), (3, 0, "Ms. Ananya Sharma")]
    told = X.explode_detections(X.with_fakes(units), values_col="fakes").where("doc_id = 1 AND unit_ord = 0").orderBy("start").collect()
    assert [(r.text, r.replacement) for r in told] == [("Rajesh Kumar", "Ananya Sharma"), ("Priya Singh", "Vikram Mehta")]
    assert X.with_fakes(units.limit(0)).count() == 0


def test_cue_switch_and_boost(spark):
    rows = [(1, 0, "a", "Mr. Rajesh Kumar"), (1, 1, "b", "Mr. Rajesh Kumar, Director"), (1, 2, "c", None), (1, 3, "d", " a "), (1, 4, "e", "call 020 4509 4400")]
    units = spark.createDataFrame(rows, UNITS)
    size = lambda df: [r[0] for r in df.orderBy("unit_ord").select(F.size("spans")).collect()]
    assert size(D.detect(units)) == [1, 1, 0, 0, 1] and size(D.detect(units, prefilter=True)) == [0, 1, 0, 0, 1]
    model = D.add_external_spans(units, spark.createDataFrame([(1, 0, "PERSON", 4, 16, 0.85, "model")], "doc_id long, unit_ord int, entity_type string, start int, end int, score double, recognizer string"))
    assert size(D.detect(model, prefilter=True)) == [2, 1, 0, 0, 1]
    scores = lambda **o: D.detect(units, **o).where("unit_ord = 4").first().spans[0].score
    assert scores() == 0.75 and scores(boost=True) == 1.0


def test_each_text_once(spark):
    rows = [(i, 0, "a", "write to a@b.com") for i in range(50)] + [(60, 0, "a", "none"), (61, 0, "a", None), (62, 0, "a", "tel +91 20 4509 4400")]
    units = spark.createDataFrame(rows, UNITS)
    plain = {(r.doc_id, str(r.spans)) for r in D.detect(units).collect()}
    assert {(r.doc_id, str(r.spans)) for r in D.detect_distinct(units).collect()} == plain


def test_separator_as_it_stands(spark):
    df = spark.createDataFrame([(1, "a|b.c"), (2, r"a\Eb.c")], "doc_id long, text string")
    parts = lambda sep, i: [r.text for r in units_from_table(df.where(f"doc_id = {i}"), sep=sep).orderBy("unit_ord").collect()]
    assert parts("|", 1) == ["a", "b.c"] and parts(".", 1) == ["a|b", "c"] and parts("\\E", 2) == ["a", "b.c"]


def test_counts_while_writing(spark, tmp_path):
    rows = [(1, 0, "a", "Mr. Rajesh Kumar and a@b.com"), (1, 1, "b", "nothing"), (2, 0, "a", "c@d.org"), (3, 0, "a", None)]
    units = X.redact_labels(X.analyze_units(D.detect(spark.createDataFrame(rows, UNITS))))
    counts = W.write_counted(units, str(tmp_path / "in"), str(tmp_path / "out"))
    assert {k: n for k, n in counts.items() if n} == {"total_units": 4, "units_with_pii": 2, "total_pii_count": 3, "PERSON": 1, "EMAIL_ADDRESS": 2}
    report = {r.doc_id: r for r in A.counts_of(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert report[1].counts_by_type == {"PERSON": 1, "EMAIL_ADDRESS": 1} and (report[3].total_units, report[3].total_pii_count, report[3].counts_by_type) == (1, 0, {})
    assert set(W.write_counted(units.limit(0), str(tmp_path / "in"), str(tmp_path / "none")).values()) == {0}


def test_stream_of_fakes(spark, tmp_path):
    """A document over several micro-batches and a restart; a batch that runs again doubles nothing."""
    base = str(tmp_path)
    text = lambda d, u: f"Mr. {('Rajesh', 'Priya', 'Arjun')[(d + u) % 3]} Kumar to u{u % 4}@b.com"
    every = [(d, u, f"p{u}", text(d, u)) for d in range(5) for u in range(12)]
    run = lambda: redact_stream_fakes(spark, f"{base}/in", f"{base}/out", f"{base}/known", f"{base}/state", files=1, compact=2).awaitTermination()
    for low in (0, 3, 6, 9):
        spark.createDataFrame([r for r in every if low <= r[1] < low + 3], UNITS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        if low in (3, 9):
            run()
    batch = X.redact_with(X.with_fakes(X.analyze_units(D.detect(spark.createDataFrame(every, UNITS)))))
    want = sorted((r.doc_id, r.unit_ord, r.redacted) for r in batch.collect())
    so_far = lambda: sorted((r.doc_id, r.unit_ord, r.redacted) for r in redacted_so_far(spark, f"{base}/out").collect())
    assert so_far() == want and len({r[2] for r in want}) < len(want)
    again = spark.createDataFrame([r for r in every if 6 <= r[1] < 9], UNITS)
    redact_batch(again, 2, f"{base}/out", f"{base}/known", compact=2)
    assert so_far() == want
    for f in [f"{base}/state/commits/3", f"{base}/state/commits/.3.crc"]:  # the last batch ended, but its end was not noted
        os.remove(f)
    run()
    assert so_far() == want


def test_corpus_index_is_dealt_evenly(spark):
    rows = [(1, i, "PERSON", 0, f"v{i}") for i in range(3_000)] + [(d, 0, "PERSON", 0, f"w{d}") for d in range(2, 200)] + [(2, 1, "EMAIL_ADDRESS", 0, "x"), (None, 5, "PERSON", 0, "first")]
    det = spark.createDataFrame(rows, "doc_id long, unit_ord int, entity_type string, start int, text string")
    got = {(r.entity_type, r.original): r.idx for r in K.assign_fake_ids_corpus(det, chunks=8).collect()}
    order = sorted((r for r in rows if r[2] == "PERSON"), key=lambda r: (r[0] or 0, r[1]))
    assert [got["PERSON", r[4]] for r in order] == list(range(len(order))) and got["EMAIL_ADDRESS", "x"] == 0


def test_matching_of_very_many_spans(spark):
    """100,000 spans a side in one unit and type, with rivals: two detections on every tenth true span."""
    n = 100_000
    truth = spark.range(n).select(F.lit(1).alias("doc_id"), F.lit("u").alias("unit_id"), F.lit("PERSON").alias("entity_type"), F.col("id").alias("gt_id"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 8).cast("int").alias("end"))
    det = truth.withColumnRenamed("gt_id", "det_id").unionByName(truth.where("gt_id % 10 = 0").select("doc_id", "unit_id", "entity_type", (F.col("gt_id") + n).alias("det_id"), (F.col("start") + 1).alias("start"), "end"))
    start = time.time()
    pairs = E.match_candidates(det, truth)
    assert pairs.count() == n + n // 10 and E.match_spans(det, truth).where("det_id = gt_id").count() == n
    assert {r.outcome: r.n for r in E.outcomes(det, truth).collect()} == {"tp": n, "fp": n // 10}
    assert time.time() - start < 150
