"""What keeps jobs in proportion on large tables: tasks of bounded rows, expressions computed once."""

from pathlib import Path

from veilwork.functions.stored import new_path
from veilwork.jobs import registry
from veilwork.operators import detect as D
from veilwork.operators import redact as X
from veilwork.sources import files


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_take_spans_once(spark):
    """The spans of a unit stand before the fold over its runs, so recognizers do not run again for each run."""
    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    text = "write to a.b@c.example now"
    runs = [{"run_index": i, "run_start": a, "run_end": b, "text": text[a:b]} for i, (a, b) in enumerate(((0, 11), (11, 18), (18, 26)))]
    units = spark.createDataFrame(spark.sparkContext.parallelize([(1, text, runs)]), "doc_id long, text string, runs array<struct<run_index:int,run_start:int,run_end:int,text:string>>")
    out = X.redact_runs(D.detect(units, ["email"]))
    told = plan(out.select("runs"))
    assert told.index("@[A-Za-z0-9-]+") < told.index("transform(runs#")
    assert [r["text"] for r in out.first()["runs"]] == ["write to [REDACTED: EMAIL]", "", " now"]


def test_keys_of_one_file_are_many_tasks(spark):
    """A table of keys in one row group is one task to Spark; its units are dealt, all of them, to partitions of bounded rows, and a document's stay together."""
    path = new_path(spark, "keys")
    spark.range(1, 20_001).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{path}/customer.parquet")
    per = registry.templates(spark, path).rdd.mapPartitions(lambda rows: [[r.doc_id for r in rows]]).collect()
    assert sum(map(len, per)) == 20_000 and len(per) >= 3 and max(map(len, per)) < 10_000
    assert sum(len(set(p)) for p in per) == len({d for p in per for d in p})


def test_truth_files_written_by_tasks(spark, tmp_path):
    """A file a document in a bounded number of folders, all of them, read back under their names."""
    rows = spark.range(3000).selectExpr("cast(id AS string) AS name", """concat('{"entries": [], "absent_types": {"US_SSN": "', id, ' ä"}}') AS value""").repartition(3)
    for _ in range(2):  # a second run of the tasks writes the same files
        files.write_ground_truth(rows, str(tmp_path / "t"), folders=16)
    assert len(list((tmp_path / "t").iterdir())) == 16
    got = files.read_ground_truth(spark, str(tmp_path / "t"))[1].collect()
    assert sorted((int(r.doc_id), r.absent_types["US_SSN"]) for r in got) == [(i, f"{i} ä") for i in range(3000)]


def test_truth_of_templates_is_a_file_a_document(spark):
    """No folder a document, which the driver would have to move and to list."""
    path = new_path(spark, "keys")
    spark.range(1, 3_001).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{path}/customer.parquet")
    folder = Path(registry.truth_files(spark, path).removeprefix("file:").replace("//", "/"))
    assert sum(1 for _ in folder.glob("*/*.json")) == 301 and len([p for p in folder.iterdir() if p.is_dir()]) <= 256


def test_distinct_texts_without_triggers_are_not_shuffled(spark, monkeypatch):
    """Only texts that a recognizer may hit enter the dictionary; the spans are those of detect() for every unit, repeated, blank and null ones too."""
    texts = [f"plain words {chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["to a.b@c.example", "to a.b@c.example", "call 5", " ", None, "Mr. Rajesh Kumar", "QQQQ!!"]
    units = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    asked, plainly = [], D.detect
    monkeypatch.setattr(D, "detect", lambda u, *a, **k: asked.append(u.count()) or plainly(u, *a, **k))
    told = lambda df: sorted((r.doc_id, r.text, tuple(r.spans)) for r in df.collect() if r.text) + [len([0 for r in df.collect() if r.text is None and r.spans == []])]
    assert told(D.detect_distinct(units)) == told(plainly(units)) and asked == [3]
    extra = {"shout": D.regex_recognizer("SHOUT", "[A-Z]{4,}!!", 0.8)}
    assert told(D.detect_distinct(units, extra=extra)) == told(plainly(units, extra=extra)) and asked[1] == 304
