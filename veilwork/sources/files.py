"""Files in and out: .docx corpora, ground truth, reports and redacted units."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import BinaryIO
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
UNITS = "doc_id string, unit_ord int, unit_id string, text string, runs array<struct<run_index:int,run_start:int,run_end:int,text:string>>"
ERRORS = "doc_id string, error string"
MOST_BYTES = 50 * 1024 * 1024


def docx_gate(files: DataFrame, max_bytes: int = MOST_BYTES) -> DataFrame:
    """S3: files named .docx, in any case, of at most max_bytes."""
    return files.where(F.lower("path").endswith(".docx") & (F.col("length") <= max_bytes))


def _run_text(run) -> str:
    """Text, tabs, line breaks and no-break hyphens of a run; breaks of a page or column are no text."""
    said = {f"{W}tab": "\t", f"{W}ptab": "\t", f"{W}cr": "\n", f"{W}noBreakHyphen": "-"}

    def one(x) -> str:
        if x.tag == f"{W}br":
            return "\n" if x.get(f"{W}type", "textWrapping") == "textWrapping" else ""
        return x.text or "" if x.tag == f"{W}t" else said.get(x.tag, "")

    return "".join(map(one, run))


def _paragraph(p) -> list[str]:
    """Texts of the paragraph's own runs; those inside hyperlinks and tracked insertions are not among them."""
    return [_run_text(x) for x in p.findall(f"{W}r")]


def _table(table, prefix: str, nested: str | None = None) -> Iterator[tuple[str, list[str]]]:
    for r, row in enumerate(table.findall(f"{W}tr")):
        for c, cell in enumerate(row.findall(f"{W}tc")):
            for p, para in enumerate(cell.findall(f"{W}p")):
                yield f"{prefix}-r{r}-c{c}-para-{p}", _paragraph(para)
            for n, inner in enumerate(cell.findall(f"{W}tbl")):
                yield from _table(inner, f"{prefix}-nested-{n}")


def _part(root, prefix: str) -> Iterator[tuple[str, list[str]]]:
    for p, para in enumerate(root.findall(f"{W}p")):
        yield f"{prefix}-para-{p}", _paragraph(para)
    for t, table in enumerate(root.findall(f"{W}tbl")):
        yield from _table(table, f"{prefix}-table-{t}")


def _xml(z: zipfile.ZipFile, name: str):
    with z.open(name) as part:
        return ElementTree.parse(part).getroot()


def walk_docx(file: BinaryIO) -> Iterator[tuple[str, list[str]]]:
    """(unit id, texts of the runs): body paragraphs, tables, then each section's default header and footer. A section without its own takes the one before."""
    with zipfile.ZipFile(file) as z:
        body = _xml(z, "word/document.xml").find(f"{W}body")
        for p, para in enumerate(body.findall(f"{W}p")):
            yield f"body-para-{p}", _paragraph(para)
        for t, table in enumerate(body.findall(f"{W}tbl")):
            yield from _table(table, f"table-{t}")
        names = z.namelist()
        rels = {}
        if "word/_rels/document.xml.rels" in names:
            rels = {x.get("Id"): x.get("Target") for x in _xml(z, "word/_rels/document.xml.rels")}
        last: dict[str, str | None] = {"header": None, "footer": None}
        sections = [x for p in body for x in (p.findall(f"{W}pPr/{W}sectPr") if p.tag == f"{W}p" else [p] if p.tag == f"{W}sectPr" else [])]
        for s, section in enumerate(sections):
            for kind in ("header", "footer"):
                for ref in section.findall(f"{W}{kind}Reference"):
                    if ref.get(f"{W}type", "default") == "default":
                        last[kind] = rels.get(ref.get(f"{R}id"))
                path = last[kind] and (last[kind].lstrip("/") if last[kind].startswith("/") else f"word/{last[kind]}")
                if path in names:
                    yield from _part(_xml(z, path), f"section-{s}-{kind}")


def units_of_file(file: BinaryIO) -> tuple[list[tuple[int, str, str, list[dict]]], str | None]:
    """(unit_ord, unit_id, text, runs) of the units that are not blank, and the name of the error of a file that is no readable .docx."""
    try:
        units = list(walk_docx(file))
    except Exception as e:  # damaged, encrypted or foreign archives fail in many ways; one file must not end the job
        return [], type(e).__name__
    out = []
    for i, (unit_id, texts) in enumerate(units):
        at, runs = 0, []
        for k, text in enumerate(texts):
            runs.append({"run_index": k, "run_start": at, "run_end": at + len(text), "text": text})
            at += len(text)
        if "".join(texts).strip():
            out.append((i, unit_id, "".join(texts), runs))
    return out, None


def units_of_docx(files: DataFrame, max_bytes: int = MOST_BYTES, errors: bool = False) -> DataFrame:
    """S2 for a table of files (path, length, content): units with their runs; blank units are left out. A file that is no readable .docx, for whatever reason, gives none;
    with `errors` the result is those files instead: doc_id, error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                units, error = units_of_file(io.BytesIO(content))
                if errors:
                    yield pd.DataFrame([(name, error)] if error else [], columns=["doc_id", "error"])
                else:
                    yield pd.DataFrame([(name, *u) for u in units], columns=["doc_id", "unit_ord", "unit_id", "text", "runs"])

    return docx_gate(files, max_bytes).select("path", "content").mapInPandas(run, ERRORS if errors else UNITS)


def units_from_docx(spark: SparkSession, path: str, max_bytes: int = MOST_BYTES) -> DataFrame:
    """Units of the .docx files under a path."""
    return units_of_docx(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), max_bytes)


def docx_bytes(paragraphs: list[list[str]], cells: list[list[str]] = (), nested: list[list[str]] = (), header: str = "", footer: str = "") -> bytes:
    """A .docx of paragraphs (texts of their runs), and a table of one row if there are cells; nested: cells of a table of one row inside the last cell.
    header, footer: content of these parts, as docx_part() gives it."""
    inner = docx_part([], nested) if len(nested) else ""
    body = docx_part(paragraphs, cells, inner)
    parts = {kind: content for kind, content in (("header", header), ("footer", footer)) if content}
    space = f'xmlns:w="{W[1:-1]}" xmlns:r="{R[1:-1]}"'
    refs = "".join(f'<w:{kind}Reference w:type="default" r:id="{kind}"/>' for kind in parts)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}{f'<w:sectPr>{refs}</w:sectPr>' if refs else ''}</w:body></w:document>")
        for kind, content in parts.items():
            z.writestr(f"word/{kind}1.xml", f"<w:hdr {space}>{content}</w:hdr>")
        if parts:
            z.writestr("word/_rels/document.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="{kind}" Target="{kind}1.xml"/>' for kind in parts) + "</Relationships>")
    return out.getvalue()


def docx_part(paragraphs: list[list[str]], cells: list[list[str]] = (), inner: str = "") -> str:
    """Paragraphs and a table of one row if there are cells; inner goes into its last cell."""
    text = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    para = lambda runs: "<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{text(t)}</w:t></w:r>' for t in runs) + "</w:p>"
    row = [para(c) + (inner if k == len(cells) - 1 else "") for k, c in enumerate(cells)]
    return "".join(map(para, paragraphs)) + ("<w:tbl><w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in row) + "</w:tr></w:tbl>" if row else "")


ENTRY = "struct<unit_id:string,entity_type:string,start:int,end:int,text:string>"


def read_ground_truth(spark: SparkSession, path: str, document: str = r"([^/]+?)(?:\.[A-Za-z]+)?$") -> tuple[DataFrame, DataFrame]:
    """(entries with doc_id and gt_id in file order, a row with doc_id and the map absent_types a file). A file holds an object with entries, or a bare list.

    doc_id is what group 1 of the pattern `document` finds in the file's path (its name without the ending); gt_id starts from 0 in every file."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), document, 1).alias("doc_id"), "value")
    both = raw.select("doc_id", F.from_json("value", f"struct<entries:array<{ENTRY}>,absent_types:map<string,string>>").alias("o"),
                      F.from_json("value", f"array<{ENTRY}>").alias("l"), F.trim("value").startswith("[").alias("bare"))
    chosen = both.select("doc_id", F.when(F.col("bare"), F.col("l")).otherwise(F.col("o.entries")).alias("e"), F.coalesce("o.absent_types", F.create_map().cast("map<string,string>")).alias("absent_types"))
    entries = chosen.select("doc_id", F.posexplode("e").alias("gt_id", "x")).select("doc_id", "gt_id", "x.*")
    return entries, chosen.select("doc_id", "absent_types")


def write_ground_truth(rows: DataFrame, path: str, folders: int = 256) -> None:
    """A file {name}.json with the content value for each row (name, value), in any of `folders` folders under path, for read_ground_truth().

    The tasks write the files. Spark's writer with a folder a document would have the driver move every file at the end, and list as many folders as there are documents
    when they are read. path must be on a file system that pyarrow opens; a task that runs again writes the same files again."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from .docx_source import file_system

        store, root = file_system(path)
        for b in batches:
            for folder in b["folder"].unique():
                store.create_dir(f"{root}/{folder}", recursive=True)
            for folder, name, value in zip(b["folder"], b["name"], b["value"]):
                with store.open_output_stream(f"{root}/{folder}/{name}.json") as out:
                    out.write(value.encode())
            yield b[["name"]]

    dealt = rows.select("name", "value", F.pmod(F.hash("name"), F.lit(folders)).alias("folder"))
    dealt.mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


def write_report(report: DataFrame, path: str) -> None:
    """Reports as JSON lines, one per document."""
    report.write.mode("overwrite").json(path)


def write_detections(detections: DataFrame, path: str) -> None:
    detections.write.mode("overwrite").partitionBy("entity_type").parquet(path)


def write_redacted(units: DataFrame, in_path: str, out_path: str) -> None:
    """Redacted units as Parquet, never over or inside the input."""
    spark = units.sparkSession

    def full(p: str) -> str:
        q = spark._jvm.org.apache.hadoop.fs.Path(p)
        return str(q.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(q)).rstrip("/")

    a, b = full(in_path), full(out_path)
    if a == b or b.startswith(a + "/") or a.startswith(b + "/"):
        raise ValueError("the output would be written over the input")
    units.write.mode("overwrite").parquet(out_path)


def write_counted(units: DataFrame, in_path: str, out_path: str, columns=("doc_id", "unit_ord", "unit_id", "redacted"), types: dict | None = None) -> dict[str, int]:
    """S6 with A1 to A3 in the same pass: writes the columns and kinds (the types of the spans) of units that have spans, and returns total_units, units_with_pii, total_pii_count
    and the number of spans of each entity type. A report by document comes from the output (reports.counts_of), so nothing is detected twice."""
    from ..operators.reports import observed

    counted, seen = observed(units, types)
    write_redacted(counted.select(*columns, F.transform("spans", lambda s: s["entity_type"]).alias("kinds")), in_path, out_path)
    return {name: n or 0 for name, n in seen.get.items()}
