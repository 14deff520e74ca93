"""The .docx data source: the same units as the walker over binary files, packing, gate, errors and memory."""

import os
import tracemalloc
import zipfile

import pytest

from veilwork.sources import docx_source, files

SPACE = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


@pytest.fixture()
def corpus(tmp_path):
    (tmp_path / "sub").mkdir()
    for k in range(20):
        whole = files.docx_bytes([["Name: ", f"J{k}"], [" "]], [["a"], ["b"]], [["n0"], ["n1"]], files.docx_part([["head"]], [["cell"]]), files.docx_part([["foot"]]))
        (tmp_path / ("sub" if k % 2 else ".") / f"{k}.{'docx' if k % 3 else 'DOCX'}").write_bytes(whole)
    (tmp_path / "broken.docx").write_bytes(b"not a zip")
    (tmp_path / "other.txt").write_bytes(b"no")
    with zipfile.ZipFile(tmp_path / "large.docx", "w") as z:  # one large picture beside a little text
        z.writestr("word/media/image1.png", os.urandom(30 << 20))
        z.writestr("word/document.xml", f"<w:document {SPACE}><w:body><w:p><w:r><w:t>small</w:t></w:r></w:p></w:body></w:document>")
    return tmp_path


def test_source(spark, corpus):
    docx_source.register(spark)
    read = spark.read.format("docx_units")
    got = read.load(str(corpus))
    want = files.units_from_docx(spark, str(corpus))
    key = lambda r: (r.doc_id.removeprefix("file:"), r.unit_ord, r.unit_id, r.text, r.runs)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert {r.unit_id for r in got.where("doc_id LIKE '%/7.docx'").collect()} == {
        "body-para-0", "table-0-r0-c0-para-0", "table-0-r0-c1-para-0", "table-0-nested-0-r0-c0-para-0", "table-0-nested-0-r0-c1-para-0",
        "section-0-header-para-0", "section-0-header-table-0-r0-c0-para-0", "section-0-footer-para-0"}
    assert [(r.doc_id.split("/")[-1], r.error) for r in read.option("errors", "true").load(str(corpus)).collect()] == [("broken.docx", "BadZipFile")]
    assert spark.read.format("docx_units").option("maxBytes", 1 << 20).load(str(corpus)).where("text = 'small'").count() == 0


def test_packing(corpus, tmp_path_factory):
    reader = docx_source.DocxReader(f"file:{corpus}", files.MOST_BYTES, 4096, False)
    parts = reader.partitions()
    paths = [p for part in parts for p in part.paths]
    assert len(parts) > 3 and len(paths) == len(set(paths)) == 22
    assert all(sum(os.path.getsize(p) for p in part.paths) <= 4096 or len(part.paths) == 1 for part in parts)
    empty = docx_source.DocxReader(str(tmp_path_factory.mktemp("none")), files.MOST_BYTES, 4096, False)
    assert [r for p in empty.partitions() for r in empty.read(p)] == []
    with pytest.raises(FileNotFoundError):
        docx_source.DocxReader(str(corpus / "missing"), files.MOST_BYTES, 4096, False).partitions()
    tracemalloc.start()
    rows = list(reader.read(docx_source.Files([str(corpus / "large.docx")])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r[3] for r in rows] == ["small"] and most < 4 << 20  # pictures are never read


def test_runs_and_sections(tmp_path):
    """Runs of hyperlinks are not the paragraph's own; page breaks are no text; former sections of tracked changes do not count."""
    body = ('<w:p><w:r><w:t>a</w:t><w:noBreakHyphen/><w:t>b</w:t><w:br/><w:br w:type="page"/><w:tab/></w:r><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink><w:r><w:t>c</w:t></w:r></w:p>'
            '<w:p><w:pPr><w:sectPr><w:sectPrChange><w:sectPr/></w:sectPrChange></w:sectPr></w:pPr></w:p><w:sectPr><w:headerReference w:type="default" r:id="h"/></w:sectPr>')
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {SPACE}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<R><Relationship Id="h" Target="h.xml"/></R>')
        z.writestr("word/h.xml", f"<w:hdr {SPACE}><w:p><w:r><w:t>top</w:t></w:r></w:p></w:hdr>")
    with open(tmp_path / "a.docx", "rb") as f:
        assert list(files.walk_docx(f)) == [("body-para-0", ["a-b\n\t", "c"]), ("body-para-1", []), ("section-1-header-para-0", ["top"])]
