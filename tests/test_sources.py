import zipfile

import pytest
from pyspark.sql import functions as F

from veinstone.config import EngineConfig
from veinstone.functions.cutting import parts, token_estimate
from veinstone.operators import chunking, embedding
from veinstone.plans import ingest
from veinstone.sources import files, office


def docx(path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    para = '<w:p><w:pPr><w:pStyle w:val="{}"/></w:pPr><w:r><w:t>{}</w:t></w:r></w:p>'
    body = (para.format("H1", "Top") + "<w:p><w:r><w:t>Body</w:t></w:r></w:p>"
            "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc>"
            "<w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>")
    with zipfile.ZipFile(path, "w") as box:
        box.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        box.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')


def xlsx(path):
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    rows = ('<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Total</t></is></c></row>'
            '<row r="2"><c r="A2"><v>5</v></c><c r="C2"><f>A2*2</f></c></row>')
    with zipfile.ZipFile(path, "w") as box:
        box.writestr("xl/workbook.xml", f'<workbook {s} {r}><sheets><sheet name="Rules" r:id="r1"/>'
                     '<sheet name="Gone" state="hidden" r:id="r1"/></sheets></workbook>')
        box.writestr("xl/_rels/workbook.xml.rels", '<x><Relationship Id="r1" Target="worksheets/sheet1.xml"/></x>')
        box.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>Limit</t></si></sst>")
        box.writestr("xl/worksheets/sheet1.xml", f"<worksheet {s}><sheetData>{rows}</sheetData></worksheet>")


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("inbox")
    docx(root / "a.docx")
    xlsx(root / "b.xlsx")
    (root / "c.md").write_text("intro\n# One\n#no heading\n### Deep\ntext\n")
    (root / "d.csv").write_bytes(b"\xef\xbb\xbfh1,h2\n" + b"".join(b"%d,x\n" % i for i in range(30)))
    (root / "e.txt").write_bytes("plain \xff text".encode("latin-1"))
    (root / "f.one").write_bytes(b"x")
    (root / "g.txt").write_text("  \n ")
    (root / "h.pdf").write_bytes(b"%PDF")
    (root / "i.docx").write_bytes(b"no zip")
    (root / "j.html").write_text("<h2>Head</h2><p>x &amp;amp; y</p><script>no</script>"
                                 "<table><tr><th>a</th><td>b c</td></tr></table><dl><dt>t</dt><dd>d</dd></dl>"
                                 "<aside>note</aside>")
    rows = files.parse_files(files.read_files(spark, str(root))).collect()
    return {r.path.rsplit("/", 1)[1]: r for r in rows}


def shape(row):
    return [(u.text, u.heading_path, u.sheet_name, u.cell_range, u.is_table) for u in row.units]


def test_formats(parsed):
    assert shape(parsed["a.docx"]) == [("Body", "Top", None, None, False), ("a | b", "Top > Table 1", None, None, True)]
    assert shape(parsed["b.xlsx"]) == [("Limit |  | Total\n5 |  | [no cached value] (=A2*2)",
                                       "Worksheet: Rules", "Rules", "A1:C2", True)]
    assert parsed["b.xlsx"].warnings == ["Rules!C2 has no cached formula value"]
    assert shape(parsed["c.md"]) == [("intro", "", None, None, False), ("#no heading", "One", None, None, False),
                                     ("text", "One > Deep", None, None, False)]
    csv = shape(parsed["d.csv"])
    assert [c[3] for c in csv] == ["row 1-25", "row 26-31"] and csv[1][0].startswith("h1 | h2\n24 | x")
    assert parsed["e.txt"].units[0].text == "plain � text"
    assert shape(parsed["j.html"]) == [("x & y", "Head", None, None, False), ("a | b c", "Head", None, None, True),
                                       ("t\nd\nnote", "Head", None, None, False)]


def test_errors(parsed):
    assert "notebooks" in parsed["f.one"].error and "PDF" in parsed["h.pdf"].error
    assert parsed["g.txt"].error == files.EMPTY and "BadZipFile" in parsed["i.docx"].error


def test_each_text_of_a_page_is_read_once():
    units, _ = office.read_html("<ul><li>a<p>x</p></li><li>b<li>c</ul><p>one<p>two<div>no block</div>")
    assert [u[0] for u in units] == ["a\nx\nb\nc\none\ntwo"]
    units, _ = office.read_html("<h1>T</h1><table><tr><th>k<td><p>v</p><p>w</p><tr><td><table><tr><td>in</table></td><td>z</table><p>end")
    assert [(u[0], u[1], u[5]) for u in units] == [("k | v w\n | z", "T", True), ("in", "T", True), ("end", "T", False)]


def test_a_page_of_unclosed_elements_is_linear():
    import time

    for page in ("<p>x" * 250_000, "<li>x" * 200_000, "<table><tr><td>" + "<td>x" * 200_000, "<div><p>x" * 100_000, "</b>" * 250_000):
        start = time.process_time()
        office.read_html(page)
        assert time.process_time() - start < 30


def test_chunks_respect_the_limit_and_link(spark):
    config = EngineConfig(chunk_target_tokens=80, chunk_max_tokens=100, chunk_overlap_tokens=10)
    text = "订单取消必须由主管审批并且记录在案。" * 120
    frame = spark.createDataFrame([("v", text)], "version_id string, t string").select(
        "version_id", F.array(chunking.unit(F.col("t"))).alias("units"))
    rows = chunking.chunk_documents(frame, config).orderBy("ordinal").collect()
    assert len(rows) > 20 and max(r.token_count for r in rows) <= 100
    assert [r.ordinal for r in rows] == list(range(len(rows)))
    assert [r.next_chunk_id for r in rows[:-1]] == [r.chunk_id for r in rows[1:]]
    assert rows[0].previous_chunk_id is None and rows[-1].next_chunk_id is None
    body = "".join(parts(text, 100)).replace("\n", "").replace(" ", "")
    assert body == text.replace("\n", "").replace(" ", "")


def test_overlap_fits_or_is_dropped(spark):
    config = EngineConfig(chunk_target_tokens=20, chunk_max_tokens=50, chunk_overlap_tokens=3)
    text = ("word " * 17 + "four five six. ") * 12
    frame = spark.createDataFrame([("v", text)], "version_id string, t string").select(
        "version_id", F.array(chunking.unit(F.col("t"))).alias("units"))
    rows = chunking.chunk_documents(frame, config).orderBy("ordinal").collect()
    assert all(token_estimate(r.content) <= 50 for r in rows)
    assert any(r.content.startswith("four five six.\n\n") for r in rows[1:])


def test_ingest_embeds_each_content_once(spark, tmp_path):
    (tmp_path / "a.txt").write_text("same text")
    (tmp_path / "b.txt").write_text("same text")
    (tmp_path / "c.one").write_text("x")
    config = EngineConfig(embedding_dimensions=16)
    read = files.read_files(spark, str(tmp_path))
    name = F.regexp_extract("path", "[^/]*$", 0)
    catalog = read.select("path", name.alias("filename"), name.alias("version_id"))
    cache = embedding.embed_missing(
        spark.createDataFrame([], "content_hash string, content string"),
        spark.createDataFrame([], "content_hash string, embedding_fingerprint string"), config)
    chunks, fresh, failed = ingest.ingest(read, catalog, cache, config)
    assert chunks.count() == 2 and fresh.count() == 1 and failed.count() == 1
    assert {r.technical_status for r in chunks.collect()} == {"embedded"}


def test_objects_are_immutable(spark):
    old = spark.createDataFrame([("k", "0" * 64)], "object_key string, sha256 string")
    new = spark.createDataFrame([("k", bytearray(b"1")), ("n", bytearray(b"2"))], "object_key string, data binary")
    with pytest.raises(Exception, match="collision"):
        files.store_objects(old, new).collect()
    same = spark.createDataFrame([("n", bytearray(b"2")), ("n", bytearray(b"2"))], "object_key string, data binary")
    assert files.store_objects(old, same).count() == 1
    assert files.resolve_path("/data", "a/../b") == "/data/b"
    with pytest.raises(ValueError):
        files.resolve_path("/data", "../etc")
