"""Readers, writers and the streaming forms."""

import csv as stdlib_csv
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.plans.file_queries import workbook
from lexweave.sources import office, readers, writers
from lexweave.streaming import status


def test_json(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"doc_id": "a", "text": "x"}, {"doc_id": "b", "text": "y"}]))
    assert readers.json_array(spark, str(tmp_path / "a.json"), "doc_id string, text string").count() == 2
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "b.jsonl").write_text('{"instruction": "i", "output": "o"}\n\nnot json\n{"instruction": "j"}\n')
    good, bad = readers.json_lines(spark, str(tmp_path / "l"), "instruction string, output string")
    assert sorted(r["instruction"] for r in good.collect()) == ["i", "j"]
    assert [r["value"] for r in bad.collect()] == ["not json"]


def test_titles(spark, tmp_path):
    (tmp_path / "map.yaml").write_text("domain:\n  - AB-1  # First title\n  - AB-2\n")
    assert [tuple(r) for r in readers.comment_titles(spark, str(tmp_path / "map.yaml")).collect()] == [("AB-1", "First title")]


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "c.up").write_bytes(b"abc")
    (tmp_path / "d.up").write_bytes(b"\xff")
    rows = {r["name"]: r for r in readers.documents(spark, str(tmp_path), {"up": lambda b: b.decode().upper()}).collect()}
    assert rows["a.txt"]["text"] == "é" and rows["a.txt"]["error"] is None
    assert "unsupported" in rows["b.bin"]["error"]
    assert rows["c.up"]["text"] == "ABC" and rows["d.up"]["text"] == "" and rows["d.up"]["error"]
    assert (rows["a.txt"]["size"], rows["a.txt"]["sha256"]) == (2, hashlib.sha256("é".encode()).hexdigest())
    (tmp_path / "e.txt").write_bytes(b"a\xffb")
    bad = readers.documents(spark, str(tmp_path)).filter("name = 'e.txt'").first()
    assert bad["text"] == "a\ufffdb" and bad["error"] is None


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({
    "word/document.xml": f"<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val='h1'/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t> a</w:t><w:tab/><w:t>b </w:t></w:r></w:p><w:p/>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>",
    "word/styles.xml": f"<w:styles {W}><w:style w:styleId='h1'><w:name w:val='heading 1'/></w:style></w:styles>",
    "docProps/core.xml": "<c xmlns:dc='d'><dc:title>T</dc:title><dc:creator>A</dc:creator></c>",
})
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def slide(inner):
    return f"<p:sld {P}><p:cSld><p:spTree>{inner}</p:spTree></p:cSld></p:sld>"


PPTX = zipped({
    "ppt/presentation.xml": f"<p:presentation {P}><p:sldIdLst><p:sldId r:id='b'/><p:sldId r:id='a'/></p:sldIdLst></p:presentation>",
    "ppt/_rels/presentation.xml.rels": "<R><r Id='a' Target='slides/slide1.xml'/><r Id='b' Target='/ppt/slides/slide2.xml'/></R>",
    "ppt/slides/slide1.xml": slide("<p:sp><p:txBody><a:p><a:r><a:t>one </a:t></a:r><a:r><a:t>two</a:t></a:r></a:p><a:p/></p:txBody></p:sp>"),
    "ppt/slides/slide2.xml": slide("<p:graphicFrame><a:graphic><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t> v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphic></p:graphicFrame>"),
})
S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
XLSX = zipped({
    "xl/workbook.xml": f"<workbook xmlns='{S}' xmlns:r='http://schemas.openxmlformats.org/officeDocument/2006/relationships'><sheets><sheet name='One' r:id='x'/></sheets></workbook>",
    "xl/_rels/workbook.xml.rels": "<R><r Id='x' Target='worksheets/sheet1.xml'/></R>",
    "xl/sharedStrings.xml": f"<sst xmlns='{S}'><si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r></si></sst>",
    "xl/worksheets/sheet1.xml": f"<worksheet xmlns='{S}'><dimension ref='A1:C4'/><sheetData><row><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>1</v></c></row><row/><row><c r='B3'><v>1.50</v></c><c r='C3' t='b'><v>1</v></c></row><row><c r='A4'><v>7</v></c></row></sheetData></worksheet>",
})


def test_office_files():
    d = office.docx(DOCX)
    assert d.text == "\n## Title\na\tb" and d.tables == [[["x\ny", ""]]] and d.metadata == {"title": "T", "author": "A", "subject": "", "modified": ""}
    p = office.pptx(PPTX)
    assert p.pages == ["=== スライド 1 ===\n[表]\nk | v", "=== スライド 2 ===\none two"] and p.tables == [[["k", "v"]]] and p.metadata == {"slide_count": "2"}
    x = office.xlsx(XLSX)
    assert x.pages == ["=== シート: One ===\na |  | bc\n | 1.5 | True\n7 |  | "] and x.tables == [[["a", "", "bc"], ["", "1.5", "True"], ["7", "", ""]]]
    cut = office.xlsx(XLSX, most_rows=2)
    assert cut.pages[0].endswith("\n... (最大 2 行で打ち切り)") and len(cut.tables[0]) == 2
    many = office.xlsx(workbook({"S": [[str(k)] for k in range(1200)]}))
    assert len(many.tables[0]) == 1000 and many.pages[0].endswith("(最大 1000 行で打ち切り)")


def test_parsed_files(spark):
    """Pages, tables, errors and fallbacks of files of every kind."""
    files = [("f/a.docx", DOCX), ("f/b.XLSX", XLSX), ("f/c.pptx", b"no archive"), ("f/d.scan", b"short"), ("f/e.scan", b"l" * 100), ("f/g.md", b"x"), ("f/h", b"x"), ("f/i.docx", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    parsers = {"scan": lambda c: office.Parsed([c.decode(), "", " "], separator="")}
    out = {r["path"]: r for r in readers.parse_files(df, parsers, {"scan": lambda c: "read as an image"}).collect()}
    assert out["f/a.docx"]["text"] == "\n## Title\na\tb" and out["f/b.XLSX"]["tables"][0][0] == ["a", "", "bc"] and out["f/a.docx"]["metadata"]["title"] == "T"
    assert out["f/c.pptx"]["text"] == "" and out["f/c.pptx"]["error"] and out["f/d.scan"]["text"] == "read as an image" and out["f/e.scan"]["text"] == "l" * 100 + " "
    assert out["f/g.md"]["text"] == "x" and "unsupported" in out["f/h"]["error"] and out["f/i.docx"]["text"] is None
    forced = readers.parse_files(df.filter("path = 'f/e.scan'"), parsers, {"scan": lambda c: "image"}, force=("scan",)).first()
    assert forced["text"] == "image"
    parsed = readers.parse_files(df, parsers)
    assert [tuple(r) for r in readers.pages(parsed).filter("path like '%.scan'").orderBy("path").collect()] == [("f/d.scan", 1, "short"), ("f/e.scan", 1, "l" * 100)]
    assert {r["path"]: r["text"] for r in readers.whole_texts(parsed).collect()}["f/c.pptx"] == ""
    assert [tuple(r) for r in readers.tables(parsed).filter("path = 'f/a.docx'").collect()] == [("f/a.docx", 1, 1, ["x\ny", ""])]


def test_pdf_needs_its_module():
    try:
        import pypdf  # noqa: F401
    except ImportError:
        assert "pypdf" in readers.parse_one("pdf", b"%PDF", office.PARSERS)["error"]


def test_missing_lines_are_empty(spark, tmp_path):
    good, bad = readers.json_lines(spark, str(tmp_path / "nothing.jsonl"), "a string")
    assert good.count() == bad.count() == 0 and good.columns == ["a", "file"]


def test_mail_charsets(spark):
    head = b"Message-ID: <1@x>\r\nFrom: a@x.org\r\nSubject: =?iso-2022-jp?b?GyRCRnxLXBsoQg==?=\r\nContent-Type: text/plain; charset="
    assert readers.parse_mail(head + b"iso-8859-1\r\n\r\ncaf\xe9")["body_text"] == "café"
    assert readers.parse_mail(head + b"iso-2022-jp\r\n\r\n\x1b$BF|K\\\x1b(B")["body_text"] == "日本"
    assert readers.parse_mail(head + b"no-such-set\r\n\r\ncaf\xc3\xa9 \xff")["body_text"].startswith("café")
    assert readers.parse_mail(head + b"utf-8\r\n\r\nx")["subject"] == "日本"


def test_views(spark, data):
    readers.register_views(spark, data, ["nation", "region"])
    assert spark.sql("select count(*) from nation join region on n_regionkey = r_regionkey").first()[0] == 25


def test_mail(spark, tmp_path):
    (tmp_path / "a.eml").write_bytes(b"Message-ID: <1@x>\r\nFrom: A <A@x.org>\r\nTo: b@x.org\r\nSubject: =?utf-8?b?5Lya6K2w?=\r\nIn-Reply-To: <0@x>\r\n\r\nHello\r\n")
    (tmp_path / "b.eml").write_bytes(b"")
    out = readers.mail(spark, str(tmp_path)).collect()
    assert [(m["message_id"], m["sender"], m["subject"], m["in_reply_to"], m["body_text"].strip()) for m in out] == [("<1@x>", "a@x.org", "会議", "<0@x>", "Hello")]


def test_atom_and_unknown(spark):
    feed = spark.createDataFrame([("<feed><entry><title>A\n b</title><id>1</id><summary>s</summary><published>p</published></entry></feed>",)], "xml string")
    assert tuple(readers.atom_entries(feed).first()) == ("A b", "s", "1", "p")
    with pytest.raises(ValueError):
        readers.reader("nothing")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, ["x", "y"], "l")], "id int, tags array<string>, line string")
    writers.csv(df.coalesce(1), str(tmp_path / "c"), {"tags": ", "}, ("番号", "タグ", "行"))
    (part,) = (tmp_path / "c").glob("*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    assert list(stdlib_csv.reader(part.read_text(encoding="utf-8-sig").splitlines())) == [["番号", "タグ", "行"], ["1", "x, y", "l"]]
    quoted = spark.createDataFrame([('a "b"', "")], "x string, y string")
    writers.csv(quoted.coalesce(1), str(tmp_path / "q"))
    (part,) = (tmp_path / "q").glob("*.csv")
    assert list(stdlib_csv.reader(part.read_text(encoding="utf-8-sig").splitlines()))[1] == ['a "b"', ""]
    rows = spark.createDataFrame([(i, f'k"{i}') for i in range(3)], "n int, k string").coalesce(1)
    for name, write, want in (("ja", lambda p: writers.json_array(rows, p), [{"n": i, "k": f'k"{i}'} for i in range(3)]), ("jd", lambda p: writers.json_dictionary(rows, "k", p), {f'k"{i}': {"n": i} for i in range(3)}), ("je", lambda p: writers.json_array(rows.limit(0).coalesce(1), p), [])):
        write(str(tmp_path / name))
        found = [json.loads(f.read_text()) for f in (tmp_path / name).glob("*.txt") if f.read_text()]
        assert found == [want] or (want == [] and found in ([], [[]]))
    writers.json_lines(df, str(tmp_path / "j"))
    writers.lines(df, "line", str(tmp_path / "t"))
    writers.lines(df, "line", str(tmp_path / "t"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1 and spark.read.text(str(tmp_path / "t")).count() == 2
    writers.parquet(df, str(tmp_path / "p"), by=["line"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1


def test_stream(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/events.parquet").schema
    source = tmp_path / "in"
    spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(source))
    stream = spark.readStream.schema(spark.read.parquet(str(source)).schema).parquet(str(source))
    assert schema.names == stream.columns
    q = status.counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("counts").collect()}
    finally:
        q.stop()
    assert status.once(stream).isStreaming
    assert status.once(spark.read.parquet(str(source))).count() == spark.read.parquet(str(source)).count()
    want = {(r["start"], r["event_type"]): r["n"] for r in status.counts(spark.read.parquet(str(source))).collect()}
    assert got and all(want[k] == n for k, n in got.items())
