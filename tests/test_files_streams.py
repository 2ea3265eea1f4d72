"""Files in and out, streams, feedback."""

import io
import zipfile

from pyspark.sql import functions as F

from lanthorn.operators import feedback, metrics
from lanthorn.plans.scan import scan
from lanthorn.sources import files
from lanthorn.streaming import check

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def docx() -> bytes:
    return archive({"word/document.xml": f'<w:document {W}><w:body><w:p><w:r><w:t>Call Sarah </w:t></w:r><w:r><w:t>Mitchell &amp; co</w:t></w:r></w:p><w:p><w:r><w:t>b</w:t><w:tab/><w:t>c</w:t></w:r></w:p></w:body></w:document>', "word/header1.xml": f"<w:hdr {W}><w:p><w:r><w:t>Head</w:t></w:r></w:p></w:hdr>"})


def xlsx() -> bytes:
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return archive({
        "xl/workbook.xml": f'<workbook {S} {rel}><sheets><sheet name="Plan" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>Owner</t></si><si><t>Sarah Mitchell</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>12</v></c><c r="D1"/></row><row r="2"/><row r="3"><c r="A3" t="s"><v>1</v></c></row></sheetData></worksheet>',
    })


def test_office_round_trip():
    assert files.docx_text(docx())[0] == "Call Sarah Mitchell & co\nb\tc\n\nHead"
    assert files.xlsx_text(xlsx()) == ("--- Plan ---\nOwner |  | 12\nSarah Mitchell", ["Plan"])
    names = {"Sarah Mitchell": "Person_001", "Sarah": "X"}
    assert files.docx_text(files.docx_cleaned(docx(), names))[0].startswith("Call Person_001 & co")
    assert files.xlsx_text(files.xlsx_cleaned(xlsx(), names))[0].endswith("Person_001")


def book(sheet: str, more: str = "", styles: str = "") -> bytes:
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return archive({
        "xl/workbook.xml": f'<workbook {S} {rel}>{more}<sheets><sheet name="Empty" sheetId="1" r:id="rId2"/><sheet name="Plan" sheetId="2" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f"<styleSheet {S}>{styles}</styleSheet>",
        "xl/worksheets/sheet1.xml": f"<worksheet {S}><sheetData>{sheet}</sheetData></worksheet>",
        "xl/worksheets/sheet2.xml": f'<worksheet {S}><sheetData><row r="1"><c r="A1" s="1"/></row></sheetData></worksheet>',
    })


STYLES = '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="&quot;R&quot; #,##0.00;[Red]-&quot;R&quot; #,##0.00"/></numFmts><cellStyleXfs><xf numFmtId="9"/></cellStyleXfs><cellXfs>' + "".join(f'<xf numFmtId="{n}"/>' for n in (0, 164, 165, 10, 22, 3)) + "</cellXfs>"


def test_cells_read_as_shown():
    """A date of 2026-03-31 has the serial number 46112; a quarter of a day is six o'clock."""
    row = '<row r="1"><c r="A1" s="1"><v>46112</v></c><c r="B1" s="2"><v>-1450000.5</v></c><c r="C1" s="3"><v>0.125</v></c><c r="D1" s="4"><v>46112.25</v></c><c r="E1" t="b"><v>1</v></c><c r="F1"><v>4111111111111111</v></c><c r="G1" s="5"><v>1450000</v></c><c r="H1"><v>0.1</v></c></row>'
    shown = "2026-03-31 | -R 1,450,000.50 | 12.50% | 3/31/26 6:00 | TRUE | 4111111111111111 | 1,450,000 | 0.1"
    assert files.xlsx_text(book(row, styles=STYLES)) == (f"--- Plan ---\n{shown}", ["Empty", "Plan"])
    late = book('<row r="1"><c r="A1" s="1"><v>44650</v></c></row>', '<workbookPr date1904="1"/>', STYLES)
    assert files.xlsx_text(late)[0] == "--- Plan ---\n2026-03-31"


def test_changed_cells_are_text_and_others_keep_their_form():
    row = '<row r="1"><c r="A1" s="1"><v>46112</v></c><c r="B1" s="5"><v>1450000</v></c><c r="C1" s="3" t="str"><f>A9</f><v>Sarah Mitchell</v></c><c r="D1"><v>12</v></c></row>'
    out = files.xlsx_cleaned(book(row, styles=STYLES), {"2026-03-31": "[DATE]", "Sarah Mitchell": "[NAME]"})
    assert files.xlsx_text(out)[0] == "--- Plan ---\n[DATE] | 1,450,000 | [NAME] | 12"
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        xml = z.read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="B1" s="5"><v>1450000</v></c>' in xml and "<f>" not in xml
    assert '<c r="C1" s="3" t="inlineStr">' in xml and '<c r="A1" t="inlineStr">' in xml


def test_runs_keep_their_formats_and_prefixes_stay_declared():
    """A value over two bold and plain runs; the tail of the second stays where it was."""
    mc = 'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"'
    body = "<w:r><w:rPr><w:b/></w:rPr><w:t>Call John Sm</w:t></w:r><w:r><w:t>i</w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:t>th or Ann, now</w:t></w:r>"
    source = archive({"word/document.xml": f"<w:document {W} {mc}><w:body><w:p>{body}</w:p><w:p><w:r><w:t>plain</w:t></w:r></w:p></w:body></w:document>"})
    out = files.docx_cleaned(source, {"John Smith": "[NAME]", "Ann": "[N2]", "Smith": "?"})
    assert files.docx_text(out)[0] == "Call [NAME] or [N2], now\nplain"
    with zipfile.ZipFile(io.BytesIO(out)) as z:
        xml = z.read("word/document.xml").decode()
    assert '<w:b /></w:rPr><w:t xml:space="preserve">Call [NAME]</w:t>' in xml and '<w:i /></w:rPr><w:t xml:space="preserve"> or [N2], now</w:t>' in xml
    assert 'xmlns:w14="' in xml and 'mc:Ignorable="w14"' in xml and "<w:t>plain</w:t>" in xml
    files.ElementTree.fromstring(xml.encode())


def test_read_files(spark, tmp_path):
    for name, data in {"a.docx": docx(), "b.xlsx": xlsx(), "c.txt": b"x\ny", "d.pdf": b"%PDF", "e.xlsx": b"junk", "f.exe": b""}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["name"]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.docx", "b.xlsx", "c.txt", "d.pdf", "e.xlsx"}
    assert rows["c.txt"]["text"] == "x\ny" and rows["c.txt"]["detail"] == "2 lines"
    assert rows["b.xlsx"]["delimiter"] == " | " and rows["b.xlsx"]["detail"] == "1 sheet"
    assert rows["d.pdf"]["error"] and rows["e.xlsx"]["error"] and rows["d.pdf"]["text"] is None
    clean = spark.createDataFrame([("a.docx", "docx", bytearray(docx()), "", {"Sarah Mitchell": "P"}), ("x.pdf", "pdf", bytearray(b""), "text", {})], "name string, kind string, content binary, text string, value_map map<string,string>")
    out = {r["name"]: r for r in files.cleaned_files(clean).collect()}
    assert set(out) == {"a — sanitized.docx", "x — sanitized.txt"} and bytes(out["x — sanitized.txt"]["content"]) == b"text"


def test_names_and_sizes(spark):
    df = spark.createDataFrame([("A.TSV", 10), ("b.xlsm", 2048), ("c", 3 << 20)], "name string, n long")
    rows = df.select(files.kind(F.col("name")).alias("k"), files.size_label(F.col("n")).alias("s")).collect()
    assert [r["k"] for r in rows] == ["csv", "xlsx", None] and [r["s"] for r in rows] == ["10 B", "2 KB", "3.0 MB"]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    turns = [("2024-01-01 00:00:00", "my password: hunter22 please"), ("2024-01-01 00:00:30", "my password: hunter22 please"), ("2024-01-01 00:01:00", "what is the weather today"), ("2024-01-01 00:01:00", "what is the weather today")]
    df = spark.createDataFrame(turns, "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text")
    df.write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).parquet(str(src))
    query = check.checked(stream).select("text", "decision").writeStream.format("memory").queryName("checked").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r["text"][:4], r["decision"]) for r in spark.sql("select * from checked").collect()) == [("my p", "block"), ("my p", "block"), ("what", "allow"), ("what", "allow")]
    # What was allowed is not passed on again; what was blocked is judged each time.
    query = check.not_cleared(check.checked(stream), "ts").select("text", "decision").writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c2")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(r["decision"] for r in spark.sql("select * from fresh").collect()) == ["allow", "block", "block"]


def test_two_stages_and_limits(spark):
    df = spark.createDataFrame([(1, "Mark called about the report."), (2, "x" * 1_000_001), (3, "nothing here")], "id long, text string")
    first = check.checked(df)
    rows = {r["id"]: r for r in check.deep_checked(first).select("id", "decision", "headline").collect()}
    assert rows[2]["headline"] == "Could not check this content" and rows[2]["decision"] == "warn" and rows[3]["decision"] == "allow"


def test_feedback_and_scores(spark):
    scanned = scan(spark.createDataFrame([(1, "mail a.b@c.de"), (2, "plain")], "doc_id long, text string"))
    records = feedback.records(scanned)
    labels = spark.createDataFrame([("a1", "internal", None), ("a9", "public", None)], "id string, label string, decision string")
    rows = {r["id"]: r for r in feedback.labelled(records, labels).collect()}
    assert rows["a1"]["label"] == "internal" and rows["a1"]["user_decision"] == "overridden" and rows["a2"]["user_decision"] == "unreviewed"
    assert rows["a1"]["fingerprint"]["finding_counts"]["personal"] == 1 and rows["a1"]["sample"] is None
    found = spark.createDataFrame([(1, "a.b@c.de", "EMAIL")], "doc_id long, value string, category string")
    expected = spark.createDataFrame([(1, "a.b@c.de", None), (2, "x", None)], "doc_id long, value string, category string")
    score = metrics.corpus_score(found, expected, spark.createDataFrame([(2, "plain")], "doc_id long, value string")).first()
    assert score["recall"] == 0.5 and score["trap_resistance"] == 1.0


def test_sites(spark):
    df = spark.createDataFrame([("chat.example.com",), ("evilexample.com",), ("example.com",)], "h string")
    assert [r[0] for r in df.select(check.site(F.col("h"), {"example.com": "x"})).collect()] == ["x", None, "x"]
