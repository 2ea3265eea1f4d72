"""PDF text and files by parts, on files made here."""

import base64
import io
import random
import subprocess
import sys
import zipfile
import zlib
from pathlib import Path

import pytest
from test_files_streams import STYLES, W, archive, book, docx, xlsx

from lanthorn.plans.scan import finding_rows, scan
from lanthorn.sources import files, parts, pdf

HELVETICA = "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"


def stream(data: bytes, more: str = "", flate: bool = True) -> bytes:
    data = zlib.compress(data) if flate else data
    return f"<< /Length {len(data)} {'/Filter /FlateDecode' if flate else ''} {more} >>\nstream\n".encode() + data + b"\nendstream"


def made(objects: dict[int, str | bytes], root: int = 1, trailer: str = "") -> bytes:
    """A file with a cross-reference table."""
    out, at = bytearray(b"%PDF-1.4\n%\xe2\xe3\n"), {}
    for n, body in objects.items():
        at[n] = len(out)
        out += f"{n} 0 obj\n".encode() + (body.encode("latin-1") if isinstance(body, str) else body) + b"\nendobj\n"
    start, size = len(out), max(objects) + 1
    out += f"xref\n0 {size}\n0000000000 65535 f \n".encode()
    for n in range(1, size):
        out += f"{at.get(n, 0):010d} 00000 {'n' if n in at else 'f'} \n".encode()
    return bytes(out + f"trailer\n<< /Size {size} /Root {root} 0 R {trailer} >>\nstartxref\n{start}\n%%EOF\n".encode())


def paged(*contents: bytes, font: str = HELVETICA, more: dict[int, str | bytes] | None = None, resources: str = "") -> dict[int, str | bytes]:
    """Objects of a file with a page for each content; resources are inherited."""
    kids = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(contents)))
    out: dict[int, str | bytes] = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(contents)} /Resources << /Font << /F1 3 0 R >> {resources} >> >>", 3: font}
    for k, c in enumerate(contents):
        out[10 + 2 * k], out[11 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {11 + 2 * k} 0 R >>", stream(c)
    return {**out, **(more or {})}


def text(objects: dict[int, str | bytes]) -> str:
    return pdf.pdf_text(made(objects))[0]


def test_pages_lines_and_strings():
    first = rb"BT /F1 12 Tf 72 700 Td (Mail sarah\100northwind.com \(now\)) Tj 0 -14 Td (next \
line) Tj T* <41 42 4> Tj ET"
    assert pdf.pdf_text(made(paged(first, b"BT /F1 9 Tf (two) ' ET", b"0 0 10 10 re f"))) == ("Mail sarah@northwind.com (now) next line AB@\n\ntwo", 3)


def test_runs_that_touch_are_one_word():
    widths = "<< /Type /Font /Subtype /TrueType /FirstChar 65 /LastChar 67 /Widths [500 500 500] /Encoding /WinAnsiEncoding >>"
    assert text(paged(b"BT /F1 10 Tf [(A) -20 (B) 30 (C) -400 (A)] TJ ET", font=widths)) == "ABC A"
    # A step of five units is just the width of a letter of size 10; six leave a fifth free.
    assert text(paged(b"BT /F1 10 Tf (A) Tj 5 0 Td (B) Tj 8 0 Td (C) Tj ET", font=widths)) == "AB C"
    assert text(paged(b"BT /F1 1 Tf 0 10 -10 0 50 50 Tm (A) Tj 0 10 -10 0 50 55 Tm (B) Tj ET", font=widths)) == "AB"
    assert text(paged(b"q 2 0 0 2 0 0 cm BT /F1 10 Tf (A) Tj ET Q BT /F1 20 Tf 10 0 Td (B) Tj ET", font=widths)) == "AB"


def test_encodings():
    named = "<< /Type /Font /Subtype /Type1 /Encoding << /BaseEncoding /WinAnsiEncoding /Differences [1 /eacute /fi /seven /uni20AC /Zcaron 200 /a.alt] >> >>"
    assert text(paged(b"BT /F1 10 Tf (\x01\x02\x03\x04\x05\xc8\x93) Tj ET", font=named)) == "éfi7€Ža“"
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0003> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0058> <00590059>] endbfrange"
    wide = "<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R /DescendantFonts [<< /DW 1000 /W [16 [500 500] 18 32 700] >>] >>"
    assert text(paged(b"BT /F1 10 Tf <0003001000110012002000210099> Tj ET", font=wide, more={5: stream(cmap)})) == "😀ABCXYY"


def test_forms_and_pictures():
    form = stream(b"BT /F1 10 Tf (in a form) Tj ET /Me Do", "/Type /XObject /Subtype /Form /Matrix [1 0 0 1 0 300]")
    page = b"BT /F1 10 Tf (before) Tj ET /Me Do BI /W 2 /H 2 ID \x00(Tj\xff EI BT 0 -50 Td /F1 10 Tf (after) Tj ET"
    out = text(paged(page, more={6: form}, resources="/XObject << /Me 6 0 R >>"))
    assert out.startswith("before in a form") and out.endswith("after")


def packed() -> bytes:
    """A file whose objects lie in an object stream, found by a stream of cross-references
    with a predictor."""
    inside = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Contents 6 0 R /Resources << /Font << /F1 4 0 R >> >> >>", 4: HELVETICA.encode()}
    heads, bodies = [], b""
    for n, b in inside.items():
        heads.append(f"{n} {len(bodies)}")
        bodies += b + b" "
    head = " ".join(heads).encode() + b" "
    out, at = bytearray(b"%PDF-1.5\n"), {}
    for n, body in {5: stream(head + bodies, f"/Type /ObjStm /N 4 /First {len(head)}"), 6: stream(b"BT /F1 10 Tf (packed away) Tj ET")}.items():
        at[n] = len(out)
        out += f"{n} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    rows = [(0, 0, 0), *((2, 5, k) for k in range(4)), (1, at[5], 0), (1, at[6], 0), (1, start, 0)]
    table, above = b"", bytes(4)
    for kind, place, k in rows:
        row = bytes([kind]) + place.to_bytes(2) + bytes([k])
        table += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, above, strict=True))
        above = row
    out += b"7 0 obj\n" + stream(table, "/Type /XRef /Size 8 /W [1 2 1] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 4 >>") + b"\nendobj\n"
    return bytes(out + f"startxref\n{start}\n%%EOF".encode())


def test_object_streams_and_broken_references():
    assert pdf.pdf_text(packed()) == ("packed away", 1)
    assert pdf.pdf_text(packed().replace(b"startxref", b"nowhere!!")) == ("packed away", 1)
    whole = made(paged(b"BT /F1 10 Tf (still here) Tj ET"))
    assert pdf.pdf_text(whole[: whole.rindex(b"xref\n0")])[0] == "still here"
    moved = b"%PDF-1.4\n% more before all offsets\n" + whole
    assert pdf.pdf_text(moved)[0] == "still here"


def test_newer_sections_win():
    old = made(paged(b"BT /F1 10 Tf (old) Tj ET"))
    body = b"11 0 obj\n" + stream(b"BT /F1 10 Tf (new) Tj ET") + b"\nendobj\n"
    start = len(old) + len(body)
    prev = int(old.split(b"startxref\n")[1].split()[0])
    more = f"xref\n11 1\n{len(old):010d} 00000 n \ntrailer\n<< /Size 12 /Root 1 0 R /Prev {prev} >>\nstartxref\n{start}\n%%EOF".encode()
    assert pdf.pdf_text(old + body + more)[0] == "new"


@pytest.mark.parametrize("content", [b"", b"%PDF-1.4", b"%PDF-1.4 1 0 obj << /Type /Catalog", made(paged(b""), trailer="/Encrypt << /Filter /Standard >>"), made({**paged(b""), 11: stream(b"x", "/Filter /LZWDecode", flate=False)})])
def test_what_cant_be_read(content):
    with pytest.raises(ValueError):
        pdf.pdf_text(content)


def test_damage_is_an_error_or_less_text():
    rng = random.Random(7)
    for whole in (packed(), made(paged(b"BT /F1 10 Tf [(a) -300 (b)] TJ ET", b"BT /F1 10 Tf (c) Tj ET"))):
        for _ in range(1500):
            data = bytearray(whole)
            for _ in range(rng.randint(1, 6)):
                data[rng.randrange(9, len(data))] = rng.randrange(256)
            try:
                pdf.pdf_text(bytes(data[: rng.randint(9, len(data))] if rng.random() < 0.3 else data))
            except ValueError:
                pass


def test_filters():
    show = b"BT /F1 10 Tf (ok) Tj ET"
    runs = bytes([len(show) - 1]) + show + b"\x80"
    for name, data in {"ASCIIHexDecode": show.hex().encode() + b">", "ASCII85Decode": base64.a85encode(show) + b"~>", "RunLengthDecode": runs}.items():
        assert text({**paged(b""), 11: stream(data, f"/Filter [/{name}]", flate=False)}) == "ok"


def test_files_have_pdf_text_and_details(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(paged(b"BT /F1 10 Tf (Mail sarah.mitchell@northwind.com) Tj ET", b"")))
    (tmp_path / "b.docx").write_bytes(docx())
    (tmp_path / "c.txt").write_text("x\n" * 1200)
    (tmp_path / "d.pdf").write_bytes(b"%PDF-1.4 nothing")
    read = files.read_files(spark, str(tmp_path))
    rows = {r["name"]: r for r in read.collect()}
    assert {n: r["detail"] for n, r in rows.items()} == {"a.pdf": "2 pages", "b.docx": "8 words", "c.txt": "1,201 lines", "d.pdf": None}
    assert rows["d.pdf"]["text"] is None and rows["d.pdf"]["error"] and rows["a.pdf"]["error"] is None
    found = finding_rows(scan(read.where("name = 'a.pdf'")), "name").collect()
    assert [(r["category"], r["value"]) for r in found] == [("EMAIL", "sarah.mitchell@northwind.com")]


def joined(rows) -> dict[str, str]:
    """Whole texts from lines, as ``read_files`` gives them."""
    out: dict = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["part"], r["line"])):
        out.setdefault((r["path"].rpartition("/")[2], r["kind"]), {}).setdefault((r["part"], r["name"]), []).append(r["text"])
    gap = {"pdf": "\n\n"}
    head = lambda kind, name, ls: [f"--- {name} ---", *ls] if kind == "xlsx" else ls
    return {n: "\n\n".join(s for (_, name), ls in ps.items() if (s := gap.get(k, "\n").join(head(k, name, ls))).strip()).strip() for (n, k), ps in out.items()}


def test_lines_make_up_the_files(spark, tmp_path):
    boxed = f"<w:document {W}><w:body><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>out </w:t></w:r><w:txbx><w:p><w:r><w:t>in</w:t></w:r></w:p></w:txbx></w:p><w:sectPr/></w:body></w:document>"
    made_here = {"a.docx": docx(), "b.docx": archive({"word/document.xml": boxed}), "c.xlsx": xlsx(), "d.xlsx": book('<row r="1"><c r="A1" s="1"><v>45000</v></c><c r="B1" t="inlineStr"><is><t>x</t></is></c></row>', styles=STYLES), "e.pdf": made(paged(*(b"BT /F1 10 Tf (page %d) Tj ET" % k for k in range(130))))}
    for name, data in {**made_here, "junk.xlsx": b"junk", "cut.docx": archive({"word/document.xml": f"<w:document {W}><w:p><w:r><w:t>kept</w:t></w:r></w:p><w:p>"}), "t.txt": b"not these"}.items():
        (tmp_path / name).write_bytes(data)
    rows = parts.read_lines(spark, str(tmp_path), 3).collect()
    bad = {r["path"].rpartition("/")[2] for r in rows if r["error"]}
    assert bad == {"junk.xlsx", "cut.docx"}
    assert [r["text"] for r in rows if r["path"].endswith("cut.docx")] == ["kept", None]
    whole = {r["name"]: r["text"].strip() for r in files.read_files(spark, str(tmp_path)).where("error is null and kind <> 'txt'").collect()}
    assert joined(r for r in rows if r["path"].rpartition("/")[2] not in bad) == whole and len(whole) == 5
    assert {r["part"] for r in rows if r["kind"] == "pdf"} == {0, 1, 2}


def test_no_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("x")
    assert parts.read_lines(spark, str(tmp_path)).collect() == []


def test_a_large_sheet_in_little_memory(tmp_path):
    """A sheet of 120 MB of XML and 22 MB of shared strings, in a process of its own."""
    at = tmp_path / "big.xlsx"
    n = 400_000
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z:
        with zipfile.ZipFile(io.BytesIO(xlsx())) as old:
            for name in ("xl/workbook.xml", "xl/_rels/workbook.xml.rels"):
                z.writestr(name, old.read(name))
        ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        with z.open("xl/sharedStrings.xml", "w") as f:
            f.write(f"<sst {ns}>".encode())
            for a in range(0, n, 10_000):
                f.write("".join(f"<si><t>shared string number {k:012d}</t></si>" for k in range(a, a + 10_000)).encode())
            f.write(b"</sst>")
        with z.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as f:
            f.write(f"<worksheet {ns}><sheetData>".encode())
            for a in range(0, n, 10_000):
                f.write("".join(f'<row r="{k + 1}"><c r="A{k + 1}" t="s"><v>{k}</v></c>' + "".join(f'<c r="{c}{k + 1}"><v>{k}</v></c>' for c in "BCDEFGHIJ") + "</row>" for k in range(a, a + 10_000)).encode())
            f.write(b"</sheetData></worksheet>")
    code = f"""
import resource
from lanthorn.sources import parts
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = 0
for line in parts._texts("file://{at}", "xlsx", "xl/worksheets/sheet1.xml"):
    assert line.startswith(f"shared string number {{n:012d}} | {{n}} | ")
    n += 1
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True, timeout=300)
    rows, grown = map(int, out.stdout.split())
    assert rows == n and grown < 150 * 1024, f"{grown} KB"
