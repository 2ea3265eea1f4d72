"""Files in and out: text, tables, spreadsheets and word-processor documents.

Office files are zip archives of XML. They are read as ``binaryFile`` rows and taken apart
by the standard library in an Arrow UDF; nothing else is needed. PDF files are read by
``pdf``. Files too large for a row are read by ``parts``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import portable
from .pdf import pdf_text

KINDS = {".txt": "txt", ".md": "txt", ".log": "txt", ".json": "txt", ".csv": "csv", ".tsv": "csv", ".docx": "docx", ".xlsx": "xlsx", ".xlsm": "xlsx", ".pdf": "pdf"}
MIME = {"txt": "text/plain", "csv": "text/csv", "pdf": "text/plain", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
DELIMITER = " | "


def kind(path: Column) -> Column:
    """The kind of a file by its extension; null for others."""
    table = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return F.try_element_at(table, F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)))


def size_label(n: Column) -> Column:
    return F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024 * 1024, F.format_string("%.0f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1048576))


def output_name(name: Column) -> Column:
    """The name of the cleaned file; PDF files come back as text."""
    cleaned = F.when(name.rlike(r"\.[^.]+$"), F.regexp_replace(name, r"(\.[^.]+)$", " — sanitized$1")).otherwise(F.concat(name, F.lit(" — sanitized")))
    return F.regexp_replace(cleaned, r"(?i)\.pdf$", ".txt")


def row_text(*columns: str) -> Column:
    """A table's row as text, cells parted as in spreadsheets; empty cells at its end are
    left off."""
    cells = F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return F.regexp_replace(F.array_join(cells, DELIMITER), r"( \| )+$", "")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_PART = re.compile(r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml$")


def _paragraph(p) -> str:
    say = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
    return "".join(say[e.tag](e) for e in p.iter() if e.tag in say)


def _part_order(name: str) -> tuple[int, str]:
    return (0 if "document" in name else 1 if "header" in name else 2), name


def docx_parts(z: zipfile.ZipFile) -> list[str]:
    """Parts with text: body, headers, the rest."""
    return sorted((n for n in z.namelist() if _PART.search(n)), key=_part_order)


def docx_text(content: bytes) -> tuple[str, list[str]]:
    """Paragraphs by line; parts (body, headers, the rest) by blank line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = docx_parts(z)
        sections = ["\n".join(_paragraph(p) for p in ElementTree.fromstring(z.read(n)).iter(f"{_W}p")) for n in parts]
    return "\n\n".join(s for s in sections if s.strip()), []


def _shared(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names and parts of the sheets, in order."""
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    return [(s.get("name"), "xl/" + targets[s.get(rel)].removeprefix("/xl/")) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]


def _column(reference: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


#: Formats by number (ECMA-376, 18.8.30).
_FORMATS = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00",
    14: "m/d/yy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0;(#,##0)", 38: "#,##0;(#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;(#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mm:ss.0",
}
_DATE_PART = re.compile(r'"[^"]*"|\\.|\[[hms]+\]|AM/PM|A/P|y+|m+|d+|h+|s+(?:\.0+)?|.', re.I)


def _date_text(days: float, code: str, epoch: datetime) -> str:
    """A serial date by its format's parts; m is a minute after hours or before seconds."""
    at = epoch + timedelta(seconds=round(days * 86400))
    tokens, twelve = _DATE_PART.findall(code), bool(re.search(r"AM/PM|A/P", code, re.I))
    kinds = [t[0].lower() if t[0].lower() in "ymdhs" else t[:2].strip("[") if t[0] == "[" else "" for t in tokens]
    known = [(k, n) for n, k in enumerate(kinds) if k]
    for j, (k, n) in enumerate(known):
        if k == "m" and len(tokens[n]) <= 2 and (j and known[j - 1][0] in "hH" or j + 1 < len(known) and known[j + 1][0] == "s"):
            kinds[n] = "minute"
    hour = (at.hour % 12 or 12) if twelve else at.hour
    say = {
        "y": lambda n: at.strftime("%Y" if n > 2 else "%y"),
        "m": lambda n: at.strftime({3: "%b", 4: "%B"}[n]) if n in (3, 4) else at.strftime("%b")[0] if n > 4 else f"{at.month:0{n}d}",
        "d": lambda n: at.strftime("%a" if n == 3 else "%A") if n > 2 else f"{at.day:0{n}d}",
        "h": lambda n: f"{hour:0{min(n, 2)}d}",
        "minute": lambda n: f"{at.minute:0{n}d}",
        "s": lambda n: f"{at.second:0{min(n, 2)}d}",
    }
    out = []
    for t, k in zip(tokens, kinds, strict=True):
        if t[0] == "[":
            unit = {"h": 3600, "m": 60, "s": 1}[t[1].lower()]
            out.append(str(round(days * 86400) // unit))
        elif k:
            out.append(say[k](len(t)))
        elif t.upper() in ("AM/PM", "A/P"):
            out.append(at.strftime("%p"))
        else:
            out.append(t.strip('"') if t[0] == '"' else t[-1])
    return "".join(out)


def _number_text(x: float, code: str) -> str:
    """A number by its format: decimals, thousands, percent, exponent and plain text."""
    bare = re.sub(r'"[^"]*"|\\.', "", code)
    slots = re.search(r"[#0?][#0?,.]*(?:E[+-]0+)?", bare)
    literal = lambda t: re.sub(r'"([^"]*)"|\\(.)', lambda m: m[1] or m[2] or "", t)
    if not slots:
        return literal(code)
    places = len(re.match(r"[0#?]*", slots[0].partition(".")[2])[0])
    if "E" in slots[0]:
        digits = f"{x:.{places}E}"
    else:
        x *= 100 ** bare.count("%")
        digits = f"{x:{',' if ',' in slots[0].strip(',') else ''}.{places}f}"
    at = code.find(slots[0])
    return literal(code[:at]) + digits + literal(code[at + len(slots[0]) :]) if at >= 0 else digits


def _shown(value: str, code: str, epoch: datetime) -> str:
    """A stored number as its cell shows it. Whole numbers without a format keep all digits."""
    try:
        x = float(value)
    except ValueError:
        return value
    if code in ("", "General", "@"):
        return str(int(x)) if x.is_integer() and abs(x) < 1e21 else format(x, ".10g")
    sections = re.split(r';(?=(?:[^"]*"[^"]*")*[^"]*$)', code)
    k = 1 if x < 0 and len(sections) > 1 else 2 if x == 0 and len(sections) > 2 else 0
    code = re.sub(r"\[(?![hms]+\])[^\]]*\]|_.|\*.", "", sections[k], flags=re.I)
    if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|E[+-]', "", code), re.I):
        try:
            return _date_text(x, code, epoch)
        except OverflowError:
            return value
    return _number_text(abs(x) if k == 1 else x, code)


@dataclass(frozen=True)
class _Book:
    """What the cells of a workbook refer to: shared strings, formats by style, dates."""

    shared: Sequence[str]
    formats: list[str]
    epoch: datetime

    @classmethod
    def of(cls, z: zipfile.ZipFile, shared: Sequence[str] | None = None) -> _Book:
        formats: list[str] = []
        if "xl/styles.xml" in z.namelist():
            styles = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {int(f.get("numFmtId")): f.get("formatCode") for f in styles.iter(f"{_S}numFmt")}
            formats = [own.get(int(xf.get("numFmtId", 0)), _FORMATS.get(int(xf.get("numFmtId", 0)), "")) for group in styles.findall(f"{_S}cellXfs") for xf in group]
        settings = ElementTree.fromstring(z.read("xl/workbook.xml")).find(f"{_S}workbookPr")
        late = settings is not None and settings.get("date1904") in ("1", "true")
        return cls(_shared(z) if shared is None else shared, formats, datetime(1904, 1, 1) if late else datetime(1899, 12, 30))

    def raw(self, c) -> str:
        value = c.find(f"{_S}v")
        if c.get("t") == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_S}t"))
        if value is None or value.text is None:
            return ""
        return self.shared[int(value.text)] if c.get("t") == "s" else value.text

    def shown(self, c) -> str:
        """A cell's text as the sheet shows it."""
        raw, style = self.raw(c), int(c.get("s", 0))
        if c.get("t") == "b":
            return {"1": "TRUE", "0": "FALSE"}.get(raw, raw)
        if not raw or c.get("t", "n") != "n":
            return raw
        return _shown(raw, self.formats[style] if style < len(self.formats) else "", self.epoch)


    def line(self, row) -> str:
        """A row's cells as shown, empty ones at its end left off."""
        cells: list[str] = []
        for c in row.iter(f"{_S}c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [""] * (at - len(cells))
            cells.append(self.shown(c))
        while cells and not cells[-1].strip():
            cells.pop()
        return DELIMITER.join(cells)


def xlsx_text(content: bytes) -> tuple[str, list[str]]:
    """Each sheet under a line with its name, sheets parted by a blank line; cells as shown,
    empty ends and rows dropped. A sheet without text gives no line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book, out, names = _Book.of(z), [], []
        for name, part in _sheets(z):
            names.append(name)
            lines = [line for row in ElementTree.fromstring(z.read(part)).iter(f"{_S}row") if (line := book.line(row))]
            if lines:
                out.append("\n".join([f"--- {name} ---", *lines]))
    return "\n\n".join(out), names


#: Text, names of sheets, number of pages.
_READERS = {"docx": lambda b: (*docx_text(b), None), "xlsx": lambda b: (*xlsx_text(b), None), "pdf": lambda b: (lambda text, pages: (text, [], pages))(*pdf_text(b))}


def _replace_all(text: str, value_map: dict[str, str]) -> str:
    for key in sorted((k for k in value_map if k), key=lambda k: (-len(k), k)):
        text = text.replace(key, value_map[key])
    return text


def _places(text: str, value_map: dict[str, str]) -> list[tuple[int, int, str]]:
    """``(start, end, replacement)`` of the values in a text; longer ones take their place
    first, none overlap."""
    taken, out = bytearray(len(text)), []
    for key in sorted((k for k in value_map if k), key=lambda k: (-len(k), k)):
        at = text.find(key)
        while at >= 0:
            end = at + len(key)
            if any(taken[at:end]):
                end = at + 1
            else:
                taken[at:end] = b"\1" * len(key)
                out.append((at, end, value_map[key]))
            at = text.find(key, end)
    return sorted(out)


def _spread(nodes, places: list[tuple[int, int, str]]) -> None:
    """Writes replacements into the run in which each value begins; the rest of the value
    goes from the runs after it, which keep their other text."""
    k = low = 0
    for node in nodes:
        text = node.text or ""
        high, cut, parts = low + len(text), 0, []
        while k < len(places) and places[k][0] < high:
            start, end, new = places[k]
            if start >= low:
                parts += [text[cut : start - low], new]
            cut = min(end, high) - low
            if end > high:
                break
            k += 1
        if parts or cut:
            node.text = "".join([*parts, text[cut:]])
            node.set("{http://www.w3.org/XML/1998/namespace}space", "preserve")
        low = high


_FIRST_TAG = re.compile(r"<[A-Za-z_][^>]*>")


def _parsed(data: bytes):
    for prefix, uri in re.findall(r'xmlns:([\w.-]+)="([^"]+)"', data.decode("utf-8", "replace")):
        if not re.fullmatch(r"ns\d+", prefix):
            ElementTree.register_namespace(prefix, uri)
    return ElementTree.fromstring(data)


def _serialized(root, source: bytes) -> bytes:
    """The changed XML with every prefix that the source's first element declares, used or
    not: attributes such as ``mc:Ignorable`` name prefixes in their values."""
    text = ElementTree.tostring(root, encoding="unicode")
    head, before = _FIRST_TAG.search(text)[0], _FIRST_TAG.search(source.decode("utf-8", "replace"))[0]
    more = [f' xmlns:{p}="{uri}"' for p, uri in re.findall(r'xmlns:([\w.-]+)="([^"]+)"', before) if f"xmlns:{p}=" not in head]
    end = len(head) - (2 if head.endswith("/>") else 1)
    return ("<?xml version='1.0' encoding='UTF-8'?>\n" + head[:end] + "".join(more) + text[end:]).encode()


def docx_cleaned(content: bytes, value_map: dict[str, str]) -> bytes:
    """The document with values replaced, found over the runs of a paragraph. A replacement
    takes the format of the run in which its value begins; all other text keeps its own."""

    def part(data: bytes) -> bytes:
        root = _parsed(data)
        for p in root.iter(f"{_W}p"):
            nodes = list(p.iter(f"{_W}t"))
            _spread(nodes, _places("".join(t.text or "" for t in nodes), value_map))
        return _serialized(root, data)

    return _rewritten(content, lambda name: bool(_PART.search(name)), part)


def xlsx_cleaned(content: bytes, value_map: dict[str, str]) -> bytes:
    """The workbook with values replaced in what cells show, else in what they store. A
    changed cell becomes text without a formula; a number also loses its format."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        book, sheets = _Book.of(z), {p for _, p in _sheets(z)}

    def part(data: bytes) -> bytes:
        ElementTree.register_namespace("", _S[1:-1])
        root = _parsed(data)
        for c in root.iter(f"{_S}c"):
            shown, raw = book.shown(c), book.raw(c)
            new = _replace_all(shown, value_map)
            if new == shown:
                new = _replace_all(raw, value_map)
                if new == raw:
                    continue
            if c.get("t", "n") in ("n", "d"):
                c.attrib.pop("s", None)
            for child in list(c):
                c.remove(child)
            c.set("t", "inlineStr")
            ElementTree.SubElement(ElementTree.SubElement(c, f"{_S}is"), f"{_S}t").text = new
        return _serialized(root, data)

    return _rewritten(content, sheets.__contains__, part)


def _rewritten(content: bytes, wanted, change) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as w:
        for item in z.infolist():
            data = z.read(item.filename)
            w.writestr(item, change(data) if wanted(item.filename) else data)
    return out.getvalue()


EXTRACTED = "text string, sheet_names array<string>, error string, pages int"


def _counted(n: Column, one: str) -> Column:
    """A number with its noun, thousands parted: ``1 page``, ``1,200 pages``."""
    return F.concat(F.format_number(n, 0), F.when(n == 1, f" {one}").otherwise(f" {one}s"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(path, name, kind, size, text, detail, sheet_names, delimiter, error)`` for each
    file. A file that can't be read has a null text and an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), "content").withColumn("kind", kind(F.col("name"))).where("kind is not null")
    plain = files.where(F.col("kind").isin("txt", "csv")).select("path", "name", "kind", "size", F.make_valid_utf8(F.col("content").cast("string")).alias("text"), F.lit(None).cast("array<string>").alias("sheet_names"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("pages"))

    def run(source):
        for batch in source:
            rows = {k: [] for k in ("text", "sheet_names", "error", "pages")}
            for k, content in zip(batch.column("kind").to_pylist(), batch.column("content"), strict=True):
                try:
                    text, names, pages = _READERS[k](content.as_py())
                    row = (text, names, None, pages)
                except KeyError as e:
                    row = (None, None, f"missing part {e}", None)
                except (zipfile.BadZipFile, ElementTree.ParseError, ValueError, IndexError) as e:
                    row = (None, None, str(e), None)
                for name, value in zip(rows, row, strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("path", "name", "kind", "size")), pa.array(rows["text"], pa.string()), pa.array(rows["sheet_names"], pa.list_(pa.string())), pa.array(rows["error"], pa.string()), pa.array(rows["pages"], pa.int32())], names=["path", "name", "kind", "size", "text", "sheet_names", "error", "pages"])

    packed = files.where(~F.col("kind").isin("txt", "csv")).mapInArrow(run, "path string, name string, kind string, size long, " + EXTRACTED)
    lines = F.concat(F.format_number(F.size(F.split("text", "\n", -1)), 0), F.lit(" lines"))
    words = F.concat(F.format_number(F.size(F.filter(F.split("text", portable(r"\s+")), lambda w: w != "")), 0), F.lit(" words"))
    detail = F.when(F.col("kind") == "xlsx", _counted(F.size("sheet_names"), "sheet")).when(F.col("kind") == "pdf", _counted(F.col("pages"), "page")).when(F.col("kind") == "docx", words).otherwise(lines)
    return plain.unionByName(packed).withColumn("detail", detail).withColumn("delimiter", F.when(F.col("kind") == "xlsx", DELIMITER)).drop("pages")


def cleaned_files(files: DataFrame) -> DataFrame:
    """``(name, mime, content)`` from ``(name, kind, content, text, value_map)``: Office
    files rewritten in place, others as their cleaned text."""

    def run(source):
        for batch in source:
            out = []
            for k, content, text, pairs in zip(*(batch.column(c).to_pylist() for c in ("kind", "content", "text", "value_map")), strict=True):
                change = {"docx": docx_cleaned, "xlsx": xlsx_cleaned}.get(k)
                out.append(change(content, dict(pairs or [])) if change else (text or "").encode())
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("kind"), pa.array(out, pa.binary())], names=["name", "kind", "content"])

    done = files.select("name", "kind", "content", "text", "value_map").mapInArrow(run, "name string, kind string, content binary")
    mime = F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv))
    return done.select(output_name(F.col("name")).alias("name"), F.try_element_at(mime, F.col("kind")).alias("mime"), "content")


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Cases to score against, from JSON files that hold a list of objects each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
