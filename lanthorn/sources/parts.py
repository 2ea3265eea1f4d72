"""Office and PDF files by parts: a row a line, for files that are too large for one row.

Spark lists the files without reading them; tasks look into each archive's directory and give
a row a part: a sheet, a document part, a run of pages. The parts are spread over tasks by
their key, and each is parsed as a stream, so a task holds a row of cells or a paragraph, and
a workbook's shared strings as bytes. A sheet is one compressed stream: it isn't split.
Text and CSV files need none of this: ``spark.read.text`` splits them.
"""

from __future__ import annotations

import re
import zipfile
from array import array
from collections.abc import Iterator, Sequence
from itertools import count
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _S, _W, _Book, _paragraph, _sheets, docx_parts, kind
from .pdf import document, page_text

PART = "path string, kind string, part int, name string, target string, error string"
LINE = "path string, kind string, part int, name string, line long, text string, error string"
#: Pages of a PDF file in a part, and lines and characters in a batch.
PAGES, LINES, CHARACTERS = 64, 2_000, 4 << 20
BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, ValueError, KeyError, IndexError, EOFError)


def opened(path: str) -> pa.NativeFile:
    """A file that can be read from any place, wherever ``pyarrow.fs`` reaches."""
    system, at = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return system.open_input_file(at)


def elements(source, tag: str) -> Iterator[ElementTree.Element]:
    """The outermost elements with a tag, one at a time. All else is let go as it is read."""
    above, inside = [], 0
    for event, e in ElementTree.iterparse(source, ("start", "end")):
        if event == "start":
            above.append(e)
            inside += e.tag == tag
            continue
        above.pop()
        inside -= e.tag == tag
        if not inside:
            if e.tag == tag:
                yield e
            if above:
                above[-1].remove(e)


class Strings(Sequence):
    """A workbook's shared strings, as bytes one after the other."""

    def __init__(self, strings: Iterator[str]):
        self.data, self.ends = bytearray(), array("Q", [0])
        for s in strings:
            self.data += s.encode("utf-8", "surrogatepass")
            self.ends.append(len(self.data))

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, k: int) -> str:
        if not 0 <= k < len(self):
            raise IndexError(f"no shared string {k}")
        return self.data[self.ends[k] : self.ends[k + 1]].decode("utf-8", "surrogatepass")


def shared(z: zipfile.ZipFile) -> Strings:
    if "xl/sharedStrings.xml" not in z.namelist():
        return Strings(iter(()))
    with z.open("xl/sharedStrings.xml") as f:
        return Strings("".join(t.text or "" for t in si.iter(f"{_S}t")) for si in elements(f, f"{_S}si"))


def _targets(path: str, kind: str) -> list[tuple[str, str]]:
    """Names of a file's parts, and where each lies."""
    with opened(path) as f:
        if kind == "pdf":
            n = len(document(f.read()).pages())
            return [(f"pages {a + 1}-{min(a + PAGES, n)}", f"{a}:{min(a + PAGES, n)}") for a in range(0, n, PAGES)]
        with zipfile.ZipFile(f) as z:
            return _sheets(z) if kind == "xlsx" else [(p, p) for p in docx_parts(z)]


def parts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, kind, part, name, target, error)``: a row for each part of the Office and PDF
    files below a path, numbered from 0 in their order; one row with an error for a file that
    can't be read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    listed = listed.withColumn("kind", kind(F.col("path"))).where(F.col("kind").isin("docx", "xlsx", "pdf"))

    def run(source):
        for batch in source:
            rows = []
            for p, k in zip(batch.column("path").to_pylist(), batch.column("kind").to_pylist(), strict=True):
                try:
                    rows += [(p, k, n, name, target, None) for n, (name, target) in enumerate(_targets(p, k))]
                except BROKEN as e:
                    rows.append((p, k, 0, None, None, str(e)))
            yield _batch(rows, PART)

    return listed.mapInArrow(run, PART)


_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _ARROW[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _texts(path: str, kind: str, target: str) -> Iterator[str]:
    with opened(path) as f:
        if kind == "pdf":
            doc, (first, last) = document(f.read()), map(int, target.split(":"))
            for page, resources in doc.pages()[first:last]:
                yield page_text(doc, page, resources)
            return
        with zipfile.ZipFile(f) as z:
            book = _Book.of(z, shared(z)) if kind == "xlsx" else None
            with z.open(target) as xml:
                if book:
                    yield from (line for row in elements(xml, f"{_S}row") if (line := book.line(row)))
                else:
                    for outer in elements(xml, f"{_W}p"):
                        yield from map(_paragraph, outer.iter(f"{_W}p"))


def lines(parts: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(path, kind, part, name, line, text, error)`` of ``parts``: a row for each row of a
    sheet that isn't empty, each paragraph, each page, numbered from 0 in its part. A part that
    breaks off has its lines up to there, then one with a null text and the error; a part
    without lines has no rows.

    ``tasks`` (by default four for each core) share the parts. The number is given to Spark,
    since rows of parts are small and would else be put into one task."""
    spark = parts.sparkSession
    tasks = tasks or 4 * spark.sparkContext.defaultParallelism

    def run(source):
        rows, held = [], 0
        for batch in source:
            for part in batch.to_pylist():
                key = (part["path"], part["kind"], part["part"], part["name"])
                if part["error"] is not None:
                    rows.append((*key, 0, None, part["error"]))
                    continue
                numbers = count()
                try:
                    for text in _texts(part["path"], part["kind"], part["target"]):
                        rows.append((*key, next(numbers), text, None))
                        held += len(text)
                        if len(rows) >= LINES or held >= CHARACTERS:
                            yield _batch(rows, LINE)
                            rows, held = [], 0
                except BROKEN as e:
                    rows.append((*key, next(numbers), None, str(e)))
        if rows:
            yield _batch(rows, LINE)

    return parts.repartition(tasks, "path", "part").select(*(f.split()[0] for f in PART.split(", "))).mapInArrow(run, LINE)


def read_lines(spark: SparkSession, path: str, tasks: int | None = None) -> DataFrame:
    """The lines of all Office and PDF files below a path, ready for ``scan``."""
    return lines(parts(spark, path), tasks)
