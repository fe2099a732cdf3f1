"""Texts of office files, books and sheets: zip archives of XML, read a file at a time in Arrow batches."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import document, extension
from .pages import inner_text
from .pdf import Pdf

#: Rows of a sheet that leave the worker together.
SHEET_ROWS = 4096
#: The source that a document names, by converter.
SOURCES = {"office": "Office file uploaded by the user.", "docx": "pdf file uploaded by the user.", "pdf": "pdf file uploaded by the user.", "book": "a epub file uploaded by the user."}


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _all(e: ET.Element, tag: str) -> Iterator[ET.Element]:
    """The element and those inside it that have a tag of any namespace, in order."""
    return (c for c in e.iter() if _tag(c) == tag)


def word_text(archive: zipfile.ZipFile) -> str:
    """Paragraphs, each with an empty line behind it; deleted text, notes and headers don't count.

    Paragraphs inside a paragraph (text boxes) come after it.
    """
    out: list[str] = []

    def inside(e: ET.Element, line: list[str], later: list[ET.Element]) -> None:
        for c in e:
            t = _tag(c)
            if t == "t":
                line.append(c.text or "")
            elif t == "tab" and _tag(e) == "r":
                line.append("\t")
            elif t == "noBreakHyphen":
                line.append("‑")
            elif t == "p":
                later.append(c)
            elif t not in ("Choice", "del", "pPr", "rPr"):
                inside(c, line, later)

    def block(p: ET.Element) -> None:
        line, later = [], []
        inside(p, line, later)
        if _tag(p) == "p":
            out.append("".join(line) + "\n\n")
        for q in later:
            block(q)

    block(ET.fromstring(archive.read("word/document.xml")).find("{*}body"))
    return "".join(out)


def slides_text(archive: zipfile.ZipFile) -> str:
    """Paragraphs with any text as lines, slides by number, a slide's notes behind it."""
    found = []
    for name in archive.namelist():
        m = re.fullmatch(r"ppt/(slides/slide|notesSlides/notesSlide)(\d+)\.xml", name)
        if m:
            found.append((int(m[2]), m[1] != "slides/slide", name))
    lines = []
    for _, _, name in sorted(found):
        for p in _all(ET.fromstring(archive.read(name)), "p"):
            line = "".join(t.text or "" for t in _all(p, "t"))
            if line:
                lines.append(line)
    return "\n".join(lines)


def open_document_text(archive: zipfile.ZipFile) -> str:
    """Paragraphs and headings with any text as lines, in document order; notes of slides come last."""
    lines: list[str] = []
    notes: list[str] = []

    def text(e: ET.Element) -> str:
        out = [e.text or ""]
        for c in e:
            t = _tag(c)
            if t == "s":
                out.append(" " * next((int(v) for k, v in c.attrib.items() if k.endswith("}c")), 1))
            elif t in ("tab", "line-break"):
                out.append("\t" if t == "tab" else "\n")
            elif t not in ("p", "h"):
                out.append(text(c))
            out.append(c.tail or "")
        return "".join(out)

    def walk(e: ET.Element, to: list[str]) -> None:
        for c in e:
            t = _tag(c)
            if t in ("p", "h"):
                line = text(c)
                if line:
                    to.append(line)
            walk(c, notes if t == "notes" else to)

    walk(ET.fromstring(archive.read("content.xml")), lines)
    return "\n".join(lines + notes)


def _chapters(archive: zipfile.ZipFile) -> list[str]:
    """The pages of a book in reading order."""
    package = next(_all(ET.fromstring(archive.read("META-INF/container.xml")), "rootfile")).attrib["full-path"]
    book = ET.fromstring(archive.read(package))
    items = {i.attrib["id"]: i.attrib["href"] for i in _all(book, "item")}
    names = set(archive.namelist())
    paths = [posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(items[r.attrib["idref"]]))) for r in _all(book, "itemref") if r.attrib.get("idref") in items]
    return [archive.read(p).decode("utf-8", "replace") for p in paths if p in names]


def _read(name: str, kind: str, content: bytes) -> tuple[list[str], dict[str, str]]:
    """Parts of the text, none of a broken file, and what the file says of itself."""
    try:
        if kind == "pdf":
            pdf = Pdf(content)
            return pdf.pages(), pdf.info()
        with zipfile.ZipFile(io.BytesIO(content)) as a:
            if kind == "book":
                return _chapters(a), {}
            read = word_text if name.lower().endswith(".docx") else slides_text if name.lower().endswith(".pptx") else open_document_text
            return [read(a)], {}
    except Exception:  # whatever a broken file does to a parser, other files are read
        return [], {}


def texts(files: DataFrame) -> DataFrame:
    """(name, path, modified, kind, text, creator, title, reason) of office, PDF and book files (name, path, modified, content, kind).

    A PDF's pages are joined directly, a book's chapters by an empty line.  A
    file without text, a broken one among them, has a null text and a reason.
    Creator and title are those that a PDF states.
    """
    wanted = files.filter(F.col("kind").isin("office", "pdf", "book"))
    schema = "name string, path string, modified timestamp, kind string, parts array<string>, creator string, title string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_read(n or "", k, c.as_py() or b"") for n, k, c in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4))]
            more = [pa.array([parts for parts, _ in found], pa.list_(pa.string())), *(pa.array([said.get(k) for _, said in found], pa.string()) for k in ("Creator", "Title"))]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *more], ["name", "path", "modified", "kind", "parts", "creator", "title"])

    x = wanted.select("name", "path", "modified", "kind", "content").mapInArrow(run, schema)
    text = F.when(F.col("kind") == "book", F.array_join(F.transform("parts", inner_text), "\n\n")).otherwise(F.array_join("parts", ""))
    x = x.withColumn("text", F.when(F.regexp_replace(text, r"\s+", "") != "", text)).drop("parts")
    return x.withColumn("reason", F.when(F.col("text").isNull(), F.concat(F.lit("No text content found in "), "name", F.lit("."))))


def documents(read: DataFrame) -> DataFrame:
    """Documents of :func:`texts`; files without text have none."""
    kind = F.when(extension(F.col("name")) == ".docx", "docx").otherwise(F.col("kind"))
    source = F.coalesce(*(F.when(kind == k, v) for k, v in SOURCES.items()))
    book = F.col("kind") == "book"
    author = F.when(book, "Unknown").otherwise(F.coalesce("creator", F.lit("no author found")))
    about = F.when(book, "Unknown").otherwise(F.coalesce(F.col("title"), F.lit("No description found.")))
    x = read.filter("text IS NOT NULL")
    return x.select(*document(F.col("name"), F.col("text"), F.concat(F.lit("file://"), "path"), source, F.col("modified").cast("string"), author, about))


# --- sheets


def _number(text: str) -> str:
    """A number as its shortest text: no fraction if it has none."""
    x = float(text)
    return str(int(x)) if x.is_integer() and abs(x) < 1e21 else repr(x)


def _at(reference: str) -> tuple[int, int]:
    """Row and column, from 1, of a cell's address."""
    m = re.fullmatch(r"\$?([A-Z]+)\$?(\d+)", reference)
    column = 0
    for c in m[1]:
        column = column * 26 + ord(c) - 64
    return int(m[2]), column


def _strings(archive: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    kept = lambda e: "".join(t.text or "" for r in e for t in ([r] if _tag(r) == "t" else r.findall("{*}t") if _tag(r) == "r" else []))
    return [kept(e) for e in ET.fromstring(archive.read("xl/sharedStrings.xml")).findall("{*}si")]


def _sheets(archive: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, path) of the sheets in the workbook's order."""
    to = {r.attrib["Id"]: r.attrib["Target"] for r in ET.fromstring(archive.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in _all(ET.fromstring(archive.read("xl/workbook.xml")), "sheet"):
        target = to[next(v for k, v in s.attrib.items() if k.endswith("}id"))]
        out.append((s.attrib["name"], target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))))
    return out


def _cell(c: ET.Element, strings: list[str]) -> tuple[str | None, bool]:
    kind, v = c.attrib.get("t", "n"), c.find("{*}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _all(c, "t")), True
    if v is None or v.text is None or kind == "e":
        return None, False
    if kind == "s":
        return strings[int(v.text)], True
    if kind == "b":
        return ("true" if v.text == "1" else "false"), False
    return (_number(v.text), False) if kind == "n" else (v.text, True)


def _rows(archive: zipfile.ZipFile, path: str, strings: list[str]) -> Iterator[tuple[int, dict[int, tuple[str | None, bool]]]]:
    """(row, cells by column) of a sheet, read as a stream."""
    at = 0
    with archive.open(path) as f:
        for _, e in ET.iterparse(f):
            if _tag(e) != "row":
                continue
            at = int(e.attrib.get("r", at + 1))
            cells, column = {}, 0
            for c in e.findall("{*}c"):
                column = _at(c.attrib["r"])[1] if "r" in c.attrib else column + 1
                value = _cell(c, strings)
                if value[0] is not None:
                    cells[column] = value
            yield at, cells
            e.clear()


def _lines(rows: Iterator[tuple[int, dict]]) -> Iterator[tuple[int, list[tuple[str | None, bool]]]]:
    """Rows from the first one and the first column that have a value to the last; rows and cells between are empty."""
    held = [(r, c) for r, c in rows if c]
    if not held:
        return
    left, at = min(min(c) for _, c in held), held[0][0]
    for r, cells in held:
        for gap in range(at, r):
            yield gap, []
        yield r, [cells.get(k, (None, False)) for k in range(left, max(cells) + 1)]
        at = r + 1


def sheet_rows(files: DataFrame) -> DataFrame:
    """(file, sheet, sheet_ix, place, cells) of the sheets of workbooks (name, content), for :func:`files.sheet_text`.

    ``cells``: array of struct(value, is_text).  A sheet that can't be read is
    left out, as is a broken workbook.
    """
    cell = pa.struct([("value", pa.string()), ("is_text", pa.bool_())])
    names = ["file", "sheet", "sheet_ix", "place", "cells"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(cell)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def workbook(name: str, content: bytes) -> Iterator[list[tuple]]:
        with zipfile.ZipFile(io.BytesIO(content)) as a:
            strings = _strings(a)
            for i, (sheet, path) in enumerate(_sheets(a)):
                try:
                    lines = list(_lines(_rows(a, path, strings)))
                except Exception:  # a sheet that can't be read
                    continue
                for k in range(0, len(lines), SHEET_ROWS):
                    yield [(name, sheet, i, place, [{"value": v, "is_text": t} for v, t in cells]) for place, cells in lines[k : k + SHEET_ROWS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    for rows in workbook(name, content.as_py() or b""):
                        yield batch(rows)
                except Exception:  # a broken workbook
                    continue

    return files.select("name", "content").mapInArrow(run, "file string, sheet string, sheet_ix int, place bigint, cells array<struct<value:string,is_text:boolean>>")


def zipped(parts: Callable[[list[str]], dict[str, str]], texts_: Column) -> Column:
    """A zip archive made of an array of texts by ``parts`` (path to content)."""

    @F.arrow_udf("binary")
    def make(column: pa.Array) -> pa.Array:
        out = []
        for t in column.to_pylist():
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as a:
                for path, content in parts(t or []).items():
                    a.writestr(path, content)
            out.append(held.getvalue())
        return pa.array(out, pa.binary())

    return make(texts_)
