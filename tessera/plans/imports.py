"""Registered readers of office files, PDF files, repositories, wikis and transcripts, over files made of the supplied tables."""

from __future__ import annotations

import zlib
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import files, office, repositories
from ..sources.tables import table
from .catalogue import query

_W, _A, _U = 'xmlns:w="urn:w"', 'xmlns:a="urn:a"', 'xmlns="urn:u"'


def _xml(text: str) -> str:
    return escape(text, {"\r": "&#13;", "\n": "&#10;"})


def _file(rows: DataFrame, key: str, end: str, kind: str, content: Column) -> DataFrame:
    name = F.concat(F.col(key).cast("string"), F.lit(end))
    return rows.select(name.alias("name"), name.alias("path"), F.timestamp_seconds(F.lit(0)).alias("modified"), content.alias("content"), F.lit(kind).alias("kind"))


def _number(read: DataFrame, key: str) -> DataFrame:
    return read.select(F.regexp_extract("name", r"^(\d+)", 1).cast("bigint").alias(key), "text")


def _talks(s, d) -> DataFrame:
    c = table(s, d, "conversations").filter("text IS NOT NULL")
    return c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t")).select("conv_id", F.transform("t", lambda t: t["text"]).alias("texts"))


def _word_file(texts: list[str]) -> dict[str, str]:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_xml(t)}</w:t></w:r></w:p>' for t in texts)
    return {"word/document.xml": f"<w:document {_W}><w:body>{body}</w:body></w:document>"}


@query("SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) AS text FROM documents WHERE regexp_replace(text, '\\s+', '', 'g') <> ''")
def word_texts(s, d):
    x = _file(table(s, d, "documents"), "doc_id", ".docx", "office", office.zipped(_word_file, F.split("text", "\n")))
    return _number(office.texts(x).filter("text IS NOT NULL"), "doc_id")


def _slides(texts: list[str]) -> dict[str, str]:
    return {f"ppt/slides/slide{i}.xml": f"<sld {_A}><a:p><a:t>{_xml(t)}</a:t></a:p></sld>" for i, t in enumerate(texts, 1)}


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS text FROM conversations GROUP BY conv_id HAVING regexp_replace(string_agg(text, ''), '\\s+', '', 'g') <> ''")
def slide_texts(s, d):
    x = _file(_talks(s, d), "conv_id", ".pptx", "office", office.zipped(_slides, F.col("texts")))
    return _number(office.texts(x).filter("text IS NOT NULL"), "conv_id")


def _open_document(texts: list[str]) -> dict[str, str]:
    return {"content.xml": f"<body {_U}>" + "".join(f"<p>{_xml(t)}</p>" for t in texts) + "</body>"}


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (text <> '') AS text FROM conversations GROUP BY conv_id HAVING regexp_replace(string_agg(text, ''), '\\s+', '', 'g') <> ''")
def open_document_texts(s, d):
    x = _file(_talks(s, d), "conv_id", ".odt", "office", office.zipped(_open_document, F.col("texts")))
    return _number(office.texts(x).filter("text IS NOT NULL"), "conv_id")


def _book(texts: list[str]) -> dict[str, str]:
    items = "".join(f'<item id="c{i}" href="c{i}.xhtml"/>' for i in range(len(texts)))
    spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(texts)))
    return {
        "META-INF/container.xml": f'<container {_U}><rootfiles><rootfile full-path="b.opf"/></rootfiles></container>',
        "b.opf": f"<package {_U}><manifest>{items}</manifest><spine>{spine}</spine></package>",
        **{f"c{i}.xhtml": f"<html><head><title>x</title></head><body><p>{escape(t)}</p></body></html>" for i, t in enumerate(texts)},
    }


@query("SELECT conv_id, string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id HAVING regexp_replace(string_agg(text, ''), '\\s+', '', 'g') <> ''")
def book_texts(s, d):
    x = _file(_talks(s, d), "conv_id", ".epub", "book", office.zipped(_book, F.col("texts")))
    return _number(office.texts(x).filter("text IS NOT NULL"), "conv_id")


def _workbook(texts: list[str]) -> dict[str, str]:
    """Names and numbers by turns, a row of each two; a number of 0 has no cell."""
    rows = "".join(
        f'<row r="{i + 1}"><c r="A{i + 1}" t="s"><v>{i}</v></c>' + (f'<c r="B{i + 1}"><v>{texts[2 * i + 1]}</v></c>' if texts[2 * i + 1] != "0" else "") + "</row>"
        for i in range(len(texts) // 2)
    )
    return {
        "xl/workbook.xml": f'<workbook {_U} xmlns:r="urn:r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {_U}><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {_U}>" + "".join(f"<si><t>{_xml(t)}</t></si>" for t in texts[::2]) + "</sst>",
        "xl/worksheets/s.xml": f"<worksheet {_U}><sheetData>{rows}</sheetData></worksheet>",
    }


@query("SELECT p_brand AS brand, 'S' AS sheet, string_agg(CASE WHEN p_size > 40 THEN '\"' || p_name || ',x\"' ELSE p_name END || CASE WHEN p_size % 5 = 0 THEN '' ELSE ',' || p_size END, chr(10) ORDER BY p_partkey) AS content FROM part GROUP BY p_brand")
def workbook_texts(s, d):
    size = F.col("p_size")
    pair = F.array(F.when(size > 40, F.concat("p_name", F.lit(",x"))).otherwise(F.col("p_name")), F.when(size % 5 == 0, "0").otherwise(size.cast("string")))
    x = table(s, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", pair.alias("c")))).alias("r"))
    books = x.select(F.col("p_brand").alias("name"), office.zipped(_workbook, F.flatten(F.transform("r", lambda r: r["c"]))).alias("content"))
    return files.sheet_text(office.sheet_rows(books), ["file", "sheet"], "place", "cells").select(F.col("file").alias("brand"), "sheet", "content")


def _pdf(pages: list[str]) -> bytes:
    """A file with a page for each text, its characters as code units under a map that says so."""
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    out = [b"%PDF-1.7\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Resources<</Font<</F 3 0 R>>>>/Kids[" + b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages))) + b"]>>endobj\n"]
    out.append(b"3 0 obj<</Type/Font/Subtype/Type0/ToUnicode 4 0 R>>endobj\n4 0 obj<</Length %d>>stream\n%s\nendstream endobj\n" % (len(cmap), cmap))
    for i, t in enumerate(pages):
        lines = b" T* ".join(b"<" + line.encode("utf-16-be").hex().encode() + b"> Tj" for line in t.split("\n"))
        body = zlib.compress(b"BT /F 10 Tf 12 TL 50 700 Td " + lines + b" ET")
        out.append(b"%d 0 obj<</Type/Page/Contents %d 0 R>>endobj\n%d 0 obj<</Filter/FlateDecode/Length %d>>stream\n%s\nendstream endobj\n" % (5 + 2 * i, 6 + 2 * i, 6 + 2 * i, len(body), body))
    return b"".join(out) + b"trailer<</Root 1 0 R>>\n%%EOF"


def pdf_files(texts: Column) -> Column:
    @F.arrow_udf("binary")
    def make(column: pa.Array) -> pa.Array:
        return pa.array([_pdf(t or []) for t in column.to_pylist()], pa.binary())

    return make(texts)


@query("SELECT conv_id, string_agg(trim(regexp_replace(text, '\\n+', chr(10), 'g'), ' ' || chr(10)), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id HAVING regexp_replace(string_agg(text, ''), '\\s+', '', 'g') <> ''")
def pdf_texts(s, d):
    x = _file(_talks(s, d), "conv_id", ".pdf", "pdf", pdf_files(F.col("texts")))
    return _number(office.texts(x).filter("text IS NOT NULL"), "conv_id")


# --- repositories, wikis, transcripts


@query("SELECT 'github://' || p AS url, p AS title, t AS words FROM (SELECT source || '/' || lang || '/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.md' ELSE '.log' END AS p, lang, doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS t FROM documents WHERE text <> '') WHERE (doc_id % 3 = 0 OR p LIKE 'src1/%/7.log') AND lang <> 'de'")
def repository_files(s, d):
    i = F.col("doc_id")
    path = F.concat_ws("/", "source", "lang", F.concat(i.cast("string"), F.when(i % 3 == 0, ".md").otherwise(".log")))
    x = repositories.repository_files(table(s, d, "documents").select(path.alias("path"), F.col("text").alias("content")), "me", "github", ["# kept small", "*.log", "!src1/*/7.log", "de/", "!**/de/1.md"])
    return x.select("url", "title", F.col("wordCount").alias("words"))


@query("SELECT '# ' || o_orderkey || ' (' || o_orderkey || ')' || chr(10) || chr(10) || 'null' || chr(10) || chr(10) || '## Metadata' || chr(10) || chr(10) || '- state: ' || o_orderstatus || chr(10) || '- created at: ' || CAST(o_orderdate AS VARCHAR) || coalesce(chr(10) || '- labels:' || chr(10) || l, '') || coalesce(chr(10) || chr(10) || '## Activity' || chr(10) || chr(10) || a || chr(10), '') AS text FROM (SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders) LEFT JOIN (SELECT l_orderkey, string_agg('  - ' || l_linenumber, chr(10) ORDER BY l_linenumber) AS l, string_agg('u' || l_linenumber || ' at t:' || chr(10) || l_linenumber || ',' || 'x at t:' || chr(10) || 'ok', chr(10) || chr(10) ORDER BY l_linenumber) AS a FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def issue_texts(s, d):
    lines = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda n: n.cast("string")).alias("n"))
    x = table(s, d, "orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").cast("string").alias("at")).join(lines, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.array().cast("array<string>")))
    talks = F.transform("n", lambda n: F.array(repositories.note_text(F.concat(F.lit("u"), n), F.lit("t"), n), repositories.note_text(F.lit("x"), F.lit("t"), F.lit("ok"))))
    none = F.lit(None).cast("string")
    fields = {"state": F.col("o_orderstatus"), "created_at": F.col("at"), "closed_at": none, "upvotes": F.lit("0")}
    return x.select(repositories.issue_text(F.col("o_orderkey"), F.col("o_orderkey").cast("string"), none, fields, {"labels": F.col("n")}, talks).alias("text"))


@query("SELECT 'gitlab://wiki-r-' || doc_id AS url, 'GitLab Wiki Page' || CASE WHEN lang = 'en' THEN ' (Markdown)' ELSE '' END AS description, CAST(len(string_split(text, ' ')) AS INTEGER) AS words FROM documents WHERE text <> ''")
def repository_wiki(s, d):
    x = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("slug"), F.col("source").alias("title"), F.when(F.col("lang") == "en", "markdown").alias("format"), F.col("text").alias("content"))
    return repositories.wiki_pages(x, "r", "me").select("url", "description", F.col("wordCount").alias("words"))


@query("SELECT 'wiki.example.' || c_nationkey || '.' || c_custkey || '.5' AS id, CASE WHEN c_nationkey = 3 THEN c_name ELSE upper(c_mktsegment) || ' X' || chr(10) || c_name END AS text FROM customer")
def wiki_bodies(s, d):
    body = F.concat(F.lit("<table><tr><th class='a'>"), F.lower("c_mktsegment"), F.lit(" <b>x</b></TH></tr><tr><td>"), "c_name", F.lit("</td></tr></table>"))
    return table(s, d, "customer").select(
        repositories.wiki_page_id(F.lit("wiki.example"), F.col("c_nationkey"), F.col("c_custkey"), F.lit(5)).alias("id"),
        repositories.wiki_body(F.when(F.col("c_nationkey") == 3, " ").otherwise(body), F.col("c_name")).alias("text"),
    )


@query("SELECT conv_id, trim(regexp_replace(string_agg(text || '!', ' ' ORDER BY turn), '\\s+', ' ', 'g')) AS text FROM conversations GROUP BY conv_id")
def transcripts(s, d):
    run = lambda t: F.struct(F.struct(F.struct(F.array(F.struct(t.alias("text")), F.struct(F.lit("!").alias("text"))).alias("runs")).alias("snippet")).alias("transcriptSegmentRenderer"))
    held = F.transform("texts", run)
    for name in ("initialSegments", "transcriptSegmentListRenderer", "body", "transcriptSearchPanelRenderer", "content", "transcriptRenderer", "content", "updateEngagementPanelAction"):
        held = F.struct(held.alias(name))
    answer = F.to_json(F.struct(F.array(held).alias("actions")))
    return _talks(s, d).select("conv_id", repositories.transcript(answer).alias("text"))


@query("SELECT CAST(range AS BIGINT) AS id, 'r' || range AS name FROM range(1, 251)")
def paged_rows(s, d):
    """A source of 250 rows in pages of 100."""
    fetch = lambda page: ([(i, f"r{i}") for i in range(100 * page - 99, min(100 * page, 250) + 1)], 3)
    return repositories.read_pages(s, "tessera_numbers", "id bigint, name string", fetch)
