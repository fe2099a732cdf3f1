from __future__ import annotations

import io
import random
import zipfile
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="urn:mc"'
A = 'xmlns:a="urn:a" xmlns:p="urn:p"'
O = 'xmlns:office="urn:o" xmlns:text="urn:t" xmlns:presentation="urn:p" xmlns:draw="urn:d"'


def zipped(parts: dict[str, str]) -> bytes:
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as a:
        for k, v in parts.items():
            a.writestr(k, v)
    return held.getvalue()


def pdf(*bodies: bytes, extra: bytes = b"", deflate: bool = True) -> bytes:
    out = [b"%PDF-1.5\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(bodies))) + b"]/Resources<</Font<</F1 3 0 R/F2 4 0 R>>/XObject<</X 6 0 R>>>>>>endobj\n"]
    out.append(b"3 0 obj<</Type/Font/Subtype/Type1/Encoding<</BaseEncoding/WinAnsiEncoding/Differences[1/eacute/fi/uni0416]>>>>endobj\n")
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfchar <0001> <D83DDE00> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0078> <0079007A>] endbfrange"
    out.append(b"4 0 obj<</Type/Font/Subtype/Type0/ToUnicode 5 0 R>>endobj\n5 0 obj<</Length %d>>stream\n" % len(cmap) + cmap + b"\nendstream endobj\n")
    out.append(b"6 0 obj<</Subtype/Form/Length 40>>stream\nBT /F1 9 Tf 1 0 0 1 5 5 Tm (form) Tj ET /X Do\nendstream endobj\n7 0 obj<</Creator(me)/Title<FEFF00E9>>>endobj\n")
    for i, b in enumerate(bodies):
        data = zlib.compress(b) if deflate else b
        out.append(b"%d 0 obj<</Type/Page/Parent 2 0 R/Contents[%d 0 R]>>endobj\n%d 0 obj<</Length %d%s>>stream\r\n" % (10 + 2 * i, 11 + 2 * i, 11 + 2 * i, len(data), b"/Filter/FlateDecode" if deflate else b"") + data + b"\nendstream endobj\n")
    return b"".join(out) + extra + b"trailer<</Root 1 0 R/Info 7 0 R>>"


ONE = b"BT /F1 12 Tf 72 700 Td (Hello \\(w\\)orld\\041) Tj 0 -14 Td [(A) -300 (B) 20 (C)] TJ 14 TL T* <010203> Tj ET q 2 0 0 2 0 9 cm /X Do Q"
TWO = b"% note\nBT /F2 10 Tf 1 0 0 1 10 50 Tm <0001001000110012> Tj 200 0 Td <00200021> Tj ET BI /W 1 ID \x00(x) Tj EI BT /F1 1 Tf 0 0 Td (end) ' ET"


def test_pdf_pages():
    from tessera.sources.pdf import Pdf, glyph

    for deflate in (True, False):
        p = Pdf(pdf(ONE, b"", TWO, deflate=deflate))
        assert p.pages() == ["Hello (w)orld!\nA BC\néfiЖ\nform", "\U0001f600ABC xyz\nend"]
        assert p.info() == {"Creator": "me", "Title": "é"}
    assert [glyph(n) for n in ("A", "comma", "Odieresis", "uni00e5", "g17", "a.alt")] == ["A", ",", "Ö", "å", "", "a"]
    with pytest.raises(ValueError):
        Pdf(b"text")
    with pytest.raises(ValueError):
        Pdf(pdf(ONE) + b" trailer<</Encrypt 9 0 R>>")
    held = b"20 0 21 37 <</Type/Catalog/Pages 21 0 R>>      <</Type/Pages/Kids[22 0 R]>>"
    first = held.index(b"<<")
    held = b"20 0 21 %d " % (held.index(b"<</Type/Pages") - first) + held[first:]
    packed = b"%PDF-1.5\n9 0 obj<</Type/ObjStm/N 2/First " + str(held.index(b"<<")).encode() + b"/Filter/FlateDecode/Length 1>>stream\n" + zlib.compress(held) + b"\nendstream endobj\n22 0 obj<</Type/Page/Contents 23 0 R/Resources<</Font<</F 24 0 R>>>>>>endobj 23 0 obj<<>>stream\nBT /F 1 Tf (packed) Tj ET\nendstream endobj 24 0 obj<</Subtype/TrueType>>endobj 8 0 obj<</Type/XRef/Root 20 0 R>>stream\n\nendstream endobj"
    assert Pdf(packed).pages() == ["packed"]


def test_broken_files_stop_nothing():
    from tessera.sources.office import _read

    r = random.Random(3)
    whole = {"a.pdf": ("pdf", pdf(ONE, TWO, deflate=False)), "b.docx": ("office", zipped({"word/document.xml": f"<w:document {W}><w:body><w:p/></w:body></w:document>"}))}
    for name, (kind, data) in whole.items():
        for _ in range(400):
            b = bytearray(data)
            for _ in range(r.randrange(1, 9)):
                b[r.randrange(len(b))] = r.randrange(256)
            parts, said = _read(name, kind, bytes(b[: r.randrange(len(b))] if r.random() < 0.3 else b))
            assert isinstance(parts, list) and isinstance(said, dict)


def test_texts_and_documents(spark):
    from tessera.sources import office

    docx = zipped({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>one</w:t><w:tab/><w:t> two</w:t><w:br/></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del></w:p><w:tbl><w:tr><w:tc><w:p><w:ins><w:r><w:t>cell</w:t></w:r></w:ins></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><mc:AlternateContent><mc:Choice><w:p><w:r><w:t>box</w:t></w:r></w:p></mc:Choice><mc:Fallback><w:p><w:r><w:t>box</w:t></w:r></w:p></mc:Fallback></mc:AlternateContent><w:t>last</w:t></w:r></w:p></w:body></w:document>'})
    slide = lambda t: f"<p:sld {A}><a:p><a:r><a:t>{t}</a:t></a:r><a:r><a:t>!</a:t></a:r></a:p><a:p/></p:sld>"
    pptx = zipped({"ppt/slides/slide10.xml": slide("ten"), "ppt/slides/slide2.xml": slide("two"), "ppt/notesSlides/notesSlide2.xml": slide("note"), "ppt/slides/_rels/slide2.xml.rels": "x"})
    odt = zipped({"content.xml": f'<office:body {O}><text:h>Head</text:h><text:p>a<text:s text:c="2"/>b<text:tab/><text:span>c</text:span>d</text:p><text:p/><presentation:notes><text:p>note</text:p></presentation:notes><text:p>end</text:p></office:body>'})
    epub = zipped({
        "META-INF/container.xml": '<container xmlns="u"><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>',
        "O/b.opf": '<package xmlns="u"><manifest><item id="a" href="t/a%20b.xhtml"/><item id="b" href="b.xhtml"/><item id="c" href="no.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="c"/></spine></package>',
        "O/t/a b.xhtml": "<html><body><h1>Second</h1><p>x &amp; y</p></body></html>", "O/b.xhtml": "<html><head><title>t</title></head><body><p>First</p></body></html>",
    })
    rows = [("a.docx", "office", docx), ("B.PPTX", "office", pptx), ("c.odt", "office", odt), ("d.epub", "book", epub), ("e.pdf", "pdf", pdf(ONE)), ("f.docx", "office", b"junk"), ("g.pdf", "pdf", None), ("h.txt", "text", b"x"), ("i.odp", "office", zipped({"content.xml": f"<office:body {O}><text:p> </text:p></office:body>"}))]
    at = datetime(2024, 1, 2)
    files = spark.createDataFrame([(n, "/f/" + n, at, None if c is None else bytearray(c), k) for n, k, c in rows], "name string, path string, modified timestamp, content binary, kind string")
    got = {r.name: r for r in office.texts(files).collect()}
    assert {n: r.text for n, r in got.items()} == {
        "a.docx": "one\t two\n\ncell\n\n\n\nlast\n\nbox\n\n", "B.PPTX": "two!\nnote!\nten!", "c.odt": "Head\na  b\tcd\nend\nnote", "d.epub": "First\n\nSecond\nx & y",
        "e.pdf": "Hello (w)orld!\nA BC\néfiЖ\nform", "f.docx": None, "g.pdf": None, "i.odp": None,
    }
    assert got["f.docx"].reason == "No text content found in f.docx." and got["a.docx"].reason is None
    docs = {r.title: r for r in office.documents(office.texts(files)).collect()}
    assert sorted(docs) == ["B.PPTX", "a.docx", "c.odt", "d.epub", "e.pdf"]
    assert (docs["e.pdf"].docAuthor, docs["e.pdf"].description) == ("me", "é") and docs["d.epub"].docAuthor == "Unknown" and docs["c.odt"].docAuthor == "no author found"
    assert docs["B.PPTX"].docSource == "Office file uploaded by the user." and docs["a.docx"].docSource == "pdf file uploaded by the user." and docs["a.docx"].url == "file:///f/a.docx"


def test_sheets(spark):
    from tessera.sources import files, office

    sheet = lambda rows: f'<worksheet xmlns="u"><sheetData>{rows}</sheetData></worksheet>'
    book = zipped({
        "xl/workbook.xml": '<workbook xmlns="u" xmlns:r="q"><sheets><sheet name="Z" r:id="r2"/><sheet name="A" r:id="r1"/><sheet name="none" r:id="r3"/><sheet name="bad" r:id="r4"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="u"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/><Relationship Id="r3" Target="worksheets/s3.xml"/><Relationship Id="r4" Target="worksheets/s4.xml"/></Relationships>',
        "xl/sharedStrings.xml": '<sst xmlns="u"><si><t>plain</t></si><si><r><t>a,</t></r><r><t>"b"</t></r><rPh><t>no</t></rPh></si></sst>',
        "xl/worksheets/s1.xml": sheet('<row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2"><v>1.0</v></c></row><row r="4"><c r="C4" t="s"><v>1</v></c><c r="D4"/><c r="E4" t="b"><v>1</v></c><c r="AA4" t="e"><v>#N/A</v></c></row>'),
        "xl/worksheets/s2.xml": sheet('<row><c t="inlineStr"><is><t>in</t></is></c><c t="str"><v>f,x</v></c><c><v>0.1</v></c><c><v>-2E+3</v></c></row>'),
        "xl/worksheets/s3.xml": sheet(""), "xl/worksheets/s4.xml": "<worksheet",
    })
    df = spark.createDataFrame([("b.xlsx", bytearray(book)), ("j.xlsx", bytearray(b"junk")), ("n.xlsx", None)], "name string, content binary")
    rows = office.sheet_rows(df)
    got = files.sheet_text(rows, ["file", "sheet"], "place", "cells")
    assert {r.sheet: r.content for r in got.collect()} == {"A": 'plain,,1\n\n,"a,"b"",,true', "Z": 'in,"f,x",0.1,-2000'}
    assert {r.sheet: r.sheet_ix for r in rows.collect()} == {"Z": 0, "A": 1}
    assert files.sheet_documents(got, F.lit("now")).count() == 2
