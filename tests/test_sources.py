from __future__ import annotations

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from passagelake.operators.extract import extract, unsupported
from passagelake.operators.intake import checked_uploads, question_problem, turn_problem
from passagelake.config import Settings
from passagelake.sources.containers import docx_parts, pdf_pages
from passagelake.sources.files import read_uploads
from passagelake.sources.plain import decode_text


def pdf(pages: list[list[str]], deflate: bool = False) -> bytes:
    """A text PDF with one line per drawing operation."""
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", None]
    kids = []
    out = [b"%PDF-1.4\n"]
    objects: list[bytes] = []
    for lines in pages:
        escaped = [
            line.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") for line in lines
        ]
        drawn = "BT /F1 11 Tf 15 TL 56 700 Td\n" + "".join(f"({e}) Tj T*\n" for e in escaped) + "ET"
        data = drawn.encode("cp1252")
        kind = b""
        if deflate:
            data, kind = zlib.compress(data), b"/Filter /FlateDecode "
        number = 3 + len(objects)
        objects.append(b"<< " + kind + b"/Length %d >>\nstream\n" % len(data) + data + b"\nendstream")
        kids.append(number + 1)
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % number)
    bodies[1] = "<< /Type /Pages /Kids [%s] /Count %d >>" % (
        " ".join(f"{k} 0 R" for k in kids), len(kids),
    )
    for number, body in enumerate([b.encode() for b in bodies] + objects, start=1):
        out.append(b"%d 0 obj\n" % number + body + b"\nendobj\n")
    out.append(b"trailer << /Root 1 0 R >>\n%%EOF")
    return b"".join(out)


def docx(paragraphs: list[str], rows: list[list[str]] = ()) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'

    def p(text):
        return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"

    table = "".join(
        "<w:tr>" + "".join(f"<w:tc>{p(cell)}</w:tc>" for cell in row) + "</w:tr>" for row in rows
    )
    middle = f"<w:tbl>{table}</w:tbl>" if rows else ""
    body = p(paragraphs[0]) + middle + "".join(map(p, paragraphs[1:])) if paragraphs else middle
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return buffer.getvalue()


def blocks_of(spark, files: dict[str, bytes]):
    rows = [(n, n[n.rindex(".") :], bytearray(d)) for n, d in files.items()]
    frame = spark.createDataFrame(rows, "doc_id string, extension string, content binary")
    return {
        r["doc_id"]: ([(b["page"], b["text"]) for b in r["blocks"]], r["error"])
        for r in extract(frame).collect()
    }


def test_decoding_ladder(spark):
    cases = [
        ("naïve – ok".encode(), "naïve – ok"),
        (b"\xef\xbb\xbfmark", "﻿mark"),
        ("naïve – “x”".encode("cp1252"), "naïve – “x”"),
        (b"caf\xe9 \x81", "caf\xe9 \x81"),
        (b"a\r\nb\rc\n", "a\nb\nc\n"),
    ]
    frame = spark.createDataFrame([(i, bytearray(d)) for i, (d, _) in enumerate(cases)], "i int, c binary")
    got = {r["i"]: r["t"] for r in frame.select("i", decode_text(F.col("c")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [t for _, t in cases]


def test_pdf_pages_in_order():
    pages = [["Title (draft)", "", "Body one"], ["Body \\ two"]]
    for deflate in (False, True):
        assert pdf_pages(pdf(pages, deflate)) == ["Title (draft)\n\nBody one", "Body \\ two"]


def test_pdf_kerned_text():
    page = pdf([["x"]]).replace(b"(x) Tj T*", b"[(Wor) -20 (ld) -300 (peace)] TJ <41> Tj")
    assert pdf_pages(page) == ["World peaceA"]


def test_docx_paragraphs_then_rows():
    parts = docx_parts(docx(["One", "Two"], [["a", "", "b"]]))
    assert parts == (["One", "Two"], [["a", "", "b"]])


def test_every_kind_of_file(spark):
    got = blocks_of(
        spark,
        {
            "a.pdf": pdf([["Page one."], ["Page", "two."]]),
            "b.docx": docx(["First.", "Last."], [["Rate", " ", "5 percent"], ["", ""]]),
            "c.md": b"# Head\n\nBody",
            "d.txt": b" \n ",
            "e.pdf": b"not a pdf",
            "f.pdf": pdf([[""]]),
            "g.docx": b"PK broken",
            "h.docx": docx([" "]),
        },
    )
    assert got["a.pdf"] == ([(1, "Page one."), (2, "Page two.")], None)
    assert got["b.docx"] == ([(None, "First."), (None, "Last."), (None, "Rate | 5 percent")], None)
    assert got["c.md"] == ([(None, "# Head"), (None, "Body")], None)
    assert got["d.txt"] == ([], "The file is empty.")
    assert got["e.pdf"][1].startswith("Could not open the PDF")
    assert got["f.pdf"][1].startswith("No selectable text found")
    assert got["g.docx"][1].startswith("Could not open the DOCX")
    assert got["h.docx"][1] == "The document contains no readable text."


def test_hyphenated_lines_are_joined(spark):
    got = blocks_of(spark, {"a.txt": b"The recovery objec-\ntive is four hours."})
    assert got["a.txt"][0] == [(None, "The recovery objective is four hours.")]


def test_unsupported_kinds(spark):
    frame = spark.createDataFrame([(".rtf",), (".doc",), (".md",)], "e string")
    got = [r[0] for r in frame.select(unsupported(F.col("e"))).collect()]
    assert "Unsupported file type '.rtf'" in got[0]
    assert "save as .docx" in got[1]
    assert got[2] is None


def test_upload_checks_in_order(spark):
    rows = [
        ("photo.png", b""), ("blank.txt", b""), ("big.txt", b"x" * (1024 * 1024 + 1)), ("noext", b"x"),
        ("ok.MD", b"x"),
    ]
    frame = spark.createDataFrame([(n, bytearray(d)) for n, d in rows], "filename string, content binary")
    checked = checked_uploads(frame, Settings(max_upload_mb=1)).collect()
    got = {r["filename"]: r["rejected"] for r in checked}
    assert got["photo.png"].startswith("Unsupported file type '.png'. Supported: .docx, .md")
    assert got["blank.txt"] == "The file is empty."
    assert got["big.txt"] == "File is 1.0 MB; the limit is 1 MB."
    assert got["noext"].startswith("Unsupported file type '(none)'")
    assert got["ok.MD"] is None


@pytest.mark.parametrize(
    "question,top_k,problem",
    [("x", 1, None), ("", 1, "question is missing"), ("  ", 1, "Question must not be empty."),
     ("x" * 2001, 1, "question is too long"), ("x", 21, "top_k is out of range")],
)
def test_question_checks(spark, question, top_k, problem):
    frame = spark.createDataFrame([(question, top_k)], "q string, k int")
    assert frame.select(question_problem(F.col("q"), F.col("k"))).first()[0] == problem


def test_turn_checks(spark):
    frame = spark.createDataFrame([("user", "x"), ("system", "x"), ("user", "x" * 8001)], "r string, c string")
    got = [r[0] for r in frame.select(turn_problem(F.col("r"), F.col("c"))).collect()]
    assert got == [None, "role is unknown", "content is too long"]


def test_reads_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "sub" / "b.PDF").write_bytes(b"two")
    (tmp_path / "c.exe").write_bytes(b"three")
    got = read_uploads(spark, str(tmp_path)).collect()
    assert sorted(r["filename"] for r in got) == ["a.txt", "b.PDF"]


def test_names_are_matched_in_any_case(spark, tmp_path):
    names = ["a.Txt", "b.MD", "c.txt", "d.pDf", "e.Docx", "f.png"]
    for name in names:
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["filename"] for r in read_uploads(spark, str(tmp_path)).collect()) == names[:5]


def test_pdf_refuses_what_it_cannot_read():
    from passagelake.sources import containers as C

    page = (
        b"%PDF-1.4\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj\n2 0 obj <</Kids [3 0 R]>> endobj\n"
        b"3 0 obj <</Type /Page /Contents 4 0 R>> endobj\n4 0 obj <<>> stream\n(see /Encrypt) Tj\nendstream endobj\n"
    )
    assert C.pdf_pages(page) == ["see /Encrypt"]
    with pytest.raises(ValueError, match="password"):
        C.pdf_pages(page + b"trailer <</Encrypt 9 0 R /Root 1 0 R>>\nstartxref 0")
    with pytest.raises(ValueError, match="composite"):
        C.pdf_pages(page + b"5 0 obj <</Type /Font /Subtype /Type0 /Encoding /Identity-H>> endobj\n")
