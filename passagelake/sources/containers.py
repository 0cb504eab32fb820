"""PDF and DOCX: unpack one file into pages or paragraphs of raw text.

Only the container is opened here, one file per row inside a Spark task; cleaning,
paragraphs and everything later are Column expressions. PDF support covers text drawn
with the ordinary text operators in plain or deflated streams; other files are
reported as holding no selectable text.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd

NO_PDF_TEXT = "No selectable text found. The PDF is probably a scan; OCR is out of scope."
NO_DOCX_TEXT = "The document contains no readable text."
LOCKED_PDF = "The PDF is password protected."
COMPOSITE_PDF = "The PDF's text is drawn in composite fonts, which are not read."

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R")
_OPERATION = re.compile(
    rb"\((?P<text>(?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*)\)"
    rb"|<(?P<hex>[0-9A-Fa-f\s]*)>"
    rb"|(?P<number>[-+]?\d*\.?\d+)"
    rb"|(?P<open>\[)|(?P<close>\])"
    rb"|(?P<name>/[^\s/\[\]()<>]*)"
    rb"|(?P<operator>[A-Za-z'\"][A-Za-z0-9*]*|'|\")",
    re.S,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


#: what one stream or part may unpack to; more is refused, not read
MAX_UNPACKED = 256 << 20


def _inflate(data: bytes) -> bytes:
    unpacking = zlib.decompressobj()
    out = unpacking.decompress(data, MAX_UNPACKED)
    if unpacking.unconsumed_tail:
        raise TooLarge("A part of the file unpacks to more than is read.")
    return out


class TooLarge(Exception):
    """The file is refused as a whole."""


def _literal(raw: bytes) -> str:
    def plain(match):
        code = match.group(1)
        if code[:1] in b"01234567":
            return bytes([int(code, 8) & 0xFF])
        return b"" if code in (b"\n", b"\r\n") else _ESCAPES.get(code, code)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, raw, flags=re.S).decode("cp1252", "replace")


def _page_text(stream: bytes) -> str:
    """Text in drawing order; moving to another line starts a new line of output."""
    lines, operands, pending, wide = [""], [], [], False
    for match in _OPERATION.finditer(stream):
        kind = match.lastgroup
        value = match.group(kind)
        if kind == "text":
            pending.append(_literal(value))
        elif kind == "hex":
            digits = re.sub(rb"\s", b"", value)
            digits += b"0" * (len(digits) % 2)
            pending.append(bytes.fromhex(digits.decode()).decode("cp1252", "replace"))
        elif kind == "number":
            operands.append(float(value))
            # inside TJ a large backward step is how many writers draw a space
            if wide and operands[-1] < -200:
                pending.append(" ")
        elif kind in ("open", "close"):
            wide = kind == "open"
        elif kind == "operator":
            if value in (b"T*", b"'", b'"') or (
                value in (b"Td", b"TD") and len(operands) > 1 and operands[-1] != 0
            ) or value == b"Tm":
                lines.append("")
            if value in (b"Tj", b"TJ", b"'", b'"'):
                lines[-1] += "".join(pending)
            operands, pending = [], []
    return "\n".join(lines).strip("\n")


def pdf_pages(data: bytes) -> list[str]:
    """Text of every page, in page order."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("Could not open the PDF: missing header")
    objects = {int(number): body for number, body in _OBJECT.findall(data)}
    for body in list(objects.values()):
        if b"/ObjStm" in body.split(b"stream")[0]:
            objects.update(_packed_objects(body))
    heads = [body.split(b"stream")[0] for body in objects.values()]
    trailers = [t.split(b"startxref")[0] for t in data.split(b"trailer")[1:]]
    trailers += [h for h in heads if re.search(rb"/Type\s*/XRef\b", h)]
    if any(b"/Encrypt" in t for t in trailers):
        raise ValueError(LOCKED_PDF)
    # codes of such fonts are glyph numbers; read as letters they would be junk
    if any(re.search(rb"/Subtype\s*/Type0\b", h) for h in heads):
        raise ValueError(COMPOSITE_PDF)

    def stream(number: int) -> bytes:
        found = _STREAM.search(objects.get(number, b""))
        if not found:
            return b""
        if b"/FlateDecode" in objects[number][: found.start()]:
            return _inflate(found.group(1))
        return found.group(1)

    def leaves(number: int, seen: frozenset) -> Iterator[bytes]:
        body = objects.get(number, b"")
        kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
        if kids is None:
            yield body
            return
        for kid in _REFERENCE.findall(kids.group(1)):
            if int(kid) not in seen:
                yield from leaves(int(kid), seen | {int(kid)})

    root = re.search(rb"/Type\s*/Catalog.*?/Pages\s+(\d+)|/Pages\s+(\d+)\s+\d+\s+R", data, re.S)
    catalogs = [b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)]
    if catalogs:
        root = re.search(rb"/Pages\s+(\d+)", catalogs[-1]) or root
    if root is None:
        raise ValueError("Could not open the PDF: no page tree")
    top = int(next(g for g in root.groups() if g))
    pages = []
    for page in leaves(top, frozenset({top})):
        contents = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", page, re.S)
        numbers = _REFERENCE.findall(contents.group(1)) if contents else []
        try:
            pages.append(_page_text(b"\n".join(stream(int(n)) for n in numbers)))
        except (zlib.error, ValueError):
            pages.append("")
    return pages


def _packed_objects(body: bytes) -> dict[int, bytes]:
    found = _STREAM.search(body)
    count = re.search(rb"/N\s+(\d+)", body)
    first = re.search(rb"/First\s+(\d+)", body)
    if not (found and count and first):
        return {}
    try:
        data = _inflate(found.group(1))
    except zlib.error:
        return {}
    header = [int(n) for n in data[: int(first.group(1))].split()]
    starts = [int(first.group(1)) + offset for offset in header[1::2]] + [len(data)]
    return {n: data[starts[i] : starts[i + 1]] for i, n in enumerate(header[::2])}


def _run_text(node) -> str:
    parts = []
    for item in node.iter():
        if item.tag == f"{_W}t":
            parts.append(item.text or "")
        elif item.tag == f"{_W}tab":
            parts.append("\t")
        elif item.tag in (f"{_W}br", f"{_W}cr"):
            parts.append("\n")
    return "".join(parts)


def docx_parts(data: bytes) -> tuple[list[str], list[list[str]]]:
    """Body paragraphs, then table rows as lists of cell texts."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            if archive.getinfo("word/document.xml").file_size > MAX_UNPACKED:
                raise TooLarge("A part of the file unpacks to more than is read.")
            body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
    except Exception as problem:
        raise ValueError(f"Could not open the DOCX: {problem}") from problem
    if body is None:
        return [], []
    paragraphs = [_run_text(p) for p in body.findall(f"{_W}p")]
    rows = [
        ["\n".join(_run_text(p) for p in cell.findall(f"{_W}p")) for cell in row.findall(f"{_W}tc")]
        for table in body.findall(f"{_W}tbl")
        for row in table.findall(f"{_W}tr")
    ]
    return paragraphs, rows


UNPACKED = (
    "doc_id string, pages array<string>, paragraphs array<string>, "
    "rows array<array<string>>, problem string"
)


def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``mapInPandas`` body: (doc_id, extension, content) to raw text parts."""
    for batch in batches:
        out = []
        for doc_id, extension, content in zip(
            batch["doc_id"], batch["extension"], batch["content"], strict=True
        ):
            pages, paragraphs, rows, problem = None, None, None, None
            try:
                if extension == ".pdf":
                    pages = pdf_pages(bytes(content))
                else:
                    paragraphs, rows = docx_parts(bytes(content))
            except Exception as error:
                problem = str(error)
            out.append((doc_id, pages, paragraphs, rows, problem))
        yield pd.DataFrame(out, columns=["doc_id", "pages", "paragraphs", "rows", "problem"])
