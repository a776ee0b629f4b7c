"""Word-processor documents (DOCX): their paragraphs, the document again with other texts, and new ones from pages."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

from leafstream.sources.plain import translatable

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
XML_SPACE = "{http://www.w3.org/XML/1998/namespace}space"
BODY = "word/document.xml"
FONT = "Vazirmatn"


def _namespaces(data: bytes) -> None:
    """Prefixes as the file has them, so that what refers to them by name still holds."""
    for prefix, uri in re.findall(rb'xmlns:(\w+)="([^"]+)"', data):
        if not re.fullmatch(rb"ns\d+", prefix):
            ET.register_namespace(prefix.decode(), uri.decode())


def _parts(book: zipfile.ZipFile) -> list[str]:
    """The body, then the headers and footers that its sections name, each once, in order."""
    names = set(book.namelist())
    out = [BODY]
    rels_at = "word/_rels/document.xml.rels"
    if rels_at in names:
        targets = {r.get("Id"): r.get("Target", "") for r in ET.fromstring(book.read(rels_at))}
        for e in ET.fromstring(book.read(BODY)).iter():
            if e.tag in (W + "headerReference", W + "footerReference") and e.get(W + "type", "default") == "default":
                at = posixpath.normpath(posixpath.join("word", targets.get(e.get(R + "id"), "")))
                if at in names and at not in out:
                    out.append(at)
    return out


def _direct(container: ET.Element) -> Iterator[ET.Element]:
    """A container's own paragraphs, then those of its tables, cell by cell."""
    yield from (e for e in container if e.tag == W + "p")
    for table in (e for e in container if e.tag == W + "tbl"):
        for row in (e for e in table if e.tag == W + "tr"):
            for cell in (e for e in row if e.tag == W + "tc"):
                yield from _direct(cell)


def _paragraphs(root: ET.Element) -> Iterator[tuple[int, ET.Element, list[ET.Element], str]]:
    container = root.find(W + "body") if root.tag == W + "document" else root
    for no, p in enumerate(_direct(container if container is not None else root)):
        runs = list(p.iter(W + "t"))
        text = "".join(t.text or "" for t in runs)
        if translatable(text):
            yield no, p, runs, text


def paragraphs(content: bytes) -> list[tuple[str, str, str]]:
    """(part, paragraph number, text) of the paragraphs worth rendering: body, tables, headers, footers."""
    book = zipfile.ZipFile(io.BytesIO(content))
    return [
        (part, str(no), text.strip()) for part in _parts(book) for no, _, _, text in _paragraphs(ET.fromstring(book.read(part)))
    ]


def _first(parent: ET.Element, tag: str) -> ET.Element:
    found = parent.find(tag)
    if found is None:
        found = ET.Element(tag)
        parent.insert(0, found)
    return found


def _right_to_left(paragraph: ET.Element) -> None:
    _mark(_first(paragraph, W + "pPr"), W + "bidi")
    for run in paragraph.iter(W + "r"):
        _mark(_first(run, W + "rPr"), W + "rtl")


def _mark(parent: ET.Element, tag: str) -> None:
    if parent.find(tag) is None:
        ET.SubElement(parent, tag)


def rebuild(content: bytes, results: dict[int, str]) -> bytes:
    """A document with the results in place of its paragraphs' texts, those right to left; the text goes to a
    paragraph's first run. Paragraphs without a result, and all other parts, stay as they are."""
    book = zipfile.ZipFile(io.BytesIO(content))
    done: dict[str, bytes] = {}
    number = 0
    for part in _parts(book):
        data = book.read(part)
        _namespaces(data)
        root = ET.fromstring(data)
        for _, paragraph, runs, _text in list(_paragraphs(root)):
            if number in results:
                runs[0].text = results[number]
                runs[0].set(XML_SPACE, "preserve")
                for run in runs[1:]:
                    run.text = ""
                _right_to_left(paragraph)
            number += 1
        done[part] = ET.tostring(root, encoding="utf-8", xml_declaration=True)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        for info in book.infolist():
            target.writestr(info, done.get(info.filename, book.read(info.filename)))
    return out.getvalue()


_TYPES = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" '
    'ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
_RELATIONS = (
    '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def from_pages(pages: list[list[str]]) -> bytes:
    """A new document: each page's paragraphs, justified and right to left, with a page break between pages."""
    ET.register_namespace("w", W[1:-1])
    root = ET.Element(W + "document")
    body = ET.SubElement(root, W + "body")
    for no, page in enumerate(pages or ()):
        if no:
            run = ET.SubElement(ET.SubElement(body, W + "p"), W + "r")
            ET.SubElement(run, W + "br").set(W + "type", "page")
        for text in page or ():
            paragraph = ET.SubElement(body, W + "p")
            look = ET.SubElement(paragraph, W + "pPr")
            ET.SubElement(look, W + "bidi")
            ET.SubElement(look, W + "jc").set(W + "val", "both")
            run = ET.SubElement(paragraph, W + "r")
            look = ET.SubElement(run, W + "rPr")
            ET.SubElement(look, W + "rFonts").set(W + "cs", FONT)
            ET.SubElement(look, W + "szCs").set(W + "val", "24")
            ET.SubElement(look, W + "rtl")
            piece = ET.SubElement(run, W + "t")
            piece.text = text
            piece.set(XML_SPACE, "preserve")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        body_part = ET.tostring(root, encoding="utf-8", xml_declaration=True)
        for name, data in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELATIONS), (BODY, body_part)):
            # without the time of writing, so that a task run again gives the same bytes
            target.writestr(zipfile.ZipInfo(name), data, compress_type=zipfile.ZIP_DEFLATED)
    return out.getvalue()
