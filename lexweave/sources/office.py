"""Office files as pages of text and tables.

Word, PowerPoint and Excel files of the XML kind are archives of XML parts and
are read with the standard library; PDF files need a parser module where the
executors run, or a parser that the caller passes.
"""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

# Marks that the texts of slides, tables, headings and sheets carry.
SLIDE, TABLE, HEADING, SHEET, CUT = "=== スライド {} ===", "[表]", "\n## {}", "=== シート: {} ===", "... (最大 {} 行で打ち切り)"
HEADING_STYLES = ("Heading", "見出し")
MOST_ROWS = 1000

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REF = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


@dataclass
class Parsed:
    """What a parser finds in a file: pages (the text is their join), tables of rows of cells, facts about the file."""

    pages: list[str]
    tables: list[list[list[str]]] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    method: str = ""
    separator: str = "\n\n"

    @property
    def text(self) -> str:
        return self.separator.join(self.pages)


class _Parts:
    """The XML parts of an archive."""

    def __init__(self, content: bytes):
        self.archive = zipfile.ZipFile(io.BytesIO(content))

    def xml(self, name: str):
        """The root of a part; None if there is none."""
        return ElementTree.fromstring(self.archive.read(name)) if name in self.archive.namelist() else None

    def related(self, name: str) -> dict[str, str]:
        """Targets of a part's relations by id, as names in the archive."""
        folder, _, own = name.rpartition("/")
        root = self.xml(f"{folder}/_rels/{own}.rels")
        out = {}
        for r in root if root is not None else ():
            target = r.get("Target", "")
            out[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
        return out


def _written(paragraph) -> str:
    """The text of a Word paragraph; tabs and breaks count."""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    runs = (e for r in paragraph.iter(f"{_W}r") for e in r)
    return "".join((e.text or "") if e.tag == f"{_W}t" else marks.get(e.tag, "") for e in runs)


def docx(content: bytes) -> Parsed:
    """Paragraphs, headings marked, as one page; the tables; title, author, subject and time of change."""
    parts = _Parts(content)
    body = parts.xml("word/document.xml").find(f"{_W}body")
    styles = parts.xml("word/styles.xml")
    names = {s.get(f"{_W}styleId"): n.get(f"{_W}val") for s in (styles if styles is not None else ()) if (n := s.find(f"{_W}name")) is not None}
    lines = []
    for p in body.findall(f"{_W}p"):
        if not (text := _written(p).strip()):
            continue
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = names.get(style.get(f"{_W}val"), style.get(f"{_W}val")) if style is not None else ""
        # styles are stored in lower case and shown with a capital
        named = any(s.lower() in name.lower() for s in HEADING_STYLES)
        lines.append(HEADING.format(text) if named else text)
    cell = lambda c: "\n".join(_written(p) for p in c.findall(f"{_W}p")).strip()
    tables = [[[cell(c) for c in r.findall(f"{_W}tc")] for r in t.findall(f"{_W}tr")] for t in body.findall(f"{_W}tbl")]
    core = parts.xml("docProps/core.xml")
    facts = {re.sub(r"^\{.*\}", "", e.tag): e.text or "" for e in (core if core is not None else ())}
    metadata = {"title": facts.get("title", ""), "author": facts.get("creator", ""), "subject": facts.get("subject", ""), "modified": facts.get("modified", "")}
    return Parsed(["\n".join(lines)], tables, metadata, "docx")


def pptx(content: bytes) -> Parsed:
    """A page for each slide in order: its number, the paragraphs and the rows of its tables."""
    parts = _Parts(content)
    main = "ppt/presentation.xml"
    targets = parts.related(main)
    listed = parts.xml(main).find(f"{_P}sldIdLst")
    slides = [targets[s.get(_REF)] for s in (listed if listed is not None else ())]
    said = lambda p: "".join(r.text or "" for r in p.findall(f"{_A}r/{_A}t"))
    pages, tables = [], []
    for n, name in enumerate(slides, 1):
        lines = [SLIDE.format(n)]
        for shape in parts.xml(name).find(f"{_P}cSld/{_P}spTree"):
            if shape.tag == f"{_P}sp":
                lines += filter(None, (said(p).strip() for p in shape.findall(f"{_P}txBody/{_A}p")))
            for table in shape.iter(f"{_A}tbl") if shape.tag == f"{_P}graphicFrame" else ():
                rows = [["\n".join(said(p) for p in c.iter(f"{_A}p")).strip() for c in r.findall(f"{_A}tc")] for r in table.findall(f"{_A}tr")]
                tables.append(rows)
                lines += [TABLE, *(" | ".join(r) for r in rows)]
        pages.append("\n".join(lines))
    return Parsed(pages, tables, {"slide_count": str(len(slides))}, "pptx")


def _column(reference: str) -> int:
    """The number of a column, from 0, of a cell like BC12."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell, shared: list[str]) -> str:
    kind, v = cell.get("t", "n"), cell.find(f"{_S}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_S}t"))
    if v is None or v.text is None:
        return ""
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return str(v.text == "1")
    if kind == "n":
        return str(int(v.text)) if re.fullmatch(r"-?\d+", v.text) else str(float(v.text))
    return v.text


def xlsx(content: bytes, most_rows: int = MOST_ROWS) -> Parsed:
    """A page for each sheet: its name and its rows that aren't empty, ``most_rows`` at most; dates are numbers of days."""
    parts = _Parts(content)
    main = "xl/workbook.xml"
    targets = parts.related(main)
    strings = parts.xml("xl/sharedStrings.xml")
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in (strings if strings is not None else ())]
    pages, tables = [], []
    sheets = parts.xml(main).findall(f"{_S}sheets/{_S}sheet")
    for sheet in sheets:
        root = parts.xml(targets[sheet.get(_REF)])
        size = root.find(f"{_S}dimension")
        width = _column(size.get("ref").split(":")[-1]) + 1 if size is not None else 0
        lines, rows = [SHEET.format(sheet.get("name"))], []
        for row in root.iter(f"{_S}row"):
            found: dict[int, str] = {}
            for c in row.findall(f"{_S}c"):
                at = _column(c.get("r")) if c.get("r") else len(found)
                found[at] = _value(c, shared)
            if not any(found.values()):
                continue
            if len(rows) == most_rows:
                lines.append(CUT.format(most_rows))
                break
            rows.append([found.get(k, "") for k in range(max(width, max(found) + 1))])
            lines.append(" | ".join(rows[-1]))
        pages.append("\n".join(lines))
        if rows:
            tables.append(rows)
    return Parsed(pages, tables, {"sheet_count": str(len(sheets))}, "xlsx")


def pdf(content: bytes) -> Parsed:
    """The pages of a PDF file; one that can't be read is empty.  Needs the pypdf module on the executors."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise RuntimeError("reading PDF files needs the pypdf module, or a parser of the caller's") from missing
    pages = []
    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # a page that can't be read is an empty one
            pages.append("")
    return Parsed(pages, method="pdf", separator="\n")


#: By extension.
PARSERS = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "pdf": pdf}
