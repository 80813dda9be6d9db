"""Text of one office file at a time, for the extraction job in `files`.

Each parser takes the bytes of a file and yields pieces of text in reading order.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree as ET

_OFFICE = "http://schemas.openxmlformats.org"
_W = f"{{{_OFFICE}/wordprocessingml/2006/main}}"
_S = f"{{{_OFFICE}/spreadsheetml/2006/main}}"
_P = f"{{{_OFFICE}/presentationml/2006/main}}"
_A = f"{{{_OFFICE}/drawingml/2006/main}}"
_R_ID = f"{{{_OFFICE}/officeDocument/2006/relationships}}id"
_REL = f"{{{_OFFICE}/package/2006/relationships}}Relationship"


def _relations(package: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Relation id -> (kind, target part) for one part of a package."""
    folder, name = posixpath.split(part)
    try:
        xml = package.read(posixpath.join(folder, "_rels", f"{name}.rels"))
    except KeyError:
        return {}
    found = {}
    for rel in ET.fromstring(xml).iter(_REL):
        target = posixpath.normpath(posixpath.join("/", folder, rel.get("Target", ""))).lstrip("/")
        found[rel.get("Id")] = (rel.get("Type", "").rsplit("/", 1)[-1], target)
    return found


def _main_part(package: zipfile.ZipFile) -> str:
    return next(target for kind, target in _relations(package, "").values() if kind == "officeDocument")


# --- documents -----------------------------------------------------------------


def _run_text(run: ET.Element) -> str:
    marks = {f"{_W}tab": "\t", f"{_W}ptab": "\t", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}
    text = ""
    for node in run:
        if node.tag == f"{_W}t":
            text += node.text or ""
        elif node.tag == f"{_W}br":
            text += "\n" if node.get(f"{_W}type", "textWrapping") == "textWrapping" else ""
        else:
            text += marks.get(node.tag, "")
    return text


def docx_text(content: bytes) -> Iterator[str]:
    """Paragraphs of the body, each followed by a newline; tables and headers are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        body = ET.fromstring(package.read(_main_part(package))).find(f"{_W}body")
        for paragraph in body.findall(f"{_W}p"):
            for node in paragraph:
                if node.tag == f"{_W}r":
                    yield _run_text(node)
                elif node.tag == f"{_W}hyperlink":
                    yield "".join(_run_text(run) for run in node.findall(f"{_W}r"))
            yield "\n"


# --- workbooks -----------------------------------------------------------------

# Number formats that every workbook knows as dates or times, and as a duration.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 47}
_DURATION_FORMATS = {46}
# Day 0 of the two calendars.
_EPOCH_1900 = datetime(1899, 12, 30)
_EPOCH_1904 = datetime(1904, 1, 1)


def _format_kind(number: int, code: str) -> str | None:
    """Whether a number format shows a date or a duration; only its first section counts."""
    code = re.sub(r'"[^"]*"', "", code.split(";")[0])
    if number in _DURATION_FORMATS or re.search(r"\[(h+|m+|s+)\]", code, re.I):
        return "duration"
    bare = re.sub(r"\[[^\]]*\]|\\.|_.", "", code)
    return "date" if number in _DATE_FORMATS or re.search("[dmyhs]", bare, re.I) else None


def _time_styles(package: zipfile.ZipFile, relations: dict) -> dict[int, str]:
    """Position of a cell style -> date or duration, for the styles that show one."""
    part = next((target for kind, target in relations.values() if kind == "styles"), None)
    if part is None or part not in package.namelist():
        return {}
    styles = ET.fromstring(package.read(part))
    codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter(f"{_S}numFmt")}
    cells = styles.find(f"{_S}cellXfs")
    numbers = [] if cells is None else [int(c.get("numFmtId", 0)) for c in cells]
    kinds = {i: _format_kind(number, codes.get(number, "")) for i, number in enumerate(numbers)}
    return {i: kind for i, kind in kinds.items() if kind}


def _time_text(serial: float, kind: str, epoch: datetime) -> str:
    """A day number as date, time of day or duration, to the millisecond."""
    days, fraction = divmod(serial, 1)
    rest = timedelta(milliseconds=round(fraction * 86_400_000))
    if kind == "duration":
        return str(timedelta(days=days) + rest)
    if 0 <= serial < 1 and not rest.days:
        return str((epoch + rest).time())
    if 0 < serial < 60 and epoch == _EPOCH_1900:
        days += 1  # day 60 never existed, so earlier days sit one off
    return str(epoch + timedelta(days=days) + rest)


def _shared_strings(package: zipfile.ZipFile, relations: dict) -> list[str]:
    part = next((target for kind, target in relations.values() if kind == "sharedStrings"), None)
    if part is None:
        return []
    return [_plain_string(item) for item in ET.fromstring(package.read(part)).findall(f"{_S}si")]


def _plain_string(item: ET.Element) -> str:
    """Own text and rich runs, without phonetic guides."""
    nodes = item.findall(f"{_S}t") + item.findall(f"{_S}r/{_S}t")
    return "".join(node.text or "" for node in nodes)


def _cell_text(cell: ET.Element, strings: list[str], times: dict[int, str], epoch: datetime) -> str | None:
    formula = cell.find(f"{_S}f")
    if formula is not None:
        return "=" + (formula.text or "")
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{_S}is")
        return None if inline is None else _plain_string(inline)
    value = cell.findtext(f"{_S}v")
    if value is None:
        return None
    if kind == "s":
        return strings[int(value)]
    if kind == "b":
        return str(bool(int(value)))
    if kind == "d":
        return value.rstrip("Z").replace("T", " ")
    if kind != "n":
        return value
    number = float(value) if re.search("[.eE]", value) else int(value)
    shown_as = times.get(int(cell.get("s", 0)))
    return _time_text(number, shown_as, epoch) if shown_as else str(number)


def xlsx_text(content: bytes) -> Iterator[str]:
    """Sheets in order; the filled cells of a row joined by a space, then a newline."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        book = _main_part(package)
        relations = _relations(package, book)
        strings = _shared_strings(package, relations)
        times = _time_styles(package, relations)
        workbook = ET.fromstring(package.read(book))
        settings = workbook.find(f"{_S}workbookPr")
        late = settings is not None and settings.get("date1904") in ("1", "true")
        epoch = _EPOCH_1904 if late else _EPOCH_1900
        for sheet in workbook.iter(f"{_S}sheet"):
            kind, part = relations[sheet.get(_R_ID)]
            if kind != "worksheet":
                continue
            seen = 0
            with package.open(part) as stream:
                for _, row in ET.iterparse(stream):
                    if row.tag != f"{_S}row":
                        continue
                    place = int(row.get("r", seen + 1))
                    yield "\n" * (place - seen - 1)
                    cells = (_cell_text(cell, strings, times, epoch) for cell in row.findall(f"{_S}c"))
                    yield " ".join(text for text in cells if text is not None) + "\n"
                    seen = place
                    row.clear()


# --- slides --------------------------------------------------------------------


def pptx_text(content: bytes) -> Iterator[str]:
    """Slides in order; a space after each run, a newline after each shape that can hold text."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        deck = _main_part(package)
        relations = _relations(package, deck)
        for entry in ET.fromstring(package.read(deck)).iter(f"{_P}sldId"):
            slide = ET.fromstring(package.read(relations[entry.get(_R_ID)][1]))
            for shape in slide.findall(f"{_P}cSld/{_P}spTree/{_P}sp"):
                for run in shape.findall(f"{_P}txBody/{_A}p/{_A}r"):
                    yield run.findtext(f"{_A}t", "") + " "
                yield "\n"


PARSERS = {"docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text}


# --- pdf -----------------------------------------------------------------------


def pdf_parser() -> Callable[[bytes], Iterator[str]] | None:
    """A parser over an installed PDF library, if there is one."""
    try:
        from pypdf import PdfReader
    except ImportError:
        try:
            from PyPDF2 import PdfReader
        except ImportError:
            return None

    def pdf_text(content: bytes) -> Iterator[str]:
        for page in PdfReader(io.BytesIO(content)).pages:
            yield page.extract_text()

    return pdf_text
