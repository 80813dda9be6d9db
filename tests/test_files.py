"""Extraction from real files, written here with zipfile."""

import zipfile

import pytest
from pyspark.sql import functions as F

from docvec.plans.tables import docx_bytes, pptx_bytes, xlsx_bytes
from docvec.sources import files as S
from docvec.sources import parsers as P

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def package(parts, tmp_path, links=None):
    """Bytes of a zip with the given parts; links: relation file -> [(id, kind, target)]."""
    path = tmp_path / "package.zip"
    with zipfile.ZipFile(path, "w") as out:
        for name, targets in (links or {}).items():
            rows = "".join(f'<Relationship Id="{i}" Type="{REL}/{k}" Target="{t}"/>' for i, k, t in targets)
            kind = "http://schemas.openxmlformats.org/package/2006/relationships"
            out.writestr(name, f'<Relationships xmlns="{kind}">{rows}</Relationships>')
        for name, xml in parts.items():
            out.writestr(name, xml)
    return path.read_bytes()


def text(parse, content):
    return "".join(parse(content))


def test_docx(tmp_path):
    run = "<w:r><w:t>{}</w:t></w:r>"
    body = (
        f"<w:p>{run.format('um')}<w:r><w:tab/><w:t>x</w:t><w:br/><w:br w:type=\"page\"/></w:r></w:p>"
        f"<w:tbl><w:tr><w:tc><w:p>{run.format('cell')}</w:p></w:tc></w:tr></w:tbl>"
        f"<w:p><w:hyperlink>{run.format('dois')}</w:hyperlink><w:ins>{run.format('no')}</w:ins></w:p><w:p/>"
    )
    xml = f"<w:document {W}><w:body>{body}</w:body></w:document>"
    links = {"_rels/.rels": [("r1", "officeDocument", "/word/document.xml")]}
    assert text(P.docx_text, package({"word/document.xml": xml}, tmp_path, links)) == "um\tx\n\ndois\n\n"


def workbook(tmp_path, sheets, strings="", styles=""):
    names = "".join(f'<sheet name="s{i}" sheetId="{i + 1}" r:id="s{i}"/>' for i in range(len(sheets)))
    parts = {"xl/workbook.xml": f'<workbook {SHEET} xmlns:r="{REL}"><sheets>{names}</sheets></workbook>'}
    targets = [(f"s{i}", "worksheet", f"worksheets/s{i}.xml") for i in range(len(sheets))]
    for i, rows in enumerate(sheets):
        parts[f"xl/worksheets/s{i}.xml"] = f"<worksheet {SHEET}><sheetData>{rows}</sheetData></worksheet>"
    parts["xl/shared.xml"] = f"<sst {SHEET}>{strings}</sst>"
    parts["xl/styles.xml"] = f"<styleSheet {SHEET}>{styles}</styleSheet>"
    targets += [("x", "sharedStrings", "shared.xml"), ("y", "styles", "styles.xml")]
    links = {"_rels/.rels": [("r", "officeDocument", "xl/workbook.xml")], "xl/_rels/workbook.xml.rels": targets}
    return package(parts, tmp_path, links)


def test_xlsx(tmp_path):
    strings = "<si><t>a</t></si><si><r><t>b</t></r><r><t>c</t></r><rPh><t>no</t></rPh></si>"
    styles = (
        '<numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="[Red]0"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="21"/></cellXfs>'
    )
    first = (
        '<row r="1"><c t="s"><v>0</v></c><c/><c t="s"><v>1</v></c><c><v>3</v></c><c><v>2.50</v></c></row>'
        '<row r="4"><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c><f>A1+1</f><v>2</v></c></row>'
    )
    second = (
        '<row><c s="1"><v>45292</v></c><c s="2"><v>45292.5</v></c><c s="3"><v>7</v></c>'
        '<c s="4"><v>0.25</v></c><c t="inlineStr"><is><t>x</t></is></c></row>'
    )
    content = workbook(tmp_path, [first, second], strings, styles)
    assert text(P.xlsx_text, content) == (
        "a bc 3 2.5\n\n\nTrue #N/A =A1+1\n2024-01-01 00:00:00 2024-01-01 12:00:00 7 06:00:00 x\n"
    )


def test_xlsx_times(tmp_path):
    styles = (
        '<numFmts><numFmt numFmtId="164" formatCode="[h]:mm"/><numFmt numFmtId="165" formatCode="0;[Red]d"/></numFmts>'
        '<cellXfs><xf numFmtId="22"/><xf numFmtId="46"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs>'
    )
    cells = [(0, "45292.1"), (0, "1"), (0, "59.5"), (0, "61"), (1, "1.5"), (2, "0.25"), (3, "7"), (0, "0.999999999")]
    row = "".join(f'<c s="{s}"><v>{v}</v></c>' for s, v in cells) + '<c t="d"><v>2024-01-02T03:04:05Z</v></c>'
    assert text(P.xlsx_text, workbook(tmp_path, [f"<row>{row}</row>"], styles=styles)) == (
        "2024-01-01 02:24:00 1900-01-01 00:00:00 1900-02-28 12:00:00 1900-03-01 00:00:00 "
        "1 day, 12:00:00 6:00:00 7 1900-01-01 00:00:00 2024-01-02 03:04:05\n"
    )
    assert P._time_text(1, "date", P._EPOCH_1904) == "1904-01-02 00:00:00"


def test_text_before_an_error_is_kept(tmp_path):
    content = workbook(tmp_path, ["<row><c><v>1</v></c></row>", "<row><c><v>no number</v></c></row>"])
    assert S._read_one(P.xlsx_text, content) == ("1\n", "error")


def test_pptx(tmp_path):
    names = (
        'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" '
        'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" ' + f'xmlns:r="{REL}"'
    )
    run = "<a:r><a:t>{}</a:t></a:r>"

    def slide(shapes):
        return f"<p:sld {names}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"

    one = (
        f"<p:sp><p:txBody><a:p>{run.format('a')}{run.format('b')}<a:fld><a:t>no</a:t></a:fld></a:p>"
        f"<a:p>{run.format('c')}</a:p></p:txBody></p:sp><p:sp/><p:pic/>"
        f"<p:grpSp><p:sp><p:txBody><a:p>{run.format('no')}</a:p></p:txBody></p:sp></p:grpSp>"
    )
    two = f"<p:sp><p:txBody><a:p>{run.format('d')}</a:p></p:txBody></p:sp>"
    deck = f'<p:presentation {names}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:sldIdLst></p:presentation>'
    parts = {"ppt/presentation.xml": deck, "ppt/slides/1.xml": slide(two), "ppt/slides/2.xml": slide(one)}
    links = {
        "_rels/.rels": [("r", "officeDocument", "ppt/presentation.xml")],
        "ppt/_rels/presentation.xml.rels": [("r1", "slide", "slides/1.xml"), ("r2", "slide", "slides/2.xml")],
    }
    assert text(P.pptx_text, package(parts, tmp_path, links)) == "a b c \n\nd \n"


FILES = {
    "a.txt": (b"a\r\nb\rc", "a\nb\nc", "txt", "ok"),
    "bad.txt": (b"\xc3\x28", "", "txt", "error"),
    "bom.txt": (b"\xef\xbb\xbfa", "﻿a", "txt", "ok"),
    "a.docx": (docx_bytes(["x & y", "z"]), "x & y\nz\n", "docx", "ok"),
    "sub/junk.docx": (b"junk", "", "docx", "error"),
    "a.xlsx": (xlsx_bytes(["x", "y"]), "x\ny\n", "xlsx", "ok"),
    "no.xlsx": (xlsx_bytes([]), "", "xlsx", "empty"),
    "sub/a.pptx": (pptx_bytes(["x", "y"]), "x \ny \n", "pptx", "ok"),
    "a.ppt": (b"\xd0\xcf\x11\xe0", "", "pptx", "error"),
    "zip.ppt": (pptx_bytes(["x"]), "x \n", "pptx", "ok"),
    "A.PDF": (b"x", "", "unsupported", "unsupported"),
    "a.csv": (b"x", "", "unsupported", "unsupported"),
    "noext": (b"x", "", "unsupported", "unsupported"),
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    (root / "sub").mkdir()
    for name, (content, *_) in FILES.items():
        (root / name).write_bytes(content)
    (root / "a.pdf").write_bytes(b"pdf bytes")
    return root


def test_extraction_of_a_folder(spark, folder):
    rows = S.extract_text(S.read_files(spark, str(folder))).collect()
    found = {r["path"].split(f"{folder}/")[1]: (r["text"], r["route"], r["status"]) for r in rows}
    pdf = found.pop("a.pdf")
    assert found == {name: tuple(expected) for name, (_, *expected) in FILES.items()}
    assert pdf == ("", "pdf", "no_parser" if P.pdf_parser() is None else "error")


def test_empty_files(spark):
    """Spark's scan leaves files of no bytes out; as rows they have no text."""
    files = spark.createDataFrame([("a.txt", b""), ("a.docx", b""), ("a.xlsx", None)], "path string, content binary")
    found = [(r["text"], r["status"]) for r in S.extract_text(files).orderBy("path").collect()]
    assert found == [("", "error"), ("", "empty"), ("", "error")]


def test_a_parser_can_be_given(spark, folder):
    files = S.read_files(spark, str(folder)).where(F.endswith("path", F.lit(".pdf")))
    row = S.extract_text(files, {"pdf": lambda content: iter([content.decode(), "!"])}).first()
    assert (row["text"], row["status"]) == ("pdf bytes!", "ok")


def test_only_files_for_a_parser_reach_python(spark, folder):
    """A filter on the text does not parse a file twice."""
    texts = S.nonempty_text(S.extract_text(S.read_files(spark, str(folder))))
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_tokens_of_files(spark, folder):
    texts = S.extract_text(S.read_files(spark, str(folder))).select("path", "text")
    tokens = {r["file_name"]: r["tokens"] for r in S.tokenize_files(texts).collect()}
    assert tokens["a.docx"] == ["x", "y", "z"] and tokens["bad.txt"] is None and tokens["a.pptx"] == ["x", "y"]
