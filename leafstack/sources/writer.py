"""Minimal packages made from lines of text, for round trips and fixtures."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_OFFICE = "http://schemas.openxmlformats.org"
W = f'xmlns:w="{_OFFICE}/wordprocessingml/2006/main"'
A = f'xmlns:a="{_OFFICE}/drawingml/2006/main"'
P = f'xmlns:p="{_OFFICE}/presentationml/2006/main"'
R = f'xmlns:r="{_OFFICE}/officeDocument/2006/relationships"'
S = f'xmlns="{_OFFICE}/spreadsheetml/2006/main"'
H = 'xmlns:hp="http://www.hancom.co.kr/hwpml/2011/paragraph"'


def zipped(parts: dict[str, str | bytes]) -> bytes:
    """A package of parts; equal parts give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(info, data if isinstance(data, bytes) else _HEAD + data)
    return out.getvalue()


def clean(text: str) -> str:
    """Without the control characters that XML can't hold, escaped."""
    return escape("".join(c for c in text if c in "\t\n" or ord(c) >= 32 and not 0xD800 <= ord(c) <= 0xDFFF and ord(c) not in (0xFFFE, 0xFFFF)))


def relations(items: dict[str, tuple[str, str]]) -> str:
    rows = "".join(f'<Relationship Id="{k}" Type="{_OFFICE}/officeDocument/2006/relationships/{kind}" Target="{target}"/>' for k, (kind, target) in items.items())
    return f'<Relationships xmlns="{_OFFICE}/package/2006/relationships">{rows}</Relationships>'


def docx(lines: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{clean(x)}</w:t></w:r></w:p>' for x in lines)
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})


def hwpx(lines: list[str]) -> bytes:
    body = "".join(f"<hp:p><hp:run><hp:t>{clean(x)}</hp:t></hp:run></hp:p>" for x in lines)
    return zipped({"Contents/section0.xml": f"<hp:sec {H}>{body}</hp:sec>"})


def pptx(lines: list[str]) -> bytes:
    body = "".join(f"<a:p><a:r><a:t>{clean(x)}</a:t></a:r></a:p>" for x in lines)
    shape = f'<p:sp><p:nvSpPr><p:cNvPr id="2" name="Text"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="914400" y="914400"/><a:ext cx="4572000" cy="3429000"/></a:xfrm></p:spPr><p:txBody>{body}</p:txBody></p:sp>'
    return deck([shape])


def deck(slides: list[str], more: dict[str, str | bytes] | None = None, rels: dict[int, dict] | None = None) -> bytes:
    """A presentation of slides given as the shapes in them; ``rels`` holds relations of slides by number."""
    ids = "".join(f'<p:sldId id="{256 + i}" r:id="rId{i + 1}"/>' for i in range(len(slides)))
    parts: dict[str, str | bytes] = {
        "ppt/presentation.xml": f'<p:presentation {P} {R}><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": relations({f"rId{i + 1}": ("slide", f"slides/slide{i + 1}.xml") for i in range(len(slides))}),
    }
    for i, shapes in enumerate(slides, 1):
        parts[f"ppt/slides/slide{i}.xml"] = f"<p:sld {P} {A} {R}><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
        if rels and i in rels:
            parts[f"ppt/slides/_rels/slide{i}.xml.rels"] = relations(rels[i])
    return zipped(parts | (more or {}))


def xlsx(lines: list[str]) -> bytes:
    rows = "".join(f'<row r="{i}"><c r="A{i}" t="inlineStr"><is><t xml:space="preserve">{clean(x)}</t></is></c></row>' for i, x in enumerate(lines, 1))
    return book({"Sheet1": f"<worksheet {S}><sheetData>{rows}</sheetData></worksheet>"})


def book(sheets: dict[str, str], more: dict[str, str | bytes] | None = None) -> bytes:
    names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
    parts: dict[str, str | bytes] = {
        "xl/workbook.xml": f"<workbook {S} {R}><sheets>{names}</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": relations({f"rId{i}": ("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(sheets) + 1)}),
    }
    return zipped(parts | {f"xl/worksheets/sheet{i}.xml": xml for i, xml in enumerate(sheets.values(), 1)} | (more or {}))


WRITERS = {"docx": docx, "hwpx": hwpx, "pptx": pptx, "xlsx": xlsx}
