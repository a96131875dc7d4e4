"""Spreadsheet packages: one page and one table per sheet, cached values as text."""

from __future__ import annotations

import datetime
import functools
import re
from collections.abc import Iterator

from leafstack.sources.package import Found, Package, attr, cell, child, children, clamp, local, number, stacked_box, texts, within

#: A sheet of so many places gives a cell for each, empty ones too. Beyond that one that has values in less than an eighth of
#: them gives only cells with a value or in a merged range, so a stray cell in the last row costs one cell. Sheets of
#: more places don't list their equal widths and heights.
DENSE = 1_000_000
#: Built-in number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}


@functools.lru_cache(maxsize=65536)
def place(ref: str) -> tuple[int, int]:
    """Row and column, from 0, of a reference such as B12."""
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref).groups()
    col = 0
    for ch in letters.upper():
        col = col * 26 + ord(ch) - 64
    return int(digits) - 1, col - 1


def is_date(code: str) -> bool:
    """Whether a number format shows a date or time: such a letter outside quotes, brackets and escapes."""
    return re.search(r"[dmhysDMHYS]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", code)) is not None


def date_styles(package: Package) -> set[int]:
    """Indexes of cell styles with a date format."""
    if "xl/styles.xml" not in package:
        return set()
    root = package.xml("xl/styles.xml")
    own = {number(attr(f, "numFmtId"), -1) for f in within(root, "numFmt") if is_date(attr(f, "formatCode") or "")}
    formats = children(child(root, "cellXfs"), "xf")
    return {i for i, xf in enumerate(formats) if number(attr(xf, "numFmtId"), 0) in _DATE_FORMATS | own}


@functools.lru_cache(maxsize=16384)
def _number(raw: str, dated: bool, epoch: datetime.datetime) -> str:
    value = float(raw)
    if not dated:
        return str(value if any(c in raw for c in ".eE") else int(raw))
    if 0 <= value < 1:
        seconds = round(value * 86400)
        return str((datetime.datetime.min + datetime.timedelta(seconds=seconds)).time()) if seconds < 86400 else "00:00:00"
    if epoch.year == 1899 and value < 60:
        value += 1  # the calendar of this format has a 29 February 1900
    return str(epoch + datetime.timedelta(days=int(value), seconds=round((value % 1) * 86400)))


def values(package: Package, root, strings: list[str], dates: set[int], epoch) -> dict[tuple[int, int], str]:
    """Text of each cell that the sheet lists, at its place; cells without a value are empty."""
    out, row_no = {}, -1
    for row in within(root, "row"):
        row_no = number(attr(row, "r"), row_no + 2) - 1
        col_no = -1
        for c in children(row, "c"):
            ref = c.get("r") or attr(c, "r")
            at = place(ref) if ref else (row_no, col_no + 1)
            col_no = at[1]
            kind, v = c.get("t") or attr(c, "t", "n"), child(c, "v")
            raw = v.text if v is not None and v.text is not None else None
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in within(c, "t"))
            elif raw is None:
                text = ""
            elif kind == "s":
                text = strings[int(raw)]
            elif kind == "b":
                text = str(raw == "1")
            elif kind == "n":
                text = _number(raw, number(attr(c, "s"), 0) in dates, epoch)
            else:
                text = raw
            out[at] = text.strip()
    return out


def _shared_strings(package: Package) -> list[str]:
    if "xl/sharedStrings.xml" not in package:
        return []
    # Phonetic readings (rPh) aren't part of the string.
    return ["".join(t.text or "" for part in si if local(part) in ("t", "r") for t in within(part, "t")) for si in package.xml("xl/sharedStrings.xml")]


def _drawings(package: Package, part: str):
    """(kind, row, column, part name) of a sheet's pictures, then its charts."""
    found = []
    for target, kind in package.relations(part).values():
        if kind != "drawing" or target not in package:
            continue
        rels = package.relations(target)
        for anchor in package.xml(target):
            start = child(anchor, "from")
            at = tuple(number(getattr(child(start, k), "text", None), 0) for k in ("row", "col")) if start is not None else (None, None)
            pic, chart = next(within(anchor, "blip"), None), next(within(anchor, "chart"), None)
            for name, node, key in (("image", pic, "embed"), ("chart", chart, "id")):
                if node is not None and attr(node, key) in rels:
                    found.append((name, *at, rels[attr(node, key)][0]))
    return sorted(found, key=lambda f: f[0] != "image")


def _places(rows: int, cols: int, known: set) -> list[tuple[int, int]] | Iterator[tuple[int, int]]:
    """Places of a sheet by row: all of them, or where stray cells make the sheet mostly empty, the known ones."""
    if rows * cols <= max(DENSE, 8 * len(known)):
        return ((r, c) for r in range(rows) for c in range(cols))
    return sorted(known)


def read(package: Package, found: Found) -> None:
    book = package.xml("xl/workbook.xml")
    rels = package.relations("xl/workbook.xml")
    strings, dates = _shared_strings(package), date_styles(package)
    old = attr(child(book, "workbookPr"), "date1904", "0") in ("1", "true")
    epoch = datetime.datetime(1904, 1, 1) if old else datetime.datetime(1899, 12, 30)
    for sheet in children(child(book, "sheets"), "sheet"):
        name, part = attr(sheet, "name"), rels.get(attr(sheet, "id"), (None, None))[0]
        page = found.page(1.0, 1.0, source_format="xlsx", layout_mode="grid", sheet_name=name)
        if part is None or part not in package:
            continue
        root = package.xml(part)
        text = values(package, root, strings, dates, epoch)
        rows, cols = max((r for r, _ in text), default=0) + 1, max((c for _, c in text), default=0) + 1
        merged: dict[tuple[int, int], tuple[int, int] | None] = {}
        for m in within(root, "mergeCell"):
            ends = [place(x) for x in (attr(m, "ref") or "A1").split(":")]
            (r1, c1), (r2, c2) = ends[0], ends[-1]
            merged |= {(r, c): None for r in range(r1, r2 + 1) for c in range(c1, c2 + 1)} | {(r1, c1): (c2 - c1 + 1, r2 - r1 + 1)}
        cells, lines, dense = [], {}, rows * cols <= DENSE
        for r, c in _places(rows, cols, text.keys() | merged.keys()):
            span = merged.get((r, c), (1, 1))
            shown = text.get((r, c), "") if span else ""
            lines.setdefault(r, []).append(shown)
            cells.append(cell(r, c, shown or None, span is None, *(span or (1, 1)), origin=span is not None))
        whole = "\n".join(" | ".join(line) for line in lines.values() if any(line)) or None
        sizes = {"col_widths": [1.0] * cols, "row_heights": [1.0] * rows} if dense else {}
        found.table(found.element("table", 1, 1, stacked_box(0, 0.9), whole, source_format="xlsx", sheet_name=name, **sizes), cells)
        order = pictures = charts = 0
        for kind, row, col, target in _drawings(package, part):
            order += 1
            box = stacked_box(order + 1) if row is None else (clamp(col / cols), clamp(row / rows), max(clamp(1 / cols), 0.05), max(clamp(1 / rows), 0.05))
            if kind == "image" and target in package:
                pictures += 1
                ref = found.asset(f"sheet{page}_img{pictures}.png", package.read(target))
                found.element("image", order + 1, order + 1, box, None, source_format="xlsx", image_ref=ref)
            elif kind == "chart":
                charts += 1
                title = child(package.xml(target), "chart", "title") if target in package else None
                found.element("chart", order + 1, order + 1, box, (texts(title) if title is not None else "") or f"Chart {charts}", source_format="xlsx")
