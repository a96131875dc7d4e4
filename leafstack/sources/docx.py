"""Word-processing packages: sections as pages, blocks placed by a running cursor."""

from __future__ import annotations

import posixpath

from leafstack.sources.package import Found, Package, attr, child, children, clamp, local, number, piped, spread, texts, within

#: English metric units in a twip.
EMU = 635


class Sheet:
    """Page size and margins in twips, and the cursor of the flowing text."""

    def __init__(self, section):
        size, margin = child(section, "pgSz"), child(section, "pgMar")
        self.w, self.h = number(attr(size, "w"), 12240.0), number(attr(size, "h"), 15840.0)
        self.left, self.right, self.top, self.bottom = (number(attr(margin, k), 1440.0) for k in ("left", "right", "top", "bottom"))
        self.inner_w, self.inner_h = max(self.w - self.left - self.right, 1.0), max(self.h - self.top - self.bottom, 1.0)
        self.y = clamp(self.top / self.h)

    def paragraph(self, p) -> tuple:
        """Box of the next paragraph; the cursor moves below it, never beyond the page."""
        space, indent = child(p, "pPr", "spacing"), child(p, "pPr", "ind")
        line = number(attr(space, "line"), 240.0)
        if space is not None and line:
            line = line / 20 if attr(space, "lineRule", "auto") == "auto" else line
        before, after, left, right = (number(attr(n, k), 0.0) for n, k in ((space, "before"), (space, "after"), (indent, "left"), (indent, "right")))
        self.y = clamp(self.y + before / self.inner_h)
        height = min(max((line or 240.0) / self.inner_h, 0.025), max(0.02, 1.0 - self.y))
        width = clamp(clamp(self.inner_w / self.w) - left / self.w - right / self.w)
        box = (clamp(clamp(self.left / self.w) + left / self.w), self.y, max(width, 0.1), height)
        self.y = clamp(self.y + height + after / self.inner_h)
        return box

    def table(self, rows: int) -> tuple:
        wanted = max(0.035, min(0.08 * max(rows, 1), clamp(self.inner_h / self.h) * 0.85))
        height = min(wanted, max(0.05, 1.0 - self.y))
        box = (clamp(self.left / self.w), self.y, clamp(self.inner_w / self.w), height)
        self.y = clamp(self.y + height)
        return box

    def drawing(self, node, fallback: tuple) -> tuple:
        """Box of a floating or inline drawing."""
        holder = next(within(node, "anchor"), None)
        floating = holder is not None
        holder = holder if floating else next(within(node, "inline"), None)
        extent = child(holder, "extent") if holder is not None else None
        if extent is None:
            return fallback
        cx, cy = number(attr(extent, "cx", "0"), -1), number(attr(extent, "cy", "0"), -1)
        if cx < 0 or cy < 0:
            return fallback
        x, y = self.left * EMU, self.top * EMU
        if floating:
            x, y = self._place(child(holder, "positionH"), cx, self.left, self.inner_w), self._place(child(holder, "positionV"), cy, self.top, self.inner_h)
        x, y = clamp(x / (self.w * EMU)), clamp(y / (self.h * EMU))
        size = lambda span, page, at: max(min(clamp(span / (page * EMU)), 1.0 - at), 0.03)
        return x, y, size(cx, self.w, x), size(cy, self.h, y)

    def _place(self, position, span: int, margin: float, room: float) -> float:
        if position is None:
            return margin * EMU
        start = margin * EMU if attr(position, "relativeFrom", "page") in ("margin", "column", "leftMargin", "rightMargin") else 0.0
        offset = child(position, "posOffset")
        offset = number(offset.text, 0) if offset is not None else 0
        align = child(position, "align")
        align = align.text if align is not None else None
        if align in ("right", "outside"):
            return start + room * EMU - span - offset
        return start + (room * EMU - span) / 2 + offset if align == "center" else start + offset


def sections(body) -> list[tuple[list, object]]:
    """(blocks, properties) of each section; properties inside a paragraph count only at the end of the last blocks."""
    out, blocks, last = [], [], None
    for node in body:
        if local(node) == "sectPr":
            out.append((blocks, node))
            blocks = []
        else:
            blocks.append(node)
    if blocks:
        if local(blocks[-1]) == "p":
            last = child(blocks[-1], "pPr", "sectPr")
        out.append((blocks, last))
    return out or [([], None)]


def _bold(run) -> bool:
    b = child(run, "rPr", "b")
    return b is not None and str(attr(b, "val", "1")).lower() not in ("0", "false")


def runs(p) -> list[tuple[str, bool]]:
    """(text, bold) of a paragraph's runs and links; runs that hold a drawing have no text of their own."""
    out = []
    for node in p:
        if local(node) == "hyperlink":
            out.append((texts(node), False))
        elif local(node) == "r" and not any(local(x) in ("drawing", "pict") for x in node.iter()):
            signs = {"tab": "\t", "br": "\n"}
            out.append(("".join((x.text or "") if local(x) == "t" else signs.get(local(x), "") for x in node), _bold(node)))
    return [r for r in out if r[0]]


def paragraph(p) -> tuple[str, dict]:
    """Text and metadata of a paragraph."""
    meta: dict = {}
    props = child(p, "pPr")
    style = attr(child(props, "pStyle"), "val")
    if style:
        meta["paragraph_style"] = style
        if style.lower().startswith("heading"):
            meta |= {"is_heading": True, "heading_level": int("".join(c for c in style if c.isdigit()) or 1)}
    listed = child(props, "numPr")
    if listed is not None:
        meta |= {"is_list_item": True, "list_level": number(attr(child(listed, "ilvl"), "val", "0"), 0)}
    parts = runs(p)
    text = "".join(t for t, _ in parts).strip()
    bold = [b for _, b in parts]
    if bold and text:
        meta["is_mostly_bold"] = sum(bold) * 2 >= len(bold)
    if any(bold):
        meta["formatted_text"] = "".join(f"**{t}**" if b else t for t, b in parts).strip() or None
    if text.startswith("[") and "]" in text:
        meta["line_pattern"] = "bracket_leading"
    if listed is not None and text:
        text = f"{'  ' * meta['list_level']}- {text}"
    return text, meta


def text_box(drawing) -> str | None:
    box = next((x for x in drawing.iter() if local(x) in ("txbx", "txbxContent")), None)
    if box is None:
        return None
    return "\n".join(t for p in within(box, "p") if (t := texts(p))) or None


def table_cells(tbl) -> list[dict]:
    """Cells of a table. Spans are read as attributes of the cell properties, vertical merges as their child."""
    rows = []
    for tr in children(tbl, "tr"):
        row = []
        for tc in children(tr, "tc"):
            props = child(tc, "tcPr")
            merge = child(props, "vMerge")
            continues = merge is not None and attr(merge, "val", "continue") in ("1", "true", "continue")
            text = "\n".join(t for p in within(tc, "p") if (t := texts(p))) or None
            row.append((text, max(1, number(attr(props, "gridSpan"), 1)), max(1, number(attr(props, "rowSpan"), 1)), continues))
        rows.append(row)
    return spread(rows)


def column_widths(tbl) -> list[float]:
    """Widths that the table's grid gives its columns; one of 1 where it gives none."""
    return [number(attr(g, "w"), 1.0) for g in children(child(tbl, "tblGrid"), "gridCol")] or [1.0]


def read(package: Package, found: Found) -> None:
    rels = package.relations("word/document.xml")
    body = child(package.xml("word/document.xml"), "body")
    if body is None:
        return
    for blocks, props in sections(body):
        sheet = Sheet(props)
        found.page(1.0, 1.0, source_format="docx", layout_mode="page_metrics")
        order = 0
        for node in blocks:
            order += 1
            if local(node) == "p":
                box = sheet.paragraph(node)
                text, meta = paragraph(node)
                if text:
                    found.element("text", order, order, box, text, source_format="docx", layout="flow", **meta)
                for drawing in within(node, "drawing"):
                    order += 1
                    _drawing(package, found, rels, sheet, drawing, order, box)
            elif local(node) == "tbl":
                box = sheet.table(len(children(node, "tr")))
                cells = table_cells(node)
                at = found.element("table", order, order, box, piped(cells), source_format="docx", layout="flow", col_widths=column_widths(node), row_heights=[1.0] * len(children(node, "tr")))
                across = box[2] / (max((c["col_idx"] for c in cells), default=0) + 1)
                down = box[3] / (max((c["row_idx"] for c in cells), default=0) + 1)
                found.table(at, cells, lambda c, box=box, across=across, down=down: None if c["is_spanned"] else (box[0] + c["col_idx"] * across, box[1] + c["row_idx"] * down, across * c["span_width"], down * c["span_height"]))
            elif text := texts(node):
                found.element("unknown", order, order, sheet.paragraph(node), text, source_format="docx", layout="flow")


def _drawing(package: Package, found: Found, rels: dict, sheet: Sheet, drawing, order: int, fallback: tuple) -> None:
    box = sheet.drawing(drawing, fallback)
    anchor = next(within(drawing, "anchor"), None)
    z = order if anchor is None else max(order - 1000, 0) if attr(anchor, "behindDoc", "0") in ("1", "true") else order + 100
    if text := text_box(drawing):
        found.element("text", order, z, box, text, source_format="docx", layout="floating_textbox")
        return
    target = rels.get(attr(next(within(drawing, "blip"), None), "embed"), (None, None))[0]
    if target and target not in package:
        target = f"word/media/{posixpath.basename(target)}"
    if target and target in package:
        # The number of an image is its z-order, so such ids may repeat in a page.
        ref = found.asset(posixpath.basename(target), package.read(target))
        found.element("image", z, z, box, None, source_format="docx", layout="inline" if anchor is None else "floating", image_ref=ref)
