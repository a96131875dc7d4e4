"""Hangul packages: one page per section, blocks stacked in order."""

from __future__ import annotations

import posixpath

from leafstack.sources.package import Found, Package, children, local, number, part_number, spread, stacked_box, texts, within


def section_names(names: list[str]) -> list[str]:
    own = [n for n in names if n.startswith("Contents/section") and n.endswith(".xml")]
    return sorted(own, key=part_number) or sorted(n for n in names if "section" in n.lower() and n.endswith(".xml"))


def blocks(root):
    for node in root:
        if local(node) in ("p", "tbl", "pic", "img"):
            yield node
        elif local(node) in ("sec", "section"):
            yield from blocks(node)


def _span(tc, name: str) -> int:
    if not tc.items():
        return 1
    for key in (name, name.lower(), f"hp:{name}"):
        if tc.get(key) is not None:
            return max(number(tc.get(key), 1), 1)
    return 1


def table(tbl) -> tuple[list[dict], str | None]:
    """Cells, and rows of text with one place per column."""
    rows = list(tbl) if len(tbl) and local(tbl[0]) == "tr" else list(within(tbl, "tr"))
    cells = spread([[(texts(tc), _span(tc, "colSpan"), _span(tc, "rowSpan"), False) for tc in children(tr, "tc")] for tr in rows])
    lines: dict[int, dict[int, str]] = {}
    for c in cells:
        if not c["is_spanned"]:
            lines.setdefault(c["row_idx"], {})[c["col_idx"]] = c["text"]
    shown = [[by.get(i, "") for i in range(max(by) + 1)] for _, by in sorted(lines.items())]
    return cells, "\n".join(" | ".join(r) for r in shown if any(t.strip() for t in r)) or None


def image_part(node, bindata: dict[str, str]) -> str | None:
    """Part that a picture names: by file name, else the first whose name contains the reference."""
    ref = next((x.get(k) for x in node.iter() for k in ("href", "binaryItemIDRef", "binItemIDRef") if x.get(k)), None)
    if not ref:
        return None
    name = posixpath.basename(ref)
    return bindata.get(name) or bindata.get(ref) or next((p for n, p in bindata.items() if name in n or ref in p), None)


def read(package: Package, found: Found) -> None:
    bindata = {posixpath.basename(n): n for n in package.names if n.startswith("BinData/") and not n.endswith("/")}
    for name in section_names(package.names):
        found.page(1.0, 1.0, source_format="hwpx", layout_mode="structural")
        for order, node in enumerate(blocks(package.xml(name)), 1):
            kind, box = local(node), stacked_box(order - 1)
            if kind == "p":
                if text := texts(node):
                    found.element("text", order, order, box, text, source_format="hwpx")
            elif kind == "tbl":
                cells, text = table(node)
                found.table(found.element("table", order, order, box, text, source_format="hwpx"), cells)
            elif part := image_part(node, bindata):
                ref = found.asset(posixpath.basename(part), package.read(part))
                found.element("image", order, order, box, None, source_format="hwpx", image_ref=ref)
    if not found.pages:
        found.page(1.0, 1.0, source_format="hwpx")
