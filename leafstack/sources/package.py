"""What the format readers share: access to the parts of a package and a collector for what they find."""

from __future__ import annotations

import dataclasses
import functools
import io
import posixpath
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
import zlib

#: Uncompressed size of one part that is still read; larger ones are refused rather than unpacked.
PART_LIMIT = 512 * 1024 * 1024
#: Bytes of parts of one package whose trees are kept for a second look.
KEPT_BYTES = 4 * 1024 * 1024


def clamp(v: float) -> float:
    return max(0.0, min(1.0, v))


@functools.lru_cache(maxsize=8192)
def _bare(name) -> str:
    return name.rpartition("}")[2] if isinstance(name, str) else ""


def local(node) -> str:
    """Name of an element or attribute without its namespace."""
    return _bare(node if isinstance(node, str) else node.tag)


def attr(node, name: str, default=None):
    """Attribute by local name; an empty one counts as absent."""
    if node is not None:
        for k, v in node.items():
            if v != "" and _bare(k) == name:
                return v
    return default


def number(text, default):
    """``text`` in the type of ``default``, or ``default``."""
    if text is None:  # most often
        return default
    try:
        return type(default)(text)
    except (TypeError, ValueError):
        return default


def child(node, *path: str):
    """First descendant along a path of local names, or None."""
    for name in path:
        if node is None:
            return None
        for c in node:
            if _bare(c.tag) == name:
                node = c
                break
        else:
            return None
    return node


def children(node, name: str) -> list:
    return [] if node is None else [c for c in node if _bare(c.tag) == name]


def within(node, name: str):
    for x in node.iter():
        if _bare(x.tag) == name:
            yield x


def all_within(node, name: str) -> list:
    """As :func:`within`, all at once: one pass over the names in use, one over the tree for the name that fits."""
    tags = [t for t in {x.tag for x in node.iter()} if _bare(t) == name]
    return list(node.iter(tags[0])) if len(tags) == 1 else [x for x in node.iter() if x.tag in tags]


def texts(node) -> str:
    """All text runs below ``node``, joined and stripped."""
    return "".join(t.text for t in within(node, "t") if t.text).strip()


def part_number(name: str) -> int:
    return int(re.sub(r"\D", "", posixpath.splitext(posixpath.basename(name))[0]) or 0)


class Package:
    """A zip of XML parts."""

    def __init__(self, content: bytes):
        self.content = content
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()
        self._known = set(self.names)
        self._trees: dict = {}
        self._room = KEPT_BYTES

    def __contains__(self, name: str) -> bool:
        return name in self._known

    def read(self, name: str) -> bytes:
        if self.zip.getinfo(name).file_size > PART_LIMIT:
            raise ValueError(f"part {name} is larger than {PART_LIMIT} bytes")
        data = self._unpacked(self.zip.getinfo(name))
        return self.zip.read(name) if data is None else data

    def _unpacked(self, info: zipfile.ZipInfo) -> bytes | None:
        """A small deflated part without the cost of a file object; None leaves all that is unusual or broken to zipfile."""
        at = info.header_offset
        if info.compress_type != zipfile.ZIP_DEFLATED or info.flag_bits & 0x21 or not 0 < info.file_size <= KEPT_BYTES or at < 0 or self.content[at : at + 4] != b"PK\3\4" or len(self.content) < at + 30:
            return None
        named, more = struct.unpack_from("<HH", self.content, at + 26)
        start = at + 30 + named + more
        if self.content[at + 30 : at + 30 + named] != info.orig_filename.encode("utf-8" if info.flag_bits & 0x800 else "cp437", "replace"):
            return None
        try:
            data = zlib.decompressobj(-15).decompress(self.content[start : start + info.compress_size], info.file_size)
        except zlib.error:
            return None
        return data if len(data) == info.file_size and zlib.crc32(data) == info.CRC else None

    def xml(self, name: str):
        """Tree of a part. Trees of small parts are kept, so nobody may change one."""
        if name in self._trees:
            return self._trees[name]
        data = self.read(name)
        tree = ET.fromstring(data)
        if len(data) <= self._room:
            self._room -= len(data)
            self._trees[name] = tree
        return tree

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Id -> (part name, kind) of a part's relations."""
        folder, name = posixpath.split(part)
        path = f"{folder}/_rels/{name}.rels"
        out = {}
        if path in self:
            for r in self.xml(path):
                target = attr(r, "Target")
                if attr(r, "Id") and target and attr(r, "TargetMode") != "External":
                    full = target[1:] if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                    out[attr(r, "Id")] = (full, (attr(r, "Type") or "").rpartition("/")[2])
        return out


@dataclasses.dataclass
class Options:
    include_master_shapes: bool = True
    deduplicate_master_shapes: bool = True
    keep_assets: bool = False
    assets_name: str | None = None


class Found:
    """Pages, elements, cells and assets of one package, in order."""

    def __init__(self, options: Options):
        self.options = options
        self.pages: list[dict] = []
        self.elements: list[dict] = []
        self.cells: list[dict] = []
        self.assets: list[dict] = []

    def page(self, width: float, height: float, **meta) -> int:
        self.pages.append({"page_number": len(self.pages) + 1, "width": width, "height": height, **meta})
        self._ordinal = 0
        return len(self.pages)

    def element(self, kind: str, number_: int, z: int, box: tuple, text: str | None, **meta) -> int:
        """Add an element to the current page; returns its ordinal."""
        page, ordinal = len(self.pages), self._ordinal
        self._ordinal += 1
        x, y, w, h = map(float, box)
        self.elements.append({"page_number": page, "ordinal": ordinal, "element_id": f"E_{page:03d}_{number_:04d}", "element_type": kind, "z_order": z, "x": x, "y": y, "width": w, "height": h, "text": text, **meta})
        return ordinal

    def table(self, ordinal: int, cells: list[dict], boxes=None) -> None:
        page, none = len(self.pages), (None,) * 4
        for i, c in enumerate(cells):
            cx, cy, cw, ch = (boxes(c) if boxes else None) or none
            self.cells.append({"page_number": page, "ordinal": ordinal, "cell_idx": i, **c, "cx": cx, "cy": cy, "cw": cw, "ch": ch})

    def asset(self, filename: str, data: bytes) -> str:
        """Keep a file if assets are wanted; returns what elements refer to it by."""
        if not self.options.keep_assets:
            return filename
        self.assets.append({"name": filename, "data": data})
        return f"{self.options.assets_name}/{filename}" if self.options.assets_name else filename


def cell(row: int, col: int, text: str | None, spanned: bool = False, width: int = 1, height: int = 1, origin: bool = False, formatted: str | None = None) -> dict:
    return {"row_idx": row, "col_idx": col, "text": None if spanned else text, "is_spanned": spanned, "span_width": width, "span_height": height, "is_merge_origin": origin, "formatted_text": formatted}


def spread(rows: list[list[tuple]]) -> list[dict]:
    """Cells of a table given as rows of (text, width, height, continues), each placed at the next free column.

    Every origin cell is marked as such; the places it covers, and cells that continue one above, are spanned.
    """
    taken: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(rows):
        c = 0
        for text, width, height, continues in row:
            while (r, c) in taken:
                c += 1
            for dr in range(height):
                for dc in range(width):
                    first = dr == dc == 0 and not continues
                    out.append(cell(r + dr, c + dc, text, not first, width if first else 1, height if first else 1, first))
                    taken.add((r + dr, c + dc))
            c += width
    return out


def piped(cells: list[dict]) -> str | None:
    """Plain text of a table: cells that have text, by row."""
    lines: dict[int, list[str]] = {}
    for c in cells:
        if not c["is_spanned"] and c["text"]:
            lines.setdefault(c["row_idx"], []).append(c["text"])
    return "\n".join(" | ".join(lines[r]) for r in sorted(lines)) or None


def stacked_box(index: int, height: float = 0.08) -> tuple:
    """Stand-in for the box of the index-th block of a document without coordinates."""
    return 0.02, clamp(index * height), 0.96, height
