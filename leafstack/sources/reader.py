"""Packages at corpus scale: binary files to pages, elements, cells and assets.

Each package is parsed once, in a Python worker, to one row of nested lists; the lists then become frames.
"""

from __future__ import annotations

import dataclasses
import gc
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from leafstack import schema
from leafstack.common import written
from leafstack.sources import docx, hwpx, pptx, xlsx
from leafstack.sources.package import Found, Options, Package

#: Readers in order of preference: suffixes, function. A reader of one's own goes in front.
READERS: list[tuple[tuple[str, ...], Callable]] = [
    ((".pptx",), pptx.read),
    ((".docx", ".docm"), docx.read),
    ((".xlsx", ".xlsm", ".xltx", ".xltm"), xlsx.read),
    ((".hwpx",), hwpx.read),
]

#: Packages leave a worker together until they have so many pages, elements and cells.
BATCH_ROWS = 4096


def find_reader(path: str) -> Callable:
    for suffixes, reader in READERS:
        if path.lower().endswith(suffixes):
            return reader
    raise ValueError(f"no reader for {path}")


def _lists(kind: str, ddl: str) -> str:
    fields = ", ".join(f.strip().replace(" ", ":", 1) for f in ddl.split(", ") if not f.startswith("doc_id "))
    return f"{kind} array<struct<{fields}>>"


PARSED = ", ".join(["doc_id string", "error string", _lists("pages", schema.PAGES), _lists("elements", schema.ELEMENTS), _lists("cells", schema.CELLS), "assets array<struct<name:string,data:binary>>"])


def parse(path: str, content: bytes, options: Options = Options()) -> Found:
    """Parse one package; errors of the file propagate."""
    found = Found(options)
    find_reader(path)(Package(content), found)
    return found


def parse_row(path: str, content: bytes, options: Options, strict: bool) -> dict:
    empty = {"doc_id": path, "error": None, "pages": [], "elements": [], "cells": [], "assets": []}
    collects = gc.isenabled()
    gc.disable()  # trees and rows hold no cycles; the collector would walk them again and again
    try:
        got = parse(path, content, options)
    except Exception as e:  # a broken file must not stop a corpus
        if strict:
            raise
        return empty | {"error": f"{type(e).__name__}: {e}"[:500]}
    finally:
        if collects:
            gc.enable()
    return empty | {"pages": got.pages, "elements": got.elements, "cells": got.cells, "assets": got.assets}


def parse_packages(files: DataFrame, options: Options = Options(), strict: bool = False) -> DataFrame:
    """(doc_id, error, pages, elements, cells, assets) of a frame with ``path`` and ``content``.

    Broken packages and those without a reader give a row with ``error`` and empty lists, or stop the job if ``strict``.
    """
    arrow = to_arrow_schema(_parse_datatype_string(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, content in zip(batch.column(0), batch.column(1)):  # one package at a time: they may be large
                rows.append(row := parse_row(path.as_py(), content.as_py(), options, strict))
                held += BATCH_ROWS if row["assets"] else len(row["cells"]) + len(row["elements"]) + len(row["pages"])
                if held >= BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return files.select("path", "content").mapInArrow(run, PARSED)


def parse_cells(files: DataFrame, columns: list[str], options: Options = Options(), strict: bool = False) -> DataFrame:
    """(doc_id, *columns) of all cells of a frame with ``path`` and ``content``, for those who want nothing else.

    ``columns`` are those of cells, or else of the page they are on. The rows leave the workers as columns, so no nested
    lists are built; broken packages give none.
    """
    types = {n: t for ddl in (schema.PAGES, schema.CELLS) for n, t in (f.strip().split(" ") for f in ddl.split(", "))}
    ddl = ", ".join(f"{n} {types[n]}" for n in ("doc_id", *columns))
    arrow = to_arrow_schema(_parse_datatype_string(ddl))
    of_cell = {f.strip().split(" ")[0] for f in schema.CELLS.split(", ")}

    def taken(docs: list[str], cells: list[dict], of_page: list[dict]) -> pa.RecordBatch:
        values = [docs, *([c.get(n) for c in cells] if n in of_cell else [p.get(n) for p in of_page] for n in columns)]
        return pa.record_batch([pa.array(v, f.type) for v, f in zip(values, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, cells, of_page = [], [], []
            for path, content in zip(batch.column(0), batch.column(1)):
                row = parse_row(path.as_py(), content.as_py(), options, strict)
                docs += [row["doc_id"]] * len(row["cells"])
                cells += row["cells"]
                if not of_cell.issuperset(columns):
                    of_page += [row["pages"][c["page_number"] - 1] for c in row["cells"]]
                if len(cells) >= BATCH_ROWS:
                    yield taken(docs, cells, of_page)
                    docs, cells, of_page = [], [], []
            if cells:
                yield taken(docs, cells, of_page)

    return files.select("path", "content").mapInArrow(run, ddl)


@dataclasses.dataclass(frozen=True)
class Frames:
    pages: DataFrame
    elements: DataFrame
    cells: DataFrame
    assets: DataFrame
    errors: DataFrame


def frames(parsed: DataFrame) -> Frames:
    """The lists of :func:`parse_packages` as frames; the parsed rows are written once, so no package is read again."""
    rows = written(parsed, "parsed")
    flat = lambda name: rows.select("doc_id", F.explode(name).alias("r")).select("doc_id", "r.*")
    return Frames(flat("pages"), flat("elements"), flat("cells"), flat("assets"), rows.filter("error IS NOT NULL").select("doc_id", "error"))


def read_packages(spark: SparkSession, path: str, options: Options = Options(), strict: bool = False) -> Frames:
    """All packages under ``path``; files without a reader aren't opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    known = F.lower(F.col("path")).rlike("(" + "|".join(s.replace(".", r"\.") for suffixes, _ in READERS for s in suffixes) + ")$")
    return frames(parse_packages(files.filter(known), options, strict))


class OfficeDataSource(DataSource):
    """``spark.read.format("officedoc").option("table", "elements").load(path)``: the elements, pages or cells of all
    packages of a local or mounted folder. ``batch_bytes`` of packages (64 MB) make one partition."""

    @classmethod
    def name(cls) -> str:
        return "officedoc"

    def _table(self) -> str:
        table = self.options.get("table", "elements").lower()
        if table not in _TABLES:
            raise ValueError(f"table must be one of {sorted(_TABLES)}")
        return table

    def schema(self) -> str:
        return _TABLES[self._table()]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _OfficeReader(self.options, self._table())


_TABLES = {"pages": schema.PAGES, "elements": schema.ELEMENTS, "cells": schema.CELLS}


class _OfficeReader(DataSourceReader):
    def __init__(self, options, table: str):
        self.path, self.table = options["path"], table
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.batch_bytes = int(options.get("batch_bytes", 64 * 1024 * 1024))

    def partitions(self) -> list[InputPartition]:
        if os.path.isfile(self.path):
            return [InputPartition([self.path])]
        known = tuple(s for suffixes, _ in READERS for s in suffixes)
        batches, held = [], 0
        for path in sorted(os.path.join(root, n) for root, _, names in os.walk(self.path) for n in names if n.lower().endswith(known)):
            if not batches or held >= self.batch_bytes:
                batches.append([])
                held = 0
            batches[-1].append(path)
            held += os.path.getsize(path)
        return [InputPartition(b) for b in batches]

    def read(self, partition: InputPartition):
        names = [f.strip().split(" ")[0] for f in _TABLES[self.table].split(", ")]
        for path in partition.value:
            with open(path, "rb") as f:
                row = parse_row(path, f.read(), Options(), self.strict)
            for e in row[self.table]:
                yield tuple(path if n == "doc_id" else e.get(n) for n in names)
