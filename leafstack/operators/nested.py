"""Nested records into related flat tables (problem 4).

The JVM reads each payload once as a variant and shapes it to one typed nested column: a bare object becomes a list of
one, JSON inside a string is opened, numbers in any spelling become numbers, absent fields become null. The flattening
itself works on Arrow buffers: child rows come from the lists' flattened values, parent links from parent-index kernels,
and the keys are taken to the children as whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.common import maybe_broadcast, written

_ABSORBED = "struct<element_id:string,type:string,content:string,containment:double,y:double,x:double>"
_BOX = "struct<x:double,y:double,width:double,height:double>"
_CELL = f"struct<row:int,col:int,text:string,formatted_text:string,is_spanned:boolean,span_width:int,span_height:int,is_merge_origin:boolean,cell_bbox:{_BOX},absorbed_elements:array<{_ABSORBED}>>"
_ELEMENT = f"struct<element_id:string,element_type:string,z_order:int,bbox:{_BOX},text:string,metadata:string,table_cells:array<{_CELL}>>"
_PAGE = f"struct<page_number:int,width:double,height:double,metadata:string,elements:array<{_ELEMENT}>>"

LEVELS = ("pages", "elements", "cells", "absorbed")
_LINKS = {"pages": ["page_pos"], "elements": ["page_pos", "element_pos"], "cells": ["page_pos", "element_pos", "cell_pos"], "absorbed": ["page_pos", "element_pos", "cell_pos", "absorbed_pos"]}
_FIELDS = {
    "pages": "page_number int, width double, height double, metadata string",
    "elements": f"element_id string, element_type string, z_order int, bbox {_BOX}, text string, metadata string",
    "cells": f"row int, col int, text string, formatted_text string, is_spanned boolean, span_width int, span_height int, is_merge_origin boolean, cell_bbox {_BOX}",
    "absorbed": "element_id string, type string, content string, containment double, y double, x double",
}


def _list(v: str, path: str) -> str:
    """SQL: the list at ``path``, a bare object (or other value) as a list of one, null and absent as null."""
    got = f"try_variant_get({v}, '{path}', 'variant')"
    return f"coalesce(try_variant_get({v}, '{path}', 'array<variant>'), CASE WHEN {got} IS NOT NULL AND NOT is_variant_null({got}) THEN array({got}) END)"


def _text(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'string')"


def _double(v: str, path: str) -> str:
    return f"coalesce(try_variant_get({v}, '{path}', 'double'), try_cast(trim({_text(v, path)}) AS double))"


def _int(v: str, path: str) -> str:
    return f"try_cast({_double(v, path)} AS int)"


def _bool(v: str, path: str) -> str:
    return f"coalesce(try_variant_get({v}, '{path}', 'boolean'), try_cast(trim({_text(v, path)}) AS boolean))"


def _box(v: str, path: str) -> str:
    fields = ", ".join(f"'{k}', {_double(v, f'{path}.{k}')}" for k in ("x", "y", "width", "height"))
    return f"CASE WHEN try_variant_get({v}, '{path}', 'map<string,variant>') IS NOT NULL THEN named_struct({fields}) END"


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {e}" for k, e in fields.items()) + ")"


def _opened(v: str, path: str) -> str:
    """An object, or the same as JSON inside a string: read from its text either way."""
    return f"try_parse_json({_text(v, path)})"


def shaped(payload: str, level: str) -> Column:
    """Typed nested pages of the JSON column ``payload``, with the fields of ``level`` and the lists down to it; or with the
    fields of all levels, for ``level`` "all".

    Null for null or malformed payloads and for payloads without pages.
    """
    deep, whole = LEVELS.index("absorbed" if level == "all" else level), level == "all"
    absorbed = _struct({k: (_double if k in ("containment", "y", "x") else _text)("a", f"$.{k}") for k in ("element_id", "type", "content", "containment", "y", "x")})
    cell, element, page = {}, {}, {}
    if deep == 2 or whole:
        cell |= {"row": _int("c", "$.row"), "col": _int("c", "$.col"), "text": _text("c", "$.text"), "formatted_text": _text("c", "$.formatted_text")}
        cell |= {"is_spanned": _bool("c", "$.is_spanned"), "span_width": _int("c", "$.span_width"), "span_height": _int("c", "$.span_height")}
        cell |= {"is_merge_origin": _bool("c", "$.is_merge_origin"), "cell_bbox": _box("c", "$.cell_bbox")}
    if deep == 3:
        cell |= {"absorbed_elements": f"transform({_list('c', '$.absorbed_elements')}, a -> {absorbed})"}
    if deep == 1 or whole:
        element |= {"element_id": _text("e", "$.element_id"), "element_type": _text("e", "$.element_type"), "z_order": _int("e", "$.z_order"), "bbox": _box("e", "$.bbox")}
        element |= {"text": _text("e", "$.text"), "metadata": _text("e", "$.metadata")}
    if deep >= 2:
        element |= {"table_cells": f"transform(transform(array({_opened('e', '$.metadata')}), m -> {_list('m', '$.table_cells')})[0], c -> {_struct(cell)})"}
    if deep == 0 or whole:
        page |= {"page_number": _int("p", "$.page_number"), "width": _double("p", "$.width"), "height": _double("p", "$.height"), "metadata": _text("p", "$.metadata")}
    if deep >= 1:
        page |= {"elements": f"transform({_list('p', '$.elements')}, e -> {_struct(element)})"}
    return F.expr(f"transform(transform(array(try_parse_json(`{payload}`)), r -> {_list('r', '$.pages')})[0], p -> {_struct(page)})")


def _children(parents: pa.Array, keys: list[pa.Array]) -> tuple[pa.Array, list[pa.Array]]:
    """Values of a list column, with the parents' keys taken along and the position within the parent (from 1) added."""
    index = pc.list_parent_indices(parents)
    values = pc.list_flatten(parents)
    sizes = pc.fill_null(pc.list_value_length(parents), 0)
    first = pc.subtract(pc.cumulative_sum(sizes), sizes)  # where each parent's values begin
    place = pc.subtract(pa.array(np.arange(len(values), dtype=np.int64)), pc.take(first, index).cast(pa.int64()))
    return values, [*(pc.take(k, index) for k in keys), pc.add(place, 1).cast(pa.int32())]


def flatten_arrow(batch: pa.RecordBatch, key: str, level: str) -> pa.RecordBatch:
    """One level of the ``__pages`` column of ``batch`` as a flat batch, with its links to all levels above."""
    values, keys = batch.column("__pages"), [batch.column(key)]
    for depth, step in enumerate(("elements", "table_cells", "absorbed_elements", None)):
        values, keys = _children(values, keys)
        if LEVELS[depth] == level:
            break
        values = pc.struct_field(values, step)
    names = [f.split(" ")[0] for f in _FIELDS[level].split(", ")]
    if level == "absorbed":
        names = ["element_id", "type", "content", "containment", "y", "x"]
    return pa.record_batch([*keys, *(pc.struct_field(values, n) for n in names)], names=[key, *_LINKS[level], *names])


def _once(records: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, payload) of records with a payload, whole copies once; one key with two payloads keeps both.

    Only keys and hashes of the payloads are shuffled to find the copies, and only payloads that have any meet.
    """
    rows = records.filter(F.col(payload).isNotNull()).select(key, payload)
    marks = {"__a": F.xxhash64(payload), "__b": F.xxhash64(payload, F.lit(1))}
    by = [key, *marks]
    copies = written(rows.withColumns(marks).groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(*by), "record-copies")
    marked = rows.withColumns(marks)
    same = [marked[key].eqNullSafe(copies[key]), marked["__a"] == copies["__a"], marked["__b"] == copies["__b"]]
    several = marked.join(maybe_broadcast(copies), same, "left_semi").select(key, payload).distinct()
    return marked.join(maybe_broadcast(copies), same, "left_anti").select(key, payload).unionByName(several)


def _nested(rows: DataFrame, key: str, payload: str, level: str) -> DataFrame:
    return rows.select(key, shaped(payload, level).alias("__pages")).filter(F.col("__pages").isNotNull())


def _flat(nested: DataFrame, key: str, level: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield flatten_arrow(batch, key, level)

    links = ", ".join(f"{x} int" for x in _LINKS[level])
    return nested.mapInArrow(run, f"`{key}` {nested.schema[key].dataType.simpleString()}, {links}, {_FIELDS[level]}")


def flatten_records(records: DataFrame, level: str, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """One of the related tables ``pages``, ``elements``, ``cells``, ``absorbed`` of nested JSON records.

    Each row has the record's key and the positions (from 1) of itself and of all its parents, so the tables join without
    invented ids. Records that come twice give their rows once. A null, malformed or empty payload gives no rows; an absent
    or null list no children; a null entry in a list keeps its position and gives a row of nulls; a value that doesn't fit
    its type is null. Other columns of ``records`` aren't carried. For several tables see :func:`flatten_all`.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}")
    return _flat(_nested(_once(records, key, payload), key, payload, level), key, level)


def flatten_all(records: DataFrame, key: str = "record_id", payload: str = "payload") -> dict[str, DataFrame]:
    """All related tables by name, as :func:`flatten_records` gives them; payloads are parsed once.

    The typed nested form is written, and each table reads only its own fields of it.
    """
    nested = written(_nested(_once(records, key, payload), key, payload, "all"), "nested-records")

    def part(level: str) -> DataFrame:
        names = [f.split(" ")[0] for f in _FIELDS[level].split(", ")] if level != "absorbed" else ["absorbed_elements"]
        lists = ["elements", "table_cells", "absorbed_elements"]
        depth = LEVELS.index(level)

        def picked(value: Column, at: int) -> Column:
            return F.struct(*(value[n].alias(n) for n in names)) if at == min(depth, 2) else F.struct(F.transform(value[lists[at]], lambda x: picked(x, at + 1)).alias(lists[at]))

        return _flat(nested.select(key, F.transform("__pages", lambda p: picked(p, 0)).alias("__pages")), key, level)

    return {level: part(level) for level in LEVELS}


def merged_cells(records: DataFrame) -> DataFrame:
    """Positions of the cells whose span covers more than one grid cell; an absent or null span counts as 1.

    Copies of a record aren't sought before, since the few positions that come out are made distinct.
    """
    cells = _flat(_nested(records.filter(F.col("payload").isNotNull()).select("record_id", "payload"), "record_id", "payload", "cells"), "record_id", "cells")
    area = F.coalesce("span_width", F.lit(1)).cast("long") * F.coalesce("span_height", F.lit(1))
    return cells.filter(area > 1).select("record_id", "page_pos", "element_pos", "cell_pos").distinct()
