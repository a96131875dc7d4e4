"""Spatial operators of a page: containment, absorption into tables and images, and the filters after them.

Every spatial join has the page key as an equality, so it runs as a hash or merge join whose residual compares boxes; a
page has tens of elements. Ties follow the page order (``ordinal``).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafstack.common import maybe_broadcast, written
from leafstack.config import ParserConfig
from leafstack.functions import geometry as geo
from leafstack.functions import text as tx
from leafstack.schema import KEY, PAGE

_CELL_BOX = ("cx", "cy", "cw", "ch")


def by_area(elements: DataFrame, name: str) -> DataFrame:
    """Rank of each element in its page, largest area first."""
    w = Window.partitionBy(*PAGE).orderBy(F.desc(geo.area(F.col("width"), F.col("height"))), "ordinal")
    return elements.withColumn(name, F.row_number().over(w))


def containment_parents(elements: DataFrame, cfg: ParserConfig) -> DataFrame:
    """The tightest container of each contained element: page key, ordinal, parent_ordinal, ratio, first_rank, child_rank.

    A container has a larger area (or the same and stands earlier), holds at least ``containment_threshold`` of the element
    and is, like the element, no table; flow paragraphs are never contained. ``first_rank`` is the rank of the largest
    qualifying container; merging goes in the order of (first_rank, child_rank).
    """
    ranked = by_area(elements.select(*KEY, "element_type", "layout", "x", "y", "width", "height").filter("element_type <> 'table'"), "rank")
    parent, child = ranked.alias("p"), ranked.filter("coalesce(layout, '') <> 'flow'").alias("c")
    ratio = geo.containment(geo.box("c"), geo.box("p"))
    same = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in PAGE]
    pairs = parent.join(child, [*same, F.col("p.rank") < F.col("c.rank"), ratio >= cfg.containment_threshold])
    pairs = pairs.select(*(F.col(f"c.{k}").alias(k) for k in KEY), F.col("c.rank").alias("child_rank"), F.struct(F.col("p.rank").alias("rank"), F.col("p.ordinal").alias("ordinal"), ratio.alias("ratio")).alias("parent"))
    best = pairs.groupBy(*KEY, "child_rank").agg(F.max("parent").alias("best"), F.min("parent.rank").alias("first_rank"))
    return best.select(*KEY, F.col("best.ordinal").alias("parent_ordinal"), F.col("best.ratio").alias("ratio"), "first_rank", "child_rank")


_MERGED = "array<struct<ordinal:int,new_text:string,absorbed_by:string,merged_children:array<string>,absorbed_children:array<struct<element_id:string,type:string,content:string>>>>"


def _image_mark(element_id: str, ref: str | None) -> str:
    return f"![{element_id}]({ref or 'image-not-exported'})"


def fold_page(rows: list[dict]) -> list[dict]:
    """Merge the groups of one page in order; a parent's text is what earlier groups left of it."""
    at = {r["ordinal"]: r for r in rows}
    text = {o: (r["text"] or "").strip() for o, r in at.items()}
    out = {o: {"ordinal": o, "new_text": r["text"], "absorbed_by": None, "merged_children": None, "absorbed_children": None} for o, r in at.items()}
    groups: dict[int, list[int]] = {}
    for r in sorted((r for r in rows if r["parent_ordinal"] is not None), key=lambda r: (r["first_rank"], r["child_rank"])):
        groups.setdefault(r["parent_ordinal"], []).append(r["ordinal"])
    for parent, children in groups.items():
        top = at[parent]
        if top["element_type"] not in ("text", "unknown", "group"):
            continue
        children.sort(key=lambda o: (at[o]["y"], at[o]["x"]))  # equal places keep the order in which they were found
        only_text = top["element_type"] == "text" and all(at[c]["element_type"] == "text" for c in children)
        parts, items = [text[parent]] if text[parent] else [], []
        for c in children:
            kind = at[c]["element_type"]
            out[c]["absorbed_by"] = top["element_id"]
            if kind == "text" and text[c] and text[c] not in parts:
                parts.append(text[c])
            if not only_text and (content := _image_mark(at[c]["element_id"], at[c]["image_ref"]) if kind == "image" else text[c]):
                items.append({"element_id": at[c]["element_id"], "type": kind, "content": content})
        if parts:
            out[parent]["new_text"] = "\n".join(parts)
            text[parent] = out[parent]["new_text"].strip()
        if only_text:
            out[parent]["merged_children"] = [at[c]["element_id"] for c in children]
        elif items:
            out[parent]["absorbed_children"] = items
    return list(out.values())


_FOLDED = ("ordinal", "element_id", "element_type", "x", "y", "text", "image_ref", "parent_ordinal", "first_rank", "child_rank")


def resolve_containment(elements: DataFrame, cfg: ParserConfig) -> DataFrame:
    """Elements with texts merged into their containers: ``text`` replaced, ``absorbed_by``, ``merged_children`` and
    ``absorbed_children`` added.

    A text container with text children joins the distinct texts by line feeds, children by (y, x); other text, unknown and
    group containers gather their children and join the texts among them; images and charts gather nothing. Only
    containers and what they contain go through Python, each page as one list.
    """

    @F.pandas_udf(_MERGED)
    def fold(pages: pd.Series) -> pd.Series:
        return pd.Series([fold_page([dict(zip(_FOLDED, r.values())) for r in page]) for page in pages], dtype=object)

    # Ids and texts go to the pages only of elements that contain or are contained.
    edges = written(containment_parents(elements, cfg).select(*KEY, "parent_ordinal", "first_rank", "child_rank"), "contained")
    members = edges.select(*KEY).unionByName(edges.select(*PAGE, F.col("parent_ordinal").alias("ordinal"))).distinct()
    rows = elements.select(*KEY, "element_id", "element_type", "x", "y", "text", "image_ref").join(maybe_broadcast(members), KEY, "left_semi").join(maybe_broadcast(edges), KEY, "left")
    pages = rows.groupBy(*PAGE).agg(F.collect_list(F.struct(*_FOLDED)).alias("rows"))
    merged = pages.select(*PAGE, F.explode(fold("rows")).alias("m")).select(*PAGE, "m.*", F.lit(True).alias("__hit"))
    both = elements.join(merged, KEY, "left")
    return both.withColumn("text", F.when(F.col("__hit"), F.col("new_text")).otherwise(F.col("text"))).drop("new_text", "__hit")


def cell_boxes(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with their boxes (cx, cy, cw, ch): equal columns and rows of the table's box; spanned cells have none."""
    size = Window.partitionBy(*KEY)
    grid = cells.withColumn("rows", F.max("row_idx").over(size) + 1).withColumn("cols", F.max("col_idx").over(size) + 1)
    both = grid.join(tables.select(*KEY, "x", "y", "width", "height"), KEY)
    step_x, step_y = F.col("width") / F.col("cols"), F.col("height") / F.col("rows")
    free = ~F.coalesce("is_spanned", F.lit(False))
    sizes = {"cx": F.col("x") + step_x * F.col("col_idx"), "cy": F.col("y") + step_y * F.col("row_idx"), "cw": step_x * F.coalesce("span_width", F.lit(1)), "ch": step_y * F.coalesce("span_height", F.lit(1))}
    return both.withColumns({k: F.when(free, v) for k, v in sizes.items()}).drop("rows", "cols", "x", "y", "width", "height")


def table_claims(elements: DataFrame, cells: DataFrame, cfg: ParserConfig) -> DataFrame:
    """Best cell of each table for each candidate that fits into one: page key, table_ordinal, table_rank, ordinal,
    cell_idx, ratio.

    Candidates are all elements but groups and those absorbed by a container; the larger share wins, the first cell of
    equals. ``elements`` may lack ``absorbed_by``.
    """
    free = elements if "absorbed_by" not in elements.columns else elements.filter("absorbed_by IS NULL")
    # Most tables are alone on their page; cells go to the pages only of those that something could fit into.
    candidate = F.when((F.col("element_type") != "group") & (F.lit(True) if free is elements else F.col("absorbed_by").isNull()), F.col("ordinal"))
    page = Window.partitionBy(*PAGE)
    beside = elements.withColumns({"__low": F.min(candidate).over(page), "__high": F.max(candidate).over(page)}).filter("element_type = 'table'")
    beside = by_area(beside, "table_rank").filter("__low <> ordinal OR __high <> ordinal")
    tables = written(beside.select(*PAGE, F.col("ordinal").alias("table_ordinal"), "table_rank"), "tables")
    slots = cells.filter("cx IS NOT NULL AND NOT coalesce(is_spanned, false)").select(*PAGE, F.col("ordinal").alias("table_ordinal"), "cell_idx", *_CELL_BOX).join(maybe_broadcast(tables), [*PAGE, "table_ordinal"])
    ratio = geo.containment(geo.box("c"), geo.box("s", _CELL_BOX))
    c = free.filter("element_type <> 'group'").select(*KEY, "x", "y", "width", "height").alias("c")
    same = [F.col(f"c.{k}") == F.col(f"s.{k}") for k in PAGE]
    hits = c.join(slots.alias("s"), [*same, F.col("c.ordinal") != F.col("s.table_ordinal"), ratio >= cfg.table_cell_containment_threshold, ratio > 0])
    best = hits.groupBy(*(F.col(f"c.{k}").alias(k) for k in KEY), "s.table_ordinal", "s.table_rank").agg(F.max(F.struct(ratio.alias("ratio"), (-F.col("s.cell_idx")).alias("idx"))).alias("best"))
    return best.select(*KEY, "table_ordinal", "table_rank", (-F.col("best.idx")).alias("cell_idx"), F.col("best.ratio").alias("ratio"))


def absorb_into_tables(elements: DataFrame, cells: DataFrame, cfg: ParserConfig) -> DataFrame:
    """Which cell takes which element: page key, ordinal, table_ordinal, cell_idx, ratio.

    Tables take in the order of their area; a table that an earlier active one has taken takes nothing itself. That order
    is a fold over the page's few tables, done on one array per page.
    """
    claims = table_claims(elements, cells, cfg)
    tables = by_area(elements.filter("element_type = 'table'"), "rank").select(*KEY, "rank")
    nested = claims.join(tables, KEY).select(*PAGE, F.col("table_rank").alias("by"), F.col("rank").alias("taken"))
    # Only pages where a table could take a table need the fold.
    order = nested.groupBy(*PAGE, "by").agg(F.collect_set("taken").alias("taken")).groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("by", "taken"))).alias("steps"))
    gone = F.aggregate("steps", F.array().cast("array<int>"), lambda acc, s: F.when(F.array_contains(acc, s["by"]), acc).otherwise(F.array_union(acc, s["taken"])))
    active = claims.join(order.select(*PAGE, gone.alias("gone")), PAGE, "left").filter("gone IS NULL OR NOT array_contains(gone, table_rank)")
    first = active.groupBy(*KEY).agg(F.min(F.struct("table_rank", "table_ordinal", "cell_idx", "ratio")).alias("m"))
    return first.select(*KEY, "m.table_ordinal", "m.cell_idx", "m.ratio")


def annotate_images(elements: DataFrame, cfg: ParserConfig) -> DataFrame:
    """Short labels that lie on an image: page key, ordinal, image_ordinal, ratio. The largest image that holds one wins.

    Elements absorbed before (columns ``absorbed_by``, ``table_ordinal``, where present) are no labels, but absorbed
    images still take labels.
    """
    free = elements
    for c in ("absorbed_by", "table_ordinal"):
        if c in elements.columns:
            free = free.filter(F.col(c).isNull())
    size = F.length(tx.stripped(F.col("text")))
    labels = free.filter(F.col("element_type").isin("text", "unknown") & size.between(1, cfg.image_annotation_max_text_len)).select(*KEY, "x", "y", "width", "height").alias("c")
    images = by_area(elements.filter("element_type = 'image'"), "rank").select(*KEY, "rank", "x", "y", "width", "height").alias("i")
    ratio = geo.containment(geo.box("c"), geo.box("i"))
    hits = labels.join(images, [*(F.col(f"c.{k}") == F.col(f"i.{k}") for k in PAGE), ratio >= cfg.image_annotation_containment_threshold])
    first = hits.groupBy(*(F.col(f"c.{k}").alias(k) for k in KEY)).agg(F.min(F.struct("i.rank", F.col("i.ordinal").alias("image_ordinal"), ratio.alias("ratio"))).alias("m"))
    return first.select(*KEY, "m.image_ordinal", "m.ratio")


def is_noise(cfg: ParserConfig):
    """Empty text and unknown elements, and tiny elements without text."""
    empty = tx.stripped(F.col("text")) == ""
    return empty & (F.col("element_type").isin("unknown", "text") | (F.col("width") * F.col("height") < cfg.min_element_area))


def drop_noise(elements: DataFrame, cfg: ParserConfig) -> DataFrame:
    return elements.filter(~is_noise(cfg))
