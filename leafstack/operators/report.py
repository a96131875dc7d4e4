"""Debug reports and the nested JSON form of parsed documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.functions import text as tx
from leafstack.schema import KEY, PAGE

PREVIEW = 120


def counts(pages: DataFrame, blocks: DataFrame, relations: DataFrame) -> DataFrame:
    """doc_id, num_pages, num_blocks, num_relations of every document."""
    n = lambda df, name: df.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    return n(pages, "num_pages").join(n(blocks, "num_blocks"), "doc_id", "left").join(n(relations, "num_relations"), "doc_id", "left").fillna(0)


def _listed(df: DataFrame, keys: list[str], order: str | list[str], item, name: str) -> DataFrame:
    """Items of each group as an array, by ``order``, whose values are unique in the group."""
    place = F.struct(*([order] if isinstance(order, str) else order))
    got = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(place.alias("o"), item.alias("v")))).alias("l"))
    return got.select(*keys, F.transform("l", lambda x: x["v"]).alias(name))


def debug_report(pages: DataFrame, ordered: DataFrame, blocks: DataFrame, relations: DataFrame, decisions: DataFrame) -> DataFrame:
    """(doc_id, report): JSON of counts, blocks, relations and pages with element previews and caption decisions."""
    box = F.struct("x", "y", "width", "height")
    element = F.struct("element_id", F.col("element_type").alias("type"), box.alias("bbox"), F.substring(F.coalesce("text", F.lit("")), 1, PREVIEW).alias("text_preview"))
    els = _listed(ordered, ["doc_id", "page_number"], "read_ord", element, "elements")
    dec = _listed(decisions, ["doc_id", "page_number"], "decision_idx", F.struct("visual_element_id", "text_element_id", "score", "method", "rejected_reason"), "caption_candidate_decisions")
    page = pages.select("doc_id", "page_number").join(els, ["doc_id", "page_number"], "left").join(dec, ["doc_id", "page_number"], "left")
    page = page.withColumn("num_elements", F.coalesce(F.size("elements"), F.lit(0)))
    per = _listed(page, ["doc_id"], "page_number", F.struct("page_number", "num_elements", "elements", "caption_candidate_decisions"), "pages")
    blk = _listed(blocks, ["doc_id"], ["page_number", "block_idx"], F.struct("block_id", "kind", "level", F.substring("title_text", 1, PREVIEW).alias("title_text"), "parent_block_id", "section_path", "element_ids", "page_number"), "blocks")
    rel = _listed(relations, ["doc_id"], "rel_idx", F.struct("relation_type", "source_element_id", "target_element_id", "confidence"), "relations")
    both = counts(pages, blocks, relations).join(blk, "doc_id", "left").join(rel, "doc_id", "left").join(per, "doc_id", "left")
    return both.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("source_path"), "num_pages", "num_blocks", "num_relations", "blocks", "relations", "pages")).alias("report"))


def table_cells(cells: DataFrame) -> DataFrame:
    """KEY and ``table_cells``: the cells of each table in order, with their boxes and the elements they have taken in."""
    box = F.when(F.col("cx").isNotNull(), F.struct(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cw").alias("width"), F.col("ch").alias("height")))
    item = [F.col("row_idx").alias("row"), F.col("col_idx").alias("col"), "text", "formatted_text", "is_spanned", "span_width", "span_height", box.alias("cell_bbox")]
    if "is_merge_origin" in cells.columns:
        item.insert(7, F.col("is_merge_origin"))
    if "absorbed_elements" in cells.columns:
        names = ("element_id", "type", "content", "containment", "y", "x")
        item.append(F.transform("absorbed_elements", lambda a: F.struct(*(a[n].alias(n) for n in names), a["width"].alias("display_width_px"))).alias("absorbed_elements"))
    return _listed(cells, KEY, ["cell_idx"], F.struct(*item), "table_cells")


def image_annotations(elements: DataFrame) -> DataFrame:
    """KEY and ``annotations``: the labels that images have taken in, by (y, x)."""
    got = elements.filter("image_ordinal IS NOT NULL").withColumn("target", F.col("image_ordinal"))
    item = F.struct("element_id", tx.stripped(F.col("text")).alias("text"), "y", "x", F.col("image_ratio").alias("containment"))
    return _listed(got, [*PAGE, "target"], ["y", "x", "ordinal"], item, "annotations").withColumnRenamed("target", "ordinal")


def document_json(pages: DataFrame, ordered: DataFrame, blocks: DataFrame, relations: DataFrame, cells: DataFrame | None = None, annotations: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): the whole document as one nested object, fields that are null left out.

    ``cells`` and ``annotations``: see :func:`table_cells` and :func:`image_annotations`.
    """
    skip = {"doc_id", "page_number", "ordinal", "read_ord", "x", "y", "width", "height", "table_ordinal", "image_ordinal", "image_ratio", "absorbed_by"}
    for more in (cells, annotations):
        if more is not None:
            ordered = ordered.join(more, KEY, "left")
    meta = F.struct(*(F.col(f"`{c}`") for c in ordered.columns if c not in skip | {"element_id", "element_type", "z_order", "text"}))
    element = F.struct("element_id", "element_type", "page_number", "z_order", F.struct("x", "y", "width", "height").alias("bbox"), "text", meta.alias("metadata"))
    els = _listed(ordered, ["doc_id", "page_number"], "read_ord", element, "elements")
    page = pages.join(els, ["doc_id", "page_number"], "left")
    page_meta = F.struct(*(F.col(f"`{c}`") for c in pages.columns if c not in ("doc_id", "page_number", "width", "height")))
    per = _listed(page, ["doc_id"], "page_number", F.struct("page_number", "width", "height", "elements", page_meta.alias("metadata")), "pages")
    blk = _listed(blocks, ["doc_id"], ["page_number", "block_idx"], F.struct("block_id", "kind", "page_number", "level", "title_text", "element_ids", "parent_block_id", "section_path", "bbox"), "blocks")
    parts = [F.col(c) for c in ("relation_type", "source_element_id", "target_element_id", "confidence")]
    told = F.struct(*(c for c in ("page_number", "method", "rule_score", "caption_text", "score_breakdown") if c in relations.columns))
    rel = _listed(relations, ["doc_id"], "rel_idx", F.struct(*parts, told.alias("metadata")), "relations")
    both = per.join(rel, "doc_id", "left").join(blk, "doc_id", "left")
    return both.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("source_path"), "pages", "relations", "blocks")).alias("json"))
