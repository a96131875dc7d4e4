"""Registered queries of the core operators, with their SQL where SQL can express them.

``document_elements`` and its neighbours are the pipeline's own tables. Spatial operators also run over a dense layout made
of order lines, where boxes overlap far more often.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafstack.common import table, written
from leafstack.config import ParserConfig
from leafstack.functions import geometry as geo
from leafstack.functions import runs
from leafstack.functions import text as tx
from leafstack.operators import evaluate, layout, markdown, nested, ordering, rag, relations, report, structure, tables
from leafstack.plans import packages, pipeline
from leafstack.plans import tables as frames
from leafstack.schema import KEY, PAGE
from leafstack.sources import reader, writer

CFG = ParserConfig()
#: Wider gaps, so that the dense layout has captions of every kind.
WIDE = ParserConfig(caption_max_gap=0.3, alignment_tolerance=0.2)


def _dense(spark: SparkSession, d: str) -> DataFrame:
    return frames.layout_elements(spark, d)


def _stored(df: DataFrame) -> DataFrame:
    """Elements in the order of the file."""
    return df.withColumn("read_ord", F.col("ordinal") + 1).withColumn("spatial_group", F.lit(None).cast("string"))


# ---- nested records


def p4_found(spark, d):
    return nested.merged_cells(table(spark, d, "raw_records"))


def _level(level: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = nested.flatten_records(table(spark, d, "raw_records"), level)
        # Metadata of any shape is kept as JSON text, whose order of keys is free; boxes stand as four columns.
        kept = [F.col("metadata").isNotNull().alias("has_metadata") if c == "metadata" else F.col(f"{c}.*") if c.endswith("bbox") else F.col(c) for c in out.columns]
        return out.select(*kept)

    return query


# ---- geometry and spatial joins


def bbox_normalize(spark, d):
    e = frames.elements(spark, d).join(frames.pages(spark, d).select(*PAGE, F.col("width").alias("pw"), F.col("height").alias("ph")), PAGE)
    box = geo.normalised(F.col("x") * F.col("pw"), F.col("y") * F.col("ph"), F.col("width") * F.col("pw"), F.col("height") * F.col("ph"), F.col("pw"), F.col("ph"))
    return e.select("element_uid", box.alias("b")).select("element_uid", "b.x", "b.y", "b.width", "b.height")


def containment_parent(spark, d):
    return layout.containment_parents(_dense(spark, d), CFG)


def containment_merge(spark, d):
    out = layout.resolve_containment(written(_dense(spark, d), "dense"), CFG)
    return out.select(*KEY, "text", "absorbed_by", F.array_join("merged_children", ",").alias("merged_children"), F.to_json("absorbed_children").alias("absorbed_children"))


def table_cell_bbox(spark, d):
    return frames.cells(spark, d, frames.elements(spark, d)).select(*KEY, "cell_idx", "cx", "cy", "cw", "ch")


def table_absorb_best_cell(spark, d):
    e = _dense(spark, d)
    return layout.table_claims(e, frames.layout_cells(e), CFG)


def table_absorb(spark, d):
    e = _dense(spark, d)
    return layout.absorb_into_tables(e, frames.layout_cells(e), CFG)


def image_annotation_absorb(spark, d):
    return layout.annotate_images(_dense(spark, d), CFG)


def noise_filter(spark, d):
    return layout.drop_noise(frames.elements(spark, d), CFG).select("element_uid")


# ---- reading order


def document_order(spark, d):
    return ordering.document_order(frames.elements(spark, d), CFG).select("element_uid", "read_ord")


def order_choice(spark, d):
    return ordering.uses_document_order(frames.pages(spark, d), frames.elements(spark, d))


def row_clustering(spark, d):
    return ordering.row_clustering(_dense(spark, d), CFG).select(*KEY, "read_ord")


def xy_cut_order(spark, d):
    return ordering.xy_cut(_dense(spark, d), CFG).select(*KEY, "read_ord", "spatial_group")


def composite_order(spark, d):
    return ordering.composite(_dense(spark, d), CFG).select(*KEY, "read_ord", "spatial_group")


def reading_order(spark, d):
    out = ordering.reading_order(frames.pages(spark, d), frames.elements(spark, d), CFG)
    return out.select("element_uid", "read_ord", "spatial_group")


# ---- relations


def title_of(spark, d):
    return relations.title_relations(_stored(frames.elements(spark, d)), CFG).select(*PAGE, "source_ordinal", "target_ordinal", "confidence")


def _candidates(spark, d):
    return relations.caption_candidates(_stored(_dense(spark, d)), WIDE)


_SCORES = ["doc_id", "page_number", "text_ordinal", "visual_ordinal"]


def caption_score(spark, d):
    return _candidates(spark, d).select(*_SCORES, *relations.scoring_parts(), "score", "relation_type")


def caption_assignment(spark, d):
    return relations.assigned(_candidates(spark, d)).select(*_SCORES, "score", "relation_type", "rejected_reason", "rank")


def caption_verified(spark, d):
    yes = F.struct((F.col("text_ordinal") % 2 == 0).alias("is_caption"), F.lit(0.91).alias("confidence"))
    return relations.verified(_candidates(spark, d), yes).select(*_SCORES, "score", "relation_type", "method")


def no_candidate_log(spark, d):
    dense = _stored(_dense(spark, d))
    return relations.without_candidate(dense, relations.caption_candidates(dense, WIDE)).select(*PAGE, "ordinal")


def caption_map_last_wins(spark, d):
    rels, _ = relations.relations(_stored(_dense(spark, d)), WIDE)
    return relations.caption_map(rels)


def flagship(spark, d):
    return caption_assignment(spark, d)


# ---- structure


def _blocks(spark, d):
    return structure.blocks(frames.pages(spark, d), _stored(frames.elements(spark, d)))


def section_path(spark, d):
    out = structure.outline(frames.pages(spark, d), _stored(frames.elements(spark, d)))
    heads = out.filter("level IS NOT NULL")
    return heads.select("element_uid", "level", F.col("parent.ordinal").alias("parent_ordinal"), F.array_join(F.transform("chain", lambda h: h["title"]), " > ").alias("path"))


def block_kinds(spark, d):
    return _blocks(spark, d).select(*PAGE, "block_idx", "block_id", "kind", "level", "title_text", F.array_join("element_ids", ",").alias("element_ids"), "parent_block_id")


def bbox_union(spark, d):
    return _blocks(spark, d).filter("bbox IS NOT NULL").select(*PAGE, "block_idx", "bbox.x", "bbox.y", "bbox.width", "bbox.height")


# ---- tables and Markdown


def _cells(spark, d):
    return frames.cells(spark, d, frames.elements(spark, d))


def table_header_rows(spark, d):
    return tables.header_rows(tables.usable(_cells(spark, d)).withColumn("content", tables.cell_content(False)))


def pipe_table(spark, d):
    return tables.pipe_tables(_cells(spark, d))


def html_table(spark, d):
    return tables.html_tables(_cells(spark, d))


def nested_html(spark, d):
    return tables.nested_html(_cells(spark, d))


def col_width_pct(spark, d):
    widths = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.floor("l_quantity").cast("double"))).alias("w"))
    return widths.select("l_orderkey", F.posexplode(tables.column_percentages(F.col("w")))).select("l_orderkey", "pos", F.col("col").alias("pct"))


def md_linebreaks(spark, d):
    e = frames.elements(spark, d).filter("text IS NOT NULL")
    return e.select("element_uid", tx.line_breaks_markdown(tx.stripped(F.col("text"))).alias("markdown"), tx.line_breaks_html(tx.stripped(F.col("text"))).alias("html"), tx.tabs_shown(F.col("text")).alias("tabs"))


def img_md_to_html(spark, d):
    e = frames.elements(spark, d).filter("element_type = 'image'")
    text = F.concat(F.lit("see ![" ), "element_id", F.lit("]("), F.coalesce("image_ref", F.lit("none.png")), F.lit(") and ![x](y.png)"))
    return e.select("element_uid", tx.images_to_html(text, F.col("ordinal") % 3).alias("html"))


def column_break(spark, d):
    out = ordering.xy_cut(_dense(spark, d), CFG)
    w = Window.partitionBy(*PAGE).orderBy("read_ord")
    return out.select(*KEY, markdown.column_break(F.lag("spatial_group").over(w), F.col("spatial_group")).alias("breaks"))


def markdown_page(spark, d):
    return markdown.render_pages(frames.pages(spark, d), _stored(frames.elements(spark, d)), CFG)


def _parsed(spark, d):
    return pipeline.parse(frames.pages(spark, d), frames.elements(spark, d), _cells(spark, d), CFG)


def markdown_document(spark, d):
    return _parsed(spark, d).markdown()


def pipeline_elements(spark, d):
    return _parsed(spark, d).elements.select("element_uid", "text", "absorbed_by", "table_ordinal", "image_ordinal")


def pipeline_order(spark, d):
    return _parsed(spark, d).ordered.select("element_uid", "read_ord", "spatial_group")


def pipeline_relations(spark, d):
    return _parsed(spark, d).relations.select(*PAGE, "rel_idx", "relation_type", "source_element_id", "target_element_id", "confidence", "method", "caption_text")


def pipeline_blocks(spark, d):
    return _parsed(spark, d).blocks.select(*PAGE, "block_idx", "block_id", "kind", "level", "title_text", F.array_join("element_ids", ",").alias("element_ids"), "parent_block_id", F.array_join("section_path", " > ").alias("section_path"))


# ---- chunks, reports, evaluation


def rag_split(spark, d):
    text = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    docs = table(spark, d, "documents").select("doc_id", text.alias("t")).filter("t <> ''").distinct()
    return docs.select("doc_id", F.posexplode(rag.split_column(F.col("t"), 400)).alias("part_no", "part"))


def rag_chunks(spark, d):
    return _parsed(spark, d).chunks().select("doc_id", "chunk_id", "page_number", "text", "block_id", "block_kind", F.array_join("element_ids", ",").alias("element_ids"), "outline_level", "parent_block_id", F.array_join("section_path", " > ").alias("section_path"))


def rag_chunks_elements(spark, d):
    return rag.chunks_from_elements(_stored(frames.elements(spark, d)), CFG).select("doc_id", "chunk_idx", "chunk_id", "page_number", "text", "element_id")


def _stored_relations(spark, d):
    r = table(spark, d, "element_relations").dropDuplicates(["package_id", "rel_idx"])
    return r.select(F.col("package_id").cast("string").alias("doc_id"), "rel_idx", "relation_type", "source_element_id", "target_element_id", "confidence")


def debug_report_counts(spark, d):
    return report.counts(frames.pages(spark, d), _blocks(spark, d), _stored_relations(spark, d))


def debug_report(spark, d):
    """What the reports say, read back from their JSON."""
    page = "struct<elements:array<struct<text_preview:string>>,caption_candidate_decisions:array<struct<rejected_reason:string>>>"
    r = F.from_json("report", f"num_pages long, num_blocks long, num_relations long, pages array<{page}>")
    got = _parsed(spark, d).debug().select("doc_id", r.alias("r"))
    flat = lambda name: F.flatten(F.filter(F.transform("r.pages", lambda p: p[name]), lambda x: x.isNotNull()))
    chars = F.aggregate(flat("elements"), F.lit(0).cast("long"), lambda a, e: a + F.length(e["text_preview"]))
    decisions = flat("caption_candidate_decisions")
    rejected = F.size(F.filter(decisions, lambda x: x["rejected_reason"].isNotNull()))
    return got.select("doc_id", "r.num_pages", "r.num_blocks", "r.num_relations", F.size(flat("elements")).alias("elements"), chars.alias("preview_chars"), F.size(decisions).alias("decisions"), rejected.alias("rejected"))


def parsed_json(spark, d):
    """What the documents hold, counted in their JSON: elements, cells and their boxes, absorbed elements, labels, relations
    with the parts of their scores, blocks."""
    cell = "struct<cell_bbox:struct<x:double>,absorbed_elements:array<struct<element_id:string,containment:double>>>"
    element = f"struct<element_id:string,metadata:struct<table_cells:array<{cell}>,annotations:array<struct<element_id:string,text:string>>>>"
    relation = "struct<relation_type:string,metadata:struct<rule_score:double,score_breakdown:struct<proximity:double>>>"
    j = F.from_json("json", f"pages array<struct<elements:array<{element}>>>, relations array<{relation}>, blocks array<struct<block_id:string>>")
    got = _parsed(spark, d).json().select("doc_id", j.alias("j"))
    here = lambda x: x.isNotNull()
    parts = lambda lists: F.flatten(F.filter(lists, here))
    elements = parts(F.transform("j.pages", lambda p: p["elements"]))
    cells = parts(F.transform(elements, lambda e: e["metadata"]["table_cells"]))
    scored = F.filter("j.relations", lambda r: r["metadata"]["rule_score"].isNotNull() & r["metadata"]["score_breakdown"]["proximity"].isNotNull())
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return got.select(
        "doc_id", n("j.pages").alias("pages"), n(elements).alias("elements"), n(cells).alias("cells"), n(F.filter(cells, lambda c: c["cell_bbox"]["x"].isNotNull())).alias("boxed_cells"),
        n(parts(F.transform(cells, lambda c: c["absorbed_elements"]))).alias("absorbed"), n(parts(F.transform(elements, lambda e: e["metadata"]["annotations"]))).alias("annotations"), n("j.relations").alias("relations"), n(scored).alias("scored"), n("j.blocks").alias("blocks"),
    )


def _two_orders(spark, d):
    dense = _dense(spark, d)
    ident = F.char((F.col("ordinal") + 40).cast("int"))
    expected = dense.select(*PAGE, ident.alias("id"), F.col("ordinal").alias("pos"))
    predicted = ordering.row_clustering(dense, CFG).filter("ordinal % 7 <> 3").select(*PAGE, ident.alias("id"), F.col("read_ord").alias("pos"))
    return expected, predicted


def kendall_tau(spark, d):
    return evaluate.kendall_tau(*_two_orders(spark, d))


def edit_distance_norm(spark, d):
    return evaluate.edit_similarity(*_two_orders(spark, d))


def _two_relations(spark, d):
    golden = _stored_relations(spark, d)
    n = F.col("rel_idx") + F.col("doc_id").cast("int")
    predicted = golden.filter(n % 5 != 0).withColumn("relation_type", F.when(n % 7 == 0, "related_to").otherwise(F.col("relation_type")))
    return golden, predicted


def relation_prf(spark, d):
    return evaluate.relation_prf(*_two_relations(spark, d))


def golden_report(spark, d):
    return evaluate.golden_report(_two_orders(spark, d), _two_relations(spark, d))


def caption_baseline(spark, d):
    dense = written(_stored(_dense(spark, d)), "dense")
    return evaluate.caption_baseline(dense, *relations.relations(dense, WIDE))


def caption_review_sample(spark, d):
    return evaluate.review_sample(relations.relations(_stored(_dense(spark, d)), WIDE)[0])


def title_scores(spark, d):
    return relations.title_scores(_stored(frames.elements(spark, d)), CFG).groupBy(*PAGE, "source_ordinal").agg(F.count(F.lit(1)).alias("targets"), F.max("score").alias("score"))


# ---- text runs


def autonum_format(spark, d):
    kinds = F.array(*(F.lit(k) for k in ("arabicPeriod", "arabicParenR", "arabicPlain", "alphaLcPeriod", "alphaUcParenR", "romanLcPeriod", "romanUcParenR", "circleNumDbPlain", "other")))
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 60 + 1).cast("int").alias("n"), F.get(kinds, (F.col("p_partkey") % 9).cast("int")).alias("kind"))
    return p.select("p_partkey", tx.auto_number(F.col("kind"), F.col("n")).alias("prefix"))


def roman_numeral(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.roman((F.col("p_partkey") % 3999 + 1).cast("int")).alias("numeral"))


def _runs(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    rows = table(spark, d, "lineitem").withColumn("run_idx", F.row_number().over(w))
    flag = lambda c: F.expr(c)
    return rows.select(F.col("l_orderkey").alias("shape"), F.expr("cast(l_linenumber % 2 as int)").alias("par"), "run_idx", F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("text"), flag("l_partkey % 4 < 3").alias("bold"), flag("l_suppkey % 3 = 0").alias("italic"), flag("l_quantity > 40").alias("underline"))


def dominant_style(spark, d):
    return runs.dominant(_runs(spark, d), ["shape"])


def merge_runs(spark, d):
    return runs.merged(_runs(spark, d), ["shape", "par"])


def wrap_runs(spark, d):
    return runs.formatted(_runs(spark, d), ["shape"])


# ---- packages


def packages_of(docs: DataFrame, suffix: str) -> DataFrame:
    """(path, content): a package of each text's lines, blank ones left out."""

    def run(batches):
        write = writer.WRITERS[suffix]
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
            yield pa.record_batch([pa.array([f"{i}.{suffix}" for i in ids]), pa.array([write(x) for x in lines], pa.binary())], names=["path", "content"])

    return docs.mapInArrow(run, "path string, content binary")


def _roundtrip(suffix: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        docs = table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", "text").distinct()
        got = reader.parse_packages(packages_of(docs, suffix)).select("doc_id", F.explode("elements").alias("e"))
        return got.select(F.regexp_extract("doc_id", r"^(\d+)", 1).cast("long").alias("doc_id"), "e.element_type", "e.ordinal", "e.text").filter("text IS NOT NULL")

    return query


_QUERIES = (
    p4_found, bbox_normalize, containment_parent, containment_merge, table_cell_bbox, table_absorb_best_cell, table_absorb, image_annotation_absorb, noise_filter, document_order, order_choice, row_clustering,
    xy_cut_order, composite_order, reading_order, title_of, caption_score, caption_assignment, caption_verified, no_candidate_log, caption_map_last_wins, section_path, block_kinds, bbox_union,
    table_header_rows, pipe_table, html_table, nested_html, col_width_pct, md_linebreaks, img_md_to_html, column_break, markdown_page, markdown_document, rag_split, rag_chunks, rag_chunks_elements,
    pipeline_elements, pipeline_order, pipeline_relations, pipeline_blocks, debug_report_counts, debug_report, parsed_json, kendall_tau, edit_distance_norm, relation_prf, golden_report, caption_baseline, caption_review_sample, title_scores, autonum_format, roman_numeral, dominant_style, merge_runs, wrap_runs,
)


def queries() -> dict:
    trips = {f"{suffix}_ingest_roundtrip": _roundtrip(suffix) for suffix in writer.WRITERS}
    return {f.__name__: f for f in (*_QUERIES, *packages.QUERIES)} | trips | {f"p4_{level}": _level(level) for level in nested.LEVELS}


def oracle_sql() -> dict[str, str]:
    from leafstack.plans import oracles, pipeline_oracles

    return oracles.ORACLES | pipeline_oracles.ORACLES
