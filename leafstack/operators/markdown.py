"""Markdown of documents, by pages or by outline blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.config import ParserConfig
from leafstack.functions import text as tx
from leafstack.schema import PAGE

BREAK = "<!-- column-break -->"


def default_body(cfg: ParserConfig, title_used: Column) -> Column:
    """Body of one element; needs ``table_body`` (rendered table or null) and ``labels`` (array of annotation texts or null)."""
    text = tx.stripped(F.col("text"))
    shown = tx.tabs_shown(text)
    if cfg.preserve_text_formatting:
        shown = F.coalesce(F.nullif(tx.strip(F.col("formatted_text")), F.lit("")), shown)
    level = F.least(F.greatest(F.coalesce(F.nullif("heading_level", F.lit(0)), F.lit(2)), F.lit(2)), F.lit(6))
    flag = lambda c: F.coalesce(c, F.lit(False))
    words = F.when(text == "", "").when(flag("is_placeholder") & ~title_used, F.concat(F.lit("# "), shown)).when(flag("is_heading"), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), shown)).otherwise(tx.line_breaks_markdown(shown))
    src = F.coalesce(F.nullif("image_ref", F.lit("")), F.lit("image-not-exported"))
    tag = tx.image_tag(src, F.col("element_id"), F.when(F.nullif("image_ref", F.lit("")).isNotNull(), F.col("image_width")))
    labels = F.filter("labels", lambda x: x != "")
    image = F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, F.concat(tag, F.lit("\n\n*"), F.array_join(labels, " | "), F.lit("*"))).otherwise(tag)
    chart = F.when(F.coalesce(F.col("text"), F.lit("")) == "", "> [chart]").otherwise(F.concat(F.lit("> [chart] "), text))
    plain = tx.line_breaks_markdown(text)
    kind = F.col("element_type")
    return F.when(kind == "text", words).when(kind == "image", image).when(kind == "table", F.coalesce(F.nullif("table_body", F.lit("")), plain)).when(kind == "chart", chart).otherwise(plain)


def column_break(previous: Column, current: Column) -> Column:
    """Whether the way from one spatial group to the next first parts at a vertical cut."""
    a, b = F.split(previous, r"\."), F.split(current, r"\.")
    same = F.zip_with(a, b, lambda p, q: F.coalesce(p == q, F.lit(False)))
    # Parts before the first difference are shared; what follows in the current path decides.
    depth = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(b))
    part = F.get(b, depth.cast("int"))
    return F.coalesce((previous != current) & F.startswith(part, F.lit("v")), F.lit(False))


def bodies(ordered: DataFrame, tables: DataFrame | None, labels: DataFrame | None, captions: DataFrame | None) -> DataFrame:
    """``ordered`` with what its bodies need: ``table_body``, ``labels`` and ``caption``. Rows that have them already stay."""
    if "table_body" in ordered.columns:
        return ordered
    key = [*PAGE, "ordinal"]
    out = ordered
    out = out.join(tables.withColumnRenamed("html", "table_body"), key, "left") if tables is not None else out.withColumn("table_body", F.lit(None).cast("string"))
    out = out.join(labels, key, "left") if labels is not None else out.withColumn("labels", F.lit(None).cast("array<string>"))
    if captions is None:
        return out.withColumn("caption", F.lit(None).cast("string"))
    return out.join(captions.select("doc_id", F.col("target_element_id").alias("element_id"), "caption"), ["doc_id", "element_id"], "left")


def page_lines(ordered: DataFrame, cfg: ParserConfig, tables: DataFrame | None = None, labels: DataFrame | None = None, captions: DataFrame | None = None) -> DataFrame:
    """The rendered elements: page key, read_ord, body, whether a column break precedes, and the caption to show."""
    rows = bodies(ordered, tables, labels, captions)
    past = Window.partitionBy(*PAGE).orderBy("read_ord").rowsBetween(Window.unboundedPreceding, -1)
    # A placeholder with text is the page's title unless an earlier body already began like one.
    opens = (F.col("element_type") == "text") & (tx.stripped(F.col("text")) != "") & F.coalesce("is_placeholder", F.lit(False))
    rows = rows.withColumn("__plain", default_body(cfg, F.lit(True)))
    rows = rows.withColumn("__used", F.coalesce(F.max(opens | F.startswith("__plain", F.lit("# "))).over(past), F.lit(False)))
    rows = rows.withColumn("body", default_body(cfg, F.col("__used"))).filter("body <> ''")
    w = Window.partitionBy(*PAGE).orderBy("read_ord")
    rows = rows.withColumn("breaks", column_break(F.lag("spatial_group").over(w), F.col("spatial_group")))
    first = F.row_number().over(Window.partitionBy(*PAGE, "caption").orderBy("read_ord")) == 1
    return rows.select(*PAGE, "read_ord", "body", "breaks", F.when(first, F.nullif("caption", F.lit(""))).alias("caption"))


def render_pages(pages: DataFrame, ordered: DataFrame, cfg: ParserConfig, tables: DataFrame | None = None, labels: DataFrame | None = None, captions: DataFrame | None = None, comment: bool = True) -> DataFrame:
    """(doc_id, page_number, markdown) of every page; empty text for a page without anything."""
    lines = page_lines(ordered, cfg, tables, labels, captions)
    part = F.concat(
        F.when(F.col("breaks"), F.array(F.lit(BREAK), F.lit(""))).otherwise(F.array().cast("array<string>")), F.array("body"),
        F.when(F.col("caption").isNotNull(), F.array(F.concat(F.lit("> "), F.col("caption")))).otherwise(F.array().cast("array<string>")), F.array(F.lit("")),
    )
    got = lines.select(*PAGE, "read_ord", part.alias("part")).groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("read_ord", "part"))).alias("p"))
    both = pages.select(*PAGE).join(got, PAGE, "left")
    body = F.flatten(F.transform(F.coalesce("p", F.array().cast("array<struct<read_ord:int,part:array<string>>>")), lambda x: x["part"]))
    head = F.array(F.concat(F.lit("<!-- Page "), F.col("page_number").cast("string"), F.lit(" -->")), F.lit("")) if comment else F.array().cast("array<string>")
    return both.select(*PAGE, tx.strip(F.array_join(F.concat(head, body), "\n")).alias("markdown"))


def render_documents(pages_md: DataFrame) -> DataFrame:
    """(doc_id, markdown): pages that aren't blank, parted by rules."""
    got = pages_md.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.when(tx.strip(F.col("markdown")) != "", F.struct("page_number", "markdown")))).alias("p"))
    return got.select("doc_id", F.concat(tx.strip(F.array_join(F.transform("p", lambda x: x["markdown"]), "\n\n---\n\n")), F.lit("\n")).alias("markdown"))


def native_headings(blocks: DataFrame, ordered: DataFrame) -> DataFrame:
    """doc_id of the documents whose heading blocks own a heading or placeholder element: those render by blocks."""
    heads = blocks.filter("kind = 'heading'").select("doc_id", "page_number", F.explode("ordinals").alias("ordinal"))
    marked = ordered.filter("coalesce(is_heading, false) OR coalesce(is_placeholder, false)").select(*PAGE, "ordinal")
    return heads.join(marked, [*PAGE, "ordinal"], "left_semi").select("doc_id").distinct()


def render_blocks(blocks: DataFrame, ordered: DataFrame, cfg: ParserConfig, tables: DataFrame | None = None, labels: DataFrame | None = None, captions: DataFrame | None = None, comment: bool = True) -> DataFrame:
    """(doc_id, markdown) by outline blocks; a caption shows once in its document."""
    rows = bodies(ordered, tables, labels, captions).withColumn("body", default_body(cfg, F.lit(True)))
    owned = blocks.select("doc_id", "page_number", "block_idx", "kind", F.col("title_text").alias("block_title"), F.posexplode("ordinals").alias("at", "ordinal"))
    parts = owned.join(rows.select(*PAGE, "ordinal", "text", "body", "caption"), [*PAGE, "ordinal"])
    own_title = (F.col("kind") == "heading") & (tx.tabs_shown(tx.stripped(F.col("text"))) == tx.tabs_shown(tx.stripped(F.col("block_title"))))
    parts = parts.filter((F.col("body") != "") & ~own_title)
    first = F.row_number().over(Window.partitionBy("doc_id", "caption").orderBy("page_number", "block_idx", "at")) == 1
    said = F.when(F.nullif("caption", F.lit("")).isNotNull() & first, F.array(F.concat(F.lit("> "), F.col("caption")))).otherwise(F.array().cast("array<string>"))
    parts = parts.withColumn("part", F.concat(F.array("body"), said, F.array(F.lit(""))))
    shown_parts = parts.groupBy(*PAGE, "block_idx").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("p"))
    w = Window.partitionBy(*PAGE).orderBy("block_idx")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    title = tx.tabs_shown(F.col("title_text"))
    shown = (F.col("kind") == "heading") & (F.col("level") > 0) & (F.col("title_text") != "")
    # Only a heading of level 2 or deeper uses up the page's first place.
    taken = F.coalesce(F.max(shown & (F.col("level") >= 2)).over(past), F.lit(False))
    mark = F.when(~taken & (F.col("level") >= 2), F.lit("#")).otherwise(F.repeat(F.lit("#"), F.col("level")))
    none = F.array().cast("array<string>")
    new_page = F.row_number().over(w) == 1
    gap = F.when(F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "block_idx")) > 1, F.array(F.lit(""))).otherwise(none)
    top = F.when(new_page, F.concat(gap, F.array(F.concat(F.lit("<!-- Page "), F.col("page_number").cast("string"), F.lit(" -->")), F.lit("")))).otherwise(none) if comment else none
    head = F.when(shown, F.array(F.concat(mark, F.lit(" "), title), F.lit(""))).when((F.col("kind") == "container") & (F.col("title_text") != ""), F.array(F.concat(F.lit("<!-- "), F.col("title_text"), F.lit(" -->")), F.lit(""))).otherwise(none)
    both = blocks.withColumn("__top", top).withColumn("__head", head).join(shown_parts, [*PAGE, "block_idx"], "left")
    body = F.flatten(F.transform(F.coalesce("p", F.array().cast("array<struct<at:int,part:array<string>>>")), lambda x: x["part"]))
    got = both.select("doc_id", F.struct("page_number", "block_idx", F.concat("__top", "__head", body).alias("lines")).alias("s")).groupBy("doc_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return got.select("doc_id", F.concat(tx.strip(F.array_join(F.flatten(F.transform("s", lambda x: x["lines"])), "\n")), F.lit("\n")).alias("markdown"))
