"""Outline blocks: headings and placeholders open sections, tables and figures are blocks, the rest joins its section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.functions import text as tx
from leafstack.schema import PAGE

#: Outline levels are clamped to 1..6, so a page's open headings fit into that many window columns.
LEVELS = range(1, 7)
_HEAD = "struct<ord:int,title:string,ordinal:int,own_idx:int>"


def outline_level() -> Column:
    """Level of a heading (2 where none or 0 is given), 3 for placeholders, null for other elements."""
    given = F.coalesce(F.nullif("heading_level", F.lit(0)), F.lit(2))
    return F.when(F.coalesce("is_heading", F.lit(False)), F.least(F.greatest(given, F.lit(1)), F.lit(6))).when(F.coalesce("is_placeholder", F.lit(False)), F.lit(3))


def containers(pages: DataFrame) -> DataFrame:
    """Page key and title of the container block of pages that have one."""
    n = F.col("page_number").cast("string")
    named = F.coalesce(F.nullif("sheet_name", F.lit("")), F.concat(F.lit("Sheet "), n))
    title = F.when(F.col("source_format") == "pptx", F.concat(F.lit("Slide "), n)).when(F.col("source_format") == "xlsx", named).when(F.col("source_format") == "hwpx", F.concat(F.lit("Section "), n))
    return pages.select(*PAGE, title.alias("container")).filter("container IS NOT NULL")


def _chain(below: int) -> Column:
    """Open headings of a level under ``below``, outermost first: those later than every open heading of a lower level."""
    kept = []
    for k in range(1, below):
        later = F.lit(True)
        for j in range(1, k):
            later = later & F.coalesce(F.col(f"h{k}.ord") > F.col(f"h{j}.ord"), F.lit(True))
        kept.append(F.when(F.col(f"h{k}").isNotNull() & later, F.col(f"h{k}")))
    return F.filter(F.array(*kept), lambda x: x.isNotNull()) if kept else F.array().cast(f"array<{_HEAD}>")


def outline(pages: DataFrame, ordered: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Each element with its outline: level, ``chain`` of open headings, parent heading, whether it makes a block, and the
    number of that block in its page. All of it is windows over one partitioning by page.

    ``titles``: title_of relations (page key, source_ordinal, target_ordinal); a target of a title that is a heading met
    before belongs to that heading's block. In their place ``ordered`` may have a column ``page_title`` (see
    :func:`leafstack.operators.relations.with_title`), which saves the joins.
    """
    rows = ordered.withColumn("level", outline_level()).withColumn("title", tx.stripped(F.col("text")))
    rows = rows.withColumn("label", F.coalesce(F.nullif("title", F.lit("")), F.lit("heading")))
    if titles is not None:
        places = ordered.select(*PAGE, F.col("ordinal").alias("source_ordinal"), F.col("read_ord").alias("__ord"))
        linked = titles.select(*PAGE, "source_ordinal", F.col("target_ordinal").alias("ordinal")).join(places, [*PAGE, "source_ordinal"])
        linked = linked.select(*PAGE, "ordinal", F.struct(F.col("__ord").alias("read_ord"), F.col("source_ordinal").alias("ordinal")).alias("page_title"))
        rows = rows.drop("page_title").join(linked, [*PAGE, "ordinal"], "left")
    elif "page_title" not in rows.columns:
        rows = rows.withColumn("page_title", F.lit(None).cast("struct<read_ord:int,ordinal:int>"))
    rows = rows.join(containers(pages), PAGE, "left")
    page = Window.partitionBy(*PAGE)
    past, upto = (page.orderBy("read_ord").rowsBetween(Window.unboundedPreceding, end) for end in (-1, 0))
    # Without a container, what comes before all headings makes blocks of its own.
    orphan = F.col("container").isNull() & (F.coalesce(F.count("level").over(past), F.lit(0)) == 0)
    rows = rows.withColumn("makes_block", F.col("level").isNotNull() | F.col("element_type").isin("table", "image") | orphan)
    number = F.sum(F.col("makes_block").cast("int")).over(upto) + F.col("container").isNotNull().cast("int")
    rows = rows.withColumn("own_idx", F.when(F.col("makes_block"), number).cast("int"))
    me = F.struct(F.col("read_ord").alias("ord"), F.col("label").alias("title"), "ordinal", "own_idx")
    heads = {f"h{k}": F.last(F.when(F.col("level") == k, me), ignorenulls=True).over(past) for k in LEVELS}
    rows = rows.withColumns(heads)
    chain = _chain(7)
    for k in reversed(LEVELS):
        chain = F.when(F.col("level") == k, _chain(k)).otherwise(chain)
    rows = rows.withColumn("chain", chain).drop(*heads)
    # The chain of a title's own block is the chain the title has, with the title at its end.
    of_title = F.map_from_entries(F.collect_list(F.when(F.col("__titles") & F.col("level").isNotNull(), F.struct("read_ord", F.array_append("chain", me)))).over(page))
    rows = rows.withColumn("__titles", F.array_contains(F.collect_set("page_title.read_ord").over(page), F.col("read_ord")))
    rows = rows.withColumn("__chains", of_title)
    moved = F.col("level").isNull() & (F.col("page_title.read_ord") < F.col("read_ord"))
    rows = rows.withColumn("chain", F.coalesce(F.when(moved, F.element_at("__chains", F.col("page_title.read_ord"))), F.col("chain"))).drop("__titles", "__chains", "page_title")
    return rows.withColumn("parent", F.when(F.size("chain") > 0, F.element_at("chain", F.greatest(F.size("chain"), F.lit(1)))))


def block_id(idx: Column) -> Column:
    return F.format_string("B_%03d_%04d", F.col("page_number"), idx)


def blocks(pages: DataFrame, ordered: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """doc_id, page_number, block_idx, block_id, kind, level, title_text, element_ids, ordinals, parent_block_id,
    section_path and the union box (null for a block without elements)."""
    rows = outline(pages, ordered, titles)
    parent_idx = F.coalesce("parent.own_idx", F.when(F.col("container").isNotNull(), F.lit(1)))
    kind = F.when(F.col("level").isNotNull(), "heading").when(F.col("element_type") == "table", "table").when(F.col("element_type") == "image", "figure")
    kind = kind.when(F.coalesce("is_list_item", F.lit(False)), "list_item").otherwise("paragraph")
    title = F.when(kind == "heading", F.col("title")).when(kind == "figure", F.lit("figure")).otherwise(F.coalesce(F.nullif("title", F.lit("")), kind))
    path = F.transform("chain", lambda h: h["title"])
    edges = {"x1": F.col("x"), "y1": F.col("y"), "x2": F.col("x") + F.col("width"), "y2": F.col("y") + F.col("height")}
    part = rows.select(
        *PAGE, F.coalesce("own_idx", parent_idx).alias("block_idx"), "makes_block", "read_ord", "element_id", "ordinal",
        F.when(F.col("makes_block"), F.struct(kind.alias("kind"), F.coalesce("level", F.lit(0)).alias("level"), title.alias("title_text"), F.when(parent_idx.isNotNull(), block_id(parent_idx)).alias("parent_block_id"), F.when(kind == "heading", F.array_append(path, F.col("label"))).otherwise(path).alias("section_path"))).alias("b"),
        *(e.alias(k) for k, e in edges.items()),
    )
    top = containers(pages).select(*PAGE, F.lit(1).alias("block_idx"), F.struct(F.lit("container").alias("kind"), F.lit(1).alias("level"), F.col("container").alias("title_text"), F.lit(None).cast("string").alias("parent_block_id"), F.array().cast("array<string>").alias("section_path")).alias("b"))
    both = part.unionByName(top, allowMissingColumns=True)
    got = both.groupBy(*PAGE, "block_idx").agg(
        F.max("b").alias("b"), F.sort_array(F.collect_list(F.when(F.col("ordinal").isNotNull(), F.struct("read_ord", "element_id", "ordinal")))).alias("items"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )
    union = F.when(F.col("x1").isNotNull(), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0)).alias("width"), F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0)).alias("height")))
    return got.select(
        *PAGE, "block_idx", block_id(F.col("block_idx")).alias("block_id"), "b.kind", "b.level", "b.title_text", F.array_distinct(F.transform("items", lambda i: i["element_id"])).alias("element_ids"),
        F.transform("items", lambda i: i["ordinal"]).alias("ordinals"), "b.parent_block_id", "b.section_path", union.alias("bbox"),
    )
