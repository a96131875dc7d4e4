"""Retrieval chunks from blocks, or from elements where a document has no blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.config import ParserConfig
from leafstack.functions import text as tx
from leafstack.schema import PAGE

STYLE = ("paragraph_style", "is_mostly_bold", "list_level", "line_pattern", "is_heading")


def split_parts(text: str, limit: int) -> list[str]:
    """Windows of ``limit`` characters, ended at their last blank line where they hold one; blank parts are dropped."""
    if len(text) <= limit:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = min(start + limit, len(text))
        if end < len(text) and (at := text.rfind("\n\n", start, end)) > start:
            end = at
        if part := text[start:end].strip():
            out.append(part)
        start = end
    return out


def split_column(text: Column, limit: int) -> Column:
    if limit < 1:
        raise ValueError("chunk_max_chars must be positive")

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else split_parts(t, limit))

    # Texts within the limit are one part; only the others need the fold.
    return F.when(F.length(text) <= limit, F.array(text)).otherwise(split(F.when(F.length(text) > limit, text)))


def style_of(df: DataFrame) -> Column:
    """The style fields of a row as a struct, null where none is set."""
    some = F.coalesce(*(F.col(c).cast("string") for c in STYLE)).isNotNull()
    return F.when(some, F.struct(*STYLE))


def _numbered(parts: DataFrame, order: list[str]) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(*order, "part_no")
    idx = F.row_number().over(w)
    return parts.withColumn("chunk_idx", idx).withColumn("chunk_id", F.format_string("CH_%05d", idx))


def chunks_from_blocks(blocks: DataFrame, ordered: DataFrame, cfg: ParserConfig, captions: DataFrame | None = None) -> DataFrame:
    """doc_id, chunk_idx, chunk_id, page_number, text and the metadata of the block; containers give none."""
    owned = blocks.filter("kind <> 'container'").select(*PAGE, "block_idx", F.posexplode("ordinals").alias("at", "ordinal"))
    shown = ordered.select(*PAGE, "ordinal", "element_id", tx.display(F.col("text"), F.col("formatted_text"), cfg.preserve_text_formatting).alias("shown"), style_of(ordered).alias("style"))
    parts = owned.join(shown, [*PAGE, "ordinal"])
    if captions is not None and cfg.chunk_include_captions:
        parts = parts.join(captions.select("doc_id", F.col("target_element_id").alias("element_id"), "caption"), ["doc_id", "element_id"], "left")
    else:
        parts = parts.withColumn("caption", F.lit(None).cast("string"))
    got = parts.groupBy(*PAGE, "block_idx").agg(
        F.sort_array(F.collect_list(F.struct("at", "shown", "caption"))).alias("p"), F.min_by("style", F.when(F.col("style").isNotNull(), F.col("at"))).alias("style")
    )
    both = blocks.filter("kind <> 'container'").join(got, [*PAGE, "block_idx"], "left")
    title = tx.stripped(F.col("title_text"))
    none = F.array().cast("array<string>")
    items = F.coalesce("p", F.array().cast("array<struct<at:int,shown:string,caption:string>>"))
    body = F.flatten(F.transform(items, lambda i: F.concat(F.when((i["shown"] != "") & (i["shown"] != title), F.array(i["shown"])).otherwise(none), F.when(F.coalesce(i["caption"], F.lit("")) != "", F.array(F.concat(F.lit("[CAPTION] "), i["caption"]))).otherwise(none))))
    head = F.when((F.col("kind") == "heading") & (F.col("title_text") != ""), F.array("title_text")).otherwise(none)
    texts = both.withColumn("whole", tx.strip(F.array_join(F.concat(head, body), "\n\n"))).filter("whole <> ''")
    cut = texts.select("*", F.posexplode(split_column(F.col("whole"), cfg.chunk_max_chars)).alias("part_no", "text"))
    heading = F.col("kind") == "heading"
    done = _numbered(cut, ["page_number", "block_idx"])
    return done.select(
        "doc_id", "chunk_idx", "chunk_id", "page_number", "text", "block_id", F.col("kind").alias("block_kind"), "element_ids",
        F.when(heading, F.col("level")).alias("outline_level"), F.when(heading, F.col("parent_block_id")).alias("parent_block_id"), F.when(F.size("section_path") > 0, F.col("section_path")).alias("section_path"), "style",
    )


def chunks_from_elements(ordered: DataFrame, cfg: ParserConfig, captions: DataFrame | None = None) -> DataFrame:
    """As above for documents without blocks: one text per element."""
    rows = ordered.withColumn("shown", tx.display(F.col("text"), F.col("formatted_text"), cfg.preserve_text_formatting))
    none = F.array().cast("array<string>")
    said = none
    if captions is not None and cfg.chunk_include_captions:
        rows = rows.join(captions.select("doc_id", F.col("target_element_id").alias("element_id"), "caption"), ["doc_id", "element_id"], "left")
        said = F.when(F.coalesce("caption", F.lit("")) != "", F.array(F.concat(F.lit("[CAPTION] "), F.col("caption")))).otherwise(none)
    whole = tx.strip(F.array_join(F.concat(F.when(F.col("shown") != "", F.array("shown")).otherwise(none), said), "\n\n"))
    rows = rows.withColumn("whole", whole).filter("whole <> ''").withColumn("style", style_of(rows))
    cut = rows.select("*", F.posexplode(split_column(F.col("whole"), cfg.chunk_max_chars)).alias("part_no", "part"))
    done = _numbered(cut, ["page_number", "read_ord"])
    return done.select("doc_id", "chunk_idx", "chunk_id", "page_number", F.col("part").alias("text"), "element_id", "style")
