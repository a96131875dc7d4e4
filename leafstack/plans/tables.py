"""The pipeline's frames from flat tables: parsed packages, and a dense layout made of order lines for spatial operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafstack.common import table
from leafstack.operators import layout
from leafstack.schema import KEY


def elements(spark: SparkSession, d: str) -> DataFrame:
    """document_elements in the pipeline's form; of rows that come twice the latest counts."""
    raw = table(spark, d, "document_elements").drop("site_code")
    one = raw.groupBy("element_uid").agg(F.max_by(F.struct(*(c for c in raw.columns if c != "element_uid")), "ingested_at").alias("e")).select("element_uid", "e.*")
    meta = lambda k: F.col("metadata")[k]
    flag = lambda k: (F.lower(meta(k)) == "true").alias(k)
    image = F.from_json(meta("image"), "filename string, relative_path string, display_width_px int")
    none = lambda kind, n: F.lit(None).cast(kind).alias(n)
    return one.select(
        F.col("package_id").cast("string").alias("doc_id"), "page_number", "ordinal", "element_id", "element_type", "z_order", "bbox.x", "bbox.y", "bbox.width", "bbox.height", "text",
        meta("formatted_text").alias("formatted_text"), meta("layout").alias("layout"), meta("source_format").alias("source_format"), flag("is_placeholder"), flag("is_heading"), meta("heading_level").cast("int").alias("heading_level"),
        flag("is_list_item"), meta("list_level").cast("int").alias("list_level"), meta("placeholder_idx").cast("int").alias("placeholder_idx"), F.coalesce(image["relative_path"], image["filename"]).alias("image_ref"), image["display_width_px"].alias("image_width"),
        meta("paragraph_style").alias("paragraph_style"), flag("is_mostly_bold"), meta("line_pattern").alias("line_pattern"), none("string", "sheet_name"), none("array<double>", "col_widths"), none("array<double>", "row_heights"), none("array<double>", "crop"), F.col("element_uid"),
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    meta = lambda k: F.col("metadata")[k].alias(k)
    raw = table(spark, d, "document_pages")
    return raw.select(F.col("package_id").cast("string").alias("doc_id"), "page_number", "width", "height", meta("source_format"), meta("layout_mode"), meta("sheet_name")).dropDuplicates(["doc_id", "page_number"])


def cells(spark: SparkSession, d: str, els: DataFrame) -> DataFrame:
    """table_cells keyed like their tables, with boxes."""
    raw = table(spark, d, "table_cells").drop("package_id").dropDuplicates(["cell_uid"])
    keyed = els.filter("element_type = 'table'").select(*KEY, "element_uid").join(raw, "element_uid").drop("element_uid", "cell_uid")
    return layout.cell_boxes(els, keyed)


def layout_elements(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as elements of pages: many overlapping boxes on few places, labels from part names."""
    lines, parts = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_name")
    page = F.expr("l_orderkey div 4")
    place = Window.partitionBy(page).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    kind = F.expr("l_partkey % 5")
    rows = lines.join(parts, lines.l_partkey == parts.p_partkey, "left").withColumn("ordinal", F.row_number().over(place) - 1)
    none = lambda t, n: F.lit(None).cast(t).alias(n)
    return rows.select(
        page.cast("string").alias("doc_id"), F.lit(1).alias("page_number"), "ordinal", F.format_string("E_001_%04d", F.col("ordinal") + 1).alias("element_id"),
        F.when(kind == 0, "image").when(kind == 1, "table").when(kind == 2, "unknown").otherwise("text").alias("element_type"), (F.col("ordinal") + 1).alias("z_order"),
        (F.expr("l_partkey % 80") / 100).alias("x"), (F.expr("l_suppkey % 80") / 100).alias("y"), (F.col("l_quantity") / 100).alias("width"), (F.lit(0.02) + F.expr("l_partkey % 7") / 50).alias("height"),
        F.when(kind >= 2, F.col("p_name")).alias("text"), none("string", "formatted_text"), none("string", "layout"), F.lit("pptx").alias("source_format"), none("boolean", "is_placeholder"), none("boolean", "is_heading"), none("int", "heading_level"),
        none("boolean", "is_list_item"), none("int", "list_level"), F.when(F.expr("l_suppkey % 11") == 0, F.expr("cast(l_partkey % 3 as int)")).alias("placeholder_idx"), none("string", "image_ref"), none("int", "image_width"),
        none("string", "paragraph_style"), none("boolean", "is_mostly_bold"), none("string", "line_pattern"), none("string", "sheet_name"), none("array<double>", "col_widths"), none("array<double>", "row_heights"), none("array<double>", "crop"),
    )


def layout_cells(els: DataFrame) -> DataFrame:
    """Two by two cells in each table of :func:`layout_elements`."""
    grid = els.filter("element_type = 'table'").select(*KEY, "x", "y", "width", "height").withColumn("cell_idx", F.explode(F.sequence(F.lit(0), F.lit(3))))
    grid = grid.withColumn("row_idx", (F.col("cell_idx") / 2).cast("int")).withColumn("col_idx", F.col("cell_idx") % 2)
    return grid.select(
        *KEY, "cell_idx", "row_idx", "col_idx", F.lit("").alias("text"), F.lit(None).cast("string").alias("formatted_text"), F.lit(False).alias("is_spanned"), F.lit(1).alias("span_width"), F.lit(1).alias("span_height"),
        (F.col("x") + F.col("width") / 2 * F.col("col_idx")).alias("cx"), (F.col("y") + F.col("height") / 2 * F.col("row_idx")).alias("cy"), (F.col("width") / 2).alias("cw"), (F.col("height") / 2).alias("ch"),
    )
