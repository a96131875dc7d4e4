"""The whole pipeline: from elements as read to relations, blocks, Markdown, chunks, reports and JSON."""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.common import Scratch, at_once, maybe_broadcast, small, written
from leafstack.config import ParserConfig
from leafstack.functions import text as tx
from leafstack.operators import layout, markdown, ordering, rag, relations, report, structure, tables
from leafstack.schema import KEY, PAGE


@dataclasses.dataclass(frozen=True)
class Hooks:
    """What a caller may put in place of the built-in steps; None keeps them.

    ``verifier``: a column of struct<is_caption, confidence> for related captions. ``order``: reading order of (elements,
    config). ``rerank``: candidates to candidates. ``scorer``: see :func:`leafstack.operators.relations.caption_candidates`.
    ``structure``: blocks of (pages, ordered elements, title relations).
    """

    verifier: Column | None = None
    order: Callable | None = None
    rerank: Callable[[DataFrame], DataFrame] | None = None
    scorer: Callable | None = None
    structure: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = structure.blocks


class Parsed:
    """Frames of parsed documents. Each is written once, when first asked for, to a folder that :meth:`close` removes.

    ``elements``: all, with what absorbed them. ``ordered``: those that stand for themselves, in reading order.
    """

    def __init__(self, pages: DataFrame, placed: DataFrame, ordered: DataFrame, cells: DataFrame, taken: DataFrame, config: ParserConfig, hooks: Hooks, scratch: Scratch):
        self.pages, self.ordered, self.config = pages, ordered, config
        self._placed, self._cells, self._taken, self._hooks, self._scratch = placed, cells, taken, hooks, scratch

    def close(self) -> None:
        """Remove all intermediate tables; frames of this object can't be read afterwards."""
        self._scratch.remove()

    @functools.cached_property
    def elements(self) -> DataFrame:
        with self._scratch:
            return written(self._placed, "placed")

    @functools.cached_property
    def cells(self) -> DataFrame:
        """Cells with ``absorbed_elements``."""
        with self._scratch:
            return with_absorbed(self._cells, self.elements, self._taken)

    @functools.cached_property
    def _related(self) -> tuple[DataFrame, DataFrame]:
        with self._scratch:
            return relations.relations(self.ordered, self.config, self._hooks.verifier, self._hooks.rerank, self._hooks.scorer)

    @functools.cached_property
    def relations(self) -> DataFrame:
        with self._scratch:
            return written(self._related[0], "relations")

    @functools.cached_property
    def decisions(self) -> DataFrame:
        with self._scratch:
            return written(self._related[1], "decisions")

    @functools.cached_property
    def blocks(self) -> DataFrame:
        with self._scratch:
            if self._hooks.structure is structure.blocks:
                found = structure.blocks(self.pages, relations.with_title(self.ordered, self.config))
            else:
                found = self._hooks.structure(self.pages, self.ordered, relations.title_relations(self.ordered, self.config))
            return written(found, "blocks")

    def _extras(self) -> dict:
        labels = annotation_labels(self.elements)
        widths = self.elements.filter("element_type = 'table' AND col_widths IS NOT NULL").select(*KEY, "col_widths")
        shown = self.config.table_render_html
        html = tables.html_tables(self.cells, self.config.preserve_text_formatting, absorbed=True, widths=widths) if shown else tables.pipe_tables(self.cells).withColumnRenamed("markdown", "html")
        return {"tables": html, "labels": labels, "captions": relations.caption_map(self.relations)}

    def markdown(self) -> DataFrame:
        """(doc_id, markdown): by blocks for documents with headings of their own, by pages for the others."""
        at_once(lambda: self.cells, lambda: self.relations, lambda: self.blocks)
        native = maybe_broadcast(markdown.native_headings(self.blocks, self.ordered).withColumn("__native", F.lit(True)))
        with self._scratch:  # bodies and the mark of their document serve both forms
            rows = written(markdown.bodies(self.ordered, **self._extras()).join(native, "doc_id", "left"), "bodies")
        here, there = rows.filter("__native").drop("__native"), rows.filter("__native IS NULL").drop("__native")
        ours = maybe_broadcast(here.select("doc_id").distinct())
        blocks = markdown.render_blocks(self.blocks.join(ours, "doc_id", "left_semi"), here, self.config)
        pages = markdown.render_documents(markdown.render_pages(self.pages.join(ours, "doc_id", "left_anti"), there, self.config))
        return blocks.unionByName(pages)

    def chunks(self) -> DataFrame:
        at_once(lambda: self.relations, lambda: self.blocks)
        return rag.chunks_from_blocks(self.blocks, self.ordered, self.config, relations.caption_map(self.relations))

    def debug(self) -> DataFrame:
        at_once(lambda: self._related, lambda: self.blocks)  # relations and decisions share what this finds
        at_once(lambda: self.relations, lambda: self.decisions)
        return report.debug_report(self.pages, self.ordered, self.blocks, self.relations, self.decisions)

    def json(self) -> DataFrame:
        at_once(lambda: self.cells, lambda: self.relations, lambda: self.blocks)
        return report.document_json(self.pages, self.ordered, self.blocks, self.relations, report.table_cells(self.cells), report.image_annotations(self.elements))


def annotation_labels(elements: DataFrame) -> DataFrame:
    """KEY and labels of annotated images, by (y, x)."""
    got = elements.filter("image_ordinal IS NOT NULL").select(*PAGE, F.col("image_ordinal").alias("ordinal"), F.struct("y", "x", F.col("ordinal").alias("o"), tx.stripped(F.col("text")).alias("t")).alias("a"))
    return got.groupBy(*KEY).agg(F.transform(F.sort_array(F.collect_list("a")), lambda a: a["t"]).alias("labels"))


def with_absorbed(cells: DataFrame, elements: DataFrame, taken: DataFrame) -> DataFrame:
    """Cells with the elements they absorbed: content by type (image mark, nested table, text), in page order.

    What was absorbed is written; the cells stay where they are if that can be broadcast, and are written with it if not.
    """
    some = maybe_broadcast(taken)
    nested = tables.nested_html(cells.join(maybe_broadcast(taken.select(*KEY)), KEY, "left_semi")).withColumnRenamed("html", "nested")
    src = F.coalesce(F.nullif("image_ref", F.lit("")), F.lit("image-not-exported"))
    mark = F.concat(F.lit("!["), F.col("element_id"), F.lit("]("), src, F.lit(")"))
    kind = F.col("element_type")
    content = F.when(kind == "image", mark).when(kind == "table", F.coalesce("nested", tx.stripped(F.col("text")))).otherwise(tx.stripped(F.col("text")))
    rows = elements.select(*KEY, "element_id", "element_type", "x", "y", "text", "image_ref", "image_width").join(some, KEY).join(nested, KEY, "left")
    item = F.struct("y", "x", F.col("ordinal"), content.alias("content"), F.when((kind == "image") & (F.col("image_width") > 0), F.col("image_width")).alias("width"), "element_id", F.col("element_type").alias("type"), F.col("ratio").alias("containment"))
    got = rows.groupBy(*PAGE, F.col("table_ordinal").alias("ordinal_"), "cell_idx").agg(F.sort_array(F.collect_list(item)).alias("absorbed_elements"))
    got = written(got.withColumnRenamed("ordinal_", "ordinal"), "absorbed")
    both = cells.join(maybe_broadcast(got), [*KEY, "cell_idx"], "left")
    return both if small(got) else written(both, "cells")


def parse(pages: DataFrame, elements: DataFrame, cells: DataFrame, cfg: ParserConfig | None = None, verifier: Column | None = None, order=None, rerank=None, scorer=None, structure=structure.blocks) -> Parsed:
    """Run the stages in their fixed order: containment, tables, image labels, filters, reading order; relations and blocks
    follow when they are asked for. The further arguments are :class:`Hooks`.

    ``cells`` need boxes (see :func:`leafstack.operators.layout.cell_boxes`); a cell without one takes nothing. Every
    stage reads its input several times, so stages end in written tables; without them the plan would double at each.
    """
    cfg = cfg or ParserConfig()
    scratch = Scratch(pages.sparkSession)
    with scratch:
        merged, boxed = at_once(lambda: written(layout.resolve_containment(written(elements, "elements"), cfg), "merged"), lambda: written(cells, "cells"))
        taken = written(layout.absorb_into_tables(merged, boxed, cfg), "taken")
        placed = merged.join(taken.select(*KEY, "table_ordinal"), KEY, "left")
        if cfg.absorb_image_annotations:
            placed = placed.join(layout.annotate_images(placed, cfg).select(*KEY, "image_ordinal", F.col("ratio").alias("image_ratio")), KEY, "left")
        else:
            placed = placed.withColumns({"image_ordinal": F.lit(None).cast("int"), "image_ratio": F.lit(None).cast("double")})
        free = placed.filter("absorbed_by IS NULL AND table_ordinal IS NULL AND image_ordinal IS NULL")
        if cfg.filter_noise_elements:
            free = layout.drop_noise(free, cfg)
        ordered = written(ordering.reading_order(pages, free, cfg, order), "ordered")
    return Parsed(pages, placed, ordered, boxed, taken, cfg, Hooks(verifier, order, rerank, scorer, structure), scratch)
