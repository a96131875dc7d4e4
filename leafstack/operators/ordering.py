"""Reading order: adds ``read_ord`` (from 1 in each page) and ``spatial_group`` (null where the strategy has none)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.config import ParserConfig
from leafstack.schema import PAGE


def _numbered(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("read_ord", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)))


def document_order(elements: DataFrame, cfg: ParserConfig) -> DataFrame:
    """As the file has it: z-order, then id."""
    return _numbered(elements, "z_order", "element_id", "ordinal").withColumn("spatial_group", F.lit(None).cast("string"))


def row_clustering(elements: DataFrame, cfg: ParserConfig) -> DataFrame:
    """Rows from top to bottom, left to right within a row.

    A row begins where an element lies more than ``row_tolerance`` below the first element of the current row, which is a
    fold over the page's sorted tops.
    """
    tops = elements.groupBy(*PAGE).agg(F.sort_array(F.collect_set("y")).alias("tops"))
    start = F.array().cast("array<double>")
    anchors = F.aggregate("tops", start, lambda acc, y: F.when((F.size(acc) == 0) | (y - F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) > cfg.row_tolerance), F.array_append(acc, y)).otherwise(acc))
    rows = tops.select(*PAGE, anchors.alias("anchors"))
    # The row of an element is the number of anchors not below it.
    placed = elements.join(rows, PAGE).withColumn("row", F.size(F.filter("anchors", lambda a: a <= F.col("y"))))
    done = _numbered(placed, "row", "x", "z_order", "y", "ordinal").drop("anchors", "row")
    return done.withColumn("spatial_group", F.lit(None).cast("string"))


def _cut(starts: np.ndarray, ends: np.ndarray, least: float) -> np.ndarray | None:
    """Boolean mask of the part before the widest gap, or None where no gap is wide enough."""
    order = np.argsort(starts, kind="stable")
    reach = np.maximum.accumulate(ends[order])
    gaps = starts[order][1:] - reach[:-1]
    at = int(np.argmax(gaps))
    if not gaps[at] > 0 or gaps[at] < least:
        return None
    first = np.zeros(len(starts), dtype=bool)
    first[order[: at + 1]] = True
    return first


def leaf_paths(x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, least: float) -> list[str]:
    """Path of the leaf that each box falls into when the page is cut at its widest gaps, across first, then down."""
    paths = ["0"] * len(x)
    todo = [(np.arange(len(x)), "0")]
    while todo:
        at, path = todo.pop()
        split = None
        if len(at) > 1:
            for name, a, b in (("h", y[at], y[at] + h[at]), ("v", x[at], x[at] + w[at])):
                if (split := _cut(a, b, least)) is not None:
                    break
        if split is None:
            for i in at:
                paths[i] = path
        else:
            todo += [(at[split], f"{path}.{name}0"), (at[~split], f"{path}.{name}1")]
    return paths


def xy_cut(elements: DataFrame, cfg: ParserConfig) -> DataFrame:
    """Recursive cuts; leaves in the order of their paths, elements of a leaf by (y, x, z_order).

    Elements without a box take no part in the cuts and stand last, without a group. Only the boxes go to Python, in Arrow
    batches with one list of them per page.
    """
    return _numbered(_with_paths(elements, cfg), F.asc_nulls_last("spatial_group"), "y", "x", "z_order", "ordinal")


def _with_paths(elements: DataFrame, cfg: ParserConfig, taking_part: Column | None = None) -> DataFrame:
    """``elements`` with ``spatial_group``, null for those without a box or outside ``taking_part``.

    The rows of a page travel once, as one list, and come back from it in the same partition, so what follows per page needs
    no further exchange.
    """
    least = cfg.xy_cut_gap_ratio

    @F.pandas_udf("array<string>")
    def paths(boxes: pd.Series) -> pd.Series:
        out = []
        for page in boxes:
            at = sorted((i for i, b in enumerate(page) if b is not None), key=lambda i: page[i]["ordinal"])
            found: list[str | None] = [None] * len(page)
            x, y, w, h = (np.array([page[i][k] for i in at], dtype=float) for k in ("x", "y", "width", "height"))
            for i, path in zip(at, leaf_paths(x, y, w, h, least) if at else []):
                found[i] = path
            out.append(found)
        return pd.Series(out, dtype=object)

    box = F.struct("ordinal", "x", "y", "width", "height")
    boxed = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("width").isNotNull() & F.col("height").isNotNull()
    mine = boxed if taking_part is None else boxed & taking_part
    row = F.struct(F.struct(*(F.col(f"`{c}`") for c in elements.columns if c not in PAGE)).alias("e"), F.when(mine, box).alias("b"))
    pages = elements.groupBy(*PAGE).agg(F.collect_list(row).alias("rows"))
    pages = pages.withColumn("paths", paths(F.transform("rows", lambda r: r["b"])))
    got = pages.select(*PAGE, F.explode(F.arrays_zip("rows", "paths")).alias("r"))
    return got.select(*PAGE, "r.rows.e.*", F.col("r.paths").alias("spatial_group")).select(*elements.columns, "spatial_group")


def composite(elements: DataFrame, cfg: ParserConfig) -> DataFrame:
    """Placeholders by their index first (group ``ph``), the others by recursive cuts."""
    rest = F.col("placeholder_idx").isNull()
    placed = _with_paths(elements, cfg, rest)
    last = [F.when(rest, F.col(c)) for c in ("y", "x", "z_order")]
    done = _numbered(placed, F.asc_nulls_last("placeholder_idx"), F.asc_nulls_last("spatial_group"), *last, "ordinal")
    return done.withColumn("spatial_group", F.when(rest, F.col("spatial_group")).otherwise("ph"))


STRATEGIES: dict[str, Callable[[DataFrame, ParserConfig], DataFrame]] = {"row": row_clustering, "row_clustering": row_clustering, "xy_cut": xy_cut, "composite": composite}


def _as_stored(n: Column, flowing: Column, stacked: Column) -> Column:
    meta = F.coalesce(F.col("layout_mode") == "page_metrics", F.lit(False)) | F.coalesce(F.col("source_format") == "docx", F.lit(False))
    return meta | F.coalesce((flowing >= F.greatest(F.lit(3), F.floor(n / 2))) & (stacked >= 3), F.lit(False))


def _flow_counts() -> tuple[Column, Column, Column]:
    flow = F.coalesce(F.col("layout") == "flow", F.lit(False))
    return F.count(F.lit(1)), F.sum(flow.cast("int")), F.sum((flow & (F.col("y") >= 0.99)).cast("int"))


def uses_document_order(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Pages (key, ``as_stored``) with the mark of those kept in stored order: flowing documents, and pages where at least
    half of the elements (and three) flow and at least three of them are stacked at the bottom."""
    counts = elements.groupBy(*PAGE).agg(*(c.alias(k) for k, c in zip(("n", "flowing", "stacked"), _flow_counts())))
    return pages.join(counts, PAGE, "left").select(*PAGE, _as_stored(F.col("n"), F.col("flowing"), F.col("stacked")).alias("as_stored"))


def _marked(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """``elements`` with ``__stored``, by one join with the pages and windows in its partitioning. An element whose page is
    unknown isn't stored."""
    page = Window.partitionBy(*PAGE)
    known = pages.select(*PAGE, "layout_mode", F.col("source_format").alias("__format"), F.lit(True).alias("__known"))
    counts = {f"__{k}": c.over(page) for k, c in zip(("n", "flowing", "stacked"), _flow_counts())}
    both = elements.join(known, PAGE, "left").withColumns(counts)
    rule = _as_stored(F.col("__n"), F.col("__flowing"), F.col("__stacked"))
    # The rule reads the format of the page, not of the element.
    own = both.withColumnRenamed("source_format", "__own").withColumnRenamed("__format", "source_format")
    out = own.withColumn("__stored", F.coalesce("__known", F.lit(False)) & rule).drop("source_format", "layout_mode", "__known", *counts)
    return out.withColumnRenamed("__own", "source_format").select(*elements.columns, "__stored")


def reading_order(pages: DataFrame, elements: DataFrame, cfg: ParserConfig, strategy: Callable | None = None) -> DataFrame:
    """Stored order where :func:`uses_document_order` says so, else the configured strategy; unknown names are composite.

    The composite order shares its one exchange per page with the stored order; other strategies run on their own pages.
    """
    strategy = strategy or STRATEGIES.get(cfg.reading_order_strategy, composite)
    marked = _marked(pages, elements)
    if strategy is not composite:
        stored = document_order(marked.filter("__stored").drop("__stored"), cfg)
        return stored.unionByName(strategy(marked.filter("NOT __stored").drop("__stored"), cfg))
    spatial = ~F.col("__stored")
    rest = spatial & F.col("placeholder_idx").isNull()
    placed = _with_paths(marked, cfg, rest)
    stored = [F.when(F.col("__stored"), F.col(c)) for c in ("z_order", "element_id")]
    last = [F.when(rest, F.col(c)) for c in ("y", "x", "z_order")]
    done = _numbered(placed, *stored, F.when(spatial, F.col("placeholder_idx")).asc_nulls_last(), F.asc_nulls_last("spatial_group"), *last, "ordinal")
    return done.withColumn("spatial_group", F.when(rest, F.col("spatial_group")).when(spatial, "ph")).drop("__stored")
