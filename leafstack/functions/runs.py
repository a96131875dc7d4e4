"""Formatted runs of shapes: suppress a shape's dominant style, merge equal neighbours, wrap the rest in marks.

Frames have one row per run: keys of the shape, ``par`` (its paragraph), ``run_idx``, ``text`` and the flags ``bold``,
``italic``, ``underline``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.functions.text import strip

FLAGS = ("bold", "italic", "underline")
#: Share of a shape's characters from which a flag is its ordinary look.
DOMINANT = 0.8


def dominant(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``dominant_*`` per shape: the flag holds for at least 80 % of its characters; never in one without characters."""
    size = F.length(F.coalesce("text", F.lit("")))
    total = F.sum(size).alias("chars")
    got = runs.groupBy(*keys).agg(total, *(F.sum(F.when(F.col(f), size).otherwise(0)).alias(f) for f in FLAGS))
    return got.select(*keys, *(((F.col("chars") > 0) & (F.col(f) / F.greatest(F.col("chars"), F.lit(1)) >= DOMINANT)).alias(f"dominant_{f}") for f in FLAGS))


def suppressed(runs: DataFrame, keys: list[str]) -> DataFrame:
    return runs.join(dominant(runs, keys), keys).withColumns({f: F.col(f) & ~F.col(f"dominant_{f}") for f in FLAGS}).drop(*(f"dominant_{f}" for f in FLAGS))


def merged(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbouring runs of one style become one: keys, ``run_idx`` of the first, text and flags. Runs without text vanish."""
    w = Window.partitionBy(*keys).orderBy("run_idx")
    style = F.struct(*FLAGS)
    rows = runs.filter(F.coalesce("text", F.lit("")) != "").withColumn("__new", F.coalesce((style != F.lag(style).over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumn("__run", F.sum("__new").over(w))
    got = rows.groupBy(*keys, "__run", *FLAGS).agg(F.min("run_idx").alias("run_idx"), F.sort_array(F.collect_list(F.struct("run_idx", "text"))).alias("t"))
    return got.select(*keys, "run_idx", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"), *FLAGS)


def wrapped(html: bool = False) -> Column:
    """Text of a run in its marks: underline inside, then italic, then bold."""
    mark = lambda c, a, b: F.concat(F.lit(a), c, F.lit(b))
    out = F.col("text")
    out = F.when(F.col("underline"), mark(out, "<u>", "</u>")).otherwise(out)
    out = F.when(F.col("italic"), mark(out, *(("<i>", "</i>") if html else ("*", "*")))).otherwise(out)
    return F.when(F.col("bold"), mark(out, *(("<b>", "</b>") if html else ("**", "**")))).otherwise(out)


def formatted(runs: DataFrame, keys: list[str], html: bool = False) -> DataFrame:
    """(keys, formatted): each shape with the marks of the runs that differ from its ordinary look.

    Paragraphs are stripped and joined by line feeds; those without text are left out.
    """
    parts = merged(suppressed(runs, keys), [*keys, "par"]).withColumn("w", wrapped(html))
    lines = parts.groupBy(*keys, "par").agg(F.sort_array(F.collect_list(F.struct("run_idx", "w"))).alias("p"))
    lines = lines.select(*keys, "par", strip(F.array_join(F.transform("p", lambda x: x["w"]), "")).alias("line")).filter("line <> ''")
    got = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("par", "line"))).alias("l"))
    return got.select(*keys, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("formatted"))
