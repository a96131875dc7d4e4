"""Relations between elements: titles by place, captions by score with one visual per text, and the log of decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafstack.common import written
from leafstack.config import ParserConfig
from leafstack.functions import geometry as geo
from leafstack.functions import scoring
from leafstack.functions import text as tx
from leafstack.schema import PAGE

def looks_like_title(cfg: ParserConfig) -> Column:
    text = tx.stripped(F.col("text"))
    short = (F.length(text) <= cfg.title_max_len) & ~F.contains(text, F.lit("\n"))
    return (F.col("element_type") == "text") & (text != "") & (F.coalesce("is_placeholder", F.lit(False)) | short)


def with_title(ordered: DataFrame, cfg: ParserConfig) -> DataFrame:
    """``ordered`` with ``page_title``: place and id of the page's first title in reading order, for every other element that
    isn't above it and near enough; null for the others. One window over the page, no join."""
    page = Window.partitionBy(*PAGE)
    title = F.min(F.when(looks_like_title(cfg), F.struct("read_ord", "ordinal", "element_id", "y", "height"))).over(page)
    rows = ordered.withColumn("__t", title)
    near = (F.col("y") >= F.col("__t.y")) & (F.col("y") - (F.col("__t.y") + F.col("__t.height")) <= cfg.title_max_y_distance) & (F.col("ordinal") != F.col("__t.ordinal"))
    return rows.withColumn("page_title", F.when(near, F.struct("__t.read_ord", "__t.ordinal", "__t.element_id"))).drop("__t")


def title_relations(ordered: DataFrame, cfg: ParserConfig) -> DataFrame:
    """title_of: the page's first title in reading order to every other element not above it and near enough.

    Page key, source_ordinal, target_ordinal, target_ord, source_element_id, target_element_id, confidence.
    """
    out = with_title(ordered, cfg).filter("page_title IS NOT NULL")
    return out.select(
        *PAGE, F.col("page_title.ordinal").alias("source_ordinal"), F.col("ordinal").alias("target_ordinal"), F.col("read_ord").alias("target_ord"), F.col("page_title.element_id").alias("source_element_id"),
        F.col("element_id").alias("target_element_id"), F.lit(0.7).alias("confidence"),
    )


_SIDE = ["ordinal", "element_id", "read_ord", "x", "y", "width", "height"]


def caption_candidates(ordered: DataFrame, cfg: ParserConfig, scorer: Callable[..., dict[str, Column]] | None = None) -> DataFrame:
    """Texts that may caption an image or table of their page, with score, type and the parts of the score.

    The gates on gap and alignment are part of the join condition, so far pairs are never scored. Elements already in a
    table or container (where those columns exist) aren't captions. ``scorer`` replaces
    :func:`~leafstack.functions.scoring.caption_breakdown` and what combines its parts: it gets the same boxes, sizes, text
    and knobs, and its result must hold the same names and ``raw`` and ``score``.
    """
    texts = ordered.filter((F.col("element_type") == "text") & (tx.stripped(F.col("text")) != ""))
    for c in ("absorbed_by", "table_ordinal"):
        if c in ordered.columns:
            texts = texts.filter(F.col(c).isNull())
    texts = texts.select(*PAGE, *_SIDE, tx.stripped(F.col("text")).alias("text"))
    t = texts.select("*", *(c.alias(k) for k, c in scoring.text_parts(F.col("text")).items())).alias("t")
    v = ordered.filter(F.col("element_type").isin("image", "table")).select(*PAGE, *_SIDE, "element_type").alias("v")
    tb, vb = geo.box("t"), geo.box("v")
    pairs = t.join(v, [*(F.col(f"t.{k}") == F.col(f"v.{k}") for k in PAGE), scoring.caption_gate(tb, vb, cfg)])
    sizes = F.col("t.width"), F.col("t.height"), F.col("v.width"), F.col("v.height")
    known = {"of_text": {k: F.col(f"t.{k}") for k in ("text_hint", "bullet_penalty")}} if scorer is None else {}
    parts = (scorer or scoring.caption_breakdown)(tb, vb, sizes, F.col("t.text"), cfg, **known)
    names = [F.col(f"{s}.{c}").alias(f"{p}_{c}") for s, p in (("t", "text"), ("v", "visual")) for c in ("ordinal", "element_id", "read_ord")]
    # One row is made of each pair by a generator: no filter on scores passes it, so they are worked out once, for gated pairs.
    scores = F.explode(F.array(F.struct(*(c.alias(k) for k, c in parts.items())))).alias("__p")
    out = pairs.select(*(F.col(f"t.{k}").alias(k) for k in PAGE), *names, F.col("t.text").alias("caption_text"), F.col("v.element_type").alias("visual_type"), scores).select("*", "__p.*").drop("__p")
    if scorer is None:
        out = out.withColumns(scoring.combined({k: F.col(k) for k in parts}, cfg))
    out = out.withColumn("relation_type", scoring.relation_type(F.col("score"), cfg))
    return out.filter("relation_type IS NOT NULL").withColumn("method", F.lit("rule"))


def verified(candidates: DataFrame, verifier: Column | None) -> DataFrame:
    """related_to candidates after a verifier (a column of struct<is_caption, confidence>); None leaves them as they are."""
    if verifier is None:
        return candidates
    asked = F.col("relation_type") == "related_to"
    out = candidates.withColumn("__v", F.when(asked, verifier))
    yes = asked & F.coalesce(F.col("__v.is_caption"), F.lit(False))
    return (
        out.withColumn("method", F.when(yes, "vlm_fallback").when(asked, "vlm_rejected").otherwise(F.col("method")))
        .withColumn("score", F.when(yes, F.col("__v.confidence")).otherwise(F.col("score")))
        .withColumn("relation_type", F.when(yes, "caption_of").otherwise(F.col("relation_type")))
        .drop("__v")
    )


def no_op_verifier() -> Column:
    return F.struct(F.lit(False).alias("is_caption"), F.lit(0.0).alias("confidence"))


def assigned(candidates: DataFrame) -> DataFrame:
    """Candidates with ``rejected_reason`` (null for the chosen) and ``rank`` of the decision in its page.

    Only a text can be used up, so taking the best first over the page is the best visual of each text.
    """
    best = Window.partitionBy(*PAGE, "text_ordinal").orderBy(F.desc("score"), "visual_read_ord", "text_read_ord")
    page = Window.partitionBy(*PAGE).orderBy(F.desc("score"), "visual_read_ord", "text_read_ord")
    return candidates.withColumn("rejected_reason", F.when(F.row_number().over(best) > 1, "caption_already_assigned")).withColumn("rank", F.row_number().over(page))


def without_candidate(ordered: DataFrame, candidates: DataFrame) -> DataFrame:
    """Images and tables that no text may caption: page key, ordinal, element_id."""
    visuals = ordered.filter(F.col("element_type").isin("image", "table")).select(*PAGE, "ordinal", "element_id", "read_ord")
    return visuals.join(candidates.select(*PAGE, F.col("visual_ordinal").alias("ordinal")), [*PAGE, "ordinal"], "left_anti")


def title_scores(ordered: DataFrame, cfg: ParserConfig) -> DataFrame:
    """Scores of single pairs as titles, apart from the page's one title: every title-like element or placeholder with
    every other element of its page. Page key, source_ordinal, target_ordinal, score."""
    source = ordered.filter(F.coalesce("is_placeholder", F.lit(False)) | looks_like_title(cfg)).select(*PAGE, F.col("ordinal").alias("source_ordinal"))
    both = source.join(ordered.select(*PAGE, F.col("ordinal").alias("target_ordinal")), PAGE).filter("source_ordinal <> target_ordinal")
    return both.withColumn("score", F.lit(0.7))


def relations(
    ordered: DataFrame, cfg: ParserConfig, verifier: Column | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None, scorer: Callable[..., dict[str, Column]] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(relations, decisions). ``rel_idx`` numbers a document's relations: by page, titles first, then captions by score.

    Captions carry ``rule_score`` and ``score_breakdown``, the parts their score is made of; titles have none.
    """
    found = written(caption_candidates(ordered, cfg, scorer), "candidates")  # both results and the log of visuals without any read it
    judged = assigned(verified(rerank(found) if rerank else found, verifier))
    titles = title_relations(ordered, cfg).select(*PAGE, F.lit("title_of").alias("relation_type"), "source_ordinal", "target_ordinal", "source_element_id", "target_element_id", "confidence", F.lit(0).alias("part"), F.col("target_ord").alias("at"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("string").alias("caption_text"))
    taken = judged.filter("rejected_reason IS NULL").select(*PAGE, "relation_type", F.col("text_ordinal").alias("source_ordinal"), F.col("visual_ordinal").alias("target_ordinal"), F.col("text_element_id").alias("source_element_id"), F.col("visual_element_id").alias("target_element_id"), F.col("score").alias("confidence"), F.lit(1).alias("part"), F.col("rank").alias("at"), "method", "caption_text", F.col("score").alias("rule_score"), F.struct(*scoring_parts()).alias("score_breakdown"))
    out = titles.unionByName(taken, allowMissingColumns=True)
    out = out.withColumn("rel_idx", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "part", "at"))).drop("part", "at")
    none = without_candidate(ordered, found).select(*PAGE, F.col("element_id").alias("visual_element_id"), F.lit("no_candidate").alias("rejected_reason"), F.col("read_ord").alias("at"), F.lit(0).alias("part"))
    log = judged.select(*PAGE, "visual_element_id", "text_element_id", "score", "method", "rejected_reason", F.col("rank").alias("at"), F.lit(1).alias("part"), *scoring_parts())
    both = log.unionByName(none, allowMissingColumns=True)
    decisions = both.withColumn("decision_idx", F.row_number().over(Window.partitionBy(*PAGE).orderBy("part", "at"))).drop("part", "at")
    return out, decisions


def scoring_parts() -> list[str]:
    return ["proximity", "alignment", "size_ratio", "position", "text_hint", "bullet_penalty"]


def caption_map(rels: DataFrame) -> DataFrame:
    """(doc_id, target_element_id, caption): of several captions of one visual the last relation shows."""
    text = tx.stripped(F.col("caption_text"))
    shown = rels.filter((F.col("relation_type") == "caption_of") & (text != ""))
    return shown.groupBy("doc_id", "target_element_id").agg(F.max_by(text, F.col("rel_idx")).alias("caption"))
