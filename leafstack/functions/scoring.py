"""Scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafstack.config import ParserConfig
from leafstack.functions import geometry as geo
from leafstack.functions import text as tx


def caption_gate(t: tuple, v: tuple, cfg: ParserConfig) -> Column:
    """Whether text box ``t`` lies above or below visual box ``v``, near and aligned enough to be scored."""
    below, above = t[1] - v[3], v[1] - t[3]
    gap = F.least(F.when(below >= 0, below), F.when(above >= 0, above))
    return (_overlap_ratio(t, v) >= 1.0 - cfg.alignment_tolerance) & gap.isNotNull() & (gap <= cfg.caption_max_gap)


def _overlap_ratio(t: tuple, v: tuple) -> Column:
    shared = geo.positive(F.least(v[2], t[2]) - F.greatest(v[0], t[0]))
    return shared / F.greatest(F.least(v[2] - v[0], t[2] - t[0]), F.lit(1e-6))


def text_parts(text: Column) -> dict[str, Column]:
    """The parts of a caption score that depend on the text alone, to be worked out once for each text."""
    n = F.length(text)
    length = F.when(n.between(8, 120), 1.0).when(n.between(1, 180), 0.5).otherwise(0.0)
    return {
        "text_hint": F.greatest(length, F.when(tx.has_caption_word(text), 1.0).otherwise(0.0)),
        "bullet_penalty": F.when(F.substring(text, 1, 1).isin(*tx.BULLETS), 0.3).otherwise(0.0),
    }


def caption_breakdown(t: tuple, v: tuple, sizes: tuple, text: Column, cfg: ParserConfig, of_text: dict[str, Column] | None = None) -> dict[str, Column]:
    """The parts of a caption score; meaningful only behind :func:`caption_gate`.

    ``sizes``: width and height of the text and of the visual. ``of_text``: :func:`text_parts` where they are known.
    """
    below, above = t[1] - v[3], v[1] - t[3]
    gap = F.least(F.when(below >= 0, below), F.when(above >= 0, above))
    tw, th, vw, vh = sizes
    ratio = F.greatest(tw * th, F.lit(1e-9)) / F.greatest(vw * vh, F.lit(1e-9))
    near = lambda g: (g >= 0) & (g <= cfg.caption_max_gap)
    return {
        "proximity": geo.positive(F.lit(1.0) - gap / F.lit(max(cfg.caption_max_gap, 1e-6))),
        "alignment": geo.clamp(_overlap_ratio(t, v)),
        "size_ratio": F.when(ratio < 0.5, 1.0).otherwise(geo.positive(F.lit(1.0) - ratio)),
        "position": F.when(near(below), 0.8).when(near(above), 0.6).otherwise(0.3),
    } | (of_text or text_parts(text))


def combined(parts: dict[str, Column], cfg: ParserConfig) -> dict[str, Column]:
    """``raw`` and ``score`` of the parts by their weights."""
    raw = F.lit(cfg.rel_proximity_weight) * parts["proximity"] + F.lit(cfg.rel_alignment_weight) * parts["alignment"]
    raw = raw + F.lit(cfg.rel_size_ratio_weight) * parts["size_ratio"] + F.lit(cfg.rel_position_weight) * parts["position"]
    raw = raw + F.lit(cfg.rel_text_hint_weight) * parts["text_hint"] - parts["bullet_penalty"]
    return {"raw": raw, "score": geo.clamp(raw)}


def relation_type(score: Column, cfg: ParserConfig) -> Column:
    """caption_of, related_to, or null below both thresholds."""
    return F.when(score >= cfg.caption_rule_threshold, "caption_of").when(score >= cfg.caption_vlm_threshold, "related_to")


def header_score(any_span: Column, short_cells: Column, cells: Column) -> Column:
    """How much the first row of a table looks like a header; header from 0.45 on."""
    structure = F.lit(0.5) + F.when(any_span, F.lit(0.3)).otherwise(0.0)
    return F.lit(0.5) * structure + F.lit(0.3) * F.lit(0.0) + F.lit(0.2) * (short_cells / F.greatest(cells, F.lit(1)))
