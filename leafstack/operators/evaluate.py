"""Metrics of reading order and relations, and the reports built from them."""

from __future__ import annotations

import dataclasses

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GROUP = ["doc_id", "page_number"]


def kendall_tau(expected: DataFrame, predicted: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """Rank agreement per group: keys and ``tau``.

    Frames of (keys, id, pos). Only ids that occur in both count; fewer than two, or none comparable, give 1. An id that
    comes twice has its last place.
    """
    last = lambda df, n: df.groupBy(*keys, "id").agg(F.max("pos").alias(n))
    both = last(expected, "e").join(last(predicted, "p"), [*keys, "id"])
    pairs = both.alias("a").join(both.alias("b"), [*(F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys), F.col("a.e") < F.col("b.e")])
    sign = F.signum((F.col("b.p") - F.col("a.p")).cast("double"))
    got = pairs.groupBy(*(F.col(f"a.{k}").alias(k) for k in keys)).agg(F.sum(sign).alias("s"), F.sum(F.abs(sign)).alias("n"))
    every = expected.select(*keys).distinct()
    return every.join(got, keys, "left").select(*keys, F.when(F.coalesce("n", F.lit(0.0)) > 0, F.col("s") / F.col("n")).otherwise(1.0).alias("tau"))


def _distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance, a row at a time; the running minimum of the insertions is a prefix minimum."""
    place = np.arange(len(b) + 1)
    row = place.copy()
    for i, x in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != x))
        best = np.r_[i, best]
        row = np.minimum.accumulate(best - place) + place
    return int(row[-1])


def edit_similarity(expected: DataFrame, predicted: DataFrame, keys: list[str] = GROUP) -> DataFrame:
    """1 - edit distance / longer length of the id sequences per group: keys and ``ned``; two empty sequences give 1."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            code = {v: i for i, v in enumerate(dict.fromkeys([*x, *y]))}
            n = max(len(x), len(y))
            out.append(1.0 if n == 0 else 1.0 - _distance(np.array([code[v] for v in x]), np.array([code[v] for v in y])) / n)
        return pd.Series(out, dtype=float)

    seq = lambda df, n: df.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias(n))
    both = seq(expected, "a").join(seq(predicted, "b"), keys, "full")
    empty = F.array().cast("array<string>")
    return both.select(*keys, score(F.coalesce("a", empty), F.coalesce("b", empty)).alias("ned"))


def _rates(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    p, r = tp / F.greatest(tp + fp, F.lit(1)), tp / F.greatest(tp + fn, F.lit(1))
    return p, r, 2 * p * r / F.greatest(p + r, F.lit(1e-9))


def relation_prf(golden: DataFrame, predicted: DataFrame, keys: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """Precision, recall and F1 per relation type and over all (type ``_overall``), on distinct (type, source, target).

    Frames of (keys, relation_type, source_element_id, target_element_id). ``digits`` rounds for display.
    """
    keys = keys or []
    cols = [*keys, "relation_type", "source_element_id", "target_element_id"]
    g, p = golden.select(*cols).distinct().withColumn("g", F.lit(1)), predicted.select(*cols).distinct().withColumn("p", F.lit(1))
    both = g.join(p, cols, "full").select(*cols, F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("p", F.lit(0)).alias("p"))
    sums = [F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum(F.col("p") * (1 - F.col("g"))).alias("fp"), F.sum(F.col("g") * (1 - F.col("p"))).alias("fn")]
    sets = [[*(F.col(k) for k in keys), F.col("relation_type")], [F.col(k) for k in keys]]
    got = both.groupingSets(sets, *keys, "relation_type").agg(F.grouping("relation_type").alias("whole"), *sums)
    prec, rec, f1 = _rates(F.col("tp"), F.col("fp"), F.col("fn"))
    cut = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return got.select(*keys, F.when(F.col("whole") == 1, "_overall").otherwise(F.col("relation_type")).alias("relation_type"), "tp", "fp", "fn", cut(prec).alias("precision"), cut(rec).alias("recall"), cut(f1).alias("f1"))


def golden_report(orders: tuple[DataFrame, DataFrame], relations: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Per document: labelled pages, mean tau and edit similarity, and overall precision, recall and F1."""
    tau, ned = kendall_tau(*orders), edit_similarity(*orders)
    pages = tau.join(ned, GROUP).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.avg("tau").alias("avg_tau"), F.avg("ned").alias("avg_ned"))
    prf = relation_prf(*relations, keys=["doc_id"]).filter("relation_type = '_overall'").select("doc_id", "precision", "recall", "f1")
    return pages.join(prf, "doc_id", "left")


def caption_baseline(elements: DataFrame, relations: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per document, and over all (doc_id null): pages, images, caption relations, decisions, rejected ones, captions per
    image and the share of rejections."""
    e = elements.groupBy("doc_id").agg(F.count_distinct("page_number").alias("pages"), F.sum((F.col("element_type") == "image").cast("int")).alias("images"))
    r = relations.filter("relation_type = 'caption_of'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("captions"))
    d = decisions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("decisions"), F.count("rejected_reason").alias("rejected"))
    both = e.join(r, "doc_id", "left").join(d, "doc_id", "left").fillna(0, ["captions", "decisions", "rejected"])
    got = both.rollup("doc_id").agg(*(F.sum(c).alias(c) for c in ("pages", "images", "captions", "decisions", "rejected")))
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return got.select("*", ratio("captions", "images").alias("caption_density_per_image"), ratio("rejected", "decisions").alias("rejection_rate"))


GOLDEN = "source string, pages array<struct<page_number:int,expected_reading_order:array<string>,expected_relations:array<struct<type:string,source:string,target:string>>>>"


@dataclasses.dataclass(frozen=True)
class Golden:
    """Labels of documents: pages (doc_id, page_number), order (with id, pos) and relations (with page_number)."""

    documents: DataFrame
    pages: DataFrame
    order: DataFrame
    relations: DataFrame


def read_golden(spark: SparkSession, folder: str, root: str = "") -> Golden:
    """Labels from the files ``*.golden.json`` below ``folder``; ``root`` goes before the path of their ``source``.

    A page without labelled order or relations has none; an id that an order names twice counts where it stands last.
    """
    raw = spark.read.schema(GOLDEN).option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.golden.json").json(folder)
    labels = raw.filter("source IS NOT NULL").select(F.concat(F.lit(root), "source").alias("doc_id"), "pages")
    pages = labels.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")
    order = pages.select("doc_id", "page_number", F.posexplode("expected_reading_order").alias("pos", "id"))
    rels = pages.select("doc_id", "page_number", F.explode("expected_relations").alias("r"))
    rels = rels.select("doc_id", "page_number", F.col("r.type").alias("relation_type"), F.col("r.source").alias("source_element_id"), F.col("r.target").alias("target_element_id"))
    return Golden(labels.select("doc_id").distinct(), pages.select("doc_id", "page_number").distinct(), order, rels)


def golden_evaluation(golden: Golden, pages: DataFrame, ordered: DataFrame, relations: DataFrame, digits: int = 4) -> DataFrame:
    """Per labelled document: ``status`` (ok, or missing where it wasn't parsed), labelled pages that were found and not
    found, mean tau and edit similarity over those found, and precision, recall and F1 of their relations.

    Relations of pages without labels don't count. A document none of whose labelled pages was found has zeros.
    """
    here = pages.select("doc_id", "page_number").distinct()
    found = golden.pages.join(here, GROUP, "left_semi")
    order = golden.order.join(found, GROUP, "left_semi")
    predicted = ordered.join(found, GROUP, "left_semi").select(*GROUP, F.col("element_id").alias("id"), F.col("read_ord").alias("pos"))
    tau = found.join(kendall_tau(order, predicted), GROUP, "left").select(*GROUP, F.coalesce("tau", F.lit(1.0)).alias("tau"))
    ned = found.join(edit_similarity(order, predicted), GROUP, "left").select(*GROUP, F.coalesce("ned", F.lit(1.0)).alias("ned"))
    scores = tau.join(ned, GROUP).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.avg("tau").alias("avg_tau"), F.avg("ned").alias("avg_ned"))
    prf = relation_prf(golden.relations.join(found, GROUP, "left_semi"), relations.join(found, GROUP, "left_semi"), keys=["doc_id"]).filter("relation_type = '_overall'").select("doc_id", "precision", "recall", "f1")
    lost = golden.pages.join(here, GROUP, "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages_not_found"))
    parsed = here.select("doc_id").distinct().withColumn("status", F.lit("ok"))
    out = golden.documents.join(parsed, "doc_id", "left").join(scores, "doc_id", "left").join(lost, "doc_id", "left").join(prf, "doc_id", "left")
    zero = lambda c: F.round(F.coalesce(F.col(c), F.lit(0.0)), digits).alias(c)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("doc_id", F.coalesce("status", F.lit("missing")).alias("status"), count("pages"), count("pages_not_found"), *(zero(c) for c in ("avg_tau", "avg_ned", "precision", "recall", "f1")))


def review_sample(relations: DataFrame, size: int = 50, seed: int = 0) -> DataFrame:
    """``size`` caption relations to be judged by hand, chosen by hash, so that the same data give the same sample."""
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), "doc_id", F.col("page_number").cast("string"), "source_element_id", "target_element_id"))
    picked = relations.filter("relation_type = 'caption_of'").withColumn("__mark", mark).orderBy("__mark", "doc_id", "rel_idx").limit(size)
    return picked.select("doc_id", "page_number", "source_element_id", "target_element_id", "confidence", F.lit("correct_caption_link, wrong_link or missing_link").alias("labels"))
