"""Mixing sources to target weights (problem 7).

Each source needs a number of tokens; divided by what it has, that is the number of copies of each of its documents. The
whole part is given to every document, the fraction is rounded by the pivotal method: two documents exchange mass, in
random direction and so that expectations and the source's tokens stay as they are, until one of them is integral. Groups
of documents round independently and hand at most one unresolved document each to the next level of a reduction tree.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafstack.common import maybe_broadcast, written
from leafstack.llm.tokens import TOKENIZER, token_count

#: Documents rounded in one group, and unresolved documents that meet in one group of the next level.
GROUP, FAN_IN = 20_000, 5_000
_EPS = 1e-9


def pivotal(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round the fractions ``p`` of documents of ``size`` tokens; at most one stays fractional (its index, or -1).

    Mass moves between the two open documents in tokens, so sum(p * size) is kept exactly, and each move is a fair bet, so
    each expectation is too.
    """
    p = p.astype(float).copy()
    p[p < _EPS], p[p > 1 - _EPS] = 0.0, 1.0
    open_ = -1
    draws = rng.random(len(p))
    for i in np.flatnonzero((p > 0) & (p < 1)):
        if open_ < 0:
            open_ = int(i)
            continue
        a, b = open_, int(i)
        to_b = min(p[a] * size[a], (1 - p[b]) * size[b])  # tokens that can move from a to b
        to_a = min(p[b] * size[b], (1 - p[a]) * size[a])
        move = to_b if draws[i] < to_a / (to_a + to_b) else -to_a
        p[a] -= move / size[a]
        p[b] += move / size[b]
        for k in (a, b):
            p[k] = 0.0 if p[k] < _EPS else 1.0 if p[k] > 1 - _EPS else p[k]
        open_ = a if 0 < p[a] < 1 else b if 0 < p[b] < 1 else -1
    return p, open_


def _rounder(seed: int, level: int, last: bool):
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["size", "doc_id"], kind="stable").reset_index(drop=True)  # like sizes meet
        text = f"{seed}|{level}|{key[0]}|{key[1]}"
        rng = np.random.default_rng(np.frombuffer(text.encode().ljust(8, b"."), dtype=np.uint8))
        p, left = pivotal(df["p"].to_numpy(), df["size"].to_numpy(float), rng)
        if last and left >= 0:  # nobody is left to bet with: one draw, off by less than this document
            p[left] = float(rng.random() < p[left])
            left = -1
        df["p"], df["open"] = p, False
        if left >= 0:
            df.loc[left, "open"] = True
        return df

    return run


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(source, doc_id, size): tokens of every document that has any; rows that come twice count once, the longest stays."""
    sized = docs.filter(F.col("source").isNotNull() & F.col("text").isNotNull()).select("source", "doc_id", token_count(F.col("text"), tokenizer).alias("size"))
    return sized.groupBy("doc_id").agg(F.max(F.struct("size", "source")).alias("m")).select("m.source", "doc_id", "m.size").filter("size > 0")


def source_plan(sizes: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """Per source: target_weight, max_repeats, available tokens, documents, and the copies wanted of each document.

    Without ``total_tokens`` the mix is made as large as it can be with every source at its weight. Weights count relative
    to the sum over sources that have documents; a source without targets or documents is left out; with a given total a
    source gets no more than max_repeats copies, so its share may stay below the target.
    """
    have = sizes.groupBy("source").agg(F.sum("size").alias("available"), F.count(F.lit(1)).alias("documents"))
    wanted = targets.filter("source IS NOT NULL AND target_weight > 0 AND max_repeats > 0")
    wanted = wanted.groupBy("source").agg(F.max("target_weight").alias("target_weight"), F.max("max_repeats").alias("max_repeats"))
    both = have.join(wanted, "source")
    top = both.agg(F.sum("target_weight").alias("weights"), F.min(F.col("max_repeats") * F.col("available") / F.col("target_weight")).alias("reach"))
    total = F.lit(float(total_tokens)) if total_tokens is not None else F.col("reach") * F.col("weights")
    plan = both.crossJoin(F.broadcast(top)).withColumn("weight", F.col("target_weight") / F.col("weights"))  # top is one row
    plan = plan.withColumn("rate", F.least(F.col("max_repeats").cast("double"), F.col("weight") * total / F.col("available")))
    return plan.select("source", "target_weight", "weight", "max_repeats", "available", "documents", "rate")


def mix(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen documents, shares per source).

    Chosen: doc_id, source, size, copies (at least 1, at most the source's max_repeats). Shares: see :func:`shares`.
    Documents with null or empty text, or with a null source or one without target, are never chosen; rows of a null doc_id
    are one document. Other columns aren't read. Equal sizes are
    ordered by doc_id, so the choice depends on the seed and the data alone, not on how they are partitioned.
    """
    sizes = written(token_sizes(docs, tokenizer), "token-sizes")
    plan = written(source_plan(sizes, targets, total_tokens), "source-plan")
    rows = sizes.join(maybe_broadcast(plan.select("source", "documents", "rate")), "source")
    # At the ceiling every copy is whole; the rest splits into a whole and a fractional part.
    whole = F.floor(F.col("rate") + F.lit(_EPS))
    rows = rows.select("source", "doc_id", "size", whole.cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("rate") - whole).alias("p"), "documents")
    groups = F.greatest(F.lit(1), F.ceil(F.col("documents") / GROUP))
    state = rows.select("source", "doc_id", "size", "whole", "p", F.pmod(F.xxhash64("doc_id", F.lit(seed)), groups).alias("bucket"))
    most = max(1, int(plan.agg(F.max("documents")).first()[0] or 0))
    levels, buckets = 1, -(-most // GROUP)
    while buckets > 1:
        levels, buckets = levels + 1, -(-buckets // FAN_IN)
    kind = sizes.schema["doc_id"].dataType.simpleString()
    schema = f"source string, doc_id {kind}, size long, whole int, p double, bucket long, open boolean"
    decided = []
    for level in range(levels):
        out = state.groupBy("source", "bucket").applyInPandas(_rounder(seed, level, level == levels - 1), schema)
        out = written(out, f"rounded-{level}")
        decided.append(out.filter("NOT open"))
        state = out.filter("open").select("source", "doc_id", "size", "whole", "p", F.floor(F.col("bucket") / FAN_IN).alias("bucket"))
    done = decided[0]
    for d in decided[1:]:
        done = done.unionByName(d)
    chosen = done.select("doc_id", "source", "size", (F.col("whole") + F.col("p").cast("int")).alias("copies")).filter("copies > 0")
    return chosen, shares(chosen, plan, targets)


def shares(chosen: DataFrame, plan: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_weight, available tokens, tokens in the mix, actual_share, documents chosen, most copies.

    Sources without documents are listed with zeros.
    """
    got = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("chosen_documents"), F.max("copies").alias("most_copies"))
    total = got.agg(F.sum("tokens").alias("total"))
    out = targets.filter("source IS NOT NULL").select("source", "target_weight", "max_repeats").distinct().join(plan.select("source", "available"), "source", "left").join(got, "source", "left")
    out = out.crossJoin(F.broadcast(total))  # one row
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "source", "target_weight", "max_repeats", zero(F.col("available")).alias("available_tokens"), zero(F.col("tokens")).alias("tokens"),
        F.coalesce(F.col("tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"), zero(F.col("chosen_documents")).alias("chosen_documents"), zero(F.col("most_copies")).alias("most_copies"),
    )


def audit(chosen: DataFrame, got: DataFrame, docs: DataFrame) -> DataFrame:
    """Per target source: max_repeats, usable_documents (with text), whether no document is used more often than that, and
    whether the source's tokens are within one of its documents (its longest) of what the reached total asks for.

    ``chosen`` and ``got``: the results of :func:`mix`. Weights count relative to the sources that have documents.
    """
    usable = docs.filter(F.col("source").isNotNull() & (F.coalesce("text", F.lit("")) != "")).groupBy("source").agg(F.count_distinct("doc_id").alias("usable_documents"))
    longest = chosen.groupBy("source").agg(F.max("size").alias("longest"))
    live = F.when(F.col("available_tokens") > 0, F.col("target_weight"))
    # Every source may be off by one document, and so is the total they are measured against.
    total = got.join(longest, "source", "left").agg(F.sum("tokens").alias("total"), F.sum(live).alias("weights"), F.sum("longest").alias("slack"))
    rows = got.join(longest, "source", "left").join(usable, "source", "left").crossJoin(F.broadcast(total))  # one row
    share = F.coalesce(live / F.col("weights"), F.lit(0.0))
    off = F.abs(F.col("tokens") - share * F.col("total"))
    return rows.select(
        "source", "max_repeats", F.coalesce("usable_documents", F.lit(0)).alias("usable_documents"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_caps"),
        (off <= F.coalesce("longest", F.lit(0)) + share * F.col("slack")).alias("within_one_document"),
    )
