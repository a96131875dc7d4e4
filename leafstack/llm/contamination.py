"""Evaluation texts leaking into training text (problem 6).

Spaced seeds: fixed masks over a window of words ignore selected positions, so that a window still meets its copy after
words in ignored positions were changed. Corpus and test windows are hashed under each mask; a bitmap of the test hashes,
sized by their number, lets the corpus side drop nearly all of its windows where they arise. The rest is joined with the
test windows and compared word by word.
"""

from __future__ import annotations

import html
import operator
import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafstack.common import maybe_broadcast, written

#: Words in a window; a passage is at least this long.
WINDOW = 12
#: Bits of the filter for each test hash, and the most bits it may have (as a power of two: 16 MB). More test hashes than
#: that allows are joined without a filter, with the same result.
BITS_PER_HASH, MOST_BITS = 16, 27


def masks(changes: int, width: int = WINDOW) -> tuple[str, ...]:
    """Masks (1: the position counts) of which at least one ignores all of any ``changes`` positions.

    The window is cut into ``changes`` + 2 blocks and each mask looks at two of them: the changes leave two blocks whole.
    """
    if not 0 <= changes <= width - 2:
        raise ValueError(f"changes must be from 0 to {width - 2}")
    block = [j * (changes + 2) // width for j in range(width)]
    return tuple("".join("01"[b in kept] for b in block) for kept in combinations(range(changes + 2), 2))


_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->|\[/?[a-zA-Z*]{1,12}(?:=[^\[\]]*)?\]", re.S)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")
_WORD = re.compile(r"[^\W_]+")
_UNSEEN = re.compile("[­​-‏⁠﻿]")


def words(text: str | None) -> list[str]:
    """Words in lower case; punctuation, quote signs, markup tags, entities and line breaks only part them."""
    if not text:
        return []
    if "<" in text or "[" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: c if (c := html.unescape(m[0])).isalnum() else " ", text)
        if "<" in text:
            text = _TAG.sub(" ", text)
    return _WORD.findall(_UNSEEN.sub("", text).lower())


def _factors(width: int) -> np.ndarray:
    """Odd multipliers, one per place, from a fixed linear congruence."""
    x, out = 0x9E3779B97F4A7C15, []
    for _ in range(width):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x | 1)
    return np.array(out, dtype=np.uint64)


def window_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each window of ``len(mask)`` words under ``mask``, from the words' own hashes."""
    n = len(hashes) - len(mask) + 1
    out, f = np.zeros(max(n, 0), dtype=np.uint64), _factors(len(mask))
    if n > 0:
        for j, bit in enumerate(mask):
            if bit == "1":
                out += hashes[j : j + n] * f[j]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _hits(batch: pa.RecordBatch, width: int, seeds: tuple[str, ...], bitmap: np.ndarray | None) -> pa.RecordBatch:
    """Windows of a batch (id, text) whose hash is in the bitmap, with their words; all windows without one."""
    from xxhash import xxh3_64_intdigest

    cache: dict[str, int] = {}
    flat: list[str] = []
    ends = []
    for text in batch.column(1).to_pylist():
        flat += words(text)
        ends.append(len(flat))
    hashed = np.empty(len(flat), dtype=np.uint64)
    for i, w in enumerate(flat):
        h = cache.get(w)
        if h is None:
            h = cache[w] = xxh3_64_intdigest(w)
        hashed[i] = h
    ends = np.array(ends, dtype=np.int64)
    first = np.r_[0, ends[:-1]]
    doc = np.repeat(np.arange(len(ends)), ends - first)
    rows, places, kinds, values = [], [], [], []
    inside = doc[: len(flat) - width + 1] == doc[width - 1 :] if len(flat) >= width else np.zeros(0, bool)
    for k, mask in enumerate(seeds):
        h = window_hashes(hashed, mask)
        ok = inside
        if bitmap is not None and len(h):
            bit = h >> np.uint64(58 - (len(bitmap).bit_length() - 1))
            ok = inside & ((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
        at = np.flatnonzero(ok)
        rows.append(doc[at])
        places.append(at)
        kinds.append(np.full(len(at), k, dtype=np.int32))
        values.append(h[at].view(np.int64))
    rows, places, kinds, values = (np.concatenate(x) for x in (rows, places, kinds, values))
    return pa.record_batch(
        [
            batch.column(0).take(pa.array(rows, pa.int64())),
            pa.array(kinds, pa.int32()),
            pa.array(values, pa.int64()),
            pa.array((places - first[rows]).astype(np.int32) if len(rows) else np.zeros(0, np.int32), pa.int32()),
            pa.array([" ".join(flat[p : p + width]) for p in places], pa.string()),
        ],
        names=["id", "seed", "hash", "pos", "window"],
    )


def _windows(texts: DataFrame, width: int, seeds: tuple[str, ...], bitmap: np.ndarray | None) -> DataFrame:
    """(id, seed, hash, pos, window) of a frame of (id, text)."""
    kind = texts.schema["id"].dataType.simpleString()
    handle = texts.sparkSession.sparkContext.broadcast(bitmap) if bitmap is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Slices keep a batch's word list small whatever the texts' lengths.
            sizes = np.array([len(t or "") for t in batch.column(1).to_pylist()])
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // 4_000_000)) + 1
            for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(sizes)]):
                if b > a:
                    yield _hits(batch.slice(a, b - a), width, seeds, None if handle is None else handle.value)

    return texts.mapInArrow(run, f"id {kind}, seed int, hash long, pos int, window string")


def _bitmap(windows: DataFrame) -> np.ndarray | None:
    """Bitmap of the hashes, or None where they are too many for one.

    Its 64-bit words are put together where the hashes arise; what reaches the driver is at most 2^MOST_BITS bits.
    """
    hashes = int(windows.agg(F.approx_count_distinct("hash")).first()[0])
    bits = max(10, (hashes * BITS_PER_HASH).bit_length())
    if bits > MOST_BITS:
        return None
    place = f"shiftrightunsigned(hash, {64 - bits})"
    parts = windows.select(F.expr(f"{place} div 64").alias("w"), F.expr(f"shiftleft(1L, cast({place} % 64 AS int))").alias("b"))
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    got = parts.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).view(np.uint64)
    return out


def window_matches(docs: DataFrame, items: DataFrame, seeds: tuple[str, ...], changes: int = 0, width: int = WINDOW) -> DataFrame:
    """Pairs of windows that share a seed hash and differ in at most ``changes`` words: doc_id, item_id, doc_pos, item_pos,
    changed, distinct.

    ``docs`` and ``items`` are frames of (id, text). Test windows that are few enough are broadcast; else both sides are
    shuffled by hash, where adaptive execution splits the document side of a hash that many documents hold.
    """
    test = written(_windows(items, width, seeds, None).distinct(), "test-windows")
    hits = _windows(docs, width, seeds, _bitmap(test))
    d = hits.select(F.col("id").alias("doc_id"), "seed", "hash", F.col("pos").alias("doc_pos"), F.split("window", " ").alias("a"))
    i = test.select(F.col("id").alias("item_id"), "seed", "hash", F.col("pos").alias("item_pos"), F.split("window", " ").alias("b"))
    both = d.join(maybe_broadcast(i), ["seed", "hash"])
    # Word by word as one compiled sum, not as functions over arrays.
    changed = reduce(operator.add, [(F.get("a", F.lit(k)) != F.get("b", F.lit(k))).cast("int") for k in range(width)])
    return both.select("doc_id", "item_id", "doc_pos", "item_pos", changed.alias("changed")).filter(F.col("changed") <= changes).distinct()


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))


def exact_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (doc_id, item_id) where the document holds at least 12 consecutive words of the item: the overlaps of
    :func:`tolerant_leaks` that hold a window without a change.

    Null and empty texts and items of fewer words than the window are in no pair. Rows that come twice count once. A passage
    shared by several items leaks all of them.
    """
    return tolerant_leaks(docs, items, doc_key, item_key, text).filter("exact_windows > 0").select(doc_key, item_key)


def tolerant_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", changes: int = 2) -> DataFrame:
    """Per (doc_id, item_id) the longest overlap that allows ``changes`` changed words in any 12: its place and length in
    words; and ``exact_windows``, the windows of 12 words that the pair shares without a change, in any overlap.

    Every window of 12 words with that many changes or fewer is hit under some mask (see :func:`masks`) and is compared
    word by word. Windows that follow each other word by word on one diagonal form one overlap, so no 12 words inside it
    have more changes; changed words at its ends belong to it. Of equal lengths the overlap with more windows without a
    change counts, then the earlier one in the document, then in the item. Nulls and repeated rows as for :func:`exact_leaks`.
    """
    near = window_matches(_keyed(docs, doc_key, text), _keyed(items, item_key, text), masks(changes), changes)
    run = Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("doc_pos")
    near = near.withColumn("diagonal", F.col("doc_pos") - F.col("item_pos"))
    near = near.withColumn("new", (F.coalesce(F.col("doc_pos") - F.lag("doc_pos").over(run), F.lit(2)) > 1).cast("int"))
    near = near.withColumn("run", F.sum("new").over(run))
    runs = near.groupBy("doc_id", "item_id", "diagonal", "run").agg(
        F.min("doc_pos").alias("doc_pos"), F.min("item_pos").alias("item_pos"), (F.max("doc_pos") - F.min("doc_pos") + WINDOW).alias("overlap_words"), F.sum((F.col("changed") == 0).cast("int")).alias("exact")
    )
    best = runs.groupBy("doc_id", "item_id").agg(F.max(F.struct("overlap_words", "exact", (-F.col("doc_pos")).alias("a"), (-F.col("item_pos")).alias("b"))).alias("m"), F.sum("exact").alias("exact_windows"))
    return best.select(F.col("doc_id").alias(doc_key), F.col("item_id").alias(item_key), F.col("m.overlap_words").cast("long").alias("overlap_words"), "exact_windows", (-F.col("m.a")).alias("doc_pos"), (-F.col("m.b")).alias("item_pos"))
