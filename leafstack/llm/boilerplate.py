"""Lines repeated across one source's documents (problem 5).

First pass: every task keeps a bounded heavy-hitter summary (Misra-Gries) of the lines of each source; summaries merge by
adding counts and errors. Second pass: exact document counts of the few candidate lines. A source with so many lines that
its summaries may have lost a repeated one is counted exactly instead. Confirmed lines then leave the texts through one
set of lines per source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.common import maybe_broadcast, written

#: Counters kept for one source within one task.
COUNTERS = 1024
#: Counters held by one task in all; beyond this it hands out what it has and starts again, which only adds summaries.
HELD = 400_000


def site_of_path(path: Column) -> Column:
    """First folder of a path, lower-cased; separators and leading signs vary. Null where the path names no folder."""
    parts = F.filter(F.split(F.regexp_replace(path, r"\\", "/"), "/"), lambda x: ~F.trim(x).isin("", ".", ".."))
    return F.when(F.size(parts) > 1, F.lower(F.trim(F.element_at(parts, 1))))


def line_key(line: Column) -> Column:
    """Lines with the same key differ only in letter case, white space or the value of digit runs."""
    text = F.regexp_replace(line, r"[\s\p{Z}\x1c-\x1f\x85]+", " ")
    return F.regexp_replace(F.lower(F.upper(F.trim(text))), r"\p{Nd}+", "0")


class Summary:
    """Misra-Gries over integer keys, fed in batches of distinct keys with counts."""

    def __init__(self, counters: int = COUNTERS):
        self.counters, self.error = counters, 0
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both = np.concatenate([self.keys, keys])
        if not len(both):
            return
        self.keys, at = np.unique(both, return_inverse=True)
        self.counts = np.bincount(at, weights=np.concatenate([self.counts, counts])).astype(np.int64)
        if len(self.keys) > self.counters:
            # The usual merge of such summaries: take the first count beyond the room off all of them.
            cut = int(np.partition(self.counts, len(self.counts) - self.counters - 1)[len(self.counts) - self.counters - 1])
            self.error += cut
            keep = self.counts > cut
            self.keys, self.counts = self.keys[keep], self.counts[keep] - cut


def _summaries(counters: int):
    """Summaries of each task's lines, with ``counters`` counters per site."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def out() -> pa.RecordBatch:
            parts = [(s, m) for s, m in held.items()]
            n = [len(m.keys) + 1 for _, m in parts]
            return pa.record_batch(
                {
                    "site": pa.array(np.repeat(np.array([s for s, _ in parts], dtype=object), n), pa.string()),
                    "key": pa.array(np.concatenate([np.r_[0, m.keys] for _, m in parts]), pa.int64()),
                    "count": pa.array(np.concatenate([np.r_[0, m.counts] for _, m in parts]), pa.int64()),
                    "error": pa.array(np.concatenate([np.r_[m.error, np.zeros(len(m.keys), np.int64)] for _, m in parts]), pa.int64()),
                }
            )

        for batch in batches:
            df = batch.to_pandas()
            if df.empty:
                continue
            df = df.drop_duplicates()  # lines repeated on the pages of one document mostly sit in one batch
            code, sites = pd.factorize(df["site"])
            order = np.lexsort((df["key"].to_numpy(), code))
            code, key = code[order], df["key"].to_numpy()[order]
            new = np.r_[True, (code[1:] != code[:-1]) | (key[1:] != key[:-1])]
            first = np.flatnonzero(new)
            code, key, counts = code[first], key[first], np.diff(np.r_[first, len(code)])
            ends = np.searchsorted(code, np.arange(len(sites) + 1))
            for i, site in enumerate(sites):
                held.setdefault(site, Summary(counters)).add(key[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]])
            if sum(len(m.keys) for m in held.values()) > HELD:
                yield out()
                held = {}
        if held:
            yield out()

    return run


def heavy_candidates(lines: DataFrame, thresholds: DataFrame) -> DataFrame:
    """(site, key) of every line that may reach its site's threshold; none that does is missing.

    ``lines``: site, doc, key, one row per occurrence. A summary undercounts a line by at most its error, so count plus
    the site's whole error is an upper bound of the line's documents. Where that error alone reaches the threshold, a line
    may have left every summary, so all lines of such a site are counted exactly, in one more pass over it.
    """
    parts = lines.select("site", "doc", "key").mapInArrow(_summaries(COUNTERS), "site string, key long, count long, error long")
    merged = written(parts.groupBy("site", "key").agg(F.sum("count").alias("count"), F.sum("error").alias("error")), "line-summaries")
    # The rows with key 0 and count 0 carry the errors; a line whose hash is 0 shares the row and stays a candidate.
    errors = merged.filter("error > 0").groupBy("site").agg(F.sum("error").alias("site_error"))
    bound = thresholds.join(errors, "site", "left").select("site", "least", (F.col("least") - F.coalesce("site_error", F.lit(0))).alias("floor"))
    bound = written(bound, "line-bounds")
    sure = merged.join(maybe_broadcast(bound.filter("floor > 0")), "site").filter("key = 0 OR count >= floor").select("site", "key")
    unsure = bound.filter("floor <= 0").select("site", "least")
    if unsure.isEmpty():
        return sure
    places = lines.join(maybe_broadcast(unsure), "site").select("site", "key", "doc", "least").distinct()
    exact = places.groupBy("site", "key", "least").agg(F.count(F.lit(1)).alias("n")).filter("n >= least")
    return sure.unionByName(exact.select("site", "key"))


def element_sites(elements: DataFrame, packages: DataFrame) -> DataFrame:
    """``elements`` with ``site`` (in the place of an input column of that name): its own site code, lower-cased, or where that is missing the site of its package's path.

    Only the rows without a code take part in the join.
    """
    elements = elements.drop(*(c for c in elements.columns if c.lower() == "site"))
    code = F.lower(F.trim("site_code"))
    known = F.coalesce(code, F.lit("")) != ""
    paths = packages.groupBy("package_id").agg(F.min(site_of_path(F.col("source_path"))).alias("site"))
    return elements.filter(known).withColumn("site", code).unionByName(elements.filter(~known).join(paths, "package_id", "left"))


def site_thresholds(packages: DataFrame, share: float = 0.25, least: int = 3) -> DataFrame:
    """Per site the number of its packages and the number of them a line must occur in."""
    sites = packages.select("package_id", site_of_path(F.col("source_path")).alias("site")).filter("site IS NOT NULL")
    n = sites.groupBy("site").agg(F.count_distinct("package_id").alias("packages"))
    return n.withColumn("least", F.greatest(F.lit(least), F.ceil(F.col("packages") * F.lit(share))).cast("long"))


def _lines(sited: DataFrame) -> DataFrame:
    """One row per line that is not blank: uid, site, doc, line number from 1, key text."""
    rows = sited.filter(F.col("text").isNotNull() & F.col("site").isNotNull())
    rows = rows.select("element_uid", "site", F.col("package_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    return rows.select("element_uid", "site", "doc", (F.col("pos") + 1).alias("line_no"), line_key(F.col("line")).alias("line")).filter("line <> ''")


def _candidate_places(elements: DataFrame, packages: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Every occurrence of a candidate line, written once: the exact counts and the places both come from it."""
    lines = _lines(element_sites(elements, packages)).withColumn("key", F.xxhash64("line"))
    candidates = written(heavy_candidates(lines, thresholds), "candidate-lines")
    return written(lines.join(maybe_broadcast(candidates), ["site", "key"], "left_semi").drop("key"), "candidate-places")


def _confirmed(places: DataFrame, thresholds: DataFrame) -> DataFrame:
    exact = places.select("site", "line", "doc").distinct().groupBy("site", "line").agg(F.count(F.lit(1)).alias("packages_with_line"))
    return exact.join(thresholds, "site").filter("packages_with_line >= least").select("site", "line", "packages_with_line", "packages")


def repeated_lines(elements: DataFrame, packages: DataFrame, share: float = 0.25, least: int = 3) -> DataFrame:
    """Lines in at least ``share`` of their site's packages and in at least ``least`` of them.

    Returns site, line (in its comparison form), packages_with_line, packages. Blank lines are never reported; null and
    empty texts have no lines; rows that come twice count once, since packages are counted. Elements whose package is
    unknown take the site from their own site code; without either they belong to no site.
    """
    thresholds = site_thresholds(packages, share, least)
    return _confirmed(_candidate_places(elements, packages, thresholds), thresholds)


def repeated_line_places(elements: DataFrame, packages: DataFrame, share: float = 0.25, least: int = 3) -> DataFrame:
    """element_uid and line_no (from 1, blank lines counted) of every occurrence of a repeated line, distinct."""
    thresholds = site_thresholds(packages, share, least)
    places = _candidate_places(elements, packages, thresholds)
    confirmed = written(_confirmed(places, thresholds).select("site", "line"), "confirmed-lines")
    return places.join(maybe_broadcast(confirmed), ["site", "line"], "left_semi").select("element_uid", "line_no").distinct()


def without_repeated_lines(elements: DataFrame, packages: DataFrame, share: float = 0.25, least: int = 3) -> DataFrame:
    """All rows of ``elements`` with ``clean_text``: the text without its repeated lines, and ``lines_removed``.

    One set of confirmed lines per site meets the texts, so no text is shuffled while the sets are small enough to
    broadcast. A site confirms at most 1/``share`` times as many lines as a package has on average, which bounds its set.
    Null text stays null; a text of repeated lines only becomes empty. Input columns named like the result's are replaced.
    """
    mine = ("clean_text", "lines_removed", "__set", "__kept")
    elements = elements.drop(*(c for c in elements.columns if c.lower() in mine))
    confirmed = repeated_lines(elements, packages, share, least)
    sets = written(confirmed.groupBy("site").agg(F.collect_set("line").alias("__set")), "confirmed-sets")
    both = element_sites(elements, packages).join(maybe_broadcast(sets), "site", "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(lines, lambda x: ~F.array_contains("__set", line_key(x)))
    has = F.col("__set").isNotNull() & F.col("text").isNotNull()
    return (
        both.withColumn("__kept", F.when(has, kept))
        .withColumn("clean_text", F.when(has, F.array_join("__kept", "\n")).otherwise(F.col("text")))
        .withColumn("lines_removed", F.when(has, F.size(lines) - F.size("__kept")).otherwise(0))
        .drop("__set", "__kept")
    )
