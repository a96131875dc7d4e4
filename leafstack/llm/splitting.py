"""Splitting oversized texts at natural boundaries (problem 1).

Every possible cut position gets a boundary strength. A sparse table over the strengths answers "strongest cut in this
length window, the rightmost of equals" in constant time; the next piece starts the overlap before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strength of a cut: never inside a character sequence, anywhere, word end, sentence end, line end, paragraph end.
JOINED, INSIDE, WORD, SENTENCE, LINE, PARAGRAPH = range(6)
#: Code points indexed at once. Bounds the table to about 4 * 12 bytes a code point; longer texts go through in stretches.
STRETCH = 1 << 20

_SPAN = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
SPANS = T.ArrayType(T.StructType(_SPAN))
PIECES = T.ArrayType(T.StructType([*_SPAN, T.StructField("text", T.StringType())]))

_SPACE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_STOP = np.array([ord(c) for c in ".!?…。！？．"], dtype=np.uint32)
_WIDE_STOP = np.array([ord(c) for c in "。！？"], dtype=np.uint32)
_CLOSER = np.array([ord(c) for c in "\"')]}»”’」』"], dtype=np.uint32)
_EXTEND = [(0x300, 0x36F), (0x483, 0x489), (0x591, 0x5BD), (0x64B, 0x65F), (0x93A, 0x94D), (0x1160, 0x11FF), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x200C, 0x200D), (0x20D0, 0x20F0), (0xFE00, 0xFE0F), (0xFE20, 0xFE2F), (0x1F3FB, 0x1F3FF), (0xE0100, 0xE01EF)]


def _last(flag: np.ndarray) -> np.ndarray:
    """For each place the index of the last set flag at or before it, or -1."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))


def boundary_strengths(code: np.ndarray) -> np.ndarray:
    """Strength of cutting before each index of ``code`` (and at its end): an array one longer than ``code``."""
    n = len(code)
    out = np.full(n + 1, INSIDE, dtype=np.int32)
    if n == 0:
        return out
    space, newline = np.isin(code, _SPACE), code == 10
    closer = np.isin(code, _CLOSER)
    ink, inked = _last(~space), _last(~space & ~closer)  # last visible code point; the same without closing marks
    before_space = np.r_[False, space]  # the code point left of the cut is white space
    after_space = np.r_[space, True]
    out[before_space | after_space] = WORD
    mark = np.isin(code, _STOP)
    ends = (inked >= 0) & mark[np.maximum(inked, 0)]
    out[1:][ends & (space | after_space[1:])] = SENTENCE
    out[1:][ends & ~space & (ink == np.arange(n)) & np.isin(code[np.maximum(inked, 0)], _WIDE_STOP)] = SENTENCE
    out[1:][newline] = LINE
    previous = np.r_[-1, _last(newline)[:-1]]  # the line feed before this one
    out[1:][newline & (previous >= 0) & (ink < previous)] = PARAGRAPH
    extends = np.zeros(n, dtype=bool)
    if code.max() >= 0x300:
        for a, b in _EXTEND:
            extends |= (code >= a) & (code <= b)
    extends[1:] |= (code[:-1] == 0x200D) | ((code[:-1] == 13) & newline[1:])
    out[:-1][extends] = JOINED
    return out


class RangeMax:
    """Sparse table over ``strength``; keys carry the position, so equal strengths resolve to the right."""

    def __init__(self, strength: np.ndarray, widest: int):
        self.base = len(strength)
        level = strength.astype(np.int64) * self.base + np.arange(self.base)
        self.levels = [level.astype(np.int32 if 6 * self.base < 2**31 else np.int64)]
        for k in range(max(1, int(widest)).bit_length() - 1):
            low = self.levels[-1]
            if len(low) <= 1 << k:
                break
            self.levels.append(np.maximum(low[: -(1 << k)], low[1 << k :]))

    def best(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Strength and position of the best cut in each closed window ``lo..hi``."""
        k = np.floor(np.log2(hi - lo + 1)).astype(np.int64)
        key = np.empty(len(lo), dtype=np.int64)
        for level in np.unique(k):
            at = k == level
            t = self.levels[level]
            key[at] = np.maximum(t[lo[at]], t[hi[at] - (1 << int(level)) + 1])
        return key // self.base, key % self.base


def _split_batch(codes: list[np.ndarray], limits: np.ndarray, overlaps: np.ndarray, strengths: list[np.ndarray] | None = None) -> list[list[tuple[int, int]]]:
    """Spans of texts that all exceed their limit; one table serves all of them, and each round cuts one piece from each."""
    sizes = np.array([len(c) for c in codes], dtype=np.int64)
    base = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    index = RangeMax(np.concatenate(strengths or [boundary_strengths(c) for c in codes]), int(limits.max()))
    out: list[list[tuple[int, int]]] = [[] for _ in codes]
    start, live = np.zeros(len(codes), dtype=np.int64), np.arange(len(codes))
    while len(live):
        s, limit, overlap = start[live], limits[live], overlaps[live]
        done = sizes[live] - s <= limit
        for i in live[done]:
            out[i].append((int(start[i]), int(sizes[i])))
        live, s, limit, overlap = live[~done], s[~done], limit[~done], overlap[~done]
        if not len(live):
            break
        hi = base[live] + s + limit
        near, far = base[live] + s + np.maximum(overlap + 1, (limit + 1) // 2), base[live] + s + overlap + 1
        strength, cut = index.best(near, hi)
        weak = strength < WORD  # nothing in the upper half: look at every length that still moves on
        if weak.any():
            _, cut[weak] = index.best(far[weak], hi[weak])
        cut -= base[live]
        for i, a, b in zip(live, s, cut):
            out[i].append((int(a), int(b)))
        start[live] = cut - overlap
    return out


def _lead(code: np.ndarray, start: int) -> int:
    """Place of the last visible code point before ``start`` that is no closing mark: what a boundary there depends on."""
    step, end = 4096, start
    while end > 0:
        begin = max(0, end - step)
        seen = np.flatnonzero(~np.isin(code[begin:end], _SPACE) & ~np.isin(code[begin:end], _CLOSER))
        if len(seen):
            return begin + int(seen[-1])
        step, end = 2 * step, begin
    return 0


def _split_long(code: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """As ``_split_batch`` for one text beyond a stretch, indexed stretch by stretch."""
    out, start, step = [], 0, max(STRETCH, 4 * limit)
    while True:
        part, lead = code[start : start + step], _lead(code, start)
        strengths = boundary_strengths(code[lead : start + step])[start - lead :]
        spans = _split_batch([part], np.array([limit]), np.array([overlap]), [strengths])[0] if len(part) > limit else [(0, len(part))]
        if start + len(part) == len(code):
            return out + [(start + a, start + b) for a, b in spans]
        spans = spans[:-2]  # the last ones saw the end of the stretch, not of the text
        out += [(start + a, start + b) for a, b in spans]
        start += spans[-1][1] - overlap


def split_spans(text: str | None, limit: int | None, overlap: int | None = 0) -> list[tuple[int, int]] | None:
    """Spans of one text; see :func:`split_oversized` for the special cases."""
    return _spans([text], [limit], [overlap])[0]


def _spans(texts, limits, overlaps) -> list[list[tuple[int, int]] | None]:
    out: list = [None] * len(texts)
    batch: list[int] = []
    codes: list[np.ndarray] = []
    settings: list[tuple[int, int]] = []
    held = 0

    def flush() -> None:
        nonlocal batch, codes, settings, held
        if batch:
            lim, ov = (np.array(x, dtype=np.int64) for x in zip(*settings))
            for i, spans in zip(batch, _split_batch(codes, lim, ov)):
                out[i] = spans
        batch, codes, settings, held = [], [], [], 0

    for i, (text, limit, overlap) in enumerate(zip(texts, limits, overlaps)):
        if text is None:
            continue
        n = len(text)
        if limit is None or limit != limit or limit < 1 or n <= limit:
            out[i] = [(0, n)]
            continue
        limit = int(limit)
        overlap = 0 if overlap is None or overlap != overlap else min(max(int(overlap), 0), limit - 1)
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if n > STRETCH:
            out[i] = _split_long(code, limit, overlap)
            continue
        if held + n > STRETCH:
            flush()
        batch.append(i)
        codes.append(code)
        settings.append((limit, overlap))
        held += n + 1
    flush()
    return out


def spans_column(text: Column, limit: Column, overlap: Column, with_text: bool = False) -> Column:
    """Spans of the pieces of ``text``, and with ``with_text`` the pieces themselves."""

    @F.pandas_udf(PIECES if with_text else SPANS)
    def spans(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for t, n, o in batches:
            found = _spans(t.tolist(), n.tolist(), o.tolist())
            if with_text:
                yield pd.Series([None if s is None else [{"start": a, "end": b, "text": x[a:b]} for a, b in s] for x, s in zip(t, found)], dtype=object)
            else:
                yield pd.Series([None if s is None else [{"start": a, "end": b} for a, b in s] for s in found], dtype=object)

    return spans(text, limit.cast("double"), overlap.cast("double"))


def split_oversized(df: DataFrame, text: str, limit: str, overlap: str | None = None, prefix: str = "piece", with_text: bool = True) -> DataFrame:
    """One row per piece of ``df[text]``, all input columns kept, with ``{prefix}_no`` (from 1), ``{prefix}_start``,
    ``{prefix}_chars``, ``{prefix}_count`` and ``{prefix}_text``.

    Each piece has at most ``limit`` code points and ends at the strongest boundary of its length window: paragraph, line,
    sentence or word end, and inside a word only if the whole window holds none of them (never before a combining mark if
    that can be avoided). Consecutive pieces share exactly ``overlap`` code points, so the text can be rebuilt from them.

    Null text: one row with null piece columns and count 0. Empty text: one empty piece. Null, zero or negative limit:
    the text stays whole. Null or negative overlap counts as 0; an overlap of the limit or more counts as limit - 1.
    Result columns stand in the place of input columns of the same name (letter case ignored), also where that is the text.

    Pieces are cut where the spans are found, so a caller that drops the text doesn't have it repeated for each piece;
    without ``with_text`` there are no piece texts either.
    """
    names = [f"{prefix}_{x}" for x in ("no", "start", "chars", "count", "text")]
    mark = "_"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    pieces = spans_column(F.col(f"`{text}`"), F.col(f"`{limit}`"), F.col(f"`{overlap}`") if overlap else F.lit(0), with_text)
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in names}]
    one = df.select(*kept, pieces.alias(mark))
    cut = one.select(*kept, F.coalesce(F.size(mark), F.lit(0)).alias(f"{mark}n"), F.posexplode_outer(mark).alias(f"{mark}i", f"{mark}s"))
    start, end = F.col(f"{mark}s.start"), F.col(f"{mark}s.end")
    found = [F.col(f"{mark}i") + 1, start, end - start, F.greatest(F.col(f"{mark}n"), F.lit(0)), *([F.col(f"{mark}s.text")] if with_text else [])]
    return cut.select(*kept, *(c.alias(n) for n, c in zip(names, found)))


def oversized(df: DataFrame, keys: list[str], text: str, limit: str, overlap: str) -> DataFrame:
    """Distinct ``keys`` of the rows that the splitter cuts into more than one piece."""
    spans = spans_column(F.col(text), F.col(limit), F.col(overlap))
    return df.select(*keys, F.size(spans).alias("__n")).filter("__n > 1").select(*keys).distinct()
