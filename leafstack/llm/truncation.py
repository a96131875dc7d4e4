"""Text cut off by field limits (problem 8).

A vocabulary trie of the corpus tells whether the last token of a text is an unknown proper prefix of known words. Length
evidence joins it: a source whose lengths pile up at one value, in code points or in bytes, has a limit there. Where the
last token is a whole word the trie can't tell, so statistics over all sentences say how often one ends at such a place.
"""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafstack.common import maybe_broadcast, written

#: A word is known from this many occurrences before a text's end; it also counts as a fragment where words that
#: begin with it are so many times as frequent.
KNOWN, FRAGMENT = 2, 50
#: Chance that a sentence ends like this text, below which the text is cut: away from and at its source's limit.
FAR, NEAR = 0.03, 0.5
#: A last word that ends so small a share of its (at least so many) occurrences doesn't end a sentence.
NEVER, OFTEN = 0.01, 30
#: Lengths pile up where so many texts, and so many times the usual number around, have one length. A cut at word ends
#: and a sign of omission spread the lengths over a few code points.
PILE, TIMES, SPREAD = 6, 6.0, 8
#: A closing formula (greeting, "edit: solved") is at most so many words and ends so large a share of texts.
CLOSER_WORDS, CLOSER_SHARE, CLOSER_LEAST = 4, 0.001, 5
#: Lengths that a pile is compared with lie so far around it: the widest that is no more than half of its length.
REACHES = (12, 25, 50, 100)
#: Bits of the filter for each context that a text ends with, and the most bits it may have (as a power of two: 8 MB). More
#: contexts than that allows are counted without a filter, with the same result.
BITS_PER_CONTEXT, MOST_BITS = 16, 26
#: Characters that are counted at once, and words a task remembers.
SLICE, REMEMBERED = 2_000_000, 1_000_000

# Tags that stand inside a sentence.
_INLINE = "b i u s em strong color size font span a code small big sub sup tt"
_TAG = re.compile(r"</?([a-zA-Z]+)[^<>]*>|\[/?([a-zA-Z*]{1,12})(?:=[^\[\]]*)?\]")
_ENTITY = re.compile(r"&(?:#\w{1,7}|[a-zA-Z]\w{1,30});")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.[a-z]{2,10}/\S*")
_STOPS, _WORDS = r"[.!?…]+(?=[\s\"')\]»”]|$)|[\n|]", r"[^\W_]+(?:['’][^\W_]+)*"
_STOP, _WORD, _TOKEN = (re.compile(x) for x in (_STOPS, _WORDS, f"{_WORDS}|{_STOPS}"))
_SIGN = re.compile(r"(?:\.\.\.|…|�)$")
_OPEN_TAG = re.compile(r"<(?:/?[a-zA-Z][^<>]*)?$")
_OPEN_BB = re.compile(r"\[/?[a-zA-Z]*(?:=[^\[\]]*)?$")
_OPEN_ENTITY = re.compile(r"&(#\w{0,7}|[a-z]{0,8})$")
_ENDED = re.compile(r"[.!?][\"'’”)»\]*_~]*$")
_SMILEY = re.compile(r"(?:[:;=8][-o^']?[()\[\]DPp/|]|^:\w+:|<3|\^\^|xD)$")
_ENDS_IN_LINK = re.compile(f"(?:{_LINK.pattern})$")
_SIGNATURE = re.compile(r"(?:^|\n)(?:--|_{3,}|={3,})[ \t]*\n[ \t]*(\S+)[ \t]*$|(?:^|\s)[-–—~]{1,2}[ \t]*(\S+)$")
_NAMES = sorted(n.rstrip(";") for n in html.entities.html5 if n.islower())

_INLINE_SET = frozenset(_INLINE.split())


def _plain(text: str) -> str:
    if "<" in text or "[" in text:
        text = _TAG.sub(lambda m: "" if (m[1] or m[2]).lower() in _INLINE_SET else "\n", text)
    if "/" in text:
        text = _LINK.sub(" ", text)
    return _ENTITY.sub(" ", text) if "&" in text else text


#: Weight, in observations, of the estimate from the context before.
_WEIGHTS = (4, 2, 2, 4, 1)
#: Words of which each context consists, of a sentence that ends with "c b a" and begins with "first second"; the last two
#: contexts also know its length.
_CONTEXTS = (("a",), ("b", "a"), ("c", "b", "a"), ("first", "n"), ("first", "second", "n"))


def _contexts(parts: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Hashes of what is known of an end: from the plain last word to the way the sentence opens and its length."""
    out = []
    for k, names in enumerate(_CONTEXTS, 1):
        h = np.full(len(parts["a"]), k * 0x9E3779B97F4A7C15 % 2**64, dtype=np.uint64)
        for name in names:
            h = (h ^ parts[name]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        out.append(h ^ (h >> np.uint64(29)))
    return out


class Vocabulary:
    """Numbers for words, from 1, and their hashes; 0 is the end of a sentence, and numbers are one word."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.words, self.hashes = [""], [0]

    def add(self, token: str) -> int:
        from xxhash import xxh3_64_intdigest

        if not token[0].isalnum():
            k = 0
        elif token.isdigit() and token != "0":
            k = self.ids.get("0") or self.add("0")
        else:
            k = len(self.words)
            self.words.append(token)
            self.hashes.append(xxh3_64_intdigest(token) | 1)  # never the hash of no word
        self.ids[token] = k
        return k

    def numbers(self, tokens: list[str]) -> np.ndarray:
        get, add = self.ids.get, self.add
        return np.array([k if (k := get(t)) is not None else add(t) for t in tokens], dtype=np.int64)


def _ends(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """For every word of the sentences in ``ids``: its place, what is known if the sentence ended there, and whether it does."""
    stop = ids == 0
    at = np.flatnonzero(~stop)
    place = np.arange(len(ids))
    i = (place - np.maximum.accumulate(np.where(stop, place, -1)))[at]  # words of the sentence so far
    h = hashes[ids]
    none = np.uint64(0)
    parts = {
        "a": h[at], "b": np.where(i > 1, h[at - 1], none), "c": np.where(i > 2, h[at - 2], none), "first": h[at - i + 1],
        "second": np.where(i > 1, h[np.minimum(at - i + 2, len(ids) - 1)], none), "n": np.minimum(i, 40).astype(np.uint64),
    }
    return at, parts, stop[np.minimum(at + 1, len(ids) - 1)]


def tail(text: str, author: str | None) -> dict:
    """What the end of one text shows by itself.

    state: "cut" inside a tag, entity or character; "done" where it ends properly; "ask" where the corpus has to tell.
    """
    r = text.rstrip()
    none = {"state": "done", "sign": False, "token": None, "suffixes": [], "whole": None, "words": None}
    found = _SIGN.search(r)
    body = r[: found.start()].rstrip() if found else r
    if found and found[0] == "�":
        return none | {"state": "cut", "sign": True}
    # Only the last bracket can be open; what follows it may have any length.
    tag, code = body.rfind("<"), body.rfind("[")
    if (tag >= 0 and _OPEN_TAG.match(body, tag) and not body.endswith(("<<", "<3"))) or (code >= 0 and _OPEN_BB.match(body, code)):
        return none | {"state": "cut"}
    if (sign := body.rfind("&")) >= 0 and (m := _OPEN_ENTITY.match(body, sign)) and not body[:sign].endswith(" ") and (not m[1] or m[1][0] == "#" or any(x.startswith(m[1]) for x in _NAMES)):
        return none | {"state": "cut"}
    plain = _plain(body).rstrip()
    if not plain:
        return none
    token = body.split()[-1] if len(body) < 400 else body[max(body.rfind(c) for c in " \n\t\r\x0b\x0c\u00a0") + 1 :]
    if (not found and _ENDED.search(plain[-400:] if plain[-400:-399].isalnum() else plain)) or _SMILEY.search(token) or _ENDS_IN_LINK.search(token):
        return none
    # A signature is in the last two lines.
    if m := _SIGNATURE.search(plain, plain.rfind("\n", 0, max(plain.rfind("\n"), 0)) + 1):
        name = (m[1] or m[2]).lower()
        # A name signs the post, unless the author's own name goes on.
        if not (author and author.lower() != name and author.lower().startswith(name)):
            return none
        return none | {"state": "ask", "token": name, "sign": bool(found)}
    parts = _STOP.split(plain)
    if not (w := ["0" if x.isdigit() else x for x in _WORD.findall(parts[-1].lower())]) or not (plain[-1].isalnum() or plain[-1] in "*_\"')],;:-–/&~"):
        return none
    if re.search(r"[*]{2,}$", plain):
        return none
    return {
        "state": "ask",
        "sign": bool(found),
        "token": w[-1],
        "suffixes": [" ".join(w[-k:]) for k in range(1, min(len(w), CLOSER_WORDS) + 1)],
        "whole": " ".join(w) if len(w) <= CLOSER_WORDS else None,
        "words": w,
    }


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_64_intdigest

    for batch in batches:
        ids, sources, texts, authors = (batch.column(i).to_pylist() for i in range(4))
        rows = [tail(t, a) for t, a in zip(texts, authors)]
        encoded = [t.encode("utf-8", "replace") for t in texts]
        words = Vocabulary()
        asked = [k for k, r in enumerate(rows) if r["words"]]
        flat = words.numbers([t for k in asked for t in (*rows[k]["words"], "\n")])
        _, parts, last = _ends(flat, np.array(words.hashes, dtype=np.uint64))
        ctx = np.zeros((5, len(rows)), dtype=np.int64)  # 0 where the corpus isn't asked
        ctx[:, asked] = [h[last].view(np.int64) for h in _contexts(parts)]
        yield pa.record_batch(
            [
                batch.column(0),
                pa.array(sources, pa.string()),
                pa.array([len(t) for t in texts], pa.int32()),
                pa.array([len(x) for x in encoded], pa.int32()),
                pa.array(np.array([xxh3_64_intdigest(x) for x in encoded], dtype=np.uint64).view(np.int64)),
                pa.array([r["state"] for r in rows], pa.string()),
                pa.array([r["sign"] for r in rows], pa.bool_()),
                pa.array([r["token"] for r in rows], pa.string()),
                pa.array([r["suffixes"] for r in rows], pa.list_(pa.string())),
                pa.array([r["whole"] for r in rows], pa.string()),
                *(pa.array(c) for c in ctx),
            ],
            names=["id", "source", "chars", "bytes", "digest", "state", "sign", "token", "suffixes", "whole", *(f"c{k}" for k in range(1, 6))],
        )


def _counts(handle):
    """Occurrences of words and contexts; only contexts that some text may end with by the filter are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, words = None if handle is None else handle.value, Vocabulary()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            cuts = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // SLICE)) + 1
            for first, end in zip(np.r_[0, cuts], np.r_[cuts, len(texts)]):
                yield _counted(texts[first:end], words, bitmap)
                if len(words.words) > REMEMBERED:
                    words = Vocabulary()

    return run


def _counted(texts: list[str], words: Vocabulary, bitmap: np.ndarray | None) -> pa.RecordBatch:
    tokens, closing = [], []
    for text in texts:
        tokens += _TOKEN.findall(_plain(text.rstrip()).lower())
        tokens.append("\n")
        closing.append(len(tokens))
    ids = words.numbers(tokens)
    at, parts, ended = _ends(ids, np.array(words.hashes, dtype=np.uint64))
    # A text's last word may be a fragment and makes no word known.
    n = np.bincount(ids[at], minlength=len(words.words))
    if len(at):
        before = np.searchsorted(at, closing) - 1
        last = at[before[(before >= 0) & (at[before] >= np.r_[0, closing[:-1]])]]
        n -= np.bincount(ids[last], minlength=len(words.words))
    seen, n_seen, n_ends = [], [], []
    for h in _contexts(parts):
        held = ended
        if bitmap is not None:
            bit = h >> np.uint64(58 - (len(bitmap).bit_length() - 1))
            asked = ((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
            h, held = h[asked], ended[asked]
        values, where = np.unique(h, return_inverse=True)
        seen.append(values.view(np.int64))
        n_seen.append(np.bincount(where, minlength=len(values)))
        n_ends.append(np.bincount(where, weights=held, minlength=len(values)).astype(np.int64))
    known = np.flatnonzero(n)
    seen, n_seen, n_ends = (np.concatenate(x) for x in (seen, n_seen, n_ends))
    return pa.record_batch(
        [
            pa.concat_arrays([pa.nulls(len(seen), pa.string()), pa.array([words.words[k] for k in known], pa.string())]),
            pa.concat_arrays([pa.array(seen, pa.int64()), pa.nulls(len(known), pa.int64())]),
            pa.array(np.r_[n_seen, n[known]], pa.int64()),
            pa.array(np.r_[n_ends, np.zeros(len(known), np.int64)], pa.int64()),
        ],
        names=["word", "context", "n", "ends"],
    )


def _filter_bits(tails: DataFrame) -> np.ndarray | None:
    """Bitmap of the contexts that texts end with, sized by their number; None where they are too many for one.

    What reaches the driver is at most 2^MOST_BITS bits, put together where the contexts arise.
    """
    hashes = tails.select(F.explode(F.array(*(f"c{k}" for k in range(1, 6)))).alias("h"))
    bits = max(10, (int(hashes.agg(F.approx_count_distinct("h")).first()[0]) * BITS_PER_CONTEXT).bit_length())
    if bits > MOST_BITS:
        return None
    place = f"shiftrightunsigned(h, {64 - bits})"
    parts = hashes.groupBy(F.expr(f"{place} div 64").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} % 64 AS int))")).alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), dtype=np.uint64)
    out[parts["w"].to_numpy(np.int64)] = parts["v"].to_numpy(np.int64).view(np.uint64)
    return out


def text_lengths(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """(source, chars, bytes, digest) of the texts of known sources: what :func:`source_limits` reads."""
    rows = docs.filter(F.col(source).isNotNull() & F.col(text).isNotNull())
    return rows.select(F.col(source).alias("source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("digest"))


def source_limits(tails: DataFrame) -> DataFrame:
    """(source, unit, length, top): lengths where a source's texts pile up; ``top`` where nothing longer exists and the pile
    spreads over a few lengths below. Copies of one text count once, so a text posted often makes no pile. Lengths of less than
    twice the least reach have no room for a comparison."""
    texts = tails.select("source", "chars", "bytes", "digest").distinct()
    lengths = texts.select("source", F.expr("stack(2, 'chars', chars, 'bytes', bytes) AS (unit, length)")).groupBy("source", "unit", "length").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("source", "unit").orderBy("length")
    sums = lambda a, b: F.coalesce(F.sum("n").over(w.rangeBetween(a, b)), F.lit(0))
    # Texts per length around and below a length, over the widest reach that it allows.
    around = F.coalesce(*(F.when(F.col("length") >= 2 * r, F.greatest(sums(-r, -1), sums(1, r)) / r) for r in reversed(REACHES)))
    below = F.coalesce(*(F.when(F.col("length") >= 2 * r, sums(-r - SPREAD, -SPREAD) / r) for r in reversed(REACHES)))
    spread = lengths.select("source", "unit", "length", "n", around.alias("around"), below.alias("below"), F.sum("n").over(w.rangeBetween(1 - SPREAD, 0)).alias("near"), F.max("length").over(Window.partitionBy("source", "unit")).alias("longest"))
    sharp = (F.col("n") >= PILE) & (F.col("n") >= TIMES * (F.col("around") + 0.5))
    top = (F.col("length") == F.col("longest")) & (F.col("near") >= PILE) & (F.col("near") >= TIMES * (F.col("below") * SPREAD + 0.5))
    return spread.filter(F.col("around").isNotNull() & (sharp | top)).select("source", "unit", "length", top.alias("top"))


def vocabulary_trie(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Nodes of the trie over (word, n) that occur in ``tokens`` (token): prefix, ``own`` occurrences of it as a word and
    ``longer`` of words beyond it.

    Words are cut only at lengths that some token has, so long words cost no row per letter.
    """
    tokens = tokens.filter("token IS NOT NULL").select(F.col("token").alias("node")).distinct()
    lengths = tokens.agg(F.collect_set(F.length("node")).alias("lengths"))
    known = words.filter(F.col("n") >= KNOWN).crossJoin(F.broadcast(lengths))  # lengths is one row
    paths = known.select("word", "n", F.explode(F.filter("lengths", lambda k: k <= F.length("word"))).alias("k"))
    paths = paths.select("word", "n", "k", F.expr("substring(word, 1, k)").alias("node")).join(maybe_broadcast(tokens), "node", "left_semi")
    return paths.groupBy("node").agg(
        F.sum(F.when(F.length("word") == F.col("k"), F.col("n")).otherwise(0)).alias("own"), F.sum(F.when(F.length("word") > F.col("k"), F.col("n")).otherwise(0)).alias("longer")
    )


def _within(unit: str):
    return lambda x: F.col("sign") & (F.col(unit) <= x) & (F.col(unit) > x - SPREAD)


def truncation_flags(docs: DataFrame, doc_key: str = "doc_id", source: str = "source", text: str = "text", author: str | None = "author") -> DataFrame:
    """One row per document: key, source, ``at_limit``, ``truncated`` and ``reason`` (tag, word, name, sentence or sign).

    Cut are texts that stop inside a tag, entity or character; whose last token is a fragment by the vocabulary trie, or in a
    signature a part of the author's name; whose last sentence goes on by the corpus' statistics; or that stop at their
    source's limit with a sign of omission. Complete are texts with a proper end, a link, a smiley, a signature or a closing
    formula, also where they just fill the limit.

    Null and empty texts are never truncated and are listed as such; rows that come twice count once; a null source has no
    limit, but its texts are judged all the same. Without an author column signatures are taken as they stand. Rows of a null
    key are one document, judged without the sentence statistics. Other columns aren't read.
    """
    spark = docs.sparkSession
    name = F.col(author) if author else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_key).alias("id"), F.col(source).alias("source"), F.coalesce(F.col(text), F.lit("")).alias("text"), name.alias("author"))
    kind = rows.schema["id"].dataType.simpleString()
    ends = ", ".join(f"c{k} long" for k in range(1, 6))
    raw = rows.mapInArrow(_tails, f"id {kind}, source string, chars int, bytes int, digest long, state string, sign boolean, token string, suffixes array<string>, whole string, {ends}")
    columns = raw.columns
    tails = written(raw.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")), "tails")
    limits = written(source_limits(tails.filter("source IS NOT NULL")), "limits").filter("source IS NOT NULL")
    by_source = limits.groupBy("source").agg(*(F.collect_set(F.when((F.col("unit") == u) & (F.lit(True) if not t else F.col("top")), F.col("length"))).alias(f"{u}_{t}") for u in ("chars", "bytes") for t in (0, 1)))
    at = F.lit(False)
    for u in ("chars", "bytes"):
        at = at | F.array_contains(f"{u}_0", F.col(u)) | F.coalesce(F.exists(f"{u}_1", _within(u)), F.lit(False))
    placed = tails.join(maybe_broadcast(by_source), "source", "left").withColumn("at_limit", F.coalesce(at, F.lit(False)))
    asked = placed.filter("state = 'ask'")

    bits = _filter_bits(asked)
    handle = None if bits is None else spark.sparkContext.broadcast(bits)
    counts = rows.filter("text <> ''").select("text").mapInArrow(_counts(handle), "word string, context long, n long, ends long")
    counts = written(counts.groupBy("word", "context").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")), "counts")
    contexts = counts.filter("context IS NOT NULL").select("context", "n", "ends")
    trie = vocabulary_trie(counts.filter("word IS NOT NULL").select("word", "n"), asked.select("token"))

    # Closing formulas: short last sentences that many texts have and that seldom go on; at a limit they may be fragments.
    total = tails.agg(F.greatest(F.lit(CLOSER_LEAST), F.count(F.lit(1)) * F.lit(CLOSER_SHARE)).alias("least"))
    closers = asked.filter("whole IS NOT NULL AND NOT sign AND NOT at_limit").groupBy("whole", F.col("c5").alias("context")).agg(F.sum("copies").alias("times"))
    closers = closers.join(contexts, "context").crossJoin(F.broadcast(total)).filter("times >= least AND ends >= 0.5 * n").select(F.col("whole").alias("suffix"))  # total is one row
    closed = asked.select("id", F.explode("suffixes").alias("suffix")).join(maybe_broadcast(closers), "suffix", "left_semi").select("id").distinct()

    # Frequencies of the five contexts of each tail: one shuffle of the contexts, one to bring them together again.
    pairs = asked.select("id", "copies", F.posexplode(F.array(*(f"c{k}" for k in range(1, 6)))).alias("k", "context")).join(contexts, "context", "left")
    own = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) - F.col("copies"), F.lit(0))  # noqa: E731  a text is no witness for itself
    per = pairs.groupBy("id").agg(*(F.max(F.when(F.col("k") == k, own(c))).alias(f"{c}{k + 1}") for k in range(5) for c in ("n", "ends")))
    chance = F.lit(0.07)
    for k, weight in enumerate(_WEIGHTS, 1):
        chance = (F.col(f"ends{k}") + F.lit(float(weight)) * chance) / (F.col(f"n{k}") + F.lit(float(weight)))
    per = per.select("id", chance.alias("chance"), "n1", "ends1")

    # Only texts that need the corpus take part in the joins, so ends without a token don't gather in one task.
    both = (
        asked.select("id", "source", "sign", "token", "at_limit", (F.size("suffixes") == 0).alias("named"))
        .join(trie.withColumnRenamed("node", "token"), "token", "left")
        .join(per, "id", "left")
        .join(closed.withColumn("closed", F.lit(True)), "id", "left")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    fragment = (zero("longer") > 0) & ((zero("own") < KNOWN) | (zero("own") * FRAGMENT < zero("longer")))
    never = (zero("ends1") < F.lit(NEVER) * zero("n1")) & (zero("n1") >= OFTEN)
    rarely = (zero("ends1") < F.lit(5 * NEVER) * zero("n1")) & (zero("n1") >= CLOSER_LEAST)
    reason = (
        F.when(F.col("closed"), None)
        .when(F.col("named"), "name")
        .when(fragment, "word")
        .when(F.col("at_limit") & F.col("sign"), "sign")
        .when(F.col("at_limit") & ((F.col("chance") < NEAR) | rarely), "sentence")
        .when(never | (~F.col("sign") & (F.col("chance") < FAR)), "sentence")
    )
    plain = placed.filter("state <> 'ask'").select("id", "source", "at_limit", F.when(F.col("state") == "cut", "tag").alias("reason"))
    flagged = both.select("id", "source", "at_limit", reason.alias("reason")).unionByName(plain).withColumnsRenamed({"id": doc_key, "source": source})
    one = flagged.groupBy(doc_key, source).agg(F.max("at_limit").alias("at_limit"), F.max("reason").alias("reason"))
    return one.select(doc_key, source, "at_limit", F.col("reason").isNotNull().alias("truncated"), "reason")


def truncation_rates(flags: DataFrame, source: str = "source") -> DataFrame:
    """Per source: documents, truncated ones, their share, and those truncated at the source's limit."""
    cut = F.col("truncated").cast("long")
    return flags.groupBy(source).agg(
        F.count(F.lit(1)).alias("documents"), F.sum(cut).alias("truncated"), F.avg(cut).alias("share"), F.sum(F.when(F.col("truncated") & F.col("at_limit"), 1).otherwise(0)).alias("at_limit")
    )
