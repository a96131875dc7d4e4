"""One consistent form for texts that look alike (problem 2).

The mapping is SQL run by DuckDB inside Arrow partitions: invisible characters go, compatibility forms of width, space,
hyphen and joined letters are mapped, look-alike letters of Latin, Cyrillic and Greek collapse, and the composed form is
taken. Raised, lowered and circled digits, letter case, accents and the number of spaces and line breaks stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.common import written

# Characters without a visible form of their own.
INVISIBLE = "­͏؜᠋᠌᠍᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩︀︁︂︃︄︅︆︇︈︉︊︋︌︍︎️﻿"
# Kinds of one space and of one hyphen.
SPACES = "\t               　"
HYPHENS = "‐‑‒−﹣－"
# Letters of one look, Latin first, then Cyrillic, then Greek ("." where there is none).
LOOKALIKES = (
    "AАΑ BВΒ CСϹ EЕΕ HНΗ IІΙ JЈͿ KКΚ MМΜ N.Ν OОΟ "
    "PРΡ SЅ. TТΤ XХΧ YҮΥ Z.Ζ aа. cсϲ dԁ. eе. hһ. iі. jјϳ oоο "
    "pр. qԛ. sѕ. wԝ. xх. yу. ËЁ. ëё. ÏЇΪ ïї. ÈЀ. èѐ. µ.μ"
).split()

# One step of decomposition: half-width Hangul letters become the letters of full width, not the jamo behind those.
_WIDTH = {chr(c): chr(int(unicodedata.decomposition(chr(c)).split()[1], 16)) for c in range(0xFF01, 0xFFEF) if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))}
_JOINED = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in [0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), 0x2025, 0x2026, 0x203C, *range(0x2160, 0x2180), *range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18)]}


#: Marks that letters of several scripts carry; composed letters of one look are derived from them by rule.
_MARKS = [chr(c) for c in range(0x300, 0x32A)]


def look_alikes() -> dict[str, str]:
    """Each Cyrillic or Greek letter that looks like a Latin one, and each composed letter of such a letter and a mark, with
    its Latin form (of more than one code point where no composed Latin letter exists)."""
    out = {x[k]: x[0] for x in LOOKALIKES for k in (1, 2) if x[k] != "."}
    for a, b in list(out.items()):
        for mark in _MARKS:
            if len(whole := unicodedata.normalize("NFC", a + mark)) == 1:
                out.setdefault(whole, unicodedata.normalize("NFC", b + mark))
    return out


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _translate(expr: str, pairs: dict[str, str]) -> str:
    return f"translate({expr}, {_quote(''.join(pairs))}, {_quote(''.join(pairs.values()))})"


def _script(word: str, place: int, letters: str) -> str:
    """A word that holds a letter only this script has is written in this script throughout."""
    back = {x[0]: x[place] for x in LOOKALIKES if x[place] != "." and x[0] != "µ"}
    for a, b in list(back.items()):
        for mark in _MARKS:
            whole, other = unicodedata.normalize("NFC", a + mark), unicodedata.normalize("NFC", b + mark)
            if len(whole) == len(other) == 1:
                back.setdefault(whole, other)
    return f"WHEN regexp_matches({word}, '[{letters}]') THEN {_translate(word, back)}"


def canonical_sql(column: str) -> str:
    """DuckDB expression for the consistent form of ``column``."""
    same = {a: b for a, b in {**_WIDTH, **_JOINED}.items() if len(b) == 1}
    same |= {c: " " for c in SPACES} | {c: "-" for c in HYPHENS} | {" ": "\n", " ": "\n", "\u0085": "\n"}
    longer = {a: b for a, b in {**_WIDTH, **_JOINED}.items() if len(b) > 1}
    expr = f"translate({column}, {_quote(INVISIBLE)}, '')"
    expr = _translate(expr, same)
    expr = f"replace({expr}, chr(13) || chr(10), chr(10))"
    spelled = expr
    for a, b in longer.items():
        spelled = f"replace({spelled}, {_quote(a)}, {_quote(b)})"
    expr = f"CASE WHEN regexp_matches({expr}, '[{''.join(longer)}]') THEN {spelled} ELSE {expr} END"
    alike = look_alikes()
    single, several = {a: b for a, b in alike.items() if len(b) == 1}, {a: b for a, b in alike.items() if len(b) > 1}
    expr = f"nfc_normalize({expr})"
    parted = expr
    for a, b in several.items():
        parted = f"replace({parted}, {_quote(a)}, {_quote(b)})"
    expr = f"CASE WHEN regexp_matches({expr}, '[{''.join(several)}]') THEN {parted} ELSE {expr} END"
    expr = f"nfc_normalize({_translate(expr, single)})"
    scripts = f"CASE {_script('w', 1, 'Ѐ-ӿ')} {_script('w', 2, 'α-ωΑ-Ωά-ώ')} ELSE w END"
    whole = f"array_to_string(list_transform(regexp_extract_all(s, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+'), lambda w: {scripts}), '')"
    return f"(SELECT CASE WHEN regexp_matches(s, '[Ѐ-ӿΆ-ώ]') THEN {whole} ELSE s END FROM (SELECT {expr} AS s))"


def _statement() -> str:
    return f"SELECT i, {canonical_sql('t')} AS c FROM texts ORDER BY i"


#: Texts of these characters alone are their own form: none of them is mapped, and none composes with another.
_PLAIN = "^[ -~\n¡-¬®-ıĴ-ſ가-힣₀-₉①-⑳]*$"


def canonical_array(texts: pa.Array, con) -> pa.Array:
    """Consistent forms of ``texts``; plain texts are their own form and take no SQL."""
    words = pc.dictionary_encode(texts)
    values = words.dictionary.cast(pa.string())
    plain = pc.match_substring_regex(values, _PLAIN)
    todo = pc.filter(values, pc.invert(plain))
    if not len(todo):
        return texts.cast(pa.string())
    con.register("texts", pa.table({"i": pa.array(range(len(todo)), pa.int64()), "t": todo}))
    done = con.sql(_STATEMENT).to_arrow_table().column("c").combine_chunks().cast(pa.string())
    con.unregister("texts")
    values = pc.replace_with_mask(values, pc.invert(plain), done)
    return pc.take(values, words.indices)


_STATEMENT = _statement()


def canonical_column(text: Column) -> Column:
    """The consistent form of a string column; null stays null and empty stays empty."""

    @F.arrow_udf("string")
    def canonical(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        for batch in batches:
            yield canonical_array(batch, con)

    return canonical(text)


def canonicalize(df: DataFrame, text: str, out: str = "canonical") -> DataFrame:
    """``df`` with the consistent form of ``text`` in ``out``, in the place of an input column of that name.

    Null stays null, empty stays empty; rows that come twice stay two rows.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() != out.lower()]
    return df.select(*kept, canonical_column(F.col(f"`{text}`")).alias(out))


def _hashed(df: DataFrame, scope: list[str], uid: str, text: str) -> tuple[DataFrame, list[str]]:
    """Texts that aren't blank as two hashes of their look and two of their stored form, written once; and the look's keys."""
    rows = df.filter(F.col(text).isNotNull()).select(*scope, F.col(uid).alias("__uid"), F.col(text).alias("__text"))
    rows = rows.withColumn("__c", canonical_column(F.col("__text"))).filter(F.length(F.regexp_replace("__c", r"[ \n\r]+", "")) > 0)
    form = F.struct(F.xxhash64("__text").alias("a"), F.xxhash64("__text", F.lit(1)).alias("b"))
    rows = rows.select(*scope, "__uid", F.xxhash64("__c").alias("__k1"), F.xxhash64("__c", F.lit(1)).alias("__k2"), form.alias("__form"))
    return written(rows, "looks"), [*scope, "__k1", "__k2"]


def _several_forms(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The distinct rows of looks that are stored in more than one form."""
    mixed = rows.groupBy(*keys).agg(F.min("__form").alias("__a"), F.max("__form").alias("__b")).filter("__a <> __b").select(*keys)
    return written(rows.join(mixed, keys, "left_semi").distinct(), "looks-of-several-forms")


def alike_pairs(df: DataFrame, scope: list[str], uid: str, text: str) -> DataFrame:
    """Pairs ``uid_a < uid_b`` within one ``scope`` whose texts look the same and are stored differently.

    Null, empty and blank texts (only spaces, line breaks and invisible characters) are in no pair. Rows that come twice
    count once. Looks stored in one form only, however often, drop out first; the others meet by pairs of stored forms, so
    every pair that a join makes is a result. :func:`alike_classes` gives the same links without writing out pairs. Texts
    are compared by two independent 64-bit hashes each. A null in ``scope`` or ``uid`` is in no pair.
    """
    rows, keys = _hashed(df, scope, uid, text)
    live = _several_forms(rows, keys)
    forms = live.select(*keys, "__form").distinct()
    met = forms.withColumnRenamed("__form", "__fa").join(forms.withColumnRenamed("__form", "__fb"), keys).filter("__fa < __fb")
    a, b = live.withColumnsRenamed({"__form": "__fa", "__uid": "__x"}), live.withColumnsRenamed({"__form": "__fb", "__uid": "__y"})
    pairs = a.join(met, [*keys, "__fa"]).join(b, [*keys, "__fb"]).filter("__x <> __y")
    return pairs.select(*scope, F.least("__x", "__y").alias("uid_a"), F.greatest("__x", "__y").alias("uid_b")).distinct()


def alike_classes(df: DataFrame, scope: list[str], uid: str, text: str) -> DataFrame:
    """One row per member of a look that ``scope`` stores in several forms: scope, ``uid``, ``class_uid`` (the least uid of
    that look), ``forms`` (its stored forms) and ``links`` (members stored in another form).

    Nulls, blanks and rows that come twice as for :func:`alike_pairs`. A uid with several texts is a member of each of
    their classes, once per stored form. Counts are pre-aggregated per stored form, so a class of any size costs one row per form.
    """
    rows, keys = _hashed(df, scope, uid, text)
    live = _several_forms(rows, keys)
    per = live.groupBy(*keys, "__form").agg(F.count(F.lit(1)).alias("__n"), F.min("__uid").alias("__least"))
    whole = per.groupBy(*keys).agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("forms"), F.min("__least").alias("class_uid"))
    out = live.join(per.select(*keys, "__form", "__n"), [*keys, "__form"]).join(whole, keys)
    return out.select(*scope, F.col("__uid").alias(uid), "class_uid", "forms", (F.col("__all") - F.col("__n")).alias("links"))
