"""Column builders for text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode text processing strips it: built from the rule, not listed.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
# Words that hint at a caption.
CAPTION_WORDS = ("figure", "fig.", "fig", "그림", "표", "table", "chart", "도표")
# Signs that start a bullet.
BULLETS = ("-", "•", "·")
#: Circled numbers 1 to 20.
CIRCLED = "".join(chr(0x2460 + i) for i in range(20))
# Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def stripped(c: Column) -> Column:
    """Null counts as empty."""
    return strip(F.coalesce(c, F.lit("")))


def _lines(c: Column, joint: str) -> Column:
    return F.when(~F.contains(c, F.lit("\n")), c).otherwise(F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.rtrim(x, F.lit(WHITE))), joint))


def line_breaks_html(c: Column) -> Column:
    return _lines(c, "<br/>")


def line_breaks_markdown(c: Column) -> Column:
    return _lines(c, "  \n")


def tabs_shown(c: Column) -> Column:
    return F.replace(c, F.lit("\t"), F.lit(" · "))


def image_tag(src: Column, alt: Column, width: Column) -> Column:
    size = F.when(F.coalesce(width, F.lit(0)) > 0, F.concat(F.lit(' width="'), width.cast("string"), F.lit('"'))).otherwise("")
    return F.concat(F.lit('<img src="'), src, F.lit('" alt="'), alt, F.lit('"'), size, F.lit("/>"))


def images_to_html(c: Column, width: Column) -> Column:
    """Markdown images as tags, with a width where it is positive."""
    plain = F.regexp_replace(c, r"!\[([^\]]*)\]\(([^)]+)\)", '<img src="$2" alt="$1"/>')
    sized = F.regexp_replace(c, F.lit(r"!\[([^\]]*)\]\(([^)]+)\)"), F.concat(F.lit('<img src="$2" alt="$1" width="'), width.cast("string"), F.lit('"/>')))
    return F.when(F.coalesce(width, F.lit(0)) > 0, sized).otherwise(plain)


def display(text: Column, formatted: Column, preserve: bool) -> Column:
    """Formatted text where it is wanted and not blank, else the stripped text."""
    plain = stripped(text)
    return F.coalesce(F.nullif(strip(formatted), F.lit("")), plain) if preserve else plain


def has_caption_word(c: Column) -> Column:
    out = F.lit(False)
    for w in CAPTION_WORDS:
        out = out | F.contains(F.lower(c), F.lit(w))
    return out


def roman(n: Column) -> Column:
    """Upper-case roman numeral of a positive integer; empty for zero and below."""
    signs = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN))
    start = F.struct(F.greatest(n, F.lit(0)).cast("int").alias("left"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        times = F.floor(acc["left"] / x["v"]).cast("int")
        return F.struct((acc["left"] - times * x["v"]).alias("left"), F.concat(acc["out"], F.repeat(x["s"], times)).alias("out"))

    return F.aggregate(signs, start, step, lambda acc: acc["out"])


def letters(n: Column) -> Column:
    """a..z by number, starting again after z."""
    return F.char((F.lit(97) + F.pmod(n - 1, F.lit(26))).cast("int"))


def auto_number(kind: Column, n: Column) -> Column:
    """Prefix of an automatically numbered paragraph; unknown kinds count as arabic with a period."""
    num, low, big = n.cast("string"), letters(n), roman(n)
    circled = F.when((n >= 1) & (n <= 20), F.substring(F.lit(CIRCLED), n.cast("int"), F.lit(1)))
    sign = F.when(F.startswith(kind, F.lit("alphaLc")), low).when(F.startswith(kind, F.lit("alphaUc")), F.upper(low))
    sign = sign.when(F.startswith(kind, F.lit("romanLc")), F.lower(big)).when(F.startswith(kind, F.lit("romanUc")), big).otherwise(num)
    known = kind.isin(*(f"{a}{b}" for a in ("arabic", "alphaLc", "alphaUc", "romanLc", "romanUc") for b in ("Period", "ParenR")), "arabicPlain")
    end = F.when(F.endswith(kind, F.lit("ParenR")), ") ").when(kind == "arabicPlain", " ").otherwise(". ")
    return (
        F.when(F.contains(kind, F.lit("circleNum")), F.coalesce(F.concat(circled, F.lit(" ")), F.concat(F.lit("("), num, F.lit(") "))))
        .when(known, F.concat(sign, end))
        .otherwise(F.concat(num, F.lit(". ")))
    )
