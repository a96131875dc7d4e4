"""Tables as text: pipe tables, HTML with merged cells, nested HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafstack.functions import scoring
from leafstack.functions import text as tx
from leafstack.schema import KEY


#: Elements that a cell has taken in, by (y, x).
ABSORBED = "array<struct<y:double,x:double,ordinal:int,content:string,width:int,element_id:string,type:string,containment:double>>"


def usable(cells: DataFrame) -> DataFrame:
    return cells.filter("NOT coalesce(is_spanned, false)")


def cell_content(use_formatting: bool, absorbed: bool = False) -> Column:
    """Content of a cell: its text, with absorbed items above the cell's middle before it and the others after it.

    Needs text, formatted_text, and with ``absorbed`` also cy, ch and absorbed_elements (sorted here by y, x).
    """
    plain = tx.line_breaks_html(tx.stripped(F.col("text")))
    base = F.coalesce(tx.line_breaks_html(F.nullif(tx.strip(F.col("formatted_text")), F.lit(""))), plain) if use_formatting else plain
    if not absorbed:
        return base
    items = F.filter(F.coalesce("absorbed_elements", F.array().cast(ABSORBED)), lambda i: tx.stripped(i["content"]) != "")
    middle = F.col("cy") + F.col("ch") / 2
    shown = lambda part: F.transform(part, lambda i: tx.images_to_html(tx.line_breaks_html(tx.strip(i["content"])), i["width"]))
    above = lambda i: F.coalesce(i["y"] < middle, F.lit(False))
    before, after = shown(F.filter(items, above)), shown(F.filter(items, lambda i: ~above(i)))
    return F.array_join(F.concat(before, F.when(base != "", F.array(base)).otherwise(F.array().cast("array<string>")), after), "<br/>")


def header_rows(cells: DataFrame) -> DataFrame:
    """Per table: ``header_rows``, the number of leading rows that form the header (0 for none).

    The first row is a header if it scores at least 0.45; its tallest cell may take further rows in. Needs ``content``.
    """
    spans = lambda c: F.coalesce(c, F.lit(1))
    short = (F.col("content") != "") & (F.length("content") <= 30) & ~F.contains("content", F.lit("\n"))
    first = F.col("row_idx") == 0
    per = cells.groupBy(*KEY).agg(
        F.max("row_idx").alias("max_row"), F.sum(first.cast("int")).alias("n"), F.sum((first & short).cast("int")).alias("short"),
        F.max(first & ((spans("span_width") > 1) | (spans("span_height") > 1))).alias("spanned"), F.max(F.when(first, spans("span_height"))).alias("tallest"),
    )
    is_header = (F.col("n") > 0) & (scoring.header_score(F.col("spanned"), F.col("short"), F.col("n")) >= 0.45)
    return per.select(*KEY, "max_row", F.when(is_header, F.greatest(F.lit(1), F.least("tallest", F.col("max_row") + 1))).otherwise(0).alias("header_rows"))


def _rows(cells: DataFrame, tag: Column | None = None) -> DataFrame:
    """One row per table row: its HTML with cells by column."""
    span = lambda n, c: F.when(F.coalesce(c, F.lit(1)) > 1, F.concat(F.lit(f' {n}="'), F.col(c).cast("string"), F.lit('"'))).otherwise("")
    name = F.lit("td") if tag is None else tag
    html = F.concat(F.lit("<"), name, span("colspan", "span_width"), span("rowspan", "span_height"), F.lit(">"), F.col("content"), F.lit("</"), name, F.lit(">"))
    got = cells.groupBy(*KEY, "row_idx").agg(F.sort_array(F.collect_list(F.struct("col_idx", "cell_idx", html.alias("h")))).alias("c"))
    return got.select(*KEY, "row_idx", F.concat(F.lit("<tr>"), F.array_join(F.transform("c", lambda x: x["h"]), ""), F.lit("</tr>")).alias("row"))


def _filled(rows: Column, start: Column, end: Column) -> Column:
    """HTML of table rows start..end - 1 from an array of (row_idx, row) of that range, by row; missing rows are empty ones.

    Each row is preceded by the empty rows since the one before it, so the work is linear in the result.
    """
    empty = lambda n: F.array_repeat(F.lit("<tr></tr>"), F.greatest(n, F.lit(0)).cast("int"))
    before = lambda i: F.when(i == 0, start - 1).otherwise(F.get(rows, i - 1)["row_idx"])
    shown = F.flatten(F.transform(rows, lambda x, i: F.concat(empty(x["row_idx"] - before(i) - 1), F.array(x["row"]))))
    last = F.coalesce(F.get(rows, F.size(rows) - 1)["row_idx"], start - 1)
    return F.concat(shown, empty(end - 1 - last))


def column_percentages(widths: Column) -> Column:
    """Shares of the columns in percent; null where the widths don't add up to something positive."""
    total = F.aggregate(widths, F.lit(0.0), lambda a, w: a + w)
    return F.when(total > 0, F.transform(widths, lambda w: w / total * 100))


def html_tables(cells: DataFrame, use_formatting: bool = True, absorbed: bool = False, widths: DataFrame | None = None) -> DataFrame:
    """KEY and ``html`` of each table with usable cells: column widths, header and body; nothing is escaped.

    ``widths``: KEY and ``col_widths`` (array<double>) of tables that have them.
    """
    shown = usable(cells).withColumn("content", cell_content(use_formatting, absorbed))
    head = header_rows(usable(cells).withColumn("content", cell_content(False, absorbed)))
    tagged = shown.join(head, KEY)
    rows = _rows(tagged, F.when(F.col("row_idx") < F.col("header_rows"), "th").otherwise("td")).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("row_idx", "row"))).alias("rows"))
    both = rows.join(head, KEY)
    top, end = F.col("header_rows"), F.col("max_row") + 1
    none = F.array().cast("array<string>")
    cols = none
    if widths is not None:
        both = both.join(widths, KEY, "left")
        pct = column_percentages(F.col("col_widths"))
        cols = F.when(pct.isNotNull() & (F.size(pct) > 0), F.concat(F.array(F.lit("<colgroup>")), F.transform(pct, lambda p: F.format_string('<col style="width:%.1f%%"/>', p)), F.array(F.lit("</colgroup>")))).otherwise(none)
    # Both parts as columns of their own, so that neither is worked out again for every row.
    both = both.withColumn("__head", F.filter("rows", lambda x: x["row_idx"] < top)).withColumn("__body", F.filter("rows", lambda x: x["row_idx"] >= top))
    header = F.when(top > 0, F.concat(F.array(F.lit("<thead>")), _filled(F.col("__head"), F.lit(0), top), F.array(F.lit("</thead>")))).otherwise(none)
    body = F.concat(F.array(F.lit("<tbody>")), _filled(F.col("__body"), top, end), F.array(F.lit("</tbody>")))
    return both.select(*KEY, F.array_join(F.concat(F.array(F.lit("<table>")), cols, header, body, F.array(F.lit("</table>"))), "\n").alias("html"))


def nested_html(cells: DataFrame) -> DataFrame:
    """KEY and ``html`` of tables inside a cell: all rows plain, no header."""
    shown = usable(cells).withColumn("content", tx.stripped(F.col("text")))
    rows = _rows(shown).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("row_idx", "row"))).alias("rows"), (F.max("row_idx") + 1).alias("n"))
    return rows.select(*KEY, F.array_join(F.concat(F.array(F.lit("<table>")), _filled(F.col("rows"), F.lit(0), F.col("n")), F.array(F.lit("</table>"))), "\n").alias("html"))


def pipe_tables(cells: DataFrame) -> DataFrame:
    """KEY and ``markdown`` of each table as a pipe table; of two cells in one place the later shows.

    The cells of a table are sorted once, and each writes what lies between the one before it and itself, so the work is
    linear in cells and shown places.
    """
    item = F.struct("row_idx", "col_idx", "cell_idx", tx.stripped(F.col("text")).alias("t"))
    got = usable(cells).groupBy(*KEY).agg(F.sort_array(F.collect_list(item)).alias("all"), F.max("col_idx").alias("cols"))
    follows = lambda i: F.get("all", i + 1)
    last = lambda x, i: ~F.coalesce((follows(i)["row_idx"] == x["row_idx"]) & (follows(i)["col_idx"] == x["col_idx"]), F.lit(False))
    got = got.withColumn("cells", F.filter("all", last))
    bar = lambda n: F.repeat(F.lit(" | "), n.cast("int"))
    cols = F.col("cols")
    blank = F.concat(F.lit("| "), bar(cols), F.lit(" |\n"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), cols + 1), " | "), F.lit(" |\n"))

    def shown(x: Column, i: Column) -> Column:
        prev = F.get("cells", i - 1)
        row, col = F.coalesce(prev["row_idx"], F.lit(-1)), F.coalesce(prev["col_idx"], F.lit(0))
        gap = x["row_idx"] - row - 1  # whole rows without a cell
        done = F.when(i > 0, F.concat(bar(cols - col), F.lit(" |\n"))).otherwise("")
        # The rule stands below the first row, which is an empty one where the first cell lies deeper.
        above = F.when((row == 0) & (i > 0), F.concat(rule, F.repeat(blank, gap))).when(gap > 0, F.when(row < 0, F.concat(blank, rule, F.repeat(blank, gap - 1))).otherwise(F.repeat(blank, gap))).otherwise("")
        fresh = F.concat(done, above, F.lit("| "), bar(x["col_idx"]))
        return F.concat(F.when((i > 0) & (x["row_idx"] == row), bar(x["col_idx"] - col)).otherwise(fresh), x["t"])

    end = F.get("cells", F.size("cells") - 1)
    tail = F.concat(bar(cols - end["col_idx"]), F.lit(" |"), F.when(end["row_idx"] == 0, F.concat(F.lit("\n"), F.rtrim(rule, F.lit("\n")))).otherwise(""))
    return got.select(*KEY, F.concat(F.array_join(F.transform("cells", shown), ""), tail).alias("markdown"))
