"""Markdown from semantic blocks: each block's text is a column expression, documents are ordered joins of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, sanitize


def escape_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def run_text(text: Column, bold: Column, italic: Column) -> Column:
    """A run with its marks; blanks around it stay outside of them, since Markdown knows no emphasis next to a blank."""
    clean = sanitize(text)
    lead, trail = F.regexp_extract(clean, f"\\A[{SPACE}]*", 0), F.regexp_extract(clean, f"[^{SPACE}]([{SPACE}]*)\\z", 1)
    core = F.substring(clean, F.length(lead) + 1, F.length(clean) - F.length(lead) - F.length(trail))
    mark = F.concat(F.when(bold, "**").otherwise(""), F.when(italic, "*").otherwise(""))
    return F.when((core == "") | (mark == ""), clean).otherwise(F.concat(lead, mark, core, F.reverse(mark), trail))


def runs_text(runs: Column) -> Column:
    """An array of structs (text, bold, italic)."""
    return F.array_join(F.transform(runs, lambda r: run_text(r["text"], r["bold"], r["italic"])), "")


def table_markdown(rows: Column) -> Column:
    """An array of rows, each an array of cell texts; short rows are filled up, a single row gets an empty head."""
    wide = F.array_max(F.transform(rows, lambda r: F.size(r)))
    row = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
    lines = F.transform(rows, row)
    head = F.when(F.size(rows) == 1, row(F.array_repeat(F.lit(""), wide))).otherwise(F.element_at(lines, 1))
    body = F.when(F.size(rows) == 1, lines).otherwise(F.slice(lines, 2, F.greatest(F.size(rows) - 1, F.lit(1))))
    return F.array_join(F.concat(F.array(head, rule), body), "\n")


def html_table(cells: Column) -> Column:
    """An array of rows of structs (text, row_span, col_span) as HTML, for tables with merged cells."""
    span = lambda n, v: F.when(v > 1, F.concat(F.lit(f' {n}="'), v.cast("string"), F.lit('"'))).otherwise("")
    cell = lambda c: F.concat(F.lit("    <td"), span("rowspan", c["row_span"]), span("colspan", c["col_span"]), F.lit(">"), escape_html(c["text"]), F.lit("</td>"))
    row = lambda r: F.concat(F.lit("  <tr>\n"), F.array_join(F.transform(r, cell), "\n"), F.lit("\n  </tr>"))
    return F.concat(F.lit("<table>\n"), F.array_join(F.transform(cells, row), "\n"), F.lit("\n</table>"))


def page_marker(page: Column) -> Column:
    return F.format_string("<!-- page: %d -->", page + 1)


def block_markdown(kind: Column, level: Column, text: Column) -> Column:
    """A heading, list item (its marker, if of digits, stays a number) or paragraph."""
    heading = F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)
    number = F.regexp_extract(text, r"\A\(?([0-9]+)[.)]\s*", 1)
    rest = F.regexp_replace(text, r"\A(?:[•·▪◦‣⁃●○■□∙*–—-]|\(?[0-9]+[.)])\s*", "")
    item = F.concat(F.repeat(F.lit("  "), F.coalesce(level, F.lit(0))), F.when(number != "", F.concat(number, F.lit(". "))).otherwise("- "), rest)
    return F.when(kind == "heading", heading).when(kind == "list-item", item).otherwise(text)


def documents(blocks: DataFrame, by: str = "doc_id", order: Sequence[str] = ("page_index", "block")) -> DataFrame:
    """by, markdown: blocks (kind, level, text, page_index, block) in order, a marker before each page, list items of one
    run without blank lines between them."""
    w = Window.partitionBy(by).orderBy(*order)
    text = block_markdown(F.col("kind"), F.col("level"), F.col("text"))
    previous = F.lag("kind").over(w)
    new_page = F.coalesce(F.lag("page_index").over(w) != F.col("page_index"), F.lit(True))
    tight = (F.col("kind") == "list-item") & (previous == "list-item") & ~new_page
    lead = F.when(previous.isNull(), "").when(tight, "\n").otherwise("\n\n")
    marked = F.when(new_page, F.concat(page_marker(F.col("page_index")), F.lit("\n\n"), text)).otherwise(text)
    pieces = blocks.withColumn("_piece", F.concat(lead, marked))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "_piece"))), lambda s: s["_piece"]), "")
    return pieces.groupBy(by).agg(F.concat(joined, F.lit("\n")).alias("markdown"))


def manifest(blocks: DataFrame, by: str = "doc_id", order: Sequence[str] = ("page_index", "block")) -> DataFrame:
    """by, manifest: JSON of a document's blocks with kind and page."""
    entry = F.struct(*order, "kind")
    return blocks.groupBy(by).agg(F.to_json(F.struct(F.lit(1).alias("version"), F.array_sort(F.collect_list(entry)).alias("blocks"))).alias("manifest"))
