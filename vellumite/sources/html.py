"""HTML pages to Markdown, with a list of allowed elements; what is removed is counted."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content goes with them; elements that break lines; schemes of links that stay.
DROPPED = {"script", "style", "iframe", "object", "embed", "form", "noscript", "template"}
BLOCKS = {"p", "div", "article", "section", "header", "footer", "nav", "ul", "ol", "table", "tr", "blockquote", "main", "aside"}
SCHEMES = ("http:", "https:", "mailto:", "#", "/")
BULLETS = "•◦▪"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.lists: list[int | None] = []
        self.links: list[str] = []
        self.skip: list[str] = []
        self.removed = 0

    def line(self) -> None:
        self.out.append("\n\n")

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.append(tag)
            return
        if tag in DROPPED:
            self.removed += 1
            self.skip.append(tag)
        elif re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.line()
            start = dict(attrs).get("start") or "1"
            self.lists.append(int(start) if tag == "ol" and start.lstrip("-").isdigit() else (1 if tag == "ol" else None))
        elif tag == "li":
            depth = max(0, len(self.lists) - 1)
            at = self.lists[-1] if self.lists else None
            self.out.append("\n" + "  " * depth + ("- " if at is None else f"{at}. "))
            if at is not None:
                self.lists[-1] = at + 1
        elif tag in BLOCKS:
            self.line()
        elif tag == "br":
            self.out.append("\n")
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a":
            href = (dict(attrs).get("href") or "").strip()
            self.links.append(href if href.lower().startswith(SCHEMES) else "")
            self.out.append("[" if self.links[-1] else "")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[-1]:
                self.skip.pop()
            return
        if tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "a" and self.links:
            href = self.links.pop()
            self.out.append(f"]({href})" if href else "")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.line()
        elif tag in BLOCKS or re.fullmatch("h[1-6]", tag):
            self.line()

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def to_markdown(html: str | None) -> tuple[str, int]:
    """(Markdown, elements removed); empty for null."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    lines = [x.rstrip() if re.match(r" *(?:- |[0-9]+\. )", x) else x.strip() for x in "".join(reader.out).split("\n")]
    text = re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()
    return text + ("\n" if text else ""), reader.removed


def pages_to_markdown(pages: DataFrame, html: str = "html", into: str = "markdown") -> DataFrame:
    """Adds `into` and `removed`."""

    @F.pandas_udf("markdown string, removed int")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([to_markdown(h) for h in batch], columns=["markdown", "removed"])

    return pages.withColumn("_m", convert(F.col(html))).withColumn(into, F.col("_m.markdown")).withColumn("removed", F.col("_m.removed")).drop("_m")


#: YAML front matter and a byte order mark, which Markdown readers skip.
def strip_front_matter(text):
    return F.regexp_replace(F.regexp_replace(text, "\\A\\x{FEFF}", ""), r"(?s)\A---\r?\n.*?\r?\n---\r?\n", "")
