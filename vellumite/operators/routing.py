"""Which tool takes a batch of files: votes of the files for the tools that accept them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extensions and media types that the tools accept, the tools in order; on equal votes the first wins.
PDF = (("pdf",), ("application/pdf",), ())
WORD = (("docx",), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document",), ())
IMAGES = (("jpg", "jpeg", "png", "webp", "gif", "bmp", "avif", "svg"), (), ("image/",))
MORE_IMAGES = (IMAGES[0] + ("heic", "heif", "tif", "tiff", "ico"), (), ("image/",))
MARKDOWN = (("md", "markdown", "txt") + IMAGES[0], ("text/markdown", "text/plain"), ("image/",))
TOOLS = {
    "pdf-to-word": PDF, "pdf-to-markdown": PDF, "pdf-to-images": PDF, "word-to-pdf": WORD, "markdown-to-pdf": MARKDOWN, "images-to-pdf": IMAGES,
    "compress-images": MORE_IMAGES, "convert-images": MORE_IMAGES, "resize-images": MORE_IMAGES,
}


def extension(name: Column) -> Column:
    """In lower case, without the dot; empty where there is none."""
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")


def accepts(tool: str, name: Column, media: Column) -> Column:
    extensions, types, prefixes = TOOLS[tool]
    name, media = F.coalesce(name, F.lit("")), F.coalesce(media, F.lit(""))
    found = extension(name).isin(*extensions) | media.isin(*types) if types else extension(name).isin(*extensions)
    for p in prefixes:
        found = found | media.startswith(p)
    return found


def is_markdown(name: Column, media: Column) -> Column:
    return F.coalesce(name, F.lit("")).rlike(r"(?i)\.(?:md|markdown|txt)\z") | F.coalesce(media == "text/markdown", F.lit(False))


def route(files: DataFrame, by: Sequence[str], name: str = "name", media: str = "media") -> DataFrame:
    """by, tool, votes: the tool that takes most of a batch's files; null and 0 if none takes any.

    Images beside a text count for the tool of texts, which refers to them; without a text it has no votes. One partial
    aggregation with a count a tool."""
    held, kind = F.col(name), F.col(media)
    counts = files.groupBy(*by).agg(*[F.count_if(accepts(t, held, kind)).alias(t) for t in TOOLS], F.count_if(is_markdown(held, kind)).alias("_texts"))
    votes = {t: F.when((F.lit(t) != "markdown-to-pdf") | (F.col("_texts") > 0), F.col(f"`{t}`")).otherwise(0) for t in TOOLS}
    most = F.greatest(*votes.values())
    tool = F.lit(None).cast("string")
    for t in reversed(TOOLS):
        tool = F.when((most > 0) & (votes[t] == most), t).otherwise(tool)
    return counts.select(*by, tool.alias("tool"), most.alias("votes"))
