"""Word files from semantic blocks, by zipfile and plain XML."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

from .archives import pack

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"/></Types>"""
RELS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>"""
PART_RELS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/numbering" Target="numbering.xml"/></Relationships>"""
#: Number formats of the four levels of ordered lists, and the signs of bullet lists.
LEVELS, BULLETS = ("decimal", "lowerLetter", "lowerRoman", "decimal"), "•◦▪•"


def twips(points: float) -> int:
    return int(points * 20 + 0.5)


def _styles() -> str:
    headings = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/><w:pPr><w:outlineLvl w:val="{k - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{size}"/></w:rPr></w:style>' for k, size in enumerate((40, 32, 28, 24), 1))
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:styles {W}>{headings}</w:styles>'


def _numbering() -> str:
    def abstract(i: int, level) -> str:
        return f'<w:abstractNum w:abstractNumId="{i}">' + "".join(level(k) for k in range(4)) + "</w:abstractNum>"

    lvl = lambda k, kind, text: f'<w:lvl w:ilvl="{k}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{text}"/><w:pPr><w:ind w:left="{twips(21 * (k + 1))}" w:hanging="{twips(21)}"/></w:pPr></w:lvl>'
    both = abstract(0, lambda k: lvl(k, "bullet", BULLETS[k])) + abstract(1, lambda k: lvl(k, LEVELS[k], f"%{k + 1}."))
    return f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:numbering {W}>{both}' + "".join(f'<w:num w:numId="{i + 1}"><w:abstractNumId w:val="{i}"/></w:num>' for i in (0, 1)) + "</w:numbering>"


def run(text: str, bold: bool = False, italic: bool = False, size: float | None = None) -> str:
    marks = ("<w:b/>" if bold else "") + ("<w:i/>" if italic else "") + (f'<w:sz w:val="{max(2, int(size * 2 + 0.5))}"/>' if size else "")
    return f"<w:r>{f'<w:rPr>{marks}</w:rPr>' if marks else ''}<w:t xml:space={quoteattr('preserve')}>{escape(text)}</w:t></w:r>"


def paragraph(kind: str, level: int | None, text: str, break_before: bool = False) -> str:
    """A heading, list item (ordered where its text starts with a number) or paragraph."""
    properties = '<w:pageBreakBefore/>' if break_before else ""
    if kind == "heading":
        properties = f'<w:pStyle w:val="Heading{min(4, max(1, level or 1))}"/>' + properties
    elif kind == "list-item":
        head, _, rest = text.partition(" ")
        ordered = head.strip("().").isdigit()
        text = rest or text
        properties += f'<w:numPr><w:ilvl w:val="{min(3, level or 0)}"/><w:numId w:val="{2 if ordered else 1}"/></w:numPr>'
    return f"<w:p>{f'<w:pPr>{properties}</w:pPr>' if properties else ''}{run(text)}</w:p>"


def table(rows: Sequence[Sequence[str]], width: float) -> str:
    """Equal columns of at least 12 points; an empty paragraph follows, as Word wants between tables."""
    n = max(1, max(map(len, rows), default=1))
    w = twips(max(12.0, width / n))
    cell = lambda t: f'<w:tc><w:tcPr><w:tcW w:w="{w}" w:type="dxa"/></w:tcPr><w:p>{run(t)}</w:p></w:tc>'
    body = "".join("<w:tr>" + "".join(cell(t) for t in [*r, *[""] * (n - len(r))]) + "</w:tr>" for r in rows)
    return f'<w:tbl><w:tblPr><w:tblW w:w="0" w:type="auto"/></w:tblPr>{body}</w:tbl><w:p/>'


def document(parts: Iterable[str], width: float = 595.28, height: float = 841.89, margin: float = 72.0) -> bytes:
    m = twips(margin)
    section = f'<w:sectPr><w:pgSz w:w="{twips(width)}" w:h="{twips(height)}"/><w:pgMar w:top="{m}" w:right="{m}" w:bottom="{m}" w:left="{m}" w:header="{m // 2}" w:footer="{m // 2}" w:gutter="0"/></w:sectPr>'
    body = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document {W}><w:body>{"".join(parts)}{section}</w:body></w:document>'
    files = {"[Content_Types].xml": TYPES, "_rels/.rels": RELS, "word/document.xml": body, "word/styles.xml": _styles(), "word/numbering.xml": _numbering(), "word/_rels/document.xml.rels": PART_RELS}
    return pack(list(files), [f.encode() for f in files.values()], level=6)


def documents(blocks: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, blocks, docx: blocks (page_index, block, kind, level, text) in order, a page break before each new page."""
    kinds = dict(blocks.dtypes)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["page_index", "block"])
        fresh = pdf["page_index"].diff().fillna(0) > 0
        parts = [paragraph(r.kind, None if pd.isna(r.level) else int(r.level), r.text, new) for r, new in zip(pdf.itertuples(), fresh, strict=True)]
        return pd.DataFrame({by: [pdf[by].iloc[0]], "blocks": [len(pdf)], "docx": [document(parts)]})

    return blocks.groupBy(by).applyInPandas(write, f"{by} {kinds[by]}, blocks int, docx binary")
