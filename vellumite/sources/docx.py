"""Word files to semantic blocks: paragraphs, headings, list items and tables, in order, with page fields named."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FIELDS = {"PAGE": "page", "NUMPAGES": "pages", "SECTIONPAGES": "pages"}
BLOCK = "array<struct<seq:int,kind:string,level:int,text:string,ordered:boolean,field:string>>"
#: The format's page: size and margins in points where a file names none.
DEFAULTS = {"width": 595.28, "height": 841.89, "margin": 72.0}


def _paragraph(p: ElementTree.Element, ordered: dict[str, bool]) -> tuple:
    """(kind, level, text, ordered, field). Results of page fields are left out of the text; a field whose runs also
    carry other text stays as it is."""
    text, field, depth, code, result = [], None, 0, "", []
    for e in p.iter():
        if e.tag == NS + "fldSimple":
            field = field or FIELDS.get((e.get(NS + "instr") or "").split()[0] if e.get(NS + "instr") else "")
        elif e.tag == NS + "fldChar":
            kind = e.get(NS + "fldCharType")
            depth += (kind == "begin") - (kind == "end")
            if kind == "begin" and depth == 1:
                code, result = "", []
            elif kind == "end" and depth == 0:
                name = FIELDS.get(code.split()[0]) if code.split() else None
                field = field or name
                text += [] if name else result
        elif e.tag == NS + "instrText":
            code += e.text or ""
        elif e.tag in (NS + "t", NS + "tab", NS + "br"):
            (result if depth else text).append(e.text or "" if e.tag == NS + "t" else ("\t" if e.tag == NS + "tab" else "\n"))
    style = p.find(f"{NS}pPr/{NS}pStyle")
    name = (style.get(NS + "val") or "").lower() if style is not None else ""
    number = p.find(f"{NS}pPr/{NS}numPr")
    if name.startswith("heading") and name[7:].isdigit():
        return "heading", int(name[7:]), "".join(text), None, field
    if number is not None:
        level, num = number.find(NS + "ilvl"), number.find(NS + "numId")
        return "list-item", int(level.get(NS + "val")) if level is not None else 0, "".join(text), ordered.get(num.get(NS + "val") if num is not None else "", False), field
    return "paragraph", None, "".join(text), None, field


def _ordered(z: zipfile.ZipFile) -> dict[str, bool]:
    if "word/numbering.xml" not in z.namelist():
        return {}
    root = ElementTree.fromstring(z.read("word/numbering.xml"))
    kinds = {a.get(NS + "abstractNumId"): a.find(f"{NS}lvl/{NS}numFmt") for a in root.iter(NS + "abstractNum")}
    out = {}
    for n in root.iter(NS + "num"):
        kind = kinds.get(n.find(NS + "abstractNumId").get(NS + "val"))
        out[n.get(NS + "numId")] = kind is not None and kind.get(NS + "val") != "bullet"
    return out


def read(content: bytes | None) -> tuple[list[tuple] | None, str | None]:
    """(blocks, error code): errors are values, one bad file doesn't end a job."""
    try:
        with zipfile.ZipFile(io.BytesIO(bytes(content or b""))) as z:
            ordered = _ordered(z)
            body = ElementTree.fromstring(z.read("word/document.xml")).find(NS + "body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, "invalid-docx"
    out: list[tuple] = []
    for e in body if body is not None else []:
        if e.tag == NS + "p":
            kind, level, text, is_ordered, field = _paragraph(e, ordered)
            if text.strip() or field:
                out.append((len(out), kind, level, text, is_ordered, field))
        elif e.tag == NS + "tbl":
            rows = ["\t".join("".join(t.text or "" for t in c.iter(NS + "t")) for c in r.iter(NS + "tc")) for r in e.iter(NS + "tr")]
            out.append((len(out), "table", None, "\n".join(rows), None, None))
    return out, None


def _read_all(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = ("seq", "kind", "level", "text", "ordered", "field")
    for content in batches:
        made = [read(c) for c in content]
        yield pd.DataFrame({"blocks": [None if b is None else [dict(zip(names, row, strict=True)) for row in b] for b, _ in made], "error": [e for _, e in made]})


def read_documents(files: DataFrame, content: str = "content") -> DataFrame:
    """files without content, with seq, kind, level, text, ordered, field of each block; files that can't be read have one
    row with `error`."""
    blocks = F.pandas_udf(_read_all, f"blocks {BLOCK}, error string")
    found = files.withColumn("_d", blocks(F.col(content))).drop(content)
    rows = found.select(*[c for c in found.columns if c != "_d"], F.col("_d.error").alias("error"), F.explode_outer("_d.blocks").alias("_b"))
    return rows.select(*[c for c in found.columns if c != "_d"], "_b.*", "error")
