"""Store-only zip archives, one for each group of files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.sequences import unique_names


def pack(names: Sequence[str], contents: Sequence[bytes], stamp: tuple = (1980, 1, 1, 0, 0, 0), level: int = 0) -> bytes:
    """A zip file; names beyond ASCII are marked as UTF-8. More than 65,535 entries or 4 GiB are an error."""
    if len(names) > 0xFFFF or sum(map(len, contents)) > 0xFFFFFFFF:
        raise ValueError("too much for a zip file")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if level else zipfile.ZIP_STORED, allowZip64=False, compresslevel=level or None) as z:
        for name, content in zip(names, contents, strict=True):
            z.writestr(zipfile.ZipInfo(name, stamp), bytes(content), z.compression, level or None)
    return out.getvalue()


def archives(files: DataFrame, by: str, name: str = "name", content: str = "content", order: str = "seq") -> DataFrame:
    """by, entries, zip: the files of each group in order, names made unique. A group's files meet in one task, as they
    must to become one file."""
    kinds = dict(files.dtypes)
    named = unique_names(files.select(by, name, content, order), [by], name, [order])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "entries": [len(pdf)], "zip": [pack(pdf["unique_name"].tolist(), pdf[content].tolist())]})

    return named.groupBy(by).applyInPandas(run, f"{by} {kinds[by]}, entries int, zip binary")
