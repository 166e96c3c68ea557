"""Straight rules in page bitmaps: long dark runs, joined across neighbouring lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DARK, BRIDGE, RUN_PT, RULE_PT, THICK_PT, SKEW = 420, 2, 20.0, 30.0, 3.0, 0.03
SEGMENT = "orientation string, position double, start double, end double, thickness double"


def ink(rgb: np.ndarray) -> np.ndarray:
    """Dark pixels of a height x width x 3 array."""
    return rgb[..., :3].astype(int).sum(2) < DARK


def _runs(dark: np.ndarray, least: float) -> np.ndarray:
    """(line, first, last + 1) of dark runs of at least `least` pixels, gaps of BRIDGE pixels closed."""
    out = []
    for k in np.flatnonzero(dark.sum(1) >= least * 0.5):
        at = np.flatnonzero(dark[k])
        cut = np.flatnonzero(np.diff(at) > BRIDGE + 1)
        first, last = at[np.concatenate(([0], cut + 1))], at[np.concatenate((cut, [len(at) - 1]))] + 1
        keep = last - first >= least
        out += list(zip(np.full(keep.sum(), k), first[keep], last[keep], strict=True))
    return np.array(out, int).reshape(-1, 3)


def rules(dark: np.ndarray, scale: float) -> pd.DataFrame:
    """SEGMENT of a bitmap, in points (pixels over scale). Runs on neighbouring lines that touch make one rule; it must be
    30 points long and no thicker than 3 points and 3 % of its length; dark edges of a scan are left out."""
    rows = []
    for name, bitmap in (("horizontal", dark), ("vertical", dark.T)):
        runs = _runs(bitmap, RUN_PT * scale)
        parts: list[list[int]] = []  # first line, last line, start, end, last run's start, last run's end
        live: list[list[int]] = []
        for line, a, b in runs:
            live = [p for p in live if p[1] >= line - 1]
            home = next((p for p in live if a <= p[5] + 1 and b >= p[4] - 1), None)
            if home is None:
                live.append([line, line, a, b, a, b])
                parts.append(live[-1])
            else:
                home[1:] = line, min(home[2], a), max(home[3], b), a, b
        size = len(bitmap)
        for top, low, a, b, *_ in parts:
            length, thick = b - a, low + 1 - top
            if length >= RULE_PT * scale and thick <= THICK_PT * scale + SKEW * length and not (top == 0 or low == size - 1):
                rows.append((name, (top + low + 1) / 2 / scale, a / scale, b / scale, thick / scale))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENT.split(", ")])


def detect(images: DataFrame, page: tuple[str, ...] = ("doc_id", "page_index"), scale: float = 2.0) -> DataFrame:
    """page, SEGMENT of images in Spark's image format: `image` with height, width, nChannels and data (BGR or gray)."""
    kinds = dict(images.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.to_dict("records"):
                pixels = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                found = rules(ink(pixels if r["nChannels"] >= 3 else pixels.repeat(3, 2)), scale)
                yield found.assign(**{c: r[c] for c in page})[[*page, *found.columns]]

    flat = images.select(*page, "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in page) + ", " + SEGMENT)
