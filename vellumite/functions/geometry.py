"""Boxes as (x, y, w, h) with y downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over the shorter one; 0 where that has no length."""
    shorter = F.least(a1 - a0, b1 - b0)
    return F.when(shorter > 0, overlap(a0, a1, b0, b1) / shorter).otherwise(F.lit(0.0))


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return overlap(a["x"], a["x"] + a["w"], b["x"], b["x"] + b["w"]) * overlap(a["y"], a["y"] + a["h"], b["y"], b["y"] + b["h"])


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    common = intersection(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def center_inside(box: dict[str, Column], outer: dict[str, Column], outset: float = 0.0) -> Column:
    cx, cy = box["x"] + box["w"] / 2, box["y"] + box["h"] / 2
    return cx.between(outer["x"] - outset, outer["x"] + outer["w"] + outset) & cy.between(outer["y"] - outset, outer["y"] + outer["h"] + outset)


def contains(outer: dict[str, Column], box: dict[str, Column], slack: float = 0.0) -> Column:
    return (box["x"] >= outer["x"] - slack) & (box["y"] >= outer["y"] - slack) & (box["x"] + box["w"] <= outer["x"] + outer["w"] + slack) & (box["y"] + box["h"] <= outer["y"] + outer["h"] + slack)


def near(a: dict[str, Column], b: dict[str, Column], gap: float) -> Column:
    """Within gap of each other on both axes."""
    return (a["x"] <= b["x"] + b["w"] + gap) & (b["x"] <= a["x"] + a["w"] + gap) & (a["y"] <= b["y"] + b["h"] + gap) & (b["y"] <= a["y"] + a["h"] + gap)


def full_page(box: dict[str, Column], width: Column, height: Column) -> Column:
    return (box["w"] > width * F.lit(0.85)) & (box["h"] > height * F.lit(0.85))


def margin(side: Column) -> Column:
    return clamp(F.floor(side + 0.5), 18, 108)


def columns(prefix: str = "") -> dict[str, Column]:
    return {c: F.col(prefix + c) for c in ("x", "y", "w", "h")}
