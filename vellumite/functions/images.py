"""Image plans: target sizes, formats, keep rules, placing on pages. Everything is a column of a job's row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import clamp_int, round_half_up

MAX_SIDE = 16384
# Points.
PAPER = {"a4": (595.28, 841.89), "letter": (612.0, 792.0)}
MARGINS = {"none": 0.0, "small": 28.35, "normal": 56.7}
PLAN = ("width", "height", "sx", "sy", "sw", "sh", "dx", "dy", "dw", "dh", "changed")


def _plan(**fields: Column) -> Column:
    return F.struct(*[fields[k].cast("boolean" if k == "changed" else "double").alias(k) for k in PLAN])


def _whole(w: Column, h: Column, width: Column, height: Column) -> Column:
    zero = F.lit(0)
    return _plan(width=width, height=height, sx=zero, sy=zero, sw=w, sh=h, dx=zero, dy=zero, dw=width, dh=height, changed=(width != w) | (height != h))


def _scaled(w: Column, h: Column, scale: Column, upscale: bool) -> Column:
    side = lambda v: F.greatest(F.lit(1), round_half_up(v * scale))
    goes = (scale < 1) | ((scale > 1) if upscale else F.lit(False))
    return F.when(goes, _whole(w, h, side(w), side(h))).otherwise(_whole(w, h, w, h))


def plan_exact(w: Column, h: Column, width: Column, height: Column, cover: bool) -> Column:
    zero, same = F.lit(0), (width == w) & (height == h)
    if cover:
        scale = F.greatest(width / w, height / h)
        sw, sh = F.least(w.cast("double"), width / scale), F.least(h.cast("double"), height / scale)
        made = _plan(width=width, height=height, sx=(w - sw) / 2, sy=(h - sh) / 2, sw=sw, sh=sh, dx=zero, dy=zero, dw=width, dh=height, changed=F.lit(True))
    else:
        scale = F.least(width / w, height / h)
        dw, dh = F.greatest(F.lit(1), round_half_up(w * scale)), F.greatest(F.lit(1), round_half_up(h * scale))
        made = _plan(width=width, height=height, sx=zero, sy=zero, sw=w, sh=h, dx=F.floor((width - dw) / 2), dy=F.floor((height - dh) / 2), dw=dw, dh=dh, changed=F.lit(True))
    return F.when(same, _whole(w, h, width, height)).otherwise(made)


def plan_resize(w: Column, h: Column, mode: str, size: Column | int = 1920, percent: Column | int = 50, exact: tuple = (800, 800), cover: bool = True, upscale: bool = False) -> Column:
    """struct of PLAN. Bitmaps only shrink, except to an exact size; vector images (upscale) may grow."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    side = clamp_int(as_column(size), 1, MAX_SIDE, 1)
    if mode == "exact":
        return plan_exact(w, h, *(clamp_int(as_column(v), 1, MAX_SIDE, 1) for v in exact), cover)
    scales = {"long": side / F.greatest(w, h), "width": side / w, "height": side / h, "percent": clamp_int(as_column(percent), 1, 100, 100) / 100, "none": F.lit(1.0)}
    return _scaled(w, h, scales[mode], upscale and mode != "percent")


def limit_plan(plan: Column, max_pixels: int) -> Column:
    """The plan scaled down, rounding down, to a number of pixels and to the longest side there is."""
    scale = F.least(F.lit(1.0), F.sqrt(F.lit(float(max_pixels)) / (plan["width"] * plan["height"])), F.lit(float(MAX_SIDE)) / F.greatest(plan["width"], plan["height"]))
    side = lambda v: F.greatest(F.lit(1), F.floor(v * scale))
    made = {k: side(plan[k]) for k in ("width", "height", "dw", "dh")} | {k: F.floor(plan[k] * scale) for k in ("dx", "dy")} | {k: plan[k] for k in ("sx", "sy", "sw", "sh")}
    return F.when(scale >= 1, plan).otherwise(_plan(**made, changed=F.lit(True)))


def shrink_plan(plan: Column, factor: float) -> Column:
    side = lambda v: F.greatest(F.lit(1), round_half_up(v * F.lit(factor)))
    made = {k: side(plan[k]) for k in ("width", "height", "dw", "dh")} | {k: F.floor(plan[k] * F.lit(factor)) for k in ("dx", "dy")} | {k: plan[k] for k in ("sx", "sy", "sw", "sh")}
    return _plan(**made, changed=F.lit(True))


def choose_format(source: Column, choice: Column, has_alpha: Column, photographic: Column, webp: Column) -> Column:
    """struct(format, changed); changed: what was asked for can't be written."""
    other = F.when(has_alpha | ~photographic, "png").otherwise("jpeg")
    kept = source.isin("jpeg", "png") | ((source == "webp") & webp)
    made = F.when(choice == "webp", F.when(webp, "webp").otherwise(other)).when(choice != "keep", choice).when(kept, source).otherwise(other)
    changed = F.when(choice == "webp", ~webp).when(choice != "keep", False).otherwise(~kept)
    return F.struct(made.alias("format"), changed.alias("changed"))


def keep_original(same_format: Column, plan_changed: Column, background_changed: Column, before: Column, after: Column) -> Column:
    return same_format & ~plan_changed & ~background_changed & (after >= before)


def shrink_factor(size: Column, target: Column) -> Column:
    return F.least(F.lit(0.9), F.greatest(F.lit(0.5), F.sqrt(target / size) * F.lit(0.92)))


def search_quality(size_at, target: Column, low: float = 0.3, high: float = 0.92, steps: int = 6) -> Column:
    """struct(quality, fits): the highest quality whose size, size_at(quality), is at most target, by bisection."""

    def step(a: Column, _: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        fine = size_at(mid) <= target
        return F.struct(F.when(fine, mid).otherwise(a["lo"]).alias("lo"), F.when(fine, a["hi"]).otherwise(mid).alias("hi"))

    start = F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda a: a["lo"])
    top, bottom = size_at(F.lit(high)) <= target, size_at(F.lit(low)) <= target
    return F.struct(F.when(top, F.lit(high)).when(~bottom, F.lit(low)).otherwise(found).alias("quality"), (top | bottom).alias("fits"))


def place_image(w: Column, h: Column, page: str, orientation: str = "auto", margin: str = "none") -> Column:
    """struct(page_width, page_height, x, y, width, height) in points."""
    m = F.lit(MARGINS[margin])
    names = ("page_width", "page_height", "x", "y", "width", "height")
    if page == "fit":
        return F.struct(*[v.cast("double").alias(n) for n, v in zip(names, (w + m * 2, h + m * 2, m, m, w, h), strict=True)])
    short, long = map(F.lit, PAPER[page])
    lying = F.lit(orientation == "landscape") | (F.lit(orientation == "auto") & (w > h))
    pw, ph = F.when(lying, long).otherwise(short), F.when(lying, short).otherwise(long)
    scale = F.least((pw - m * 2) / w, (ph - m * 2) / h)
    return F.struct(*[v.alias(n) for n, v in zip(names, (pw, ph, (pw - w * scale) / 2, (ph - h * scale) / 2, w * scale, h * scale), strict=True)])


def display_size(width: Column, height: Column, orientation: Column) -> Column:
    turned = orientation >= 5
    return F.struct(F.when(turned, height).otherwise(width).alias("width"), F.when(turned, width).otherwise(height).alias("height"))


def image_reference(source: Column) -> Column:
    """struct(kind, name) of an image's source: `inline` (data of an image, or a blob) stays as it is, `blocked` has a scheme
    or a host, `file` is looked up by name, its last part without escapes; broken escapes stay. Null counts as empty."""
    text = F.coalesce(source, F.lit(""))
    # Image data that documents may hold.
    inline = text.rlike(r"(?i)\Adata:image/(?:png|jpe?g|gif|webp|bmp|avif|x-icon|vnd\.microsoft\.icon)[;,]") | text.rlike(r"(?i)\Ablob:")
    blocked = F.trim(text).rlike(r"(?i)\A(?:[a-z][a-z0-9+.-]*:|[\\/]{2})")
    last = F.element_at(F.split(text, r"[\\/]"), -1)
    name = F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)
    kind = F.when(inline, "inline").when(blocked, "blocked").otherwise("file")
    return F.struct(kind.alias("kind"), F.when(kind == "file", name).alias("name"))
