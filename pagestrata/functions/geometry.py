"""Box arithmetic as Column expressions.

A box is four integer columns, half-open in pixels. The clamp variants differ in
swapping, NULL results and minimum size, so each has its own name.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values
MIN_CANON_SIDE = 4
VERTICAL_RATIO = 1.15
HUGE_PAGE_SHARE = 0.35
NEAR_IOU = 0.35
NEAR_STRICT_OVERLAP = 0.90
NEAR_OVERLAP = 0.80
NEAR_CENTER_OVERLAP = 0.70
OCR_PAD = 12
OCR_MIN_SHORT_SIDE = 10
OCR_MAX_LONG_SIDE = 1000
OCR_MAX_UPSCALE = 4.0
CROP_RATIO = 1.7

EDGES = ("x1", "y1", "x2", "y2")


class Box(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column

    def named(self, prefix: str = "", suffix: str = "") -> list[Column]:
        return [c.cast("long").alias(f"{prefix}{e}{suffix}") for e, c in zip(EDGES, self)]

    def struct(self) -> Column:
        return F.struct(*self.named())

    def keep_if(self, condition: Column) -> "Box":
        return Box(*(F.when(condition, c) for c in self))

    def or_else(self, other: "Box") -> "Box":
        """The whole other box where this one is NULL."""
        missing = self.x1.isNull()
        return Box(*(F.when(missing, b).otherwise(a) for a, b in zip(self, other)))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1


def box(prefix: str = "", suffix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{e}{suffix}") for e in EDGES))


def struct_box(column: Column | str) -> Box:
    column = F.col(column) if isinstance(column, str) else column
    return Box(*(column[e] for e in EDGES))


def _long(c: Column) -> Column:
    return c.cast("long")


def _within(c: Column, top: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(_long(c), _long(top)))


def half_even(c: Column) -> Column:
    return F.bround(c.cast("double"), 0).cast("long")


def parse_number(text: Column) -> Column:
    """Number from a numeric string, NULL otherwise."""
    cleaned = F.trim(text.cast("string"))
    return F.when(~cleaned.rlike("(?i)[df]$|nan|inf"), cleaned.try_cast("double"))


def _swap(b: Box) -> Box:
    return Box(F.least(b.x1, b.x2), F.least(b.y1, b.y2), F.greatest(b.x1, b.x2), F.greatest(b.y1, b.y2))


def has_min_side(b: Box, side: int) -> Column:
    return (b.width >= side) & (b.height >= side)


def _all_present(b: Box) -> Column:
    return b.x1.isNotNull() & b.y1.isNotNull() & b.x2.isNotNull() & b.y2.isNotNull()


def stage(df: DataFrame, prefix: str, b: Box) -> DataFrame:
    """Materialise a box as columns, so later steps name it instead of repeating it.

    One row out of an array of one struct: a plain projection would be written out again in each later filter and column, which
    makes methods too long to be compiled.
    """
    return df.select("*", F.inline(F.array(F.struct(*b.named(prefix)))))


def _drop(df: DataFrame, *prefixes: str) -> DataFrame:
    return df.drop(*(f"{p}{e}" for p in prefixes for e in EDGES))


def with_normalized_box(
    df: DataFrame, values: Box, prefix: str, w: Column | None = None, h: Column | None = None
) -> DataFrame:
    """Numbers or numeric strings to an ordered box, NULL under 4 px a side; cut to the
    page when its size is given."""
    kinds = [kind for _, kind in df.select(*(v.alias(e) for e, v in zip(EDGES, values))).dtypes]
    df = stage(df, "__n", Box(*(
        half_even(parse_number(v)) if kind == "string" else v.cast("long") if kind in ("int", "bigint") else half_even(v)
        for v, kind in zip(values, kinds)
    )))
    n = box("__n")
    df = stage(df, "__o", _swap(n).keep_if(_all_present(n)))
    ordered = box("__o")
    if w is not None and h is not None:
        big_enough = ordered.keep_if(has_min_side(ordered, MIN_CANON_SIDE))
        df = stage(df, "__c", Box(*(_within(c, t) for c, t in zip(big_enough, (w, h, w, h)))))
        cut = box("__c")
        fits = has_min_side(ordered, MIN_CANON_SIDE) & has_min_side(cut, MIN_CANON_SIDE)
        return _drop(stage(df, prefix, cut.keep_if(fits)), "__n", "__o", "__c")
    return _drop(stage(df, prefix, ordered.keep_if(has_min_side(ordered, MIN_CANON_SIDE))), "__n", "__o")


def clamp_or_null(b: Box, w: Column, h: Column) -> Box:
    """Cut to the page without swapping; NULL when nothing is left."""
    cut = Box(_within(b.x1, w), _within(b.y1, h), _within(b.x2, w), _within(b.y2, h))
    return cut.keep_if(_all_present(b) & (cut.x2 > cut.x1) & (cut.y2 > cut.y1))


def clamp_swap(b: Box, w: Column, h: Column) -> Box:
    """Cut to the page, then order the corners; may be empty."""
    return _swap(Box(_within(b.x1, w), _within(b.y1, h), _within(b.x2, w), _within(b.y2, h)))


def grow(b: Box, pad: Column | int) -> Box:
    pad = F.lit(pad) if isinstance(pad, int) else pad
    return Box(b.x1 - pad, b.y1 - pad, b.x2 + pad, b.y2 + pad)


def expand(b: Box, pad: Column | int, w: Column, h: Column) -> Box:
    return clamp_or_null(grow(b, pad), w, h)


def common(a: Box, b: Box) -> Box:
    return Box(
        F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2)
    )


def intersect(a: Box, b: Box, w: Column, h: Column) -> Box:
    """Common part on the page, NULL when empty."""
    return clamp_or_null(common(a, b).keep_if(_all_present(a) & _all_present(b)), w, h)


def area(b: Box) -> Column:
    zero = F.lit(0).cast("long")
    return F.coalesce(F.greatest(zero, _long(b.width)) * F.greatest(zero, _long(b.height)), zero)


def overlap_area(a: Box, b: Box) -> Column:
    return area(common(a, b))


def iou(a: Box, b: Box) -> Column:
    inter = overlap_area(a, b)
    union = area(a) + area(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def floored_share(part: Column, whole: Column) -> Column:
    """part / whole with the whole floored at one pixel."""
    return part / F.greatest(whole, F.lit(1).cast("long"))


def overlap_over_area(a: Box, b: Box) -> tuple[Column, Column]:
    inter = overlap_area(a, b)
    return share(inter, area(a)), share(inter, area(b))


def center(b: Box) -> tuple[Column, Column]:
    return (b.x1 + b.x2) / F.lit(2.0), (b.y1 + b.y2) / F.lit(2.0)


def point_in_box(point: tuple[Column, Column], b: Box, pad: int = 0) -> Column:
    x, y = point
    return x.between(b.x1 - pad, b.x2 + pad) & y.between(b.y1 - pad, b.y2 + pad)


def min_area_share(a: Box, b: Box) -> Column:
    return floored_share(overlap_area(a, b), F.least(area(a), area(b)))


def is_near_duplicate(a: Box, b: Box) -> Column:
    over_a, over_b = overlap_over_area(a, b)
    smaller = min_area_share(a, b)
    centred = point_in_box(center(a), b) | point_in_box(center(b), a)
    return (overlap_area(a, b) > 0) & (
        (iou(a, b) >= NEAR_IOU)
        | (over_a >= NEAR_STRICT_OVERLAP)
        | (over_b >= NEAR_STRICT_OVERLAP)
        | (smaller >= NEAR_OVERLAP)
        | (centred & (smaller >= NEAR_CENTER_OVERLAP))
    )


def source_direction(b: Box) -> Column:
    one = F.lit(1).cast("long")
    tall = F.greatest(one, _long(b.height)) >= F.greatest(one, _long(b.width)) * F.lit(VERTICAL_RATIO)
    return F.when(tall, "vertical").otherwise("horizontal")


def is_tiny(b: Box, min_w: int, min_h: int, min_area: int) -> Column:
    zero = F.lit(0).cast("long")
    return (
        (F.greatest(zero, _long(b.width)) < min_w)
        | (F.greatest(zero, _long(b.height)) < min_h)
        | (area(b) < min_area)
    )


def is_huge(b: Box, w: Column, h: Column, ratio: float = HUGE_PAGE_SHARE) -> Column:
    return area(b) > F.greatest(F.lit(1).cast("long"), _long(w * h)) * F.lit(ratio)


def polygon_box(points: Column) -> Column:
    """Box struct around an array of [x, y] points, NULL without usable points."""
    usable = F.filter(points, lambda p: F.size(p) >= 2)
    xs = F.transform(usable, lambda p: p[0].cast("long"))
    ys = F.transform(usable, lambda p: p[1].cast("long"))
    made = F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"),
        F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"),
    )
    return F.when(F.size(usable) > 0, made)


def polygon_boxes(polygons: Column) -> Column:
    """Boxes of all polygons; empty and degenerate ones are left out."""
    boxes = F.transform(polygons, polygon_box)
    return F.coalesce(
        F.filter(boxes, lambda b: b.isNotNull() & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])),
        F.array().cast("array<struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>>"),
    )


def box_polygon(b: Box) -> Column:
    corner = lambda x, y: F.array(_long(x), _long(y))
    return F.array(corner(b.x1, b.y1), corner(b.x2, b.y1), corner(b.x2, b.y2), corner(b.x1, b.y2))


def line_polygons(polygons: Column, line_boxes: Column) -> Column:
    """Polygons of at least four points, else polygons made from the line boxes."""
    whole = F.filter(
        F.transform(
            polygons,
            lambda poly: F.transform(
                F.filter(poly, lambda p: F.size(p) >= 2),
                lambda p: F.array(p[0].cast("long"), p[1].cast("long")),
            ),
        ),
        lambda poly: F.size(poly) >= 4,
    )
    from_boxes = F.transform(
        F.filter(line_boxes, lambda b: b.isNotNull()), lambda b: box_polygon(struct_box(b))
    )
    return F.when(F.size(F.coalesce(whole, F.array())) > 0, whole).when(
        F.size(F.coalesce(from_boxes, F.array())) > 0, from_boxes
    )


def with_crop_bounds(
    df: DataFrame, region: Box, detector: Column, polygons_box: Box, font_size: Column,
    direction: Column, w: Column, h: Column, prefix: str,
) -> DataFrame:
    """Recognition crop of a text block: region and line boxes, padded by font size."""
    one = F.lit(1).cast("long")
    df = stage(df, "__r", clamp_swap(region, w, h))
    base = box("__r")
    width, height = F.greatest(one, base.width), F.greatest(one, base.height)
    df = df.withColumn(
        "__size", F.coalesce(font_size.cast("double"), F.least(width, height).cast("double"))
    ).withColumn(
        "__upright",
        F.when(direction != "", direction == "vertical").otherwise(height >= width * F.lit(VERTICAL_RATIO)),
    )
    size, upright = F.col("__size"), F.col("__upright")
    floor = F.greatest(size * 0.20, F.lit(6.0))
    df = df.withColumn(
        "__px", F.greatest(size * F.when(upright, 0.35).otherwise(0.25), floor)
    ).withColumn("__py", F.greatest(size * F.when(upright, 0.25).otherwise(0.35), floor))
    df = stage(df, "__p", Box(
        half_even(F.least(base.x1, polygons_box.x1) - F.col("__px")),
        half_even(F.least(base.y1, polygons_box.y1) - F.col("__py")),
        half_even(F.greatest(base.x2, polygons_box.x2) + F.col("__px")),
        half_even(F.greatest(base.y2, polygons_box.y2) + F.col("__py")),
    ))
    refined = (F.coalesce(detector, F.lit("")) == "comic_text_detector") | polygons_box.x1.isNotNull()
    padded = clamp_swap(box("__p"), w, h)
    df = stage(df, prefix, Box(*(F.when(refined, p).otherwise(b) for p, b in zip(padded, base))))
    return _drop(df, "__r", "__p").drop("__size", "__upright", "__px", "__py")


def roi_to_page(local: Box, roi: Box) -> Box:
    return Box(local.x1 + roi.x1, local.y1 + roi.y1, local.x2 + roi.x1, local.y2 + roi.y1)


def with_render_box(
    df: DataFrame, kind: Column, translated: Box, translated_ocr: Box, ocr: Box, ocr_item: Box,
    w: Column, h: Column, prefix: str,
) -> DataFrame:
    """Bubbles prefer the base box, other kinds the recognition box; newer snapshots win."""
    df = stage(df, "__t", translated_ocr.or_else(ocr))
    df = stage(df, "__b", translated.or_else(ocr_item))
    df = stage(df, "__tc", clamp_or_null(box("__t"), w, h))
    df = stage(df, "__bc", clamp_or_null(box("__b"), w, h))
    text_box, base_box = box("__tc"), box("__bc")
    bubble = kind == "bubble"
    first = Box(*(F.when(bubble, b).otherwise(t) for b, t in zip(base_box, text_box)))
    second = Box(*(F.when(bubble, t).otherwise(b) for b, t in zip(base_box, text_box)))
    return _drop(stage(df, prefix, first.or_else(second)), "__t", "__b", "__tc", "__bc")


def with_crop_window(
    df: DataFrame, b: Box, w: Column, h: Column, prefix: str,
    ratio: float = CROP_RATIO, aspect: float = 1.0,
) -> DataFrame:
    """Square-ish context window around a box; NULL when empty."""
    one = F.lit(1).cast("long")
    width, height = F.greatest(one, _long(b.width)), F.greatest(one, _long(b.height))
    df = df.withColumn("__base", F.greatest(width, half_even(height * F.lit(aspect))))
    base = F.col("__base")
    df = df.withColumn("__hw", F.greatest(width, half_even(base * F.lit(ratio))) / 2.0).withColumn(
        "__hh", F.greatest(height, half_even(base / F.lit(max(aspect, 1e-6)) * F.lit(ratio))) / 2.0
    )
    cx, cy, half_w, half_h = b.x1 + width / 2.0, b.y1 + height / 2.0, F.col("__hw"), F.col("__hh")
    df = stage(df, "__w", Box(
        half_even(cx - half_w), half_even(cy - half_h), half_even(cx + half_w), half_even(cy + half_h)
    ))
    df = stage(df, "__v", clamp_swap(box("__w"), w, h))
    window = box("__v")
    df = stage(df, prefix, window.keep_if((window.x2 > window.x1) & (window.y2 > window.y1)))
    return _drop(df, "__w", "__v").drop("__base", "__hw", "__hh")


def ocr_crop_plan(w: Column, h: Column) -> dict[str, Column]:
    """Padded size, scale and target size of a recognition crop."""
    pw, ph = w + 2 * OCR_PAD, h + 2 * OCR_PAD
    short, longest = F.least(pw, ph), F.greatest(pw, ph)
    up = F.when(
        short < OCR_MIN_SHORT_SIDE,
        F.greatest(F.lit(1.0), F.least(F.lit(float(OCR_MIN_SHORT_SIDE)) / short, F.lit(OCR_MAX_UPSCALE))),
    ).otherwise(F.lit(1.0))
    scale = F.when(
        longest * up > OCR_MAX_LONG_SIDE, F.least(up, F.lit(float(OCR_MAX_LONG_SIDE)) / longest)
    ).otherwise(up)
    resized = (F.abs(scale - 1.0) > 0.01) & ((scale < 1.0) | (scale > 1.01))
    one = F.lit(1).cast("long")
    return {
        "padded_w": _long(pw),
        "padded_h": _long(ph),
        "scale": scale,
        "target_w": F.when(resized, F.greatest(one, half_even(pw * scale))).otherwise(_long(pw)),
        "target_h": F.when(resized, F.greatest(one, half_even(ph * scale))).otherwise(_long(ph)),
    }


def inpaint_size_plan(w: Column, h: Column, max_side: int, mod: int) -> dict[str, Column]:
    """Size after limiting the longer side, then padding to a multiple."""
    longest = F.greatest(w, h)
    scale = F.when(longest > max_side, F.lit(float(max_side)) / longest).otherwise(F.lit(1.0))
    one = F.lit(1).cast("long")
    rw = F.when(longest > max_side, F.greatest(one, half_even(w * scale))).otherwise(_long(w))
    rh = F.when(longest > max_side, F.greatest(one, half_even(h * scale))).otherwise(_long(h))
    if mod <= 1:
        return {"scale": scale, "resized_w": rw, "resized_h": rh, "final_w": rw, "final_h": rh}
    return {
        "scale": scale, "resized_w": rw, "resized_h": rh,
        "final_w": rw + F.pmod(-rw, F.lit(mod)), "final_h": rh + F.pmod(-rh, F.lit(mod)),
    }
