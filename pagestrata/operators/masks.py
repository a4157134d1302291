"""Removal masks as box tables, and statistics over pixel samples and pixel rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions import geometry as g
from pagestrata.functions.geometry import EDGES, box, stage
from pagestrata.operators.ranking import with_position
from pagestrata.operators.regions import suppress_non_max
from pagestrata.operators.status import clean_status
from pagestrata.session import saved

# Fixed values
MIN_MASK_AREA = 16
BLOCK_PAD, SMALL_PAD = 14, 8
MAX_SHARE, EMERGENCY_SHARE = 0.35, 0.50
TILE_PX = 512
LUMA = (0.114, 0.587, 0.299)
WHITE, BLACK, MIN_GUTTER = 245.0, 15.0, 10
TILE, OVERLAP, MIN_TILE, MIN_CUT, TALL_RATIO = 1500, 200, 50, 800, 3.0


def text_mask_boxes(items: DataFrame, pad: int = 0, strict: bool = True, with_skipped: bool = True) -> DataFrame:
    """Box to remove per recognised item; padded only when not strict."""
    live = ~F.coalesce("excluded", F.lit(False))
    if not with_skipped:
        live = live & (clean_status(F.col("status")) != "skipped")
    return _mask_box(items.where(live), box("o").or_else(box()), pad, strict).where(
        F.col("mx1").isNotNull() & (g.area(box("m")) >= MIN_MASK_AREA))


def _mask_box(df: DataFrame, chosen: g.Box, pad: int, strict: bool) -> DataFrame:
    w, h = F.col("w"), F.col("h")
    df = stage(df, "__k", g.clamp_or_null(chosen, w, h))
    grown = box("__k") if strict or pad <= 0 else g.expand(box("__k"), pad, w, h)
    return stage(df, "m", grown).drop(*(f"__k{e}" for e in EDGES))


def canon_mask_boxes(items: DataFrame, pad: int = 0, strict: bool = True) -> DataFrame:
    """Mask box of each enabled item: recognition box if it is on the page, else main box."""
    live = items.where(F.coalesce("enabled", F.lit(True)))
    live = stage(live, "__o", g.clamp_or_null(box("o"), F.col("w"), F.col("h")))
    df = live.withColumn("fallback", F.col("__ox1").isNull())
    df = _mask_box(df, box("__o").or_else(box()), pad, strict)
    return df.withColumn("used", F.coalesce(g.area(box("m")) >= MIN_MASK_AREA, F.lit(False)) & F.col("mx1").isNotNull())


def canon_mask_stats(masked: DataFrame) -> DataFrame:
    return masked.groupBy("page_id").agg(
        F.count("*").alias("active_item_count"), F.count_if("used").alias("used_ocr_bboxes"),
        F.count_if(F.col("used") & F.col("fallback")).alias("fallback_to_bbox_count"), F.count_if(~F.col("used")).alias("skipped_invalid_bbox_count"))


def item_inpaint_boxes(items: DataFrame) -> DataFrame:
    """Boxes to inpaint per item: explicit ones, then padded ones, first occurrences, none
    huge. Huge ones count only for fallback items without any other box.

    Items bring ``item_id``, ``explicit`` (box structs), boxes ``r*, o*``, no prefix, and
    ``f*``; page in ``w, h``; flag ``fallback``. All boxes of an item are in its row, so
    nothing is shuffled.
    """
    w, h = F.col("w"), F.col("h")

    def cut(b: Column, pad: int = 0) -> Column:
        return g.clamp_swap(g.grow(g.struct_box(b), pad), w, h).struct()

    pads = (("r", BLOCK_PAD), ("o", SMALL_PAD), ("", SMALL_PAD), ("f", max(SMALL_PAD, BLOCK_PAD // 2)))
    df = items
    for p, _ in pads:
        df = stage(df, f"__{p}", g.clamp_swap(box(p), w, h))
    padded = F.array(*(F.when(box(p).x1.isNotNull(), cut(box(f"__{p}").struct(), pad)) for p, pad in pads))
    listed = F.concat(F.transform("explicit", lambda b: cut(b)), padded)
    solid = F.filter(listed, lambda b: b.isNotNull() & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    df = df.select("page_id", "item_id", "fallback", "w", "h", F.array_distinct(solid).alias("__all"))
    huge = lambda share: lambda b: g.is_huge(g.struct_box(b), w, h, share)
    df = df.withColumn("__fine", F.filter("__all", lambda b: ~huge(MAX_SHARE)(b)))
    spare = F.filter("__all", lambda b: ~huge(EMERGENCY_SHARE)(b))
    chosen = F.when((F.size("__fine") == 0) & F.col("fallback"), spare).otherwise(F.col("__fine"))
    return df.select("page_id", "item_id", F.posexplode(chosen).alias("slot", "b")).select(
        "page_id", "item_id", "b.*", F.col("slot").cast("long").alias("slot"))


def masked_pixels(boxes: DataFrame) -> DataFrame:
    """Pixels covered by the union of each page's boxes, overlaps once.

    Boxes are cut at tiles, and a tile is cut into strips at the left and right edges of its boxes (no more than it has
    columns). In a strip every box is a run of rows; a run adds what lies beyond the runs before it. A page with most of the boxes spreads over
    tiles and strips, and runs with one start are one row before the exchange.
    """
    once = boxes.select("page_id", *EDGES).where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).distinct()
    tiled = once.withColumn("tx", F.explode(F.sequence(F.floor(F.col("x1") / TILE_PX), F.floor((F.col("x2") - 1) / TILE_PX)))).withColumn(
        "ty", F.explode(F.sequence(F.floor(F.col("y1") / TILE_PX), F.floor((F.col("y2") - 1) / TILE_PX))))
    at = {"x1": "tx", "x2": "tx", "y1": "ty", "y2": "ty"}
    tile = ["page_id", "tx", "ty"]
    local = tiled.select(*tile, *(F.greatest(F.lit(0), F.least(F.lit(TILE_PX), F.col(e) - F.col(t) * TILE_PX)).cast("int").alias(e) for e, t in at.items()))
    cuts = local.select(*tile, F.explode(F.array("x1", "x2")).alias("x")).groupBy(*tile).agg(F.array_sort(F.collect_set("x")).alias("cuts"))
    own = F.filter("cuts", lambda x: (x >= F.col("x1")) & (x < F.col("x2")))
    runs = local.join(cuts, tile).select(*tile, "y1", "y2", "x2", own.alias("own"))
    width = F.transform("own", lambda x, i: F.struct(x.alias("x"), (F.coalesce(F.get("own", i + 1), F.col("x2")) - x).alias("wide")))
    runs = runs.select(*tile, "y1", "y2", F.explode(width).alias("s")).groupBy(*tile, "s.x", "s.wide", "y1").agg(F.max("y2").alias("y2"))
    before = Window.partitionBy(*tile, "x").orderBy("y1").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("y2") - F.greatest("y1", F.coalesce(F.max("y2").over(before), F.lit(0))))
    painted = runs.select("page_id", (covered * F.col("wide")).cast("long").alias("pixels"))
    return painted.groupBy("page_id").agg(F.sum("pixels").alias("masked_pixel_count"))


def mask_signature(boxes: DataFrame) -> DataFrame:
    """Hash per page that changes with its set of boxes or its size; order does not count."""
    once = boxes.select("page_id", "w", "h", *EDGES).distinct()
    digest = F.md5(F.concat_ws(",", *EDGES))
    keyed = once.withColumns({k: F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for k, at in (("k", 1), ("k2", 16))})
    rolled = keyed.groupBy("page_id", "w", "h").agg(F.bit_xor("k").alias("a"), F.bit_xor("k2").alias("b"), F.count("*").alias("n"))
    return rolled.select("page_id", F.sha2(F.concat_ws(",", "w", "h", "n", "a", "b"), 256).alias("signature"))


# ---------------------------------------------------------------- pixels


def luma(b: Column, gr: Column, r: Column) -> Column:
    return b * LUMA[0] + gr * LUMA[1] + r * LUMA[2]


def luma_profile(pixels: DataFrame) -> DataFrame:
    value = luma(F.col("b"), F.col("g"), F.col("r"))
    out = pixels.groupBy("page_id", "region_id").agg(
        F.percentile(value, F.lit(0.5)).alias("median_luma"), F.stddev_pop(value).alias("std_luma"), F.avg(value).alias("mean_luma"))
    return out.withColumns({
        "dark_text": F.col("median_luma") < 132.0, "dark_mask": F.col("median_luma") < 140.0, "dark_mean": F.col("mean_luma") < 100.0})


def mode_color(pixels: DataFrame) -> DataFrame:
    """Most frequent colour in steps of 8; the lowest one on a tie."""
    step = lambda c: F.floor(F.col(c) / 8) * 8
    counts = pixels.groupBy("page_id", "region_id", step("b").alias("cb"), step("g").alias("cg"), step("r").alias("cr")).agg(F.count("*").alias("n"))
    best = F.min_by(F.struct("cb", "cg", "cr"), F.struct(-F.col("n"), "cb", "cg", "cr"))
    return counts.groupBy("page_id", "region_id").agg(best.alias("c")).select("page_id", "region_id", "c.*")


def peak_color(pixels: DataFrame, bins: int = 32) -> DataFrame:
    """Middle of the fullest bin of each channel."""
    width = 256 // bins
    long = pixels.select("page_id", "region_id", F.explode(F.create_map(*(x for c in "bgr" for x in (F.lit(c), F.col(c))))).alias("channel", "value"))
    counts = long.groupBy("page_id", "region_id", "channel", F.floor(F.col("value") / width).alias("bin")).agg(F.count("*").alias("n"))
    best = counts.groupBy("page_id", "region_id", "channel").agg(F.min_by("bin", F.struct(-F.col("n"), "bin")).alias("bin"))
    value = F.col("bin") * width + width // 2
    return best.groupBy("page_id", "region_id").agg(*(F.max(F.when(F.col("channel") == c, value)).alias(f"peak_{c}") for c in "bgr"))


def row_means(pixels: DataFrame) -> DataFrame:
    out = pixels.groupBy("page_id", "y").agg(F.avg(luma(F.col("b"), F.col("g"), F.col("r"))).alias("mean_luma"))
    return out.withColumn("gutter", is_gutter(F.col("mean_luma")))


def is_gutter(mean: Column) -> Column:
    return (mean > WHITE) | (mean < BLACK)


def gutter_runs(rows: DataFrame) -> DataFrame:
    """Runs of at least ten gutter rows per strip, found by joining neighbours on (strip, y)."""
    gutter = rows.where(is_gutter(F.col("mean_luma"))).select("strip_id", "y")
    first = gutter.join(gutter.select("strip_id", (F.col("y") + 1).alias("y")), ["strip_id", "y"], "left_anti")
    last = gutter.join(gutter.select("strip_id", (F.col("y") - 1).alias("y")), ["strip_id", "y"], "left_anti")
    place = lambda df, name: with_position(df, ["strip_id"], [F.col("y")], [F.floor(F.col("y") / 1024)], "run").withColumnRenamed("y", name)
    runs = place(first, "start").join(place(last, "__l"), ["strip_id", "run"]).withColumn("stop", F.col("__l") + 1)
    return runs.where(F.col("stop") - F.col("start") >= MIN_GUTTER).select(
        "strip_id", "start", "stop", F.floor((F.col("start") + F.col("stop")) / 2).alias("center"))


def gutter_cuts(runs: DataFrame, target: int = TILE) -> DataFrame:
    """Cut rows per strip: run centres far enough from the cut before. Runs per strip are
    bounded by its height."""
    centers = runs.groupBy("strip_id").agg(F.array_sort(F.collect_list("center")).alias("centers"))
    far = max(MIN_CUT, target * 0.7)
    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<bigint>").alias("cuts"))

    def step(acc, c):
        take = c - acc["last"] >= far
        return F.struct(F.when(take, c).otherwise(acc["last"]).alias("last"), F.when(take, F.concat(acc["cuts"], F.array(c))).otherwise(acc["cuts"]).alias("cuts"))

    return centers.select("strip_id", F.aggregate("centers", start, step)["cuts"].alias("cuts"))


def strip_tiles(strips: DataFrame, cuts: DataFrame) -> DataFrame:
    """Tiles of each strip: whole if not tall, else between cuts, else overlapping slices.

    ``strips`` hold ``strip_id, w, h``.
    """
    df = strips.join(cuts, "strip_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    h, zero = F.col("h").cast("long"), F.lit(0).cast("long")
    tall = h / F.col("w") > TALL_RATIO
    edges = F.concat(F.array(zero), "cuts", F.array(h))
    between = F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: F.struct(a.alias("y1"), b.alias("y2")))
    stride = TILE - OVERLAP
    slices = F.transform(
        F.sequence(zero, F.greatest(zero, F.ceil((h - TILE) / stride))), lambda k: F.struct((k * stride).alias("y1"), F.least(k * stride + TILE, h).alias("y2")))
    whole = F.array(F.struct(zero.alias("y1"), h.alias("y2")))
    tiles = F.when(~tall, whole).when(F.size("cuts") > 0, F.filter(between, lambda t: t["y2"] - t["y1"] >= MIN_TILE)).otherwise(
        F.filter(slices, lambda t: t["y2"] - t["y1"] >= MIN_TILE))
    return df.select("strip_id", F.posexplode(tiles).alias("tile_no", "t")).select("strip_id", F.col("tile_no").cast("long").alias("tile_no"), "t.*")


def strip_detections(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """Boxes found per tile (``strip_id, tile_no, local_id``, box, ``score``) as boxes of the strip, each once.

    Boxes move down by the top of their tile and are numbered by tile and place; of boxes that repeat in the overlap of two tiles the best stays.
    """
    moved = found.join(tiles.select("strip_id", "tile_no", F.col("y1").alias("top")), ["strip_id", "tile_no"])
    # the numbering reads the boxes twice, the selection those that are numbered
    moved = saved(moved.withColumns({"y1": F.col("y1") + F.col("top"), "y2": F.col("y2") + F.col("top")}).drop("top"), "moved")
    numbered = with_position(moved, ["strip_id"], [F.col("tile_no"), F.col("local_id")], [F.col("tile_no"), F.floor(F.col("local_id") / 1024)], "region_id")
    return suppress_non_max(saved(numbered.withColumnRenamed("strip_id", "page_id"), "numbered")).withColumnRenamed("page_id", "strip_id")
