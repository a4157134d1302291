"""Detected regions: normalising, ownership, overlap and selection.

Region tables hold ``page_id, region_id, x1, y1, x2, y2``; ``region_id`` is the input
position. Exact copies of a box are collapsed before any pair join, so a group of
copies costs one row there; the result is spread back to every copy afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import geometry as g
from pagestrata.functions.geometry import EDGES, box, stage
from pagestrata.operators.ranking import first_per_key, reading_key, with_page_position, with_position
from pagestrata.operators.spatial import connected_components, greedy_keep, touching_pairs
from pagestrata.session import saved

# Fixed values
TEXT_LABEL_PARTS = ("text", "title", "caption", "content", "letter")
TEXT_TARGET_DETECTORS = ("ogk_manga_rtdetr", "manual")
LAYOUT_ROLE_PARTS = ("text", "caption", "letter")
BUBBLE_ROLE_PARTS = ("bubble", "balloon", "speech")
OWNER_OVERLAP = 0.50
OWNER_CENTER_OVERLAP = 0.25
COMPONENT_SHARE = 0.10
LAYOUT_MIN_SCORE = 0.25
LAYOUT_MIN_AREA = 64
FULL_PAGE_SHARE = 0.92
TEXT_MIN_CONFIDENCE = 0.3
NMS_IOU = 0.5

PAGE_BOX = ["page_id", *EDGES]


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """True when the text holds one of the plain parts."""
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def clean_label(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(label, F.lit(""))))


def is_text_target(detector: Column, label: Column) -> Column:
    return clean_label(detector).isin(*TEXT_TARGET_DETECTORS) | contains_any(
        clean_label(label), TEXT_LABEL_PARTS
    )


def valid_on_page(df: DataFrame) -> DataFrame:
    """Boxes cut to the page, empty ones left out; the page size is in ``w, h``."""
    df = stage(df, "__k", g.clamp_or_null(box(), F.col("w"), F.col("h"))).where(F.col("__kx1").isNotNull())
    return df.withColumns({e: F.col(f"__k{e}") for e in EDGES}).drop(*(f"__k{e}" for e in EDGES))


def text_targets(regions: DataFrame) -> DataFrame:
    """Active text regions with a usable box."""
    keep = ~F.coalesce("excluded", F.lit(False)) & is_text_target(F.col("detector"), F.col("label"))
    return valid_on_page(regions.where(keep))


def active_bubbles(bubbles: DataFrame) -> DataFrame:
    return valid_on_page(bubbles.where(~F.coalesce("excluded", F.lit(False))))


def one_per_box(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """One row per distinct box of a page, with the lowest ``region_id`` and the copies."""
    return df.groupBy(*PAGE_BOX, *extra).agg(
        F.min("region_id").alias("region_id"), F.count("*").alias("copies")
    )


# ---------------------------------------------------------------- normalising


def label_roles(labels: DataFrame, bubble_names: Sequence[str], layout_names: Sequence[str]) -> DataFrame:
    """Role of each class label: layout names, then bubble names, then parts of the label."""
    def key_of(c: Column) -> Column:
        return F.translate(F.lower(F.trim(F.coalesce(c, F.lit("")))), "- ", "__")

    named = lambda names: [n.strip().lower().replace("-", "_").replace(" ", "_") for n in names if n.strip()]
    key = key_of(F.col("label"))
    role = (
        F.when(key.isin(*named(layout_names)) if named(layout_names) else F.lit(False), "layout")
        .when(key.isin(*named(bubble_names)) if named(bubble_names) else F.lit(False), "bubble")
        .when(contains_any(key, LAYOUT_ROLE_PARTS), "layout")
        .when(contains_any(key, BUBBLE_ROLE_PARTS), "bubble")
    )
    return labels.withColumn("role", role)


def checked_roles(roles: DataFrame) -> DataFrame:
    """The roles, or an error when bubbles or layout text could not be told apart."""
    seen = roles.agg(F.bool_or(F.col("role") == "bubble"), F.bool_or(F.col("role") == "layout")).first()
    if not (seen[0] and seen[1]):
        raise ValueError("class labels give no bubble role or no layout role")
    return roles


def normalize_layout(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Scored layout boxes per page; page-sized ones only where nothing smaller is left."""
    cut = stage(
        raw.where(F.col("score") >= LAYOUT_MIN_SCORE), "__k", g.clamp_swap(box(), F.col("w"), F.col("h"))
    )
    k = box("__k")
    cut = cut.where((k.width > 0) & (k.height > 0) & (g.area(k) >= LAYOUT_MIN_AREA)).select(
        "page_id", "region_id", *k.named(), "score", "label", "reading_order",
        (g.area(k) / F.greatest(F.lit(1), F.col("w") * F.col("h")) <= FULL_PAGE_SHARE).alias("__small"),
    )
    small, big = cut.where("__small"), cut.where(~F.col("__small"))
    kept = small.unionByName(big.join(small.select("page_id").distinct(), "page_id", "left_anti")).drop("__small")
    empty = pages.join(cut.select("page_id").distinct(), "page_id", "left_anti").select(
        "page_id", F.lit(None).cast("long").alias("region_id"), F.lit(0).cast("long").alias("x1"),
        F.lit(0).cast("long").alias("y1"), F.col("w").cast("long").alias("x2"), F.col("h").cast("long").alias("y2"),
        F.lit(1.0).alias("score"), F.lit("full_page").alias("label"), F.lit(0).cast("long").alias("reading_order"),
    )
    ordered = with_page_position(
        kept, ["page_id"], F.col("reading_order"), F.col("y1"), F.col("x1"), F.col("region_id")
    )
    filled = ordered.withColumn("reading_order", F.coalesce("reading_order", "position")).drop("position")
    return filled.unionByName(empty)


def normalize_role_boxes(raw: DataFrame, roles: DataFrame) -> DataFrame:
    """Rounded, cut boxes of the classes with a role, numbered by top and left per role.

    ``roles`` is the class table of one model, ``label, role``; Spark broadcasts it while
    its measured size allows.
    """
    rounded = raw.join(roles.where(F.col("role").isNotNull()), "label")
    rounded = stage(rounded, "__r", g.Box(*(g.half_even(c) for c in box())))
    rounded = stage(rounded, "__k", g.clamp_swap(box("__r"), F.col("w"), F.col("h")))
    k = box("__k")
    kept = rounded.where((k.width > 0) & (k.height > 0)).select(
        "page_id", "region_id", "role", "label", *k.named(), F.coalesce("score", F.lit(1.0)).alias("score")
    )
    return with_position(
        kept, ["page_id", "role"], [F.col("y1"), F.col("x1"), F.col("region_id")], [F.floor(F.col("y1") / 64)]
    )


def normalize_text_detections(raw: DataFrame) -> DataFrame:
    """Confident, non-empty text boxes with detector, direction and font size filled."""
    b, one = box(), F.lit(1).cast("long")
    side = F.least(F.greatest(one, b.width), F.greatest(one, b.height)).cast("double")
    return raw.where((F.col("confidence") >= TEXT_MIN_CONFIDENCE) & (b.width > 0) & (b.height > 0)).withColumns({
        "detector": F.coalesce("detector", F.lit("comic_text_detector")),
        "source_direction": F.coalesce(F.when(F.col("source_direction") != "", F.col("source_direction")), g.source_direction(b)),
        "font_size": F.coalesce(F.col("font_size").cast("double"), side),
    })


def normalize_segmentation(raw: DataFrame) -> DataFrame:
    """Model boxes cut to the page, else the box of the mask; numbered by top and left.

    The mask's box comes as columns ``mx1, my1, mx2, my2``, NULL for an empty mask.
    """
    w, h = F.col("w"), F.col("h")
    df = raw.where(F.col("mx1").isNotNull())
    df = stage(df, "__b", g.clamp_swap(box(), w, h))
    df = stage(df, "__m", g.clamp_swap(box("m"), w, h))
    b, m = box("__b"), box("__m")
    usable = F.coalesce((b.width > 0) & (b.height > 0), F.lit(False))
    df = stage(df, "__f", g.Box(*(F.when(usable, x).otherwise(y) for x, y in zip(b, m))))
    f = box("__f")
    kept = df.where((f.width > 0) & (f.height > 0)).select(
        "page_id", "region_id", *f.named(), F.coalesce("score", F.lit(1.0)).alias("score")
    )
    return with_position(
        kept, ["page_id"], [F.col("y1"), F.col("x1"), F.col("region_id")], [F.floor(F.col("y1") / 64)]
    )


# ---------------------------------------------------------------- ownership


def belongs(region: g.Box, bubble: g.Box) -> Column:
    covered = g.floored_share(g.overlap_area(region, bubble), g.area(region))
    return (covered >= OWNER_OVERLAP) | (
        g.point_in_box(g.center(region), bubble) & (covered >= OWNER_CENTER_OVERLAP)
    )


def assign_owner(regions: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Each region with its best bubble: most covered, then smallest, then first; or none.

    Adds ``bubble_id``, ``overlap`` and the bubble's box ``bx1 .. by2``.
    """
    pairs = touching_pairs(
        regions.select(*PAGE_BOX).distinct(),
        one_per_box(bubbles).select(*PAGE_BOX, "region_id"), ["page_id"], 0, "", "b_",
    )
    r, b = box(), box("b_")
    covered = g.floored_share(g.overlap_area(r, b), g.area(r))
    owned = pairs.where(belongs(r, b)).withColumn("overlap", covered)
    best = owned.groupBy(*PAGE_BOX).agg(
        F.min_by(
            F.struct("b_region_id", "overlap", *b.named()),
            F.struct((-F.col("overlap")).alias("o"), F.greatest(F.lit(1), g.area(b)).alias("a"), "b_region_id"),
        ).alias("__best")
    ).select(
        *PAGE_BOX, F.col("__best.b_region_id").alias("bubble_id"), F.col("__best.overlap").alias("overlap"),
        *g.struct_box("__best").named("b"),
    )
    return regions.join(best, PAGE_BOX, "left")


def owner_candidates(regions: DataFrame, bubbles: DataFrame) -> DataFrame:
    """How many bubbles each owned region could belong to."""
    pairs = touching_pairs(
        regions.select(*PAGE_BOX).distinct(), one_per_box(bubbles).select(*PAGE_BOX, "copies"),
        ["page_id"], 0, "", "b_",
    )
    counts = pairs.where(belongs(box(), box("b_"))).groupBy(*PAGE_BOX).agg(F.sum("b_copies").alias("candidates"))
    return regions.join(counts, PAGE_BOX)


def regions_by_bubble(owned: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Every bubble with its regions, one row each; a bubble without text keeps one row."""
    mine = owned.where(F.col("bubble_id").isNotNull()).select("page_id", "bubble_id", "region_id")
    return bubbles.select("page_id", F.col("region_id").alias("bubble_id")).join(
        mine, ["page_id", "bubble_id"], "left"
    )


def unowned(owned: DataFrame) -> DataFrame:
    return owned.where(F.col("bubble_id").isNull())


def detection_items(regions: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Work items of a page: owned text clipped to its bubble, other text as it is."""
    raw_order = [F.col("y1").alias("raw_y1"), F.col("x1").alias("raw_x1")]
    tagged = text_targets(regions.select("*", *raw_order))
    owned = assign_owner(tagged, active_bubbles(bubbles))
    has = F.col("bubble_id").isNotNull()
    owned = stage(owned, "__i", g.intersect(box(), box("b"), F.col("w"), F.col("h")))
    text_box = box("__i").or_else(box())
    items = owned.select(
        "page_id", "region_id", F.when(has, "bubble").otherwise("layout_text").alias("kind"), "bubble_id",
        "reading_order",
        *g.Box(*(F.when(has, b).otherwise(r) for b, r in zip(box("b"), box()))).named(),
        *text_box.named("o"), "raw_y1", "raw_x1",
    )
    items = items.withColumn("source_direction", g.source_direction(box("o")))
    key = reading_key(F.col("reading_order"))
    # the numbering reads the items twice
    numbered = with_position(
        saved(items, "items"), ["page_id"],
        [key, F.col("oy1"), F.col("ox1"), F.col("raw_y1"), F.col("raw_x1"), F.col("region_id")],
        [key, F.floor(F.col("oy1") / 64)], "item_id",
    )
    return numbered.drop("raw_y1", "raw_x1")


def sanitize_regions(regions: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Text clipped to its bubble, split over several, or freed from a wrong owner.

    ``regions`` bring their earlier ``bubble_id``; pages without bubbles stay as they are.
    """
    valid = valid_on_page(bubbles)
    with_bubbles = valid.select("page_id").distinct()
    untouched = regions.join(with_bubbles, "page_id", "left_anti").select(
        "page_id", "region_id", F.col("region_id").alias("new_id"), *box().named(), "bubble_id",
        F.lit(None).cast("string").alias("reason"),
    )
    # boxes, owners and free regions are read by both kinds of rows, twice each by the numbering
    boxed = saved(valid_on_page(regions.join(with_bubbles, "page_id", "left_semi")).select("page_id", "region_id", *EDGES, "bubble_id"), "boxed")
    pairs = touching_pairs(
        boxed.select(*PAGE_BOX, "region_id", F.col("bubble_id").alias("old")),
        valid.select(*PAGE_BOX, "region_id"), ["page_id"], 0, "", "b_",
    )
    r, b = box(), box("b_")
    covered = g.floored_share(g.overlap_area(r, b), g.area(r))
    owners = pairs.where(g.point_in_box(g.center(r), b) | (covered >= OWNER_OVERLAP)).withColumn("covered", covered)
    counts = saved(owners.groupBy("page_id", "region_id").agg(F.count("*").alias("owners")), "owners")
    owners = owners.join(counts, ["page_id", "region_id"])
    clip = g.common(r, b)
    moved = (clip.x1 != r.x1) | (clip.y1 != r.y1) | (clip.x2 != r.x2) | (clip.y2 != r.y2)
    changed_owner = ~F.col("old").eqNullSafe(F.col("b_region_id"))
    wanted = F.col("old").isNotNull()
    rank_1 = F.when(wanted, F.when(F.col("old") == F.col("b_region_id"), 0.0).otherwise(1.0)).otherwise(-F.col("covered"))
    inside = owners.select(
        "page_id", "region_id", *clip.named(), F.col("b_region_id").alias("bubble_id"),
        F.when(F.col("owners") > 1, "split_across_bubbles")
        .when(moved, "clipped_to_bubble_bbox").when(changed_owner, "assigned_to_bubble_bbox").alias("reason"),
        rank_1.alias("__r1"), F.col("b_region_id").alias("__r2"),
    )
    free = saved(boxed.join(counts, ["page_id", "region_id"], "left_anti").select(
        "page_id", "region_id", *box().named(), F.lit(None).cast("long").alias("bubble_id"),
        F.when(F.col("bubble_id").isNotNull(), "cleared_invalid_bubble_owner").alias("reason"),
        F.lit(0.0).alias("__r1"), F.lit(0).cast("long").alias("__r2"),
    ), "free")
    numbered = with_position(
        inside.unionByName(free), ["page_id"], [F.col("region_id"), F.col("__r1"), F.col("__r2")],
        [F.floor(F.col("region_id") / 64)], "new_id",
    )
    return numbered.drop("__r1", "__r2").unionByName(untouched)


def inside_any_bubble(regions: DataFrame, bubbles: DataFrame, overlap: float = 0.50, pad: int = 4) -> DataFrame:
    """Distinct boxes of the regions that lie in some bubble."""
    pairs = touching_pairs(
        regions.select(*PAGE_BOX).distinct(), bubbles.select(*PAGE_BOX).distinct(), ["page_id"], pad, "", "b_"
    )
    r, b = box(), box("b_")
    covered = g.overlap_area(r, b) / F.greatest(g.area(r), F.lit(1))
    return pairs.where(g.point_in_box(g.center(r), b, pad) | (covered >= overlap)).select(*PAGE_BOX).distinct()


def outside_bubbles(regions: DataFrame, bubbles: DataFrame, overlap: float = 0.50, pad: int = 4) -> DataFrame:
    return regions.join(inside_any_bubble(regions, bubbles, overlap, pad), PAGE_BOX, "left_anti")


def attach_evidence(blocks: DataFrame, fine: DataFrame) -> DataFrame:
    """Each fine region with the first block, by ``block_order``, that covers half of it
    or holds its centre; NULL when none does."""
    ordered = blocks.groupBy(*PAGE_BOX).agg(F.min("block_order").alias("block_order"))
    pairs = touching_pairs(fine.select(*PAGE_BOX).distinct(), ordered, ["page_id"], 2, "", "b_")
    r, b = box(), box("b_")
    hit = pairs.where(
        (g.share(g.overlap_area(r, b), g.area(r)) >= 0.50) | g.point_in_box(g.center(r), b, 2)
    ).groupBy(*PAGE_BOX).agg(F.min("b_block_order").alias("block_order"))
    return fine.join(hit, PAGE_BOX, "left")


def drop_contained(regions: DataFrame) -> DataFrame:
    """Without the regions that lie at least .90 inside another one of no smaller area."""
    boxes = one_per_box(regions)
    slim = boxes.select(*PAGE_BOX, "region_id")
    pairs = touching_pairs(slim, slim, ["page_id"], 0, "", "b_")
    r, b = box(), box("b_")
    covered = pairs.where(
        (F.col("region_id") != F.col("b_region_id"))
        & (g.share(g.overlap_area(r, b), g.area(r)) >= 0.90) & (g.area(r) <= g.area(b))
    ).select(*PAGE_BOX)
    copied = boxes.where((F.col("copies") > 1) & (g.area(box()) > 0)).select(*PAGE_BOX)
    return regions.join(covered.unionByName(copied).distinct(), PAGE_BOX, "left_anti")


# ---------------------------------------------------------------- overlap


def connects(a: g.Box, b: g.Box) -> Column:
    area_a, area_b = F.greatest(F.lit(1), g.area(a)), F.greatest(F.lit(1), g.area(b))
    inter = g.overlap_area(a, b)
    contained = (inter > 0) & (inter / F.least(area_a, area_b) >= COMPONENT_SHARE)
    centred = F.when(area_a <= area_b, g.point_in_box(g.center(a), b)).otherwise(g.point_in_box(g.center(b), a))
    return contained | centred


def _mergeable(a: Column, b: Column) -> Column:
    """Region id sets that are both filled must share an id."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def overlap_edges(items: DataFrame) -> DataFrame:
    """Same-kind items of a page that count as one, as ``src < dst``.

    Items bring ``idx``, ``kind`` and ``region_ids``.
    """
    cols = items.select("page_id", "kind", "idx", *EDGES, "region_ids")
    pairs = touching_pairs(cols, cols, ["page_id", "kind"])
    return pairs.where(
        (F.col("l_idx") < F.col("r_idx")) & connects(box("l_"), box("r_"))
        & _mergeable(F.col("l_region_ids"), F.col("r_region_ids"))
    ).select("page_id", "kind", F.col("l_idx").alias("src"), F.col("r_idx").alias("dst"))


def resolve_overlaps(items: DataFrame) -> DataFrame:
    """Keep the largest item of each component of overlapping items, suppress the others.

    Manual items and kinds other than bubble and layout text take no part. Copies with
    equal box, kind and ids always connect, so one of them stands for all in the joins.
    """
    boxed = stage(items, "__k", g.clamp_or_null(box(), F.col("w"), F.col("h")))
    takes_part = (
        F.col("__kx1").isNotNull() & ~F.coalesce("manual", F.lit(False)) & F.col("kind").isin("bubble", "layout_text")
    )
    # read by the joins of every round below
    candidates = saved(boxed.where(takes_part).select(
        "page_id", "kind", "idx", *box("__k").named(), F.array_sort(F.array_distinct("region_ids")).alias("region_ids")
    ), "candidates")
    shape = ["page_id", "kind", *EDGES, "region_ids"]
    stand_ins = saved(candidates.groupBy(*shape).agg(F.min("idx").alias("idx"), F.count("*").alias("copies")), "standins")
    parts = connected_components(
        stand_ins, overlap_edges(stand_ins), ["page_id", "kind"], "idx", "src", "dst"
    )
    members = saved(parts.withColumn("area", F.greatest(F.lit(1), g.area(box()))), "members")
    groups = members.groupBy("page_id", "kind", "component").agg(
        F.sum("copies").alias("size"),
        F.min_by("idx", F.struct((-F.col("area")).alias("a"), "idx")).alias("winner"),
    )
    first_seen = candidates.groupBy("page_id", "kind").agg(F.min("idx").alias("kind_first"))
    merged = saved(groups.where(F.col("size") > 1).join(first_seen, ["page_id", "kind"]), "groups")
    merged = with_position(
        merged, ["page_id"], [F.col("kind_first"), F.col("component")],
        [F.col("kind_first"), F.floor(F.col("component") / 64)],
    ).select("page_id", "kind", "component", "winner", F.format_string("overlap_%04d", F.col("position") + 1).alias("overlap_group_id"))
    labelled = members.select(*shape, "component").join(merged, ["page_id", "kind", "component"])
    hit = saved(candidates.join(labelled, shape).select("page_id", "idx", "winner", "overlap_group_id"), "hits")
    out = items.join(hit, ["page_id", "idx"], "left")
    lost = F.col("overlap_group_id").isNotNull() & (F.col("winner") != F.col("idx"))
    return out.withColumns({
        "suppressed": lost,
        "suppressed_by": F.when(lost, F.col("winner")),
        "suppression_reason": F.when(lost, "overlap_component_smaller_rect"),
    }).drop("winner")


def suppress_non_max(boxes: DataFrame, threshold: float = NMS_IOU) -> DataFrame:
    """Best-first selection: a box falls to a kept one of higher score with enough IoU.

    Equal scores keep input order. Copies of a box share its fate except the best one.
    """
    solid = boxes.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    flat = boxes.where((F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1")))
    # both sides of the pair join and the result read it
    best = saved(first_per_key(solid, PAGE_BOX, [-F.col("score"), F.col("region_id")]), "best")
    slim = best.select(*PAGE_BOX, "region_id", "score")
    pairs = touching_pairs(slim, slim, ["page_id"])
    stronger = (F.col("l_score") > F.col("r_score")) | (
        (F.col("l_score") == F.col("r_score")) & (F.col("l_region_id") < F.col("r_region_id"))
    )
    edges = pairs.where(stronger & (g.iou(box("l_"), box("r_")) >= threshold)).select(
        "page_id", F.col("l_region_id").alias("strong"), F.col("r_region_id").alias("weak")
    )
    return greedy_keep(best, edges, ["page_id"], "region_id", "strong", "weak").unionByName(flat)


def union_detections(model: DataFrame, dark: DataFrame) -> DataFrame:
    """Model boxes and dark-bubble boxes with a flag, duplicates suppressed where a page
    has dark boxes; ``region_id`` of the dark ones must follow the model's."""
    both = model.withColumn("is_dark", F.lit(False)).unionByName(dark.withColumn("is_dark", F.lit(True)))
    mixed = dark.select("page_id").distinct()
    return suppress_non_max(both.join(mixed, "page_id", "left_semi")).unionByName(
        both.join(mixed, "page_id", "left_anti")
    )


def union_box(boxes: DataFrame, keys: Sequence[str], w: Column, h: Column) -> DataFrame:
    """Box around all boxes of a key, cut to the page."""
    merged = boxes.groupBy(*keys).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")
    )
    return merged.select(*keys, *g.clamp_or_null(box(), w, h).named())


def ordered_distinct(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """First occurrence of each key."""
    return first_per_key(df, keys, [F.col(position)])
