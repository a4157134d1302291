"""The page's source of truth: items with three boxes, their ids, matches and edits.

Canon tables hold ``page_id, canon_id, pos, kind, enabled``, boxes without prefix and with
``o`` (recognition) and ``r`` (render), ``bubble_id`` and ``region_ids``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import geometry as g
from pagestrata.functions.geometry import EDGES, box, stage
from pagestrata.functions.styles import style_defaults
from pagestrata.operators import regions as reg
from pagestrata.operators.ranking import first_per_key, with_page_position, with_position
from pagestrata.operators.status import propagate_stale
from pagestrata.session import saved

# Fixed values
ID_PREFIX = "item_"
KINDS = ("bubble", "layout_text")
BOX_SETS = ("", "o", "r")


def normal_kind(kind: Column) -> Column:
    cleaned = F.replace(F.lower(F.trim(F.coalesce(kind, F.lit("")))), F.lit(" "), F.lit("_"))
    return F.when(cleaned == "bubble", "bubble").otherwise("layout_text")


def category(kind: Column) -> Column:
    return F.when(normal_kind(kind) == "bubble", "bubble").otherwise("layout_region")


def kind_of_category(name: Column) -> Column:
    return normal_kind(name)


def active(items: DataFrame) -> DataFrame:
    return items.where(F.coalesce("enabled", F.lit(True)))


def is_manual(flags: list[Column], source: Column) -> Column:
    found = F.lower(F.trim(F.coalesce(source, F.lit("")))) == "manual"
    for flag in flags:
        found = found | F.coalesce(flag, F.lit(False))
    return found


def canon_id(position: Column) -> Column:
    return F.format_string(ID_PREFIX + "%04d", position)


def next_ids(items: DataFrame) -> DataFrame:
    """Next free number per page."""
    number = F.regexp_extract("canon_id", rf"^{ID_PREFIX}(\d+)$", 1).try_cast("long")
    return items.groupBy("page_id").agg((F.coalesce(F.max(number), F.lit(-1).cast("long")) + 1).alias("next_number"))


def display_id(bubble_id: Column, region_ids: Column, shown: Column, position: Column) -> Column:
    return F.coalesce(bubble_id, F.try_element_at(region_ids, F.lit(1)), shown, position)


def ocr_items(canon: DataFrame) -> DataFrame:
    """Items to recognise, in page order; ids count the dropped items too."""
    live = active(canon)
    first = box("o").or_else(box())
    numbered = with_page_position(
        stage(live, "__s", first), ["page_id"], F.col("reading_order"), F.col("__sy1"), F.col("__sx1"), F.col("pos"), "item_id"
    )
    fits = F.col("kind").isin(*KINDS) & ((F.col("kind") != "bubble") | (F.size("region_ids") > 0))
    df = stage(numbered.where(fits), "__b", g.clamp_or_null(box(), F.col("w"), F.col("h")))
    df = stage(df, "__o", g.clamp_or_null(box("__s"), F.col("w"), F.col("h")))
    df = df.where(F.col("__bx1").isNotNull() | F.col("__ox1").isNotNull())
    return df.select(
        "page_id", "item_id", "canon_id", "kind", *box("__b").or_else(box("__o")).named(),
        *box("__o").or_else(box("__b")).named("o"), "reading_order",
    )


def _names(df: DataFrame, *cols: str) -> DataFrame:
    """What an item is known by, best first: its id, its bubble or regions. One row per ``step, handle``."""
    kind = normal_kind(F.col("kind"))

    def handle(step: int, part: Column) -> Column:
        return F.struct(F.lit(step).alias("step"), F.coalesce(part.cast("string"), F.lit("")).alias("handle"))

    none = F.array().cast("array<struct<step: int, handle: string>>")
    by_id = F.when(F.coalesce("canon_id", F.lit("")) != "", F.array(handle(1, F.col("canon_id")))).otherwise(none)
    by_bubble = F.when((kind == "bubble") & F.col("bubble_id").isNotNull(), F.array(handle(2, F.col("bubble_id")))).otherwise(none)
    by_region = F.when(kind == "layout_text", F.transform(F.coalesce("region_ids", F.array().cast("array<bigint>")), lambda r: handle(3, r))).otherwise(none)
    every = F.array_distinct(F.concat(by_id, by_bubble, by_region))
    return df.select("page_id", *cols, F.explode(every).alias("h")).select("page_id", *cols, "h.*")


def _places(df: DataFrame, *cols: str) -> DataFrame:
    """The boxes of an item with its kind, one row per ``handle``."""
    boxes = F.filter(F.array(*(box(p).struct() for p in BOX_SETS)), lambda b: b["x1"].isNotNull())
    by_box = F.array_distinct(F.transform(boxes, lambda b: F.concat_ws(",", normal_kind(F.col("kind")), *(b[e].cast("string") for e in EDGES))))
    return df.select("page_id", *cols, F.explode(by_box).alias("handle"))


def _found(stage_items: DataFrame, canon: DataFrame, handles) -> DataFrame:
    """The first canon item that shares the best handle with an item: ``page_id, item_id, match``."""
    known, asked = handles(canon, "pos"), handles(stage_items, "item_id")
    key = [c for c in known.columns if c != "pos"]
    found = asked.join(known.groupBy(*key).agg(F.min("pos").alias("pos")), key)
    best = F.struct(*(c for c in key if c == "step"), "pos")
    return found.groupBy("page_id", "item_id").agg(F.min(best)["pos"].alias("match"))


def resolve(stage_items: DataFrame, canon: DataFrame) -> DataFrame:
    """Match stage items to canon items: by id, by bubble or shared region, by equal box.

    A lookup holds the first canon item per handle, so the join with the items' handles multiplies no rows, and the best step
    with its first item wins. Boxes, the last step and the most handles, are looked up for items that no name has found. Adds
    ``match``, the canon position, NULL without a match.
    """
    key = ["page_id", "item_id"]
    named = saved(_found(stage_items, canon, _names), "named")
    placed = saved(_found(stage_items.join(named, key, "left_anti"), canon, _places), "placed")
    return stage_items.join(named.unionByName(placed), key, "left").select(*stage_items.columns, "match")


def disabled_items(regions: DataFrame, used: DataFrame) -> DataFrame:
    """Excluded text regions no item uses, kept as disabled items.

    ``used`` holds ``page_id, region_id`` of the items' regions.
    """
    out = regions.where(F.coalesce("excluded", F.lit(False)) & reg.is_text_target(F.col("detector"), F.col("label")))
    out = out.join(used.select("page_id", "region_id").distinct(), ["page_id", "region_id"], "left_anti")
    out = g.with_normalized_box(out, box(), "n_", F.col("w"), F.col("h")).where(F.col("n_x1").isNotNull())
    return out.select("page_id", "region_id", *box("n_").named(), "reading_order")


def from_detection(layout: DataFrame, bubbles: DataFrame) -> DataFrame:
    """The page state built from raw detections: work items with overlaps resolved, then
    the disabled ones, numbered in that order."""
    items = saved(reg.detection_items(layout, bubbles), "items").withColumns({
        "idx": F.col("item_id"), "region_ids": F.array("region_id"), "manual": F.lit(False),
    })
    sized = items.join(layout.select("page_id", "w", "h").distinct(), "page_id")
    # resolving reads its items twice, and the numbering what comes out of it
    resolved = reg.resolve_overlaps(saved(sized, "sized"))
    live = resolved.select(
        "page_id", "kind", (~F.col("suppressed")).alias("enabled"), *box().named(), *box("o").named("o"),
        "bubble_id", "region_id", "reading_order", "overlap_group_id", F.lit(0).cast("long").alias("part"), F.col("idx").alias("slot"),
    )
    off = disabled_items(layout, items.select("page_id", "region_id")).select(
        "page_id", F.lit("layout_text").alias("kind"), F.lit(False).alias("enabled"), *box().named(), *box().named("o"),
        F.lit(None).cast("long").alias("bubble_id"), "region_id", "reading_order", F.lit(None).cast("string").alias("overlap_group_id"),
        F.lit(1).cast("long").alias("part"), F.col("region_id").alias("slot"),
    )
    both = with_position(
        saved(live.unionByName(off), "rebuilt"), ["page_id"], [F.col("part"), F.col("slot")], [F.col("part"), F.floor(F.col("slot") / 64)], "pos"
    )
    return both.withColumn("canon_id", canon_id(F.col("pos"))).drop("part", "slot")


def mask_boxes(items: DataFrame, regions: DataFrame) -> DataFrame:
    """Text boxes of each item as rows: its own ones, clipped for bubbles; a bubble without
    any takes its regions' boxes, other text its whole box. First occurrences only.

    Items bring ``own_boxes`` (array of box structs); box and regions are on ``w, h``.
    """
    w, h = F.col("w"), F.col("h")
    base = items.select("page_id", "canon_id", "kind", *box().named("b_"), "own_boxes", "region_ids", "w", "h")
    own = base.select("*", F.posexplode("own_boxes").alias("slot", "s")).select("*", "s.*").drop("s")
    own = g.with_normalized_box(own, box(), "n_", w, h).where(F.col("n_x1").isNotNull())
    has_own = own.select("page_id", "canon_id").distinct()
    plain = own.where("kind <> 'bubble'").select("page_id", "canon_id", "slot", *box("n_").named())

    def clipped(df, prefix):
        df = stage(df, "__i", g.intersect(box(prefix), box("b_"), w, h)).where(F.col("__ix1").isNotNull())
        return df.select("page_id", "canon_id", "slot", *box("__i").named())

    inside = clipped(own.where("kind = 'bubble'"), "n_")
    bare = base.join(has_own, ["page_id", "canon_id"], "left_anti")
    whole = bare.where("kind <> 'bubble'").select("page_id", "canon_id", F.lit(0).alias("slot"), *box("b_").named())
    wanted = bare.where("kind = 'bubble'").select("page_id", "canon_id", *box("b_").named("b_"), "w", "h", F.posexplode("region_ids").alias("slot", "region_id"))
    found = wanted.join(regions.select("page_id", "region_id", *EDGES), ["page_id", "region_id"])
    found = clipped(stage(found, "__k", g.clamp_or_null(box(), w, h)).where(F.col("__kx1").isNotNull()), "__k")
    rows = plain.unionByName(inside).unionByName(whole).unionByName(found)
    return rows.groupBy("page_id", "canon_id", *EDGES).agg(F.min("slot").cast("long").alias("slot"))


def guidance_bubbles(bubbles: DataFrame, canon: DataFrame) -> DataFrame:
    wanted = active(canon).where("kind = 'bubble' and bubble_id is not null").select("page_id", F.col("bubble_id").alias("region_id")).distinct()
    return bubbles.join(wanted, ["page_id", "region_id"], "left_semi")


# ---------------------------------------------------------------- summaries


def summarize(items: DataFrame) -> DataFrame:
    on = F.coalesce("enabled", F.lit(True))
    bubble = category(F.col("kind")) == "bubble"
    return items.groupBy("page_id").agg(
        F.count("*").alias("total"), F.count_if(on).alias("active"), F.count_if(~on).alias("excluded"),
        F.count_if(on & bubble).alias("active_bubbles"), F.count_if(~on & bubble).alias("excluded_bubbles"),
        F.count_if(on & ~bubble).alias("active_layout_regions"), F.count_if(~on & ~bubble).alias("excluded_layout_regions"),
    )


def summarize_detection(pages: DataFrame, canon: DataFrame, regions: DataFrame) -> DataFrame:
    """Canon counts and edit marks; pages without canon count their raw regions."""
    raw = regions.withColumns({"kind": F.when(F.col("det_kind") == "bubble", "bubble").otherwise("layout_text"), "enabled": ~F.col("excluded")})
    left = raw.join(canon.select("page_id").distinct(), "page_id", "left_anti")
    fallback = summarize(left).withColumns({"total": F.lit(None).cast("long"), "active": F.lit(None).cast("long"), "excluded": F.lit(None).cast("long")})
    return pages.join(summarize(canon).unionByName(fallback), "page_id")


# ---------------------------------------------------------------- edits


def latest_edits(log: DataFrame, keys: list[str], fields: list[str], order: Column) -> DataFrame:
    return log.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("__e")).select(*keys, "__e.*")


def edit_boxes(canon: DataFrame, edits: DataFrame) -> DataFrame:
    """Apply one box edit per item (``field`` and box ``e_*``); ``edit_error`` marks bad boxes.

    Moving the main box moves the other boxes unless a user set them.
    """
    flagged = canon if "bbox_edited" in canon.columns else canon.withColumn("bbox_edited", F.lit(False))
    df = flagged.join(edits.select("page_id", "canon_id", "field", *box("e_")), ["page_id", "canon_id"], "left")
    df = g.with_normalized_box(df, box("e_"), "n_", F.col("w"), F.col("h"))
    good, field = F.col("n_x1").isNotNull(), F.col("field")
    moves = {
        "": good & (field == "bbox"),
        "o": good & ((field == "ocr_bbox") | ((field == "bbox") & ~F.col("ocr_edited"))),
        "r": good & ((field == "render_bbox") | ((field == "bbox") & ~F.col("render_edited"))),
    }
    changed = {
        f"{p}{e}": F.when(hit, F.col(f"n_{e}")).otherwise(F.col(f"{p}{e}")) for p, hit in moves.items() for e in EDGES
    }
    flags = {
        name: F.coalesce(good & (field == f), F.lit(False)) | F.coalesce(name, F.lit(False))
        for name, f in (("bbox_edited", "bbox"), ("ocr_edited", "ocr_bbox"), ("render_edited", "render_bbox"))
    }
    known = field.isin("bbox", "ocr_bbox", "render_bbox")
    error = F.when(field.isNotNull() & ~known, "unsupported field").when(field.isNotNull() & ~good, "invalid box")
    return df.withColumn("edit_error", error).withColumns(changed).withColumns(flags).select(
        *flagged.columns, "edit_error"
    )


def set_enabled(canon: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits`` hold ``page_id, canon_id, new_enabled``."""
    joined = canon.join(edits, ["page_id", "canon_id"], "left")
    on = F.coalesce("new_enabled", "enabled")
    return joined.withColumns({"enabled": on, "excluded": ~on}).drop("new_enabled")


def add_manual(canon: DataFrame, new: DataFrame) -> DataFrame:
    """New items (``page_id, slot, kind, box, w, h``) with the next free ids; bad boxes are left out."""
    good = g.with_normalized_box(new, box(), "n_", F.col("w"), F.col("h")).where(F.col("n_x1").isNotNull())
    placed = with_position(good, ["page_id"], [F.col("slot")], [F.floor(F.col("slot") / 64)])
    numbered = placed.join(next_ids(canon), "page_id", "left")
    n = box("n_")
    return numbered.select(
        "page_id", canon_id(F.coalesce("next_number", F.lit(0)) + F.col("position")).alias("canon_id"),
        kind_of_category(F.col("kind")).alias("kind"), F.lit(True).alias("enabled"), F.lit(True).alias("manual"),
        *n.named(), *n.named("o"), *n.named("r"), g.source_direction(n).alias("source_direction"),
    )


def upsert_boxes(canon: DataFrame, edits: DataFrame) -> DataFrame:
    """Upsert of edited boxes: known ids move and switch, rows without an id are added; all columns of ``canon`` and ``edit_error``.

    ``edits`` hold ``page_id, slot, canon_id, kind, box, excluded, w, h``; of several edits of an item the one with the highest slot counts.
    """
    known = edits.where(F.col("canon_id") != "").select(
        "page_id", "canon_id", F.lit("bbox").alias("field"), *box().named("e_"), (~F.col("excluded")).alias("new_enabled"), "slot"
    )
    last = first_per_key(known, ["page_id", "canon_id"], [-F.col("slot")])
    moved = set_enabled(edit_boxes(canon, last), last.select("page_id", "canon_id", "new_enabled"))
    new = edits.where(F.col("canon_id") == "")
    added = add_manual(canon, new)
    size = new.groupBy("page_id").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    both = moved.unionByName(added.join(size, "page_id"), allowMissingColumns=True)
    flags = [c for c in ("manual", "bbox_edited", "ocr_edited", "render_edited") if c in both.columns]
    return both.withColumns({**{c: F.coalesce(c, F.lit(False)) for c in flags}, "excluded": ~F.col("enabled")})


def apply_detection_edits(canon: DataFrame, edits: DataFrame) -> DataFrame:
    """The boxes of the page state after ``upsert_boxes``."""
    cols = ["page_id", "canon_id", "kind", "enabled", *EDGES, *(f"o{e}" for e in EDGES), *(f"r{e}" for e in EDGES), "manual", "edit_error"]
    return upsert_boxes(canon, edits).select(cols)


def edit_marks(edits: DataFrame, stage: str, target: str) -> DataFrame:
    """What edits of a stage mark (``page_id, stage, mark``): their own page as edited, the stages after it as stale."""
    pages = edits.select("page_id", F.lit(stage).alias("edited_stage")).distinct()
    stale = propagate_stale(pages, target).withColumn("mark", F.lit("stale"))
    return pages.select("page_id", F.col("edited_stage").alias("stage"), F.lit("edited").alias("mark")).unionByName(stale)


def edit_mask_boxes(masks: DataFrame, before: DataFrame, edits: DataFrame, regions: DataFrame) -> DataFrame:
    """Text boxes after ``edit_boxes``: rows ``page_id, canon_id, slot`` and box, derived again where an edit moved their ground.

    A moved main box becomes the text box of other text; of a bubble it cuts the text boxes it had. A bubble whose recognition box moved, or which
    has no text box left, takes those of its regions. ``before`` is the page state with ``region_ids``.
    """
    after = edit_boxes(before, edits)
    hit = after.join(edits.select("page_id", "canon_id", "field"), ["page_id", "canon_id"]).where("edit_error is null")
    bubble = F.col("kind") == "bubble"
    hit = saved(hit.where((F.col("field") == "bbox") | (bubble & (F.col("field") == "ocr_bbox"))).select(
        "page_id", "canon_id", "kind", "field", *EDGES, "region_ids", "w", "h"), "moved")
    key = ["page_id", "canon_id"]
    kept = masks.join(hit.select(key), key, "left_anti").select(*key, "slot", *EDGES)
    whole = hit.where(~bubble).select(*key, F.lit(0).cast("long").alias("slot"), *EDGES)
    cut = hit.where(bubble & (F.col("field") == "bbox")).select(*key, *box().named("b_"), "w", "h").join(masks.select(*key, "slot", *EDGES), key)
    cut = stage(cut, "__i", g.intersect(box(), box("b_"), F.col("w"), F.col("h"))).where(F.col("__ix1").isNotNull())
    cut = cut.select(*key, "slot", *box("__i").named()).groupBy(*key, *EDGES).agg(F.min("slot").alias("slot")).select(*key, "slot", *EDGES)
    bare = hit.where(bubble).join(cut.select(key).distinct(), key, "left_anti").withColumn("own_boxes", F.array().cast("array<struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>>"))
    return kept.unionByName(whole).unionByName(cut).unionByName(mask_boxes(bare, regions).select(*key, "slot", *EDGES))


def apply_ocr_edits(canon: DataFrame, items: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Page state and recognition items after edits of the items (``page_id, item_id, e_*, new_excluded``).

    The page state changes first: a moved recognition box and a switched item are set there. The items then show its boxes and
    flags, also those that another edit has changed since, and what moved or switched is to be recognised again.
    """
    asked = items.join(edits, ["page_id", "item_id"])
    boxes = asked.where(F.col("e_x1").isNotNull()).select("page_id", "canon_id", F.lit("ocr_bbox").alias("field"), *box("e_"), "item_id")
    moved = edit_boxes(canon, first_per_key(boxes, ["page_id", "canon_id"], [-F.col("item_id")]).drop("item_id"))
    switched = asked.where(F.col("new_excluded").isNotNull()).select("page_id", "canon_id", (~F.col("new_excluded")).alias("new_enabled"), "item_id")
    state = set_enabled(moved, first_per_key(switched, ["page_id", "canon_id"], [-F.col("item_id")]).drop("item_id"))
    truth = state.select("page_id", "canon_id", *box("o").named("t_"), (~F.col("enabled")).alias("t_excluded"))
    shown = edit_ocr_items(items, edits).join(truth, ["page_id", "canon_id"], "left")
    known = F.col("t_excluded").isNotNull()
    return state, shown.withColumns({
        **{f"o{e}": F.when(known, F.col(f"t_{e}")).otherwise(F.col(f"o{e}")) for e in EDGES}, "excluded": F.coalesce("t_excluded", "excluded"),
    }).drop(*(f"t_{e}" for e in EDGES), "t_excluded")


def edit_render_style(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Store style values (``page_id, item_id`` and the override columns) with an item, coerced, and have it drawn again.

    Items come out with the struct ``style_overrides``; ``enabled`` in it tells whether any value says something.
    """
    fields = [c for c in edits.columns if c not in ("page_id", "item_id")]
    coerced = style_defaults(edits.select("page_id", "item_id", *fields)).withColumn("enabled", F.col("active"))
    new = coerced.select("page_id", "item_id", F.struct(*fields).alias("__style"))
    joined = items.join(new, ["page_id", "item_id"], "left")
    hit = F.col("__style").isNotNull()
    style = F.coalesce("__style", "style_overrides") if "style_overrides" in items.columns else F.col("__style")
    return joined.withColumns({
        "style_overrides": style, "needs_render": F.col("needs_render") | hit, "error": F.when(hit, "").otherwise(F.col("error"))}).drop("__style")


def edit_view(items: DataFrame, canon: DataFrame) -> DataFrame:
    """Stage items as an editor sees them, with the saved box and flag to detect changes."""
    # of an item only its place goes on to the wide side
    found = saved(resolve(items, canon).select("page_id", "item_id", "match"), "matched")
    truth = canon.select(
        "page_id", F.col("pos").alias("match"), *box().named("n_"), *box("o").named("n_o"), F.col("enabled").alias("n_enabled"),
        F.col("canon_id").alias("n_canon_id"), F.col("bubble_id").alias("n_bubble_id"), F.col("region_ids").alias("n_region_ids"),
        F.col("kind").alias("n_kind"),
    )
    df = found.join(truth, ["page_id", "match"], "left")
    return df.select(
        "page_id", "item_id", F.col("n_canon_id").alias("canon_id"), category(F.col("n_kind")).alias("category"),
        display_id(F.col("n_bubble_id"), F.col("n_region_ids"), F.lit(None).cast("long"), F.col("item_id")).alias("display_id"),
        *box("n_").named(), *box("n_o").named("o"), *box("n_o").named("saved_o"),
        (~F.col("n_enabled")).alias("excluded"), (~F.col("n_enabled")).alias("saved_excluded"), F.col("match").isNull().alias("unmatched"),
    )


def edit_ocr_items(items: DataFrame, edits: DataFrame) -> DataFrame:
    """A moved recognition box or switched item must be recognised again.

    Items hold the saved ``o*`` and ``excluded``; ``edits`` the new ``e_*`` and ``new_excluded``.
    """
    df = items.join(edits, ["page_id", "item_id"], "left")
    df = g.with_normalized_box(df, box("e_"), "n_", F.col("w"), F.col("h"))
    asked, good = F.col("e_x1").isNotNull(), F.col("n_x1").isNotNull()
    moved = F.lit(False)
    for e in EDGES:
        moved = moved | ~F.col(f"n_{e}").eqNullSafe(F.col(f"o{e}"))
    moved = asked & good & moved
    off = F.coalesce("new_excluded", "excluded")
    switched = off != F.col("excluded")
    again = moved | switched
    return df.withColumns({"__off": off, "__moved": moved, "__again": again}).withColumns({
        **{f"o{e}": F.when(F.col("__moved"), F.col(f"n_{e}")).otherwise(F.col(f"o{e}")) for e in EDGES},
        "needs_ocr": F.col("needs_ocr") | F.col("__again"), "bbox_edited": F.col("__moved"), "excluded": F.col("__off"),
        "status": F.when(F.col("__again") & ~F.col("__off"), "prepared").otherwise(F.col("status")),
        "edit_error": F.when(asked & ~good, "invalid box"),
    }).select(*items.columns, "bbox_edited", "edit_error")


def edit_render_items(items: DataFrame, edits: DataFrame) -> DataFrame:
    """A moved, switched or restyled item must be drawn again."""
    df = items.join(edits, ["page_id", "item_id"], "left")
    df = g.with_normalized_box(df, box("e_"), "n_", F.col("w"), F.col("h"))
    moved = F.lit(False)
    for e in EDGES:
        moved = moved | ~F.col(f"n_{e}").eqNullSafe(F.col(f"r{e}"))
    moved = F.col("n_x1").isNotNull() & moved
    styled = F.coalesce("new_style", F.lit(False))
    switched = F.col("new_excluded").isNotNull()
    return df.withColumns({"__moved": moved, "__styled": styled, "__switched": switched}).withColumns({
        **{f"r{e}": F.when(F.col("__moved"), F.col(f"n_{e}")).otherwise(F.col(f"r{e}")) for e in EDGES},
        "excluded": F.coalesce("new_excluded", "excluded"),
        "needs_render": F.col("needs_render") | F.col("__moved") | F.col("__styled") | F.col("__switched"),
        "error": F.when(F.col("__styled"), "").otherwise(F.col("error")),
    }).select(*items.columns)


def edit_ocr_text(items: DataFrame, new_text: Column) -> DataFrame:
    text = F.coalesce(new_text, F.lit(""))
    return items.withColumns({
        "status": F.when(F.regexp_replace(text, r"(?U)^\s+|\s+$", "") != "", "done").otherwise("skipped"),
        "text": text, "error": F.lit(""), "needs_ocr": F.lit(False), "manually_edited": F.lit(True),
    })


def split_by_version(pages: DataFrame, version: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pages whose stored state can be read, and pages to rebuild from detections."""
    current = F.coalesce(F.col("schema_version") == version, F.lit(False))
    return pages.where(current), pages.where(~current)


def normalize_items(items: DataFrame) -> DataFrame:
    """Stored items with defaults filled; an item without a usable box is an error row."""
    df = with_position(items.drop("pos"), ["page_id"], [F.col("slot")], [F.floor(F.col("slot") / 64)], "pos")
    df = g.with_normalized_box(df, box(), "n_", F.col("w"), F.col("h"))
    df = g.with_normalized_box(df, box("o"), "no_", F.col("w"), F.col("h"))
    df = g.with_normalized_box(df, box("r"), "nr_", F.col("w"), F.col("h"))
    b = box("n_")
    o = box("no_").or_else(b)
    return df.select(
        "page_id", "pos", F.coalesce(F.when(F.col("canon_id") != "", F.col("canon_id")), canon_id(F.col("pos"))).alias("canon_id"),
        normal_kind(F.col("kind")).alias("kind"), F.coalesce("enabled", F.lit(True)).alias("enabled"), *b.named(), *o.named("o"),
        *box("nr_").or_else(b).named("r"), F.coalesce(F.when(F.col("source_direction") != "", F.col("source_direction")), g.source_direction(o)).alias("source_direction"),
        b.x1.isNull().alias("invalid"),
    )


def upgrade(pages: DataFrame, items: DataFrame, layout: DataFrame, bubbles: DataFrame) -> DataFrame:
    """Readable pages normalised, the others rebuilt; one table."""
    readable, stale = split_by_version(pages)
    cols = ["page_id", "pos", "canon_id", "kind", "enabled", *EDGES, *(f"o{e}" for e in EDGES)]
    kept = normalize_items(items.join(readable.select("page_id"), "page_id", "left_semi")).select(cols)
    pick = lambda df: saved(df.join(stale.select("page_id"), "page_id", "left_semi"), "stale")
    return kept.unionByName(from_detection(pick(layout), pick(bubbles)).select(cols))


