"""Page state operators over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import geometry as g
from pagestrata.functions.geometry import EDGES, box
from pagestrata.operators import canon as cn
from pagestrata.plans.q_regions import OWNED, bubbles, layout
from pagestrata.plans.registry import query
from pagestrata.session import saved

O = [f"o{e}" for e in EDGES]
LONG_ARRAY = "array<bigint>"


def canon(v):
    """The canon view with list of ids, position and render box."""
    ref = F.when(F.col("ref_id").isNotNull(), F.array("ref_id")).otherwise(F.array().cast(LONG_ARRAY))
    return v.canon.select("*", F.col("region_id").alias("pos"), ref.alias("region_ids"), *box().named("r"))


@query("active_items", "select page_id, canon_id from fx_canon where enabled", "fx_canon")
def _(v):
    return cn.active(v.canon).select("page_id", "canon_id")


@query("manual_items", "select page_id, canon_id, manual or ocr_edited or render_edited or part_key%31=0 is_manual from fx_canon", "fx_canon")
def _(v):
    source = F.when(F.col("part_key") % 31 == 0, " Manual").otherwise("detector")
    flags = [F.col("manual"), F.col("ocr_edited"), F.col("render_edited")]
    return v.canon.select("page_id", "canon_id", cn.is_manual(flags, source).alias("is_manual"))


@query("canon_ids", """with n as (select page_id, max(region_id)+1 next_number from fx_canon group by 1), p as (select page_id, region_id, row_number() over (partition by page_id order by coalesce(reading_order,1000000000), y1, x1, region_id)-1 pos from fx_canon)
  select p.page_id, p.region_id, 'item_'||lpad(cast(pos as varchar),4,'0') new_id, next_number from p join n using (page_id)""", "fx_canon")
def _(v):
    from pagestrata.operators.ranking import with_page_position

    placed = with_page_position(v.canon, ["page_id"], F.col("reading_order"), F.col("y1"), F.col("x1"), F.col("region_id"))
    return placed.join(cn.next_ids(v.canon), "page_id").select(
        "page_id", "region_id", cn.canon_id(F.col("position")).alias("new_id"), "next_number")


@query("display_ids", "select page_id, region_id, coalesce(bubble_id, ref_id, region_id) display_id, case when kind='bubble' then 'bubble' else 'layout_region' end category from fx_canon", "fx_canon")
def _(v):
    c = canon(v)
    return c.select("page_id", "region_id", cn.display_id(
        F.col("bubble_id"), F.col("region_ids"), F.lit(None).cast("long"), F.col("pos")).alias("display_id"), cn.category(F.col("kind")).alias("category"))


@query("ocr_items_from_canon", """with a as (select *, row_number() over (partition by page_id order by coalesce(reading_order,1000000000), oy1, ox1, region_id)-1 item_id from fx_canon where enabled)
  select page_id, item_id, canon_id, kind, x1, y1, x2, y2, ox1, oy1, ox2, oy2, reading_order from a where kind<>'bubble' or ref_id is not null""", "fx_canon")
def _(v):
    return cn.ocr_items(canon(v))


RESOLVE = """st as (select page_id, region_id item_id, case when part_key%3=0 then canon_id when part_key%3=1 then 'gone' else '' end canon_id, kind,
    case when part_key%4<>0 then bubble_id end bubble_id, case when part_key%5<>0 then ref_id end ref_id, x1+(part_key%7) x1, y1, x2, y2, ox1, oy1, ox2, oy2 from fx_canon),
  m1 as (select page_id, canon_id, min(region_id) m from fx_canon group by 1,2), m2 as (select page_id, bubble_id, min(region_id) m from fx_canon where kind='bubble' group by 1,2),
  m3 as (select page_id, ref_id, min(region_id) m from fx_canon where kind<>'bubble' and ref_id is not null group by 1,2),
  cb as (select page_id, kind, x1, y1, x2, y2, region_id from fx_canon union all select page_id, kind, ox1, oy1, ox2, oy2, region_id from fx_canon),
  sb as (select page_id, item_id, kind, x1, y1, x2, y2 from st union all select page_id, item_id, kind, ox1, oy1, ox2, oy2 from st),
  m4 as (select sb.page_id, sb.item_id, min(cb.region_id) m from sb join cb using (page_id, kind, x1, y1, x2, y2) group by 1,2),
  rs as (select st.page_id, st.item_id, coalesce(m1.m, case when st.kind='bubble' then m2.m else m3.m end, m4.m) as match from st left join m1 on m1.page_id=st.page_id and m1.canon_id=st.canon_id
    left join m2 on m2.page_id=st.page_id and m2.bubble_id=st.bubble_id left join m3 on m3.page_id=st.page_id and m3.ref_id=st.ref_id left join m4 on m4.page_id=st.page_id and m4.item_id=st.item_id)"""


def stage_items(v):
    p, c = F.col("part_key"), canon(v)
    return c.select(
        "page_id", F.col("region_id").alias("item_id"), F.when(p % 3 == 0, F.col("canon_id")).when(p % 3 == 1, "gone").otherwise("").alias("canon_id"),
        "kind", F.when(p % 4 != 0, F.col("bubble_id")).alias("bubble_id"),
        F.when(p % 5 != 0, F.col("region_ids")).otherwise(F.array().cast(LONG_ARRAY)).alias("region_ids"),
        (F.col("x1") + p % 7).alias("x1"), "y1", "x2", "y2", *O, *box("r").keep_if(F.lit(False)).named("r"),
    )


@query("resolve_canon_id", f"with {RESOLVE} select * from rs", "fx_canon")
def _(v):
    v.keep("canon")
    return cn.resolve(stage_items(v), canon(v)).select("page_id", "item_id", "match")


@query("edit_view", f"""with {RESOLVE} select rs.page_id, item_id, canon_id, case when kind='bubble' then 'bubble' else 'layout_region' end category, coalesce(bubble_id, ref_id, item_id) display_id,
  x1, y1, x2, y2, ox1, oy1, ox2, oy2, ox1 saved_ox1, oy1 saved_oy1, ox2 saved_ox2, oy2 saved_oy2, not enabled excluded, not enabled saved_excluded, match is null unmatched
  from rs left join fx_canon c on c.page_id=rs.page_id and c.region_id=rs.match""", "fx_canon")
def _(v):
    v.keep("canon")
    return cn.edit_view(stage_items(v), canon(v))


@query("disabled_layout_items", """select page_id, region_id, greatest(0,least(x1,w)) x1, greatest(0,least(y1,h)) y1, greatest(0,least(x2,w)) x2, greatest(0,least(y2,h)) y2, reading_order from fx_region
  where det_kind='layout' and excluded and (part_key%13=0 or regexp_matches(label,'text|title|caption|content|letter')) and region_id%5<>0
    and least(x2,w)-greatest(0,x1)>=4 and least(y2,h)-greatest(0,y1)>=4""", "fx_region")
def _(v):
    return cn.disabled_items(layout(v), layout(v).where("region_id % 5 = 0"))


# items of one region each never merge: filled sets of region ids must share one
BUILT = f"""{OWNED}, it as (select t.page_id, t.region_id, t.reading_order, raw_x1, raw_y1, bubble_id, case when bubble_id is null then 'layout_text' else 'bubble' end kind,
    coalesce(bx1,t.x1) x1, coalesce(by1,t.y1) y1, coalesce(bx2,t.x2) x2, coalesce(by2,t.y2) y2, case when bubble_id is null then t.x1 else greatest(t.x1,bx1) end ox1, case when bubble_id is null then t.y1 else greatest(t.y1,by1) end oy1,
    case when bubble_id is null then t.x2 else least(t.x2,bx2) end ox2, case when bubble_id is null then t.y2 else least(t.y2,by2) end oy2 from tt t left join own o on o.page_id=t.page_id and o.region_id=t.region_id),
  sl as (select *, true enabled, 0 part, row_number() over (partition by page_id order by coalesce(reading_order,1000000000), oy1, ox1, raw_y1, raw_x1, region_id)-1 slot from it),
  ds as (select page_id, region_id, reading_order, greatest(0,least(x1,w)) x1, greatest(0,least(y1,h)) y1, greatest(0,least(x2,w)) x2, greatest(0,least(y2,h)) y2 from fx_region
    where det_kind='layout' and excluded and (part_key%13=0 or regexp_matches(label,'text|title|caption|content|letter')) and least(x2,w)-greatest(0,x1)>=4 and least(y2,h)-greatest(0,y1)>=4),
  un as (select page_id, kind, enabled, x1, y1, x2, y2, ox1, oy1, ox2, oy2, bubble_id, region_id, reading_order, part, slot from sl
    union all select page_id, 'layout_text', false, x1, y1, x2, y2, x1, y1, x2, y2, null, region_id, reading_order, 1, region_id from ds),
  bu as (select *, row_number() over (partition by page_id order by part, slot)-1 pos from un)"""
BUILT_ID = "'item_'||lpad(cast(pos as varchar),4,'0')"


@query("canon_from_detection", f"with {BUILT} select page_id, kind, enabled, x1, y1, x2, y2, ox1, oy1, ox2, oy2, bubble_id, region_id, reading_order, cast(null as varchar) overlap_group_id, pos, {BUILT_ID} canon_id from bu", "fx_region")
def _(v):
    v.keep("region")
    return cn.from_detection(layout(v), bubbles(v))


@query("derive_mask_boxes", """with i as (select page_id, canon_id, kind, x1, y1, x2, y2, part_key, region_id, w, h from fx_canon),
  own as (select page_id, canon_id, kind, x1 bx1, y1 by1, x2 bx2, y2 by2, unnest([0,1]) slot, x1, y1, x2, y2, w, h from i where part_key%3=0),
  ow as (select page_id, canon_id, kind, slot, bx1, by1, bx2, by2, greatest(0,least(x1-6*(1-slot),w)) x1, greatest(0,least(y1+2,h)) y1, greatest(0,least(x2+9,w)) x2, greatest(0,least(y2,h)) y2 from own),
  o2 as (select page_id, canon_id, slot, case when kind='bubble' then greatest(x1,bx1) else x1 end x1, case when kind='bubble' then greatest(y1,by1) else y1 end y1, case when kind='bubble' then least(x2,bx2) else x2 end x2, case when kind='bubble' then least(y2,by2) else y2 end y2 from ow),
  wh as (select page_id, canon_id, 0 slot, x1, y1, x2, y2 from i where part_key%3<>0 and kind<>'bubble'),
  rg as (select i.page_id, i.canon_id, s.slot, greatest(i.x1,r.x1,0) x1, greatest(i.y1,r.y1,0) y1, least(i.x2,r.x2,i.w) x2, least(i.y2,r.y2,i.h) y2 from (select *, unnest([region_id, region_id+1, region_id]) rid, generate_subscripts([1,2,3],1)-1 slot0 from i where part_key%3<>0 and kind='bubble') i
    join fx_region r on r.page_id=i.page_id and r.region_id=i.rid, lateral (select i.slot0 slot) s)
  select page_id, canon_id, x1, y1, x2, y2, cast(min(slot) as bigint) slot from (select * from o2 union all select * from wh union all select * from rg where x2>x1 and y2>y1) u group by 1,2,3,4,5,6""", "fx_canon fx_region")
def _(v):
    v.keep("region")
    b = box()
    first = g.Box(b.x1 - 6, b.y1 + 2, b.x2 + 9, b.y2).struct()
    second = g.Box(b.x1, b.y1 + 2, b.x2 + 9, b.y2).struct()
    flat = g.Box(b.x1, b.y1, b.x1 + 2, b.y2).struct()
    none = F.array().cast("array<struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>>")
    items = canon(v).withColumns({
        "own_boxes": F.when(F.col("part_key") % 3 == 0, F.array(first, second, flat)).otherwise(none),
        "region_ids": F.array(F.col("region_id"), F.col("region_id") + 1, F.col("region_id")),
    })
    return cn.mask_boxes(items, v.region)


@query("guidance_bubbles", """select page_id, region_id from fx_region r where det_kind='bubble' and exists (select 1 from fx_canon c where c.page_id=r.page_id and c.bubble_id=r.region_id and c.enabled and c.kind='bubble')""", "fx_region fx_canon")
def _(v):
    return cn.guidance_bubbles(bubbles(v), v.canon).select("page_id", "region_id")


COUNTS = """count(*) total, count(*) filter (where enabled) active, count(*) filter (where not enabled) excluded, count(*) filter (where enabled and kind='bubble') active_bubbles,
  count(*) filter (where not enabled and kind='bubble') excluded_bubbles, count(*) filter (where enabled and kind<>'bubble') active_layout_regions, count(*) filter (where not enabled and kind<>'bubble') excluded_layout_regions"""


@query("summarize_canon", f"select page_id, {COUNTS} from fx_canon group by 1", "fx_canon")
def _(v):
    return cn.summarize(v.canon)


@query("summarize_detection", f"""with c as (select * from fx_canon), s as (select page_id, {COUNTS} from c group by 1),
  f as (select page_id, null::bigint total, null::bigint active, null::bigint excluded, count(*) filter (where not excluded and det_kind='bubble') active_bubbles, count(*) filter (where excluded and det_kind='bubble') excluded_bubbles,
    count(*) filter (where not excluded and det_kind<>'bubble') active_layout_regions, count(*) filter (where excluded and det_kind<>'bubble') excluded_layout_regions from fx_region where page_id not in (select page_id from c) group by 1)
  select p.page_id, render_stale edited, total, active, excluded, active_bubbles, excluded_bubbles, active_layout_regions, excluded_layout_regions from fx_page p join (select * from s union all select * from f) u using (page_id)""", "fx_canon fx_region fx_page")
def _(v):
    pages = v.page.select("page_id", F.col("render_stale").alias("edited"))
    return cn.summarize_detection(pages, v.canon, v.region)


# ------------------------------------------------------------- edits

EDITS = """ed as (select page_id, canon_id, case part_key%4 when 0 then 'bbox' when 1 then 'ocr_bbox' when 2 then 'render_bbox' else 'mask' end field,
    x2+part_key%9 e1, y1-3 f1, case when part_key%17=0 then x2+part_key%9+1 else x1-5 end e2, y2+4 f2 from fx_canon where part_key%6<>5),
  nb as (select page_id, canon_id, field, greatest(0,least(least(e1,e2),1000)) x1, greatest(0,least(f1,1400)) y1, greatest(0,least(greatest(e1,e2),1000)) x2, greatest(0,least(f2,1400)) y2, abs(e1-e2)>=4 wide from ed),
  nn as (select *, wide and x2-x1>=4 and y2-y1>=4 good from nb)"""


def _edits(v):
    p = F.col("part_key")
    field = F.when(p % 4 == 0, "bbox").when(p % 4 == 1, "ocr_bbox").when(p % 4 == 2, "render_bbox").otherwise("mask")
    return v.canon.where(p % 6 != 5).select(
        "page_id", "canon_id", field.alias("field"), (F.col("x2") + p % 9).alias("e_x1"), (F.col("y1") - 3).alias("e_y1"),
        F.when(p % 17 == 0, F.col("x2") + p % 9 + 1).otherwise(F.col("x1") - 5).alias("e_x2"), (F.col("y2") + 4).alias("e_y2"),
    )


@query("edit_canon_box", f"""with {EDITS} select c.page_id, c.canon_id, case when good and field='bbox' then n.x1 else c.x1 end x1, case when good and (field='ocr_bbox' or (field='bbox' and not ocr_edited)) then n.x1 else c.ox1 end ox1,
    case when good and (field='render_bbox' or (field='bbox' and not render_edited)) then n.y2 else c.y2 end ry2, coalesce(good and field='bbox',false) bbox_edited, coalesce(good and field='ocr_bbox',false) or ocr_edited ocr_edited,
    case when field='mask' then 'unsupported field' when field is not null and not good then 'invalid box' end edit_error from fx_canon c left join nn n on n.page_id=c.page_id and n.canon_id=c.canon_id""", "fx_canon")
def _(v):
    items = canon(v).withColumn("bbox_edited", F.lit(False))
    return cn.edit_boxes(items, _edits(v)).select("page_id", "canon_id", "x1", "ox1", "ry2", "bbox_edited", "ocr_edited", "edit_error")


@query("edit_mask_boxes", f"""with {EDITS}, mk as (select page_id, canon_id, unnest([0,1]) slot, x1, y1, (x1+x2)//2 x2, y2 from fx_canon where part_key%2=0), f as (select c.page_id, c.canon_id, c.kind, c.region_id, n.field, case when field='bbox' then n.x1 else c.x1 end x1, case when field='bbox' then n.y1 else c.y1 end y1,
    case when field='bbox' then n.x2 else c.x2 end x2, case when field='bbox' then n.y2 else c.y2 end y2, c.w, c.h from fx_canon c join nn n on n.page_id=c.page_id and n.canon_id=c.canon_id where n.good and (n.field='bbox' or (n.field='ocr_bbox' and c.kind='bubble'))),
  m2 as (select page_id, canon_id, slot, case slot when 0 then x1 else x1+7 end x1, y1, x2+slot*9 x2, y2 from mk),
  kept as (select m2.* from m2 where not exists (select 1 from f where f.page_id=m2.page_id and f.canon_id=m2.canon_id)), wh as (select page_id, canon_id, 0 slot, x1, y1, x2, y2 from f where kind<>'bubble'),
  cu as (select f.page_id, f.canon_id, slot, greatest(f.x1,m2.x1,0) x1, greatest(f.y1,m2.y1,0) y1, least(f.x2,m2.x2,w) x2, least(f.y2,m2.y2,h) y2 from f join m2 on m2.page_id=f.page_id and m2.canon_id=f.canon_id where f.kind='bubble' and f.field='bbox'),
  cv as (select page_id, canon_id, min(slot) slot, x1, y1, x2, y2 from cu where x2>x1 and y2>y1 group by page_id, canon_id, x1, y1, x2, y2),
  fb as (select f.page_id, f.canon_id, 0 slot, greatest(f.x1,r.x1,0) x1, greatest(f.y1,r.y1,0) y1, least(f.x2,r.x2,w) x2, least(f.y2,r.y2,h) y2 from (select *, w fw from f) f join (select page_id, region_id, greatest(0,least(x1,1000)) x1, greatest(0,least(y1,1400)) y1, greatest(0,least(x2,1000)) x2, greatest(0,least(y2,1400)) y2 from fx_region) r
    on r.page_id=f.page_id and r.region_id=f.region_id where f.kind='bubble' and not exists (select 1 from cv where cv.page_id=f.page_id and cv.canon_id=f.canon_id))
  select page_id, canon_id, cast(slot as bigint) slot, x1, y1, x2, y2 from (select page_id, canon_id, slot, x1, y1, x2, y2 from kept union all select * from wh union all select page_id, canon_id, slot, x1, y1, x2, y2 from cv union all select * from fb where x2>x1 and y2>y1) u""", "fx_canon fx_region")
def _(v):
    v.keep("region")
    before = canon(v).withColumns({"bbox_edited": F.lit(False), "region_ids": F.array("region_id")})
    mid = F.floor((F.col("x1") + F.col("x2")) / 2)
    masks = v.canon.where("part_key % 2 = 0").select("page_id", "canon_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("slot"), *EDGES).select(
        "page_id", "canon_id", F.col("slot").cast("long").alias("slot"), (F.col("x1") + 7 * F.col("slot")).alias("x1"), "y1", (mid + 9 * F.col("slot")).alias("x2"), "y2")
    return cn.edit_mask_boxes(masks, before, _edits(v), v.region)


@query("detection_edit_marks", """with p as (select distinct page_id from fx_canon where part_key%5=0)
  select page_id, s as stage, case when s='detection' then 'edited' else 'stale' end mark from (select page_id, unnest(['detection','ocr','translation','inpaint','render','export']) s from p) q""", "fx_canon")
def _(v):
    return cn.edit_marks(v.canon.where("part_key % 5 = 0"), "detection", "file")


@query("ocr_edits_on_canon", """with e as (select page_id, canon_id, ox1, oy1, ox2, oy2, part_key%3=0 moved, case when part_key%4=0 then part_key%8=0 end off from fx_ocr)
  select c.page_id, c.canon_id, case when moved then greatest(0, c.ox1+4) else c.ox1 end ox1, coalesce(moved,false) or c.ocr_edited ocr_edited, case when off is not null then not off else c.enabled end enabled,
    case when moved then greatest(0, c.ox1+4) else c.ox1 end item_ox1, coalesce(off, not c.enabled) item_excluded from fx_canon c join e on e.page_id=c.page_id and e.canon_id=c.canon_id""", "fx_ocr fx_canon")
def _(v):
    v.keep("canon")
    p = F.col("part_key")
    # read many times below: met with its parts once
    items = saved(v.ocr.withColumnRenamed("ocr_item_id", "item_id"), "items")
    edits = items.where((p % 3 == 0) | (p % 4 == 0)).select(
        "page_id", "item_id", *g.Box(F.col("ox1") + 4, F.col("oy1"), F.col("ox2"), F.col("oy2")).keep_if(p % 3 == 0).named("e_"), F.when(p % 4 == 0, p % 8 == 0).alias("new_excluded"))
    state, shown = cn.apply_ocr_edits(canon(v).withColumn("bbox_edited", F.lit(False)), items, edits)
    return state.select("page_id", "canon_id", "ox1", "ocr_edited", "enabled").join(
        shown.select("page_id", "canon_id", F.col("ox1").alias("item_ox1"), F.col("excluded").alias("item_excluded")), ["page_id", "canon_id"])


@query("render_style_edits", """select page_id, region_id item_id, part_key%11=0 or part_key%7=0 needs_render, case when part_key%7=0 then '' else 'old' end as error, case when part_key%7=0 then 'font '||cast(part_key%5 as varchar) end font_name,
    case when part_key%7=0 then case when part_key%2=0 then 'fixed' else 'inherit' end end font_size_mode, case when part_key%7=0 then greatest(0, part_key%30-5) end fixed_font_size, case when part_key%7=0 then true end enabled from fx_canon""", "fx_canon")
def _(v):
    p = F.col("part_key")
    items = v.canon.select("page_id", F.col("region_id").alias("item_id"), (p % 11 == 0).alias("needs_render"), F.lit("old").alias("error"))
    none = F.lit(None)
    edits = v.canon.where(p % 7 == 0).select(
        "page_id", F.col("region_id").alias("item_id"), F.lit(False).alias("enabled"), F.lit("").alias("render_text_override"), F.concat(F.lit("font "), (p % 5).cast("string")).alias("font_name"), F.lit("").alias("font_path"),
        F.when(p % 2 == 0, "Fixed").otherwise("odd").alias("font_size_mode"), (p % 30 - 5).cast("string").alias("fixed_font_size"), none.cast("string").alias("min_font_size"), none.cast("string").alias("max_font_size"),
        none.cast("string").alias("writing_mode"), none.cast("string").alias("stroke_enabled"), none.cast("string").alias("stroke_width"), none.cast("string").alias("text_color_mode"), none.cast("array<string>").alias("text_color"),
        none.cast("array<string>").alias("stroke_color"), none.cast("string").alias("line_spacing_ratio"))
    style = F.col("style_overrides")
    return cn.edit_render_style(items, edits).select(
        "page_id", "item_id", "needs_render", "error", style["font_name"].alias("font_name"), style["font_size_mode"].alias("font_size_mode"), style["fixed_font_size"].cast("long").alias("fixed_font_size"), style["enabled"].alias("enabled"))


@query("set_enabled", """select page_id, canon_id, case when part_key%3=0 then part_key%2=0 else enabled end enabled, not case when part_key%3=0 then part_key%2=0 else enabled end excluded from fx_canon""", "fx_canon")
def _(v):
    p = F.col("part_key")
    edits = v.canon.where(p % 3 == 0).select("page_id", "canon_id", (p % 2 == 0).alias("new_enabled"))
    return cn.set_enabled(v.canon, edits).select("page_id", "canon_id", "enabled", "excluded")


def _new_items(v):
    return v.canon.where(F.col("part_key") % 8 == 0).select(
        "page_id", F.col("region_id").alias("slot"), F.when(F.col("part_key") % 16 == 0, "Bubble").otherwise("layout region").alias("kind"),
        "x1", "y1", F.when(F.col("part_key") % 24 == 0, F.col("x1") + 2).otherwise(F.col("x2")).alias("x2"), "y2", "w", "h",
    )


ADDED = """ad as (select page_id, row_number() over (partition by page_id order by region_id)-1 p, case when part_key%16=0 then 'bubble' else 'layout_text' end kind, x1, y1, x2, y2 from fx_canon where part_key%8=0 and part_key%24<>0),
  nx as (select page_id, max(region_id)+1 n from fx_canon group by 1)"""


@query("add_manual_item", f"with {ADDED} select page_id, 'item_'||lpad(cast(n+p as varchar),4,'0') canon_id, kind, x1, y1, x2, y2 from ad join nx using (page_id)", "fx_canon")
def _(v):
    return cn.add_manual(v.canon, _new_items(v)).select("page_id", "canon_id", "kind", *EDGES)


@query("apply_detection_edits", f"""with {ADDED} select page_id, 'item_'||lpad(cast(n+p as varchar),4,'0') canon_id, kind, true enabled, x1, y1, x2, y2, true manual from ad join nx using (page_id)
  union all select page_id, canon_id, kind, case when part_key%5=0 then part_key%10<>0 else enabled end, case when part_key%5=0 then greatest(0,x1-3) else x1 end, y1, x2, y2, manual from fx_canon""", "fx_canon")
def _(v):
    p = F.col("part_key")
    known = v.canon.where(p % 5 == 0).select("page_id", F.col("region_id").alias("slot"), "canon_id", "kind", (F.col("x1") - 3).alias("x1"), "y1", "x2", "y2", (p % 10 == 0).alias("excluded"), "w", "h")
    new = _new_items(v).withColumns({"canon_id": F.lit(""), "excluded": F.lit(False)})
    return cn.apply_detection_edits(canon(v), known.unionByName(new)).select("page_id", "canon_id", "kind", "enabled", *EDGES, "manual")


@query("apply_ocr_edits", """with e as (select *, part_key%3=0 moved, part_key%4=0 asked from fx_ocr)
  select page_id, ocr_item_id item_id, case when moved then ox1+4 else ox1 end ox1, case when asked then part_key%8=0 else excluded end excluded,
    needs_ocr or moved or (asked and (part_key%8=0)<>excluded) needs_ocr, moved bbox_edited,
    case when (moved or (asked and (part_key%8=0)<>excluded)) and not case when asked then part_key%8=0 else excluded end then 'prepared' else status end status from e""", "fx_ocr")
def _(v):
    p = F.col("part_key")
    items = v.ocr.withColumnRenamed("ocr_item_id", "item_id")
    moved = p % 3 == 0
    edits = items.where(moved | (p % 4 == 0)).select(
        "page_id", "item_id", *g.Box(F.col("ox1") + 4, F.col("oy1"), F.col("ox2"), F.col("oy2")).keep_if(moved).named("e_"),
        F.when(p % 4 == 0, p % 8 == 0).alias("new_excluded"),
    )
    return cn.edit_ocr_items(items, edits).select("page_id", "item_id", "ox1", "excluded", "needs_ocr", "bbox_edited", "status")


@query("apply_render_edits", """select page_id, region_id item_id, case when part_key%3=0 then y1+2 else y1 end ry1, case when part_key%5=0 then part_key%2=0 else not enabled end excluded,
    part_key%11=0 or part_key%3=0 or part_key%5=0 or part_key%7=0 needs_render, case when part_key%7=0 then '' else 'old' end error from fx_canon""", "fx_canon")
def _(v):
    p = F.col("part_key")
    items = canon(v).select("page_id", F.col("region_id").alias("item_id"), *box("r"), (~F.col("enabled")).alias("excluded"), (p % 11 == 0).alias("needs_render"), F.lit("old").alias("error"), "w", "h", "part_key")
    edits = v.canon.select(
        "page_id", F.col("region_id").alias("item_id"), *g.Box(F.col("x1"), F.col("y1") + 2, F.col("x2"), F.col("y2")).keep_if(p % 3 == 0).named("e_"),
        F.when(p % 5 == 0, p % 2 == 0).alias("new_excluded"), (p % 7 == 0).alias("new_style"),
    )
    return cn.edit_render_items(items, edits).select("page_id", "item_id", "ry1", "excluded", "needs_render", "error")


@query("edit_ocr_text", """select page_id, ocr_item_id, case when part_key%3=0 then '  ' else text end text, case when part_key%3<>0 and text<>'' then 'done' else 'skipped' end status, false needs_ocr from fx_ocr""", "fx_ocr")
def _(v):
    return cn.edit_ocr_text(v.ocr, F.when(F.col("part_key") % 3 == 0, "  ").otherwise(F.col("text"))).select("page_id", "ocr_item_id", "text", "status", "needs_ocr")


@query("upgrade_canon", f"""with {BUILT} select page_id, row_number() over (partition by page_id order by region_id)-1 pos, canon_id, kind, enabled, x1, y1, x2, y2, ox1, oy1, ox2, oy2 from fx_canon where page_id%3=1
  union all select page_id, pos, {BUILT_ID}, kind, enabled, x1, y1, x2, y2, ox1, oy1, ox2, oy2 from bu where page_id%3<>1""", "fx_region fx_canon")
def _(v):
    v.keep("region")
    pages = v.page.withColumn("schema_version", F.when(F.col("page_id") % 3 == 0, 1).when(F.col("page_id") % 3 == 1, 2))
    items = canon(v).withColumns({"slot": F.col("region_id"), "source_direction": F.lit("")})
    return cn.upgrade(pages, items, layout(v), bubbles(v))
