"""Masks, pixel statistics and strip cutting over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagestrata.functions import geometry as g
from pagestrata.functions import styles as sy
from pagestrata.functions.geometry import EDGES, box
from pagestrata.operators import masks as mk
from pagestrata.plans.registry import query
from pagestrata.session import saved

CLIP = "greatest(0,least({0}x1{1},w)) x1, greatest(0,least({0}y1{1},h)) y1, greatest(0,least({0}x2{2},w)) x2, greatest(0,least({0}y2{2},h)) y2"


@query("text_mask_boxes", f"""with a as (select page_id, ocr_item_id, w, h, {CLIP.format('o','','')} from fx_ocr where not excluded and status<>'skipped'), b as (select page_id, ocr_item_id, {CLIP.format('','-5','+5')} from a where x2>x1 and y2>y1)
  select * from b where (x2-x1)*(y2-y1)>=16""", "fx_ocr")
def _(v):
    df = mk.text_mask_boxes(v.ocr, pad=5, strict=False, with_skipped=False)
    return df.select("page_id", "ocr_item_id", *box("m").named())


MASKED = """m as (select page_id, region_id, case when part_key%9=0 then x1 else ox1 end x1, case when part_key%9=0 then y1 else oy1 end y1, case when part_key%9=0 then x2 else ox2 end x2, case when part_key%9=0 then y2 else oy2 end y2, part_key%9=0 fallback from fx_canon where enabled),
  u as (select *, (x2-x1)*(y2-y1)>=16 used from m)"""


def _masked(v):
    off = F.col("part_key") % 9 == 0
    items = v.canon.withColumn("ox2", F.when(off, F.col("ox1")).otherwise(F.col("ox2")))
    return mk.canon_mask_boxes(items)


@query("canon_mask_boxes", f"with {MASKED} select page_id, region_id, x1, y1, x2, y2 from u where used", "fx_canon")
def _(v):
    return _masked(v).where("used").select("page_id", "region_id", *box("m").named())


@query("canon_mask_stats", f"with {MASKED} select page_id, count(*) active_item_count, count(*) filter (where used) used_ocr_bboxes, count(*) filter (where used and fallback) fallback_to_bbox_count, count(*) filter (where not used) skipped_invalid_bbox_count from u group by 1", "fx_canon")
def _(v):
    return mk.canon_mask_stats(_masked(v))


@query("item_inpaint_boxes", """with i as (select page_id, region_id item_id, x1, y1, x2, y2, ox1, oy1, ox2, oy2, part_key%2=0 fb, part_key%43=0 big, w, h from fx_canon),
  e as (select page_id, item_id, fb, w, h, 0 slot, 0 pad, x1 a, y1 b, x2 c, y2 d from i where not big union all select page_id, item_id, fb, w, h, 1, 0, x1, y1, x2, y2 from i where not big
    union all select page_id, item_id, fb, w, h, 100, 14, case when big then 0 else x1 end, case when big then 0 else y1 end, case when big then 1000 else x2 end, case when big then 600 else y2 end from i
    union all select page_id, item_id, fb, w, h, 101, 8, ox1, oy1, ox2, oy2 from i where not big union all select page_id, item_id, fb, w, h, 102, 8, x1, y1, x2, y2 from i where not big),
  p as (select page_id, item_id, fb, w, h, slot, greatest(0,least(a-pad,w)) x1, greatest(0,least(b-pad,h)) y1, greatest(0,least(c+pad,w)) x2, greatest(0,least(d+pad,h)) y2 from e),
  o as (select page_id, item_id, fb, w, h, x1, y1, x2, y2, min(slot) slot, (x2-x1)*(y2-y1) a from p where x2>x1 and y2>y1 group by all),
  f as (select * from o where a<=w*h*0.35e0)
  select page_id, item_id, x1, y1, x2, y2, row_number() over (partition by page_id, item_id order by slot)-1 slot from f union all select page_id, item_id, x1, y1, x2, y2, 0 from o where a>w*h*0.35e0 and a<=w*h*0.5e0 and fb and not exists (select 1 from f where f.page_id=o.page_id and f.item_id=o.item_id)""", "fx_canon")
def _(v):
    big = F.col("part_key") % 43 == 0
    none = F.array().cast("array<struct<x1:bigint,y1:bigint,x2:bigint,y2:bigint>>")
    whole = g.Box(*(F.lit(x).cast("long") for x in (0, 0, 1000, 600)))
    items = v.canon.select(
        "page_id", F.col("region_id").alias("item_id"), F.when(big, none).otherwise(F.array(box().struct(), box().struct())).alias("explicit"),
        (F.col("part_key") % 2 == 0).alias("fallback"), "w", "h", *g.Box(*(F.when(big, a).otherwise(b) for a, b in zip(whole, box()))).named("r"),
        *box("o").keep_if(~big).named("o"), *box().keep_if(~big).named(), *box().keep_if(F.lit(False)).named("f"))
    return mk.item_inpaint_boxes(items)


@query("masked_pixels", """with b as (select distinct page_id, ox1 x1, oy1 y1, ox2 x2, oy2 y2 from fx_canon where enabled), c as (select page_id, x1 x from b union select page_id, x2 from b),
  s as (select page_id, x a, lead(x) over (partition by page_id order by x) z from c), j as (select s.page_id, a, z, y1, y2 from s join b on b.page_id=s.page_id and b.x1<=a and b.x2>=z where z is not null),
  m as (select *, max(y2) over (partition by page_id, a order by y1, y2 rows between unbounded preceding and 1 preceding) pm from j)
  select page_id, cast(sum((z-a)*greatest(0,y2-greatest(y1,coalesce(pm,y1)))) as bigint) masked_pixel_count from m group by 1""", "fx_canon")
def _(v):
    return mk.masked_pixels(v.canon.where("enabled").select("page_id", *box("o").named()))


@query("mask_signature", """with o as (select distinct page_id, w, h, x1, y1, x2, y2 from fx_canon where enabled), d as (select *, md5(concat_ws(',',x1,y1,x2,y2)) m from o),
  r as (select page_id, w, h, count(*) n, bit_xor(('0x'||substr(m,1,15))::bigint) a, bit_xor(('0x'||substr(m,16,15))::bigint) b from d group by 1,2,3)
  select page_id, sha256(concat_ws(',',w,h,n,a,b)) signature from r""", "fx_canon")
def _(v):
    return mk.mask_signature(v.canon.where("enabled").select("page_id", "w", "h", *EDGES))


L = "(b*0.114e0+g*0.587e0+r*0.299e0)"


@query("luma_profile", f"""with p as (select page_id, region_id, {L} l from fx_pixel), a as (select page_id, region_id, quantile_cont(l,0.5) m, stddev_pop(l) s, avg(l) e from p group by 1,2)
  select page_id, region_id, round(m,4) median_luma, round(s,4) std_luma, m<132 dark_text, m<140 dark_mask, e<100 dark_mean from a""", "fx_pixel")
def _(v):
    return mk.luma_profile(v.pixel).select(
        "page_id", "region_id", F.round("median_luma", 4).alias("median_luma"), F.round("std_luma", 4).alias("std_luma"), "dark_text", "dark_mask", "dark_mean")


@query("text_color_rule", f"""with p as (select page_id, region_id, {L} l from fx_pixel), a as (select page_id, region_id, quantile_cont(l,0.5) m, stddev_pop(l) s, 40+region_id*37 side, region_id%2=0 o from p group by 1,2),
  k as (select *, m<132 dk, s>=28 cx, greatest(1,cast(round_even(side/40.0e0,0) as bigint)) bs, greatest(1,cast(round_even(side*0.07e0,0) as bigint)) ms from a),
  w as (select *, least(ms, bs+case when dk then (cx or o)::int else o::int end) wd from k)
  select page_id, region_id, case when dk then '255,255,255' else '0,0,0' end text_color, case when dk then '0,0,0' when o or cx then '255,255,255' end stroke_color, greatest(1,cast(round_even(case when o then wd*1.35e0 else wd end,0) as bigint)) stroke_width from w""", "fx_pixel")
def _(v):
    rule = sy.text_color_rule(F.col("median_luma"), F.col("std_luma"), F.col("region_id") * 37 + 40, F.lit(None).cast("boolean"), F.col("region_id") % 2 == 0)
    return mk.luma_profile(v.pixel).select("page_id", "region_id", *(c.alias(n) for n, c in rule.items()))


@query("mode_color", """with c as (select page_id, region_id, b//8*8 cb, g//8*8 cg, r//8*8 cr, count(*) n from fx_pixel group by all)
  select page_id, region_id, cb, cg, cr from (select *, row_number() over (partition by page_id, region_id order by n desc, cb, cg, cr) k from c) q where k=1""", "fx_pixel")
def _(v):
    return mk.mode_color(v.pixel)


@query("peak_color", """with l as (select page_id, region_id, 'b' ch, b//8 bin from fx_pixel union all select page_id, region_id, 'g', g//8 from fx_pixel union all select page_id, region_id, 'r', r//8 from fx_pixel),
  c as (select page_id, region_id, ch, bin, count(*) n from l group by all), k as (select *, row_number() over (partition by page_id, region_id, ch order by n desc, bin) k from c)
  select page_id, region_id, max(bin*8+4) filter (where ch='b') peak_b, max(bin*8+4) filter (where ch='g') peak_g, max(bin*8+4) filter (where ch='r') peak_r from k where k=1 group by 1,2""", "fx_pixel")
def _(v):
    return mk.peak_color(v.pixel)


@query("row_means", f"""select page_id, y, round(avg({L}),6) mean_luma, avg({L})>245 or avg({L})<15 gutter from fx_pixel group by 1,2""", "fx_pixel")
def _(v):
    return mk.row_means(v.pixel).withColumn("mean_luma", F.round("mean_luma", 6))


RUNS = """gr as (select strip_id, y, y-row_number() over (partition by strip_id order by y) k from fx_row where mean_luma>245 or mean_luma<15),
  rn as (select strip_id, min(y) as "start", max(y)+1 as stop from gr group by strip_id, k having count(*)>=10)"""


@query("gutter_runs", f"""with {RUNS} select strip_id, "start", stop, ("start"+stop)//2 center from rn""", "fx_row")
def _(v):
    return mk.gutter_runs(v.row)


CUTS = f"""{RUNS}, ct as (select strip_id, ("start"+stop)//2 c from rn),
  fold as (select strip_id, cast(0 as bigint) last from (select distinct strip_id from ct) q union all select f.strip_id, n.c from fold f, lateral (select min(c) c from ct where ct.strip_id=f.strip_id and c-f.last>=1050) n where n.c is not null)"""


@query("gutter_cuts", f"with recursive {CUTS} select strip_id, last as cut from fold where last>0", "fx_row")
def _(v):
    return mk.gutter_cuts(mk.gutter_runs(v.row)).select("strip_id", F.explode("cuts").alias("cut"))


@query("strip_tiles", f"""with recursive {CUTS}, sz as (select strip_id, count(*) h from fx_row group by 1), hc as (select distinct strip_id from fold where last>0),
  ed as (select strip_id, last y from fold where last>0 union all select strip_id, 0 from hc union all select strip_id, h from sz where strip_id in (select strip_id from hc)),
  bt as (select strip_id, y y1, lead(y) over (partition by strip_id order by y) y2 from ed),
  sl as (select strip_id, k*1300 y1, least(k*1300+1500,h) y2 from sz, lateral (select unnest(range(0, greatest(0,cast(ceil((h-1500)/1300.0) as bigint))+1)) k) z where strip_id not in (select strip_id from hc) and h>3000),
  al as (select strip_id, y1, y2 from bt where y2 is not null and (select h from sz where sz.strip_id=bt.strip_id)>3000 union all select strip_id, y1, y2 from sl union all select strip_id, 0, h from sz where h<=3000)
  select strip_id, row_number() over (partition by strip_id order by y1)-1 tile_no, y1, y2 from al where y2-y1>=50""", "fx_row")
def _(v):
    strips = v.row.groupBy("strip_id").agg(F.count("*").alias("h")).withColumn("w", F.lit(1000))
    return mk.strip_tiles(strips, mk.gutter_cuts(mk.gutter_runs(v.row)))


@query("strip_detections", """with t as (select * from fx_region), b as (select page_id strip_id, region_id, x1, y1, x2, y2, score, region_id%2 tile_no from t where x2>x1 and y2>y1)
  select strip_id, count(*) n from (select distinct strip_id, x1, y1, x2, y2 from b) q group by 1""", "fx_region")
def _(v):
    # every box is found by two tiles that overlap it; a far shift keeps different boxes apart
    far = v.region.where("x2 > x1 and y2 > y1").select("page_id", *EDGES, "score").distinct()
    spread = F.dense_rank().over(Window.partitionBy("page_id").orderBy(*EDGES)) * 10000
    apart = saved(far.groupBy("page_id", *EDGES).agg(F.max("score").alias("score")).withColumn("d", spread), "apart")
    tiles = apart.select(F.col("page_id").alias("strip_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("tile_no")).distinct().withColumn("y1", F.col("tile_no") * 1300)
    found = apart.select(F.col("page_id").alias("strip_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("tile_no"), F.col("d").alias("local_id"), "x1", "x2", "score",
                         (F.col("y1") + F.col("d")).alias("y1"), (F.col("y2") + F.col("d")).alias("y2"))
    found = found.withColumns({"y1": F.col("y1") - F.col("tile_no") * 1300, "y2": F.col("y2") - F.col("tile_no") * 1300})
    return mk.strip_detections(tiles, found).groupBy("strip_id").agg(F.count("*").alias("n"))
