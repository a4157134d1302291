"""Box functions over whole region tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import geometry as g
from pagestrata.functions.geometry import Box, box
from pagestrata.plans.registry import query
from pagestrata.plans.sqltext import area, center_in, cut, inter, iou



def W():
    return F.col("w")


def H():
    return F.col("h")


ID = ["page_id", "region_id"]


def _raw() -> Box:
    return Box(F.col("a1"), F.col("b1"), F.col("a2"), F.col("b2"))


NORMALIZED = """
  parsed as (select page_id, region_id, w, h,
      cast(round_even(try_cast(nullif(trim(a1),'') as double),0) as bigint) p1, cast(round_even(try_cast(nullif(trim(b1),'') as double),0) as bigint) q1,
      cast(round_even(try_cast(nullif(trim(a2),'') as double),0) as bigint) p2, cast(round_even(try_cast(nullif(trim(b2),'') as double),0) as bigint) q2 from fx_rawbox),
  ordered as (select page_id, region_id, w, h, p1 is not null and q1 is not null and p2 is not null and q2 is not null good,
      least(p1,p2) x1, least(q1,q2) y1, greatest(p1,p2) x2, greatest(q1,q2) y2 from parsed),
  sized as (select *, good and x2-x1>=4 and y2-y1>=4 ok from ordered)"""


@query("box_normalize", f"""with {NORMALIZED}
  select page_id, region_id, case when ok then x1 end x1, case when ok then y1 end y1,
    case when ok then x2 end x2, case when ok then y2 end y2 from sized""", "fx_rawbox")
def _(v):
    return g.with_normalized_box(v.rawbox, _raw(), "").select(*ID, *g.EDGES)


@query("box_clamp_or_null", """with c as (select page_id, region_id, greatest(0,least(x1,w)) x1, greatest(0,least(y1,h)) y1,
    greatest(0,least(x2,w)) x2, greatest(0,least(y2,h)) y2 from fx_region), k as (select *, x2>x1 and y2>y1 ok from c)
  select page_id, region_id, case when ok then x1 end x1, case when ok then y1 end y1,
    case when ok then x2 end x2, case when ok then y2 end y2 from k""", "fx_region")
def _(v):
    return v.region.select(*ID, *g.clamp_or_null(box(), W(), H()).named())


@query("box_clamp_swap", """select page_id, region_id,
    least(greatest(0,least(x2,w)),greatest(0,least(x1,w))) x1, least(greatest(0,least(y1,h)),greatest(0,least(y2,h))) y1,
    greatest(greatest(0,least(x2,w)),greatest(0,least(x1,w))) x2, greatest(greatest(0,least(y1,h)),greatest(0,least(y2,h))) y2
  from (select page_id, region_id, w, h, case when region_id%2=0 then x2 else x1 end x1, y1,
    case when region_id%2=0 then x1 else x2 end x2, y2 from fx_region) q""", "fx_region")
def _(v):
    flipped = F.col("region_id") % 2 == 0
    b = Box(F.when(flipped, F.col("x2")).otherwise(F.col("x1")), F.col("y1"),
            F.when(flipped, F.col("x1")).otherwise(F.col("x2")), F.col("y2"))
    return v.region.select(*ID, *g.clamp_swap(b, W(), H()).named())


@query("box_clamp_canon", f"""with {NORMALIZED},
  c as (select page_id, region_id, ok, greatest(0,least(x1,w)) x1, greatest(0,least(y1,h)) y1,
    greatest(0,least(x2,w)) x2, greatest(0,least(y2,h)) y2 from sized),
  k as (select *, ok and x2-x1>=4 and y2-y1>=4 fine from c)
  select page_id, region_id, case when fine then x1 end x1, case when fine then y1 end y1,
    case when fine then x2 end x2, case when fine then y2 end y2 from k""", "fx_rawbox")
def _(v):
    return g.with_normalized_box(v.rawbox, _raw(), "", W(), H()).select(*ID, *g.EDGES)


@query("box_expand", """with e as (select page_id, region_id, greatest(0,least(x1-12,w)) x1, greatest(0,least(y1-12,h)) y1,
    greatest(0,least(x2+12,w)) x2, greatest(0,least(y2+12,h)) y2 from fx_region)
  select page_id, region_id, case when x2>x1 and y2>y1 then x1 end x1, case when x2>x1 and y2>y1 then y1 end y1,
    case when x2>x1 and y2>y1 then x2 end x2, case when x2>x1 and y2>y1 then y2 end y2 from e""", "fx_region")
def _(v):
    return v.region.select(*ID, *g.expand(box(), 12, W(), H()).named())


# a second box next to each region, shifted by its keys
SHIFTED = """shifted as (select page_id, region_id, w, h, x1 a_x1, y1 a_y1, x2 a_x2, y2 a_y2,
    x1 + part_key%60 - 20 b_x1, y1 + supp_key%50 - 15 b_y1, x2 + part_key%45 - 30 b_x2, y2 + supp_key%70 - 40 b_y2 from fx_region)"""


def _shifted(v):
    p, s = F.col("part_key"), F.col("supp_key")
    return v.region.select(
        *ID, "w", "h", *box().named("a_"),
        (F.col("x1") + p % 60 - 20).alias("b_x1"), (F.col("y1") + s % 50 - 15).alias("b_y1"),
        (F.col("x2") + p % 45 - 30).alias("b_x2"), (F.col("y2") + s % 70 - 40).alias("b_y2"),
    )


def A():
    return box("a_")


def B():
    return box("b_")


@query("box_intersect", f"""with {SHIFTED}, c as (select page_id, region_id, greatest(0,least(greatest(a_x1,b_x1),w)) x1,
    greatest(0,least(greatest(a_y1,b_y1),h)) y1, greatest(0,least(least(a_x2,b_x2),w)) x2, greatest(0,least(least(a_y2,b_y2),h)) y2 from shifted)
  select page_id, region_id, case when x2>x1 and y2>y1 then x1 end x1, case when x2>x1 and y2>y1 then y1 end y1,
    case when x2>x1 and y2>y1 then x2 end x2, case when x2>x1 and y2>y1 then y2 end y2 from c""", "fx_region")
def _(v):
    return _shifted(v).select(*ID, *g.intersect(A(), B(), W(), H()).named())


@query("box_measures", f"""with {SHIFTED} select page_id, region_id, cast({area('a_')} as bigint) area_a, cast({inter('a_','b_')} as bigint) common,
    round({iou('a_','b_')},6) iou, round({inter('a_','b_')}/{area('a_')},6) share_a,
    round(case when {area('b_')}>0 then {inter('a_','b_')}/{area('b_')} else 0 end,6) share_b,
    round({inter('a_','b_')}/greatest({area('b_')},1),6) floored_b,
    (a_x1+a_x2)/2.0e0 cx, (a_y1+a_y2)/2.0e0 cy, {center_in('a_','b_',2)} inside from shifted""", "fx_region")
def _(v):
    sa, sb = g.overlap_over_area(A(), B())
    cx, cy = g.center(A())
    return _shifted(v).select(
        *ID, g.area(A()).alias("area_a"), g.overlap_area(A(), B()).alias("common"), F.round(g.iou(A(), B()), 6).alias("iou"),
        F.round(sa, 6).alias("share_a"), F.round(sb, 6).alias("share_b"),
        F.round(g.floored_share(g.overlap_area(A(), B()), g.area(B())), 6).alias("floored_b"),
        cx.alias("cx"), cy.alias("cy"), g.point_in_box(g.center(A()), B(), 2).alias("inside"),
    )


@query("box_near_duplicate", f"""with {SHIFTED}, m as (select *, {inter('a_','b_')} i, {area('a_')} aa, {area('b_')} ab,
    {iou('a_','b_')} u, {center_in('a_','b_')} or {center_in('b_','a_')} mid from shifted)
  select page_id, region_id, i>0 and (u>=0.35 or i/aa>=0.9 or (ab>0 and i/ab>=0.9) or i/greatest(least(aa,ab),1)>=0.8
    or (mid and i/greatest(least(aa,ab),1)>=0.7)) near from m""", "fx_region")
def _(v):
    return _shifted(v).select(*ID, g.is_near_duplicate(A(), B()).alias("near"))


@query("box_flags", f"""select page_id, region_id, case when greatest(1,y2-y1) >= greatest(1,x2-x1)*1.15e0 then 'vertical' else 'horizontal' end direction,
    (x2-x1<40 or y2-y1<45 or {area()}<2500) tiny, {area()} > w*h*0.05e0 huge from fx_region""", "fx_region")
def _(v):
    return v.region.select(
        *ID, g.source_direction(box()).alias("direction"), g.is_tiny(box(), 40, 45, 2500).alias("tiny"),
        g.is_huge(box(), W(), H(), 0.05).alias("huge"),
    )


@query("polygon_to_box", """select page_id, region_id, least(x1, x1-part_key%9, x2+supp_key%7) px1, least(y1+part_key%5, y2, y1-supp_key%11) py1,
    greatest(x1, x1-part_key%9, x2+supp_key%7) px2, greatest(y1+part_key%5, y2, y1-supp_key%11) py2 from fx_region""", "fx_region")
def _(v):
    p, s = F.col("part_key"), F.col("supp_key")
    points = F.array(
        F.array(F.col("x1"), F.col("y1") + p % 5), F.array(F.col("x1") - p % 9, F.col("y2")),
        F.array(F.col("x2") + s % 7, F.col("y1") - s % 11), F.array(F.col("x2")),
    )
    return v.region.select(*ID, g.polygon_box(points).alias("b")).select(*ID, *g.struct_box("b").named("p"))


@query("crop_bounds", """with b as (select page_id, region_id, w, h, part_key, greatest(0,least(x1,w)) x1, greatest(0,least(y1,h)) y1,
      greatest(0,least(x2,w)) x2, greatest(0,least(y2,h)) y2, part_key%3<>0 or part_key%4=1 refined,
      case when part_key%4=1 then x1-5 end lx1, case when part_key%4=1 then y1+2 end ly1, case when part_key%4=1 then x2+9 end lx2, case when part_key%4=1 then y2+4 end ly2,
      case when part_key%6=0 then 20.0e0 end font, case when part_key%5=0 then 'vertical' when part_key%5=1 then 'horizontal' else '' end dir from fx_region),
    f as (select *, coalesce(font, least(greatest(1,x2-x1),greatest(1,y2-y1))) sz,
      case when dir<>'' then dir when greatest(1,y2-y1)>=greatest(1,x2-x1)*1.15e0 then 'vertical' else 'horizontal' end d from b),
    p as (select *, greatest(sz*case when d='vertical' then 0.35e0 else 0.25e0 end, greatest(sz*0.2e0,6)) px,
      greatest(sz*case when d='vertical' then 0.25e0 else 0.35e0 end, greatest(sz*0.2e0,6)) py from f),
    r as (select page_id, region_id, refined, x1, y1, x2, y2, greatest(0,least(cast(round_even(least(x1,lx1)-px,0) as bigint),w)) e1,
      greatest(0,least(cast(round_even(least(y1,ly1)-py,0) as bigint),h)) f1,
      greatest(0,least(cast(round_even(greatest(x2,lx2)+px,0) as bigint),w)) e2, greatest(0,least(cast(round_even(greatest(y2,ly2)+py,0) as bigint),h)) f2 from p)
  select page_id, region_id, case when refined then least(e1,e2) else x1 end x1, case when refined then least(f1,f2) else y1 end y1,
    case when refined then greatest(e1,e2) else x2 end x2, case when refined then greatest(f1,f2) else y2 end y2
  from (select page_id, region_id, refined, least(x1,x2) x1, least(y1,y2) y1, greatest(x1,x2) x2, greatest(y1,y2) y2, e1, f1, e2, f2 from r) z""", "fx_region")
def _(v):
    p = F.col("part_key")
    lines = p % 4 == 1
    line_box = Box(F.col("x1") - 5, F.col("y1") + 2, F.col("x2") + 9, F.col("y2") + 4).keep_if(lines)
    return g.with_crop_bounds(
        v.region, box(), F.when(p % 3 != 0, "comic_text_detector").otherwise("pp_doclayout_v3"), line_box,
        F.when(p % 6 == 0, 20.0), F.when(p % 5 == 0, "vertical").when(p % 5 == 1, "horizontal").otherwise(""), W(), H(), "c_",
    ).select(*ID, *box("c_").named())


@query("roi_to_page", f"""with {SHIFTED} select page_id, region_id, a_x1+b_x1 x1, a_y1+b_y1 y1, a_x2+b_x1 x2, a_y2+b_y1 y2 from shifted""", "fx_region")
def _(v):
    return _shifted(v).select(*ID, *g.roi_to_page(A(), B()).named())


@query("choose_render_box", f"""with s as (select page_id, region_id, kind, w, h, case when part_key%4<>0 then x1 end tx1, y1 ty1, x2 tx2, y2 ty2,
      case when part_key%5<>0 then ox1 end sx1, oy1 sy1, ox2 sx2, oy2 sy2, ox1+2 rx1, oy1+2 ry1, ox2+2 rx2, oy2+2 ry2,
      x1-1 bx1, y1-1 by1, case when part_key%8=0 then x1-40 else x2-1 end bx2, y2-1 by2 from fx_canon),
    o as (select page_id, region_id, kind, {cut("case when sx1 is null then rx1 else sx1 end",'w')} ox1, {cut("case when sx1 is null then ry1 else sy1 end",'h')} oy1,
      {cut("case when sx1 is null then rx2 else sx2 end",'w')} ox2, {cut("case when sx1 is null then ry2 else sy2 end",'h')} oy2,
      {cut("case when tx1 is null then bx1 else tx1 end",'w')} bx1, {cut("case when tx1 is null then by1 else ty1 end",'h')} by1,
      {cut("case when tx1 is null then bx2 else tx2 end",'w')} bx2, {cut("case when tx1 is null then by2 else ty2 end",'h')} by2 from s),
    f as (select *, ox2>ox1 and oy2>oy1 ook, bx2>bx1 and by2>by1 bok from o),
    c as (select *, case when kind='bubble' then case when bok then 'b' when ook then 'o' end else case when ook then 'o' when bok then 'b' end end pick from f)
  select page_id, region_id, case pick when 'b' then bx1 when 'o' then ox1 end x1, case pick when 'b' then by1 when 'o' then oy1 end y1,
    case pick when 'b' then bx2 when 'o' then ox2 end x2, case pick when 'b' then by2 when 'o' then oy2 end y2 from c""", "fx_canon")
def _(v):
    p, o = F.col("part_key"), box("o")
    base = Box(F.col("x1") - 1, F.col("y1") - 1,
               F.when(p % 8 == 0, F.col("x1") - 40).otherwise(F.col("x2") - 1), F.col("y2") - 1)
    return g.with_render_box(
        v.canon, F.col("kind"), box().keep_if(p % 4 != 0), o.keep_if(p % 5 != 0),
        Box(o.x1 + 2, o.y1 + 2, o.x2 + 2, o.y2 + 2), base, W(), H(), "r_",
    ).select(*ID, *box("r_").named())


@query("crop_window", """with s as (select page_id, region_id, w, h, x1, y1, greatest(1,x2-x1) bw, greatest(1,y2-y1) bh from fx_region),
    m as (select *, greatest(bw, cast(round_even(bh*1.0e0,0) as bigint)) base, x1+bw/2.0e0 cx, y1+bh/2.0e0 cy from s),
    z as (select *, greatest(bw, cast(round_even(base*1.7e0,0) as bigint)) gw, greatest(bh, cast(round_even(base/1.0e0*1.7e0,0) as bigint)) gh from m),
    k as (select page_id, region_id, greatest(0,least(cast(round_even(cx-gw/2.0e0,0) as bigint),w)) x1, greatest(0,least(cast(round_even(cy-gh/2.0e0,0) as bigint),h)) y1,
      greatest(0,least(cast(round_even(cx+gw/2.0e0,0) as bigint),w)) x2, greatest(0,least(cast(round_even(cy+gh/2.0e0,0) as bigint),h)) y2 from z)
  select page_id, region_id, case when x2>x1 and y2>y1 then x1 end x1, case when x2>x1 and y2>y1 then y1 end y1,
    case when x2>x1 and y2>y1 then x2 end x2, case when x2>x1 and y2>y1 then y2 end y2 from k""", "fx_region")
def _(v):
    return g.with_crop_window(v.region, box(), W(), H(), "v_").select(*ID, *box("v_").named())


@query("resize_plan", """with s as (select page_id, region_id, (x2-x1)*(1+part_key%9) cw, (y2-y1)*(1+supp_key%7) ch from fx_region),
    p as (select *, cw+24 padded_w, ch+24 padded_h from s),
    f as (select *, case when greatest(padded_w,padded_h)>1000 then 1000.0e0/greatest(padded_w,padded_h) else 1.0e0 end scale,
      case when greatest(cw,ch)>512 then 512.0e0/greatest(cw,ch) else 1.0e0 end s2 from p),
    r as (select *, case when scale<1 and abs(scale-1)>0.01 then greatest(1,cast(round_even(padded_w*scale,0) as bigint)) else padded_w end target_w,
      case when scale<1 and abs(scale-1)>0.01 then greatest(1,cast(round_even(padded_h*scale,0) as bigint)) else padded_h end target_h,
      case when greatest(cw,ch)>512 then greatest(1,cast(round_even(cw*s2,0) as bigint)) else cw end resized_w,
      case when greatest(cw,ch)>512 then greatest(1,cast(round_even(ch*s2,0) as bigint)) else ch end resized_h from f)
  select page_id, region_id, padded_w, padded_h, round(scale,6) scale, target_w, target_h, round(s2,6) inpaint_scale, resized_w, resized_h,
    resized_w + (8-resized_w%8)%8 final_w, resized_h + (8-resized_h%8)%8 final_h from r""", "fx_region")
def _(v):
    sized = v.region.select(
        *ID, ((F.col("x2") - F.col("x1")) * (1 + F.col("part_key") % 9)).alias("cw"),
        ((F.col("y2") - F.col("y1")) * (1 + F.col("supp_key") % 7)).alias("ch"),
    )
    ocr = g.ocr_crop_plan(F.col("cw"), F.col("ch"))
    paint = g.inpaint_size_plan(F.col("cw"), F.col("ch"), 512, 8)
    return sized.select(
        *ID, ocr["padded_w"].alias("padded_w"), ocr["padded_h"].alias("padded_h"),
        F.round(ocr["scale"], 6).alias("scale"), ocr["target_w"].alias("target_w"), ocr["target_h"].alias("target_h"),
        F.round(paint["scale"], 6).alias("inpaint_scale"), paint["resized_w"].alias("resized_w"),
        paint["resized_h"].alias("resized_h"), paint["final_w"].alias("final_w"), paint["final_h"].alias("final_h"),
    )
