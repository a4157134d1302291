"""Region operators over whole region tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import geometry as g
from pagestrata.functions.geometry import box
from pagestrata.operators import ranking as rk
from pagestrata.operators import regions as r
from pagestrata.plans.registry import query
from pagestrata.plans.sqltext import area, center_in, inter, iou

CUT = """greatest(0,least(x1,w)) x1, greatest(0,least(y1,h)) y1, greatest(0,least(x2,w)) x2, greatest(0,least(y2,h)) y2"""
TARGETS = f"""tt as (select * from (select page_id, region_id, {CUT}, reading_order, w, h, x1 raw_x1, y1 raw_y1 from fx_region
    where det_kind='layout' and not excluded and (part_key%13=0 or regexp_matches(label,'text|title|caption|content|letter'))) q where x2>x1 and y2>y1),
  bb as (select * from (select page_id, region_id, {CUT} from fx_region where det_kind='bubble' and not excluded) q where x2>x1 and y2>y1)"""
OWNED = f"""{TARGETS},
  cand as (select t.page_id, t.region_id, b.region_id bubble_id, b.x1 bx1, b.y1 by1, b.x2 bx2, b.y2 by2,
      {inter('t.','b.')}/greatest(1,{area('t.')}) ov, {area('b.')} ba, {center_in('t.','b.')} mid
    from tt t join bb b using (page_id) where {inter('t.','b.')}>0),
  own as (select * from (select *, row_number() over (partition by page_id, region_id order by ov desc, ba, bubble_id) rn
    from cand where ov>=0.5 or (mid and ov>=0.25)) z where rn=1)"""


def layout(v):
    return v.region.where("det_kind = 'layout'").withColumn(
        "detector", F.when(F.col("part_key") % 13 == 0, "manual")
    )


def bubbles(v):
    return v.region.where("det_kind = 'bubble'")


def owned(v):
    return r.assign_owner(r.text_targets(layout(v)), r.active_bubbles(bubbles(v)))


@query("text_targets", f"with {TARGETS} select page_id, region_id, x1, y1, x2, y2 from tt", "fx_region")
def _(v):
    return r.text_targets(layout(v)).select("page_id", "region_id", *g.EDGES)


@query("assign_owner", f"""with {OWNED} select t.page_id, t.region_id, bubble_id, round(ov,6) as overlap from tt t
  left join own o on o.page_id=t.page_id and o.region_id=t.region_id""", "fx_region")
def _(v):
    return owned(v).select("page_id", "region_id", "bubble_id", F.round("overlap", 6).alias("overlap"))


@query("owner_summary", f"""with {OWNED}, p as (select page_id, count(*) bubbles from bb group by 1),
  a as (select t.page_id, count(bubble_id) owned, count(*)-count(bubble_id) unowned, round(avg(ov),6) mean_overlap
    from tt t left join own o on o.page_id=t.page_id and o.region_id=t.region_id group by 1)
  select page_id, coalesce(bubbles,0) bubbles, coalesce(owned,0) owned, coalesce(unowned,0) unowned, mean_overlap from p full join a using (page_id)""", "fx_region")
def _(v):
    per_page = owned(v).groupBy("page_id").agg(
        F.count("bubble_id").alias("owned"), F.count_if(F.col("bubble_id").isNull()).alias("unowned"),
        F.round(F.avg("overlap"), 6).alias("mean_overlap"),
    )
    seen = r.active_bubbles(bubbles(v)).groupBy("page_id").agg(F.count("*").alias("bubbles"))
    return seen.join(per_page, "page_id", "full").na.fill(0, ["bubbles", "owned", "unowned"])


@query("owner_candidates", f"""with {OWNED} select page_id, region_id, count(*) candidates from cand
  where ov>=0.5 or (mid and ov>=0.25) group by 1,2""", "fx_region")
def _(v):
    return r.owner_candidates(r.text_targets(layout(v)), r.active_bubbles(bubbles(v))).select(
        "page_id", "region_id", "candidates"
    )


@query("regions_by_bubble", f"""with {OWNED} select b.page_id, b.region_id bubble_id, o.region_id from bb b
  left join own o on o.page_id=b.page_id and o.bubble_id=b.region_id""", "fx_region")
def _(v):
    return r.regions_by_bubble(owned(v), r.active_bubbles(bubbles(v)))


@query("unowned_regions", f"""with {OWNED} select t.page_id, t.region_id from tt t
  anti join own o on o.page_id=t.page_id and o.region_id=t.region_id""", "fx_region")
def _(v):
    return r.unowned(owned(v)).select("page_id", "region_id")


@query("detection_items", f"""with {OWNED}, i as (select t.page_id, t.region_id, t.reading_order, raw_x1, raw_y1, bubble_id,
    case when bubble_id is null then 'layout_text' else 'bubble' end kind,
    coalesce(bx1,t.x1) x1, coalesce(by1,t.y1) y1, coalesce(bx2,t.x2) x2, coalesce(by2,t.y2) y2,
    case when bubble_id is null then t.x1 else greatest(t.x1,bx1) end ox1, case when bubble_id is null then t.y1 else greatest(t.y1,by1) end oy1,
    case when bubble_id is null then t.x2 else least(t.x2,bx2) end ox2, case when bubble_id is null then t.y2 else least(t.y2,by2) end oy2
    from tt t left join own o on o.page_id=t.page_id and o.region_id=t.region_id)
  select page_id, region_id, kind, bubble_id, reading_order, x1, y1, x2, y2, ox1, oy1, ox2, oy2,
    case when greatest(1,oy2-oy1)>=greatest(1,ox2-ox1)*1.15e0 then 'vertical' else 'horizontal' end source_direction,
    row_number() over (partition by page_id order by coalesce(reading_order,1000000000), oy1, ox1, raw_y1, raw_x1, region_id)-1 item_id from i""", "fx_region")
def _(v):
    return r.detection_items(layout(v), bubbles(v))


@query("sanitize_regions", f"""with b as (select * from (select page_id, region_id, {CUT} from fx_region where det_kind='bubble') q where x2>x1 and y2>y1),
  raw as (select page_id, region_id, x1, y1, x2, y2, w, h, case when part_key%3=0 then supp_key%24 end old from fx_region where det_kind='layout'),
  t as (select * from (select page_id, region_id, old, {CUT} from raw where page_id in (select page_id from b)) q where x2>x1 and y2>y1),
  p as (select t.page_id, t.region_id, t.old, t.x1, t.y1, t.x2, t.y2, b.region_id bid, greatest(t.x1,b.x1) cx1, greatest(t.y1,b.y1) cy1, least(t.x2,b.x2) cx2, least(t.y2,b.y2) cy2,
      {inter('t.','b.')}/greatest(1,{area('t.')}) ov from t join b using (page_id) where {center_in('t.','b.')} or {inter('t.','b.')}/greatest(1,{area('t.')})>=0.5),
  n as (select *, count(*) over (partition by page_id, region_id) c from p),
  o as (select page_id, region_id, cx1 x1, cy1 y1, cx2 x2, cy2 y2, bid bubble_id, case when c>1 then 'split_across_bubbles'
      when cx1<>x1 or cy1<>y1 or cx2<>x2 or cy2<>y2 then 'clipped_to_bubble_bbox' when old is distinct from bid then 'assigned_to_bubble_bbox' end reason,
      case when old is not null then case when old=bid then 0 else 1 end else -ov end r1, bid r2 from n),
  f as (select page_id, region_id, x1, y1, x2, y2, cast(null as bigint) bubble_id, case when old is not null then 'cleared_invalid_bubble_owner' end reason, 0 r1, 0 r2
    from t anti join p on p.page_id=t.page_id and p.region_id=t.region_id),
  u as (select * from o union all select * from f)
  select page_id, region_id, x1, y1, x2, y2, bubble_id, reason, row_number() over (partition by page_id order by region_id, r1, r2)-1 new_id from u
  union all select page_id, region_id, x1, y1, x2, y2, old, null, region_id from raw where page_id not in (select page_id from b)""", "fx_region")
def _(v):
    v.keep("region")
    claimed = layout(v).withColumn("bubble_id", F.when(F.col("part_key") % 3 == 0, F.col("supp_key") % 24))
    return r.sanitize_regions(claimed, bubbles(v)).select(
        "page_id", "region_id", "new_id", *g.EDGES, "bubble_id", "reason"
    )


# ------------------------------------------------------------- normalising


def _with_page_boxes(v):
    whole = F.col("part_key") % 37 == 0
    return layout(v).withColumns({
        "x1": F.when(whole, 0).otherwise(F.col("x1")), "y1": F.when(whole, 0).otherwise(F.col("y1")),
        "x2": F.when(whole, 1000).otherwise(F.col("x2")), "y2": F.when(whole, 1390).otherwise(F.col("y2")),
    })


@query("normalize_layout", f"""with raw as (select page_id, region_id, w, h, score, label, reading_order, case when part_key%37=0 then 0 else x1 end x1, case when part_key%37=0 then 0 else y1 end y1,
    case when part_key%37=0 then 1000 else x2 end x2, case when part_key%37=0 then 1390 else y2 end y2 from fx_region where det_kind='layout'),
  c as (select page_id, region_id, w, h, score, label, reading_order, {CUT} from raw where score>=0.25),
  k as (select *, {area()}/(w*h)<=0.92 small from c where x2>x1 and y2>y1 and {area()}>=64),
  f as (select *, max(cast(small as int)) over (partition by page_id) any_small from k),
  o as (select *, row_number() over (partition by page_id order by coalesce(reading_order,1000000000), y1, x1, region_id)-1 pos from f where small or any_small=0)
  select page_id, region_id, x1, y1, x2, y2, score, label, coalesce(reading_order,pos) reading_order from o
  union all select page_id, null, 0, 0, w, h, 1.0, 'full_page', 0 from fx_page p where page_id not in (select page_id from o)""", "fx_region fx_page")
def _(v):
    return r.normalize_layout(_with_page_boxes(v), v.page)


ROLE_SQL = """case when label in ('doc_title','table') then 'layout' when label in ('caption') then 'bubble' when regexp_matches(label,'text|caption|letter') then 'layout'
    when regexp_matches(label,'bubble|balloon|speech') then 'bubble' end"""


def _roles(v):
    labels = v.region.select("label").distinct()
    return r.label_roles(labels, ["Caption"], ["DOC-title", "table"])


@query("label_roles", f"select label, {ROLE_SQL} as role from (select distinct label from fx_region) q", "fx_region")
def _(v):
    return _roles(v)


@query("normalize_role_boxes", f"""with k as (select page_id, region_id, label, {ROLE_SQL} as role, w, h, score,
    cast(round_even(x1+(part_key%4)*0.25e0,0) as bigint) x1, cast(round_even(y1+(supp_key%2)*0.5e0,0) as bigint) y1,
    cast(round_even(x2+(part_key%2)*0.5e0,0) as bigint) x2, cast(round_even(y2+(supp_key%4)*0.25e0,0) as bigint) y2 from fx_region),
  c as (select page_id, region_id, label, role, score, {CUT} from k where role is not null)
  select *, row_number() over (partition by page_id, role order by y1, x1, region_id)-1 as position from c where x2>x1 and y2>y1""", "fx_region")
def _(v):
    p, s = F.col("part_key"), F.col("supp_key")
    raw = v.region.withColumns({
        "x1": F.col("x1") + (p % 4) * 0.25, "y1": F.col("y1") + (s % 2) * 0.5,
        "x2": F.col("x2") + (p % 2) * 0.5, "y2": F.col("y2") + (s % 4) * 0.25,
    })
    return r.normalize_role_boxes(raw, r.checked_roles(_roles(v))).select(
        "page_id", "region_id", "label", "role", "score", *g.EDGES, "position"
    )


@query("normalize_text_detections", """select page_id, region_id, x1, y1, x2, y2, score confidence,
    case when part_key%7=0 then 'manual' else 'comic_text_detector' end detector,
    case when part_key%5=0 then 'vertical' when greatest(1,y2-y1)>=greatest(1,x2-x1)*1.15e0 then 'vertical' else 'horizontal' end source_direction,
    case when part_key%6=0 then 21.5e0 else cast(least(greatest(1,x2-x1),greatest(1,y2-y1)) as double) end font_size
  from (select page_id, region_id, x1, y1, case when part_key%31=0 then x1 else x2 end x2, y2, score, part_key from fx_region where det_kind='layout') q
  where score>=0.3 and x2>x1 and y2>y1""", "fx_region")
def _(v):
    p = F.col("part_key")
    raw = layout(v).select(
        "page_id", "region_id", "x1", "y1", F.when(p % 31 == 0, F.col("x1")).otherwise(F.col("x2")).alias("x2"), "y2",
        F.col("score").alias("confidence"), F.when(p % 7 == 0, "manual").alias("detector"),
        F.when(p % 5 == 0, "vertical").otherwise("").alias("source_direction"), F.when(p % 6 == 0, 21.5).alias("font_size"),
    )
    return r.normalize_text_detections(raw)


@query("normalize_segmentation", f"""with raw as (select page_id, region_id, w, h, score, case when part_key%9=0 then null when part_key%11=0 then x2 else x1 end x1, y1, x2, y2,
    case when supp_key%13<>0 then x1+3 end mx1, y1+4 my1, x2-5 mx2, y2-6 my2 from fx_region where det_kind='bubble'),
  c as (select page_id, region_id, score, greatest(0,least(x1,w)) x1, greatest(0,least(y1,h)) y1, greatest(0,least(x2,w)) x2, greatest(0,least(y2,h)) y2, x1 is null nobox,
    greatest(0,least(mx1,w)) mx1, greatest(0,least(my1,h)) my1, greatest(0,least(mx2,w)) mx2, greatest(0,least(my2,h)) my2 from raw where mx1 is not null),
  f as (select page_id, region_id, score, not nobox and x2>x1 and y2>y1 ok, x1, y1, x2, y2, mx1, my1, mx2, my2 from c),
  k as (select page_id, region_id, case when ok then x1 else mx1 end x1, case when ok then y1 else my1 end y1, case when ok then x2 else mx2 end x2, case when ok then y2 else my2 end y2,
    coalesce(case when region_id%4=0 then null else score end,1.0) score from f)
  select *, row_number() over (partition by page_id order by y1, x1, region_id)-1 as position from k where x2>x1 and y2>y1""", "fx_region")
def _(v):
    p, s = F.col("part_key"), F.col("supp_key")
    has_box, flat = p % 9 != 0, p % 11 == 0
    raw = bubbles(v).select(
        "page_id", "region_id", "w", "h", F.when(F.col("region_id") % 4 != 0, F.col("score")).alias("score"),
        *g.Box(F.when(flat, F.col("x2")).otherwise(F.col("x1")), F.col("y1"), F.col("x2"), F.col("y2")).keep_if(has_box).named(),
        F.when(s % 13 != 0, F.col("x1") + 3).alias("mx1"), (F.col("y1") + 4).alias("my1"),
        (F.col("x2") - 5).alias("mx2"), (F.col("y2") - 6).alias("my2"),
    )
    return r.normalize_segmentation(raw)


# ------------------------------------------------------------- predicates and joins


@query("outside_bubbles", f"""with b as (select page_id, x1, y1, x2, y2 from fx_region where det_kind='bubble')
  select page_id, region_id from fx_region t where det_kind='layout' and not exists (select 1 from b where b.page_id=t.page_id
    and ({center_in('t.','b.',4)} or {inter('t.','b.')}/greatest({area('t.')},1)>=0.5))""", "fx_region")
def _(v):
    return r.outside_bubbles(layout(v), bubbles(v)).select("page_id", "region_id")


@query("attach_evidence", f"""with b as (select page_id, x1, y1, x2, y2, region_id bo from fx_region where det_kind='layout' and label='table'),
  f as (select * from fx_region where det_kind='layout' and label<>'table'),
  m as (select f.page_id, f.region_id, min(bo) bo from f join b using (page_id) where {inter('f.','b.')}/{area('f.')}>=0.5 or {center_in('f.','b.',2)} group by 1,2)
  select f.page_id, f.region_id, bo block_order from f left join m on m.page_id=f.page_id and m.region_id=f.region_id""", "fx_region")
def _(v):
    blocks = layout(v).where("label = 'table'").select("page_id", *g.EDGES, F.col("region_id").alias("block_order"))
    return r.attach_evidence(blocks, layout(v).where("label <> 'table'")).select("page_id", "region_id", "block_order")


@query("drop_contained", f"""with t as (select page_id, region_id, x1, y1, x2, y2 from fx_region union all
    select page_id, region_id+1000000, x1+4, y1+4, x2-case when part_key%2=0 then 4 else -90 end, y2-4 from fx_region where part_key%5=0
    union all select page_id, region_id+2000000, x1, y1, x2, y2 from fx_region where part_key%41=0)
  select a.page_id, a.region_id from t a where not exists (select 1 from t b where b.page_id=a.page_id and b.region_id<>a.region_id
    and {inter('a.','b.')}>0 and {inter('a.','b.')}/{area('a.')}>=0.9 and {area('a.')}<={area('b.')})""", "fx_region")
def _(v):
    p, c = F.col("part_key"), F.col
    both = each_as(v.region, ["region_id", *g.EDGES], [
        (None, [c("region_id"), *g.box()]),
        (p % 5 == 0, [c("region_id") + 1000000, c("x1") + 4, c("y1") + 4, c("x2") - F.when(p % 2 == 0, 4).otherwise(-90), c("y2") - 4]),
        (p % 41 == 0, [c("region_id") + 2000000, *g.box()]),
    ])
    return r.drop_contained(both).select("page_id", "region_id")


# ------------------------------------------------------------- overlap

CONNECT = f"""(({inter('a.','b.')}>0 and {inter('a.','b.')}/least(greatest(1,{area('a.')}),greatest(1,{area('b.')}))>=0.1)
    or case when {area('a.')}<={area('b.')} then {center_in('a.','b.')} else {center_in('b.','a.')} end)
  and (a.ref_id is null or b.ref_id is null or a.ref_id=b.ref_id)"""


def canon_items(v):
    return v.canon.select(
        "page_id", F.col("region_id").alias("idx"), "kind", *g.EDGES, "manual", "w", "h",
        F.when(F.col("ref_id").isNotNull(), F.array("ref_id")).otherwise(F.array().cast("array<bigint>")).alias("region_ids"),
    )


@query("overlap_edges", f"""select a.page_id, a.kind, a.region_id src, b.region_id dst from fx_canon a join fx_canon b
  on a.page_id=b.page_id and a.kind=b.kind and a.region_id<b.region_id where {CONNECT}""", "fx_canon")
def _(v):
    return r.overlap_edges(canon_items(v))


@query("resolve_overlaps", f"""with recursive c as (select * from fx_canon where not manual),
  e as (select a.page_id, a.region_id s, b.region_id d from c a join c b on a.page_id=b.page_id and a.kind=b.kind and a.region_id<>b.region_id where {CONNECT}),
  reach as (select page_id, region_id node, region_id root from c union select e.page_id, e.d, reach.root from reach join e on e.page_id=reach.page_id and e.s=reach.node),
  comp as (select page_id, node, min(root) comp from reach group by 1,2),
  m as (select c.page_id, c.kind, c.region_id, comp, count(*) over (partition by c.page_id, comp) size,
      first_value(c.region_id) over (partition by c.page_id, comp order by {area()} desc, c.region_id) winner,
      min(c.region_id) over (partition by c.page_id, c.kind) kind_first from c join comp on comp.page_id=c.page_id and comp.node=c.region_id),
  n as (select *, 'overlap_' || lpad(cast(dense_rank() over (partition by page_id order by kind_first, comp) as varchar),4,'0') gid from m where size>1)
  select f.page_id, f.region_id idx, gid overlap_group_id, coalesce(winner<>f.region_id,false) suppressed,
    case when winner<>f.region_id then winner end suppressed_by from fx_canon f left join n on n.page_id=f.page_id and n.region_id=f.region_id""", "fx_canon")
def _(v):
    v.keep("canon")
    return r.resolve_overlaps(canon_items(v)).select("page_id", "idx", "overlap_group_id", "suppressed", "suppressed_by")


NMS_STEP = """with recursive {src},
  ranked as (select *, row_number() over (partition by page_id order by score desc, region_id) rk from boxes),
  step as (select page_id, cast(0 as bigint) rk, cast([] as struct(x1 bigint, y1 bigint, x2 bigint, y2 bigint)[]) kept, cast(null as bigint) got from (select distinct page_id from boxes) q
    union all select s.page_id, r.rk, case when ok then list_append(kept, struct_pack(x1:=r.x1,y1:=r.y1,x2:=r.x2,y2:=r.y2)) else kept end, case when ok then r.region_id end
    from step s join (select *, true from ranked) r on r.page_id=s.page_id and r.rk=s.rk+1, lateral (select not list_bool_or(list_prepend(false, list_transform(s.kept, lambda k:
      greatest(0,least(k.x2,r.x2)-greatest(k.x1,r.x1))*greatest(0,least(k.y2,r.y2)-greatest(k.y1,r.y1)) >= 0.5*((k.x2-k.x1)*(k.y2-k.y1)+(r.x2-r.x1)*(r.y2-r.y1)
        -greatest(0,least(k.x2,r.x2)-greatest(k.x1,r.x1))*greatest(0,least(k.y2,r.y2)-greatest(k.y1,r.y1)))))) ok) z)
  select page_id, got as region_id from step where got is not null"""
CROWD = """boxes as (select page_id, region_id, x1, y1, x2, y2, score from fx_region union all
    select page_id, region_id+1000000, x1+part_key%9, y1+supp_key%7, x2+part_key%11, y2, round(1-score,2) from fx_region where part_key%2=0
    union all select page_id, region_id+2000000, x1, y1, x2, y2, score from fx_region where part_key%13=0)"""


def crowd(v):
    p, s, c = F.col("part_key"), F.col("supp_key"), F.col
    return each_as(v.region, ["region_id", *g.EDGES, "score"], [
        (None, [c("region_id"), *g.box(), c("score")]),
        (p % 2 == 0, [c("region_id") + 1000000, c("x1") + p % 9, c("y1") + s % 7, c("x2") + p % 11, c("y2"), F.round(1 - c("score"), 2)]),
        (p % 13 == 0, [c("region_id") + 2000000, *g.box(), c("score")]),
    ])


def each_as(regions, names, forms):
    """Every region in each form whose condition holds: the table is read once, however many forms it takes."""
    def one(when, values):
        row = F.struct(*(x.alias(n) for n, x in zip(names, values)))
        return row if when is None else F.when(when, row)

    rows = F.filter(F.array(*(one(*form) for form in forms)), lambda row: row.isNotNull())
    return regions.select("page_id", F.inline(rows))


@query("suppress_non_max", NMS_STEP.format(src=CROWD), "fx_region")
def _(v):
    return r.suppress_non_max(crowd(v)).select("page_id", "region_id")


@query("union_detections", NMS_STEP.format(src="""m as (select page_id, region_id, x1, y1, x2, y2, score from fx_region where det_kind='bubble'),
    d as (select page_id, region_id+1000000 region_id, x1+6, y1-4, x2+5, y2+3, round(1-score,2) from fx_region where det_kind='bubble' and supp_key%2=0 and page_id%3<>0),
    boxes as (select * from (select * from m union all select * from d) u where page_id in (select page_id from d))""")
    + " union all select page_id, region_id from m where page_id not in (select page_id from d)", "fx_region")
def _(v):
    cols = ["page_id", "region_id", *g.EDGES, "score"]
    base = bubbles(v)
    dark = base.where((F.col("supp_key") % 2 == 0) & (F.col("page_id") % 3 != 0)).select(
        "page_id", (F.col("region_id") + 1000000).alias("region_id"), (F.col("x1") + 6).alias("x1"), (F.col("y1") - 4).alias("y1"),
        (F.col("x2") + 5).alias("x2"), (F.col("y2") + 3).alias("y2"), F.round(1 - F.col("score"), 2).alias("score"),
    )
    return r.union_detections(base.select(cols), dark).select("page_id", "region_id")


# ------------------------------------------------------------- order, unions, distinct


@query("region_order", """select page_id, region_id, row_number() over (partition by page_id
    order by coalesce(reading_order,1000000000), y1, x1, region_id)-1 as position from fx_region""", "fx_region")
def _(v):
    return rk.with_page_position(
        v.region, ["page_id"], F.col("reading_order"), F.col("y1"), F.col("x1"), F.col("region_id")
    ).select("page_id", "region_id", "position")


@query("renumber", """select page_id, region_id, pos new_id, coalesce(reading_order,pos) reading_order from (select *, row_number() over (partition by page_id
    order by coalesce(reading_order,1000000000), y1, x1, region_id)-1 as pos from fx_canon) q""", "fx_canon")
def _(v):
    return rk.with_page_position(
        v.canon, ["page_id"], F.col("reading_order"), F.col("y1"), F.col("x1"), F.col("region_id"), "new_id"
    ).select("page_id", "region_id", "new_id", F.coalesce("reading_order", "new_id").alias("reading_order"))


@query("union_box", f"""with u as (select page_id, det_kind, greatest(0,least(min(x1),1000)) x1, greatest(0,least(min(y1),1400)) y1,
    greatest(0,least(max(x2),1000)) x2, greatest(0,least(max(y2),1400)) y2 from fx_region group by 1,2)
  select page_id, det_kind, case when x2>x1 and y2>y1 then x1 end x1, case when x2>x1 and y2>y1 then y1 end y1, case when x2>x1 and y2>y1 then x2 end x2,
    case when x2>x1 and y2>y1 then y2 end y2 from u""", "fx_region")
def _(v):
    return r.union_box(v.region, ["page_id", "det_kind"], F.lit(1000), F.lit(1400))


@query("ordered_distinct", """select page_id, label, min(region_id) region_id from fx_region group by 1,2""", "fx_region")
def _(v):
    return r.ordered_distinct(v.region.select("page_id", "label", "region_id"), ["page_id", "label"], "region_id")
