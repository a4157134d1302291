"""Status, work lists, render items, export and styles over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import styles as sy
from pagestrata.functions.geometry import box
from pagestrata.operators import export as ex
from pagestrata.operators import status as st
from pagestrata.operators import translation as tr
from pagestrata.plans.registry import query


def sql_counts(states, extra=""):
    return "count(*) filter (where not excluded) total, " + ", ".join(f"count(*) filter (where not excluded and status='{s}') as \"{s}\"" for s in states) + ", count(*) filter (where excluded) excluded"


@query("summarize_ocr", f"select page_id, {sql_counts(st.OCR_STATES)} from fx_ocr group by 1", "fx_ocr")
def _(v):
    return st.status_counts(v.ocr, ["page_id"], st.OCR_STATES, "prepared")


@query("summarize_ocr_edit", "select page_id, count(*) filter (where not excluded) active_items, count(*) filter (where excluded) excluded_items, count(*) filter (where not excluded and needs_ocr) needs_ocr_items from fx_ocr group by 1", "fx_ocr")
def _(v):
    return st.edit_counts(v.ocr, ["page_id"], "needs_ocr")


@query("summarize_translation", f"with t as (select page_id, part_key%9=0 excluded, status from fx_translation) select page_id, {sql_counts(st.TRANSLATION_STATES)} from t group by 1", "fx_translation")
def _(v):
    return st.status_counts(v.translation.withColumn("excluded", F.col("part_key") % 9 == 0), ["page_id"], st.TRANSLATION_STATES, "pending")


def _renders(v):
    p = F.col("part_key")
    state = F.when(p % 4 == 0, "Rendered ").when(p % 4 == 1, "skipped").when(p % 4 == 2, "error")
    return v.canon.select("page_id", state.alias("status"), (~F.col("enabled")).alias("excluded"), (p % 7 == 0).alias("needs_render"))


RENDERS = "r as (select page_id, case part_key%4 when 0 then 'rendered' when 1 then 'skipped' when 2 then 'error' end status, not enabled excluded, part_key%7=0 needs_render from fx_canon)"


@query("summarize_render", f"with {RENDERS} select page_id, {sql_counts(st.RENDER_STATES)} from r group by 1", "fx_canon")
def _(v):
    return st.status_counts(_renders(v), ["page_id"], st.RENDER_STATES)


@query("summarize_render_edit", f"with {RENDERS} select page_id, count(*) filter (where not excluded) active_items, count(*) filter (where excluded) excluded_items, count(*) filter (where not excluded and needs_render) needs_render_items from r group by 1", "fx_canon")
def _(v):
    return st.edit_counts(_renders(v), ["page_id"], "needs_render")


@query("summarize_inpaint", """select page_id, case when render_stale and ocr_status='done' then 'prepared' else ocr_status end status, render_stale needs_inpaint, page_no item_count, render_exists has_output_image, false has_text_mask, page_id%2=0 has_bubble_mask from fx_page""", "fx_page")
def _(v):
    meta = v.page.select(
        "page_id", F.col("ocr_status").alias("status"), F.col("render_stale").alias("needs_inpaint"), F.col("page_no").alias("item_count"),
        F.when(F.col("render_exists"), F.col("source_path")).alias("output_image_path"), F.lit(" ").alias("text_mask_path"),
        F.when(F.col("page_id") % 2 == 0, "m.png").otherwise("").alias("bubble_mask_path"))
    return st.inpaint_summary(meta).select("page_id", "status", "needs_inpaint", "item_count", "has_output_image", "has_text_mask", "has_bubble_mask")


@query("page_status", """select page_id, case when ocr_status in ('error','failed') then 'error' when page_id%13=0 then 'missing' when page_id%17=0 then 'ready' when render_exists and not render_stale then 'done' else 'ready' end page_status from fx_page""", "fx_page")
def _(v):
    pages = v.page.withColumn("has_canon", F.col("page_id") % 13 != 0)
    stages = v.page.select("page_id", F.lit("ocr").alias("stage"), F.col("ocr_status").alias("status"), F.lit(False).alias("stale")).unionByName(
        v.page.select("page_id", F.lit("render").alias("stage"), F.lit("done").alias("status"), F.col("render_stale").alias("stale")))
    return st.page_status(pages, stages, F.col("page_id") % 17 == 0).select("page_id", "page_status")


@query("run_result", """select command_id, count(distinct page_id) pages_processed, count(distinct page_id) filter (where event='page_error') failed_pages, count(distinct stage) filter (where event in ('page_done','page_error')) stages_completed,
  greatest(0,count(distinct page_id)-count(distinct page_id) filter (where event='page_error')) succeeded_pages, case when count(*) filter (where event='page_error')>0 then 'completed_with_errors' else 'completed' end final_state from fx_event group by 1""", "fx_event")
def _(v):
    return st.run_result(v.event)


@query("detector_stats", "select page_id, count(*) raw_detections, count(*) filter (where det_kind='bubble') bubbles, count(*) filter (where det_kind<>'bubble') layout_regions, count(distinct label) labels from fx_region group by 1", "fx_region")
def _(v):
    return st.detector_stats(v.region)


@query("ocr_work_list", "select page_id, ocr_item_id from fx_ocr where not excluded and not (status='done' and trim(text)<>'' and not needs_ocr)", "fx_ocr")
def _(v):
    return st.ocr_work_list(v.ocr).select("page_id", "ocr_item_id")


@query("render_work_list", """with s as (select page_id, ocr_item_id, excluded, status, text, (greatest(0,least(case when part_key%7=0 then x1+3 else x2 end,w))-x1)*(y2-y1) a from fx_ocr)
  select page_id, ocr_item_id, not excluded and status<>'skipped' and a>=64 and text<>'' wanted, case when not excluded and status<>'skipped' and (a<64 or text='') then 'skipped' else status end status,
    case when not excluded and status<>'skipped' then case when a<64 then 'box unusable' when text='' then '' else 'old' end else 'old' end error from s""", "fx_ocr")
def _(v):
    items = v.ocr.withColumns({"x2": F.when(F.col("part_key") % 7 == 0, F.col("x1") + 3).otherwise(F.col("x2")), "error": F.lit("old")})
    return st.render_work_list(items).select("page_id", "ocr_item_id", "wanted", "status", "error")


@query("reuse_decision", """select page_id, page_id%4<>0 detection, page_id%4<>0 and ocr_status='done' and not render_stale and page_id%6<>0 inpaint, render_exists and ocr_status='done' and not render_stale render from fx_page""", "fx_page")
def _(v):
    p = F.col("page_id")
    now = v.page.select("page_id", F.lit(0.25).alias("threshold"), F.lit("m").alias("model"))
    old = v.page.select(
        "page_id", F.when(p % 4 == 0, 0.3).otherwise(0.25).alias("threshold"), F.lit("m").alias("model"), F.col("ocr_status").alias("status"),
        F.col("render_stale").alias("needs_inpaint"), F.lit("a").alias("text_mask_hash"), F.when(p % 6 == 0, "b").otherwise("a").alias("output_mask_hash"),
        F.lit(None).cast("string").alias("bubble_mask_hash"), F.lit(None).cast("string").alias("output_bubble_mask_hash"))
    keys = ["threshold", "model"]
    renders = v.page.select("page_id", F.col("render_exists").alias("output_exists"), F.col("ocr_status").alias("status"), F.col("render_stale").alias("needs_render"))
    mark = lambda df, n: df.select("page_id", F.lit(True).alias(n))
    df = v.page.select("page_id")
    for part, name in ((st.reusable_detections(now, old, keys), "detection"), (st.reusable_inpaints(old, now, keys), "inpaint"), (st.reusable_renders(renders), "render")):
        df = df.join(mark(part, name), "page_id", "left")
    return df.na.fill(False)


@query("stage_status_upsert", """with l as (select page_id, stage, case when event='item_done' then 'stale' else 'status' end kind, case event when 'page_start' then 'running' when 'page_done' then 'done' else 'error' end status,
    case when event='page_done' then 'cache/'||stage end cache_path, case when event='page_error' then 'failed' end error, (ts, event_id) k from fx_event),
  s as (select page_id, stage, arg_max((status, cache_path, error), k) r, max(k) k from l where kind='status' group by 1,2), m as (select page_id, stage, max(k) k from l where kind='stale' group by 1,2)
  select coalesce(s.page_id,m.page_id) page_id, coalesce(s.stage,m.stage) stage, r[1] status, r[2] cache_path, r[3] error, coalesce(m.k is not null and (s.k is null or m.k>s.k),false) stale from s full join m on s.page_id=m.page_id and s.stage=m.stage""", "fx_event")
def _(v):
    e = F.col("event")
    log = v.event.select(
        "page_id", "stage", F.when(e == "item_done", "stale").otherwise("status").alias("kind"),
        F.when(e == "page_start", "running").when(e == "page_done", "done").otherwise("error").alias("status"),
        F.when(e == "page_done", F.concat(F.lit("cache/"), "stage")).alias("cache_path"), F.when(e == "page_error", "failed").alias("error"),
        (e == "item_done").alias("stale"), "ts", F.col("event_id").alias("seq"))
    return st.latest_stages(log)


@query("propagate_stale", """select distinct page_id, s as stage from (select page_id, unnest(case stage when 'detection' then ['ocr','translation','inpaint','render','export'] when 'ocr' then ['ocr','translation','inpaint','render','export'] when 'render' then ['render','export'] end) s from fx_event) q""", "fx_event")
def _(v):
    return st.propagate_stale(v.event.select("page_id", F.col("stage").alias("edited_stage")), "project")


@query("transition_status", """select page_id, ocr_item_id, case part_key%4 when 0 then 'running' when 1 then 'done' when 2 then 'error' else status end status, case part_key%4 when 2 then 'no answer' when 3 then error else '' end error, case when part_key%4=3 then translator else 'deepseek' end translator from fx_translation""", "fx_translation")
def _(v):
    p = F.col("part_key") % 4
    to = F.when(p == 0, "running").when(p == 1, "done").when(p == 2, "error")
    items = v.translation.withColumn("updated_at", F.lit(""))
    return st.transition(items, to, F.lit("no answer"), "deepseek", F.lit("2024-01-01T00:00:00+00:00")).select("page_id", "ocr_item_id", "status", "error", "translator")


REMOVAL = """rq as (select l_orderkey slot, cast(floor(l_orderkey/8.0) as bigint)%25 project_id, case l_linenumber when 1 then concat('source/p',cast(floor(l_orderkey/8.0) as bigint),'.png') when 2 then ' ' else 'source/none.png' end path
    from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey, l_linenumber order by l_partkey, l_suppkey, l_quantity, l_extendedprice) n from lineitem) q where n=1),
  fr as (select project_id, trim(path) path, min(slot) f from rq group by 1,2),
  oc as (select rq.project_id, rq.slot, trim(rq.path) path, p.page_id, case when trim(rq.path)='' then 'error' when p.page_id is null then 'error' when slot=f then 'removed' else 'skipped' end outcome
    from rq join fr on fr.project_id=rq.project_id and fr.path=trim(rq.path) left join fx_page p on p.project_id=rq.project_id and p.source_path=trim(rq.path))"""


def _outcome(v):
    page = F.floor(F.col("l_orderkey") / 8)
    path = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("source/p"), page.cast("string"), F.lit(".png"))).when(F.col("l_linenumber") == 2, " ").otherwise("source/none.png")
    req = v.table("lineitem").select("l_orderkey", "l_linenumber").distinct().select(
        (page % 25).alias("project_id"), F.col("l_orderkey").alias("slot"), path.alias("path"))
    return st.removal(req, v.page)


@query("remove_pages", f"with {REMOVAL} select project_id, slot, path, page_id, outcome from oc", "fx_page")
def _(v):
    return _outcome(v).select("project_id", "slot", "path", "page_id", "outcome")


@query("removed_to_trash", f"""with {REMOVAL}, gone as (select distinct page_id from oc where outcome='removed'),
  a as (select project_id, page_id, 'page' kind, source_path path, 'trash/pages/'||cast(page_id as varchar)||'_p'||cast(page_id as varchar)||'.png' trash_path from fx_page
    union all select project_id, page_id, k[1], 'cache/'||k[1]||'/p'||cast(page_id as varchar)||k[2], 'trash/cache/'||k[1]||'/'||cast(page_id as varchar)||'_p'||cast(page_id as varchar)||k[2] from fx_page, (select unnest([['ocr','.json'],['render','.png']]) k) z)
  select a.*, a.page_id in (select page_id from gone) trashed from a""", "fx_page")
def _(v):
    from pagestrata.plans.q_stages import scratch

    stored = st.artefacts(v.page, (("ocr", ".json"), ("render", ".png")))
    trash, cols = scratch(v, "trash"), ["project_id", "page_id", "kind", "path"]
    pages, files = st.remove_pages(_outcome(v), v.page, stored, trash, "run-1")
    gone = v.spark.read.parquet(trash).select(*cols, "trash_path").withColumn("trashed", F.lit(True))
    stay = pages.select("project_id", "page_id", F.lit("page").alias("kind"), F.col("source_path").alias("path")).unionByName(files.select(cols))
    every = st.trash_rows(v.page.select("page_id", F.lit("removed").alias("outcome")), v.page, stored).select(*cols, "trash_path")
    return every.join(stay, cols, "left_semi").withColumn("trashed", F.lit(False)).unionByName(gone)


@query("selected_ocr_work", """select page_id, ocr_item_id from fx_ocr where part_key%3=0 and not excluded and not (status='done' and trim(text)<>'' and not needs_ocr)""", "fx_ocr")
def _(v):
    chosen = v.ocr.where("part_key % 3 = 0").select("page_id", "ocr_item_id")
    return st.ocr_work_list(v.ocr, ids=chosen).select("page_id", "ocr_item_id")


@query("selected_translation_work", """select page_id, ocr_item_id, part_key%3=0 and trim(coalesce(source_text,''))<>'' and not (status='manually_edited' or (status in ('done','error') and trim(translated_text)<>'')) wanted,
    case when part_key%3=0 and trim(source_text)='' then 'skipped' else status end status from fx_translation""", "fx_translation")
def _(v):
    items = v.translation.withColumn("excluded", F.lit(False))
    chosen = items.where("part_key % 3 = 0").select("page_id", "ocr_item_id")
    return tr.work_list(items, ids=chosen).select("page_id", "ocr_item_id", "wanted", "status")


@query("reordered_pages", """with o as (select project_id, source_path, page_no, row_number() over (partition by project_id order by case when project_id%2=0 then -page_no else page_no end)-1 n from fx_page), k as (select project_id, count(*)//3 c from fx_page group by 1)
  select o.project_id, source_path, case when o.project_id%5=0 then page_no else n end page_no, case when o.project_id%5=0 then c when o.project_id%2=0 then coalesce((select n from o q where q.project_id=o.project_id and q.page_no=c), c) else coalesce((select n from o q where q.project_id=o.project_id and q.page_no=c), c) end current_index from o join k using (project_id)""", "fx_page")
def _(v):
    p = F.col("project_id")
    order = v.page.select("project_id", F.when(p % 2 == 0, -F.col("page_no")).otherwise(F.col("page_no")).alias("slot"), F.when((p % 5 == 0) & (F.col("page_no") == 0), "source/none.png").otherwise(F.col("source_path")).alias("source_path"))
    current = v.page.groupBy("project_id").agg(F.floor(F.count("*") / 3).alias("current_index"))
    pages, index = tr.reordered_pages(order, v.page, current)
    return pages.select("project_id", "source_path", "page_no").join(index, "project_id")


@query("next_page", f"""with {REMOVAL}, gone as (select distinct page_id from oc where outcome='removed'), c as (select project_id, max(page_no)//2 cur from fx_page group by 1),
  k as (select project_id, count(*) filter (where page_id not in (select page_id from gone)) kept, count(*) filter (where page_id in (select page_id from gone) and page_no<cur) b from fx_page join c using (project_id) group by 1)
  select project_id, case when kept=0 then 0 else greatest(0,least(cur-b,kept-1)) end current_index from k join c using (project_id)""", "fx_page")
def _(v):
    current = v.page.groupBy("project_id").agg(F.floor(F.max("page_no") / 2).alias("current_index"))
    return st.next_page(current, _outcome(v), v.page)


# ------------------------------------------------------------- render and export


@query("build_render_items", """with t as (select t.page_id, t.ocr_item_id, t.canon_id, o.kind okind, case when t.part_key%2=0 then o.kind else '' end kind, trim(translated_text) tt, c.* exclude (page_id, canon_id, kind) from fx_translation t join fx_canon c on c.page_id=t.page_id and c.canon_id=t.canon_id and c.enabled
    left join fx_ocr o on o.page_id=t.page_id and o.ocr_item_id=t.ocr_item_id), a as (select *, case when part_key%9=0 then 36 else (x2-x1)*(y2-y1) end a from t)
  select page_id, ocr_item_id, canon_id, case when kind<>'' then kind else okind end kind, tt translated_text, case when tt='' or a<64 then 'skipped' else 'pending' end status, case when tt<>'' and a<64 then 'box unusable' else '' end error from a""", "fx_translation fx_ocr fx_canon")
def _(v):
    small = F.col("part_key") % 9 == 0
    canon = v.canon.withColumns({
        "rx1": F.col("x1"), "ry1": F.col("y1"), "rx2": F.when(small, F.col("x1") + 6).otherwise(F.col("x2")), "ry2": F.when(small, F.col("y1") + 6).otherwise(F.col("y2"))})
    kinds = v.ocr.select("page_id", "ocr_item_id", F.col("kind").alias("k"))
    tr = v.translation.join(kinds, ["page_id", "ocr_item_id"]).withColumn("kind", F.when(F.col("part_key") % 2 == 0, F.col("k")).otherwise(""))
    return ex.build_render_items(tr, v.ocr, canon).select("page_id", "ocr_item_id", "canon_id", "kind", "translated_text", "status", "error")


@query("carry_render_overrides", """select o.page_id, o.ocr_item_id, coalesce(case when c.part_key%3=0 then 'bold' else '' end,'') style, coalesce(c.part_key%5=0,false) bbox_edited, coalesce(c.part_key%7=0 or c.part_key%3=0,false) needs_render
  from fx_ocr o left join fx_canon c on c.page_id=o.page_id and c.canon_id=o.canon_id and c.enabled""", "fx_ocr fx_canon")
def _(v):
    p = F.col("part_key")
    old = v.canon.where("enabled").select("page_id", "canon_id", F.when(p % 3 == 0, "bold").otherwise("").alias("style"), (p % 3 == 0).alias("style_active"), (p % 5 == 0).alias("bbox_edited"), (p % 7 == 0).alias("needs_render"))
    return ex.carry_overrides(v.ocr.select("page_id", "canon_id", "ocr_item_id"), old).select("page_id", "ocr_item_id", "style", "bbox_edited", "needs_render")


@query("page_cache_paths", """select page_id, k[1] kind, 'cache/'||k[1]||'/p'||cast(page_id as varchar)||k[2] as path from fx_page, (select unnest([['detection','.json'],['ocr','.json'],['translation','.json'],['inpaint','.json'],['inpaint','.png'],['render','.json'],['render','.png'],['masks',''],['ocr_crops',''],['render_sprites','']]) k) z""", "fx_page")
def _(v):
    return ex.cache_paths(v.page)


@query("unique_names", """with n as (select c_custkey, c_mktsegment||'.png' nm, row_number() over (partition by c_mktsegment order by c_custkey)-1 k from customer)
  select c_custkey, case when k=0 then nm else replace(nm,'.png','')||'_'||lpad(cast(k as varchar),greatest(3,length(cast(k as varchar)))::int,'0')||'.png' end unique_name from n""")
def _(v):
    named = v.table("customer").withColumn("name", F.concat("c_mktsegment", F.lit(".png")))
    return ex.unique_names(named, "name", "c_custkey").select("c_custkey", "unique_name")


NUMBERS = """nb as (select project_id, page_id, source_path, row_number() over (partition by project_id order by page_id%10, page_id) export_index, pn page_number from (select *, row_number() over (partition by project_id order by page_no, page_id) pn from fx_page) q)"""


def _scope(v):
    return tr.page_scope(v.page, "all").withColumn("scope_slot", F.col("page_id") % 10)


@query("page_numbering", f"with {NUMBERS} select project_id, page_id, export_index, page_number from nb", "fx_page")
def _(v):
    return ex.page_numbering(_scope(v).select("project_id", "page_id", "scope_slot"), v.page).select("project_id", "page_id", "export_index", "page_number")


MANIFEST = f"""{NUMBERS}, mf as (select project_id, page_id, export_index, page_number, case when page_id%3=0 then 'cache/render/p'||page_id||'.png' else '' end source_file,
    case when page_id%3<>0 then 'skipped' when page_id%7=0 then 'error' else 'exported' end status, case when page_id%3<>0 then 'not drawn yet' when page_id%7=0 then 'cannot read image' else '' end error,
    case when page_id%3=0 and page_id%7<>0 then 'project_'||project_id||'-'||lpad(cast(page_number as varchar),3,'0')||'_p'||page_id||'_render.webp' else '' end output_name,
    case when page_id%3=0 and page_id%7<>0 then 1000 else 0 end width, case when page_id%3=0 and page_id%7<>0 then 1400 else 0 end height from nb)"""


def _manifest(v):
    listing = v.page.where("render_exists").select(
        F.concat(F.lit("cache/render/p"), F.col("page_id").cast("string"), F.lit(".png")).alias("path"), F.col("w").alias("width"), F.col("h").alias("height"), (F.col("page_id") % 7 != 0).alias("readable"))
    return ex.export_manifest(_scope(v), v.page, listing, "render", "{project}-{page_number:03d}_{stem}_{stage}", ".webp")


@query("export_manifest", f"with {MANIFEST} select * replace (width::bigint as width, height::bigint as height) from mf", "fx_page")
def _(v):
    return _manifest(v)


@query("export_names_once", """with n as (select project_id, page_id, row_number() over (partition by project_id order by page_id%10, page_id) k, 'p'||cast(page_id%4 as varchar) st from fx_page where render_exists)
  select project_id, page_id, case when r=1 then st else st||'_'||lpad(cast(r-1 as varchar), greatest(3, length(cast(r-1 as varchar)))::int, '0') end||'.png' output_name from (select *, row_number() over (partition by project_id, st order by k) r from n) q""", "fx_page")
def _(v):
    # many pages share a file name, in folders of their own
    pages = _scope(v).withColumn("source_path", F.concat(F.lit("source/"), "page_id", F.lit("/p"), (F.col("page_id") % 4).cast("string"), F.lit(".png")))
    listing = pages.where("render_exists").select(F.col("source_path").alias("path"), F.col("w").alias("width"), F.col("h").alias("height"), F.lit(True).alias("readable"))
    return ex.export_manifest(pages, v.page, listing, "source", "{stem}").where("status = 'exported'").select("project_id", "page_id", "output_name")


@query("export_counts", f"with {MANIFEST} select project_id, count(*) total_pages, count(*) filter (where status='exported') exported_count, count(*) filter (where status='skipped') skipped_count, count(*) filter (where status='error') error_count from mf group by 1", "fx_page")
def _(v):
    return ex.export_counts(_manifest(v))


@query("export_names", """with s as (select c_custkey, case c_custkey%3 when 0 then 'a:b?' when 1 then ' .x. ' else '' end||case when c_custkey%3=2 then '' else c_mktsegment end st from customer),
  n as (select c_custkey, st, trim(regexp_replace(lpad(cast(c_custkey as varchar),4,'0')||'_'||st,'[<>:"/\\\\|?*\\x00-\\x1f]+','_','g')) a, trim(regexp_replace(st,'[<>:"/\\\\|?*\\x00-\\x1f]+','_','g')) b from s),
  m as (select c_custkey, st, regexp_replace(a,'^[. ]+|[. ]+$','','g') a, regexp_replace(b,'^[. ]+|[. ]+$','','g') b from n)
  select c_custkey, a default_name, case when b='' then lpad(cast(c_custkey as varchar),4,'0')||'_page' else b end stem_name, a bad_pattern from m""")
def _(v):
    c = F.col("c_custkey")
    st_ = F.when(c % 3 == 0, F.concat(F.lit("a:b?"), "c_mktsegment")).when(c % 3 == 1, F.concat(F.lit(" .x. "), "c_mktsegment")).otherwise("")
    f = {"index": c, "page_number": c, "stem": st_, "source_stem": F.lit("page"), "project": F.lit("p"), "stage": F.lit("render")}
    g_ = {**f, "source_stem": st_}
    bad = F.when(st_ == "", sy.export_name("{index:04d}_{stem}", f)).otherwise(sy.export_name("{nothing}", g_))
    return v.table("customer").select("c_custkey", sy.export_name("", f).alias("default_name"), sy.export_name("{stem}", f).alias("stem_name"), bad.alias("bad_pattern"))


@query("page_documents", """select page_id, count(*) item_count, '['||string_agg('{"id":'||cast(rn as varchar)||',"canon_id":"'||canon_id||'","kind":"'||kind||'"}',',' order by rn)||']' as document from (select *, row_number() over (partition by page_id order by region_id)-1 rn from fx_canon) q group by 1""", "fx_canon")
def _(v):
    return ex.page_documents(v.canon.select("page_id", F.col("region_id").alias("id"), "canon_id", "kind"), ["canon_id", "kind"])


# ------------------------------------------------------------- styles


@query("normalize_names", """with s as (select p_partkey, case p_partkey%6 when 0 then 'DeepSeek OCR' when 1 then 'chrome-lens' when 2 then 'Paddleocr' else p_name end pv, case p_partkey%5 when 0 then ' Local LLM' when 1 then 'NLLB' else p_type end tv, case p_partkey%7 when 0 then 'JPN' when 1 then 'auto' when 2 then 'simplified chinese' else p_name end lv from part)
  select p_partkey, case when p_partkey%6=0 then 'deepseek_ocr_llama' when p_partkey%6=1 then 'chrome_lens' else 'paddleocr_vl_llama' end provider, case p_partkey%5 when 0 then 'local_llm' when 1 then 'nllb' else 'google' end translator,
    case p_partkey%7 when 0 then 'Japanese' when 1 then null when 2 then 'Chinese' else array_to_string(list_transform(list_filter(regexp_split_to_array(trim(lv),'[\\s_-]+'), lambda w: w<>''), lambda w: upper(w[1])||w[2:]),' ') end as language from s""")
def _(v):
    p = F.col("p_partkey")
    pv = F.when(p % 6 == 0, "DeepSeek OCR").when(p % 6 == 1, "chrome-lens").when(p % 6 == 2, "Paddleocr").otherwise(F.col("p_name"))
    tv = F.when(p % 5 == 0, " Local LLM").when(p % 5 == 1, "NLLB").otherwise(F.col("p_type"))
    lv = F.when(p % 7 == 0, "JPN").when(p % 7 == 1, "auto").when(p % 7 == 2, "simplified chinese").otherwise(F.col("p_name"))
    return v.table("part").select("p_partkey", sy.normal_provider(pv).alias("provider"), sy.normal_translator(tv).alias("translator"), sy.normal_language(lv).alias("language"))


@query("parse_color", """select l_orderkey, l_linenumber::bigint line, l_partkey, case l_partkey%4 when 0 then concat(l_suppkey%256,',',l_partkey%256,',',least(255,l_partkey%400)) when 1 then concat(cast(('0x'||substr(h,1,2))::int as varchar),',',cast(('0x'||substr(h,3,2))::int as varchar),',',cast(('0x'||substr(h,5,2))::int as varchar)) end color, l_partkey%4=3 bad
  from (select *, lpad(lower(hex(l_partkey*7919%16777216)),6,'0') h from lineitem) q""")
def _(v):
    p = F.col("l_partkey")
    text = F.when(p % 4 == 0, F.concat_ws(", ", (F.col("l_suppkey") % 256).cast("string"), (p % 256).cast("string"), (p % 400).cast("string"))).when(
        p % 4 == 1, F.concat(F.lit("#"), F.lpad(F.lower(F.hex(p * 7919 % 16777216)), 6, "0"))).when(p % 4 == 2, "Auto").otherwise("1,2")
    color, error = sy.parse_color(text)
    return v.table("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), "l_partkey", F.array_join(color, ",").alias("color"), error.isNotNull().alias("bad"))


def _overrides(v):
    p, s = F.col("part_key"), F.col("supp_key")
    return v.canon.select(
        "page_id", "region_id", (p % 50 == 0).alias("enabled"), F.when(p % 11 == 0, "over").alias("render_text_override"), F.lit(None).cast("string").alias("font_name"), F.lit("").alias("font_path"),
        F.when(p % 4 == 0, "Fixed").when(p % 4 == 1, "odd").alias("font_size_mode"), F.lit("inherit").alias("writing_mode"), F.when(p % 3 == 0, "auto").when(p % 3 == 1, "custom").alias("text_color_mode"),
        (s % 30 - 4).cast("string").alias("fixed_font_size"), F.when(p % 5 == 0, "x").otherwise((s % 20).cast("string")).alias("min_font_size"), (p % 80).alias("max_font_size"),
        F.when(p % 6 == 0, "yes").when(p % 6 == 1, "Off").when(p % 6 == 2, "maybe").alias("stroke_enabled"), F.when(p % 7 == 0, "2.5").when(p % 7 == 1, "-1").alias("stroke_width"),
        F.when(p % 8 == 0, F.array(F.lit(300), F.lit(-5), F.lit(7), F.lit(9))).alias("text_color"), F.lit(None).cast("array<int>").alias("stroke_color"), F.lit(None).cast("double").alias("line_spacing_ratio"),
        F.lit("tr").alias("translated_text"))


STYLES = """sv as (select page_id, region_id, part_key%50=0 enabled, case when part_key%11=0 then 'over' else '' end txt, case when part_key%4=0 then 'fixed' else 'inherit' end fm, case part_key%3 when 0 then 'auto' when 1 then 'custom' else 'inherit' end cm,
    greatest(0,supp_key%30-4) fx, case when part_key%5=0 then 0 else supp_key%20 end mn, part_key%80 mx, case part_key%6 when 0 then true when 1 then false end se, case when part_key%7=0 then 2.5e0 end sw, case when part_key%8=0 then '255,0,7' end tc from fx_canon)"""


@query("style_override_defaults", f"""with {STYLES} select page_id, region_id, fm font_size_mode, cm text_color_mode, fx fixed_font_size, mn min_font_size, mx max_font_size, se stroke_enabled, sw stroke_width, tc text_color,
  enabled or txt<>'' or fm<>'inherit' or cm<>'inherit' or fx<>0 or mn<>0 or mx<>0 or se is not null or sw is not null or tc is not null active from sv""", "fx_canon")
def _(v):
    return sy.style_defaults(_overrides(v)).select(
        "page_id", "region_id", "font_size_mode", "text_color_mode", "fixed_font_size", "min_font_size", "max_font_size", "stroke_enabled", "stroke_width", F.array_join("text_color", ",").alias("text_color"), "active")


@query("effective_style", f"""with {STYLES}, m as (select *, case when fm='fixed' and fx>0 then fx when fm<>'fixed' and mn>0 then mn else 12 end lo from sv)
  select page_id, region_id, lo eff_min, greatest(lo, case when fm='fixed' and fx>0 then fx when fm<>'fixed' and mx>0 then mx else 72 end) eff_max, coalesce(se,true) eff_stroke_enabled, coalesce(sw,1.5e0) eff_stroke_width,
    case cm when 'custom' then false else true end eff_auto_color, case cm when 'auto' then null when 'custom' then coalesce(tc,'1,2,3') else '1,2,3' end eff_text_color, case when txt<>'' then txt else 'tr' end eff_text from m""", "fx_canon")
def _(v):
    config = {"min_font_size": 12, "max_font_size": 72, "stroke_enabled": True, "stroke_width": 1.5, "auto_color": True, "text_color": (1, 2, 3), "stroke_color": None, "line_spacing_ratio": 0.18}
    return sy.effective_style(sy.style_defaults(_overrides(v)), config).select(
        "page_id", "region_id", "eff_min", "eff_max", "eff_stroke_enabled", "eff_stroke_width", "eff_auto_color", F.array_join("eff_text_color", ",").alias("eff_text_color"), "eff_text")


@query("build_prompt", f"""with s as (select p_partkey, p_name, p_type, case when p_partkey%3=0 then 'full_custom_prompt' else 'built_in_plus_user' end m, case when p_partkey%4=0 then ' ' else p_brand end u, case when p_partkey%5=0 then null else p_type end nt from part)
  select p_partkey, sha256('Role / Task:'||chr(10)||'You are a manga/comic translator.'||chr(10)||'Translate from ja to '||case when p_partkey%2=0 then 'vi' else 'en' end||'.'||chr(10)||'Preserve meaning, tone, character voice, and reading flow.'
    ||chr(10)||chr(10)||case when m='full_custom_prompt' then 'Custom Prompt Override:'||chr(10)||p_name else 'Style Instructions ('||p_name||'):'||chr(10)||p_name||case when u=' ' then '' else chr(10)||chr(10)||'User Extra Instructions:'||chr(10)||u end end
    ||coalesce(chr(10)||chr(10)||'Project Translation Notes:'||chr(10)||nt,'')||chr(10)||chr(10)||'Output Contract:'||chr(10)||'{sy.DEFAULT_OUTPUT_CONTRACT}') prompt_hash from s""")
def _(v):
    p = F.col("p_partkey")
    prompt = sy.build_prompt(
        F.lit(""), F.when(p % 2 == 0, "vi"), F.when(p % 3 == 0, "full_custom_prompt").otherwise("built_in_plus_user"), F.col("p_name"), F.col("p_name"),
        F.when(p % 4 == 0, " ").otherwise(F.col("p_brand")), F.lit(""), F.when(p % 5 != 0, F.col("p_type")), F.lit(None).cast("string"))
    return v.table("part").select("p_partkey", F.sha2(prompt, 256).alias("prompt_hash"))
