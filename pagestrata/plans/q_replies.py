"""Replies, requests, recognised pieces and catalogs over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.functions import replies as rp
from pagestrata.operators import recognition as rc
from pagestrata.operators import terms as tm
from pagestrata.operators import translation as tr
from pagestrata.plans.q_text import TAILS, scompact
from pagestrata.plans.q_translation import SUMMARY, TERM_ROWS
from pagestrata.plans.registry import query


def _page_items(v, field="translation"):
    """Lines of a source page as one reply."""
    items = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x, i: F.struct(i.cast("long").alias("index"), x["text"].alias(field)))
    return v.source.groupBy(*tr.PAGE).agg(items.alias("items"), F.count("*").alias("n"))


def _loose(body):
    p = F.col("project_id") % 4
    return F.when(p == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(p == 1, F.concat(F.lit("Here you go: "), body, F.lit(" Bye"))).when(
        p == 2, body).otherwise(F.concat(F.lit("```\n"), F.substring(body, 1, 12), F.lit("```")))


@query("extract_json", """select project_id, page_no, case when project_id%4<>3 then '{"items":['||string_agg('{"index":'||cast(line_no as varchar)||',"translation":'||to_json(text)::varchar||'}',',' order by line_no)||']}' end json_text
  from fx_source group by 1,2""", "fx_source")
def _(v):
    df = _page_items(v).withColumn("reply", _loose(F.to_json(F.struct("items"))))
    return rp.extract_json(df, F.col("reply")).select(*tr.PAGE, "json_text")


@query("parse_items", """with n as (select project_id, page_no, count(*) n from fx_source group by 1,2)
  select s.project_id, s.page_no, s.line_no, s.text from fx_source s join n using (project_id, page_no) where (project_id+page_no)%5<>0 and not ((project_id+page_no)%5=1 and n>1)""", "fx_source")
def _(v):
    k = (F.col("project_id") + F.col("page_no")) % 5
    items = F.when(k == 0, F.slice("items", F.lit(2), F.greatest(F.lit(0), F.size("items") - 1))).when(k == 1, F.reverse("items")).otherwise(F.col("items"))
    df = _page_items(v).withColumn("j", F.to_json(F.struct(items.alias("items"))))
    out = rp.parse_items(df, F.col("j"), F.col("n"))
    return out.select(*tr.PAGE, F.posexplode("translations").alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))


@query("parse_pages", """with n as (select project_id, page_no, count(*) n, string_agg(text, chr(10) order by line_no) j from fx_source group by 1,2)
  select cast(project_id as varchar)||':'||cast((row_number() over (partition by project_id order by page_no)-1)//3 as varchar) chunk_id, 'p'||cast(page_no as varchar) page_key, n line_count,
    case when page_no%3<>1 then j end as lines from n""", "fx_source")
def _(v):
    pages = _page_items(v).join(tr.page_chunks(v.source.select(*tr.PAGE).distinct(), 3), tr.PAGE)
    chunk = F.concat_ws(":", "project_id", "chunk").alias("chunk_id")
    key = F.concat(F.lit("p"), F.col("page_no").cast("string"))
    items = F.when(F.col("page_no") % 3 == 1, F.slice("items", F.lit(2), F.size("items"))).otherwise(F.col("items"))
    named = pages.select(chunk, key.alias("page_key"), items.alias("items"))
    reply = named.groupBy("chunk_id").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("page_key", "items"))).alias("pages"))).alias("j"))
    sent = pages.select(chunk, key.alias("page_key"), F.col("n").alias("line_count"))
    return rp.parse_pages(reply, F.col("j"), sent).select("chunk_id", "page_key", "line_count", F.array_join("translations", "\n").alias("lines"))


@query("chat_text", """select project_id, page_no, case project_id%3 when 0 then trim(source_text) when 1 then trim(source_text||chr(10)||translated_text) end content, project_id%3=2 malformed from fx_pair""", "fx_pair")
def _(v):
    p = F.col("project_id") % 3
    part = lambda c: F.struct(F.lit("text").alias("type"), F.col(c).alias("text"))
    wrap = lambda content: F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices")))
    body = F.when(p == 0, wrap(F.col("source_text"))).when(p == 1, wrap(F.array(part("source_text"), part("translated_text")))).otherwise('{"choices": []}')
    return rp.chat_text(v.pair, body).select(*tr.PAGE, "content", "malformed")


@query("translation_inputs", """select project_id, page_no, line_no, row_number() over (partition by project_id order by page_no, line_no)-1 flat_index from fx_source""", "fx_source")
def _(v):
    from pagestrata.operators.ranking import number_band, with_position

    return with_position(v.source, ["project_id"], [F.col("page_no"), F.col("line_no")], number_band(F.col("page_no"), 64), "flat_index").drop("text")


@query("build_requests", """with c as (select project_id, page_no, (row_number() over (partition by project_id order by page_no)-1)//2 ch from (select distinct project_id, page_no from fx_source) q),
  i as (select s.project_id, ch, s.page_no, '['||string_agg('{"index":'||cast(line_no as varchar)||',"text":'||to_json(text)::varchar||'}',',' order by line_no)||']' j, count(*) n from fx_source s join c on c.project_id=s.project_id and c.page_no=s.page_no group by 1,2,3)
  select project_id, ch as chunk, cast(sum(n) as bigint) line_count, '{"pages":{'||string_agg('"page_'||lpad(cast(page_no as varchar),3,'0')||'.png":'||j,',' order by page_no)||'}}' payload from i group by 1,2""", "fx_source")
def _(v):
    chunks = tr.page_chunks(v.source.select(*tr.PAGE).distinct(), 2)
    out = rp.build_requests(v.source, chunks, "Japanese", "English")
    return out.select("project_id", "chunk", "line_count", F.split("user", "\n\n")[1].alias("payload"))


IN_CONTEXT = f"""with {TERM_ROWS}, {SUMMARY}, ck as (select project_id, page_no, (row_number() over (partition by project_id order by page_no)-1)//2 ch from (select distinct project_id, page_no from fx_source) q),
  cl as (select project_id, ch, max(page_no) last_page from ck group by 1,2), tc as (select tr.*, ch from tr join ck using (project_id, page_no)),
  kb as (select cl.project_id, cl.ch, term, count(*) cnt, min((page_no, line_no, slot)) fs from cl join tc on tc.project_id=cl.project_id and tc.ch<cl.ch group by 1,2,3),
  kr as (select *, row_number() over (partition by project_id, ch order by cnt desc, fs) rnk from kb),
  b as (select project_id, ch, 'KEY TERMS (translate consistently):'||chr(10)||string_agg('  '||term||' (×'||cast(cnt as varchar)||')'||chr(10),'' order by rnk) b from kr where rnk<=15 and cnt>=2 group by 1,2),
  c as (select sm.project_id, ch+1 ch, 'STORY SO FAR:'||chr(10)||'  '||arg_max(summary, sm.page_no)||chr(10) c from sm join ck on ck.project_id=sm.project_id and ck.page_no=sm.page_no group by 1,2 having arg_max(summary, sm.page_no)<>''),
  n as (select project_id, ch, count(*) line_count from fx_source join ck using (project_id, page_no) group by 1,2)
  select n.project_id, n.ch as chunk, line_count, case when b is null and c is null then '{rp.DEFAULT_SYSTEM % ("Japanese", "English")}' else
    '{rp.CONTEXT_TITLE}'||chr(10)||'---'||chr(10)||'CONTEXT MEMORY:'||chr(10)||coalesce(b,'')||coalesce(c,'')||'---' end as system
  from n left join b using (project_id, ch) left join c using (project_id, ch)"""


@query("build_requests_in_context", IN_CONTEXT, "fx_source fx_target")
def _(v):
    chunks = tr.page_chunks(v.source.select(*tr.PAGE).distinct(), 2)
    none = v.source.select("project_id", F.lit("").alias("term"), F.lit("").alias("translation"), F.lit(1).alias("rank")).where(F.lit(False))
    context = tm.chunk_context(tm.term_rows(v.source, v.target), chunks, v.target, none, none)
    out = rp.build_requests(v.source, chunks, "Japanese", "English", context)
    return out.select("project_id", "chunk", "line_count", "system")


# ------------------------------------------------------------- pieces


def _pieces(v):
    p = F.col("part_key")
    return v.ocr.select("page_id", F.col("ocr_item_id").alias("slot"), F.when(p % 3 == 0, F.upper("text")).otherwise(F.concat("text", F.lit(" ,"))).alias("text"),
                        ((p % 100) / 100.0).alias("score"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"), ((F.col("x1") + F.col("x2")) / 2).alias("cx"))


PIECES = "pc as (select page_id, ocr_item_id slot, case when part_key%3=0 then upper(text) else text||' ,' end text, (part_key%100)/100.0e0 score, (y1+y2)/2 cy, (x1+x2)/2 cx from fx_ocr)"


@query("best_by_key", f"""with {PIECES}, k as (select *, regexp_replace(lower(text),'[^a-z0-9]+','','g') piece_key from pc)
  select page_id, piece_key, slot from (select *, row_number() over (partition by page_id, piece_key order by score desc, slot) n from k where piece_key<>'') q where n=1""", "fx_ocr")
def _(v):
    return rc.best_by_key(_pieces(v), ["page_id"]).select("page_id", "piece_key", "slot")


@query("join_pieces", f"""with {PIECES} select page_id, trim(regexp_replace(regexp_replace(trim(string_agg(text,' ' order by cy, cx, slot)),'\\s+',' ','g'),'\\s+([,.!?;:])','\\1','g')) as text from pc where score>=0.2 and text<>'' group by 1""", "fx_ocr")
def _(v):
    return rc.join_pieces(_pieces(v), ["page_id"], 0.2)


@query("flatten_ocr_output", """with l as (select doc_id crop_id, line_no i, trim(regexp_replace(line,'\\s+',' ','g')) text, line_no%10 s from fx_line),
  k as (select *, regexp_replace(lower(text),'[^a-z0-9]+','','g') pk from l where text<>'' and (crop_id%4=3 or s>=3)), b as (select *, row_number() over (partition by crop_id, pk order by s desc, i) n from k where pk<>'' and crop_id%4<>3)
  select crop_id, text, s/10.0e0 score, i*10+2.0e0 cy from b where n=1 union all select crop_id, text, 1.0e0, i*10.0e0 from k where crop_id%4=3""", "fx_line")
def _(v):
    i = F.col("line_no").cast("double")
    rows = v.line.groupBy(F.col("doc_id").alias("crop_id")).agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    arr = F.struct(
        F.transform("l", lambda x: x["line"]).alias("rec_texts"), F.transform("l", lambda x: (x["line_no"] % 10) / 10.0).alias("rec_scores"),
        F.transform("l", lambda x: F.array(F.lit(0.0), x["line_no"] * 10.0, F.lit(50.0), x["line_no"] * 10.0 + 4.0)).alias("rec_boxes"))
    lines = F.struct(F.transform("l", lambda x: F.struct(x["line"].alias("text"), F.array(F.lit(0.0), x["line_no"] * 10.0, F.lit(9.0), F.lit(9.0)).alias("bbox"))).alias("text_lines"))
    k, deep = F.col("crop_id") % 4, F.floor(F.col("crop_id") / 4) % 3
    j = F.when(k == 0, F.to_json(arr)).when(k == 1, F.to_json(F.struct(arr.alias("res")))).when(k == 2, F.to_json(F.struct(arr.alias("prunedResult")))).otherwise(F.to_json(lines))
    # deeper: in a list after other things, or in a wrapper in a wrapper in a list
    j = F.when(deep == 1, F.concat(F.lit('[7, null, {"rec_texts": [], "page": '), j, F.lit("}]"))).when(
        deep == 2, F.concat(F.lit('{"a": [[{"b": {"c": [{"other": [1, "x"]}, '), j, F.lit(']}}]], "rec_scores": {"no": 1}}'))).otherwise(j)
    return rc.flatten_output(rows, j, 0.3).select("crop_id", "text", "score", "cy")


@query("best_attempt", f"""with {TAILS}, a as (select doc_id, line_no//3 crop, line_no%3 attempt, case when line<>'' and not trimmed and not degenerate then 0 when trimmed and kept<>'' then 1 when line<>'' then 2 else 3 end rank, line, kept from t3),
  b as (select *, case when rank=1 then kept else line end t, {scompact('case when rank=1 then kept else line end')} d from a),
  w as (select *, row_number() over (partition by doc_id, crop order by rank, case when rank=0 then attempt else 0 end, -length(d), -len(list_distinct(string_split(d,''))), attempt) n from b)
  select doc_id, crop, case when rank=3 then '' else t end as text, ['OK','LOOP_TRIMMED','BEST_EFFORT','EMPTY'][rank+1] status from w where n=1""", "fx_line")
def _(v):
    lines = v.line.select("doc_id", F.floor(F.col("line_no") / 3).alias("crop"), (F.col("line_no") % 3).alias("attempt"), F.col("line").alias("cleaned"))
    return rc.best_attempt(lines, ["doc_id", "crop"])


# ------------------------------------------------------------- catalogs


@query("resolve_style", """select p_partkey, case p_partkey%6 when 0 then 'casual_dialogue' when 1 then 'default_manga' when 2 then 'style_'||p_brand when 3 then 'style_'||p_brand when 4 then 'default_manga' else 'default_manga' end resolved from part""")
def _(v):
    p = F.col("p_partkey")
    part = v.table("part")
    custom = part.select(F.concat(F.lit("style_"), "p_brand").alias("id"), F.concat(F.lit("Style "), "p_brand").alias("display_name")).distinct().withColumn("slot", F.lit(9))
    built = part.sparkSession.createDataFrame([("default_manga", "Default Manga", 0), ("casual_dialogue", "Casual Dialogue", 1)], "id string, display_name string, slot int")
    asked = part.select("p_partkey", F.when(p % 6 == 0, " Casual").when(p % 6 == 1, "default manga").when(p % 6 == 2, F.concat(F.lit("style_"), "p_brand")).when(
        p % 6 == 3, F.concat(F.lit("STYLE "), F.upper("p_brand"))).when(p % 6 == 4, "").otherwise("unknown").alias("style_id"))
    return rc.resolve_style(asked, built.unionByName(custom)).select("p_partkey", "resolved")


@query("match_catalog_name", """select p_partkey, case p_partkey%5 when 0 then 'ring' when 1 then 'Small Ring' when 2 then 'Small Ring' when 3 then 'gear' else 'bolt' end matched from part""")
def _(v):
    p = F.col("p_partkey")
    answer = F.when(p % 5 == 0, '"ring"').when(p % 5 == 1, "small ring").when(p % 5 == 2, "Font: Small Ring").when(p % 5 == 3, "a GEAR, I think").otherwise("zzz")
    return rc.match_catalog_name(v.table("part").select("p_partkey", answer.alias("answer")), ["Small Ring", "ring", "gear", "bolt"], "bolt").select("p_partkey", "matched")


@query("resolve_font", """with f as (select p_brand, 'fonts/'||replace(p_brand,'#','')||'.ttf' p, min(p_partkey) s from part group by 1), x as (select arg_min(p,s) p from f)
  select p_partkey, case p_partkey%4 when 0 then f.p when 1 then f.p when 2 then x.p end resolved, p_partkey%4=3 font_error from part join f using (p_brand), x""")
def _(v):
    p = F.col("p_partkey")
    part = v.table("part")
    path = F.concat(F.lit("fonts/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".ttf"))
    fonts = part.groupBy(F.col("p_brand").alias("name"), path.alias("path")).agg(F.min("p_partkey").alias("slot"))
    asked = part.select("p_partkey", F.when(p % 4 == 0, F.upper("p_brand")).when(p % 4 == 1, F.concat(F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".TTF"))).alias("font_name"),
                        F.when(p % 4 == 3, "fonts/none.ttf").alias("font_path"))
    return rc.resolve_font(asked, fonts).select("p_partkey", "resolved", "font_error")
