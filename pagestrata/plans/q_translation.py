"""Translation batches, items and project context over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagestrata.operators import terms as tm
from pagestrata.operators import translation as tr
from pagestrata.plans.registry import query

PAGES = "pg as (select distinct project_id, page_no from fx_source)"


def _pages(v):
    return v.source.select(*tr.PAGE).distinct()


@query("page_chunks_fixed", f"with {PAGES} select project_id, page_no, (row_number() over (partition by project_id order by page_no)-1)//3 as chunk from pg", "fx_source")
def _(v):
    return tr.page_chunks(_pages(v), 3).select(*tr.PAGE, "chunk")




@query("page_chunks_balanced", """with r as (select c_nationkey::bigint project_id, c_custkey page_no, row_number() over (partition by c_nationkey order by c_custkey)-1 p, count(*) over (partition by c_nationkey) n from customer),
  k as (select *, (n+4)//5 k from r), b as (select *, n//k base, n%k longer from k)
  select project_id, page_no, case when p<(base+1)*longer then p//(base+1) else longer+(p-(base+1)*longer)//base end as chunk from b""")
def _(v):
    pages = v.table("customer").select(F.col("c_nationkey").cast("long").alias("project_id"), F.col("c_custkey").alias("page_no"))
    return tr.page_chunks(pages).select(*tr.PAGE, "chunk")


SHAPES = """sh as (select s.project_id, s.page_no, n sent, m received, coalesce(n=m,false) valid from (select project_id, page_no, count(*) n from fx_source group by 1,2) s
  left join (select project_id, page_no, count(*) m from fx_target where (project_id+page_no)%7<>0 group by 1,2) t on s.project_id=t.project_id and s.page_no=t.page_no)"""


def _answers(v):
    return v.target.where((F.col("project_id") + F.col("page_no")) % 7 != 0)


@query("valid_pages", f"with {SHAPES} select * from sh", "fx_source fx_target")
def _(v):
    return tr.page_shapes(v.source, _answers(v))


@query("missing_pages", f"with {SHAPES} select project_id, page_no from sh where received is null", "fx_source fx_target")
def _(v):
    return tr.missing_pages(v.source, _answers(v))


@query("repair_lines", """select s.project_id, s.page_no, s.line_no, coalesce(t.text, s.text) original_pad, coalesce(t.text,'') empty_pad from fx_source s
  left join fx_target t on s.project_id=t.project_id and s.page_no=t.page_no and s.line_no=t.line_no and (t.project_id+t.page_no)%7<>0""", "fx_source fx_target")
def _(v):
    a = tr.repair_lines(v.source, _answers(v)).select(*tr.LINE, F.col("translated").alias("original_pad"))
    b = tr.repair_lines(v.source, _answers(v), False).select(*tr.LINE, F.col("translated").alias("empty_pad"))
    return a.join(b, tr.LINE)


@query("page_key_check", f"""with {PAGES}, w as (select project_id chunk_id, page_no k, row_number() over (partition by project_id order by page_no)-1 p from pg),
  g as (select project_id chunk_id, page_no k, row_number() over (partition by project_id order by case when project_id%3=0 then -page_no else page_no end)-1 p from pg where project_id%5<>0 or page_no>0)
  select coalesce(w.chunk_id,g.chunk_id) chunk_id, bool_and(w.k is not distinct from g.k) same_keys, count(*) slots from w full join g on w.chunk_id=g.chunk_id and w.p=g.p group by 1""", "fx_source")
def _(v):
    def keyed(df, order):
        from pagestrata.operators.ranking import number_band, with_position

        placed = with_position(df, ["project_id"], [order], number_band(order, 256))
        return placed.select(F.col("project_id").alias("chunk_id"), "position", F.col("page_no").alias("page_key"))

    pages = _pages(v)
    sent = keyed(pages, F.col("page_no"))
    kept = pages.where((F.col("project_id") % 5 != 0) | (F.col("page_no") > 0))
    got = keyed(kept, F.when(F.col("project_id") % 3 == 0, -F.col("page_no")).otherwise(F.col("page_no")))
    return tr.page_key_check(sent, got)


@query("translate_nonblank", """select doc_id project_id, cast(0 as bigint) page_no, line_no, case when regexp_matches(line,'\\S') then concat('[',
    cast(count(*) filter (where regexp_matches(line,'\\S')) over (partition by doc_id order by line_no)-1 as varchar),'] ',reverse(line)) else line end translated from fx_line""", "fx_line")
def _(v):
    lines = v.line.select(F.col("doc_id").alias("project_id"), F.lit(0).cast("long").alias("page_no"), "line_no", F.col("line").alias("text"))
    sent = tr.sent_lines(lines)
    answers = sent.withColumn("text", F.concat(F.lit("["), F.col("sent_index").cast("string"), F.lit("] "), F.reverse("text")))
    return tr.place_answers(lines, sent, answers).select(*tr.LINE, "translated")


@query("page_scope", """with sel as (select source_path, min(l_orderkey) scope_slot from (select concat('source/p',cast(floor(l_orderkey/3.0) as bigint),'.png') source_path, l_orderkey from lineitem) q group by 1)
  select page_id, scope_slot from fx_page join sel using (source_path)""", "fx_page")
def _(v):
    named = F.concat(F.lit("source/p"), F.floor(F.col("l_orderkey") / 3).cast("string"), F.lit(".png"))
    selected = v.table("lineitem").select(named.alias("source_path"), F.col("l_orderkey").alias("slot"))
    return tr.page_scope(v.page, "selected", selected).select("page_id", "scope_slot")


@query("minus_failed", "select page_id from fx_page where page_id not in (select page_id from fx_event where event='page_error')", "fx_page fx_event")
def _(v):
    return tr.without_failed(v.page, v.event.where("event = 'page_error'")).select("page_id")


@query("same_page_set", """with o as (select project_id, source_path from fx_page where not (project_id%4=1 and page_no=0) union all select project_id, source_path from fx_page where project_id%4=2 and page_no=0),
  a as (select project_id, source_path, count(*) n from o group by 1,2)
  select coalesce(p.project_id,a.project_id) project_id, bool_and(coalesce(n=1 and p.source_path is not null,false)) accepted from fx_page p full join a on p.project_id=a.project_id and p.source_path=a.source_path group by 1""", "fx_page")
def _(v):
    p, first = F.col("project_id") % 4, F.col("page_no") == 0
    order = v.page.where(~((p == 1) & first)).unionByName(v.page.where((p == 2) & first))
    return tr.same_page_set(order, v.page)


# ------------------------------------------------------------- items

MERGED = """ex as (select page_id, ocr_item_id, case when part_key%2=0 then canon_id else '' end canon_id, trim(source_text) src, translated_text tt, status, error, translator from fx_translation),
  b as (select o.page_id, o.ocr_item_id, o.canon_id, o.kind, trim(o.text) source_text, true matched from fx_ocr o join fx_canon c on c.page_id=o.page_id and c.canon_id=o.canon_id where c.enabled),
  j as (select b.*, coalesce(x.src,y.src) osrc, coalesce(x.tt,y.tt) ott, coalesce(x.status,y.status) ost, coalesce(x.error,y.error) oerr, coalesce(x.translator,y.translator) otr
    from b left join ex x on x.page_id=b.page_id and x.canon_id=b.canon_id left join ex y on y.page_id=b.page_id and y.ocr_item_id=b.ocr_item_id),
  f as (select *, coalesce(ost='manually_edited',false) edited, coalesce(ost='manually_edited',false) or coalesce(osrc=source_text,false) keep from j)"""


@query("init_translation", f"""with {MERGED} select page_id, ocr_item_id, canon_id, kind, matched, source_text,
    case when keep and (edited or source_text<>'') then ott else '' end translated_text,
    case when edited then 'manually_edited' when source_text='' then 'skipped' when keep then case ost when 'running' then 'pending' else ost end else 'pending' end status,
    case when keep and (edited or source_text<>'') then oerr else '' end error,
    case when edited then case when otr<>'' then otr else 'manual_edit' end when keep then otr else '' end translator from f""", "fx_ocr fx_canon fx_translation")
def _(v):
    existing = v.translation.withColumn("canon_id", F.when(F.col("part_key") % 2 == 0, F.col("canon_id")).otherwise(""))
    return tr.init_translation(v.ocr, v.canon, existing)


@query("merge_translation", """with j as (select page_id, ocr_item_id, trim(text) source_text, x.* from fx_ocr left join (select page_id p, ocr_item_id i, trim(source_text) osrc, translated_text ott, status ost from fx_translation) x on p=page_id and i=ocr_item_id)
  select page_id, ocr_item_id, case when coalesce(ost='manually_edited',false) then 'manually_edited' when source_text='' then 'skipped' when coalesce(osrc=source_text,false) then case ost when 'running' then 'pending' else ost end else 'pending' end status,
    case when source_text='' then 'skipped' else 'pending' end forced from j""", "fx_ocr fx_translation")
def _(v):
    old = v.translation.select("page_id", "ocr_item_id", F.struct("source_text", "translated_text", "status", "error", "translator").alias("old"))
    base = v.ocr.select("page_id", "ocr_item_id", tr.strip(F.col("text")).alias("source_text")).join(old, ["page_id", "ocr_item_id"], "left")
    kept = tr.merge_translation(base).select("page_id", "ocr_item_id", "status")
    forced = tr.merge_translation(base, True).select("page_id", "ocr_item_id", F.col("status").alias("forced"))
    return kept.join(forced, ["page_id", "ocr_item_id"])


@query("translation_work_list", """with s as (select page_id, ocr_item_id, part_key%9=0 excluded, trim(source_text)<>'' filled, trim(translated_text)<>'' has, case when part_key%5=0 then 'skipped' when part_key%5=1 then 'pending' else status end status,
    translated_text, error from fx_translation)
  select page_id, ocr_item_id, not excluded and filled and not (status in ('manually_edited','skipped') or (status in ('done','error') and has)) wanted,
    case when not excluded and not filled then 'skipped' else status end status, case when not excluded and not filled then '' else translated_text end translated_text,
    case when not excluded and not filled then '' else error end error from s""", "fx_translation")
def _(v):
    p = F.col("part_key")
    items = v.translation.withColumns({
        "excluded": p % 9 == 0, "status": F.when(p % 5 == 0, "skipped").when(p % 5 == 1, "pending").otherwise(F.col("status")),
    })
    return tr.work_list(items).select("page_id", "ocr_item_id", "wanted", "status", "translated_text", "error")


@query("sync_from_canon", """with i as (select page_id, canon_id, x1, y1+part_key%2 y1, x2, y2, ox1, oy1, ox2, oy2, part_key%4=0 excluded from fx_ocr union all select page_id, 'gone', x1, y1, x2, y2, ox1, oy1, ox2, oy2, false from fx_ocr where ocr_item_id=0)
  select i.page_id, i.canon_id, case when c.enabled is null then i.y1 else c.y1 end y1, coalesce(not c.enabled, i.excluded) excluded,
    coalesce(c.enabled is not null and not (i.x1=c.x1 and i.y1=c.y1 and i.x2=c.x2 and i.y2=c.y2 and i.ox1=c.ox1 and i.oy1=c.oy1 and i.ox2=c.ox2 and i.oy2=c.oy2 and i.excluded=(not c.enabled)),false) changed
  from i left join fx_canon c on c.page_id=i.page_id and c.canon_id=i.canon_id""", "fx_ocr fx_canon")
def _(v):
    cols = ["page_id", "canon_id", "x1", "y1", "x2", "y2", "ox1", "oy1", "ox2", "oy2", "excluded"]
    p = F.col("part_key")
    items = v.ocr.withColumns({"y1": F.col("y1") + p % 2, "excluded": p % 4 == 0}).select(cols)
    gone = v.ocr.where("ocr_item_id = 0").withColumns({"canon_id": F.lit("gone"), "excluded": F.lit(False)}).select(cols)
    return tr.sync_from_canon(items.unionByName(gone), v.canon).select("page_id", "canon_id", "y1", "excluded", "changed")


@query("edit_item_texts", """with s as (select page_id, ocr_item_id, case when part_key%3=0 then ' ' else source_text||'!' end ns, trim(translated_text)<>'' has, status, case when part_key%4=0 then '' else 'T'||translated_text end nt, source_text from fx_translation)
  select page_id, ocr_item_id, case when has then status when trim(ns)='' then 'skipped' else 'pending' end source_status,
    case when trim(nt)<>'' then 'manually_edited' when trim(source_text)<>'' then 'pending' else 'skipped' end target_status, nt translated_text from s""", "fx_translation")
def _(v):
    p = F.col("part_key")
    a = tr.edit_source_text(v.translation, F.when(p % 3 == 0, " ").otherwise(F.concat("source_text", F.lit("!"))))
    b = tr.edit_translated_text(v.translation, F.when(p % 4 == 0, "").otherwise(F.concat(F.lit("T"), "translated_text")))
    key = ["page_id", "ocr_item_id"]
    return a.select(*key, F.col("status").alias("source_status")).join(b.select(*key, F.col("status").alias("target_status"), "translated_text"), key)


# ------------------------------------------------------------- terms

NAMES = [p for p in tm.NAME_PATTERNS[:3]]
COMMON = ",".join(f"'{w}'" for w in tm.COMMON_WORDS)
# RE2 has no look-around: separators are doubled so that neighbours do not share one
CAPITALS = r"regexp_extract_all(regexp_replace(text,'([^\p{L}\p{N}_])','\1\1','g'),'(?:^|[^\p{L}\p{N}_])([A-Z][a-z]{2,})(?:$|[^\p{L}\p{N}_])',1)"
TERM_ROWS = f"""ok as (select s.project_id, s.page_no from (select project_id, page_no, count(*) n from fx_source group by 1,2) s join (select project_id, page_no, count(*) m from fx_target group by 1,2) t
    on s.project_id=t.project_id and s.page_no=t.page_no where n=m),
  fl as (select s.* from fx_source s join fx_target t on s.project_id=t.project_id and s.page_no=t.page_no and s.line_no=t.line_no join ok on ok.project_id=s.project_id and ok.page_no=s.page_no where s.text<>'' and t.text<>''),
  cs as (select project_id, page_no, line_no, list_filter({' || '.join(f"regexp_extract_all(text,'{p}',1)" for p in NAMES)} || {CAPITALS}
    || list_filter(regexp_split_to_array(trim(text),'\\s+'), lambda w: w not in ({COMMON})), lambda w: length(w)>=2) c from fl),
  tr as (select project_id, page_no, line_no, generate_subscripts(c,1)-1 slot, unnest(c) term from cs),
  us as (select project_id, term, count(*) cnt, min((page_no, line_no, slot)) fs from tr group by 1,2),
  rk as (select *, row_number() over (partition by project_id order by cnt desc, fs) rnk from us)"""
SUMMARY = """ps as (select project_id, page_no, row_number() over (partition by project_id order by page_no)-1 as pos from (select distinct project_id, page_no from fx_target) q),
  ll as (select t.project_id, pos, line_no, text from fx_target t join ps on ps.project_id=t.project_id and ps.page_no=t.page_no where length(text)>10),
  sp as (select p.project_id, p.page_no, p.pos, l.text, row_number() over (partition by p.project_id, p.pos order by l.pos, l.line_no) n from ps p join ll l on l.project_id=p.project_id and l.pos between p.pos-2 and p.pos),
  sm as (select ps.project_id, ps.page_no, ps.pos, coalesce(string_agg(sp.text,' | ' order by n)||'...','') summary from ps left join sp on sp.project_id=ps.project_id and sp.pos=ps.pos and n<=3 group by 1,2,3)"""


def _rows(v):
    return tm.term_rows(v.source, v.target)


@query("term_usage", f"with {TERM_ROWS} select project_id, term, cnt from us", "fx_source fx_target")
def _(v):
    return tm.term_usage(_rows(v)).select("project_id", "term", "cnt")


@query("priority_terms", f"with {TERM_ROWS} select project_id, term, cnt, rnk::bigint rnk from rk where rnk<=20", "fx_source fx_target")
def _(v):
    return tm.priority_terms(tm.term_usage(_rows(v))).select("project_id", "term", "cnt", F.col("rank").cast("long").alias("rnk"))


@query("frequent_terms", f"with {TERM_ROWS} select project_id, term, cnt from rk where rnk<=15 and cnt>=2", "fx_source fx_target")
def _(v):
    return tm.frequent_terms(tm.term_usage(_rows(v))).select("project_id", "term", "cnt")


@query("running_term_usage", f"""with {TERM_ROWS}, pp as (select project_id, page_no, term, count(*) cnt from tr group by 1,2,3)
  select *, coalesce(sum(cnt) over (partition by project_id, term order by page_no rows between unbounded preceding and 1 preceding),0)::bigint known_before from pp""", "fx_source fx_target")
def _(v):
    return tm.running_term_usage(_rows(v))


@query("story_summary", f"with {SUMMARY} select project_id, page_no, pos as position, summary from sm", "fx_target")
def _(v):
    return tm.story_summary(v.target)


@query("chunk_summaries", f"""with {SUMMARY}, ch as (select project_id, pos//2 as chunk, max(page_no) page_no from ps group by 1,2)
  select ch.project_id, chunk, ch.page_no, summary from ch join sm on sm.project_id=ch.project_id and sm.page_no=ch.page_no""", "fx_target")
def _(v):
    return tm.chunk_summaries(v.target, 2)


REPLIES = """rp as (select project_id, page_no, concat(source_text, chr(10), '[TERMS]', chr(10), 'N', cast(project_id%3 as varchar), ' → n', cast(page_no as varchar), chr(10), 'no pair', chr(10), ' A → b → c ', chr(10), ' → x', chr(10), '[/TERMS] tail') reply from fx_pair),
  tp as (select project_id, 'N'||cast(project_id%3 as varchar) term, 'n'||cast(max(page_no) as varchar) translation from rp group by 1 union all select distinct project_id, 'A', 'b → c' from rp)"""


def _term_pairs(v):
    reply = F.concat(
        "source_text", F.lit("\n[TERMS]\nN"), (F.col("project_id") % 3).cast("string"), F.lit(" → n"), F.col("page_no").cast("string"),
        F.lit("\nno pair\n A → b → c \n → x\n[/TERMS] tail"),
    )
    return tm.term_pairs(v.pair.select("project_id", "page_no", reply.alias("reply")))


@query("parse_terms", f"with {REPLIES} select * from tp", "fx_pair")
def _(v):
    return _term_pairs(v).select("project_id", "term", "translation")


@query("context_stats", f"""with {TERM_ROWS}, {REPLIES}, {SUMMARY}, rc as (select project_id, least(5,count(*)) recent_pages from ps group by 1), kn as (select project_id, count(*) total_terms, count(*) filter (where term<>'A') character_names from tp group by 1),
  tw as (select project_id, count(*) tracked_words from us group by 1), hs as (select project_id, arg_max(summary,page_no)<>'' has_summary from sm group by 1)
  select rc.project_id, recent_pages, coalesce(tracked_words,0) tracked_words, coalesce(total_terms,0) total_terms, coalesce(character_names,0) character_names, coalesce(has_summary,false) has_summary
  from rc left join tw using (project_id) left join kn using (project_id) left join hs using (project_id)""", "fx_source fx_target fx_pair")
def _(v):
    known = _term_pairs(v).withColumn("is_name", F.col("term") != "A")
    return tm.context_stats(tm.term_usage(_rows(v)), v.target, known, tm.story_summary(v.target))


@query("context_prompt", f"""with {TERM_ROWS}, {REPLIES}, {SUMMARY}, a as (select project_id, 'CHARACTER NAMES (use consistently):'||chr(10)||string_agg('  '||term||' → '||translation||chr(10),'' order by term desc) a from tp group by 1),
  b as (select rk.project_id, 'KEY TERMS (translate consistently):'||chr(10)||string_agg('  '||rk.term||' (×'||cast(cnt as varchar)||')'||chr(10),'' order by rnk) b from rk where rnk<=15 and cnt>=2 group by 1),
  c as (select project_id, case when arg_max(summary,page_no)<>'' then 'STORY SO FAR:'||chr(10)||'  '||arg_max(summary,page_no)||chr(10) end c from sm group by 1)
  select c.project_id, '---'||chr(10)||'CONTEXT MEMORY:'||chr(10)||coalesce(a,'')||coalesce(b,'')||coalesce(c,'')||'---'||chr(10) prompt from c left join a using (project_id) left join b using (project_id)""", "fx_source fx_target fx_pair")
def _(v):
    pairs = _term_pairs(v)
    names = pairs.withColumn("rank", F.when(F.col("term") == "A", 2).otherwise(1))
    return tm.context_prompt(tm.term_usage(_rows(v)), names, pairs, tm.story_summary(v.target))
