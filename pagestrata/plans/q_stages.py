"""Model stages with deterministic stand-ins, sources round trips and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pagestrata.functions.geometry import EDGES, box
from pagestrata.operators import canon as cn
from pagestrata.operators import export as ex
from pagestrata.operators import memory as mm
from pagestrata.operators import stages as sg
from pagestrata.operators import status as st
from pagestrata.operators import terms as tm
from pagestrata.operators import translation as tr
from pagestrata.plans.q_text import FILTER_CTES, FLAGS
from pagestrata.plans.q_translation import SUMMARY, TERM_ROWS
from pagestrata.plans.registry import query
from pagestrata.session import saved, shared_folder
from pagestrata.sources import documents as docs
from pagestrata.sources.images import import_names, png_size
from pagestrata.streaming import context as cm
from pagestrata.streaming import jobs


def scratch(v, name: str) -> str:
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


class EchoOcr:
    """Returns the stored text; one item in seventeen fails."""

    def call(self, row):
        if row["seed"] % 17 == 0:
            raise RuntimeError("no answer")
        return {"raw_text": row["truth"]}


class PrefixPages:
    """Whole pages with a prefix; fails or shortens some of them."""

    def call(self, row):
        pages = row["pages"]
        if len(pages) > 1 and any(p["page_no"] % 8 == 6 for p in pages):
            raise RuntimeError("batch refused")
        return {"answers": [
            {"page_no": p["page_no"], "lines": ["tr:" + x for x in p["lines"]][: -1 if p["page_no"] % 4 == 2 else None]} for p in pages
        ]}


class PrefixLines:
    def call(self, row):
        return {"lines": ["ln:" + x for x in row["source_lines"]][: -1 if row["project_id"] % 2 else None]}


@query("recognise_items", f"""with src as (select doc_id, text raw, provider from fx_doc), {FLAGS}, {FILTER_CTES}
  select doc_id, case when doc_id%17=0 then 'error' when reason<>'' then 'skipped' else 'done' end status, case when doc_id%17=0 then '' else reason end skip_reason,
    case when doc_id%17=0 or reason<>'' then '' when some_bad then kept else t end as text from vd""", "fx_doc")
def _(v):
    items = v.doc.select("doc_id", "provider", F.col("text").alias("truth"), F.col("doc_id").alias("seed"), F.lit("").alias("text"), F.lit("prepared").alias("status"), F.lit(False).alias("excluded"), F.lit(False).alias("needs_ocr"), F.lit("").alias("error"))
    return sg.recognise_items(items, EchoOcr).select("doc_id", "status", "skip_reason", "text")


@query("translate_pages", """with l as (select *, count(*) over (partition by project_id, page_no) n from fx_source),
  ps as (select project_id, page_no, row_number() over (partition by project_id order by page_no)-1 p from (select distinct project_id, page_no from fx_source) q), ck as (select *, p//2 as ch from ps),
  cb as (select project_id, ch, bool_or(page_no%8=6) and count(*)>1 refused from ck group by 1,2)
  select l.project_id, l.page_no, line_no, text, case when page_no%4<>2 then 'tr:'||text when project_id%2=0 then 'ln:'||text when line_no<n-1 then 'ln:'||text else text end translated,
    case when l.page_no%4=2 then case when project_id%2=0 then 'lines' else 'original' end when refused then 'page' else 'batch' end recovered_by from l join ck using (project_id, page_no) join cb using (project_id, ch)""", "fx_source")
def _(v):
    return sg.translate_pages(v.source, PrefixPages, PrefixLines, 2)


@query("open_detection_pages", "select page_id from fx_page where not (render_exists and not render_stale)", "fx_page")
def _(v):
    now = v.page.select("page_id", F.lit("m1").alias("model"))
    old = v.page.where("render_exists").select("page_id", F.when(F.col("render_stale"), "m0").otherwise("m1").alias("model"))
    return st.work_pages(v.page.select("page_id"), st.reusable_detections(now, old, ["model"]))


@query("run_outcomes", """with e as (select page_id, stage, bool_or(event='page_error') bad from fx_event group by 1,2), k as (select *, case stage when 'detection' then 0 when 'ocr' then 1 when 'translation' then 2 when 'inpaint' then 3 else 4 end n from e)
  select page_id, stage, case when bad then 'error' else 'done' end status from k where not exists (select 1 from k b where b.page_id=k.page_id and b.n<k.n and b.bad)""", "fx_event")
def _(v):
    rolled = v.event.groupBy("page_id", "stage").agg(F.when(F.bool_or(F.col("event") == "page_error"), "error").otherwise("done").alias("status"))

    def stage_of(name):
        return name, lambda pages: rolled.where(F.col("stage") == name).join(pages.select("page_id"), "page_id").select("page_id", "status", F.lit("").alias("error"))

    pages = rolled.select("page_id").distinct()
    return sg.run_stages(pages, [stage_of(n) for n in ("detection", "ocr", "translation", "inpaint", "render")])[0].select("page_id", "stage", "status")


class Busy:
    """Refuses the first calls for a row, as many as its ``refusals``; -1 is a used-up quota."""

    def __init__(self):
        self.asked = {}

    def call(self, row):
        n = self.asked[row["doc_id"]] = self.asked.get(row["doc_id"], 0) + 1
        if row["refusals"] < 0:
            raise RuntimeError("quota exceeded")
        if n <= row["refusals"]:
            raise RuntimeError(f"busy {n}")
        return {"raw_text": row["truth"]}


@query("retries", """select doc_id, r<3 and r>=0 ok, case when r<0 then 'quota exceeded' when r>=3 then 'busy 3' else '' end as error, case when r<0 then '1:quota exceeded' else array_to_string(list_transform(range(1, least(r,3)+1), lambda n: cast(n as varchar)||':busy '||cast(n as varchar)), ';') end tries
  from (select doc_id, length(text)%6-1 r from fx_doc) q""", "fx_doc")
def _(v):
    rows = v.doc.select("doc_id", F.col("text").alias("truth"), (F.length("text") % 6 - 1).alias("refusals"))
    done = sg.run_provider(rows, Busy, sg.TEXT_RESULT, 3, 0.0)
    return done.select("doc_id", "ok", "error", F.array_join(F.transform("tries", lambda t: F.concat_ws(":", t["attempt"].cast("string"), t["error"])), ";").alias("tries"))


# ------------------------------------------------------------- sources


@query("stage_table_round_trip", "select page_id, ocr_item_id, text, status, page_id%25 project_id from fx_ocr", "fx_ocr")
def _(v):
    path = scratch(v, "stage")
    docs.write_stage(v.ocr.select("page_id", "ocr_item_id", "text", "status", (F.col("page_id") % 25).alias("project_id")), "ocr", path)
    return docs.read_stage(v.spark, "ocr", path).select("page_id", "ocr_item_id", "text", "status", F.col("project_id").cast("long").alias("project_id"))


def written(v, stage: str, made):
    """Documents (``page_id`` and their fields) as JSON lines. One page in ten has another stage's name, one is broken."""
    path, page = scratch(v, stage), F.col("page_id") % 10
    fields = [c for c in made.columns if c != "page_id"]
    value = F.to_json(F.struct(
        F.when(page == 3, "other").otherwise(F.lit(stage)).alias("stage"), F.concat(F.lit("source/p"), F.col("page_id").cast("string"), F.lit(".png")).alias("source_image"), *fields))
    made.select(F.when(page == 7, F.concat(F.lit("{"), value)).otherwise(value).alias("value")).write.option("compression", "gzip").text(path)
    return path


def listed(rows, key: str, *fields):
    """Item list of each page in the order of ``key``; ``k`` is a field no reader knows."""
    return rows.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), *fields))).alias("items"))


def page_of_key():
    return F.substring("page_key", 2, 20).cast("long").alias("page_id")


READABLE = "page_id%10 not in (3,7)"


@query("scan_ocr_documents", f"""select page_id, case when part_key%5=0 then row_number() over (partition by page_id order by ocr_item_id)-1 else ocr_item_id end id, canon_id, text,
  case when part_key%2=0 then 'prepared' else status end status, needs_ocr, false excluded from fx_ocr where {READABLE}""", "fx_ocr")
def _(v):
    p = F.col("part_key")
    made = listed(v.ocr, "ocr_item_id", F.when(p % 5 != 0, F.col("ocr_item_id")).alias("id"), "canon_id", "text", F.when(p % 2 == 1, F.col("status")).alias("status"), "needs_ocr")
    items = docs.scan_items(v.spark, written(v, "ocr", made), "ocr", lines=True)["items"]
    return items.select(page_of_key(), F.col("id").cast("long").alias("id"), "canon_id", "text", "status", "needs_ocr", "excluded")


@query("unknown_fields_return", f"""select page_id, count(*) item_count, '['||string_agg('{{"id":'||cast(rn as varchar)||',"canon_id":"'||canon_id||'"'||case when part_key%3=0 then ',"k":'||cast(ocr_item_id as varchar)||',"odd":{{"p":['||cast(part_key as varchar)||',null]}}' else ',"k":'||cast(ocr_item_id as varchar) end||'}}',',' order by rn)||']' as document,
  '{{"note":"n'||cast(page_id as varchar)||'"}}' extra from (select *, row_number() over (partition by page_id order by ocr_item_id)-1 rn from fx_ocr where {READABLE}) q group by 1""", "fx_ocr")
def _(v):
    p = F.col("part_key")
    odd = F.when(p % 3 == 0, F.struct(F.array(p, F.lit(None)).alias("p"))).alias("odd")
    made = listed(v.ocr, "ocr_item_id", "canon_id", odd).withColumn("note", F.concat(F.lit("n"), F.col("page_id").cast("string")))
    read = docs.scan_items(v.spark, written(v, "ocr", made), "ocr", lines=True)
    built = ex.page_documents(read["items"].select(page_of_key(), F.col("id").cast("long").alias("id"), "canon_id", "extra"), ["canon_id"], "extra")
    return built.join(read["documents"].select(page_of_key(), F.to_json("extra").alias("extra")), "page_id")


@query("scan_rejected_documents", "select page_id%10=7 broken, count(*) n from (select distinct page_id from fx_ocr) q where page_id%10 in (3,7) group by 1", "fx_ocr")
def _(v):
    rejected = docs.scan_items(v.spark, written(v, "ocr", listed(v.ocr, "ocr_item_id", "canon_id")), "ocr", lines=True)["rejected"]
    return rejected.groupBy(F.col("_corrupt_record").isNotNull().alias("broken")).agg(F.count("*").alias("n"))


@query("scan_detection_documents", f"""with r as (select *, det_kind part, row_number() over (partition by page_id, det_kind order by region_id)-1 p from fx_region where {READABLE})
  select page_id, part, case when part_key%5=0 then p else region_id end id, x1, y1, x2, y2, score confidence, case when part='layout' then label end label, excluded, false manual from r
  union all select page_id, 'canon', region_id, x1, y1, x2, y2, null, 'layout_text', false, part_key%2=0 from r where det_kind='layout'""", "fx_region")
def _(v):
    v.keep("region")
    p, edges = F.col("part_key"), F.array(*EDGES).alias("bbox")
    id_, likely = F.when(p % 5 != 0, F.col("region_id")).alias("id"), F.col("score").alias("confidence")
    found, laid = v.region.where("det_kind = 'bubble'"), v.region.where("det_kind = 'layout'")
    bubbles = listed(found, "region_id", id_, edges, likely, "excluded").withColumnRenamed("items", "bubbles")
    layout = listed(laid, "region_id", id_, edges, likely, "label", "excluded").withColumnRenamed("items", "layout_regions")
    canon = listed(laid, "region_id", F.col("region_id").cast("string").alias("canon_id"), edges, (p % 2 == 0).alias("manual"))
    canon = canon.select("page_id", F.struct(F.lit(2).alias("schema_version"), "items").alias("canon_state"))
    got = docs.scan_detection(v.spark, written(v, "detection", bubbles.join(layout, "page_id", "full").join(canon, "page_id", "full")), lines=True)

    def part(rows, name, id_, confidence, label):
        box_ = (F.col("bbox")[i].cast("long").alias(e) for i, e in enumerate(EDGES))
        return rows.select(page_of_key(), F.lit(name).alias("part"), F.col(id_).cast("long").alias("id"), *box_, confidence.alias("confidence"), label.alias("label"), "excluded", "manual")

    none = F.lit(None)
    return part(got["bubbles"], "bubble", "id", F.col("confidence"), none.cast("string")).unionByName(
        part(got["layout_regions"], "layout", "id", F.col("confidence"), F.col("label"))).unionByName(
        part(got["canon_items"], "canon", "canon_id", none.cast("double"), F.col("kind")))


@query("scan_translation_documents", f"""select page_id, case when part_key%5=0 then row_number() over (partition by page_id order by ocr_item_id)-1 else ocr_item_id end id, canon_id, source_text, translated_text,
  case when part_key%2=0 then 'pending' else status end status, translator, status='manually_edited' manually_edited from fx_translation where {READABLE}""", "fx_translation")
def _(v):
    p = F.col("part_key")
    made = listed(
        v.translation, "ocr_item_id", F.when(p % 5 != 0, F.col("ocr_item_id")).alias("id"), "canon_id", "source_text", "translated_text",
        F.when(p % 2 == 1, F.col("status")).alias("status"), F.when(F.col("translator") != "", F.col("translator")).alias("translator"), (F.col("status") == "manually_edited").alias("manually_edited"))
    items = docs.scan_items(v.spark, written(v, "translation", made), "translation", lines=True)["items"]
    return items.select(page_of_key(), F.col("id").cast("long").alias("id"), "canon_id", "source_text", "translated_text", "status", "translator", "manually_edited")


@query("scan_render_documents", f"""select page_id, ocr_item_id id, text translated_text, case when part_key%2=0 then 'horizontal' else 'vertical' end writing_mode,
  case when part_key%3=0 then 'font '||canon_id end font_name, status, excluded from fx_ocr where {READABLE}""", "fx_ocr")
def _(v):
    p = F.col("part_key")
    style = F.when(p % 3 == 0, F.struct(F.concat(F.lit("font "), "canon_id").alias("font_name"))).alias("style_overrides")
    made = listed(v.ocr, "ocr_item_id", F.col("ocr_item_id").alias("id"), F.col("text").alias("translated_text"), F.when(p % 2 == 1, "vertical").alias("writing_mode"), style, "status", "excluded")
    items = docs.scan_items(v.spark, written(v, "render", made), "render", lines=True)["items"]
    return items.select(page_of_key(), F.col("id").cast("long").alias("id"), "translated_text", "writing_mode", F.col("style_overrides.font_name").alias("font_name"), "status", "excluded")


@query("scan_inpaint_documents", f"""select page_id, case when page_id%2=0 then 'done' else '' end status, count(*) item_count, count(*) filter (where enabled) active_item_count,
  'h'||cast(sum(x1) as varchar) text_mask_hash, cast(min(part_key) as varchar) radius from fx_canon where {READABLE} group by 1""", "fx_canon")
def _(v):
    made = v.canon.groupBy("page_id").agg(
        F.count("*").alias("item_count"), F.count_if("enabled").alias("active_item_count"), F.concat(F.lit("h"), F.sum("x1").cast("string")).alias("text_mask_hash"),
        F.create_map(F.lit("radius"), F.min("part_key").cast("string")).alias("settings")).withColumn("status", F.when(F.col("page_id") % 2 == 0, "done"))
    read = docs.scan_inpaint(v.spark, written(v, "inpaint", made), lines=True)["documents"]
    return read.select(
        page_of_key(), "status", F.col("item_count").cast("long").alias("item_count"), F.col("active_item_count").cast("long").alias("active_item_count"),
        "text_mask_hash", F.col("settings")["radius"].alias("radius"))


@query("scan_events", "select command_id, stage, event, page_id page_index, cast(event_id as varchar) message from fx_event", "fx_event")
def _(v):
    path = scratch(v, "events")
    v.event.select(F.to_json(F.struct("command_id", "stage", "event", F.col("page_id").alias("page_index"), F.col("event_id").cast("string").alias("message"), "value")).alias("value")).write.text(path)
    return docs.scan_events(v.spark, path).select("command_id", "stage", "event", F.col("page_index").cast("long").alias("page_index"), "message")


@query("scan_project_pages", "select project_id, source_path, min(page_no) slot, max(ocr_status) ocr_status from (select project_id, 'source/p'||cast(page_no//2 as varchar)||'.png' source_path, page_no, case when page_no%2=0 then ocr_status end ocr_status from fx_page) q group by 1,2", "fx_page")
def _(v):
    stages = F.create_map(F.lit("ocr"), F.struct(F.col("ocr_status").alias("status"), F.lit("").alias("cache_path"), F.lit("").alias("error"), F.lit(False).alias("stale")))
    path = F.concat(F.when(F.col("page_no") % 3 == 0, "/old/").otherwise("source/"), F.lit("p"), F.floor(F.col("page_no") / 2).cast("string"), F.lit(".png"))
    made = v.page.groupBy("project_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("page_no", path.alias("source_path"), F.struct(F.col("ocr_status").alias("s")).alias("x")))), lambda p: F.struct(p["source_path"], F.create_map(F.lit("ocr"), F.struct(
            p["x"]["s"].alias("status"), F.lit("").alias("cache_path"), F.lit("").alias("error"), F.lit(False).alias("stale"))).alias("stages"))).alias("pages"))
    base = made.select("project_id", F.lit("n").alias("name"), F.lit(0).alias("current_page_index"), "pages", F.lit(None).cast("array<string>").alias("source_images"))
    pages = docs.project_pages(base)
    return pages.join(v.page.groupBy("project_id").agg(F.min("page_no").alias("m")), "project_id").select(
        "project_id", "source_path", (F.col("slot") + F.col("m")).alias("slot"), F.col("stages")["ocr"]["status"].alias("ocr_status"))


@query("scan_project_files", """with p as (select project_id, 'source/p'||cast(page_no//2 as varchar)||'.png' source_path, page_no from fx_page), d as (select project_id, source_path, min(page_no) page_no from p group by 1,2), n as (select project_id, count(*) n, min(page_no) m from d group by 1)
  select 'project '||cast(project_id as varchar) project_id, source_path, page_no-m slot, greatest(0, least(project_id*3-20, n-1)) current_page_index, case when project_id%2=0 then 'done' end ocr_status from d join n using (project_id)""", "fx_page")
def _(v):
    path, stages = scratch(v, "projects"), F.when(F.col("project_id") % 2 == 0, F.create_map(F.lit("ocr"), F.struct(F.lit("done").alias("status"))))
    page = F.concat(F.when(F.col("page_no") % 3 == 0, "/old/").otherwise("source/"), F.lit("p"), F.floor(F.col("page_no") / 2).cast("string"), F.lit(".png"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("page_no", page.alias("source_path")))), lambda p: F.struct(p["source_path"]))
    made = v.page.groupBy("project_id").agg(listed.alias("pages")).withColumn("pages", F.transform("pages", lambda p: F.struct(p["source_path"], stages.alias("stages"))))
    name = F.concat(F.lit("project "), F.col("project_id").cast("string")).alias("name")
    made.select(F.to_json(F.struct(name, "pages", (F.col("project_id") * 3 - 20).alias("current_page_index"), F.lit("x").alias("odd"))).alias("value")).write.text(path)
    pages = docs.scan_project(v.spark, path, lines=True)
    return pages.select("project_id", "source_path", "slot", F.col("current_page_index").cast("long").alias("current_page_index"), F.col("stages")["ocr"]["status"].alias("ocr_status"))


@query("import_names", """with n as (select c_custkey, c_mktsegment||'.PNG' name, row_number() over (partition by c_mktsegment order by lpad(cast(c_custkey as varchar),12,'0'))-1 k from customer)
  select c_custkey, case when k=0 then name else replace(name,'.PNG','')||'_'||cast(k as varchar)||'.PNG' end import_name from n""")
def _(v):
    files = v.table("customer").select("c_custkey", F.concat("c_mktsegment", F.lit(".PNG")).alias("name"), F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("path"))
    return import_names(files, "name", "path").select("c_custkey", "import_name")


@query("png_sizes", "select p_partkey, case when p_partkey%5=0 then 0 else p_partkey+100000 end width, case when p_partkey%5=0 then 0 else p_size::bigint end height from part")
def _(v):
    head = F.lit("89504E470D0A1A0A0000000D49484452")
    whole = F.concat(head, F.lpad(F.hex(F.col("p_partkey") + 100000), 8, "0"), F.lpad(F.hex("p_size"), 8, "0"))
    content = F.unhex(F.when(F.col("p_partkey") % 5 == 0, F.substring(whole, 1, 40)).otherwise(whole))
    df = v.table("part").withColumn("content", content)
    w, h = png_size(F.col("content"))
    return df.select("p_partkey", w.alias("width"), h.alias("height"))


# ------------------------------------------------------------- streams


def _event_stream(v):
    """The events table as a stream of files."""
    path = scratch(v, "events")
    v.event.repartition(3).write.parquet(path)
    return v.spark.readStream.schema(v.event.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(v, stream, shape, mode="append"):
    out, mark = scratch(v, "out"), scratch(v, "mark")
    jobs.into_batches(stream, out, mark, shape, mode).awaitTermination()
    return v.spark.read.parquet(out)


@query("progress_rollup", """with t as (select command_id, count(distinct page_id) total from fx_event group by 1) select command_id, stage, count(distinct page_id) done, total, least(100, count(distinct page_id)*100//total) percent
  from fx_event join t using (command_id) where event='page_done' group by 1,2,4""", "fx_event")
def _(v):
    totals = v.event.groupBy("command_id").agg(F.countDistinct("page_id").alias("total"))
    return jobs.progress_now(_run(v, jobs.progress_rollup(_event_stream(v)), lambda b: b, "update"), totals)


@query("latest_status", "select stage, arg_max(event, (ts, event_id)) as event, arg_max(page_id, (ts, event_id)) page_id from fx_event group by 1", "fx_event")
def _(v):
    return jobs.latest_batch(_run(v, jobs.latest_status(_event_stream(v)), lambda b: b, "complete"))


TERMS = r"""cs as (select project_id, page_no, line_no, list_filter({names} || regexp_extract_all(regexp_replace(text,'([^\p{{L}}\p{{N}}_])','\1\1','g'),'(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-z]{{2,}})(?:$|[^\p{{L}}\p{{N}}_])',1)
    || list_filter(regexp_split_to_array(trim(text),'\s+'), lambda w: w not in ({common})), lambda w: length(w)>=2) c from fx_source)"""


def _terms_sql():
    from pagestrata.operators import terms as tm

    names = " || ".join(f"regexp_extract_all(text,'{p}',1)" for p in tm.NAME_PATTERNS[:3])
    return TERMS.format(names=names, common=",".join(f"'{w}'" for w in tm.COMMON_WORDS))


@query("stream_context_terms", f"with {_terms_sql()}, x as (select project_id, unnest(c) term from cs) select project_id, term, count(*) cnt from x group by 1,2", "fx_source")
def _(v):
    path = scratch(v, "lines")
    v.source.repartition(4).write.parquet(path)
    stream = v.spark.readStream.schema(v.source.schema).option("maxFilesPerTrigger", 2).parquet(path)
    return jobs.merged_terms(_run(v, stream, jobs.term_counts)).select("project_id", "term", "cnt")


@query("stream_context_memory", f"""with {TERM_ROWS}, {SUMMARY}, lp as (select project_id, max(page_no) page_no, least(5, count(*)) recent_pages from ps group by 1),
  nm as (select project_id, count(*) names, string_agg(term||'='||tl, ';' order by term) named from (select project_id, 'N'||cast(page_no%3 as varchar) term, arg_max('n'||cast(page_no as varchar), page_no) tl from ps group by 1,2) q group by 1),
  tw as (select project_id, count(*) tracked, sum(cnt) mentions, string_agg(case when rnk<=20 then term||'='||cast(cnt as varchar) end, ';' order by rnk) top from rk group by 1)
  select lp.project_id, recent_pages, names, named, tracked, cast(mentions as bigint) mentions, top, summary from lp join nm using (project_id) left join tw using (project_id) join sm on sm.project_id=lp.project_id and sm.page_no=lp.page_no""", "fx_source fx_target")
def _(v):
    path, out = scratch(v, "pairs"), scratch(v, "memory")
    lines = v.source.join(v.target.select(*tr.LINE, F.col("text").alias("translated")), tr.LINE, "full")
    # lines of pages whose counts differ teach no terms; names come by the reply of a page, without weight here
    fine = tr.page_shapes(v.source, v.target).where("valid").select(*tr.PAGE, F.lit(True).alias("valid"))
    rows = lines.join(fine, tr.PAGE, "left").select(*tr.LINE, F.when(F.col("valid"), F.col("text")).otherwise("").alias("text"), "translated", F.timestamp_seconds(F.col("page_no") + 1_700_000_000).alias("at"),
        F.when(F.col("line_no") == 0, F.format_string("[TERMS]\nN%d → n%d\n[/TERMS]", F.col("page_no") % 3, "page_no")).alias("reply"))
    rows.repartitionByRange(3, "page_no").write.parquet(path)
    stream = v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    cm.run(cm.project_memory(stream, "1 hour"), out, scratch(v, "mark"))
    memory = cm.latest(v.spark, out)
    words = tm.priority_terms(mm.usage(memory).join(mm.names(memory).select("project_id", "term"), ["project_id", "term"], "left_anti"), 2**31 - 1)
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= 20, F.struct("rank", F.concat_ws("=", "term", "cnt").alias("t"))))), lambda x: x["t"]), ";")
    used = words.groupBy("project_id").agg(F.count("*").alias("tracked"), F.sum("cnt").alias("mentions"), top.alias("top"))
    named = mm.names(memory).groupBy("project_id").agg(F.count("*").alias("names"), F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "term", "translation"))), ";").alias("named"))
    return mm.stats(memory).select("project_id", "recent_pages").join(named, "project_id").join(used, "project_id", "left").join(mm.summaries(memory).select("project_id", "summary"), "project_id")


@query("stream_edits", """select page_id, canon_id, max(x1 + part_key%9) filter (where true) x1, count(*)::bigint n from fx_canon group by 1,2""", "fx_canon")
def _(v):
    path = scratch(v, "edits")
    p = F.col("part_key")
    log = v.canon.select("page_id", "canon_id", F.lit("bbox").alias("field"), F.explode(F.array(F.lit(0), F.lit(1))).alias("seq"), (F.col("x1") + p % 9).alias("e_x1"), F.col("y1").alias("e_y1"), (F.col("x2") + p % 9).alias("e_x2"), F.col("y2").alias("e_y2"))
    log = log.withColumn("e_x1", F.when(F.col("seq") == 0, F.col("e_x1") - 30).otherwise(F.col("e_x1")))
    # four batches of as many files each as tasks can write at once
    files = max(1, int(v.spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    log.repartition(4 * files, "page_id", "canon_id", "seq").write.parquet(path)
    stream = v.spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(path)
    edits = jobs.merged_edits(_run(v, stream, jobs.edit_batch))
    sized = v.canon.withColumns({"w": F.lit(2000), "bbox_edited": F.lit(False), **{f"r{e}": F.col(e) for e in EDGES}})
    moved = cn.edit_boxes(sized, edits).where("bbox_edited")
    return moved.groupBy("page_id", "canon_id").agg(F.max("x1").alias("x1"), F.count("*").alias("n"))


@query("incremental_pages", "select page_id, source_path from fx_page where not render_exists", "fx_page")
def _(v):
    path = scratch(v, "pages")
    listing = v.page.select("page_id", F.col("source_path").alias("path"), "render_exists")
    listing.select("page_id", "path").repartition(3).write.parquet(path)
    stream = v.spark.readStream.schema("page_id long, path string").option("maxFilesPerTrigger", 1).parquet(path)
    seen = _run(v, stream, jobs.new_pages(listing.where("render_exists")))
    return seen.select("page_id", F.col("path").alias("source_path"))


@query("incremental_stage", """with l as (select page_id, source_path path, case when page_id%4=0 then 1 else 0 end grown, ocr_status='done' and render_exists had, render_stale changed from fx_page)
  select path, cast(case when had and not changed then 0 else 1 end + grown as bigint) runs, cast(10+grown as bigint) threshold from l where not (had and not changed) or grown=1""", "fx_page")
def _(v):
    path, out = scratch(v, "pages"), scratch(v, "stage")
    old = v.page.where("ocr_status = 'done' and render_exists").select(F.col("source_path").alias("path"), F.when(F.col("render_stale"), 9).otherwise(10).cast("long").alias("threshold"))
    listing = v.page.select("page_id", F.col("source_path").alias("path"), F.lit(10).cast("long").alias("threshold"))
    # the same pages come again, every fourth one with another setting
    again = listing.withColumn("threshold", F.col("threshold") + F.when(F.col("page_id") % 4 == 0, 1).otherwise(0))
    listing.coalesce(1).write.parquet(path)
    again.coalesce(1).write.mode("append").parquet(path)
    stream = v.spark.readStream.schema(listing.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.stage_new_pages(stream, old, ["threshold"], lambda open_: open_, out, scratch(v, "mark")).awaitTermination()
    return v.spark.read.parquet(out).groupBy("path").agg(F.count("*").alias("runs"), F.max("threshold").alias("threshold"))


MOVES = """mv as (select page_id, region_id, canon_id, kind, part_key, x1, y1, x2, y2, part_key%3=0 hit, part_key%6=0 off from fx_canon),
  nw as (select page_id, row_number() over (partition by page_id order by region_id)-1 p, x1, y1, x2, y2 from fx_canon where part_key%10=0), nx as (select page_id, max(region_id)+1 n from fx_canon group by 1)"""


def _edit_log(v):
    """Two moves of every third item, the second one final, and one added box per tenth item; in the order of ``slot``."""
    p = F.col("part_key")
    cols = ["page_id", "slot", "canon_id", "kind", *EDGES, "excluded", "w", "h"]
    def move(n):
        return v.canon.where(p % 3 == 0).select("page_id", (F.col("region_id") + n * 1000000).alias("slot"), "canon_id", "kind", (F.col("x1") - n).alias("x1"), "y1", "x2", (F.col("y2") + n).alias("y2"), (p % 6 == 0).alias("excluded"), "w", "h")
    new = v.canon.where(p % 10 == 0).select("page_id", (F.col("region_id") + 3000000).alias("slot"), F.lit("").alias("canon_id"), F.lit("bubble").alias("kind"), *EDGES, F.lit(False).alias("excluded"), "w", "h")
    return [move(1).select(cols), move(2).select(cols), new.select(cols)]


def _edit_stream(v):
    """The log as a stream of one batch per part or so: each part is many files, all edits of a page in one of them."""
    path, parts = scratch(v, "edits"), _edit_log(v)
    for part in parts:
        part.repartition("page_id").write.mode("append").option("compression", "zstd").parquet(path)
    files = len(v.spark.read.parquet(path).inputFiles())
    return v.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", max(1, -(-files // len(parts)))).parquet(path)


def _editable(v):
    c = canon_table(v)
    return c.select("page_id", "canon_id", "kind", "enabled", "excluded", "manual", "bbox_edited", "ocr_edited", "render_edited", *EDGES, *(f"o{e}" for e in EDGES), *(f"r{e}" for e in EDGES), "w", "h")


def canon_table(v):
    p = F.col("part_key")
    return v.canon.withColumns({"excluded": ~F.col("enabled"), "manual": p % 23 == 0, "bbox_edited": F.lit(False), "render_edited": p % 29 == 0, **{f"r{e}": F.col(e) for e in EDGES}})


@query("stream_edit_batches", f"""with {MOVES} select page_id, canon_id, case when hit then not off else enabled end enabled, case when hit then greatest(0,c.x1-2) else c.x1 end x1, case when hit then least(1400,c.y2+2) else c.y2 end y2,
    case when hit and not ocr_edited then greatest(0,c.x1-2) else ox1 end ox1, coalesce(hit,false) bbox_edited, manual from fx_canon c join mv using (page_id, canon_id)
  union all select page_id, 'item_'||lpad(cast(n+p as varchar),4,'0'), true, x1, y2, x1, false, true from nw join nx using (page_id)""", "fx_canon")
def _(v):
    v.keep("canon")
    out, base, log = scratch(v, "state"), saved(_editable(v), "base"), _edit_stream(v)
    v.drop("canon")
    jobs.stream_edits(log, base, out, scratch(v, "mark")).awaitTermination()
    return jobs.page_state(v.spark, base, out).select("page_id", "canon_id", "enabled", "x1", "y2", "ox1", "bbox_edited", "manual")


@query("stream_edit_marks", """with p as (select distinct page_id from fx_canon where part_key%3=0 or part_key%10=0)
  select page_id, s as stage, case when s='detection' then 'edited' else 'stale' end mark from (select page_id, unnest(['detection','ocr','translation','inpaint','render','export']) s from p) q""", "fx_canon")
def _(v):
    v.keep("canon")
    out, base, log = scratch(v, "state"), saved(_editable(v), "base"), _edit_stream(v)
    v.drop("canon")
    jobs.stream_edits(log, base, out, scratch(v, "mark")).awaitTermination()
    return jobs.edit_marks_of(v.spark, out).select("page_id", "stage", "mark")


# ------------------------------------------------------------- translation with the memory of the chunks before


class ContextPages:
    """Answers that tell how long their context was; some pages are refused, cut short, out of quota, or teach names."""

    def call(self, row):
        page = row["pages"][0]
        k, project = page["page_no"] % 8, row["project_id"]
        if k == 2 and project % 11 == 4:
            raise RuntimeError("quota exceeded")
        if k == 4 and "chunk" in row:
            raise RuntimeError("batch refused")
        mark = f"tr{len(row['context'])}:"
        lines = ["" if i % 5 == 3 else mark + x for i, x in enumerate(page["lines"])]
        reply = "[TERMS]\nN → again\n[/TERMS]" if k == 4 else f"[TERMS]\nN → n{project}\nThe → T\n[/TERMS]" if k == 0 and project % 3 == 0 else None
        return {"answers": [{"page_no": page["page_no"], "lines": lines[: -1 if k == 6 else None]}], "reply": reply}


def _context_sql(rounds: int = 4) -> str:
    """The rounds of a project of up to four pages, one after the other."""
    from pagestrata.operators import terms as tm

    big = 2**62
    out = [_terms_sql(), """pg as materialized (select project_id, page_no, row_number() over (partition by project_id order by page_no)-1 pos from (select distinct project_id, page_no from fx_source) q),
  cd as materialized (select project_id, page_no, line_no, generate_subscripts(c,1)-1 slot, unnest(c) term from cs),
  ln as materialized (select s.*, pos, count(*) over (partition by project_id, page_no) n from fx_source s join pg using (project_id, page_no))""",
           f"""tg as (select project_id, pos, page_no, {big} line_no, 0 slot, 'N' term, 'n'||cast(project_id as varchar) tl from pg where page_no%8=0 and project_id%3=0
  union all select project_id, pos, page_no, {big}, 1, 'The', 'T' from pg where page_no%8=0 and project_id%3=0
  union all select project_id, pos, page_no, {big + 1}, 0, 'N', 'again' from pg where page_no%8=4)"""]
    for k in range(rounds + 1):
        before = " union all ".join(f"select * from dn{j}" for j in range(k)) or "select null::bigint project_id, null::bigint page_no, null::bigint line_no, null::bigint pos, null::varchar translated where false"
        out.append(f"""bf{k} as materialized ({before}),
  ct{k} as (select cd.project_id, cd.term, 1 w, (cd.page_no, cd.line_no, cd.slot) fs from cd join bf{k} b on b.project_id=cd.project_id and b.page_no=cd.page_no and b.line_no=cd.line_no where translated<>''
    union all select project_id, term, {tm.MANUAL_TERM_WEIGHT}, (page_no, line_no, slot) from tg where pos<{k}),
  rk{k} as (select *, row_number() over (partition by project_id order by cnt desc, fs) r from (select project_id, term, sum(w) cnt, min(fs) fs from ct{k} group by 1,2) q),
  nm{k} as (select project_id, term, arg_max(tl, pos) tl, min((pos, line_no, slot)) fs from tg where pos<{k} group by 1,2),
  na{k} as (select project_id, '{tm.NAMES_TITLE}'||chr(10)||string_agg('  '||term||' → '||tl||chr(10), '' order by fs) a from nm{k} group by 1),
  tb{k} as (select project_id, '{tm.TERMS_TITLE}'||chr(10)||string_agg(case when tl is null then '  '||term||' (×'||cast(cnt as varchar)||')'||chr(10) else '  '||term||' → '||tl||chr(10) end, '' order by r) b
    from rk{k} left join nm{k} using (project_id, term) where r<=15 and cnt>=2 group by 1),
  sl{k} as (select project_id, translated, row_number() over (partition by project_id order by pos, line_no) r from (select *, max(pos) over (partition by project_id) newest from bf{k}) q where length(translated)>10 and pos>newest-3),
  st{k} as (select project_id, 'STORY SO FAR:'||chr(10)||'  '||string_agg(translated, ' | ' order by r)||'...'||chr(10) c from sl{k} where r<=3 group by 1),
  pr{k} as materialized (select project_id, case when coalesce(a,b,c) is null then '' else '---'||chr(10)||'CONTEXT MEMORY:'||chr(10)||coalesce(a,'')||coalesce(b,'')||coalesce(c,'')||'---'||chr(10) end prompt
    from (select distinct project_id from pg) p left join na{k} using (project_id) left join tb{k} using (project_id) left join st{k} using (project_id))""")
        if k < rounds:
            out.append(f"""dn{k} as materialized (select project_id, page_no, line_no, pos, case when page_no%8=2 and project_id%11=4 then text
    when page_no%8=6 then case when project_id%2=0 or line_no<n-1 then 'ln:'||text else text end when line_no%5=3 then '' else 'tr'||cast(length(prompt) as varchar)||':'||text end translated
    from ln join pr{k} using (project_id) where pos={k})""")
    return "with " + ",\n".join(out)


CONTEXT_STEPS = "case when page_no%8=2 and project_id%11=4 then 'original' when page_no%8=6 then case when project_id%2=0 then 'lines' else 'original' end when page_no%8=4 then 'page' else 'batch' end"


@query("translate_in_context", f"{_context_sql()} select project_id, page_no, line_no, text, translated, {CONTEXT_STEPS} recovered_by from ln join bf4 using (project_id, page_no, line_no)", "fx_source")
def _(v):
    return sg.translate_in_context(v.source, ContextPages, PrefixLines, 1)[0]


@query("context_after_translation", f"{_context_sql()} select p.project_id, prompt, count(rk4.term) tracked_words, (select count(*) from nm4 where nm4.project_id=p.project_id) character_names, (select least(5, count(*)) from pg where pg.project_id=p.project_id) recent_pages from pr4 p left join rk4 using (project_id) group by 1,2", "fx_source")
def _(v):
    memory = sg.translate_in_context(v.source, ContextPages, PrefixLines, 1)[1]
    return mm.prompts(memory).join(mm.stats(memory), "project_id").drop("has_summary")
