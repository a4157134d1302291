"""Page tables derived from the given tables, the same in Spark and in plain SQL.

Pages are 1000 x 1400 px. Every view is a full scan of its base tables.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pagestrata.session import forget, written

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

PAGE_W, PAGE_H = 1000, 1400

# view name -> (views it reads, SQL text shared by both engines)
SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_region": ((), """
        select page_id,
          cast(row_number() over (partition by page_id
            order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as bigint) region_id,
          case when is_bubble then 'bubble' else 'layout' end det_kind,
          cast(ax as bigint) x1, cast(ay as bigint) y1,
          cast(ax + case when is_bubble then 120 + l_partkey % 180 else 30 + l_partkey % 90 end as bigint) x2,
          cast(ay + case when is_bubble then 140 + l_suppkey % 200 else 30 + l_suppkey % 100 end as bigint) y2,
          cast(l_partkey % 100 as double) / 100 score,
          case l_partkey % 5 when 0 then 'text' when 1 then 'doc_title' when 2 then 'figure'
            when 3 then 'caption' else 'table' end label,
          l_partkey % 17 = 0 excluded,
          case when l_partkey % 4 = 0 then cast(l_linenumber as bigint) end reading_order,
          l_partkey part_key, l_suppkey supp_key,
          cast(1000 as bigint) w, cast(1400 as bigint) h
        from (
          select cast(floor(l_orderkey / 8.0) as bigint) page_id, l_orderkey, l_linenumber, l_partkey,
            l_suppkey, l_quantity, l_extendedprice,
            (l_partkey + l_linenumber) % 3 = 0 is_bubble,
            (l_partkey * 7919 + l_linenumber * 131 + l_orderkey * 17) % 1000 - 20 ax,
            (l_suppkey * 104729 + l_partkey * 31 + l_orderkey * 53) % 1400 - 20 ay
          from {lineitem}) raw"""),
    "fx_page": ((), """
        select page_id, page_id % 25 project_id, cast(floor(page_id / 25.0) as bigint) page_no,
          concat('source/p', cast(page_id as varchar(20)), '.png') source_path,
          cast(1000 as bigint) w, cast(1400 as bigint) h,
          case when page_id % 11 = 0 then 'error' when page_id % 7 = 0 then 'failed' else 'done' end ocr_status,
          page_id % 3 = 0 render_exists, page_id % 5 = 0 render_stale
        from (select distinct cast(floor(l_orderkey / 8.0) as bigint) page_id from {lineitem}) q"""),
    "fx_rawbox": (("fx_region",), """
        select page_id, region_id, w, h,
          case when region_id % 29 = 7 then 'n/a' when region_id % 31 = 5 then ''
            else cast(case when region_id % 5 = 0 then x2 else x1 end + (part_key % 4) * 0.25e0 as varchar(20)) end a1,
          cast(case when region_id % 3 = 0 then y2 else y1 end + (supp_key % 4) * 0.25e0 as varchar(20)) b1,
          cast(case when region_id % 5 = 0 then x1 else x2 end + (part_key % 2) * 0.5e0 as varchar(20)) a2,
          cast(case when region_id % 3 = 0 then y1 else case when region_id % 7 = 0 then y1 + 3 else y2 end end as varchar(20)) b2
        from fx_region"""),
    "fx_canon": (("fx_region",), """
        select page_id, region_id, concat('item_', lpad(cast(region_id as varchar(20)), 4, '0')) canon_id,
          case when det_kind = 'bubble' then 'bubble' else 'layout_text' end kind, not excluded enabled,
          x1, y1, x2, y2, x1 + 10 ox1, y1 + 10 oy1, x2 - 10 ox2, y2 - 10 oy2, reading_order, part_key, supp_key,
          case when det_kind = 'bubble' then region_id end bubble_id,
          case when part_key % 3 <> 0 then part_key % 7 end ref_id,
          part_key % 23 = 0 manual, part_key % 19 = 0 ocr_edited, part_key % 29 = 0 render_edited, w, h
        from (select page_id, region_id, det_kind, excluded, reading_order, part_key, supp_key, w, h,
            greatest(0, least(x1, 1000)) x1, greatest(0, least(y1, 1400)) y1,
            greatest(0, least(x2, 1000)) x2, greatest(0, least(y2, 1400)) y2 from fx_region) q
        where x2 - x1 >= 30 and y2 - y1 >= 30"""),
    "fx_ocr": (("fx_canon",), """
        select c.page_id, c.region_id ocr_item_id, c.canon_id, c.kind,
          case when c.region_id % 13 = 0 then '' else concat(p.p_name, ' ', p.p_brand, ' ', p.p_type) end text,
          case c.region_id % 5 when 0 then 'done' when 1 then 'prepared' when 2 then 'error'
            when 3 then 'skipped' else 'running' end status,
          c.region_id % 7 = 0 needs_ocr, not c.enabled excluded,
          c.x1, c.y1, c.x2, c.y2, c.ox1, c.oy1, c.ox2, c.oy2, c.part_key, c.w, c.h,
          case c.part_key % 3 when 0 then 'deepseek_ocr_llama' when 1 then 'paddleocr_vl_llama' else 'chrome_lens' end provider
        from fx_canon c join {part} p on p.p_partkey = c.part_key"""),
    "fx_translation": (("fx_ocr",), """
        select page_id, case when gone then ocr_item_id + 1000000 else ocr_item_id end ocr_item_id,
          case when gone then concat('gone_', canon_id) else canon_id end canon_id, part_key,
          case when ocr_item_id % 4 = 0 then concat(text, ' changed') else text end source_text,
          case when ocr_item_id % 6 = 0 then '' else concat('tr:', text) end translated_text,
          case (page_id + ocr_item_id) % 4 when 0 then 'manually_edited' when 1 then 'done'
            when 2 then 'error' else 'running' end status,
          case when (page_id + ocr_item_id) % 4 = 2 then 'timeout' else '' end error,
          case when part_key % 2 = 0 then 'gemini' else '' end translator
        from (select *, (page_id + ocr_item_id) % 3 = 0 gone from fx_ocr) q"""),
    "fx_pair": ((), """
        select u.conv_id project_id, u.turn page_no, u.text source_text, a.text translated_text
        from {conversations} u join {conversations} a on a.conv_id = u.conv_id and a.turn = u.turn + 1
        where u.role = 'user' and a.role = 'assistant'"""),
    "fx_event": ((), """
        select event_id, ts, concat('cmd_', cast(user_id % 10 as varchar(20))) command_id,
          case event_id % 5 when 0 then 'detection' when 1 then 'ocr' when 2 then 'translation'
            when 3 then 'inpaint' else 'render' end stage,
          case event_type when 'click' then 'page_start' when 'view' then 'item_done'
            when 'error' then 'page_error' else 'page_done' end event,
          user_id % 200 page_id, value
        from {events}"""),
    "fx_pixel": ((), """
        select cast(floor(l_orderkey / 8.0) as bigint) page_id, cast(l_linenumber as bigint) region_id,
          l_partkey % 1400 y, l_partkey % 256 b, (l_suppkey * 7) % 256 g, (l_partkey * 3 + l_suppkey) % 256 r
        from {lineitem}"""),
    "fx_row": ((), """
        select strip_id, y, case when floor(y / (97.0 + strip_id % 5)) % 9 = 0 then 250.0e0 else 128.0e0 end mean_luma
        from (select cast(floor(l_suppkey / 10.0) as bigint) strip_id,
            cast(row_number() over (partition by cast(floor(l_suppkey / 10.0) as bigint)
              order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as bigint) y
          from {lineitem}) q"""),
    "fx_doc": ((), """
        select doc_id, text, lang, source,
          case doc_id % 3 when 2 then 'chrome_lens' else 'deepseek_ocr_llama' end provider
        from {documents}"""),
}

# views whose unnesting differs: name -> (views it reads, Spark text, DuckDB text)
DIALECT: dict[str, tuple[tuple[str, ...], str, str]] = {
    "fx_line": ((), """
        select doc_id, cast(pos as bigint) line_no, line
        from (select doc_id, posexplode(split(text, '\\n')) as (pos, line) from {documents})""", """
        select doc_id, cast(generate_subscripts(a, 1) - 1 as bigint) line_no, unnest(a) line
        from (select doc_id, string_split(text, chr(10)) a from {documents}) q"""),
    "fx_source": (("fx_pair",), """
        select project_id, page_no, cast(pos as bigint) line_no, line text
        from (select project_id, page_no, posexplode(split(source_text, '[.] ')) as (pos, line) from fx_pair)""", """
        select project_id, page_no, cast(generate_subscripts(a, 1) - 1 as bigint) line_no, unnest(a) text
        from (select project_id, page_no, string_split(source_text, '. ') a from fx_pair) q"""),
    "fx_target": (("fx_pair",), """
        select project_id, page_no, cast(pos as bigint) line_no, line text
        from (select project_id, page_no, posexplode(split(translated_text, '[.] ')) as (pos, line) from fx_pair)""", """
        select project_id, page_no, cast(generate_subscripts(a, 1) - 1 as bigint) line_no, unnest(a) text
        from (select project_id, page_no, string_split(translated_text, '. ') a from fx_pair) q"""),
}


def _needs(name: str) -> tuple[str, ...]:
    return SHARED[name][0] if name in SHARED else DIALECT[name][0]


def _in_order(names: Sequence[str]) -> list[str]:
    done: list[str] = []
    for name in names:
        for each in [*_in_order(_needs(name)), name]:
            if each not in done:
                done.append(each)
    return done


def _text(name: str, engine: int) -> str:
    return SHARED[name][1] if name in SHARED else DIALECT[name][1 + engine]


def with_views(sql: str, names: Sequence[str]) -> str:
    """The SQL with the views it reads as CTEs in front, for DuckDB. Each CTE is computed once, however often it is read."""
    ctes = [
        f"{n} as materialized ({_text(n, 1).format(**{t: t for t in BASE_TABLES})})" for n in _in_order(names)
    ]
    body = sql.strip()
    recursive = body.lower().startswith("with recursive ")
    if not recursive:
        body = re.sub(r"(^with |,\s*)(\w+) as \((?=\s*select)", r"\1\2 as materialized (", body, flags=re.IGNORECASE)
    if not ctes:
        return body
    if recursive:
        return "with recursive " + ",\n".join(ctes) + ",\n" + body[len("with recursive "):]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(ctes) + ",\n" + body[len("with "):]
    return "with " + ",\n".join(ctes) + "\n" + body


class Views:
    """Lazy access to the given tables and the derived views of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self.kept = spark, sf_dir.rstrip("/"), {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def keep(self, name: str) -> None:
        """Compute a view once and write it whole, for queries that read it, or views on top of it, more than once."""
        self.kept[f"fx_{name}"] = written(getattr(self, name), name)

    def drop(self, name: str) -> None:
        """Delete a kept view that nothing reads any more."""
        forget(self.spark, self.kept.pop(f"fx_{name}"))

    def __getattr__(self, name: str) -> DataFrame:
        view = f"fx_{name}"
        if view not in SHARED and view not in DIALECT:
            raise AttributeError(name)
        tables = {t: f"parquet.`{self.sf_dir}/{t}.parquet`" for t in BASE_TABLES}
        texts = {n: _text(n, 0).format(**tables) for n in _in_order([view])} | {n: f"select * from parquet.`{path}`" for n, path in self.kept.items()}
        ctes = [f"{n} as ({texts[n]})" for n in _in_order([view])]
        return self.spark.sql("with " + ",\n".join(ctes) + f"\nselect * from {view}")
