"""Status roll-ups, stage reuse and stale marks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import geometry as g
from pagestrata.functions.geometry import box
from pagestrata.functions.paths import stem
from pagestrata.functions.text import strip

# Fixed values
OCR_STATES = ("prepared", "running", "done", "error", "skipped")
TRANSLATION_STATES = ("pending", "done", "error", "skipped", "manually_edited")
RENDER_STATES = ("rendered", "skipped", "error")
FAILED_STATES = ("error", "failed")
MIN_RENDER_AREA = 64
DOWNSTREAM = {
    ("detection", "file"): ("ocr", "translation", "inpaint", "render", "export"),
    ("detection", "project"): ("ocr", "translation", "inpaint", "render", "export"),
    ("ocr", "file"): ("translation", "inpaint", "render", "export"),
    ("ocr", "project"): ("ocr", "translation", "inpaint", "render", "export"),
    ("render", "file"): ("render", "export"),
    ("render", "project"): ("render", "export"),
}


def clean_status(status: Column, default: str = "") -> Column:
    text = F.lower(strip(F.coalesce(status, F.lit(""))))
    return F.when(text == "", default).otherwise(text)


def status_counts(items: DataFrame, keys: Sequence[str], states: Sequence[str], default: str = "") -> DataFrame:
    """Counts by status; excluded items only in ``excluded``, unknown ones only in ``total``."""
    live = ~F.coalesce("excluded", F.lit(False))
    state = clean_status(F.col("status"), default)
    return items.groupBy(*keys).agg(
        F.count_if(live).alias("total"), *(F.count_if(live & (state == s)).alias(s) for s in states), F.count_if(~live).alias("excluded")
    )


def edit_counts(items: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    live = ~F.coalesce("excluded", F.lit(False))
    return items.groupBy(*keys).agg(
        F.count_if(live).alias("active_items"), F.count_if(~live).alias("excluded_items"),
        F.count_if(live & F.coalesce(flag, F.lit(False))).alias(f"{flag}_items"),
    )


def inpaint_summary(meta: DataFrame) -> DataFrame:
    """Done but stale pages show as prepared; artefact flags from their paths."""
    stale = F.coalesce("needs_inpaint", F.lit(False))
    shown = F.when(stale & (clean_status(F.col("status")) == "done"), "prepared").otherwise(F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("pending")))
    has = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    return meta.withColumns({
        "status": shown, "needs_inpaint": stale, "item_count": F.coalesce("item_count", F.lit(0)),
        "has_output_image": has("output_image_path"), "has_text_mask": has("text_mask_path"), "has_bubble_mask": has("bubble_mask_path"),
    })


def page_status(pages: DataFrame, stages: DataFrame, processing: Column) -> DataFrame:
    """error, missing, ready or done for each page.

    ``stages`` hold ``page_id, stage, status, stale``; pages ``has_canon, render_exists``.
    """
    rolled = stages.groupBy("page_id").agg(
        F.bool_or(clean_status(F.col("status")).isin(*FAILED_STATES)).alias("__bad"),
        F.bool_or((F.col("stage") == "render") & F.coalesce("stale", F.lit(False))).alias("__stale"),
    )
    df = pages.join(rolled, "page_id", "left")
    complete = F.col("render_exists") & ~F.coalesce("__stale", F.lit(False))
    return df.withColumn("page_status", F.when(F.coalesce("__bad", F.lit(False)), "error").when(
        ~F.col("has_canon"), "missing").when(processing, "ready").when(complete, "done").otherwise("ready")).drop("__bad", "__stale")


def run_result(events: DataFrame, scope: str = "chapter") -> DataFrame:
    """Outcome of each run from its events (``command_id, stage, event, page_id``)."""
    failed = F.col("event") == "page_error"
    out = events.groupBy("command_id").agg(
        F.countDistinct("page_id").alias("pages_processed"), F.countDistinct(F.when(failed, F.col("page_id"))).alias("failed_pages"),
        F.countDistinct(F.when(F.col("event").isin("page_done", "page_error"), F.col("stage"))).alias("stages_completed"),
        F.bool_or(F.col("event") == "canceled").alias("__canceled"), F.bool_or(F.col("event") == "fatal_error").alias("__fatal"),
    )
    broken = F.col("failed_pages") > 0
    state = F.when(F.col("__canceled"), "canceled").when(
        F.col("__fatal") | (broken if scope == "current" else F.lit(False)), "failed").when(broken, "completed_with_errors").otherwise("completed")
    return out.withColumns({
        "succeeded_pages": F.greatest(F.lit(0), F.col("pages_processed") - F.col("failed_pages")), "final_state": state,
    }).drop("__canceled", "__fatal")


def detector_stats(detections: DataFrame) -> DataFrame:
    return detections.groupBy("page_id").agg(
        F.count("*").alias("raw_detections"), F.count_if(F.col("det_kind") == "bubble").alias("bubbles"),
        F.count_if(F.col("det_kind") != "bubble").alias("layout_regions"), F.countDistinct("label").alias("labels"),
    )


# ---------------------------------------------------------------- work lists and reuse


def selected(items: DataFrame, ids: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """The items whose ``keys`` are listed in ``ids``; all of them without a list."""
    return items if ids is None else items.join(ids.select(*keys).distinct(), list(keys), "left_semi")


def ocr_work_list(items: DataFrame, force: bool = False, ids: DataFrame | None = None, keys: Sequence[str] = ("page_id", "ocr_item_id")) -> DataFrame:
    """Items still to be recognised, of the ``ids`` if such a table is given."""
    items = selected(items, ids, keys)
    done = (clean_status(F.col("status")) == "done") & (strip(F.coalesce("text", F.lit(""))) != "") & ~F.coalesce("needs_ocr", F.lit(False))
    open_ = ~F.coalesce("excluded", F.lit(False))
    return items.where(open_ if force else open_ & ~done)


def render_work_list(items: DataFrame) -> DataFrame:
    """Adds ``wanted``, the new status and error; box without prefix, page in ``w, h``."""
    df = g.stage(items, "__b", g.clamp_or_null(box(), F.col("w"), F.col("h")))
    live = ~F.coalesce("excluded", F.lit(False)) & (clean_status(F.col("status")) != "skipped")
    small = F.col("__bx1").isNull() | (g.area(box("__b")) < MIN_RENDER_AREA)
    blank = strip(F.coalesce("text", F.lit(""))) == ""
    return df.withColumns({
        "wanted": live & ~small & ~blank,
        "error": F.when(live & small, "box unusable").when(live & blank, "").otherwise(F.col("error")),
        "status": F.when(live & (small | blank), "skipped").otherwise(F.col("status")),
    }).drop("__bx1", "__by1", "__bx2", "__by2")


def signature(columns: Sequence[str]) -> Column:
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def reusable_detections(pages: DataFrame, stored: DataFrame, settings: Sequence[str]) -> DataFrame:
    """Pages whose stored result was made with equal settings."""
    now = pages.select("page_id", signature(settings).alias("sig"))
    return now.join(stored.select("page_id", signature(settings).alias("sig")), ["page_id", "sig"], "left_semi").select("page_id")


def reusable_inpaints(stored: DataFrame, current: DataFrame, settings: Sequence[str]) -> DataFrame:
    """Done, not stale, both mask hashes and all settings equal."""
    fine = stored.where(
        (clean_status(F.col("status")) == "done") & ~F.coalesce("needs_inpaint", F.lit(False))
        & F.col("output_mask_hash").eqNullSafe(F.col("text_mask_hash")) & F.col("output_bubble_mask_hash").eqNullSafe(F.col("bubble_mask_hash"))
    )
    return reusable_detections(current, fine, settings)


def reusable_renders(stored: DataFrame) -> DataFrame:
    return stored.where(F.col("output_exists") & (clean_status(F.col("status")) == "done") & ~F.coalesce("needs_render", F.lit(False))).select("page_id")


def work_pages(pages: DataFrame, reusable: DataFrame, force: bool = False) -> DataFrame:
    return pages if force else pages.join(reusable, "page_id", "left_anti")


# ---------------------------------------------------------------- stage table


def latest_stages(log: DataFrame) -> DataFrame:
    """Stage table from a log of status reports and stale marks.

    ``log`` holds ``page_id, stage, kind`` ('status' or 'stale'), ``status, cache_path,
    error, stale, ts, seq``. A status report clears an earlier stale mark.
    """
    at = F.struct("ts", "seq")
    report, mark = F.col("kind") == "status", F.col("kind") == "stale"
    rolled = log.groupBy("page_id", "stage").agg(
        F.max_by(F.when(report, F.struct("status", "cache_path", "error")), F.when(report, at)).alias("s"), F.max(F.when(report, at)).alias("t"),
        F.max_by(F.when(mark, F.col("stale")), F.when(mark, at)).alias("m"), F.max(F.when(mark, at)).alias("u"),
    )
    after = F.col("u").isNotNull() & (F.col("t").isNull() | (F.col("u") > F.col("t")))
    return rolled.select("page_id", "stage", "s.status", "s.cache_path", "s.error", F.coalesce(after & F.col("m"), F.lit(False)).alias("stale"))


def propagate_stale(edits: DataFrame, target: str) -> DataFrame:
    """Stages each edit makes stale, in the page file or in the project table."""
    listed = F.create_map(*(x for (kind, where), stages in DOWNSTREAM.items() if where == target for x in (F.lit(kind), F.array(*(F.lit(s) for s in stages)))))
    return edits.select("page_id", F.explode(listed[F.col("edited_stage")]).alias("stage")).distinct()


def mark_stale(stages: DataFrame, stale: DataFrame) -> DataFrame:
    hit = stale.select("page_id", "stage", F.lit(True).alias("__hit"))
    return stages.join(hit, ["page_id", "stage"], "left").withColumn("stale", F.coalesce("stale", F.lit(False)) | F.col("__hit").isNotNull()).drop("__hit")


def transition(items: DataFrame, to: Column, error: Column, translator: str, at: Column) -> DataFrame:
    """Mark items running, done or error with time and translator; NULL leaves an item alone."""
    moves = to.isNotNull()
    return items.withColumns({
        "status": F.coalesce(to, F.col("status")), "error": F.when(moves, F.when(to == "error", error).otherwise("")).otherwise(F.col("error")),
        "updated_at": F.when(moves, at).otherwise(F.col("updated_at")), "translator": F.when(moves, F.lit(translator)).otherwise(F.col("translator")),
    })


def removal(requested: DataFrame, pages: DataFrame) -> DataFrame:
    """What happens to each requested page path: removed, skipped (asked again) or error."""
    asked = requested.withColumn("path", strip(F.coalesce("path", F.lit(""))))
    firsts = asked.groupBy("project_id", "path").agg(F.min("slot").alias("__first"))
    known = pages.select("project_id", F.col("source_path").alias("path"), "page_id")
    df = asked.join(firsts, ["project_id", "path"]).join(known, ["project_id", "path"], "left")
    return df.withColumn("outcome", F.when(F.col("path") == "", "error").when(F.col("page_id").isNull(), "error").when(
        F.col("slot") == F.col("__first"), "removed").otherwise("skipped")).drop("__first")


def remaining_pages(pages: DataFrame, outcome: DataFrame) -> DataFrame:
    return pages.join(outcome.where("outcome = 'removed'").select("page_id").distinct(), "page_id", "left_anti")


def artefacts(pages: DataFrame, kinds: Sequence[tuple[str, str]]) -> DataFrame:
    """Stored files of pages (``project_id, page_id, source_path``) by kind: (folder, suffix) under ``cache/``."""
    listed = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(e).alias("ending")) for k, e in kinds))
    rows = pages.select("project_id", "page_id", F.explode(listed).alias("k"), stem(F.substring_index("source_path", "/", -1)).alias("name"))
    return rows.select("project_id", "page_id", F.col("k.kind").alias("kind"), F.concat(F.lit("cache/"), "k.kind", F.lit("/"), "name", "k.ending").alias("path"))


def trash_rows(outcome: DataFrame, pages: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows for the trash table: the removed pages and their stored artefacts (``project_id, page_id, kind, path``)."""
    gone = outcome.where("outcome = 'removed'").select("page_id").distinct()
    kinds = pages.select("project_id", "page_id", F.lit("page").alias("kind"), F.col("source_path").alias("path")).unionByName(stored.select("project_id", "page_id", "kind", "path"))
    name = F.substring_index("path", "/", -1)
    folder = F.when(F.col("kind") == "page", F.lit("pages")).otherwise(F.concat(F.lit("cache/"), "kind"))
    return kinds.join(gone, "page_id", "left_semi").withColumn("trash_path", F.concat(F.lit("trash/"), folder, F.lit("/"), F.col("page_id").cast("string"), F.lit("_"), name))


def remove_pages(outcome: DataFrame, pages: DataFrame, stored: DataFrame, trash: str, batch_id: str) -> tuple[DataFrame, DataFrame]:
    """Append the removed rows to the trash table, and return the pages and artefacts that stay.

    The rows go to the partition of ``batch_id``, which a replay overwrites; nothing is taken out of the live tables before they are
    written. The caller publishes what stays in the same way (``sources.documents.write_stage``).
    """
    trash_rows(outcome, pages, stored).write.mode("overwrite").parquet(f"{trash}/batch={batch_id}")
    gone = outcome.where("outcome = 'removed'").select("page_id").distinct()
    return remaining_pages(pages, outcome), stored.join(gone, "page_id", "left_anti")


def next_page(current: DataFrame, outcome: DataFrame, pages: DataFrame) -> DataFrame:
    """Current page index after a removal. ``current`` holds ``project_id, current_index``."""
    gone = outcome.where("outcome = 'removed'").select("page_id").distinct()
    kept = pages.join(gone, "page_id", "left_anti").groupBy("project_id").agg(F.count("*").alias("__kept"))
    removed = pages.join(gone, "page_id", "left_semi").join(current, "project_id")
    before = removed.groupBy("project_id").agg(F.count_if(F.col("page_no") < F.col("current_index")).alias("__before"))
    df = current.join(kept, "project_id", "left").join(before, "project_id", "left").na.fill(0, ["__kept", "__before"])
    moved = F.greatest(F.lit(0), F.least(F.col("current_index") - F.col("__before"), F.col("__kept") - 1))
    return df.select("project_id", F.when(F.col("__kept") == 0, 0).otherwise(moved).alias("current_index"))
