"""Translation batches: chunking, shape checks, repair, merging and status changes.

Line tables are ``project_id, page_no, line_no, text``; a page is (project_id, page_no).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.text import strip
from pagestrata.operators.ranking import first_per_key, number_band, with_position

# Fixed values
DEFAULT_CHUNK = 5

PAGE = ["project_id", "page_no"]
LINE = [*PAGE, "line_no"]


def page_positions(pages: DataFrame) -> DataFrame:
    return with_position(pages, ["project_id"], [F.col("page_no")], number_band(F.col("page_no"), 256))


def page_chunks(pages: DataFrame, size: int | None = None, default_size: int = DEFAULT_CHUNK) -> DataFrame:
    """Adds ``chunk``: slices of ``size`` pages, else balanced chunks of about five."""
    placed = page_positions(pages)
    if size is not None:
        return placed.withColumn("chunk", F.floor(F.col("position") / size))
    counts = pages.groupBy("project_id").agg(F.count("*").alias("__n"))
    placed = placed.join(counts, "project_id")
    chunks = F.ceil(F.col("__n") / default_size)
    base, longer = F.floor(F.col("__n") / chunks), F.col("__n") % chunks
    head = (base + 1) * longer
    return placed.withColumn("chunk", F.when(
        F.col("position") < head, F.floor(F.col("position") / (base + 1))
    ).otherwise(longer + F.floor((F.col("position") - head) / base))).drop("__n")


def page_shapes(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Lines sent and received per page; a page without an answer has none received."""
    asked = sent.groupBy(*PAGE).agg(F.count("*").alias("sent"))
    got = received.groupBy(*PAGE).agg(F.count("*").alias("received"))
    return asked.join(got, PAGE, "left").withColumn("valid", F.coalesce(F.col("sent") == F.col("received"), F.lit(False)))


def missing_pages(sent: DataFrame, received: DataFrame) -> DataFrame:
    return sent.select(*PAGE).distinct().join(received.select(*PAGE).distinct(), PAGE, "left_anti")


def repair_lines(sent: DataFrame, received: DataFrame, pad_with_original: bool = True) -> DataFrame:
    """Answers in the shape of the request: extra lines cut, missing ones padded."""
    answers = received.select(*LINE, F.col("text").alias("translated"))
    pad = F.col("text") if pad_with_original else F.lit("")
    return sent.join(answers, LINE, "left").withColumn("translated", F.coalesce("translated", pad))


def page_key_check(sent: DataFrame, received: DataFrame) -> DataFrame:
    """Per chunk: does the answer hold the same page keys in the same order?

    Both bring ``chunk_id, position, page_key``.
    """
    both = sent.select("chunk_id", "position", F.col("page_key").alias("want")).join(
        received.select("chunk_id", "position", F.col("page_key").alias("got")), ["chunk_id", "position"], "full_outer"
    )
    return both.groupBy("chunk_id").agg(
        F.bool_and(F.col("want").eqNullSafe(F.col("got"))).alias("same_keys"), F.count("*").alias("slots")
    )


def sent_lines(lines: DataFrame) -> DataFrame:
    """Lines with text and the index each is sent under within its page."""
    filled = lines.where(strip(F.coalesce("text", F.lit(""))) != "")
    return with_position(filled, PAGE, [F.col("line_no")], number_band(F.col("line_no")), "sent_index")


def place_answers(lines: DataFrame, sent: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers by sent index back at their lines; all other lines keep the original."""
    found = sent.select(*LINE, "sent_index").join(
        answers.select(*PAGE, "sent_index", F.col("text").alias("translated")), [*PAGE, "sent_index"]
    )
    return lines.join(found.select(*LINE, "translated"), LINE, "left").withColumn(
        "translated", F.coalesce("translated", "text")
    )


def page_scope(pages: DataFrame, scope: str, selected: DataFrame | None = None, current: str | None = None) -> DataFrame:
    """Pages of an export: all, the known selected ones in order of first mention, or one.

    ``selected`` holds ``source_path, slot``; the result has ``scope_slot``.
    """
    if scope == "selected":
        first = selected.groupBy("source_path").agg(F.min("slot").alias("scope_slot"))
        return pages.join(first, "source_path")
    chosen = pages if scope == "all" else pages.where(F.col("source_path") == F.lit(current))
    return chosen.withColumn("scope_slot", F.col("page_no"))


def without_failed(pages: DataFrame, failures: DataFrame) -> DataFrame:
    return pages.join(failures.select("page_id").distinct(), "page_id", "left_anti")


def same_page_set(order: DataFrame, pages: DataFrame) -> DataFrame:
    """Per project: does the new order name every page exactly once?"""
    asked = order.groupBy("project_id", "source_path").agg(F.count("*").alias("asked"))
    known = pages.select("project_id", "source_path").distinct().withColumn("known", F.lit(1).cast("long"))
    both = asked.join(known, ["project_id", "source_path"], "full_outer")
    return both.groupBy("project_id").agg(F.bool_and(F.coalesce((F.col("asked") == 1) & (F.col("known") == 1), F.lit(False))).alias("accepted"))


def reordered_pages(order: DataFrame, pages: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with their new ``page_no``, and the index of the page that was current (``project_id, current_index``) in the new order.

    ``order`` holds ``project_id, slot, source_path``. A project whose order is not accepted keeps its pages as they are.
    """
    fine = same_page_set(order, pages).where("accepted").select("project_id")
    placed = with_position(order.join(fine, "project_id", "left_semi"), ["project_id"], [F.col("slot")], number_band(F.col("slot"), 256), "new_no")
    out = pages.join(placed.select("project_id", "source_path", "new_no"), ["project_id", "source_path"], "left")
    moved = out.where("new_no is not null").select("project_id", F.col("page_no").alias("current_index"), "new_no")
    index = current.join(moved, ["project_id", "current_index"], "left").select("project_id", F.coalesce("new_no", "current_index").alias("current_index"))
    return out.withColumn("page_no", F.coalesce("new_no", "page_no")).select(*pages.columns), index


# ---------------------------------------------------------------- items


def status_of(status: Column) -> Column:
    cleaned = F.lower(strip(F.coalesce(status, F.lit(""))))
    return F.when(cleaned == "", "pending").otherwise(cleaned)


def work_list(items: DataFrame, force: bool = False, ids: DataFrame | None = None, keys: Sequence[str] = ("page_id", "ocr_item_id")) -> DataFrame:
    """Adds ``wanted`` and the status, text and error after the pass over the items.

    Items without source text are skipped and cleared; finished and edited ones stay. With a table of ``ids``, the pass
    leaves all other items as they are, not wanted.
    """
    if ids is not None:
        chosen = work_list(items.join(ids.select(*keys).distinct(), list(keys), "left_semi"), force)
        others = items.join(ids.select(*keys).distinct(), list(keys), "left_anti")
        return chosen.unionByName(others.withColumn("wanted", F.lit(False)))
    filled = strip(F.coalesce("source_text", F.lit(""))) != ""
    has = strip(F.coalesce("translated_text", F.lit(""))) != ""
    status = status_of(F.col("status"))
    active = ~F.coalesce("excluded", F.lit(False))
    settled = (
        status.isin("manually_edited", "skipped") | (status.isin("done", "error") & has)
        | (has & ~status.isin("pending", "running", "error"))
    )
    blank = active & ~filled
    return items.withColumns({
        "wanted": active & filled & (F.lit(force) | ~settled),
        "status": F.when(blank, "skipped").otherwise(F.col("status")),
        "translated_text": F.when(blank, "").otherwise(F.col("translated_text")),
        "error": F.when(blank, "").otherwise(F.col("error")),
    })


def last_per_key(df: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    return first_per_key(df, keys, [-F.col(position)])


def init_translation(ocr: DataFrame, canon: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """Translation items from recognised items: matched to the page state, merged with
    earlier results by ``canon_id``, else by ``ocr_item_id``.

    ``canon`` brings ``page_id, canon_id, enabled``; items without a match come out with
    ``matched`` false, as the error rows of their page.
    """
    base = ocr.join(canon.select("page_id", "canon_id", "enabled"), ["page_id", "canon_id"], "left")
    base = base.where(F.coalesce("enabled", F.lit(True))).select(
        "page_id", "ocr_item_id", "canon_id", "kind", F.col("enabled").isNotNull().alias("matched"),
        strip(F.coalesce("text", F.lit(""))).alias("source_text"),
    )
    old = existing.select(
        "page_id", "ocr_item_id", "canon_id",
        F.struct("source_text", "translated_text", status_of(F.col("status")).alias("status"), "error", "translator").alias("old"),
    )
    by_canon = last_per_key(old.where(F.col("canon_id") != "").select("page_id", "canon_id", "ocr_item_id", "old"), ["page_id", "canon_id"], "ocr_item_id")
    by_ocr = last_per_key(
        old.select("page_id", "ocr_item_id", F.col("ocr_item_id").alias("slot"), "old"), ["page_id", "ocr_item_id"], "slot"
    )
    joined = base.join(by_canon.select("page_id", "canon_id", F.col("old").alias("old_c")), ["page_id", "canon_id"], "left").join(
        by_ocr.select("page_id", "ocr_item_id", F.col("old").alias("old_o")), ["page_id", "ocr_item_id"], "left"
    ).withColumn("old", F.coalesce("old_c", "old_o"))
    return merge_translation(joined, force).drop("old_c", "old_o", "old")


def merge_translation(df: DataFrame, force: bool = False) -> DataFrame:
    """Fresh fields, or those of the struct ``old`` while they still apply."""
    old = F.col("old")
    fresh = F.when(F.col("source_text") != "", "pending").otherwise("skipped")
    if force:
        return df.withColumns({"translated_text": F.lit(""), "status": fresh, "error": F.lit(""), "translator": F.lit("")})
    edited = F.coalesce(old["status"] == "manually_edited", F.lit(False))
    same = F.coalesce(strip(old["source_text"]) == F.col("source_text"), F.lit(False))
    keep = edited | same
    blank = (F.col("source_text") == "") & ~edited
    carried = lambda f: F.coalesce(old[f], F.lit(""))
    return df.withColumns({
        "translated_text": F.when(keep & ~blank, carried("translated_text")).otherwise(""),
        "status": F.when(edited, "manually_edited").when(blank, "skipped").when(
            keep, F.when(old["status"] == "running", "pending").otherwise(old["status"])).otherwise(fresh),
        "error": F.when(keep & ~blank, carried("error")).otherwise(""),
        "translator": F.when(edited, F.coalesce(F.when(old["translator"] != "", old["translator"]), F.lit("manual_edit")))
        .when(keep, carried("translator")).otherwise(""),
    })


def sync_from_canon(items: DataFrame, canon: DataFrame) -> DataFrame:
    """Boxes and exclusion refreshed from the page state; ``changed`` tells which rows moved."""
    boxes = [f"{p}{e}" for p in ("", "o") for e in ("x1", "y1", "x2", "y2")]
    truth = canon.select("page_id", "canon_id", *(F.col(b).alias(f"n_{b}") for b in boxes), F.col("enabled").alias("n_enabled"))
    joined = items.join(truth, ["page_id", "canon_id"], "left")
    known = F.col("n_enabled").isNotNull()
    same = F.lit(True)
    for b in boxes:
        same = same & F.col(b).eqNullSafe(F.col(f"n_{b}"))
    moved = known & ~(same & (F.col("excluded") == ~F.col("n_enabled")))
    fresh = {b: F.when(known, F.col(f"n_{b}")).otherwise(F.col(b)) for b in boxes}
    fresh["excluded"] = F.when(known, ~F.col("n_enabled")).otherwise(F.col("excluded"))
    return joined.withColumn("changed", F.coalesce(moved, F.lit(False))).withColumns(fresh).select(*items.columns, "changed")


def edit_source_text(items: DataFrame, new_text: Column) -> DataFrame:
    """New source text: to be translated again, status by what is filled."""
    has = strip(F.coalesce("translated_text", F.lit(""))) != ""
    status = status_of(F.col("status"))
    return items.withColumn("source_text", F.coalesce(new_text, F.lit(""))).withColumns({
        "status": F.when(has, status).when(strip(F.col("source_text")) == "", "skipped").otherwise("pending"),
        "needs_retranslate": F.lit(True), "source_manually_edited": F.lit(True), "error": F.lit(""),
    })


def edit_translated_text(items: DataFrame, new_text: Column, manual: bool = True) -> DataFrame:
    text = F.coalesce(new_text, F.lit(""))
    filled = strip(text) != ""
    source = strip(F.coalesce("source_text", F.lit(""))) != ""
    out = items.withColumns({
        "translated_text": text, "error": F.lit(""), "needs_retranslate": F.lit(False),
        "status": F.when(filled, "manually_edited" if manual else "done").when(source, "pending").otherwise("skipped"),
    })
    return out.withColumn("translator", F.lit("manual_edit")) if manual else out
