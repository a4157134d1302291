"""Render items, export manifest and artefact paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagestrata.functions import geometry as g
from pagestrata.functions.geometry import box, stage
from pagestrata.functions.paths import stem, suffix
from pagestrata.functions.styles import export_name
from pagestrata.functions.text import strip
from pagestrata.operators.ranking import distinct_names, number_band, with_position
from pagestrata.operators.status import MIN_RENDER_AREA

MISSING_SOURCE = {
    "source": "no source image", "inpaint": "not inpainted yet", "render": "not drawn yet",
}
# Fixed values
CACHE_ARTEFACTS = (
    ("detection", ".json"), ("ocr", ".json"), ("translation", ".json"), ("inpaint", ".json"), ("inpaint", ".png"),
    ("render", ".json"), ("render", ".png"), ("masks", ""), ("ocr_crops", ""), ("render_sprites", ""),
)


def cache_paths(pages: DataFrame) -> DataFrame:
    """The ten derived artefacts of each page, from its file stem."""
    parts = F.array(*(F.struct(F.lit(d).alias("kind"), F.lit(s).alias("suffix")) for d, s in CACHE_ARTEFACTS))
    return pages.select("page_id", stem(F.col("source_path")).alias("stem"), F.explode(parts).alias("p")).select(
        "page_id", "p.kind", F.concat(F.lit("cache/"), "p.kind", F.lit("/"), "stem", "p.suffix").alias("path")
    )


def build_render_items(translation: DataFrame, ocr: DataFrame, canon: DataFrame) -> DataFrame:
    """Items to draw: translation with its recognised item and page state; disabled ones out."""
    state = canon.where(F.coalesce("enabled", F.lit(True))).select("page_id", "canon_id", *box().named("b"), *box("r").named("r"), "w", "h")
    df = translation.join(state, ["page_id", "canon_id"]).join(
        ocr.select("page_id", "ocr_item_id", F.col("kind").alias("__kind")), ["page_id", "ocr_item_id"], "left")
    df = stage(df, "__r", g.clamp_or_null(box("r"), F.col("w"), F.col("h")))
    df = stage(df, "__b", g.clamp_or_null(box("b"), F.col("w"), F.col("h")))
    text = strip(F.coalesce("translated_text", F.lit("")))
    small = F.col("__rx1").isNull() | (g.area(box("__r")) < MIN_RENDER_AREA)
    return df.select(
        "page_id", "ocr_item_id", "canon_id", F.coalesce(F.when(F.col("kind") != "", F.col("kind")), F.col("__kind"), F.lit("")).alias("kind"),
        text.alias("translated_text"), *box("__b").named(), *box("__r").named("r"),
        F.when((text == "") | small, "skipped").otherwise("pending").alias("status"),
        F.when((text != "") & small, "box unusable").otherwise("").alias("error"),
    )


def carry_overrides(new: DataFrame, old: DataFrame) -> DataFrame:
    """Style and edit marks of earlier render items, by canon id.

    ``old`` holds ``page_id, canon_id, style, style_active, bbox_edited, needs_render``.
    """
    kept = old.where(F.col("canon_id") != "").select(
        "page_id", "canon_id", F.col("style").alias("__s"), F.col("style_active").alias("__a"), F.col("bbox_edited").alias("__e"), F.col("needs_render").alias("__n"))
    df = new.join(kept, ["page_id", "canon_id"], "left")
    again = F.coalesce(F.col("__n") | F.col("__a"), F.lit(False))
    return df.withColumns({
        "style": F.coalesce("__s", F.lit("")), "bbox_edited": F.coalesce("__e", F.lit(False)), "needs_render": again,
    }).drop("__s", "__a", "__e", "__n")


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Second and later equal names get _001, _002 and so on before the suffix, past names that others hold."""
    return distinct_names(df, name, order, digits=3)


def page_numbering(scope: DataFrame, pages: DataFrame) -> DataFrame:
    """Export index in scope order, page number in project order, both from 1."""
    exported = with_position(scope, ["project_id"], [F.col("scope_slot"), F.col("page_id")], number_band(F.col("scope_slot")), "__e")
    numbered = with_position(pages.select("project_id", "page_id", "page_no"), ["project_id"], [F.col("page_no"), F.col("page_id")], number_band(F.col("page_no"), 256), "__p")
    return exported.join(numbered.select("page_id", "__p"), "page_id").withColumns({
        "export_index": F.col("__e") + 1, "page_number": F.col("__p") + 1}).drop("__e", "__p")


def export_manifest(scope: DataFrame, pages: DataFrame, artefacts: DataFrame, layer: str, pattern: str, suffix_to: str = "") -> DataFrame:
    """One row per page of the scope: exported with its name, skipped or error.

    ``artefacts`` is a listing ``path, width, height, readable`` of existing files. Of the files that would get one name,
    the first page keeps it and the others are numbered.
    """
    numbered = page_numbering(scope, pages)
    path = F.col("source_path") if layer == "source" else F.concat(F.lit(f"cache/{layer}/"), stem(F.col("source_path")), F.lit(".png"))
    df = numbered.withColumn("path", path).join(artefacts, "path", "left")
    exists, readable = F.col("readable").isNotNull(), F.coalesce("readable", F.lit(False))
    fields = {
        "index": F.col("export_index"), "page_number": F.col("page_number"), "stem": stem(F.col("path")), "source_stem": stem(F.col("source_path")),
        "project": F.concat(F.lit("project_"), F.col("project_id").cast("string")), "stage": F.lit(layer),
    }
    ending = F.lit(suffix_to) if suffix_to else F.coalesce(F.when(suffix(F.col("path")) != "", suffix(F.col("path"))), F.lit(".png"))
    rows = df.select(
        "project_id", "page_id", "export_index", "page_number", F.when(exists, F.col("path")).otherwise("").alias("source_file"),
        F.when(~exists, "skipped").when(readable, "exported").otherwise("error").alias("status"),
        F.when(~exists, MISSING_SOURCE[layer]).when(~readable, "cannot read image").otherwise("").alias("error"),
        F.when(readable, F.concat(export_name(pattern, fields), ending)).alias("output_name"),
        F.when(readable, F.col("width")).otherwise(0).cast("long").alias("width"), F.when(readable, F.col("height")).otherwise(0).cast("long").alias("height"),
    )
    named = distinct_names(rows, "output_name", "export_index", digits=3, keys=["project_id"], into="__name")
    return named.withColumn("output_name", F.coalesce("__name", F.lit(""))).drop("__name")


def export_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("project_id").agg(
        F.count("*").alias("total_pages"), *(F.count_if(F.col("status") == s).alias(f"{n}_count") for s, n in (("exported", "exported"), ("skipped", "skipped"), ("error", "error")))
    )


def page_documents(items: DataFrame, fields: list[str], extra: str | None = None) -> DataFrame:
    """Nested document per page with its items in order, ids renumbered by position.

    ``extra`` names a column (variant object or NULL) whose fields come after those of the item. One document per page is the
    format; the rows of a page meet in one array.
    """
    more = [F.to_json(extra).alias("__more")] if extra else []
    ordered = F.sort_array(F.collect_list(F.struct("id", *fields, *more)))

    def text(x, i):
        own = F.to_json(F.struct(i.cast("long").alias("id"), *(x[f].alias(f) for f in fields)))
        if not extra:
            return own
        return F.when(x["__more"].isNull(), own).otherwise(F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(","), F.substring(x["__more"], 2, 2**31 - 1)))

    listed = F.concat(F.lit("["), F.array_join(F.transform(ordered, text), ","), F.lit("]"))
    return items.groupBy("page_id").agg(listed.alias("document"), F.count("*").alias("item_count"))
