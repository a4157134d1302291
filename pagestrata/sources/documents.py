"""Stage documents, project files and run events: JSON in, Parquet tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from pagestrata.operators.ranking import first_per_key

BOX = "array<int>"
REFS = "struct<bubble_id:int,layout_region_ids:array<int>>"
STAGES = "map<string,struct<status:string,cache_path:string,error:string,stale:boolean>>"

HEAD = "schema_version int, stage string, source_image string, image_width int, image_height int"
CANON_ITEM = f"canon_id:string,kind:string,enabled:boolean,excluded:boolean,manual:boolean,source:string,bbox:{BOX},ocr_bbox:{BOX},render_bbox:{BOX},bbox_user_edited:boolean,ocr_bbox_user_edited:boolean,render_bbox_user_edited:boolean,text_mask_bboxes:array<{BOX}>,source_direction:string,reading_order:int,detector_refs:{REFS}"
OCR_ITEM = f"id:int,canon_id:string,kind:string,bbox:{BOX},ocr_bbox:{BOX},crop_path:string,bubble_id:int,reading_order:int,detector_sources:array<string>,source_direction:string,text:string,raw_ocr_text:string,status:string,error:string,skip_reason:string,ocr_rejection_reason:string,needs_ocr:boolean,manually_edited:boolean,excluded:boolean"
TRANSLATION_ITEM = f"id:int,ocr_item_id:int,canon_id:string,kind:string,bbox:{BOX},ocr_bbox:{BOX},source_text:string,translated_text:string,status:string,error:string,updated_at:string,edited_at:string,manually_edited:boolean,source_manually_edited:boolean,source_edited_at:string,needs_retranslate:boolean,translator:string,excluded:boolean"
STYLE = "enabled:boolean,render_text_override:string,font_name:string,font_path:string,font_size_mode:string,fixed_font_size:int,min_font_size:int,max_font_size:int,writing_mode:string,stroke_enabled:boolean,stroke_width:double,text_color_mode:string,text_color:array<int>,stroke_color:array<int>,line_spacing_ratio:double"
RENDER_ITEM = f"id:int,translation_item_id:int,ocr_item_id:int,canon_id:string,kind:string,source_text:string,translated_text:string,bbox:{BOX},render_bbox:{BOX},writing_mode:string,font_size:int,font_path:string,style_overrides:struct<{STYLE}>,status:string,error:string,excluded:boolean,bbox_edited:boolean,needs_render:boolean"
BUBBLE = f"id:int,bbox:{BOX},confidence:double,detector:string,class_id:int,is_dark:boolean,mask_path:string,manual:boolean,excluded:boolean,source:string"
LAYOUT_REGION = f"id:int,bbox:{BOX},confidence:double,label:string,detector:string,reading_order:int,label_id:int,manual:boolean,excluded:boolean,source:string"
ITEMS = {"bubble": BUBBLE, "layout": LAYOUT_REGION, "canon": CANON_ITEM, "ocr": OCR_ITEM, "translation": TRANSLATION_ITEM, "render": RENDER_ITEM}
DETECTION = (
    f"{HEAD}, method string, edited boolean, edited_at string, downstream_stale array<string>, "
    f"bubbles array<struct<{BUBBLE}>>, layout_regions array<struct<{LAYOUT_REGION}>>, "
    f"canon_state struct<schema_version:int,created_at:string,updated_at:string,items:array<struct<{CANON_ITEM}>>>"
)
INPAINT = (
    f"{HEAD}, status string, error string, needs_inpaint boolean, item_count int, active_item_count int, text_mask_box_count int, skipped_item_count int, "
    "masked_pixel_count long, bubble_mask_pixel_count long, text_mask_hash string, bubble_mask_hash string, output_mask_hash string, output_bubble_mask_hash string, "
    "output_image_path string, text_mask_path string, bubble_mask_path string, settings map<string,string>"
)
PROMPT = "source_language string, target_language string, translator string, provider string, style string, custom_prompt string, prompt_style_id string, prompt_mode string, user_instructions string, full_custom_prompt string, project_translation_notes string, output_contract string, prompt_preview string, prompt_hash string, created_at string, updated_at string"
SCHEMAS = {
    "detection": DETECTION,
    "ocr": f"{HEAD}, items array<struct<{OCR_ITEM}>>",
    "translation": f"{HEAD}, ocr_cache_path string, {PROMPT}, items array<struct<{TRANSLATION_ITEM}>>",
    "inpaint": INPAINT,
    "render": f"{HEAD}, status string, needs_render boolean, edited boolean, items array<struct<{RENDER_ITEM}>>",
}
PROJECT = f"name string, pages array<struct<source_path:string,stages:{STAGES}>>, source_images array<string>, current_page_index int, settings map<string,string>"
EVENT = "command_id string, service_name string, action string, stage string, event string, image_relative_path string, page_index int, page_total int, progress int, message string, output_path string, error string"

# Fixed values
ITEM_DEFAULTS = {
    "canon": {"kind": "layout_text", "source": "detector", "source_direction": ""},
    "ocr": {"canon_id": "", "kind": "", "text": "", "raw_ocr_text": "", "status": "prepared", "error": "", "skip_reason": "", "ocr_rejection_reason": "", "source_direction": ""},
    "translation": {"canon_id": "", "kind": "", "source_text": "", "translated_text": "", "status": "pending", "error": "", "updated_at": "", "edited_at": "", "source_edited_at": "", "translator": ""},
    "render": {"canon_id": "", "kind": "", "source_text": "", "translated_text": "", "writing_mode": "horizontal", "font_path": "", "status": "pending", "error": ""},
}


def unknown_fields(node: Column, known: list[str]) -> Column:
    """The fields of a JSON object that no schema names, as one variant; NULL without any."""
    rest = F.map_filter(F.try_variant_get(node, F.lit("$"), "map<string,variant>"), lambda k, _: ~k.isin(known))
    return F.when(F.size(rest) > 0, F.parse_json(F.to_json(rest)))


def read_documents(spark: SparkSession, path: str, stage: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents of a stage, and the rejected ones: broken JSON or another stage's.

    A file is one document, named after its page. With ``lines`` a file holds a document per line, so that many pages
    are few files that can be split, and a document belongs to the page of its ``source_image``. A document is parsed once, as a
    variant in ``node``; the fields of the stage are taken out of it (a field of another type is missing), the others stay in ``extra``.
    """
    raw = spark.read.text(path, wholetext=not lines).select("value", F.input_file_name().alias("file")).where(F.trim("value") != "")
    raw = raw.withColumn("node", F.try_parse_json("value"))
    fields = StructType.fromDDL(SCHEMAS[stage])
    raw = raw.withColumn("d", F.try_variant_get("node", F.lit("$"), "struct<stage:string>"))
    good = F.coalesce(F.col("d.stage") == stage, F.lit(False))
    flat = [f for f in fields if not isinstance(f.dataType, ArrayType) or not isinstance(f.dataType.elementType, StructType)]
    docs = raw.where(good).select(
        "file", "node", *(F.try_variant_get("node", F.lit(f"$.{f.name}"), f.dataType.simpleString()).alias(f.name) for f in flat if f.name != "canon_state"),
        unknown_fields(F.col("node"), fields.names).alias("extra"))
    kinds = {k: [f.name for f in docs.schema.fields if f.dataType.simpleString() == k] for k in ("string", "boolean")}
    docs = docs.na.fill("", [c for c in kinds["string"] if c != "file"]).na.fill(False, kinds["boolean"])
    docs = docs.withColumn("schema_version", F.coalesce("schema_version", F.lit(2 if stage == "detection" else 1)))
    name = F.substring_index("source_image" if lines else "file", "/", -1)
    rejected = raw.where(~good).select("file", F.col("d.stage").alias("stage"), F.when(F.col("node").isNull(), F.col("value")).alias("_corrupt_record"))
    return docs.withColumn("page_key", F.regexp_replace(name, r"\.[^.]*$", "")), rejected


def items_of(docs: DataFrame, path: str, kind: str) -> DataFrame:
    """Rows of an item list with missing fields defaulted; a missing id is the position, unknown fields are in ``extra``."""
    schema = f"struct<{ITEMS[kind]}>"
    each = docs.select("page_key", "image_width", "image_height", F.posexplode(F.try_variant_get("node", F.lit(path), "array<variant>")).alias("slot", "i"))
    known = StructType.fromDDL(f"i {schema}")["i"].dataType.names
    rows = each.select("page_key", "image_width", "image_height", "slot", F.try_variant_get("i", F.lit("$"), schema).alias("k"), unknown_fields(F.col("i"), known).alias("extra"))
    rows = rows.select("page_key", "image_width", "image_height", "slot", "k.*", "extra")
    filled = {c: F.coalesce(c, F.lit(d)) for c, d in ITEM_DEFAULTS.get(kind, {}).items() if c in rows.columns}
    flags = {f.name: F.coalesce(f.name, F.lit(f.name == "enabled")) for f in rows.schema.fields if f.dataType.simpleString() == "boolean" and f.name != "is_dark"}
    ids = {"id": F.coalesce("id", "slot")} if "id" in rows.columns else {}
    return rows.withColumns({**filled, **flags, **ids})


def scan_detection(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    docs, rejected = read_documents(spark, path, "detection", lines)
    return {
        "documents": docs.drop("node"), "bubbles": items_of(docs, "$.bubbles", "bubble"),
        "layout_regions": items_of(docs, "$.layout_regions", "layout"), "canon_items": items_of(docs, "$.canon_state.items", "canon"), "rejected": rejected,
    }


def scan_items(spark: SparkSession, path: str, stage: str, lines: bool = False) -> dict[str, DataFrame]:
    """Documents, items and rejects of the ``ocr``, ``translation`` or ``render`` stage."""
    docs, rejected = read_documents(spark, path, stage, lines)
    return {"documents": docs.drop("node"), "items": items_of(docs, "$.items", stage), "rejected": rejected}


def scan_inpaint(spark: SparkSession, path: str, lines: bool = False) -> dict[str, DataFrame]:
    docs, rejected = read_documents(spark, path, "inpaint", lines)
    return {"documents": docs.drop("node"), "rejected": rejected}


def project_pages(projects: DataFrame) -> DataFrame:
    """Pages of project files in order: first of equal paths, all kept under ``source/``; the current index clamped to them.

    ``projects`` hold ``project_id`` and the project fields.
    """
    named = F.filter("pages", lambda p: F.trim(F.coalesce(p["source_path"], F.lit(""))) != "")
    old = F.transform(F.filter("source_images", lambda p: F.trim(p) != ""), lambda p: F.struct(p.alias("source_path"), F.lit(None).cast(STAGES).alias("stages")))
    pages = F.when(F.size(F.coalesce(named, F.array())) > 0, named).otherwise(old)
    rows = projects.select("project_id", "name", "current_page_index", F.posexplode(pages).alias("slot", "p")).select(
        "project_id", "name", "current_page_index", F.col("slot").cast("long").alias("slot"), "p.source_path", "p.stages")
    inside = F.when(F.col("source_path").startswith("source/"), F.col("source_path")).otherwise(F.concat(F.lit("source/"), F.substring_index("source_path", "/", -1)))
    rows = first_per_key(rows.withColumn("source_path", inside), ["project_id", "source_path"], [F.col("slot")])
    counts = rows.groupBy("project_id").agg(F.count("*").alias("__n"))
    clamped = F.greatest(F.lit(0), F.least(F.coalesce("current_page_index", F.lit(0)), (F.col("__n") - 1).cast("int")))
    return rows.join(counts, "project_id").withColumn("current_page_index", clamped).drop("__n")


def scan_project(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pages of project files. A file is one project, known by its path; with ``lines`` a line is one, known by its name."""
    raw = spark.read.option("multiLine", not lines).schema(PROJECT).json(path)
    return project_pages(raw.withColumn("project_id", F.col("name") if lines else F.input_file_name()))


def page_stages(pages: DataFrame) -> DataFrame:
    return pages.select("project_id", "source_path", F.explode("stages").alias("stage", "s")).select("project_id", "source_path", "stage", "s.*")


def scan_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENT).json(path)


def write_stage(df: DataFrame, stage: str, path: str) -> None:
    """Replace the partitions of the projects in the frame; other partitions stay.

    The commit protocol publishes a partition only when all of it is written. Rows are rebalanced by project first: small
    projects are one file each, a large one is split over tasks.
    """
    df.hint("rebalance", "project_id").withColumn("stage", F.lit(stage)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stage", "project_id").parquet(path)


def read_stage(spark: SparkSession, stage: str, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("stage") == stage)
