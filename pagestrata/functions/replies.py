"""Model replies and requests: JSON out of loose text, indexed items, chat content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.text import strip, whole_json

# Fixed values
ITEM = "struct<index:bigint,translation:string>"
ITEMS_LABEL = "Input JSON object for one page of items."
PAGES_LABEL = "Input JSON object for multiple pages."
ITEMS_SHAPE = (
    'Return ONLY valid JSON with this exact shape:\n{\n  "items": [\n    {"index": 0, "translation": "..."},\n'
    '    {"index": 1, "translation": "..."}\n  ]\n}\nKeep the same item count and the same item indexes.'
)
PAGES_SHAPE = (
    'Return ONLY valid JSON with this exact shape:\n{\n  "pages": {\n    "page_001.png": [\n      {"index": 0, "translation": "..."},\n'
    '      {"index": 1, "translation": "..."}\n    ]\n  }\n}\n'
    "Preserve page keys exactly. Preserve item indexes exactly. Preserve item counts exactly."
)
NO_EXTRAS = "Do not add markdown, code fences, or explanations."
DEFAULT_SYSTEM = (
    "You are a manga/comic translator. Translate from %s to %s. "
    "Preserve tone, character voice, concise bubble fit, and item order. Return only the structured result requested by the user."
)
CONTEXT_TITLE = "Additional continuity context:"


def strip_fence(text: Column) -> Column:
    opened = strip(F.coalesce(text, F.lit("")))
    return strip(F.regexp_replace(strip(F.regexp_replace(opened, r"^```(?:json)?", "")), r"```$", ""))


def extract_json(df: DataFrame, text: Column, name: str = "json_text") -> DataFrame:
    """Adds the JSON of a reply: the whole text without its fence, else from the first
    opening bracket to the last matching closing one; NULL without valid JSON."""
    df = df.withColumn("__c", strip_fence(text))
    c = F.col("__c")
    braced = F.regexp_extract(c, r"(?s)^[^{\[]*(\{.*\})", 1)
    listed = F.regexp_extract(c, r"(?s)^[^{\[]*(\[.*\])", 1)
    inner = F.coalesce(F.when(braced != "", braced), F.when(listed != "", listed))
    valid = lambda x: F.when(whole_json(x).isNotNull(), x)
    return df.withColumn(name, F.coalesce(F.when(c != "", valid(c)), valid(inner))).drop("__c")


def _in_place(items: Column, size: Column) -> Column:
    """Items are as many as asked and each carries its own position."""
    bad = F.filter(items, lambda x, i: ~F.coalesce(x["index"] == i, F.lit(False)))
    return F.coalesce((F.size(items) == size) & (F.size(bad) == 0), F.lit(False))


def parse_items(df: DataFrame, json_text: Column, expected: Column) -> DataFrame:
    """Adds ``translations``, NULL unless the reply holds exactly the asked items in order."""
    df = df.withColumn("__i", F.from_json(json_text, f"struct<items:array<{ITEM}>>")["items"])
    texts = F.transform("__i", lambda x: F.coalesce(x["translation"], F.lit("")))
    return df.withColumn("translations", F.when(_in_place(F.col("__i"), expected), texts)).drop("__i")


def parse_pages(replies: DataFrame, json_text: Column, sent: DataFrame) -> DataFrame:
    """One row per asked page with its lines, NULL where page or items do not fit.

    ``replies`` hold ``chunk_id``; ``sent`` holds ``chunk_id, page_key, line_count``.
    """
    answer = replies.select("chunk_id", F.explode(F.from_json(json_text, f"struct<pages:map<string,array<{ITEM}>>>")["pages"]).alias("page_key", "__i"))
    joined = sent.join(answer, ["chunk_id", "page_key"], "left")
    texts = F.transform("__i", lambda x: F.coalesce(x["translation"], F.lit("")))
    return joined.withColumn("translations", F.when(_in_place(F.col("__i"), F.col("line_count")), texts)).drop("__i")


def chat_text(df: DataFrame, response: Column) -> DataFrame:
    """Adds ``content`` and ``malformed``: first choice's message, list parts joined."""
    df = df.withColumn("__m", F.try_variant_get(whole_json(response), F.lit("$.choices[0].message.content"), "variant"))
    kind = F.schema_of_variant("__m")
    parts = F.try_variant_get("__m", F.lit("$"), "array<struct<text:string>>")
    filled = F.filter(F.transform(parts, lambda p: p["text"]), lambda x: x != "")
    content = F.when(kind == "STRING", strip(F.try_variant_get("__m", F.lit("$"), "string"))).when(
        kind.startswith("ARRAY"), strip(F.array_join(filled, "\n")))
    return df.withColumns({"content": content, "malformed": content.isNull()}).drop("__m")


def build_requests(lines: DataFrame, chunks: DataFrame, source: str, target: str, context: DataFrame | None = None) -> DataFrame:
    """Chat request per chunk of pages: system text, labelled JSON of the lines, shape.

    ``lines`` hold ``project_id, page_no, line_no, text``; ``chunks`` assign ``chunk``;
    ``context`` may hold ``project_id, prompt``, or ``project_id, chunk, prompt`` with what is known before a chunk. A chunk is a few pages by construction.
    """
    items = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda x, i: F.struct(i.cast("long").alias("index"), F.coalesce(x["text"], F.lit("")).alias("text")))
    pages = lines.join(chunks.select("project_id", "page_no", "chunk"), ["project_id", "page_no"]).groupBy("project_id", "chunk", "page_no").agg(items.alias("items"))
    keyed = F.sort_array(F.collect_list(F.struct("page_no", "items")))
    payload = F.map_from_entries(F.transform(keyed, lambda p: F.struct(F.concat(F.lit("page_"), F.lpad(p["page_no"].cast("string"), 3, "0"), F.lit(".png")), p["items"])))
    df = pages.groupBy("project_id", "chunk").agg(F.to_json(F.struct(payload.alias("pages"))).alias("payload"), F.sum(F.size("items")).cast("long").alias("line_count"))
    system = F.lit(DEFAULT_SYSTEM % (source, target))
    if context is not None:
        keys = [c for c in ("project_id", "chunk") if c in context.columns]
        df = df.join(context.select(*keys, "prompt"), keys, "left")
        known = strip(F.coalesce("prompt", F.lit("")))
        system = F.when(known != "", F.concat(F.lit(CONTEXT_TITLE + "\n"), known)).otherwise(system)
    user = F.concat_ws("\n\n", F.lit(PAGES_LABEL), "payload", F.lit(PAGES_SHAPE), F.lit(NO_EXTRAS))
    return df.select("project_id", "chunk", "line_count", system.alias("system"), user.alias("user"))
