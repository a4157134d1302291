"""Recognised pieces and attempts, and lookups in small named catalogs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.functions.repeats import is_degenerate, trim_repeated_suffix
from pagestrata.functions.styles import clean_answer
from pagestrata.functions.text import clean_joined, clean_piece, compact, strip
from pagestrata.session import cut_lineage

# Fixed values
TEXTS, SCORES, BOXES = "rec_texts", "rec_scores", ("rec_boxes", "rec_polys", "dt_polys")
LINES, LINE = "text_lines", "array<struct<text:string,confidence:double,bbox:array<double>>>"
DEFAULT_STYLE = "default_manga"
STYLE_ALIASES = {
    "default": "default_manga", "default manga": "default_manga", "casual": "casual_dialogue", "casual dialogue": "casual_dialogue",
    "formal": "formal_polite", "formal / polite": "formal_polite", "keep honorifics": "keep_honorifics",
    "short bubble fit": "short_bubble_fit", "literal": "literal_faithful", "literal / faithful": "literal_faithful",
    "web novel style": "web_novel_style", "action": "action_impact", "action / impact": "action_impact",
    "comedy / light slang": "comedy_light_slang", "custom": "custom",
}


def best_by_key(items: DataFrame, keys: Sequence[str], text: str = "text", score: str = "score", position: str = "slot") -> DataFrame:
    """One piece per letters-and-digits key: highest score, the first one on a tie."""
    keyed = items.withColumn("piece_key", F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")).where("piece_key <> ''")
    rest = [c for c in items.columns if c not in keys]
    best = keyed.groupBy(*keys, "piece_key").agg(F.min_by(F.struct(*rest), F.struct((-F.col(score)).alias("s"), F.col(position).alias("p"))).alias("__b"))
    return best.select(*keys, "piece_key", "__b.*")


def join_pieces(pieces: DataFrame, keys: Sequence[str], min_score: float = 0.0) -> DataFrame:
    """Text of a crop: pieces by centre, top to bottom, joined and tidied.

    The result is one text per crop, so the pieces of a crop meet in one row.
    """
    kept = pieces.where((F.col("score") >= min_score) & (F.col("text") != ""))
    ordered = F.sort_array(F.collect_list(F.struct("cy", "cx", "slot", "text")))
    return kept.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("__t")).select(
        *keys, clean_joined(F.col("__t")).alias("text"))


def _mean(points: Column, axis: int) -> Column:
    return F.aggregate(points, F.lit(0.0), lambda a, p: a + p[axis]) / F.size(points)


def result_nodes(outputs: DataFrame, json_text: Column) -> DataFrame:
    """Every JSON object of the outputs that holds results: ``crop_id, path, node`` (variant), at any depth of objects and lists.

    Objects and lists are opened level by level until none is left; the parallel arrays themselves are not. ``path`` has the place
    at every level in four digits, so it sorts like the tree. Broken JSON has no nodes.
    """
    kind = F.schema_of_variant("node")
    inner = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    level = outputs.select("crop_id", F.lit("").alias("path"), F.try_parse_json(json_text).alias("node")).where(inner)
    closed = F.coalesce(F.col("key").isin(TEXTS, SCORES, *BOXES, LINES), F.lit(False))
    found = []
    while True:
        level = cut_lineage(level)
        if level.isEmpty():
            break
        has = F.greatest(*(F.try_variant_get("node", F.lit(f"$.{n}"), "variant").isNotNull() for n in (TEXTS, LINES)))
        found.append(level.where(kind.startswith("OBJECT") & has))
        # a null value is an entry too: only its place is counted
        opened = level.alias("l").lateralJoin(level.sparkSession.tvf.variant_explode(F.col("l.node").outer()).alias("e"))
        level = opened.where(~closed).select("crop_id", F.concat("path", F.lit("/"), F.lpad(F.col("e.pos").cast("string"), 4, "0")).alias("path"), F.col("e.value").alias("node")).where(inner)
    return reduce(DataFrame.unionByName, found) if found else level


def flatten_output(outputs: DataFrame, json_text: Column, min_score: float = 0.0) -> DataFrame:
    """Pieces of recogniser output (``outputs`` hold ``crop_id``): parallel arrays and line objects of all nodes.

    Of pieces with one key the best score stays, on a tie the first one in the order of node and place. Scores that are missing or
    no numbers count as 1.
    """
    nodes = result_nodes(outputs, json_text)
    get = lambda name, kind: F.try_variant_get("node", F.lit(f"$.{name}"), kind)
    boxes = F.coalesce(*(get(n, "array<variant>") for n in BOXES)).alias("boxes")
    rows = nodes.select("crop_id", "path", get(SCORES, "array<string>").alias("scores"), boxes, F.posexplode(get(TEXTS, "array<string>")).alias("i", "raw"))
    at = F.col("i") + 1
    rows = rows.withColumn("box", F.try_element_at("boxes", at))
    rows = rows.withColumns({"corners": F.try_variant_get("box", F.lit("$"), "array<double>"), "polygon": F.try_variant_get("box", F.lit("$"), "array<array<double>>")})
    nested = F.schema_of_variant("box").startswith("ARRAY<ARRAY")
    center = lambda a, b, axis: F.coalesce(F.when(nested, _mean(F.col("polygon"), axis)).when(F.size("corners") >= 4, (F.col("corners")[a] + F.col("corners")[b]) / 2), F.lit(0.0))
    slot = F.concat("path", F.lit("#"), F.lpad(F.col("i").cast("string"), 6, "0")).alias("slot")
    arrays = rows.select(
        "crop_id", slot, clean_piece(F.col("raw")).alias("text"),
        F.coalesce(F.try_element_at("scores", at).try_cast("double"), F.lit(1.0)).alias("score"), center(0, 2, 0).alias("cx"), center(1, 3, 1).alias("cy"))
    lines = nodes.select("crop_id", "path", F.posexplode(get(LINES, LINE)).alias("i", "l")).select(
        "crop_id", slot, clean_piece(F.col("l.text")).alias("text"), F.coalesce("l.confidence", F.lit(1.0)).alias("score"),
        F.coalesce(F.try_element_at("l.bbox", F.lit(1)), F.lit(0.0)).alias("cx"), F.coalesce(F.try_element_at("l.bbox", F.lit(2)), F.lit(0.0)).alias("cy"))
    fine = lambda d: d.where((F.col("text") != "") & (F.col("score") >= min_score))
    pieces = best_by_key(fine(arrays), ["crop_id"]).drop("piece_key")
    return pieces.unionByName(fine(lines))


def best_attempt(attempts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First clean attempt of a crop, else the longest trimmed one, else the longest raw one.

    ``attempts`` hold ``attempt`` and ``cleaned``.
    """
    df = attempts.withColumn("tail", trim_repeated_suffix(F.col("cleaned")))
    had, trimmed = F.col("tail.trimmed"), F.col("tail.text")
    filled = F.col("cleaned") != ""
    clean = filled & ~had & ~is_degenerate(F.col("cleaned"), F.col("tail"))
    text = F.when(clean, F.col("cleaned")).when(had & (trimmed != ""), trimmed).otherwise(F.col("cleaned"))
    rank = F.when(clean, 0).when(had & (trimmed != ""), 1).when(filled, 2).otherwise(3)
    df = df.withColumns({"text": text, "rank": rank})
    dense = compact(F.col("text"))
    late = F.when(F.col("rank") == 0, F.col("attempt")).otherwise(0)
    order = F.struct("rank", late.alias("a"), (-F.length(dense)).alias("n"), (-F.size(F.array_distinct(F.split(dense, "")))).alias("d"), F.col("attempt").alias("t"))
    # a trimmed attempt also counts as a raw candidate, but only when no trimmed one exists
    best = df.groupBy(*keys).agg(F.min_by(F.struct("rank", "text"), order).alias("b"))
    status = F.element_at(F.array(*(F.lit(s) for s in ("OK", "LOOP_TRIMMED", "BEST_EFFORT", "EMPTY"))), F.col("b.rank") + 1)
    return best.select(*keys, F.when(F.col("b.rank") == 3, "").otherwise(F.col("b.text")).alias("text"), status.alias("status"))


# ---------------------------------------------------------------- catalogs


def resolve_style(asked: DataFrame, styles: DataFrame) -> DataFrame:
    """Style of each request by alias, id, display name or default.

    ``asked`` holds ``style_id``; ``styles`` ``id, display_name, slot``, later ones winning.
    Requests are looked up per distinct name; Spark broadcasts the small side if it fits.
    """
    key = F.when(strip(F.coalesce("style_id", F.lit(""))) == "", DEFAULT_STYLE).otherwise(strip(F.col("style_id")))
    alias = F.create_map(*(F.lit(x) for pair in STYLE_ALIASES.items() for x in pair))[F.lower(key)]
    names = styles.select(F.explode(F.array(F.col("id"), F.lower(strip(F.col("display_name"))))).alias("name"), "id", "slot").groupBy("name").agg(F.max_by("id", "slot").alias("found"))
    wanted = asked.select("style_id").distinct().select("style_id", F.posexplode(F.array(alias, key, F.lower(key), F.lit(DEFAULT_STYLE))).alias("step", "name"))
    hit = wanted.join(names, "name").groupBy(F.col("style_id").alias("__asked")).agg(F.min_by("found", "step").alias("resolved"))
    return asked.join(hit, asked["style_id"].eqNullSafe(hit["__asked"]), "left").drop("__asked")


def match_catalog_name(answers: DataFrame, catalog: list[str], default: str) -> DataFrame:
    """Name a model answer means: exact, else the first equal or contained one ignoring case.

    ``catalog`` is a fixed list of names in order.
    """
    text = clean_answer(F.col("answer"))
    names = F.array(*(F.lit(n) for n in catalog))
    low = F.lower(text)
    loose = F.filter(names, lambda n: (F.lower(n) == low) | F.contains(low, F.lower(n)) | F.contains(F.lower(n), low))
    return answers.withColumn("matched", F.when(F.array_contains(names, text), text).otherwise(F.coalesce(F.try_element_at(loose, F.lit(1)), F.lit(default))))


def resolve_font(asked: DataFrame, fonts: DataFrame) -> DataFrame:
    """Font file of each request: its path, else by name or file name, else the first font.

    ``fonts`` hold ``slot, name, path``; a named path that does not exist is an error row.
    """
    listed = fonts.select("slot", "path", F.explode(F.array(F.lower("name"), F.lower(F.substring_index("path", "/", -1)))).alias("key"))
    by_name = listed.groupBy("key").agg(F.min_by("path", "slot").alias("named"))
    known = fonts.select(F.col("path").alias("__path")).distinct().withColumn("__known", F.lit(True))
    first = fonts.agg(F.min_by("path", "slot").alias("f")).first()["f"] or ""
    explicit = strip(F.coalesce("font_path", F.lit("")))
    df = asked.withColumns({"__p": explicit, "key": F.lower(strip(F.coalesce("font_name", F.lit(""))))})
    df = df.join(by_name, "key", "left").join(known, F.col("__p") == F.col("__path"), "left")
    return df.withColumns({
        "font_error": (F.col("__p") != "") & F.col("__known").isNull(),
        "resolved": F.when(F.col("__p") != "", F.when(F.col("__known"), F.col("__p"))).otherwise(F.coalesce(F.when(F.col("key") != "", F.col("named")), F.lit(first))),
    }).drop("__p", "key", "named", "__path", "__known")
