"""What a project has taught so far, as rows that merge: terms with counts, names with translations, recent pages.

A memory is a table ``project_id, kind, key, cnt, seen, round, value, lines``. Terms add up, names keep their first place and their
latest translation, and of the pages only the last few stay. Merging is one grouping, so a memory can be rolled forward by
rounds, by batches of a stream or all at once, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagestrata.operators import terms as tm
from pagestrata.operators.translation import LINE, PAGE

SEEN = "struct<page_no: long, line_no: long, slot: long>"
SCHEMA = f"project_id long, kind string, key string, cnt long, seen {SEEN}, round long, value string, lines array<string>"
#: Place after all lines of a page, for names that its reply teaches.
AFTER_LINES = 2**62


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def _rows(df: DataFrame, kind: str, key: Column, cnt: Column, seen: Column, round_: Column, value: Column | None = None, lines: Column | None = None) -> DataFrame:
    none = F.lit(None)
    return df.select(
        F.col("project_id").cast("long").alias("project_id"), F.lit(kind).alias("kind"), key.cast("string").alias("key"), cnt.cast("long").alias("cnt"), seen.cast(SEEN).alias("seen"),
        round_.cast("long").alias("round"), (none if value is None else value).cast("string").alias("value"), (none if lines is None else lines).cast("array<string>").alias("lines"))


def place(page_no: str | int, line_no: str | int, slot: str | int) -> Column:
    parts = {"page_no": page_no, "line_no": line_no, "slot": slot}
    return F.struct(*((F.lit(x) if isinstance(x, int) else F.col(x)).cast("long").alias(n) for n, x in parts.items()))


def given_names(known: DataFrame) -> DataFrame:
    """Names set by hand (``project_id, term, translation, slot``), before all pages; each weighs as much as five mentions."""
    at = place(-1, 0, "slot")
    return _taught(known.withColumnsRenamed({"term": "key"}), at, F.lit(-1))


def _taught(rows: DataFrame, at: Column, round_: Column) -> DataFrame:
    names = _rows(rows, "name", F.col("key"), F.lit(0), at, round_, F.col("translation"))
    return names.unionByName(_rows(rows, "term", F.col("key"), F.lit(tm.MANUAL_TERM_WEIGHT), at, round_))


def learnt(done: DataFrame, replies: DataFrame, round_: int) -> DataFrame:
    """What translated lines (``text, translated``) and replies (``page_no, step, reply``) add."""
    filled = done.where((F.col("text") != "") & (F.col("translated") != ""))
    words = filled.select(*LINE, F.posexplode(tm.term_candidates(F.col("text"))).alias("slot", "key"))
    terms = _rows(words.groupBy("project_id", "key").agg(F.count("*").alias("n"), F.min(place("page_no", "line_no", "slot")).alias("at")), "term", F.col("key"), F.col("n"), F.col("at"), F.lit(round_))
    long_ = F.filter(F.collect_list(F.when(F.length("translated") > tm.MIN_SUMMARY_CHARS, F.struct("line_no", "translated"))), lambda x: x.isNotNull())
    heads = F.transform(F.slice(F.sort_array(long_), 1, tm.SUMMARY_LINES), lambda x: x["translated"])
    pages = done.groupBy(*PAGE).agg(heads.alias("heads"))
    told = _rows(pages, "page", F.col("page_no"), F.lit(0), place("page_no", 0, 0), F.lit(round_), None, F.col("heads"))
    pairs = replies.select(*PAGE, "step", F.posexplode(tm.parse_terms(F.coalesce("reply", F.lit("")))).alias("slot", "pair"))
    pairs = pairs.groupBy(*PAGE, "step", F.col("pair.term").alias("key")).agg(F.max_by("pair.translation", "slot").alias("translation"), F.min("slot").alias("slot"))
    at = F.struct(F.col("page_no").cast("long").alias("page_no"), (F.lit(AFTER_LINES) + F.col("step")).alias("line_no"), F.col("slot").cast("long").alias("slot"))
    return terms.unionByName(told).unionByName(_taught(pairs, at, F.lit(round_)))


def merged(rows: DataFrame) -> DataFrame:
    """One row per project, kind and key; only the last pages of each project stay."""
    latest = F.struct("round", "seen")
    one = rows.groupBy("project_id", "kind", "key").agg(
        F.sum("cnt").alias("cnt"), F.min("seen").alias("seen"), F.max("round").alias("round"), F.max_by("value", latest).alias("value"), F.max_by("lines", latest).alias("lines"))
    newest = Window.partitionBy("project_id").orderBy(F.col("seen.page_no").desc())
    pages = one.where("kind = 'page'").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= tm.RECENT_PAGES).drop("n")
    return one.where("kind <> 'page'").unionByName(pages)


def summaries(memory: DataFrame) -> DataFrame:
    """The story so far of every project: the first long lines of its last three pages."""
    newest = Window.partitionBy("project_id").orderBy(F.col("seen.page_no").desc())
    pages = memory.where("kind = 'page'").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= tm.SUMMARY_PAGES)
    told = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(F.col("seen.page_no").alias("page_no"), "lines"))), lambda p: p["lines"]))
    story = pages.groupBy("project_id").agg(F.max("seen.page_no").alias("page_no"), F.slice(told, 1, tm.SUMMARY_LINES).alias("told"))
    return story.select("project_id", "page_no", F.when(F.size("told") > 0, F.concat(F.array_join("told", " | "), F.lit("..."))).otherwise("").alias("summary"))


def usage(memory: DataFrame) -> DataFrame:
    return memory.where("kind = 'term'").select("project_id", F.col("key").alias("term"), "cnt", F.col("seen").alias("first_seen"))


def names(memory: DataFrame) -> DataFrame:
    """Names in the order in which they were learnt: ``project_id, term, translation, rank``."""
    order = Window.partitionBy("project_id").orderBy("seen", "key")
    return memory.where("kind = 'name'").select("project_id", F.col("key").alias("term"), F.col("value").alias("translation"), F.row_number().over(order).alias("rank"))


def prompts(memory: DataFrame) -> DataFrame:
    """Context text of every project that has any: ``project_id, prompt``."""
    known = names(memory)
    projects = memory.select("project_id").distinct().join(summaries(memory), "project_id", "left")
    return tm.context_prompt(usage(memory), known, known.select("project_id", "term", "translation"), projects)


def stats(memory: DataFrame) -> DataFrame:
    """Sizes of every project's memory."""
    story = memory.select("project_id").distinct().join(summaries(memory), "project_id", "left")
    counts = memory.groupBy("project_id").agg(
        F.count_if(F.col("kind") == "term").alias("tracked_words"), F.count_if(F.col("kind") == "name").alias("character_names"), F.count_if(F.col("kind") == "page").alias("recent_pages"))
    return counts.join(story.select("project_id", F.coalesce(F.col("summary") != "", F.lit(False)).alias("has_summary")), "project_id")
