"""Terms and story context of a project, from its source and translated lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions.text import strip
from pagestrata.operators.translation import LINE, PAGE, page_chunks, page_positions, page_shapes
from pagestrata.session import cut_lineage

# Fixed values
JAPANESE_TITLES = "さん|君|くん|ちゃん|様|さま|先生|先輩|後輩|殿"
KOREAN_TITLES = "씨|님|선배|후배|형|누나|오빠|언니"
CHINESE_TITLES = "先生|小姐|大人|师父|师兄|师姐"
COMMON_WORDS = (
    "は", "が", "を", "に", "の", "で", "と", "も", "や", "か", "から", "まで", "より", "など", "だ", "です", "ます",
    "은", "는", "이", "가", "을", "를", "의", "에", "와", "과", "도", "만", "부터", "까지", "에서", "로", "으로",
    "的", "了", "是", "在", "有", "和", "与", "或", "但", "而", "就", "也", "都", "要", "会", "能", "可以",
)
WORD = r"[\p{L}\p{N}_]"
NAME_PATTERNS = (
    rf"({WORD}+)[-\s]?(?:{JAPANESE_TITLES})", rf"({WORD}+)[-\s]?(?:{KOREAN_TITLES})", rf"({WORD}+)[-\s]?(?:{CHINESE_TITLES})",
    rf"(?<!{WORD})([A-Z][a-z]{{2,}})(?!{WORD})",
)
PROMPT_START, PROMPT_END = "---\nCONTEXT MEMORY:\n", "---\n"
NAMES_TITLE, TERMS_TITLE = "CHARACTER NAMES (use consistently):", "KEY TERMS (translate consistently):"
STORY_TITLE = "STORY SO FAR:\n  "
MANUAL_TERM_WEIGHT = 5
PRIORITY_TERMS, PROMPT_TERMS, MAX_NAMES, RECENT_PAGES = 20, 15, 15, 5
SUMMARY_PAGES, SUMMARY_LINES, MIN_SUMMARY_CHARS = 3, 3, 10


def term_candidates(text: Column) -> Column:
    """All counted words of a line, names by pattern first, then plain words, in order."""
    names = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in NAME_PATTERNS))
    words = F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: ~w.isin(*COMMON_WORDS))
    return F.filter(F.concat(names, words), lambda w: F.length(w) >= 2)


def term_rows(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row per counted word; pages whose line counts differ are left out."""
    fine = page_shapes(source, target).where("valid").select(*PAGE)
    both = source.join(target.select(*LINE, F.col("text").alias("translated")), LINE).join(fine, PAGE, "left_semi")
    filled = both.where((F.col("text") != "") & (F.col("translated") != ""))
    return filled.select(*LINE, F.posexplode(term_candidates(F.col("text"))).alias("slot", "term"))


def term_usage(rows: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Counts per project and term, with where each was first seen.

    ``manual`` adds terms (``project_id, term``), which weigh more and come last on a tie.
    """
    seen = F.struct("page_no", "line_no", "slot")
    counted = rows.groupBy("project_id", "term").agg(F.count("*").alias("cnt"), F.min(seen).alias("first_seen"))
    if manual is None:
        return counted
    last = F.struct(*(F.lit(2**62).cast(t).alias(n) for n, t in (("page_no", "long"), ("line_no", "long"))), F.lit(2**31 - 1).alias("slot"))
    extra = manual.groupBy("project_id", "term").agg((F.count("*") * MANUAL_TERM_WEIGHT).alias("cnt")).withColumn("first_seen", last)
    return counted.unionByName(extra).groupBy("project_id", "term").agg(
        F.sum("cnt").alias("cnt"), F.min("first_seen").alias("first_seen")
    )


def priority_terms(usage: DataFrame, n: int = PRIORITY_TERMS) -> DataFrame:
    """Top terms of each project; Spark keeps only n rows per task before the shuffle."""
    best = Window.partitionBy("project_id").orderBy(F.col("cnt").desc(), "first_seen")
    return usage.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def frequent_terms(usage: DataFrame) -> DataFrame:
    """Terms for the prompt: the first of the top ones that occur at least twice."""
    top = priority_terms(usage).where("cnt >= 2")
    return top.where(F.col("rank") <= PROMPT_TERMS)


#: Pages that are summed up in one sorted run.
RUN_PAGES = 256


def running_term_usage(rows: DataFrame) -> DataFrame:
    """Count of a term known before each page that uses it.

    Pages are cut into runs: counts are summed inside a run and shifted by the sums of the runs before, so a term of a very long
    project is not sorted in one task.
    """
    key, run = ["project_id", "term"], F.floor(F.col("page_no") / RUN_PAGES)
    per_page = rows.groupBy(*PAGE, "term").agg(F.count("*").alias("cnt")).withColumn("__run", run)
    before = Window.partitionBy(*key).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)
    runs = per_page.groupBy(*key, "__run").agg(F.sum("cnt").alias("__n"))
    runs = runs.select(*key, "__run", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__before"))
    inside = Window.partitionBy(*key, "__run").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("cnt").over(inside), F.lit(0).cast("long"))
    return per_page.withColumn("__own", own).join(runs, [*key, "__run"]).select(*PAGE, "term", "cnt", (F.col("__own") + F.col("__before")).alias("known_before"))


#: Blocks of chunks per block of the next level.
FAN = 16


def terms_before(rows: DataFrame, chunks: DataFrame, n: int = PRIORITY_TERMS) -> DataFrame:
    """Top terms of all earlier chunks, for each chunk: ``project_id, chunk, term, cnt, first_seen, rank``.

    Works down from blocks of many chunks to single ones. A term that is among the first n before a block's part was
    so before the block, or occurs in the block: only such terms are carried, so a long project costs a constant
    number of rows per term and level, and no window holds more than one block or one set of candidates.
    """
    used = rows.join(chunks.select(*PAGE, "chunk"), PAGE).groupBy("project_id", "chunk", "term").agg(
        F.count("*").alias("cnt"), F.min(F.struct("page_no", "line_no", "slot")).alias("first_seen"))
    used = cut_lineage(used)
    last = used.agg(F.max("chunk")).first()[0] or 0
    levels = 1
    while FAN**levels <= last:
        levels += 1
    base = used.groupBy("project_id", "term").agg(F.min("first_seen").alias("first_seen")).select(
        "project_id", F.lit(0).cast("long").alias("parent"), "term", F.lit(0).cast("long").alias("before"), "first_seen")
    top, key = None, ["project_id", "parent", "term"]
    for level in reversed(range(levels)):
        block = F.floor(F.col("chunk") / FAN**level)
        counts = used.groupBy("project_id", F.floor(block / FAN).alias("parent"), block.alias("block"), "term").agg(F.sum("cnt").alias("cnt"))
        inside = Window.partitionBy(*key).orderBy("block")
        seen = cut_lineage(counts.join(base, key).withColumns({
            "before": F.col("before") + F.coalesce(F.sum("cnt").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")),
            "until": F.coalesce(F.lead("block").over(inside), (F.col("parent") + 1) * FAN - 1),
        }))
        cols = ["project_id", "block", "term", "cnt", "first_seen"]
        held = seen.where(F.col("until") > F.col("block")).select(
            "project_id", "term", "first_seen", (F.col("before") + F.col("cnt")).alias("cnt"),
            F.explode(F.sequence(F.col("block") + 1, "until")).alias("block")).select(cols)
        if top is not None:
            first = F.col("block") * FAN
            held = held.unionByName(top.withColumn("block", F.explode(F.sequence(first, first + (FAN - 1)))).select(cols))
        merged = held.groupBy("project_id", "block", "term").agg(F.max("cnt").alias("cnt"), F.min("first_seen").alias("first_seen"))
        best = Window.partitionBy("project_id", "block").orderBy(F.col("cnt").desc(), "first_seen")
        top = cut_lineage(merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n))
        base = seen.select("project_id", F.col("block").alias("parent"), "term", "before", "first_seen")
    present = chunks.select("project_id", "chunk").distinct()
    return top.withColumnRenamed("block", "chunk").join(present, ["project_id", "chunk"], "left_semi")


def story_summary(target: DataFrame) -> DataFrame:
    """Summary after every page: long lines of the last three pages, first three of them.

    Each page gives at most three lines to its own and the two following pages, so the
    groups stay small however long a project is.
    """
    long_ = target.where(F.length("text") > MIN_SUMMARY_CHARS)
    first = Window.partitionBy(*PAGE).orderBy("line_no")
    heads = long_.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= SUMMARY_LINES).drop("__n")
    pages = page_positions(target.select(*PAGE).distinct())
    spread = heads.join(pages, PAGE).select(
        "project_id", F.col("position").alias("from_page"), "line_no", "text",
        F.explode(F.sequence(F.col("position"), F.col("position") + (SUMMARY_PAGES - 1))).alias("position"),
    )
    picked = spread.groupBy("project_id", "position").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("from_page", "line_no", "text"))), 1, SUMMARY_LINES).alias("__s")
    )
    joined = F.concat(F.array_join(F.transform("__s", lambda s: s["text"]), " | "), F.lit("..."))
    return pages.join(picked, ["project_id", "position"], "left").select(
        *PAGE, "position", F.coalesce(joined, F.lit("")).alias("summary")
    )


def chunk_summaries(target: DataFrame, size: int | None = None) -> DataFrame:
    """The summary in force after each chunk: that of its last page."""
    chunks = page_chunks(target.select(*PAGE).distinct(), size)
    last = chunks.groupBy("project_id", "chunk").agg(F.max("page_no").alias("page_no"))
    return last.join(story_summary(target), PAGE).select("project_id", "chunk", "page_no", "summary")


def context_stats(usage: DataFrame, pages: DataFrame, terms: DataFrame, summaries: DataFrame) -> DataFrame:
    """Size of the memory of each project. ``terms`` hold ``project_id, term, is_name``."""
    words = usage.groupBy("project_id").agg(F.count("*").alias("tracked_words"))
    recent = pages.select(*PAGE).distinct().groupBy("project_id").agg(F.least(F.lit(RECENT_PAGES), F.count("*")).alias("recent_pages"))
    known = terms.groupBy("project_id").agg(
        F.countDistinct("term").alias("total_terms"), F.countDistinct(F.when(F.col("is_name"), F.col("term"))).alias("character_names")
    )
    story = summaries.groupBy("project_id").agg((F.max_by("summary", "page_no") != "").alias("has_summary"))
    return recent.join(words, "project_id", "left").join(known, "project_id", "left").join(story, "project_id", "left").na.fill(
        0, ["tracked_words", "total_terms", "character_names"]
    ).withColumn("has_summary", F.coalesce("has_summary", F.lit(False)))


def parse_terms(text: Column) -> Column:
    """Pairs inside [TERMS] .. [/TERMS] of a reply, in order of first mention."""
    section = F.regexp_extract(text, r"(?s)\[TERMS\](.*?)\[/TERMS\]", 1)
    pairs = F.transform(F.filter(F.split(section, "\n"), lambda x: F.contains(x, F.lit("→"))), lambda x: F.split(x, "→", 2))
    named = F.transform(pairs, lambda p: F.struct(strip(p[0]).alias("term"), strip(p[1]).alias("translation")))
    return F.filter(named, lambda p: (p["term"] != "") & (p["translation"] != ""))


def term_pairs(replies: DataFrame) -> DataFrame:
    """One row per project and term from replies (``project_id, page_no, reply``); the last wins."""
    rows = replies.select("project_id", "page_no", F.posexplode(parse_terms(F.col("reply"))).alias("slot", "pair"))
    return rows.groupBy("project_id", F.col("pair.term").alias("term")).agg(
        F.max_by("pair.translation", F.struct("page_no", "slot")).alias("translation"), F.min(F.struct("page_no", "slot")).alias("first_seen")
    )


def _section(rows: DataFrame, title: str, line: Column, order: Column, name: str, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    listed = F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda s: s["l"])
    return rows.groupBy(*keys).agg(F.concat(F.lit(title + "\n"), F.array_join(listed, "")).alias(name))


def _name_lines(names: DataFrame) -> DataFrame:
    pair = F.format_string("  %s → %s\n", "term", "translation")
    return _section(names.where(F.col("rank") <= MAX_NAMES), NAMES_TITLE, pair, F.col("rank"), "a")


def _term_lines(frequent: DataFrame, terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    keyed = frequent.join(terms.select("project_id", "term", "translation"), ["project_id", "term"], "left")
    line = F.when(F.col("translation").isNotNull(), F.format_string("  %s → %s\n", "term", "translation")).otherwise(
        F.format_string("  %s (×%d)\n", "term", "cnt"))
    return _section(keyed, TERMS_TITLE, line, F.col("rank"), "b", keys)


def _prompt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, prompt`` from the names ``a``, the terms ``b`` and the story ``s``."""
    story = F.when(F.col("s") != "", F.concat(F.lit(STORY_TITLE), "s", F.lit("\n")))
    body = F.concat_ws("", "a", "b", story)
    return df.select(*keys, F.when(body != "", F.concat(F.lit(PROMPT_START), body, F.lit(PROMPT_END))).otherwise("").alias("prompt"))


def context_prompt(usage: DataFrame, names: DataFrame, terms: DataFrame, summaries: DataFrame) -> DataFrame:
    """Context text per project after its last page: names, key terms, story. Empty parts are left out.

    ``names`` and ``terms`` hold ``project_id, term, translation``; names also ``rank``.
    """
    keys = ["project_id"]
    story = summaries.groupBy(*keys).agg(F.max_by("summary", "page_no").alias("s"))
    terms_of = _term_lines(frequent_terms(usage), terms, keys)
    return _prompt(story.join(_name_lines(names), keys, "left").join(terms_of, keys, "left"), keys)


def chunk_context(rows: DataFrame, chunks: DataFrame, target: DataFrame, names: DataFrame, terms: DataFrame) -> DataFrame:
    """Context text per chunk: names and translations given for the project, key terms and story of the chunks before.

    ``rows`` are those of ``term_rows``; ``chunks`` assign ``chunk`` to the pages, without gaps from 0.
    """
    keys = ["project_id", "chunk"]
    frequent = terms_before(rows, chunks).where((F.col("cnt") >= 2) & (F.col("rank") <= PROMPT_TERMS))
    after = story_summary(target).join(chunks.select(*PAGE, "chunk"), PAGE).groupBy(*keys).agg(F.max_by("summary", "page_no").alias("s"))
    story = after.withColumn("chunk", F.col("chunk") + 1)
    df = chunks.select(*keys).distinct().join(story, keys, "left").join(_term_lines(frequent, terms, keys), keys, "left")
    return _prompt(df.join(_name_lines(names), "project_id", "left"), keys)
