"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; a line found in more than ``MAX_DOCS`` documents of one host (source) is boilerplate and is
taken out of every document of that host. A document that loses more than half of its characters, or fails the base
rules, is rejected. Counts are combined before the exchange. The commonest lines are few by arithmetic (no more than
``TOP_LINES`` lines can each hold a ``TOP_LINES``-th of the rows) and are looked up by broadcast; a line below that bound
never fills a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagestrata.llm import base

# Fixed values
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3
#: A line in more documents of its host than this is taken out.
MAX_DOCS = 10
#: A document is depleted when it keeps less than this share of its characters (of normalised lines).
LEAST_LEFT = 0.5
#: At most so many lines are sent to every task.
TOP_LINES = 10_000
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def normalised(text: Column) -> Column:
    """Lines in lower case, digits as 0, runs of white space as one space; trimmed, empty ones left out."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", "0"), "[ \t\x0b\f\r]+", " ")
    return F.split(F.regexp_replace(clean, " ?\n ?", "\n"), "\n")


def line_keys(lines: Column, host: Column) -> Column:
    """(h1, h2, chars) per line: 128 bits of (host, line), a null host apart from an empty one."""
    return F.transform(lines, lambda x: F.struct(
        F.xxhash64(host.isNull(), host, x).alias("h1"), F.xxhash64(x, host, host.isNull(), F.lit(1)).alias("h2"), F.length(x).cast("long").alias("chars")))


def with_signals(docs: DataFrame, *carried: str) -> DataFrame:
    """row_id, doc_id, the base signals and the line keys of every document; one scan, everything inside the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.col("source").alias("host"), text.alias("body"),
                       *(F.col(c).alias(f"own_{i}") for i, c in enumerate(carried)))
    own = [f"own_{i}" for i in range(len(carried))]
    rows = rows.select(
        "row_id", "doc_id", "host", *own,
        F.array_remove(F.split("body", f"[{SPACES}]+"), "").alias("words"),
        F.filter(F.split("body", "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "").alias("lines"),
        F.filter(F.transform(normalised(F.col("body")), lambda x: F.trim(x)), lambda x: x != "").alias("plain"),
        (F.length("body") - F.length(F.regexp_replace("body", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
    )
    # windows as hashes of three words; equal neighbours in hash order start at places where a window repeats
    n = F.size("words")
    marks = F.when(n >= WINDOW, F.array_sort(F.transform(
        F.slice(F.arrays_zip(F.col("words").alias("a"), F.slice("words", F.lit(2), n).alias("b"), F.slice("words", F.lit(3), n).alias("c")), F.lit(1), n - 2),
        lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h: long, i: int>>"))
    rows = rows.select(
        "row_id", "doc_id", *own, n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        marks.alias("marks"), line_keys(F.col("plain"), F.col("host")).alias("lines"),
    )
    same = F.zip_with(F.slice("marks", F.lit(1), F.greatest(F.size("marks") - 1, F.lit(0))), F.slice("marks", F.lit(2), F.greatest(F.size("marks"), F.lit(1))),
                      lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    starts = F.array_sort(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))
    rows = rows.withColumn("starts", starts)
    more = F.zip_with("starts", F.slice("starts", F.lit(2), F.greatest(F.size("starts"), F.lit(1))),
                      lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(more, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return rows.select("row_id", "doc_id", *own, "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"), "lines")


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def common_lines(rows: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(h1, h2, docs) of lines in more than ``max_docs`` documents of a host; a row of the table is a document."""
    each = rows.select(F.explode(F.array_distinct(F.transform("lines", lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"))))).alias("x"))
    return each.groupBy("x.h1", "x.h2").agg(F.count("*").alias("docs")).filter(F.col("docs") > max_docs)


def removed_lines(rows: DataFrame, common: DataFrame) -> DataFrame:
    """(row_id, at, chars) of every line of ``rows`` that is in ``common``."""
    total = common.agg(F.sum("docs")).first()[0] or 0
    top = F.col("docs") * TOP_LINES > total
    often = F.broadcast(common.filter(top).select("h1", "h2"))  # fewer than TOP_LINES rows
    each = rows.select("row_id", F.posexplode("lines").alias("at", "x")).select("row_id", "at", "x.*")
    rest = each.join(often, ["h1", "h2"], "left_anti").join(common.filter(~top), ["h1", "h2"], "left_semi")
    return each.join(often, ["h1", "h2"], "left_semi").unionByName(rest).select("row_id", "at", "chars")


def _judged(rows: DataFrame, max_docs: int, least_left: float, *carried: str) -> DataFrame:
    common = base.stage(common_lines(rows, max_docs), "common")
    lost = removed_lines(rows, common).groupBy("row_id").agg(F.sum("chars").alias("lost"), F.collect_list("at").alias("gone"))
    chars = F.aggregate("lines", F.lit(0).cast("long"), lambda acc, x: acc + x["chars"])
    left, right = rows.select("row_id", "doc_id", *SIGNALS, *carried, chars.alias("chars")).alias("l"), lost.alias("r")
    met = left.join(right, F.col("l.row_id") == F.col("r.row_id"), "left").select(
        "l.*", F.coalesce("r.lost", F.lit(0)).alias("chars_removed"), F.coalesce("r.gone", F.array().cast("array<int>")).alias("gone"))
    depleted = F.col("chars") - F.col("chars_removed") < least_left * F.col("chars")
    met = met.withColumn("base_failed", base_failed())
    return met.withColumn("kept", ~F.col("base_failed") & ~depleted)


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, the base signals, chars_removed, base_failed and kept, one row per row of ``docs``.

    Null and empty texts have no words and fail the base rules. A null source is a host of its own. Every row counts as a document, so
    repeated rows and copies count as often as they stand there. A line that repeats inside a document counts once for
    the host and is removed wherever it stands. Texts of any length are judged whole. No rows give no rows. Other columns take no
    part, whatever their names. Windows and lines are compared by 64 and 128 bits of hash.
    """
    rows = base.stage(with_signals(docs), "lines")
    return _judged(rows, max_docs, least_left).drop("gone", "chars", "row_id")


def cleaned(docs: DataFrame, max_docs: int = MAX_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """The kept documents with their boilerplate lines taken out of ``text``; all columns of ``docs``."""
    names = docs.columns
    rows = base.stage(with_signals(docs, *names), "lines")
    own = {c: f"own_{i}" for i, c in enumerate(names)}
    kept = _judged(rows, max_docs, least_left, *own.values()).filter("kept")
    # lines of the text and the numbers of the normalised lines among them: blank lines have none and stay
    text = kept.withColumn("parts", F.split(F.col(own["text"]), "\n"))
    text = text.withColumn("full", F.filter(F.sequence(F.lit(0), F.size("parts") - 1), lambda i: F.trim(F.col("parts")[i], F.lit(SPACES)) != ""))
    gone = F.transform("gone", lambda k: F.col("full")[k])
    stays = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), gone)
    text = text.withColumn("stays", F.when(F.size("parts") > 0, stays))
    rest = F.when(F.size("parts") > 0, F.array_join(F.transform("stays", lambda i: F.col("parts")[i]), "\n"))
    return text.select(*((rest if c == "text" else F.col(own[c])).alias(c) for c in names))
