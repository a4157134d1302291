"""Rules on recognised text as Column expressions.

Lengths and positions are code points. Letter case is folded with ``lower`` plus the
German sharp s, which is what the rules need of full case folding.
"""

from __future__ import annotations

import html
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values
FILTERED_PROVIDER = "deepseek_ocr_llama"
MARKUP_MARKERS = (
    "<table", "</table>", "<thead", "<tbody", "<tr", "<td", "<svg", "<path", "<math", "<figure", "<chart",
)
COORDINATE_PATTERN = r"\(?\s*-?\d+(?:\.\d+)?\s*,\s*-?\d+(?:\.\d+)?\s*\)?"
TABLE_WORD_PATTERN = r"(?i)(category|value|blue|red|total|name|score)"
STRUCTURAL_CHARS = "{}[]()<>/:;|,=-_"
KANA_HAN = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
TOKEN_PATTERN = rf"[A-Za-z0-9]+|[{KANA_HAN}]+"
NOT_WORD = r"[^\p{L}\p{N}]"
JSON_TEXT_KEYS = ("text", "ocr", "content", "result")
CJK_NAMES = ("CJK", "HIRAGANA", "KATAKANA", "HANGUL")
VERTICAL_TOKEN = "[!?！？‼⁉]{2}|[^\n]"
CIRCLED_NUMBERS = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
LINE_MARKER = rf"^\s*(?:\(\d{{1,2}}\)|\d{{1,2}}(?:[.):]|\s+)|[{CIRCLED_NUMBERS}]|[\-–—*•・])\s*"
INLINE_NUMBER = rf"(?<=^|\s)(?:\(\d{{1,2}}\)|\d{{1,2}}[.):]|[{CIRCLED_NUMBERS}])(?=\s*\S)"
INLINE_BULLET = r"(?<=^|\s)[\-–—*•・](?=\s*\S)"
OUTPUT_PREFIXES = ("OCR:", "Text:", "Recognized text:", "Output:")
FORMAT_TAGS = "b|strong|i|em|u|s|strike|del|ins|sub|sup|small|big|mark|span|font|ruby|rt|rp|br|p|div"
QUOTA_MARKERS = ("429", "quota", "rate limit", "resource_exhausted", "too many requests")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def fold_case(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def cleaned_ocr(text: Column) -> Column:
    return strip(unix_lines(F.coalesce(text, F.lit(""))))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named.

    Inside array lambdas Spark repeats a named expression at each mention.
    """
    return F.transform(F.array(value), use)[0]


def has_markup(text: Column) -> Column:
    return F.contains(text, F.lit("<")) & text.rlike("(?i)" + "|".join(MARKUP_MARKERS))


def is_coordinates(text: Column) -> Column:
    pairs = _count(text, COORDINATE_PATTERN)
    return text.rlike(r"\d\s*,\s*-?\d") & ((pairs >= 6) | ((pairs >= 3) & F.contains(text, F.lit("--"))))


def is_structured_noise(text: Column) -> Column:
    dense = compact(text)
    size = F.length(dense)
    structural = size - F.length(F.translate(dense, STRUCTURAL_CHARS, ""))
    letters = size - F.length(F.regexp_replace(dense, rf"[\p{{L}}{KANA_HAN}]", ""))
    return (F.length(text) > 120) & (size > 120) & (structural / size > 0.45) & (letters < structural)


def is_table_like(text: Column) -> Column:
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TABLE_WORD_PATTERN), F.lit(1)), F.lower))
    two_gaps = text.rlike(r"(?U)\s\S+\s")
    return (F.length(text) > 20) & ~two_gaps & text.rlike(r"\p{Nd}") & (F.size(words) >= 2)


def _top_share(values: Column, least: float) -> Column:
    """At most two distinct values, one of which fills the share."""
    # array_remove takes the first value once; a lambda would look it up per element
    others = F.array_remove(values, F.try_element_at(values, F.lit(1)))
    size, rest = F.size(values), F.size(others)
    return (F.size(F.array_distinct(others)) <= 1) & (F.greatest(rest, size - rest) / size >= least)


def text_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def is_repeated_line(text: Column) -> Column:
    edges = rf"^{NOT_WORD}+|{NOT_WORD}+$"
    plain = F.filter(
        F.transform(text_lines(text), lambda x: strip(F.regexp_replace(fold_case(x), edges, ""))), lambda x: x != ""
    )
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (breaks >= 4) & let(plain, lambda v: (F.size(v) >= 5) & _top_share(v, 0.70))


def is_repeated_char(dense: Column) -> Column:
    """``dense`` is text without white space."""
    def judge(rest: Column) -> Column:
        other = F.length(F.replace(rest, F.substring(rest, 1, 1), F.lit("")))
        size = F.length(dense)
        first = size - F.length(rest)
        return ((rest == "") | (other == 0)) & (F.greatest(first, size - first) / size >= 0.85)

    return (F.length(dense) >= 12) & let(F.replace(dense, F.substring(dense, 1, 1), F.lit("")), judge)


def is_repeated_token(text: Column) -> Column:
    tokens = F.transform(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), fold_case)
    # of two values at most, three tokens hold one twice; most texts end here
    head = r"^" + rf"[^A-Za-z0-9{KANA_HAN}]*+([A-Za-z0-9]++|[{KANA_HAN}]++)" * 3
    a, b, c = (fold_case(F.regexp_extract(text, head, k)) for k in (1, 2, 3))
    return ((a == b) | (b == c) | (a == c)) & let(tokens, lambda v: (F.size(v) >= 6) & _top_share(v, 0.70))


def is_repeated_pattern(dense: Column) -> Column:
    """A unit of 2 to 8 characters opens the text, at least four times and over .80 of it."""
    size = F.length(dense)

    def fits(unit: Column) -> Column:
        times = F.greatest(F.lit(4), F.ceil((size * 4) / (unit * 5.0)).cast("int"))
        return (times * unit <= size) & (dense.substr(F.lit(1), times * unit) == F.repeat(dense.substr(F.lit(1), unit), times))

    units = F.filter(F.array(*(F.lit(n) for n in range(2, 9))), lambda u: u * 4 <= size)
    return (size >= 16) & dense.rlike(r"(?s)^(.{2,8})\1\1\1") & F.exists(units, fits)


def repetition_reason(line: Column) -> Column:
    return let(compact(line), lambda dense: (
        F.when(is_repeated_char(dense), "repeated_character_hallucination")
        .when(is_repeated_token(line), "repeated_token_hallucination")
        .when(is_repeated_pattern(dense), "repeated_pattern_hallucination")
    ))


def judged_lines(text: Column) -> Column:
    """Non-empty lines with the reason each would be dropped for."""
    return F.transform(text_lines(text), lambda x: F.struct(x.alias("line"), repetition_reason(x).alias("reason")))


def whole_json(text: Column) -> Column:
    """Variant of a text that is JSON from end to end, else NULL.

    The parser stops after the first value, so the text is parsed as the first of two
    list members: anything behind the value breaks the list or adds a member.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(",7]")))
    alone = (F.try_variant_get(pair, F.lit("$[1]"), "int") == 7) & F.try_variant_get(pair, F.lit("$[2]"), "variant").isNull()
    return F.when(alone, F.try_variant_get(pair, F.lit("$[0]"), "variant"))


def _json_step(df: DataFrame) -> DataFrame:
    """One level of JSON unwrapping of ``__t`` for rows still without a verdict."""
    opened = F.col("__open")
    begins = F.col("__t").rlike(r'^[{\["\-0-9tfnNI]')
    df = df.withColumn("__v", F.when(opened & begins, whole_json(F.col("__t"))))
    df = df.withColumn("__kind", F.schema_of_variant("__v"))
    inner = None
    for key in JSON_TEXT_KEYS:
        part = F.try_variant_get("__v", F.lit(f"$.{key}"), "variant")
        found = F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get("__v", F.lit(f"$.{key}"), "string"))
        inner = found if inner is None else F.coalesce(inner, found)
    parts = F.filter(F.try_variant_get("__v", F.lit("$"), "array<string>"), lambda x: strip(x) != "")
    unwrapped = F.when(F.col("__kind").startswith("OBJECT"), inner).when(
        F.col("__kind") == "ARRAY<STRING>", F.array_join(parts, "\n")
    )
    df = df.withColumn("__u", unwrapped)
    is_json = F.col("__v").isNotNull()
    return df.withColumns({
        "__reason": F.when(is_json & F.col("__u").isNull(), "structured_json_non_text").otherwise(F.col("__reason")),
        "__t": F.when(F.col("__u").isNotNull(), cleaned_ocr(F.col("__u"))).otherwise(F.col("__t")),
        "__open": opened & F.col("__u").isNotNull(),
    }).drop("__v", "__kind", "__u")


def filter_ocr_text(df: DataFrame, text: Column, provider: Column) -> DataFrame:
    """Adds ``clean_text, rejected, reason``. Only one provider is checked beyond emptiness."""
    df = df.withColumns({"__t": cleaned_ocr(text), "__open": strip(F.coalesce(provider, F.lit(""))) == FILTERED_PROVIDER})
    df = df.withColumns({
        "__checked": F.col("__open"), "__reason": F.when(F.col("__t") == "", "empty_ocr_output"),
    })
    for _ in range(4):
        df = df.withColumns({
            "__reason": F.when(
                F.col("__open") & F.col("__reason").isNull() & has_markup(F.col("__t")), "structured_markup_non_text"
            ).otherwise(F.col("__reason")),
        }).withColumn("__open", F.col("__open") & F.col("__reason").isNull())
        df = _json_step(df).withColumn(
            "__reason", F.when(F.col("__open") & (F.col("__t") == ""), "empty_ocr_output").otherwise(F.col("__reason"))
        )
    # still open after four levels: nested too deep
    df = df.withColumn("__reason", F.when(
        F.col("__open") & F.col("__reason").isNull(), "structured_json_non_text").otherwise(F.col("__reason")))
    t, live = F.col("__t"), F.col("__checked") & F.col("__reason").isNull()
    df = df.withColumn("__reason", F.when(live, F.when(is_coordinates(t), "coordinate_geometry_non_text")
        .when(is_structured_noise(t), "structured_hallucination_non_text").when(is_table_like(t), "table_like_non_text")
        .when(is_repeated_line(t), "repeated_line_hallucination")).otherwise(F.col("__reason")))
    live = F.col("__checked") & F.col("__reason").isNull()
    df = df.withColumn("__lines", F.when(live, judged_lines(F.col("__t"))))
    kept = F.transform(F.filter("__lines", lambda x: x["reason"].isNull()), lambda x: x["line"])
    bad = F.filter("__lines", lambda x: x["reason"].isNotNull())
    df = df.withColumns({"__kept": kept, "__bad": bad})
    some_bad = F.coalesce(F.size("__bad") > 0, F.lit(False))
    none_left = some_bad & (F.size("__kept") == 0)
    df = df.withColumn("reason", F.coalesce(F.when(none_left, F.col("__bad")[0]["reason"]), F.col("__reason"), F.lit("")))
    return df.withColumns({
        "rejected": F.col("reason") != "",
        "clean_text": F.when(F.col("reason") != "", "").when(some_bad, F.array_join("__kept", "\n")).otherwise(F.col("__t")),
    }).drop("__t", "__open", "__checked", "__reason", "__lines", "__kept", "__bad")


# ---------------------------------------------------------------- clean-up


def join_text_lines(lines: Column) -> Column:
    """Lines joined by one space, none left before punctuation."""
    joined = F.array_join(F.filter(F.transform(lines, strip), lambda x: x != ""), " ")
    return strip(F.regexp_replace(F.regexp_replace(joined, r"(?U)\s+", " "), r"\s+([,.;:!?])", "$1"))


def strip_list_markers(text: Column) -> Column:
    """Text of a list without its numbers and bullets."""
    trimmed = strip(F.coalesce(text, F.lit("")))
    lines = F.split(unix_lines(trimmed), "\n")
    filled = F.filter(lines, lambda x: strip(x) != "")
    marked = F.size(F.filter(filled, lambda x: x.rlike(LINE_MARKER)))
    is_list = (F.size(filled) >= 2) & (marked >= F.greatest(F.lit(2), F.size(filled) - 1))
    # the marker pattern is anchored at the start of a line
    bare = join_text_lines(F.transform(lines, lambda x: F.regexp_replace(x, LINE_MARKER, "")))
    inline = F.regexp_replace(F.regexp_replace(trimmed, INLINE_NUMBER, ""), INLINE_BULLET, "")
    return F.when(is_list, bare).when(
        inline != trimmed, join_text_lines(F.split(unix_lines(inline), "\n"))
    ).otherwise(trimmed)


def _json_text(df: DataFrame, column: str) -> DataFrame:
    df = df.withColumn("__v", F.when(F.col(column).rlike(r"^[{\[]"), whole_json(F.col(column))))
    picked = None
    for key in JSON_TEXT_KEYS:
        part = F.try_variant_get("__v", F.lit(f"$.{key}"), "variant")
        found = F.when(F.schema_of_variant(part) == "STRING", strip(F.try_variant_get("__v", F.lit(f"$.{key}"), "string")))
        picked = found if picked is None else F.coalesce(picked, found)
    members = F.filter(F.try_variant_get("__v", F.lit("$"), "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    strings = F.transform(members, lambda x: F.try_variant_get(x, F.lit("$"), "string"))
    listed = F.when(F.size(strings) > 0, strip(F.array_join(strings, "\n")))
    return df.withColumn(column, F.coalesce(picked, listed, F.col(column))).drop("__v")


def clean_model_output(df: DataFrame, text: Column, name: str = "clean_text") -> DataFrame:
    """Code fence, JSON wrapper, answer prefix, list marks and spare white space removed."""
    whole = strip(F.coalesce(text, F.lit("")))
    rows = F.split(whole, r"\r\n|\n|\r")
    fenced = whole.startswith("```") & whole.endswith("```") & (F.size(rows) >= 2)
    inside = strip(F.array_join(F.slice(rows, F.lit(2), F.greatest(F.lit(0), F.size(rows) - 2)), "\n"))
    df = _json_text(df.withColumn(name, F.when(fenced, inside).otherwise(whole)), name)
    lowered, cut = F.lower(F.col(name)), None
    for prefix in OUTPUT_PREFIXES:
        hit = lowered.startswith(prefix.lower())
        rest = strip(F.col(name).substr(F.lit(len(prefix) + 1), F.length(F.col(name))))
        cut = F.when(hit, rest) if cut is None else cut.when(hit, rest)
    df = df.withColumn(name, cut.otherwise(F.col(name)))
    df = df.withColumn(name, strip_list_markers(F.col(name)))
    tidy = F.transform(text_lines(unix_lines(F.col(name))), lambda x: F.regexp_replace(x, r"(?U)\s+", " "))
    return df.withColumn(name, F.array_join(tidy, "\n"))


@F.pandas_udf(StringType())
def unescape_entities(text: pd.Series) -> pd.Series:
    """Named and numeric character references of HTML; Spark has no function for their table."""
    return text.map(html.unescape, na_action="ignore")


def strip_markup(text: Column) -> Column:
    """Readable text of marked-up recognition output."""
    out = unescape_entities(F.coalesce(text, F.lit("")))
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{FORMAT_TAGS})\b[^>]*>", "")
    out = F.regexp_replace(out, r"</?[A-Za-z][A-Za-z0-9:_-]*(?:\s+[^<>]*)?>", "")
    out = F.regexp_replace(F.replace(out, F.lit(" "), F.lit(" ")), r"[ \t\r\f\x0B]+", " ")
    out = F.regexp_replace(out, r"\s*\n\s*", " ")
    return strip(F.regexp_replace(out, r"\s+([,.!?;:…。、！？])", "$1"))


def clean_piece(text: Column) -> Column:
    """Straight quotes, plain ligatures, single spaces."""
    out = F.translate(strip(F.coalesce(text, F.lit(""))), "’‘“”", "''\"\"")
    out = F.replace(F.replace(out, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def clean_joined(text: Column) -> Column:
    """Joined pieces without spaces before punctuation or around apostrophes."""
    out = F.regexp_replace(clean_piece(text), r"\s+([,.!?;:])", "$1")
    out = F.regexp_replace(out, r"(?U)\b([A-Za-z])\s+'\s*([A-Za-z])", "$1'$2")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def clean_bubble_text(text: Column) -> Column:
    """English bubble text: bars read as I, straight quotes, single spaces."""
    return F.regexp_replace(F.translate(strip(text), "|’“”", "I'\"\""), r"(?U)\s+", " ")


def ascii_dot(text: Column) -> Column:
    return F.replace(text, F.lit("．"), F.lit("."))


def ocr_key(text: Column) -> Column:
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), rf"{NOT_WORD}+", "")


def ocr_similar(key_a: Column, key_b: Column) -> Column:
    """Keys of ``ocr_key``: equal, or the shorter one is a long part of the longer one."""
    a_short = F.length(key_a) <= F.length(key_b)
    short, long_ = F.when(a_short, key_a).otherwise(key_b), F.when(a_short, key_b).otherwise(key_a)
    part = (F.length(short) >= 6) & F.contains(long_, short) & (F.length(short) / F.length(long_) >= 0.75)
    return (key_a != "") & (key_b != "") & ((key_a == key_b) | part)


@cache
def cjk_class() -> str:
    """Pattern of the characters whose Unicode name holds one of ``CJK_NAMES``; all lie below U+34000."""
    hits = [c for c in range(0x34000) if any(n in unicodedata.name(chr(c), "") for n in CJK_NAMES)]
    starts = [c for c, before in zip(hits, [-1, *hits]) if c != before + 1]
    ends = [c for c, after in zip(hits, [*hits[1:], -1]) if c != after - 1]
    return "[" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in zip(starts, ends)) + "]"


def contains_cjk(text: Column) -> Column:
    return text.rlike(cjk_class())


def vertical_tokens(text: Column) -> Column:
    """Characters of vertical text, pairs of marks like !? kept together."""
    return F.regexp_extract_all(F.replace(text, F.lit("\n"), F.lit("")), F.lit(VERTICAL_TOKEN), F.lit(0))


def writing_mode(text: Column, width: Column, height: Column, direction: Column, auto: Column, vertical_cjk: Column, override: Column) -> Column:
    """Vertical only for CJK text from a vertical source or, on auto, in a tall box."""
    cjk = contains_cjk(text)
    upright = F.lower(F.trim(F.coalesce(direction, F.lit("")))).startswith("vertical")
    one = F.lit(1).cast("long")
    tall = F.greatest(one, height) >= (F.greatest(one, width) * F.lit(1.1)).cast("long")
    pick = lambda ok: F.when(ok, "vertical_rl").otherwise("horizontal")
    chosen = F.lower(F.trim(F.coalesce(override, F.lit("inherit"))))
    return (
        F.when(chosen.isin("horizontal", "vertical_rl"), chosen)
        .when(chosen == "auto", pick(cjk & (upright | tall)))
        .otherwise(pick(vertical_cjk & cjk & (upright | (auto & tall))))
    )


def is_quota_error(message: Column) -> Column:
    return message.rlike("(?i)" + "|".join(QUOTA_MARKERS))
