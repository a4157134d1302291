"""Repeated tails of recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagestrata.functions.text import compact, strip

# Fixed values
MAX_UNIT = 12
MIN_REPEATS = 4
MIN_CHARS = 12


def _tail_length(dense: Column) -> Column:
    """Length of the longest tail made of one short unit repeated.

    A unit of the tail is a unit of the start of the reversed text, where one anchored expression per size finds it in one pass.
    """
    backwards = F.reverse(dense)

    def length(size: int) -> Column:
        more = max(MIN_REPEATS, -(-MIN_CHARS // size)) - 1
        return F.length(F.regexp_extract(backwards, rf"(?s)^(.{{{size}}})\1{{{more},}}", 0))

    return F.greatest(*(length(size) for size in range(1, MAX_UNIT + 1)))


def trim_repeated_suffix(text: Column) -> Column:
    """Struct of the text without its repeated tail and whether there was one; white space is ignored in the tail."""
    cleaned = strip(F.coalesce(text, F.lit("")))
    dense = compact(cleaned)
    tail = _tail_length(dense)
    filled = F.filter(F.transform(F.split(cleaned, ""), lambda c, i: F.struct(c.alias("c"), (i + 1).alias("at"))), lambda x: compact(x["c"]) != "")
    last = F.try_element_at(filled, F.length(dense) - tail)["at"]
    kept = F.when(tail == F.length(dense), "").otherwise(strip(F.substring(cleaned, F.lit(1), last)))
    return F.struct(F.when(tail > 0, kept).otherwise(cleaned).alias("text"), (tail > 0).alias("trimmed"))


def is_degenerate(text: Column, trimmed: Column) -> Column:
    """Too few different characters, or a repeated tail; ``trimmed`` is the struct above."""
    dense = compact(F.coalesce(text, F.lit("")))
    size = F.length(dense)
    unique = F.size(F.array_distinct(F.split(dense, "")))
    repeat = trimmed["trimmed"] & ((trimmed["text"] == "") | (size >= 18))
    return (strip(F.coalesce(text, F.lit(""))) != "") & (size >= MIN_CHARS) & (
        (unique <= 2) | repeat | ((size >= 24) & (unique / size < 0.18))
    )
