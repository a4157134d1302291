"""Parts of a file path as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r".\.[^.]+$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def suffix(path: Column) -> Column:
    return F.regexp_extract(F.substring_index(path, "/", -1), r".(\.[^.]+)$", 1)
