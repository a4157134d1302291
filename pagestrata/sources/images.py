"""Page images from a folder tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagestrata.operators.ranking import distinct_names

# Fixed values
IMAGE_SUFFIX = r"(?i)\.(jpg|jpeg|png|webp)$"


def scan_page_images(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """Image files below a folder, with import names made unique."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    files = files.where(F.col("path").rlike(IMAGE_SUFFIX)).withColumn("name", F.substring_index("path", "/", -1))
    picked = ["path", "name", "length", "modificationTime"] + (["content"] if content else [])
    return import_names(files.select(*picked), "name", "path")


def import_names(files: DataFrame, name: str, order: str) -> DataFrame:
    """Equal file names get _1, _2 and so on before the suffix, past names that other files hold."""
    return distinct_names(files, name, order, into="import_name")


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height from a PNG header, zero when the content is too short."""
    def number(at: int) -> Column:
        part = F.hex(F.substring(content, at, 4))
        return F.when(F.length(content) >= 24, F.conv(part, 16, 10).cast("long")).otherwise(F.lit(0).cast("long"))

    return number(17), number(21)
