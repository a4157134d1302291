"""Positions inside a key that hold when one key owns most of the rows.

A plain ``row_number`` over the key sorts the whole key in one task. Here the key
is cut into order-preserving buckets: rows are numbered inside (key, bucket) and
shifted by the sizes of the earlier buckets, which are counted with a partial
aggregate, so the hot key spreads over as many tasks as it has buckets. The shift
of a bucket travels as one more row of it, so the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagestrata.functions.paths import stem, suffix
from pagestrata.session import cut_lineage

# Fixed values
MISSING_ORDER = 10**9
BAND_PX = 64
ORDER_BAND = 1024


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    buckets: Sequence[Column],
    name: str = "position",
) -> DataFrame:
    """Add the 0-based position of each row in its key.

    ``buckets`` must rise with ``order``: comparing two rows by the buckets never
    contradicts comparing them by the order columns.
    """
    bucket_names = [f"__b{i}" for i in range(len(buckets))]
    tagged = df.select("*", *(b.alias(n) for b, n in zip(buckets, bucket_names)))
    earlier = (
        Window.partitionBy(*keys).orderBy(*bucket_names).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        tagged.groupBy(*keys, *bucket_names)
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", F.sum("__n").over(earlier))
        .where(F.col("__before").isNotNull()).drop("__n")
    )
    rows = tagged.withColumn("__before", F.lit(None).cast("long")).unionByName(offsets, allowMissingColumns=True)
    # a bucket's offset comes first in it; windows take missing keys and buckets as equal
    inside = Window.partitionBy(*keys, *bucket_names).orderBy(F.col("__before").isNull(), *order)
    numbered = rows.withColumns({"__local": F.row_number().over(inside).cast("long"), "__shift": F.max("__before").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    first = F.when(F.col("__shift").isNull(), F.lit(-1)).otherwise(F.col("__shift") - 2)
    return numbered.where(F.col("__before").isNull()).select(*df.columns, (F.col("__local") + first).cast("long").alias(name))


def reading_key(reading_order: Column) -> Column:
    return F.coalesce(reading_order.cast("long"), F.lit(MISSING_ORDER).cast("long"))


def page_order(reading_order: Column, y1: Column, x1: Column, tie: Column) -> list[Column]:
    """Reading order first (missing last), then top, left and input position."""
    return [reading_key(reading_order), y1, x1, tie]


def page_buckets(reading_order: Column, y1: Column) -> list[Column]:
    """Bands of filled reading orders, bands of the page where they are missing."""
    key = reading_key(reading_order)
    return [F.floor(key / ORDER_BAND), F.when(key == MISSING_ORDER, F.floor(y1 / BAND_PX)).otherwise(0)]


def with_page_position(
    df: DataFrame, keys: Sequence[str], reading_order: Column, y1: Column, x1: Column, tie: Column,
    name: str = "position",
) -> DataFrame:
    return with_position(
        df, keys, page_order(reading_order, y1, x1, tie), page_buckets(reading_order, y1), name
    )


def number_band(c: Column, width: int = 1024) -> list[Column]:
    """Bucket for an order that starts with a whole number."""
    return [F.floor(c / width)]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order``; combines map-side, needs no sort of the key."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("__row")
    )
    return picked.select(*keys, *(F.col(f"__row.{c}").alias(c) for c in rest)).select(*df.columns)


def distinct_names(df: DataFrame, name: str, order: str, digits: int = 1, keys: Sequence[str] = (), into: str = "unique_name") -> DataFrame:
    """Adds ``into``: the first row of a name keeps it, the others get the free numbers from 1 before the suffix.

    A number is free if no row of the keys has the name it gives. Names with other stems cannot give the same name, so
    one pass over the names settles all: a later row's number is its place among the later rows and the taken numbers
    of its name. Rows are cut into ranges of (name, order), which spreads a name that many rows share. Null names stay.
    """
    keys = list(keys)
    ranged = cut_lineage(df.repartitionByRange(*keys, name, order).withColumn("__range", F.spark_partition_id()))
    placed = cut_lineage(with_position(ranged, [*keys, name], [F.col(order)], [F.col("__range")], "__n"))
    firsts = placed.where((F.col("__n") == 0) & F.col(name).isNotNull()).select(*keys, name)
    repeated = placed.where("__n = 1").select(*keys, name)
    number = F.regexp_extract(stem(F.col(name)), r"_([1-9][0-9]{0,17}|0[0-9]*[1-9][0-9]*)$", 1)
    taken = firsts.select(*keys, F.col(name).alias("__taken"), number.alias("__digits")).where("__digits <> ''")
    value = F.col("__digits").cast("long")
    written = F.lpad(value.cast("string"), F.greatest(F.lit(digits), F.length(value.cast("string"))), F.lit("0")) == F.col("__digits")
    base = F.concat(F.expr("substr(__taken, 1, length(__taken) - length(__digits) - length(__x) - 1)"), "__x")
    taken = taken.withColumn("__x", suffix(F.col("__taken"))).where(F.coalesce(written, F.lit(False))).select(
        *keys, base.alias(name), value.alias("__v")).join(repeated, [*keys, name], "left_semi")
    # the i-th taken number b leaves b - i free ones before it
    rank = with_position(taken, [*keys, name], [F.col("__v")], number_band(F.col("__v")), "__i")
    marks = rank.select(*keys, name, (F.col("__v") - F.col("__i") - 1).alias("__at"), F.lit(1).alias("__kind"), F.col("__v").alias("__tie"))
    later = placed.where(F.col("__n") > 0).select(*keys, name, F.col("__n").alias("__at"), F.lit(0).alias("__kind"), F.col("__n").alias("__tie"))
    both = with_position(later.unionByName(marks), [*keys, name], [F.col("__at"), F.col("__kind"), F.col("__tie")], number_band(F.col("__at")), "__p")
    found = both.where("__kind = 0").select(*keys, name, F.col("__at").alias("__n"), (F.col("__p") + 1).cast("string").alias("__number"))
    on = None
    left, right = placed.alias("l"), found.alias("r")
    for k in [*keys, name, "__n"]:
        term = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        on = term if on is None else on & term
    given = F.lpad(F.col("r.__number"), F.greatest(F.lit(digits), F.length("r.__number")), F.lit("0"))
    own = F.col(f"l.{name}")
    return left.join(right, on, "left").select(
        *(F.col(f"l.{c}") for c in df.columns), F.coalesce(F.concat(stem(own), F.lit("_"), given, suffix(own)), own).alias(into))
