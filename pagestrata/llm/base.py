"""Small helpers the operators share: batches, row identity, staged tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagestrata.session import shared_folder

#: Rows of text that one Python worker holds at a time.
TEXT_BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bound the Arrow batches, so that a worker's memory follows the batch and not the partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_batches(df: DataFrame, per_batch: Callable[[dict], dict], schema: str, start: Callable[[], object] | None = None) -> DataFrame:
    """``per_batch`` turns the columns of one Arrow batch (as lists) into the columns of the result.

    With ``start``, it runs once per task and its value is the second argument.
    """
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def task(batches):
        extra = () if start is None else (start(),)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(per_batch(batch.to_pydict(), *extra), schema=arrow)

    return df.mapInArrow(task, schema)


def with_row(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and ``row_id``, which tells repeated rows apart.

    It follows a row's place in the scan: read the documents from files or from a staged table, so that a task that is
    run again numbers its rows the same way.
    """
    return docs.select(F.monotonically_increasing_id().alias("row_id"), *names)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``rank`` (from 0, by ``order`` inside ``keys``) and ``n_ranked`` (rows of the key); nulls come first.

    Rows are cut into ranges of (keys, order), numbered inside each range and shifted by the sizes of the earlier ones,
    so a key that holds most rows is spread over many tasks. Equal rows are parted by their place in the scan. ``df`` is
    read twice (ranges are found from a sample): pass a staged table.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, *order, "tie")
    ranged = stage(ranged.withColumn("part", F.spark_partition_id()), name)
    inside = Window.partitionBy("part", *keys).orderBy(*order, "tie")
    numbered = ranged.withColumn("inside", F.row_number().over(inside).cast("long"))
    sizes = ranged.groupBy("part", *keys).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("part", *keys, before.alias("before"), F.sum("n").over(whole).alias("n_ranked"))
    left, right = numbered.alias("l"), sizes.alias("r")
    same = F.col("l.part") == F.col("r.part")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same).select(
        *(F.col(f"l.{c}") for c in df.columns), (F.col("l.inside") + F.col("r.before") - 1).alias("rank"), F.col("r.n_ranked").alias("n_ranked")
    )
