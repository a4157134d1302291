"""Two-pass external shuffle into equal shards.

Pass 1 scatters the records to buckets by a seeded hash of their row, so that each bucket fits into a task's memory
whatever keys repeat. Pass 2 shuffles each bucket by Fisher-Yates and writes it. A record's number in the whole
order is the size of the earlier buckets plus its place in its own; its shard is that number modulo the number of shards
and its slot the quotient. Shard sizes differ by one row at most, and slots have no gaps.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, LongType

from pagestrata.llm import base

BUCKET_BYTES = 16 << 20
SEED = 20_240_917
#: Offsets are sent to every task only up to this many buckets (16 MB).
SENT_BUCKETS = 1_000_000


def scattered(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """All columns of ``docs`` in a struct ``record``, in shuffled order inside ``bucket``: (bucket, place, record)."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    buckets = int(total // bucket_bytes) + 1
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.struct(*docs.columns).alias("record"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "row_id"), F.lit(buckets)))
    schema = StructType([StructField("bucket", LongType()), StructField("place", LongType()), rows.schema["record"]])

    def shuffled(part: pa.Table) -> pa.Table:
        """Rows come in any order from the exchange: sort by row, then swap from the end on (numpy's shuffle)."""
        part = part.take(pa.array(np.argsort(part.column("row_id").to_numpy())))
        order = np.arange(part.num_rows)
        np.random.default_rng([seed, part.column("bucket")[0].as_py()]).shuffle(order)
        part = part.take(pa.array(order))
        return pa.table([part.column("bucket"), pa.array(np.arange(part.num_rows)), part.column("record")], names=["bucket", "place", "record"])

    return rows.groupBy("bucket").applyInArrow(shuffled, schema)


def shards(docs: DataFrame, count: int = 16, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``docs`` in shuffled order, written bucket by bucket: record (struct of all columns), bucket, place, shard, slot.

    Null texts and ids, repeated rows and extra columns are carried as they are; equal rows are separate records. An
    empty table gives no rows. The same rows in the same files give the same shards for a seed.
    """
    written = base.stage(scattered(docs, bucket_bytes, seed), "buckets")
    buckets = (written.agg(F.max("bucket")).first()[0] or 0) + 1
    sizes = written.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("before"))
    if buckets <= SENT_BUCKETS:  # else both sides meet in an exchange
        sizes = F.broadcast(sizes)
    number = F.col("before") + F.col("place")
    return written.join(sizes, "bucket").select(
        "record", "bucket", "place", F.pmod(number, F.lit(count)).cast("int").alias("shard"),
        F.floor(number / count).cast("long").alias("slot"),
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """Shard folders ``shard=k`` under ``path``; slots order the records of a shard, over files in the order of their names.

    Ranges of (shard, slot) are dealt to as many tasks as there are shuffle partitions. Columns of the records that are called shard or slot
    are written as record_shard and record_slot.
    """
    names = sharded.schema["record"].dataType.names
    fields = (F.col(f"record.`{n}`").alias(f"record_{n}" if n in ("shard", "slot") else n) for n in names)
    parts = int(sharded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sharded.select("shard", "slot", *fields).repartitionByRange(parts, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(sharded: DataFrame) -> DataFrame:
    """Columns of the contract: sizes, checksums and places under the law of equal rows."""
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return sharded.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
