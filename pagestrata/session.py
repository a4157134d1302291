"""Session settings and the checkpoint folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pagestrata")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see, from ``spark.checkpoint.dir``.

    A local master without the setting gets a temporary folder; a cluster
    without it is an error, because a lost executor would lose the data.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="pagestrata-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df):
    """Reliable checkpoint in the shared folder; survives executor loss.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` its files go when no frame refers to them any more.
    """
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Give back the shuffle files of plans that nothing refers to; Spark's cleaner learns of them when the driver collects garbage."""
    context = spark.sparkContext
    try:  # listeners hold the last plan until they have heard of its end
        context._jsc.sc().listenerBus().waitUntilEmpty(2_000)
    except Py4JError:
        pass
    context._jvm.System.gc()


def written(df: DataFrame, name: str, *by: str) -> str:
    """Path in the shared folder to which the rows are written, parted by the columns ``by``; goes when the driver ends.

    Other than a checkpoint it keeps the columns as compressed files, so later filters on ``by`` read only their part, and the plan
    that wrote them can be forgotten: shuffle files of finished steps are given back before the next step makes its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    release(spark)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def forget(spark: SparkSession, *paths: str) -> None:
    """Delete what was ``written`` before the driver ends."""
    for path in map(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, paths):
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def saved(df: DataFrame, name: str, *by: str) -> DataFrame:
    """The rows, ``written`` and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name, *by)).select(df.columns)
