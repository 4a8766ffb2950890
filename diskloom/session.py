"""Session helpers: table reading, checkpoint folder, durable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, name: str = "diskloom") -> SparkSession:
    """A local session for tests and benches; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("DISKLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per context, so clusters need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_diskloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="diskloom-")) / "diskloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._diskloom_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a snapshot folder."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint.

    The folder is the cluster's ``spark.checkpoint.dir``; only where that is
    unset (local runs and tests) a folder of our own is used.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share, set where it is unset and the master is local."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="diskloom-checkpoint-"))
    return context.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all slots of the session where its files give fewer slices than that."""
    spark = df.sparkSession
    return df if df.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism else df.repartition(parallelism(spark))


def small(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``df``, to be broadcast if it has at most ``most`` rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= most else df


def parallelism(spark: SparkSession) -> int:
    """Shuffle width of the session, the number of slices heavy Python stages are spread over."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
