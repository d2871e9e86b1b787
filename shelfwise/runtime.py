"""Session defaults and the shared work folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def session(app: str = "shelfwise", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; cluster settings win where given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        # Extraction costs far more per byte than a usual query: small partitions are worth keeping.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@functools.cache
def _local_root() -> str:
    """For sessions that run on this machine alone; it goes when the process ends."""
    folder = tempfile.mkdtemp(prefix="shelfwise-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def work_root(spark: SparkSession) -> str:
    """The folder for all intermediates of this application, under the shared folder named by the cluster.

    A machine-local folder is used only when the whole session runs on this machine.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder all executors can reach")
        root = _local_root()
    return f"{root.rstrip('/')}/shelfwise-{spark.sparkContext.applicationId}"


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one intermediate."""
    return f"{work_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Delete all intermediates of this application. Results that have not been written elsewhere cannot be read
    after it, so it is the owner of the application who calls it, at its end."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate once and read it back, so that its readers share one computation."""
    spark = df.sparkSession
    path = work_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scanned: DataFrame) -> DataFrame:
    """Give every core a share of a scan that has fewer partitions than there are cores.

    For rules that cost much per row on a small table. A table of many files or row groups is
    returned as it is, without a shuffle.
    """
    cores = scanned.sparkSession.sparkContext.defaultParallelism
    return scanned if scanned.rdd.getNumPartitions() >= cores else scanned.repartition(cores)
