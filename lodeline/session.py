"""Session settings and table access shared by every module."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit both one machine and a cluster; sizes are left to the deployer.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session on one machine, for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lodeline")
    settings = SETTINGS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.driver.host": "127.0.0.1",
    }
    for key, value in (settings | extra).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; the driver and all executors share it.

    Where it is unset a folder here will do if the session is local, as in tests;
    on a cluster that is a ValueError, since executors couldn't read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with checkpoint() in the shared folder, from which any executor can read it again."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new path in the shared folder, deleted in the end, in whatever store it lies; what is kept must have been materialised by then."""
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Rows and bytes of whole texts in an Arrow batch: what a Python worker holds at once doesn't grow with the table.
BATCH_ROWS, BATCH_BYTES = 500, 1 << 24


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes per Arrow batch where they are higher or unbounded."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(key).lower()
        if not held.rstrip("b").isdigit() or not 0 < int(held.rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table in fewer files than there are cores, dealt over all cores; others as they are, so that large tables aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df
