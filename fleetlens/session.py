"""Session settings the operators rely on, and the folder for what they store."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes reduce tasks from the real shuffle sizes and splits skewed joins; the
# initial count only has to be high enough for the largest shuffle.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and benches on one machine; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fleetlens")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "8g")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables, which all executors can reach.

    A cluster names it in ``spark.checkpoint.dir``. Only where no folder is set and all runs in one
    process, as in local tests, a new temporary one is made and set for the rest of the session.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fleetlens-", dir="/tmp"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Run ``df`` once, write it below the shared folder, and read it back.

    For input that is costly to compute and that a plan reads several times: each later read takes
    only the columns it needs from the stored table, and a lost executor does not cost the
    computation again. The table stays until :func:`clear_stored`.
    """
    spark = df.sparkSession
    path = f"{_stored_folder(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stored_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stored/{spark.sparkContext.applicationId}"


def clear_stored(spark: SparkSession) -> None:
    """Delete the tables that this application stored; results that read them cannot be read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_stored_folder(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def task_count(spark: SparkSession, per_core: int = 4) -> int:
    """Tasks for work that is large per row, such as opening files.

    Such rows are small, so adaptive execution would put all of them into one task; it leaves a
    repartition with a number as it is.
    """
    return spark.sparkContext.defaultParallelism * per_core
