"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; a temporary one only for local runs without any."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
        return configured
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lumenreel-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the checkpoint folder and go on from there, with its lineage cut.

    Unlike a checkpoint, what is read again has the size of its files as its statistics; the estimate of the plan
    that was cut would multiply with every round of a loop. ``instead_of`` is an earlier result of this function
    that nothing needs any longer; its files are deleted.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    found = spark.read.schema(df.schema).parquet(folder)
    found._written_to = folder
    if instead_of is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(instead_of._written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return found


def spread(df: DataFrame) -> DataFrame:
    """Give every core work when the input comes in fewer pieces than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def tasks_for(df: DataFrame) -> int:
    """Tasks for work on a stored table: several a core, and more of them the larger the table."""
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, 4 * df.rdd.getNumPartitions())


def dealt(df: DataFrame) -> DataFrame:
    """The rows of a stored table in equal shares.

    How many pieces a file is cut into doesn't say where its rows are: a Parquet row group is read by one of them.
    """
    return df.repartition(tasks_for(df))
