"""The folder that driver and executors share, and how small tables are dealt out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables below this size for each core are dealt out anew before costly work.
SPREAD_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a local folder only in local mode where that is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: a cluster needs a folder that its machines share")
        context.setCheckpointDir(named or "/tmp/checkpoints")
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared folder: what reads it starts there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is so small that few tasks would read it.

    A table of one row group is read by one task, however many cores there
    are.  Larger tables have splits enough and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * cores) if size < cores * SPREAD_BYTES else df


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file of the driver's, on any storage that Spark reads."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
