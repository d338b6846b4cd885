"""Tables written down on the way, so that several branches read the same rows and a lost executor costs no whole lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables written down are broadcast up to this many rows.
BROADCAST_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own where it is unset in local mode, as in tests."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="cadenza-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """Written as Parquet in the shared folder: large tables, of which each reader takes the columns it needs; removed when the driver ends."""
    path = f"{shared_dir(df.sparkSession)}/cadenza-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may have ended before this
        return


def small(df: DataFrame) -> DataFrame:
    """A table that is written down, with a hint to broadcast it if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
