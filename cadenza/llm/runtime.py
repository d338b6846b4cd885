"""Lineage cuts and small helpers that all operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once an application, so that their Python can import it wherever it lies."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        at = Path(tempfile.mkdtemp(prefix="cadenza-")) / "cadenza_package.zip"
        with zipfile.ZipFile(at, "w") as z:
            for f in sorted(PACKAGE.rglob("*.py")):
                z.write(f, f.relative_to(PACKAGE.parent))
        spark.sparkContext.addPyFile(str(at))


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own where it is unset in local mode, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="cadenza-")
        spark.sparkContext.setCheckpointDir(at)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: small tables that several branches read."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    sweep(df.sparkSession)
    return out


def table(df: DataFrame) -> DataFrame:
    """Write as Parquet in the shared folder and read again; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cadenza-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    sweep(spark)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Shuffle files go when the driver's JVM collects the plans that wrote them; a cut is the moment they are done with."""
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the JVM may have ended before this
        return


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function from one batch to batches."""

    ship(df.sparkSession)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from fn(b)

    return df.mapInArrow(run, schema)


def batch(names: list[str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with so many underscores before it that no column's name begins like it."""
    taken = [c.lower() for c in df.columns]
    while any(c.startswith(name.lower()) for c in taken):
        name = f"_{name}"
    return name


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    """Equality of key columns that holds for nulls as well."""
    cond = F.lit(True)
    for n in names:
        cond = cond & a[n].eqNullSafe(b[n])
    return cond
