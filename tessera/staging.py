"""Results written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .errors import StoreError

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset, a folder of this machine, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise StoreError("set spark.checkpoint.dir to a folder that driver and executors share", master=spark.sparkContext.master)
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back.

    Cuts lineage in a way that outlives lost executors, and computes df once where
    ``checkpoint()`` would compute it twice. All of a session lies in one folder, see ``release``.
    """
    spark = df.sparkSession
    path = f"{_session_dir(spark)}/{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")  # a finished write needs its shuffle files no more
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove what ``staged`` wrote for these frames; nothing that is still to run may read them."""
    for df in frames:
        if path := getattr(df, "staged_path", None):
            remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Remove all that this session staged. Its frames can't be read afterwards."""
    remove(spark, _session_dir(spark))


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
