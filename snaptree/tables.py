"""Intermediate tables in the folder that driver and executors share."""
from __future__ import annotations

import functools
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

_local = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; only a local session may be without that setting."""
    context = spark.sparkContext
    base = context.getCheckpointDir()
    if base is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            base = "file://" + tempfile.mkdtemp(prefix="snaptree-")
        context.setCheckpointDir(base)
        base = context.getCheckpointDir()
    return f"{base}/{uuid.uuid4().hex}"


def saved(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows of df from a table in the shared folder: cuts the lineage and outlives lost executors.

    by: a column by whose values the table is parted, so that a filter on it reads only its own files.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    if scopes := _scopes():
        scopes[-1].append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _scopes() -> list:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def cleaned(f):
    """f, whose result (one DataFrame) is written as a table; all other tables that it wrote are removed, also if it fails.

    The result's own table goes with the folder, or with the caller if that is cleaned too.
    """

    @functools.wraps(f)
    def run(*args, **kw):
        scopes = _scopes()
        own: list[str] = []
        scopes.append(own)
        keep = None
        try:
            out = saved(f(*args, **kw))
            keep = own.pop()
            if len(scopes) > 1:
                scopes[-2].append(keep)
            return out
        finally:
            scopes.pop()
            if own:
                spark = SparkSession.getActiveSession()
                for path in own:
                    remove(spark, path)

    return run
