"""Shared scratch tables that cut the lineage of multi-step jobs.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, so that a lost
executor only costs a re-read. A private folder is made for a local session alone.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder visible to every executor, as configured for the session."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if configured:
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = sc.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="topicloom-")
    return _LOCAL_DIRS[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one scratch table of this application."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/topicloom-{app}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and continue from the written table.

    The written size is known to Catalyst, so later joins broadcast the table only where it
    is below ``spark.sql.autoBroadcastJoinThreshold``; nothing needs a hint.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Delete the scratch tables of this application, once no result reads them any more."""
    app = spark.sparkContext.applicationId
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/topicloom-{app}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path) and fs.delete(path, True)
