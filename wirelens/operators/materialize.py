"""Cut points of long jobs, kept in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a new one only in local mode where none is named.

    The session's settings stay as they are: a folder of this module's own is
    remembered for the application.
    """
    context = spark.sparkContext
    named = spark.conf.get(_SETTING, None) or context.getConf().get(_SETTING) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder every executor can reach")
        named = _own.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="wirelens-")
        _own[context.applicationId] = named
    return named


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read from there afterwards.

    A columnar table rather than a checkpoint of rows: each later step reads only
    the columns it needs. Losing an executor costs a re-read, nothing more.
    """
    path = new_path(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote and no longer reads, in whatever store it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
