"""The folder that driver and executors share, and tables in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a temporary folder serves,
    but only for a local master; a cluster without the setting is an error, since its machines share no other folder."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured and sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="watchfire-checkpoint-")
    if configured and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def new_path(spark: SparkSession, stem: str = "watchfire") -> str:
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, which may have wildcards, is there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def temporary(spark: SparkSession, path: str) -> str:
    """path, which is there, and is deleted when the session's driver ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that nothing reads any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once: nothing is computed twice, and a lost executor
    costs no recomputation. It goes when the driver ends."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    temporary(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
