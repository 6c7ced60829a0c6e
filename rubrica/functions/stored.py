"""Frames that are used several times: written once to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; on a single machine one is made if none is set."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="rubrica-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from the shared folder from then on."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders written by ``stored_columns``, by application.
_WRITTEN: dict[str, list[str]] = {}


def stored_columns(df: DataFrame) -> DataFrame:
    """As ``stored``, for wide rows of which later steps read a part: written as Parquet, so
    that columns are compressed and read one by one.  The files stay until ``clear_stored``."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark).rstrip('/')}/rubrica-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(folder)
    df.write.parquet(f"{folder}/stored")
    return spark.read.schema(df.schema).parquet(f"{folder}/stored")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder this program has written, wherever Spark keeps it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clear_stored(spark: SparkSession) -> int:
    """Remove what ``stored_columns`` has written in this application, once no frame over it is needed; how many folders."""
    folders = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        remove(spark, folder)
    return len(folders)
