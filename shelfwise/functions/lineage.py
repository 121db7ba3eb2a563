"""Shared scratch folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach: the session's setting or the context's checkpoint folder.

    Only a session whose master is local gets a temporary folder when neither is set; on a cluster
    each executor would write to its own disk, so that raises.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="shelfwise-")
    return _local_folders[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    """New path under the shared folder, deleted when the application ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop_path, file_system = _on_file_system(spark, path)
    file_system.deleteOnExit(hadoop_path)
    return path


def pin(df: DataFrame, name: str = "pinned") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a driver-side fit runs many jobs over one small frame, and between the phases of
    iterative operators; the written table survives the loss of executors.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame that ``pin`` returned, once nothing reads it any more."""
    spark = df.sparkSession
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    root = shared_folder(spark).rstrip("/").removeprefix("file:").lstrip("/")
    for folder in folders:
        if root in folder:
            path, file_system = _on_file_system(spark, folder)
            file_system.delete(path, True)


def _on_file_system(spark: SparkSession, path: str):
    """Hadoop path and the file system that holds it."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
