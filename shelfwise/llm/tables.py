"""Given tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Take rows to Python in batches of 8 MB, not 64.

    Documents are large rows; a batch is held several times over by the executor and its workers.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
