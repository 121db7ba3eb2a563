"""The store-day table, and the segment-day tables made of it, kept up to date from a stream of sales.

Sales arrive in any order. A stateful aggregate sums them to (store, day, promotion flag), the same
rows as ``segment_day.store_day_sums`` makes in a batch; partial sums are taken before the state.
Each micro-batch gives the sums it changed, whole, and a merge replaces just those rows in a table with
one folder per month. Sums are whole and not increments, so a batch that is written twice after a failure
does no harm.

Late data. A day is kept in the state until the latest day seen is more than ``delay`` after it; sales
that come later than that are not added, and ``late_rows`` tells how many there were.

The state holds every kept (store, day, flag), so it is as large as the table. It lies in RocksDB on the
disks of the executors, with a bounded cache, and not in their heaps.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfwise.functions.lineage import discard, pin
from shelfwise.operators.enrich import canonical_sales
from shelfwise.sources.raw import path_exists
from shelfwise.sources.sinks import replace_months

KEYS = ["store_id", "date", "on_promotion"]
DELAY = "28 days"

# Where the state lies and what its caches may take on one executor.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def store_day_stream(sales: DataFrame, delay: str = DELAY) -> DataFrame:
    """Changed rows (store_id, date, on_promotion, units, n_sales) of a stream of raw sales.

    Rows without a day are left out, as in the batch.
    """
    timed = canonical_sales(sales).filter(F.col("date").isNotNull()).withColumn("_day", F.to_timestamp("date"))
    sums = (
        timed.withWatermark("_day", delay)
        .groupBy("store_id", "_day", "on_promotion")
        .agg(F.sum("units").alias("units"), F.count("units").alias("n_sales"), F.count(F.lit(1)).alias("n_rows"))
    )
    return sums.select("store_id", F.to_date("_day").alias("date"), "on_promotion", "units", "n_sales", "n_rows")


def merge_into(path: str):
    """A ``foreachBatch`` function that replaces the changed rows of the table at ``path``.

    Only the months of changed rows are read and written.
    """

    def merge(changed: DataFrame, batch: int) -> None:
        spark = changed.sparkSession
        changed = pin(changed.withColumn("year_month", F.date_format("date", "yyyy-MM")), "changed")
        whole = changed
        if path_exists(spark, path):
            months = [r.year_month for r in changed.select("year_month").distinct().collect()]
            old = spark.read.schema(changed.schema).parquet(path).filter(F.col("year_month").isin(months))
            same = [old[k].eqNullSafe(changed[k]) for k in KEYS]
            kept = old.join(changed, same[0] & same[1] & same[2], "left_anti")
            # A table cannot be written over while it is read.
            whole = pin(kept.unionByName(changed), "merged")
        replace_months(whole, path)
        if whole is not changed:
            discard(whole)
        discard(changed)

    return merge


@contextmanager
def _settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def start(
    sales: DataFrame, path: str, checkpoint: str, delay: str = DELAY, partitions: int | None = None
) -> StreamingQuery:
    """Read what is there, in as many micro-batches as the source makes, merge it and stop.

    A checkpoint keeps the number of partitions its first run had, by default as many as shuffle
    partitions; it should follow the size of the table that is to be kept.
    """
    stream = (
        store_day_stream(sales, delay)
        .writeStream.outputMode("update")
        .foreachBatch(merge_into(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    more = {} if partitions is None else {"spark.sql.shuffle.partitions": str(partitions)}
    # The query copies the session's settings when it starts.
    with _settings(sales.sparkSession, STATE_SETTINGS | more):
        return stream.start()


def late_rows(query: StreamingQuery) -> int:
    """Partial sums that came too late and were not added, over the kept progress reports."""
    return sum(
        state["numRowsDroppedByWatermark"] for report in query.recentProgress for state in report["stateOperators"]
    )


def tables_of(spark: SparkSession, path: str, tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """``tables`` with the merged table as ``store_days``, which the segment-day plans then read."""
    return {**tables, "store_days": spark.read.parquet(path)}
