"""Exact ranks, quantiles, suffix minima and positions without a one-task sort.

A window that orders a whole column, or a column inside a group that may hold a
third of all rows, runs in one task. The functions here first count equal values
(partial aggregation does that on the map side) and write that table once. Then one
exchange by range of (keys, value) deals the distinct values to ordered ranges of
about equal size, whatever their distribution; the running work is done inside
(key, range), and the totals of the ranges before, a prefix sum over one row per key
and range, are added. Tables of few rows stay one range.

Not-a-number comes after all other values and infinities at the ends, as Spark orders
them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.lineage import pin

RANGE = "_range"
ROWS_IN_ONE_RANGE = 1 << 16
HASH_BUCKETS = 4096


def with_ranges(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows``, written once, with the number of the range of (keys, value) each lies in.

    Range numbers rise with (keys, value) and equal values share a range. A table that
    has its ranges already keeps them.
    """
    if RANGE in rows.columns:
        return rows
    stored = pin(rows.withColumn(RANGE, F.lit(0)), "ordered")
    if stored.count() <= ROWS_IN_ONE_RANGE:
        return stored
    # The number is written with the row, so a second draw of the range bounds cannot disagree.
    return pin(stored.repartitionByRange(*keys, value).withColumn(RANGE, F.spark_partition_id()), "ranges")


def running_counts(
    histogram: DataFrame, keys: Sequence[str], value: str, weight: str, keep_ranges: bool = False
) -> DataFrame:
    """Add ``n_below``, ``n_through`` and ``n_total`` to one row per (keys, value).

    ``keep_ranges`` leaves the ranges in, for more work in the same order.
    """
    ranged = with_ranges(histogram, keys, value)
    totals = ranged.groupBy(*keys, RANGE).agg(F.sum(weight).alias("_in_range"))
    per_key = Window.partitionBy(*keys)
    through = F.sum("_in_range").over(per_key.orderBy(RANGE))
    offsets = totals.select(
        *keys,
        RANGE,
        (through - F.col("_in_range")).alias("_before"),
        F.sum("_in_range").over(per_key).alias("n_total"),
    )
    inside = Window.partitionBy(*keys, RANGE).orderBy(value)
    counted = (
        ranged.withColumn("_running", F.sum(weight).over(inside))
        .join(offsets, [*keys, RANGE])
        .withColumn("n_through", F.col("_before") + F.col("_running"))
        .withColumn("n_below", F.col("n_through") - F.col(weight))
        .drop("_before", "_running")
    )
    return counted if keep_ranges else counted.drop(RANGE)


def value_histogram(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Rows per (keys, value) as ``n``; rows with a null key or value are left out."""
    kept = df
    for name in [*keys, value]:
        kept = kept.filter(F.col(name).isNotNull())
    more = [column.alias(name) for name, column in (extra or {}).items()]
    return kept.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), *more)


def quantiles_of(
    counts: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles from the output of :func:`running_counts`."""
    aggregates: list[Column] = [F.max("n_total").alias("_n")]
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("n_total") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (F.col("n_below") <= rank) & (rank < F.col("n_through"))
            aggregates.append(
                F.max(F.when(here, F.col(value))).alias(f"_{name}_{side}")
            )
    more = [column.alias(name) for name, column in (extra or {}).items()]
    picked = counts.groupBy(*keys).agg(*aggregates, *more)
    columns: list[Column] = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        between = low + (high - low) * (place - F.floor(place))
        # Equal ends may be infinite; their difference is no number.
        columns.append(F.when(low == high, low).otherwise(between).alias(name))
    return picked.select(*keys, *columns, *(extra or {}))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probabilities: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles of ``value`` per key, interpolated like ``numpy.quantile``."""
    counts = running_counts(value_histogram(df, keys, value), keys, value, "n")
    return quantiles_of(counts, keys, value, probabilities)


def suffix_minimum(
    df: DataFrame, keys: Sequence[str], order: str, measure: str, out: str
) -> DataFrame:
    """Smallest ``measure`` at or after each row's ``order`` value, per key.

    Rows with equal ``order`` see each other. The windows run from the highest value
    down, so every frame grows by one row at a time.
    """
    ranged = with_ranges(df, keys, order)
    lows = ranged.groupBy(*keys, RANGE).agg(F.min(measure).alias("_low"))
    later = Window.partitionBy(*keys).orderBy(F.desc(RANGE))
    beyond = lows.select(
        *keys,
        RANGE,
        F.min("_low").over(later.rowsBetween(Window.unboundedPreceding, -1)).alias("_later"),
    )
    inside = (
        Window.partitionBy(*keys, RANGE)
        .orderBy(F.desc(order))
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        ranged.withColumn("_here", F.min(measure).over(inside))
        .join(beyond, [*keys, RANGE])
        .withColumn(out, F.least("_here", "_later"))
        .drop(RANGE, "_here", "_later")
    )


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    out: str,
    width: int = 1 << 16,
) -> DataFrame:
    """Zero-based position by a column that is unique within each key.

    Positions follow a numeric column; its buckets hold at most ``width`` rows, because
    the column is unique. Positions of another type follow a hash of it first, which
    spreads any ids evenly.
    """
    if isinstance(df.schema[order].dataType, T.NumericType):
        bucket = F.floor(F.col(order) / F.lit(width))
    else:
        bucket = F.pmod(F.xxhash64(order), F.lit(HASH_BUCKETS))
    bucketed = df.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    running = F.sum("_size").over(Window.partitionBy(*keys).orderBy("_bucket"))
    offsets = sizes.select(*keys, "_bucket", (running - F.col("_size")).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order)
    return (
        bucketed.withColumn("_place", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_bucket"])
        .withColumn(out, F.col("_before") + F.col("_place"))
        .drop("_bucket", "_before", "_place")
    )
