"""Checks of the fact and counts for its overview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import flag, require_columns

ID_COLUMNS = ("store_id", "product_id")


def _is_negative(units: str) -> Column:
    return F.col(units) < 0


def _has_null(names: Sequence[str]) -> Column:
    condition = F.lit(False)
    for name in names:
        condition = condition | F.col(name).isNull()
    return condition


def _is_stockout(units: str, promo: str) -> Column:
    return (F.col(units) == 0) & ~flag(F.col(promo))


def negative_units(fact: DataFrame, units: str = "units") -> DataFrame:
    """Rows with units below zero."""
    require_columns(fact, [units], "fact")
    return fact.filter(_is_negative(units))


def null_ids(fact: DataFrame, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Rows in which at least one id is null."""
    require_columns(fact, ids, "fact")
    return fact.filter(_has_null(ids))


def stockout_candidates(
    fact: DataFrame, units: str = "units", promo: str = "on_promotion"
) -> DataFrame:
    """Rows with zero units and no promotion."""
    require_columns(fact, [units, promo], "fact")
    return fact.filter(_is_stockout(units, promo))


def missing_dates(
    fact: DataFrame, segment: Sequence[str] = ID_COLUMNS, date: str = "date"
) -> DataFrame:
    """Days without a row between the first and last day of each segment.

    The fact is reduced to distinct (segment, day) before it is ordered, so a
    segment has at most one row per calendar day in its window.
    """
    gaps = _gaps(fact, segment, date)
    between = F.sequence(F.date_add(date, 1), F.date_sub("_next", 1))
    return gaps.select(*segment, F.explode(between).alias(date))


def missing_date_counts(
    fact: DataFrame, segment: Sequence[str] = ID_COLUMNS, date: str = "date"
) -> DataFrame:
    """Number of such days per segment that has any, without listing them."""
    missing = F.datediff("_next", date).cast("long") - 1
    return _gaps(fact, segment, date).groupBy(*segment).agg(F.sum(missing).alias("n_missing"))


def _gaps(fact: DataFrame, segment: Sequence[str], date: str) -> DataFrame:
    """Days that are followed by a gap, with the day after the gap as ``_next``."""
    require_columns(fact, [*segment, date], "fact")
    days = fact.select(*segment, F.col(date).cast("date").alias(date)).dropna().distinct()
    following = F.lead(date).over(Window.partitionBy(*segment).orderBy(date))
    return days.withColumn("_next", following).filter(F.datediff("_next", date) > 1)


def validation_summary(
    fact: DataFrame,
    ids: Sequence[str] = ID_COLUMNS,
    units: str = "units",
    promo: str = "on_promotion",
    date: str = "date",
) -> DataFrame:
    """One row of counts: rows, negatives, null ids, stockout candidates, missing dates.

    The fact is read and shuffled once, summed to (ids, day) on the map side. Missing
    dates are counted without listing them: a segment's span in days less its number
    of distinct days.
    """
    require_columns(fact, [*ids, units, promo, date], "fact")
    daily = fact.groupBy(*ids, F.col(date).cast("date").alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(_is_negative(units)).alias("_negative"),
        F.count_if(_is_stockout(units, promo)).alias("_stockout"),
    )
    span = F.datediff(F.max("_day"), F.min("_day")) + 1 - F.count("_day")
    segments = daily.groupBy(*ids).agg(
        *[F.sum(name).alias(name) for name in ("_n", "_negative", "_stockout")],
        F.when(~_has_null(ids), F.coalesce(span, F.lit(0))).otherwise(0).alias("_gap"),
    )
    return segments.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("_negative"), F.lit(0)).alias("negative_units"),
        F.coalesce(F.sum(F.when(_has_null(ids), F.col("_n"))), F.lit(0)).alias("null_ids"),
        F.coalesce(F.sum("_stockout"), F.lit(0)).alias("stockout_candidates"),
        F.coalesce(F.sum("_gap"), F.lit(0)).alias("missing_dates"),
    )


def missing_profile(fact: DataFrame) -> DataFrame:
    """Null count and percentage of every column that has nulls, in one pass."""
    names = fact.columns
    counted = fact.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(name).isNull()).alias(name) for name in names],
    )
    return (
        counted.unpivot(["_rows"], names, "column_name", "missing_count")
        .filter(F.col("missing_count") > 0)
        .select(
            "column_name",
            "missing_count",
            F.round(F.lit(100.0) * F.col("missing_count") / F.col("_rows"), 2).alias("missing_pct"),
        )
    )


def key_counts(
    fact: DataFrame, store: str = "store_id", product: str = "product_id", date: str = "date"
) -> DataFrame:
    """One row: rows, columns, distinct stores, products and pairs, first and last date.

    The fact is reduced to (store, product) pairs first. Distinct counts over the
    raw rows would copy every row once per distinct count.
    """
    require_columns(fact, [store, product, date], "fact")
    pairs = fact.groupBy(store, product).agg(
        F.count(F.lit(1)).alias("_n"), F.min(date).alias("_first"), F.max(date).alias("_last")
    )
    return pairs.agg(
        F.sum("_n").alias("rows"),
        F.lit(len(fact.columns)).alias("columns"),
        F.countDistinct(store).alias("unique_stores"),
        F.countDistinct(product).alias("unique_products"),
        F.count(F.lit(1)).alias("unique_store_product_pairs"),
        F.min("_first").alias("first_date"),
        F.max("_last").alias("last_date"),
    )
