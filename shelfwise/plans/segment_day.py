"""Segment-day tables straight from the raw tables, without building the fact.

Nothing in these tables needs the product, and holiday, oil and traffic are the same
for all sales of a store and day. So the sales are first summed to (store, day,
promotion flag), with partial sums on the map side, and only those rows are joined
with the small tables. A hot store or day costs no more than any other, and no join
sees a raw sale.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import flag, share
from shelfwise.functions.joins import attach, attach_daily, deal
from shelfwise.operators.enrich import (
    canonical_sales,
    daily_signals,
    holiday_daily,
    store_clusters,
    store_traffic,
)


def store_day_sums(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Units and numbers of sales per store, day and promotion flag.

    A table ``store_days`` of these rows, as ``shelfwise.streaming`` keeps it, takes the place of the sales.
    """
    if "store_days" in tables:
        return tables["store_days"].select("store_id", "date", "on_promotion", "units", "n_sales")
    sales = canonical_sales(tables["sales"]).filter(F.col("date").isNotNull())
    return sales.groupBy("store_id", "date", "on_promotion").agg(
        F.sum("units").alias("units"), F.count("units").alias("n_sales")
    )


def store_day_promo(tables: Mapping[str, DataFrame], counted_only: bool = True) -> DataFrame:
    """Units and number of sales per store, day and promotion flag, with the cluster.

    Sales without units count for nothing but, unless ``counted_only``, for the day's flags.
    """
    sums = store_day_sums(tables)
    if counted_only:
        sums = sums.filter(F.col("n_sales") > 0)
    joined = attach(sums, store_clusters(tables["stores"]), ["store_id"])
    return joined.filter(F.col("cluster").isNotNull())


def segment_daily_base(tables: Mapping[str, DataFrame], partitions: int | None = None) -> DataFrame:
    """Same result as :func:`shelfwise.operators.features.segment_daily_base` on the fact.

    With ``partitions``, the store days are joined with their traffic in that many.
    """
    store_days = deal(store_day_promo(tables), partitions, "store_id", "date")
    rows = attach(store_days, store_traffic(tables["transactions"]), ["store_id", "date"])
    n, traffic = F.col("n_sales"), F.col("store_transactions")
    sums = rows.groupBy("cluster", "date").agg(
        F.sum("units").alias("units"),
        F.sum(n).alias("_n"),
        F.sum(F.when(F.col("on_promotion"), n)).alias("_promo"),
        F.sum(n * traffic).alias("_traffic"),
        F.sum(F.when(traffic.isNotNull(), n)).alias("_traffic_n"),
    )
    daily = attach_daily(sums, daily_signals(tables))
    return daily.select(
        "cluster",
        "date",
        "units",
        share(F.coalesce("_promo", F.lit(0)), F.col("_n")).alias("promo_rate"),
        flag(F.col("is_holiday_event")).cast("double").alias("holiday_rate"),
        "oil_price",
        share(F.col("_traffic"), F.col("_traffic_n")).alias("avg_store_transactions"),
    )


def segment_daily_total(tables: Mapping[str, DataFrame]) -> DataFrame:
    return store_day_promo(tables).groupBy("cluster", "date").agg(F.sum("units").alias("units"))


def segment_day_any(tables: Mapping[str, DataFrame]) -> DataFrame:
    """A day whose sales all lack units has 0 units and keeps its flags."""
    sums = store_day_promo(tables, counted_only=False).groupBy("cluster", "date").agg(
        F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"),
        F.bool_or(flag(F.col("on_promotion"))).alias("on_promotion"),
    )
    joined = attach_daily(sums, holiday_daily(tables["holidays"]))
    return joined.withColumn("is_holiday_event", flag(F.col("is_holiday_event"))).select(
        "cluster", "date", "units", "on_promotion", "is_holiday_event"
    )


def segment_day_promo(tables: Mapping[str, DataFrame]) -> DataFrame:
    return (
        store_day_promo(tables)
        .groupBy("cluster", "date", "on_promotion")
        .agg(share(F.sum("units"), F.sum("n_sales")).alias("units"))
    )


