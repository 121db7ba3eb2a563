"""Inputs the registered queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.columns import promo_flag
from shelfwise.functions.joins import tasks_for
from shelfwise.functions.lineage import pin
from shelfwise.operators import features
from shelfwise.operators.enrich import base_daily_sales, product_classes
from shelfwise.plans import segment_day
from shelfwise.sources import star

CUTOFF = "2001-06-30"


def sales_tasks(spark: SparkSession, folder: str) -> int:
    """Partitions for queries that sort or group the whole sales by store and day."""
    return tasks_for(star.raw_tables(spark, folder)["sales"])


def fact(spark: SparkSession, folder: str, partitions: int | None = None) -> DataFrame:
    return base_daily_sales(star.raw_tables(spark, folder, partitions), partitions)


def base(spark: SparkSession, folder: str) -> DataFrame:
    return segment_day.segment_daily_base(star.raw_tables(spark, folder))


def total(spark: SparkSession, folder: str) -> DataFrame:
    return segment_day.segment_daily_total(star.raw_tables(spark, folder))


def frame(spark: SparkSession, folder: str) -> DataFrame:
    return features.model_frame_of(base(spark, folder))


def written_frame(spark: SparkSession, folder: str) -> DataFrame:
    """The frame as a written table, for queries that read it more than once."""
    return pin(frame(spark, folder), "frame")


def promo_days(spark: SparkSession, folder: str) -> DataFrame:
    return segment_day.segment_day_promo(star.raw_tables(spark, folder))


def light_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Sales with the store's cluster only, for tables that need nothing else."""
    tables = star.raw_tables(spark, folder)
    clusters = tables["stores"].withColumnRenamed("store_nbr", "store_id")
    return (
        tables["sales"]
        .select(
            "date",
            F.col("store_nbr").alias("store_id"),
            F.col("item_nbr").alias("product_id"),
            F.col("unit_sales").alias("units"),
            promo_flag(F.col("onpromotion")).alias("on_promotion"),
        )
        .join(clusters, "store_id", "left")
    )


def classed_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Light fact with the product's class and kind."""
    classes = product_classes(star.products(star.Star(spark, folder)))
    return light_fact(spark, folder).join(classes, "product_id", "left")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round columns whose last bits depend on the order of summation."""
    return df.withColumns({name: F.round(F.col(name), digits) for name in names})


def round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return rounded(df, *[name for name, kind in df.dtypes if kind == "double"], digits=digits)

