"""Writers of the fact, of small reports and of prediction extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import require_columns

FACT_ORDER = ("store_id", "product_id", "date")


def write_training_table(fact: DataFrame, path: str) -> None:
    """Write the fact as Parquet, one folder per month.

    The rebalance hint lets adaptive execution cut a month that is too large into
    several files of the advisory size, also when one store, product or group of
    equal rows fills it, and join months that are too small. Rows are sorted inside
    each file, which is what row-group pruning needs; there is no global sort.
    """
    require_columns(fact, FACT_ORDER, "training table")
    (
        fact.withColumn("year_month", F.date_format("date", "yyyy-MM"))
        .hint("rebalance", "year_month")
        .sortWithinPartitions("year_month", *FACT_ORDER)
        .write.mode("overwrite")
        .partitionBy("year_month")
        .parquet(path)
    )


def replace_months(rows: DataFrame, path: str) -> None:
    """Write ``rows`` (with ``year_month``) over the same months of a table; other months stay as they are.

    For a month that is delivered again. The new files of all months are made beside the table first
    and take the place of the old ones when the job ends well, so a failed run leaves the old months.
    ``rows`` must not be read from ``path`` itself.
    """
    require_columns(rows, ["year_month"], "months")
    (
        rows.hint("rebalance", "year_month")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year_month")
        .parquet(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    """Write a small report table as one CSV file.

    The shuffle in front of the one writing task keeps the work before it parallel.
    """
    report.repartition(1).write.mode("overwrite").option("header", True).csv(path)


def write_search_summary(best: DataFrame, path: str) -> None:
    """Write the best trials as JSON lines, parameters as a nested object."""
    best.repartition(1).write.mode("overwrite").json(path)


def prediction_extract(
    predictions: DataFrame,
    columns: dict[str, str],
    rows: int = 2000,
    segment: str = "cluster",
    date: str = "date",
) -> DataFrame:
    """The last ``rows`` predictions in (segment, date) order.

    ``columns`` maps input names to output names, for example
    ``{"lag_7": "pred_seasonal_naive_7d"}``.
    """
    require_columns(predictions, [segment, date, *columns], "predictions")
    named = [F.col(old).alias(new) for old, new in columns.items()]
    return (
        predictions.select(date, segment, *named)
        .orderBy(F.desc(segment), F.desc(date))
        .limit(rows)
    )
