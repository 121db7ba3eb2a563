"""From raw tables to the written and validated fact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from shelfwise.operators.enrich import base_daily_sales, merge_external
from shelfwise.operators.quality import validation_summary
from shelfwise.sources import raw
from shelfwise.sources.sinks import write_training_table


def training_table(
    tables: Mapping[str, DataFrame],
    weather: DataFrame | None = None,
    events: DataFrame | None = None,
) -> DataFrame:
    return merge_external(base_daily_sales(tables), weather, events)


def build(spark: SparkSession, raw_folder: str, external_folder: str, out: str) -> DataFrame:
    """Read the raw files, write the fact to ``out`` and return its validation counts.

    Weather and events are optional files of the external folder. The checks read
    the written table, so the joins run once.
    """
    weather_path = f"{external_folder}/weather.json"
    weather = raw.read_weather(spark, weather_path) if raw.path_exists(spark, weather_path) else None
    events = raw.read_local_events(spark, f"{external_folder}/local_events.csv")
    write_training_table(training_table(raw.read_raw_tables(spark, raw_folder), weather, events), out)
    return validation_summary(raw.read_fact(spark, out))
