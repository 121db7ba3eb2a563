"""Typed readers of the raw files. Every reader is lazy and has a fixed schema."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfwise.functions.columns import promo_flag, require_columns

# File names and columns of the six raw tables, the optional files
# and the weather payload.
RAW_FILES = {
    "sales": "train.csv",
    "stores": "stores.csv",
    "products": "items.csv",
    "holidays": "holidays_events.csv",
    "oil": "oil.csv",
    "transactions": "transactions.csv",
}
RAW_COLUMNS = {
    "sales": "date date, store_nbr bigint, item_nbr bigint, unit_sales double, onpromotion string",
    "stores": "store_nbr bigint, cluster int",
    "products": "item_nbr bigint, class int, perishable int",
    "holidays": "date date, type string, transferred boolean",
    "oil": "date date, dcoilwtico double",
    "transactions": "date date, store_nbr bigint, transactions double",
}
COORDINATE_COLUMNS = "store_id bigint, latitude double, longitude double"
EVENT_COLUMNS = "date date, event_name string, store_id bigint, event_intensity double"
WEATHER_PAYLOAD = (
    "daily struct<time: array<string>, temperature_2m_mean: array<double>, "
    "precipitation_sum: array<double>, windspeed_10m_max: array<double>>"
)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on any file system Hadoop can open."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def missing_files(spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> list[str]:
    """Names of the raw files that ``folder`` lacks, sorted."""
    wanted = list(names) if names is not None else list(RAW_FILES.values())
    return sorted(n for n in wanted if not path_exists(spark, f"{folder}/{n}"))


def _read_csv(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Read the named columns of a CSV file with a header, whatever their order.

    The header decides the positions, so a file may have more columns than asked
    for; only the asked ones are parsed.
    """
    wanted = T.StructType.fromDDL(columns)
    header = spark.read.option("header", True).csv(path).columns
    require_columns(_Header(header), wanted.fieldNames(), path)
    types = {field.name: field.dataType for field in wanted}
    schema = T.StructType(
        [T.StructField(name, types.get(name, T.StringType())) for name in header]
    )
    return (
        spark.read.schema(schema).option("header", True).csv(path).select(*wanted.fieldNames())
    )


class _Header:
    def __init__(self, columns: list[str]):
        self.columns = columns


def read_raw_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The six raw tables by name. Raises if a file is missing."""
    missing = missing_files(spark, folder)
    if missing:
        raise FileNotFoundError(f"{folder} lacks raw files: {', '.join(missing)}")
    tables = {
        name: _read_csv(spark, f"{folder}/{file}", RAW_COLUMNS[name])
        for name, file in RAW_FILES.items()
    }
    tables["sales"] = tables["sales"].withColumn("onpromotion", promo_flag(F.col("onpromotion")))
    return tables


def read_fact(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The training table, with only the named columns."""
    fact = spark.read.parquet(path)
    if columns is None:
        return fact
    require_columns(fact, columns, path)
    return fact.select(*columns)


def empty(spark: SparkSession, columns: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType.fromDDL(columns))


def store_coordinates(table: DataFrame) -> DataFrame:
    """Distinct complete coordinate rows."""
    names = T.StructType.fromDDL(COORDINATE_COLUMNS).fieldNames()
    require_columns(table, names, "store coordinates")
    return table.select(*names).dropna().dropDuplicates()


def read_store_coordinates(spark: SparkSession, path: str) -> DataFrame:
    """Optional coordinates file; an empty table if there is none."""
    if not path_exists(spark, path):
        return empty(spark, COORDINATE_COLUMNS)
    return store_coordinates(_read_csv(spark, path, COORDINATE_COLUMNS))


def local_events(table: DataFrame) -> DataFrame:
    """Event rows with the two optional columns filled in where they are absent."""
    require_columns(table, ["date", "event_name"], "local events")
    out = table
    if "store_id" not in out.columns:
        out = out.withColumn("store_id", F.lit(None).cast("bigint"))
    if "event_intensity" not in out.columns:
        out = out.withColumn("event_intensity", F.lit(1.0))
    return out.select(
        F.col("date").cast("date").alias("date"),
        F.col("event_name").cast("string").alias("event_name"),
        F.col("store_id").try_cast("double").cast("bigint").alias("store_id"),
        F.col("event_intensity").try_cast("double").alias("event_intensity"),
    )


def read_local_events(spark: SparkSession, path: str) -> DataFrame:
    """Optional events file; an empty table if there is none."""
    if not path_exists(spark, path):
        return empty(spark, EVENT_COLUMNS)
    return local_events(spark.read.option("header", True).csv(path))


def explode_weather(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per store and day from one JSON payload of parallel arrays per store.

    A payload without dates gives no rows.
    """
    require_columns(payloads, ["store_id", payload], "weather payloads")
    daily = F.from_json(F.col(payload), T.StructType.fromDDL(WEATHER_PAYLOAD))["daily"]
    rows = payloads.select("store_id", daily.alias("d")).select(
        "store_id",
        F.explode(
            F.arrays_zip(
                F.col("d.time").alias("time"),
                F.col("d.temperature_2m_mean").alias("temp"),
                F.col("d.precipitation_sum").alias("rain"),
                F.col("d.windspeed_10m_max").alias("wind"),
            )
        ).alias("day"),
    )
    return rows.select(
        "store_id",
        F.to_date("day.time").alias("date"),
        F.col("day.temp").alias("weather_temp_mean"),
        F.col("day.rain").alias("weather_precip_sum"),
        F.col("day.wind").alias("weather_wind_max"),
    ).filter(F.col("date").isNotNull())


def read_weather(spark: SparkSession, path: str) -> DataFrame:
    """Weather payload files: one JSON object per line with ``store_id`` and ``daily``."""
    lines = spark.read.text(path).select(
        F.get_json_object("value", "$.store_id").cast("bigint").alias("store_id"),
        F.col("value").alias("payload"),
    )
    return explode_weather(lines)


def read_metrics(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """Metrics table written by :func:`shelfwise.sources.sinks.write_report`."""
    table = _read_csv(spark, path, "model string, mae double, rmse double, mape_pct double")
    return table if model is None else table.filter(F.col("model") == model)
