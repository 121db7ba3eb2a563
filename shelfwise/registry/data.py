"""Sources, sinks, enrichment and quality."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shelfwise.functions.columns import promo_flag
from shelfwise.functions.joins import ROWS_IN_A_TASK
from shelfwise.functions.lineage import fresh_path, pin
from shelfwise.operators import enrich, features, profile, quality, sketches
from shelfwise.operators.evaluate import split_column
from shelfwise.plans import segment_day
from shelfwise.registry import SQL, query
from shelfwise.registry.inputs import CUTOFF, fact, light_fact, rounded, sales_tasks, total
from shelfwise.registry.views import with_base, with_more
from shelfwise.sources import buckets, raw, sinks, star
from shelfwise.streaming import store_days


@query(
    "load_raw_tables",
    with_base("""
SELECT 'sales' AS table_name, count(*) AS n_rows, count(DISTINCT date) AS n_dates, sum(units) AS total FROM sales
UNION ALL SELECT 'promoted', count(*), count(DISTINCT date), sum(units) FROM sales WHERE lower(onpromotion) = 'true'
UNION ALL SELECT 'stores', count(*), NULL, CAST(sum(cluster) AS DOUBLE) FROM stores
UNION ALL SELECT 'products', count(*), NULL, CAST(sum(product_class * 10 + perishable) AS DOUBLE) FROM products
UNION ALL SELECT 'holidays', count(*), count(DISTINCT date), CAST(count_if(transferred) AS DOUBLE) FROM holidays
UNION ALL SELECT 'oil', count(*), count(DISTINCT date), round(sum(price), 2) FROM oil_raw
UNION ALL SELECT 'transactions', count(*), count(DISTINCT date), sum(store_transactions) FROM transactions
"""),
)
def load_raw_tables(spark, folder):
    """Write the raw tables as CSV files, read them back with the typed reader, sum them up."""
    target = fresh_path(spark, "raw")
    for name, table in star.raw_tables(spark, folder).items():
        table.write.option("header", True).csv(f"{target}/{raw.RAW_FILES[name]}")
    tables = raw.read_raw_tables(spark, target)

    def summary(name, df, dates, amount):
        days = F.countDistinct("date") if dates else F.lit(None).cast("bigint")
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"), days.alias("n_dates"), amount.alias("total")
        ).select(F.lit(name).alias("table_name"), "n_rows", "n_dates", "total")

    sales = tables["sales"]
    parts = [
        summary("sales", sales, True, F.sum("unit_sales")),
        summary("promoted", sales.filter("onpromotion"), True, F.sum("unit_sales")),
        summary("stores", tables["stores"], False, F.sum("cluster").cast("double")),
        summary(
            "products",
            tables["products"],
            False,
            F.sum(F.col("class") * 10 + F.col("perishable")).cast("double"),
        ),
        summary("holidays", tables["holidays"], True, F.count_if("transferred").cast("double")),
        summary("oil", tables["oil"], True, F.round(F.sum("dcoilwtico"), 2)),
        summary("transactions", tables["transactions"], True, F.sum("transactions")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_FACT_SQL = """
SELECT store_id, product_id, date, units, on_promotion, cluster, product_class, perishable,
       store_transactions, is_holiday_event, oil_price, oil_price_missing_flag{more} FROM fact"""


@query("base_daily_sales", with_base(_FACT_SQL.format(more="")))
def base_daily_sales(spark, folder):
    return fact(spark, folder)


@query("write_training_table", with_base(_FACT_SQL.format(more=", strftime(date, '%Y-%m') AS year_month")))
def write_training_table(spark, folder):
    target = fresh_path(spark, "training")
    sinks.write_training_table(fact(spark, folder), target)
    # The month is the folder's name as it was written; inferred, it would not be text.
    written = raw.read_fact(spark, target)
    return written.withColumn("year_month", F.col("year_month").cast("string"))


@query(
    "store_coordinates",
    """SELECT s_suppkey AS store_id, CAST(s_nationkey AS DOUBLE) * 2.5::DOUBLE - 30 AS latitude,
              CAST(-60 - s_nationkey AS DOUBLE) AS longitude
       FROM supplier WHERE s_acctbal >= 0""",
)
def store_coordinates(spark, folder):
    target = fresh_path(spark, "coordinates")
    star.coordinates(star.Star(spark, folder)).write.option("header", True).csv(target)
    return raw.read_store_coordinates(spark, target)


@query("local_events", with_base("SELECT date, event_name, store_id, event_intensity FROM events_in"))
def local_events(spark, folder):
    target = fresh_path(spark, "events")
    star.events(star.Star(spark, folder)).write.option("header", True).csv(target)
    return raw.read_local_events(spark, target)


@query("weather_explode", with_base("SELECT * FROM weather"))
def weather_explode(spark, folder):
    return raw.explode_weather(star.weather_payloads(star.Star(spark, folder)))


@query(
    "promo_flag_parse",
    with_base("""SELECT onpromotion, coalesce(lower(onpromotion) = 'true', false) AS on_promotion,
                        count(*) AS n_rows, sum(units) AS units
                 FROM sales GROUP BY ALL"""),
)
def promo_flag_parse(spark, folder):
    text = F.col("onpromotion")
    return (
        star.sales(star.Star(spark, folder))
        .groupBy("onpromotion", promo_flag(text).alias("on_promotion"))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("unit_sales").alias("units"))
    )


@query("holiday_daily", with_base("SELECT date, is_holiday_event FROM holiday_daily"))
def holiday_daily(spark, folder):
    return enrich.holiday_daily(star.holidays(star.Star(spark, folder)))


@query(
    "oil_impute",
    with_base("""SELECT date, oil_price, CASE WHEN looked_up IS NULL THEN 1 ELSE 0 END AS oil_price_missing_flag
                 FROM oil_daily"""),
)
def oil_impute(spark, folder):
    source = star.Star(spark, folder)
    dates = star.sales(source).select("date").distinct()
    return enrich.oil_daily(star.oil(source), dates)


@query(
    "merge_external",
    with_more(
        """
own AS (SELECT store_id, date, first(event_name ORDER BY event_intensity DESC, event_name) AS name,
               first(event_intensity ORDER BY event_intensity DESC, event_name) AS strength,
               string_agg(DISTINCT event_name, '|' ORDER BY event_name) AS names
        FROM events_in WHERE store_id IS NOT NULL GROUP BY ALL),
city AS (SELECT date, first(event_name ORDER BY event_intensity DESC, event_name) AS name,
                first(event_intensity ORDER BY event_intensity DESC, event_name) AS strength,
                string_agg(DISTINCT event_name, '|' ORDER BY event_name) AS names
         FROM events_in WHERE store_id IS NULL GROUP BY ALL)""",
        """
SELECT f.*, w.weather_temp_mean, w.weather_precip_sum, w.weather_wind_max,
       coalesce(o.name, c.name) AS event_name,
       coalesce(o.strength, c.strength, CAST(0 AS DOUBLE)) AS event_intensity,
       coalesce(o.names, c.names) AS event_names
FROM fact f
LEFT JOIN weather w ON f.store_id = w.store_id AND f.date = w.date
LEFT JOIN own o ON f.store_id = o.store_id AND f.date = o.date
LEFT JOIN city c ON f.date = c.date""",
    ),
)
def merge_external(spark, folder):
    source = star.Star(spark, folder)
    weather = raw.explode_weather(star.weather_payloads(source))
    merged = enrich.merge_external(fact(spark, folder), weather, star.events(source))
    return merged.withColumn("event_names", F.array_join("event_names", "|"))


@query("negative_units", with_base("SELECT * FROM dirty WHERE units < 0"))
def negative_units(spark, folder):
    return quality.negative_units(star.dirty_sales(star.Star(spark, folder)))


@query("null_ids", with_base("SELECT * FROM dirty WHERE store_id IS NULL OR product_id IS NULL"))
def null_ids(spark, folder):
    return quality.null_ids(star.dirty_sales(star.Star(spark, folder)))


@query(
    "stockout_candidates",
    with_base("SELECT * FROM dirty WHERE units = 0 AND NOT coalesce(on_promotion, false)"),
)
def stockout_candidates(spark, folder):
    return quality.stockout_candidates(star.dirty_sales(star.Star(spark, folder)))


@query(
    "missing_dates",
    with_more(
        """
days AS (SELECT DISTINCT store_id, date FROM dirty WHERE store_id IS NOT NULL),
spans AS (SELECT store_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date
          FROM days GROUP BY store_id)""",
        " SELECT store_id, date FROM spans EXCEPT SELECT store_id, date FROM days",
    ),
)
def missing_dates(spark, folder):
    return quality.missing_dates(star.dirty_sales(star.Star(spark, folder)), segment=["store_id"])


@query(
    "missing_pair_dates",
    with_more(
        """
pairs AS (SELECT store_id, product_id, max(date) - min(date) + 1 - count(DISTINCT date) AS gap
          FROM dirty WHERE store_id IS NOT NULL GROUP BY ALL)""",
        """
SELECT store_id, CAST(sum(gap) AS BIGINT) AS n_missing, count(*) AS n_products
FROM pairs WHERE gap > 0 GROUP BY store_id""",
    ),
)
def missing_pair_dates(spark, folder):
    """Missing days of every store-product pair, counted per store."""
    per_pair = quality.missing_date_counts(star.dirty_sales(star.Star(spark, folder)))
    return per_pair.groupBy("store_id").agg(
        F.sum("n_missing").alias("n_missing"), F.count(F.lit(1)).alias("n_products")
    )


@query(
    "validation_summary",
    with_more(
        """
pairs AS (SELECT store_id, product_id, max(date) - min(date) + 1 - count(DISTINCT date) AS gap
          FROM dirty WHERE store_id IS NOT NULL AND product_id IS NOT NULL GROUP BY ALL)""",
        """
SELECT count(*) AS rows, count_if(units < 0) AS negative_units,
       count_if(store_id IS NULL OR product_id IS NULL) AS null_ids,
       count_if(units = 0 AND NOT on_promotion) AS stockout_candidates,
       (SELECT CAST(sum(gap) AS BIGINT) FROM pairs) AS missing_dates
FROM dirty""",
    ),
)
def validation_summary(spark, folder):
    return quality.validation_summary(star.dirty_sales(star.Star(spark, folder)))


@query(
    "missing_profile",
    with_more(
        """
wide AS (SELECT d.*, t.store_transactions FROM dirty d
         LEFT JOIN transactions t ON d.store_id = t.store_id AND d.date = t.date)""",
        """
SELECT 'store_id' AS column_name, count_if(store_id IS NULL) AS missing_count,
       round(100.0::DOUBLE * count_if(store_id IS NULL) / count(*), 2) AS missing_pct FROM wide
UNION ALL
SELECT 'store_transactions', count_if(store_transactions IS NULL),
       round(100.0::DOUBLE * count_if(store_transactions IS NULL) / count(*), 2) FROM wide""",
    ),
)
def missing_profile(spark, folder):
    source = star.Star(spark, folder)
    sales = star.dirty_sales(source)
    traffic = enrich.store_traffic(star.transactions(source))
    return quality.missing_profile(sales.join(traffic, ["store_id", "date"], "left"))


@query(
    "key_counts",
    with_base("""
SELECT count(*) AS rows, 5 AS columns, count(DISTINCT store_id) AS unique_stores,
       count(DISTINCT product_id) AS unique_products,
       (SELECT count(*) FROM (SELECT DISTINCT store_id, product_id FROM dirty)) AS unique_store_product_pairs,
       min(date) AS first_date, max(date) AS last_date
FROM dirty"""),
)
def key_counts(spark, folder):
    return quality.key_counts(star.dirty_sales(star.Star(spark, folder)))


@query(
    "cutoff_split",
    with_base("""
SELECT cluster, CASE WHEN date <= DATE '2001-06-30' THEN 'train' ELSE 'valid' END AS split,
       count(*) AS n_days, sum(units) AS units, min(date) AS first_date, max(date) AS last_date
FROM base GROUP BY ALL"""),
)
def cutoff_split(spark, folder):
    split = split_column(F.col("date"), CUTOFF).alias("split")
    return (
        total(spark, folder)
        .groupBy("cluster", split)
        .agg(
            F.count(F.lit(1)).alias("n_days"),
            F.sum("units").alias("units"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


@query(
    "prediction_export",
    with_base("""
SELECT date, cluster, units, pred_seasonal_naive_7d FROM (
  SELECT date, cluster, units, lag(units, 7) OVER (PARTITION BY cluster ORDER BY date) AS pred_seasonal_naive_7d
  FROM base) ORDER BY cluster DESC, date DESC LIMIT 2000"""),
)
def prediction_export(spark, folder):
    series = features.add_lags(total(spark, folder))
    return sinks.prediction_extract(
        series, {"units": "units", "lag_7": "pred_seasonal_naive_7d"}, rows=2000
    )


@query(
    "segment_daily_base",
    with_base("SELECT * FROM base"),
)
def segment_daily_base(spark, folder):
    """The operator on the row-level fact."""
    return rounded(features.segment_daily_base(fact(spark, folder)), "oil_price")


@query("segment_daily_base_reduced", with_base("SELECT * FROM base"))
def segment_daily_base_reduced(spark, folder):
    """The same table from the plan that sums the sales before any join."""
    return rounded(segment_day.segment_daily_base(star.raw_tables(spark, folder)), "oil_price")


@query("segment_daily_total", with_base("SELECT cluster, date, units FROM base"))
def segment_daily_total(spark, folder):
    return total(spark, folder)


@query("segment_day_any", with_base("SELECT * FROM any_day"))
def segment_day_any(spark, folder):
    return segment_day.segment_day_any(star.raw_tables(spark, folder))


@query("segment_day_promo", with_base("SELECT * FROM promo_day"))
def segment_day_promo(spark, folder):
    return segment_day.segment_day_promo(star.raw_tables(spark, folder))


@query(
    "row_sample",
    with_more(
        """
hashed AS (
  SELECT *, md5('42|' || concat_ws('|', date::VARCHAR, store_id::VARCHAR, product_id::VARCHAR,
                                   units::INT::VARCHAR, coalesce(onpromotion, '~'))) AS h
  FROM sales)""",
        """
SELECT date, store_id, product_id, CAST(units AS INTEGER) AS units, onpromotion
FROM (SELECT *, row_number() OVER (ORDER BY h) AS place FROM hashed) WHERE place <= 5000""",
    ),
)
def row_sample(spark, folder):
    rows = star.sales(star.Star(spark, folder)).select(
        "date",
        F.col("store_nbr").alias("store_id"),
        F.col("item_nbr").alias("product_id"),
        F.col("unit_sales").cast("int").alias("units"),
        "onpromotion",
    )
    return profile.row_sample(rows, 5000)


@query(
    "cluster_day_covariates",
    with_base("""
SELECT cluster, date, units, promo_rate, holiday_rate,
  round(coalesce(last_value(avg_store_transactions IGNORE NULLS) OVER back,
           first_value(avg_store_transactions IGNORE NULLS) OVER ahead), 6) AS avg_store_transactions,
  round(coalesce(last_value(oil_price IGNORE NULLS) OVER back,
           first_value(oil_price IGNORE NULLS) OVER ahead), 6) AS oil_price,
  isodow(date) - 1 AS day_of_week, month(date) AS month
FROM base
WINDOW back AS (PARTITION BY cluster ORDER BY date ROWS UNBOUNDED PRECEDING),
       ahead AS (PARTITION BY cluster ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""),
)
def cluster_day_covariates(spark, folder):
    series = features.covariates_of(segment_day.segment_daily_base(star.raw_tables(spark, folder)))
    return rounded(series, "avg_store_transactions", "oil_price")




@query(
    "replaced_month",
    with_base("""
SELECT store_id, product_id, date, units * CASE WHEN strftime(date, '%Y-%m') = '1997-05' THEN 2 ELSE 1 END AS units,
       strftime(date, '%Y-%m') AS year_month
FROM fact WHERE date >= DATE '1997-01-01' AND date < DATE '1998-01-01'"""),
)
def replaced_month(spark, folder):
    """A year of the fact, of which one month is delivered again with other units."""
    year = light_fact(spark, folder).filter("date >= DATE'1997-01-01' AND date < DATE'1998-01-01'")
    target = fresh_path(spark, "delivered")
    sinks.write_training_table(year, target)
    month = F.date_format("date", "yyyy-MM")
    again = year.withColumn("year_month", month).filter(F.col("year_month") == "1997-05")
    sinks.replace_months(again.withColumn("units", F.col("units") * 2), target)
    written = raw.read_fact(spark, target)
    return written.select(
        "store_id", "product_id", "date", "units", F.col("year_month").cast("string").alias("year_month")
    )


@query(
    "distinct_rollup",
    with_base("""
SELECT cluster, count(*) AS n_rows, count(DISTINCT product_id) AS unique_products,
       count(DISTINCT store_id) AS unique_stores, true AS products_close, true AS stores_close
FROM fact GROUP BY cluster"""),
)
def distinct_rollup(spark, folder):
    """Distinct counts per cluster from sketches per store and day, next to the exact ones.

    Close is within four standard errors.
    """
    sales = light_fact(spark, folder).select("cluster", "store_id", "date", "product_id")
    stored = pin(sketches.sketch_table(sales, ["cluster", "store_id", "date"], ["product_id", "store_id"]), "sketches")
    found = sketches.estimates(sketches.rolled_up(stored.drop("store_id"), ["cluster"]))
    exact = sales.groupBy("cluster").agg(
        F.countDistinct("product_id").alias("unique_products"), F.countDistinct("store_id").alias("unique_stores")
    )
    error = 4 * 1.04 / 2 ** (sketches.DISTINCT_BITS / 2)
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= error * F.col(b)
    return found.join(exact, found["cluster"].eqNullSafe(exact["cluster"])).select(
        found["cluster"],
        "n_rows",
        "unique_products",
        "unique_stores",
        close("product_id", "unique_products").alias("products_close"),
        close("store_id", "unique_stores").alias("stores_close"),
    )


@query(
    "quantile_rollup",
    with_base("""
SELECT cluster, count(*) AS n_rows, true AS median_close, true AS p95_close
FROM fact WHERE cluster IS NOT NULL GROUP BY cluster"""),
)
def quantile_rollup(spark, folder):
    """Median and 95th percentile per cluster from sketches per cluster and day; ranks off by 2 percent at most."""
    sales = light_fact(spark, folder).filter("cluster IS NOT NULL").select("cluster", "date", "units")
    stored = pin(sketches.sketch_table(sales, ["cluster", "date"], quantiles=["units"]), "sketches")
    found = pin(sketches.estimates(sketches.rolled_up(stored, ["cluster"]), {"median": 0.5, "p95": 0.95}), "found")
    out = found.select("cluster", "n_rows")
    for label, p in (("median", 0.5), ("p95", 0.95)):
        errors = sketches.rank_errors(sales, found, ["cluster"], "units", f"units_{label}", p)
        out = out.join(errors.select("cluster", (F.col("rank_error") <= 0.02).alias(f"{label}_close")), "cluster")
    return out


def _streamed(spark, folder, partitions):
    """Raw tables whose sales went through the stream in two micro-batches of shuffled files."""
    tables = star.raw_tables(spark, folder, partitions)
    path, checkpoint, target = (fresh_path(spark, name) for name in ("sales", "stream", "store-days"))
    sales = tables["sales"]
    files = -(-sales.count() // (2 * ROWS_IN_A_TASK)) or 1
    sales.repartition(2 * files).write.parquet(path)
    stream = spark.readStream.schema(sales.schema).option("maxFilesPerTrigger", files).parquet(path)
    query = store_days.start(stream, target, checkpoint, delay="20000 days", partitions=partitions)
    query.awaitTermination()
    return store_days.tables_of(spark, target, {name: tables[name] for name in tables})


@query("segment_daily_base_stream", with_base("SELECT * FROM base"))
def segment_daily_base_stream(spark, folder):
    """The segment-day base table from a stream of sales in any order."""
    partitions = sales_tasks(spark, folder)
    return rounded(segment_day.segment_daily_base(_streamed(spark, folder, partitions), partitions), "oil_price")


@query("segment_daily_total_stream", with_base("SELECT cluster, date, units FROM base"))
def segment_daily_total_stream(spark, folder):
    return segment_day.segment_daily_total(_streamed(spark, folder, sales_tasks(spark, folder)))


@query("merge_external_bucketed", SQL["merge_external"])
def merge_external_bucketed(spark, folder):
    """The same table from a fact and a weather table in buckets of (store_id, date)."""
    source = star.Star(spark, folder)
    number = sales_tasks(spark, folder)
    weather = raw.explode_weather(star.weather_payloads(source))
    tables = {"fact_by_key": fact(spark, folder, number), "weather_by_key": weather}
    kept = [
        buckets.write_bucketed(rows, f"{name}_{uuid.uuid4().hex}", fresh_path(spark, name), buckets=number)
        for name, rows in tables.items()
    ]
    merged = enrich.merge_external(*kept, star.events(source))
    return merged.withColumn("event_names", F.array_join("event_names", "|"))
