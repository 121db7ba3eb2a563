"""From raw tables to the store x product x day fact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import fill_both_ways, flag, promo_flag, require_columns, to_number
from shelfwise.functions.joins import attach, attach_daily, deal

# Holiday types that mark a day as special.
SPECIAL_TYPES = ("Holiday", "Event")


def canonical_sales(sales: DataFrame) -> DataFrame:
    """Sales under the library's column names, with the promotion flag as boolean."""
    require_columns(sales, ["date", "store_nbr", "item_nbr", "unit_sales", "onpromotion"], "sales")
    text = dict(sales.dtypes)["onpromotion"] == "string"
    promo = promo_flag(F.col("onpromotion")) if text else flag(F.col("onpromotion"))
    return sales.select(
        F.col("date"),
        F.col("store_nbr").alias("store_id"),
        F.col("item_nbr").alias("product_id"),
        F.col("unit_sales").cast("double").alias("units"),
        promo.alias("on_promotion"),
    )


def holiday_daily(holidays: DataFrame) -> DataFrame:
    """One row per date: is any entry of the day special and not transferred?"""
    require_columns(holidays, ["date", "type", "transferred"], "holidays")
    special = F.col("type").isin(*SPECIAL_TYPES) & ~flag(F.col("transferred"))
    return holidays.groupBy("date").agg(
        F.bool_or(flag(special)).alias("is_holiday_event")
    )


def oil_daily(oil: DataFrame, sales_dates: DataFrame) -> DataFrame:
    """One row per sales date with the filled oil price and the missing flag.

    The price is first carried forward along the oil table, then the dates of the
    sales look it up (the flag marks those that find nothing), and what is still
    missing is filled from the sales dates before and after. Both windows have no
    partition key, but order one row per calendar date.
    """
    require_columns(oil, ["date", "dcoilwtico"], "oil")
    along = Window.orderBy("date")
    known = (
        oil.filter(F.col("date").isNotNull())
        .groupBy("date")
        .agg(F.max(to_number(F.col("dcoilwtico"))).alias("_price"))
        .select(
            "date",
            F.last("_price", ignorenulls=True)
            .over(along.rowsBetween(Window.unboundedPreceding, 0))
            .alias("_price"),
        )
    )
    looked_up = attach_daily(sales_dates, known)
    return looked_up.select(
        "date",
        fill_both_ways(F.col("_price"), "date").alias("oil_price"),
        F.col("_price").isNull().cast("int").alias("oil_price_missing_flag"),
    )


def daily_signals(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per sales date: holiday flag, oil price and its missing flag."""
    days = tables["store_days"] if "store_days" in tables else tables["sales"]
    dates = days.select("date").filter(F.col("date").isNotNull()).distinct()
    signals = oil_daily(tables["oil"], dates)
    joined = attach_daily(signals, holiday_daily(tables["holidays"]))
    return joined.withColumn("is_holiday_event", flag(F.col("is_holiday_event")))


def store_traffic(transactions: DataFrame) -> DataFrame:
    return transactions.select(
        "date",
        F.col("store_nbr").alias("store_id"),
        F.col("transactions").cast("double").alias("store_transactions"),
    )


def store_clusters(stores: DataFrame) -> DataFrame:
    return stores.select(F.col("store_nbr").alias("store_id"), "cluster")


def product_classes(products: DataFrame) -> DataFrame:
    return products.select(
        F.col("item_nbr").alias("product_id"),
        F.col("class").alias("product_class"),
        "perishable",
    )


def base_daily_sales(tables: Mapping[str, DataFrame], partitions: int | None = None) -> DataFrame:
    """The fact: every sale with its store, product, traffic and day attributes.

    Holiday and oil are merged into one table of days first, so the fact passes one
    broadcast join for both. The other three joins are left to Catalyst. With ``partitions`` the
    fact comes in that many by (store, day), for use that sorts or groups it so.
    """
    fact = canonical_sales(tables["sales"])
    fact = attach(fact, store_clusters(tables["stores"]), ["store_id"])
    fact = attach(fact, product_classes(tables["products"]), ["product_id"])
    fact = deal(fact, partitions, "store_id", "date")
    fact = attach(fact, store_traffic(tables["transactions"]), ["store_id", "date"])
    fact = attach_daily(fact, daily_signals(tables))
    return fact.select(
        "store_id",
        "product_id",
        "date",
        "units",
        "on_promotion",
        "cluster",
        "product_class",
        "perishable",
        "store_transactions",
        flag(F.col("is_holiday_event")).alias("is_holiday_event"),
        "oil_price",
        "oil_price_missing_flag",
    )


def _events_on(events: DataFrame, keys: list[str], prefix: str, allow_fanout: bool) -> DataFrame:
    """One row per key with the strongest event and all names, or one row per event."""
    name, strength, every = f"_{prefix}_name", f"_{prefix}_intensity", f"_{prefix}_names"
    if allow_fanout:
        return events.select(
            *keys,
            F.col("event_name").alias(name),
            F.col("event_intensity").alias(strength),
            F.array("event_name").alias(every),
        )
    # Strongest first, events without intensity last; of equals the first name.
    weakness = -F.coalesce(F.col("event_intensity"), F.lit(float("-inf")))
    strongest = F.min(
        F.struct(weakness.alias("weakness"), F.col("event_name").alias("name"), F.col("event_intensity").alias("strength"))
    )
    return (
        events.groupBy(*keys)
        .agg(strongest.alias("_e"), F.array_sort(F.collect_set("event_name")).alias(every))
        .select(*keys, F.col("_e.name").alias(name), F.col("_e.strength").alias(strength), every)
    )


def merge_external(
    fact: DataFrame,
    weather: DataFrame | None,
    events: DataFrame | None,
    allow_fanout: bool = False,
) -> DataFrame:
    """Add weather and local events to the fact.

    A store's own events win over city-wide ones; a day without events has intensity 0.
    So that no sale is counted twice, ``event_name`` and ``event_intensity`` are those of the
    strongest event on the key, of equals the one with the first name, and ``event_names``
    lists all of them; ``allow_fanout`` keeps one output row per event instead. A store's
    own event without intensity takes the city's. Columns of an absent table are null.
    """
    require_columns(fact, ["store_id", "date"], "fact")
    out = fact
    if weather is None:
        for name in ("weather_temp_mean", "weather_precip_sum", "weather_wind_max"):
            out = out.withColumn(name, F.lit(None).cast("double"))
    else:
        out = attach(out, weather, ["store_id", "date"])
    if events is None:
        return out.withColumns(
            {
                "event_name": F.lit(None).cast("string"),
                "event_intensity": F.lit(0.0),
                "event_names": F.lit(None).cast("array<string>"),
            }
        )
    own = events.filter(F.col("store_id").isNotNull()).withColumn(
        "store_id", F.col("store_id").cast(fact.schema["store_id"].dataType)
    )
    city = events.filter(F.col("store_id").isNull()).drop("store_id")
    out = attach(out, _events_on(own, ["store_id", "date"], "own", allow_fanout), ["store_id", "date"])
    daily = _events_on(city, ["date"], "city", allow_fanout)
    out = out.join(daily, ["date"], "left") if allow_fanout else attach_daily(out, daily)
    return out.withColumns(
        {
            "event_name": F.coalesce("_own_name", "_city_name"),
            "event_intensity": F.coalesce("_own_intensity", "_city_intensity", F.lit(0.0)),
            "event_names": F.coalesce("_own_names", "_city_names"),
        }
    ).drop(*[f"_{who}_{what}" for who in ("own", "city") for what in ("name", "intensity", "names")])
