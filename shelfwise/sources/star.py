"""The raw retail tables as views over a star schema of orders.

An order line is a sale: the supplier is the store, the part is the product and the
ship date is the day. ``FIXTURES.md`` states the same rules in words.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.functions.joins import deal

# Part types in alphabetical order; the class number is the place here.
PART_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


class Star:
    """The tables of one folder; each file listing is read once.

    With ``partitions``, tables by store and day are made in that many partitions of (store, day).
    """

    def __init__(self, spark: SparkSession, folder: str, partitions: int | None = None):
        self._spark, self._folder, self.partitions = spark, folder, partitions
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._tables[name]


def _day(name: str):
    return F.col(name).cast("date")


def sales(star: Star) -> DataFrame:
    """date, store_nbr, item_nbr, unit_sales, onpromotion (text, null when no discount)."""
    discount = F.col("l_discount")
    return star.table("lineitem").select(
        _day("l_shipdate").alias("date"),
        F.col("l_suppkey").alias("store_nbr"),
        F.col("l_partkey").alias("item_nbr"),
        F.col("l_quantity").alias("unit_sales"),
        F.when(discount >= 0.095, "True").when(discount >= 0.005, "False").alias("onpromotion"),
    )


def dirty_sales(star: Star) -> DataFrame:
    """Sales with returns as negative units, zero units and missing stores."""
    tax, discount = F.col("l_tax"), F.col("l_discount")
    units = (
        F.when((F.col("l_returnflag") == "R") & (tax < 0.005), -F.col("l_quantity"))
        .when(discount < 0.005, F.lit(0.0))
        .otherwise(F.col("l_quantity"))
    )
    store = F.when(~((tax >= 0.075) & (discount >= 0.085)), F.col("l_suppkey"))
    return star.table("lineitem").select(
        _day("l_shipdate").alias("date"),
        store.alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        units.alias("units"),
        (discount >= 0.095).alias("on_promotion"),
    )


def stores(star: Star) -> DataFrame:
    nation = F.broadcast(star.table("nation"))  # a fixed table of 25 rows
    supplier = star.table("supplier")
    return supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("s_suppkey").alias("store_nbr"), F.col("n_regionkey").alias("cluster")
    )


def products(star: Star) -> DataFrame:
    types = F.array(*[F.lit(t) for t in PART_TYPES])
    return star.table("part").select(
        F.col("p_partkey").alias("item_nbr"),
        F.array_position(types, F.col("p_type")).cast("int").alias("class"),
        (F.col("p_size") <= 25).cast("int").alias("perishable"),
    )


def _order_days(star: Star) -> DataFrame:
    return star.table("orders").select(
        _day("o_orderdate").alias("date"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
    )


def holidays(star: Star) -> DataFrame:
    """Order days 1, 15 and 25 of a month; those of June and December are transferred."""
    day = F.dayofmonth("date")
    kind = F.when(day == 1, "Holiday").when(day == 25, "Event").when(day == 15, "Work Day")
    return (
        _order_days(star)
        .select("date")
        .distinct()
        .select(
            "date",
            kind.alias("type"),
            F.month("date").isin(6, 12).alias("transferred"),
        )
        .filter(F.col("type").isNotNull())
    )


def oil(star: Star) -> DataFrame:
    """Price signal with two decimals; null on Saturdays, no row on Sundays."""
    price = F.expr("sum(cents) div (count(*) * 1000)") / 100.0
    return (
        _order_days(star)
        .groupBy("date")
        .agg(price.alias("price"))
        .filter(F.weekday("date") < 6)
        .select("date", F.when(F.weekday("date") < 5, F.col("price")).alias("dcoilwtico"))
    )


def transactions(star: Star) -> DataFrame:
    """Orders with taxed lines per store and day; days without any have no row."""
    taxed = (
        star.table("lineitem")
        .filter(F.col("l_tax") >= 0.005)
        .select(_day("l_shipdate").alias("date"), F.col("l_suppkey").alias("store_nbr"), "l_orderkey")
    )
    return (
        deal(taxed, star.partitions, "store_nbr", "date")
        .groupBy("date", "store_nbr")
        .agg(F.countDistinct("l_orderkey").cast("double").alias("transactions"))
    )


class RawTables(Mapping):
    """The six raw tables by name; a table's files are listed when it is first used."""

    _builders = {
        "sales": sales,
        "stores": stores,
        "products": products,
        "holidays": holidays,
        "oil": oil,
        "transactions": transactions,
    }

    def __init__(self, star: Star):
        self._star = star

    def __getitem__(self, name: str) -> DataFrame:
        return self._builders[name](self._star)

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def raw_tables(spark: SparkSession, folder: str, partitions: int | None = None) -> RawTables:
    return RawTables(Star(spark, folder, partitions))


def store_days(star: Star) -> DataFrame:
    """Distinct (store_id, date) of the sales."""
    return (
        sales(star)
        .select(F.col("store_nbr").alias("store_id"), "date")
        .distinct()
    )


def weather_payloads(star: Star) -> DataFrame:
    """One JSON payload per store with a value for each of its sales days.

    A store has at most one entry per calendar day, so the arrays are bounded.
    """

    def entry(s):
        date = s["date"]
        day = F.dayofyear(date)
        temp = (day * 7 + F.col("store_id") * 3) % 300 / 10.0
        rain = (day + F.col("store_id")) % 50 / 10.0
        wind = (day * 3 + F.col("store_id")) % 400 / 10.0
        return F.struct(
            date.cast("string").alias("time"), temp.alias("temp"), rain.alias("rain"), wind.alias("wind")
        )

    # Only days are shuffled and sorted; the struct keeps a missing day.
    days = store_days(star).groupBy("store_id").agg(F.sort_array(F.collect_list(F.struct("date"))).alias("d"))
    series = days.select("store_id", F.transform("d", entry).alias("s"))
    payload = F.to_json(
        F.struct(
            F.struct(
                F.col("s.time").alias("time"),
                F.col("s.temp").alias("temperature_2m_mean"),
                F.col("s.rain").alias("precipitation_sum"),
                F.col("s.wind").alias("windspeed_10m_max"),
            ).alias("daily")
        )
    )
    return series.select("store_id", payload.alias("payload"))


def events(star: Star) -> DataFrame:
    """City-wide events on 20 March and 20 September, and one August day per store, with two
    events in odd stores.

    The store's day in August is its nation number plus one.
    """
    days = sales(star).select("date").distinct()
    city = days.filter(
        (F.dayofmonth("date") == 20) & F.month("date").isin(3, 9)
    ).select(
        "date",
        F.lit("City Day").alias("event_name"),
        F.lit(None).cast("bigint").alias("store_id"),
        F.lit(1.5).alias("event_intensity"),
    )
    nation_of = star.table("supplier").select(
        F.col("s_suppkey").alias("store_id"), "s_nationkey"
    )
    shop = (
        store_days(star)
        .filter(F.month("date") == 8)
        .join(nation_of, "store_id")
        .filter(F.dayofmonth("date") == F.col("s_nationkey") + 1)
        .select(
            "date",
            F.lit("Shop Day").alias("event_name"),
            "store_id",
            F.lit(1.2).alias("event_intensity"),
        )
    )
    # Odd stores have a second, weaker event on the same day.
    fair = shop.filter(F.col("store_id") % 2 == 1).withColumns(
        {"event_name": F.lit("Fair"), "event_intensity": F.lit(1.1)}
    )
    return city.unionByName(shop).unionByName(fair)


def coordinates(star: Star) -> DataFrame:
    """Store coordinates with incomplete and repeated rows, as in a hand-kept file."""
    rows = star.table("supplier").select(
        F.col("s_suppkey").alias("store_id"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_nationkey") * 2.5 - 30).alias("latitude"),
        (F.lit(-60.0) - F.col("s_nationkey")).alias("longitude"),
    )
    return rows.unionByName(rows)
