"""Overview tables of demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import flag, pct_change, require_columns, share
from shelfwise.functions.lineage import pin
from shelfwise.functions.ordered import quantiles_of, running_counts, value_histogram

PROMO_LABELS = ("No Promo", "Promo")


def daily_trend(fact: DataFrame, date: str = "date", units: str = "units", rows: int = 28) -> DataFrame:
    """Units per day and their mean over the last ``rows`` days with sales.

    The window has no partition key but orders one row per calendar day.
    """
    require_columns(fact, [date, units], "fact")
    daily = fact.select(date, units).dropna().groupBy(date).agg(F.sum(units).alias(units))
    trailing = Window.orderBy(date).rowsBetween(1 - rows, 0)
    return daily.withColumn(f"rolling_{rows}d", F.avg(units).over(trailing))


def daily_tail(trend: DataFrame, days: int = 90, date: str = "date") -> DataFrame:
    """The last days of a daily trend."""
    return trend.orderBy(F.desc(date)).limit(days)


def top_stores(fact: DataFrame, k: int = 15, store: str = "store_id", units: str = "units") -> DataFrame:
    """Stores with the most units."""
    require_columns(fact, [store, units], "fact")
    totals = fact.select(store, units).dropna().groupBy(store).agg(F.sum(units).alias(units))
    return totals.orderBy(F.desc(units), store).limit(k)


def segment_summary(fact: DataFrame, segment: str = "cluster", kind: str = "perishable") -> DataFrame:
    """Mean and median units and promotion rate by segment and kind of product.

    All three come from one count per (segment, kind, units value).
    """
    require_columns(fact, [segment, kind, "units", "on_promotion"], "fact")
    keys = [segment, kind]
    promo = {"_promo": F.count_if(flag(F.col("on_promotion")))}
    counts = running_counts(value_histogram(fact, keys, "units", promo), keys, "units", "n")
    rows = F.sum("n")
    return quantiles_of(
        counts,
        keys,
        "units",
        {"median_units": 0.5},
        {
            "avg_units": share(F.sum(F.col("units") * F.col("n")), rows),
            "promo_rate": share(F.sum("_promo"), rows),
        },
    )


def zero_negative_rates(fact: DataFrame, segment: str = "cluster") -> DataFrame:
    """Shares of zero and negative sales per segment, in percent with two decimals."""
    require_columns(fact, [segment, "units"], "fact")
    rows = F.count(F.lit(1))
    return (
        fact.filter(F.col(segment).isNotNull())
        .groupBy(segment)
        .agg(
            rows.alias("rows"),
            F.round(100 * share(F.count_if(F.col("units") == 0), rows), 2).alias("zero_rate_pct"),
            F.round(100 * share(F.count_if(F.col("units") < 0), rows), 2).alias("negative_rate_pct"),
            F.avg("units").alias("avg_units"),
        )
    )


def promo_lift(fact: DataFrame, segment: str = "cluster") -> DataFrame:
    """Mean units with and without promotion per segment, and the lift."""
    require_columns(fact, [segment, "units", "on_promotion"], "fact")
    on = F.col("on_promotion")
    means = (
        fact.filter(F.col(segment).isNotNull())
        .groupBy(segment)
        .agg(
            F.avg(F.when(~on, F.col("units"))).alias("avg_units_no_promo"),
            F.avg(F.when(on, F.col("units"))).alias("avg_units_promo"),
        )
    )
    base, promo = F.col("avg_units_no_promo"), F.col("avg_units_promo")
    return means.withColumns(
        {"uplift_abs": promo - base, "uplift_pct": F.round(pct_change(promo, base), 2)}
    )


def _clipped(histogram: DataFrame, units: str, low: float | None, high: float) -> Column:
    """Units cut at exact quantiles of all rows, which come as one scalar subquery."""
    counts = running_counts(histogram, [], units, "n")
    wanted = {"high": high} if low is None else {"low": low, "high": high}
    bounds = quantiles_of(counts, [], units, wanted).select(F.struct(*wanted).alias("b")).scalar()
    cut = F.least(F.col(units), bounds["high"])
    return cut if low is None else F.greatest(cut, bounds["low"])


def clip_units(
    fact: DataFrame, low: float | None = 0.01, high: float = 0.99, units: str = "units"
) -> DataFrame:
    """The fact with ``units_clipped``, cut at exact quantiles of all rows.

    ``low=None`` cuts the upper end only.
    """
    require_columns(fact, [units], "fact")
    histogram = value_histogram(fact, [], units)
    clipped = F.when(F.col(units).isNotNull(), _clipped(histogram, units, low, high))
    return fact.withColumn("units_clipped", clipped)


def _clipped_counts(fact: DataFrame, low: float | None, high: float) -> DataFrame:
    """Rows per promotion label and clipped value, with running counts per label.

    The quantiles come from the same written histogram, so the fact is read once.
    """
    require_columns(fact, ["units", "on_promotion"], "fact")
    by_value = pin(value_histogram(fact, ["on_promotion"], "units"), "values")
    all_values = by_value.groupBy("units").agg(F.sum("n").alias("n"))
    clipped = _clipped(all_values, "units", low, high)
    label = F.when(F.col("on_promotion"), PROMO_LABELS[1]).otherwise(PROMO_LABELS[0])
    merged = by_value.groupBy(
        label.alias("promo_label"), clipped.alias("units_clipped")
    ).agg(F.sum("n").alias("n"))
    return running_counts(merged, ["promo_label"], "units_clipped", "n")


def ecdf(fact: DataFrame, low: float | None = 0.01, high: float = 0.99) -> DataFrame:
    """Cumulative share of sales by clipped units, for each promotion label."""
    counts = _clipped_counts(fact, low, high)
    return counts.select(
        "promo_label",
        "units_clipped",
        share(F.col("n_through"), F.col("n_total")).alias("cumulative_share"),
    )


def promo_medians(fact: DataFrame, low: float | None = 0.01, high: float = 0.99) -> DataFrame:
    """Median of clipped units for each promotion label."""
    counts = _clipped_counts(fact, low, high)
    return quantiles_of(counts, ["promo_label"], "units_clipped", {"median_units": 0.5})


def row_sample(df: DataFrame, rows: int, seed: int = 42) -> DataFrame:
    """Exactly ``rows`` rows (all if there are fewer), chosen by a hash of their values.

    The same rows come out under any partitioning. Rows are spread over 2**20 hash
    buckets; whole buckets are kept by a filter, without a shuffle, and only the
    bucket at the edge is ordered. There, equal rows are counted first and as many
    copies are written back as are still wanted.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(f"{seed}|"), text))).withColumn(
        "_bucket", F.substring("_hash", 1, 5)
    )
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    running = sizes.select(
        "_bucket", F.sum("_n").over(Window.orderBy("_bucket")).alias("_through"), "_n"
    )
    fits = F.col("_through") <= rows
    edge = running.agg(
        F.min(F.when(~fits, F.col("_bucket"))).alias("bucket"),
        F.coalesce(F.max(F.when(fits, F.col("_through"))), F.lit(0)).alias("kept"),
    )
    last = edge.select("bucket").scalar()
    sure = hashed.filter(last.isNull() | (F.col("_bucket") < last)).select(*df.columns)
    copies = (
        hashed.filter(F.col("_bucket") == last)
        .groupBy(*df.columns, "_hash")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_through", F.sum("_n").over(Window.orderBy("_hash", *df.columns)))
    )
    wanted = F.lit(rows) - edge.select("kept").scalar() - (F.col("_through") - F.col("_n"))
    written = copies.withColumn("_take", F.least(F.col("_n"), wanted)).filter(F.col("_take") > 0)
    spread = written.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_take"))))
    return sure.unionByName(spread.select(*df.columns))
