"""Segment-day series and the features of the supervised frame.

Aggregates run on the fact; windows run only on the aggregated series, where a
segment has one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import Roles
from shelfwise.functions.columns import (
    calendar_columns,
    fill_both_ways,
    flag,
    require_columns,
    to_number,
)

# Lags and rolling windows (rows, least rows) of the model frame.
LAGS = (7, 14, 28)
ROLLING_MEANS = ((7, 3), (28, 7))
ROLLING_STDS = ((28, 7),)


def _with_keys(fact: DataFrame, *names: str) -> DataFrame:
    out = fact
    for name in names:
        out = out.filter(F.col(name).isNotNull())
    return out


def segment_daily_base(fact: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Units, promotion and holiday rates, oil price and traffic per segment and day."""
    require_columns(fact, roles.training_columns(), "fact")
    kept = _with_keys(fact, roles.date, roles.segment, roles.target)
    return kept.groupBy(roles.segment, roles.date).agg(
        F.coalesce(F.sum(to_number(F.col(roles.target))), F.lit(0.0)).alias("units"),
        F.avg(flag(F.col(roles.promo)).cast("int")).alias("promo_rate"),
        F.avg(flag(F.col(roles.holiday)).cast("int")).alias("holiday_rate"),
        F.avg(to_number(F.col(roles.oil))).alias("oil_price"),
        F.avg(to_number(F.col(roles.transactions))).alias("avg_store_transactions"),
    )


def segment_daily_total(fact: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Units per segment and day."""
    require_columns(fact, [roles.date, roles.segment, roles.target], "fact")
    kept = _with_keys(fact, roles.date, roles.segment, roles.target)
    return kept.groupBy(roles.segment, roles.date).agg(F.sum(roles.target).alias(roles.target))


def segment_day_any(fact: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Units per segment and day, and whether any sale was on promotion or on a holiday."""
    names = [roles.date, roles.segment, roles.target, roles.promo, roles.holiday]
    require_columns(fact, names, "fact")
    kept = _with_keys(fact, roles.date, roles.segment)
    return kept.groupBy(roles.segment, roles.date).agg(
        F.coalesce(F.sum(roles.target), F.lit(0.0)).alias(roles.target),
        F.bool_or(flag(F.col(roles.promo))).alias(roles.promo),
        F.bool_or(flag(F.col(roles.holiday))).alias(roles.holiday),
    )


def segment_day_promo(fact: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Mean units per sale by segment, day and promotion flag."""
    names = [roles.date, roles.segment, roles.target, roles.promo]
    require_columns(fact, names, "fact")
    return (
        _with_keys(fact, *names)
        .groupBy(roles.segment, roles.date, roles.promo)
        .agg(F.avg(roles.target).alias(roles.target))
    )


def by_segment(roles: Roles = Roles()):
    return Window.partitionBy(roles.segment).orderBy(roles.date)


def add_calendar(series: DataFrame, roles: Roles = Roles()) -> DataFrame:
    require_columns(series, [roles.date], "series")
    return series.withColumns(calendar_columns(F.col(roles.date)))


def over_prior_rows(aggregate, value: Column, window, rows: int, least: int) -> Column:
    """``aggregate`` over the ``rows`` rows before the current one, null with fewer than ``least``."""
    frame = window.rowsBetween(-rows, -1)
    return F.when(F.count(value).over(frame) >= least, aggregate(value).over(frame))


def add_lags(series: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Values of the target 7, 14 and 28 rows earlier in the segment."""
    w = by_segment(roles)
    return series.withColumns({f"lag_{k}": F.lag(roles.target, k).over(w) for k in LAGS})


def add_rolling(series: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Rolling mean and sample deviation over the rows before the current one."""
    w, target = by_segment(roles), F.col(roles.target)
    columns = {
        f"rolling_mean_{n}": over_prior_rows(F.avg, target, w, n, least)
        for n, least in ROLLING_MEANS
    }
    for n, least in ROLLING_STDS:
        columns[f"rolling_std_{n}"] = over_prior_rows(F.stddev_samp, target, w, n, least)
    return series.withColumns(columns)


def model_frame_of(series: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Calendar, lag and rolling features on a segment-day series; incomplete rows dropped."""
    return add_rolling(add_lags(add_calendar(series, roles), roles), roles).dropna()


def model_frame(fact: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """The supervised frame of a fact."""
    return model_frame_of(segment_daily_base(fact, roles), roles)


def feature_columns(frame: DataFrame, roles: Roles = Roles()) -> list[str]:
    """All columns of the frame but the target and the date."""
    return [name for name in frame.columns if name not in (roles.target, roles.date)]


def covariates_of(series: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Segment-day series with filled covariates, weekday and month.

    Traffic and oil are carried forward and then backward inside the segment. A
    segment without any value takes the mean of the day over all segments, and
    then the mean over all days.
    """
    day = Window.partitionBy(roles.date)
    filled, names = series, ("avg_store_transactions", "oil_price")
    means = series.agg(F.struct(*[F.avg(name).alias(name) for name in names]).alias("m")).scalar()
    for name in names:
        filled = filled.withColumn(
            name,
            F.coalesce(fill_both_ways(F.col(name), roles.date, [roles.segment]), F.avg(name).over(day), means[name]),
        )
    out = filled.withColumns(
        {"day_of_week": F.weekday(roles.date), "month": F.month(roles.date)}
    )
    return out.dropna(
        subset=["units", "promo_rate", "holiday_rate", "avg_store_transactions", "oil_price"]
    )


def cluster_day_covariates(fact: DataFrame, roles: Roles = Roles()) -> DataFrame:
    return covariates_of(segment_daily_base(fact, roles), roles)
