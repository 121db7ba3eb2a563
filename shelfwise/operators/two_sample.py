"""Comparison of two groups of days (or stores) inside every key.

Each statistic is a plain aggregate over all keys at once. Only the tail
probability runs as an Arrow function, on the result rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.functions.columns import pct_change, require_columns


def arm_moments(samples: DataFrame, keys: Sequence[str], arm: str, value: str) -> DataFrame:
    """Count, mean and sample variance of ``value`` in both arms, one row per key.

    ``arm`` is boolean; its true side gets suffix 1, its false side suffix 0.
    """
    require_columns(samples, [*keys, arm, value], "samples")
    aggregates: list[Column] = []
    for side, chosen in ((1, F.col(arm)), (0, ~F.col(arm))):
        x = F.when(chosen, F.col(value))
        aggregates += [
            F.count(x).alias(f"n_{side}"),
            F.avg(x).alias(f"mean_{side}"),
            F.var_samp(x).alias(f"var_{side}"),
        ]
    return samples.groupBy(*keys).agg(*aggregates)


def large_enough(moments: DataFrame, least: int) -> DataFrame:
    """Keys in which both arms have at least ``least`` values."""
    return moments.filter((F.col("n_1") >= least) & (F.col("n_0") >= least))


def uplift_columns() -> dict[str, Column]:
    return {
        "uplift_abs": F.col("mean_1") - F.col("mean_0"),
        "uplift_pct": pct_change(F.col("mean_1"), F.col("mean_0")),
    }


def welch_columns() -> dict[str, Column]:
    """Welch's t and its degrees of freedom; null when both variances are 0."""
    a, b = F.col("var_1") / F.col("n_1"), F.col("var_0") / F.col("n_0")
    freedom = F.try_divide(
        (a + b) * (a + b), a * a / (F.col("n_1") - 1) + b * b / (F.col("n_0") - 1)
    )
    return {
        "welch_t": F.try_divide(F.col("mean_1") - F.col("mean_0"), F.sqrt(a + b)),
        "welch_df": freedom,
    }


def cohens_d_column() -> Column:
    """Mean difference over the pooled deviation; null for tiny or constant arms."""
    w1, w0 = F.col("n_1") - 1, F.col("n_0") - 1
    pooled = F.sqrt(F.try_divide(w1 * F.col("var_1") + w0 * F.col("var_0"), w1 + w0))
    enough = (F.col("n_1") >= 2) & (F.col("n_0") >= 2)
    return F.when(enough, F.try_divide(F.col("mean_1") - F.col("mean_0"), pooled))


def average_ranks(samples: DataFrame, keys: Sequence[str], value: str, out: str = "rank") -> DataFrame:
    """Rank inside each key, equal values sharing the mean of their places."""
    order = Window.partitionBy(*keys).orderBy(value)
    equal = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return samples.withColumn(out, F.rank().over(order) + (equal - 1) / 2.0)


def rank_sums(samples: DataFrame, keys: Sequence[str], arm: str, value: str) -> DataFrame:
    """Mann-Whitney statistics per key: rank sum, U, tie term and corrected z.

    Values are counted per (key, value) first, so ties cost nothing: a value's
    members all beat the other arm's lower values and half of its equal ones. A key
    has at most two values per calendar day, which bounds its window.
    """
    require_columns(samples, [*keys, arm, value], "samples")
    counts = (
        samples.filter(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count_if(F.col(arm)).alias("_a"), F.count_if(~F.col(arm)).alias("_b"))
    )
    below = (
        Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    beaten = F.coalesce(F.sum("_b").over(below), F.lit(0)) + F.col("_b") / 2.0
    t = (F.col("_a") + F.col("_b")).cast("double")
    sums = (
        counts.withColumn("_u", F.col("_a") * beaten)
        .groupBy(*keys)
        .agg(
            F.sum("_a").alias("n_1"),
            F.sum("_b").alias("n_0"),
            F.sum("_u").alias("u_statistic"),
            F.sum(t * t * t - t).alias("tie_term"),
        )
    )
    n1, n0 = F.col("n_1").cast("double"), F.col("n_0").cast("double")
    n = n1 + n0
    spread = F.sqrt(n1 * n0 / 12.0 * ((n + 1) - F.try_divide(F.col("tie_term"), n * (n - 1))))
    larger = F.greatest(F.col("u_statistic"), n1 * n0 - F.col("u_statistic"))
    return sums.withColumns(
        {
            "rank_sum": F.col("u_statistic") + n1 * (n1 + 1) / 2.0,
            "mann_whitney_z": F.try_divide(larger - n1 * n0 / 2.0 - 0.5, spread),
        }
    )
