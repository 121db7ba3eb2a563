"""Count-distribution diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import require_columns, share

ALL_ROWS = "row_level_overall"


def _moment_parts(units: str) -> list[Column]:
    x = F.col(units).cast("double")
    return [
        F.count(x).alias("_n"),
        F.avg(x).alias("_mean"),
        F.var_pop(x).alias("_var"),
        F.count_if(x == 0).alias("_zero"),
    ]


def _statistics() -> dict[str, Column]:
    mean, variance = F.col("mean_units"), F.col("variance_units")
    positive = mean > 0
    alpha = F.greatest((variance - mean) / (mean * mean), F.lit(0.0))
    return {
        "dispersion_ratio": F.when(positive, variance / mean),
        "poisson_expected_zero_rate": F.when(mean >= 0, F.exp(-mean)),
        "nb_alpha_estimate": F.when(positive & variance.isNotNull(), alpha),
    }


def count_diagnostics(fact: DataFrame, segment: str = "cluster", units: str = "units") -> DataFrame:
    """Dispersion and zero rate of units, for all rows and for each segment.

    The fact is aggregated once, by segment; the moments of all rows are combined
    from the segments' counts, means and variances.
    """
    require_columns(fact, [segment, units], "fact")
    parts = fact.filter(F.col(units).isNotNull()).groupBy(segment).agg(*_moment_parts(units))
    n, mean = F.col("_n"), F.col("_mean")
    # The grand mean first, then squared distances from it: differences of large squares would
    # lose the variance of large values. One row per segment is read here.
    grand = parts.agg(F.sum(n * mean) / F.sum(n)).scalar()
    away = mean - F.col("_grand")
    total = (
        parts.withColumn("_grand", grand)
        .agg(
            F.sum(n).alias("_n"),
            F.max("_grand").alias("_mean"),
            (F.sum(n * (F.col("_var") + away * away)) / F.sum(n)).alias("_var"),
            F.sum("_zero").alias("_zero"),
        )
    ).select(
        F.lit(ALL_ROWS).alias("scope"),
        F.lit(None).cast(fact.schema[segment].dataType).alias(segment),
        "_n",
        "_mean",
        "_var",
        "_zero",
    )
    each = parts.filter(F.col(segment).isNotNull()).select(
        F.lit("segment").alias("scope"), segment, "_n", "_mean", "_var", "_zero"
    )
    stats = total.unionByName(each).select(
        "scope",
        segment,
        F.col("_n").alias("n_obs"),
        F.col("_mean").alias("mean_units"),
        F.when(n > 1, F.col("_var") * n / (n - 1)).alias("variance_units"),
        share(F.col("_zero"), n).alias("observed_zero_rate"),
    )
    stats = stats.withColumns(_statistics())
    gap = F.col("observed_zero_rate") - F.col("poisson_expected_zero_rate")
    ratio = F.col("dispersion_ratio")
    return stats.withColumns(
        {
            "zero_inflation_gap": gap,
            "poisson_suitable_flag": F.coalesce((ratio <= 1.2) & (F.abs(gap) <= 0.02), F.lit(False)),
            "negbin_preferred_flag": F.coalesce(
                ratio.isNotNull() & ((ratio > 1.2) | (gap > 0.02)), F.lit(False)
            ),
        }
    )
