"""Promotion and holiday effects by segment, from a segment-day table to the report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import Roles, TestPlan
from shelfwise.functions.columns import require_columns
from shelfwise.functions.lineage import pin
from shelfwise.functions.ordered import exact_quantiles
from shelfwise.functions.tails import normal_two_sided_upper, t_two_sided
from shelfwise.operators import fdr
from shelfwise.operators.bootstrap import mean_difference_interval
from shelfwise.operators.two_sample import (
    arm_moments,
    cohens_d_column,
    large_enough,
    rank_sums,
    uplift_columns,
    welch_columns,
)
from shelfwise.plans import segment_day

EVENT_FLAGS = {"promotion": "on_promotion", "holiday": "is_holiday_event"}


def _interval(samples: DataFrame, keys: list[str], arm: str, roles: Roles, plan: TestPlan) -> DataFrame:
    """Bootstrap interval over days; an arm has at most one value per calendar day."""
    place = F.row_number().over(Window.partitionBy(*keys, arm).orderBy(roles.date)) - 1
    return mean_difference_interval(
        samples.withColumn("_position", place),
        keys,
        arm,
        "_position",
        roles.target,
        plan.replicates,
        plan.seed,
        plan.alpha,
        plan.draw_hash,
        bounded=True,
    )


def promo_effects(days: DataFrame, roles: Roles = Roles(), plan: TestPlan = TestPlan()) -> DataFrame:
    """Means, uplift, Cohen's d and Welch's t of promotion days per segment."""
    moments = large_enough(
        arm_moments(days, [roles.segment], roles.promo, roles.target), plan.min_days
    )
    return moments.withColumns({**uplift_columns(), **welch_columns(), "cohens_d": cohens_d_column()})


def promo_tests(
    days: DataFrame, roles: Roles = Roles(), plan: TestPlan = TestPlan()
) -> DataFrame:
    """Effect, tests and interval of promotion days, one row per segment."""
    require_columns(days, [roles.segment, roles.date, roles.promo, roles.target], "segment days")
    segment = roles.segment
    effects = promo_effects(days, roles, plan)
    wanted = days.join(effects.select(segment), segment, "left_semi")
    ranks = rank_sums(wanted, [segment], roles.promo, roles.target).select(segment, "mann_whitney_z")
    interval = _interval(wanted, [segment], roles.promo, roles, plan)
    return (
        effects.join(ranks, segment)
        .join(interval, segment)
        .withColumn("welch_t_pvalue", t_two_sided(F.col("welch_t"), F.col("welch_df")))
        .withColumn("mannwhitney_pvalue", normal_two_sided_upper(F.col("mann_whitney_z")))
    )


def promo_corrected(
    tests: DataFrame, roles: Roles = Roles(), plan: TestPlan = TestPlan()
) -> DataFrame:
    """The report of :func:`promo_tests` with adjusted p-values and flags."""
    adjusted = fdr.adjust(tests, "welch_t_pvalue", out="welch_fdr_qvalue")
    level = F.lit(plan.fdr_level)
    return adjusted.select(
        roles.segment,
        F.col("n_1").alias("n_days_promo"),
        F.col("n_0").alias("n_days_nonpromo"),
        F.col("mean_1").alias("mean_promo"),
        F.col("mean_0").alias("mean_nonpromo"),
        "uplift_abs",
        "uplift_pct",
        "cohens_d",
        "welch_t_pvalue",
        "mannwhitney_pvalue",
        F.col("ci_low").alias("mean_diff_ci95_low"),
        F.col("ci_high").alias("mean_diff_ci95_high"),
        F.coalesce(F.col("welch_t_pvalue") < level, F.lit(False)).alias("significant_0_05"),
        "welch_fdr_qvalue",
        F.coalesce(F.col("welch_fdr_qvalue") < level, F.lit(False)).alias("significant_fdr_0_05"),
    )


def promo_significance(
    days: DataFrame, roles: Roles = Roles(), plan: TestPlan = TestPlan()
) -> DataFrame:
    """Promotion effect per segment on the mean units per sale.

    ``days`` has one row per segment, day and promotion flag.
    """
    return promo_corrected(promo_tests(days, roles, plan), roles, plan)


def action_tests(
    days: DataFrame, roles: Roles = Roles(), plan: TestPlan = TestPlan()
) -> DataFrame:
    """Effect, test and interval per event type and segment.

    Both flags are tested in one plan, as two event types.
    """
    names = [roles.segment, roles.date, roles.target, roles.promo, roles.holiday]
    require_columns(days, names, "segment days")
    keys = ["event_type", roles.segment]
    flags = F.array(
        F.struct(F.lit("promotion").alias("event_type"), F.col(roles.promo).alias("_event")),
        F.struct(F.lit("holiday").alias("event_type"), F.col(roles.holiday).alias("_event")),
    )
    long = days.select(roles.segment, roles.date, roles.target, F.inline(flags))
    moments = large_enough(arm_moments(long, keys, "_event", roles.target), plan.min_days)
    effects = moments.withColumns(
        {**uplift_columns(), **welch_columns(), "cohens_d": cohens_d_column()}
    )
    wanted = long.join(effects.select(*keys), keys, "left_semi")
    return effects.join(_interval(wanted, keys, "_event", roles, plan), keys).withColumn(
        "welch_t_pvalue", t_two_sided(F.col("welch_t"), F.col("welch_df"))
    )


def action_corrected(
    tests: DataFrame, roles: Roles = Roles(), plan: TestPlan = TestPlan()
) -> DataFrame:
    """The report of :func:`action_tests`, adjusted within event types, with flags."""
    adjusted = fdr.adjust(tests, "welch_t_pvalue", ["event_type"])
    significant = F.coalesce(F.col("fdr_qvalue") < plan.fdr_level, F.lit(False))
    actionable = (
        significant
        & (F.col("ci_low") > 0)
        & F.coalesce(F.col("uplift_pct") >= plan.actionable_uplift_pct, F.lit(False))
    )
    return adjusted.select(
        "event_type",
        roles.segment,
        F.col("n_1").alias("n_event_days"),
        F.col("n_0").alias("n_non_event_days"),
        F.col("mean_1").alias("mean_event"),
        F.col("mean_0").alias("mean_non_event"),
        "uplift_abs",
        "uplift_pct",
        "cohens_d",
        "welch_t_pvalue",
        F.col("ci_low").alias("mean_diff_ci95_low"),
        F.col("ci_high").alias("mean_diff_ci95_high"),
        "fdr_qvalue",
        significant.alias("significant_fdr_0_05"),
        actionable.alias("actionable_positive_flag"),
    )


def action_effects(
    days: DataFrame, roles: Roles = Roles(), plan: TestPlan = TestPlan()
) -> DataFrame:
    """Promotion and holiday effects per segment on the total units per day.

    ``days`` has one row per segment and day with "any sale" flags.
    """
    return action_corrected(action_tests(days, roles, plan), roles, plan)


def promotion_report(tables: Mapping[str, DataFrame], plan: TestPlan = TestPlan()) -> DataFrame:
    """Promotion report from the raw tables.

    Every statistic reads the segment-day table and the correction reads the tests
    twice, so both, a few thousand rows and one row per segment, are written once.
    """
    days = pin(segment_day.segment_day_promo(tables), "promo-days")
    return promo_corrected(pin(promo_tests(days, plan=plan), "promo-tests"), plan=plan)


def action_report(tables: Mapping[str, DataFrame], plan: TestPlan = TestPlan()) -> DataFrame:
    """Promotion and holiday report from the raw tables."""
    days = pin(segment_day.segment_day_any(tables), "event-days")
    return action_corrected(pin(action_tests(days, plan=plan), "action-tests"), plan=plan)


def significance_rollup(
    results: DataFrame, flag: str, measure: str, keys: list[str] | None = None
) -> DataFrame:
    """Number of results, number flagged and median of the measure, per key."""
    by = list(keys or [])
    counts = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_results"), F.count_if(F.col(flag)).alias("n_flagged")
    )
    median = exact_quantiles(results, by, measure, {"median_value": 0.5})
    if by:
        return counts.join(median, by, "left")
    return counts.withColumn("median_value", median.scalar())
