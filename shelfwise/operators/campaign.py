"""Did a promotion of one class take demand from the other classes of the store?

Difference in differences over all (cluster, product class) pairs at once: treated
stores promote the class often, control stores hardly, and the outcome is the units
of the store's other classes before and after the first promotion day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import CampaignPlan
from shelfwise.functions.columns import flag, require_columns
from shelfwise.functions.ordered import number_rows
from shelfwise.functions.tails import t_two_sided
from shelfwise.operators.bootstrap import mean_difference_interval
from shelfwise.operators.two_sample import arm_moments, welch_columns

PAIR = ["cluster", "product_class"]
UNIT = [*PAIR, "store_id"]
FACT_COLUMNS = ["date", "store_id", "cluster", "product_class", "units", "on_promotion"]


def store_class_days(fact: DataFrame) -> DataFrame:
    """Units and promotion per store, class and day."""
    require_columns(fact, FACT_COLUMNS, "fact")
    return (
        fact.filter(F.col("cluster").isNotNull() & F.col("product_class").isNotNull())
        .filter(F.col("store_id").isNotNull() & F.col("date").isNotNull())
        .groupBy("cluster", "store_id", "date", "product_class")
        .agg(
            F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"),
            F.bool_or(flag(F.col("on_promotion"))).alias("promo_active"),
        )
    )


def with_other_classes(rows: DataFrame) -> DataFrame:
    """Add the units of the store's other classes on the day.

    The window holds the classes of one store on one day.
    """
    store_day = Window.partitionBy("cluster", "store_id", "date")
    total = F.sum("units").over(store_day)
    return rows.withColumn("store_day_total_units", total).withColumn(
        "other_class_units", F.col("store_day_total_units") - F.col("units")
    )


def cross_class_panel(fact: DataFrame) -> DataFrame:
    """Units per store, class and day with the units of the store's other classes."""
    return with_other_classes(store_class_days(fact))


def promo_days(panel: DataFrame) -> DataFrame:
    """Days on promotion and the first of them per cluster, class and store."""
    active = F.col("promo_active")
    return panel.groupBy(*UNIT).agg(
        F.count_if(active).alias("promo_days"),
        F.min(F.when(active, F.col("date"))).alias("first_promo_date"),
    )


def did_roles(panel: DataFrame, plan: CampaignPlan = CampaignPlan()) -> DataFrame:
    """Treated and control stores of the pairs that have enough of both.

    Every row carries the start of the pair's campaign: the first promotion day of
    any treated store. Works on one row per store and class.
    """
    days = F.col("promo_days")
    role = F.when(days >= plan.min_promo_days, "treated").when(
        days <= plan.max_control_promo_days, "control"
    )
    stores = promo_days(panel).withColumn("role", role).filter(F.col("role").isNotNull())
    treated = F.col("role") == "treated"
    pairs = (
        stores.groupBy(*PAIR)
        .agg(
            F.count_if(treated).alias("_treated"),
            F.count_if(~treated).alias("_control"),
            F.min(F.when(treated, F.col("first_promo_date"))).alias("campaign_start"),
        )
        .filter((F.col("_treated") >= plan.min_stores) & (F.col("_control") >= plan.min_stores))
        .filter(F.col("campaign_start").isNotNull())
        .drop("_treated", "_control")
    )
    return stores.select(*UNIT, "role", "promo_days").join(pairs, PAIR)


def did_panel(panel: DataFrame, roles: DataFrame, plan: CampaignPlan = CampaignPlan()) -> DataFrame:
    """Panel rows of treated and control stores inside the campaign window.

    The join key is the store and class, which has one row per day, so no key is hot.
    """
    start = F.col("campaign_start")
    inside = (F.col("date") >= F.date_sub(start, plan.pre_days)) & (
        F.col("date") <= F.date_add(start, plan.post_days - 1)
    )
    rows = panel.select(*UNIT, "date", "other_class_units")
    joined = rows.join(roles.select(*UNIT, "role", "campaign_start"), UNIT).filter(inside)
    return joined.withColumn("period", F.when(F.col("date") < start, "pre").otherwise("post"))


def did_store_change(window: DataFrame) -> DataFrame:
    """Mean of other-class units before and after per store; stores with both only."""
    def mean_in(period: str):
        return F.avg(F.when(F.col("period") == period, F.col("other_class_units")))

    means = window.groupBy(*UNIT, "role", "campaign_start").agg(
        mean_in("pre").alias("pre"), mean_in("post").alias("post")
    )
    return means.dropna(subset=["pre", "post"]).withColumn("change", F.col("post") - F.col("pre"))


def did_effects(changes: DataFrame, plan: CampaignPlan = CampaignPlan()) -> DataFrame:
    """Effect, interval, test and flag per pair with enough stores in both arms."""
    arms = changes.withColumn("_treated", F.col("role") == "treated")
    treated = F.col("_treated")
    keys = [*PAIR, "campaign_start"]
    moments = arm_moments(arms, keys, "_treated", "change").filter(
        (F.col("n_1") >= plan.min_stores) & (F.col("n_0") >= plan.min_stores)
    )
    levels = arms.groupBy(*keys).agg(
        F.avg(F.when(treated, F.col("pre"))).alias("treated_pre_mean_other_class_units"),
        F.avg(F.when(treated, F.col("post"))).alias("treated_post_mean_other_class_units"),
        F.avg(F.when(~treated, F.col("pre"))).alias("control_pre_mean_other_class_units"),
        F.avg(F.when(~treated, F.col("post"))).alias("control_post_mean_other_class_units"),
    )
    numbered = number_rows(arms, [*keys, "_treated"], "store_id", "_position")
    interval = mean_difference_interval(
        numbered,
        keys,
        "_treated",
        "_position",
        "change",
        plan.replicates,
        plan.seed,
        plan.alpha,
        plan.draw_hash,
    )
    base = F.col("control_pre_mean_other_class_units")
    effect = F.col("did_effect_other_class_units")
    tested = (
        moments.withColumns(welch_columns())
        .join(levels, keys)
        .join(interval, keys)
        .withColumn("did_effect_other_class_units", F.col("mean_1") - F.col("mean_0"))
        .withColumn("did_pct_of_control_pre", F.lit(100.0) * F.try_divide(effect, base))
        .withColumn("welch_t_pvalue", t_two_sided(F.col("welch_t"), F.col("welch_df")))
    )
    found = (effect < 0) & (F.col("ci_high") < 0) & (F.col("welch_t_pvalue") < 0.05)
    return tested.select(
        *keys,
        F.col("n_1").alias("n_treated_stores"),
        F.col("n_0").alias("n_control_stores"),
        "treated_pre_mean_other_class_units",
        "treated_post_mean_other_class_units",
        "control_pre_mean_other_class_units",
        "control_post_mean_other_class_units",
        effect,
        "did_pct_of_control_pre",
        F.col("ci_low").alias("did_ci95_low"),
        F.col("ci_high").alias("did_ci95_high"),
        "welch_t_pvalue",
        F.coalesce(found, F.lit(False)).alias("cannibalization_flag"),
    )
