"""Cannibalization report straight from the raw tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.config import CampaignPlan
from shelfwise.functions.joins import attach
from shelfwise.functions.lineage import pin
from shelfwise.operators import campaign
from shelfwise.operators.enrich import canonical_sales, product_classes, store_clusters


def panel(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Same result as :func:`shelfwise.operators.campaign.cross_class_panel` on the fact.

    A sale needs only its class before the sum. The cluster belongs to the store and
    is joined to the summed rows; traffic, holidays and oil are not joined at all.
    """
    sales = canonical_sales(tables["sales"]).select(
        "store_id", "product_id", "date", "units", "on_promotion"
    )
    classes = product_classes(tables["products"]).select("product_id", "product_class")
    classed = attach(sales, classes, ["product_id"]).dropna(
        subset=["store_id", "date", "product_class"]
    )
    rows = classed.groupBy("store_id", "date", "product_class").agg(
        F.coalesce(F.sum("units"), F.lit(0.0)).alias("units"),
        F.bool_or("on_promotion").alias("promo_active"),
    )
    clustered = attach(rows, store_clusters(tables["stores"]), ["store_id"])
    return campaign.with_other_classes(clustered.filter(F.col("cluster").isNotNull()))


def window(tables: Mapping[str, DataFrame], plan: CampaignPlan = CampaignPlan()) -> DataFrame:
    """Panel rows of all campaigns with role and period."""
    rows = panel(tables)
    return campaign.did_panel(rows, campaign.did_roles(rows, plan), plan)


def report(tables: Mapping[str, DataFrame], plan: CampaignPlan = CampaignPlan()) -> DataFrame:
    """Effect, interval, test and flag of every campaign.

    The panel is read for the roles and for the window, and the changes for every
    statistic, so both are written once and the sales are read once.
    """
    rows = pin(panel(tables), "panel")
    inside = campaign.did_panel(rows, campaign.did_roles(rows, plan), plan)
    changes = pin(campaign.did_store_change(inside), "changes")
    return campaign.did_effects(changes, plan)
