"""Residual diagnostics straight from the raw tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from shelfwise.functions.lineage import pin
from shelfwise.operators import residuals
from shelfwise.operators.features import covariates_of
from shelfwise.plans.segment_day import segment_daily_base


def covariates(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Filled segment-day series. The base table, one row per segment and day, is
    written once because the fills read it several times."""
    return covariates_of(pin(segment_daily_base(tables), "segment-days"))


def by_segment(tables: Mapping[str, DataFrame]) -> DataFrame:
    return residuals.residual_diagnostics(covariates(tables))


def overall(tables: Mapping[str, DataFrame]) -> DataFrame:
    return residuals.residual_diagnostics_overall(covariates(tables))
