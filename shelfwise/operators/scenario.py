"""What-if projection of daily demand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.config import ScenarioPlan
from shelfwise.functions.columns import require_columns


def project(
    effects: DataFrame,
    scenarios: list[tuple[str, float, float, bool]],
    plan: ScenarioPlan = ScenarioPlan(),
    base: str = "mean_nonpromo",
    uplift_pct: str = "uplift_pct",
) -> DataFrame:
    """Expected units of every row of ``effects`` under every scenario.

    A scenario is (name, share of items on promotion, oil price change as a fraction,
    holiday). The list is a literal array that each row explodes, so nothing shuffles.
    """
    require_columns(effects, [base, uplift_pct], "effects")
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("scenario"),
                F.lit(float(intensity)).alias("promo_intensity"),
                F.lit(float(oil)).alias("oil_change"),
                F.lit(bool(holiday)).alias("holiday"),
            )
            for name, intensity, oil, holiday in scenarios
        ]
    )
    lift = (
        F.col("promo_intensity") * F.col(uplift_pct) / 100.0
        - F.col("oil_change") * plan.oil_elasticity
        + F.when(F.col("holiday"), plan.holiday_lift).otherwise(0.0)
    )
    return (
        effects.withColumn("_s", F.explode(rows))
        .select(*effects.columns, "_s.*")
        .withColumn("total_lift", lift)
        .withColumn("estimated_units", F.col(base) * (1 + F.col("total_lift")))
    )
