"""Parameters of the operators. Every default can be overridden per call."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Roles:
    """Names of the columns an operator works on."""

    target: str = "units"
    date: str = "date"
    segment: str = "cluster"
    promo: str = "on_promotion"
    holiday: str = "is_holiday_event"
    oil: str = "oil_price"
    transactions: str = "store_transactions"

    def training_columns(self) -> list[str]:
        return [
            self.date,
            self.segment,
            self.target,
            self.promo,
            self.holiday,
            self.oil,
            self.transactions,
        ]


@dataclass(frozen=True)
class TestPlan:
    """Two-sample test settings."""

    __test__ = False

    min_days: int = 30
    replicates: int = 1000
    seed: int = 42
    alpha: float = 0.05
    fdr_level: float = 0.05
    actionable_uplift_pct: float = 5.0
    draw_hash: str = "xxhash64"


@dataclass(frozen=True)
class CampaignPlan:
    """Difference-in-differences settings."""

    pre_days: int = 28
    post_days: int = 28
    min_promo_days: int = 14
    max_control_promo_days: int = 3
    min_stores: int = 2
    replicates: int = 500
    seed: int = 42
    alpha: float = 0.05
    draw_hash: str = "xxhash64"


@dataclass(frozen=True)
class FoldPlan:
    """Rolling-origin folds. Steps count positions in the sorted list of dates;
    horizons count calendar days after the end of training."""

    folds: int = 5
    step: int = 28
    horizons: tuple[int, ...] = (7, 14, 28)
    min_train: int = 180

    @property
    def longest(self) -> int:
        return max(self.horizons)


@dataclass(frozen=True)
class ScenarioPlan:
    """Coefficients of the what-if projection."""

    oil_elasticity: float = 0.12
    holiday_lift: float = 0.11


@dataclass(frozen=True)
class TreeProfile:
    """Boosted-tree settings in the terms of Spark ML."""

    trees: int = 500
    depth: int = 8
    step_size: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    min_rows_per_node: int = 1
    min_gain: float = 0.0
    seed: int = 42


# The boosted-tree settings the published figures were made with.
STANDARD_TREES = TreeProfile()
REGULARIZED_TREES = TreeProfile(
    depth=5, row_share=0.7, feature_share=0.7, min_rows_per_node=10, min_gain=2.0
)


@dataclass(frozen=True)
class SearchSpace:
    """Value lists of the random search, one per tree parameter."""

    trees: tuple[int, ...] = (200, 500, 800)
    depth: tuple[int, ...] = (6, 8)
    step_size: tuple[float, ...] = (0.01, 0.05, 0.1)
    row_share: tuple[float, ...] = (0.6, 0.8, 1.0)
    feature_share: tuple[float, ...] = (0.6, 0.8, 1.0)
    trials: int = 6
    seed: int = 42


DEEP_SEARCH = SearchSpace(
    trees=(500, 800, 1000), depth=(6, 8, 10), step_size=(0.01, 0.03, 0.05), trials=30
)


@dataclass(frozen=True)
class SeasonalOrder:
    """Non-seasonal (p, d, q) and seasonal (P, D, Q) orders with a weekly period."""

    p: int = 1
    d: int = 0
    q: int = 1
    sp: int = 1
    sd: int = 0
    sq: int = 1
    period: int = 7

    @property
    def label(self) -> str:
        return f"({self.p},{self.d},{self.q})x({self.sp},{self.sd},{self.sq},{self.period})"


# The order grid of the per-segment search, first entry is the default order.
ORDER_GRID = (
    SeasonalOrder(1, 0, 1, 1, 0, 1),
    SeasonalOrder(1, 1, 1, 1, 0, 1),
    SeasonalOrder(0, 1, 1, 0, 1, 1),
    SeasonalOrder(1, 0, 1, 0, 1, 1),
    SeasonalOrder(2, 0, 1, 1, 0, 1),
    SeasonalOrder(1, 0, 2, 1, 0, 1),
)

# The short grid without a seasonal part.
SHORT_ORDER_GRID = (
    SeasonalOrder(0, 0, 0, 0, 0, 0),
    SeasonalOrder(1, 0, 0, 0, 0, 0),
    SeasonalOrder(1, 1, 0, 0, 0, 0),
    SeasonalOrder(0, 1, 1, 0, 0, 0),
    SeasonalOrder(1, 1, 1, 0, 0, 0),
)


@dataclass(frozen=True)
class ForecastColumns:
    """Outside inputs of the per-segment forecaster."""

    names: tuple[str, ...] = field(
        default=(
            "promo_rate",
            "holiday_rate",
            "oil_price",
            "avg_store_transactions",
            "day_of_week",
            "month",
            "is_month_start",
            "is_month_end",
        )
    )
