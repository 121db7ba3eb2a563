"""Train and validation parts of a supervised frame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.config import Roles
from shelfwise.functions.lineage import pin
from shelfwise.operators.evaluate import forecast_metrics
from shelfwise.operators.features import feature_columns
from shelfwise.sources.sinks import prediction_extract

NAIVE_COLUMN = "lag_7"


@dataclass(frozen=True)
class Dataset:
    """A frame split by date. All frames are lazy reads of one written table."""

    roles: Roles
    frame: DataFrame
    train: DataFrame
    valid: DataFrame
    features: list[str]


@dataclass(frozen=True)
class Scored:
    """Predictions of a fitted model with their metrics next to the naive rule."""

    name: str
    predictions: DataFrame
    metrics: DataFrame
    importance: DataFrame | None = None
    model: object | None = None

    def extract(self, roles: Roles = Roles(), rows: int = 2000) -> DataFrame:
        columns = {
            roles.target: roles.target,
            NAIVE_COLUMN: "pred_seasonal_naive_7d",
            "prediction": f"pred_{self.name}",
        }
        return prediction_extract(self.predictions, columns, rows, roles.segment, roles.date)


def split(frame: DataFrame, cutoff: str, roles: Roles = Roles(), written: bool = False) -> Dataset:
    """Split at the cutoff date. The frame is written once unless it already is a table:
    a fit reads it many times."""
    table = frame if written else pin(frame, "frame")
    day, limit = F.col(roles.date), F.lit(cutoff).cast("date")
    return Dataset(
        roles,
        table,
        table.filter(day <= limit),
        table.filter(day > limit),
        feature_columns(table, roles),
    )


def with_naive(name: str, predictions: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Metrics of a model and of the seasonal naive rule on the same rows."""
    models = {name: "prediction", "seasonal_naive_7d": NAIVE_COLUMN}
    return forecast_metrics(predictions, models, target=roles.target)
