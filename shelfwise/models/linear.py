"""Elastic-net regression on the supervised frame."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.models.dataset import Dataset, Scored, with_naive


def _as_doubles(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumns({name: F.col(name).cast("double") for name in names})


def elastic_pipeline(
    numeric: list[str], segment: str, target: str, alpha: float, l1_ratio: float, iterations: int
) -> Pipeline:
    """Median fill and scaling of numbers, one column per segment, elastic net.

    A null segment or one not seen in training gets its own column.
    """
    filled = [f"_{name}" for name in numeric]
    return Pipeline(
        stages=[
            Imputer(inputCols=numeric, outputCols=filled, strategy="median"),
            VectorAssembler(inputCols=filled, outputCol="_numbers"),
            StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True),
            StringIndexer(inputCol=segment, outputCol="_index", handleInvalid="keep"),
            OneHotEncoder(
                inputCol="_index", outputCol="_onehot", dropLast=False, handleInvalid="keep"
            ),
            VectorAssembler(inputCols=["_scaled", "_onehot"], outputCol="_features"),
            LinearRegression(
                featuresCol="_features",
                labelCol=target,
                regParam=alpha,
                elasticNetParam=l1_ratio,
                maxIter=iterations,
                standardization=False,
            ),
        ]
    )


def holdout(
    data: Dataset,
    alpha: float = 0.1,
    l1_ratio: float = 0.2,
    iterations: int = 1000,
    name: str = "elasticnet_cluster_daily",
) -> Scored:
    """Fit on the train part and score the validation part."""
    roles = data.roles
    numeric = [f for f in data.features if f != roles.segment]
    pipeline = elastic_pipeline(numeric, roles.segment, roles.target, alpha, l1_ratio, iterations)
    model = pipeline.fit(_as_doubles(data.train, numeric))
    scored = model.transform(_as_doubles(data.valid, numeric))
    predictions = scored.select(*data.valid.columns, "prediction")
    return Scored(name, predictions, with_naive(name, predictions, roles), None, model)
