"""Boosted trees on the supervised frame: holdout, backtest, importance.

Lag features of validation days use the actual values before each day, so the
scores are one step ahead. They must not be compared with the recursive forecasts
of :mod:`shelfwise.models.seasonal` as equals.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.config import STANDARD_TREES, FoldPlan, Roles, TreeProfile
from shelfwise.functions.lineage import pin
from shelfwise.models.dataset import Dataset, Scored, with_naive
from shelfwise.operators.evaluate import fold_boundaries, fold_metrics, forecast_metrics
from shelfwise.operators.features import feature_columns

PARALLEL_FITS = 4
BINS = 64


def tree_pipeline(
    features: list[str],
    roles: Roles,
    profile: TreeProfile,
    categorical: bool,
    early_stop: str | None = None,
    bins: int = BINS,
) -> Pipeline:
    """Assembler and boosted trees; ``categorical`` treats the segment as a category.

    ``early_stop`` names a boolean column that marks rows for early stopping. ``bins``
    must be at least the number of segments when they are categories.
    """
    stages, inputs = [], list(features)
    if categorical:
        stages.append(
            StringIndexer(inputCol=roles.segment, outputCol="_segment", handleInvalid="keep")
        )
        inputs = ["_segment" if name == roles.segment else name for name in features]
    trees = GBTRegressor(
        featuresCol="_features",
        labelCol=roles.target,
        maxIter=profile.trees,
        maxDepth=profile.depth,
        stepSize=profile.step_size,
        subsamplingRate=profile.row_share,
        featureSubsetStrategy=str(profile.feature_share),
        minInstancesPerNode=profile.min_rows_per_node,
        minInfoGain=profile.min_gain,
        seed=profile.seed,
        maxBins=bins,
    )
    if early_stop:
        trees = trees.setValidationIndicatorCol(early_stop)
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=inputs, outputCol="_features"), trees])


def _predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    scored = model.transform(rows)
    return scored.select(*rows.columns, "prediction")


def importance_table(spark: SparkSession, model: PipelineModel, features: list[str]) -> DataFrame:
    """Importance per feature, one row each."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(name, float(value)) for name, value in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def holdout(
    data: Dataset,
    profile: TreeProfile = STANDARD_TREES,
    name: str = "gbt_cluster_daily",
    categorical: bool = False,
) -> Scored:
    """Fit on the train part and score the validation part."""
    bins = BINS
    if categorical:
        bins = max(BINS, data.train.select(data.roles.segment).distinct().count() + 1)
    pipeline = tree_pipeline(data.features, data.roles, profile, categorical, bins=bins)
    model = pipeline.fit(data.train)
    predictions = _predict(model, data.valid)
    spark = data.frame.sparkSession
    return Scored(
        name,
        predictions,
        with_naive(name, predictions, data.roles),
        importance_table(spark, model, data.features),
        model,
    )


def backtest(
    frame: DataFrame,
    plan: FoldPlan = FoldPlan(),
    profile: TreeProfile = STANDARD_TREES,
    roles: Roles = Roles(),
    name: str = "gbt_cluster_daily",
    written: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Fold metrics per horizon (model and naive rule) and errors per fold and split.

    One fit per fold, a few at a time; every fit is a set of Spark jobs over the
    written frame. The number of folds is a parameter, so reading the boundaries on
    the driver is bounded.
    """
    table = frame if written else pin(frame, "frame")
    features = feature_columns(table, roles)
    day = F.col(roles.date)
    session = table.sparkSession

    @inheritable_thread_target(session)
    def run(fold) -> DataFrame:
        end = F.lit(fold.train_end_date)
        train = table.filter(day <= end)
        model = tree_pipeline(features, roles, profile, False).fit(train)
        rows = table.filter(day <= F.lit(fold.eval_end_date))
        return _predict(model, rows).select(
            roles.segment,
            roles.date,
            roles.target,
            "lag_7",
            "prediction",
            F.lit(fold.fold).alias("fold"),
            end.alias("train_end_date"),
            F.lit(fold.eval_end_date).alias("eval_end_date"),
            F.when(day <= end, "train").otherwise("eval").alias("split"),
        )

    folds = fold_boundaries(table, plan, roles.date).collect()
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        parts = list(pool.map(run, folds))
    scored = pin(reduce(DataFrame.unionByName, parts), "folds")
    wanted = F.array(*[F.lit(h) for h in sorted(set(plan.horizons))])
    ahead = F.datediff(day, "train_end_date")
    by_horizon = scored.filter(F.col("split") == "eval").withColumn(
        "horizon_days", F.explode(F.filter(wanted, lambda h: ahead <= h))
    )
    models = {name: "prediction", "seasonal_naive_7d": "lag_7"}
    keys = ["fold", "train_end_date", "eval_end_date", "split"]
    return (
        fold_metrics(by_horizon, models, roles.target),
        forecast_metrics(scored, {name: "prediction"}, keys, roles.target),
    )
