"""Seeded random search over boosted-tree settings with a time-ordered split."""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.config import Roles, SearchSpace, TreeProfile
from shelfwise.models.dataset import Dataset
from shelfwise.models.trees import PARALLEL_FITS, tree_pipeline
from shelfwise.operators.evaluate import forecast_metrics

TRIAL_COLUMNS = (
    "trial int, trees int, depth int, step_size double, row_share double, "
    "feature_share double, mae double, rmse double, mape_pct double"
)


def sample_profiles(space: SearchSpace) -> list[TreeProfile]:
    """The settings of all trials, drawn independently per parameter."""
    draw = random.Random(space.seed)
    names = ("trees", "depth", "step_size", "row_share", "feature_share")
    return [
        TreeProfile(**{name: draw.choice(getattr(space, name)) for name in names}, seed=space.seed + t)
        for t in range(space.trials)
    ]


def random_search(
    data: Dataset, space: SearchSpace = SearchSpace(), tuning_days: int | None = 46
) -> DataFrame:
    """One row per trial with its settings and errors.

    Trials are fitted and stopped early on the days before the last ``tuning_days``
    of the train part and scored on those days, so the validation part stays unseen.
    ``tuning_days=None`` scores on the validation part instead. The trial table has
    as many rows as trials, so it is built on the driver.
    """
    roles: Roles = data.roles
    day = F.col(roles.date)
    if tuning_days is None:
        train, tune = data.train, data.valid
    else:
        edge = F.date_sub(data.train.agg(F.max(roles.date)).scalar(), tuning_days)
        train, tune = data.train.filter(day <= edge), data.train.filter(day > edge)
    marked = train.withColumn("_stop", F.lit(False)).unionByName(tune.withColumn("_stop", F.lit(True)))

    @inheritable_thread_target(data.frame.sparkSession)
    def run(job: tuple[int, TreeProfile]) -> tuple:
        number, profile = job
        model = tree_pipeline(data.features, roles, profile, False, early_stop="_stop").fit(marked)
        scored = model.transform(tune).select(roles.target, "prediction")
        errors = forecast_metrics(
            scored, {"trial": "prediction"}, target=roles.target, whole_error_fallback=True
        ).first()
        p = asdict(profile)
        settings = [p[n] for n in ("trees", "depth", "step_size", "row_share", "feature_share")]
        return (number, *settings, errors.mae, errors.rmse, errors.mape_pct)

    jobs = list(enumerate(sample_profiles(space)))
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        rows = list(pool.map(run, jobs))
    return data.frame.sparkSession.createDataFrame(rows, TRIAL_COLUMNS)


def best_trial(trials: DataFrame) -> DataFrame:
    """The trial with the lowest MAE, its settings as a nested column."""
    settings = F.struct("trees", "depth", "step_size", "row_share", "feature_share").alias("params")
    return trials.orderBy("mae", "trial").limit(1).select("trial", "mae", "rmse", "mape_pct", settings)
