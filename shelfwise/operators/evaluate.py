"""Forecast baselines, error metrics, folds and comparison tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import FoldPlan, Roles
from shelfwise.functions.columns import pct_change, require_columns
from shelfwise.operators.features import by_segment, over_prior_rows

NAIVE = "seasonal_naive_7d"
MOVING = "moving_avg_7d"
METRICS = ("mae", "rmse", "mape_pct")


def seasonal_naive(
    series: DataFrame, roles: Roles = Roles(), season: int = 7, out: str = "pred_seasonal_naive_7d"
) -> DataFrame:
    """The target ``season`` rows earlier in the segment."""
    require_columns(series, [roles.segment, roles.date, roles.target], "series")
    return series.withColumn(out, F.lag(roles.target, season).over(by_segment(roles)))


def moving_average(
    series: DataFrame, roles: Roles = Roles(), rows: int = 7, out: str = "pred_moving_avg_7d"
) -> DataFrame:
    """Mean of the target over up to ``rows`` rows before the current one."""
    require_columns(series, [roles.segment, roles.date, roles.target], "series")
    mean = over_prior_rows(F.avg, F.col(roles.target), by_segment(roles), rows, 1)
    return series.withColumn(out, mean)


def split_column(date: Column, cutoff: str) -> Column:
    """'train' up to and with the cutoff date, 'valid' after it."""
    return F.when(date <= F.lit(cutoff).cast("date"), "train").otherwise("valid")


def _error_sums(actual: Column, predicted: Column) -> list[Column]:
    error = actual - predicted
    relative = F.when(actual != 0, F.abs(error / actual))
    return [
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.abs(error)).alias("_abs"),
        F.sum(error * error).alias("_sq"),
        F.sum(relative).alias("_rel"),
        F.count(relative).alias("_n_rel"),
        F.sum(actual).alias("_actual"),
    ]


def _sums_per_model(
    scored: DataFrame, models: Mapping[str, str], keys: Sequence[str], target: str
) -> DataFrame:
    require_columns(scored, [*keys, target, *models.values()], "scored frame")
    entries = [
        F.struct(F.lit(name).alias("model"), F.col(column).cast("double").alias("_p"))
        for name, column in models.items()
    ]
    long = scored.select(*keys, F.col(target).alias("_y"), F.inline(F.array(*entries)))
    return (
        long.filter(F.col("_p").isNotNull() & F.col("_y").isNotNull())
        .groupBy("model", *keys)
        .agg(*_error_sums(F.col("_y"), F.col("_p")))
    )


def _finish(sums: DataFrame, keys: Sequence[str], fallback: bool = False) -> DataFrame:
    mape = F.lit(100.0) * F.try_divide(F.col("_rel"), F.col("_n_rel"))
    if fallback:
        weighted = F.lit(100.0) * F.col("_abs") / (F.col("_actual") + 1e-9 * F.col("_n"))
        mape = F.coalesce(mape, weighted)
    return sums.select(
        "model",
        *keys,
        (F.col("_abs") / F.col("_n")).alias("mae"),
        F.sqrt(F.col("_sq") / F.col("_n")).alias("rmse"),
        mape.alias("mape_pct"),
    )


def forecast_metrics(
    scored: DataFrame,
    models: Mapping[str, str],
    keys: Sequence[str] = (),
    target: str = "units",
    whole_error_fallback: bool = False,
) -> DataFrame:
    """MAE, RMSE and MAPE per model and key.

    ``models`` maps model names to prediction columns. Rows without a prediction are
    left out per model. MAPE ignores days with zero demand and is null if there is
    no other; ``whole_error_fallback`` then gives total error over total demand.
    """
    return _finish(_sums_per_model(scored, models, keys, target), keys, whole_error_fallback)


def metrics_with_total(
    scored: DataFrame, models: Mapping[str, str], segment: str = "cluster", target: str = "units"
) -> DataFrame:
    """Metrics per model and segment, and per model over all segments (segment null).

    The totals add up the segments' error sums.
    """
    each = _sums_per_model(scored, models, [segment], target)
    parts = [name for name in each.columns if name.startswith("_")]
    kind = scored.schema[segment].dataType
    total = (
        each.groupBy("model")
        .agg(*[F.sum(name).alias(name) for name in parts])
        .withColumn(segment, F.lit(None).cast(kind))
    )
    return _finish(each.unionByName(total), [segment])


def fold_array(dates: DataFrame, plan: FoldPlan = FoldPlan(), date: str = "date") -> DataFrame:
    """One row with the array of folds: fold, train_end_date, eval_end_date.

    The dates are one array entry per calendar day. Folds with too little history
    are left out, and the query fails if none is left.
    """
    listed = dates.agg(F.array_sort(F.collect_set(date)).alias("_dates"))
    n = F.size("_dates")
    numbers = F.sequence(F.lit(1), F.lit(plan.folds))

    def fold(k: Column) -> Column:
        end = n - 1 - (F.lit(plan.folds) - k) * F.lit(plan.step)
        start = end - F.lit(plan.longest)
        enough = (start >= F.lit(plan.min_train)) & (start >= 0)
        return F.when(
            enough,
            F.struct(
                k.alias("fold"),
                F.get("_dates", start).alias("train_end_date"),
                F.get("_dates", end).alias("eval_end_date"),
            ),
        )

    folds = F.filter(F.transform(numbers, fold), lambda f: f.isNotNull())
    failure = F.raise_error(F.lit("too little history for the requested folds and horizons"))
    built = listed.select(folds.alias("folds"))
    return built.select(F.when(F.size("folds") > 0, F.col("folds")).otherwise(failure).alias("folds"))


def fold_boundaries(dates: DataFrame, plan: FoldPlan = FoldPlan(), date: str = "date") -> DataFrame:
    """One row per fold: fold, train_end_date, eval_end_date."""
    return fold_array(dates, plan, date).select(F.inline("folds"))


def backtest_frame(
    frame: DataFrame, plan: FoldPlan = FoldPlan(), roles: Roles = Roles(), horizons: bool = False
) -> DataFrame:
    """Rows of the frame with every fold they belong to and their split.

    The folds come as an array of at most ``plan.folds`` entries that each row explodes,
    so no join is needed. With ``horizons`` only evaluation rows
    are kept, once for each horizon that covers them.
    """
    day = F.col(roles.date)
    folds = fold_array(frame.select(roles.date), plan, roles.date).scalar()
    with_fold = (
        frame.withColumn("_f", F.explode(folds))
        .filter(day <= F.col("_f.eval_end_date"))
        .select(*frame.columns, "_f.*")
    )
    split = F.when(day <= F.col("train_end_date"), "train").otherwise("eval")
    out = with_fold.withColumn("split", split)
    if not horizons:
        return out
    ahead = F.datediff(day, F.col("train_end_date"))
    wanted = F.array(*[F.lit(h) for h in sorted(set(plan.horizons))])
    return out.filter(F.col("split") == "eval").withColumn(
        "horizon_days", F.explode(F.filter(wanted, lambda h: ahead <= h))
    )


def fold_metrics(
    evaluated: DataFrame, models: Mapping[str, str], target: str = "units"
) -> DataFrame:
    """Metrics per fold, horizon and model of a frame with exploded horizons."""
    keys = ["fold", "train_end_date", "horizon_days"]
    return forecast_metrics(evaluated, models, keys, target)


def backtest_summary(metrics: DataFrame) -> DataFrame:
    """Mean and sample deviation of the metrics over folds, per model and horizon."""
    return metrics.groupBy("model", "horizon_days").agg(
        F.avg("mae").alias("mae_mean"),
        F.stddev_samp("mae").alias("mae_std"),
        F.avg("rmse").alias("rmse_mean"),
        F.stddev_samp("rmse").alias("rmse_std"),
        F.avg("mape_pct").alias("mape_mean"),
        F.stddev_samp("mape_pct").alias("mape_std"),
    )


def improvement_over(
    summary: DataFrame, model: str, reference: str = NAIVE, measure: str = "mae_mean"
) -> DataFrame:
    """Reduction of the error of ``reference`` by ``model``, in percent per horizon."""
    pivoted = summary.groupBy("horizon_days").pivot("model", [model, reference]).agg(F.max(measure))
    gain = -pct_change(F.col(model), F.col(reference))
    return pivoted.select(
        "horizon_days",
        F.col(model).alias("mae_model"),
        F.col(reference).alias("mae_naive"),
        gain.alias("mae_improvement_vs_naive_pct"),
    ).dropna()


def leaderboard(
    metrics: DataFrame, reference: str = NAIVE, tiers: tuple[float, float] = (2500.0, 4000.0)
) -> DataFrame:
    """Ranks, gain over the reference model, tier and the best model, one row per model.

    The windows have no partition key: the table has one row per model.
    """
    everything = Window.partitionBy()
    baseline = F.max(F.when(F.col("model") == reference, F.col("mae"))).over(everything)
    tier = F.when(F.col("mae") < tiers[0], "good").when(F.col("mae") < tiers[1], "fair")
    return metrics.select(
        "model",
        *METRICS,
        F.rank().over(Window.orderBy("mae")).alias("rank_mae"),
        F.rank().over(Window.orderBy("rmse")).alias("rank_rmse"),
        (-pct_change(F.col("mae"), baseline)).alias("vs_naive_pct"),
        tier.otherwise("poor").alias("tier"),
        F.min_by("model", F.struct("mae", "model")).over(everything).alias("best_model"),
    )


def segment_drilldown(
    scored: DataFrame, prediction: str, naive: str, segment: str = "cluster", target: str = "units"
) -> DataFrame:
    """MAE of a model and of the naive rule per segment, and the gain in percent."""
    require_columns(scored, [segment, target, prediction, naive], "scored frame")
    error = F.avg(F.abs(F.col(target) - F.col(prediction)))
    base = F.avg(F.abs(F.col(target) - F.col(naive)))
    means = scored.groupBy(segment).agg(
        F.count(prediction).alias("n_days"), error.alias("mae"), base.alias("naive_mae")
    )
    return means.withColumn("improvement_pct", -pct_change(F.col("mae"), F.col("naive_mae")))


def residual_rows(
    scored: DataFrame, prediction: str, target: str = "units", out: str = "residual"
) -> DataFrame:
    """The scored frame with actual minus prediction."""
    return scored.withColumn(out, F.col(target) - F.col(prediction))


def top_rows(table: DataFrame, measure: str, k: int, *ties: str, descending: bool = True) -> DataFrame:
    """The ``k`` rows with the highest (or lowest) measure; ``ties`` break equal values."""
    order = F.desc_nulls_last(measure) if descending else F.asc_nulls_last(measure)
    return table.orderBy(order, *ties).limit(k)


def ranked_overlap(first: DataFrame, second: DataFrame, k: int = 10) -> DataFrame:
    """Which features are in the top ``k`` of both importance lists, or of one only.

    Both inputs have ``feature`` and ``importance``.
    """
    def top(table: DataFrame, mark: str) -> DataFrame:
        chosen = top_rows(table, "importance", k, "feature")
        return chosen.select("feature", F.lit(mark).alias("_in"))

    sides = top(first, "a").unionByName(top(second, "b")).groupBy("feature").agg(
        F.collect_set("_in").alias("_in")
    )
    group = (
        F.when(F.size("_in") == 2, "shared")
        .when(F.array_contains("_in", "a"), "only_first")
        .otherwise("only_second")
    )
    return sides.select("feature", group.alias("membership"))


def overfit_gap(metrics: DataFrame, model: str) -> DataFrame:
    """Evaluation less training error per fold.

    ``metrics`` has fold, train_end_date, eval_end_date, split, model, mae and rmse.
    """
    rows = metrics.filter(F.col("model") == model)
    sides = {}
    for measure in ("mae", "rmse"):
        for split, name in (("train", f"train_{measure}"), ("eval", f"eval_{measure}_max_horizon")):
            sides[name] = F.max(F.when(F.col("split") == split, F.col(measure)))
    wide = rows.groupBy("fold", "train_end_date", "eval_end_date").agg(
        *[column.alias(name) for name, column in sides.items()]
    )
    return wide.withColumns(
        {
            "mae_gap": F.col("eval_mae_max_horizon") - F.col("train_mae"),
            "rmse_gap": F.col("eval_rmse_max_horizon") - F.col("train_rmse"),
        }
    )
