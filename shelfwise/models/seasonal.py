"""Per-segment seasonal forecaster with outside inputs.

Each segment's series is one group of one row per calendar day. The model is a
regression on outside inputs whose errors are autoregressive with moving-average
terms at non-seasonal and weekly lags. All steps are least squares; there is no
maximum-likelihood search. Forecasts are recursive: beyond the first day they use
the model's own predictions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.config import ORDER_GRID, FoldPlan, ForecastColumns, Roles, SeasonalOrder
from shelfwise.functions.columns import require_columns
from shelfwise.functions.lineage import pin
from shelfwise.models.dataset import Scored, with_naive
from shelfwise.operators.evaluate import backtest_frame, fold_metrics, forecast_metrics

FIT_FIELDS = "prediction double, converged int, residuals_mean_abs double, residuals_std double, error string"


@dataclass(frozen=True)
class Forecast:
    values: np.ndarray
    converged: bool
    residuals: np.ndarray


Forecaster = Callable[[np.ndarray, np.ndarray, np.ndarray, SeasonalOrder], Forecast]


def _difference_weights(order: SeasonalOrder) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^period)^D."""
    weights = np.array([1.0])
    once, weekly = np.array([1.0, -1.0]), np.zeros(order.period + 1)
    weekly[0], weekly[-1] = 1.0, -1.0
    for _ in range(order.d):
        weights = np.convolve(weights, once)
    for _ in range(order.sd):
        weights = np.convolve(weights, weekly)
    return weights


def _lag_set(short: int, seasonal: int, period: int) -> list[int]:
    return sorted({i + period * j for i in range(short + 1) for j in range(seasonal + 1)} - {0})


def _filtered(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The differenced series; the first ``len(weights) - 1`` entries are lost."""
    lost = len(weights) - 1
    return sum(v * x[lost - j : len(x) - j] for j, v in enumerate(weights))


def _lagged(x: np.ndarray, lags: Sequence[int], start: int) -> np.ndarray:
    return np.column_stack([x[start - k : len(x) - k] for k in lags]) if lags else np.empty((len(x) - start, 0))


def _stable(coefficients: np.ndarray, lags: Sequence[int]) -> tuple[np.ndarray, bool]:
    """Shrink autoregressive coefficients whose largest root is outside the unit circle."""
    if not lags:
        return coefficients, True
    polynomial = np.zeros(max(lags) + 1)
    polynomial[0] = 1.0
    polynomial[list(lags)] = -coefficients
    largest = float(np.max(np.abs(np.roots(polynomial)))) if np.any(coefficients) else 0.0
    if largest <= 1.0:
        return coefficients, True
    return coefficients * np.power(0.99 / largest, np.array(lags)), False


def _solve(design: np.ndarray, target: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(design, target, rcond=None)[0]


def _error_model(
    u: np.ndarray, ar: Sequence[int], ma: Sequence[int], long_lags: Sequence[int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Coefficients of the error series and its shocks, by two least-squares passes."""
    start = max(long_lags, default=0)
    long = _solve(_lagged(u, long_lags, start), u[start:]) if long_lags else np.empty(0)
    shocks = np.zeros(len(u))
    shocks[start:] = u[start:] - _lagged(u, long_lags, start) @ long
    phi, theta = (long, np.empty(0)) if not ma else (np.empty(0), np.empty(0))
    if ma:
        first = start + max(ma)
        both = np.column_stack([_lagged(u, ar, first), _lagged(shocks, ma, first)])
        coefficients = _solve(both, u[first:])
        phi, theta = coefficients[: len(ar)], coefficients[len(ar) :]
        shocks[first:] = u[first:] - both @ coefficients
    phi, stable = _stable(phi, ar)
    return phi, theta, shocks, stable


def seasonal_regression(
    history: np.ndarray, known: np.ndarray, future: np.ndarray, order: SeasonalOrder
) -> Forecast:
    """Regression on outside inputs whose errors follow the seasonal order.

    ``known`` has the inputs of ``history``; one value is forecast per row of ``future``.
    The regression is estimated again on series filtered by a long autoregression of
    its first errors, so correlated errors do not blur the input effects.
    """
    weights = _difference_weights(order)
    lost = len(weights) - 1
    scale, center = known.std(axis=0), known.mean(axis=0)
    use = scale > 0
    inputs = (np.vstack([known, future]) - center)[:, use] / scale[use]
    w = _filtered(history[:, None], weights)[:, 0]
    x = np.column_stack([np.ones(len(inputs) - lost), _filtered(inputs, weights)])
    ar, ma = _lag_set(order.p, order.sp, order.period), _lag_set(order.q, order.sq, order.period)
    n, horizon = len(w), len(future)
    long_lags = list(range(1, max([*ar, *ma, order.period]) + 2)) if ma else ar
    start = max(long_lags, default=0)
    if n - start < x.shape[1] + 2 * len(long_lags) + 10:
        raise ValueError("series too short for this order")

    beta = _solve(x[:n], w)
    if long_lags:
        u = w - x[:n] @ beta
        rho = _solve(_lagged(u, long_lags, start), u[start:])
        flat_w = w[start:] - _lagged(w, long_lags, start) @ rho
        flat_x = x[start:n] - sum(
            r * x[start - lag : n - lag] for r, lag in zip(rho, long_lags)
        )
        beta = _solve(flat_x, flat_w)
    u = w - x[:n] @ beta
    phi, theta, shocks, stable = _error_model(u, ar, ma, long_lags)
    u_all, e_all = np.concatenate([u, np.zeros(horizon)]), np.concatenate([shocks, np.zeros(horizon)])
    y_all = np.concatenate([history, np.zeros(horizon)])
    for t in range(n, n + horizon):
        u_all[t] = sum(c * u_all[t - lag] for c, lag in zip(phi, ar))
        u_all[t] += sum(c * e_all[t - lag] for c, lag in zip(theta, ma))
        at = lost + t
        y_all[at] = x[t] @ beta + u_all[t] - sum(weights[j] * y_all[at - j] for j in range(1, lost + 1))
    values = y_all[len(history) :]
    return Forecast(values, stable and bool(np.all(np.isfinite(values))), shocks[start:])


def _forecast_group(
    group: pd.DataFrame,
    order: SeasonalOrder,
    roles: Roles,
    inputs: Sequence[str],
    forecaster: Forecaster,
    clip: bool,
) -> pd.DataFrame:
    """The evaluation rows of one series with predictions, or with the error of the fit."""
    ordered = group.sort_values(roles.date)
    train = ordered[ordered["split"] == "train"]
    out = ordered[ordered["split"] != "train"].copy()
    fields = {
        "prediction": None,
        "converged": 0,
        "residuals_mean_abs": None,
        "residuals_std": None,
        "error": None,
    }
    if len(out):
        try:
            fit = forecaster(
                train[roles.target].to_numpy(float),
                train[list(inputs)].to_numpy(float),
                out[list(inputs)].to_numpy(float),
                order,
            )
            fields["prediction"] = np.maximum(fit.values, 0.0) if clip else fit.values
            fields["converged"] = int(fit.converged)
            fields["residuals_mean_abs"] = float(np.abs(fit.residuals).mean())
            fields["residuals_std"] = float(fit.residuals.std(ddof=1))
        except (ValueError, np.linalg.LinAlgError) as error:
            fields["error"] = str(error)
    return out.assign(**fields)


def forecast_groups(
    rows: DataFrame,
    keys: Sequence[str],
    order: SeasonalOrder | None = None,
    roles: Roles = Roles(),
    inputs: Sequence[str] = ForecastColumns().names,
    forecaster: Forecaster = seasonal_regression,
    clip: bool = False,
) -> DataFrame:
    """Forecast every group of ``keys``: one fit per group, groups spread over tasks.

    ``rows`` has a ``split`` column; its 'train' rows are fitted and the others are
    returned with predictions. With ``order=None`` the columns of ``SeasonalOrder``
    are read from the rows, so one job can fit many orders.
    """
    carried = [*keys, roles.date, roles.target, "lag_7"]
    carried += [c for c in ("train_end_date", "eval_end_date") if c in rows.columns and c not in keys]
    orders = [] if order else list(SeasonalOrder.__dataclass_fields__)
    require_columns(rows, [*carried, *inputs, "split", *orders], "rows")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        chosen = order or SeasonalOrder(**{name: int(group[name].iloc[0]) for name in orders})
        return _forecast_group(group, chosen, roles, inputs, forecaster, clip)[
            [*carried, "prediction", "converged", "residuals_mean_abs", "residuals_std", "error"]
        ]

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    wanted = list(dict.fromkeys([*carried, *inputs, "split", *orders]))
    return rows.select(*wanted).groupBy(*keys).applyInPandas(fit, f"{schema}, {FIT_FIELDS}")


def _split_rows(frame: DataFrame, cutoff: str, roles: Roles) -> DataFrame:
    train = F.col(roles.date) <= F.lit(cutoff).cast("date")
    return frame.withColumn("split", F.when(train, "train").otherwise("eval"))


def segment_forecast(
    frame: DataFrame,
    cutoff: str,
    order: SeasonalOrder = ORDER_GRID[0],
    roles: Roles = Roles(),
    forecaster: Forecaster = seasonal_regression,
    name: str = "seasonal_cluster_daily",
) -> Scored:
    """One model per segment, fitted up to the cutoff and forecast beyond it."""
    predictions = forecast_groups(
        _split_rows(frame, cutoff, roles), [roles.segment], order, roles, forecaster=forecaster
    )
    return Scored(name, predictions, scored_with_failures(name, predictions, roles))


def scored_with_failures(name: str, predictions: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Metrics of the model and the naive rule on the rows that have a prediction.

    ``n_failed_segments`` and ``n_failed_rows`` count what has none.
    """
    missing = F.col("prediction").isNull()
    failed = predictions.agg(
        F.count_distinct(F.when(missing, F.col(roles.segment))).alias("n_failed_segments"),
        F.count_if(missing).alias("n_failed_rows"),
    )
    counts = failed.select(F.struct("*")).scalar()
    metrics = with_naive(name, predictions.filter(~missing), roles)
    return metrics.withColumn("_failed", counts).select(*metrics.columns, "_failed.*")


def order_predictions(
    frame: DataFrame,
    cutoff: str,
    grid: Sequence[SeasonalOrder] = ORDER_GRID,
    roles: Roles = Roles(),
    forecaster: Forecaster = seasonal_regression,
) -> DataFrame:
    """Forecasts of every order for every segment, with the error text of failed fits.

    Each row explodes the grid, so (segment, order) pairs are separate groups of one
    job. Predictions below zero are set to zero.
    """
    fields = list(SeasonalOrder.__dataclass_fields__)
    grid_rows = F.array(
        *[
            F.struct(
                F.lit(order.label).alias("order_label"),
                *[F.lit(getattr(order, name)).alias(name) for name in fields],
            )
            for order in grid
        ]
    )
    rows = _split_rows(frame, cutoff, roles).select("*", F.inline(grid_rows))
    keys = [roles.segment, "order_label"]
    return forecast_groups(rows, keys, None, roles, forecaster=forecaster, clip=True)


def trials_of(predictions: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """MAE of every order and segment; null, with the error, where the fit failed."""
    error = F.abs(F.col(roles.target) - F.col("prediction"))
    return predictions.groupBy(roles.segment, "order_label").agg(
        F.avg(error).alias("mae"), F.first("error", True).alias("error")
    )


def order_trials(
    frame: DataFrame,
    cutoff: str,
    grid: Sequence[SeasonalOrder] = ORDER_GRID,
    roles: Roles = Roles(),
    forecaster: Forecaster = seasonal_regression,
) -> DataFrame:
    """The trial table of the order search."""
    return trials_of(order_predictions(frame, cutoff, grid, roles, forecaster), roles)


def best_orders(trials: DataFrame, segment: str = "cluster") -> DataFrame:
    """The order with the lowest MAE per segment; null where every fit failed."""
    ranked = F.struct(F.col("mae").isNull().alias("failed"), "mae", "order_label")
    best = trials.groupBy(segment).agg(F.min(ranked).alias("_b"))
    return best.select(
        segment,
        F.when(~F.col("_b.failed"), F.col("_b.order_label")).alias("best_order"),
        F.col("_b.mae").alias("mae"),
    )


def order_search(
    frame: DataFrame,
    cutoff: str,
    grid: Sequence[SeasonalOrder] = ORDER_GRID,
    roles: Roles = Roles(),
    forecaster: Forecaster = seasonal_regression,
    name: str = "seasonal_best_order",
) -> Scored:
    """The search as one model: each segment's forecasts under its best order, scored together."""
    every = pin(order_predictions(frame, cutoff, grid, roles, forecaster), "order_predictions")
    best = best_orders(trials_of(every, roles), roles.segment).select(
        roles.segment, F.col("best_order").alias("order_label")
    )
    # A segment without any fit keeps one row a day, without prediction, and counts as failed.
    chosen = every.join(best.filter(F.col("order_label").isNotNull()), [roles.segment, "order_label"], "left_semi")
    lost = every.join(best.filter(F.col("order_label").isNull()), roles.segment, "left_semi")
    lost = lost.filter(F.col("order_label") == F.lit(grid[0].label))
    predictions = chosen.unionByName(lost)
    return Scored(name, predictions, scored_with_failures(name, predictions, roles))


def trial_quantiles(trials: DataFrame) -> DataFrame:
    """Distribution of MAE over segments for each order."""
    ok = trials.filter(F.col("mae").isNotNull())
    return ok.groupBy("order_label").agg(
        F.count("mae").alias("n_trials"),
        *[
            F.percentile("mae", F.lit(p)).alias(name)
            for name, p in (
                ("mae_min", 0.0),
                ("mae_q1", 0.25),
                ("mae_median", 0.5),
                ("mae_q3", 0.75),
                ("mae_max", 1.0),
            )
        ],
    )


def backtest(
    frame: DataFrame,
    plan: FoldPlan = FoldPlan(),
    order: SeasonalOrder = ORDER_GRID[0],
    roles: Roles = Roles(),
    forecaster: Forecaster = seasonal_regression,
) -> DataFrame:
    """Predictions of every (fold, segment) fit of a rolling-origin backtest, in one job."""
    rows = backtest_frame(frame, plan, roles)
    return forecast_groups(rows, ["fold", roles.segment], order, roles, forecaster=forecaster)


def backtest_metrics(
    predictions: DataFrame,
    plan: FoldPlan = FoldPlan(),
    roles: Roles = Roles(),
    name: str = "seasonal_cluster_daily",
) -> DataFrame:
    """Metrics per fold, horizon and model, next to the naive rule on the same rows.

    ``n_failed_rows`` counts the rows of the fold and horizon without a prediction.
    """
    wanted = F.array(*[F.lit(h) for h in sorted(set(plan.horizons))])
    ahead = F.datediff(roles.date, "train_end_date")
    every = predictions.withColumn("horizon_days", F.explode(F.filter(wanted, lambda h: ahead <= h)))
    missing = F.col("prediction").isNull()
    failed = every.groupBy("fold", "horizon_days").agg(F.count_if(missing).alias("n_failed_rows"))
    models = {name: "prediction", "seasonal_naive_7d": "lag_7"}
    metrics = fold_metrics(every.filter(~missing), models, roles.target)
    return metrics.join(failed, ["fold", "horizon_days"], "left")


def fit_diagnostics(predictions: DataFrame, roles: Roles = Roles()) -> DataFrame:
    """Convergence rate, residual size and gain over the naive rule per fold."""
    per_segment = predictions.groupBy("fold", "train_end_date", "eval_end_date", roles.segment).agg(
        F.first("converged").alias("converged"),
        F.first("residuals_mean_abs").alias("residuals_mean_abs"),
        F.first("residuals_std").alias("residuals_std"),
    )
    keys = ["fold", "train_end_date", "eval_end_date"]
    fits = per_segment.groupBy(*keys).agg(
        F.avg("converged").alias("convergence_rate"),
        F.avg("residuals_mean_abs").alias("residuals_mean_abs"),
        F.avg("residuals_std").alias("residuals_std"),
    )
    ok = predictions.filter(F.col("prediction").isNotNull())
    errors = forecast_metrics(ok, {"model": "prediction", "naive": "lag_7"}, ["fold"], roles.target)
    wide = errors.groupBy("fold").agg(
        F.max(F.when(F.col("model") == "model", F.col("mae"))).alias("model_mae_max_horizon"),
        F.max(F.when(F.col("model") == "naive", F.col("mae"))).alias("baseline_mae_max_horizon"),
    )
    gain = F.col("baseline_mae_max_horizon") - F.col("model_mae_max_horizon")
    return fits.join(wide, "fold", "left").withColumn("mae_improvement_vs_baseline", gain)
