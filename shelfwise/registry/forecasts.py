"""Forecast metrics, folds, backtests and comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.config import FoldPlan
from shelfwise.operators import evaluate
from shelfwise.registry import query
from shelfwise.registry.inputs import CUTOFF, frame, round_all, rounded, total, written_frame
from shelfwise.registry.views import with_more

FOLDS = FoldPlan()
MODELS = {
    "seasonal_naive_7d": "pred_seasonal_naive_7d",
    "moving_avg_7d": "pred_moving_avg_7d",
}
FRAME_MODELS = {"seasonal_naive_7d": "lag_7", "rolling_mean_7d": "rolling_mean_7"}

_ERRORS = """avg(abs(units - p)) AS mae, sqrt(avg((units - p) * (units - p))) AS rmse,
  100 * avg(CASE WHEN units <> 0 THEN abs((units - p) / units) END) AS mape_pct"""
_ROUNDED = "round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(mape_pct, 6) AS mape_pct"

_SCORED = """
scored AS (
  SELECT cluster, date, units, lag(units, 7) OVER w AS naive, avg(units) OVER w7 AS moving
  FROM base WINDOW w AS (PARTITION BY cluster ORDER BY date),
    w7 AS (PARTITION BY cluster ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
valid AS (
  SELECT 'seasonal_naive_7d' AS model, cluster, date, units, naive AS p FROM scored WHERE date > DATE '2001-06-30'
  UNION ALL
  SELECT 'moving_avg_7d', cluster, date, units, moving FROM scored WHERE date > DATE '2001-06-30')"""


def scored(spark, folder):
    series = evaluate.moving_average(evaluate.seasonal_naive(total(spark, folder)))
    return series.filter(F.col("date") > F.lit(CUTOFF).cast("date"))


@query(
    "baseline_metrics",
    with_more(
        _SCORED,
        f"""
SELECT model, cluster, {_ROUNDED} FROM (
  SELECT model, cluster, {_ERRORS} FROM valid WHERE p IS NOT NULL GROUP BY model, cluster
  UNION ALL
  SELECT model, NULL, {_ERRORS} FROM valid WHERE p IS NOT NULL GROUP BY model)""",
    ),
)
def baseline_metrics(spark, folder):
    return round_all(evaluate.metrics_with_total(scored(spark, folder), MODELS))


@query(
    "forecast_metrics",
    with_more(
        _SCORED,
        f"SELECT model, {_ROUNDED} FROM (SELECT model, {_ERRORS} FROM valid WHERE p IS NOT NULL GROUP BY model)",
    ),
)
def forecast_metrics(spark, folder):
    return round_all(evaluate.forecast_metrics(scored(spark, folder), MODELS))


@query(
    "segment_drilldown",
    with_more(
        _SCORED,
        """
SELECT cluster, n_days, round(mae, 6) AS mae, round(naive_mae, 6) AS naive_mae,
       round(100 * (naive_mae - mae) / naive_mae, 6) AS improvement_pct
FROM (SELECT cluster, count(moving) AS n_days, avg(abs(units - moving)) AS mae, avg(abs(units - naive)) AS naive_mae
      FROM scored WHERE date > DATE '2001-06-30' GROUP BY cluster)""",
    ),
)
def segment_drilldown(spark, folder):
    table = evaluate.segment_drilldown(
        scored(spark, folder), "pred_moving_avg_7d", "pred_seasonal_naive_7d"
    )
    return round_all(table)


@query(
    "residual_rows",
    with_more(
        _SCORED,
        """
SELECT cluster, date, units, round(moving, 6) AS pred_moving_avg_7d, round(units - moving, 6) AS residual
FROM scored WHERE date > DATE '2001-06-30' AND moving IS NOT NULL""",
    ),
)
def residual_rows(spark, folder):
    """Actual minus prediction of the moving average, row by row."""
    rows = scored(spark, folder).filter(F.col("pred_moving_avg_7d").isNotNull())
    table = evaluate.residual_rows(rows, "pred_moving_avg_7d")
    return rounded(
        table.select("cluster", "date", "units", "pred_moving_avg_7d", "residual"), "pred_moving_avg_7d", "residual"
    )


_FOLDS = """
dates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS place, count(*) OVER () AS n
          FROM (SELECT DISTINCT date FROM frame)),
folds AS (
  SELECT k.k AS fold, t.date AS train_end_date, e.date AS eval_end_date
  FROM (SELECT unnest(range(1, 6))::INT AS k) k
  JOIN dates e ON e.place = e.n - 1 - (5 - k.k) * 28
  JOIN dates t ON t.place = e.place - 28
  WHERE t.place >= 180)"""
_FOLD_ROWS = (
    _FOLDS
    + """,
fold_rows AS (
  SELECT f.fold, f.train_end_date, h.h AS horizon_days, r.units, r.lag_7, r.rolling_mean_7
  FROM frame r JOIN folds f ON r.date > f.train_end_date AND r.date <= f.eval_end_date
  JOIN (SELECT unnest([7, 14, 28])::INT AS h) h ON r.date - f.train_end_date <= h.h),
fold_metrics AS (
  SELECT fold, train_end_date, horizon_days, model, {errors} FROM (
    SELECT *, 'seasonal_naive_7d' AS model, lag_7 AS p FROM fold_rows
    UNION ALL SELECT *, 'rolling_mean_7d', rolling_mean_7 FROM fold_rows)
  GROUP BY fold, train_end_date, horizon_days, model),
summary AS (
  SELECT model, horizon_days, avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std, avg(rmse) AS rmse_mean,
         stddev_samp(rmse) AS rmse_std, avg(mape_pct) AS mape_mean, stddev_samp(mape_pct) AS mape_std
  FROM fold_metrics GROUP BY model, horizon_days)""".replace("{errors}", _ERRORS)
)


def naive_folds(spark, folder):
    rows = evaluate.backtest_frame(written_frame(spark, folder), FOLDS, horizons=True)
    return evaluate.fold_metrics(rows, FRAME_MODELS)


@query("fold_boundaries", with_more(_FOLDS, " SELECT fold, train_end_date, eval_end_date FROM folds"))
def fold_boundaries(spark, folder):
    return evaluate.fold_boundaries(frame(spark, folder), FOLDS)


@query(
    "backtest_frame",
    with_more(
        _FOLDS,
        """
SELECT r.cluster, r.date, r.units, r.lag_7, f.fold, f.train_end_date, f.eval_end_date,
       CASE WHEN r.date <= f.train_end_date THEN 'train' ELSE 'eval' END AS split
FROM frame r JOIN folds f ON r.date <= f.eval_end_date""",
    ),
)
def backtest_frame(spark, folder):
    return evaluate.backtest_frame(written_frame(spark, folder), FOLDS).select(
        "cluster", "date", "units", "lag_7", "fold", "train_end_date", "eval_end_date", "split"
    )


@query(
    "backtest_naive",
    with_more(
        _FOLD_ROWS,
        f" SELECT fold, train_end_date, horizon_days, model, {_ROUNDED} FROM fold_metrics",
    ),
)
def backtest_naive(spark, folder):
    return round_all(naive_folds(spark, folder))


@query(
    "backtest_summary",
    with_more(
        _FOLD_ROWS,
        """
SELECT model, horizon_days, round(mae_mean, 6) AS mae_mean, round(mae_std, 6) AS mae_std,
       round(rmse_mean, 6) AS rmse_mean, round(rmse_std, 6) AS rmse_std,
       round(mape_mean, 6) AS mape_mean, round(mape_std, 6) AS mape_std FROM summary""",
    ),
)
def backtest_summary(spark, folder):
    return round_all(evaluate.backtest_summary(naive_folds(spark, folder)))


@query(
    "backtest_improvement",
    with_more(
        _FOLD_ROWS,
        """
SELECT m.horizon_days, round(m.mae_mean, 6) AS mae_model, round(n.mae_mean, 6) AS mae_naive,
       round(100 * (n.mae_mean - m.mae_mean) / n.mae_mean, 6) AS mae_improvement_vs_naive_pct
FROM summary m JOIN summary n ON m.horizon_days = n.horizon_days
WHERE m.model = 'rolling_mean_7d' AND n.model = 'seasonal_naive_7d'""",
    ),
)
def backtest_improvement(spark, folder):
    summary = evaluate.backtest_summary(naive_folds(spark, folder))
    return round_all(evaluate.improvement_over(summary, "rolling_mean_7d"))


_BOARD_MODELS = {
    "seasonal_naive_7d": "lag_7",
    "seasonal_naive_14d": "lag_14",
    "seasonal_naive_28d": "lag_28",
    "rolling_mean_7d": "rolling_mean_7",
    "rolling_mean_28d": "rolling_mean_28",
}
_BOARD = (
    """
board_rows AS ("""
    + " UNION ALL ".join(
        f"SELECT '{model}' AS model, units, {column} AS p FROM frame WHERE date > DATE '2001-06-30'"
        for model, column in _BOARD_MODELS.items()
    )
    + f"""),
board AS (SELECT model, {_ERRORS} FROM board_rows GROUP BY model)"""
)


@query(
    "leaderboard",
    with_more(
        _BOARD,
        f"""
SELECT model, {_ROUNDED}, CAST(rank() OVER (ORDER BY mae) AS INTEGER) AS rank_mae,
       CAST(rank() OVER (ORDER BY rmse) AS INTEGER) AS rank_rmse,
       round(100 * (naive - mae) / naive, 6) AS vs_naive_pct,
       CASE WHEN mae < 50 THEN 'good' WHEN mae < 60 THEN 'fair' ELSE 'poor' END AS tier,
       (SELECT arg_min(model, mae) FROM board) AS best_model
FROM board, (SELECT mae AS naive FROM board WHERE model = 'seasonal_naive_7d')""",
    ),
)
def leaderboard(spark, folder):
    valid = frame(spark, folder).filter(F.col("date") > F.lit(CUTOFF).cast("date"))
    metrics = evaluate.forecast_metrics(valid, _BOARD_MODELS)
    return round_all(evaluate.leaderboard(metrics, tiers=(50.0, 60.0)))


IMPORTANCE = (
    "promo_rate",
    "avg_store_transactions",
    "oil_price",
    "lag_7",
    "lag_14",
    "lag_28",
    "rolling_mean_7",
    "rolling_mean_28",
    "rolling_std_28",
    "day_of_week",
    "day_of_month",
    "month",
    "week_of_year",
)


def _importance_sql(where: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS feature, abs(corr(units, {name})) AS importance FROM frame WHERE {where}"
        for name in IMPORTANCE
    )


def importance_by_correlation(rows):
    """Features by the size of their correlation with the target, one aggregate."""
    wide = rows.agg(*[F.abs(F.corr("units", name)).alias(name) for name in IMPORTANCE])
    return wide.unpivot([], list(IMPORTANCE), "feature", "importance")


@query(
    "feature_overlap",
    with_more(
        f"""
early AS (SELECT * FROM ({_importance_sql("date <= DATE '1998-06-30'")}) ORDER BY importance DESC, feature LIMIT 10),
late AS (SELECT * FROM ({_importance_sql("date > DATE '1998-06-30'")}) ORDER BY importance DESC, feature LIMIT 10)""",
        """
SELECT coalesce(e.feature, l.feature) AS feature,
       CASE WHEN l.feature IS NULL THEN 'only_first' WHEN e.feature IS NULL THEN 'only_second'
            ELSE 'shared' END AS membership
FROM early e FULL JOIN late l ON e.feature = l.feature""",
    ),
)
def feature_overlap(spark, folder):
    """Top features of the first and second half of the history, by correlation."""
    rows, middle = written_frame(spark, folder), F.lit("1998-06-30").cast("date")
    early = importance_by_correlation(rows.filter(F.col("date") <= middle))
    late = importance_by_correlation(rows.filter(F.col("date") > middle))
    return evaluate.ranked_overlap(early, late, 10)
