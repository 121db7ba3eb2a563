"""Fitted models. Their numbers have no SQL twin."""

from __future__ import annotations

from dataclasses import replace

from shelfwise.config import REGULARIZED_TREES, SHORT_ORDER_GRID, STANDARD_TREES, FoldPlan, SearchSpace
from shelfwise.models import linear, search, seasonal, trees
from shelfwise.models.dataset import split
from shelfwise.operators.evaluate import overfit_gap
from shelfwise.registry import query
from shelfwise.registry.inputs import CUTOFF, frame, round_all, written_frame

# Few and shallow trees keep the registered queries short; the settings of the
# published runs are the defaults of the functions.
SMALL = replace(STANDARD_TREES, trees=8, depth=4, step_size=0.3)
SMALL_REGULARIZED = replace(REGULARIZED_TREES, trees=8, depth=3, step_size=0.3)
FOLDS = FoldPlan()
SPACE = SearchSpace(trees=(4, 8), depth=(3, 4), step_size=(0.1, 0.3))


def data(spark, folder):
    return split(frame(spark, folder), CUTOFF)


@query("gbt_holdout")
def gbt_holdout(spark, folder):
    return round_all(trees.holdout(data(spark, folder), SMALL).metrics)


@query("gbt_categorical")
def gbt_categorical(spark, folder):
    scored = trees.holdout(data(spark, folder), SMALL, "gbt_categorical_daily", categorical=True)
    return round_all(scored.metrics)


@query("gbt_predictions")
def gbt_predictions(spark, folder):
    return round_all(trees.holdout(data(spark, folder), SMALL, "gbt").extract())


@query("feature_importance")
def feature_importance(spark, folder):
    return round_all(trees.holdout(data(spark, folder), SMALL).importance)


@query("elasticnet_holdout")
def elasticnet_holdout(spark, folder):
    return round_all(linear.holdout(data(spark, folder)).metrics)


@query("segment_forecast")
def segment_forecast(spark, folder):
    return round_all(seasonal.segment_forecast(frame(spark, folder), CUTOFF).metrics)


@query("order_search")
def order_search(spark, folder):
    return round_all(seasonal.best_orders(seasonal.order_trials(frame(spark, folder), CUTOFF)))


@query("short_order_search")
def short_order_search(spark, folder):
    trials = seasonal.order_trials(frame(spark, folder), CUTOFF, SHORT_ORDER_GRID)
    return round_all(seasonal.best_orders(trials))


@query("order_trials")
def order_trials(spark, folder):
    """MAE of every order and segment, failed fits with their error."""
    return round_all(seasonal.order_trials(frame(spark, folder), CUTOFF))


@query("order_search_metrics")
def order_search_metrics(spark, folder):
    """Every segment's best order, scored as one model next to the naive rule."""
    return round_all(seasonal.order_search(frame(spark, folder), CUTOFF).metrics)


@query("trial_quantiles")
def trial_quantiles(spark, folder):
    return round_all(seasonal.trial_quantiles(seasonal.order_trials(frame(spark, folder), CUTOFF)))


@query("backtest_segment")
def backtest_segment(spark, folder):
    return round_all(seasonal.backtest_metrics(seasonal.backtest(written_frame(spark, folder))))


@query("segment_fit_diagnostics")
def segment_fit_diagnostics(spark, folder):
    return round_all(seasonal.fit_diagnostics(seasonal.backtest(written_frame(spark, folder))))


@query("backtest_gbt")
def backtest_gbt(spark, folder):
    return round_all(trees.backtest(frame(spark, folder), FOLDS, SMALL)[0])


@query("backtest_gbt_regularized")
def backtest_gbt_regularized(spark, folder):
    name = "gbt_regularized_daily"
    return round_all(trees.backtest(frame(spark, folder), FOLDS, SMALL_REGULARIZED, name=name)[0])


@query("overfit_gap")
def overfit(spark, folder):
    errors = trees.backtest(frame(spark, folder), FOLDS, SMALL)[1]
    return round_all(overfit_gap(errors, "gbt_cluster_daily"))


@query("random_search")
def random_search(spark, folder):
    return round_all(search.random_search(data(spark, folder), SPACE))


@query("best_trial")
def best_trial(spark, folder):
    return round_all(search.best_trial(search.random_search(data(spark, folder), SPACE)))
