"""Residual diagnostics of a linear model of segment-day units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.config import Roles
from shelfwise.functions.columns import require_columns
from shelfwise.functions.lineage import pin
from shelfwise.functions.ordered import running_counts
from shelfwise.functions.tails import chi_square_upper, f_upper
from shelfwise.operators.least_squares import fit_groups, predicted, standardised

COVARIATES = ("promo_rate", "holiday_rate", "avg_store_transactions", "oil_price")
DUMMIES = ("day_of_week", "month")
LJUNG_BOX_LAGS = (7, 14)
MIN_ROWS = 30
OVERALL = "overall_cluster_day"
#: A response whose variance is below this, in units of its mean square, is constant.
VARIES = 1e-12


def _fitted(series: DataFrame, key: str, least: int) -> DataFrame:
    """The written ``series`` with fitted values, residuals and Breusch-Pagan statistics per ``key``.

    Three passes: group means and spreads, moments of the model, moments of the squared residuals.
    """
    size = len(COVARIATES)
    rows = standardised(series, key, COVARIATES, "units", least)
    model = fit_groups(rows, key, size, DUMMIES, F.col("_y"))
    # The model of the squared residuals takes them as shares of their mean, less one.
    mean_square = F.col("unexplained") / F.col("n_rows")
    model = pin(model.withColumn("_ms", F.when(mean_square > 0, mean_square).otherwise(F.lit(1.0))), "model")
    scored = rows.join(model, key).withColumn("_e", F.col("_y") - predicted(size, DUMMIES))
    share = F.col("_e") * F.col("_e") / F.col("_ms") - 1
    squares = fit_groups(scored, key, size, DUMMIES, share)
    constant = F.col("spread") <= VARIES * F.col("n_rows")
    squares = squares.select(
        key, F.when(~constant, 1 - F.col("unexplained") / F.col("spread")).alias("_aux_r2")
    )
    statistics = pin(
        model.join(squares, key).select(
            key,
            (1 - F.try_divide("unexplained", "spread")).alias("_r2"),
            "n_params",
            F.when(F.col("n_rank") > 1, F.col("n_rows") * F.col("_aux_r2")).alias("bp_lm"),
            _f_value(F.col("_aux_r2"), F.col("n_rank") - 1, F.col("n_rows") - F.col("n_rank")).alias("bp_f"),
            (F.col("n_rank") - 1).alias("bp_df_model"),
            (F.col("n_rows") - F.col("n_rank")).cast("int").alias("bp_df_resid"),
        ),
        "statistics",
    )
    return scored.drop("n_params").join(statistics, key).select(
        *series.columns,
        (F.col("units") - F.col("_e")).alias("fitted"),
        F.col("_e").alias("residual"),
        F.when(F.col("_varies"), F.col("_r2")).alias("r_squared"),
        "n_params",
        F.when(F.col("_varies"), F.col("bp_lm")).alias("bp_lm"),
        F.when(F.col("_varies"), F.col("bp_f")).alias("bp_f"),
        "bp_df_model",
        "bp_df_resid",
    )


def _f_value(r2: Column, model_df: Column, resid_df: Column) -> Column:
    """F statistic of a regression; null where it has no meaning.

    That is so without regressors, without residual degrees of freedom, for a constant
    response and for a perfect fit.
    """
    return F.when((model_df > 0) & (resid_df > 0) & (r2 < 1), (r2 / model_df) / ((1 - r2) / resid_df))


def ols_segment(series: DataFrame, roles: Roles = Roles(), min_rows: int = MIN_ROWS) -> DataFrame:
    """Fitted values, residuals and Breusch-Pagan statistics for each segment's own model.

    Statistics that a constant segment or one without varying regressors lacks are null.
    Every row of a segment repeats the segment's statistics. The series is written once
    because all passes read it; rows with a null regressor, dummy or response are left out.
    """
    require_columns(series, [roles.segment, roles.date, "units", *COVARIATES, *DUMMIES], "series")
    names = [roles.segment, roles.date, "units", *COVARIATES, *DUMMIES]
    written = pin(series.select(names).dropna(), "series")
    return _fitted(written, roles.segment, min_rows).drop(*COVARIATES, *DUMMIES)


def ols_overall(series: DataFrame) -> DataFrame:
    """The series with the same columns for one model over all segments."""
    require_columns(series, ["units", *COVARIATES, *DUMMIES], "series")
    whole = series.dropna(subset=["units", *COVARIATES, *DUMMIES]).withColumn("_all", F.lit(0))
    return _fitted(pin(whole, "series"), "_all", 1).drop("_all")


def breusch_pagan_columns() -> dict[str, Column]:
    """p-values of the Lagrange multiplier and F forms of the Breusch-Pagan test."""
    return {
        "breusch_pagan_lm_pvalue": chi_square_upper(
            F.col("bp_lm"), (F.col("n_params") - 1).cast("double")
        ),
        "breusch_pagan_f_pvalue": f_upper(
            F.col("bp_f"), F.col("bp_df_model").cast("double"), F.col("bp_df_resid").cast("double")
        ),
    }


def _box_sums(
    lagged: DataFrame, keys: Sequence[str], longest: int, carried: Sequence[str] = ()
) -> DataFrame:
    """Sums of products of a centred value ``_c`` with its lags ``_c1``, ``_c2`` and so on.

    ``carried`` columns are constant within a key.
    """
    products = [F.sum(F.col("_c") * F.col(f"_c{k}")).alias(f"_p{k}") for k in range(1, longest + 1)]
    return lagged.groupBy(*keys).agg(
        F.count("_c").alias("n_obs"),
        F.sum(F.col("_c") * F.col("_c")).alias("_p0"),
        F.stddev_samp("_c").alias("residual_std"),
        *products,
        *[F.first(name).alias(name) for name in carried],
    )


def _box_statistics(
    sums: DataFrame, keys: Sequence[str], lags: Sequence[int], carried: Sequence[str] = ()
) -> DataFrame:
    n = F.col("n_obs").cast("double")
    columns: list[Column] = []
    for lag in lags:
        total = F.lit(0.0)
        for k in range(1, lag + 1):
            r = F.try_divide(F.coalesce(F.col(f"_p{k}"), F.lit(0.0)), F.col("_p0"))
            total = total + r * r / (n - k)
        columns.append((n * (n + 2) * total).alias(f"ljung_box_q{lag}"))
    return sums.select(*keys, "n_obs", "residual_std", *columns, *carried)


def ljung_box(
    rows: DataFrame,
    segment: str,
    order: str,
    value: str = "residual",
    lags: Sequence[int] = LJUNG_BOX_LAGS,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Ljung-Box Q of each segment's series at the given lags.

    ``carried`` names columns that are constant in a segment and are kept.
    """
    require_columns(rows, [segment, order, value], "residuals")
    longest = max(lags)
    inside = Window.partitionBy(segment)
    w = inside.orderBy(order)
    centred = rows.select(
        segment, order, *carried, (F.col(value) - F.avg(value).over(inside)).alias("_c")
    )
    lagged = centred.withColumns({f"_c{k}": F.lag("_c", k).over(w) for k in range(1, longest + 1)})
    sums = _box_sums(lagged, [segment], longest, carried)
    return _box_statistics(sums, [segment], lags, carried)


def ljung_box_overall(
    rows: DataFrame,
    segment: str,
    order: str,
    value: str = "residual",
    lags: Sequence[int] = LJUNG_BOX_LAGS,
    block: int = 1 << 16,
) -> DataFrame:
    """Ljung-Box Q over all segments laid end to end in segment and date order.

    Lags run across segment boundaries. Every row gets its place in that order from
    the sizes of the segments before it; blocks of places are worked on separately,
    each with a copy of the last rows of the block before.
    """
    require_columns(rows, [segment, order, value], "residuals")
    longest = max(lags)
    sizes = rows.groupBy(segment).agg(F.count(F.lit(1)).alias("n"))
    before = running_counts(sizes, [], segment, "n").select(segment, "n_below")
    mean = rows.agg(F.avg(value).alias("m")).scalar()
    place = F.row_number().over(Window.partitionBy(segment).orderBy(order)) - 1
    placed = (
        rows.select(segment, order, (F.col(value) - mean).alias("_c"))
        .withColumn("_row", place)
        .join(before, segment)
        .select((F.col("n_below") + F.col("_row")).alias("_place"), "_c")
    )
    home = F.floor(F.col("_place") / block)
    is_tail = F.pmod(F.col("_place"), F.lit(block)) >= block - longest
    homes = F.when(is_tail, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed.select(
        "_place", "_c", home.alias("_home"), F.explode(homes).alias("_block")
    )
    w = Window.partitionBy("_block").orderBy("_place")
    lagged = spread.withColumns({f"_c{k}": F.lag("_c", k).over(w) for k in range(1, longest + 1)})
    own = lagged.filter(F.col("_home") == F.col("_block"))
    return _box_statistics(_box_sums(own, [], longest), [], lags)


def _with_flags(report: DataFrame, keys: Sequence[str], level: float) -> DataFrame:
    tested = report.withColumns(breusch_pagan_columns()).withColumns(
        {
            f"ljung_box_pvalue_lag{lag}": chi_square_upper(F.col(f"ljung_box_q{lag}"), F.lit(float(lag)))
            for lag in LJUNG_BOX_LAGS
        }
    )
    return tested.select(
        *keys,
        "n_obs",
        "r_squared",
        "breusch_pagan_lm_pvalue",
        "breusch_pagan_f_pvalue",
        *[f"ljung_box_pvalue_lag{lag}" for lag in LJUNG_BOX_LAGS],
        "residual_std",
        (F.col("breusch_pagan_lm_pvalue") < level).alias("heteroskedasticity_flag"),
        *[
            (F.col(f"ljung_box_pvalue_lag{lag}") < level).alias(f"autocorrelation_flag_lag{lag}")
            for lag in LJUNG_BOX_LAGS
        ],
    )


_STATISTICS = ("r_squared", "n_params", "bp_lm", "bp_f", "bp_df_model", "bp_df_resid")


def residual_diagnostics(
    series: DataFrame, roles: Roles = Roles(), level: float = 0.05, min_rows: int = MIN_ROWS
) -> DataFrame:
    """R squared, Breusch-Pagan and Ljung-Box tests and flags per segment."""
    rows = ols_segment(series, roles, min_rows)
    report = ljung_box(rows, roles.segment, roles.date, carried=_STATISTICS)
    return _with_flags(report, [roles.segment], level)


def residual_diagnostics_overall(
    series: DataFrame, roles: Roles = Roles(), level: float = 0.05
) -> DataFrame:
    """The same report for one model over all segments."""
    rows = ols_overall(series)
    box = ljung_box_overall(rows, roles.segment, roles.date)
    stats = rows.select(F.struct(*_STATISTICS).alias("s")).limit(1).scalar()
    report = box.withColumn("_s", stats).select("*", "_s.*").withColumn("scope", F.lit(OVERALL))
    return _with_flags(report, ["scope"], level)
