"""Features and profile tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfwise.operators import counts, evaluate, features, profile
from shelfwise.registry import query
from shelfwise.registry.inputs import classed_fact, frame, light_fact, round_all, rounded, total
from shelfwise.registry.views import with_base, with_more
from shelfwise.sources import star


@query(
    "calendar_features",
    with_base("""
SELECT cluster, date, units, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month,
       month(date) AS month, weekofyear(date) AS week_of_year,
       (day(date) = 1)::INT AS is_month_start, (date = last_day(date))::INT AS is_month_end
FROM base"""),
)
def calendar_features(spark, folder):
    return features.add_calendar(total(spark, folder))


@query(
    "lag_features",
    with_base("""
SELECT cluster, date, units, lag(units, 7) OVER w AS lag_7, lag(units, 14) OVER w AS lag_14,
       lag(units, 28) OVER w AS lag_28
FROM base WINDOW w AS (PARTITION BY cluster ORDER BY date)"""),
)
def lag_features(spark, folder):
    return features.add_lags(total(spark, folder))


@query(
    "rolling_features",
    with_base("""
SELECT cluster, date, units,
  round(CASE WHEN count(units) OVER w7 >= 3 THEN avg(units) OVER w7 END, 6) AS rolling_mean_7,
  round(CASE WHEN count(units) OVER w28 >= 7 THEN avg(units) OVER w28 END, 6) AS rolling_mean_28,
  round(CASE WHEN count(units) OVER w28 >= 7 THEN stddev_samp(units) OVER w28 END, 6) AS rolling_std_28
FROM base
WINDOW w7 AS (PARTITION BY cluster ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w28 AS (PARTITION BY cluster ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)"""),
)
def rolling_features(spark, folder):
    series = features.add_rolling(total(spark, folder))
    return rounded(series, "rolling_mean_7", "rolling_mean_28", "rolling_std_28")


@query(
    "model_frame",
    with_base("""
SELECT * REPLACE (round(promo_rate, 6) AS promo_rate,
                  round(avg_store_transactions, 6) AS avg_store_transactions,
                  round(rolling_mean_7, 6) AS rolling_mean_7, round(rolling_mean_28, 6) AS rolling_mean_28,
                  round(rolling_std_28, 6) AS rolling_std_28)
FROM frame"""),
)
def model_frame(spark, folder):
    return round_all(frame(spark, folder))


@query(
    "seasonal_naive",
    with_base("""
SELECT cluster, date, units, lag(units, 7) OVER (PARTITION BY cluster ORDER BY date) AS pred_seasonal_naive_7d
FROM base"""),
)
def seasonal_naive(spark, folder):
    return evaluate.seasonal_naive(total(spark, folder))


@query(
    "moving_average",
    with_base("""
SELECT cluster, date, units, round(avg(units) OVER (PARTITION BY cluster ORDER BY date
         ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS pred_moving_avg_7d
FROM base"""),
)
def moving_average(spark, folder):
    return rounded(evaluate.moving_average(total(spark, folder)), "pred_moving_avg_7d")


@query(
    "daily_trend",
    with_base("""
SELECT date, units, round(avg(units) OVER (ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 6) AS rolling_28d
FROM (SELECT date, sum(units) AS units FROM sales GROUP BY date)"""),
)
def daily_trend(spark, folder):
    return rounded(profile.daily_trend(light_fact(spark, folder)), "rolling_28d")


@query(
    "daily_tail",
    with_base("""
SELECT date, units, round(avg(units) OVER (ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW), 6) AS rolling_28d
FROM (SELECT date, sum(units) AS units FROM sales GROUP BY date) ORDER BY date DESC LIMIT 90"""),
)
def daily_tail(spark, folder):
    return rounded(
        profile.daily_tail(profile.daily_trend(light_fact(spark, folder))), "rolling_28d"
    )


@query(
    "top_stores",
    with_base("""SELECT store_id, sum(units) AS units FROM sales GROUP BY store_id
                 ORDER BY units DESC, store_id LIMIT 15"""),
)
def top_stores(spark, folder):
    return profile.top_stores(light_fact(spark, folder))


@query(
    "segment_summary",
    with_base("""
SELECT cluster, perishable, round(avg(units), 6) AS avg_units, round(quantile_cont(units, 0.5::DOUBLE), 6) AS median_units,
       round(avg(on_promotion::INT), 6) AS promo_rate
FROM fact GROUP BY cluster, perishable"""),
)
def segment_summary(spark, folder):
    return round_all(profile.segment_summary(classed_fact(spark, folder)))


@query(
    "zero_negative_rates",
    with_base("""
SELECT cluster, count(*) AS rows, round(100 * avg((units = 0)::INT), 2) AS zero_rate_pct,
       round(100 * avg((units < 0)::INT), 2) AS negative_rate_pct, avg(units) AS avg_units
FROM dirty JOIN stores USING (store_id) GROUP BY cluster"""),
)
def zero_negative_rates(spark, folder):
    source = star.Star(spark, folder)
    clusters = star.stores(source).withColumnRenamed("store_nbr", "store_id")
    joined = star.dirty_sales(source).join(clusters, "store_id", "left")
    return profile.zero_negative_rates(joined)


@query(
    "promo_lift",
    with_more(
        """
arms AS (SELECT cluster, avg(units) FILTER (NOT on_promotion) AS avg_units_no_promo,
                avg(units) FILTER (on_promotion) AS avg_units_promo FROM fact GROUP BY cluster)""",
        """
SELECT *, round(avg_units_promo - avg_units_no_promo, 6) AS uplift_abs,
       round(100 * (avg_units_promo - avg_units_no_promo) / nullif(avg_units_no_promo, 0), 2) AS uplift_pct
FROM arms""",
    ),
)
def promo_lift(spark, folder):
    return rounded(profile.promo_lift(light_fact(spark, folder)), "uplift_abs")


_CLIP = """
bounds AS (SELECT quantile_cont(units, 0.01::DOUBLE) AS lo, quantile_cont(units, 0.99::DOUBLE) AS hi FROM fact),
clipped AS (SELECT store_id, product_id, date, units, on_promotion,
                   round(greatest(least(units, hi), lo), 6) AS units_clipped FROM fact, bounds)"""


@query(
    "clip_units",
    with_more(_CLIP, " SELECT store_id, product_id, date, units, units_clipped FROM clipped"),
)
def clip_units(spark, folder):
    rows = light_fact(spark, folder).select("store_id", "product_id", "date", "units")
    return rounded(profile.clip_units(rows), "units_clipped")


@query(
    "clip_medians",
    with_more(
        _CLIP,
        """ SELECT CASE WHEN on_promotion THEN 'Promo' ELSE 'No Promo' END AS promo_label,
                   quantile_cont(units_clipped, 0.5::DOUBLE) AS median_units
            FROM clipped GROUP BY ALL""",
    ),
)
def clip_medians(spark, folder):
    return profile.promo_medians(light_fact(spark, folder))


@query(
    "ecdf",
    with_more(
        _CLIP
        + """,
steps AS (SELECT CASE WHEN on_promotion THEN 'Promo' ELSE 'No Promo' END AS promo_label,
                 units_clipped, count(*) AS n FROM clipped GROUP BY ALL)""",
        """
SELECT promo_label, units_clipped,
       round(CAST(sum(n) OVER (PARTITION BY promo_label ORDER BY units_clipped) AS DOUBLE)
             / CAST(sum(n) OVER (PARTITION BY promo_label) AS DOUBLE), 6) AS cumulative_share
FROM steps""",
    ),
)
def ecdf(spark, folder):
    return rounded(profile.ecdf(light_fact(spark, folder)), "units_clipped", "cumulative_share")


_COUNTS = """
moments AS (
  SELECT 'row_level_overall' AS scope, CAST(NULL AS INTEGER) AS cluster, count(*) AS n_obs, avg(units) AS mean_units,
         var_samp(units) AS variance_units, avg((units = 0)::INT) AS observed_zero_rate FROM fact
  UNION ALL
  SELECT 'segment', cluster, count(*), avg(units), var_samp(units), avg((units = 0)::INT) FROM fact GROUP BY cluster),
stats AS (
  SELECT *, variance_units / mean_units AS dispersion_ratio, exp(-mean_units) AS poisson_expected_zero_rate,
         observed_zero_rate - exp(-mean_units) AS zero_inflation_gap,
         greatest((variance_units - mean_units) / (mean_units * mean_units), 0.0::DOUBLE) AS nb_alpha_estimate
  FROM moments)"""
_COUNT_COLUMNS = """
SELECT scope, cluster, n_obs, round(mean_units, 6) AS mean_units, round(variance_units, 6) AS variance_units,
       round(observed_zero_rate, 6) AS observed_zero_rate, round(dispersion_ratio, 6) AS dispersion_ratio,
       round(poisson_expected_zero_rate, 6) AS poisson_expected_zero_rate,
       round(zero_inflation_gap, 6) AS zero_inflation_gap, round(nb_alpha_estimate, 6) AS nb_alpha_estimate,
       dispersion_ratio <= 1.2 AND abs(zero_inflation_gap) <= 0.02 AS poisson_suitable_flag,
       dispersion_ratio > 1.2 OR zero_inflation_gap > 0.02 AS negbin_preferred_flag
FROM stats"""


@query("count_diagnostics", with_more(_COUNTS, _COUNT_COLUMNS))
def count_diagnostics(spark, folder):
    return round_all(counts.count_diagnostics(light_fact(spark, folder)))


@query(
    "top_dispersion",
    with_more(
        _COUNTS,
        """
SELECT cluster, round(dispersion_ratio, 6) AS dispersion_ratio FROM stats
WHERE scope = 'segment' ORDER BY stats.dispersion_ratio DESC, cluster LIMIT 12""",
    ),
)
def top_dispersion(spark, folder):
    table = counts.count_diagnostics(light_fact(spark, folder)).filter(F.col("scope") == "segment")
    top = evaluate.top_rows(table, "dispersion_ratio", 12, "cluster")
    return rounded(top.select("cluster", "dispersion_ratio"), "dispersion_ratio")


