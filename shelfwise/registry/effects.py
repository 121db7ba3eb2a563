"""Statistical tests: promotions, holidays, cannibalization, residuals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.config import CampaignPlan, TestPlan
from shelfwise.operators import campaign, evaluate, fdr, residuals, scenario
from shelfwise.operators.bootstrap import mean_difference_interval
from shelfwise.operators.residuals import OVERALL
from shelfwise.operators.two_sample import (
    arm_moments,
    average_ranks,
    cohens_d_column,
    rank_sums,
    welch_columns,
)
from shelfwise.plans import cannibalization, diagnostics, promotion
from shelfwise.registry import query
from shelfwise.registry.inputs import (
    fact,
    light_fact,
    promo_days,
    round_all,
    rounded,
    sales_tasks,
    total,
)
from shelfwise.registry.views import with_more
from shelfwise.sources import star

# The SQL twins recompute every draw, so the checked queries use the hash that other engines have.
TESTS = TestPlan(draw_hash="md5")
# Promotions are sparse per store and class in this data; see FIXTURES.md.
CAMPAIGNS = CampaignPlan(
    pre_days=365,
    post_days=365,
    min_promo_days=6,
    max_control_promo_days=3,
    draw_hash="md5",
)

# Tail probabilities in SQL: Simpson's rule over the density from 0 to the statistic.
_T_TAIL = """greatest(1 - 2 * list_sum(list_transform(range(0, 2001), lambda i:
  (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * exp(lgamma(({v} + 1) / 2) - lgamma({v} / 2) - 0.5::DOUBLE * ln({v} * pi())
        - ({v} + 1) / 2 * ln(1 + pow(abs({t}) * i / 2000.0::DOUBLE, 2) / {v}))))
  * abs({t}) / 2000.0::DOUBLE / 3, 0)"""
_Z_TAIL = """greatest(1 - 2 * list_sum(list_transform(range(0, 2001), lambda i:
  (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * exp(-pow(greatest({z}, 0) * i / 2000.0::DOUBLE, 2) / 2) / sqrt(2 * pi())))
  * greatest({z}, 0) / 2000.0::DOUBLE / 3, 0)"""

_WELCH = """(mean_1 - mean_0) / sqrt(var_1 / n_1 + var_0 / n_0) AS welch_t,
  pow(var_1 / n_1 + var_0 / n_0, 2)
    / (pow(var_1 / n_1, 2) / (n_1 - 1) + pow(var_0 / n_0, 2) / (n_0 - 1)) AS welch_df"""
_COHEN = "(mean_1 - mean_0) / sqrt(((n_1 - 1) * var_1 + (n_0 - 1) * var_0) / (n_1 + n_0 - 2)) AS cohens_d"


def _moments(source: str, keys: str, arm: str, value: str) -> str:
    sides = ", ".join(
        f"count({value}) FILTER ({test}) AS n_{s}, avg({value}) FILTER ({test}) AS mean_{s}, "
        f"var_samp({value}) FILTER ({test}) AS var_{s}"
        for s, test in ((1, arm), (0, f"NOT {arm}"))
    )
    return f"SELECT {keys}, {sides} FROM {source} GROUP BY {keys}"


def _boot(
    source: str, keys: str, label: str, arm: str, order: str, value: str, replicates: int = TestPlan.replicates
) -> str:
    """CTEs ``numbered``, ``draws``, ``boot``: bootstrap means with md5 draws."""
    same = " AND ".join(f"d.{k.strip()} = v.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    return f"""
numbered AS (
  SELECT {keys}, {arm} AS arm, {value} AS v, row_number() OVER (PARTITION BY {keys}, {arm} ORDER BY {order}) - 1 AS place,
         count(*) OVER (PARTITION BY {keys}, {arm}) AS n
  FROM {source}),
draws AS (
  SELECT {keys}, arm, r.r AS replicate,
         ('0x' || substr(md5('42|' || {label} || '/' || arm::VARCHAR || '|' || r.r::VARCHAR || '|' || place::VARCHAR), 1, 8))::BIGINT % n AS pick
  FROM numbered, (SELECT unnest(range(0, {replicates})) AS r) r),
boot AS (
  SELECT {keys}, quantile_cont(diff, 0.025::DOUBLE) AS ci_low, quantile_cont(diff, 0.975::DOUBLE) AS ci_high FROM (
    SELECT {picked}, replicate, avg(v.v) FILTER (d.arm) - avg(v.v) FILTER (NOT d.arm) AS diff
    FROM draws d JOIN numbered v ON {same} AND d.arm = v.arm AND d.pick = v.place
    GROUP BY {picked}, replicate)
  GROUP BY {keys})"""


def _bh(source: str, keys: str, p: str, family: str = "") -> str:
    part = f"PARTITION BY {family}" if family else ""
    return f"""
ranked AS (SELECT {keys}, {p} AS p, row_number() OVER ({part} ORDER BY {p}) AS place,
                  count(*) OVER ({part}) AS n FROM {source}),
adjusted AS (SELECT {keys}, least(min(p * n / place) OVER ({part} ORDER BY place
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM ranked)"""


_PROMO_MOMENTS = "promo_moments AS (" + _moments("promo_day", "cluster", "on_promotion", "units") + ")"


@query(
    "welch_t",
    with_more(
        _PROMO_MOMENTS,
        f"""
SELECT cluster, n_1, n_0, round(mean_1, 6) AS mean_1, round(mean_0, 6) AS mean_0, round(var_1, 6) AS var_1,
       round(var_0, 6) AS var_0, round(welch_t, 6) AS welch_t, round(welch_df, 6) AS welch_df
FROM (SELECT *, {_WELCH} FROM promo_moments)""",
    ),
)
def welch_t(spark, folder):
    moments = arm_moments(promo_days(spark, folder), ["cluster"], "on_promotion", "units")
    return round_all(moments.withColumns(welch_columns()))


@query(
    "cohens_d",
    with_more(
        _PROMO_MOMENTS, f" SELECT cluster, round(cohens_d, 6) AS cohens_d FROM (SELECT *, {_COHEN} FROM promo_moments)"
    ),
)
def cohens_d(spark, folder):
    moments = arm_moments(promo_days(spark, folder), ["cluster"], "on_promotion", "units")
    return moments.select("cluster", F.round(cohens_d_column(), 6).alias("cohens_d"))


_RANKS = """
ranks AS (
  SELECT *, rank() OVER (PARTITION BY cluster ORDER BY units)
            + (count(*) OVER (PARTITION BY cluster, units) - 1) / 2.0::DOUBLE AS r
  FROM promo_day),
ties AS (SELECT cluster, sum(pow(t, 3) - t) AS tie_term
         FROM (SELECT cluster, units, count(*) AS t FROM promo_day GROUP BY ALL) GROUP BY cluster),
rank_stats AS (
  SELECT *, (greatest(u_statistic, n_1 * n_0 - u_statistic) - n_1 * n_0 / 2.0::DOUBLE - 0.5::DOUBLE)
       / sqrt(n_1 * n_0 / 12.0::DOUBLE * ((n_1 + n_0 + 1) - tie_term / ((n_1 + n_0) * (n_1 + n_0 - 1)))) AS mann_whitney_z
  FROM (SELECT cluster, count_if(on_promotion) AS n_1, count_if(NOT on_promotion) AS n_0,
               sum(r) FILTER (on_promotion) AS rank_sum,
               sum(r) FILTER (on_promotion) - count_if(on_promotion) * (count_if(on_promotion) + 1) / 2.0::DOUBLE AS u_statistic
        FROM ranks GROUP BY cluster) JOIN ties USING (cluster))"""


@query(
    "rank_sum",
    with_more(
        _RANKS,
        """ SELECT cluster, CAST(n_1 AS BIGINT) AS n_1, CAST(n_0 AS BIGINT) AS n_0, u_statistic, tie_term, rank_sum,
                   round(mann_whitney_z, 6) AS mann_whitney_z FROM rank_stats""",
    ),
)
def rank_sum(spark, folder):
    table = rank_sums(promo_days(spark, folder), ["cluster"], "on_promotion", "units")
    return rounded(table, "mann_whitney_z")


@query(
    "average_rank",
    with_more(
        """
ranks AS (SELECT cluster, date, units, rank() OVER (PARTITION BY cluster ORDER BY units)
            + (count(*) OVER (PARTITION BY cluster, units) - 1) / 2.0::DOUBLE AS rank FROM base)""",
        " SELECT * FROM ranks",
    ),
)
def average_rank(spark, folder):
    return average_ranks(total(spark, folder), ["cluster"], "units")


@query(
    "bootstrap_ci",
    with_more(
        _boot("promo_day", "cluster", "cluster::VARCHAR", "on_promotion", "date", "units"),
        " SELECT cluster, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM boot",
    ),
)
def bootstrap_ci(spark, folder):
    place = F.row_number().over(Window.partitionBy("cluster", "on_promotion").orderBy("date")) - 1
    samples = promo_days(spark, folder).withColumn("place", place)
    return round_all(
        mean_difference_interval(
            samples, ["cluster"], "on_promotion", "place", "units", TESTS.replicates, hash_name="md5", bounded=True
        )
    )


_STORE_P = """
scores AS (SELECT store_id, round(avg(units), 6) AS m, count(*) AS n FROM sales GROUP BY store_id),
tests AS (SELECT s.store_id, st.cluster, round(abs(s.m - 25.5::DOUBLE) / 25.5::DOUBLE, 4) AS p_value
          FROM scores s JOIN stores st ON s.store_id = st.store_id),"""


@query(
    "fdr_adjust",
    with_more(
        _STORE_P + _bh("tests", "store_id, cluster", "p_value", "cluster"),
        """ SELECT t.store_id, t.cluster, t.p_value, a.q AS fdr_qvalue
            FROM tests t JOIN adjusted a ON t.store_id = a.store_id""",
    ),
)
def fdr_adjust(spark, folder):
    """Adjusted values of one score in [0, 1] per store, inside its cluster, with ties."""
    score = F.round(F.abs(F.round(F.avg("units"), 6) - 25.5) / 25.5, 4)
    tests = light_fact(spark, folder).groupBy("store_id", "cluster").agg(score.alias("p_value"))
    return fdr.adjust(tests, "p_value", ["cluster"])


_PROMO_TESTED = (
    _PROMO_MOMENTS
    + ","
    + _RANKS
    + ","
    + _boot("promo_day", "cluster", "cluster::VARCHAR", "on_promotion", "date", "units")
    + f""",
promo_tested AS (
  SELECT m.*, b.ci_low, b.ci_high, {_T_TAIL.format(t="welch_t", v="welch_df")} AS p,
         {_Z_TAIL.format(z="mann_whitney_z")} AS mw
  FROM (SELECT *, {_WELCH}, {_COHEN} FROM promo_moments WHERE n_1 >= 30 AND n_0 >= 30) m
  JOIN rank_stats r ON m.cluster = r.cluster JOIN boot b ON m.cluster = b.cluster),"""
    + _bh("promo_tested", "cluster", "p")
    + """,
promo_report AS (
  SELECT t.cluster, n_1 AS n_days_promo, n_0 AS n_days_nonpromo, round(mean_1, 6) AS mean_promo,
    round(mean_0, 6) AS mean_nonpromo, round(mean_1 - mean_0, 6) AS uplift_abs,
    round(100 * (mean_1 - mean_0) / mean_0, 6) AS uplift_pct, round(cohens_d, 6) AS cohens_d,
    round(p, 6) AS welch_t_pvalue, round(mw, 6) AS mannwhitney_pvalue, round(ci_low, 6) AS mean_diff_ci95_low,
    round(ci_high, 6) AS mean_diff_ci95_high, p < 0.05 AS significant_0_05, round(q, 6) AS welch_fdr_qvalue,
    q < 0.05 AS significant_fdr_0_05
  FROM promo_tested t JOIN adjusted a ON t.cluster = a.cluster)"""
)


def promo_report(spark, folder):
    return promotion.promotion_report(star.raw_tables(spark, folder), TESTS)


@query("promo_significance", with_more(_PROMO_TESTED, " SELECT * FROM promo_report"))
def promo_significance(spark, folder):
    return round_all(promo_report(spark, folder))


_ACTION_TESTED = (
    """
long_days AS (
  SELECT 'promotion' AS event_type, cluster, date, units, on_promotion AS event FROM any_day
  UNION ALL SELECT 'holiday', cluster, date, units, is_holiday_event FROM any_day),
action_moments AS ("""
    + _moments("long_days", "event_type, cluster", "event", "units")
    + "),"
    + _boot("long_days", "event_type, cluster", "event_type || '/' || cluster::VARCHAR", "event", "date", "units")
    + f""",
action_tested AS (
  SELECT m.*, b.ci_low, b.ci_high, {_T_TAIL.format(t="welch_t", v="welch_df")} AS p
  FROM (SELECT *, {_WELCH}, {_COHEN} FROM action_moments WHERE n_1 >= 30 AND n_0 >= 30) m
  JOIN boot b ON m.cluster = b.cluster AND m.event_type = b.event_type),"""
    + _bh("action_tested", "event_type, cluster", "p", "event_type")
    + """,
action_report AS (
  SELECT t.event_type, t.cluster, n_1 AS n_event_days, n_0 AS n_non_event_days, round(mean_1, 6) AS mean_event,
    round(mean_0, 6) AS mean_non_event, round(mean_1 - mean_0, 6) AS uplift_abs,
    round(100 * (mean_1 - mean_0) / mean_0, 6) AS uplift_pct, round(cohens_d, 6) AS cohens_d,
    round(p, 6) AS welch_t_pvalue, round(ci_low, 6) AS mean_diff_ci95_low, round(ci_high, 6) AS mean_diff_ci95_high,
    round(q, 6) AS fdr_qvalue, q < 0.05 AS significant_fdr_0_05,
    q < 0.05 AND ci_low > 0 AND 100 * (mean_1 - mean_0) / mean_0 >= 5 AS actionable_positive_flag
  FROM action_tested t JOIN adjusted a ON t.cluster = a.cluster AND t.event_type = a.event_type)"""
)


def action_report(spark, folder):
    return promotion.action_report(star.raw_tables(spark, folder), TESTS)


@query("action_effects", with_more(_ACTION_TESTED, " SELECT * FROM action_report"))
def action_effects(spark, folder):
    return round_all(action_report(spark, folder))


@query(
    "significance_rollup",
    with_more(
        _ACTION_TESTED,
        """ SELECT event_type, count(*) AS n_results, count_if(significant_fdr_0_05) AS n_flagged,
                   round(quantile_cont(uplift_pct, 0.5::DOUBLE), 4) AS median_value
            FROM action_report GROUP BY event_type""",
    ),
)
def significance_rollup(spark, folder):
    table = promotion.significance_rollup(
        action_report(spark, folder), "significant_fdr_0_05", "uplift_pct", ["event_type"]
    )
    return rounded(table, "median_value", digits=4)


SCENARIOS = [
    ("half the items on promotion", 0.5, 0.0, False),
    ("all items on promotion, holiday", 1.0, 0.0, True),
    ("oil up by 20 percent", 0.0, 0.2, False),
    ("oil down by 30 percent, holiday", 0.25, -0.3, True),
]


@query(
    "scenario_projection",
    with_more(
        _PROMO_MOMENTS
        + """,
cases AS (SELECT * FROM (VALUES """
        + ", ".join(
            f"('{n}', {i}::DOUBLE, {o}::DOUBLE, {str(h).lower()})" for n, i, o, h in SCENARIOS
        )
        + """) t(scenario, promo_intensity, oil_change, holiday)),
lifted AS (SELECT cluster, mean_0, scenario, promo_intensity, oil_change, holiday,
                  promo_intensity * (mean_1 - mean_0) / mean_0 - oil_change * 0.12::DOUBLE
                  + CASE WHEN holiday THEN 0.11::DOUBLE ELSE 0 END AS lift FROM promo_moments, cases
           WHERE n_1 >= 30 AND n_0 >= 30)""",
        """ SELECT cluster, round(mean_0, 6) AS mean_nonpromo, scenario, promo_intensity, oil_change, holiday,
                   round(lift, 6) AS total_lift, round(mean_0 * (1 + lift), 6) AS estimated_units FROM lifted""",
    ),
)
def scenario_projection(spark, folder):
    effects = promotion.promo_effects(promo_days(spark, folder)).select(
        "cluster", F.col("mean_0").alias("mean_nonpromo"), "uplift_pct"
    )
    return round_all(scenario.project(effects, SCENARIOS).drop("uplift_pct"))


_PANEL = """
scd AS (SELECT cluster, store_id, date, product_class, sum(units) AS units, bool_or(on_promotion) AS promo_active
        FROM fact GROUP BY ALL),
panel AS (SELECT *, sum(units) OVER (PARTITION BY cluster, store_id, date) AS store_day_total_units,
                 sum(units) OVER (PARTITION BY cluster, store_id, date) - units AS other_class_units FROM scd),
store_promo AS (SELECT cluster, product_class, store_id, count_if(promo_active) AS promo_days,
                       min(date) FILTER (promo_active) AS first_promo_date FROM panel GROUP BY ALL)"""
_ROLES = (
    _PANEL
    + """,
graded AS (SELECT *, CASE WHEN promo_days >= 6 THEN 'treated' WHEN promo_days <= 3 THEN 'control' END AS role
           FROM store_promo),
pairs AS (SELECT cluster, product_class, min(first_promo_date) FILTER (role = 'treated') AS campaign_start
          FROM graded WHERE role IS NOT NULL GROUP BY ALL
          HAVING count_if(role = 'treated') >= 2 AND count_if(role = 'control') >= 2),
roles AS (SELECT g.cluster, g.product_class, g.store_id, g.role, g.promo_days, p.campaign_start
          FROM graded g JOIN pairs p ON g.cluster = p.cluster AND g.product_class = p.product_class
          WHERE g.role IS NOT NULL AND p.campaign_start IS NOT NULL)"""
)
_WINDOWED = (
    _ROLES
    + """,
windowed AS (SELECT r.cluster, r.product_class, r.store_id, n.date, n.other_class_units, r.role, r.campaign_start,
                    CASE WHEN n.date < r.campaign_start THEN 'pre' ELSE 'post' END AS period
             FROM panel n JOIN roles r ON n.cluster = r.cluster AND n.product_class = r.product_class
              AND n.store_id = r.store_id
             WHERE n.date >= r.campaign_start - 365 AND n.date <= r.campaign_start + 364),
changes AS (SELECT *, post - pre AS change FROM (
              SELECT cluster, product_class, store_id, role, campaign_start,
                     avg(other_class_units) FILTER (period = 'pre') AS pre,
                     avg(other_class_units) FILTER (period = 'post') AS post
              FROM windowed GROUP BY ALL)
            WHERE pre IS NOT NULL AND post IS NOT NULL)"""
)
_DID = (
    _WINDOWED
    + """,
arms AS (SELECT *, role = 'treated' AS treated FROM changes),
did_moments AS ("""
    + _moments("arms", "cluster, product_class", "treated", "change")
    + "),"
    + _boot("arms", "cluster, product_class", "cluster::VARCHAR || '/' || product_class::VARCHAR || '/' || campaign_start::VARCHAR", "treated", "store_id", "change", CAMPAIGNS.replicates).replace(
        "SELECT cluster, product_class, treated AS arm,", "SELECT cluster, product_class, campaign_start, treated AS arm,"
    )
    + f""",
did_report AS (
  SELECT m.cluster, m.product_class, l.campaign_start, n_1 AS n_treated_stores, n_0 AS n_control_stores,
    l.tp AS treated_pre_mean_other_class_units, l.tq AS treated_post_mean_other_class_units,
    l.cp AS control_pre_mean_other_class_units, l.cq AS control_post_mean_other_class_units,
    mean_1 - mean_0 AS did_effect_other_class_units, 100 * (mean_1 - mean_0) / nullif(l.cp, 0) AS did_pct_of_control_pre,
    b.ci_low AS did_ci95_low, b.ci_high AS did_ci95_high, {_T_TAIL.format(t="welch_t", v="welch_df")} AS welch_t_pvalue
  FROM (SELECT *, {_WELCH} FROM did_moments WHERE n_1 >= 2 AND n_0 >= 2) m
  JOIN boot b ON m.cluster = b.cluster AND m.product_class = b.product_class
  JOIN (SELECT cluster, product_class, campaign_start, avg(pre) FILTER (treated) AS tp, avg(post) FILTER (treated) AS tq,
               avg(pre) FILTER (NOT treated) AS cp, avg(post) FILTER (NOT treated) AS cq FROM arms GROUP BY ALL) l
    ON m.cluster = l.cluster AND m.product_class = l.product_class)"""
)
_DID_COLUMNS = """cluster, product_class, campaign_start, n_treated_stores, n_control_stores,
  round(treated_pre_mean_other_class_units, 6) AS treated_pre_mean_other_class_units,
  round(treated_post_mean_other_class_units, 6) AS treated_post_mean_other_class_units,
  round(control_pre_mean_other_class_units, 6) AS control_pre_mean_other_class_units,
  round(control_post_mean_other_class_units, 6) AS control_post_mean_other_class_units,
  round(did_effect_other_class_units, 6) AS did_effect_other_class_units,
  round(did_pct_of_control_pre, 6) AS did_pct_of_control_pre,
  round(did_ci95_low, 6) AS did_ci95_low, round(did_ci95_high, 6) AS did_ci95_high,
  round(welch_t_pvalue, 6) AS welch_t_pvalue,
  did_effect_other_class_units < 0 AND did_ci95_high < 0 AND welch_t_pvalue < 0.05 AS cannibalization_flag"""


def panel(spark, folder):
    return cannibalization.panel(star.raw_tables(spark, folder))


def window(spark, folder):
    return cannibalization.window(star.raw_tables(spark, folder), CAMPAIGNS)


def effects(spark, folder):
    return cannibalization.report(star.raw_tables(spark, folder), CAMPAIGNS)


@query("cross_class_panel", with_more(_PANEL, " SELECT * FROM panel"))
def cross_class_panel(spark, folder):
    """The operator on the row-level fact."""
    return campaign.cross_class_panel(fact(spark, folder, sales_tasks(spark, folder)))


@query("promo_days", with_more(_PANEL, " SELECT * FROM store_promo"))
def promo_days_per_store(spark, folder):
    return campaign.promo_days(panel(spark, folder))


@query("did_roles", with_more(_ROLES, " SELECT * FROM roles"))
def did_roles(spark, folder):
    return campaign.did_roles(panel(spark, folder), CAMPAIGNS)


@query("did_panel", with_more(_WINDOWED, " SELECT * FROM windowed"))
def did_panel(spark, folder):
    return window(spark, folder)


@query(
    "did_store_change",
    with_more(
        _WINDOWED,
        """ SELECT cluster, product_class, store_id, role, campaign_start, round(pre, 6) AS pre,
                   round(post, 6) AS post, round(change, 6) AS change FROM changes""",
    ),
)
def did_store_change(spark, folder):
    return round_all(campaign.did_store_change(window(spark, folder)))


@query("did_effects", with_more(_DID, f" SELECT {_DID_COLUMNS} FROM did_report"))
def did_effects(spark, folder):
    return round_all(effects(spark, folder))


@query(
    "worst_did",
    with_more(
        _DID,
        f""" SELECT {_DID_COLUMNS} FROM did_report
             ORDER BY did_report.did_effect_other_class_units, cluster, product_class LIMIT 12""",
    ),
)
def worst_did(spark, folder):
    table = evaluate.top_rows(
        effects(spark, folder),
        "did_effect_other_class_units",
        12,
        "cluster",
        "product_class",
        descending=False,
    )
    return round_all(table)


_BOX_TERMS = {
    lag: " + ".join(f"pow(p{k} / p0, 2) / (n - {k})" for k in range(1, lag + 1)) for lag in (7, 14)
}
_BOX_SUMS = ", ".join(f"sum(c * c{k}) AS p{k}" for k in range(1, 15))


def _box(partition: str, order: str, keys: str, source: str = "base", value: str = "units") -> str:
    lags = ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, 15))
    group = f" GROUP BY {keys}" if keys else ""
    head = f"{keys}, " if keys else ""
    return f"""
centred AS (SELECT cluster, date, {value} - avg({value}) OVER ({partition}) AS c FROM {source}),
lagged AS (SELECT *, {lags} FROM centred WINDOW w AS ({partition} ORDER BY {order})),
sums AS (SELECT {head}count(*) AS n, sum(c * c) AS p0, stddev_samp(c) AS residual_std, {_BOX_SUMS} FROM lagged{group})"""


_BOX_COLUMNS = f"""n AS n_obs, round(residual_std, 6) AS residual_std,
  round(n * (n + 2) * ({_BOX_TERMS[7]}), 6) AS ljung_box_q7, round(n * (n + 2) * ({_BOX_TERMS[14]}), 6) AS ljung_box_q14"""


@query(
    "ljung_box",
    with_more(_box("PARTITION BY cluster", "date", "cluster"), f" SELECT cluster, {_BOX_COLUMNS} FROM sums"),
)
def ljung_box(spark, folder):
    return round_all(residuals.ljung_box(total(spark, folder), "cluster", "date", "units"))


@query(
    "ljung_box_overall",
    with_more(_box("", "cluster, date", ""), f" SELECT {_BOX_COLUMNS} FROM sums"),
)
def ljung_box_overall(spark, folder):
    return round_all(
        residuals.ljung_box_overall(total(spark, folder), "cluster", "date", "units", block=4096)
    )


# Least squares in SQL: moments of all columns, then a sweep that passes over columns others determine.
_N_COLUMNS = 24


def _solve(name: str, source: str, y: str) -> str:
    """CTEs ``{name}_fit``: (cluster, beta, rank) of the regression of ``y`` on the list ``x``."""
    p, q = _N_COLUMNS, _N_COLUMNS + 1
    return f"""
{name}_moments AS (
  SELECT cluster, i, list(v ORDER BY j) AS line FROM (
    SELECT cluster, i, j, sum(x[i] * xy[j]) AS v
    FROM (SELECT cluster, x, list_append(x, {y}) AS xy FROM {source}),
         (SELECT unnest(range(1, {p + 1})) AS i), (SELECT unnest(range(1, {q + 1})) AS j)
    GROUP BY cluster, i, j)
  GROUP BY cluster, i),
{name}_sweep AS (
  SELECT cluster, 0::BIGINT AS k, 0::BIGINT AS rank, list(line ORDER BY i) AS m FROM {name}_moments GROUP BY cluster
  UNION ALL
  SELECT cluster, k + 1, rank + (m[k + 1][k + 1] > 1e-9 * n)::INT,
         CASE WHEN m[k + 1][k + 1] > 1e-9 * n THEN
           list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {q + 1}), lambda j:
             CASE WHEN i = k + 1 THEN m[i][j] / m[i][i]
                  ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END))
         ELSE m END
  FROM {name}_sweep JOIN sizes USING (cluster) WHERE k < {p}),
{name}_fit AS (
  SELECT cluster, rank,
         list_transform(range(1, {p + 1}), lambda i: CASE WHEN abs(m[i][i] - 1) < 1e-6 THEN m[i][{q}] ELSE 0 END) AS beta
  FROM {name}_sweep WHERE k = {p})"""


def _ols(group: str) -> str:
    """CTEs ``ols`` (rows) and ``ols_stats``; ``group`` is the segment of the model."""
    names = ("promo_rate", "holiday_rate", "avg_store_transactions", "oil_price")
    means = ", ".join(f"avg({c}) AS m_{c}, CASE WHEN max({c}) > min({c}) THEN stddev_pop({c}) END AS s_{c}" for c in names)
    scaled = ", ".join(f"coalesce(({c} - m_{c}) / s_{c}, 0)" for c in names)
    days = ", ".join(f"(dow = {d})::INT::DOUBLE" for d in range(7))
    months = ", ".join(f"(month = {m})::INT::DOUBLE" for m in range(1, 13))
    return f"""
cov AS (
  SELECT {group} AS cluster, cluster AS segment, date, units, promo_rate, holiday_rate,
    coalesce(last_value(avg_store_transactions IGNORE NULLS) OVER back,
             first_value(avg_store_transactions IGNORE NULLS) OVER ahead) AS avg_store_transactions,
    coalesce(last_value(oil_price IGNORE NULLS) OVER back, first_value(oil_price IGNORE NULLS) OVER ahead) AS oil_price,
    isodow(date) - 1 AS dow, month(date) AS month
  FROM base
  WINDOW back AS (PARTITION BY cluster ORDER BY date ROWS UNBOUNDED PRECEDING),
         ahead AS (PARTITION BY cluster ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
sizes AS (
  SELECT cluster, count(*) AS n, avg(units) AS mean, {means},
         5 + count(DISTINCT dow) - 1 + count(DISTINCT month) - 1 AS n_params
  FROM cov GROUP BY cluster),
design AS (
  SELECT c.cluster, segment, date, units, units - mean AS y, [1::DOUBLE, {scaled}, {days}, {months}] AS x
  FROM cov c JOIN sizes s ON c.cluster = s.cluster),
{_solve("line", "design", "y")},
scored AS (
  SELECT d.*, y - list_dot_product(x, beta) AS e,
         pow(y - list_dot_product(x, beta), 2) / avg(pow(y - list_dot_product(x, beta), 2)) OVER (PARTITION BY d.cluster) - 1 AS u
  FROM design d JOIN line_fit f ON d.cluster = f.cluster),
{_solve("squares", "scored", "u")},
ols_stats AS (
  SELECT *, n * aux_r2 AS bp_lm, CAST(rank - 1 AS INTEGER) AS bp_df_model, CAST(n - rank AS INTEGER) AS bp_df_resid,
         (aux_r2 / (rank - 1)) / ((1 - aux_r2) / (n - rank)) AS bp_f
  FROM (SELECT s.cluster, any_value(z.n) AS n, CAST(any_value(z.n_params) AS INTEGER) AS n_params, any_value(f.rank) AS rank,
               1 - sum(e * e) / sum(y * y) AS r_squared,
               1 - sum(pow(u - list_dot_product(x, f.beta), 2)) / (sum(u * u) - sum(u) * sum(u) / count(*)) AS aux_r2
        FROM scored s JOIN squares_fit f ON s.cluster = f.cluster JOIN sizes z ON s.cluster = z.cluster
        GROUP BY s.cluster)),
ols AS (
  SELECT s.cluster, segment, date, units, units - e AS fitted, e AS residual, r_squared, n_params, bp_lm, bp_f, bp_df_model, bp_df_resid
  FROM scored s JOIN ols_stats t ON s.cluster = t.cluster)"""


def _chi_square_tail(x: str, df: str) -> str:
    """Upper tail for whole degrees of freedom, by its finite sums."""
    half = f"({x} / 2)"
    even = f"list_sum(list_transform(range(0, {df} // 2), lambda j: exp(-{half} + j * ln({half}) - lgamma(j + 1))))"
    odd = (
        f"(CASE WHEN {df} > 1 THEN list_sum(list_transform(range(0, ({df} - 1) // 2), "
        f"lambda j: exp(-{half} + (j + 0.5::DOUBLE) * ln({half}) - lgamma(j + 1.5::DOUBLE)))) ELSE 0 END)"
    )
    return f"(CASE WHEN {df} % 2 = 0 THEN {even} ELSE {_Z_TAIL.format(z=f'sqrt({x})')} + {odd} END)"


def _f_tail(f: str, d1: str, d2: str) -> str:
    """Upper tail: Simpson's rule over the beta density up to d2 / (d2 + d1 f)."""
    end = f"({d2} / ({d2} + {d1} * {f}))"
    return f"""(list_sum(list_transform(range(1, 20001), lambda i:
      (CASE WHEN i = 20000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * exp(({d2} / 2 - 1) * ln({end} * i / 20000) + ({d1} / 2 - 1) * ln(1 - {end} * i / 20000)
            + lgamma(({d1} + {d2}) / 2) - lgamma({d1} / 2) - lgamma({d2} / 2))))
      * {end} / 20000 / 3)"""


_BP_TAILS = f"""round({_chi_square_tail("bp_lm", "(n_params - 1)")}, 6) AS breusch_pagan_lm_pvalue,
  round({_f_tail("bp_f", "bp_df_model::DOUBLE", "bp_df_resid::DOUBLE")}, 6) AS breusch_pagan_f_pvalue"""


def _report(group: str, name: str) -> tuple[str, str]:
    """CTEs and select of the report of residuals, one row per model."""
    partition, order, keys = ("PARTITION BY cluster", "date", "cluster") if name == "cluster" else ("", "cluster, date", "")
    rows = "rows_of AS (SELECT segment AS cluster, date, residual FROM ols)," if not keys else "rows_of AS (SELECT * FROM ols),"
    box = _box(partition, order, keys, "rows_of", "residual")
    joined = "sums JOIN (SELECT * EXCLUDE (n) FROM ols_stats) USING (cluster)"
    if not keys:
        joined = "sums, (SELECT * EXCLUDE (n, cluster) FROM ols_stats)"
    columns = f"cluster AS {name}" if keys else f"'{OVERALL}' AS scope"
    tails = ", ".join(
        f"round({_chi_square_tail(f'ljung_box_q{lag}', str(lag))}, 6) AS ljung_box_pvalue_lag{lag}" for lag in (7, 14)
    )
    return (
        _ols(group) + "," + rows + box,
        f"""
SELECT *, breusch_pagan_lm_pvalue < 0.05::DOUBLE AS heteroskedasticity_flag,
       ljung_box_pvalue_lag7 < 0.05::DOUBLE AS autocorrelation_flag_lag7,
       ljung_box_pvalue_lag14 < 0.05::DOUBLE AS autocorrelation_flag_lag14
FROM (SELECT {columns}, n_obs, round(r_squared, 6) AS r_squared, {_BP_TAILS}, {tails}, residual_std
      FROM (SELECT * EXCLUDE (n, residual_std), n AS n_obs, round(residual_std, 6) AS residual_std,
                   n * (n + 2) * ({_BOX_TERMS[7]}) AS ljung_box_q7, n * (n + 2) * ({_BOX_TERMS[14]}) AS ljung_box_q14
            FROM {joined}))""",
    )


def _with_recursive(ctes: str, select: str) -> str:
    return with_more(ctes, select).replace("WITH sales", "WITH RECURSIVE sales", 1)


def _residual_rows(spark, folder):
    return residuals.ols_segment(diagnostics.covariates(star.raw_tables(spark, folder)))


@query(
    "ols_segment",
    _with_recursive(
        _ols("cluster"),
        """ SELECT cluster, date, units, round(fitted, 4) AS fitted, round(residual, 4) + 0.0::DOUBLE AS residual,
                   round(r_squared, 6) AS r_squared, n_params, round(bp_lm, 6) AS bp_lm, round(bp_f, 6) AS bp_f,
                   bp_df_model, bp_df_resid FROM ols""",
    ),
)
def ols_segment(spark, folder):
    rows = round_all(rounded(_residual_rows(spark, folder), "fitted", "residual", digits=4))
    return rows.withColumn("residual", F.col("residual") + F.lit(0.0))


@query(
    "breusch_pagan",
    _with_recursive(
        _ols("cluster"),
        f""" SELECT cluster, round(bp_lm, 6) AS bp_lm, round(bp_f, 6) AS bp_f, n_params, bp_df_model, bp_df_resid,
                    {_BP_TAILS} FROM ols_stats""",
    ),
)
def breusch_pagan(spark, folder):
    stats = _residual_rows(spark, folder).groupBy("cluster").agg(
        *[F.first(c).alias(c) for c in ("bp_lm", "bp_f", "n_params", "bp_df_model", "bp_df_resid")]
    )
    return round_all(stats.withColumns(residuals.breusch_pagan_columns()))


@query("residual_diagnostics", _with_recursive(*_report("cluster", "cluster")))
def residual_diagnostics(spark, folder):
    return round_all(diagnostics.by_segment(star.raw_tables(spark, folder)))


@query("residual_diagnostics_overall", _with_recursive(*_report("0", "scope")))
def residual_diagnostics_overall(spark, folder):
    return round_all(diagnostics.overall(star.raw_tables(spark, folder)))
