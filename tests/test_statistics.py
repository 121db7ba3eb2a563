"""Statistics against closed forms, brute force and published tables."""

from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.config import CampaignPlan, Roles, SeasonalOrder, TestPlan
from shelfwise.functions import tails
from shelfwise.functions.ordered import exact_quantiles, number_rows
from shelfwise.models import seasonal
from shelfwise.operators import campaign, counts, evaluate, fdr, profile, residuals
from shelfwise.operators.bootstrap import mean_difference_interval
from shelfwise.operators.two_sample import arm_moments, average_ranks, cohens_d_column, rank_sums
from shelfwise.plans import promotion

START = date(2020, 1, 1)


def test_tails_match_known_values_and_the_jvm_library(spark):
    rows = [(2.228139, 10.0), (0.0, 5.0), (40.0, 300.0), (-1.7, 3.3), (1e-9, 2.0), (9.0, 1.5)]
    df = spark.createDataFrame(rows, "t double, v double")
    got = [r[0] for r in df.select(tails.t_two_sided(F.col("t"), F.col("v"))).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-7)
    dist = spark._jvm.org.apache.commons.math3.distribution
    for (t, v), p in zip(rows, got):
        # The library's own upper tail loses digits, so its lower tail is compared.
        assert p == pytest.approx(2 * dist.TDistribution(v).cumulativeProbability(-abs(t)), rel=1e-9)
    pairs = [(7.0, 7.0), (30.0, 14.0), (0.1, 3.0), (200.0, 21.0)]
    df = spark.createDataFrame(pairs, "x double, k double")
    got = [r[0] for r in df.select(tails.chi_square_upper(F.col("x"), F.col("k"))).collect()]
    for (x, k), p in zip(pairs, got):
        exact = spark._jvm.org.apache.commons.math3.special.Gamma.regularizedGammaQ(k / 2, x / 2)
        assert p == pytest.approx(exact, rel=1e-9)
    triples = [(1.0, 3.0, 10.0), (4.5, 21.0, 400.0), (0.2, 5.0, 9.0)]
    df = spark.createDataFrame(triples, "x double, a double, b double")
    got = [r[0] for r in df.select(tails.f_upper(F.col("x"), F.col("a"), F.col("b"))).collect()]
    for (x, a, b), p in zip(triples, got):
        assert p == pytest.approx(1 - dist.FDistribution(a, b).cumulativeProbability(x), abs=1e-10)
    df = spark.createDataFrame([(1.959963985,), (None,), (-0.5,)], "z double")
    got = [r[0] for r in df.select(tails.normal_two_sided_upper(F.col("z"))).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-9) and got[1] is None and got[2] == 1.0


def _bh(p):
    p = np.asarray(p, float)
    order = np.argsort(p)
    q = np.empty(len(p))
    best = 1.0
    for place in range(len(p), 0, -1):
        best = min(best, p[order[place - 1]] * len(p) / place)
        q[order[place - 1]] = best
    return q


def test_fdr_against_brute_force_with_ties_and_nulls(spark):
    rng = np.random.default_rng(1)
    p = np.round(rng.uniform(size=400) ** 4, 3)
    rows = [(i, "ab"[i % 2], float(x)) for i, x in enumerate(p)] + [(999, "a", None)]
    df = spark.createDataFrame(rows, "id int, family string, p double")
    got = {r.id: r.fdr_qvalue for r in fdr.adjust(df, "p", ["family"]).collect()}
    assert got.pop(999) is None
    for side in (0, 1):
        want = _bh(p[side::2])
        assert np.allclose([got[i] for i in range(side, 400, 2)], want, rtol=1e-12)
    assert all(got[i] >= p[i] - 1e-15 for i in got)


def test_fdr_on_published_holiday_tests(spark):
    # P-values and adjusted values of 17 published holiday tests.
    published = [
        (0.0049426650085018994, 0.014004217524088716),
        (0.002523047656761143, 0.010722952541234858),
        (0.0018947383200680595, 0.010722952541234858),
        (0.003671856374218594, 0.012484311672343219),
        (0.001421299516698329, 0.010722952541234858),
        (0.001827454502615585, 0.010722952541234858),
        (0.007353074400092987, 0.017857466400225824),
        (0.053348298520863445, 0.06478007677533418),
        (0.031262703795395946, 0.04592628047620532),
        (0.010240628658353701, 0.021761335899001616),
        (0.03241855092438023, 0.04592628047620532),
        (0.012448511531647792, 0.02351385511533472),
        (0.023642242988502173, 0.04019181308045369),
        (0.0469973624699117, 0.06145808938373069),
        (0.10427450926688503, 0.11817777716913637),
        (0.4637442224612885, 0.49272823636511903),
        (0.634780253270219, 0.634780253270219),
    ]
    df = spark.createDataFrame(published, "p double, want double")
    assert all(r.fdr_qvalue == pytest.approx(r.want, rel=1e-12) for r in fdr.adjust(df, "p").collect())


def test_backtest_summary_on_published_folds(spark):
    # Published 7-day MAE of two folds.
    rows = [(1, 7, "m", 2042.6845703125, 3054.073974609375, 4.389816761016846),
            (2, 7, "m", 2552.171630859375, 3800.412353515625, 5.410452365875244)]
    df = spark.createDataFrame(rows, "fold int, horizon_days int, model string, mae double, rmse double, mape_pct double")
    out = evaluate.backtest_summary(df).first()
    assert out.mae_mean == pytest.approx(np.mean([r[3] for r in rows]))
    assert out.mae_std == pytest.approx(np.std([r[3] for r in rows], ddof=1))


def test_leaderboard_on_published_models(spark):
    # Published MAE and RMSE of seven models with their ranks.
    rows = [
        ("gbt_a", 2281.087646484375, 3470.681884765625, 5.2, 1, 2),
        ("gbt_b", 2322.247874134877, 3437.51378457221, 5.5, 2, 1),
        ("gbt_c", 2507.4573873782288, 3708.666839993944, 6.0, 3, 3),
        ("tuned", 3073.1517432376972, 4635.914919659627, 6.6, 4, 4),
        ("elastic", 4287.452719738319, 6146.178096363917, 12.0, 5, 5),
        ("seasonal", 4305.610265062486, 6686.011407736591, 9.1, 6, 6),
        ("seasonal_naive_7d", 5696.94775390625, 9233.2958984375, 12.0, 7, 7),
    ]
    df = spark.createDataFrame(rows, "model string, mae double, rmse double, mape_pct double, a int, b int")
    out = {r.model: r for r in evaluate.leaderboard(df.drop("a", "b")).collect()}
    assert all((out[r[0]].rank_mae, out[r[0]].rank_rmse) == (r[4], r[5]) for r in rows)
    assert out["gbt_a"].tier == "good" and out["tuned"].tier == "fair" and out["elastic"].tier == "poor"
    assert out["tuned"].best_model == "gbt_a"
    assert out["gbt_a"].vs_naive_pct == pytest.approx(59.96, abs=0.01)


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(size=500), np.zeros(300), rng.lognormal(3, 2, 500), [-1e-300, 1e300]])
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(len(values)) % 3, "v": values}))
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"a": 0.01, "b": 0.5, "c": 0.99, "d": 1.0}).collect()}
    for g in range(3):
        want = np.quantile(values[np.arange(len(values)) % 3 == g], [0.01, 0.5, 0.99, 1.0])
        assert np.allclose([got[g].a, got[g].b, got[g].c, got[g].d], want, rtol=1e-12, atol=1e-12)


def test_positions_are_whole_and_ordered(spark):
    rng = np.random.default_rng(3)
    ids = rng.choice(10**6, size=3000, replace=False)
    df = spark.createDataFrame(pd.DataFrame({"g": ids % 2, "i": ids}))
    rows = number_rows(df, ["g"], "i", "place", width=1000).collect()
    for g in (0, 1):
        ordered = sorted((r.place, r.i) for r in rows if r.g == g)
        assert [p for p, _ in ordered] == list(range(len(ordered)))
        assert [i for _, i in ordered] == sorted(i for i in ids if i % 2 == g)


def test_row_sample_is_exact_with_a_hot_group_of_copies(spark):
    rows = [(1, "same")] * 3000 + [(i, "own") for i in range(6000)]
    df = spark.createDataFrame(rows, "a int, b string")
    for wanted in (10, 4000, 8999):
        one = sorted(map(tuple, profile.row_sample(df.repartition(7), wanted).collect()))
        two = sorted(map(tuple, profile.row_sample(df.repartition(3, "b"), wanted).collect()))
        assert one == two and len(one) == wanted
    assert profile.row_sample(df, 10**6).count() == 9000


def _bootstrap_rows(rng, n):
    return [(k, arm, place, float(rng.normal(5 + 3 * arm))) for k in "xy" for arm in (True, False) for place in range(n)]


def test_bootstrap_paths_agree_and_cover(spark):
    rows = _bootstrap_rows(np.random.default_rng(4), 60)
    df = spark.createDataFrame(rows, "k string, arm boolean, place int, v double")
    for name in ("xxhash64", "md5"):
        args = (["k"], "arm", "place", "v", 120, 7, 0.05, name)
        arrays = {r.k: (r.ci_low, r.ci_high) for r in mean_difference_interval(df, *args, bounded=True).collect()}
        mixed = {r.k: (r.ci_low, r.ci_high) for r in mean_difference_interval(df, *args).collect()}
        for k in "xy":
            assert arrays[k] == pytest.approx(mixed[k], rel=1e-12)
            x = [r[3] for r in rows if r[0] == k and r[1]]
            y = [r[3] for r in rows if r[0] == k and not r[1]]
            assert arrays[k][0] < np.mean(x) - np.mean(y) < arrays[k][1]
            spread = np.sqrt(np.var(x) / 60 + np.var(y) / 60)
            assert (arrays[k][1] - arrays[k][0]) / (2 * 1.96 * spread) == pytest.approx(1.0, abs=0.25)


def test_rank_sum_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 12, 40).astype(float), rng.integers(3, 15, 35).astype(float)
    df = spark.createDataFrame([(1, True, v) for v in x.tolist()] + [(1, False, v) for v in y.tolist()], "k int, arm boolean, v double")
    out = rank_sums(df, ["k"], "arm", "v").first()
    u = sum((a > b) + 0.5 * (a == b) for a in x for b in y)
    assert out.u_statistic == u
    ranks = average_ranks(df, ["k"], "v").filter("arm").agg(F.sum("rank")).first()[0]
    assert ranks == out.rank_sum == pd.Series(np.concatenate([x, y])).rank()[:40].sum()


def test_cohens_d_of_constant_arms_is_null(spark):
    df = spark.createDataFrame([(1, True, 2.0), (1, True, 2.0), (1, False, 1.0), (1, False, 1.0), (2, True, 1.0), (2, False, 2.0)], "k int, arm boolean, v double")
    out = arm_moments(df, ["k"], "arm", "v").select(cohens_d_column().alias("d")).collect()
    assert [r.d for r in out] == [None, None]


def test_small_segments_are_left_out(spark):
    rows = [(c, START + timedelta(i), i % 2 == 0, float(i % 7)) for c, n in ((1, 80), (2, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "cluster int, date date, on_promotion boolean, units double")
    out = promotion.promo_significance(df, plan=TestPlan(replicates=20)).collect()
    assert [r.cluster for r in out] == [1]


def test_count_diagnostics_matches_numpy(spark):
    rng = np.random.default_rng(6)
    units = rng.negative_binomial(2, 0.3, 500).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"cluster": np.arange(500) % 4, "units": units}))
    rows = {(r.scope, r.cluster): r for r in counts.count_diagnostics(df).collect()}
    for key, values in [((counts.ALL_ROWS, None), units), (("segment", 2), units[np.arange(500) % 4 == 2])]:
        r, m, v = rows[key], values.mean(), values.var(ddof=1)
        assert r.variance_units == pytest.approx(v) and r.dispersion_ratio == pytest.approx(v / m)
        assert r.nb_alpha_estimate == pytest.approx((v - m) / m**2) and r.negbin_preferred_flag


def _series(clusters, n, seed):
    rng = np.random.default_rng(seed)
    days = pd.date_range(START, periods=n)
    parts = []
    for c in range(clusters):
        promo = rng.uniform(size=n)
        noise = np.convolve(rng.normal(size=n + 1), [1, 0.6], "valid")
        parts.append(pd.DataFrame({
            "cluster": c, "date": days.date, "promo_rate": promo, "holiday_rate": rng.uniform(size=n),
            "avg_store_transactions": rng.uniform(100, 200, n), "oil_price": rng.uniform(40, 60, n),
            "units": 50 + 30 * promo + 5 * days.dayofweek.to_numpy() + noise * (1 + promo),
            "day_of_week": days.dayofweek.to_numpy(), "month": days.month.to_numpy(),
        }))
    return pd.concat(parts, ignore_index=True)


def _reference_tests(pdf):
    """Brute-force OLS, Breusch-Pagan LM and Ljung-Box Q of rows in their given order."""
    columns = [np.ones(len(pdf))] + [pdf[c].to_numpy(float) for c in residuals.COVARIATES]
    for d in residuals.DUMMIES:
        columns += [(pdf[d] == v).to_numpy(float) for v in sorted(pdf[d].unique())[1:]]
    x, y = np.column_stack(columns), pdf["units"].to_numpy(float)

    def fit(t):
        e = t - x @ np.linalg.pinv(x) @ t
        return e, 1 - (e**2).sum() / ((t - t.mean()) ** 2).sum()

    e, r2 = fit(y)
    n = len(y)
    c = e - e.mean()
    rho = [(c[k:] * c[:-k]).sum() / (c**2).sum() for k in range(1, 15)]
    q = {lag: n * (n + 2) * sum(rho[k - 1] ** 2 / (n - k) for k in range(1, lag + 1)) for lag in (7, 14)}
    return r2, n * fit(e**2)[1], q, x.shape[1]


def test_residual_diagnostics_against_brute_force(spark):
    pdf = _series(3, 200, 7)
    df = spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("date"))
    got = {r.cluster: r for r in residuals.residual_diagnostics(df).collect()}
    gamma = spark._jvm.org.apache.commons.math3.special.Gamma.regularizedGammaQ
    for c in range(3):
        r2, lm, q, k = _reference_tests(pdf[pdf.cluster == c])
        assert got[c].r_squared == pytest.approx(r2)
        assert got[c].breusch_pagan_lm_pvalue == pytest.approx(gamma((k - 1) / 2, lm / 2), rel=1e-6)
        assert got[c].ljung_box_pvalue_lag7 == pytest.approx(gamma(3.5, q[7] / 2), rel=1e-6)
        assert got[c].autocorrelation_flag_lag7
    r2, lm, q, k = _reference_tests(pdf)
    over = residuals.residual_diagnostics_overall(df).first()
    assert over.n_obs == 600 and over.r_squared == pytest.approx(r2)
    assert over.breusch_pagan_lm_pvalue == pytest.approx(gamma((k - 1) / 2, lm / 2), rel=1e-5)
    assert over.ljung_box_pvalue_lag14 == pytest.approx(gamma(7.0, q[14] / 2), rel=1e-5)


def test_small_groups_have_no_residual_report(spark):
    pdf = _series(2, 40, 8)
    pdf = pdf[(pdf.cluster == 0) | (pdf.index % 40 < 20)]
    df = spark.createDataFrame(pdf).withColumn("date", F.col("date").cast("date"))
    assert [r.cluster for r in residuals.residual_diagnostics(df).collect()] == [0]


def test_ljung_box_blocks_do_not_change_the_result(spark):
    pdf = _series(3, 90, 9)
    df = spark.createDataFrame(pdf[["cluster", "date", "units"]]).withColumn("date", F.col("date").cast("date"))
    small = residuals.ljung_box_overall(df, "cluster", "date", "units", block=20).first()
    large = residuals.ljung_box_overall(df, "cluster", "date", "units").first()
    assert small.ljung_box_q14 == pytest.approx(large.ljung_box_q14, rel=1e-12)
    assert small.n_obs == large.n_obs == 270


def test_did_on_a_known_shift(spark):
    rows = []
    for store in range(8):
        treated = store < 4
        for i in range(-20, 20):
            day = START + timedelta(100 + i)
            promo = treated and i >= 0
            drop = 5.0 if promo else 0.0
            rows.append((day, store, 1, 1, 10.0, promo))
            rows.append((day, store, 1, 2, 50.0 + store + (i + store) % 3 - drop, False))
    df = spark.createDataFrame(rows, "date date, store_id bigint, cluster int, product_class int, units double, on_promotion boolean")
    plan = CampaignPlan(replicates=200)
    panel = campaign.cross_class_panel(df)
    changes = campaign.did_store_change(campaign.did_panel(panel, campaign.did_roles(panel, plan), plan))
    out = campaign.did_effects(changes, plan).collect()
    assert [(r.cluster, r.product_class) for r in out] == [(1, 1)]
    assert out[0].did_effect_other_class_units == pytest.approx(-5.0, abs=0.2)
    assert out[0].cannibalization_flag and out[0].n_treated_stores == out[0].n_control_stores == 4
    assert out[0].campaign_start == START + timedelta(100)


def test_seasonal_forecaster_recovers_a_weekly_series():
    rng = np.random.default_rng(10)
    n, ahead = 400, 28
    promo = rng.uniform(size=n + ahead)
    week = np.tile([10.0, 12, 9, 15, 20, 30, 25], 70)[: n + ahead]
    y = 100 + week + 40 * promo + rng.normal(scale=0.5, size=n + ahead)
    inputs = promo[:, None]
    for order in (SeasonalOrder(), SeasonalOrder(0, 1, 1, 0, 1, 1), SeasonalOrder(2, 0, 1, 1, 0, 1)):
        fit = seasonal.seasonal_regression(y[:n], inputs[:n], inputs[n:], order)
        assert np.abs(fit.values - y[n:]).mean() < 3.0, order
    with pytest.raises(ValueError, match="too short"):
        seasonal.seasonal_regression(y[:20], inputs[:20], inputs[n:], SeasonalOrder())


def test_failed_fits_are_reported_not_raised(spark):
    rows = [(1, START + timedelta(i), float(i), 1.0, "train" if i < 15 else "eval") for i in range(20)]
    df = spark.createDataFrame(rows, "cluster int, date date, units double, lag_7 double, split string").withColumn("x", F.lit(1.0))
    out = seasonal.forecast_groups(df, ["cluster"], SeasonalOrder(), Roles(), inputs=["x"]).collect()
    assert len(out) == 5 and all("too short" in r.error and r.prediction is None for r in out)


def test_categorical_trees_take_more_segments_than_bins(spark):
    from shelfwise.config import TreeProfile
    from shelfwise.models import trees
    from shelfwise.models.dataset import split

    day = F.date_add(F.lit(START), (F.col("id") % 20).cast("int"))
    frame = spark.range(100 * 20).select(
        F.floor(F.col("id") / 20).cast("int").alias("cluster"), day.alias("date"),
        (F.floor(F.col("id") / 20) * 3.0).alias("units"), (F.col("id") % 7).cast("double").alias("lag_7"),
    )
    data = split(frame, str(START + timedelta(14)))
    scored = trees.holdout(data, TreeProfile(trees=2, depth=3), categorical=True)
    assert scored.metrics.count() == 2 and scored.predictions.count() == 500


def _draws_by_sql(df, replicates, seed, name):
    """Interval ends of each key from one row per draw, with Spark's own hashes."""
    arms = df.groupBy("k", "arm").agg(F.count(F.lit(1)).alias("n"))
    rows = df.select("k", "arm", F.col("place").alias("draw")).join(arms, ["k", "arm"])
    rows = rows.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    label = F.concat_ws("/", "k", F.col("arm").cast("string"))
    text = F.concat_ws("|", F.lit(str(seed)), label, F.col("r").cast("string"), F.col("draw").cast("string"))
    hashed = {
        "md5": F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"),
        "xxhash64": F.xxhash64(F.lit(seed), label, "r", F.col("draw").cast("int")),
    }[name]
    drawn = rows.withColumn("place", F.pmod(hashed, F.col("n"))).join(df, ["k", "arm", "place"])
    mean = lambda on: F.avg(F.when(F.col("arm") == on, F.col("v")))
    diffs = drawn.groupBy("k", "r").agg((mean(True) - mean(False)).alias("d"))
    ends = diffs.groupBy("k").agg(F.percentile("d", F.lit(0.025)).alias("a"), F.percentile("d", F.lit(0.975)).alias("b"))
    return {r.k: (r.a, r.b) for r in ends.collect()}


@pytest.mark.parametrize("name", ["md5", "xxhash64"])
def test_bootstrap_draws_are_those_of_sql(spark, monkeypatch, name):
    """Arms of many chunks, draws in several lots, missing values, long labels, a missing arm."""
    from shelfwise.operators import bootstrap

    rng = np.random.default_rng(11)
    rows = [("a", True, i, float(rng.normal())) for i in range(1203)]
    rows += [("a", False, i, None if i % 7 == 0 else float(rng.normal(2))) for i in range(95)]
    rows += [("long" * 20, arm, i, float(rng.normal())) for arm in (True, False) for i in range(11)]
    rows += [("one", True, 0, 4.0), ("one", False, 0, 1.0), ("half", True, 0, 1.0), ("half", True, 1, 2.0)]
    df = spark.createDataFrame(rows, "k string, arm boolean, place long, v double").repartition(5)
    wanted = _draws_by_sql(df, 130, 3, name)
    for chunk, lot in ((1 << 18, 1 << 18), (100, 900)):
        monkeypatch.setattr(bootstrap, "CHUNK", chunk)
        monkeypatch.setattr(bootstrap, "DRAWS_AT_ONCE", lot)
        got = mean_difference_interval(df, ["k"], "arm", "place", "v", 130, 3, 0.05, name).collect()
        assert {r.k for r in got} == set(wanted) and len(got) == 4
        for r in got:
            assert (r.ci_low, r.ci_high) == (pytest.approx(wanted[r.k], rel=1e-9) if wanted[r.k][0] is not None else (None, None))
    assert wanted["one"] == (3.0, 3.0)


def test_bootstrap_makes_no_row_per_draw(spark):
    df = spark.createDataFrame([("a", True, 0, 1.0), ("a", False, 0, 2.0)], "k string, arm boolean, place int, v double")
    plan = mean_difference_interval(df, ["k"], "arm", "place", "v", 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate ") == 2  # blocks of replicates, and replicates


def test_md5_draws_against_hashlib():
    from hashlib import md5

    from shelfwise.functions.draws import md5_draws

    prefixes = [b"42|a/true|%d|" % r for r in range(0, 1200, 97)] + ["é漢|".encode(), b"", b"x" * 54, b"y" * 200]
    for low, high in ((0, 1), (0, 1103), (8, 12), (99_995, 100_006)):
        got = md5_draws(prefixes, low, high)
        assert got.tolist() == [[int(md5(p + b"%d" % i).hexdigest()[:8], 16) for i in range(low, high)] for p in prefixes]
