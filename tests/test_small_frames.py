"""Operators on small frames with known answers."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from shelfwise.config import FoldPlan, Roles
from shelfwise.functions.columns import promo_flag
from shelfwise.operators import enrich, evaluate, features, profile, quality
from shelfwise.sources import raw, sinks

D = date.fromisoformat


def test_seasonal_naive_shift(spark):
    rows = [(1, D("2024-01-01") + timedelta(i), 10.0 + i) for i in range(8)]
    df = spark.createDataFrame(rows, "cluster int, date date, units double")
    out = evaluate.seasonal_naive(df).orderBy("date").collect()
    assert out[0].pred_seasonal_naive_7d is None
    assert out[7].pred_seasonal_naive_7d == 10.0


def test_lags_and_rolling_stay_inside_the_segment(spark):
    rows = [(c, D("2024-01-01") + timedelta(i), 100.0 * c + i) for c in (1, 2) for i in range(35)]
    df = spark.createDataFrame(rows, "cluster int, date date, units double")
    out = features.add_rolling(features.add_lags(df)).filter("cluster = 2").orderBy("date").collect()
    assert [r.lag_7 for r in out[:7]] == [None] * 7
    assert out[2].rolling_mean_7 is None and out[3].rolling_mean_7 == 201.0
    assert out[6].rolling_mean_28 is None and out[7].rolling_mean_28 == 203.0
    assert out[28].lag_28 == 200.0


BASE = "store_id int, product_id int, date date, units int"
BASE_ROWS = [(1, 100, D("2024-01-01"), 10), (1, 100, D("2024-01-02"), 12)]
WEATHER = (
    "store_id int, date date, weather_temp_mean double, weather_precip_sum double, weather_wind_max double"
)
EVENTS = "date date, event_name string, store_id bigint, event_intensity double"


def test_merge_weather_and_global_event(spark):
    base = spark.createDataFrame(BASE_ROWS, BASE)
    weather = spark.createDataFrame(
        [(1, D("2024-01-01"), 20.0, 0.0, 12.0), (1, D("2024-01-02"), 21.0, 0.2, 11.0)], WEATHER
    )
    events = spark.createDataFrame([(D("2024-01-02"), "Sports Final", None, 1.5)], EVENTS)
    out = {r.date: r for r in enrich.merge_external(base, weather, events).collect()}
    assert out[D("2024-01-02")].event_name == "Sports Final"
    assert out[D("2024-01-02")].weather_temp_mean == 21.0
    assert out[D("2024-01-01")].event_name is None
    assert out[D("2024-01-01")].event_intensity == 0.0


def test_store_event_wins_and_facts_do_not_multiply(spark):
    base = spark.createDataFrame(BASE_ROWS, BASE)
    day = D("2024-01-02")
    events = spark.createDataFrame(
        [(day, "City", None, 1.5), (day, "Shop B", 1, 1.0), (day, "Shop A", 1, None)], EVENTS
    )
    out = enrich.merge_external(base, None, events).filter(F.col("date") == F.lit(day)).collect()
    assert [(r.event_name, r.event_intensity, r.event_names) for r in out] == [("Shop B", 1.0, ["Shop A", "Shop B"])]
    wide = enrich.merge_external(base, None, events, allow_fanout=True)
    kept = {(r.event_name, r.event_intensity) for r in wide.filter(F.col("date") == F.lit(day)).collect()}
    assert kept == {("Shop B", 1.0), ("Shop A", 1.5)}


def test_absent_optional_tables_give_fixed_columns(spark):
    out = enrich.merge_external(spark.createDataFrame(BASE_ROWS, BASE), None, None)
    assert out.columns[-3:] == ["event_name", "event_intensity", "event_names"]
    empty = raw.read_local_events(spark, "/nonexistent/events.csv")
    assert empty.count() == 0
    assert enrich.merge_external(spark.createDataFrame(BASE_ROWS, BASE), None, empty).count() == 2


def test_missing_date_found(spark):
    rows = [(1, 100, D("2024-01-01")), (1, 100, D("2024-01-03")), (None, 1, D("2024-01-09"))]
    df = spark.createDataFrame(rows, "store_id int, product_id int, date date")
    assert [r.date for r in quality.missing_dates(df).collect()] == [D("2024-01-02")]


def test_oil_fill_flag_and_order(spark):
    oil = spark.createDataFrame(
        [(D("2024-01-05"), 3.0), (D("2024-01-02"), None), (D("2024-01-03"), 2.0), (D("2024-01-04"), None)],
        "date date, dcoilwtico double",
    )
    days = spark.createDataFrame([(D(f"2024-01-0{i}"),) for i in range(1, 8)], "date date")
    out = [
        (r.oil_price, r.oil_price_missing_flag)
        for r in enrich.oil_daily(oil, days).orderBy("date").collect()
    ]
    assert out == [(2.0, 1), (2.0, 1), (2.0, 0), (2.0, 0), (3.0, 0), (3.0, 1), (3.0, 1)]


def test_holiday_rules(spark):
    rows = [
        (D("2024-01-01"), "Holiday", False),
        (D("2024-01-02"), "Holiday", True),
        (D("2024-01-03"), "Work Day", False),
        (D("2024-01-03"), "Event", None),
    ]
    df = spark.createDataFrame(rows, "date date, type string, transferred boolean")
    out = {r.date.day: r.is_holiday_event for r in enrich.holiday_daily(df).collect()}
    assert out == {1: True, 2: False, 3: True}


def test_promo_text(spark):
    df = spark.createDataFrame([("True",), ("TRUE",), ("false",), ("yes",), (None,)], "c string")
    assert [r[0] for r in df.select(promo_flag(F.col("c"))).collect()] == [True, True, False, False, False]


def test_mape_ignores_zero_days_and_falls_back(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 1.0), ("a", 10.0, 8.0), ("b", 0.0, 3.0), ("b", 0.0, None)],
        "cluster string, units double, p double",
    )
    got = {r.cluster: r for r in evaluate.forecast_metrics(df, {"m": "p"}, ["cluster"]).collect()}
    assert got["a"].mae == 1.5 and got["a"].mape_pct == pytest.approx(20.0)
    assert got["b"].mae == 3.0 and got["b"].mape_pct is None
    got = evaluate.forecast_metrics(
        df.filter("cluster = 'b'"), {"m": "p"}, whole_error_fallback=True
    ).first()
    assert got.mape_pct == pytest.approx(100 * 3 / 1e-9)


def test_folds_are_positions_and_fail_without_history(spark):
    days = [D("2024-01-01") + timedelta(2 * i) for i in range(60)]
    df = spark.createDataFrame([(d,) for d in days], "date date")
    plan = FoldPlan(folds=3, step=5, horizons=(3, 10), min_train=42)
    folds = evaluate.fold_boundaries(df, plan).orderBy("fold").collect()
    assert [f.fold for f in folds] == [2, 3]
    assert folds[1].eval_end_date == days[59] and folds[1].train_end_date == days[49]
    assert folds[0].eval_end_date == days[54] and folds[0].train_end_date == days[44]
    with pytest.raises(Exception, match="too little history"):
        evaluate.fold_boundaries(df, FoldPlan(folds=1, min_train=500)).collect()


def test_horizons_end_on_calendar_days(spark):
    days = [D("2024-01-01") + timedelta(2 * i) for i in range(30)]
    df = spark.createDataFrame([(1, d, 1.0) for d in days], "cluster int, date date, units double")
    plan = FoldPlan(folds=1, step=1, horizons=(4, 10), min_train=5)
    rows = evaluate.backtest_frame(df, plan, horizons=True).groupBy("horizon_days").count().collect()
    assert {r.horizon_days: r["count"] for r in rows} == {4: 2, 10: 5}


def test_columns_are_checked(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="units"):
        quality.negative_units(df)
    with pytest.raises(ValueError, match="cluster"):
        features.segment_daily_base(df)


def test_null_keys_are_dropped_and_null_flags_are_false(spark):
    rows = [(1, D("2024-01-01"), 2.0, None, True, 1.0, None), (None, D("2024-01-01"), 9.0, True, True, 1.0, 1.0)]
    df = spark.createDataFrame(
        rows,
        "cluster int, date date, units double, on_promotion boolean, is_holiday_event boolean, "
        "oil_price double, store_transactions double",
    )
    out = features.segment_daily_base(df, Roles()).collect()
    assert [(r.units, r.promo_rate, r.avg_store_transactions) for r in out] == [(2.0, 0.0, None)]


def test_missing_raw_files_are_named(spark, tmp_path):
    (tmp_path / "train.csv").write_text("date\n")
    with pytest.raises(FileNotFoundError, match="items.csv, oil.csv"):
        raw.read_raw_tables(spark, str(tmp_path))


def test_csv_reader_prunes_and_orders_columns(spark, tmp_path):
    files = {
        "train.csv": "id,date,store_nbr,item_nbr,unit_sales,onpromotion\n7,2024-01-01,1,5,2.5,TRUE\n8,2024-01-02,1,5,-1,\n",
        "stores.csv": "store_nbr,city,cluster\n1,Q,13\n",
        "items.csv": "item_nbr,family,class,perishable\n5,X,1093,0\n",
        "holidays_events.csv": "date,type,locale,transferred\n2024-01-01,Holiday,N,False\n",
        "oil.csv": "date,dcoilwtico\n2024-01-01,\n2024-01-02,93.14\n",
        "transactions.csv": "date,store_nbr,transactions\n2024-01-01,1,770\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    tables = raw.read_raw_tables(spark, str(tmp_path))
    fact = {r.date.day: r for r in enrich.base_daily_sales(tables).collect()}
    assert fact[1].on_promotion and not fact[2].on_promotion
    assert fact[1].cluster == 13 and fact[1].product_class == 1093 and fact[2].units == -1.0
    assert fact[1].is_holiday_event and not fact[2].is_holiday_event
    assert fact[1].oil_price == 93.14 and fact[1].oil_price_missing_flag == 1
    assert fact[1].store_transactions == 770.0 and fact[2].store_transactions is None


def test_weather_payload_file(spark, tmp_path):
    path = tmp_path / "weather.json"
    path.write_text(
        '{"store_id": 1, "daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_mean": [20.5, null],'
        ' "precipitation_sum": [0.0, 1.5], "windspeed_10m_max": [12.0, 11.0]}}\n'
        '{"store_id": 2, "daily": {}}\n'
    )
    rows = raw.read_weather(spark, str(path)).orderBy("date").collect()
    assert [(r.store_id, r.date.day, r.weather_temp_mean, r.weather_precip_sum) for r in rows] == [
        (1, 1, 20.5, 0.0),
        (1, 2, None, 1.5),
    ]


def test_report_round_trip(spark, tmp_path):
    table = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("b", 4.0, 5.0, 6.0)], "model string, mae double, rmse double, mape_pct double")
    path = str(tmp_path / "metrics")
    sinks.write_report(table, path)
    assert raw.read_metrics(spark, path, "b").first().mae == 4.0
    assert raw.read_metrics(spark, path).count() == 2


def test_search_summary_keeps_nested_settings(spark, tmp_path):
    from shelfwise.models.search import TRIAL_COLUMNS, best_trial

    trials = [(0, 8, 3, 0.1, 0.8, 0.8, 5.0, 6.0, 7.0), (1, 4, 4, 0.3, 0.6, 1.0, 4.0, 6.0, 7.0)]
    path = str(tmp_path / "best")
    sinks.write_search_summary(best_trial(spark.createDataFrame(trials, TRIAL_COLUMNS)), path)
    row = spark.read.json(path).first()
    assert row.trial == 1 and row.params.depth == 4 and row.mae == 4.0


def test_prediction_extract_takes_the_last_rows(spark):
    rows = [(c, D("2024-01-01") + timedelta(i), float(i), 1.0) for c in (1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "cluster int, date date, units double, lag_7 double")
    out = sinks.prediction_extract(df, {"units": "units", "lag_7": "naive"}, rows=6).collect()
    assert len(out) == 6 and sum(r.cluster == 2 for r in out) == 5
    assert {r.date.day for r in out if r.cluster == 1} == {5}


def test_training_table_round_trip(spark, tmp_path):
    from shelfwise.plans import training_table

    raw_dir, out = tmp_path / "raw", str(tmp_path / "out")
    raw_dir.mkdir()
    test_csv_reader_prunes_and_orders_columns(spark, raw_dir)
    (tmp_path / "local_events.csv").write_text(
        "date,event_name,store_id,event_intensity\n2024-01-01,Fair,1,1.2\n2024-01-02,Final,,1.5\n"
    )
    counts = training_table.build(spark, str(raw_dir), str(tmp_path), out).first()
    assert (counts.rows, counts.negative_units, counts.missing_dates) == (2, 1, 0)
    written = {r.date.day: r for r in raw.read_fact(spark, out, ["date", "event_name", "year_month"]).collect()}
    assert written[1].event_name == "Fair" and written[2].event_name == "Final"
    assert written[1].year_month == "2024-01"


def test_promo_lift_without_base(spark):
    df = spark.createDataFrame([(1, 5.0, True), (2, 0.0, False), (2, 3.0, True)], "cluster int, units double, on_promotion boolean")
    out = {r.cluster: r for r in profile.promo_lift(df).collect()}
    assert out[1].uplift_pct is None and out[2].uplift_pct is None and out[2].uplift_abs == 3.0
