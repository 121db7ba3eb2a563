"""Cases on which plausible data once gave wrong or no results."""

from __future__ import annotations

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.functions import lineage, ordered
from shelfwise.functions.ordered import (
    RANGE,
    exact_quantiles,
    number_rows,
    running_counts,
    suffix_minimum,
    with_ranges,
)
from shelfwise.models import seasonal
from shelfwise.operators import features, residuals
from shelfwise.operators.counts import count_diagnostics
from shelfwise.plans import segment_day
from shelfwise.plans.training_table import base_daily_sales


def test_variance_of_large_values(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), float(1e9 + x)) for i, x in enumerate(rng.integers(0, 5, 3000))]
    out = count_diagnostics(spark.createDataFrame(rows, "cluster int, units double"))
    total = out.filter(F.col("scope") == "row_level_overall").first()
    assert total.variance_units == pytest.approx(np.var([u for _, u in rows], ddof=1), rel=1e-6)
    assert total.mean_units == pytest.approx(np.mean([u for _, u in rows]), rel=1e-12)


@pytest.fixture
def small_ranges(spark, monkeypatch):
    """Ranges even for tables of few rows, as many as shuffle partitions."""
    monkeypatch.setattr(ordered, "ROWS_IN_ONE_RANGE", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ranges_are_even_far_from_zero(spark, small_ranges):
    n = 200_000
    values = spark.range(n).select((F.lit(1.7e9) + F.col("id")).alias("v"), F.lit(1).cast("long").alias("n"))
    sizes = with_ranges(values, [], "v").groupBy(RANGE).count().agg(F.max("count"), F.count("*")).first()
    assert sizes[0] <= 2 * n / 8 and sizes[1] == 8
    ranks = running_counts(values, [], "v", "n")
    assert ranks.filter(F.col("n_below") != F.col("v") - 1.7e9).isEmpty()
    close = spark.range(50_000).select((F.lit(1.0) + F.col("id") * 1e-9).alias("v"), F.lit(1).cast("long").alias("n"))
    far = close.unionByName(spark.createDataFrame([(1e300, 1), (-1e300, 1)], "v double, n long"))
    assert with_ranges(far, [], "v").groupBy(RANGE).count().agg(F.max("count")).first()[0] <= 2 * 50_000 / 8


def test_many_ranges_give_the_ranks_and_minima_of_one(spark, request):
    rng = np.random.default_rng(5)
    rows = [(int(g), float(v), float(m)) for g, v, m in zip(rng.zipf(1.5, 4000) % 5, rng.normal(size=4000), rng.normal(size=4000))]
    rows += [(9, math.inf, 1.0), (9, -math.inf, 2.0), (9, math.nan, 0.5)]
    df = spark.createDataFrame(rows, "g int, v double, m double").withColumn("n", F.lit(2).cast("long"))

    def answers():
        ranks = running_counts(df, ["g"], "v", "n").select("g", "v", "n_below", "n_through", "n_total")
        lows = suffix_minimum(df, ["g"], "v", "m", "low").select("g", "v", "low")
        return sorted(map(str, ranks.collect())), sorted(map(str, lows.collect()))

    one = answers()
    request.getfixturevalue("small_ranges")
    assert with_ranges(df, ["g"], "v").select(RANGE).distinct().count() > 1
    assert answers() == one


def test_infinite_and_missing_numbers_have_places(spark):
    values = [1.0, 2.0, math.inf, -math.inf, math.nan, 0.0, -3.5]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, n long")
    order = [r.v for r in running_counts(df, [], "v", "n").orderBy("n_below").collect()]
    assert order[:6] == [-math.inf, -3.5, 0.0, 1.0, 2.0, math.inf] and math.isnan(order[6])
    q = exact_quantiles(df, [], "v", {"low": 0.0, "mid": 0.5}).first()
    assert (q.low, q.mid) == (-math.inf, 1.0)


def test_text_ids_are_numbered(spark):
    df = spark.createDataFrame([("g", f"store {i}") for i in range(500)], "k string, id string")
    places = [r.place for r in number_rows(df, ["k"], "id", "place").collect()]
    assert sorted(places) == list(range(500))


def _series(segments):
    rows, first = [], datetime.date(2024, 1, 1)
    rng = np.random.default_rng(2)
    for segment, constant in segments:
        for day in range(60):
            date = first + datetime.timedelta(days=0 if constant else day)
            x = [0.0] * 4 if constant else rng.normal(size=4).tolist()
            units = 5.0 if constant else float(rng.normal())
            rows.append((segment, first + datetime.timedelta(days=day), units, *x, date.isoweekday() - 1, date.month))
    schema = (
        "cluster int, date date, units double, promo_rate double, holiday_rate double, "
        "avg_store_transactions double, oil_price double, day_of_week int, month int"
    )
    return spark_frame(rows, schema)


spark_frame = None


@pytest.fixture(autouse=True)
def _bind(spark):
    global spark_frame
    spark_frame = spark.createDataFrame


def test_constant_segment_gets_nulls_and_others_stay(spark):
    out = {r.cluster: r for r in residuals.residual_diagnostics(_series([(1, False), (2, True)])).collect()}
    assert set(out) == {1, 2}
    assert out[2].r_squared is None and out[2].breusch_pagan_f_pvalue is None
    assert 0 < out[1].r_squared < 1 and 0 <= out[1].breusch_pagan_lm_pvalue <= 1
    alone = residuals.residual_diagnostics_overall(_series([(1, False)])).first()
    assert 0 < alone.r_squared < 1
    assert out[1].r_squared == pytest.approx(alone.r_squared, abs=1e-8)
    assert out[1].breusch_pagan_f_pvalue == pytest.approx(alone.breusch_pagan_f_pvalue, abs=1e-8)


def test_model_and_naive_see_the_same_rows(spark):
    rows = []
    for segment in (1, 2):
        for day in range(120):
            date = datetime.date(2024, 1, 1) + datetime.timedelta(days=day)
            rows.append((segment, date, float(day % 7), float(day % 7) if segment == 1 else 500.0, 0.0, 0.0, 1.0, 1.0))
    schema = (
        "cluster int, date date, units double, lag_7 double, promo_rate double, holiday_rate double, "
        "oil_price double, avg_store_transactions double"
    )
    frame = spark.createDataFrame(rows, schema)

    def half(history, x, ahead, order):
        if history.mean() > 500:
            raise ValueError("no fit")
        return seasonal.Forecast(np.resize(np.arange(7.0), len(ahead)), True, np.zeros(1))

    shifted = F.when(F.col("cluster") == 2, F.col("units") + 1000).otherwise(F.col("units"))
    marked = features.add_calendar(frame.withColumn("units", shifted))
    scored = seasonal.segment_forecast(marked, "2024-04-10", forecaster=half)
    by = {r.model: r for r in scored.metrics.collect()}
    assert by["seasonal_naive_7d"].n_failed_segments == 1 and by["seasonal_naive_7d"].n_failed_rows == 19
    assert by["seasonal_naive_7d"].mae == pytest.approx(0.0)
    search = seasonal.order_search(marked, "2024-04-10", forecaster=half)
    assert {r.n_failed_segments for r in search.metrics.collect()} == {1}
    best = {r.cluster: r for r in seasonal.best_orders(seasonal.order_trials(marked, "2024-04-10", forecaster=half)).collect()}
    assert best[2].best_order is None and best[2].mae is None and best[1].best_order


def _raw_tables(spark):
    sales = spark.createDataFrame(
        [
            ("2024-01-01", 1, 7, None, True), ("2024-01-02", 1, 7, 2.0, None), ("2024-01-02", 1, 7, None, True),
            ("2024-01-02", 1, 7, 2.0, None), ("2024-01-03", None, 7, 4.0, False), ("2024-01-03", 2, 8, 1.5, False),
            ("2024-01-03", 2, 8, 1.5, False), (None, 2, 8, 1.0, False),
        ],
        "d string, store_nbr int, item_nbr int, unit_sales double, onpromotion boolean",
    ).withColumn("date", F.to_date("d")).drop("d")
    return {
        "sales": sales,
        "stores": spark.createDataFrame([(1, 1), (2, 2)], "store_nbr int, cluster int"),
        "products": spark.createDataFrame([(7, 70, 0), (8, 80, 1)], "item_nbr int, class int, perishable int"),
        "transactions": spark.createDataFrame([(datetime.date(2024, 1, 2), 1, 100)], "date date, store_nbr int, transactions int"),
        "holidays": spark.createDataFrame([(datetime.date(2024, 1, 1), "Holiday", False)], "date date, type string, transferred boolean"),
        "oil": spark.createDataFrame([(datetime.date(2024, 1, 2), 50.0)], "date date, dcoilwtico double"),
    }


@pytest.mark.parametrize("name", ["segment_day_any", "segment_day_promo", "segment_daily_base", "segment_daily_total"])
def test_plans_equal_the_operators_on_the_fact(spark, name):
    """Null units, flags, stores and repeated sales count alike on both paths."""
    tables = _raw_tables(spark)
    fact = base_daily_sales(tables)
    one = getattr(segment_day, name)(tables)
    two = getattr(features, name)(fact)
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.select(sorted(df.columns)).collect())))
    assert rows(one) == rows(two)


def test_shared_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, applicationId = "spark://host:7077", "a"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        lineage.shared_folder(Session)
    monkeypatch.setattr(Context, "getCheckpointDir", lambda self: "hdfs://x/y")
    assert lineage.shared_folder(Session) == "hdfs://x/y"


def test_written_tables_can_be_discarded(spark):
    import os

    df = lineage.pin(spark.range(3).toDF("x"), "thing")
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder)
    lineage.discard(df)
    assert not os.path.exists(folder)
