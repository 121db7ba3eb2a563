"""Streams against the batch, sketches against exact answers, months that are delivered again."""

from __future__ import annotations

import os
import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.operators import sketches
from shelfwise.plans import segment_day
from shelfwise.sources import sinks
from shelfwise.streaming import store_days

SALES = "date date, store_nbr int, item_nbr int, unit_sales double, onpromotion string"


def _sales(n, seed):
    random.seed(seed)
    first = date(2024, 1, 20)
    rows = [
        (
            None if i % 50 == 0 else first + timedelta(random.randrange(40)),
            random.choice([1, 1, 1, 2, 3]),
            i % 17,
            None if i % 11 == 0 else float(random.randrange(9) - 1),
            random.choice(["True", "False", None]),
        )
        for i in range(n)
    ]
    random.shuffle(rows)
    return rows


def _run(spark, tmp_path, parts, delay):
    """Each part arrives after the ones before it were merged."""
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    late = 0
    for part in parts:
        spark.createDataFrame(part, SALES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SALES).parquet(source)
        query = store_days.start(stream, target, checkpoint, delay)
        query.awaitTermination(120)
        assert query.exception() is None
        late += store_days.late_rows(query)
    return target, late


def _tables(spark, rows):
    stores = spark.createDataFrame([(1, 10), (2, 10), (3, None)], "store_nbr int, cluster int")
    holidays = spark.createDataFrame([(date(2024, 2, 1), "Holiday", False)], "date date, type string, transferred boolean")
    oil = spark.createDataFrame([(date(2024, 1, 25), "70.5")], "date date, dcoilwtico string")
    traffic = spark.createDataFrame([(date(2024, 2, 3), 1, 500)], "date date, store_nbr int, transactions int")
    sales = spark.createDataFrame(rows, SALES)
    return {"sales": sales, "stores": stores, "holidays": holidays, "oil": oil, "transactions": traffic}


def test_stream_and_batch_give_the_same_segment_days(spark, tmp_path):
    rows = _sales(1200, 1)
    target, late = _run(spark, tmp_path, [rows[:500], rows[500:501], rows[501:]], "100 days")
    assert late == 0
    batch = _tables(spark, rows)
    streamed = store_days.tables_of(spark, target, {k: v for k, v in batch.items() if k != "sales"})
    for plan in (segment_day.segment_daily_base, segment_day.segment_daily_total, segment_day.segment_day_any, segment_day.segment_day_promo):
        assert sorted(map(str, plan(streamed).collect())) == sorted(map(str, plan(batch).collect())), plan.__name__


def test_sales_later_than_the_delay_are_counted_and_left_out(spark, tmp_path):
    day = lambda i: date(2024, 3, 1) + timedelta(i)
    early = [(day(0), 1, 1, 5.0, None), (day(20), 1, 1, 7.0, None)]
    # The second delivery moves the limit to day 13; the third has one sale before and one behind it.
    parts = [early, [(day(20), 2, 1, 1.0, None)], [(day(2), 1, 1, 100.0, None), (day(15), 1, 1, 3.0, None)]]
    target, late = _run(spark, tmp_path, parts, "7 days")
    found = {(r.store_id, r.date): r.units for r in spark.read.parquet(target).collect()}
    assert found == {(1, day(0)): 5.0, (1, day(20)): 7.0, (2, day(20)): 1.0, (1, day(15)): 3.0}
    assert late == 1


def test_a_batch_merged_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "days")
    schema = "store_id int, date date, on_promotion boolean, units double, n_sales long, n_rows long"
    first = spark.createDataFrame([(1, date(2024, 1, 1), True, 2.0, 1, 1), (1, date(2024, 2, 1), None, 1.0, 1, 1)], schema)
    second = spark.createDataFrame([(1, date(2024, 2, 1), None, 9.0, 3, 3), (None, date(2024, 2, 2), False, None, 0, 1)], schema)
    merge = store_days.merge_into(path)
    merge(first, 0)
    merge(second, 1)
    once = sorted(map(str, spark.read.parquet(path).collect()))
    merge(second, 1)
    assert sorted(map(str, spark.read.parquet(path).collect())) == once and len(once) == 3


def _files(path):
    return {
        os.path.join(folder, name): os.path.getmtime(os.path.join(folder, name))
        for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")
    }


def test_a_month_delivered_again_leaves_the_others_alone(spark, tmp_path):
    path = str(tmp_path / "fact")
    rows = [(s, 1, date(2024, m, d), 1.0) for s in range(5) for m in (1, 2, 3) for d in (1, 15)]
    fact = spark.createDataFrame(rows, "store_id int, product_id int, date date, units double")
    sinks.write_training_table(fact, path)
    before = _files(path)
    again = fact.filter(F.month("date") == 2).withColumns({"units": F.lit(7.0), "year_month": F.lit("2024-02")})
    sinks.replace_months(again.filter("store_id < 3"), path)
    after = _files(path)
    others = {f: t for f, t in before.items() if "2024-02" not in f}
    assert others and others == {f: t for f, t in after.items() if "2024-02" not in f}
    sums = {r[0]: (r[1], r[2]) for r in spark.read.parquet(path).groupBy("year_month").agg(F.sum("units"), F.count("*")).collect()}
    assert {str(k)[:7]: v for k, v in sums.items()} == {"2024-01": (10.0, 10), "2024-02": (42.0, 6), "2024-03": (10.0, 10)}

    broken = again.withColumn("units", F.raise_error(F.lit("no delivery")).cast("double"))
    with pytest.raises(Exception, match="no delivery"):
        sinks.replace_months(broken, path)
    assert _files(path) == after


def test_sketches_roll_up_to_any_key(spark):
    rng = np.random.default_rng(12)
    values = np.concatenate([rng.pareto(0.7, 20_000), [1e300, -1e300, 0.0]])
    rows = [(int(i % 4), int(i % 30), int(p), float(v)) for i, (p, v) in enumerate(zip(rng.integers(0, 9000, len(values)), values))]
    rows += [(9, 0, None, None), (None, 1, 5, 2.0)]
    df = spark.createDataFrame(rows, "store int, day int, product int, units double")
    table = sketches.sketch_table(df, ["store", "day"], ["product"], ["units"]).cache()
    quantiles = {"median": 0.5, "p99": 0.99}
    for keys in (["store"], ["day"], []):
        found = sketches.estimates(sketches.rolled_up(table, keys), quantiles).collect()
        for r in found:
            part = df
            for k in keys:
                part = part.filter(F.col(k).eqNullSafe(F.lit(r[k])))
            assert r.n_rows == part.count()
            wanted = part.agg(F.countDistinct("product")).first()[0]
            assert abs((r["product"] or 0) - wanted) <= 4 * 1.04 / 64 * wanted
            x = np.array([v.units for v in part.collect() if v.units is not None])
            for label, p in quantiles.items():
                got = r[f"units_{label}"]
                if not len(x):
                    assert got is None
                    continue
                assert max((x < got).mean() - p, p - (x <= got).mean(), 0) <= 0.02
    table.unpersist()


def test_rank_errors_of_exact_and_wrong_quantiles(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(100)], "k string, v double")
    found = spark.createDataFrame([("a", 49.0, 79.0)], "k string, good double, bad double")
    error = lambda c: sketches.rank_errors(df, found, ["k"], "v", c, 0.5).first().rank_error
    assert error("good") == 0.0 and error("bad") == pytest.approx(0.29)
