"""Partitions that follow the rows: a task's share does not grow with the input."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from shelfwise.functions import joins
from shelfwise.operators import campaign
from shelfwise.operators.enrich import base_daily_sales
from shelfwise.plans import segment_day
from shelfwise.streaming import store_days

SALES = "date date, store_nbr int, item_nbr int, unit_sales double, onpromotion string"


def _tables(spark):
    first = date(2024, 1, 1)
    rows = [(first + timedelta(i % 30), i % 40, i % 7, float(i % 5), "True" if i % 3 else None) for i in range(3000)]
    rows += [(None, 1, 1, 1.0, None), (first, None, 1, 1.0, None)]
    stores = [(s, s % 3) for s in range(39)]
    products = [(p, p % 3, 0) for p in range(6)]
    traffic = [(first, s, 9.0) for s in range(0, 40, 2)]
    return {
        "sales": spark.createDataFrame(rows, SALES),
        "stores": spark.createDataFrame(stores, "store_nbr int, cluster int"),
        "products": spark.createDataFrame(products, "item_nbr int, class int, perishable int"),
        "holidays": spark.createDataFrame([(first, "Holiday", False)], "date date, type string, transferred boolean"),
        "oil": spark.createDataFrame([(first, 70.5)], "date date, dcoilwtico double"),
        "transactions": spark.createDataFrame(traffic, "date date, store_nbr int, transactions double"),
    }


def _text(df):
    return sorted(map(str, df.collect()))


def test_panel_of_a_dealt_fact_has_as_many_tasks_as_its_rows_need(spark):
    tables = _tables(spark)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) * 3 + 1
    assert joins.tasks_for(tables["sales"], 1) == 3002
    assert joins.tasks_for(tables["sales"]) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = base_daily_sales(tables, wanted)
    panel = campaign.cross_class_panel(dealt)
    sizes = panel.groupBy(F.spark_partition_id()).count().collect()
    assert panel.rdd.getNumPartitions() == wanted and len(sizes) > wanted // 2
    assert _text(dealt) == _text(base_daily_sales(tables))
    assert _text(panel) == _text(campaign.cross_class_panel(base_daily_sales(tables)))


def test_dealt_fact_goes_to_its_buckets_without_another_exchange(spark, tmp_path):
    tables = _tables(spark)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) + 3
    rows = base_daily_sales(tables, wanted).repartition(wanted, "store_id", "date")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    by_key = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(store_id#\d+L?, date#\d+, ", line)]
    # One for the sales and one for the traffic that is joined to them.
    assert len(by_key) == 2 and all(f", {wanted})" in line for line in by_key), plan


def test_stream_state_lies_on_disk_in_the_partitions_asked_for(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    _tables(spark)["sales"].repartition(4).write.parquet(source)
    stream = spark.readStream.schema(SALES).option("maxFilesPerTrigger", 2).parquet(source)
    names = [*store_days.STATE_SETTINGS, "spark.sql.shuffle.partitions"]
    before = {name: spark.conf.get(name, None) for name in names}
    query = store_days.start(stream, target, checkpoint, "100 days", partitions=3)
    query.awaitTermination(120)
    assert query.exception() is None
    assert {name: spark.conf.get(name, None) for name in names} == before
    reports = [report for report in query.recentProgress if report["numInputRows"]]
    assert len(reports) == 2
    for report in reports:
        (state,) = report["stateOperators"]
        assert state["numShufflePartitions"] == 3 and "rocksdbPutCount" in state["customMetrics"]
    sums = spark.read.parquet(target).agg(F.sum("units"), F.sum("n_rows")).first()
    assert tuple(sums) == (6001.0, 3001)


def test_segment_days_of_dealt_store_days_are_the_same(spark):
    tables = _tables(spark)
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) + 5
    dealt = segment_day.segment_daily_base(tables, wanted)
    assert f", {wanted}), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert _text(dealt) == _text(segment_day.segment_daily_base(tables))
