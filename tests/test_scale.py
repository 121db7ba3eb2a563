"""Properties that must hold on large data: plans, skew, partitioning."""

import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfwise.operators import enrich, features, profile, quality
from shelfwise.plans import segment_day
from shelfwise.sources import star
from tests.compare import rows_of

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def logical_joins(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_cross_joins(spark, name):
    text = plan_of(entry.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_only_needed_columns_are_read(spark):
    text = plan_of(segment_day.segment_daily_total(star.raw_tables(spark, SMALL)))
    lines = [line for line in text.splitlines() if "FileScan" in line and "l_shipdate" in line]
    assert lines and all("l_extendedprice" not in line and "l_orderkey" not in line for line in lines)


def test_filters_reach_the_scan(spark):
    fact = star.sales(star.Star(spark, SMALL)).filter(F.col("unit_sales") < 0)
    assert "LessThan(l_quantity,0.0)" in plan_of(fact)


def test_small_sides_are_not_broadcast_by_force(spark):
    """Without a size under the threshold the dimension joins shuffle."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(enrich.base_daily_sales(star.raw_tables(spark, SMALL)))
        assert text.count("SortMergeJoin") >= 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("partitions", ["13"])
def test_results_do_not_depend_on_partitions(spark, partitions):
    names = ["promo_significance", "row_sample", "ecdf", "ljung_box_overall"]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    want = {n: [tuple(r) for r in entry.queries()[n](spark, SMALL).collect()] for n in names}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        for n in names:
            df = entry.queries()[n](spark, SMALL)
            got = [tuple(r) for r in df.collect()]
            assert rows_of(df.columns, got) == rows_of(df.columns, want[n])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 sales, a third of them equal copies of one sale."""
    day = date(2024, 1, 1)
    hot = spark.range(7000).select(
        F.lit(1).alias("store_id"), F.lit(1).alias("product_id"), F.lit(day).alias("date"),
        F.lit(3.0).alias("units"), F.lit(True).alias("on_promotion"), F.lit(1).alias("cluster"),
    )
    i = F.col("id")
    rest = spark.range(13000).select(
        (i % 40 + 2).cast("int").alias("store_id"), (i % 7).cast("int").alias("product_id"),
        F.date_add(F.lit(day), (i % 300).cast("int")).alias("date"), (i % 11).cast("double").alias("units"),
        (i % 5 == 0).alias("on_promotion"), (i % 3 + 1).cast("int").alias("cluster"),
    )
    return hot.unionByName(rest)


def test_hot_copies_keep_results_whole(spark, skewed):
    pdf = skewed.toPandas()
    counts = quality.key_counts(skewed).first()
    assert counts.rows == 20000 and counts.unique_stores == pdf.store_id.nunique()
    top = profile.top_stores(skewed, 3).collect()
    assert [r.units for r in top] == sorted(pdf.groupby("store_id").units.sum(), reverse=True)[:3]
    clip = profile.clip_units(skewed).agg(F.max("units_clipped"), F.count("units_clipped")).first()
    assert clip[0] == pdf.units.quantile(0.99) and clip[1] == 20000
    total = features.segment_daily_total(skewed)
    assert total.agg(F.sum("units")).first()[0] == pdf.units.sum()
    summary = quality.validation_summary(skewed).first()
    gaps = pdf.groupby(["store_id", "product_id"]).date.agg(lambda d: (d.max() - d.min()).days + 1 - d.nunique())
    assert summary.rows == 20000 and summary.missing_dates == gaps.sum()
    assert summary.stockout_candidates == ((pdf.units == 0) & ~pdf.on_promotion).sum()
    steps = profile.ecdf(skewed).groupBy("promo_label").agg(F.max("cumulative_share").alias("m"))
    assert {r.m for r in steps.collect()} == {1.0}


def test_hot_key_of_a_shuffled_join_is_split(spark):
    """Without broadcasts, adaptive execution cuts the partition of the hot store."""
    from shelfwise.functions.joins import attach

    wanted = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        store = F.when(F.col("id") < 7000, 1).otherwise(F.col("id") % 40 + 2)
        fact = spark.range(0, 20000, 1, 8).select(
            store.alias("store_id"), F.sha2(F.col("id").cast("string"), 256).alias("receipt")
        )
        stores = spark.range(60).select(F.col("id").alias("store_id"), (F.col("id") * 10).alias("region"))
        result = attach(fact, stores, ["store_id"])
        rows = result.collect()
        assert len({r.receipt for r in rows}) == 20000 == len(rows)
        assert all(r.region == r.store_id * 10 for r in rows)
        assert "skew=true" in plan_of(result)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_training_table_with_a_hot_key_is_split_into_files(spark, skewed, tmp_path):
    from shelfwise.sources.sinks import write_training_table

    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16KB")
    try:
        path = str(tmp_path / "fact")
        write_training_table(skewed.repartition(8), path)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    written = spark.read.parquet(path)
    assert written.count() == 20000
    files = written.filter("store_id = 1").select(F.input_file_name().alias("f")).distinct().count()
    assert files > 1


def test_row_operators_run_on_a_stream(spark, tmp_path):
    """Checks and enrichment of single rows need no history, so they also stream."""
    days = [(1, 5, date(2024, 1, 1) + timedelta(i), float(i - 2), i == 0) for i in range(5)]
    schema = "store_id int, product_id int, date date, units double, on_promotion boolean"
    path = str(tmp_path / "in")
    spark.createDataFrame(days, schema).write.parquet(path)
    stream = spark.readStream.schema(schema).parquet(path)
    bad = quality.negative_units(features.add_calendar(stream))
    query = bad.writeStream.format("memory").queryName("bad_rows").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("bad_rows").count() == 2


def test_joins_of_bucketed_tables_leave_the_fact_where_it_is(spark, tmp_path):
    """Fact, weather and events on (store_id, date): only the events, which are grouped first, are shuffled."""
    from shelfwise.operators.enrich import merge_external
    from shelfwise.sources.buckets import write_bucketed

    first = date(2024, 1, 1)
    rows = [(s, i % 5, first + timedelta(i % 20), float(i)) for s in (1, 1, 1, 2, 3) for i in range(200)]
    fact = spark.createDataFrame(rows, "store_id int, product_id int, date date, units double")
    days = fact.select("store_id", "date").distinct()
    weather = days.select(
        "store_id", "date", *(F.col("store_id").cast("double").alias(f"weather_{n}") for n in ("temp_mean", "precip_sum", "wind_max"))
    )
    events = days.filter("day(date) < 4").select("date", F.lit("fair").alias("event_name"), "store_id", F.lit(1.5).alias("event_intensity"))
    names = [f"bucketed_{n}_{os.getpid()}" for n in ("fact", "weather")]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = [
            write_bucketed(t, n, str(tmp_path / n)) for t, n in zip((fact, weather), names)
        ]
        merged = merge_external(*kept, events)
        plan = plan_of(merged)
        assert merged.count() == len(rows)
        shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        assert shuffled and not any("units" in line or "weather" in line for line in shuffled)
        # Below every exchange there is no scan of a bucketed table.
        depth = None
        for line in plan.splitlines():
            indent = len(line) - len(line.lstrip(" :+-*()0123456789"))
            if depth is not None and indent <= depth:
                depth = None
            if "Exchange hashpartitioning" in line:
                depth = indent
            assert depth is None or "Bucketed: true" not in line
        assert plan.count("Bucketed: true") == 2
        plain = merge_external(fact, weather, events)
        assert sorted(map(str, merged.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
