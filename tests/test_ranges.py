"""Scans over ranges of even size where one hour, and one group, hold most of the rows."""

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from labelloom.operators import history
from labelloom.operators.skew import bucketed_lag, bucketed_row_number, bucketed_running, ranged


def events(spark, n=60_000):
    """90 % of the events within one hour, most of them of one experiment."""
    i = F.col("id")
    second = F.when(i % 10 == 0, i * 400).otherwise(i % 3600)
    return spark.range(n).select(
        F.when(i % 8 < 5, 1).otherwise(i % 40).cast("long").alias("experiment_id"), F.timestamp_seconds(second).alias("ts"), i.alias("event_id"), (i * 7919 % 1000).cast("double").alias("value")
    )


@pytest.fixture(autouse=True)
def no_merging(spark):
    """Small tables would be merged into one range."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_ranges_are_even_and_scans_exact(spark):
    placed = ranged(events(spark), ["experiment_id"], ["ts", "event_id"])
    sizes = sorted(r["count"] for r in placed.groupBy("_range").count().collect())
    assert len(sizes) >= 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    order = ["ts", "event_id"]
    found = bucketed_row_number(placed, ["experiment_id"], "_range", order, "rn")
    found = bucketed_running(found, ["experiment_id"], "_range", order, "value", "total")
    found = bucketed_lag(found, ["experiment_id"], "_range", order, "event_id", "before").drop("_range")
    spec = W.partitionBy("experiment_id").orderBy(*order)
    plain = events(spark).withColumn("rn", F.row_number().over(spec)).withColumn("total", F.sum("value").over(spec)).withColumn("before", F.lag("event_id").over(spec))
    columns = plain.columns
    assert found.select(columns).exceptAll(plain).isEmpty() and found.count() == plain.count()


def test_epochs_of_a_burst(spark):
    spec = W.partitionBy("experiment_id").orderBy("ts", "event_id")
    plain = events(spark).withColumn("epoch", F.row_number().over(spec))
    assert history.with_epoch(events(spark)).select(plain.columns).exceptAll(plain).isEmpty()
    hours = events(spark).withColumn("hour", F.date_trunc("hour", "ts"))
    assert history.with_epoch(hours, "hour").select(plain.columns).exceptAll(plain).isEmpty()
