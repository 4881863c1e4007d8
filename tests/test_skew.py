"""Skew-safe joins and scans against plain Python, with one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from labelloom.operators import dedup, skew


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [(("hot" if rng.random() < 0.6 else f"k{rng.randrange(9)}"), i, rng.randrange(50)) for i in range(600)]
    return data, spark.createDataFrame(data, "g string, t long, v long").repartition(7)


def grouped(data):
    out = {}
    for g, t, v in sorted(data, key=lambda r: r[1]):
        out.setdefault(g, []).append((t, v))
    return out


def test_row_number_running_and_lag(rows):
    data, df = rows
    df = df.withColumn("b", F.floor(F.col("t") / 37))
    want = {}
    for g, items in grouped(data).items():
        total, top, before = 0, None, None
        for n, (t, v) in enumerate(items, 1):
            total, top = total + v, v if top is None else max(top, v)
            want[t] = (n, total, top, before)
            before = v
    out = skew.bucketed_row_number(df, ["g"], "b", ["t"], "n")
    out = skew.bucketed_running(out, ["g"], "b", ["t"], "v", "total")
    out = skew.bucketed_running(out, ["g"], "b", ["t"], "v", "top", how="max")
    out = skew.bucketed_lag(out, ["g"], "b", ["t"], "v", "before")
    got = {r.t: (r.n, r.total, r.top, r.before) for r in out.collect()}
    assert got == want


def test_global_row_number_without_group(rows):
    data, df = rows
    out = skew.bucketed_row_number(df.withColumn("b", F.floor(F.col("t") / 100)), [], "b", ["t"], "n")
    assert {r.t: r.n for r in out.collect()} == {t: t + 1 for _, t, _ in data}


def test_join_group_summary_gives_the_plain_join(rows):
    data, df = rows
    summary = df.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s")).where("g <> 'k3'")
    out = skew.join_group_summary(df, summary, ["g"], "n", ["t"])
    sums = {}
    for g, _, v in data:
        sums[g] = sums.get(g, 0) + v
    assert {(r.g, r.t, r.v, r.s) for r in out.collect()} == {(g, t, v, sums[g]) for g, t, v in data if g != "k3"}
    assert out.count() == sum(1 for g, _, _ in data if g != "k3")


def test_null_keys_are_keys(rows):
    _, df = rows
    df = df.withColumn("g", F.when(F.col("g") != "hot", F.col("g"))).withColumn("b", F.floor(F.col("t") / 100))
    summary = df.groupBy("g").agg(F.count("*").alias("n"))
    assert skew.join_group_summary(df, summary, ["g"], "n", ["t"]).count() == df.count()
    assert skew.bucketed_row_number(df, ["g"], "b", ["t"], "n").count() == df.count()
    assert skew.bucketed_running(df, ["g"], "b", ["t"], "v", "total").count() == df.count()
    assert skew.bucketed_lag(df, ["g"], "b", ["t"], "v", "before").count() == df.count()


def test_salted_join_and_top_k(rows):
    data, df = rows
    small = df.select("g").distinct().withColumn("w", F.length("g"))
    assert skew.salted_join(df, small, ["g"], ["t"], 5).count() == len(data)
    out = skew.top_k(df, ["g"], [F.desc("v"), "t"], 3)
    want = {(g, t) for g, items in grouped(data).items() for t, _ in sorted(items, key=lambda i: (-i[1], i[0]))[:3]}
    assert {(r.g, r.t) for r in out.collect()} == want
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_copies_keep_the_first_of_a_hot_group(spark):
    df = spark.createDataFrame([("a", i) for i in range(40)] + [("b", 99), (None, 100), (None, 101)], "k string, id long")
    out = dedup.copies(df, ["k"], "id", ["id"]).collect()
    assert sorted((r.id, r.original_id, r.copies) for r in out) == [(i, 0, 40) for i in range(1, 40)]


def test_near_duplicates_report_groups_not_pairs(spark):
    rows = [(i, f"p{i % 4}", 10, 10, "jpg") for i in range(30)] + [(50, "x", 10, 11, "jpg"), (51, "y", None, 1, "jpg"), (52, "same", 7, 7, "png"), (53, "same", 7, 7, "png")]
    out = dedup.near_duplicates(spark.createDataFrame(rows, "id long, file_path string, width int, height int, format string")).collect()
    pairs = sum(1 for a in range(30) for b in range(a + 1, 30) if a % 4 != b % 4)
    assert {(r.group_id, r.member_id) for r in out} == {(0, i) for i in range(1, 30)}
    assert {(r.members, r.pairs) for r in out} == {(30, pairs)}
