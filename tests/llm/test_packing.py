"""Bucket lengths are the best ones whatever the lengths."""

import random

from pyspark.sql import functions as F

from labelloom.llm import packing


def padding(ends, found):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in found.items())


def least_padding(found, buckets):
    """Least padding by trying every start of every bucket."""
    lengths = sorted(found)
    cost = {0: 0}
    for _ in range(buckets):
        cost |= {
            j: min(cost[i] + sum(found[n] * (lengths[j - 1] - n) for n in lengths[i:j]) for i in range(j) if i in cost)
            for j in range(len(lengths), 0, -1)
        }
    return cost[len(lengths)]


def test_boundaries_of_long_texts_are_best(spark):
    for seed in range(4):
        rng = random.Random(seed)
        found = {n: rng.randint(1, 9) for n in rng.sample(range(256, 3000), 40)}
        table = spark.createDataFrame([(n,) for n, c in found.items() for _ in range(c)], "n long")
        ends, total = packing.boundaries(table, "n", 4)
        assert total == sum(found.values()) and len(ends) == 4
        assert padding(ends, found) == least_padding(found, 4)


def test_neighbouring_lengths_are_told_apart(spark):
    table = spark.range(1000).select(F.when(F.col("id") < 999, 1000).otherwise(1001).alias("n"))
    assert packing.boundaries(table, "n", 2)[0] == [1000, 1001]
