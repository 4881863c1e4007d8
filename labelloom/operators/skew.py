"""Joins, ranks and scans that stay balanced when one key holds most of the rows.

A plain window sends a whole group to one task. The scans here cut each group into
ordered buckets, work inside the buckets in parallel, and carry one summary row per
bucket forward, so the work per task is bounded by the bucket, not by the group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labelloom.session import stored


def _over_group(group: Sequence[str], bucket: str):
    partition = list(group) or [F.lit(0)]
    return W.partitionBy(*partition).orderBy(bucket)


def _before(spec):
    return spec.rowsBetween(W.unboundedPreceding, -1)


def hash_bucket(hash_hex: Column, digits: int = 3) -> Column:
    """Leading hex digits of a hash: uniform buckets that keep the order of the hash."""
    return F.substring(hash_hex, 1, digits)


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "_range") -> DataFrame:
    """``df`` with a bucket column for the scans here, of ranges that hold about as many rows
    each, however the values of ``order`` lie.

    Spark samples quantiles of (group, order) and sends each range to a partition; its number
    does not decrease along the order. The result is stored in the shared folder, so that
    every reader sees the same ranges.
    """
    placed = df.repartitionByRange(*group, *order).withColumn(name, F.spark_partition_id())
    return stored(placed, "ranges")


def stored_row_number(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """Exact ``row_number`` over all rows, in ranges of even size; the result is stored.

    The rows are sorted within their ranges as they are stored and carry their place there,
    so that the number takes one shuffle: only the sizes of the ranges are added up later.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    rows = stored(placed, "numbered")
    # The id holds the partition above 33 bits and the row within it below.
    rows = rows.withColumn("_range", F.shiftrightunsigned("_place", 33)).withColumn("_local", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    sizes = rows.groupBy("_range").agg(F.max("_local").alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(_before(_over_group([], "_range"))), F.lit(0)).alias("_offset"))
    return rows.join(offsets, "_range").withColumn(name, F.col("_offset") + F.col("_local")).drop("_place", "_range", "_local", "_offset")


def bucketed_row_number(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    name: str = "rn",
) -> DataFrame:
    """Exact ``row_number`` per ``group``; ``bucket`` must not decrease along ``order``."""
    keys = [*group, bucket]
    local = df.withColumn("_local", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        *keys,
        F.coalesce(F.sum("_n").over(_before(_over_group(group, bucket))), F.lit(0)).alias("_offset"),
    )
    return (
        join_on(local, offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_offset", "_local")
    )


def bucketed_running(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[Column | str],
    value: str,
    name: str,
    how: str = "sum",
) -> DataFrame:
    """Running ``sum``, ``max`` or ``min`` of ``value`` up to and including each row."""
    keys = [*group, bucket]
    agg = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumn("_local", agg(value).over(inside))
    totals = df.groupBy(*keys).agg(agg(value).alias("_t"))
    carried = totals.select(*keys, agg("_t").over(_before(_over_group(group, bucket))).alias("_carry"))
    joined = join_on(local, carried, keys)
    if how == "sum":
        merged = F.coalesce("_carry", F.lit(0)) + F.coalesce("_local", F.lit(0))
    else:
        merged = (F.greatest if how == "max" else F.least)("_carry", "_local")
    return joined.withColumn(name, merged).drop("_local", "_carry")


def bucketed_lag(
    df: DataFrame,
    group: Sequence[str],
    bucket: str,
    order: Sequence[str],
    value: str,
    name: str,
) -> DataFrame:
    """Value of the previous row of the group, across bucket borders."""
    keys = [*group, bucket]
    inside = W.partitionBy(*keys).orderBy(*order)
    local = df.withColumn("_lag", F.lag(value).over(inside)).withColumn(
        "_first", F.row_number().over(inside) == 1
    )
    last = df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = last.select(*keys, F.lag("_last").over(_over_group(group, bucket)).alias("_carry"))
    return (
        join_on(local, carried, keys)
        .withColumn(name, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_lag")))
        .drop("_lag", "_first", "_carry")
    )


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join by names in which null keys meet null keys; the keys appear once."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(renamed, condition, how).drop(*[f"_k_{k}" for k in keys])


def join_group_summary(rows: DataFrame, summary: DataFrame, keys: Sequence[str], size: str, spread: Sequence[str], salts: int = 1) -> DataFrame:
    """Inner join rows to a summary that has one row per key; null is a key like others.

    One shuffled join for all sizes of groups: nothing above it relies on its
    partitioning by key, so adaptive execution splits the partitions of hot keys. Where
    the keys are few, ``salts`` copies of the summary spread the rows of each.
    """
    extra = [c for c in summary.columns if c not in keys]
    if salts == 1:
        return join_on(rows, summary, keys).select(*rows.columns, *extra)
    salted, repeated = _salted(rows, summary, spread, salts)
    return join_on(salted, repeated, [*keys, "_salt"]).select(*rows.columns, *extra)


def _salted(big: DataFrame, small: DataFrame, spread: Sequence[str], salts: int) -> tuple[DataFrame, DataFrame]:
    """``big`` with a salt from the columns ``spread``, and ``small`` once for each salt."""
    return (
        big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")),
        small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))),
    )


def top_k(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    Spark turns the rank filter into a group limit that runs before the shuffle, so
    each task sends at most ``k`` rows per group.
    """
    spec = W.partitionBy(*(list(group) or [F.lit(0)])).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).where(F.col(rank) <= k)


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """Inner or left join whose hot keys on the big side are spread over ``salts`` tasks.

    The other side is repeated once per salt, so it should be the smaller one.
    """
    salted, repeated = _salted(big, small, spread, salts)
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
