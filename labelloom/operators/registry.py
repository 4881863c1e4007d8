"""Registries kept as append-only logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import versions


def latest(log: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str], deleted: str | None = None) -> DataFrame:
    """Newest row per key; keys whose newest row is a deletion are left out."""
    extra = [deleted] if deleted else []
    newest = F.max(F.struct(*order, *columns, *extra)).alias("_r")
    out = log.groupBy(*key).agg(newest, F.count(F.lit(1)).alias("revisions"))
    if deleted:
        out = out.where(~F.col(f"_r.{deleted}"))
    return out.select(*key, *[f"_r.{c}" for c in columns], "revisions")


def insert(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Registry with the new rows whose key is not taken."""
    return existing.unionByName(new.dropDuplicates(list(key)).join(existing.select(*key), list(key), "left_anti"))


def update(existing: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows with a change are replaced; changes to unknown keys are ignored."""
    kept = existing.join(changes.select(*key), list(key), "left_anti")
    return kept.unionByName(changes.join(existing.select(*key), list(key), "left_semi"))


def remove(existing: DataFrame, keys: DataFrame, key: Sequence[str]) -> DataFrame:
    return existing.join(keys.select(*key), list(key), "left_anti")


def count_by(existing: DataFrame, by: Sequence[str]) -> DataFrame:
    return existing.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"))


def list_by(existing: DataFrame, condition: Column, order: Sequence[str]) -> DataFrame:
    return existing.where(condition).orderBy(*order)


def version_list(log: DataFrame) -> DataFrame:
    """Versions newest first, by number and not by text: 1.0.10 comes before 1.0.9."""
    parsed = versions.parse(F.col("version"))
    return log.select("dataset", "version").distinct().withColumn("_v", parsed).orderBy("dataset", F.desc("_v"), "version").select(
        "dataset", "version", "_v.major", "_v.minor", "_v.patch"
    )


def latest_version(log: DataFrame) -> DataFrame:
    return log.groupBy("dataset").agg(F.max(F.struct(versions.parse(F.col("version")).alias("v"), "version")).alias("_m")).select(
        "dataset", F.col("_m.version").alias("version")
    )
