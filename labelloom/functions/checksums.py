"""Content hashes of texts, records and directories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_text(c: Column) -> Column:
    return F.sha2(c, 256)


def of_record(*fields: str) -> Column:
    """Hash of the JSON of the fields in name order, so field order does not matter."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), 256)


def of_map(c: Column) -> Column:
    """Hash of a string map, whatever the order of its entries."""
    return F.sha2(F.to_json(F.array_sort(F.map_entries(c))), 256)


def directory(files: DataFrame, group: Sequence[str], path: str, file_hash: str, digits: int = 3, step: int = 3) -> DataFrame:
    """One hash per directory over its (relative path, file hash) pairs.

    Files are hashed per bucket of ``digits`` leading digits of the path hash; buckets are
    then hashed in order, ``step`` digits at a time, up to the whole directory. A task
    holds the files of one bucket or at most 16^step bucket hashes, so more digits serve
    a larger directory. The value depends on ``digits`` and ``step``.
    """
    level = files.select(
        *group, F.substring(F.md5(path), 1, digits).alias("_bucket"), F.struct(F.col(path).alias("p"), F.col(file_hash).alias("h")).alias("_e")
    )
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list("_e")), lambda s: F.concat(s["p"], s["h"])), "")
        hashed = level.groupBy(*group, "_bucket").agg(F.sha2(joined, 256).alias("_h"))
        if digits == 0:
            return hashed.select(*group, F.col("_h").alias("directory_sha256"))
        digits = max(0, digits - step)
        level = hashed.select(
            *group, F.substring("_bucket", 1, digits).alias("_bucket"), F.struct(F.col("_bucket").alias("p"), F.col("_h").alias("h")).alias("_e")
        )
