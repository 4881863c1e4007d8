"""Checks and counters over a stream of new rows.

The row checks keep no state, so they are the same functions as for tables. The
counters keep one small row of state per data set or source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from labelloom.operators import catalog, checks


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet files of a directory."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def image_issues(images: DataFrame) -> DataFrame:
    return checks.image_issues(images)


def geometry_issues(annotations: DataFrame) -> DataFrame:
    return checks.geometry_issues(annotations)


def source_reliability(fetches: DataFrame) -> DataFrame:
    """Running reliability per source; write it in update or complete mode."""
    return catalog.source_reliability(fetches)


def append_issues(issues: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append found issues as Parquet, once per input row even after a restart."""
    return (
        issues.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
        .trigger(availableNow=True).start()
    )
