"""Images and objects far from the rest of their data set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom import config
from labelloom.functions import geometry
from labelloom.operators.skew import join_group_summary


#: Copies of a summary by data set, of which there are few.
SALTS = 64


def resolution(images: DataFrame, z: float = config.Z_THRESHOLD) -> DataFrame:
    """Width, else height, more than ``z`` sample deviations from the mean."""
    rows = images.where("width IS NOT NULL AND height IS NOT NULL").select("dataset", "id", "width", "height")
    summary = rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("_n"),
        *[f(c).alias(f"_{name}_{c}") for c in ("width", "height") for name, f in (("m", F.avg), ("s", F.stddev_samp))],
    )
    score = lambda c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}"))
    wide = F.coalesce(F.abs(score("width")) > z, F.lit(False))
    high = F.coalesce(F.abs(score("height")) > z, F.lit(False))
    return (
        join_group_summary(rows, summary, ["dataset"], "_n", ["id"])
        .where(wide | high)
        .select(
            "dataset", "id", "width", "height",
            F.when(wide, "width").otherwise("height").alias("axis"),
            F.round(F.when(wide, score("width")).otherwise(score("height")), 6).alias("z_score"),
        )
    )


def extreme_aspect(annotations: DataFrame, limit: float = config.MAX_ASPECT_RATIO) -> DataFrame:
    """Height over width beyond the limit either way; a box without width is infinite."""
    ratio = geometry.aspect_h_over_w(F.col("width"), F.col("height"))
    inverse = F.when(ratio > 0, 1 / F.nullif(ratio, F.lit(0.0))).otherwise(float("inf"))
    return annotations.where((ratio > limit) | (inverse > limit)).select(
        "dataset", "id", "seq1", "seq2", "x", "width", "height"
    )


def tiny_objects(annotations: DataFrame, limit: float = config.MIN_OBJECT_AREA) -> DataFrame:
    area = geometry.area(F.col("width"), F.col("height"))
    return annotations.where(area < limit).select("dataset", "id", "seq1", "seq2", "x", "label", area.alias("area"))


def huge_objects(annotations: DataFrame, z: float = config.Z_THRESHOLD) -> DataFrame:
    """Area above the mean by more than ``z`` sample deviations."""
    rows = annotations.select(
        "dataset", "id", "seq1", "seq2", "x", geometry.area(F.col("width"), F.col("height")).alias("area")
    )
    summary = rows.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("_n"), F.avg("area").alias("_m"), F.stddev_samp("area").alias("_s")
    )
    limit = F.col("_m") + z * F.col("_s")
    return (
        join_group_summary(rows, summary, ["dataset"], "_n", ["id", "seq1", "seq2"], salts=SALTS)
        .where((F.col("_s") > 0) & (F.col("area") > limit))
        .select("dataset", "id", "seq1", "seq2", "x", "area", F.round(limit, 4).alias("threshold"))
    )
