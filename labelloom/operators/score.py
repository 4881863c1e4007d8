"""Weighted quality scores over the checks and statistics of a data set."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import config
from labelloom.functions.bins import clamp, letter_grade
from labelloom.operators import checks, dedup, stats


def _ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(empty))


def import_score(imports: DataFrame, duplicates: DataFrame, imbalance: DataFrame, coverage: DataFrame, classes: DataFrame) -> DataFrame:
    """Mean of five scores in 0..1, and the gate at 0.6 with minimum counts."""
    joined = reduce(lambda a, b: a.join(b, "dataset", "left"), [imports, duplicates, imbalance, coverage, classes])
    unit = lambda c: F.greatest(F.lit(0.0), c)
    missing = F.col("missing_images") + F.col("empty_annotations")
    bad = F.col("invalid_boxes") + F.col("negative_boxes")
    parts = {
        "duplicate_score": unit(1 - F.col("duplicate_ratio") / config.MAX_DUPLICATE_RATIO),
        "imbalance_score": unit(1 - F.col("import_ratio") / config.MAX_CLASS_IMBALANCE),
        "missing_score": unit(1 - _ratio(missing, F.col("images"), 0.0)),
        "consistency_score": unit(1 - _ratio(bad, F.col("annotations"), 0.0)),
        "coverage_score": F.least(F.lit(1.0), F.col("coverage") / config.MIN_ONTOLOGY_COVERAGE),
    }
    score = sum(parts.values(), F.lit(0.0)) / len(parts)
    errors = (
        (F.col("duplicate_ratio") > config.MAX_DUPLICATE_RATIO).cast("int")
        + (F.col("images") < config.MIN_IMAGES).cast("int")
        + (F.col("annotations") < config.MIN_ANNOTATIONS).cast("int")
        + (F.col("classes") < config.MIN_CLASSES).cast("int")
    )
    return joined.select(
        "dataset",
        *[F.round(c, 6).alias(k) for k, c in parts.items()],
        F.round(score, 6).alias("quality_score"),
        errors.alias("errors"),
        ((score >= config.MIN_QUALITY_SCORE) & (errors == 0)).alias("passed"),
    )


def sub_scores() -> dict[str, Column]:
    """The seven sub-scores, 0..100, from the counters of :func:`scorecard_inputs`."""
    c = F.col
    total = c("annotations") + F.greatest(F.lit(0), c("missing") - 1)
    image = (
        100 - _ratio(c("corrupt"), c("images"), 0.0) * 100
        - _ratio(c("wrong_format") + c("wrong_color_space") + c("tiny") + c("oversized"), c("images"), 0.0) * 25
    )
    annotation = (
        100 - _ratio(c("negative_coordinates") + c("zero_area") + c("broken_obb"), total, 0.0) * 100
        - _ratio(c("out_of_bounds") + c("invalid_polygon") + c("missing"), total, 0.0) * 20
    )
    geometry = 100 - _ratio(c("bad_bbox") + c("bad_segmentation"), c("annotations"), 0.0) * 100
    balance = (
        100 - F.when(c("ratio") > 1, F.least(F.lit(50.0), (c("ratio") - 1) * 5)).otherwise(0.0)
        - _ratio(c("rare"), c("classes"), 0.0) * 50
    )
    none = c("annotations") == 0
    bounded = lambda v: clamp(v, 0.0, 100.0)
    return {
        "image": bounded(image),
        "annotation": F.when(none, 100.0).otherwise(bounded(annotation)),
        "geometry": F.when(none, 100.0).otherwise(bounded(geometry)),
        "coverage": c("coverage"),
        "balance": bounded(balance),
        "integrity": c("integrity_flags") / 5 * 100,
        "consistency": c("consistency_flags") / 5 * 100,
    }


def scorecard_inputs(
    images: DataFrame, annotations: DataFrame, ontology: DataFrame, files: DataFrame,
    ontology_version: str = "1.0.0", pipeline_version: str = "1.0.0",
) -> DataFrame:
    """All counters the score card needs, one row per data set."""
    expected = ontology.agg(F.count(F.lit(1)).alias("c")).scalar()
    classes = stats.class_validation_summary(annotations, ontology)
    known = F.col("classes") - F.col("unknown")
    classes = classes.withColumn("coverage", F.coalesce(known / F.nullif(expected, F.lit(0)) * 100, F.lit(0.0))).drop("unused")
    repeated = dedup.repeated_ids(images, annotations, by=["dataset"]).groupBy("dataset").agg(F.count(F.lit(1)).alias("repeated_ids"))
    sides = [
        checks.annotation_counts(annotations, images),
        classes,
        repeated,
        checks.file_integrity(images, files),
        checks.consistency(images, annotations, ontology_version, pipeline_version),
    ]
    joined = reduce(lambda a, b: a.join(b, "dataset", "left"), sides, checks.image_counts(images)).na.fill(0).na.fill(0.0)
    return checks.integrity_flags(joined.withColumn("missing", F.col("images") - F.col("annotated")), ontology_version, pipeline_version)


def scorecard(images: DataFrame, annotations: DataFrame, ontology: DataFrame, files: DataFrame) -> DataFrame:
    """Seven sub-scores, overall score, grade and production readiness per data set."""
    parts = sub_scores()
    overall = sum((c * config.SCORECARD_WEIGHTS[k] for k, c in parts.items()), F.lit(0.0))
    c = F.col
    clean = (
        (c("negative_coordinates") + c("zero_area") == 0) & (c("bad_bbox") == 0) & (c("unknown") == 0)
        & (c("repeated_ids") == 0) & c("integrity_passed") & c("consistency_passed")
    )
    return scorecard_inputs(images, annotations, ontology, files).select(
        "dataset",
        *[F.round(v, 1).alias(f"{k}_score") for k, v in parts.items()],
        F.round(overall, 1).alias("overall"),
        letter_grade(overall).alias("grade"),
        ((overall >= config.PRODUCTION_READY_SCORE) & clean).alias("production_ready"),
    )


def managed_score(statistics: DataFrame, issues: DataFrame) -> DataFrame:
    """Six-factor score in 0..1 from :func:`stats.managed_statistics` and the issues of
    managed files. The duplicate share is a percentage of the images."""
    named = ("missing_labels", "duplicate_images", "duplicate_annotations")
    found = issues.groupBy("dataset").agg(
        *[stats.count_if(F.col("rule") == k).alias(k) for k in named], F.count_distinct("rule").alias("failed_checks")
    )
    w = config.MANAGED_WEIGHTS
    images = F.greatest(F.col("images"), F.lit(1))
    percent = (F.col("duplicate_images") + F.col("duplicate_annotations")) / images * 100
    ratio = F.col("imbalance_ratio")
    validation = (config.MANAGED_CHECKS - F.col("failed_checks")) / config.MANAGED_CHECKS
    score = (
        w["completeness"] * F.col("completeness")
        + w["balance"] * F.when(ratio == 0, 1.0).otherwise(F.least(F.lit(1.0), 1 / F.nullif(ratio, F.lit(0.0))))
        + w["image_quality"]
        + w["duplicate"] * F.greatest(F.lit(0.0), 1 - percent / 100)
        + w["missing"] * F.greatest(F.lit(0.0), 1 - F.col("missing_labels") / images)
        + w["validation"] * validation
    )
    return statistics.join(found, "dataset", "left").na.fill(0).select(
        "dataset",
        F.round(percent, 4).alias("duplicate_percentage"),
        "missing_labels",
        F.round(validation, 4).alias("validation_score"),
        F.round(clamp(score, 0.0, 1.0), 4).alias("quality_score"),
    )
