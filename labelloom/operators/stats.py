"""Counts, distributions and profiles of labelled data sets.

``by`` names the grouping columns, by default the data set. A data set may hold most of
the rows: every figure is an aggregate with a map-side step, and shares are taken by
joining two aggregates, never by a window over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labelloom import config
from labelloom.functions import bins, geometry, text
from labelloom.operators.skew import join_on

BY = ("dataset",)


def count_if(condition: Column) -> Column:
    """Rows for which the condition is true; 0 for none."""
    return F.count_if(F.coalesce(condition, F.lit(False)))


def standard_metadata(images: DataFrame, target_format: str = "jpg", target_color: str = "rgb") -> DataFrame:
    """Format from the extension, and defaults for what is missing."""
    ext = F.regexp_replace(text.extension(F.col("file_path")), r"^\.", "")
    return images.withColumn("format", text.first_filled(ext, F.col("format"), F.lit(target_format))).withColumn(
        "color_space", text.first_filled(F.col("color_space"), F.lit(target_color))
    )


def with_class(annotations: DataFrame, name: str = "class_name") -> DataFrame:
    """The class of an annotation: ontology class, else normalised label, else the label."""
    label = F.col("label")
    return annotations.withColumn(name, text.first_filled(F.col("ontology_class"), text.class_name(label), label))


def class_counts(annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Annotations per class. Rows are counted by raw label first, so the class name is
    worked out once per label and not once per row."""
    raw = annotations.groupBy(*by, "ontology_class", "label").agg(F.count(F.lit(1)).alias("_n"))
    return with_class(raw).groupBy(*by, "class_name").agg(F.sum("_n").alias("n"))


def with_share(counts: DataFrame, by: Sequence[str] = BY, value: str = "n", name: str = "share", digits: int = 6) -> DataFrame:
    totals = counts.groupBy(*by).agg(F.sum(value).alias("_total"))
    return join_on(counts, totals, list(by)).withColumn(name, F.round(F.col(value) / F.col("_total"), digits)).drop("_total")


def class_distribution(annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    return with_share(class_counts(annotations, by), by)


def dataset_totals(images: DataFrame, annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    sized = (F.col("width") > 0) & (F.col("height") > 0)
    per_image = images.groupBy(*by).agg(
        F.count(F.lit(1)).alias("images"),
        F.avg(F.when(sized, F.col("width"))).alias("_w"),
        F.avg(F.when(sized, F.col("height"))).alias("_h"),
    )
    per_label = class_counts(annotations, by).groupBy(*by).agg(
        F.sum("n").alias("annotations"), F.count(F.lit(1)).alias("classes")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return per_image.join(per_label, list(by), "full").select(
        *by,
        zero("images").alias("images"),
        zero("annotations").alias("annotations"),
        zero("classes").alias("classes"),
        F.round(F.coalesce(zero("annotations") / F.nullif(zero("images"), F.lit(0)), F.lit(0.0)), 6).alias("objects_per_image"),
        F.round(F.coalesce("_w", F.lit(0.0)), 6).alias("avg_width"),
        F.round(F.coalesce("_h", F.lit(0.0)), 6).alias("avg_height"),
    )


def resolution_histogram(images: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    sized = images.where("width > 0 AND height > 0")
    size = F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string"))
    return sized.groupBy(*by, size.alias("resolution")).agg(F.count(F.lit(1)).alias("n"))


def box_histograms(annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Width, height and aspect of boxes, counted at two decimals in one pass."""
    w, h = F.col("width"), F.col("height")
    measures = {"width": w, "height": h, "aspect": geometry.aspect_w_over_h(w, h)}
    entries = F.array(*[F.struct(F.lit(k).alias("measure"), F.round(c, 2).alias("value")) for k, c in measures.items()])
    return annotations.select(*by, F.inline(entries)).groupBy(*by, "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def imbalance(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Largest over smallest class. With fewer than two classes the profiles differ:
    0 for imports, 1 for quality reports, and the plain ratio for managed sets."""
    ratio = F.max("n") / F.min("n")
    several = F.count(F.lit(1)) > 1
    return counts.groupBy(*by).agg(
        F.round(F.when(several, ratio).otherwise(0.0), 6).alias("import_ratio"),
        F.round(F.when(several, ratio).otherwise(1.0), 6).alias("quality_ratio"),
        F.round(ratio, 6).alias("managed_ratio"),
    )


def diversity(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Shannon entropy over its maximum, from sums only: log2 N - sum(n log2 n) / N."""
    total, classes = F.sum("n"), F.count(F.lit(1))
    entropy = F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total
    return counts.groupBy(*by).agg(
        F.round(F.when(classes > 1, entropy / F.nullif(F.log2(classes), F.lit(0.0))).otherwise(0.0), 6).alias("diversity")
    )


def ontology_coverage(annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    mapped = F.coalesce(text.blank_to_null(F.col("ontology_class")).isNotNull(), F.lit(False))
    return annotations.groupBy(*by).agg(
        F.count(F.lit(1)).alias("annotations"),
        F.count_if(mapped).alias("mapped"),
        F.round(F.coalesce(F.avg(mapped.cast("double")), F.lit(1.0)), 6).alias("coverage"),
    )


def conversion_statistics(images: DataFrame, annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Annotations per image, with and without, and box averages of converted sets."""
    per_image = annotations.groupBy(*by, "image_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("width").alias("w"), F.sum("height").alias("h")
    )
    labels = per_image.groupBy(*by).agg(
        F.sum("n").alias("annotations"),
        F.count(F.lit(1)).alias("images_with"),
        F.min("n").alias("min_per_image"),
        F.max("n").alias("max_per_image"),
        (F.sum("w") / F.sum("n")).alias("_w"),
        (F.sum("h") / F.sum("n")).alias("_h"),
    )
    pics = images.groupBy(*by).agg(F.count(F.lit(1)).alias("images"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return pics.join(labels, list(by), "left").select(
        *by,
        "images",
        zero("annotations").alias("annotations"),
        zero("images_with").alias("images_with"),
        (F.col("images") - zero("images_with")).alias("images_without"),
        zero("min_per_image").alias("min_per_image"),
        zero("max_per_image").alias("max_per_image"),
        F.round(zero("annotations") / F.col("images"), 6).alias("avg_per_image"),
        F.round(F.coalesce("_w", F.lit(0.0)), 6).alias("avg_box_width"),
        F.round(F.coalesce("_h", F.lit(0.0)), 6).alias("avg_box_height"),
        F.round(zero("images_with") / F.col("images") * 100, 6).alias("coverage_percent"),
    )


def managed_statistics(images: DataFrame, annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Balance, completeness and evenness of file-level sets.

    Evenness is 1 less the deviation of class shares, which equals the deviation of the
    counts over their sum.
    """
    classes = class_counts(annotations, by).groupBy(*by).agg(
        F.sum("n").alias("annotations"),
        F.count(F.lit(1)).alias("classes"),
        (F.max("n") / F.min("n")).alias("ratio"),
        (1 - F.coalesce(F.stddev_samp("n"), F.lit(0.0)) / F.sum("n")).alias("evenness"),
    )
    annotated = annotations.select(F.col("image_id").alias("id")).distinct()
    flagged = images.select(*by, "id").join(annotated.withColumn("_a", F.lit(1)), "id", "left")
    pics = flagged.groupBy(*by).agg(F.count(F.lit(1)).alias("images"), F.count("_a").alias("annotated"))
    return pics.join(classes, list(by), "left").select(
        *by,
        "images",
        F.coalesce("annotations", F.lit(0)).alias("annotations"),
        F.coalesce("classes", F.lit(0)).alias("classes"),
        F.round(F.coalesce("ratio", F.lit(0.0)), 6).alias("imbalance_ratio"),
        F.round(F.col("annotated") / F.col("images"), 6).alias("completeness"),
        F.round(F.coalesce("evenness", F.lit(0.0)), 6).alias("coverage_score"),
    )


def class_validation(annotations: DataFrame, ontology: DataFrame) -> DataFrame:
    """Every class found or expected, with its unknown, unused and rare flags."""
    counts = class_counts(annotations, by=())
    total = counts.agg(F.sum("n").alias("t"))
    threshold = F.greatest(total.select(F.col("t") * config.RARE_CLASS_SHARE).scalar(), F.lit(float(config.MIN_CLASS_SAMPLES)))
    known = ontology.select(F.col("value").alias("class_name"), F.lit(True).alias("_known"))
    n = F.coalesce("n", F.lit(0))
    return counts.join(known, "class_name", "full").select(
        "class_name",
        n.alias("n"),
        F.col("_known").isNull().alias("is_unknown"),
        F.col("n").isNull().alias("is_unused"),
        ((n > 0) & (n < threshold)).alias("is_rare"),
    )


def class_validation_summary(annotations: DataFrame, ontology: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Per data set: classes, unknown, unused and rare ones, and the imbalance."""
    counts = class_counts(annotations, by)
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_t"))
    known = ontology.select(F.col("value").alias("class_name"), F.lit(1).alias("_known"))
    expected = ontology.agg(F.count(F.lit(1)).alias("c")).scalar()
    threshold = F.greatest(F.col("_t") * config.RARE_CLASS_SHARE, F.lit(float(config.MIN_CLASS_SAMPLES)))
    several = F.count(F.lit(1)) > 1
    return (
        counts.join(known, "class_name", "left")
        .join(totals, list(by))
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("classes"),
            (F.count(F.lit(1)) - F.count("_known")).alias("unknown"),
            (expected - F.count("_known")).alias("unused"),
            F.count_if(F.col("n") < threshold).alias("rare"),
            F.when(several, F.max("n") / F.min("n")).otherwise(1.0).alias("ratio"),
        )
    )


def imbalance_classes(annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Majority and minority classes with the sample count to aim for."""
    counts = class_counts(annotations, by)
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("_t"), F.max("n").alias("_max"), F.count(F.lit(1)).alias("_k")
    )
    several = F.col("_k") > 1
    minority = several & (
        (F.col("n") < config.MIN_CLASS_SAMPLES) | (F.col("n") <= F.col("_t") * config.RARE_CLASS_SHARE)
    )
    return counts.join(totals, list(by)).select(
        *by,
        "class_name",
        "n",
        F.round(F.col("n") / F.col("_t"), 4).alias("proportion"),
        (several & (F.col("n") * 2 >= F.col("_max"))).alias("is_majority"),
        minority.alias("is_minority"),
        F.when(minority, F.greatest(F.col("n") * 3, F.lit(config.MIN_CLASS_SAMPLES * 2))).alias("target"),
    )


def long_tail(counts: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Share of the annotations in the largest third of the classes.

    Classes of equal count are folded together first: a set of N rows has at most about
    sqrt(2 N) different counts, which bounds the window.
    """
    folded = counts.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("m"))
    totals = counts.groupBy(*by).agg(
        F.sum("n").alias("total"), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 3)).alias("k")
    )
    larger = W.partitionBy(*(list(by) or [F.lit(0)])).orderBy(F.desc("n")).rowsBetween(W.unboundedPreceding, -1)
    placed = folded.withColumn("_seen", F.coalesce(F.sum("m").over(larger), F.lit(0)))
    taken = F.greatest(F.lit(0), F.least(F.col("m"), F.col("k") - F.col("_seen")))
    return (
        placed.join(totals, list(by))
        .groupBy(*by)
        .agg(F.first("k").alias("top_classes"), F.round(F.sum(F.col("n") * taken) / F.first("total"), 6).alias("long_tail_ratio"))
    )


def coverage(images: DataFrame, annotations: DataFrame, ontology: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Ontology, image, scene and object coverage, and their weighted completeness."""
    known = ontology.select(F.col("value").alias("class_name"), F.lit(1).alias("_known"))
    expected = ontology.agg(F.count(F.lit(1)).alias("c")).scalar()
    classes = (
        class_counts(annotations, by)
        .join(known, "class_name", "left")
        .groupBy(*by)
        .agg(F.sum("n").alias("annotations"), F.count(F.lit(1)).alias("classes"), F.count("_known").alias("covered"))
    )
    annotated = annotations.groupBy(*by, "image_id").agg(F.lit(1)).groupBy(*by).agg(F.count(F.lit(1)).alias("annotated"))
    scene = F.split_part(text.base_name(F.col("file_path")), F.lit("_"), F.lit(1))
    scenes = (
        images.groupBy(*by, scene.alias("scene"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*by)
        .agg(F.sum("n").alias("images"), F.count(F.lit(1)).alias("scenes"))
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    joined = scenes.join(classes, list(by), "left").join(annotated, list(by), "left")
    measured = joined.select(
        *by,
        zero("covered").alias("covered_classes"),
        (zero("covered") / F.nullif(expected, F.lit(0)) * 100).alias("ontology_percent"),
        (zero("annotated") / F.col("images") * 100).alias("image_percent"),
        F.least(F.lit(1.0), F.col("scenes") / F.col("images")).alias("scene_diversity"),
        F.least(F.lit(1.0), F.coalesce(zero("annotations") / F.nullif(zero("classes"), F.lit(0)) / 100, F.lit(0.0))).alias(
            "object_diversity"
        ),
    )
    completeness = (
        F.col("ontology_percent") * 0.4
        + F.col("image_percent") * 0.3
        + F.col("scene_diversity") * 15
        + F.col("object_diversity") * 15
    )
    names = ("ontology_percent", "image_percent", "scene_diversity", "object_diversity")
    return measured.select(
        *by, "covered_classes", *[F.round(n, 6).alias(n) for n in names], F.round(completeness, 6).alias("completeness_percent")
    )


def class_profile(annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Count, images and average box per class; images are counted in two steps, so a
    frequent class is spread over many tasks."""
    per_image = with_class(annotations).groupBy(*by, "class_name", "image_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("width").alias("w"), F.sum("height").alias("h")
    )
    return per_image.groupBy(*by, "class_name").agg(
        F.sum("n").alias("annotations"),
        F.count(F.lit(1)).alias("images"),
        F.round(F.sum("w") / F.sum("n"), 6).alias("avg_width"),
        F.round(F.sum("h") / F.sum("n"), 6).alias("avg_height"),
    )


def image_profile(images: DataFrame, by: Sequence[str] = BY, supported: Sequence[str] = config.STANDARD_FORMATS) -> DataFrame:
    """Sizes, resolution levels, bytes, empty files and unsupported extensions."""
    level = bins.resolution_level(F.col("width"), F.col("height"))
    ext = F.regexp_replace(text.extension(F.col("file_path")), r"^\.", "")
    size = F.coalesce("file_size_bytes", F.lit(0))
    return images.groupBy(*by).agg(
        F.count(F.lit(1)).alias("images"),
        F.round(F.avg("width"), 6).alias("avg_width"),
        F.round(F.avg("height"), 6).alias("avg_height"),
        *[count_if(level == k).alias(f"{k}_resolution") for k in ("high", "medium", "low")],
        F.round(F.sum(size) / (1024 * 1024), 6).alias("size_mb"),
        count_if(size == 0).alias("corrupt"),
        count_if(~ext.isin(*supported)).alias("unsupported_files"),
    )


def compare_profiles(annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """Each class with the number of data sets that have it; common when all do."""
    counts = class_counts(annotations, by)
    sets = counts.select(*by).distinct().agg(F.count(F.lit(1)).alias("c")).scalar()
    return counts.groupBy("class_name").agg(
        F.count(F.lit(1)).alias("datasets"),
        F.sum("n").alias("annotations"),
        (F.count(F.lit(1)) == sets).alias("is_common"),
    )


def provenance_rollup(annotations: DataFrame, by: Sequence[str] = BY) -> DataFrame:
    """What each source contributed to a merged set."""
    return with_class(annotations).groupBy(*by, F.col("label").alias("original_class"), F.col("class_name")).agg(
        F.count(F.lit(1)).alias("annotations")
    )


def stage_summary(runs: DataFrame) -> DataFrame:
    """Completed, failed and skipped stages and the time per run."""
    state = F.col("status")
    return runs.groupBy("run_id").agg(
        count_if(state == "completed").alias("completed"),
        count_if(state == "failed").alias("failed"),
        count_if(state == "skipped").alias("skipped"),
        F.round(F.sum("seconds"), 4).alias("seconds"),
        (count_if(state == "failed") == 0).alias("succeeded"),
    )
