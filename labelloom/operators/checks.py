"""Row and data set checks. Row checks give one issue per violated rule; data set checks
give one row per data set.

Issue columns: dataset, rule, severity, category, location, message.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import config
from labelloom.functions import confidence, text
from labelloom.operators import dedup
from labelloom.operators.joins import with_image
from labelloom.operators.skew import join_group_summary, top_k
from labelloom.operators.stats import class_counts, count_if

ERROR, WARNING, INFO = "error", "warning", "info"
ISSUE = ("dataset", "rule", "severity", "category", "location", "message")


def issue(check: str, severity: str, condition: Column, message: Column) -> Column:
    """The issue as a struct where the condition holds, else null."""
    entry = F.struct(F.lit(check).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))
    return F.when(F.coalesce(condition, F.lit(False)), entry)


def issues_of(rows: DataFrame, category: str, location: Column, rules: Sequence[Column]) -> DataFrame:
    """All issues of all rows in one pass."""
    return rows.select(
        "dataset", location.cast("string").alias("location"), F.inline(F.array_compact(F.array(*rules)))
    ).select("dataset", "rule", "severity", F.lit(category).alias("category"), "location", "message")


def _said(*parts: object) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


# Images ---------------------------------------------------------------------------


def _image_flags() -> dict[str, Column]:
    w, h = F.col("width"), F.col("height")
    return {
        "tiny": (w < config.MIN_IMAGE_SIDE) | (h < config.MIN_IMAGE_SIDE),
        "oversized": (w > config.MAX_IMAGE_SIDE) | (h > config.MAX_IMAGE_SIDE),
        "wrong_format": ~F.lower("format").isin(*config.STANDARD_FORMATS),
        "wrong_color_space": ~F.lower("color_space").isin(*config.STANDARD_COLOR_SPACES),
    }


def image_issues(images: DataFrame) -> DataFrame:
    """Too small, too large, unusual format or colour space. Unknown values pass."""
    said = {
        "tiny": _said(F.col("width"), "x", F.col("height"), " is too small"),
        "oversized": _said(F.col("width"), "x", F.col("height"), " is very large"),
        "wrong_format": _said("format ", F.col("format")),
        "wrong_color_space": _said("color space ", F.col("color_space")),
    }
    both = F.col("width").isNotNull() & F.col("height").isNotNull()
    rules = [
        issue(k, WARNING, flag & both if k in ("tiny", "oversized") else flag, said[k]) for k, flag in _image_flags().items()
    ]
    return issues_of(images, "image", F.col("id"), rules)


def image_counts(images: DataFrame) -> DataFrame:
    flags = _image_flags()
    empty = F.coalesce("file_size_bytes", F.lit(1)) == 0
    return images.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("images"), count_if(empty).alias("corrupt"), *[count_if(c).alias(k) for k, c in flags.items()]
    )


# Annotations ----------------------------------------------------------------------


def _annotation_flags() -> dict[str, Column]:
    x, y, w, h, kind = (F.col(c) for c in ("x", "y", "width", "height", "geometry_type"))
    outside = (x + w > F.col("image_width")) | (y + h > F.col("image_height"))
    return {
        "negative_coordinates": (x < 0) | (y < 0),
        "zero_area": (w <= 0) | (h <= 0),
        "out_of_bounds": outside,
        "invalid_polygon": (kind == "polygon") & (w < 1) & (h < 1),
        "broken_obb": (kind == "obb") & ((w <= 0) | (h <= 0)),
    }


def annotation_issues(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Bad coordinates and extents, boxes beyond their image, images without annotations."""
    errors = ("negative_coordinates", "zero_area")
    box = _said(F.col("x"), ",", F.col("y"), " ", F.col("width"), "x", F.col("height"))
    flags = _annotation_flags()
    outside = flags.pop("out_of_bounds")
    on_rows = issues_of(annotations, "annotation", F.col("id"), [issue(k, ERROR if k in errors else WARNING, c, box) for k, c in flags.items()])
    # One rule needs the image; only what it reads meets the images, and its constant
    # severity lets readers of errors skip the join.
    slim = annotations.select("dataset", "id", "image_id", "x", "y", "width", "height")
    beyond = with_image(slim, images).where(outside).select(
        "dataset", F.lit("out_of_bounds").alias("rule"), F.lit(WARNING).alias("severity"),
        F.lit("annotation").alias("category"), F.col("id").cast("string").alias("location"), box.alias("message"),
    )
    bare = images.join(annotations.select(F.col("image_id").alias("id")), "id", "left_anti").select(
        "dataset", F.lit("missing_annotations").alias("rule"), F.lit(WARNING).alias("severity"),
        F.lit("annotation").alias("category"), F.col("id").cast("string").alias("location"), F.lit("image has no annotations").alias("message"),
    )
    return on_rows.unionByName(beyond).unionByName(bare)


def annotation_counts(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotation, geometry and reference counters per data set.

    One join by image serves all of them: its rows are folded per image, where the
    partitioning still fits, and then per data set. ``annotated`` counts images that have
    annotations, ``broken_references`` image ids that do not exist.
    """
    kind = F.col("geometry_type")
    flat = (F.col("width") <= 0) | (F.col("height") <= 0)
    flags = {
        **_annotation_flags(),
        "bad_bbox": (kind == "bbox") & flat,
        "bad_polygon": (kind == "polygon") & flat,
        "bad_segmentation": (kind == "segmentation") & flat,
        "bad_rotated": (kind == "obb") & flat,
    }
    known = images.groupBy(F.col("id").alias("image_id")).agg(
        F.first("width").alias("image_width"), F.first("height").alias("image_height"), F.count(F.lit(1)).alias("_copies")
    )
    # The columns the counters need, before the shuffle.
    slim = annotations.select("dataset", "image_id", "x", "y", "width", "height", "geometry_type")
    per_image = (
        slim.join(known, "image_id", "left")
        .groupBy("dataset", "image_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.first("_copies").alias("_copies"), *[count_if(c).alias(k) for k, c in flags.items()])
    )
    lost = F.col("_copies").isNull()
    return per_image.groupBy("dataset").agg(
        F.sum("_n").alias("annotations"),
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("annotated"),
        F.sum(F.when(lost, F.col("_n")).otherwise(0)).alias("orphans"),
        F.count_if(lost).alias("broken_references"),
        *[F.sum(k).alias(k) for k in flags],
    )


def geometry_issues(annotations: DataFrame) -> DataFrame:
    kind = F.col("geometry_type")
    flat = (F.col("width") <= 0) | (F.col("height") <= 0)
    size = _said(F.col("width"), "x", F.col("height"))
    rules = [
        issue("invalid_bbox", ERROR, (kind == "bbox") & flat, size),
        issue("invalid_polygon", WARNING, (kind == "polygon") & flat, size),
        issue("invalid_segmentation", WARNING, (kind == "segmentation") & flat, size),
        issue("invalid_rotated_box", WARNING, (kind == "obb") & flat, size),
        issue("negative_pixel", WARNING, (F.col("x") < 0) | (F.col("y") < 0), _said(F.col("x"), ",", F.col("y"))),
    ]
    return issues_of(annotations, "geometry", F.col("id"), rules)


def geometry_summary(annotations: DataFrame) -> DataFrame:
    found = geometry_issues(annotations)
    totals = annotations.groupBy("dataset", "geometry_type").agg(F.count(F.lit(1)).alias("n"))
    return totals.groupBy("dataset").agg(F.sum("n").alias("geometries")).join(
        found.groupBy("dataset").agg(
            *[
                count_if(F.col("rule") == k).alias(k)
                for k in ("invalid_bbox", "invalid_polygon", "invalid_segmentation", "invalid_rotated_box", "negative_pixel")
            ],
            (count_if(F.col("severity") == ERROR) == 0).alias("passed"),
        ),
        "dataset",
        "left",
    ).na.fill(0).na.fill(True)


# Imports --------------------------------------------------------------------------


def import_validation(images: DataFrame, annotations: DataFrame, files: DataFrame, classes: DataFrame) -> DataFrame:
    """Counters of the import check. Boxes are normalised corners x1, y1, x2, y2; files
    lists existing paths; an image without file is not checked further."""
    present = files.select(F.col("path").alias("file_path"), F.lit(True).alias("_there")).distinct()
    listed = images.join(present, "file_path", "left").withColumn("_there", F.coalesce("_there", F.lit(False)))
    ext = F.regexp_replace(text.extension(F.col("file_path")), r"^\.", "")
    there = F.col("_there")
    bad_size = F.coalesce((F.col("width") <= 0) | (F.col("height") <= 0), F.lit(True))
    per_image = listed.groupBy("dataset", "id").agg(
        F.count(F.lit(1)).alias("rows"),
        count_if(there).alias("there"),
        count_if(there & bad_size).alias("bad_size"),
        count_if(there & ~ext.isin(*config.VALID_IMAGE_EXTENSIONS)).alias("bad_ext"),
    )
    labelled = annotations.groupBy(F.col("image_id").alias("id")).agg(F.lit(1).alias("_has"))
    image_side = per_image.join(labelled, "id", "left").groupBy("dataset").agg(
        F.sum("rows").alias("images"),
        F.sum(F.col("rows") - F.col("there")).alias("missing_images"),
        F.sum(F.greatest(F.col("there") - 1, F.lit(0))).alias("duplicate_ids"),
        F.sum("bad_size").alias("invalid_dimensions"),
        F.sum("bad_ext").alias("unsupported_extensions"),
        F.sum(F.when(F.col("_has").isNull(), F.col("there")).otherwise(0)).alias("empty_annotations"),
    )
    known = classes.select(F.col("class_name").alias("label"), F.lit(True).alias("_known")).distinct()
    checked = annotations.join(
        listed.where("_there").select(F.col("id").alias("image_id"), F.lit(1).alias("_i")).distinct(), "image_id"
    ).join(known, "label", "left")
    corners = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    negative = corners[0] < 0
    for c in corners[1:]:
        negative = negative | (c < 0)
    inverted = (corners[0] > corners[2]) | (corners[1] > corners[3])
    beyond = (corners[2] > 1) | (corners[3] > 1)
    label_side = checked.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("annotations"),
        count_if(F.col("_known").isNull()).alias("class_mismatches"),
        count_if(negative).alias("negative_boxes"),
        count_if(~negative & (inverted | beyond)).alias("invalid_boxes"),
    )
    zero = {c: 0 for c in ("annotations", "class_mismatches", "negative_boxes", "invalid_boxes")}
    has_classes = classes.select("class_name").distinct().agg(F.count(F.lit(1)) > 0).scalar()
    joined = image_side.join(label_side, "dataset", "left").na.fill(zero)
    total = F.col("images") + 2 * (F.col("images") - F.col("missing_images")) + 2 * F.col("annotations") + 2
    failed = (
        F.col("missing_images") + F.col("duplicate_ids") + F.col("invalid_dimensions") + F.col("class_mismatches")
        + F.col("negative_boxes") + F.col("invalid_boxes") + F.when(has_classes, 0).otherwise(1)
    )
    return joined.withColumn("total_checks", total).withColumn("failed_checks", failed).withColumn("passed", F.col("failed_checks") == 0)


def _id_counts(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows, blank paths, flat boxes and repeated ids, counted in two steps."""
    ids = images.groupBy("dataset", "id").agg(
        F.count(F.lit(1)).alias("n"), count_if(text.blank_to_null(F.col("file_path")).isNull()).alias("no_path")
    )
    image_side = ids.groupBy("dataset").agg(
        F.sum("n").alias("images"), F.sum("no_path").alias("without_path"), F.sum(F.col("n") - 1).alias("duplicate_image_ids")
    )
    ann_ids = annotations.groupBy("dataset", "id").agg(
        F.count(F.lit(1)).alias("n"), count_if((F.col("width") <= 0) | (F.col("height") <= 0)).alias("flat")
    )
    label_side = ann_ids.groupBy("dataset").agg(
        F.sum("n").alias("annotations"), F.sum("flat").alias("invalid_geometry"), F.sum(F.col("n") - 1).alias("duplicate_annotation_ids")
    )
    return image_side.join(label_side, "dataset", "left").na.fill(0)


def conversion_validation(images: DataFrame, annotations: DataFrame, ontology: DataFrame) -> DataFrame:
    """Checks of a converted set. Label and split checks always pass; unknown labels warn."""
    orphans = (
        annotations.select("dataset", "image_id").distinct()
        .join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti")
        .groupBy("dataset").agg(F.count(F.lit(1)).alias("orphan_images"))
    )
    unknown = (
        class_counts(annotations).join(ontology.select(F.col("value").alias("class_name")), "class_name", "left_anti")
        .groupBy("dataset").agg(F.count(F.lit(1)).alias("unknown_labels"))
    )
    joined = _id_counts(images, annotations).join(orphans, "dataset", "left").join(unknown, "dataset", "left").na.fill(0)
    flags = {
        "has_images": F.col("images") > 0,
        "paths": F.col("without_path") == 0,
        "has_annotations": F.col("annotations") > 0,
        "geometry": F.col("invalid_geometry") == 0,
        "image_ids": F.col("duplicate_image_ids") == 0,
        "annotation_ids": F.col("duplicate_annotation_ids") == 0,
        "references": F.col("orphan_images") == 0,
    }
    good = sum((c.cast("int") for c in flags.values()), F.lit(0))
    # Two presence checks are also in the list of named checks, so they fail twice.
    twice = (~flags["has_images"]).cast("int") + (~flags["has_annotations"]).cast("int")
    return joined.select(
        "*", (good + 3).alias("passed_checks"), (F.lit(len(flags)) - good + twice).alias("failed_checks"), (good == len(flags)).alias("valid")
    )


def sanity(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Presence, id uniqueness and references per data set."""
    broken = (
        annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti")
        .groupBy("dataset").agg(F.count(F.lit(1)).alias("broken_references"))
    )
    return _id_counts(images, annotations).join(broken, "dataset", "left").na.fill(0, ["broken_references"]).select(
        "dataset", "images", "annotations",
        (F.col("images") > 0).alias("has_images"),
        (F.col("annotations") > 0).alias("has_annotations"),
        (F.col("duplicate_image_ids") > 0).alias("repeats_image_ids"),
        (F.col("duplicate_annotation_ids") > 0).alias("repeats_annotation_ids"),
        "broken_references",
        (F.col("broken_references") == 0).alias("references_valid"),
    )


# Files ----------------------------------------------------------------------------


def managed_file_issues(files: DataFrame) -> DataFrame:
    """Checks over a listing (dataset, path, content): labels without image, empty labels,
    byte copies, empty images, unsupported extensions."""
    ext = text.extension(F.col("path"))
    kinds = files.select(
        "dataset", "path", "content", text.stem(F.col("path")).alias("stem"),
        F.when(ext.isin(*config.MANAGED_IMAGE_EXTENSIONS), "image")
        .when(ext.isin(*config.MANAGED_LABEL_EXTENSIONS), "label")
        .otherwise("other").alias("kind"),
    )
    pictures, labels = kinds.where("kind = 'image'"), kinds.where("kind = 'label'")
    copied = dedup.copies(
        kinds.where("kind <> 'other'").select("dataset", "kind", "path", F.md5("content").alias("hash")),
        ["dataset", "kind", "hash"], "path", ["path"],
    )
    found = [
        labels.join(pictures.select("dataset", "stem"), ["dataset", "stem"], "left_anti").select("dataset", F.lit("missing_labels").alias("rule"), "path"),
        labels.where(F.trim(F.regexp_replace("content", r"\s+", " ")) == "").select("dataset", F.lit("empty_annotations").alias("rule"), "path"),
        copied.select("dataset", F.when(F.col("kind") == "image", "duplicate_images").otherwise("duplicate_annotations").alias("rule"), "path"),
        pictures.where(F.length("content") == 0).select("dataset", F.lit("corrupted_files").alias("rule"), "path"),
        kinds.where("kind = 'other'").select("dataset", F.lit("unsupported_extensions").alias("rule"), "path"),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def file_errors(images: DataFrame, files: DataFrame) -> DataFrame:
    """Path missing, file missing, image beyond the size limit, unknown extension. The
    first two end the checks of an image."""
    present = files.select(F.col("path").alias("file_path"), F.lit(True).alias("_there")).distinct()
    ext = F.regexp_replace(text.extension(F.col("file_path")), r"^\.", "")
    no_path = text.blank_to_null(F.col("file_path")).isNull()
    absent = F.col("_there").isNull()
    go_on = ~no_path & ~absent
    rules = [
        issue("no_path", ERROR, no_path, F.lit("no file path")),
        issue("not_found", ERROR, ~no_path & absent, _said("no file ", F.col("file_path"))),
        issue("too_wide", ERROR, go_on & (F.col("width") > config.MAX_IMAGE_SIDE), _said("width ", F.col("width"))),
        issue("too_high", ERROR, go_on & (F.col("height") > config.MAX_IMAGE_SIDE), _said("height ", F.col("height"))),
        issue("unsupported_format", ERROR, go_on & (ext != "") & ~ext.isin(*config.VALID_IMAGE_EXTENSIONS), _said("format ", ext)),
    ]
    return issues_of(images.join(present, "file_path", "left"), "image", F.col("id"), rules)


def verify_checksums(manifest: DataFrame, actual: DataFrame) -> DataFrame:
    """Paths of a manifest (path, expected) with whether the file has that hash."""
    return manifest.join(actual, "path", "left").select(
        "path", F.col("actual").isNull().alias("is_missing"), F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)).alias("matches")
    )


def file_integrity(images: DataFrame, files: DataFrame) -> DataFrame:
    """Missing files and hash mismatches per data set. ``images.sha256`` is the expected
    hash; blank is not compared."""
    listed = (
        images.select("dataset", "id", F.col("file_path").alias("path"), "sha256")
        .join(files.groupBy("path").agg(F.max("actual").alias("actual"), F.min("actual").alias("_low")), "path", "left")
    )
    expected = text.blank_to_null(F.col("sha256"))
    matches = (F.col("actual") == expected) | (F.col("_low") == expected)
    return listed.groupBy("dataset").agg(
        count_if(F.col("actual").isNull()).alias("missing_files"), count_if(~matches).alias("checksum_mismatches")
    )


def integrity_flags(counts: DataFrame, ontology_version: str, pipeline_version: str) -> DataFrame:
    """Number of the five integrity flags that hold, and whether all errors are absent, from
    missing_files, checksum_mismatches and broken_references."""
    versions = bool(ontology_version and pipeline_version)
    flags = [F.col("checksum_mismatches") == 0, F.lit(True), F.col("missing_files") == 0, F.col("broken_references") == 0, F.lit(versions)]
    return counts.select(
        "*",
        sum((f.cast("int") for f in flags), F.lit(0)).alias("integrity_flags"),
        (flags[0] & flags[2] & flags[3]).alias("integrity_passed"),
    )


def integrity(images: DataFrame, annotations: DataFrame, files: DataFrame, ontology_version: str, pipeline_version: str) -> DataFrame:
    """File, checksum and reference integrity per data set."""
    broken = (
        annotations.select("dataset", "image_id").distinct()
        .join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti")
        .groupBy("dataset").agg(F.count(F.lit(1)).alias("broken_references"))
    )
    joined = file_integrity(images, files).join(broken, "dataset", "left").na.fill(0)
    return integrity_flags(joined, ontology_version, pipeline_version)


def consistency(
    images: DataFrame, annotations: DataFrame, ontology_version: str, pipeline_version: str, split: str | None = None
) -> DataFrame:
    """Five consistency flags per data set.

    Label sets are compared with those of the first annotated image by joining label
    rows, so no label set is ever held in one row.
    """
    versions = images.groupBy("dataset", "pipeline_version").agg(F.lit(1)).groupBy("dataset").agg(F.count(F.lit(1)).alias("versions"))
    labels = annotations.groupBy("dataset", "image_id", "label").agg(F.count(F.lit(1)).alias("n"))
    first = annotations.groupBy("dataset").agg(F.min("image_id").alias("image_id"))
    reference = (
        annotations.join(first, ["dataset", "image_id"], "left_semi").select("dataset", "label").distinct().withColumn("_ref", F.lit(1))
    )
    sizes = reference.groupBy("dataset").agg(F.count(F.lit(1)).alias("_ref_size"))
    per_image = labels.join(reference, ["dataset", "label"], "left").groupBy("dataset", "image_id").agg(
        F.count(F.lit(1)).alias("own"), F.count("_ref").alias("common"), F.sum("n").alias("n")
    )
    far = F.col("common") * 2 < F.least("own", "_ref_size")
    overlap = per_image.join(sizes, "dataset").groupBy("dataset").agg(
        F.sum("n").alias("annotations"), count_if(far).alias("distant_images")
    )
    joined = versions.join(overlap, "dataset", "left").na.fill(0)
    if split is None:
        joined = joined.withColumn("other_split", F.lit(0).cast("long"))
    else:
        off = annotations.groupBy("dataset").agg(count_if(F.col("split") != split).alias("other_split"))
        joined = joined.join(off, "dataset", "left").na.fill(0)
    has_versions = bool(ontology_version and pipeline_version)
    flags = [
        F.col("versions") <= 1, F.col("other_split") == 0, F.col("annotations") > 0, F.col("distant_images") == 0, F.lit(has_versions),
    ]
    return joined.select(
        "dataset", "versions", "other_split", "distant_images",
        sum((f.cast("int") for f in flags), F.lit(0)).alias("consistency_flags"),
        (flags[2] & flags[4]).alias("consistency_passed"),
    )


# Documents ------------------------------------------------------------------------


def long_fields(docs: DataFrame, id_col: str, type_col: Column, fields: Sequence[str]) -> DataFrame:
    """One row per document and field, as text."""
    entries = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    return docs.select(F.col(id_col).alias("doc_id"), type_col.alias("doc_type"), F.inline(entries))


def missing_fields(fields: DataFrame, required: DataFrame) -> DataFrame:
    """Required (doc_type, field) pairs that a document leaves out or blank."""
    docs = fields.select("doc_id", "doc_type").distinct()
    given = fields.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "").select("doc_id", "field")
    return docs.join(required, "doc_type").select("doc_id", "doc_type", "field").join(given, ["doc_id", "field"], "left_anti")


def field_types(rows: DataFrame, id_col: str, json_col: str, expected: Mapping[str, str]) -> DataFrame:
    """Fields of a JSON column whose type is not the expected str, int, float or list."""
    parsed = rows.select(id_col, F.try_parse_json(json_col).alias("_v"))

    def entry(field: str, want: str) -> Column:
        found = F.schema_of_variant(F.try_variant_get("_v", f"$.{field}", "variant"))
        kind = (
            F.when(found.isNull() | (found == "VOID"), None)
            .when(found == "STRING", "str")
            .when(found == "BIGINT", "int")
            .when(found.rlike("^(DOUBLE|FLOAT|DECIMAL)"), "float")
            .when(found.startswith("ARRAY"), "list")
            .when(found == "BOOLEAN", "bool")
            .otherwise("dict")
        )
        return F.struct(F.lit(field).alias("field"), F.lit(want).alias("expected"), kind.alias("found"))

    out = parsed.select(id_col, F.inline(F.array(*[entry(f, t) for f, t in expected.items()])))
    number = (F.col("expected") == "float") & F.col("found").isin("int", "float")
    return out.where(F.col("found").isNotNull() & ~number & (F.col("found") != F.col("expected")))


def repeated_documents(docs: DataFrame, id_col: str, name: str, category: str, order: Sequence[str]) -> DataFrame:
    """Later rows that repeat an id (error) or a filled (name, category) pair (warning)."""
    slim = docs.select(F.col(id_col).alias("document_id"), F.col(name).alias("name"), F.col(category).alias("category"), *order)
    ids = dedup.copies(slim.select("document_id", *[F.col(o).alias(f"_o_{o}") for o in order]), ["document_id"], "document_id", [f"_o_{o}" for o in order])
    # Long names are compared by hash, so that only the hash is shuffled.
    named = slim.where("name <> '' AND category <> ''").select(
        F.sha2("name", 256).alias("_name"), "category", *[F.col(o).alias(f"_o_{o}") for o in order]
    )
    pairs = dedup.copies(named, ["_name", "category"], "category", [f"_o_{o}" for o in order])
    back = [F.col(f"_o_{o}").alias(o) for o in order]
    return ids.select(F.lit(ERROR).alias("severity"), F.lit("document_id").alias("rule"), *back).unionByName(
        pairs.select(F.lit(WARNING).alias("severity"), F.lit("name_category").alias("rule"), *back)
    )


def long_strings(fields: DataFrame, limit: int = config.MAX_STRING_LENGTH) -> DataFrame:
    return fields.where(F.length("value") > limit).select("doc_id", "field", F.length("value").alias("characters"))


def mixed_versions(docs: DataFrame, type_col: str, version: str) -> DataFrame:
    return (
        docs.groupBy(F.col(type_col).alias("doc_type"), version).agg(F.lit(1))
        .groupBy("doc_type").agg(F.count(F.lit(1)).alias("versions")).where("versions > 1")
    )


# Rules, ontology, configuration -----------------------------------------------------


def rule_issues(rules: DataFrame) -> DataFrame:
    """Blank fields, confidence outside 0..1, and repeated rule ids."""
    rid = F.col("rule_id").cast("string")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = issues_of(
        rules.withColumn("dataset", F.col("dataset_name")), "mapping", rid,
        [
            issue("empty_rule_id", ERROR, blank(rid), F.lit("empty rule id")),
            issue("empty_source_label", ERROR, blank(F.col("source_label")), F.lit("empty label")),
            issue("empty_canonical_value", ERROR, blank(F.col("canonical_value")), F.lit("empty value")),
            issue("confidence_range", ERROR, ~confidence.confidence_in_range(F.col("confidence")), F.lit("confidence out of range")),
        ],
    ).select("rule", "location")
    repeated = rules.groupBy(rid.alias("location")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = repeated.select(F.lit("duplicate_rule_id").alias("rule"), "location", F.explode(F.sequence(F.lit(2), F.col("n").cast("int"))).alias("_i"))
    return rows.unionByName(again.drop("_i"))


def mapping_issues(rules: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rules to unknown values, and rules whose value differs from the first rule of the
    same data set and label."""
    absent = rules.join(nodes.select(F.col("value").alias("canonical_value")), "canonical_value", "left_anti").select(
        F.lit("unknown_value").alias("rule"), "rule_id", F.col("canonical_value").alias("detail")
    )
    keyed = rules.select("rule_id", "dataset_name", F.lower("source_label").alias("label"), "canonical_value", "created_at")
    first = keyed.groupBy("dataset_name", "label").agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("created_at", "rule_id", "canonical_value")).alias("_first")
    )
    other = join_group_summary(keyed, first, ["dataset_name", "label"], "_n", ["rule_id"]).where(
        F.col("canonical_value") != F.col("_first.canonical_value")
    )
    return absent.unionByName(
        other.select(F.lit("two_values").alias("rule"), "rule_id", F.col("_first.canonical_value").alias("detail"))
    )


def ontology_issues(nodes: DataFrame) -> DataFrame:
    """Leaves without parent node, top categories not under root, repeated values."""
    known = nodes.select(F.col("value").alias("parent"), F.lit(1).alias("_p")).distinct()
    has_root = nodes.agg(F.max((F.col("value") == "root").cast("int"))).scalar()
    orphans = nodes.where("is_leaf AND parent IS NOT NULL").join(known, "parent", "left_anti").select(
        F.lit("missing_parent").alias("rule"), "value"
    )
    top = nodes.where("depth = 1 AND parent <> 'root'").select(F.lit("category_not_under_root").alias("rule"), "value")
    again = nodes.where("is_leaf").groupBy("value").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.lit("duplicate_value").alias("rule"), "value"
    )
    rootless = nodes.groupBy().agg(F.count(F.lit(1)).alias("n")).where(F.coalesce(has_root, F.lit(0)) == 0).select(
        F.lit("missing_root").alias("rule"), F.lit("root").alias("value")
    )
    return orphans.unionByName(top).unionByName(again).unionByName(rootless)


# What training settings may name.
OPTIMIZERS = ("adam", "adamw", "sgd", "rmsprop", "adamax")
SCHEDULERS = ("cosine", "step", "linear", "polynomial", "constant")
DEVICES = ("cpu", "cuda", "mps")


def config_issues(configs: DataFrame) -> DataFrame:
    """Range rules over a table of training settings, one row per setting record."""
    c = F.col
    small = (c("image_width") < 32) | (c("image_height") < 32)
    large = (c("image_width") > 10_000) | (c("image_height") > 10_000)
    rules = [
        issue("model_name", ERROR, F.coalesce(c("model_name"), F.lit("")) == "", F.lit("required")),
        issue("batch_size", ERROR, c("batch_size") < 1, F.lit("below 1")),
        issue("batch_size", WARNING, c("batch_size") > 512, F.lit("above 512")),
        issue("epochs", ERROR, c("epochs") < 1, F.lit("below 1")),
        issue("epochs", WARNING, c("epochs") > 1000, F.lit("above 1000")),
        issue("learning_rate", ERROR, c("learning_rate") <= 0, F.lit("not positive")),
        issue("learning_rate", WARNING, c("learning_rate") > 1, F.lit("above 1")),
        issue("optimizer", WARNING, ~c("optimizer").isin(*OPTIMIZERS), F.lit("not a standard one")),
        issue("scheduler", WARNING, ~c("scheduler").isin(*SCHEDULERS), F.lit("not a standard one")),
        issue("device", WARNING, ~c("device").isin(*DEVICES), F.lit("not recognized")),
        issue("validation_interval", ERROR, c("validation_interval") < 1, F.lit("below 1")),
        issue("save_interval", ERROR, c("save_interval") < 1, F.lit("below 1")),
        issue("image_size", ERROR, small, F.lit("below 32")),
        issue("image_size", WARNING, ~small & large, F.lit("above 10000")),
        issue("weight_decay", ERROR, c("weight_decay") < 0, F.lit("negative")),
        issue("seed", ERROR, c("seed") < 0, F.lit("negative")),
        issue("early_stopping_patience", WARNING, c("early_stopping_patience") < 1, F.lit("disables early stopping")),
    ]
    return issues_of(configs, "config", c("config_id"), rules)


def ready_datasets(reports: DataFrame, order: Sequence[str]) -> DataFrame:
    """Newest quality report per data set, and whether it lets the data set be used."""
    newest = F.max(F.struct(*order, "overall", "production_ready")).alias("_r")
    return reports.groupBy("dataset").agg(newest, F.count(F.lit(1)).alias("reports")).select(
        "dataset", "_r.overall", "_r.production_ready", "reports"
    )


def rollup(issues: DataFrame, errors: int = 3) -> DataFrame:
    """Issue counts by severity and the first errors, per data set."""
    counts = issues.groupBy("dataset").agg(
        *[count_if(F.col("severity") == s).alias(f"{s}s") for s in (ERROR, WARNING, INFO)]
    )
    # At most ``errors`` rows per data set reach the collected list.
    first = top_k(issues.where(F.col("severity") == ERROR), ["dataset"], ["rule", "location", "message"], errors)
    listed = first.groupBy("dataset").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "rule", "location"))), lambda s: F.concat(s["rule"], F.lit("@"), s["location"])),
            "; ",
        ).alias("first_errors")
    )
    return counts.join(listed, "dataset", "left").withColumn("first_errors", F.coalesce("first_errors", F.lit("")))
