"""Formats and layouts of data set directories, from their file listings.

A listing has ``root`` and ``rel``, the path below the root. Many roots are judged at
once; each rule is a flag that is folded per root, so no listing is held in memory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions import text

# Directories that make up each known layout, in the order they are tried.
LAYOUT_DIRS = {
    "coco": ("train2017", "val2017", "annotations"),
    "open_images_v7": ("train", "validation", "test"),
    "visdrone": ("VisDrone2019-DET-train", "VisDrone2019-DET-val", "VisDrone2019-DET-test-dev"),
    "loveda": ("Train", "Val", "Test"),
    "spacenet": (),
    "seaships": ("train", "val"),
}
COCO_FILES = ("annotations/instances_train2017.json", "annotations/instances_val2017.json")
# File extension to conversion format.
EXTENSION_FORMAT = {
    ".json": "coco_json", ".xml": "pascal_voc", ".csv": "coco_json", ".yaml": "yolo_txt", ".yml": "yolo_txt", ".txt": "yolo_txt",
}


def list_files(spark: SparkSession, path: str, extensions: Sequence[str] = ()) -> DataFrame:
    """(path, rel, length) below a directory, sorted by path; only the given extensions,
    in either case, when there are any. File contents are not read.

    Spark's file sources leave out files of zero bytes; compare with a manifest to find
    those."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    )
    base = path.rstrip("/")
    rel = F.regexp_replace(F.substring_index(F.col("path"), base + "/", -1), "^/+", "")
    return with_extensions(files.withColumn("rel", rel), extensions)


def with_extensions(files: DataFrame, extensions: Sequence[str] = ()) -> DataFrame:
    """Rows of a listing whose ``path`` has one of the extensions, in either case, by path."""
    if extensions:
        files = files.where(text.extension(F.col("path")).isin(*[e.lower() for e in extensions]))
    return files.orderBy("path")


def _any(condition: Column) -> Column:
    return F.max(F.coalesce(condition, F.lit(False)))


def detect_format(listing: DataFrame) -> DataFrame:
    """yolo, coco, voc, geojson, csv or json per root, the first that fits; else null."""
    rel = F.col("rel")
    top = ~rel.contains("/")
    flags = listing.groupBy("root").agg(
        _any(rel == "data.yaml").alias("yaml"),
        _any(rel.startswith("images/")).alias("images"),
        _any(rel.startswith("labels/")).alias("labels"),
        _any(top & (rel.endswith("annotations.json") | (rel == "instances.json"))).alias("coco"),
        _any(rel.endswith(".xml")).alias("voc"),
        *[_any(top & rel.endswith(f".{e}")).alias(e) for e in ("geojson", "csv", "json")],
    )
    found = F.when(F.col("yaml") | (F.col("images") & F.col("labels")), "yolo")
    for name in ("coco", "voc", "geojson", "csv", "json"):
        found = found.when(F.col(name), name)
    return flags.select("root", found.alias("format"))


def detect_layout(listing: DataFrame) -> DataFrame:
    """Known corpus layout per root; null when none fits."""
    rel = F.col("rel")
    names = sorted({d for dirs in LAYOUT_DIRS.values() for d in dirs})
    flags = listing.groupBy("root").agg(
        *[_any(rel.startswith(f"{d}/")).alias(f"d{i}") for i, d in enumerate(names)],
        *[_any(rel == f).alias(f"f{i}") for i, f in enumerate(COCO_FILES)],
        _any(rel.rlike("^AOI_[^/]*/")).alias("aoi"),
    )
    found = None
    for layout, dirs in LAYOUT_DIRS.items():
        fits = F.col("aoi") if layout == "spacenet" else F.lit(True)
        for d in dirs:
            fits = fits & F.col(f"d{names.index(d)}")
        if layout == "coco":
            fits = fits & F.col("f0") & F.col("f1")
        found = F.when(fits, layout) if found is None else found.when(fits, layout)
    return flags.select("root", found.alias("layout"))


def conversion_format(layout: Column, path: Column) -> Column:
    """Conversion format from a known layout, else words in the name, else the extension."""
    name = F.lower(text.base_name(path))
    ext = text.extension(path)
    by_extension = F.lit(None).cast("string")
    for e, fmt in EXTENSION_FORMAT.items():
        by_extension = F.when(ext == e, fmt).otherwise(by_extension)
    return (
        F.when(layout.isin(*LAYOUT_DIRS), "coco_json")
        .when(name.contains("coco"), "coco_json")
        .when(name.contains("yolo") | name.contains("darknet"), "yolo_txt")
        .when(name.contains("voc") | name.contains("pascal"), "pascal_voc")
        .otherwise(F.coalesce(by_extension, F.lit("coco_json")))
    )
