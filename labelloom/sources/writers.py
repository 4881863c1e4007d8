"""Export formats: label lines, COCO, VOC, canonical tables, rules, manifests, reports.

Each format is first a DataFrame of what is written, so it can be checked or queried,
and then a ``write_*`` function that lets Spark write it in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text
from labelloom.functions.numbers import fixed6
from labelloom.operators.joins import with_image
from labelloom.operators.skew import bucketed_row_number, join_on
from labelloom.operators.stats import with_class
from labelloom.session import stored
from labelloom.sources import files


def class_ids(annotations: DataFrame) -> DataFrame:
    """(class_name, class_id): 0-based ids in name order.

    Only the distinct classes are ranked, in buckets of their first letters; the names are
    worked out once per distinct label.
    """
    labels = annotations.select("ontology_class", "label").distinct()
    classes = with_class(labels).select("class_name").distinct().withColumn("_bucket", F.substring("class_name", 1, 4))
    ranked = bucketed_row_number(classes, [], "_bucket", ["class_name"], "_rank")
    return ranked.select("class_name", (F.col("_rank") - 1).alias("class_id"))


def label_lines(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """One ``class cx cy w h`` line per annotation of a known image, scaled to the image
    where its size is known."""
    classes = class_ids(annotations)
    placed = with_image(with_class(annotations), images).where("has_image").join(classes, "class_name")

    def scaled(value: Column, side: str) -> Column:
        return F.when((F.col("image_width") > 0) & (F.col("image_height") > 0), value / F.nullif(F.col(side), F.lit(0))).otherwise(value)

    numbers = [
        scaled(F.col("x") + F.col("width") / 2, "image_width"),
        scaled(F.col("y") + F.col("height") / 2, "image_height"),
        scaled(F.col("width"), "image_width"),
        scaled(F.col("height"), "image_height"),
    ]
    return placed.withColumn("line", F.concat_ws(" ", F.col("class_id").cast("string"), *[fixed6(n) for n in numbers]))


def write_label_files(lines: DataFrame, path: str, split: str = "split") -> None:
    """``split=.../image_id=.../part-*.txt`` with the lines of one image each.

    Rows are spread by image before writing, so an image's lines come from one task
    and each task writes its own images.
    """
    lines.repartition(split, "image_id").sortWithinPartitions(split, "image_id", "line").select(split, "image_id", "line").write.mode(
        "overwrite"
    ).partitionBy(split, "image_id").text(path)


def label_paths(annotations: DataFrame, images: DataFrame, splits: DataFrame, layout: str = "{split}/labels/{stem}.txt") -> DataFrame:
    """``path, line, id`` for named label files: the label lines of every image that has a
    split, or one row without a line for an image without labels.

    A stem that several images of a split share gets the image's id as a suffix, so that no
    image writes into another's file. ``splits`` has ``id`` and ``split``.
    """
    named = images.join(splits.select("id", "split"), "id").select("id", "split", text.stem(F.col("file_path")).alias("_stem"))
    shared = named.groupBy("split", "_stem").agg(F.count(F.lit(1)).alias("_n"))
    placed = join_on(named, shared, ["split", "_stem"])
    stem = F.when(F.col("_n") > 1, F.concat_ws("-", "_stem", F.col("id").cast("string"))).otherwise(F.col("_stem"))
    before, between, after = (F.lit(part) for part in layout.replace("{stem}", "{split}").split("{split}"))
    paths = placed.select(F.col("id").alias("image_id"), F.concat(before, "split", between, stem, after).alias("path"))
    lines = label_lines(annotations, images).select("image_id", "id", "line")
    return paths.join(lines, "image_id", "left").select("path", "image_id", "id", "line")


def write_labels(lines: DataFrame, path: str, packed: bool = False) -> DataFrame:
    """The files of ``label_paths`` below ``path``; gives their manifest.

    The lines of a file stand in the order of annotation ids, then of the lines. With
    ``packed`` the files are in archives, and the manifest also has their ``lines``."""
    content = F.when(F.col("line").isNotNull(), F.concat("line", F.lit("\n")))
    rows = lines.withColumn("_content", content)
    if not packed:
        return files.write_named(rows, path, "path", "_content", ["id", "line"])
    files.write_packed(rows, path, "path", "_content", ["id", "line"])
    return files.packed_manifest(lines.sparkSession, path)


def write_yolo(annotations: DataFrame, images: DataFrame, splits: DataFrame, path: str, packed: bool = False) -> DataFrame:
    """A directory that trainers open: ``<split>/labels/<stem>.txt`` for every image,
    ``data.yaml`` and ``classes.txt``. Gives the manifest of the label files.

    With ``packed`` the label files are in archives that unpack to this directory."""
    manifest = write_labels(label_paths(annotations, images, splits), path, packed)
    _write_class_files(annotations, splits, path, "{split}/images")
    return manifest


def _write_class_files(annotations: DataFrame, splits: DataFrame, path: str, images_at: str) -> list[str]:
    """``data.yaml`` and ``classes.txt``; the class list is one document in these formats."""
    names = [r["class_name"] for r in class_ids(annotations).orderBy("class_id").toLocalIterator()]
    found = sorted(r["split"] for r in splits.select("split").distinct().collect())
    files.put_text(f"{path}/data.yaml", data_yaml(names, found, path, images_at))
    files.put_text(f"{path}/classes.txt", "".join(f"{name}\n" for name in names))
    return names


def data_yaml(class_names: Sequence[str], splits: Sequence[str], root: str, images_at: str = "{split}/images") -> str:
    """Text of the ``data.yaml`` beside the label files; names as a JSON list, which is YAML."""
    lines = [f"path: {root}", *[f"{s}: {images_at.format(split=s)}" for s in splits], f"nc: {len(class_names)}", f"names: {json.dumps(list(class_names), ensure_ascii=False)}"]
    return "\n".join(lines) + "\n"


def coco_images(images: DataFrame, bucket: Column) -> DataFrame:
    """Images numbered from 1 in id order; ``bucket`` must not decrease along the id."""
    numbered = bucketed_row_number(images.withColumn("_bucket", bucket), [], "_bucket", ["id"], "coco_id")
    return numbered.select(
        "id", "coco_id", F.regexp_extract("file_path", r"([^/]*)$", 1).alias("file_name"),
        F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"),
    )


def coco_annotations(annotations: DataFrame, numbered: DataFrame, order: Sequence[str], bucket: Column) -> DataFrame:
    """Annotations with numbers from 1, image and category numbers, box and area; an
    annotation without image points to image 0."""
    rows = with_class(annotations).join(class_ids(annotations), "class_name").withColumn("_bucket", bucket)
    counted = bucketed_row_number(rows, [], "_bucket", order, "coco_id")
    target = numbered.select(F.col("id").alias("image_id"), F.col("coco_id").alias("_image"))
    return counted.join(target, "image_id", "left").select(
        "coco_id",
        F.coalesce("_image", F.lit(0)).alias("coco_image_id"),
        (F.col("class_id") + 1).alias("category_id"),
        "x", "y", "width", "height",
        (F.col("width") * F.col("height")).alias("area"),
        F.lit(0).alias("iscrowd"),
    )


def coco_categories(annotations: DataFrame) -> DataFrame:
    return class_ids(annotations).select((F.col("class_id") + 1).alias("id"), F.col("class_name").alias("name"), F.lit("object").alias("supercategory"))


def coco_json(images: DataFrame, annotations: DataFrame, categories: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(section, line): each image, annotation and category as one JSON object."""
    pics = images.select(F.lit("images").alias("section"), F.to_json(F.struct(F.col("coco_id").alias("id"), "file_name", "width", "height")).alias("line"), *keep)
    boxes = annotations.select(
        F.lit("annotations"),
        F.to_json(F.struct(
            F.col("coco_id").alias("id"), F.col("coco_image_id").alias("image_id"), "category_id",
            F.array("x", "y", "width", "height").alias("bbox"), "area", "iscrowd",
        )),
        *keep,
    )
    return pics.union(boxes).union(categories.select(F.lit("categories"), F.to_json(F.struct("id", "name", "supercategory")), *keep))


def write_coco(sections: DataFrame, path: str) -> None:
    """JSON lines per section; a single JSON document would need one writer."""
    sections.write.mode("overwrite").partitionBy("section").text(path)


def write_coco_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> int:
    """One COCO document at ``path`` from the rows of ``coco_images``, ``coco_annotations``
    and ``coco_categories``, by as many writers as there are partitions. Gives its bytes.

    The lines are stored first, until the parts of the document are written: finding the
    ranges of the writers reads them once more."""
    numbered = lambda rows, key: rows.withColumn("_order", F.col(key).cast("long"))
    lines = coco_json(numbered(images, "coco_id"), numbered(annotations, "coco_id"), numbered(categories, "id"), keep=["_order"])
    kept = stored(lines, "coco-lines")
    return files.write_document(kept, path, ["images", "annotations", "categories"], ["_order"], None, kept)


def voc_documents(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """One document per image with integer corners, as the format wants it: the objects of
    an image, however many, are one row."""
    rows = with_class(annotations)
    corner = lambda c: c.cast("int")
    box = F.struct(
        corner(F.col("x")).alias("xmin"), corner(F.col("y")).alias("ymin"),
        corner(F.col("x") + F.col("width")).alias("xmax"), corner(F.col("y") + F.col("height")).alias("ymax"),
    )
    objects = rows.groupBy(F.col("image_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("class_name").alias("name"), box.alias("bndbox")))).alias("object")
    )
    size = F.struct(F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), F.lit(3).alias("depth"))
    return images.join(objects, "id", "left").select(
        F.lit("JPEGImages").alias("folder"), F.regexp_extract("file_path", r"([^/]*)$", 1).alias("filename"), size.alias("size"), "object"
    )


def write_voc(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").format("xml").option("rowTag", "annotation").option("rootTag", "annotations").save(path)


def canonical_categories(annotations: DataFrame) -> DataFrame:
    """Category ids by class name, with the display name of the class."""
    name = F.initcap(F.translate("class_name", "._-", "   "))
    return class_ids(annotations).select("class_id", "class_name", F.replace(name, F.lit(" "), F.lit("_")).alias("canonical_name"))


def canonical_info(images: DataFrame, annotations: DataFrame, versions: tuple[str, str] = ("1.0.0", "1.0.0")) -> DataFrame:
    """Info row per data set: counts and versions, also as JSON."""
    pics = images.groupBy("dataset").agg(F.count(F.lit(1)).alias("images"))
    labels = with_class(annotations).groupBy("dataset", "class_name").agg(F.count(F.lit(1)).alias("n"))
    labels = labels.groupBy("dataset").agg(F.sum("n").alias("annotations"), F.count(F.lit(1)).alias("classes"))
    rows = pics.join(labels, "dataset", "left").na.fill(0).select(
        "dataset", "images", "annotations", "classes",
        F.lit(versions[0]).alias("ontology_version"), F.lit(versions[1]).alias("pipeline_version"),
    )
    return rows.withColumn("info", F.to_json(F.struct(*rows.columns)))


def write_canonical(images: DataFrame, annotations: DataFrame, path: str) -> None:
    """Canonical tables as Parquet, annotations with their category id."""
    labels = with_class(annotations).join(class_ids(annotations), "class_name")
    images.write.mode("overwrite").partitionBy("dataset").parquet(f"{path}/images")
    labels.write.mode("overwrite").partitionBy("dataset").parquet(f"{path}/annotations")
    canonical_categories(annotations).write.mode("overwrite").parquet(f"{path}/categories")
    canonical_info(images, annotations).write.mode("overwrite").json(f"{path}/info")


def rule_rows(rules: DataFrame) -> DataFrame:
    """Rules as they are exported, and each also as JSON."""
    columns = ["rule_id", "dataset_name", "source_label", "canonical_value", "match_type", "confidence", "version"]
    return rules.select(*columns, F.to_json(F.struct(*columns)).alias("json"))


def write_rules(rules: DataFrame, path: str, fmt: str) -> None:
    """Rules as ``json`` or ``csv``."""
    columns = [c for c in rule_rows(rules).columns if c != "json"]
    if fmt not in ("json", "csv"):
        raise ValueError(f"unknown rule format {fmt}")
    writer = rules.select(*columns).write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)


def file_manifest(listing: DataFrame) -> DataFrame:
    """(path, size, sha256) of a binaryFile listing."""
    return listing.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def manifest_summary(listing: DataFrame, by: Sequence[str]) -> DataFrame:
    """Files, bytes and one checksum over the (path, checksum) pairs of each group.

    The pairs are hashed apart and added up, so their order does not matter and no task
    holds them all.
    """
    part = F.conv(F.substring(F.md5(F.concat_ws("|", "path", "sha256")), 1, 12), 16, 10).cast("decimal(38,0)")
    return listing.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sum(part).cast("string").alias("checksum")
    )


def report_markdown(scorecard: DataFrame, rollup: DataFrame) -> DataFrame:
    """Quality report per data set as Markdown and JSON."""
    names = ("image", "annotation", "geometry", "coverage", "balance", "integrity", "consistency")
    joined = scorecard.join(rollup, "dataset", "left").na.fill(0, ["errors", "warnings", "infos"])
    ready = F.when(F.col("production_ready"), "ready for production").otherwise("not ready for production")
    lines = [
        F.concat(F.lit("# "), "dataset"),
        F.concat(F.format_string("%.1f of 100, grade ", F.col("overall")), "grade", F.lit(", "), ready),
        F.lit(""),
        *[F.format_string(f"* {n}: %.1f", F.col(f"{n}_score")) for n in names],
        F.lit(""),
        F.format_string("Found: %d errors, %d warnings, %d notes", F.col("errors"), F.col("warnings"), F.col("infos")),
    ]
    return joined.select("dataset", "overall", "grade", "errors", "warnings", "infos", F.concat_ws("\n", *lines).alias("markdown"))


def metadata_record(totals: DataFrame, scores: DataFrame, checksums: DataFrame) -> DataFrame:
    """One record per data set: statistics, score and checksum, also nested as JSON."""
    rows = totals.join(scores, "dataset", "left").join(checksums, "dataset", "left")
    nested = F.struct(
        "dataset",
        F.struct(*[c for c in totals.columns if c != "dataset"]).alias("statistics"),
        F.struct(*[c for c in scores.columns if c != "dataset"]).alias("quality"),
        F.struct(*[c for c in checksums.columns if c != "dataset"]).alias("checksum"),
    )
    return rows.withColumn("record", F.to_json(nested))


def merged_labels(labels: DataFrame, images: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """Label texts (path, value) of a file-level export beside the image of the same stem
    and the same columns ``within``, such as the source; labels without an image are left
    out, images without labels keep an empty text."""
    text_of = labels.select(*within, text.stem(F.col("path")).alias("stem"), F.col("value").alias("labels"))
    pictures = images.select(*within, F.col("path").alias("image"), text.stem(F.col("path")).alias("stem"))
    return join_on(pictures, text_of, [*within, "stem"], "left").na.fill("", ["labels"])


def write_training_export(lines: DataFrame, annotations: DataFrame, path: str, dataset: str) -> DataFrame:
    """Label files per split, the class list, a manifest of all files with size and
    SHA-256, and an info record. ``lines`` has split, image_id and line."""
    spark = lines.sparkSession
    write_label_files(lines, f"{path}/labels")
    class_ids(annotations).orderBy("class_id").select("class_id", "class_name").write.mode("overwrite").json(f"{path}/classes")
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/labels")
    file_manifest(listing).write.mode("overwrite").json(f"{path}/manifest")
    info = lines.groupBy("split").agg(F.count(F.lit(1)).alias("annotations"), F.count_distinct("image_id").alias("images"))
    info.withColumn("dataset", F.lit(dataset)).write.mode("overwrite").json(f"{path}/dataset_info")
    return spark.read.json(f"{path}/manifest")


def write_training_package(annotations: DataFrame, images: DataFrame, splits: DataFrame, path: str, dataset: str, packed: bool = False) -> DataFrame:
    """A package that a trainer opens, and its manifest ``path, size, sha256``.

    ``labels/<split>/<stem>.txt`` for every image, ``data.yaml``, ``classes.txt``,
    ``export.json`` with classes and counts, ``dataset_info.json`` with images per split,
    and ``manifest.json`` over all files but itself. With ``packed`` the label files are in
    archives that unpack to this tree.
    """
    lines = label_paths(annotations, images, splits, "labels/{split}/{stem}.txt")
    manifest = write_labels(lines, path, packed)
    names = _write_class_files(annotations, splits, path, "images/{split}")
    split = F.split_part("path", F.lit("/"), F.lit(2))
    if packed:
        # The archives know the counts; the lines need not be made again.
        manifest = stored(manifest, "file-manifest")
        counts = manifest.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("images"), F.sum("lines").alias("annotations"))
        manifest = manifest.drop("lines")
    else:
        counts = lines.groupBy(split.alias("split")).agg(F.count_distinct("path").alias("images"), F.count("line").alias("annotations"))
    found = {r["split"]: r for r in counts.collect()}
    about = {"dataset_name": dataset, "class_count": len(names), "class_names": names}
    export = about | {f"{s}_count": r["images"] for s, r in sorted(found.items())} | {f"{s}_annotations": r["annotations"] for s, r in sorted(found.items())}
    export |= {"total_annotations": sum(r["annotations"] for r in found.values()), "status": "completed"}
    files.put_text(f"{path}/export.json", json.dumps(export, indent=2) + "\n")
    files.put_text(f"{path}/dataset_info.json", json.dumps(about | {"splits": {s: {"image_count": r["images"]} for s, r in sorted(found.items())}}, indent=2) + "\n")
    added = [files.describe(path, name) for name in ("classes.txt", "data.yaml", "dataset_info.json", "export.json")]
    manifest = manifest.union(lines.sparkSession.createDataFrame(added, files.MANIFEST))
    listed = manifest.select(F.lit("files").alias("section"), F.to_json(F.struct("path", F.col("size").alias("size_bytes"), "sha256")).alias("line"), "path")
    files.write_document(listed, f"{path}/manifest.json", ["files"], ["path"], {"manifest_version": "1.0"})
    return manifest


WRITERS = {
    "package": write_training_package,
    "yolo_package": write_yolo,
    "coco_document": write_coco_document,
    "training": write_training_export,
    "yolo": write_label_files,
    "coco": write_coco,
    "voc": write_voc,
    "canonical": write_canonical,
    "rules": write_rules,
}
