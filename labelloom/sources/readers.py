"""Readers of annotation formats.

``parse_*`` turn columns of text into rows, ``read_*`` bring files into that form. Boxes
come out as normalised corners x1, y1, x2, y2 or as x, y, width, height as named.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import geometry, text
from labelloom.functions.geometry import Box
from labelloom.operators.skew import salted_join
from labelloom.session import sent_if_few
from labelloom.sources import files, jsonsplit

CORNERS = ("x1", "y1", "x2", "y2")

COCO_SCHEMA = (
    "images array<struct<id:string,file_name:string,width:int,height:int>>, "
    "annotations array<struct<id:string,image_id:string,category_id:string,bbox:array<double>,area:double,iscrowd:int,"
    "score:double,segmentation:string>>, categories array<struct<id:string,name:string,supercategory:string>>"
)
VOC_SCHEMA = (
    "folder string, filename string, size struct<width:int,height:int,depth:int>, "
    "object array<struct<name:string,bndbox:struct<xmin:double,ymin:double,xmax:double,ymax:double>>>"
)
JSON_IMAGES_SCHEMA = (
    "array<struct<filename:string,file_name:string,width:int,height:int,annotations:array<struct<"
    "`class`:string,class_name:string,bbox:array<double>,bbox_format:string>>>>"
)
GEOJSON_SCHEMA = (
    "features array<struct<properties:struct<image_filename:string,filename:string,`class`:string,class_name:string,label:string,"
    "bbox:array<double>,bbox_format:string,width:int,height:int>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"
)


def _number(c: Column) -> Column:
    return c.try_cast("double")


def _box_of(array: str) -> Box:
    return Box(*[F.coalesce(F.get(array, i), F.lit(0.0)) for i in range(4)])


# YOLO -----------------------------------------------------------------------------


def class_list(files: DataFrame) -> DataFrame:
    """(class_id, name) from whole class-list texts: blank lines do not count."""
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)), lambda s: s != "")
    return files.select(F.posexplode(lines).alias("class_id", "name"))


def _fields(lines: DataFrame, separator: str, least: int, keys: Sequence[str]) -> DataFrame:
    """``keys`` and the fields ``_p`` of lines that have at least ``least``.

    The generator keeps later filters from being pushed below the split, which would split
    the line again for every condition.
    """
    split = F.array(F.struct(F.split(F.trim("line"), separator).alias("_p")))
    return lines.select(*keys, F.inline(split)).where(F.size("_p") >= least)


def _parsed_once(texts: DataFrame, parsed: Column, keys: Sequence[str]) -> DataFrame:
    """``keys`` and the fields of the struct ``parsed``. The generator keeps later operators,
    each of which wants a field, from parsing the text again."""
    return texts.select(*keys, F.inline(F.array(parsed)))


def parse_yolo(lines: DataFrame, classes: DataFrame | None = None, unknown: str | None = None) -> DataFrame:
    """``class cx cy w h`` lines (stem, line). Short or unreadable lines are skipped.

    A class id beyond the list is named by itself, or ``unknown`` where that is given.
    """
    rows = _fields(lines, r"\s+", 5, ["stem"]).select("stem", F.get("_p", 0).try_cast("int").alias("class_id"), *[_number(F.get("_p", i + 1)).alias(f"_{i}") for i in range(4)])
    rows = rows.where("class_id IS NOT NULL AND _0 IS NOT NULL AND _1 IS NOT NULL AND _2 IS NOT NULL AND _3 IS NOT NULL")
    fallback = F.col("class_id").cast("string") if unknown is None else F.lit(unknown)
    if classes is None:
        named = rows.withColumn("name", F.lit(None).cast("string"))
    else:
        named = rows.join(classes, "class_id", "left")
    box = Box(*[F.col(f"_{i}") for i in range(4)])
    one = F.lit(1)
    corners = geometry.corners_from(box, F.lit("cxcywh_normalized"), one, one)
    return named.select("stem", "class_id", F.coalesce("name", fallback).alias("class_name"), *corners.named(CORNERS))


def yaml_classes(documents: DataFrame) -> DataFrame:
    """(class_id, name) from the ``names`` list of whole ``data.yaml`` texts, where it
    stands in one line, quoted in either way."""
    listed = F.regexp_extract("value", r"(?m)^names:[ \t]*(\[.*\])[ \t]*$", 1)
    return documents.select(F.posexplode(F.from_json(listed, "array<string>", {"allowSingleQuotes": "true"})).alias("class_id", "name"))


def read_yolo(spark: SparkSession, root: str, labels: str = "labels", classes: str | None = "classes.txt", unknown: str | None = None) -> DataFrame:
    """Label files below ``root/labels`` with the classes of ``root/classes.txt`` or of a
    ``data.yaml``."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(f"{root}/{labels}").select(
        text.stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("line")
    )
    names = None
    if classes is not None:
        text_of = spark.read.text(f"{root}/{classes}", wholetext=True)
        names = yaml_classes(text_of) if classes.endswith((".yaml", ".yml")) else class_list(text_of)
    return parse_yolo(lines, names, unknown)


def images_of_stems(stems: DataFrame, images: DataFrame) -> DataFrame:
    """Images found for label stems; ``images`` is a listing with ``path``. Of several
    extensions the first of jpg, jpeg, png, bmp, webp is taken."""
    order = F.array_position(F.array(*map(F.lit, (".jpg", ".jpeg", ".png", ".bmp", ".webp"))), text.extension(F.col("path")))
    known = images.withColumn("stem", text.stem(F.col("path"))).withColumn("_o", order).where("_o > 0")
    best = known.groupBy("stem").agg(F.min(F.struct("_o", "path")).alias("_b")).select("stem", F.col("_b.path").alias("path"))
    return stems.select("stem").distinct().join(best, "stem", "left")


# COCO -----------------------------------------------------------------------------


def coco_annotations(docs: DataFrame, keys: Sequence[str] = (), missing: str | None = None) -> DataFrame:
    """Annotations of COCO structs with image size and category name; see ``coco_rows``."""
    parts = [docs.select(*keys, F.inline(name)) for name in ("images", "annotations", "categories")]
    return coco_rows(*parts, keys, missing)


def coco_rows(images: DataFrame, annotations: DataFrame, categories: DataFrame, keys: Sequence[str] = (), missing: str | None = None) -> DataFrame:
    """Annotations with image size and category name, from the elements of the three lists.

    ``keys`` tell documents apart; ids are unique within one. A missing category is named
    by its id, or ``missing``. A filled segmentation makes the geometry a segmentation.
    """
    images = images.select(*keys, F.col("id").alias("image_id"), "file_name", F.col("width").alias("image_width"), F.col("height").alias("image_height"))
    names = categories.select(*keys, F.col("id").alias("category_id"), F.col("name").alias("_name"))
    boxes = annotations.withColumnRenamed("id", "annotation_id")
    return _coco_columns(boxes.join(images, [*keys, "image_id"], "left").join(names, [*keys, "category_id"], "left"), keys, missing)


def _coco_columns(rows: DataFrame, keys: Sequence[str], missing: str | None) -> DataFrame:
    """The columns of an annotation from it, its image's ``file_name, image_width,
    image_height`` and the ``_name`` of its category."""
    box = _box_of("bbox")
    outlined = ~F.coalesce(F.regexp_replace("segmentation", r"\s+", ""), F.lit("")).isin("", "[]", "{}", "null")
    fallback = F.col("category_id") if missing is None else F.lit(missing)
    corners = geometry.corners_from(box, F.lit("xywh_absolute"), F.col("image_width"), F.col("image_height"))
    return rows.select(
        *keys, "annotation_id", "image_id", "file_name", "image_width", "image_height", "category_id",
        F.coalesce("_name", fallback).alias("class_name"),
        F.when(outlined, "segmentation").otherwise("bbox").alias("geometry_type"),
        *box.named(("x", "y", "width", "height")), *corners.named(CORNERS), F.col("score").alias("confidence"),
    )


def _sorted_by_id(elements: str) -> Column:
    return F.array_sort(F.filter(elements, lambda e: e["id"].isNotNull()))


def _halvings(c: str) -> Column:
    """Powers of two, falling, that add up to at least the length of a list."""
    return F.when(F.size(c) > 0, F.expr(f"transform(reverse(sequence(0, cast(floor(log2(size({c}))) AS int))), k -> shiftleft(1, k))")).otherwise(F.array().cast("array<int>"))


def _find(elements: str, steps: str, key: Column) -> Column:
    """The first element of a list sorted by id that has the id ``key``, by halving."""
    listed = F.col(elements)

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= F.size(listed)) & (F.get(listed, at + step - 1)["id"] < key), at + step).otherwise(at)

    at = F.aggregate(steps, F.lit(0), further)
    return F.filter(F.array(F.get(listed, at)), lambda e: e["id"] == key)


def parse_coco(texts: DataFrame, column: str, keys: Sequence[str] = (), missing: str | None = None) -> DataFrame:
    """Annotations of one COCO document per row, as ``coco_rows`` gives them; ``keys`` are
    carried along and need not tell the rows apart.

    An id means what it means in its own row, so images and categories are looked up there.
    Of repeated ids the first image and the first category by name count.
    """
    parsed = texts.select(*keys, F.from_json(column, f"struct<{_as_fields(COCO_SCHEMA)}>").alias("_d"))
    # Generators keep later operators from parsing and sorting again.
    docs = parsed.select(*keys, F.inline(F.array(F.struct("_d.annotations", _sorted_by_id("_d.images").alias("_i"), _sorted_by_id("_d.categories").alias("_c")))))
    docs = docs.select(*keys, F.inline(F.array(F.struct("annotations", "_i", "_c", _halvings("_i").alias("_si"), _halvings("_c").alias("_sc")))))
    placed = F.transform(
        "annotations",
        lambda a: F.struct(a.alias("_a"), F.get(_find("_i", "_si", a["image_id"]), 0).alias("_image"), F.get(_find("_c", "_sc", a["category_id"]), 0)["name"].alias("_name")),
    )
    rows = docs.select(*keys, F.inline(placed)).select(*keys, "_a.*", "_name", F.col("_image.file_name").alias("file_name"), F.col("_image.width").alias("image_width"), F.col("_image.height").alias("image_height"))
    return _coco_columns(rows.withColumnRenamed("id", "annotation_id"), keys, missing)


def _as_fields(ddl: str) -> str:
    """``a int, b string`` as the field list of a struct type, split at the top level."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(ddl):
        depth += {"<": 1, ">": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            out.append(ddl[start:i])
            start = i + 1
    out.append(ddl[start:])
    return ",".join(":".join(field.strip().split(" ", 1)) for field in out)


def element_fields(ddl: str, name: str) -> str:
    """Fields of the structs in the list ``name`` of a schema."""
    listed = T.StructType.fromDDL(ddl)[name].dataType
    return listed.elementType.simpleString()


def _is_split(spark: SparkSession, path: str, split: bool | None) -> bool:
    return jsonsplit.largest_file(spark, path) > jsonsplit.partition_bytes(spark) if split is None else split


def read_coco(spark: SparkSession, path: str, missing: str | None = None, split: bool | None = None) -> DataFrame:
    """Annotations of one or many COCO documents; ``source_file`` names the document, since
    ids are unique only within one.

    ``split`` lets many tasks read one document; by default where a file is larger than a
    partition of ``spark.sql.files.maxPartitionBytes``.
    """
    if _is_split(spark, path, split):
        elements = jsonsplit.read_elements(spark, path)
        pics, boxes, names = (jsonsplit.section(elements, name, element_fields(COCO_SCHEMA, name)) for name in ("images", "annotations", "categories"))
        return coco_rows(pics, boxes, sent_if_few(names, "coco-names"), ("source_file",), missing)
    docs = spark.read.schema(COCO_SCHEMA).option("multiLine", "true").json(path)
    return coco_annotations(docs.select("*", F.col("_metadata.file_path").alias("source_file")), ("source_file",), missing)


def read_document_list(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """Elements of the list ``name`` of large JSON documents, read by many tasks."""
    return jsonsplit.section(jsonsplit.read_elements(spark, path), name, schema).drop("source_file")


def coco_categories(docs: DataFrame) -> DataFrame:
    return docs.select(F.inline("categories")).select("id", "name", "supercategory")


# Pascal VOC -----------------------------------------------------------------------


def voc_annotations(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Objects of VOC structs. A missing name is ``unknown``, missing corners are 0; an
    object without a box is left out."""
    rows = docs.select(*keys, "filename", "size", F.explode("object").alias("_o")).where("_o.bndbox IS NOT NULL")
    corner = {c: F.coalesce(F.col(f"_o.bndbox.{c}"), F.lit(0.0)) for c in ("xmin", "ymin", "xmax", "ymax")}
    w, h = F.coalesce("size.width", F.lit(0)), F.coalesce("size.height", F.lit(0))
    unit = geometry.corners_from(Box(corner["xmin"], corner["ymin"], corner["xmax"], corner["ymax"]), F.lit("xyxy_absolute"), w, h)
    return rows.select(
        *keys, "filename", text.stem(F.col("filename")).alias("image_id"), w.alias("image_width"), h.alias("image_height"),
        F.coalesce("_o.name", F.lit("unknown")).alias("class_name"),
        corner["xmin"].alias("x"), corner["ymin"].alias("y"),
        (corner["xmax"] - corner["xmin"]).alias("width"), (corner["ymax"] - corner["ymin"]).alias("height"),
        *unit.named(CORNERS),
    )


def parse_voc(texts: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    parsed = F.from_xml(column, f"struct<{_as_fields(VOC_SCHEMA)}>", {"rowTag": "annotation"})
    return voc_annotations(_parsed_once(texts, parsed, keys), keys)


def read_voc(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("xml").option("rowTag", "annotation").schema(VOC_SCHEMA).option("pathGlobFilter", "*.xml")
    return voc_annotations(files.load(path))


# CSV ------------------------------------------------------------------------------

# Column names a CSV may use, the first present and filled one counts.
CSV_NAMES = {
    "file": ("image_filename", "filename", "image"),
    "class": ("class_name", "class", "label"),
    "x1": ("x_min", "xmin"),
    "y1": ("y_min", "ymin"),
    "x2": ("x_max", "xmax"),
    "y2": ("y_max", "ymax"),
    "width": ("width",),
    "height": ("height",),
}


def parse_csv(rows: DataFrame) -> DataFrame:
    """Boxes of a table of text columns under any of the known names."""

    def pick(name: str, default: Column) -> Column:
        there = [text.blank_to_null(F.col(c)) for c in CSV_NAMES[name] if c in rows.columns]
        return F.coalesce(*there, default)

    zero = F.lit("0")
    box = Box(*[_number(pick(c, zero)) for c in CORNERS])
    w, h = pick("width", zero).try_cast("int"), pick("height", zero).try_cast("int")
    unit = geometry.corners_from(box, F.lit("xyxy_absolute"), w, h)
    return rows.select(
        pick("file", F.lit(None).cast("string")).alias("filename"), pick("class", F.lit("unknown")).alias("class_name"), *unit.named(CORNERS)
    ).where("filename IS NOT NULL")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return parse_csv(spark.read.option("header", "true").csv(path))


def parse_open_images(lines: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Open Images lines: id, source, label, confidence, XMin, XMax, YMin, YMax, ...

    The header and lines of fewer than eight fields are skipped; confidence 1 counts as
    not given; values are normalised. ``names`` has (label, name).
    """
    x1, x2, y1, y2 = [_number(F.get("_p", i)) for i in range(4, 8)]
    rows = _fields(lines, ",", 8, []).where(x1.isNotNull() & x2.isNotNull() & y1.isNotNull() & y2.isNotNull())
    given = F.get("_p", 3)
    out = rows.select(
        F.get("_p", 0).alias("image_id"), F.get("_p", 2).alias("label"),
        F.when(~given.isin("", "1"), _number(given)).alias("confidence"),
        x1.alias("x"), y1.alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height"),
    )
    if names is None:
        return out.withColumn("class_name", F.col("label"))
    # Labels are few and one may stand on most lines.
    named = salted_join(out, names, ["label"], ["image_id", "x", "y"], how="left")
    return named.withColumn("class_name", F.coalesce("name", "label")).drop("name")


def read_open_images(spark: SparkSession, path: str, class_names: str | None = None) -> DataFrame:
    names = None
    if class_names is not None:
        names = spark.read.schema("label string, name string").csv(class_names).select(F.trim("label").alias("label"), F.trim("name").alias("name"))
    return parse_open_images(spark.read.text(path).withColumnRenamed("value", "line"), names)


# JSON and GeoJSON -----------------------------------------------------------------


def json_images(docs: DataFrame, entries: str, keys: Sequence[str] = ()) -> DataFrame:
    """Images with their own box format per annotation."""
    images = docs.select(*keys, F.inline(entries)).withColumn("filename", F.coalesce(text.blank_to_null(F.col("filename")), "file_name"))
    rows = images.select(*keys, "filename", "width", "height", F.explode("annotations").alias("_a"))
    boxes = rows.withColumn("_b", F.col("_a.bbox"))
    fmt = F.coalesce("_a.bbox_format", F.lit("xyxy_normalized"))
    unit = geometry.corners_from(_box_of("_b"), fmt, F.col("width"), F.col("height"))
    return boxes.select(*keys, "filename", F.coalesce("_a.class", "_a.class_name", F.lit("unknown")).alias("class_name"), *unit.named(CORNERS))


def parse_json_images(texts: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """A list of images, or an object with the list under ``images``."""
    texts = _parsed_once(texts, F.struct(F.col(column).alias("_text")), keys)
    listed = F.from_json("_text", JSON_IMAGES_SCHEMA)
    held = F.from_json("_text", f"struct<images:{JSON_IMAGES_SCHEMA}>")["images"]
    is_list = F.ltrim("_text").startswith("[")
    return json_images(_parsed_once(texts, F.struct(F.when(is_list, listed).otherwise(held).alias("_e")), keys), "_e", keys)


def read_json_images(spark: SparkSession, path: str, split: bool | None = None) -> DataFrame:
    """Images of JSON documents; ``split`` as for ``read_coco``."""
    if _is_split(spark, path, split):
        entry = T.DataType.fromDDL(JSON_IMAGES_SCHEMA).elementType.simpleString()
        found = jsonsplit.read_elements(spark, path).where("section IN ('', 'images')")
        return json_images(found.select(F.array(F.from_json("element", entry)).alias("_e")), "_e")
    return parse_json_images(spark.read.text(path, wholetext=True), "value")


def geojson_boxes(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Boxes held in feature properties, with the file they belong to."""
    rows = docs.select(*keys, F.explode("features.properties").alias("_p"))
    boxes = rows.withColumn("_b", F.col("_p.bbox"))
    fmt = F.coalesce("_p.bbox_format", F.lit("xyxy_normalized"))
    unit = geometry.corners_from(_box_of("_b"), fmt, F.col("_p.width"), F.col("_p.height"))
    name = text.first_filled(F.col("_p.image_filename"), F.col("_p.filename"), F.lit(""))
    kind = text.first_filled(F.col("_p.class"), F.col("_p.class_name"), F.lit("unknown"))
    return boxes.select(*keys, name.alias("filename"), kind.alias("class_name"), *unit.named(CORNERS))


def geojson_polygons(docs: DataFrame, classes: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Centre form of the outer ring of each polygon; an unlisted class is number 0."""
    rows = docs.select(*keys, F.inline("features")).where("geometry.type = 'Polygon' AND size(geometry.coordinates[0]) > 0")
    ring = F.transform(F.get("geometry.coordinates", 0), lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    x, y = F.array_min(xs), F.array_min(ys)
    w, h = F.array_max(xs) - x, F.array_max(ys) - y
    name = F.coalesce("properties.class", "properties.label", F.lit(""))
    index = F.greatest(F.array_position(F.array(*map(F.lit, classes)), name) - 1, F.lit(0))
    centre = geometry.centre_form(Box(x, y, w, h))
    return rows.select(*keys, F.coalesce(index, F.lit(0)).cast("int").alias("class_id"), *centre.named(("cx", "cy", "w", "h")))


def parse_geojson(texts: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """GeoJSON texts as structs for :func:`geojson_boxes` and :func:`geojson_polygons`."""
    return _parsed_once(texts, F.from_json(column, f"struct<{_as_fields(GEOJSON_SCHEMA)}>"), keys)


def read_geojson(spark: SparkSession, path: str, split: bool | None = None) -> DataFrame:
    """Boxes of GeoJSON features; ``split`` as for ``read_coco``."""
    if _is_split(spark, path, split):
        found = jsonsplit.read_elements(spark, path).where("section = 'features'")
        return geojson_boxes(found.select(F.array(F.from_json("element", element_fields(GEOJSON_SCHEMA, "features"))).alias("features")))
    files = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", "true").json(path)
    return geojson_boxes(files)


# Corpora --------------------------------------------------------------------------

# Class lists of corpora that do not carry their own.
VISDRONE_CLASSES = (
    "ignored_regions", "pedestrian", "people", "bicycle", "car", "van", "truck", "tricycle", "awning_tricycle", "bus", "motor", "others",
)
LOVEDA_CLASSES = ("background", "building", "road", "water", "barren", "forest", "agricultural")
SPACENET_CLASSES = ("building",)
SEASHIPS_CLASSES = ("ship",)

COMMON = ("stem", "class_id", "cx", "cy", "w", "h")


def parse_visdrone(lines: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """``left,top,width,height,score,category,...`` lines in centre form, scaled by the
    image where ``sizes`` (stem, image_width, image_height) knows it."""
    rows = _fields(lines, ",", 6, ["stem"])
    left, top, w, h = [_number(F.get("_p", i)) for i in range(4)]
    kind = F.get("_p", 5).try_cast("int")
    # Only the numbers travel to the sizes, not the fields of the line.
    rows = rows.select("stem", left.alias("_left"), top.alias("_top"), w.alias("_w"), h.alias("_h"), kind.alias("_kind"))
    rows = rows.where("_left IS NOT NULL AND _top IS NOT NULL AND _w IS NOT NULL AND _h IS NOT NULL AND _kind IS NOT NULL")
    left, top, w, h, kind = [F.col(c) for c in ("_left", "_top", "_w", "_h", "_kind")]
    iw, ih = F.lit(1), F.lit(1)
    if sizes is not None:
        rows = rows.join(sizes, "stem", "left")
        iw, ih = F.coalesce(F.nullif("image_width", F.lit(0)), F.lit(1)), F.coalesce(F.nullif("image_height", F.lit(0)), F.lit(1))
    class_id = F.greatest(F.lit(0), F.least(kind - 1, F.lit(len(VISDRONE_CLASSES) - 1)))
    return rows.select("stem", class_id.alias("class_id"), ((left + w / 2) / iw).alias("cx"), ((top + h / 2) / ih).alias("cy"), (w / iw).alias("w"), (h / ih).alias("h"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(path).select(
        text.stem(F.col("_metadata.file_path")).alias("stem"), F.col("value").alias("line")
    )


def _both(reader: Callable[[str], DataFrame], train: str, val: str) -> DataFrame:
    return reader(train).withColumn("split", F.lit("train")).unionByName(reader(val).withColumn("split", F.lit("val")))


def image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """(stem, image_width, image_height) of the images anywhere below a folder."""
    wanted = "*.{jpg,jpeg,png,bmp,JPG,JPEG,PNG,BMP}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", wanted).load(path)
    sized = image_headers(files.select(text.stem(F.col("path")).alias("stem"), "content"))
    return sized.select("stem", F.col("width").alias("image_width"), F.col("height").alias("image_height")).dropDuplicates(["stem"])


def extract_visdrone(spark: SparkSession, root: str) -> DataFrame:
    """Boxes scaled by the size of their image; pixels where the image is missing."""
    return _both(
        lambda d: parse_visdrone(_lines(spark, f"{root}/{d}/annotations"), image_sizes(spark, f"{root}/{d}")),
        "VisDrone2019-DET-train", "VisDrone2019-DET-val",
    )


def extract_coco2017(spark: SparkSession, root: str) -> DataFrame:
    """Class numbers follow the category ids of the training file."""

    def one(split: str) -> DataFrame:
        rows = read_coco(spark, f"{root}/annotations/instances_{split}2017.json").where("file_name IS NOT NULL")
        iw, ih = F.coalesce(F.nullif("image_width", F.lit(0)), F.lit(1)), F.coalesce(F.nullif("image_height", F.lit(0)), F.lit(1))
        return rows.select(
            text.stem(F.col("file_name")).alias("stem"), "category_id",
            ((F.col("x") + F.col("width") / 2) / iw).alias("cx"), ((F.col("y") + F.col("height") / 2) / ih).alias("cy"),
            (F.col("width") / iw).alias("w"), (F.col("height") / ih).alias("h"),
        )

    docs = spark.read.schema(COCO_SCHEMA).option("multiLine", "true").json(
        [f"{root}/annotations/instances_{s}2017.json" for s in ("train", "val")]
    )
    listed = coco_categories(docs).select(F.col("id").alias("category_id")).distinct()
    # A category list is short; it is numbered as one sorted array.
    ids = listed.agg(F.array_sort(F.collect_list(F.col("category_id").cast("long"))).alias("a")).scalar()
    number = F.greatest(F.array_position(ids, F.col("category_id").cast("long")) - 1, F.lit(0)).cast("int")
    return _both(one, "train", "val").select("stem", number.alias("class_id"), "cx", "cy", "w", "h", "split")


def extract_open_images(spark: SparkSession, root: str) -> DataFrame:
    """Boxes whose centre lies in the image; classes numbered in the order of the list."""
    names = spark.read.text(f"{root}/class-descriptions-boxable.csv", wholetext=True)
    listed = class_list(names).select("class_id", F.trim(F.substring_index("name", ",", 1)).alias("label"))

    def one(split: str) -> DataFrame:
        rows = read_open_images(spark, f"{root}/{split}-annotations-bbox.csv")
        centre = geometry.centre_form(Box(*[F.col(c) for c in ("x", "y", "width", "height")]))
        return rows.join(listed, "label", "left").select(
            F.trim("image_id").alias("stem"), F.coalesce("class_id", F.lit(0)).alias("class_id"), *centre.named(("cx", "cy", "w", "h"))
        ).where("cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1")

    return _both(one, "train", "val")


def _extract_geojson(spark: SparkSession, train: str, val: str, classes: Sequence[str]) -> DataFrame:
    def one(path: str) -> DataFrame:
        files = spark.read.schema(GEOJSON_SCHEMA).option("multiLine", "true").option("pathGlobFilter", "*json").json(path)
        stems = files.withColumn("stem", text.stem(F.col("_metadata.file_path")))
        return geojson_polygons(stems, classes, ["stem"])

    return _both(one, train, val)


def extract_loveda(spark: SparkSession, root: str) -> DataFrame:
    return _extract_geojson(spark, f"{root}/Train", f"{root}/Val", LOVEDA_CLASSES)


def extract_spacenet(spark: SparkSession, root: str) -> DataFrame:
    return _extract_geojson(spark, f"{root}/train", f"{root}/val", SPACENET_CLASSES)


def extract_seaships(spark: SparkSession, root: str) -> DataFrame:
    def one(split: str) -> DataFrame:
        rows = read_voc(spark, f"{root}/{split}")
        iw, ih = F.nullif("image_width", F.lit(0)), F.nullif("image_height", F.lit(0))
        return rows.select(
            F.col("image_id").alias("stem"), F.lit(0).alias("class_id"),
            ((F.col("x") + F.col("width") / 2) / iw).alias("cx"), ((F.col("y") + F.col("height") / 2) / ih).alias("cy"),
            (F.col("width") / iw).alias("w"), (F.col("height") / ih).alias("h"),
        )

    return _both(one, "train", "val")


# Documents ------------------------------------------------------------------------


def parse_documents(texts: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Documents of JSON texts: a list, an object with ``documents``, or one document.

    A text that is no JSON gives one row with a null document and ``is_bad`` set.
    """
    parsed = texts.select(*keys, F.try_parse_json(column).alias("_v"))
    listed = F.coalesce(
        F.try_variant_get("_v", "$.documents", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>"), F.array("_v")
    )
    rows = parsed.select(*keys, F.col("_v").isNull().alias("is_bad"), F.explode(listed).alias("doc"))
    field = lambda p: F.try_variant_get("doc", p, "string")
    return rows.select(
        *keys, "is_bad", F.coalesce(field("$.document_id"), field("$.metadata.document_id")).alias("document_id"),
        field("$.name").alias("name"), field("$.category").alias("category"), F.to_json("doc").alias("document"),
    )


def parse_feature_documents(texts: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """One document per GeoJSON feature: its properties, and its geometry as JSON."""
    parsed = texts.select(*keys, F.try_parse_json(column).alias("_v"))
    features = F.coalesce(F.try_variant_get("_v", "$.features", "array<variant>"), F.array().cast("array<variant>"))
    rows = parsed.select(*keys, F.explode(features).alias("_f"))
    return rows.select(
        *keys, F.to_json(F.try_variant_get("_f", "$.properties", "variant")).alias("properties"),
        F.to_json(F.try_variant_get("_f", "$.geometry", "variant")).alias("geometry"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return parse_documents(spark.read.text(path, wholetext=True), "value")


def read_csv_documents(spark: SparkSession, path: str) -> DataFrame:
    """One document per row of CSV files with a header; empty fields are left out."""
    lines = spark.read.option("header", "true").option("multiLine", "true").csv(path)
    return parse_documents(lines.select(F.to_json(F.struct("*")).alias("value")), "value")


def read_canonical(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables written by :func:`labelloom.sources.writers.write_canonical`."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("images", "annotations", "categories")}


CANONICAL_SCHEMA = (
    "info struct<dataset_name:string,dataset_id:string,ontology_version:string,pipeline_version:string>, "
    "images array<struct<id:string,file_name:string,width:int,height:int>>, categories array<struct<id:int,name:string,canonical_label:string>>"
)


def parse_canonical(texts: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Canonical data set JSON as structs; annotations are not restored from it."""
    return texts.select(*keys, F.from_json(column, f"struct<{_as_fields(CANONICAL_SCHEMA)}>").alias("_d")).select(*keys, "_d.*")


def canonical_images(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return docs.select(*keys, "info.dataset_name", F.inline("images"))


def canonical_categories(docs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return docs.select(*keys, "info.dataset_name", F.inline("categories"))


# Image headers --------------------------------------------------------------------


def _jpeg_size(head: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header of a JPEG file.

    By the JPEG standard, segments follow each other up to the start of scan: a marker (FF,
    any number of fill bytes FF, a code), and a two-byte length unless the code stands alone.
    Codes C0 to CF are frame headers but for C4, C8 and CC.
    """
    at = 0
    while at + 2 <= len(head) and head[at] == 0xFF:
        code = head[at + 1]
        if code == 0xFF:
            at += 1
        elif code == 0x01 or 0xD0 <= code <= 0xD8:
            at += 2
        elif code in (0xD9, 0xDA):
            return None
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(head):
                return None
            return int.from_bytes(head[at + 7 : at + 9], "big"), int.from_bytes(head[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(head[at + 2 : at + 4], "big")
    return None


@F.pandas_udf(T.StructType([T.StructField("width", T.LongType()), T.StructField("height", T.LongType())]))
def _jpeg(heads: pd.Series) -> pd.DataFrame:
    sizes = [_jpeg_size(bytes(h)) if h is not None else None for h in heads]
    return pd.DataFrame(
        {"width": pd.array([s[0] if s else None for s in sizes], "Int64"), "height": pd.array([s[1] if s else None for s in sizes], "Int64")}
    )


def image_headers(files: DataFrame, probe_jpeg: bool = True) -> DataFrame:
    """Width and height of PNG, BMP and JPEG contents.

    PNG and BMP sizes stand in the first 26 bytes and are read with built-in functions. A
    JPEG's frame header comes after segments of any length, so Python gets its content whole.
    """
    digits = F.hex(F.substring("content", 1, 26))

    def big(start: int) -> Column:
        return F.conv(F.substring("_x", 2 * start + 1, 8), 16, 10).cast("long")

    def little(start: int) -> Column:
        pairs = [F.substring("_x", 2 * (start + i) + 1, 2) for i in (3, 2, 1, 0)]
        return F.conv(F.concat(*pairs), 16, 10).cast("long")

    png, bmp, jpeg = F.col("_x").startswith("89504E47"), F.col("_x").startswith("424D"), F.col("_x").startswith("FFD8")
    signed = little(22)
    rows = files.withColumn("_x", digits)
    if probe_jpeg:
        rows = rows.withColumn("_j", _jpeg(F.when(jpeg, F.col("content"))))
    else:
        rows = rows.withColumn("_j", F.lit(None).cast("struct<width:long,height:long>"))
    long_enough = F.length("_x") >= 52
    return rows.withColumn(
        "width", F.when(png & long_enough, big(16)).when(bmp & long_enough, little(18)).otherwise(F.col("_j.width"))
    ).withColumn(
        "height",
        F.when(png & long_enough, big(20))
        .when(bmp & long_enough, F.when(signed >= 2**31, 2**32 - signed).otherwise(signed))
        .otherwise(F.col("_j.height")),
    ).drop("_x", "_j", "content")


def read_image_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, sha256, width, height`` of image files.

    Headers are read by range, and whole files only where ``sha256`` is used. Where no
    ranges can be read, on stores that only Spark opens, contents are read whole.
    """
    try:
        files.filesystem(path)
    except (ValueError, OSError):
        return _read_whole_headers(spark, path)
    return files.image_files(spark, path).select("path", "length", "sha256", "width", "height")


def _read_whole_headers(spark: SparkSession, path: str) -> DataFrame:
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return image_headers(listing.select("path", "length", F.sha2("content", 256).alias("sha256"), "content"))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "yolo": read_yolo,
    "coco": read_coco,
    "voc": read_voc,
    "csv": read_csv,
    "open_images": read_open_images,
    "json": read_json_images,
    "geojson": read_geojson,
    "documents": read_documents,
    "csv_documents": read_csv_documents,
}
EXTRACTORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "coco": extract_coco2017,
    "open_images_v7": extract_open_images,
    "visdrone": extract_visdrone,
    "loveda": extract_loveda,
    "spacenet": extract_spacenet,
    "seaships": extract_seaships,
}
