"""Many COCO files as one: ids renumbered over all files, categories united by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from labelloom.operators.skew import bucketed_row_number, join_on, stored_row_number
from labelloom.session import discard, sent_if_few, shuffles_removed, stored
from labelloom.sources import jsonsplit, writers
from labelloom.sources.readers import COCO_SCHEMA, element_fields

#: Elements of one file up to which they are kept together in a task.
FILE_ROWS = 500_000
#: Files are shuffled in so many turns, at most, of so many elements each, at least.
TURNS, TURN_ROWS = 2, 4_000_000


def merge_coco(images: DataFrame, annotations: DataFrame, categories: DataFrame, key: str = "source_file") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of many files with ids of their own, for
    ``writers.write_coco_document``.

    The inputs are the elements of the three lists with ``key``, the file each comes from.
    An id means what it means in its own file only: an annotation goes to its file's image,
    or to image 0 where there is none. Categories of one name are one, numbered by name from
    1; a category id that its file does not list is named by itself. Of repeated ids within
    a file the first image by name and the first category by name count as meant.

    The results are stored and do not read the inputs again. Files are kept together where
    none has more than ``FILE_ROWS`` elements, which takes one shuffle, in turns that leave
    no shuffle files behind; larger ones are spread, and looked up by joins.
    """
    listed = stored(categories.where("name IS NOT NULL").groupBy("name").agg(F.min("supercategory").alias("supercategory")), "merged-names")
    # Files are counted by a hash; two of one hash count as a larger file, which is as right.
    hashed = [df.select(F.xxhash64(key).alias("h")) for df in (images, annotations, categories)]
    with shuffles_removed(images.sparkSession):
        files = hashed[0].union(hashed[1]).union(hashed[2]).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
        size = files.agg(F.coalesce(F.max("n"), F.lit(0)).alias("largest"), F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    side = lambda i: F.coalesce(F.get("bbox", i), F.lit(0.0))
    sides = [side(i).alias(c) for i, c in enumerate(("x", "y", "_w", "_h"))]
    placed = annotations.select(key, F.col("id").alias("annotation_id"), "image_id", "category_id", *sides, "area", F.coalesce("iscrowd", F.lit(0)).alias("iscrowd"))
    pics = images.select(key, F.col("id").alias("image_id"), "file_name", "width", "height")
    names = categories.select(key, F.col("id").alias("category_id"), F.col("name").alias("_name"))
    if size.largest > FILE_ROWS:
        pics, boxes = _by_joins(pics, placed, names, key)
    else:
        turns = max(1, min(TURNS, size.rows // TURN_ROWS))
        pics, boxes = _by_range(pics, placed, names, key, _borders(annotations.select(key), key, turns, size.files))

    united = listed.union(boxes.select("_name", F.lit(None).cast("string"))).groupBy("name").agg(F.min("supercategory").alias("supercategory"))
    numbers = bucketed_row_number(united.withColumn("_letters", F.substring("name", 1, 4)), [], "_letters", ["name"], "id")
    kept = sent_if_few(numbers.select("id", "name", F.coalesce("supercategory", F.lit("object")).alias("supercategory")), "merged-categories")
    discard(listed)
    boxes = boxes.join(kept.select(F.col("id").alias("category_id"), F.col("name").alias("_name")), "_name")
    return (
        pics.select(key, F.col("image_id").alias("id"), "coco_id", "file_name", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height")),
        boxes.select(
            key, "annotation_id", "coco_id", F.coalesce("coco_image_id", F.lit(0)).alias("coco_image_id"), "category_id", "x", "y", F.col("_w").alias("width"), F.col("_h").alias("height"),
            F.coalesce("area", F.col("_w") * F.col("_h")).alias("area"), "iscrowd",
        ),
        kept,
    )


def _named() -> Column:
    return F.coalesce("_name", "category_id", F.lit("unknown"))


def _borders(keys: DataFrame, key: str, parts: int, files: int) -> list:
    """Names of files, in order, that cut them into about ``parts`` like parts. Any would do."""
    if parts == 1:
        return []
    few = F.pmod(F.xxhash64(key), F.lit(files // 1000 + 1)) == 0
    with shuffles_removed(keys.sparkSession):
        found = [r[0] for r in keys.where(few & F.col(key).isNotNull()).distinct().orderBy(key).collect()]
    return [found[i * len(found) // parts] for i in range(1, parts)] if len(found) >= parts else []


def _by_range(images: DataFrame, annotations: DataFrame, names: DataFrame, key: str, borders: Sequence = ()) -> tuple[DataFrame, DataFrame]:
    """Images and annotations with their numbers, the latter with name and image.

    All elements of a file lie in one range of files, so that windows over an id of a file
    look them up without a shuffle, and their places in the range number them. The files up
    to each of ``borders`` take their turn before those that follow.
    """
    kind = lambda df, k: df.withColumn("_kind", F.lit(k).cast("byte"))
    rows = kind(images, 0).unionByName(kind(names, 1), allowMissingColumns=True).unionByName(kind(annotations, 2), allowMissingColumns=True)
    turns = []
    for turn, (low, high) in enumerate(zip([None, *borders], [*borders, None], strict=True)):
        after = F.lit(True) if low is None else F.col(key) > F.lit(low)
        upto = F.lit(True) if high is None else F.col(key) <= F.lit(high)
        first = F.col(key).isNull() if low is None else F.lit(False)
        placed = _placed(rows.where(first | (after & upto)), key)
        turns.append(stored(placed, "merged").withColumn("_turn", F.lit(turn)))
    rows = turns[0]
    for more in turns[1:]:
        rows = rows.union(more)
    is_image = F.col("_kind") == 0
    at = ["_turn", "_range"]
    sizes = rows.groupBy(*at).agg(F.count_if(is_image).alias("_i"), F.count_if(~is_image).alias("_a"))
    before = W.orderBy(*at).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*at, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_i", "_a")])
    counted = rows.join(F.broadcast(offsets), at)
    return (
        counted.where(is_image).withColumn("coco_id", F.col("_i") + F.col("_local") + 1).select(*images.columns, "coco_id"),
        counted.where(~is_image).withColumns({"coco_id": F.col("_a") + F.col("_local") + 1, "coco_image_id": F.col("_i") + F.col("_first") + 1}),
    )


def _placed(rows: DataFrame, key: str) -> DataFrame:
    """Images and annotations with their range of files and their places in it, the latter
    with the name of their category and the place of their image."""
    place = F.monotonically_increasing_id()  # the range above 33 bits, the place in it below
    rows = rows.repartitionByRange(key).withColumn("_name", F.min("_name").over(W.partitionBy(key, "category_id"))).where("_kind <> 1")
    # Images come first for their own places, annotations do for theirs.
    rows = rows.sortWithinPartitions("_kind", key, "image_id", "file_name").withColumn("_own", place.bitwiseAND(F.lit((1 << 33) - 1)))
    rows = rows.withColumn("_first", F.min(F.when(F.col("_kind") == 0, F.col("_own"))).over(W.partitionBy(key, "image_id")))
    rows = rows.sortWithinPartitions(F.col("_kind").desc(), key, "annotation_id", "image_id", "x", "y").withColumn("_place", place)
    is_image = F.col("_kind") == 0
    thin = {
        "_name": F.when(~is_image, _named()), "image_id": F.when(is_image, F.col("image_id")),
        "_range": F.shiftrightunsigned("_place", 33), "_local": F.when(is_image, F.col("_own")).otherwise(F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))),
    }
    return rows.withColumns(thin).drop("category_id", "_place", "_own")


def _by_joins(images: DataFrame, annotations: DataFrame, names: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """What ``_by_range`` gives, with the elements of a file spread over many tasks."""
    named = names.groupBy(key, "category_id").agg(F.min("_name").alias("_name"))
    used = join_on(annotations, named, [key, "category_id"], "left").withColumn("_name", _named()).drop("category_id")
    boxes = stored_row_number(used, [key, "annotation_id", "image_id", "x", "y"], "coco_id")
    pics = stored_row_number(images, [key, "image_id", "file_name"], "coco_id")
    # Numbers follow the names within an id.
    target = pics.groupBy(key, "image_id").agg(F.min("coco_id").alias("coco_image_id"))
    return pics, join_on(boxes, target, [key, "image_id"], "left")


def merge_coco_files(spark: SparkSession, path: str, target: str) -> int:
    """Write the COCO files at ``path`` as the one document ``target``; gives its bytes."""
    elements = jsonsplit.read_elements(spark, path)
    parts = [jsonsplit.section(elements, name, element_fields(COCO_SCHEMA, name)) for name in ("images", "annotations", "categories")]
    return writers.write_coco_document(*merge_coco(*parts), target)
