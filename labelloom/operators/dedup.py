"""Duplicates by name, content, metadata, annotation and id.

A group of copies may hold a third of all rows. Each group is first reduced to one row
(its first member and its size), and copies are then linked to that first member: the
result grows with the number of copies, never with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import checksums, text
from labelloom.operators.skew import join_group_summary
from labelloom.operators.stats import with_class

BOX = ("x", "y", "width", "height")
# Columns that tell annotations of the same id apart.
SEQUENCE = ("seq1", "seq2", "seq3")


def copies(rows: DataFrame, key: Sequence[str], id_col: str, order: Sequence[str]) -> DataFrame:
    """All rows after the first of their group, with ``original_id``.

    ``order`` must tell rows apart; rows with a null key have no copies.
    """
    position = F.struct(*order)
    if list(order) == [id_col]:
        # A plain minimum can be aggregated by hash, a minimum of structs only by sort.
        least = F.struct(F.struct(F.col("_min").alias(id_col)).alias("p"), F.col("_min").alias("i"))
        found = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("_min"))
        summary = found.where("copies > 1").select(*key, "copies", least.alias("_first"))
    else:
        first = F.min(F.struct(position.alias("p"), F.col(id_col).alias("i")))
        summary = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), first.alias("_first")).where("copies > 1")
    joined = rows.join(summary, list(key))
    return joined.where(position != F.col("_first.p")).withColumn("original_id", F.col("_first.i")).drop("_first")


def _links(rows: DataFrame, key: Sequence[str], id_col: str, order: Sequence[str], kind: str) -> DataFrame:
    return copies(rows, key, id_col, order).select(
        "dataset", F.lit(kind).alias("kind"), "original_id", F.col(id_col).alias("duplicate_id")
    )


def by_file_name(images: DataFrame) -> DataFrame:
    named = images.select("dataset", "id", text.base_name(F.col("file_path")).alias("name"))
    return _links(named, ["dataset", "name"], "id", ["id"], "filename")


def by_checksum(images: DataFrame) -> DataFrame:
    """Same content hash; blank hashes are no copies."""
    hashed = images.select("dataset", "id", text.blank_to_null(F.col("sha256")).alias("sha256")).where("sha256 IS NOT NULL")
    return _links(hashed, ["dataset", "sha256"], "id", ["id"], "hash")


def by_metadata(images: DataFrame, ignore_empty: bool = False) -> DataFrame:
    """Same metadata map, whatever the order of its entries."""
    keyed = images.select("dataset", "id", "metadata", checksums.of_map(F.col("metadata")).alias("key"))
    if ignore_empty:
        keyed = keyed.where(F.size("metadata") > 0)
    return _links(keyed.drop("metadata"), ["dataset", "key"], "id", ["id"], "metadata")


def annotations_in_image(annotations: DataFrame) -> DataFrame:
    """Same class and box twice on one image; both ends are the image."""
    rows = with_class(annotations).select("dataset", "image_id", "class_name", *BOX, "id", *SEQUENCE)
    return _links(rows, ["dataset", "image_id", "class_name", *BOX], "image_id", ["id", *SEQUENCE], "annotation")


def objects_across_images(annotations: DataFrame) -> DataFrame:
    """Same class and box anywhere in the data set, repeats on one image included."""
    rows = with_class(annotations).select("dataset", "image_id", "class_name", *BOX, "id", *SEQUENCE)
    return _links(rows, ["dataset", "class_name", *BOX], "image_id", ["image_id", "id", *SEQUENCE], "object")


_KINDS = ("_name", "_hash", "_meta", "_object")


def _counted(rows: DataFrame, links: Column | int = 0, **amounts: Column | int) -> DataFrame:
    """Rows of an id with their number by kind, and the links that they stand for."""
    number = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("long")
    return rows.select("dataset", "id", number(links).alias("links"), *[number(amounts.get(k, 0)).alias(k) for k in _KINDS])


def report(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """Distinct duplicate images and annotated images per data set, and the ratio.

    Rows meet no summaries: an id has a copy where it stands in more rows than it is the
    first of groups, so rows and firsts are added up by id. A repeat on one image is a
    repeat in the data set too, so such repeats only add to the links.
    """
    path, digest, metadata = F.col("file_path"), text.blank_to_null(F.col("sha256")), F.col("metadata")
    # Entries in order are as good as their hash.
    keys = {"_name": text.base_name(path), "_hash": digest, "_meta": F.sort_array(F.map_entries(metadata))}
    filled = {"_name": path.isNotNull(), "_hash": digest.isNotNull(), "_meta": metadata.isNotNull()}
    counted = [_counted(images.where("dataset IS NOT NULL"), **filled)]
    for kind, key in keys.items():
        groups = images.where(F.col("dataset").isNotNull() & filled[kind]).groupBy("dataset", key.alias("_key"))
        firsts = groups.agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("id"))
        counted.append(_counted(firsts, F.col("_n") - 1, **{kind: -1}))

    object_key = ["dataset", "class_name", *BOX]
    known = " AND ".join(f"{c} IS NOT NULL" for c in object_key)
    boxes = with_class(annotations).select(F.col("image_id").alias("id"), *object_key).where(known)
    # Two readers share the shuffle of these.
    on_image = boxes.groupBy("id", *object_key).agg(F.count(F.lit(1)).alias("_n"))
    counted.append(_counted(on_image, F.when(F.col("id").isNotNull(), F.col("_n") - 1).otherwise(0), _object=F.col("_n")))
    # A null image comes before all others.
    least = F.when(F.count("id") == F.count(F.lit(1)), F.min("id")).alias("id")
    objects = on_image.groupBy(*object_key).agg(F.sum("_n").alias("_n"), least)
    counted.append(_counted(objects, F.col("_n") - 1, _object=-1))

    rows = counted[0]
    for other in counted[1:]:
        rows = rows.unionByName(other)
    per_id = rows.groupBy("dataset", "id").agg(*[F.sum(c).alias(c) for c in ("links", *_KINDS)])
    found = per_id.groupBy("dataset").agg(
        F.sum("links").alias("links"),
        F.count_if((F.col("_name") > 0) | (F.col("_hash") > 0) | (F.col("_meta") > 0)).alias("duplicate_images"),
        F.count_if(F.col("_object") > 0).alias("duplicate_annotations"),
    )
    totals = images.groupBy("dataset").agg(F.count(F.lit(1)).alias("images"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return totals.join(found, "dataset", "left").select(
        "dataset",
        zero("links"),
        zero("duplicate_images"),
        zero("duplicate_annotations"),
        F.round(F.coalesce("duplicate_images", F.lit(0)) / F.col("images"), 6).alias("duplicate_ratio"),
    )


def same_content(rows: DataFrame, content: Column, id_col: str) -> DataFrame:
    """Each row whose content hash was seen before, with the first id that had it."""
    hashed = rows.select(id_col, F.sha2(content, 256).alias("hash"))
    return copies(hashed, ["hash"], id_col, [id_col]).select("original_id", F.col(id_col).alias("duplicate_id"), "hash")


def same_bytes(rows: DataFrame, content: Column, path: str) -> DataFrame:
    """Paths whose MD5 was seen at an earlier path."""
    hashed = rows.select(path, F.md5(content).alias("hash"))
    return copies(hashed, ["hash"], path, [path]).select(F.col(path).alias("duplicate_path"))


SIZE_KEY = ("width", "height", "format")


def _sized(images: DataFrame) -> DataFrame:
    return images.select("id", "file_path", *SIZE_KEY).where("width IS NOT NULL AND height IS NOT NULL AND format IS NOT NULL")


def same_size_groups(images: DataFrame) -> DataFrame:
    """Groups of images of equal size and format that hold different paths: members, first
    id, and the number of pairs of different path."""
    choose_two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    paths = _sized(images).groupBy(*SIZE_KEY, "file_path").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first"))
    return (
        paths.groupBy(*SIZE_KEY)
        .agg(F.sum("m").alias("members"), F.min("first").alias("first_id"), F.sum(choose_two("m")).alias("same_path"))
        .where("members > 1")
        .withColumn("pairs", (choose_two("members") - F.col("same_path")).cast("long"))
        .where("pairs > 0")
        .drop("same_path")
    )


def near_duplicates(images: DataFrame) -> DataFrame:
    """Images of equal size and format, linked to the first of their group.

    ``pairs`` is the number of pairs of different path in the whole group. The pairs
    themselves would grow with the square of the group; the links name the same groups.
    """
    rows = _sized(images)
    return join_group_summary(rows, same_size_groups(images), SIZE_KEY, "members", ["id"]).where("id <> first_id").select(
        F.col("first_id").alias("group_id"), F.col("id").alias("member_id"), "members", "pairs"
    )


def annotation_signatures(annotations: DataFrame) -> DataFrame:
    """Annotations that repeat image, box and label, with the first id."""
    rows = annotations.select("image_id", *BOX, "label", "id", *SEQUENCE)
    return copies(rows, ["image_id", *BOX, "label"], "id", ["id", *SEQUENCE]).select(
        "original_id", F.col("id").alias("duplicate_id"), "image_id"
    )


def repeated_ids(images: DataFrame, annotations: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ids used more than once over images and annotations together."""
    ids = images.select(*by, "id").unionByName(annotations.select(*by, "id"))
    return ids.groupBy(*by, "id").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
