"""Merging data sets and splitting them reproducibly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom import config
from labelloom.operators.skew import bucketed_row_number, hash_bucket, join_group_summary, ranged
from labelloom.operators.stats import with_class

BACKGROUND = "__background__"


# Merge ------------------------------------------------------------------------------


def merge_prefixed(images: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids prefixed with the data set, and every annotation given its final class."""
    prefixed = lambda c: F.concat_ws("_", "dataset", F.col(c).cast("string"))
    pics = images.withColumn("id", prefixed("id"))
    labels = with_class(annotations, "ontology_class").withColumn("image_id", prefixed("image_id"))
    return pics, labels


def merged_classes(annotations: DataFrame) -> DataFrame:
    return with_class(annotations).select("class_name").distinct()


def resolve_collisions(images: DataFrame, prefix: str = "merged") -> DataFrame:
    """What becomes of each image when data sets are merged in the order of ``place``.

    The first image of an id keeps it. A later one with the same path is dropped as a
    copy; one with another path is renamed, with its data set in the name, and kept.
    """
    order = F.struct("place", "file_path")
    first = images.groupBy("id").agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    joined = join_group_summary(images, first, ["id"], "_n", ["place", "file_path"])
    is_first = order == F.col("_first")
    fate = F.when(is_first, "kept").when(F.col("file_path") == F.col("_first.file_path"), "dropped").otherwise("renamed")
    name = F.concat_ws("_", F.lit(prefix), F.col("id").cast("string"), "source")
    return joined.withColumn("fate", fate).withColumn(
        "new_id", F.when(F.col("fate") == "kept", F.col("id").cast("string")).when(F.col("fate") == "renamed", name)
    ).drop("_n", "_first")


def merge_annotations(annotations: DataFrame, resolved: DataFrame, prefix: str = "ann") -> DataFrame:
    """Annotations of the images that were kept, under new ids that depend only on the
    source and the old id."""
    target = resolved.where("new_id IS NOT NULL").select("source", F.col("id").alias("image_id"), F.col("new_id").alias("new_image_id"))
    tail = F.substring(F.md5(F.concat_ws("|", "source", F.col("id").cast("string"))), 1, 8)
    return annotations.join(target, ["source", "image_id"]).withColumn(
        "new_id", F.concat_ws("_", F.lit(prefix), F.col("id").cast("string"), tail)
    )


def merge_report(resolved: DataFrame, merged: DataFrame) -> DataFrame:
    """Images and annotations of the merged set and the collisions met."""
    pics = resolved.groupBy().agg(
        F.count("new_id").alias("images"),
        F.count_if(F.col("fate") != "kept").alias("deduplicated"),
        F.count_if(F.col("fate") == "renamed").alias("renamed"),
        F.count_distinct("source").alias("sources"),
    )
    labels = merged.groupBy().agg(F.count(F.lit(1)).alias("annotations"))
    return pics.withColumn("annotations", labels.scalar())


def class_differences(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Classes found but not expected, expected but not found, and in both."""
    mark = lambda df, kind: df.select("class_name", F.lit(kind).alias("kind"))
    return (
        mark(found.select("class_name").exceptAll(expected.select("class_name")).distinct(), "unknown")
        .unionByName(mark(expected.select("class_name").subtract(found.select("class_name")), "unused"))
        .unionByName(mark(found.select("class_name").intersect(expected.select("class_name")), "covered"))
    )


def common_unique_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Classes of two profiles: common, only in one, and their union."""
    a, b = left.select("class_name"), right.select("class_name")
    mark = lambda df, kind: df.select("class_name", F.lit(kind).alias("kind"))
    return (
        mark(a.intersect(b), "common")
        .unionByName(mark(a.subtract(b), "only_left"))
        .unionByName(mark(b.subtract(a), "only_right"))
        .unionByName(mark(a.union(b).distinct(), "all"))
    )


# Split ------------------------------------------------------------------------------


def check_ratios(train: float, validation: float, test: float, exact: bool = True) -> None:
    """Raise unless the ratios sum to 1, or to at most 1 when ``exact`` is false."""
    total = train + validation + test
    if min(train, validation, test) < 0:
        raise ValueError("split ratios must not be negative")
    if exact and abs(total - 1.0) > 1e-6:
        raise ValueError(f"split ratios must sum to 1, not {total}")
    if not exact and total > 1.0 + 1e-9:
        raise ValueError(f"split ratios must sum to at most 1, not {total}")


def _shuffled(images: DataFrame, group: Sequence[str], seed: int, digits: int) -> DataFrame:
    """Rank in a seeded order per group. The order is that of a hash of id and seed, and
    the hash prefix cuts each group into even buckets."""
    hashed = images.withColumn("_h", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))))).withColumn(
        "_bucket", hash_bucket(F.col("_h"), digits)
    )
    ranked = bucketed_row_number(hashed, group, "_bucket", ["_h", "id"], "_rank")
    return ranked.drop("_h", "_bucket")


def _cut(
    images: DataFrame, group: Sequence[str], seed: int, digits: int, train: Column, validation: Column
) -> DataFrame:
    """Train up to ``train`` rows of each group, validation up to ``validation`` more."""
    ranked = _shuffled(images, group, seed, digits)
    if group:
        sizes = images.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
        sized = join_group_summary(ranked, sizes, list(group), "_n", ["id"])
    else:
        sized = ranked.withColumn("_n", images.agg(F.count(F.lit(1)).alias("n")).scalar())
    rank = F.col("_rank")
    split = F.when(rank <= train, "train").when(rank <= train + validation, "validation").otherwise("test")
    return sized.withColumn("split", split).drop("_rank", "_n")


def random_split(
    images: DataFrame,
    train: float = config.TRAIN_RATIO,
    validation: float = config.VALIDATION_RATIO,
    test: float = config.TEST_RATIO,
    seed: int = config.SPLIT_SEED,
    group: Sequence[str] = (),
    at_least_one: bool = False,
    digits: int = 3,
) -> DataFrame:
    """Seeded split with floor(n x ratio) rows in train and validation; the rest is test.

    ``at_least_one`` puts one row into train whatever the ratio.
    """
    check_ratios(train, validation, test, exact=False)
    n = F.col("_n")
    first = F.floor(n * train)
    if at_least_one:
        first = F.greatest(F.lit(1), first)
    return _cut(images, group, seed, digits, first, F.floor(n * validation))


def first_class(images: DataFrame, annotations: DataFrame, order: Sequence[str] = ("id", "seq1", "seq2")) -> DataFrame:
    """Class of each image's first annotation; images without any are background."""
    labels = with_class(annotations).groupBy(F.col("image_id").alias("id")).agg(
        F.min(F.struct(*order, "class_name")).alias("_f")
    )
    return images.join(labels, "id", "left").withColumn("stratum", F.coalesce("_f.class_name", F.lit(BACKGROUND))).drop("_f")


def commonest_class(images: DataFrame, annotations: DataFrame) -> DataFrame:
    """The class of each image that is most frequent in the whole set."""
    labels = with_class(annotations)
    counts = labels.groupBy("class_name").agg(F.count(F.lit(1)).alias("_count"))
    per_image = labels.select(F.col("image_id").alias("id"), "class_name").distinct().join(counts, "class_name")
    best = per_image.groupBy("id").agg(F.min(F.struct((-F.col("_count")).alias("c"), "class_name")).alias("_b"))
    return images.join(best, "id", "left").withColumn("stratum", F.coalesce("_b.class_name", F.lit(BACKGROUND))).drop("_b")


def stratified_split(
    strata: DataFrame,
    train: float = config.TRAIN_RATIO,
    validation: float = config.VALIDATION_RATIO,
    test: float = config.TEST_RATIO,
    seed: int = config.SPLIT_SEED,
    fill_small: bool = True,
    digits: int = 3,
) -> DataFrame:
    """Split within each ``stratum``. With ``fill_small`` a stratum gives at least one row
    to train and, from two rows on, one to validation."""
    check_ratios(train, validation, test)
    n = F.col("_n")
    first, second = F.floor(n * train), F.floor(n * validation)
    if fill_small:
        first = F.greatest(F.lit(1), first)
        second = F.when(n > 1, F.greatest(F.lit(1), second)).otherwise(second)
    return _cut(strata, ["stratum"], seed, digits, first, second)


#: Steps of a sequence that fills 0 to 2**32 evenly, however long it goes on.
_STEP = 2_654_435_769


def balanced_split(
    images: DataFrame,
    annotations: DataFrame,
    train: float = config.TRAIN_RATIO,
    validation: float = config.VALIDATION_RATIO,
    test: float = config.TEST_RATIO,
    seed: int = config.SPLIT_SEED,
) -> DataFrame:
    """Images with a split in which every label has about the ratios of the whole.

    Images are put in the order of their labels, the rarest label first, and by a seeded hash
    where they carry the same ones. Along this order they take evenly spread turns, so any
    stretch of it, such as the images of one rare label, is shared out by the ratios. Of n
    images floor(n x ratio) go to train and to validation and the rest to test. Ids are unique.
    """
    check_ratios(train, validation, test)
    carried = with_class(annotations).select(F.col("image_id").alias("id"), "class_name").distinct()
    counts = carried.groupBy("class_name").agg(F.count(F.lit(1)).alias("_count"))
    listed = carried.join(counts, "class_name").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("_count", "class_name"))).alias("_labels"))
    named = F.array_join(F.transform("_labels", lambda x: F.concat(F.lpad(x["_count"].cast("string"), 12, "0"), x["class_name"])), "|")
    hashed = F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))))
    rows = images.select("id").join(listed, "id", "left").select("id", F.coalesce(named, F.lit("")).alias("_labels"), hashed.alias("_h"))
    order = ["_labels", "_h", "id"]
    ranked = bucketed_row_number(ranged(rows, [], order), [], "_range", order, "_rank")
    turn = ((F.col("_rank") % (1 << 31)) * F.lit(_STEP)) % (1 << 32)
    turns = ranked.select("id", turn.alias("_turn")).withColumn("_bucket", F.shiftright("_turn", 20))
    placed = bucketed_row_number(turns, [], "_bucket", ["_turn", "id"], "_place")
    n = images.agg(F.count(F.lit(1)).alias("n")).scalar()
    first, second = F.floor(n * train), F.floor(n * validation)
    split = F.when(F.col("_place") <= first, "train").when(F.col("_place") <= first + second, "validation").otherwise("test")
    return images.join(placed.select("id", split.alias("split")), "id")


def split_annotations(annotations: DataFrame, assigned: DataFrame) -> DataFrame:
    """Annotations with the split of their image; those without image are left out."""
    return annotations.join(assigned.select(F.col("id").alias("image_id"), "split"), "image_id")
