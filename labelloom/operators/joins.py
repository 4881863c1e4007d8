"""Joins between images, annotations, categories, rules and names.

Annotations of one image may be a large part of the table. The joins below keep the
annotation side on the left of inner or left joins, which adaptive execution can split
when a key is skewed; nothing after them relies on their partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text
from labelloom.functions.patterns import required
from labelloom.operators.skew import join_on, salted_join, top_k
from labelloom.session import stored


def with_image(annotations: DataFrame, images: DataFrame, columns: Sequence[str] = ("width", "height")) -> DataFrame:
    """Annotations with columns of their image as ``image_*``; ``has_image`` tells orphans."""
    picked = images.select(
        F.col("id").alias("image_id"), *[F.col(c).alias(f"image_{c}") for c in columns], F.lit(True).alias("_hit")
    ).dropDuplicates(["image_id"])
    return (
        annotations.join(picked, "image_id", "left")
        .withColumn("has_image", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def with_category(annotations: DataFrame, categories: DataFrame, default: Column | None = None) -> DataFrame:
    """Category name by id; without one, ``default`` or the id as text."""
    names = categories.select(F.col("id").alias("category_id"), F.col("name").alias("_name"))
    fallback = F.col("category_id").cast("string") if default is None else default
    return annotations.join(names, "category_id", "left").withColumn("category_name", F.coalesce("_name", fallback)).drop("_name")


def images_without_annotations(images: DataFrame, annotations: DataFrame) -> DataFrame:
    return images.join(annotations.select(F.col("image_id").alias("id")), "id", "left_anti")


def orphan_annotations(annotations: DataFrame, images: DataFrame) -> DataFrame:
    return annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_anti")


def images_with_label(images: DataFrame, annotations: DataFrame, label: Column) -> DataFrame:
    return images.join(annotations.where(label).select(F.col("image_id").alias("id")), "id", "left_semi")


def rules_for_labels(labels: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule whose lower-cased label equals a label's."""
    keyed = rules.withColumn("_key", F.lower(F.trim("source_label")))
    return labels.withColumn("_key", F.lower(F.trim("label"))).join(keyed, "_key").drop("_key")


def by_stem(files: DataFrame, others: DataFrame, path: str = "path", within: Sequence[str] = ()) -> DataFrame:
    """Files of two listings that share a name without extension and the columns ``within``,
    such as the data set and the folder, so that one source never meets another."""
    left = files.withColumn("stem", text.stem(F.col(path)))
    right = others.select(*within, text.stem(F.col(path)).alias("stem"), F.col(path).alias(f"other_{path}"))
    return join_on(left, right, [*within, "stem"])


def name_matches(names: DataFrame, others: DataFrame, name: str = "name", other: str = "other") -> DataFrame:
    """Pairs that share a token of three or more characters, or where all tokens of the
    shorter name are in the longer one. Both sides are lists of distinct names.

    Either way the pair shares a token, so tokens carry the join.
    """

    def exploded(df: DataFrame, c: str, side: str) -> DataFrame:
        found = text.tokens(text.spaced(F.col(c)))
        return df.select(c).distinct().select(
            c, F.size(found).alias(f"_{side}"), F.explode(found).alias("token")
        )

    shared = exploded(names, name, "left").join(exploded(others, other, "right"), "token")
    folded = shared.groupBy(name, other).agg(
        F.max(F.length("token")).alias("_longest"),
        F.count(F.lit(1)).alias("shared_tokens"),
        F.least(F.first("_left"), F.first("_right")).alias("_shorter"),
    )
    return folded.where((F.col("_longest") >= 3) | (F.col("shared_tokens") == F.col("_shorter"))).select(
        name, other, "shared_tokens"
    )


def _pieces(c: Column, sizes: Sequence[int]) -> Column:
    """Distinct substrings of the given sizes, cut in one pass over the text for each size."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in sizes]))


def contains_join(needles: DataFrame, needle: str, haystacks: DataFrame, haystack: str) -> DataFrame:
    """Pairs where the haystack contains the needle, as an equi-join on substrings.

    A needle is looked up by its rarest piece of three characters (or by itself when it
    is shorter), so the candidates are few; ``contains`` then decides. Empty needles
    match nothing. Pieces carry a digest of their text, not the text, and salts spread a
    piece that occurs in most haystacks.
    """
    words = needles.where(F.length(needle) > 0).select(needle).distinct()
    keyed = words.select(
        needle,
        F.explode(F.when(F.length(needle) >= 3, _pieces(F.col(needle), (3,))).otherwise(F.array(F.col(needle)))).alias("_piece"),
    )
    texts = haystacks.select(haystack, F.md5(F.col(haystack).cast("binary")).alias("_text_id")).dropDuplicates(["_text_id"])
    wanted = keyed.select("_piece").distinct()
    posted = texts.select("_text_id", F.explode(_pieces(F.col(haystack), (1, 2, 3))).alias("_piece")).join(
        wanted, "_piece", "left_semi"
    )
    frequency = posted.groupBy("_piece").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (
        keyed.join(frequency, "_piece", "left")
        .groupBy(needle)
        .agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_piece").alias("p"))).alias("_best"))
        .select(needle, F.col("_best.p").alias("_piece"))
    )
    met = salted_join(posted, rarest, ["_piece"], ["_text_id"]).select(needle, "_text_id")
    return met.join(texts, "_text_id").where(F.contains(haystack, needle)).select(needle, haystack)


def labels_in_nodes(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ontology nodes whose name or value contains the label, whatever the case."""
    lowered = labels.select(F.col("label"), F.lower("label").alias("_needle")).distinct()
    hay = nodes.where("value <> 'root'").select(
        "value", "name", F.explode(F.array(F.lower("name"), F.lower("value"))).alias("_hay")
    )
    found = contains_join(lowered, "_needle", hay, "_hay")
    return lowered.join(found, "_needle").join(hay, "_hay").select("label", "value", "name").distinct()


def pattern_index(rules: DataFrame) -> DataFrame:
    """``pattern, literal``: texts of which a match of the pattern contains at least one; a
    null literal where the pattern tells none. Patterns are read once, so it is stored."""
    patterns = rules.select("pattern").distinct()
    return stored(patterns.select("pattern", F.explode_outer(required("pattern")).alias("literal")), "pattern-index")


def pattern_candidates(labels: DataFrame, index: DataFrame) -> DataFrame:
    """``label, pattern`` where the label contains a text that the pattern needs.

    The texts are found through their rarest piece of three characters, so a label meets
    only the patterns that share it.
    """
    lowered = labels.select("label", F.lower("label").alias("_low")).distinct()
    wanted = index.where("literal IS NOT NULL")
    held = contains_join(wanted, "literal", lowered, "_low")
    return lowered.join(held, "_low").join(wanted, "literal").select("label", "pattern").distinct()


def regex_matches(labels: DataFrame, rules: DataFrame, per_chunk: int = 500, few: int = 0) -> DataFrame:
    """Labels with the pattern rules they match, case-insensitively, anywhere.

    Patterns are tried on the labels that contain a text they need. Those that need none,
    such as classes of characters alone, are tried on every label, in chunks of bounded size.
    Up to ``few`` rules are tried on every label without looking for their texts first.
    """
    if rules.limit(few + 1).count() <= few:
        return _tried_in_chunks(labels, rules, per_chunk)
    index = pattern_index(rules)
    matches = F.regexp_like(F.col("label"), F.concat(F.lit("(?i)"), F.col("pattern")))
    met = pattern_candidates(labels, index).where(matches)
    found = met.join(rules.select("pattern", "canonical_value", "confidence"), "pattern").select("label", "pattern", "canonical_value", "confidence")
    rest = rules.join(index.where("literal IS NULL").select("pattern"), "pattern", "left_semi")
    if index.where("literal IS NULL").isEmpty():
        return found
    return found.unionByName(_tried_in_chunks(labels, rest, per_chunk))


def _tried_in_chunks(labels: DataFrame, rules: DataFrame, per_chunk: int) -> DataFrame:
    """Each label meets each chunk of rules once, and its patterns are tried inside the row."""
    n = rules.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per_chunk)).cast("int").alias("n")).scalar()
    chunks = (
        rules.withColumn("_chunk", F.pmod(F.xxhash64("pattern", "canonical_value"), n).cast("int"))
        .groupBy("_chunk")
        .agg(F.collect_list(F.struct("pattern", "canonical_value", "confidence")).alias("_rules"))
    )
    every = labels.select("label").distinct().withColumn("_chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    hit = F.filter("_rules", lambda r: F.regexp_like(F.col("label"), F.concat(F.lit("(?i)"), r["pattern"])))
    return salted_join(every, chunks, ["_chunk"], ["label"]).select("label", F.inline(hit))


def keyword_sources(nodes: DataFrame, sources: DataFrame, limit: int) -> DataFrame:
    """First ``limit`` sources whose name or description contains a keyword part of a node.

    The first sources are taken per keyword before they are merged per node; the first
    of the union are among the firsts of its parts, so nothing is lost.
    """
    parts = F.flatten(F.transform("keywords", lambda k: F.split(text.spaced(k), r"\s+")))
    wanted = nodes.select("node_id", F.explode(F.array_distinct(parts)).alias("part")).where("part <> ''")
    described = sources.select("source_id", F.lower(F.concat_ws("\n", "name", "description")).alias("_text"))
    hits = contains_join(wanted, "part", described, "_text").join(described, "_text").select("part", "source_id")
    first = top_k(hits.distinct(), ["part"], ["source_id"], limit).drop("rank")
    return top_k(wanted.join(first, "part").select("node_id", "source_id").distinct(), ["node_id"], ["source_id"], limit)
