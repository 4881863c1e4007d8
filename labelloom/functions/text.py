"""String functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import config

# Letters and digits of any script plus underscore.
_NOT_WORD = r"[^\p{L}\p{N}_]+"
_NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_\s\p{Z}]+"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty; the last one is taken as it is."""
    return F.coalesce(*[blank_to_null(c) for c in cols[:-1]], cols[-1])


def class_name(c: Column) -> Column:
    """``" Traffic-Light  red"`` becomes ``trafficlight_red``."""
    kept = F.regexp_replace(F.lower(c), _NOT_WORD_OR_SPACE, "")
    joined = F.regexp_replace(kept, r"[\s\p{Z}_]+", "_")
    return F.regexp_replace(joined, "^_+|_+$", "")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot; empty when the name has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def file_name(path: Column) -> Column:
    """Word-only lower-case stem with a known image extension."""
    name = F.regexp_replace(F.lower(stem(path)), _NOT_WORD, "-")
    name = F.regexp_replace(name, "^-+|-+$", "")
    ext = extension(path)
    return F.concat(name, F.when(ext.isin(*config.NORMALIZED_EXTENSIONS), ext).otherwise(".jpg"))


def spaced(c: Column) -> Column:
    """Lower case with runs of ``_`` and ``-`` as one space."""
    return F.trim(F.regexp_replace(F.lower(c), r"[_\-]+", " "))


def tokens(c: Column, min_length: int = 2) -> Column:
    """Distinct ASCII tokens of at least ``min_length`` characters, without duplicates."""
    pattern = "([a-z0-9]{%d,})" % min_length
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(1)))


def all_tokens(c: Column) -> Column:
    """All ASCII tokens in order, repeats kept."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))


def singular(word: Column) -> Column:
    n = F.length(word)
    return (
        F.when(word.endswith("ies"), F.concat(F.left(word, n - 3), F.lit("y")))
        .when(word.rlike("(ses|xes|shes|ches)$"), F.left(word, n - 2))
        .when(word.endswith("s") & ~word.endswith("ss"), F.left(word, n - 1))
        .otherwise(word)
    )


def character_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of characters, ignoring ``_`` and spaces."""

    def chars(c: Column) -> Column:
        bare = F.regexp_replace(c, "[_ ]", "")
        return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(bare, "")))

    left, right = chars(a), chars(b)
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(
        shared / (F.size(left) + F.size(right) - shared)
    )


def title(c: Column) -> Column:
    """``heavy_lorry`` becomes ``Heavy Lorry``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def last_part(value: Column) -> Column:
    return F.element_at(F.split(value, r"\."), -1)


def first_part(value: Column) -> Column:
    return F.split_part(value, F.lit("."), F.lit(1))


def either_contains(a: Column, b: Column) -> Column:
    x, y = spaced(a), spaced(b)
    return x.contains(y) | y.contains(x)


def has_word(text: Column, needle: str, whole_word: bool = False) -> Column:
    """Substring test; ``whole_word`` asks for word borders."""
    if whole_word:
        return text.rlike(r"(?i)(^|[^a-z0-9])" + needle + r"($|[^a-z0-9])")
    return text.contains(needle)
