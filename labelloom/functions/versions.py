"""Dotted versions as comparable structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(version: Column) -> Column:
    """``"1.2"`` becomes the struct (1, 2, 0); structs compare part by part."""
    parts = F.split(version, r"\.")

    def part(i: int) -> Column:
        return F.coalesce(F.try_element_at(parts, F.lit(i + 1)).try_cast("int"), F.lit(0))

    return F.struct(part(0).alias("major"), part(1).alias("minor"), part(2).alias("patch"))


def dotted(major: Column, minor: Column, patch: Column) -> Column:
    return F.concat_ws(".", major.cast("string"), minor.cast("string"), patch.cast("string"))


def compare(a: Column, b: Column) -> Column:
    x, y = parse(a), parse(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def bump(version: Column, level: str) -> Column:
    v = parse(version)
    zero = F.lit(0)
    return {
        "major": lambda: dotted(v["major"] + 1, zero, zero),
        "minor": lambda: dotted(v["major"], v["minor"] + 1, zero),
        "patch": lambda: dotted(v["major"], v["minor"], v["patch"] + 1),
    }[level]()


def rolling_bump(version: Column, patches: int = 20, minors: int = 10, initial: str = "1.0.0") -> Column:
    """Next patch; patch 20 turns into a minor step and minor 10 into a major step."""
    v = parse(version)
    patch = v["patch"] + 1
    minor = v["minor"] + F.when(patch >= patches, 1).otherwise(0)
    major = v["major"] + F.when(minor >= minors, 1).otherwise(0)
    stepped = dotted(
        major,
        F.when(minor >= minors, 0).otherwise(minor),
        F.when(patch >= patches, 0).otherwise(patch),
    )
    return F.when(version.rlike(r"^\d+\.\d+\.\d+$"), stepped).otherwise(initial)


def compatible(a: Column, b: Column) -> Column:
    return parse(a)["major"] == parse(b)["major"]
