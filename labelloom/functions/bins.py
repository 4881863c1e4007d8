"""Bins and grades."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def size_bin(v: Column) -> Column:
    return (
        F.when(v < 32, "tiny").when(v < 64, "small").when(v < 128, "medium").when(v < 256, "large").otherwise("xlarge")
    )


def aspect_bin(ratio: Column) -> Column:
    return F.when(ratio < 0.5, "tall").when(ratio < 1.5, "square").when(ratio < 3.0, "wide").otherwise("xwide")


def resolution_detail(w: Column, h: Column) -> Column:
    """Four steps: hd, 720p, vga, low."""
    return (
        F.when((w >= 1920) & (h >= 1080), "hd")
        .when((w >= 1280) & (h >= 720), "720p")
        .when((w >= 640) & (h >= 480), "vga")
        .otherwise("low")
    )


def resolution_level(w: Column, h: Column) -> Column:
    """Three steps: high, medium, low."""
    return F.when((w >= 1920) & (h >= 1080), "high").when((w >= 640) & (h >= 480), "medium").otherwise("low")


def letter_grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F")


def coverage_status(percent: Column) -> Column:
    return F.when(percent >= 95, "HEALTHY").when(percent >= 80, "ACCEPTABLE").otherwise("NEEDS_ATTENTION")


def gap_impact(severity: Column) -> Column:
    return F.when(severity >= 0.8, "critical").when(severity >= 0.6, "high").when(severity >= 0.4, "medium").otherwise("low")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
