"""Confidence arithmetic and range checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom import config
from labelloom.functions.bins import clamp


def adjust(detector: Column, concept: Column, depth: Column) -> Column:
    """Concept confidence, less 5 % per hop, never above the detector's."""
    return F.round(clamp(F.least(concept * F.pow(F.lit(config.DEPTH_PENALTY), depth), detector), 0.0, 1.0), 3)


def adjust_by_source(detector: Column, concept: Column, source: Column) -> Column:
    pairs = [F.lit(v) for item in config.SOURCE_MULTIPLIER.items() for v in item]
    factor = F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit(1.0))
    return F.round(clamp(F.least(concept * factor, detector), 0.0, 1.0), 3)


def reliability(success: Column, failures: Column) -> Column:
    total = success + failures
    share = clamp(success / F.nullif(total, F.lit(0)), config.MIN_RELIABILITY, config.MAX_RELIABILITY)
    return F.when(total == 0, 0.5).otherwise(share)


def box_in_range(width: Column, height: Column) -> Column:
    return F.coalesce((width > 0) & (height > 0), F.lit(False))


def confidence_in_range(c: Column) -> Column:
    return F.coalesce(c.between(0.0, 1.0), F.lit(False))
