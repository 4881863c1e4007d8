"""Registered queries."""

from __future__ import annotations


def catalogue():
    """All registered queries, in the order of the areas."""
    import importlib

    from labelloom.plans.registry import Registry

    registry = Registry()
    for area in AREAS:
        importlib.import_module(f"labelloom.plans.{area}").register(registry)
    return registry


AREAS = ("scalars", "aggregates", "labels", "quality", "records", "exports", "formats")
