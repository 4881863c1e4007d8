"""License policy table and text classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.text import has_word

# License id, name, SPDX id, open, commercial use, modification,
# attribution, share-alike, risk, ids it is compatible with.
POLICY = [
    ("cc0", "CC0 1.0 Universal", "CC0-1.0", True, True, True, False, False, 0.0, ["cc_by_4", "mit", "apache_2"]),
    ("cc_by_4", "Creative Commons Attribution 4.0", "CC-BY-4.0", True, True, True, True, False, 0.1, ["cc0"]),
    ("cc_by_sa_4", "Creative Commons Attribution-ShareAlike 4.0", "CC-BY-SA-4.0", True, True, True, True, True, 0.2, ["cc0", "cc_by_4"]),
    ("cc_nc", "Creative Commons Non-Commercial", "CC-BY-NC-4.0", True, False, True, True, False, 0.6, []),
    ("mit", "MIT License", "MIT", True, True, True, True, False, 0.05, ["cc0", "apache_2"]),
    ("apache_2", "Apache License 2.0", "Apache-2.0", True, True, True, True, False, 0.05, ["cc0", "mit"]),
    ("odbl", "Open Database License", "ODbL", True, True, True, True, True, 0.3, ["cc0"]),
    ("pddl", "Public Domain Dedication and License", "PDDL", True, True, True, False, False, 0.0, ["cc0", "mit", "apache_2", "cc_by_4"]),
    ("proprietary", "Proprietary License", "LicenseRef-Proprietary", False, False, False, True, False, 1.0, []),
    ("unknown", "Unknown License", "", False, False, False, True, False, 0.8, []),
]
ALLOWED = ("cc0", "cc_by_4", "cc_by_sa_4", "mit", "apache_2", "odbl", "pddl")
RESTRICTED = ("cc_nc", "cc_by_nc", "unknown", "proprietary")

_SCHEMA = (
    "license_id string, name string, spdx string, is_open boolean, commercial boolean, modification boolean, "
    "attribution boolean, share_alike boolean, risk double, compatible array<string>"
)


def policy(spark: SparkSession) -> DataFrame:
    """The policy table: ten rows, whatever the data."""
    return spark.createDataFrame(POLICY, _SCHEMA)


def _exact(text: Column) -> Column:
    """License whose id, SPDX id or name is exactly the text."""
    found = None
    for license_id, name, spdx, *_ in POLICY:
        names = sorted({n.lower() for n in (license_id, name, spdx)})
        hit = text.isin(*names)
        found = F.when(hit, license_id) if found is None else found.when(hit, license_id)
    return found


def classify(text: Column, whole_word: bool = False) -> Column:
    """License id of a license statement: exact name first, then keywords.

    Keywords are plain substrings, so ``cc`` is also found inside longer words;
    ``whole_word`` asks for word borders instead.
    """
    t = F.lower(F.trim(text))

    def has(*needles: str) -> Column:
        hit = has_word(t, needles[0], whole_word)
        for needle in needles[1:]:
            hit = hit | has_word(t, needle, whole_word)
        return hit

    creative = (
        F.when(has("noncommercial", "nc"), "cc_nc")
        .when(has("zero", "cc0"), "cc0")
        .when(has("attribution") & has("sharealike", "sa"), "cc_by_sa_4")
        .otherwise("cc_by_4")
    )
    ladder = (
        F.when(has("creative commons", "cc"), creative)
        .when(has("mit"), "mit")
        .when(has("apache"), "apache_2")
        .when(has("public domain"), "cc0")
        .when(has("proprietary", "all rights reserved"), "proprietary")
        .otherwise("unknown")
    )
    return F.coalesce(_exact(t), ladder)


def classify_file(text: Column) -> Column:
    """License id of a license file: a shorter ladder than :func:`classify`."""
    t = F.lower(text)
    return (
        F.when(
            t.contains("creative commons") | t.contains("cc"),
            F.when(t.contains("noncommercial") | t.contains("nc"), "cc_nc")
            .when(t.contains("zero") | t.contains("cc0"), "cc0")
            .otherwise("cc_by_4"),
        )
        .when(t.contains("mit") & t.contains("license"), "mit")
        .otherwise("unknown")
    )


def risk(license_id: Column) -> Column:
    """Risk from the fixed table, as an expression so that no join is needed."""
    return F.element_at(F.create_map(*[F.lit(v) for row in POLICY for v in (row[0], row[8])]), license_id)


def compatibility(a: str, b: str) -> Column:
    """0..1 compatibility of two policy structs ``a`` and ``b``."""
    x, y = F.col(a), F.col(b)
    listed = F.array_contains(x["compatible"], y["license_id"]) | F.array_contains(y["compatible"], x["license_id"])
    return (
        F.when(x["license_id"] == y["license_id"], 1.0)
        .when(~x["is_open"] | ~y["is_open"], 0.0)
        .when(listed, 0.9)
        .when(x["share_alike"] != y["share_alike"], 0.3)
        .when(x["commercial"] & y["commercial"], 0.7)
        .otherwise(0.2)
    )
