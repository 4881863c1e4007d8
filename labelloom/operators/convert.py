"""Source annotations to canonical ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions import geometry
from labelloom.functions.geometry import Box


def to_canonical(source: DataFrame, labels: DataFrame) -> DataFrame:
    """Pixel boxes with canonical label and name.

    ``labels`` maps a category name to its canonical value. A category without one keeps
    its row with ``is_unmapped`` set, so that it can be reported instead of ending the
    run. Centre-form boxes (``yolo``) are moved to their corner; polygons give their
    bounding box; a missing confidence is 1.
    """
    c = F.col
    sized = F.coalesce((c("image_width") > 0) & (c("image_height") > 0), F.lit(False))
    scaled = sized & ((c("coordinate_system") == "normalized") | c("geometry_type").isin("normalized", "yolo"))
    sx, sy = F.when(scaled, c("image_width")).otherwise(1), F.when(scaled, c("image_height")).otherwise(1)
    plain = [F.get("coordinates", i) for i in range(4)]
    centred = c("geometry_type") == "yolo"
    left = F.when(centred, plain[0] - plain[2] / 2).otherwise(plain[0])
    top = F.when(centred, plain[1] - plain[3] / 2).otherwise(plain[1])
    outline = geometry.coordinate_pairs_box(c("coordinates"))
    polygon = c("geometry_type") == "polygon"
    pick = lambda a, b: F.when(polygon, a).otherwise(b)
    box = Box(pick(outline.a, left * sx), pick(outline.b, top * sy), pick(outline.c, plain[2] * sx), pick(outline.d, plain[3] * sy))
    table = labels.select(F.col("label").alias("category_name"), F.col("canonical_value").alias("canonical_label"))
    name = F.replace(F.initcap(F.translate("canonical_label", ".-_", "   ")), F.lit(" "), F.lit("_"))
    return source.join(table, "category_name", "left").select(
        *[k for k in source.columns if k not in ("coordinates", "confidence", "geometry_type")],
        "canonical_label",
        name.alias("canonical_name"),
        F.when(c("geometry_type").isin("bbox", "normalized", "yolo"), "bbox").otherwise(c("geometry_type")).alias("geometry_type"),
        *box.named(("x", "y", "width", "height")),
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"),
        c("canonical_label").isNull().alias("is_unmapped"),
    )
