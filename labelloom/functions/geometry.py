"""Box and polygon arithmetic on columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX_FORMATS = (
    "xyxy_normalized",
    "xyxy_absolute",
    "xywh_normalized",
    "xywh_absolute",
    "cxcywh_normalized",
    "cxcywh_absolute",
)


@dataclass(frozen=True)
class Box:
    """Four columns; what they mean is said by the function that returns them."""

    a: Column
    b: Column
    c: Column
    d: Column

    def named(self, names: tuple[str, str, str, str]) -> list[Column]:
        return [v.alias(n) for v, n in zip((self.a, self.b, self.c, self.d), names)]


def _ratio(num: Column, den: Column) -> Column:
    """Null instead of an error when the size is unknown or zero."""
    return num / F.nullif(den, F.lit(0))


def corners_from(box: Box, fmt: Column, width: Column, height: Column) -> Box:
    """Normalised corners x1, y1, x2, y2 from any of :data:`BOX_FORMATS`."""
    absolute = fmt.endswith("_absolute")
    centred = fmt.startswith("cxcywh")
    corner = fmt.startswith("xyxy")
    known = fmt.isin(*BOX_FORMATS)

    def axis(start: Column, extent: Column, side: Column) -> tuple[Column, Column]:
        low = F.when(centred, start - extent / 2).otherwise(start)
        high = F.when(corner, extent).when(centred, start + extent / 2).otherwise(start + extent)
        return (
            F.when(known, F.when(absolute, _ratio(low, side)).otherwise(low)),
            F.when(known, F.when(absolute, _ratio(high, side)).otherwise(high)),
        )

    x1, x2 = axis(box.a, box.c, width)
    y1, y2 = axis(box.b, box.d, height)
    return Box(x1, y1, x2, y2)


def box_error(box: Box, fmt: Column, width: Column, height: Column) -> Column:
    """Why a source box cannot be converted; null when it can."""
    sized = F.coalesce((width > 0) & (height > 0), F.lit(False))
    return (
        F.when((fmt == "xyxy") & (box.c < box.a), "xmax below xmin")
        .when((fmt == "xyxy") & (box.d < box.b), "ymax below ymin")
        .when(fmt.isin("xywh", "cxcywh") & ((box.c < 0) | (box.d < 0)), "negative extent")
        .when((fmt == "normalized_xywh") & ~sized, "image size required")
        .when(~fmt.isin("xyxy", "xywh", "cxcywh", "normalized_xywh"), "unknown format")
    )


def canonical_box(box: Box, fmt: Column, width: Column, height: Column) -> Box:
    """x, y, width, height in pixels; null where :func:`box_error` is set."""
    ok = box_error(box, fmt, width, height).isNull()
    sized = F.coalesce((width > 0) & (height > 0), F.lit(False))

    def axis(start: Column, extent: Column, side: Column) -> tuple[Column, Column]:
        scale = F.when(sized, side).otherwise(1)
        size = F.when(fmt == "xyxy", extent - start).when(fmt == "xywh", extent).otherwise(extent * scale)
        low = (
            F.when(fmt == "cxcywh", start * scale - extent * scale / 2)
            .when(fmt == "normalized_xywh", start * scale)
            .otherwise(start)
        )
        return F.when(ok, low), F.when(ok, size)

    x, w = axis(box.a, box.c, width)
    y, h = axis(box.b, box.d, height)
    return Box(x, y, w, h)


def normalize(box: Box, width: Column, height: Column) -> Box:
    w, h = F.when(width > 0, width), F.when(height > 0, height)
    return Box(box.a / w, box.b / h, box.c / w, box.d / h)


def denormalize(box: Box, width: Column, height: Column) -> Box:
    w, h = F.when(width > 0, width), F.when(height > 0, height)
    return Box(box.a * w, box.b * h, box.c * w, box.d * h)


def polygon_box(vertices: Column) -> Box:
    """Bounding x, y, width, height of an array of (x, y) structs with three or more points."""
    xs = F.transform(vertices, lambda p: p["x"])
    ys = F.transform(vertices, lambda p: p["y"])
    ok = F.size(vertices) >= 3
    return Box(
        F.when(ok, F.array_min(xs)),
        F.when(ok, F.array_min(ys)),
        F.when(ok, F.array_max(xs) - F.array_min(xs)),
        F.when(ok, F.array_max(ys) - F.array_min(ys)),
    )


def coordinate_pairs_box(flat: Column) -> Box:
    """Bounding box of a flat x0, y0, x1, y1, ... array."""
    xs = F.filter(flat, lambda v, i: i % 2 == 0)
    ys = F.filter(flat, lambda v, i: i % 2 == 1)
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def rotated_box(cx: Column, cy: Column, width: Column, height: Column, degrees: Column) -> Box:
    """Axis-parallel box around a rotated one."""
    cos, sin = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    w = width * cos + height * sin
    h = width * sin + height * cos
    return Box(cx - w / 2, cy - h / 2, w, h)


def centre_form(box: Box) -> Box:
    return Box(box.a + box.c / 2, box.b + box.d / 2, box.c, box.d)


def clamp_unit(box: Box) -> Box:
    def unit(v: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(v, F.lit(1.0)))

    return Box(unit(box.a), unit(box.b), unit(box.c), unit(box.d))


def area(width: Column, height: Column) -> Column:
    return width * height


def aspect_w_over_h(width: Column, height: Column, otherwise: float = 0.0) -> Column:
    return F.when(height > 0, width / F.nullif(height, F.lit(0))).otherwise(otherwise)


def aspect_h_over_w(width: Column, height: Column) -> Column:
    """Infinite when the width is not positive."""
    return F.when(width > 0, height / F.nullif(width, F.lit(0))).otherwise(float("inf"))
